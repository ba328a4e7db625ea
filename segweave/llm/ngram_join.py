"""N-gram Jaccard join: links documents whose sets of word n-grams have a Jaccard similarity of at least a threshold.

Words are runs of bytes other than blank and 0x09 to 0x0D in the lower-cased text; a document with fewer words than
``n`` has one gram, all its words. Grams are 64-bit hashes.

1. One pass writes a row per document: the hash of its gram set, and MinHash band hashes. ``plan_bands`` takes the most
   selective band size whose recall at the threshold reaches the target.
2. Documents with equal gram sets are one class; copies are collapsed before anything else is shuffled.
3. Classes meet on band hashes. A bucket gives each member one edge to its least member, never its pairs; the components of
   these edges hold every candidate pair, and a class with no partner in any band drops out here.
4. Only for the others the full gram sets are made, once each, and sent to their *groups*. Usually a group is a component:
   verifying all its pairs meets each pair once, where its buckets meet similar pairs in nearly every band. But a chain of
   different documents can be a component with far more pairs than its buckets have; a component of more than ``block``
   classes whose buckets have fewer pairs is therefore verified bucket by bucket, and a pair counts in the first band
   that it shares. Groups of more than ``block`` classes are dealt as tiles of two blocks each over the tasks. All pairs of
   a tile are verified on the full sets. A tile sends back counts and a spanning forest.
5. Components of the verified links are the groups; their least document stays.

Defined cases: null, empty and wordless texts have no grams, link with nothing and stay. Rows equal in id and text are one
document in ``kept`` (both rows have the same answer) and two in n_links. Null ids count as greatest. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, connected_components, map_rows, tiles_of
from .embed_dedup import forest
from .repeats import KEY, bytes_of, numbered
from .textnum import GRAM_CODES, U, gram_hashes, mix, word_hashes, word_spans

BLOCK = 512


def grams(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of the word n-grams of the whole text."""
    data = bytes_of(text.lower() if text else text)
    words = word_hashes(data, *word_spans(data))
    return np.unique(gram_hashes(words, min(n, len(words)))) if len(words) else np.empty(0, np.uint64)


def plan_bands(threshold: float, recall: float = 0.999, most_bands: int = 24) -> tuple[int, int]:
    """(bands, rows per band): the most rows for which at most ``most_bands`` bands find a pair at the threshold with this recall."""
    best = (most_bands, 1)
    for rows in range(1, 33):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-min(threshold**rows, 1 - 1e-12))))
        if bands > most_bands:
            break
        best = (bands, rows)
    return best


@lru_cache(maxsize=4)
def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(71)
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def band_hashes(own: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band; equal only where all minima of the band (and the band) are equal."""
    a, b = permutations(bands * rows)
    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    short = (own >> U(32)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        part = short[at : at + 2048]
        np.minimum(least, ((part[None, :] ^ b[:, None]) * a[:, None]).min(axis=1), out=least)
    return mix(least.reshape(bands, rows).astype(np.uint64) @ GRAM_CODES[:rows] + mix(np.arange(1, bands + 1, dtype=np.uint64)))


def signatures(rows: DataFrame, n: int, bands: int, per_band: int) -> DataFrame:
    """rank, row, node (hash of the gram set, null where it is empty), bands."""

    def run(batch):
        sets = [grams(t, n) for t in batch.column(2).to_pylist()]
        nodes = [int(mix(np.array([len(s)], np.uint64) + mix(s).sum(dtype=np.uint64)).view(np.int64)[0]) if len(s) else None for s in sets]
        made = [band_hashes(s, bands, per_band).view(np.int64) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(made, pa.list_(pa.int64()))], [*KEY, "node", "bands"])

    return map_rows(rows.select(*KEY, "text"), run, "rank long, row long, node long, bands array<long>", 256)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of gram sets."""
    out = np.zeros((len(left), len(right)), np.float32)
    flat = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in [*left, *right]])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(flat)))
    shared = size > 1
    column = np.repeat(np.cumsum(shared) - 1, size)  # grams of one set only take no part
    keep = np.repeat(shared, size)
    column, owner = column[keep], owner[keep]
    for lo in range(0, int(shared.sum()), 4096):  # columns are sorted: a strip of grams at a time
        a, b = np.searchsorted(column, [lo, lo + 4096])
        strip = np.zeros((len(left) + len(right), min(4096, int(shared.sum()) - lo)), np.float32)
        strip[owner[a:b], column[a:b] - lo] = 1
        out += strip[: len(left)] @ strip[len(left) :].T
    return out


def verified(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose Jaccard similarity reaches the threshold; i < j within one block."""
    other = left if right is None else right
    both = overlaps(left, other).astype(np.float64)
    size = np.add.outer(np.array([len(s) for s in left], np.float64), np.array([len(s) for s in other], np.float64))
    hit = both / (size - both) >= threshold
    return np.nonzero(np.triu(hit, 1) if right is None else hit)


def groups_of(near: DataFrame, classes: DataFrame, tables: Tables, block: int) -> DataFrame:
    """(node, groups): the groups that a class is sent to, as (group, band, blocks); band -1 is a whole component."""
    sizes = near.groupBy("component").agg(F.count("*").alias("m"))
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int").alias("blocks")
    large = tables.save(sizes.where(F.col("m") > block))
    if large.isEmpty():
        one = F.struct(F.col("component").alias("group"), F.lit(-1).alias("band"), blocks("m"))
        return near.join(sizes, "component").select("node", F.array(one).alias("groups"))
    held = near.join(large, "component").join(classes.select("node", "bands"), "node").select("component", "node", F.posexplode("bands").alias("band", "hash"))
    held = tables.save(held)
    buckets = tables.save(held.groupBy("component", "band", "hash").agg(F.count("*").alias("s")).where("s > 1"))
    cheap = buckets.groupBy("component").agg(F.sum(F.col("s").cast("double") * F.col("s")).alias("pairs")).join(large, "component").where(F.col("pairs") < F.col("m").cast("double") * F.col("m")).select("component")
    cheap = tables.save(cheap)
    # tables on both sides, so that Spark can split a component or bucket that holds much of all
    whole = near.join(tables.save(sizes), "component").join(cheap, "component", "left_anti").select("node", F.col("component").alias("group"), F.lit(-1).alias("band"), blocks("m"))
    apart = held.join(tables.save(buckets.join(cheap, "component", "left_semi")), ["component", "band", "hash"]).select("node", F.col("hash").alias("group"), "band", blocks("s"))
    return whole.unionByName(apart).groupBy("node").agg(F.collect_list(F.struct("group", "band", "blocks")).alias("groups"))  # at most one a band


def join(docs: DataFrame, tables: Tables, threshold: float = 0.8, n: int = 5, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(rank, row, id, n_links, component_id, kept) of every row; rank and row are those of ``numbered``."""
    bands, per_band = plan_bands(threshold, recall)
    rows = numbered(docs, id_col, text_col)
    signed = tables.save(signatures(rows, n, bands, per_band))
    classes = tables.save(signed.where("node is not null").groupBy("node").agg(F.min(F.struct(*KEY)).alias("head"), F.count("*").alias("n"), F.first("bands").alias("bands")))
    each = classes.select("node", F.explode("bands").alias("band"))
    buckets = each.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("m")).where("m > 1")
    edges = each.join(buckets, "band").select(F.col("node").alias("u"), F.col("least").alias("v"))
    near = tables.save(connected_components(edges, tables))  # (node, component)
    some = groups_of(near, classes, tables, block).join(classes.select("node", "n", "bands", "head.rank", "head.row"), "node")

    def sets(batch):
        made = [grams(t, n).astype("<u8").tobytes() for t in batch.column(4).to_pylist()]
        signs = [np.asarray(b.values, np.int64).tobytes() for b in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(signs, pa.binary()), pa.array(made, pa.binary())], ["groups", "node", "n", "bands", "grams"])

    # equal rows would bring a class's text twice: the tile keeps one of each node
    full = map_rows(rows.select(*KEY, "text").join(some, KEY).select("groups", "node", "n", "bands", "text"), sets, "groups array<struct<group:long,band:int,blocks:int>>, node long, n long, bands binary, grams binary", 256)
    placed = full.select(F.inline("groups"), "node", "n", "bands", "grams").withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    signs = F.when(F.col("band") >= 0, F.col("bands"))  # whole components need none
    dealt = placed.withColumn("tile", F.explode(tiles_of(F.col("b"), F.col("blocks")))).select("group", "band", "tile.x", "tile.y", "b", "node", "n", "grams", signs.alias("bands"))
    dealt = dealt.repartition("group", "band", "x", "y").sortWithinPartitions("group", "band", "x", "y", "b", "node")

    def answer(tile, own):
        _, band, x, _ = tile
        left = [r for r in own if r[4] == x]
        right = [r for r in own if r[4] != x]
        sets_of = lambda part: [np.frombuffer(r[7], "<u8") for r in part]
        i, j = verified(sets_of(left), sets_of(right) or None, threshold)
        other = right or left
        if band >= 0 and len(i):  # the pair counts where its first shared band is
            signs = lambda part: np.stack([np.frombuffer(r[8], "<i8") for r in part])
            a, b = signs(left), signs(other)
            first = np.concatenate([np.argmax(a[i[k : k + 4096]] == b[j[k : k + 4096]], axis=1) for k in range(0, len(i), 4096)])
            i, j = i[first == band], j[first == band]
        u, v = np.array([r[5] for r in left], np.int64)[i], np.array([r[5] for r in other], np.int64)[j]
        nu, nv = np.array([r[6] for r in left], np.int64)[i], np.array([r[6] for r in other], np.int64)[j]
        nodes, where = np.unique(np.concatenate([u, v]), return_inverse=True)
        total = np.zeros(len(nodes), np.int64)
        np.add.at(total, where, np.concatenate([nv, nu]))
        root = dict(forest(u, v))
        return [nodes, total, np.array([root.get(k, k) for k in nodes.tolist()], np.int64)]

    def run(batches):
        held, tile, out = [], None, []
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in range(3)], ["node", "n", "root"])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    if row[:4] != tile:
                        if tile and (tile[2] == tile[3] or any(r[4] != held[0][4] for r in held)):
                            out.append(answer(tile, held))
                        if len(out) >= 500:
                            yield pack(out)
                            out = []
                        held, tile = [], row[:4]
                    if not held or held[-1][5] != row[5]:
                        held.append(row)
        if tile and (tile[2] == tile[3] or any(r[4] != held[0][4] for r in held)):
            out.append(answer(tile, held))
        if out:
            yield pack(out)

    links = tables.save(dealt.mapInArrow(run, "node long, n long, root long"))
    groups = connected_components(links.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")), tables)
    placed = classes.select("node", "head", (F.col("n") - 1).alias("copies")).join(links.groupBy("node").agg(F.sum("n").alias("others")), "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = tables.save(placed)
    stays = tables.save(placed.groupBy("component").agg(F.min("head").alias("stay")))
    answers = placed.join(stays, "component").select("node", (F.col("copies") + F.coalesce("others", F.lit(0))).alias("n_links"), "stay")
    done = signed.drop("bands").join(answers, "node", "left")
    own = F.struct(*KEY)
    kind = docs.schema[id_col].dataType
    null_id = lambda c: F.when(c != (1 << 63) - 1, c).cast(kind)
    return done.select(*KEY, null_id(F.col("rank")).alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), null_id(F.coalesce("stay.rank", "rank")).alias("component_id"), (F.col("stay").isNull() | (F.col("stay") == own)).alias("kept"))
