"""Embedding near-dedup: links between vectors with cosine of at least a threshold, found from int8 tile products.

Equal vectors are collapsed first. The rest, as unit vectors, are quantised to int8 with a scale of their own: x = s*q + e, so
|x.y - s_x s_y q_x.q_y| <= |e_x| |y| + |s_x q_x| |e_y| <= e_x + e_y + e_x e_y for unit vectors. Blocks of quantised
vectors are multiplied tile by tile; products of int8 values are exact in single precision (dim * 127**2 < 2**24, else
double is used). A pair below the threshold by more than its bound is out; one above it by more than its bound is a link;
only the pairs between are recomputed from the original vectors in double precision. A tile sends back counts and a
spanning forest of its links, never the pairs, and holds the pairs of one strip at a time.

Vectors of each length are a table of their own: they have no cosine with others. Every pair of blocks is one row of work,
so tiles spread evenly however the vectors cluster. A vector travels to as many tiles as there are half blocks. The
number of blocks follows the square root of the cores, ``tiles_a_core`` tiles for each, and not the number of vectors,
until a block would exceed ``block_bytes`` of a task's memory; from there on the quadratic work by far outweighs moving.

Defined cases: vectors that are null, empty, zero, or with null or non-finite components link with nothing (n_links 0, a
component of their own). Rows with a null id are kept and link with nothing. Rows that repeat an id count as vectors
of their own in n_links. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, connected_components, tiles_of


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (by their greatest component first, so that nothing overflows)."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and upper bounds of the lengths of the errors."""
    scale = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / scale[:, None])
    error = np.sqrt(np.sum((x - q * scale[:, None]) ** 2, axis=1)) * (1 + 1e-9) + 1e-12
    return q.astype(np.int8), scale, error


def strips(a: tuple, b: tuple | None, threshold: float, rows: int = 512, columns: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked index pairs of two blocks (unit vectors, codes, scales, errors), or i < j of one block, a strip of the tile at a time."""
    xa, qa, sa, ea = a
    xb, qb, sb, eb = a if b is None else b
    kind = np.float32 if xa.shape[1] * 127**2 < 1 << 24 else np.float64
    right = np.ascontiguousarray(qb.T.astype(kind))
    for at in range(0, len(qa), rows):
        left, e_a, s_a = qa[at : at + rows].astype(kind), ea[at : at + rows].max(), sa[at : at + rows].max()
        for first in range(at if b is None else 0, len(qb), columns):
            product = left @ right[:, first : first + columns]
            # a product below this cannot reach the threshold, whatever the scales and errors of this strip
            e_b = eb[first : first + columns].max()
            least = (threshold - e_a - e_b - e_a * e_b) / (s_a * sb[first : first + columns].max())
            i, j = np.nonzero(product >= least) if least > 0 else np.nonzero(np.ones(product.shape, bool))
            value = product[i, j].astype(np.float64)
            i, j = i + at, j + first
            if b is None:
                keep = i < j
                i, j, value = i[keep], j[keep], value[keep]
            value = value * sa[i] * sb[j]
            bound = ea[i] + eb[j] + ea[i] * eb[j] + 1e-12
            sure = value - bound >= threshold
            doubt = np.flatnonzero(~sure & (value + bound >= threshold))
            for k in range(0, len(doubt), 1 << 16):
                pick = doubt[k : k + (1 << 16)]
                sure[pick] = np.einsum("ij,ij->i", xa[i[pick]], xb[j[pick]]) >= threshold
            if sure.any():
                yield i[sure], j[sure]


def fewer(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges (column, row) and (row, row) that connect what the edges (i, j) of a strip do: each column to its first row, and
    every row to the first rows of its columns."""
    low, wide = int(i.min()), int(i.max() - i.min()) + 1
    columns, first = np.unique(j, return_index=True)
    head = np.zeros(int(j.max()) + 1, np.int64)
    head[columns] = i[first]
    met = np.zeros(wide * wide, bool)
    met[(i - low) * wide + head[j] - low] = True
    row, other = np.divmod(np.flatnonzero(met), wide)
    apart = row != other
    return columns, i[first], row[apart] + low, other[apart] + low


def tile(a: tuple, b: tuple | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, number of links, least id they connect to) of the linked vectors of two blocks (ids, counts, vectors), or of one."""
    ids, counts, own = a
    other_ids, other_counts, other = b or a
    n, m = np.zeros(len(ids), np.int64), np.zeros(len(other_ids), np.int64)
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    for i, j in strips(own, None if b is None else other, threshold):
        n += np.bincount(i, other_counts[j], len(ids)).astype(np.int64)
        m += np.bincount(j, counts[i], len(other_ids)).astype(np.int64)
        columns, heads, rows, others = fewer(i, j)
        edges.append((np.concatenate([other_ids[columns], ids[rows]]), np.concatenate([ids[heads], ids[others]])))
    if b is None:
        linked, total = ids, n + m
    else:
        linked, total = np.concatenate([ids, other_ids]), np.concatenate([n, m])
    root = dict(forest(*(np.concatenate([e[k] for e in edges]) for k in (0, 1)))) if edges else {}
    linked, total = linked[total > 0], total[total > 0]
    return linked, total, np.array([root.get(k, k) for k in linked.tolist()], np.int64)


def forest(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """(node, least node of its component) for the nodes of the edges, but for those least nodes themselves."""
    nodes, back = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = np.arange(len(nodes))
    a, b = back[: len(u)], back[len(u) :]
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        np.minimum.at(new, label, new)  # the root learns what its members have seen
        if np.array_equal(new, label):
            break
        label = new
    return [(int(n), int(nodes[r])) for n, r in zip(nodes, label) if nodes[r] != n]


def link(df: DataFrame, tables: Tables, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = 1 << 26, tiles_a_core: int = 4, block: int | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) of every row. ``block`` fixes the vectors of a block."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.col("id").isNull() | F.col("v").isNull() | (F.size("v") == 0) | F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("v", lambda x: x != 0)
    marked = rows.withColumn("bad", F.coalesce(bad, F.lit(True)))
    good = marked.where(~F.col("bad")).select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))  # -0.0 becomes 0.0
    # one class per distinct vector; its members in another table
    # numbered as they are written: two vectors may have one id
    classes = tables.save(good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")).withColumn("dim", F.size("v")).withColumn("node", F.monotonically_increasing_id()))
    spark = df.sparkSession
    even = math.ceil(math.sqrt(2 * tiles_a_core * spark.sparkContext.defaultParallelism))

    def blocks_of(dim: int, many: int) -> int:
        # a component takes 8 bytes as it is, 1 as a code and 4 to multiply
        most = max(512, block_bytes // (13 * dim))
        return -(-many // block) if block else max(-(-many // most), min(even, -(-many // 512)))

    # distinct lengths: less than the root of twice the number of components in the table
    dims = [(r["dim"], blocks_of(r["dim"], r["m"])) for r in classes.groupBy("dim").agg(F.count("*").alias("m")).collect()]
    tiles = sum(b * (b // 2 + 1) for _, b in dims)
    single = df.schema[vector_col].dataType == T.ArrayType(T.FloatType(), df.schema[vector_col].dataType.containsNull)
    stored = "<f4" if single else "<f8"  # single precision is sent as it is

    def packed(batches):
        key, held = None, []

        def block_of(key, held):
            ids, counts, values = (np.concatenate([h[k] for h in held]) for k in range(3))
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([key[2]], pa.int32()), pa.array([ids.astype("<i8").tobytes()]), pa.array([counts.astype("<i8").tobytes()]), pa.array([values.tobytes()])], ["dim", "blocks", "b", "ids", "counts", "values"])

        for batch in batches:
            dim, blocks, b, rep, n = (np.asarray(batch.column(k)) for k in range(5))
            border = [0, *(np.flatnonzero((dim[1:] != dim[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(border, border[1:]):
                now = (int(dim[lo]), int(blocks[lo]), int(b[lo])) if hi > lo else key
                if now != key and held:
                    yield block_of(key, held)
                    held = []
                key = now
                if hi > lo:
                    held.append((rep[lo:hi], n[lo:hi], np.asarray(batch.column(5).slice(lo, hi - lo).flatten()).astype(stored)))
        if held:
            yield block_of(key, held)

    shape = "dim int, blocks int, b int, ids binary, counts binary, values binary"
    sizes = F.broadcast(spark.createDataFrame(dims, "dim int, blocks int"))
    placed = classes.join(sizes, "dim").select("dim", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("b"), "node", "n", "v")
    table = tables.save(placed.repartition(max(1, min(sum(b for _, b in dims), 4096)), "dim", "b").sortWithinPartitions("dim", "b").mapInArrow(packed, shape))
    work = table.withColumn("tile", F.explode(tiles_of(F.col("b"), F.col("blocks")))).select("tile", "dim", "b", "ids", "counts", "values")

    def load(batch, at):
        dim, ids, counts, values = (batch.column(k)[at].as_py() for k in (0, 4, 5, 6))
        x = unit(np.frombuffer(values, stored).astype(np.float64).reshape(-1, dim))
        return np.frombuffer(ids, "<i8"), np.frombuffer(counts, "<i8"), (x, *quantise(x))

    def answer(one, two):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in tile(one, two, threshold)], ["node", "n", "root"])

    def run(batches):
        waiting = None
        for batch in batches:
            for at in range(batch.num_rows):
                key, b = tuple(batch.column(k)[at].as_py() for k in range(3)), batch.column(3)[at].as_py()
                if key[1] == key[2]:
                    yield answer(load(batch, at), None)
                elif waiting and waiting[0] == key:
                    one, two = (waiting[2], load(batch, at)) if waiting[1] == key[1] else (load(batch, at), waiting[2])
                    waiting = None
                    yield answer(one, two)
                else:  # sorted by tile, so its other block is next; a block without rows never comes
                    waiting = (key, b, load(batch, at))

    dealt = work.select("dim", "tile.x", "tile.y", "b", "ids", "counts", "values").repartition(max(1, min(tiles, 4096)), "dim", "x", "y").sortWithinPartitions("dim", "x", "y", "b")
    links = tables.save(dealt.mapInArrow(run, "node long, n long, root long"))
    groups = tables.save(connected_components(links.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")), tables))
    # tables of their own, so that Spark can split a component that holds much of all
    least = tables.save(groups.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id")))
    named = groups.join(least, "component").select("node", "component_id")
    members = good.join(classes, "v").select("id", "rep", "node", "n")
    linked = members.join(links.groupBy("node").agg(F.sum("n").alias("others")), "node", "left").join(named, "node", "left")
    done = linked.select("id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    lone = marked.where("bad").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return done.unionByName(lone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
