"""Windows of units (bytes or words) that occur more than once, found through shared anchors.

Every window of ``width`` units is filed under its anchor: the leftmost least hash of the ``gram`` consecutive units
inside it. Equal windows have equal anchors at equal places, so only windows whose anchor occurs again can repeat, and
those with different anchors need never meet. Consecutive windows under one anchor occurrence form a *run*; the units
that a run's windows cover are its *context*. The steps:

1. ``candidates``: one pass over all texts writes a row of numbers per run, about two per ``width`` units, with the
   anchor and a hash of the context. Runs whose anchor occurs once are dropped. Runs with equal contexts are one *kind*,
   counted with partial counts before the shuffle. Where an anchor has one kind only, all its windows occur as often as
   the kind.
2. ``cut_out``: the context of a kind is cut once, from one text that holds it.
3. ``judged``: a kernel compares the contexts of each anchor and says which of their windows repeat. An anchor with more
   than ``hot`` kinds is dealt in pieces: a piece holds the windows that start within ``step`` units of each other, as
   seen from the anchor, and meets only pieces with which it shares the units that all these windows have in common.
   Equal pieces are counted before they move. Where even such a group has more than ``hot`` different pieces, they are
   cut once more into single windows, whose groups hold equal windows only. So no anchor has to fit into a task, and
   every comparison is of the units themselves.

Rows are known by their id and a 64-bit hash of their text, so rows with one id and different texts stay apart, and
equal rows get equal answers. Anchor and context hash tell contexts apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import Tables, map_rows
from .textnum import BYTE_CODES, GRAM_CODES, byte_gram_hashes, gram_hashes, mix, span_hashes, window_argmin, word_hashes, word_spans

HOT = 512
KEY = ["rank", "row"]
WINDOW = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("least", pa.int64()), ("n", pa.int64())])
WINDOWS = "array<struct<start:int,end:int,least:long,n:long>>"


@dataclass(frozen=True)
class Units:
    """Bytes or words, the window's width in them, and the anchor's length in them."""

    words: bool
    width: int
    gram: int

    def runs(self, text: str | None) -> tuple[np.ndarray, ...]:
        """Of each run: anchor hash, context hash, anchor position, first window, last window (in units)."""
        data = bytes_of(text)
        if self.words:
            units = word_hashes(data, *word_spans(data))
            grams = gram_hashes(units, self.gram)
        else:
            units = BYTE_CODES[data]
            grams = byte_gram_hashes(data, self.gram)
        at = window_argmin(grams, self.width - self.gram + 1)
        if not len(at):
            return (np.empty(0, np.int64),) * 5
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], len(at)) - 1
        place = at[first]
        content = span_hashes(mix(units), first, last + self.width)
        kind = mix(content + (place - first).astype(np.uint64) * GRAM_CODES[1] + (last - first).astype(np.uint64) * GRAM_CODES[2])
        return grams[place].view(np.int64), kind.view(np.int64), place, first, last

    @property
    def step(self) -> int:
        """Windows in a piece."""
        return max(1, self.width // 16)

    def size(self, content: bytes) -> int:
        """The units of a context."""
        return content.count(b" ") + 1 if self.words else len(content)

    def cutter(self, raw: bytes) -> Callable[[int, int], bytes]:
        """Gives the units from one up to another, words with a blank between."""
        if not self.words:
            return lambda lo, hi: raw[lo:hi]
        raw = b" ".join(raw.split())
        starts, ends = (x.tolist() for x in word_spans(np.frombuffer(raw, np.uint8)))
        return lambda lo, hi: raw[starts[lo] : ends[hi - 1]]


def bytes_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def numbered(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """rank (the id; null as greatest), row (a hash of the text) and text, after the columns ``more``."""
    return docs.select(*more, F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("rank"), F.xxhash64(F.col(text_col)).alias("row"), F.col(text_col).alias("text"))


def runs_of(rows: DataFrame, units: Units) -> DataFrame:
    """(anchor, kind, rank, row, place, first, last) of every run."""

    def run(batch):
        parts = [units.runs(text) for text in batch.column(2).to_pylist()]
        which = pa.array(np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts]))
        joined = [np.concatenate([p[i] for p in parts] + [np.empty(0, np.int64)]).astype(np.int64) for i in range(5)]
        yield pa.RecordBatch.from_arrays([pa.array(joined[0]), pa.array(joined[1]), batch.column(0).take(which), batch.column(1).take(which), *(pa.array(x.astype(np.int32)) for x in joined[2:])], ["anchor", "kind", *KEY, "place", "first", "last"])

    return map_rows(rows.select(*KEY, "text"), run, "anchor long, kind long, rank long, row long, place int, first int, last int", 128)


def contexts(texts_with_kinds: DataFrame, units: Units, most_bytes: int = 1 << 22) -> DataFrame:
    """(anchor, kind, place, n, least, busy, context); ``place`` is the anchor's place in the context."""
    names = ["anchor", "kind", "place", "n", "least", "busy", "context"]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())

    def run(batch):
        out: list[list] = [[] for _ in names]
        size = 0
        for at in range(batch.num_rows):
            cut = units.cutter(bytes_of(batch.column(0)[at].as_py()).tobytes())
            for k in batch.column(1)[at]:
                k = k.as_py()
                content = cut(k["first"], k["last"] + units.width)
                for column, x in zip(out, (k["anchor"], k["kind"], k["place"] - k["first"], k["n"], k["least"], k["busy"], content)):
                    column.append(x)
                size += len(content) + 64
                if size >= most_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names)
                    out, size = [[] for _ in names], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names)

    return map_rows(texts_with_kinds.select("text", "kinds"), run, "anchor long, kind long, place int, n long, least long, busy boolean, context binary", 64)


@dataclass
class Context:
    """A distinct context: how often it occurs, and the least rank of its documents."""

    anchor: int
    place: int
    content: bytes
    n: int
    least: int


#: contexts of one or more whole anchors -> for each, (start, end, least rank, count) of windows that occur more than once
Kernel = Callable[[list[Context]], list[list[tuple[int, int, int, int]]]]


def candidates(docs: DataFrame, units: Units, tables: Tables, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables of what may repeat: runs; kinds (anchor, kind, n, least, most, one); crowd (anchor, busy), the anchors with
    more than one kind. ``docs`` comes from ``numbered``; ``one`` tells where a kind can be cut."""
    every, every_path = tables.write(runs_of(docs, units))
    # a table of its own, so that both sides of the join are plain exchanges and Spark can split a frequent anchor
    twice, twice_path = tables.write(every.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1").select("anchor"))
    runs = tables.save(every.join(twice, "anchor"))
    tables.drop(every_path)
    tables.drop(twice_path)
    kinds = runs.groupBy("anchor", "kind").agg(F.count("*").alias("n"), F.min("rank").alias("least"), F.max("rank").alias("most"), F.min(F.struct(*KEY, "place", "first", "last")).alias("one"))
    kinds = tables.save(kinds)
    crowd = tables.save(kinds.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1").select("anchor", (F.col("m") > hot).alias("busy")))
    return runs, kinds, crowd


def cut_out(docs: DataFrame, kinds: DataFrame, units: Units) -> DataFrame:
    """The contexts of ``kinds`` (with a column busy). Rows equal in id and text cut theirs twice; whoever reads drops repeats."""
    held = F.struct("anchor", "kind", "one.place", "one.first", "one.last", "n", "least", "busy")
    by_row = kinds.groupBy(F.col("one.rank").alias("rank"), F.col("one.row").alias("row")).agg(F.collect_list(held).alias("kinds"))
    return contexts(docs.join(by_row, KEY).select("text", "kinds"), units)


def whole(first: Column, last: Column) -> Column:
    """All windows of a run, as one."""
    return F.array(F.struct(F.lit(0).alias("start"), (last - first + 1).cast("int").alias("end"), "least", "n"))


def judged(cut: DataFrame, crowd: DataFrame, units: Units, kernel: Kernel, tables: Tables, hot: int = HOT) -> DataFrame:
    """(anchor, kind, windows) of the contexts of crowded anchors, where any window repeats."""
    if crowd.where("busy").isEmpty():
        return compare(cut, kernel)
    cut = tables.save(cut)
    return compare(cut.where("not busy"), kernel).unionByName(by_pieces(cut.where("busy").dropDuplicates(["anchor", "kind"]), units, kernel, tables, hot, units.step))


def find(docs: DataFrame, units: Units, kernel: Kernel, tables: Tables, hot: int = HOT) -> DataFrame:
    """(rank, row, windows): for each run of a document its windows start to end - 1 (in units of the document) that occur
    n > 1 times in all, first in the document of rank ``least``. ``docs`` comes from ``numbered``."""
    runs, kinds, crowd = candidates(docs, units, tables, hot)
    # contexts are most of the bytes: each goes from its text straight to its anchor's task, and is never a table
    crowded = kinds.join(crowd, "anchor")
    answers = compare(cut_out(docs, crowded.where("not busy"), units), kernel)
    if not crowd.where("busy").isEmpty():
        busy = cut_out(docs, crowded.where("busy"), units).dropDuplicates(["anchor", "kind"])
        answers = answers.unionByName(by_pieces(busy, units, kernel, tables, hot, units.step))
    answers = tables.save(answers)
    alone = kinds.join(crowd.select("anchor"), "anchor", "left_anti").select("anchor", "kind", whole(F.col("one.first"), F.col("one.last")).alias("windows"))
    return runs.select("anchor", "kind", *KEY, "first").join(alone.unionByName(answers), ["anchor", "kind"]).select(*KEY, shifted("first").alias("windows"))


def compare(cut: DataFrame, kernel: Kernel, most_bytes: int = 1 << 17) -> DataFrame:
    """(anchor, kind, windows): the repeated windows of each distinct context."""
    dealt = cut.repartition("anchor").sortWithinPartitions("anchor", "kind").select("anchor", "kind", "place", "n", "least", "context")

    def answer(group: list[tuple]) -> pa.RecordBatch:
        each = kernel([Context(g[0], g[2], g[5], g[3], g[4]) for g in group])
        kept = [(g, w) for g, w in zip(group, each) if w]
        windows = pa.array([[{"start": s, "end": e, "least": m, "n": n} for s, e, m, n in w] for _, w in kept], pa.list_(WINDOW))
        return pa.RecordBatch.from_arrays([pa.array([g[0] for g, _ in kept], pa.int64()), pa.array([g[1] for g, _ in kept], pa.int64()), windows], ["anchor", "kind", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        size, last = 0, (None, None)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    if row[:2] == last:
                        continue
                    if size >= most_bytes and row[0] != last[0]:
                        yield answer(group)
                        group, size = [], 0
                    last = row[:2]
                    group.append(row)
                    size += len(row[5])
        if group:
            yield answer(group)

    return dealt.mapInArrow(run, f"anchor long, kind long, windows {WINDOWS}")


def pieces_of(busy: DataFrame, units: Units, step: int) -> DataFrame:
    """(anchor, kind, slice, at, lo, piece, n, least): the windows that start from ``lo`` on in the context, at the same distances
    (to ``step``) from the anchor, which is at ``at`` in the piece. ``slice`` names anchor, distance and the common units."""
    names = ["anchor", "kind", "slice", "at", "lo", "piece", "n", "least"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())

    def run(batch):
        out: list[list] = [[] for _ in names]
        for anchor, kind, place, content, n, least in zip(*(c.to_pylist() for c in batch.columns)):
            cut, last = units.cutter(content), units.size(content) - units.width
            for far in range(max(0, place - last) // step, place // step + 1):
                near = place - far * step  # the latest start of a window of this slice
                lo, hi = max(0, near - step + 1), min(last, near)
                if lo > hi:
                    continue
                name = xxh3_64_intdigest(cut(near, near - step + 1 + units.width), (anchor + far) & 0xFFFFFFFFFFFFFFFF)
                for column, x in zip(out, (anchor, kind, name - (1 << 63), place - lo, lo, cut(lo, hi + units.width), n, least)):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, types)], names)

    return map_rows(busy.select("anchor", "kind", "place", "context", "n", "least"), run, "anchor long, kind long, slice long, at int, lo int, piece binary, n long, least long", 32)


def by_pieces(busy: DataFrame, units: Units, kernel: Kernel, tables: Tables, hot: int, step: int) -> DataFrame:
    """As ``compare``, for contexts of anchors that have too many of them for one task."""
    each = tables.save(pieces_of(busy, units, step))
    name = ["slice", "at", "piece"]
    distinct = each.groupBy(*name).agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    if step == 1:  # a piece is a window
        # as the kernels tell it: how often does not matter, and of bytes not who is first
        told = F.col("least") if units.words else F.lit(0).cast("long")
        one = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), told.alias("least"), F.lit(2).cast("long").alias("n")))
        answers = distinct.where("n > 1").select(*name, one.alias("windows"))
    else:
        distinct = tables.save(distinct.select(*name, "n", "least", F.monotonically_increasing_id().alias("id")))
        sizes = tables.save(distinct.groupBy("slice").agg((F.count("*") > hot).alias("busy")))
        dealt = distinct.join(sizes, "slice").select(F.col("slice").alias("anchor"), F.col("id").alias("kind"), F.col("at").alias("place"), F.col("piece").alias("context"), "n", "least", "busy")
        found = compare(dealt.where("not busy"), kernel)
        if not sizes.where("busy").isEmpty():
            found = found.unionByName(by_pieces(dealt.where("busy"), units, kernel, tables, hot, 1))
        answers = distinct.select(*name, "id").join(found.select(F.col("kind").alias("id"), "windows"), "id").drop("id")
    back = each.select("anchor", "kind", "lo", *name).join(tables.save(answers), name).select("anchor", "kind", shifted("lo").alias("windows"))
    return map_rows(back.groupBy("anchor", "kind").agg(F.flatten(F.collect_list("windows")).alias("windows")), met, f"anchor long, kind long, windows {WINDOWS}", 4096)


def shifted(by: str) -> Column:
    return F.transform("windows", lambda w: F.struct((w["start"] + F.col(by)).alias("start"), (w["end"] + F.col(by)).alias("end"), w["least"].alias("least"), w["n"].alias("n")))


def met(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Adjacent windows with one answer become one run; a context has at most ``width`` windows."""
    out = []
    for windows in batch.column(2).to_pylist():
        runs: list[dict] = []
        for w in sorted(windows, key=lambda w: w["start"]):
            if runs and runs[-1]["end"] == w["start"] and (runs[-1]["least"], runs[-1]["n"]) == (w["least"], w["n"]):
                runs[-1]["end"] = w["end"]
            else:
                runs.append(w)
        out.append(runs)
    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(WINDOW))], ["anchor", "kind", "windows"])
