"""Suffix-array dedup: removes every byte covered by a string of ``width`` bytes that also starts anywhere else.

Candidates meet by ``repeats``: an anchor is an initial bucket, of the windows that hold one 16-byte gram at one place. The
kernel refines the buckets of an anchor as a suffix array does by bucket pointers, as deep as the width: positions
start in buckets of equal 8-byte grams; each round sorts them by the bucket identifiers at this and later offsets
(three at a time, so depth grows threefold) and renames the buckets, which the next round uses. Windows in one bucket at
the end are equal byte by byte. Before that a rolling hash drops contexts without any window that could repeat, which
only spares work: equal windows have equal hashes. Anchors of one kind of context need no refinement: their windows have
equal copies by the 128 bits that tell contexts apart.

Defined cases: null text counts as empty; texts shorter than the width lose nothing; matches never cross documents;
equal rows are repeats of each other and lose all their bytes from ``width`` bytes on. Strings are judged on the input, so
all copies go. Removal can split a code point, so what is left is bytes. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, map_rows
from .repeats import HOT, KEY, Context, Units, find, numbered
from .textnum import BYTE_CODES, U, mix, span_hashes

GRAM = 16


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive bytes."""
    starts = np.arange(len(data) - width + 1)
    return mix(span_hashes(BYTE_CODES[data], starts, starts + width))


def rename(keys: np.ndarray) -> np.ndarray:
    """Bucket identifiers in the order of the keys, equal for equal keys."""
    order = np.argsort(keys, kind="stable" if len(keys) < 64 else None)
    new = np.empty(len(keys), np.int64)
    held = keys[order]
    new[order] = np.cumsum(np.concatenate([[0], held[1:] != held[:-1]]))
    return new


def refined(data: np.ndarray, width: int) -> np.ndarray:
    """For each position, the rank of its bucket among all by the next ``width`` bytes; positions too near the end get -1 or less
    than a full comparison and are not to be used."""
    n = len(data)
    code = np.zeros(n, np.uint64)
    for j in range(min(8, width)):
        code[: n - j] |= data[j:].astype(np.uint64) << U(8 * (7 - j))
    bucket, depth = rename(code), min(8, width)
    bits = max(1, int(n + 1).bit_length())
    later = lambda by: np.concatenate([bucket[by:] + 1, np.zeros(min(by, n), np.int64)])[:n]
    while depth < width:
        step = min(depth, width - depth)
        keys = (bucket << bits) | later(step)
        depth += step
        if depth < width and 3 * bits <= 63:
            more = min(depth - step, width - depth) if step else 0
            keys = (keys << bits) | later(step + more)
            depth += more
        bucket = rename(keys)
    return bucket


def compared(contexts: list[Context], width: int) -> list[list[tuple[int, int, int, int]]]:
    """Runs (start, end, 0, 2) of the windows of each context that occur more than once in all."""
    sizes = np.array([len(c.content) for c in contexts])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    data = np.frombuffer(b"".join(c.content for c in contexts), np.uint8)
    starts = np.concatenate([np.arange(b, e - width + 1) for b, e in zip(begins, ends)])
    owner = np.repeat(np.arange(len(contexts)), sizes - width + 1)
    n = np.array([c.n for c in contexts])
    _, back, times = np.unique(rolling(data, width)[starts], return_inverse=True, return_counts=True)
    maybe = np.zeros(len(contexts), bool)
    maybe[owner[times[back] > 1]] = True  # contexts that may share a window with another place
    many = n[owner] > 1
    if maybe.any():
        some = np.flatnonzero(maybe)
        part = np.frombuffer(b"".join(contexts[i].content for i in some), np.uint8)
        shift = np.zeros(len(contexts), np.int64)
        shift[some] = np.cumsum(sizes[some]) - sizes[some]
        mine = np.flatnonzero(maybe[owner])
        bucket = refined(part, width)[starts[mine] - begins[owner[mine]] + shift[owner[mine]]]
        many[mine] |= np.bincount(bucket)[bucket] > 1
    edge = np.diff(np.concatenate([[0], many.astype(np.int8), [0]]))
    first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, bool)
    on, off = np.flatnonzero(many & (first | (edge[:-1] == 1))), np.flatnonzero(many & np.append(first[1:] | (edge[1:-1] == -1), True)) + 1
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in contexts]
    base = np.cumsum(sizes - width + 1) - (sizes - width + 1)
    for s, e in zip(on.tolist(), off.tolist()):
        k = int(owner[s])
        out[k].append((s - int(base[k]), e - int(base[k]), 0, 2))
    return out


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans, as maximal runs in order."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def dedup(docs: DataFrame, tables: Tables, width: int = 400, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, carry: Sequence[str] = (), as_text: bool = False) -> DataFrame:
    """(id, columns of ``carry``, n_bytes, n_removed, removed (array of start, end), kept) of every row; kept is binary, or the text it
    spells without bytes that spell nothing."""
    units = Units(False, width, min(GRAM, 1 << (width.bit_length() - 1)))
    spans = find(numbered(docs, id_col, text_col), units, partial(compared, width=width), tables, hot)
    # equal rows bring equal answers, of which one is kept
    spans = spans.groupBy(*KEY).agg(F.flatten(F.collect_set(F.transform("windows", lambda w: F.struct(w["start"].alias("start"), (w["end"] - 1 + width).alias("end"))))).alias("spans"))
    texts = docs.select(F.struct(id_col, *carry).alias("own"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    keep = [id_col, *carry]
    schema = T.StructType([*(docs.schema[c] for c in keep), *T._parse_datatype_string(f"n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept {'string' if as_text else 'binary'}").fields])

    def run(batch):
        out: list[list] = [[], [], [], []]
        own = batch.column(0)
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw = (text or "").encode("utf-8", "surrogatepass")
            gone = joined([(s["start"], s["end"]) for s in spans or ()])
            kept, at = [], 0
            for lo, hi in gone:
                kept.append(raw[at:lo])
                at = hi
            kept.append(raw[at:])
            for column, x in zip(out, (len(raw), sum(hi - lo for lo, hi in gone), [{"start": lo, "end": hi} for lo, hi in gone], b"".join(kept).decode("utf-8", "ignore") if as_text else b"".join(kept))):
                column.append(x)
        made = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(out[3], pa.string() if as_text else pa.binary())]
        yield pa.RecordBatch.from_arrays([*own.flatten(), *made], schema.names)

    both = numbered(texts, "_id", "_text", "own").join(spans, KEY, "left").select("own", "text", "spans")
    return map_rows(both, run, schema, 256)
