"""Byte-level BPE encoding and decoding as monoid tree reductions.

``encode`` halves a text until it is at most ``LEAF`` code points, encodes the leaves, and joins neighbours. A join
re-encodes a window around the seam that grows on either side until its edges are *cuts*: places where a non-space is
followed by a blank, tab or line break. No match of the splitting pattern runs across a cut, whatever stands around
it, and the patterns only look ahead; so the tokens outside the window are those of the joined text. If one side has
no cut, the window covers that side whole. ``decode`` joins the bytes of both halves of the ids up the tree.

Defined cases: null text encodes like the empty text (no ids, no bytes); texts of any length are encoded whole; ids
outside the vocabulary raise ``KeyError`` on decoding. Repeated rows are encoded alike; other columns pass through,
and those named like an output are replaced.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_rows

LEAF = 1024
CUT = regex.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \t\n\r])")


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.lengths = np.array([len(t or b"") for t in self.table], np.int64)

    def leaf(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.uint32)

    def encode(self, text: str, leaf: int = LEAF) -> np.ndarray:
        return self._encode(text, 0, len(text), leaf)

    def _encode(self, text: str, lo: int, hi: int, leaf: int) -> np.ndarray:
        if hi - lo <= max(leaf, 2):
            return self.leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid, leaf), self._encode(text, mid, hi, leaf))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        reach, first, last = 32, None, None
        while first is None or last is None:
            if first is None:  # the nearest cut at or before the seam; at least the start of this node
                at = max(lo, mid - reach)
                cuts = [m.start() for m in CUT.finditer(text, at + 1, mid + 1) if lo < m.start() <= mid and m.start() < hi]
                first = cuts[-1] if cuts else lo if at == lo else None
            if last is None:
                found = CUT.search(text, mid, min(hi, mid + reach) + 1)
                last = found.start() if found and found.start() < hi else hi if mid + reach >= hi else None
            reach *= 2
        if first == last == mid:
            return np.concatenate([left, right])
        middle = self.leaf(text[first:last])
        return np.concatenate([left[: len(left) - self._covering(left[::-1], text[first:mid])], middle, right[self._covering(right, text[mid:last]) :]])

    def _covering(self, ids: np.ndarray, text: str) -> int:
        """How many ids from the start make up exactly as many bytes as text has."""
        n = len(text.encode())
        if not n:
            return 0
        total = np.cumsum(self.lengths[ids[:n]])
        k = int(np.searchsorted(total, n))
        if total[k] != n:
            raise AssertionError("a token runs across a cut")
        return k + 1

    def decode(self, ids: np.ndarray, leaf: int = 1 << 14) -> bytes:
        if len(ids) > leaf:
            mid = len(ids) // 2
            return self.decode(ids[:mid], leaf) + self.decode(ids[mid:], leaf)
        if len(ids) and int(ids.max()) >= len(self.table):
            raise KeyError(int(ids.max()))
        return b"".join(map(self.table.__getitem__, ids.tolist()))


def ranks_of(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file, or of the byte-level vocabulary of a ``tokenizers`` JSON file (without special tokens)."""
    with open(path, "rb") as f:
        if not path.endswith(".json"):
            return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        spec = json.load(f)
    # printable bytes stand for themselves, the others for the code points from 256 on, in order
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"] for t in spec["added_tokens"] if t["special"]}
    return {bytes(byte_of[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(ranks_of(path), pattern)


def _with(df: DataFrame, name: str) -> tuple[list[str], T.StructType]:
    keep = [c for c in df.columns if c != name]
    return keep, T.StructType([*(df.schema[c] for c in keep), T.StructField(name, T.BinaryType())])


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids", leaf: int = LEAF) -> DataFrame:
    """``df`` with the ids of each text as little-endian unsigned 32-bit integers in one binary value."""
    keep, schema = _with(df, out)

    def run(batch):
        own = codec(path, pattern)
        ids = [own.encode(t or "", leaf).astype("<u4").tobytes() for t in batch.column(keep.index(text_col)).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], [*keep, out])

    return map_rows(df.select(*keep), run, schema, 256)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids stand for."""
    keep, schema = _with(df, out)

    def run(batch):
        own = codec(path, pattern)
        made = [own.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(keep.index(ids_col)).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*keep, out])

    return map_rows(df.select(*keep), run, schema, 256)
