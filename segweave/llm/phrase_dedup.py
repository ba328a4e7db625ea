"""Substring dedup with repeated-phrase automata: removes words covered by a window seen in an earlier document.

Words are runs of bytes other than blank and 0x09 to 0x0D.

1. *Recurring passages are confirmed.* Windows meet by ``repeats``; those of an anchor are compared word for word. A
   passage is a context with windows that occur in several places, the least document of each window, and the phrase
   (``GRAM`` words) at its anchor.
2. *Automata by shard.* Documents are dealt into shards of about ``SHARD`` runs, and a passage goes to the shards that hold a
   run like it, so each shard gets no more than its own documents can hold, and only if one of them comes after the first. A shard's phrases are compiled into an
   Aho-Corasick automaton (pyahocorasick), in several where its passages exceed ``CHUNK`` bytes.
3. *All documents are streamed* through the automata of their shard, which locate the phrases; nothing else says where a
   passage may stand. Windows that hold a located phrase are looked up among the passages' windows and compared with them
   byte for byte; those that an earlier document holds too are removed.

Defined cases: null text has no words; documents shorter than the window lose nothing; a window repeated within one
document only, or in rows of one id, stays. Null ids count as greatest. Windows are judged on the input. Kept words
are joined by one blank. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Tables
from .repeats import HOT, KEY, Context, Units, candidates, cut_out, judged, numbered, whole
from .suffix_dedup import joined
from .textnum import mix, span_hashes, word_hashes, word_spans

GRAM = 8
SHARD = 1 << 15
CHUNK = 1 << 21


def confirmed(contexts: list[Context], width: int) -> list[list[tuple[int, int, int, int]]]:
    """Runs (start, end, least rank, 2) of the windows of each context that occur more than once under its anchor."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in contexts]
    groups: dict[int, list[int]] = defaultdict(list)
    for i, c in enumerate(contexts):
        groups[c.anchor].append(i)
    for own in groups.values():
        number: dict[bytes, int] = {}  # of each distinct window
        times, least = [], []
        windows: dict[int, list[int]] = {}
        for i in own:
            c = contexts[i]
            ends = np.cumsum([len(w) + 1 for w in c.content.split(b" ")]).tolist()
            starts = [0, *ends]
            windows[i] = [number.setdefault(c.content[starts[k] : ends[k + width - 1] - 1], len(number)) for k in range(len(ends) - width + 1)]
            for w in windows[i]:
                if w == len(times):
                    times.append(c.n)
                    least.append(c.least)
                else:
                    times[w] += c.n
                    least[w] = min(least[w], c.least)
        for i in own:
            runs = out[i]
            for k, w in enumerate(windows[i]):
                if times[w] < 2:
                    continue
                if runs and runs[-1][1] == k and runs[-1][2] == least[w]:
                    runs[-1] = (runs[-1][0], k + 1, *runs[-1][2:])
                else:
                    runs.append((k, k + 1, least[w], 2))
    return out


class Words:
    """A text's words, joined by single blanks."""

    def __init__(self, joined: bytes) -> None:
        self.joined = joined
        data = np.frombuffer(joined, np.uint8)
        self.starts, self.ends = word_spans(data)
        self.codes = mix(word_hashes(data, self.starts, self.ends))

    def hashes(self, at: np.ndarray, width: int) -> np.ndarray:
        """Of the windows that start at the words ``at``, which rise."""
        return span_hashes(self.codes, at, at + width)

    def cut(self, first: int, end: int) -> bytes:
        return self.joined[self.starts[first] : self.ends[end - 1]]


class Phrases:
    """The passages of a shard: an automaton that locates their phrases, and their windows by hash."""

    def __init__(self, passages: list[tuple[bytes, int, np.ndarray, np.ndarray, np.ndarray]], units: Units) -> None:
        """Of each passage: its words, the place of the phrase, and starts, ends and least ranks of its runs of windows."""
        self.units, self.automaton = units, ahocorasick.Automaton()
        self.words = Words(b" ".join(p[0] for p in passages))
        base = np.concatenate([[0], np.cumsum([units.size(p[0]) for p in passages])])
        for at, (_, place, *_) in zip(base.tolist(), passages):
            phrase = self.words.cut(at + place, at + place + units.gram).decode("utf-8", "surrogatepass")
            self.automaton.add_word(f" {phrase} ", True)
        self.automaton.make_automaton()
        first, end, lowest = (np.concatenate([p[k] for p in passages]) for k in (2, 3, 4))
        sizes = end - first
        begin = first + np.repeat(base[:-1], [len(p[2]) for p in passages])
        self.at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        self.least = np.repeat(lowest, sizes)
        hashes = np.empty(len(self.at), np.uint64)
        rising = np.argsort(self.at, kind="stable")
        hashes[rising] = self.words.hashes(self.at[rising], units.width)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at, self.least = hashes[order], self.at[order], self.least[order]

    def located(self, joined: bytes) -> np.ndarray:
        """The first words of the phrases in a text, by the automaton."""
        text = joined.decode("utf-8", "surrogatepass")
        found = [end for end, _ in self.automaton.iter(f" {text} ")]
        if not found:
            return np.empty(0, np.int64)
        ends = np.cumsum([len(w) + 1 for w in text.split(" ")])  # the blank after each word of " word ... word "
        return np.searchsorted(ends, np.unique(found)) - (self.units.gram - 1)

    def repeated(self, joined: bytes, rank: int) -> list[tuple[int, int]]:
        """Runs of windows of a text, of those that hold a located phrase, that a document of lower rank holds too."""
        width, place = self.units.width, self.located(joined)
        if not len(place):
            return []
        words = Words(joined)
        total = len(words.starts) - width + 1
        if total <= 0:
            return []
        edge = np.zeros(total + 1, np.int64)
        np.add.at(edge, np.clip(place - (width - self.units.gram), 0, total), 1)
        np.add.at(edge, np.clip(place + 1, 0, total), -1)
        k = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        hashes = words.hashes(k, width)
        entry = np.searchsorted(self.hashes, hashes)
        entry[entry == len(self.hashes)] = 0
        known = self.hashes[entry] == hashes
        k, entry = k[known], entry[known]
        if not len(k):
            return []
        at = self.at[entry]
        first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1] + 1) | (at[1:] != at[:-1] + 1)]))
        good = np.zeros(len(k), bool)
        lowest = self.least[entry]
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(k)]):
            a, b, n = int(k[lo]), int(at[lo]), hi - lo - 1 + width
            if words.cut(a, a + n) == self.words.cut(b, b + n):
                good[lo:hi] = True
                continue
            for x in range(lo, hi):  # different windows of one hash
                e, h = int(entry[x]), self.hashes[entry[x]]
                while e < len(self.hashes) and self.hashes[e] == h and not good[x]:
                    p = int(self.at[e])
                    good[x] = words.cut(int(k[x]), int(k[x]) + width) == self.words.cut(p, p + width)
                    lowest[x] = self.least[e]
                    e += 1
        k = k[good & (lowest < rank)]
        if not len(k):
            return []
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1] + 1]))
        return [(int(k[lo]), int(k[hi - 1]) + 1) for lo, hi in zip(first, [*first[1:], len(k)])]


def passages(rows: DataFrame, kinds: DataFrame, crowd: DataFrame, units: Units, tables: Tables, hot: int) -> DataFrame:
    """(anchor, kind, place, context, windows) of every context that holds a window of several documents."""
    crowded = kinds.join(crowd, "anchor")
    single = kinds.where("least < most").join(crowd.select("anchor"), "anchor", "left_anti").withColumn("busy", F.lit(None).cast("boolean"))
    cut, cut_path = tables.write(cut_out(rows, crowded.unionByName(single.select(crowded.columns)), units))
    answers = tables.save(judged(cut.where("busy is not null"), crowd, units, partial(confirmed, width=units.width), tables, hot))
    per_kind = F.struct("place", "context", "least", "n")
    once = cut.groupBy("anchor", "kind").agg(F.min(per_kind).alias("c"), F.first(F.col("busy").isNull()).alias("single"))
    own = whole(F.col("first"), F.col("last"))
    alone = once.where("single").join(kinds.select("anchor", "kind", F.col("one.first").alias("first"), F.col("one.last").alias("last"), "least", "n"), ["anchor", "kind"]).select("anchor", "kind", "c.place", "c.context", own.alias("windows"))
    found = once.where("not single").join(answers, ["anchor", "kind"]).select("anchor", "kind", "c.place", "c.context", "windows")
    made = tables.save(alone.unionByName(found))
    tables.drop(cut_path)
    return made


def dedup(docs: DataFrame, tables: Tables, width: int = 50, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, shard: int = SHARD, chunk: int = CHUNK) -> DataFrame:
    """(id, n_words, n_removed, removed (array of first word, end), kept (text)) of every row."""
    units = Units(True, width, min(GRAM, width))
    rows = numbered(docs, id_col, text_col)
    runs, kinds, crowd = candidates(rows, units, tables, hot)
    known = passages(rows, kinds, crowd, units, tables, hot)
    shards = max(1, -(-runs.count() // shard), -(-docs.count() // (shard // 16)))
    home = F.pmod(F.xxhash64(*KEY), F.lit(shards)).cast("int").alias("shard")
    # a shard whose documents all come before those that hold a passage first can lose nothing to it
    first = F.array_min(F.transform("windows", lambda w: w["least"]))
    wanted = runs.groupBy("anchor", "kind", home).agg(F.max("rank").alias("top")).join(known, ["anchor", "kind"]).where(first < F.col("top"))
    kind = docs.schema[id_col].dataType.simpleString()
    nothing = lambda t: F.lit(None).cast(t)
    texts = numbered(docs, id_col, text_col, F.col(id_col).alias("own")).select(home, F.lit(0).alias("side"), "own", "rank", "text", nothing("int").alias("place"), nothing("array<struct<start:int,end:int,least:long,n:long>>").alias("windows"))
    phrases = wanted.select("shard", F.lit(1).alias("side"), nothing(kind).alias("own"), nothing("long").alias("rank"), F.col("context").cast("string").alias("text"), "place", "windows")
    dealt = texts.unionByName(phrases).repartition("shard").sortWithinPartitions("shard", "side")
    id_type = to_arrow_type(docs.schema[id_col].dataType)

    def answer(held: list[list]) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for own, _, raw, spans in held:
            words = raw.split()
            gone = joined([(lo, hi - 1 + width) for lo, hi in spans])
            kept, at = [], 0
            for lo, hi in gone:
                kept += words[at:lo]
                at = hi
            kept += words[at:]
            for column, x in zip(out, (own, len(words), sum(hi - lo for lo, hi in gone), [{"start": lo, "end": hi} for lo, hi in gone], b" ".join(kept).decode("utf-8", "surrogatepass"))):
                column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(out[0], id_type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(out[4], pa.string())], [id_col, "n_words", "n_removed", "removed", "kept"])

    def search(held: list[list], waiting: list[tuple]) -> None:
        if waiting and held:
            phrases = Phrases(waiting, units)
            for doc in held:
                doc[3] += phrases.repeated(doc[2], doc[1])

    def run(batches):
        now, held, waiting, size = None, [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                windows = part.column(6)
                borders, values = windows.offsets.to_numpy(), [np.asarray(windows.values.field(f)).astype(np.int64) for f in ("start", "end", "least")]
                for row, (home, side, own, rank, text, place) in enumerate(zip(*(c.to_pylist() for c in part.columns[:6]))):
                    if home != now:
                        search(held, waiting)
                        for k in range(0, len(held), 256):
                            yield answer(held[k : k + 256])
                        now, held, waiting, size = home, [], [], 0
                    raw = b" ".join((text or "").encode("utf-8", "surrogatepass").split())
                    if side == 0:
                        held.append([own, rank, raw, []])
                        continue
                    waiting.append((raw, place, *(v[borders[row] : borders[row + 1]] for v in values)))
                    size += len(raw)
                    if size >= chunk:
                        search(held, waiting)
                        waiting, size = [], 0
        search(held, waiting)
        for k in range(0, len(held), 256):
            yield answer(held[k : k + 256])

    return dealt.mapInArrow(run, f"{id_col} {kind}, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string")
