"""Suffix-array dedup and repeated-phrase dedup against all windows."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from segweave.llm import phrase_dedup, suffix_dedup
from segweave.llm.common import Tables
from segweave.llm.repeats import Units

from .plain import table, texts, words_of


def runs(cover):
    return sum(c and not p for c, p in zip(cover, [0, *cover]))


def plain_bytes(docs, width):
    raw = {k: (t or "").encode() for k, t in docs}
    n = Counter(b[i : i + width] for b in raw.values() for i in range(len(b) - width + 1))
    out = {}
    for k, b in raw.items():
        cover = [0] * len(b)
        for i in range(len(b) - width + 1):
            if n[b[i : i + width]] > 1:
                cover[i : i + width] = [1] * width
        out[k] = (len(b), sum(cover), runs(cover), hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest())
    return out


def plain_words(docs, width):
    words = {k: words_of(t) for k, t in docs}
    first = {}
    for k, w in sorted(words.items()):
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), k)
    out = {}
    for k, w in words.items():
        cover = [0] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < k:
                cover[i : i + width] = [1] * width
        out[k] = (len(w), sum(cover), b" ".join(x for x, c in zip(w, cover) if not c).decode())
    return out


@pytest.mark.parametrize(("width", "hot"), [(400, 512), (40, 512), (400, 1), (40, 1), (40, 3), (5, 512)])
def test_bytes(spark, width, hot):
    df = table(spark, texts(width, 50))
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["removed"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffix_dedup.dedup(df.drop("removed"), Tables(spark, "t"), width, hot=hot, carry=["rank", "n"]).collect()}
    assert got == plain_bytes(docs, width)


@pytest.mark.parametrize("hot", [512, 1])
def test_contexts_of_bytes_are_no_table(spark, hot, monkeypatch):
    """They are as large as the texts, and writing them took the most memory."""
    written, write = [], Tables.write
    monkeypatch.setattr(Tables, "write", lambda self, df: written.extend(df.columns) or write(self, df))
    suffix_dedup.dedup(table(spark, texts(40, 50)), Tables(spark, "t"), 40, hot=hot)
    assert "windows" in written and ("piece" in written) == (hot == 1)
    assert "context" not in written


def test_tables_start_no_process_for_checksums(spark):
    """No checksum file beside a table's files on a local disk, yet changed bytes are found."""
    df, path = Tables(spark, "t").write(spark.range(0, 1000, 1, 1))
    (file,) = Path(path.removeprefix("file:")).iterdir()
    data = bytearray(file.read_bytes())
    assert df.agg({"id": "sum"}).first()[0] == 499500
    data[len(data) // 4] ^= 1
    file.write_bytes(data)
    with pytest.raises(Exception, match="(?i)crc|checksum"):
        df.agg({"id": "sum"}).first()


@pytest.mark.parametrize(("width", "hot"), [(50, 512), (50, 1), (50, 3), (4, 512), (1, 512)])
def test_words(spark, width, hot):
    df = table(spark, texts(width, 50))
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in phrase_dedup.dedup(df, Tables(spark, "t"), width, hot=hot).collect()}
    assert got == plain_words(docs, width)


def test_long_texts(spark):
    """Texts of more than 256 kB, which prefix sums and windows take in pieces."""
    rng = random.Random(8)
    say = lambda k: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(k))
    first, other, shared = say(45_000), say(40_000), say(700)
    docs = [(1, f"{first} {shared} {say(100)}"), (2, f"{other} {first[200_000:280_000]} {say(50)}"), (3, f"{say(60)} {shared}"), (4, say(500))]
    assert len(docs[0][1]) > 300_000
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in phrase_dedup.dedup(df, Tables(spark, "t"), chunk=20_000).collect()}
    assert got == plain_words(docs, 50) and got[2][1] > 8_000 and got[3][1] == 700
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["removed"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffix_dedup.dedup(df, Tables(spark, "t")).collect()}
    assert got == plain_bytes(docs, 400)


def test_automata_decide(spark, monkeypatch):
    """Whatever the automata do not locate stays."""
    said = texts(5, 40)
    docs = [(i, t) for i, t in enumerate([*said, *said])]
    phrases = phrase_dedup.Phrases([(b"a b c d e f", 1, *(np.array([x]) for x in (0, 2, 3)))], Units(True, 5, 2))
    assert phrases.located(b"x a b c d e f b c").tolist() == [2, 7]
    assert phrases.repeated(b"x a b c d e f b c", 9) == [(1, 3)] and phrases.repeated(b"x a b c d e f b c", 3) == []
    monkeypatch.setattr(phrases, "located", lambda text: np.empty(0, np.int64))
    assert phrases.repeated(b"x a b c d e f b c", 9) == []
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in phrase_dedup.dedup(df, Tables(spark, "t"), 8, shard=16, chunk=64).collect()}
    assert got == plain_words(docs, 8) and sum(x[1] for x in got.values()) > 1000


def test_equal_rows_and_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, long), (1, long), (1, long + " more"), (2, long), (None, long), (3, None), (4, "")], "doc_id long, text string")
    words = sorted(((r["doc_id"] or 99, r["n_removed"]) for r in phrase_dedup.dedup(df, Tables(spark, "t")).collect()))
    assert words == [(1, 0), (1, 0), (1, 0), (2, 60), (3, 0), (4, 0), (99, 60)]
    raw = sorted((r["doc_id"] or 99, r["n_removed"]) for r in suffix_dedup.dedup(df, Tables(spark, "t"), 100).collect())
    assert raw == [(1, len(long)), (1, len(long)), (1, len(long)), (2, len(long)), (3, 0), (4, 0), (99, len(long))]
    for op in (phrase_dedup, suffix_dedup):
        assert op.dedup(df.limit(0), Tables(spark, "t")).count() == 0
