"""Tokenizers: exact round trips, the libraries' own results, packing without gaps."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

from segweave.llm import bpe, packing, token_counts
from segweave.llm.common import Tables

from .plain import table, texts

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = list("ab' ' \n\t 12é'lls,.\x1c　\x85日本😀")


def odd_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("leaf", [2, 7, 64])
def test_tree_encoding(leaf):
    own = bpe.codec(MULTI, public_tokenizers.PATTERN)
    for t in [*odd_texts(leaf, 400), *(t for t in texts(leaf, 30) if t)]:
        ids = own.encode(t, leaf)
        assert ids.tolist() == own.encoding.encode_ordinary(t)
        assert own.decode(ids, 3) == t.encode()


def test_encode_and_decode(spark):
    df = table(spark, texts(3, 30)).withColumnRenamed("n", "ids")
    rows = bpe.decode(bpe.encode(df, MULTI, public_tokenizers.PATTERN, leaf=32), MULTI, public_tokenizers.PATTERN).collect()
    own = bpe.codec(MULTI, public_tokenizers.PATTERN).encoding
    for r in rows:
        assert bytes(r["decoded"]) == (r["text"] or "").encode() and r["rank"] == "x"
        assert np.frombuffer(r["ids"], "<u4").tolist() == own.encode_ordinary(r["text"] or "")
    assert bpe.encode(df.limit(0), MULTI, public_tokenizers.PATTERN).count() == 0


def test_unknown_id():
    with pytest.raises(KeyError):
        bpe.codec(MULTI, public_tokenizers.PATTERN).decode(np.array([50_300], np.uint32))


def test_json_vocabulary():
    theirs = Tokenizer.from_file(JSON)
    theirs.encode_special_tokens = True
    own = bpe.codec(JSON, public_tokenizers.PATTERN)
    for t in [*odd_texts(9, 300), "<|endoftext|> x", *(t for t in texts(5, 30) if t)]:
        assert own.encode(t).tolist() == theirs.encode(t, add_special_tokens=False).ids


def test_unigram_counts(spark):
    own = token_counts.counter(PIECES)
    plain = token_counts.UnigramCounter(list(own.scores.items()), words=False)
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = [(m.id_to_piece(i), m.get_score(i)) if not (m.is_control(i) or m.is_unknown(i)) else (f"\x00{i}", -1e9) for i in range(m.get_piece_size())]
    theirs = Tokenizer(models.Unigram(pieces, 0, True))
    for t in [*odd_texts(1, 400), *(t or "" for t in texts(2, 40))]:
        want = len(theirs.encode("▁" + t.replace(" ", "▁")).ids) if t else 0
        assert own.count(t) == plain.count(t) == want, t
    df = table(spark, texts(2, 20)).withColumnRenamed("n", "n_tokens")
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, PIECES).collect()} == {r["doc_id"]: own.count(r["text"]) for r in df.collect()}
    assert token_counts.count_tokens(df.limit(0), PIECES).count() == 0


def brute(pieces, text, gap=10.0):
    """All paths, by starts from the left; the first best stays."""
    low = min(pieces.values(), default=0.0) - gap
    best = [(0.0, 0)] + [None] * len(text)
    for a in range(len(text)):
        ends = [(a + k, pieces[text[a : a + k]], 1) for k in range(1, len(text) - a + 1) if text[a : a + k] in pieces]
        if not any(e == a + 1 for e, _, _ in ends):
            ends.append((a + 1, low, len(text[a].encode())))
        for e, s, n in ends:
            if best[a] is not None and (best[e] is None or best[a][0] + s > best[e][0]):
                best[e] = (best[a][0] + s, best[a][1] + n)
    return best[-1][1]


def test_viterbi_ties():
    rng = random.Random(8)
    for _ in range(300):
        pieces = {"".join(rng.choice("ab▁") for _ in range(rng.randrange(1, 4))): float(-rng.randrange(3)) for _ in range(rng.randrange(6))}
        own = token_counts.UnigramCounter(list(pieces.items()))
        text = "".join(rng.choice("ab c") for _ in range(rng.randrange(1, 12)))
        assert own.count(text) == brute(pieces, "▁" + text.replace(" ", "▁")), (pieces, text)


@pytest.mark.parametrize("per_shard", [1 << 15, 40])
def test_packing(spark, per_shard):
    values = texts(6, 60)
    df = table(spark, [*values, *values[:9]])
    df = df.unionByName(df.limit(5))  # repeated rows are packed each
    tables = Tables(spark, "t")
    cut = tables.save(packing.pieces(df, JSON, capacity=64))
    rows = packing.pack(cut, 64, per_shard).toPandas().sort_values(["sequence_id", "offset"])
    ends = rows.groupby("sequence_id").length.cumsum()
    assert (rows.offset == ends - rows.length).all() and ends.max() <= 64
    own = bpe.codec(JSON, public_tokenizers.PATTERN)
    assert len(rows) == cut.count()
    for r in df.distinct().collect():
        ids = np.append(own.encode(r["text"] or ""), 0).astype("<u4")
        mine = rows[rows.doc_id == r["doc_id"]].drop_duplicates("piece").sort_values("piece")
        assert mine.piece.tolist() == list(range(len(mine))) and mine.length.sum() == len(ids)
        assert (mine.length[1:] == 64).all() and (len(mine) == 1) == (len(ids) <= 64)
        assert mine.ids_crc32.tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine.start, mine.length)]
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 64) * 1.05 + (2 if per_shard > 1000 else 8)
    assert packing.pack(tables.save(packing.pieces(df.limit(0), JSON))).count() == 0


def sum_of_squares(lengths, capacity):
    """[(length, offset), ...] of each sequence: one by one, each piece goes where the sum of squares gets least."""
    sequences, opened = [], {}
    for s in sorted(lengths, reverse=True):
        squares = {}
        for gap, members in opened.items():
            if members and gap >= s:
                after = {g: len(m) for g, m in opened.items()}
                after[gap] -= 1
                if gap > s:
                    after[gap - s] = after.get(gap - s, 0) + 1
                squares[gap] = sum(n * n for n in after.values())
        if squares:
            gap = min(sorted(squares), key=squares.get)
            at = opened[gap].pop(0)
        else:
            gap, at = capacity, len(sequences)
            sequences.append([])
        sequences[at].append((s, capacity - gap))
        if gap > s:
            opened.setdefault(gap - s, []).append(at)
    return sequences


def test_every_piece_is_placed_by_the_rule(spark):
    """Also where one length has far more than a few hundred pieces."""
    rng = random.Random(2)
    lengths = [rng.choice([3, 7, 11, 11, 13, 20, 29]) for _ in range(2500)]
    want = sum_of_squares(lengths, 30)
    df = spark.createDataFrame([(i, 0, s) for i, s in enumerate(lengths)], "doc_id long, piece int, length long")
    rows = packing.pack(Tables(spark, "t").save(df), 30).collect()
    got = {}
    for r in rows:
        got.setdefault(r["sequence_id"], []).append((r["length"], r["offset"]))
    assert sorted(sorted(x, key=lambda p: p[1]) for x in got.values()) == sorted(want)
