"""Models and fingerprints against plain versions, and texts of more than 256 kB."""

import math
import random
import struct

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from segweave.llm import langid, ngram_join, order_minhash, token_counts, toxicity
from segweave.llm.common import Tables

from .plain import texts
from .test_models import SOUNDS, labelled, prose


def spark_hash(*values):
    """xxhash64 of columns: each value is hashed with the hash before it as seed; nulls change nothing."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxh64_intdigest(v.encode() if isinstance(v, str) else v, seed)
    return seed


def plain_fingerprint(text, k=2, buckets=64, length=2):
    tokens = regex.findall(r"[\p{L}\p{N}\p{M}]{1,8}|[^\p{L}\p{N}\p{M} \t\n\x0b\f\r]", text or "")
    mask = (1 << 33) - 1
    seen, ranked = {}, {}
    for at in range(len(tokens)):
        kmer = spark_hash(*tokens[at : at + k]) & mask
        number = seen[kmer] = seen.get(kmer, -1) + 1  # the occurrence, from 0
        rank = spark_hash(struct.pack("<q", kmer), struct.pack("<i", number)) & mask
        ranked.setdefault(rank >> (33 - (buckets.bit_length() - 1)), []).append((rank, at))
    out = []
    for bucket in sorted(ranked):
        kept = sorted(sorted(ranked[bucket])[:length], key=lambda p: p[1])
        out.append(f"{bucket:02x}{spark_hash(*(struct.pack('<q', rank) for rank, _ in kept)) & 0xFFFFFF:06x}")
    return out


def plain_likeness(a, b):
    filled = {x[:2] for x in a} | {x[:2] for x in b}
    return len(set(a) & set(b)) / len(filled) if filled else 1.0


def test_fingerprints(spark):
    values = [*texts(11, 40), "word " * 60_000 + "end", "日本 " * 50]
    order = list(range(len(values)))
    df = spark.createDataFrame(list(zip(order, values)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in order_minhash.edit_report(df, ranges=5).collect()}
    for i in order:
        own, after = values[i] or "", values[i - 1] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        a, b, c = (plain_fingerprint(t) for t in (own, edited, after))
        r = got[i]
        assert (r["fingerprint"], r["edited_fingerprint"]) == ("".join(a), "".join(b)), i
        assert math.isclose(r["near_edited"], plain_likeness(a, b)) and math.isclose(r["near_next"], plain_likeness(a, c))


def test_likeness_falls_with_edit_distance(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(10**4)}" for _ in range(300)]
        for share in (0, 2, 10, 30, 80):
            edited = [f"x{rng.randrange(10**4)}" if rng.random() < share / 100 else w for w in words]
            rows.append((share, " ".join(words), " ".join(edited)))
        half = words[150:] + words[:150]  # as a set of words the same, as a text far away
        rows.append((-1, " ".join(words), " ".join(half[::-1])))
    df = order_minhash.entries(spark.createDataFrame(rows, "share int, a string, b string"), {"a": "x", "b": "y"})
    mean = {r["share"]: r["m"] for r in df.groupBy("share").agg(F.avg(order_minhash.likeness("x", "y")).alias("m")).collect()}
    assert mean[0] == 1 and mean[0] > mean[2] > mean[10] > mean[30] > mean[80] and mean[80] < 0.05 and mean[2] > 0.8 and mean[-1] < 0.1, mean


def test_language_model_plainly(spark):
    """The nearest centroid by cosine, one text and one centroid at a time."""
    model = langid.fit(labelled(spark))
    rng = random.Random(8)
    said = [prose(lang, rng, rng.randrange(1, 60)) for lang in SOUNDS for _ in range(20)] + ["zzz qqq xxx " * 9, None, "12"]
    for text, (lang, score, rejected, cosine) in zip(said, model.predict(said)):
        total = langid.counts(text)
        if total is None:
            assert (lang, score, rejected) == ("und", 0.0, True)
            continue
        v = [math.log(1 + n) * w for n, w in zip(total.tolist(), model.idf.tolist())]
        size = math.sqrt(sum(x * x for x in v))
        each = [sum(x * c for x, c in zip(v, centre)) / size for centre in model.centroids.tolist()]
        best = max(range(len(each)), key=each.__getitem__)
        by_lang = [max(c for c, o in zip(each, model.owner) if o == k) for k in range(len(model.langs))]
        odds = [math.exp(model.sharpness * c) for c in by_lang]
        n = sum(x > 0 for x in total.tolist())
        assert lang == model.langs[model.owner[best]] and math.isclose(cosine, each[best], abs_tol=1e-4) and math.isclose(score, max(odds) / sum(odds), rel_tol=1e-2)
        assert rejected == (each[best] < model.floor[best] * math.sqrt(n / (n + model.bend[best]))) or abs(each[best] - model.floor[best] * math.sqrt(n / (n + model.bend[best]))) < 1e-4
    foreign = model.predict(["privet kak dela khorosho " * 5, "xxyyzz qwx kjh wvw " * 6])
    assert all(f[2] for f in foreign)


def test_factor_machine_plainly():
    """All pairs of terms, one by one."""
    rng = np.random.default_rng(4)
    size = 1 << toxicity.BITS
    model = toxicity.FactorMachine(-0.3, np.zeros(size, np.float32), np.zeros((size, toxicity.RANK), np.float32), 0.25)
    words = [f"word{i}" for i in range(30)]
    for w in words:
        for p in toxicity.terms(w):
            model.linear[p], model.factors[p] = rng.normal(), rng.normal(size=toxicity.RANK)
    said = [" ".join(rng.choice(words, rng.integers(1, 12))) for _ in range(30)]
    for text, got in zip(said, model.scores(said)):
        places = toxicity.terms(text).tolist()
        x = len(places) ** -0.25
        z = -0.3 + sum(float(model.linear[p]) * x for p in places)
        z += sum(float(model.factors[p] @ model.factors[q]) * x * x for i, p in enumerate(places) for q in places[:i])
        assert math.isclose(got, 1 / (1 + math.exp(-max(-50, min(50, z)))), rel_tol=1e-3, abs_tol=1e-6)


def test_long_texts(spark):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(10**5)}" for _ in range(60_000))
    assert len(long) > 300_000
    words = long.split(" ")
    words[30_000] = "edited"
    df = spark.createDataFrame([(1, long), (2, " ".join(words)), (3, " ".join(words[:30_000])), (1, long), (4, "short")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_links"], r["component_id"]) for r in ngram_join.join(df, Tables(spark, "t")).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4)]
    path = public_tokenizers.path("piece_bpe_32k.model")
    counted = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, path).collect()}
    halves = spark.createDataFrame([(1, " ".join(long.split(" ")[:30_000])), (2, " ".join(long.split(" ")[30_000:]))], "doc_id long, text string")
    assert counted[1] == sum(r["n_tokens"] for r in token_counts.count_tokens(halves, path).collect())
