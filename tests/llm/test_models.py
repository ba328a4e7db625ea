"""Language ID, toxicity and fingerprints: held-out accuracy, defined cases, plain versions."""

import hashlib
import os
import random
import tracemalloc
import zlib

import numpy as np
from pyspark.sql import functions as F

from segweave.llm import langid, order_minhash, toxicity
from segweave.llm.common import Tables

from .plain import table, texts

SOUNDS = {"aa": "lo ra mi tu be", "bb": "sch ung eit ver über", "cc": "ção não mãe quê é"}


def prose(lang, rng, n=30):
    return " ".join("".join(rng.choice(SOUNDS[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def labelled(spark, n=300):
    rng = random.Random(4)
    rows = [(i, prose(lang := rng.choice(list(SOUNDS)), rng), lang) for i in range(n)]
    rows += [(9001, None, "aa"), (9002, "", "aa"), (9003, "123 ...", "bb"), (9004, prose("bb", rng), None), (9005, prose("bb", rng, 30_000), "bb"), (9005, prose("bb", rng), "bb")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("source", F.lit("s"))


def test_language(spark):
    df = labelled(spark)
    rows = langid.identify(df).collect()
    assert len(rows) == df.count()
    got = {r["doc_id"]: r for r in rows}
    truth = {r["doc_id"]: r["lang"] for r in df.collect()}
    out = [i for i in range(300) if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(300))
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in out]) >= 0.98
    assert all((got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True) for i in (9001, 9002, 9003))
    assert got[9004]["lang_pred"] == "bb" == got[9005]["lang_pred"] and all(0 <= r["score"] <= 1 for r in rows)
    assert not any(got[i]["rejected"] for i in range(300))


def test_language_left_out(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").cache()
    rejected = {True: [], False: []}
    for lang in [r["lang"] for r in df.select("lang").distinct().collect()]:
        rest = df.withColumn("lang", F.when(F.col("lang") != lang, F.col("lang")))
        rows = langid.identify(rest).join(df.select("doc_id", F.col("lang").alias("truth")), "doc_id").collect()
        for r in rows:
            if r["truth"] == lang or r["held_out"]:
                rejected[r["truth"] == lang].append(r["rejected"])
    assert np.mean(rejected[True]) >= 0.95 and np.mean(rejected[False]) <= 0.02, {k: (sum(v), len(v)) for k, v in rejected.items()}


def test_clusters_split_the_bulk():
    rng = np.random.default_rng(2)
    bulk = np.abs(rng.normal(1, 0.3, (400, 40))) * np.where(np.arange(40) < 20, np.arange(400)[:, None] % 2 * 2 + 1, 1)
    rows = np.concatenate([bulk, np.eye(40)[:8]])  # outliers that a farthest-first start would pick
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    centres, near = langid.kmeans(rows, 6)
    assert np.bincount(near)[: len(centres)].min() >= 8 and np.bincount(near).max() < 300


def test_copies_do_not_fill_the_samples(spark, monkeypatch):
    seen = []
    for kind, fit_one in ((langid, "kmeans"), (toxicity, "train")):
        monkeypatch.setattr(kind, fit_one, lambda rows, *a, f=getattr(kind, fit_one): seen.append(len(rows)) or f(rows, *a))
    rng = random.Random(6)
    rows = [(i, prose("aa", rng), "aa") for i in range(40)] + [(100 + i, prose("bb", rng), "bb") for i in range(40)]
    # many copies of each of 40 texts, of which any sample draws some
    rows += [(1000 + i, rows[i % 40][1], "aa") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.fit(df, per_lang=20)
    assert model.langs == ["aa", "bb"] and len(seen) == 2 and all(8 <= n <= 40 for n in seen), seen
    labels = spark.createDataFrame([(r[0], int(r[2] == "bb")) for r in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "train", lambda got: seen.append(got))
    toxicity.fit(df, labels, most=40)
    got = [(p.tobytes(), y) for p, y in seen[-1]]
    assert len(set(got)) == len(got) and {y for _, y in got} == {0, 1} and 20 <= len(got) <= 80


def test_language_without_rows(spark):
    df = labelled(spark)
    assert langid.identify(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_counts_in_pieces():
    text = "abc déf " * 200_000
    whole = langid.counts(text)
    assert whole.sum() == sum(len(f" {text.strip()} ".encode()) - k + 1 for k in (2, 3, 4))


def toxic_rows(spark, n=600):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(3, 60))]
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        words += ["nastyword"] * insult + ["groupname"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(insult and group), 1))
    rows += [(9001, None), (9002, ""), (9003, "nastyword groupname " * 30_000), (9004, "w1"), (9004, "w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("predicted", F.lit("clash")).withColumn("toxic", F.lit("no input"))
    return docs, spark.createDataFrame([*labels, (5, None, 1), (77777, 1, 1)], "doc_id long, toxic int, quality int"), dict((i, t) for i, t, _ in labels)


def test_toxicity_learns_pairs(spark):
    docs, labels, truth = toxic_rows(spark)
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    out = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in out]) >= 0.97
    assert next(r for r in rows if r["doc_id"] == 9003)["predicted"] == 1
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_toxicity_scores_pairs_of_places_without_weight():
    size = 1 << toxicity.BITS
    model = toxicity.FactorMachine(-1.0, np.zeros(size, np.float32), np.zeros((size, toxicity.RANK), np.float32), 0.0)
    one, two = (int(toxicity.terms(w)[0]) for w in ("abc", "xyz"))
    model.linear[one], model.factors[one, 0], model.factors[two, 0] = 0.5, 2.0, 3.0
    got = model.scores(["abc", "xyz", "abc xyz", "abc pqr", None])
    assert np.allclose(np.log(got / (1 - got)), [-0.5, -1.0, 5.5, -0.5, -1.0], atol=1e-5)


def test_toxicity_without_labels(spark):
    docs, labels, _ = toxic_rows(spark, 30)
    assert {r["predicted"] for r in toxicity.score(docs, labels.limit(0)).collect()} == {0}


def plain_edit(docs):
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        out[i] = (len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest(), nxt)
    return out


def test_fingerprints(spark):
    df = table(spark, texts(12, 60))
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = plain_edit(docs)
    for ranges in (2, 9, None):
        rows = {r["doc_id"]: r for r in order_minhash.edit_report(df, ranges=ranges).collect()}
        assert {i: (r["n_chars"], r["edited_sha256"]) for i, r in rows.items()} == {i: w[:2] for i, w in want.items()}
    by_text = {}
    for i, t in docs:
        assert by_text.setdefault(t or "", rows[i]["fingerprint"]) == rows[i]["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows.values())
    long = [i for i, t in docs if t and len(t) > 400 and len(set(t)) > 10]
    assert np.mean([rows[i]["near_edited"] for i in long]) > np.mean([rows[i]["near_next"] for i in long])
    assert all(rows[i]["near_next"] == 1 for i, t in docs if (t or "") == want[i][2])


def test_fingerprint_order_matters(spark):
    rng = random.Random(1)
    words = [f"word{rng.randrange(1000)}" for _ in range(400)]
    swapped = words[200:] + words[:200]
    some = words[:]
    some[7] = "other"
    df = spark.createDataFrame([(" ".join(words), " ".join(swapped), " ".join(some))], "a string, b string, c string")
    r = order_minhash.entries(df, {"a": "fa", "b": "fb", "c": "fc"}).select(order_minhash.likeness("fa", "fb").alias("moved"), order_minhash.likeness("fa", "fc").alias("edited")).first()
    assert r["edited"] > 0.9 > r["moved"]


def test_fingerprint_edges(spark):
    one = spark.createDataFrame([(4, "ab")], "doc_id long, text string")
    r = order_minhash.edit_report(one).first()
    assert (r["n_chars"], r["near_next"]) == (2, 1.0)
    assert order_minhash.edit_report(one.limit(0)).count() == 0
    rows = order_minhash.edit_report(spark.createDataFrame([(None, None), (None, ""), (3, "x"), (3, "x")], "doc_id long, text string")).collect()
    assert len(rows) == 4 and sum(r["fingerprint"] == "" for r in rows) == 2


def test_language_fits_in_little_memory(spark):
    """The driver holds the vectors of a language once, and one copy of a cluster."""
    rng = random.Random(8)
    df = spark.createDataFrame([(i, prose("bb", rng), "bb") for i in range(600)], "doc_id long, text string, lang string")
    tracemalloc.start()
    langid.fit(df)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.4 * 600 * langid.DIM * 4, peak


def test_toxicity_sample_comes_deflated(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(20_000)}" for _ in range(800)), i % 2) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    seen, sent = [], []
    monkeypatch.setattr(toxicity, "train", lambda got: seen.extend(got))
    monkeypatch.setattr(toxicity, "unpacked", lambda data, f=toxicity.unpacked: sent.append(len(data)) or f(data))
    toxicity.fit(docs.drop("toxic"), docs.drop("text"))
    assert sorted((p.tolist(), y) for p, y in seen) == sorted((toxicity.terms(t).tolist(), y) for _, t, y in rows)
    assert sum(sent) < 0.6 * sum(p.nbytes for p, _ in seen) and all(p.itemsize == 4 for p, _ in seen)
    assert toxicity.unpacked(toxicity.packed(toxicity.terms(""))) == b""


def test_tables_leave_no_marker(spark):
    _, path = (tables := Tables(spark, "marker")).write(spark.range(3))
    names = os.listdir(path.removeprefix("file:"))
    assert any(n.startswith("part-") for n in names) and "_SUCCESS" not in names
    tables.close()
