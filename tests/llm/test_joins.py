"""N-gram Jaccard join and embedding near-dedup against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from segweave.llm import embed_dedup, ngram_join
from segweave.llm.common import Tables, connected_components

from .plain import components, table, texts, words_of


def grams(text, n=5):
    words = words_of(text.lower() if text else text)
    k = min(n, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


@pytest.mark.parametrize("block", [512, 4, 2])
def test_jaccard(spark, block):
    values = texts(4, 90)
    df = table(spark, values)
    sets = {r["doc_id"]: grams(r["text"]) for r in df.collect()}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    group = components(ids, links)
    got = {r["doc_id"]: r for r in ngram_join.join(df, Tables(spark, "t"), block=block).collect()}
    assert sorted(got) == ids and links
    assert {i: got[i]["n_links"] for i in ids} == {i: sum(i in p for p in links) for i in ids}
    assert {i: got[i]["component_id"] for i in ids} == group
    assert {i: got[i]["kept"] for i in ids} == {i: group[i] == i for i in ids}


def test_jaccard_edges(spark):
    df = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (2, "One  two three four five\tsix"), (None, "one two three four five six"), (3, None), (4, "")], "doc_id long, text string")
    rows = ngram_join.join(df, Tables(spark, "t")).collect()
    assert sorted((r["doc_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows if r["doc_id"]) == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True)]
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(3, 1, False)]
    assert ngram_join.join(df.limit(0), Tables(spark, "t")).count() == 0


def chain(n=60):
    """Each text shares most of its words with the next, so that all are one component and few are links."""
    words = [f"w{i}" for i in range(60 + 12 * n)]
    return [" ".join(words[12 * i : 12 * i + 60]) for i in range(n)] + [" ".join([*words[12 * i : 12 * i + 60], f"more{k}"]) for i in range(0, n, 7) for k in range(3)]


def test_long_chains(spark):
    """Components whose buckets have fewer pairs are verified bucket by bucket, with the same links."""
    values = chain()
    df = table(spark, values)
    sets = {r["doc_id"]: grams(r["text"]) for r in df.collect()}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    for block in (512, 8, 3):
        got = {r["doc_id"]: r["n_links"] for r in ngram_join.join(df, Tables(spark, "t"), block=block).collect()}
        assert got == {i: sum(i in p for p in links) for i in sets} and len(links) > 20


def test_groups(spark):
    near = spark.createDataFrame([(i, 1) for i in range(1, 9)] + [(i, 20) for i in range(20, 23)] + [(i, 30) for i in range(30, 36)], "node long, component long")
    same = lambda i: [[100, 200], [5, 6]][i < 30]
    bands = {i: [1000 + i // 2, 2000 + (i + 1) // 2] for i in range(1, 9)} | {i: [7, 8] for i in range(20, 23)} | {i: same(i) for i in range(30, 36)}
    classes = spark.createDataFrame(list(bands.items()), "node long, bands array<long>")
    got = {r["node"]: sorted(tuple(g) for g in r["groups"]) for r in ngram_join.groups_of(near, classes, Tables(spark, "t"), 4).collect()}
    assert got[2] == [(1001, 0, 1), (2001, 1, 1)]  # a chain: by buckets
    assert got[30] == [(30, -1, 2)]  # all alike: as a component
    assert got[20] == [(20, -1, 1)]  # small


def test_bands():
    bands, rows = ngram_join.plan_bands(0.8, 0.999, 24)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands <= 24 and rows >= 5


@pytest.mark.parametrize("block", [None, 16])
def test_embeddings(spark, block):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 24))
    near = base[rng.integers(0, 40, 80)] + rng.normal(size=(80, 24)) * rng.choice([0.05, 0.28, 0.33], size=(80, 1))
    vectors = np.concatenate([base, near, base[:5] * 3]).astype(np.float32)
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1)[:, None]
    ids = list(range(len(vectors)))
    hit = unit @ unit.T >= 0.95
    links = [(a, b) for a in ids for b in ids if a < b and hit[a, b]]
    odd = [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [None] * 24), (904, [float("inf")] + [1.0] * 23), (905, [1.0]), (906, [])]
    df = spark.createDataFrame([*((i, [float(x) for x in v]) for i, v in enumerate(vectors)), *odd], "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("rep", F.lit("x"))
    got = {r["vec_id"]: r for r in embed_dedup.link(df, Tables(spark, "t"), block=block).collect()}
    group = components(ids, links)
    assert {i: got[i]["n_links"] for i in ids} == {i: sum(i in p for p in links) for i in ids}
    assert {i: got[i]["component_id"] for i in ids} == group
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i, _ in odd)
    assert embed_dedup.link(df.limit(0), Tables(spark, "t")).count() == 0


def test_embedding_copies(spark):
    rows = [(i, [1.0, 2.0, -0.0]) for i in (5, 3, 9)] + [(3, [1.0, 2.0, 0.0]), (7, [-1.0, 0.0, 0.0])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embed_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), Tables(spark, "t")).collect())
    assert got == [(3, 3, 3), (3, 3, 3), (5, 3, 3), (7, 0, 7), (9, 3, 3)]


def test_embeddings_of_several_lengths(spark):
    rng = np.random.default_rng(5)
    rows, links = [], []
    for dim in (2, 3, 7):
        base = rng.normal(size=(30, dim))
        vectors = np.concatenate([base, base[:9] * 2 + rng.normal(size=(9, dim)) * 0.01, base[:4]])
        unit, at = vectors / np.linalg.norm(vectors, axis=1)[:, None], len(rows)
        hit = unit @ unit.T >= 0.95
        links += [(at + a, at + b) for a in range(len(vectors)) for b in range(a + 1, len(vectors)) if hit[a, b]]
        rows += [(at + i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (900, rows[0][1][:1])], "vec_id long, embedding array<double>")
    group = components(range(len(rows)), links)
    for block in (None, 5):
        got = embed_dedup.link(df, Tables(spark, "t"), block=block).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got if r["vec_id"] not in (None, 900)} == {i: (sum(i in p for p in links), group[i]) for i, _ in rows}
        assert sorted((r["n_links"], r["kept"]) for r in got if r["vec_id"] in (None, 900)) == [(0, True), (0, True)]


def test_strips_keep_what_is_connected():
    rng = np.random.default_rng(6)
    for _ in range(30):
        i, j = rng.integers(5, 25, 18), rng.integers(100, 140, 18)
        columns, heads, rows, others = embed_dedup.fewer(i, j)
        nodes = set(i.tolist()) | set(j.tolist())
        assert components(nodes, zip(i.tolist(), j.tolist())) == components(nodes, [*zip(columns.tolist(), heads.tolist()), *zip(rows.tolist(), others.tolist())])


def test_error_bounds():
    rng = np.random.default_rng(0)
    x = embed_dedup.unit(rng.normal(size=(200, 48)) ** 3)
    q, s, e = embed_dedup.quantise(x)
    product = (q.astype(float) * s[:, None]) @ (q.astype(float) * s[:, None]).T
    assert (np.abs(product - x @ x.T) <= e[:, None] + e[None, :] + e[:, None] * e[None, :] + 1e-12).all()


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 440)]
    want = components({x for e in edges for x in e}, edges)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long"), Tables(spark, "t")).collect()}
    assert got == {k: v for k, v in want.items() if k in got} and all(k in got or want[k] == k for k in want)
