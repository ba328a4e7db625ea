"""The pipeline's stages against plain versions of what they decide, and its defined cases."""

from collections import Counter
from functools import reduce
from operator import and_

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from segweave.llm import ngram_join
from segweave.llm.common import Tables


@pytest.fixture(scope="module")
def steps(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out, tables = [docs], Tables(spark, "steps")
    for _, stage in p.STAGES:
        out.append(tables.save(stage(spark, out[-1], data)))
    return out


def test_columns_and_order(steps):
    assert [n for n, _ in p.STAGES] == ["language_id", "toxicity", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"]
    assert all(s.columns == steps[0].columns and s.dtypes == steps[0].dtypes for s in steps[:-1])


def test_filters_keep_clean_documents(spark, data, steps):
    labels = spark.read.parquet(f"{data}/labels.parquet").where("toxic = 0").select("doc_id")
    clean = steps[1].join(labels, "doc_id", "left_semi")
    assert steps[2].join(labels, "doc_id", "left_semi").count() >= 0.99 * clean.count()
    assert steps[1].count() >= 0.98 * steps[0].count()


def test_one_of_each_group(spark, steps):
    kept = {r["doc_id"] for r in ngram_join.join(steps[2], Tables(spark, "t")).where("kept").collect()}
    assert sorted(r["doc_id"] for r in steps[3].select("doc_id").collect()) == sorted(kept)


def test_repeats(steps):
    """Against all strings of the width, byte by byte."""
    raw = {r["doc_id"]: (r["text"] or "").encode() for r in steps[3].collect()}
    n = Counter(b[i : i + p.WIDTH] for b in raw.values() for i in range(len(b) - p.WIDTH + 1))
    left = {}
    for k, b in raw.items():
        cover = bytearray(len(b))
        for i in range(len(b) - p.WIDTH + 1):
            if n[b[i : i + p.WIDTH]] > 1:
                cover[i : i + p.WIDTH] = b"\1" * p.WIDTH
        left[k] = bytes(x for x, c in zip(b, cover) if not c).decode("utf-8", "ignore")
    assert {r["doc_id"]: r["text"] for r in steps[4].collect()} == left
    assert steps[4].where(F.char_length("text") != F.col("n_chars")).count() == 0


def test_packing(steps):
    rows = steps[5].toPandas().sort_values(["sequence_id", "offset"])
    ends = rows.groupby("sequence_id").length.cumsum()
    assert (rows.offset == ends - rows.length).all() and ends.max() <= 2048
    assert set(rows.doc_id) == {r["doc_id"] for r in steps[4].select("doc_id").collect()}
    assert rows.sequence_id.nunique() <= np.ceil(rows.length.sum() / 2048) * 1.1 + 1


def test_odd_rows_and_extra_columns(spark, data, steps):
    odd = spark.createDataFrame([(None, "Of the in that which and the end", None, None, None), (700001, None, "en", "x", 0), (700002, "", "en", "x", 0), (700003, "the same words here again and again", "en", "x", 5), (700003, "the same words here again and again", "en", "x", 5)], steps[0].schema)
    extra = ["rank", "row", "score", "cosine", "predicted", "rejected", "lang_pred", "kept", "removed", "n_bytes", "n_removed", "own", "_own", "_rank", "_row", "_nth", "_t", "_at", "a.b"]
    docs = steps[0].unionByName(odd).select("*", *(F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in extra))
    want = docs.dtypes
    for _, stage in p.STAGES[:-1]:
        docs = Tables(spark, "odd").save(stage(spark, docs, data))
        assert docs.dtypes == want
        assert docs.where(~reduce(and_, (F.col(f"`{c}`") == F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in extra))).count() == 0
    assert docs.where("doc_id = 700003").count() <= 1
    assert docs.where("doc_id in (700001, 700002)").count() == 0


def test_empty(spark, data, steps):
    docs = steps[0].limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, data)
    assert docs.count() == 0


def test_run(spark, data, steps):
    assert p.run(spark, data).count() == steps[5].count()
