"""Cleans a corpus: language ID, toxicity, near-duplicate groups, repeated substrings, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame that is written
as Parquet and reread as the next stage's docs. All but the last return the columns of documents. Rejected documents,
members of a group but its least document, and repeated bytes are gone for good; nothing else is. Any extra columns
of ``docs``, whatever their names, pass through the first four stages unchanged: a stage sees id, text and language only,
and the whole row travels beside them as one struct.

Rows with null or empty texts: language ID rejects them (they have no letter). Rows with equal id and text count as one
document: one of them stays in the near-duplicate stage. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segweave.llm import langid, ngram_join, packing, suffix_dedup, toxicity
from segweave.llm.common import Tables, held_out
from segweave.llm.repeats import KEY, numbered

#: Bytes of a repeated passage that the suffix-array stage removes: 50 words of four letters and a blank each.
WIDTH = 250


def beside(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text, the columns ``more``, and all columns but the text as the struct own."""
    return docs.select("doc_id", "text", *more, F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("own"))


def restored(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` from text and own, but for those that have changed."""
    old = {c: F.col("text") if c == "text" else F.col("own")[c] for c in docs.columns}
    return rows.select(*((changed | {c: x for c, x in old.items() if c not in changed})[c].alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those that language ID rejects go. Learns from rows that are not held out."""
    model = langid.fit(docs, where=~held_out())
    return restored(langid.annotate(beside(docs), model).where(~F.col("rejected")), docs)


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic. Learns from labelled rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, where=~held_out())
    return restored(toxicity.annotate(beside(docs), model).where("predicted = 0"), docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group of near-duplicates (five words, Jaccard 0.8)."""
    kept = ngram_join.join(docs.select("doc_id", "text"), Tables(spark, "near")).where("kept").select(*KEY).distinct()
    # rows equal in id and text become one before they move
    once = numbered(beside(docs), "doc_id", "text", "own").groupBy(*KEY).agg(F.first(F.struct("text", "own")).alias("of"))
    return restored(once.join(kept, KEY).select("of.text", "of.own"), docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated strings of ``WIDTH`` bytes; bytes of a code point that was cut through go too."""
    done = suffix_dedup.dedup(beside(docs), Tables(spark, "repeats"), WIDTH, carry=["own"], as_text=True)
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return restored(done.withColumnRenamed("kept", "text"), docs, n_chars=length)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and its place there."""
    cut = packing.pieces(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return packing.pack(Tables(spark, "pack").save(cut)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("toxicity", clean_of_toxicity),
    ("ngram_jaccard_join", one_of_each_group),
    ("suffix_array_dedup", without_repeats),
    ("best_fit_packing", packed),
]

#: SQL can express neither the learned models nor the packing; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents."""
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if at == len(STAGES) - 1 else tables.save(docs)
    return docs
