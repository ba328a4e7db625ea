"""Rebuilding documents from translated segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import placeholders as ph
from ..functions.text import SPACE, strip
from ..schema import BUILDABLE, NON_BUILDABLE, is_any


def joined(blocks: DataFrame, segments: DataFrame) -> DataFrame:
    """Every block with the text that stands for it, why it is skipped, and what is wrong with it.

    ``blocks``: namespace, seq, id, raw_text, source_hash, placeholders, translatable. Blocks that are not translatable pass as they are.
    """
    stored = segments.select("namespace", "id", *(F.col(c).alias(f"tm_{c}") for c in ("status", "translation", "source_hash", "source_text", "placeholders")))
    rows = blocks.join(stored, ["namespace", "id"], "left")
    known, status = F.col("tm_status").isNotNull(), F.col("tm_status")
    use = F.col("translatable") & known & is_any(status, BUILDABLE) & (F.col("tm_translation") != "")
    skip = F.when(~F.col("translatable"), F.lit(None)).when(~known, "segment not in translation memory").when(use, F.lit(None)).when(is_any(status, NON_BUILDABLE), F.concat(F.lit("status="), status)).when(F.col("tm_translation") == "", "missing translation")
    rows = rows.withColumn("use", F.coalesce(use, F.lit(False))).withColumn("skipped", skip).withColumn("restored", F.when(F.col("use"), ph.restore(F.col("tm_translation"), F.col("tm_placeholders"))))
    error = F.when(
        F.col("use"),
        F.coalesce(
            F.when(F.col("source_hash") != F.col("tm_source_hash"), "source changed since last sync"),
            F.when((F.size("tm_placeholders") == 0) & F.col("tm_source_text").rlike(ph.TOKEN), "no placeholder mapping"),
            ph.drift(F.col("tm_placeholders"), F.col("placeholders")),
            F.col("restored.error"),
        ),
    )
    raw = F.col("raw_text")
    lead, trail = F.regexp_extract(raw, f"^({SPACE}*)", 1), F.regexp_extract(raw, f"({SPACE}*)$", 1)
    text = F.when(F.col("use"), F.concat(lead, strip(F.col("restored.text")), trail)).otherwise(raw)
    return rows.select("namespace", "seq", "id", text.alias("text"), "skipped", error.alias("error"), F.coalesce(status, F.lit("missing")).alias("status"))


def checked(rows: DataFrame, allow_partial: bool = False) -> DataFrame:
    """The rows of ``joined``; reading one that has an error, or is skipped where that is not allowed, fails."""
    blame = F.coalesce(F.col("error"), F.lit(None) if allow_partial else F.col("skipped"))
    said = F.concat_ws(" ", F.lit("build blocked at"), F.col("namespace"), F.col("id"), blame)
    return rows.where(F.when(blame.isNotNull(), F.raise_error(said).cast("boolean")).otherwise(True))


def documents(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """(namespace, text): blocks joined in order."""
    parts = F.array_sort(F.collect_list(F.struct("seq", F.col(text_col).alias("t"))))
    return rows.groupBy("namespace").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"))


def skips(rows: DataFrame) -> DataFrame:
    """Per namespace: how many blocks are skipped, and the first five with their reasons."""
    some = rows.where("skipped is not null")
    nth = F.row_number().over(Window.partitionBy("namespace").orderBy("seq"))
    # Spark keeps five a namespace and task before it moves them
    five = some.select("namespace", "seq", F.concat(F.substring("id", 1, 8), F.lit("("), F.col("skipped"), F.lit(")")).alias("t")).withColumn("nth", nth).where("nth <= 5")
    listed = five.groupBy("namespace").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "t"))), lambda p: p["t"]), ", ").alias("first"))
    return some.groupBy("namespace").agg(F.count("*").alias("n_skipped")).join(listed, "namespace")


def injected(text: Column, lines: list[str]) -> Column:
    """Lines put right after the first document class."""
    found = F.regexp_extract(text, r"\\documentclass(?:\[[^\]]*\])?\{[^}]+\}", 0)
    end = F.instr(text, found) + F.char_length(found) - 1
    block = "\n% injected lines\n" + "\n".join(lines) + "\n% end of injected lines\n"
    return F.when(found == "", text).otherwise(F.concat(F.substring(text, F.lit(1), end), F.lit(block), F.substring(text, end + 1, F.char_length(text))))


def lossless(blocks: DataFrame, sources: DataFrame) -> DataFrame:
    """(namespace, lossless, first_difference): whether the raw blocks joined are the document (namespace, content)."""
    whole = documents(blocks, "raw_text").join(sources, "namespace")
    same = F.col("text") == F.col("content")
    # the first place where both differ, by halving: prefixes are equal up to it
    longest = F.greatest(F.char_length("text"), F.char_length("content"))
    steps = F.transform(F.sequence(F.lit(30), F.lit(0), F.lit(-1)), lambda i: F.pow(F.lit(2), i).cast("int"))
    shared = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= longest) & (F.substring(F.col("text"), F.lit(1), at + s) == F.substring(F.col("content"), F.lit(1), at + s)), at + s).otherwise(at))
    return whole.select("namespace", same.alias("lossless"), F.when(~same, shared).alias("first_difference"))
