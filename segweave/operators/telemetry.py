"""Views and summaries over inference records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import INFERENCE, INFERENCE_DEFAULTS


def migrated(records: DataFrame) -> DataFrame:
    """Records with every column of the schema; older ones get the defaults of those they lack."""
    out = records
    for field in INFERENCE.fields:
        given = F.col(field.name) if field.name in records.columns else F.lit(None)
        default = INFERENCE_DEFAULTS.get(field.name)
        out = out.withColumn(field.name, (F.coalesce(given, F.lit(default)) if default is not None else given).cast(field.dataType))
    return out.select(*INFERENCE.names)


def upserted(records: DataFrame, order: str) -> DataFrame:
    """The last record of each id."""
    return records.groupBy("id").agg(F.max_by(F.struct(*(c for c in records.columns if c != "id")), order).alias("v")).select("id", "v.*")


def stage_metrics(records: DataFrame) -> DataFrame:
    return records.groupBy("segment_id", "stage").agg(
        F.count("id").alias("inference_count"),
        F.sum("duration_ms").alias("total_duration_ms"),
        F.sum("prompt_tokens").alias("total_prompt_tokens"),
        F.sum("completion_tokens").alias("total_completion_tokens"),
    )


def workflow_metrics(records: DataFrame) -> DataFrame:
    flag = lambda stage: F.max(F.when(F.col("stage") == stage, 1).otherwise(0)).cast("int")
    return records.groupBy("segment_id", "namespace").agg(
        F.min("started_at").alias("started_at"),
        F.max("finished_at").alias("finished_at"),
        flag("critique").alias("used_critique"),
        flag("refine").alias("used_refine"),
        F.sum("duration_ms").alias("total_duration_ms"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
    )


def in_namespace(records: DataFrame, namespace: str | None) -> DataFrame:
    return records if namespace is None else records.where(F.col("namespace") == namespace)


def global_summary(records: DataFrame, namespace: str | None = None) -> DataFrame:
    """One row, or none without records."""
    total = in_namespace(records, namespace).agg(
        F.count("*").alias("total_requests"),
        F.sum("prompt_tokens").alias("total_prompt_tokens"),
        F.sum("completion_tokens").alias("total_completion_tokens"),
        F.sum("duration_ms").alias("total_duration_ms"),
    )
    return total.where("total_requests > 0")


def stage_breakdown(records: DataFrame, namespace: str | None = None) -> DataFrame:
    return in_namespace(records, namespace).groupBy("stage").agg(
        F.count("*").alias("requests"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.avg("duration_ms").alias("avg_duration_ms"),
    )


def workflow_summary(records: DataFrame, namespace: str | None = None) -> DataFrame:
    return workflow_metrics(in_namespace(records, namespace)).orderBy("started_at", "segment_id", "namespace")


def record_of(response: DataFrame, usage_source: Column | None = None) -> DataFrame:
    """Telemetry rows of generator responses; missing token counts are a quarter of the lengths."""
    guess = lambda text: F.floor(F.char_length(text) / 4).cast("long")
    rows = response.withColumn("prompt_tokens", F.coalesce("prompt_tokens", guess(F.col("prompt")))).withColumn("completion_tokens", F.coalesce("completion_tokens", guess(F.col("content"))))
    return migrated(rows.withColumn("usage_source", usage_source if usage_source is not None else F.lit("locally_estimated")))
