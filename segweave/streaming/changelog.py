"""Append-only changelogs of segments and telemetry, compacted by Structured Streaming."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def places(spark: SparkSession) -> tuple[str, str]:
    """New folders for a stream's output and checkpoint, below the shared checkpoint folder (a temp folder where none is set, in local mode)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None and spark.sparkContext.master.startswith("local"):
        base = tempfile.mkdtemp(prefix="changelog-")
    if base is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = f"{base.rstrip('/')}/changelog-{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/checkpoint"


def latest(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last change of each key."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("v")).select(*keys, "v.*")


def follow(spark: SparkSession, source: str, schema, target: str, checkpoint: str, keys: list[str], order: str, per_trigger: int = 16) -> StreamingQuery:
    """Reads what is new in ``source`` and writes each batch's last change per key to ``target``; ends when it has caught up.

    Batches are written under their own number, so one that is run again after a failure replaces itself.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(source)

    def upsert(batch: DataFrame, number: int) -> None:
        latest(batch, keys, order).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append(changes: DataFrame, target: str, number: int, keys: list[str], order: str, out: str | None = None, telemetry: DataFrame | None = None, telemetry_target: str | None = None) -> int:
    """Writes one batch of changes under its number; compacts to ``out`` where that is given, which ends a run of batches.

    Gives the milliseconds that took. Telemetry of the batch is written after it, with that time as its checkpoint_ms.
    """
    began = time.perf_counter()
    latest(changes, keys, order).write.mode("overwrite").parquet(f"{target}/batch={number}")
    if out is not None:
        compact(changes.sparkSession, target, out, keys, order)
    took = int((time.perf_counter() - began) * 1000)
    if telemetry is not None:
        telemetry.withColumn("checkpoint_ms", F.lit(took).cast("long")).write.mode("overwrite").parquet(f"{telemetry_target}/batch={number}")
    return took


def current(spark: SparkSession, target: str, keys: list[str], order: str) -> DataFrame:
    """The state after all batches."""
    return latest(spark.read.parquet(target).drop("batch"), keys, order)


def compact(spark: SparkSession, target: str, out: str, keys: list[str], order: str) -> None:
    """The state as one table, sorted by key within its files."""
    current(spark, target, keys, order).repartition(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(out)


def live_counts(spark: SparkSession, source: str, schema, on_batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Status counts of a feed as it grows, in update mode."""
    feed = spark.readStream.schema(schema).parquet(source)
    return feed.groupBy("namespace", "status").agg(F.count("*").alias("n")).writeStream.outputMode("update").foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
