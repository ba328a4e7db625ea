from pyspark.sql import functions as F

from segweave.streaming import changelog


def test_compaction(spark, tmp_path):
    changes = spark.range(100).select((F.col("id") % 7).alias("key"), F.col("id").alias("at"), F.concat(F.lit("v"), "id").alias("value"))
    source, target, out = (str(tmp_path / x) for x in ("in", "out", "final"))
    for lo in (0, 50):
        changes.where(f"at >= {lo} and at < {lo + 50}").coalesce(1).write.mode("append").parquet(source)
        query = changelog.follow(spark, source, changes.schema, target, str(tmp_path / "ck"), ["key"], "at", 1)
        query.awaitTermination(60)
    want = {(r["key"], r["value"]) for r in changelog.latest(changes, ["key"], "at").collect()}
    assert {(r["key"], r["value"]) for r in changelog.current(spark, target, ["key"], "at").collect()} == want
    changelog.compact(spark, target, out, ["key"], "at")
    assert spark.read.parquet(out).count() == 7
