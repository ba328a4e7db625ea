"""Helpers shared by the operators: shared-folder tables, components, Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temp folder where it is unset (tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    fixed = sc.getCheckpointDir()
    if fixed is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="segweave-"))
        fixed = sc.getCheckpointDir()
    return fixed.rstrip("/")


#: Settings of a step while it is written, put back afterwards: whole texts are long, and both sides of a Python worker hold a
#: batch; the shuffle files of a step go when it ends.
STEP = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


#: No marker file, and on a local file system no checksum files and no permissions of their own: for each of these Hadoop starts a
#: process, which holds the memory of the driver or executor a second time until it runs. Whoever reads a table here has
#: waited for its writer. Only these writes are meant, so the file system is not the one that the session keeps.
QUIET = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

#: In place of the checksum files: Parquet's own checksums, written by default, are compared.
SURE = {"parquet.page.verify-checksum.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside a ``with`` only."""
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Tables:
    """Writes intermediate results as Parquet in the shared folder, which cuts lineage and survives lost executors.

    ``drop`` removes one that no later step reads, ``close`` all of them; those that are left go when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0
        # the handles are taken now: the session may have been stopped when the driver ends
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        atexit.register(self.close)

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        """The table reread, and its path for ``drop``."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        with settings(self.spark, STEP):
            df.write.options(**QUIET).parquet(path)
        return self.spark.read.schema(df.schema).options(**SURE).parquet(path), path

    def save(self, df: DataFrame) -> DataFrame:
        return self.write(df)[0]

    def drop(self, path: str) -> None:
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self._conf).delete(where, True)

    def close(self) -> None:
        """Removes every table; results that read them are not to be used any more."""
        atexit.unregister(self.close)
        with suppress(Exception):  # the JVM may be gone, and with it whoever could delete
            self.drop(self.root)


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str, step: int = 1024) -> DataFrame:
    """``mapInArrow`` over slices of at most ``step`` rows, so that a worker holds few rows at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                yield from fn(batch.slice(at, step))

    return df.mapInArrow(run, schema)


def connected_components(edges: DataFrame, tables: Tables) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; component is the least node reachable.

    Alternating large-star and small-star rounds: a node's neighbours are only ever reduced to their minimum
    (pre-aggregated before the shuffle), never gathered. Every step is a table in the shared folder, so that both sides of
    each join are plain exchanges, in which Spark splits the edges of a hub over tasks.
    """

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now, path = tables.write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, path_1 = tables.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large, path_2 = tables.write(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        lower, path_3 = tables.write(large.groupBy("u").agg(F.min("v").alias("m")))
        pair = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        after, after_path = tables.write(large.join(lower, "u").select(F.inline(pair)).where("u <> v").distinct())
        found = mark(after)
        for old in (path, path_1, path_2, path_3):
            tables.drop(old)
        same, now, path, seen = found == seen, after, after_path, found
        if same:
            stars = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
            return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def tiles_of(block: Column, blocks: Column) -> Column:
    """The pairs (x, y) of blocks that a block takes part in, so that each pair of 0 .. blocks - 1 comes once.

    A block meets itself and the following half of the circle of blocks, which gives every block equal work.
    """
    half = F.floor(blocks / 2).cast("int")
    steps = F.sequence(F.lit(0), half)
    pair = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    both = F.concat(F.transform(steps, lambda s: pair(block, F.pmod(block + s, blocks))), F.transform(steps, lambda s: pair(F.pmod(block - s, blocks), block)))
    # half way round an even circle a pair would come from both its blocks
    once = lambda p: (p["x"] == p["y"]) | (blocks % 2 == 1) | (F.pmod(p["y"] - p["x"], blocks) != half) | (p["x"] < p["y"])
    return F.array_distinct(F.filter(both, once))
