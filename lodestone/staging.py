"""Tables written to the folder that all machines of the cluster share.

A written table cuts lineage: what reads it can be recomputed without the plan
above it, and it survives the loss of any executor. The folder is the one that
the session names in ``spark.checkpoint.dir``; only where that is unset and all
tasks run on this machine (a local master) is a temporary folder used.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A staged write needs its shuffle files no longer than it runs.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this application, as a URI or a path."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        _own = _own or tempfile.mkdtemp(prefix="lodestone-")
        named = f"file://{_own}"
    return f"{named.rstrip('/')}/lodestone-{spark.sparkContext.applicationId}"


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Actions within it leave no shuffle files."""
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, was)


class Staging:
    """Names and removes the tables that one call of an operator stages."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        fs, path = _filesystem(spark, self.root)
        fs.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes `df` and returns the written table."""
        path = self.path(name)
        with cleaned(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def numbered(self, df: DataFrame, order: list[Column], column: str, name: str) -> DataFrame:
        """`df`, written, with the place of each row (from 0) in an order, which no single task sorts.

        Ranges of rows are sorted and number their own rows; those before each
        range are added.
        """
        sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(column, F.monotonically_increasing_id())
        rows = self.write(sorted_, name)
        part = F.shiftright(column, 33)  # how the built-in puts together a partition's number and a row's
        held = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__held"))  # a row for each range
        before = F.coalesce(F.sum("__held").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bases = F.broadcast(held.select("__part", before.alias("__before")))
        joined = rows.withColumn("__part", part).join(bases, "__part")
        return joined.withColumn(column, F.col("__before") + F.col(column).bitwiseAND(F.lit((1 << 33) - 1))).select(rows.columns)

    def drop(self, *names: str) -> None:
        """Removes staged tables that nothing reads any more."""
        for name in names:
            fs, path = _filesystem(self.spark, self.path(name))
            fs.delete(path, True)
