"""Shared folder handling and small helpers of the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.scratch import few, shared_root

#: ASCII white space as the operators' word rule has it (fixed value): space, \t \n \v \f \r.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


#: Spark's switch for removing the shuffle files of a query when it is over, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder to cut lineage; ``drop`` removes those not asked to stay.

    A written table survives the loss of any executor and is computed once.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._paths: list[str] = []

    def path(self, name: str, stay: bool = False) -> str:
        path = f"{self.root}/{name}"
        if not stay:
            self._paths.append(path)
        return path

    def table(self, df: DataFrame, name: str, stay: bool = False) -> DataFrame:
        """Write ``df`` and read it back. ``stay`` keeps it after ``drop`` (an operator's result)."""
        path = self.path(name, stay)
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove the named tables, or all that were not asked to stay."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for path in [f"{self.root}/{x}" for x in names] or list(self._paths):
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
            if path in self._paths:
                self._paths.remove(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parts_for(spark: SparkSession, df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """Shuffle partitions for ``df`` from the size Spark's optimizer expects, at least the session's."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // bytes_each, 100_000))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for a row, whatever the optimizer moves where:
    an expression that stands in a lambda function is else computed for each element."""
    return F.transform(F.array(value), use)[0]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that a worker's memory doesn't follow the size of Arrow's."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


__all__ = ["Scratch", "ascii_lower", "documents", "few", "once", "parts_for", "sliced", "words"]
