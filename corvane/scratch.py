"""Written tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.errors import InvalidParameter

#: Tables up to so many rows, and about so many bytes, are broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 128 << 20


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. A session on one machine without it gets a folder of its own, which goes when
    the process ends; on a cluster a missing setting is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise InvalidParameter("spark.checkpoint.dir isn't set: the executors share no folder")
        folder = tempfile.mkdtemp(prefix="corvane-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame) -> DataFrame:
    """Broadcast if a count shows few rows, and a row of the mean length of the first thousand few bytes."""
    n = df.count()
    if n > BROADCAST_ROWS:
        return df
    fixed = sum(f.dataType.typeName() not in ("string", "binary", "array", "map", "struct") for f in df.schema) * 8
    loose = [f.name for f in df.schema if f.dataType.typeName() in ("string", "binary", "array", "map", "struct")]
    if loose and n > 10_000:
        size = df.limit(1000).agg(F.avg(F.length(F.to_json(F.struct(*loose))))).first()[0] or 0.0
    else:
        size = 64.0 * len(loose)
    return F.broadcast(df) if n * (fixed + size) <= BROADCAST_BYTES else df
