"""Scratch tables in the folder that driver and executors share: what is computed once and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of known width is sent to every executor, once it was counted.
BROADCAST_ROWS = 50_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, by the application's id. Where no folder is set, a temporary one will do on
    a single machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="lorestone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lorestone/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: it is computed once, and later reads survive lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._scratch)


def sweep(spark: SparkSession) -> None:
    """Delete all tables that this application has materialised, once their results are written elsewhere."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        _delete(spark, f"{root.rstrip('/')}/lorestone/{spark.sparkContext.applicationId}")


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, for a join: sent to every executor if its rows, of bounded width, are `most` at most."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
