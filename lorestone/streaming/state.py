"""What stateful streams need of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def needs_rocksdb(spark: SparkSession) -> None:
    """State with timers and a time to live is kept by RocksDB alone. A session that has Spark's own provider gets it; one
    with another keeps that, and its query fails to start."""
    if (spark.conf.get(PROVIDER, None) or "HDFSBackedStateStoreProvider").endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKS)
