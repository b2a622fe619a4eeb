"""The projection as a stream: edges wait in state for both of their ends, and a batch that runs again changes nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.graph import last_events, vertices
from ..operators.versioned import open_at
from ..sources.schemas import EDGES
from .state import needs_rocksdb

#: How long an edge waits for an end before it counts as an orphan, and shards of one node's edges.
PATIENCE_MS, SHARDS = 3_600_000, 8
#: Arrival is told by batch, so nothing is later than the batch before it.
DELAY = "1 second"
_TIMES = ("valid_from", "valid_to", "updated_at")


def _schema() -> T.StructType:
    return EDGES if isinstance(EDGES, T.StructType) else T._parse_datatype_string(EDGES)


def _plain(edges: DataFrame) -> DataFrame:
    """Edges with times as microseconds, which state keeps as they are."""
    return edges.select(*[F.unix_micros(F.col(c).cast("timestamp")).alias(c) if c in _TIMES else F.col(c) for c in _schema().names])


def _timed(edges: DataFrame) -> DataFrame:
    return edges.withColumns({c: F.timestamp_micros(F.col(c)) for c in _TIMES})


def _kept() -> str:
    return ", ".join(f"{f.name} {'long' if f.name in _TIMES else f.dataType.simpleString()}" for f in _schema().fields)


class _Wait(StatefulProcessor):
    """Edges of one end: they pass once the node has come, and wait until then. When patience ends they leave as orphans;
    should the node come later, it is known from then on."""

    def __init__(self, patience_ms: int, names: list[str], kept: str):
        self.patience_ms, self.names, self.kept = patience_ms, names, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "known boolean")
        self.waiting = handle.getListState("waiting", self.kept)

    def _leave(self, outcome: str, arrived: pd.Timestamp) -> pd.DataFrame:
        rows = pd.DataFrame(list(self.waiting.get()), columns=self.names)
        self.waiting.clear()
        return self._told(rows, outcome, arrived)

    def _told(self, rows: pd.DataFrame, outcome, arrived, node=None, shard: int = 0) -> pd.DataFrame:
        return rows.assign(outcome=outcome, node=node, shard=shard, arrived=arrived)[[*self.names, "outcome", "node", "shard", "arrived"]]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, waits, arrived = self.known.exists(), False, None
        for frame in rows:
            arrived = frame["arrived"].max()
            nodes = frame[frame["edge_id"].isna()]
            if len(nodes):
                if not known:
                    self.known.update((True,))
                    known = True
                # It goes on to where edges wait for it as their other end.
                yield self._told(nodes.astype(dict.fromkeys(_TIMES, "float64")), None, nodes["arrived"], key[0], key[1])
            # Beside rows of nodes, which have none, numbers came as floats that hold microseconds exactly.
            edges = frame[frame["edge_id"].notna()].astype(dict.fromkeys(_TIMES, "int64"))
            gone = edges["outcome"] == "orphan"
            if gone.any():
                yield self._told(edges[gone], "orphan", edges["arrived"][gone])
            edges = edges[~gone]
            if known and len(edges):
                yield self._told(edges, "resolved", edges["arrived"])
            elif len(edges):
                self.waiting.appendList([tuple(x.item() if hasattr(x, "item") else x for x in row) for row in edges[self.names].itertuples(index=False)])
                waits = True
        if known and self.waiting.exists():
            yield self._leave("resolved", arrived)
        elif waits:
            self.handle.registerTimer(int(arrived.timestamp() * 1000) + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            yield self._leave("orphan", pd.Timestamp(timerValues.getCurrentWatermarkInMs() + 1, unit="ms"))

    def close(self) -> None:
        pass


def resolved_edges(nodes: DataFrame, edges: DataFrame, patience_ms: int = PATIENCE_MS, shards: int = SHARDS) -> DataFrame:
    """edges with `outcome`, as soon as both ends are among the nodes (ch_id): resolved, or orphan if one hasn't come within
    `patience_ms` of the edge's own arrival. Both are streams, in any order.

    An edge waits at its source, then at its destination, in state that only waiting edges and known nodes take. Time is
    that of arrival, which a batch that runs again has too, so patience ends only as more arrives. Edges of one node are
    dealt over shards, each of which hears of the node, so a node of very many edges isn't one task's. In a batch, edges
    of a node may come in any order: the last event of a pair counts by its own time. Edges without an id or an end are
    left out. The driver's Python must find this package, as the executors' must."""
    needs_rocksdb(nodes.sparkSession)
    names, out = _schema().names, f"{_kept()}, outcome string, node string, shard int, arrived timestamp"
    heard = nodes.where("ch_id is not null").select(F.col("ch_id").alias("node"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    whole = _plain(edges).where("edge_id is not null and src_id is not null and dst_id is not null")
    # One watermark for both streams, so that either moves it; nodes pass the first end on their way to the second.
    both = heard.unionByName(whole, allowMissingColumns=True).withColumn("outcome", F.lit(None).cast("string"))
    both = both.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", DELAY)
    for end in ("src_id", "dst_id"):
        shard = F.when(F.col("node").isNotNull(), F.col("shard")).otherwise(F.pmod(F.hash("edge_id"), F.lit(shards))).alias("part")
        keyed = both.select(F.coalesce("node", end).alias("key"), shard, *names, "outcome", "arrived")
        both = keyed.groupBy("key", "part").transformWithStateInPandas(_Wait(patience_ms, names, _kept()), out, "append", "eventTime", eventTimeColumnName="arrived")
    return _timed(both.where("node is null")).select(*names, "outcome")


class GraphLog:
    """What was projected, as logs under a path: each micro-batch is a folder by its number. Writing one again replaces it,
    so a batch that was cut off, or runs again after a restart, leaves the same rows; `last_events` tells the state."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def writer(self, log: str):
        """For foreachBatch: rows of a batch go to the log."""
        return lambda rows, batch: rows.write.mode("overwrite").parquet(f"{self.path}/{log}/batch={batch}")

    def read(self, log: str, schema) -> DataFrame:
        schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{log}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{log}").select(*schema.names)

    def edges(self, as_of: Column) -> DataFrame:
        """The open last event of each pair."""
        return last_events(self.read("edges", EDGES)).where(open_at(as_of))

    def nodes(self, schema) -> DataFrame:
        """The vertices of the newest versions of all entities that came."""
        return vertices(self.read("entities", schema))

    def fold(self, log: str, schema, latest_rows) -> None:
        """Replace all batches of a log but the newest, which may run again, by what latest_rows keeps of their rows.

        The fold is written beside them, under a number below all, then the folders that it stands for go. Whatever is
        there twice in between counts once, since only newest rows count."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(fs_path(f"{self.path}/{log}")) if "=" in s.getPath().getName())
        old = found[:-1]
        if len(old) < 2:
            return
        schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{log}/batch={b}" for b in old]).select(*schema.names)
        latest_rows(rows).write.mode("overwrite").parquet(f"{self.path}/{log}/batch={min(found[0], 0) - 1}")
        for b in old:
            fs.delete(fs_path(f"{self.path}/{log}/batch={b}"), True)
