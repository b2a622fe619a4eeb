"""Micro-batches on Structured Streaming: graph projection, fact extraction and rate limits."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.proposals import parse_proposals, sanitize_proposals
from .state import needs_rocksdb

BATCH, RATE = 32, 5.0
#: Agents whose budgets are remembered, by a process or by all slots of a stream; slots; and how long an idle one is, a
#: minute, where one second fills a bucket.
AGENTS, SLOTS, TTL_MS = 10_000, 40, 60_000


def uncovered_batch(observations: DataFrame, covered: DataFrame, size: int = BATCH) -> DataFrame:
    """The oldest observations that weren't looked at yet; repeated rows count before they collapse."""
    left = observations.join(covered.select("obs_id").distinct(), "obs_id", "left_anti")
    return left.orderBy("ts", "obs_id").limit(size).dropDuplicates(["obs_id"])


def extract(batch: DataFrame, model: Callable[[list[str]], list[str | None]]) -> tuple[DataFrame, DataFrame]:
    """(proposals, covered): what a model says of each content, parsed and cleaned. Rows on which it fails are covered too."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["obs_id", "scope"]].assign(said=model(b["content"].tolist()))

    said = batch.select("obs_id", "scope", "content").mapInPandas(ask, "obs_id string, scope string, said string")
    items = said.select("obs_id", "scope", F.explode(sanitize_proposals(parse_proposals(F.col("said")))).alias("p"))
    return items.select("obs_id", "scope", "p.*"), batch.select("obs_id")


def run_projection(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Apply each micro-batch of entity or edge versions once they arrive; the checkpoint is the cursor, so a restart goes
    on where the last batch was committed, and a batch that runs again must give the same.

    There is no event time: a version that arrives below the cursor of a paged projection isn't seen until its row's next
    touch, or the next rebuild, which looks at every row."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class Budget:
    """Token buckets of agents in one process, with a burst of one second's rate. Humans have none. Beyond `most` agents
    the one heard from longest ago is forgotten, so that made-up names cost no memory."""

    def __init__(self, rate: float = RATE, most: int = AGENTS):
        self.rate = rate if rate > 0 and not math.isnan(rate) else RATE
        self.most, self.levels = most, OrderedDict()

    def wait(self, actor_type: str, actor_id: str, now: float) -> float:
        """Seconds until the actor may write; 0 if it may now, which this call then counts."""
        return spend(self.levels, self.rate, self.most, actor_type, actor_id, now)


def spend(levels: OrderedDict, rate: float, most: int, actor_type: str, actor_id: str, now: float) -> float:
    """Seconds until an actor may write, by levels (actor: level, time) of `most` agents at most, oldest first."""
    if actor_type != "agent":
        return 0.0
    if actor_id not in levels and len(levels) >= most:
        levels.popitem(last=False)
    level, last = levels.get(actor_id, (rate, now))
    level = min(rate, level + max(0.0, now - last) * rate)
    allowed = level >= 1
    levels[actor_id] = (level - allowed, now)
    levels.move_to_end(actor_id)
    return 0.0 if allowed else (1 - level) / rate


class _Buckets(StatefulProcessor):
    """Token buckets of the agents of a slot: at most `most`, of which a new agent takes the place of that heard from
    longest ago. One that isn't used for `ttl_ms` leaves by a timer; by then it is full, as a new one is."""

    def __init__(self, rate: float, most: int, ttl_ms: int):
        self.rate, self.most, self.ttl_ms = rate, most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buckets = handle.getMapState("buckets", "actor_id string", "level double, last double, seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: tuple(v) for k, v in self.buckets.iterator()}
        levels = OrderedDict((k, v[:2]) for k, v in sorted(held.items(), key=lambda e: e[1][1]))
        touched, seen = set(), 0
        for frame in rows:
            seen = int(frame["arrived"].max().timestamp() * 1000)
            frame = frame.sort_values("ts")
            allowed = []
            for kind, actor, ts in zip(frame["actor_type"], frame["actor_id"], frame["ts"]):
                allowed.append(spend(levels, self.rate, self.most, kind, actor, ts.timestamp()) == 0)
                touched.add(actor)
            yield frame[["actor_id", "ts"]].assign(allowed=allowed)
        for actor in set(held) - set(levels):
            self.buckets.removeKey((actor,))
        for actor in touched & set(levels):
            self.buckets.updateValue((actor,), (*map(float, levels[actor]), seen))
        if levels and not held:
            self.handle.registerTimer(seen + self.ttl_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, left = expiredTimerInfo.getExpiryTimeInMs(), []
        for actor, bucket in list(self.buckets.iterator()):
            if bucket[2] + self.ttl_ms <= now:
                self.buckets.removeKey(actor)
            else:
                left.append(bucket[2])
        if left:
            self.handle.registerTimer(min(left) + self.ttl_ms)
        return iter(())

    def close(self) -> None:
        pass


def rate_limited(writes: DataFrame, rate: float = RATE, most: int = AGENTS, slots: int = SLOTS, ttl_ms: int = TTL_MS) -> DataFrame:
    """(actor_id, ts, allowed) of a stream of writes (actor_id, actor_type, ts) in a token bucket for each agent, with a
    burst of one second's rate; humans always pass and take no state.

    Agents are dealt by name to slots, which hold `most` buckets together: made-up names push out the oldest, and never
    make one that is new wait. Buckets that no write has touched for ttl_ms leave, by the time of arrival, as more
    arrives. Within a batch a slot's writes are taken by their times, as far as one Arrow batch holds them. The driver's
    Python must find this package, as the executors' must."""
    needs_rocksdb(writes.sparkSession)
    rate = rate if rate > 0 and not math.isnan(rate) else RATE
    slot = F.when(F.col("actor_type") == "agent", F.pmod(F.hash("actor_id"), F.lit(slots))).otherwise(F.pmod(F.hash("actor_id", "ts"), F.lit(slots)))
    dealt = writes.select("actor_id", "actor_type", "ts", slot.alias("slot"), F.current_timestamp().alias("arrived")).withWatermark("arrived", "1 second")
    return dealt.groupBy("slot").transformWithStateInPandas(_Buckets(rate, max(1, most // slots), ttl_ms), "actor_id string, ts timestamp, allowed boolean", "append", "eventTime")
