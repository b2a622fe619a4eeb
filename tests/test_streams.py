"""Streams with state: edges that wait for their ends, batches that run again, budgets that end, and coverage by a mark."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lorestone.operators import facts, graph
from lorestone.sources import schemas
from lorestone.streaming import pipelines
from lorestone.streaming.coverage import Coverage
from lorestone.streaming.projection import GraphLog, resolved_edges

FOREVER = datetime(2105, 12, 31, 23, 59, 59)
T0 = datetime(2024, 1, 1)


def now():
    return F.lit("2024-06-01").cast("timestamp")


def at(m):
    return T0 + timedelta(minutes=m)


def entity(i, m=0):
    return (f"n{i}", "a", "ioc_domain", f"n{i}.test", f"n{i}", {}, at(m), at(m), at(m))


def edge(r, k, n):
    start = r.randint(0, 500)
    end = FOREVER if r.random() < 0.7 else at(start + r.randint(1, 50))
    return (f"e{k:04d}", "a", f"n{r.randint(0, n)}", f"n{r.randint(0, n)}", r.choice(["x", "y"]), "f", at(start), end, at(start) if end == FOREVER else end)


def plain(df):
    return sorted(map(tuple, df.select("src_id", "dst_id", "relation", "edge_id").collect()))


class Feed:
    """Folders of Parquet that streams read, one file a step."""

    def __init__(self, spark, root):
        self.spark, self.root, self.steps = spark, root, 0

    def put(self, name, rows, schema):
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def stream(self, name, schema):
        return self.spark.readStream.schema(schema).parquet(f"{self.root}/{name}")


def test_edges_wait_for_their_ends(spark, tmp_path):
    """Ends come after their edges, over several batches and restarts: the graph is that of a rebuild."""
    r = random.Random(2)
    feed, log = Feed(spark, tmp_path / "in"), GraphLog(spark, str(tmp_path / "graph"))
    edges = [edge(r, k, 12) for k in range(150)]
    edges += [(f"z{k}", *e[1:]) for k, e in enumerate(edges[:10])]
    entities, waves = [], [(edges[:60], []), ([], range(0, 5)), (edges[60:110], range(5, 6)), ([], range(6, 11)), (edges[110:], [])]
    for some, ids in waves:
        new = [entity(i) for i in ids]
        entities += new
        feed.put("edges", some, schemas.EDGES)
        feed.put("entities", new, schemas.ENTITIES)
        nodes = feed.stream("entities", schemas.ENTITIES).select(F.col("entity_id").alias("ch_id"))
        out = resolved_edges(nodes, feed.stream("edges", schemas.EDGES), shards=3)
        q = out.where("outcome = 'resolved'").drop("outcome").writeStream.foreachBatch(log.writer("edges")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    want = graph.rebuild(spark.createDataFrame(entities, schemas.ENTITIES), spark.createDataFrame(edges, schemas.EDGES), now())
    assert plain(log.edges(now())) == plain(want.edges) and len(plain(want.edges)) > 30
    log.fold("edges", schemas.EDGES, graph.last_events)
    assert plain(log.edges(now())) == plain(want.edges)


def test_edges_without_an_end_leave_as_orphans(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in")
    feed.put("entities", [entity(1), entity(2)], schemas.ENTITIES)
    row = lambda i, s, d: (i, "a", s, d, "x", "f", at(1), FOREVER, at(1))
    feed.put("edges", [row("ok", "n1", "n2"), row("late", "n3", "n1"), row("ghost", "n1", "n9"), row("no end", "n1", None)], schemas.EDGES)

    def step():
        nodes = feed.stream("entities", schemas.ENTITIES).select(F.col("entity_id").alias("ch_id"))
        out = resolved_edges(nodes, feed.stream("edges", schemas.EDGES), patience_ms=1, shards=2)
        q = out.select("edge_id", "outcome").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    step()
    feed.put("entities", [entity(3)], schemas.ENTITIES)
    step()
    feed.put("edges", [row("after", "n3", "n1")], schemas.EDGES)
    step()
    got = {r["edge_id"]: r["outcome"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["ok"] == "resolved" and got["ghost"] == "orphan" and got["after"] == "resolved" and "no end" not in got
    # Its end came with the batch that ended patience, and a batch's rows come first.
    assert got["late"] == "resolved"


def test_a_batch_that_is_cut_off_runs_again(spark, tmp_path):
    r = random.Random(5)
    feed, log = Feed(spark, tmp_path / "in"), GraphLog(spark, str(tmp_path / "graph"))
    entities, edges, died = [entity(i) for i in range(13)], [], []

    def dies_after_writing(rows, batch):
        log.writer("edges")(rows, batch)
        if batch == 1 and not died:
            died.append(batch)
            raise RuntimeError("killed")

    feed.put("entities", entities, schemas.ENTITIES)
    for wave in range(3):
        new = [edge(r, wave * 40 + k, 12) for k in range(40)]
        edges += new
        feed.put("edges", new, schemas.EDGES)
        for _ in range(2):
            nodes = feed.stream("entities", schemas.ENTITIES).select(F.col("entity_id").alias("ch_id"))
            out = resolved_edges(nodes, feed.stream("edges", schemas.EDGES), shards=2).where("outcome = 'resolved'").drop("outcome")
            q = out.writeStream.foreachBatch(dies_after_writing).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            try:
                q.awaitTermination()
                break
            except Exception:  # noqa: BLE001
                assert died
    assert died == [1]
    assert log.read("edges", schemas.EDGES).groupBy("edge_id").count().where("count > 1").count() == 0
    want = graph.rebuild(spark.createDataFrame(entities, schemas.ENTITIES), spark.createDataFrame(edges, schemas.EDGES), now())
    assert plain(log.edges(now())) == plain(want.edges)
    q = feed.stream("entities", schemas.ENTITIES).writeStream.foreachBatch(log.writer("entities")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert log.nodes(schemas.ENTITIES).count() == 13


def test_budgets_are_bounded(spark, tmp_path):
    """Made-up agents push out the oldest, are never refused, and one that comes again has a fresh budget."""
    feed = Feed(spark, tmp_path / "in")
    schema = "actor_id string, actor_type string, ts timestamp"

    def run(rows):
        feed.put("w", rows, schema)
        out = pipelines.rate_limited(feed.stream("w", schema), 2, most=8, slots=2)
        got = []
        q = out.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        return [r["allowed"] for r in got]

    second = lambda k: T0 + timedelta(milliseconds=k)
    assert sorted(run([("busy", "agent", second(0))] * 3)) == [False, True, True]
    assert sorted(run([("busy", "agent", second(1))] + [("h", "human", second(1))] * 9)) == [False] + [True] * 9
    assert all(run([(f"flood-{i}", "agent", second(10 + i)) for i in range(200)]))
    # Pushed out by the flood: its budget is full again.
    assert sorted(run([("busy", "agent", second(220))] * 3)) == [False, True, True]
    state = spark.read.format("statestore").option("stateVarName", "buckets").load(str(tmp_path / "c"))
    assert 1 <= state.count() <= 8


def test_supersede_in_ranges(spark):
    r = random.Random(3)
    rows = []
    for i in range(900):
        group = ("a", "hot", "p") if i % 3 else ("a", r.choice(["s1", "s2", None]), "p")
        start = at(r.randint(0, 60))
        rows.append((f"f{i:05d}", *group, "v", None, r.choice(["active", "active", "proposed"]), 0.5, "o", "w", start, r.choice([FOREVER, start + timedelta(minutes=3)]), start, "org", r.random() < 0.4))
    rows += [(f"g{i:05d}", "a", "quiet", "p", "v", None, "active", 0.5, "o", "w", at(i), FOREVER, at(i), "org", i == 5) for i in range(300)]
    df = spark.createDataFrame(rows, schemas.FACTS + ", closes boolean").repartition(4)
    want = sorted(map(tuple, facts.supersede(df).select("fact_id", "valid_to").collect()))
    for most in (10_000, 100, 7):
        got = facts.supersede_split(df, most)
        assert got.columns == df.columns
        assert sorted(map(tuple, got.select("fact_id", "valid_to").collect())) == want


def test_coverage_by_a_mark(spark, tmp_path):
    r = random.Random(6)
    schema = "obs_id string, ts timestamp, content string"
    coverage, every, seen, number = Coverage(spark, str(tmp_path / "c")), [], [], 0
    some = lambda n, lo, hi: [(f"o{r.randint(0, 10**6):06d}", at(r.randint(lo, hi)), "x") for _ in range(n)]

    def drain(times):
        nonlocal number
        for _ in range(times):
            rows = coverage.next(10)
            ids = [x["obs_id"] for x in rows.collect()]
            seen.extend(ids)
            coverage.cover(rows, number)
            if number == 2:
                coverage.cover(rows, number)
            number += 1
        return ids

    first = some(40, 0, 50)
    coverage.add(spark.createDataFrame(first, schema), 0, 3)
    drain(2)
    assert seen == [] or set(seen) == {x[0] for x in sorted(first, key=lambda x: (x[1], x[0]))[:20]}
    # Rows that come late, rows beyond, a repeated row and an id that was covered with a new time; the batch runs twice.
    again = [(seen[0], at(99), "again"), first[-1]]
    second = some(15, 0, 10) + some(15, 60, 90) + again
    for _ in range(2):
        coverage.add(spark.createDataFrame(second, schema), 1, 3)
    while drain(1):
        pass
    assert sorted(seen) == sorted({x[0] for x in first + second})
    plan = coverage.log.page(coverage.mark(), 10)._jdf.queryExecution().executedPlan().toString()
    assert "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
