"""Steps whose tasks must stay small as their input grows."""

import random
import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lorestone.functions import scores
from lorestone.operators import enrich, facts, graph, similar, versioned
from lorestone.plans.queries import ORACLES, QUERIES
from lorestone.plans.views import Views, sql
from lorestone.scratch import materialise
from lorestone.sources import ranged


@pytest.mark.parametrize("read", [(1, 8, None), (0, 1, None), (0, 0, None), (None,)])
def test_levels_read_on_where_they_must(spark, monkeypatch, read):
    """A walk takes the least unseen nodes of a level, by their least paths, however far its neighbours were read at first."""
    monkeypatch.setattr(graph, "READ", read)
    r = random.Random(len(read))
    pairs = sorted({(f"a{r.randint(0, 9)}", f"b{r.randint(0, 60):02d}") for _ in range(260)} | {(f"b{i:02d}", f"c{i * 7 % 90:02d}") for i in range(60)})
    edges = spark.createDataFrame(pairs, "src_id string, dst_id string")
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for most in (5, 30):
        start = spark.createDataFrame([(1, "a1"), (2, "a2"), (2, "b05"), (3, "nobody")], "query_id long, node string")
        want = []
        for q, begin in ((1, ["a1"]), (2, ["a2", "b05"])):
            seen, level, n = set(begin), [[b] for b in sorted(begin)], 0
            for depth in (1, 2, 3):
                new = {}
                for path in sorted(level):
                    for other in near.get(path[-1], ()):
                        if other not in seen:
                            new.setdefault(other, [*path, other])
                level = [new[k] for k in sorted(new)][: most - n]
                n, seen = n + len(level), seen | {p[-1] for p in level}
                want += [(q, p[-1], depth, p) for p in level]
                if n >= most:
                    break
        got = graph.walk(edges.withColumn("relation", F.lit("r")), start, 3, most=most)
        assert sorted(tuple(x) for x in got.select("query_id", "node", "depth", "path").collect()) == sorted(want)


def test_walks_from_one_node_exchange_no_neighbours(spark, monkeypatch):
    """The first level of walks from one node each is read off their links: no list is taken apart, and no window counts."""
    made = {}
    monkeypatch.setattr(graph, "materialise", lambda df, name: made.setdefault(name, []).append(df) or materialise(df, name))
    edges = spark.range(600).select(F.format_string("h%d", F.col("id") % 5).alias("src_id"), F.format_string("n%03d", F.expr("id div 5")).alias("dst_id"), F.lit("r").alias("relation"))
    edges = edges.unionByName(spark.createDataFrame([("h0", "h0", "r"), ("h0", "h1", "r")], edges.schema))
    start = spark.createDataFrame([(q, f"h{q}") for q in range(5)] + [(7, None), (8, "nobody")], "query_id long, node string")
    got = sorted((r["query_id"], r["node"], r["depth"], r["path"]) for r in graph.walk(edges, start, 1, most=30).collect())
    near = {q: [f"n{i:03d}" for i in range(120)] for q in range(5)}
    near[0], near[1] = ["h1", *near[0]], ["h0", *near[1]]
    assert got == sorted((q, n, 1, [f"h{q}", n]) for q in range(5) for n in near[q][:30])
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in made["walk-level"]]
    assert len(plans) == 1 and "Window" not in plans[0] and "explode" not in plans[0]


def test_a_level_reads_the_first_neighbours(spark):
    """Of twelve hubs of 400 nodes each a walk that lacks 88 reads 24 at most: its level isn't open after that."""
    links = graph.neighbours(spark.range(4800).select(F.format_string("h%02d", F.col("id") % 12).alias("src_id"), F.format_string("n%04d", "id").alias("dst_id")), 201)
    hubs = [f"h{i:02d}" for i in range(12)]
    level = spark.createDataFrame([(1, 88, ["s", *hubs], [["s", h] for h in hubs])], "query_id long, left int, seen array<string>, paths array<array<string>>").withColumn("bound", F.lit(None).cast("string"))
    row = graph._expand(level, links, 100, 1).first()
    assert (row["left"], row["open"], sorted(p[-1] for p in row["paths"])) == (0, False, [f"n{i:04d}" for i in range(88)])


def test_requests_are_dealt_and_normalised_once(spark):
    """Requests of one file go to several tasks before their keys are normalised, and each key is so once."""
    k = F.col("id").cast("string")
    asked = spark.range(300, numPartitions=1).select(F.col("id").alias("query_id"), F.lit("a").alias("caller"), F.concat(F.lit(" H"), k, F.lit(".Test. ")).alias("key"), F.when(F.col("id") % 3 == 0, "ioc_ip").alias("type"))
    known = spark.range(300).select(F.concat(F.lit("e"), k).alias("entity_id"), F.lit("a").alias("scope"), F.lit("ioc_domain").alias("entity_type"), F.concat(F.lit("h"), k, F.lit(".test")).alias("key"), F.lit(0).alias("updated_at"))
    for got, node in ((graph.starts(asked, known), "node"), (enrich.siblings(asked, known), "entity_id")):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("[Tt][0-9]{4}") == 1
        assert "hashpartitioning(query_id" in plan[plan.index("ArrowEvalPython") :].split("Scan")[0].split("Range")[0]
        assert {(r["query_id"], r[node]) for r in got.collect()} == {(i, f"e{i}") for i in range(300) if i % 3}


def test_ways_are_told_once(spark):
    """Paths have the keys of all their nodes, and what leads to several last nodes is looked up once; where a node in
    the middle or at the end isn't known, the path goes."""
    rows = [(q, f"n{i}", 3, ["s", f"m{i % 4}", f"o{i % 4}", f"n{i}"]) for q in (1, 2) for i in range(400)] + [(1, f"m{i}", 1, ["s", f"m{i}"]) for i in range(4)]
    paths = materialise(spark.createDataFrame(rows, "query_id long, node string, depth int, path array<string>"), "paths")
    names = ["s", "m0", "m1", "m2", "o0", "o1", "o3", *(f"n{i}" for i in range(400) if i % 5)]
    got = graph.hydrate_paths(paths, spark.createDataFrame([(n, f"k-{n}", "a") for n in names], "entity_id string, key string, scope string"))
    want = [(*r, [f"k-{n}" for n in r[3]], ["a"] * len(r[3])) for r in rows if set(r[3]) <= set(names)]
    found = got.collect()
    assert sorted(tuple(r) for r in found) == sorted(want) and len(want) == 323
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Generate posexplode") :]


def test_audits_round_as_c_does(spark):
    rows = spark.createDataFrame([(0.125,), (0.375,), (0.625,), (0.875,), (0.005,), (0.12,), (1.0,)], "c float")
    assert [r[0] for r in rows.select(F.format_string("%.2f", scores.two_decimals(F.col("c")))).collect()] == ["0.12", "0.38", "0.62", "0.88", "0.00", "0.12", "1.00"]


def test_confidence_is_rounded_as_duckdb_does(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"COPY (SELECT i AS o_orderkey, i AS o_custkey, 'P' AS o_orderstatus, CASE i WHEN 0 THEN 62500.25 WHEN 1 THEN 252500.25 WHEN 2 THEN 62500.0 ELSE i / 4.0 END::DOUBLE AS o_totalprice, TIMESTAMP '1996-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(4000) t(i)) TO '{tmp_path}/orders.parquet'")
    con.sql(f"CREATE VIEW orders AS FROM '{tmp_path}/orders.parquet'")
    got = [tuple(r) for r in Views(spark, str(tmp_path)).facts().select("fact_id", "confidence").orderBy("fact_id").collect()]
    assert got == con.sql(sql("SELECT fact_id, confidence FROM facts ORDER BY 1")).fetchall()
    audit = sorted(tuple(r) for r in QUERIES["promote_audit"](spark, str(tmp_path)).collect())
    assert audit == sorted(con.sql(ORACLES["promote_audit"]).fetchall())


def test_what_follows_is_added_up_as_it_goes(spark):
    """A frame to the last row is added up anew for each row, so its time grows with the square of a group."""
    rows = spark.range(1000).select(F.lit("a").alias("scope"), F.lit("b").alias("subject_id"), F.lit("c").alias("predicate"), F.format_string("%05d", "id").alias("fact_id"), F.lit("active").alias("status"), (F.col("id") % 7 == 0).alias("closes"), F.timestamp_seconds(F.col("id")).alias("valid_from"), F.lit("2100-01-01").cast("timestamp").alias("valid_to"))
    for got in (facts.supersede(rows), facts.supersede_split(rows, 100)):
        assert "unboundedfollowing" not in got._jdf.queryExecution().executedPlan().toString().lower()
        ends = {r["fact_id"]: r["s"] for r in got.select("fact_id", F.unix_seconds("valid_to").alias("s")).collect()}
        assert all(ends[f"{i:05d}"] == (i // 7 + 1) * 7 for i in range(994)) and len(ends) == 1000


def test_small_ranges_of_groups_are_few(spark, monkeypatch):
    made = {}
    monkeypatch.setattr(facts, "materialise", lambda df, name: made.setdefault(name, materialise(df, name)))
    monkeypatch.setattr(facts, "RANGES", 6, raising=False)
    rows = spark.range(500).select(F.lit("a").alias("scope"), F.lit("b").alias("subject_id"), F.lit("c").alias("predicate"), F.format_string("%05d", "id").alias("fact_id"), F.lit("active").alias("status"), F.lit(True).alias("closes"), F.timestamp_seconds(F.col("id")).alias("valid_from"), F.lit("2100-01-01").cast("timestamp").alias("valid_to"))
    got = facts.supersede_split(rows, 10)
    assert sorted(r[0] for r in got.select(F.unix_seconds("valid_to")).collect())[:499] == list(range(1, 500))
    assert made["group-ranges"].select("_range").distinct().count() <= 6


def test_ranges_hold_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranged, "PART_ROWS", 50, raising=False)
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), "id")
    table = ranged.RangedTable(spark, str(tmp_path / "t"), ["k"])
    table.write(rows.where("k % 2 = 0"), 0, 3)
    table.write(rows.where("k % 2 = 1"), 1, 3)
    n = [r["count"] for r in table.read().groupBy("part").count().collect()]
    assert len(n) >= 9 and sum(n) == 1000 and max(n) < 200
    lows = [p.low[0] for p in table.ranges()]
    for r in table.read().where("batch = 1").collect():
        assert r["part"] == max([i for i, low in enumerate(lows) if low <= r["k"]], default=0)
    files = table.read().groupBy(F.input_file_name()).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert files < 150
    assert [r["k"] for r in table.page((499,), 30).collect()] == list(range(500, 530))


def test_large_pages_are_not_brought_to_one_task(spark, monkeypatch):
    monkeypatch.setattr(versioned, "TOP_ROWS", 40, raising=False)
    rows = spark.range(1000).select((F.col("id") * 7919 % 100).alias("ts"), F.col("id").alias("tie"))
    got = versioned.keyset_page(rows, "ts", "tie", F.lit(10), F.lit(500), 300)
    want = sorted((r["ts"], r["tie"]) for r in rows.collect())
    want = [x for x in want if x > (10, 500)][:300]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert "limit=300" not in got._jdf.queryExecution().executedPlan().toString()
    page = spark.range(100).select(F.col("id").alias("updated_at"), F.col("id").cast("string").alias("edge_id"), F.when(F.col("id").isin(60, 80), "deferrable").otherwise("resolved").alias("outcome"))
    done = graph.projectable(page)
    assert done.count() == 60 and "Window" not in done._jdf.queryExecution().executedPlan().toString()


def test_nearest_rows_take_bounded_memory():
    """Of 8,192 questions to as many equal rows and others, a task measures a number a pair, and no pair's vectors."""
    r = np.random.default_rng(5)
    n, dim = 4096, 64
    x = np.where(r.random((n, 1)) < 0.3, 1.0, r.normal(size=(n, dim)))
    q = np.concatenate([np.ones((1000, dim)), r.normal(size=(3000, dim))])
    ids = np.array([f"o{i:05d}" for i in r.permutation(n)], object)
    scopes, opens = np.array(["a"] * n, object), r.random(n) < 0.9
    tracemalloc.start()
    near = similar._Nearest(list(range(len(q))), ["b"] * len(q), q, 20)
    for i in range(0, n, 1024):
        near.see(x[i : i + 1024], ids[i : i + 1024], scopes[i : i + 1024], opens[i : i + 1024])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20
    for k in (0, 999, 1000, 2500, 3999):
        dots = lambda a, b: np.cumsum(a * b, axis=-1)[..., -1]
        far = 1 - dots(x, q[k]) / (np.sqrt(dots(x, x)) * np.sqrt(dots(q[k], q[k])))
        want = sorted((far[i], ids[i]) for i in range(n) if opens[i])[:20]
        assert [(f, i) for f, i in zip(near.far[k], near.ids[k])] == want
