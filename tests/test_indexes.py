"""Many questions at once, and the tables that answer them: ranges by token or time, buckets by entity."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lorestone.operators import enrich, postings, similar
from lorestone.sources.ranged import RangedTable
from lorestone.sources.schemas import NIL

WORDS = ["beacon", "quiet", "São", "host", "alpha", "the", "The", "42", "x9", "unseen"]
OBS = "obs_id string, scope string, ts timestamp, kind string, confidentiality string, content string, content_vec array<float>, entity_refs array<string>"


def made(seed, n=160):
    r = random.Random(seed)
    some = [[float(r.randint(-3, 3)) for _ in range(3)] for _ in range(12)] + [[0.0] * 3, None, [1.0, 2.0], []]
    rows = []
    for i in range(n):
        content = None if i % 19 == 0 else r.choice([" ", "-", "\n", "/"]).join(r.choices(WORDS[:-1], k=r.randint(0, 6)))
        at = datetime(2024, 1, 1) + timedelta(minutes=r.randint(0, 60))
        rows.append((f"o{r.randint(0, n - 20):04d}", r.choice(["a", "b", "c"]), at, "alert", r.choice(["internal", "restricted"]), content, r.choice(some), r.choice([[], None, ["e1", "e1"], ["e1", NIL, "e2"], [None, "e3"]])))
    return rows + rows[:5]


@pytest.fixture(scope="module")
def obs(spark):
    return spark.createDataFrame(made(4), OBS).repartition(3)


def requests(spark, n=40):
    r = random.Random(7)
    rows = []
    for i in range(n):
        q = " ".join(r.choices(WORDS, k=r.randint(1, 12))) if i % 7 else "探索"
        vec = [float(r.randint(-3, 3)) for _ in range(3)] if i % 5 else None
        rows.append((i, r.choice(["a", "b", "z"]), q, [0.0] * 3 if i == 11 else [2.0, 1.0] if i == 12 else vec, r.randint(1, 50)))
    rows += [(100, "a", "  ", [1.0, 0.0, 0.0], 5), (101, " ", "beacon", None, 5), (102, "a", "beacon", None, 0), (103, "a", "beacon", None, 51), (104, "a", None, None, 5), (105, "a", "beacon", None, None)]
    return rows, spark.createDataFrame(rows, "query_id long, scope string, q string, qvec array<double>, k int")


def shown(rows):
    return [(r["obs_id"], r["score"], r["matched_by"], r["ts"], r["kind"], r["excerpt"], r["entity_ids"], r["origin_scope"]) for r in rows]


@pytest.mark.parametrize("question_bytes,pairs", [(32 << 20, 1 << 21), (200, 64)])
def test_many_questions_are_answered_as_one_at_a_time(spark, obs, monkeypatch, question_bytes, pairs):
    monkeypatch.setattr(similar, "QUESTION_BYTES", question_bytes)
    monkeypatch.setattr(similar, "PAIRS", pairs)
    rows, asked = requests(spark, 40 if pairs > 64 else 12)
    found = {}
    for r in similar.similar_many(obs, asked).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r)
    assert not {i for i in found if i >= 100}
    for i, scope, q, vec, k in rows:
        if i < 100 and (i in (11, 12) or i % 5 == 0 or i % 7 == 0) and (pairs > 64 or i < 6):
            assert shown(found.get(i, [])) == shown(similar.similar(obs, scope, q, vec, k).collect()), (i, q, vec)


def test_a_thousand_equal_vectors(spark):
    """Of rows that are equally near the smallest ids come first, in whichever task they were seen."""
    rows = [(f"o{5000 - i:05d}", "a", datetime(2024, 1, 1), "alert", "internal", None, [0.1, 0.7, 0.3] if i % 5 else [0.9, 0.1, 0.2], []) for i in range(5000)]
    many = spark.createDataFrame(rows, OBS).repartition(7)
    asked = spark.createDataFrame([(1, "b", [0.1, 0.7, 0.3]), (2, "b", [0.9, 0.1, 0.2])], "query_id long, scope string, qvec array<double>")
    got = similar.vector_legs(many, asked, 20).orderBy("query_id", "rank").collect()
    for q in (1, 2):
        ids = sorted(r[0] for r in rows if r[6] == ([0.1, 0.7, 0.3] if q == 1 else [0.9, 0.1, 0.2]))
        assert [r["obs_id"] for r in got if r["query_id"] == q] == ids[:20]


@pytest.mark.parametrize("cell", [1, 1 << 26])
def test_blocks_of_questions_meet_parts_of_rows(spark, monkeypatch, cell):
    """No question passes through the driver, and parts of the rows and blocks of questions change nothing: not for
    closed rows, nor near ties, nor vectors that are odd."""
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toArrow", None)
    for name, value in {"QUESTION_BYTES": 500, "ROW_BYTES": 4000, "SLAB_BYTES": 300, "CELL": cell, "ROWS": 40, "PAIRS": 300}.items():
        monkeypatch.setattr(similar, name, value)
    r = random.Random(11)
    odd = [[0.0] * 3, [float("nan"), 1.0, 0.0], [float("inf"), 1.0, 2.0], [1e200, 1e200, 0.0], [1e-160, 2e-160, 0.0], [1.0, None, 2.0], [1.0, 2.0], [], None]
    vec = lambda: [r.choice([1.0, 2.0, 2.0 + 1e-9, -1.0]) for _ in range(3)]
    rows = [(f"o{i:03d}", r.choice("ab"), datetime(2024, 1, 1), "alert", r.choice(["internal", "restricted", None]), None, odd[i % 9] if i % 7 == 0 else vec(), []) for i in range(400)]
    many = spark.createDataFrame(rows, OBS).repartition(5)
    asks = [(q, r.choice("abz"), vec() if q > 2 else [[1e-3, 2e-3, 0.0], [1e-160, 0.0, 1e-160], [2.0, 1.0]][q]) for q in range(40)]
    asked = spark.createDataFrame(asks, "query_id long, scope string, qvec array<double>")
    got = {}
    for x in similar.vector_legs(many, asked, 20).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append(x["obs_id"])
    tame = many.where("not exists(content_vec, x -> x is null)")
    for q, scope, v in asks[:8]:
        assert got.get(q, []) == [x["obs_id"] for x in similar.vector_leg(tame, scope, v, 20).orderBy("rank").collect()], q


def test_closed_rows_of_others_are_not_joined(spark, obs):
    rows, asked = requests(spark)
    legs = postings.text_legs(postings.token_postings(obs), postings.asked_tokens(asked), 20)
    joins = [x for x in legs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert len(joins) == 1 and "gate" in joins[0] and "token" in joins[0]


def test_one_plan_for_all_questions(spark, obs):
    plans = []
    for n in (5, 40):
        plan = similar.vector_legs(obs, requests(spark, n)[1], 20)._jdf.queryExecution().executedPlan().toString()
        plans.append(plan.count("MapInArrow"))
    # One scan for each length of a question's vector, however many ask.
    assert max(plans) <= 2


def test_token_index_with_deltas(spark, obs, tmp_path):
    index = postings.TokenIndex(spark, str(tmp_path / "tokens"))
    late = F.col("ts") > F.lit("2024-01-01 00:40:00").cast("timestamp")
    index.add(obs.where(~late), 0, 5)
    index.add(obs.where(late), 1, 5)
    index.add(obs.where(late), 1, 5)
    rows, asked = requests(spark)
    with_index = similar.similar_many(obs, asked, index).orderBy("query_id", "rank").collect()
    assert with_index == similar.similar_many(obs, asked).orderBy("query_id", "rank").collect()
    one = spark.createDataFrame([("quiet",)], "token string")
    found = index.of(one)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(token" in plan or "EqualTo(token,quiet)" in plan
    read = {f.split("/rows/")[1] for f in found.inputFiles()}
    kept = {r["f"].split("/rows/")[1] for r in found.select(F.input_file_name().alias("f")).distinct().collect()}
    assert kept < read
    assert found.select("batch", "row").distinct().count() == postings.token_postings(obs).where("token = 'quiet'").count()


def test_more_tokens_than_can_be_named(spark, obs, tmp_path, monkeypatch):
    index = postings.TokenIndex(spark, str(tmp_path / "tokens"))
    index.add(obs, 0, 3)
    want = sorted(map(tuple, index.of(spark.createDataFrame([("the",), ("host",)], "token string")).select("token", "row").collect()))
    monkeypatch.setattr(postings, "ASKED", 1)
    assert sorted(map(tuple, index.of(spark.createDataFrame([("the",), ("host",)], "token string")).select("token", "row").collect())) == want


@pytest.mark.parametrize("hot", [1_000_000, 7])
def test_references_in_buckets(spark, obs, tmp_path, hot):
    index = postings.index_references(obs, "references_under_test", str(tmp_path / "refs"), 4, hot)
    ids = spark.createDataFrame([(q, c, i) for q, c in ((1, "a"), (2, "b"), (3, "z")) for i in ("e1", "e2", "e3", "none")[q - 1 :]] + [(4, "a", NIL)], "query_id long, caller string, id string")
    told = lambda df: sorted(((r["query_id"], r["rank"], r["ts"], r["id"], r["origin_scope"]) for r in df.collect()), key=repr)
    got = postings.observations_by_reference(ids, index)
    ours, theirs = told(got), told(enrich.observations_leg(ids, obs))
    # Rows of equal time and id may change places.
    assert [x[:4] for x in ours] == [x[:4] for x in theirs] and len(ours) > 20
    if hot == 7:
        assert index.shards.where("ref = 'e1'").first()["shards"] > 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = postings.observations_by_reference(ids, index)._jdf.queryExecution().sparkPlan().toString()
        executed = postings.observations_by_reference(ids, index)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" in plan
    bucketed = [line for line in executed.split("\n") if "references_under_test" in line]
    assert bucketed and "Bucketed: true" in executed
    # Between the index and its window no row is exchanged: what is above the join goes to its request.
    lines = executed.split("\n")
    at = next(i for i, line in enumerate(lines) if "references_under_test" in line)
    join = max(i for i, line in enumerate(lines[:at]) if "Join" in line)
    assert not any("Exchange" in line for line in lines[join + 1 : at])
    index.drop()


def test_pages_of_a_ranged_log(spark, tmp_path):
    r = random.Random(3)
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    schema = "updated_at timestamp, id string, batch_no int"
    log = RangedTable(spark, str(tmp_path / "log"), ["updated_at", "id"], grows=True)
    rows = []
    for batch in range(4):
        new = [(at(r.randint(batch * 20, batch * 20 + 30)), f"{r.randint(0, 10**6):06d}", batch) for _ in range(120)]
        log.write(spark.createDataFrame(new, schema), batch, 4)
        if batch == 2:  # a batch again, as after a crash
            log.write(spark.createDataFrame(new, schema), batch, 4)
        rows += new
    rows = sorted(rows)
    assert sorted(map(tuple, log.read().select("updated_at", "id", "batch_no").collect())) == rows
    got, cursor = [], (datetime(1970, 1, 1), "")
    while page := [tuple(x)[:3] for x in log.page(cursor, 50).select("updated_at", "id", "batch_no").collect()]:
        got += page
        cursor = page[-1][:2]
    assert got == rows
    parts = log.ranges()
    assert len(parts) > 6 and len({p.part for p in parts}) == len(parts)
    plan = log.page((at(75), ""), 10)._jdf.queryExecution().executedPlan().toString()
    assert "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    opened = {r["part"] for r in log.page((at(75), ""), 10).select("part").distinct().collect()}
    assert opened and len(opened) < len(parts) / 2
    assert log.after((at(85), "")).count() == sum(x[:2] > (at(85), "") for x in rows)
    assert log.page((at(10_000), ""), 10).count() == 0


def test_an_empty_ranged_table(spark, tmp_path):
    table = RangedTable(spark, str(tmp_path / "t"), ["k"])
    table.write(spark.createDataFrame([], "k string, v int"))
    assert table.among(["x"]).count() == 0
    table.write(spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int"), 1)
    assert [r["v"] for r in table.among(["x"]).collect()] == [1]
