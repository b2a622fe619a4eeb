import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorestone.errors import Conflict, HumanGated, InvalidInput, NotFound
from lorestone.facade import Limited, Memory, status
from lorestone.functions import embedding
from lorestone.functions.prompts import BASE, system_prompt
from lorestone.operators import facts, graph, observations
from lorestone.plans import evalgate
from lorestone.sources import bootstrap, configs, schemas
from lorestone.sources.snapshots import SnapshotStore
from lorestone.streaming.pipelines import Budget

FOREVER = datetime(2105, 12, 31, 23, 59, 59)
ID = "0190a0b0-0000-7000-8000-00000000000{}"


def day(n):
    return datetime(2024, 1, n)


def asserted(spark, rows):
    return spark.createDataFrame(rows, "scope string, subject_id string, predicate string, object_value string, object_id string, confidence double, source_obs string, actor_type string, actor_id string, visibility string, asserted_at timestamp")


def stored(spark, *rows):
    return spark.createDataFrame([(i, "a", ID.format(1), "is", v, None, "active", 0.5, "o", "w", day(s), e, day(s), "org") for i, v, s, e in rows], schemas.FACTS)


def edge(i, src, dst, start, end=FOREVER, relation="is", at=None, fact="f"):
    return (i, "a", src, dst, relation, fact, day(start), end, day(at or start))


def test_assertions_end_edges_and_intervals_to_come(spark):
    s, t1, t2 = ID.format(1), ID.format(2), ID.format(3)
    store = stored(spark, ("f1", "v1", 1, day(20)), ("f2", "v2", 1, day(5)))
    edges = spark.createDataFrame([edge("e1", s, t1, 1), edge("e2", s, t1, 1, relation="has"), edge("e3", s, t1, 1, day(5), at=5)], schemas.EDGES)
    batch = [("a", s, "is", "w1", t1, 0.9, None, "human", "u", None, day(10)), ("a", s, "is", "w2", t2, 0.9, None, "human", "u", None, day(12))]
    r = facts.assert_facts(asserted(spark, batch), store, edges)
    ends = {x["object_value"]: x["valid_to"] for x in r.applied(store).collect()}
    assert ends == {"v1": day(10), "v2": day(5), "w1": day(12), "w2": FOREVER}
    after = {(x["dst_id"], x["relation"], x["valid_from"]): (x["valid_to"], x["updated_at"]) for x in r.applied_edges(edges).where("edge_id <> 'e3'").collect()}
    assert after == {(t1, "is", day(1)): (day(10), day(10)), (t1, "has", day(1)): (FOREVER, day(1)), (t1, "is", day(10)): (day(12), day(12)), (t2, "is", day(12)): (FOREVER, day(12))}
    now = F.lit("2024-01-13").cast("timestamp")
    assert sorted((x["dst_id"], x["relation"]) for x in graph.graph_state(r.applied_edges(edges).where("relation = 'is'"), now).collect()) == [(t2, "is")]


def test_assertions_that_break_a_rule(spark):
    good = ["a", ID.format(1).upper(), "is", "x", None, 0.5, None, "human", "u", None, day(1)]
    wrong = {0: " ", 1: "s1", 2: "", 3: "y" * 2001, 4: "t", 6: "obs", 7: "robot", 8: "", 9: "all"}
    rows = [tuple(good)] + [tuple(v if k == i else x for k, x in enumerate(good)) for i, v in wrong.items()]
    r = facts.assert_facts(asserted(spark, rows), stored(spark, ("f0", "v", 1, FOREVER)).limit(0))
    assert sorted(x["error"] for x in r.rejects.collect()) == sorted(["scope is blank", "subject_id is no id", "predicate is blank", "a field is too long", "object_id is no id", "source_obs is no id", "actor_type is unknown", "actor_id is blank", "visibility is unknown"])
    row = r.facts.first()
    assert (row["subject_id"], row["source_obs"], row["visibility"]) == (ID.format(1), schemas.NIL, "org")


def entities(spark, *names):
    return spark.createDataFrame([(i, scope, "ioc_domain", key, key, {}, day(1), day(1), day(n + 1)) for n, (i, scope, key) in enumerate(names)], schemas.ENTITIES)


def test_traverse(spark):
    e = entities(spark, ("A", "t1", "a.test"), ("A2", "t2", "a.test"), ("B", "t1", "b.test"), ("C", "t2", "c.test"))
    g = spark.createDataFrame([edge("1", "A", "B", 1, relation="uses"), edge("2", "B", "C", 1, relation="uses"), edge("3", "B", "ghost", 1, relation="uses")], schemas.EDGES)
    asked = spark.createDataFrame([(1, "t9", "A.test.", None), (2, "t2", "a.test", None), (3, "t1", "a.test", "ioc_ip"), (4, "t1", "no name", None), (5, " ", "a.test", None)], "query_id long, caller string, key string, type string")
    assert {r["query_id"]: r["node"] for r in graph.starts(asked, e).collect()} == {1: "A", 2: "A2"}
    found = graph.traverse(asked, e, g, relation="uses", hops=2).collect()
    assert [(r["query_id"], r["node"], r["keys"], r["scopes"]) for r in found] == [(1, "B", ["a.test", "b.test"], ["t1", "t1"]), (1, "C", ["a.test", "b.test", "c.test"], ["t1", "t1", "t2"])]
    assert graph.traverse(asked, e, g, nodes=spark.createDataFrame([("B",)], "ch_id string")).count() == 0
    for relation, hops in (("Uses!", 1), (None, 0), (None, 4)):
        with pytest.raises(InvalidInput):
            graph.traverse(asked, e, g, relation=relation, hops=hops)


def test_facets(spark):
    rows = [("uses", "", None, True), ("", None, None, False), (None, None, None, False), ("has", None, None, False), ("uses", "soon", None, False), ("uses", None, "never", False), ("uses", "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z", True), ("uses", None, "2024-01-10T00:00:00Z", False), ("uses", "2024-01-11T00:00:00Z", None, False)]
    df = spark.createDataFrame(rows, "relation string, valid_from string, valid_to string, want boolean")
    now = F.lit("2024-01-10").cast("timestamp")
    assert all(r["ok"] == r["want"] for r in df.withColumn("ok", graph.facet_ok(now, "uses")).collect())


def test_projection_by_pages_is_the_rebuild(spark):
    e = entities(spark, ("A", "t", "a.test"), ("B", "t", "b.test"), ("C", "t", "c.test"), ("D", "t", "d.test"))
    rows = [edge("1", "A", "B", 1, day(3), at=3), edge("2", "A", "B", 4, relation="has"), edge("3", "B", "C", 5), edge("4", "ghost", "C", 6), edge("5", "C", "D", 7, day(8), at=8), edge("6", "D", "A", 9)]
    g = spark.createDataFrame(rows, schemas.EDGES)
    now = F.lit("2024-01-20").cast("timestamp")
    none = graph.Projection(graph.vertices(e).limit(0), g.limit(0), graph.cursor_start(), graph.cursor_start())
    # One page of two entities: the edge to what isn't projected yet stops the page, and nothing after it counts.
    some, n = graph.project_entities(none, e, 2)
    step, left, stats = graph.project_edges(some, g, e, now, 10)
    assert (n, stats) == (2, {"processed": 2, "orphans": 0, "deferred": 1})
    again, _, stats = graph.project_edges(step, left, e, now, 10)
    assert again.edge_cursor == step.edge_cursor
    assert stats == {"processed": 0, "orphans": 0, "deferred": 1}
    done, left, total = graph.drain(step, e, left, now, 3)
    assert sorted(r["edge_id"] for r in left.collect()) == ["1", "2", "3", "5", "6"]
    assert (total["processed"], total["orphans"], total["deferred"]) == (3, 1, 0)
    whole = graph.rebuild(e, g, now)
    key = lambda df: sorted((r["src_id"], r["dst_id"], r["relation"]) for r in df.collect())
    assert key(done.edges) == key(whole.edges) == [("A", "B", "has"), ("B", "C", "is"), ("D", "A", "is")]
    assert sorted(r["ch_id"] for r in done.nodes.collect()) == sorted(r["ch_id"] for r in whole.nodes.collect())
    assert graph.advance(("2024-01-02", "b"), "2024-01-02", "a") == ("2024-01-02", "b")


def test_embedding(spark):
    embed = embedding.hashed_embedder(8)
    a, b = embed("document", ["x", "x"])
    assert a == b != embed("query", ["x"])[0]
    assert abs(float(np.linalg.norm(a)) - 1) < 1e-6
    with pytest.raises(ValueError, match="kind"):
        embed("other", ["x"])
    seen = []
    embedding.for_model(lambda texts: seen.extend(texts) or [[0.0]] * len(texts), "some-nomic-1")("query", ["q"])
    embedding.for_model(lambda texts: seen.extend(texts) or [[0.0]] * len(texts), "other")("document", ["d"])
    assert seen == ["search_query: q", "d"]
    with pytest.raises(ValueError, match="no vector"):
        embedding.for_model(lambda texts: [], "other")("query", ["q"])
    df = spark.createDataFrame([("x",), (None,)], "content string")
    got = {r["content"]: r["content_vec"] for r in embedding.with_vectors(df, embed, "document").collect()}
    assert got["x"] == a
    assert got[None] == []

    def broken(kind, texts):
        raise OSError

    assert {len(r["content_vec"]) for r in embedding.with_vectors(df, broken, "document").collect()} == {0}


def test_configs(tmp_path):
    (tmp_path / "a.yaml").write_text('name: n\nscope: s\nqueries:\n  - q: one\n    must_reference_entities: ["a.test"]\n  - q: two\n    k: 3\n')
    (read,) = configs.read_evals(str(tmp_path))
    assert read.queries == (configs.Question("one", ("a.test",), 10), configs.Question("two", (), 3))
    token = "key_" + "0f" * 32
    good = {"token": token, "actor_type": "agent", "actor_id": "bot", "scope": "t"}
    known = configs.parse_identities(json.dumps([good]))
    assert configs.identify(f"Bearer {token}", known) == configs.Identity("agent", "bot", "t")
    assert configs.identify("Basic x", known) is configs.identify(None, known) is None
    for bad in ([], [good, good], [good | {"more": 1}], [good | {"token": "short"}], [good | {"actor_type": "cat"}], [good | {"actor_id": " "}], [good | {"scope": ""}], {}):
        with pytest.raises(InvalidInput):
            configs.parse_identities(json.dumps(bad))
    assert configs.parse_trust(" a, b ,", "0.5") == configs.Trust(("a", "b"), 0.5)
    assert [configs.parse_trust(None, x).floor for x in (None, "nan", "1.5", "-1", "high", "0")] == [0.8, 0.8, 0.8, 0.8, 0.8, 0.0]
    assert [configs.strict_int(x, "k") for x in ("0", "-3", "12")] == [0, -3, 12]
    for bad in ("", "07", "+7", "1 ", "1.0", "-0", "x"):
        with pytest.raises(InvalidInput):
            configs.strict_int(bad, "k")
    assert system_prompt() == BASE
    assert system_prompt(["uses", "has"]).endswith("- uses\n- has\n")


def test_statements_and_migrations(spark, tmp_path):
    assert bootstrap.split_statements("a; -- x;\nb ';' \";\" `;` /* ; */ 'it''s \\';'; /* c */ ; -- d\n;e - f / g") == ["a", "b ';' \";\" `;` /* ; */ 'it''s \\';'", "e - f / g"]
    store = SnapshotStore(spark, str(tmp_path / "s"))
    scripts = {"002": "create or replace temp view mig as select 2 as n", "001": "create or replace temp view mig as select 1 as n; -- done"}
    assert bootstrap.migrate(spark, store, scripts) == ["001", "002"]
    assert spark.table("mig").first()["n"] == 2
    assert bootstrap.migrate(spark, store, scripts | {"003": "select 1"}) == ["003"]


def test_snapshots_change_as_a_whole(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    frame = lambda *rows: spark.createDataFrame(list(rows), "k string, ts string, id string")
    got = lambda: sorted(tuple(r) for r in store.read("t").collect())
    store.append("t", frame(("a", "1", "x")))
    store.append("t", frame(("b", "1", "y")))
    store.merge("t", frame(("b", "2", "z"), ("c", "1", "w")), ["k"])
    assert got() == [("a", "1", "x"), ("b", "2", "z"), ("c", "1", "w")]
    assert not store.swap("t", {"k": "b"}, ("1", "y"), {"ts": "3", "id": "a"})
    assert not store.swap("t", {"k": "b"}, ("2", "z"), {"ts": "2", "id": "y"})
    assert store.swap("t", {"k": "b"}, ("2", "z"), {"ts": "3", "id": "a"})
    store.delete("t", spark.createDataFrame([("a",)], "k string"))
    assert got() == [("b", "3", "a"), ("c", "1", "w")]
    store.truncate("t", frame(("b", "0", "")))
    assert got() == [("b", "0", "")]
    store.truncate("t")
    assert got() == []


def test_budget():
    b = Budget(2, most=2)
    assert [b.wait("agent", "a", 0.0) for _ in range(3)] == [0.0, 0.0, 0.5]
    assert b.wait("agent", "a", 0.5) == 0.0
    assert b.wait("human", "h", 0.5) == 0.0
    assert [b.wait("agent", "b", 1.0), b.wait("agent", "c", 1.0)] == [0.0, 0.0]
    assert list(b.levels) == ["b", "c"]
    assert Budget(float("nan")).rate == Budget(-1).rate == 5.0


def test_facade(spark, tmp_path):
    m = Memory(SnapshotStore(spark, str(tmp_path / "s")), embed=embedding.hashed_embedder(8))
    me, bot = configs.Identity("human", "ann", "t1"), configs.Identity("agent", "bot", "t1")
    seen = m.record_observation(me, kind="alert", content="db7.lorestone.test called 172.16.0.9", ts=day(2))
    ids = {r["key"]: r["entity_id"] for r in m.store.read("entities").collect()}
    assert set(ids) == {"db7.lorestone.test", "172.16.0.9"}
    fact = m.assert_fact(bot, subject_id=ids["db7.lorestone.test"], predicate="uses", object_value="it", object_id=ids["172.16.0.9"])
    with pytest.raises(HumanGated):
        m.promote_fact(bot, fact)
    live = m.promote_fact(me, fact)
    with pytest.raises(Conflict):
        m.promote_fact(me, live)
    with pytest.raises(NotFound):
        m.retract_fact(me, "nothing")
    with pytest.raises(InvalidInput):
        m.assert_fact(me, subject_id="x", predicate="uses", object_value="it")
    with pytest.raises(InvalidInput):
        m.record_observation(me, kind="alert", content="x", color="red")
    known = m.enrich(me, "DB7.lorestone.test")
    assert [r["id"] for r in known.facts.collect()] == [live]
    assert [r["id"] for r in known.observations.collect()] == [seen]
    assert [r["nid"] for r in m.traverse(me, "db7.lorestone.test", relation="uses", hops=3).collect()] == [ids["172.16.0.9"]]
    assert [r["matched_by"] for r in m.search(me, "who called").collect()] == [["txt", "vec"]]
    assert m.timeline(me, entity_id=ids["db7.lorestone.test"]).count() == 2
    with pytest.raises(InvalidInput):
        m.timeline(me)
    assert [r["predicate"] for r in m.list_predicates().collect()] == ["uses"]
    m.retract_fact(me, live, " wrong ")
    assert m.traverse(me, "db7.lorestone.test").count() == 0
    assert [r["operation"] for r in m.store.read("audit").orderBy("ts").collect()] == ["record_observation", "assert_fact", "promote_fact", "retract_fact"]
    assert "<memory-context>" in m.as_context(m.list_predicates(), "n").first()["context"]
    m.budget = Budget(1)
    m.budget.wait("agent", "bot", __import__("time").monotonic())
    with pytest.raises(Limited) as e:
        m.promote_fact(bot, live)
    assert [status(x) for x in (e.value, HumanGated(), OSError())] == [(429, "rate_limited"), (403, "human_gated"), (502, "storage_error")]


def test_eval_runner(spark, tmp_path):
    rows = spark.createDataFrame([("t", "alert", "human", "u", None, None, None, None, day(2), "db7.lorestone.test called 172.16.0.9")], "scope string, kind string, actor_type string, actor_id string, on_behalf_of string, case_id string, client_event_id string, confidentiality string, ts timestamp, content string")
    r = observations.record_observations(rows, spark.createDataFrame([], schemas.ENTITIES), F.lit(day(3)))
    ask = lambda q, *want: configs.Question(q, want)
    file = configs.EvalFile("f", "t", (ask("called", "DB7.lorestone.test", "172.16.0.9"), ask("called", "other.test"), ask("called"), ask(" ")))
    score, each = evalgate.run_evals([file], r.observations, r.entities)
    assert (score.passed, score.total, score.errored) == (2, 3, 1)
    assert [x["passed"] for x in each.orderBy("query_id").collect()] == [True, False, True]
    path = str(tmp_path / "score")
    assert [evalgate.keep_score(path, x) for x in (0.5, 0.4, 0.75)] == [True, False, True]
    assert open(path).read() == "0.7500\n"
