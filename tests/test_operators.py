from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorestone.errors import InvalidInput
from lorestone.operators import enrich, facts, graph, observations, similar, timeline
from lorestone.operators.versioned import FACT_KEY, latest
from lorestone.plans import evalgate
from lorestone.sources import jsonl, schemas, snapshots
from lorestone.streaming import pipelines

FOREVER = datetime(2105, 12, 31, 23, 59, 59)


def now():
    return F.lit("2024-06-01").cast("timestamp")


def day(n):
    return datetime(2024, 1, n)


def fact(i, value="c2", scope="a", predicate="is", status="active", start=1, end=None, visibility="org", updated=None, obj=None):
    return (i, scope, "s1", predicate, value, obj, status, 0.5, "o", "w", day(start), end or FOREVER, day(updated or start), visibility)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def inputs(spark, rows):
    return frame(spark, rows, "scope string, subject_id string, predicate string, object_value string, object_id string, confidence double, source_obs string, actor_type string, actor_id string, visibility string, asserted_at timestamp")


def test_latest_hides_what_a_newer_version_retracts(spark):
    f = frame(spark, [fact("f1"), fact("f2", status="retracted", updated=3)], schemas.FACTS)
    assert [r["fact_id"] for r in latest(f, FACT_KEY, "updated_at", "fact_id").collect()] == ["f2"]


def test_same_value_proposal_hides_the_active_fact(spark):
    f = frame(spark, [fact("f1"), fact("f2", status="proposed", updated=3)], schemas.FACTS)
    ids = frame(spark, [(1, "a", "s1")], "query_id long, caller string, id string")
    assert enrich.facts_leg(ids, f, now()).count() == 0


def test_enrich(spark):
    f = frame(spark, [fact("f1"), fact("f2", "old", end=day(5)), fact("f3", "no", status="retracted"), fact("f4", "mine", visibility="scope")], schemas.FACTS)
    e = frame(spark, [("s1", "a", "ioc_ip", "1.2.3.4", "x", {}, day(1), day(1), day(1))], schemas.ENTITIES)
    o = frame(spark, [(f"o{i}", "a", day(i), "alert", "human", "u", None, None, "restricted" if i == 3 else "internal", "text", [], ["s1", "s1"]) for i in (1, 2, 3)], schemas.OBSERVATIONS)
    g = frame(spark, [(f"e{i}", "a", "s1", f"n{i:03}", "rel", "f1", day(1), FOREVER, day(1)) for i in range(60)] + [("x", "a", "n001", "s1", "rel", "f1", day(1), day(2), day(2))], schemas.EDGES)
    asked = frame(spark, [(1, "a", "1.2.3.4", None), (2, "b", "1.2.3.4", "ioc_ip"), (3, "a", "1.2.3.4", "ioc_domain"), (4, " ", "1.2.3.4", None), (5, "a", "no entity", None)], "query_id long, caller string, key string, type string")
    r = enrich.enrich(asked, e, f, o, g, now())
    assert {x["query_id"] for x in r.entity.collect()} == {1, 2}
    assert {(x["query_id"], x["id"]) for x in r.facts.collect()} == {(1, "f1"), (1, "f4"), (2, "f1")}
    assert [(x["query_id"], x["id"]) for x in r.observations.orderBy("query_id", "rank").collect()] == [(1, "o3"), (1, "o2"), (1, "o1"), (2, "o2"), (2, "o1")]
    assert [x["entity_id"] for x in r.neighbors.where("query_id = 1").orderBy("rank").collect()] == [f"n{i:03}" for i in range(50)]


def test_similar(spark):
    rows = [("o1", "beaconing seen", [1.0, 0.0]), ("o2", "quiet", [0.9, 0.1]), ("o3", "beaconing again", []), ("o3", "beaconing again", []), ("o4", "zero", [0.0, 0.0])]
    o = frame(spark, [(i, "a", day(k + 1), "alert", "human", "u", None, None, "internal", c, v, [schemas.NIL, "e1"]) for k, (i, c, v) in enumerate(rows)], schemas.OBSERVATIONS)
    both = {r["obs_id"]: r for r in similar.similar(o, "a", "beaconing", [1.0, 0.0], 10).collect()}
    assert set(both) == {"o1", "o2", "o3"}
    assert both["o1"]["matched_by"] == ["txt", "vec"]
    assert both["o1"]["score"] == 1 / 61 + 1 / 63
    assert both["o3"]["score"] == 1 / 61
    assert both["o3"]["entity_ids"] == ["e1"]
    assert similar.similar(o, "a", "探索", None, 10).count() == 0
    with pytest.raises(InvalidInput):
        similar.similar(o, "a", " ", None, 10)
    with pytest.raises(InvalidInput):
        similar.similar(o, "a", "x", None, 51)


def test_timeline(spark):
    o = frame(spark, [(f"o{i}", "a", day(i), "alert", "human", "u", None, "c1", "internal", f"t{i}", [], ["s1"]) for i in (3, 1, 2)], schemas.OBSERVATIONS)
    f = frame(spark, [fact("f1", start=4), fact("f2", "gone", status="retracted")], schemas.FACTS)
    e = frame(spark, [("s1", "a", "ioc_ip", "1.2.3.4", "x", {}, day(1), day(1), day(1))], schemas.ENTITIES)
    whole = [r["id"] for r in timeline.timeline_entity(o, f, e, "a", "s1").collect()]
    assert whole == ["f1", "o3", "o2", "o1"]
    pages = [r["id"] for k in (0, 2) for r in timeline.timeline_entity(o, f, e, "a", "s1", 2, k).collect()]
    assert pages == whole
    assert [r["id"] for r in timeline.timeline_case(o, f, "a", "c1").collect()] == whole
    assert timeline.timeline_case(o, f, "b", "c1").count() == 0
    with pytest.raises(InvalidInput):
        timeline.page(o, 501)


def test_assert_supersedes_like_one_at_a_time(spark):
    store = frame(spark, [fact("f1", "v0")], schemas.FACTS)
    batch = [("a", "s1", "is", f"v{k}", "t1" if k == 2 else None, 0.9, None, "human", "u", None, day(k + 10)) for k in (1, 2, 3)]
    batch += [("a", "s1", "is", "p", None, 0.9, None, "agent", "bot", None, day(20)), ("a", "s1", " ", "p", None, 0.9, None, "human", "u", None, day(20))]
    r = facts.assert_facts(inputs(spark, batch), store, ids=False)
    got = {x["object_value"]: (x["status"], x["valid_to"]) for x in r.facts.collect()}
    assert got == {"v0": ("active", day(11)), "v1": ("active", day(12)), "v2": ("active", day(13)), "v3": ("active", FOREVER), "p": ("proposed", FOREVER)}
    assert r.rejects.count() == 1
    assert [x["dst_id"] for x in r.edges.collect()] == ["t1"]
    summaries = [x["payload_summary"] for x in r.audit.orderBy("ts").collect()]
    assert summaries[0] == "status=active confidence=0.90 superseded=1 edge=n vis=org"
    one = store
    for row in batch[:4]:
        step = facts.assert_facts(inputs(spark, [row]), one, ids=False)
        one = spark.createDataFrame(step.applied(one).collect(), schemas.FACTS)
    last = latest(one, FACT_KEY, "updated_at", "fact_id").collect()
    assert {x["object_value"]: (x["status"], x["valid_to"]) for x in last} == got


def test_promote_and_retract(spark):
    store = frame(spark, [fact("f1"), fact("f2", "other", status="proposed")], schemas.FACTS)
    edges = frame(spark, [("e1", "a", "s1", "t", "is", "f1", day(1), FOREVER, day(1))], schemas.EDGES)
    ask = lambda i, who: frame(spark, [(i, who, "u", day(9))], "fact_id string, actor_type string, actor_id string, at timestamp")
    p = facts.promote_facts(ask("f2", "human"), store)
    assert sorted((x["object_value"], x["status"], x["valid_to"]) for x in p.facts.collect()) == [("other", "active", FOREVER), ("other", "proposed", day(9))]
    assert p.audit.first()["payload_summary"] == "from=proposed to=active confidence=0.50 prior=f2 edge=n vis=org"
    assert [facts.promote_facts(ask(i, w), store).rejects.first()["error"] for i, w in (("f2", "agent"), ("f1", "human"), ("zz", "human"))] == ["HumanGated", "Conflict", "NotFound"]
    r = facts.retract_facts(ask("f1", "human"), store, edges)
    assert sorted((x["status"], x["valid_to"]) for x in r.facts.collect()) == [("active", day(9)), ("retracted", day(9))]
    assert r.audit.first()["payload_summary"] == "from=active prior=f1 edge=n vis=org"
    why = ask("f1", "human").withColumn("reason", F.lit("  " + "é" * 130))
    assert facts.retract_facts(why, store, edges).audit.first()["payload_summary"] == f"from=active reason={'é' * 120} prior=f1 edge=n vis=org"
    assert [x["valid_to"] for x in r.edges.collect()] == [day(9)]


def test_resolve_and_record(spark):
    known = frame(spark, [("id1", "a", "ioc_domain", "bad.test", "bad.test", {}, day(1), day(1), day(1))], schemas.ENTITIES)
    raws = ["Bad.test", "1.1.1.1", "bad.test.", "junk words", "T1566", "2.2.2.2", "1.1.1.1"]
    resolved, delta = observations.resolve_batch(frame(spark, [("a", i, r) for i, r in enumerate(raws)], "scope string, pos int, raw string"), known, now())
    ids = [r["entity_id"] for r in resolved.orderBy("pos").collect()]
    assert ids[0] == ids[2] == "id1"
    assert ids[1] == ids[6]
    assert ids[3] is None
    assert delta.count() == 4
    rows = [("a", "alert", "human", "u", None, None, None, None, day(2), "Bad.test and 1.1.1.1"), ("a", "nonsense", "human", "u", None, None, None, None, day(2), "x")]
    r = observations.record_observations(frame(spark, rows, "scope string, kind string, actor_type string, actor_id string, on_behalf_of string, case_id string, client_event_id string, confidentiality string, ts timestamp, content string"), known, now())
    assert r.observations.first()["entity_refs"][0] == "id1"
    assert r.audit.first()["payload_summary"] == "kind=alert entities=2 chars=20"
    assert r.rejects.count() == 1


def edge(i, s, d, rel="rel", start=1, end=None, at=None):
    return (i, "a", s, d, rel, "f", day(start), end or FOREVER, day(at or start))


def test_walk(spark):
    g = frame(spark, [edge("1", "A", "B"), edge("2", "B", "C"), edge("3", "C", "A", "back")], schemas.EDGES)
    state = graph.graph_state(g, now())
    start = frame(spark, [(1, "A")], "query_id long, node string")
    assert {r["node"]: r["path"] for r in graph.walk(state, start, 3).collect()} == {"B": ["A", "B"], "C": ["A", "C"]}
    assert [r["path"] for r in graph.walk(state, start, 2, "rel").orderBy("depth").collect()] == [["A", "B"], ["A", "B", "C"]]
    names = frame(spark, [("A", "ka"), ("B", "kb")], "entity_id string, key string")
    assert [r["keys"] for r in graph.hydrate_paths(graph.walk(state, start, 2, "rel"), names).collect()] == [["ka", "kb"]]
    with pytest.raises(InvalidInput):
        graph.walk(state, start, 4)


def test_close_and_reopen_keep_their_order(spark):
    g = frame(spark, [edge("1", "A", "B", end=day(3), at=3), edge("2", "A", "B", "new", 4), edge("3", "C", "D"), edge("4", "C", "D", end=day(9), at=9)], schemas.EDGES)
    assert [(r["src_id"], r["relation"]) for r in graph.graph_state(g, now()).collect()] == [("A", "new")]


def test_an_edge_that_ended_and_began_anew_is_open(spark):
    """Twenty pairs asserted twice: in the state, a rebuild, and pages of any size, whichever event's id is greater."""
    store = frame(spark, [fact("f0", "v0")], schemas.FACTS).where("false")
    none = frame(spark, [], schemas.EDGES)
    batch = lambda value, d: inputs(spark, [("a", f"s{k}", "is", value, "t", 0.9, None, "human", "u", None, day(d)) for k in range(20)])
    first = facts.assert_facts(batch("one", 2), store, none, ids=False)
    held = spark.createDataFrame(first.applied(store).collect(), schemas.FACTS)
    edges = spark.createDataFrame(first.applied_edges(none).collect(), schemas.EDGES)
    edges = spark.createDataFrame(facts.assert_facts(batch("two", 3), held, edges, ids=False).applied_edges(edges).collect(), schemas.EDGES)
    assert edges.count() == 40 and edges.where("updated_at = timestamp'2024-01-03'").count() == 40
    ids = [f"s{k}" for k in range(20)] + ["t"]
    known = frame(spark, [(i, "a", "x", i, i, {}, day(1), day(1), day(1)) for i in ids], schemas.ENTITIES)
    pairs = lambda df: sorted((r["src_id"], r["dst_id"]) for r in df.collect())
    want = sorted((f"s{k}", "t") for k in range(20))
    assert pairs(graph.graph_state(edges, now())) == pairs(graph.rebuild(known, edges, now()).edges) == want
    empty = graph.Projection(graph.vertices(known).limit(0), edges.limit(0), graph.cursor_start(), graph.cursor_start())
    for size in (7, 40):
        assert pairs(graph.drain(empty, known, edges, now(), size)[0].edges) == want


def test_ranked_links_leave_the_same_walk(spark):
    """A walk of few nodes over nodes of many links, against one that knows all links."""
    import random

    r = random.Random(4)
    rows = [edge(str(k), f"n{r.randint(0, 40):02}", f"n{r.randint(0, 40):02}") for k in range(700)]
    state = graph.graph_state(frame(spark, rows, schemas.EDGES), now())
    start = frame(spark, [(k, f"n{k:02}") for k in range(0, 40, 4)], "query_id long, node string")
    links = {}
    for e in state.collect():
        links.setdefault(e["src_id"], set()).add(e["dst_id"])
        links.setdefault(e["dst_id"], set()).add(e["src_id"])
    for most in (3, 9):
        want = []
        for k in range(0, 40, 4):
            level, found, depth = {f"n{k:02}": [f"n{k:02}"]}, {f"n{k:02}": 0}, 0
            told = []
            while depth < 3 and len(told) < most:
                depth += 1
                new = {}
                for path in sorted(level.values()):
                    for other in links.get(path[-1], ()):
                        if other not in found and (other not in new or path < new[other][:-1]):
                            new[other] = [*path, other]
                level = dict(sorted(new.items())[:most])
                found |= dict.fromkeys(level, depth)
                told += [(k, n, depth, p) for n, p in level.items()]
            want += told[:most]
        got = sorted((x["query_id"], x["node"], x["depth"], x["path"]) for x in graph.walk(state, start, 3, most=most).collect())
        assert got == sorted(want)


def test_projection_stops_at_what_must_wait(spark):
    g = frame(spark, [edge("1", "A", "B"), edge("2", "A", "ghost", start=2), edge("3", "A", "late", start=3), edge("4", "A", "B", start=4)], schemas.EDGES)
    nodes = frame(spark, [("A",), ("B",)], "ch_id string")
    known = frame(spark, [("A",), ("B",), ("late",)], "entity_id string")
    page = graph.classify_edges(graph.edge_page(g, F.lit("2000-01-01").cast("timestamp"), F.lit("")), nodes, known)
    assert {r["edge_id"]: r["outcome"] for r in page.collect()} == {"1": "resolved", "2": "orphan", "3": "deferrable", "4": "resolved"}
    assert sorted(r["edge_id"] for r in graph.projectable(page).collect()) == ["1", "2"]


def test_jsonl(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('# note\n\n{"kind":"alert","content":"x","ts":"2024-01-01T00:00:00Z"}\nnot json\n{"kind":"alert","ts":"soon"}\n')
    good, bad = jsonl.read_lines(spark, str(path), jsonl.OBSERVATION_LINES)
    assert good.count() == 1
    assert sorted(r["error"] for r in bad.collect()) == ["line is no JSON object", "ts is no timestamp"]
    assert {r["outcome"]: r["n"] for r in jsonl.dry_run(good, bad).collect()} == {"accepted": 1, "rejected": 2}


def test_snapshots(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    store.write("t", spark.range(3))
    before = store.read("t")
    store.write("t", spark.range(5))
    assert (before.count(), store.read("t").count()) == (3, 5)


def test_extraction_covers_failures(spark):
    o = frame(spark, [(f"o{i}", "a", day(i), "alert", "human", "u", None, None, "internal", f"c{i}", [], []) for i in (1, 2, 3, 4)], schemas.OBSERVATIONS)
    batch = pipelines.uncovered_batch(o, frame(spark, [("o1",)], "obs_id string"), 2)
    said = '[{"subject":"1.1.1.1","predicate":"is","object_value":"c2","confidence":0.9}]'
    found, covered = pipelines.extract(batch, lambda texts: [said if t == "c2" else None for t in texts])
    assert [(r["obs_id"], r["subject"]) for r in found.collect()] == [("o2", "1.1.1.1")]
    assert sorted(r["obs_id"] for r in covered.collect()) == ["o2", "o3"]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    frame(spark, [("a", "agent", day(1))] * 3 + [("h", "human", day(1))] * 3, "actor_id string, actor_type string, ts timestamp").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("actor_id string, actor_type string, ts timestamp").parquet(src)
    q = pipelines.rate_limited(stream, 2).writeStream.format("memory").queryName("limited").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    got = {(r["actor_id"], r["allowed"]): r["n"] for r in spark.sql("select actor_id, allowed, count(*) n from limited group by all").collect()}
    assert got == {("a", True): 2, ("a", False): 1, ("h", True): 3}
    seen = []
    pipelines.run_projection(stream, lambda df, i: seen.append(df.count()), str(tmp_path / "c2")).awaitTermination()
    assert sum(seen) == 6


def test_recall(spark):
    hits = frame(spark, [("q1", ["a", "b"]), ("q2", ["a"])], "query_id string, entity_ids array<string>")
    want = frame(spark, [("q1", "a"), ("q1", "b"), ("q2", "z")], "query_id string, entity_id string")
    assert tuple(evalgate.recall(hits, want).first()) == (1, 2, 0.5)
    assert evalgate.regressed(0.4, 0.5)
    assert not evalgate.regressed(0.5, 0.5)
