"""A query for each operator over the driver's tables, beside its SQL for DuckDB."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import entities as ent
from ..functions import scores, text
from ..functions.proposals import parse_proposals, sanitize_proposals
from ..operators import enrich, facts, graph, observations, postings, similar, timeline
from ..operators.versioned import FACT_KEY, keep_by_ttl, keyset_page, latest, valid_at, visible
from ..scratch import materialise, scratch
from ..sources.jsonl import FACT_LINES, OBSERVATION_LINES, dry_run, parse_lines, resolve_facts
from ..sources.ranged import RangedTable
from ..sources.schemas import ENTITIES
from ..streaming.pipelines import uncovered_batch
from .evalgate import ask, recall
from .views import Views, sql, stable_id_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
AS_OF = datetime(1997, 6, 30)
AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"
QUERY = "the of and est unknownword"
VERSION_KEY = ["scope", "entity_type", "key"]


def as_of():
    return F.expr("timestamp_ntz'1997-06-30 00:00:00'")


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query(sql("SELECT scope, entity_type, key, entity_id, updated_at, version_id, value FROM entity_versions QUALIFY row_number() OVER (PARTITION BY scope, entity_type, key ORDER BY updated_at DESC, version_id DESC) = 1"))
def latest_version(v: Views) -> DataFrame:
    return latest(v.entity_versions(), VERSION_KEY, "updated_at", "version_id").select("scope", "entity_type", "key", "entity_id", "updated_at", "version_id", "value")


@query(sql(f"SELECT fact_id, scope, subject_id, predicate, object_value, confidence, valid_from FROM latest_facts WHERE status = 'active' AND valid_from <= {AS_OF_SQL} AND valid_to > {AS_OF_SQL}"))
def open_facts_asof(v: Views) -> DataFrame:
    return latest(v.facts(), FACT_KEY, "updated_at", "fact_id").where(valid_at(as_of())).select("fact_id", "scope", "subject_id", "predicate", "object_value", "confidence", "valid_from")


@query(sql("SELECT obs_id, scope, kind, confidentiality, ts FROM obs WHERE scope = 'src3' OR confidentiality = 'internal'"))
def visible_obs(v: Views) -> DataFrame:
    return v.obs().where(visible("src3", "confidentiality", "internal")).select("obs_id", "scope", "kind", "confidentiality", "ts")


@query(sql("SELECT obs_id, kind, ts FROM obs WHERE NOT (kind = 'alert' AND ts + INTERVAL 365 DAY <= TIMESTAMP '2025-01-01 05:00:00')"))
def alert_ttl(v: Views) -> DataFrame:
    return v.obs().where(keep_by_ttl(F.expr("timestamp_ntz'2025-01-01 05:00:00'"))).select("obs_id", "kind", "ts")


@query(sql("SELECT DISTINCT e.entity_id, e.scope FROM entity_versions e WHERE (e.entity_type, e.key) IN (SELECT entity_type, c_custkey::VARCHAR FROM customer, (SELECT DISTINCT entity_type FROM entity_versions))"))
def sibling_lookup(v: Views) -> DataFrame:
    e = v.entity_versions()
    types = F.broadcast(e.select("entity_type").distinct())  # a handful of names
    anchor = v.table("customer").select(F.col("c_custkey").cast("string").alias("key")).crossJoin(types)
    return e.join(anchor, ["entity_type", "key"], "left_semi").select("entity_id", "scope").distinct()


def _ids(v: Views, prefix: str = "") -> DataFrame:
    """Every customer as a request of its own, asked for by one scope."""
    c = v.table("customer")
    return c.select(F.col("c_custkey").alias("query_id"), F.lit("team-1").alias("caller"), F.concat(F.lit(prefix), F.col("c_custkey").cast("string")).alias("id"))


@query(sql(f"""SELECT c_custkey AS query_id, fact_id AS id, predicate, object_value, status, confidence, valid_from, written_by, source_obs, scope AS origin_scope,
row_number() OVER (PARTITION BY c_custkey ORDER BY confidence DESC, fact_id) AS rank FROM latest_facts JOIN customer ON subject_id = c_custkey::VARCHAR
WHERE status = 'active' AND valid_from <= {AS_OF_SQL} AND valid_to > {AS_OF_SQL} AND (scope = 'team-1' OR visibility = 'org') QUALIFY rank <= 200"""))
def enrich_facts(v: Views) -> DataFrame:
    return enrich.facts_leg(_ids(v), v.facts(), as_of())


_NAMED = sql("""SELECT i AS query_id, obs_id AS id, ts, kind, substr(content, 1, 200) AS excerpt, scope AS origin_scope, row_number() OVER (PARTITION BY i ORDER BY ts DESC, obs_id) AS rank
FROM obs JOIN (SELECT unnest(range(0, 97)) AS i) q ON list_contains(entity_refs, i::VARCHAR) WHERE scope = 'src1' OR confidentiality = 'internal' QUALIFY rank <= 10""")


def _references(v: Views) -> DataFrame:
    return v.spark.range(97).select(F.col("id").alias("query_id"), F.lit("src1").alias("caller"), F.col("id").cast("string").alias("id"))


@query(_NAMED)
def enrich_observations(v: Views) -> DataFrame:
    return enrich.observations_leg(_references(v), v.obs())


@query(_NAMED)
def enrich_observations_bucketed(v: Views) -> DataFrame:
    """The same from an index in buckets, in which entities of over 100 rows are dealt over several."""
    name = f"lorestone_references_{uuid.uuid4().hex}"
    index = postings.index_references(v.obs(), name, scratch(v.spark, "references"), hot=100)
    out = materialise(postings.observations_by_reference(_references(v), index), "by-reference")
    index.drop()
    return out


@query(sql(f"""SELECT query_id, entity_id, relation, direction, row_number() OVER (PARTITION BY query_id ORDER BY entity_id, relation, direction) AS rank FROM (
SELECT DISTINCT c_custkey AS query_id, dst_id AS entity_id, relation, 'out' AS direction FROM edges JOIN customer ON src_id = 'c' || c_custkey WHERE valid_to > {AS_OF_SQL}
UNION SELECT c_custkey, src_id, relation, 'in' FROM edges JOIN customer ON dst_id = 'c' || c_custkey WHERE valid_to > {AS_OF_SQL}) QUALIFY rank <= 50"""))
def enrich_neighbors(v: Views) -> DataFrame:
    return enrich.neighbors_leg(_ids(v, "c"), v.edges(), as_of())


def _qvec(v: Views) -> list[float]:
    """The question's vector: that of id 7."""
    return list(v.table("embeddings").where("vec_id = 7").first()["embedding"])


_GATE = "(scope = 'src2' OR confidentiality = 'internal')"
_VEC = f"""vec AS (SELECT obs_id, 'vec' AS src, row_number() OVER (ORDER BY dist, obs_id) AS rank FROM (SELECT obs_id, 1 - list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))) AS dist
FROM obs JOIN embeddings ON obs_id = lpad(vec_id::VARCHAR, 9, '0'), (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7) WHERE {_GATE}) QUALIFY rank <= 20)"""
_TXT = f"""txt AS (SELECT obs_id, 'txt' AS src, row_number() OVER (ORDER BY ts DESC, obs_id) AS rank FROM obs WHERE {_GATE}
AND list_has_any(string_split_regex(content, '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), ['the', 'of', 'and', 'est', 'unknownword']) QUALIFY rank <= 20)"""


def _fused(legs: str, k: int) -> str:
    return f"SELECT f.obs_id, f.score, array_to_string(f.matched_by, ',') AS matched_by, o.ts, o.kind, substr(o.content, 1, 200) AS excerpt, o.scope AS origin_scope FROM (SELECT obs_id, sum(1.0::DOUBLE / (60 + rank)) AS score, list_sort(list(DISTINCT src)) AS matched_by FROM ({legs}) GROUP BY obs_id ORDER BY score DESC, obs_id LIMIT {k}) f JOIN obs o ON f.obs_id = o.obs_id WHERE {_GATE}"


def _with(ctes: list[str], body: str) -> str:
    return sql(", " + ",\n".join(ctes) + "\n" + body)


def _hits(hits: DataFrame) -> DataFrame:
    return hits.select("obs_id", "score", F.array_join("matched_by", ",").alias("matched_by"), "ts", "kind", "excerpt", "origin_scope")


@query(_with([_VEC], "SELECT obs_id, src, rank FROM vec"))
def similar_vec_leg(v: Views) -> DataFrame:
    return similar.vector_leg(v.obs_vec(), "src2", _qvec(v))


@query(_with([_TXT], "SELECT obs_id, src, rank FROM txt"))
def similar_txt_leg(v: Views) -> DataFrame:
    return similar.text_leg(v.obs(), "src2", QUERY)


@query(_with([_TXT], "SELECT obs_id, src, rank FROM txt"))
def similar_txt_indexed(v: Views) -> DataFrame:
    """The same from an index by token, to which half of the observations came later."""
    index, odd = postings.TokenIndex(v.spark, scratch(v.spark, "tokens")), F.col("obs_id").cast("long") % 2 == 1
    index.add(v.obs().where(~odd), 0)
    index.add(v.obs().where(odd), 1)
    asked = postings.asked_tokens(v.spark.createDataFrame([(0, "src2", QUERY)], "query_id long, scope string, q string"))
    return postings.text_legs(index.of(asked.select("token")), asked, similar.LEG).select("obs_id", "src", "rank")


@query(_with([_VEC, _TXT], _fused("SELECT * FROM vec UNION ALL SELECT * FROM txt", 20)))
def similar_rrf(v: Views) -> DataFrame:
    return _hits(similar.similar(v.obs_vec(), "src2", QUERY, _qvec(v), 20))


@query(_with([_TXT], _fused("SELECT * FROM txt", 10)))
def similar_txt_only(v: Views) -> DataFrame:
    return _hits(similar.similar(v.obs_vec(), "src2", QUERY, None, 10))


@query(_with([_VEC], _fused("SELECT * FROM vec", 10)))
def similar_vec_only(v: Views) -> DataFrame:
    return _hits(similar.similar(v.obs_vec(), "src2", "探索", _qvec(v), 10))


def _questions(v: Views) -> DataFrame:
    """A question of every vector, in the words of its document, by one scope of twenty, for 5 to 14 hits."""
    e = v.table("embeddings").join(v.table("documents"), F.col("vec_id") == F.col("doc_id"))
    return e.select(F.col("vec_id").alias("query_id"), F.concat(F.lit("src"), (F.col("vec_id") % 20).cast("string")).alias("scope"), F.col("text").alias("q"), F.col("embedding").alias("qvec"), (F.col("vec_id") % 10 + 5).alias("k"))


_MANY = [
    "asks AS (SELECT vec_id AS query_id, 'src' || (vec_id % 20) AS scope, text AS q, embedding::DOUBLE[] AS qv, vec_id % 10 + 5 AS k, coalesce(regexp_matches(text, '[^\\s]'), false) AS fine FROM embeddings JOIN documents ON vec_id = doc_id)",
    "said AS (SELECT query_id, scope, token FROM (SELECT query_id, scope, token, min(i) AS i FROM (SELECT query_id, scope, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM (SELECT *, string_split_regex(lower(q), '[^a-z0-9]+') AS w FROM asks WHERE fine)) WHERE token <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i) <= 8)",
    "held AS (SELECT DISTINCT obs_id, ts, scope, confidentiality, unnest(string_split_regex(content, '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS token FROM obs)",
    "by_vec AS (SELECT query_id, obs_id, 'vec' AS src, row_number() OVER (PARTITION BY query_id ORDER BY dist, obs_id) AS rank FROM (SELECT a.query_id, o.obs_id, 1 - list_dot_product(e.embedding::DOUBLE[], a.qv) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(a.qv, a.qv))) AS dist FROM asks a, obs o JOIN embeddings e ON o.obs_id = lpad(e.vec_id::VARCHAR, 9, '0') WHERE a.fine AND (o.scope = a.scope OR o.confidentiality = 'internal')) QUALIFY rank <= 20)",
    "by_txt AS (SELECT query_id, obs_id, 'txt' AS src, row_number() OVER (PARTITION BY query_id ORDER BY ts DESC, obs_id) AS rank FROM (SELECT DISTINCT s.query_id, h.obs_id, h.ts FROM said s JOIN held h USING (token) WHERE h.scope = s.scope OR h.confidentiality = 'internal') QUALIFY rank <= 20)",
    "best AS (SELECT f.query_id, obs_id, score, matched_by, row_number() OVER (PARTITION BY f.query_id ORDER BY score DESC, obs_id) AS rank FROM (SELECT query_id, obs_id, sum(1.0::DOUBLE / (60 + rank)) AS score, array_to_string(list_sort(list(DISTINCT src)), ',') AS matched_by FROM (SELECT * FROM by_vec UNION ALL SELECT * FROM by_txt) GROUP BY ALL) f JOIN asks USING (query_id) QUALIFY rank <= any_value(k) OVER (PARTITION BY f.query_id))",
]


@query(_with(_MANY, "SELECT query_id, rank, obs_id, score, matched_by, o.ts, o.kind, substr(o.content, 1, 200) AS excerpt, o.scope AS origin_scope FROM best JOIN obs o USING (obs_id)"))
def similar_many(v: Views) -> DataFrame:
    hits = similar.similar_many(v.obs_vec(), _questions(v))
    return hits.select("query_id", "rank", "obs_id", "score", F.array_join("matched_by", ",").alias("matched_by"), "ts", "kind", "excerpt", "origin_scope")


@query(_with([*_MANY, "got AS (SELECT DISTINCT query_id, unnest(entity_refs) AS e FROM best JOIN obs USING (obs_id))"], "SELECT query_id, fine AND (query_id, (query_id % 97)::VARCHAR) IN (SELECT query_id, e FROM got) AND (query_id % 3 > 0 OR (query_id, (query_id * 7 % 89)::VARCHAR) IN (SELECT query_id, e FROM got)) AS passed FROM asks"))
def eval_similar(v: Views) -> DataFrame:
    """Every question must name an entity of its own observation, every third one another too, by names that are known in
    each scope."""
    asked, i = _questions(v), F.col("query_id")
    name = lambda k, form="r%d.example.com": F.format_string(form, k)
    wanted = asked.select("query_id", F.explode(F.when(i % 3 == 0, F.array(name(i % 97, "R%d.Example.com."), name(i * 7 % 89))).otherwise(F.array(name(i % 97)))).alias("raw"))
    scopes = F.broadcast(v.spark.range(20).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("scope")))
    known = v.spark.range(97).select(F.col("id").cast("string").alias("entity_id"), F.lit("ioc_domain").alias("entity_type"), name(F.col("id")).alias("key"), F.lit("2024-01-01").cast("timestamp").alias("updated_at")).crossJoin(scopes)
    return ask(asked, wanted, v.obs_vec(), known).select("query_id", "passed")


_EVENTS_OBS = "SELECT obs_id AS id, 'observation' AS src, ts, kind, actor_type || ':' || actor_id AS actor, substr(content, 1, 200) AS txt, scope AS origin_scope FROM obs"
_EVENTS_FACT = "SELECT fact_id AS id, 'fact' AS src, valid_from AS ts, 'fact:' || predicate AS kind, written_by AS actor, predicate || ': ' || object_value AS txt, scope AS origin_scope FROM latest_facts"
_PAGE = "ORDER BY ts DESC, src, txt, id"


def _entities(v: Views) -> DataFrame:
    """Ids 0 to 96 as entities; those with equal remainder by 40 are siblings."""
    i = F.col("id")
    return v.spark.range(97).select(i.cast("string").alias("entity_id"), F.lit("host").alias("entity_type"), (i % 40).cast("string").alias("key"), F.concat(F.lit("src"), (i % 20).cast("string")).alias("scope"))


def _timeline(limit: int, offset: int) -> str:
    return sql(f"""SELECT * FROM ({_EVENTS_OBS} WHERE (scope = 'src5' OR confidentiality = 'internal') AND list_has_any(entity_refs, ['5', '45', '85'])
UNION ALL {_EVENTS_FACT} WHERE status <> 'retracted' AND (scope = 'src5' OR visibility = 'org') AND subject_id IN ('5', '45', '85')) {_PAGE} LIMIT {limit} OFFSET {offset}""")


@query(_timeline(200, 0))
def timeline_entity(v: Views) -> DataFrame:
    return timeline.timeline_entity(v.obs(), v.facts(), _entities(v), "src5", "45", 200, 0)


@query(_timeline(10, 15))
def timeline_page(v: Views) -> DataFrame:
    return timeline.timeline_entity(v.obs(), v.facts(), _entities(v), "src5", "45", 10, 15)


@query(sql(f"""SELECT id, src, ts, kind, actor, txt, origin_scope FROM (SELECT obs_id AS id, 'observation' AS src, ts, kind, actor_type || ':' || actor_id AS actor, substr(content, 1, 200) AS txt, 'team-' || right(scope, 1) AS origin_scope FROM obs WHERE case_id = '13' AND 'team-' || right(scope, 1) = 'team-3'
UNION ALL {_EVENTS_FACT} WHERE status <> 'retracted' AND scope = 'team-3' AND subject_id IN (SELECT id FROM (SELECT DISTINCT unnest(entity_refs) AS id FROM obs WHERE case_id = '13' AND 'team-' || right(scope, 1) = 'team-3') ORDER BY id LIMIT 200)) {_PAGE} LIMIT 500"""))
def timeline_case(v: Views) -> DataFrame:
    obs = v.obs().withColumn("scope", F.concat(F.lit("team-"), F.right("scope", F.lit(1))))
    return timeline.timeline_case(obs, v.facts(), "team-3", "13", 500, 0)


_STATE = f"state AS (SELECT src_id, dst_id, relation, valid_from, valid_to FROM (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY src_id, dst_id ORDER BY updated_at DESC, valid_to DESC, edge_id DESC) = 1) WHERE valid_to > {AS_OF_SQL})"
_LINKS = "links AS (SELECT src_id AS node, dst_id AS other, relation FROM state UNION ALL SELECT dst_id, src_id, relation FROM state)"


@query(_with([_STATE], "SELECT * FROM state"))
def graph_state_rebuild(v: Views) -> DataFrame:
    return graph.graph_state(v.edges(), as_of())


def _start(v: Views) -> DataFrame:
    return v.table("customer").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))


_START = "(SELECT c_custkey AS query_id, 'c' || c_custkey AS node FROM customer)"


@query(_with([_STATE, _LINKS], f"SELECT query_id, node, depth, path FROM (SELECT DISTINCT s.query_id, l.other AS node, 1 AS depth, s.node || '>' || l.other AS path FROM {_START} s JOIN links l ON l.node = s.node WHERE l.relation = 'rel_n') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY node) <= 100"))
def traverse_1hop(v: Views) -> DataFrame:
    g = graph.graph_state(v.edges(), as_of())
    return graph.walk(g, _start(v), 1, "rel_n").select("query_id", "node", "depth", F.array_join("path", ">").alias("path"))


@query(_with([_STATE, _LINKS, f"d1 AS (SELECT s.query_id, l.other AS node, [s.node, l.other] AS path FROM {_START} s JOIN links l ON l.node = s.node WHERE l.relation = 'rel_r' GROUP BY ALL)",
 f"d2 AS (SELECT d.query_id, l.other AS node, min(list_append(d.path, l.other)) AS path FROM d1 d JOIN links l ON l.node = d.node WHERE l.relation = 'rel_r' AND (d.query_id, l.other) NOT IN (SELECT query_id, node FROM d1) AND (d.query_id, l.other) NOT IN (SELECT query_id, node FROM {_START}) GROUP BY 1, 2)"],
 "SELECT query_id, node, depth, array_to_string(path, '>') AS path FROM (SELECT query_id, node, 1 AS depth, path FROM d1 UNION ALL SELECT query_id, node, 2, path FROM d2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY depth, node) <= 100"))
def traverse_bfs(v: Views) -> DataFrame:
    g = graph.graph_state(v.edges(), as_of())
    return graph.walk(g, _start(v), 2, "rel_r").select("query_id", "node", "depth", F.array_join("path", ">").alias("path"))


_FROM = "(SELECT s_suppkey AS query_id, 's' || s_suppkey AS node FROM supplier)"
_HOP = "SELECT d.query_id, l.other AS node, min(list_append(d.path, l.other)) AS path FROM {last} d JOIN links l ON l.node = d.node WHERE l.relation = 'rel_n' AND (d.query_id, l.other) NOT IN (SELECT query_id, node FROM {seen}) GROUP BY 1, 2"


@query(_with([_STATE, _LINKS, f"d0 AS (SELECT query_id, node, [node] AS path FROM {_FROM})", f"d1 AS ({_HOP.format(last='d0', seen='d0')})",
 "u1 AS (SELECT query_id, node FROM d0 UNION ALL SELECT query_id, node FROM d1)", f"d2 AS ({_HOP.format(last='d1', seen='u1')})",
 "u2 AS (SELECT query_id, node FROM u1 UNION ALL SELECT query_id, node FROM d2)", f"d3 AS ({_HOP.format(last='d2', seen='u2')})"],
 "SELECT query_id, node, depth, array_to_string(path, '>') AS path FROM (SELECT *, 1 AS depth FROM d1 UNION ALL SELECT *, 2 FROM d2 UNION ALL SELECT *, 3 FROM d3) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY depth, node) <= 2000"))
def traverse_3hops(v: Views) -> DataFrame:
    """From every supplier to its customers, their suppliers, and these suppliers' customers, up to 2,000 nodes."""
    start = v.table("supplier").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    paths = graph.walk(graph.graph_state(v.edges(), as_of()), start, 3, "rel_n", 2000)
    return paths.select("query_id", "node", "depth", F.array_join("path", ">").alias("path"))


@query(sql(f"""SELECT nid, relation, max(updated_at) AS ts, min(edge_id) AS ek FROM (SELECT dst_id AS nid, * FROM edges WHERE src_id IN ('s1', 's2') UNION ALL SELECT src_id AS nid, * FROM edges WHERE dst_id IN ('s1', 's2'))
WHERE valid_to > {AS_OF_SQL} AND relation = 'rel_r' GROUP BY 1, 2 ORDER BY ts DESC, ek LIMIT 100"""))
def neighbors_fallback(v: Views) -> DataFrame:
    return graph.neighbors_fallback(v.edges(), ["s1", "s2"], as_of(), "rel_r")


@query(sql("""SELECT edge_id, CASE WHEN sn AND dn THEN 'resolved' WHEN NOT se OR NOT de THEN 'orphan' ELSE 'deferrable' END AS outcome FROM (
SELECT edge_id, substr(src_id, 2)::INT % 3 <> 0 AS sn, substr(src_id, 2)::INT % 7 <> 0 OR substr(src_id, 2)::INT % 3 <> 0 AS se, substr(dst_id, 2)::INT % 4 <> 0 AS dn, substr(dst_id, 2)::INT % 5 <> 0 OR substr(dst_id, 2)::INT % 4 <> 0 AS de FROM edges)"""))
def edge_state_machine(v: Views) -> DataFrame:
    c, s = v.table("customer").select(F.col("c_custkey").alias("k")), v.table("supplier").select(F.col("s_suppkey").alias("k"))
    name = lambda df, p: df.select(F.concat(F.lit(p), F.col("k").cast("string")).alias("ch_id"))
    nodes = name(c.where("k % 3 <> 0"), "c").unionByName(name(s.where("k % 4 <> 0"), "s"))
    known = name(c.where("k % 7 <> 0 or k % 3 <> 0"), "c").unionByName(name(s.where("k % 5 <> 0 or k % 4 <> 0"), "s")).withColumnRenamed("ch_id", "entity_id")
    return graph.classify_edges(v.edges(), nodes, known).select("edge_id", "outcome")


@query(sql("SELECT predicate, count(*) AS n FROM facts GROUP BY predicate"))
def list_predicates(v: Views) -> DataFrame:
    return facts.list_predicates(v.facts())


@query(sql("SELECT obs_id, ts, scope FROM obs WHERE obs_id NOT IN (SELECT lpad(doc_id::VARCHAR, 9, '0') FROM labels) ORDER BY ts, obs_id LIMIT 32"))
def uncovered(v: Views) -> DataFrame:
    covered = v.table("labels").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("obs_id"))
    return uncovered_batch(v.obs(), covered).select("obs_id", "ts", "scope")


_EDGE_PAGE = sql(f"SELECT edge_id, updated_at FROM edges WHERE (updated_at, edge_id) > ({AS_OF_SQL}, '2') ORDER BY updated_at, edge_id LIMIT 500")


@query(_EDGE_PAGE)
def keyset_page_edges(v: Views) -> DataFrame:
    return keyset_page(v.edges(), "updated_at", "edge_id", as_of(), F.lit("2"), 500).select("edge_id", "updated_at")


@query(_EDGE_PAGE)
def keyset_page_ranged(v: Views) -> DataFrame:
    """The same page of a log that is laid out by time, which reads the files of its range alone."""
    log = RangedTable(v.spark, scratch(v.spark, "edge-log"), ["updated_at", "edge_id"], grows=True)
    log.write(v.edges(), parts=16)
    return log.page((AS_OF, "2"), 500).select("edge_id", "updated_at")


_ENDED_BY_NEXT = sql("""SELECT fact_id, status, valid_from, CASE WHEN status = 'active' THEN least(valid_to, coalesce(min(CASE WHEN status = 'active' THEN valid_from END) OVER (PARTITION BY scope, subject_id, predicate ORDER BY valid_from, fact_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), valid_to)) ELSE valid_to END AS valid_to FROM facts""")


@query(_ENDED_BY_NEXT.replace("PARTITION BY scope, subject_id, predicate", "PARTITION BY scope, predicate"))
def supersede_split(v: Views) -> DataFrame:
    """All facts told of one subject, in a few groups that are each cut into ranges of time."""
    rows = v.facts().withColumns({"subject_id": F.lit("s"), "closes": F.col("status") == "active"})
    return facts.supersede_split(rows, 400).select("fact_id", "status", "valid_from", "valid_to")


@query(_ENDED_BY_NEXT)
def supersede_batch(v: Views) -> DataFrame:
    return facts.supersede(v.facts().withColumn("closes", F.col("status") == "active")).select("fact_id", "status", "valid_from", "valid_to")


_AT = "TIMESTAMP '2027-01-01 00:00:00'"
_FACT = ["fact_id", "scope", "subject_id", "predicate", "object_value", "object_id", "status", "written_by", "valid_from", "valid_to", "updated_at", "visibility"]
_EDGE = ["edge_id", "scope", "src_id", "dst_id", "relation", "from_fact", "valid_from", "valid_to", "updated_at"]


def _plain(df: DataFrame, columns: list[str]) -> DataFrame:
    """Times without a zone, as DuckDB has them."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in ("valid_from", "valid_to", "updated_at") else F.col(c) for c in columns])


def _requests(v: Views) -> DataFrame:
    """Every fact, asked for by agents, humans, and some who don't say who they are."""
    k = F.col("fact_id").cast("long")
    return v.stored_facts().select("fact_id", F.when(k % 3 == 1, "agent").otherwise("human").alias("actor_type"), F.when(k % 17 == 0, " ").otherwise("u1").alias("actor_id"), F.lit("2027-01-01").cast("timestamp").alias("at"), F.concat(F.lit("  no. "), (k % 5).cast("string"), F.lit(" ")).alias("reason"))


_GATED = "f.fact_id::BIGINT % 3 = 1"
_ANON = "f.fact_id::BIGINT % 17 = 0"


def _errors(wrong: str) -> str:
    return sql(f"SELECT f.fact_id, CASE WHEN {_GATED} THEN 'HumanGated' WHEN {_ANON} THEN 'InvalidInput' WHEN l.fact_id IS NULL THEN 'NotFound' WHEN {wrong} THEN 'Conflict' ELSE 'ok' END AS outcome FROM stored f LEFT JOIN latest_stored l ON f.fact_id = l.fact_id")


def _outcomes(result, asked: DataFrame) -> DataFrame:
    return asked.join(result.rejects.select("fact_id", "error"), "fact_id", "left").select("fact_id", F.coalesce("error", F.lit("ok")).alias("outcome"))


def _promoted(v: Views):
    return facts.promote_facts(_requests(v).drop("reason"), v.stored_facts())


def _retracted(v: Views):
    return facts.retract_facts(_requests(v), v.stored_facts(), v.stored_edges())


_GOOD = f"SELECT * FROM latest_stored f WHERE NOT {_GATED} AND NOT {_ANON} AND "
_SAME = "scope, subject_id, predicate, object_value, object_id"


@query(_errors("l.status <> 'proposed'"))
def promote(v: Views) -> DataFrame:
    return _outcomes(_promoted(v), _requests(v))


@query(sql(f"SELECT {stable_id_sql(chr(39) + 'promoted' + chr(39), 'fact_id')} AS fact_id, {_SAME}, 'active' AS status, 'u1' AS written_by, {_AT} AS valid_from, TIMESTAMP '2105-12-31 23:59:59' AS valid_to, {_AT} AS updated_at, visibility FROM ({_GOOD} status = 'proposed') UNION ALL SELECT fact_id, {_SAME}, status, written_by, valid_from, {_AT}, updated_at, visibility FROM ({_GOOD} status = 'proposed')"))
def promote_rows(v: Views) -> DataFrame:
    return _plain(_promoted(v).facts, _FACT)


@query(sql(f"SELECT {stable_id_sql(chr(39) + 'promoted' + chr(39), 'fact_id')} AS target_id, 'promote_fact' AS operation, 'from=proposed to=active confidence=' || printf('%.2f', confidence::DOUBLE) || ' prior=' || fact_id || ' edge=' || CASE WHEN object_id IS NULL THEN 'n' ELSE 'y' END || ' vis=' || visibility AS payload_summary FROM ({_GOOD} status = 'proposed')"))
def promote_audit(v: Views) -> DataFrame:
    return _promoted(v).audit.select("target_id", "operation", "payload_summary")


@query(_errors("l.status = 'retracted'"))
def retract(v: Views) -> DataFrame:
    return _outcomes(_retracted(v), _requests(v))


@query(sql(f"SELECT {stable_id_sql(chr(39) + 'retracted' + chr(39), 'fact_id')} AS fact_id, {_SAME}, 'retracted' AS status, 'u1' AS written_by, {_AT} AS valid_from, {_AT} AS valid_to, {_AT} AS updated_at, visibility FROM ({_GOOD} status <> 'retracted') UNION ALL SELECT fact_id, {_SAME}, status, written_by, valid_from, {_AT}, updated_at, visibility FROM ({_GOOD} status <> 'retracted')"))
def retract_rows(v: Views) -> DataFrame:
    return _plain(_retracted(v).facts, _FACT)


@query(sql(f"SELECT {stable_id_sql(chr(39) + 'retracted' + chr(39), 'fact_id')} AS target_id, 'retract_fact' AS operation, 'from=' || status || ' reason=no. ' || (fact_id::BIGINT % 5) || ' prior=' || fact_id || ' edge=' || CASE WHEN object_id IS NULL THEN 'n' ELSE 'y' END || ' vis=' || visibility AS payload_summary FROM ({_GOOD} status <> 'retracted')"))
def retract_audit(v: Views) -> DataFrame:
    return _retracted(v).audit.select("target_id", "operation", "payload_summary")


@query(sql(f"SELECT edge_id, scope, src_id, dst_id, relation, from_fact, valid_from, {_AT} AS valid_to, {_AT} AS updated_at FROM stored_edges WHERE valid_to > {_AT} AND from_fact IN (SELECT fact_id FROM ({_GOOD} status <> 'retracted'))"))
def retract_edges(v: Views) -> DataFrame:
    return _plain(_retracted(v).edges, _EDGE)


@query(sql("SELECT fact_id, CASE WHEN fact_id::BIGINT % 2 = 0 THEN 'active' WHEN written_by IN ('w1', 'w3') AND confidence >= 0.5 THEN 'active' ELSE 'proposed' END AS trusted FROM facts"))
def trust_status(v: Views) -> DataFrame:
    actor = F.when(F.col("fact_id").cast("long") % 2 == 0, "human").otherwise("agent")
    return v.facts().select("fact_id", scores.trust_status(actor, F.col("written_by"), F.col("confidence"), ["w1", "w3"], 0.5).alias("trusted"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, s_acctbal / 5000)) END AS confidence FROM supplier")
def clamp_confidence(v: Views) -> DataFrame:
    raw = F.when(F.col("s_suppkey") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("s_acctbal") / 5000)
    return v.table("supplier").select("s_suppkey", scores.clamp_confidence(raw).alias("confidence"))


_OCT = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_LAB = "[a-z0-9]([a-z0-9-]*[a-z0-9])?"


def _norm(t: str) -> tuple[str, str]:
    """SQL for type and key of a name `t` without white space."""
    d = f"regexp_replace(lower({t}), '\\.$', '')"
    tech, hsh, ip = f"regexp_full_match({t}, '[Tt][0-9]{{4}}(\\.[0-9]{{3}})?')", f"regexp_full_match({t}, '([0-9a-fA-F]{{32}}|[0-9a-fA-F]{{40}}|[0-9a-fA-F]{{64}}|[0-9a-fA-F]{{128}})')", f"regexp_full_match({t}, '{_OCT}(\\.{_OCT}){{3}}')"
    dom = f"(regexp_full_match({d}, '{_LAB}(\\.{_LAB})+') AND regexp_matches(string_split({d}, '.')[-1], '[a-z]'))"
    kind = f"CASE WHEN {tech} THEN 'technique' WHEN {hsh} THEN 'ioc_hash' WHEN {ip} THEN 'ioc_ip' WHEN {dom} THEN 'ioc_domain' END"
    key = f"CASE WHEN {tech} THEN upper({t}) WHEN {hsh} THEN lower({t}) WHEN {ip} THEN {t} WHEN {dom} THEN {d} END"
    return kind, key


_T, _K = _norm("raw")
_HT, _ = _norm("string_split(tok, ':')[1]")
_CANDIDATES = f"""cand AS (SELECT obs_id, row_number() OVER (PARTITION BY obs_id ORDER BY place) AS pos, raw, {_T} AS type, {_K} AS entity_key FROM (
SELECT obs_id, raw, min(place) AS place FROM (SELECT obs_id, place, CASE WHEN regexp_full_match(tok, '[^:]+:[0-9]+') AND {_HT} IS NOT NULL THEN string_split(tok, ':')[1] ELSE tok END AS raw FROM (
SELECT obs_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS place FROM (SELECT obs_id, regexp_extract_all(content, '[A-Za-z0-9.:-]+') AS toks FROM obs))) GROUP BY obs_id, raw) WHERE {_T} IS NOT NULL QUALIFY pos <= 32)"""


@query(_with([_CANDIDATES], "SELECT obs_id, pos, raw, type, entity_key FROM cand"))
def entity_candidates(v: Views) -> DataFrame:
    return ent.entity_candidates(v.obs(), "obs_id")


_HOST = "regexp_extract(url, '://([^/?#]+)', 1)"


@query(f"SELECT page_id, type, key FROM (SELECT page_id, {_norm('h')[0]} AS type, {_norm('h')[1]} AS key FROM (SELECT page_id, regexp_replace({_HOST}, ':[0-9]+$', '') AS h FROM pages))")
def normalize_entities(v: Views) -> DataFrame:
    host = F.regexp_replace(F.regexp_extract("url", "://([^/?#]+)", 1), r":[0-9]+\z", "")
    n = v.table("pages").select("page_id", ent.normalize(host).alias("n"))
    return n.select("page_id", F.col("n.type").alias("type"), F.col("n.key").alias("key"))


@query("SELECT item_id, array_to_string(t[1:8], ' ') AS tokens FROM (SELECT item_id, list_transform(list_sort(list_transform(list_distinct(w), lambda x: list_position(w, x))), lambda i: w[i]) AS t FROM (SELECT item_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM benchmark))")
def query_tokens(v: Views) -> DataFrame:
    return v.table("benchmark").select("item_id", F.array_join(text.query_tokens(F.col("text")), " ").alias("tokens"))


@query(sql("SELECT obs_id, substr(content, 1, 200) AS excerpt FROM obs"))
def excerpt(v: Views) -> DataFrame:
    return v.obs().select("obs_id", text.excerpt(F.col("content")).alias("excerpt"))


_KNOWN = "known AS (SELECT DISTINCT scope, type, entity_key, 'k-' || scope || '-' || type || '-' || entity_key AS entity_id FROM cand JOIN obs USING (obs_id) WHERE obs_id::BIGINT % 2 = 0)"


@query(_with([_CANDIDATES, _KNOWN], f"SELECT o.scope, c.type AS entity_type, c.entity_key AS key, coalesce(any_value(k.entity_id), {stable_id_sql(chr(39) + 'entity' + chr(39), 'o.scope', 'c.type', 'c.entity_key')}) AS entity_id, count(*) AS n, bool_or(k.entity_id IS NOT NULL) AS hit FROM cand c JOIN obs o USING (obs_id) LEFT JOIN known k ON k.scope = o.scope AND k.type = c.type AND k.entity_key = c.entity_key GROUP BY 1, 2, 3"))
def resolve_batch(v: Views) -> DataFrame:
    """The store knows what observations with even numbers name; others are resolved to that, or created."""
    found = materialise(ent.entity_candidates(v.obs(), "obs_id").join(v.obs().select("obs_id", "scope"), "obs_id"), "candidates")
    known = found.where("cast(obs_id AS long) % 2 = 0").select("scope", F.col("type").alias("entity_type"), F.col("entity_key").alias("key")).distinct()
    then = F.lit("2023-01-01").cast("timestamp")
    known = known.select(F.concat_ws("-", F.lit("k"), "scope", "entity_type", "key").alias("entity_id"), "scope", "entity_type", "key", F.col("key").alias("display_name"), F.create_map().cast("map<string,string>").alias("attrs"), then.alias("first_seen"), then.alias("last_seen"), then.alias("updated_at"))
    raws = found.select("scope", F.concat_ws("-", "obs_id", "pos").alias("pos"), "raw", F.col("type").alias("entity_type"), F.col("entity_key").alias("key"))
    resolved, delta = observations.resolve_batch(raws, known, F.lit("2024-01-01").cast("timestamp"))
    n = resolved.where("entity_id is not null").groupBy("scope", "entity_type", "key").agg(F.count("*").alias("n"))
    hit = F.col("first_seen") < F.col("last_seen")
    return delta.select("scope", "entity_type", "key", "entity_id", hit.alias("hit")).join(n, ["scope", "entity_type", "key"])


_TAKEN = "taken AS (SELECT *, CASE WHEN obs_id::BIGINT % 13 = 0 THEN 'nonsense' ELSE kind END AS k, octet_length(encode(content)) AS bytes FROM obs)"


@query(_with([_CANDIDATES, _TAKEN], f"SELECT {stable_id_sql(chr(39) + 'obs' + chr(39), 'scope', 'actor_id', 't.obs_id', 'NULL')} AS obs_id, k AS kind, ts, coalesce(n, 0) AS refs, 'kind=' || k || ' entities=' || coalesce(n, 0) || ' chars=' || length(content) AS payload_summary FROM taken t LEFT JOIN (SELECT obs_id, count(*) AS n FROM cand GROUP BY 1) c ON t.obs_id = c.obs_id WHERE scope IS NOT NULL AND k <> 'nonsense' AND regexp_matches(content, '[^\\s]') AND bytes <= 10000"))
def record_batch(v: Views) -> DataFrame:
    """Every document recorded; some have a kind that isn't known, others are blank or too long."""
    o = v.obs()
    i = F.col("obs_id").cast("long")
    asked = o.select("scope", F.when(i % 13 == 0, "nonsense").otherwise(F.col("kind")).alias("kind"), "actor_type", "actor_id", F.lit(None).cast("string").alias("on_behalf_of"), F.lit(None).cast("string").alias("case_id"), F.col("obs_id").alias("client_event_id"), F.lit(None).cast("string").alias("confidentiality"), F.col("ts").cast("timestamp").alias("ts"), "content")
    none = v.spark.createDataFrame([], ENTITIES)
    r = observations.record_observations(asked, none, F.lit("2024-01-01").cast("timestamp"))
    told = r.audit.select(F.col("target_id").alias("obs_id"), "payload_summary")
    return r.observations.select("obs_id", "kind", F.col("ts").cast("timestamp_ntz").alias("ts"), F.size("entity_refs").cast("long").alias("refs")).join(told, "obs_id")


@query(_with([_CANDIDATES], "SELECT o.obs_id, 'kind=' || kind || ' entities=' || coalesce(n, 0) || ' chars=' || length(content) AS payload_summary FROM obs o LEFT JOIN (SELECT obs_id, count(*) AS n FROM cand GROUP BY 1) c ON o.obs_id = c.obs_id"))
def audit_summary(v: Views) -> DataFrame:
    n = ent.entity_candidates(v.obs(), "obs_id").groupBy("obs_id").agg(F.count("*").alias("n"))
    rows = v.obs().join(n, "obs_id", "left")
    s = F.format_string("kind=%s entities=%d chars=%d", F.col("kind"), F.coalesce("n", F.lit(0)), F.length("content"))
    return facts.audit_rows(rows, "record_observation", "observations", "obs_id", s, F.col("ts")).select(F.col("target_id").alias("obs_id"), "payload_summary")


@query(sql("SELECT count(*) FILTER (ok) AS passed, count(*) AS total, avg(ok::INT::DOUBLE) AS score FROM (SELECT obs_id, list_contains(entity_refs, (obs_id::BIGINT % 97)::VARCHAR) AND list_contains(entity_refs, ((obs_id::BIGINT * 3) % 89)::VARCHAR) AS ok FROM obs)"))
def eval_recall(v: Views) -> DataFrame:
    """A question for each observation, which must name two entities."""
    i = F.col("obs_id").cast("long")
    asked = v.obs().select(F.col("obs_id").alias("query_id"), F.explode(F.array((i % 97).cast("string"), ((i * 3) % 89).cast("string"))).alias("entity_id"))
    return recall(v.obs().select(F.col("obs_id").alias("query_id"), F.col("entity_refs").alias("entity_ids")), asked)


@query("SELECT 'accepted' AS outcome, count(*) AS n FROM documents WHERE doc_id % 4 < 2 UNION ALL SELECT 'rejected', count(*) FROM documents WHERE doc_id % 4 = 2")
def ingest_rejects(v: Views) -> DataFrame:
    i = F.col("doc_id") % 4
    line = F.to_json(F.struct(F.lit("2024-01-01T00:00:00Z").alias("ts"), F.lit("alert").alias("kind"), F.lit("human").alias("actor_type"), F.lit("a").alias("actor_id"), F.col("source").alias("scope"), F.col("text").alias("content")))
    value = F.when(i < 2, line).when(i == 2, F.lit("{not json")).otherwise(F.lit("# comment"))
    good, bad = parse_lines(v.table("documents").select(value.alias("value")), OBSERVATION_LINES)
    return dry_run(good, bad)


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'host' || p_partkey || '.example.com' END AS subject, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE least(1.0, p_size / 40.0)::DOUBLE END AS confidence FROM part")
def sanitize_model_output(v: Views) -> DataFrame:
    """Fences, a thought, and an array of which two of four items are valid; every fifth text has no array."""
    item = lambda s, p, o, c: F.format_string('{"subject":"%s","predicate":"%s","object_value":"%s","confidence":%s}', s, F.lit(p), o, c.cast("string"))
    host, name, c = F.format_string("HOST%d.Example.com.", F.col("p_partkey")), F.col("p_brand"), F.col("p_size") / 40
    said = F.concat(F.lit("<think>[maybe]</think>Here:\n```json\n["), F.concat_ws(",", item(host, "seen_on", name, c), item(F.lit("hello world"), "seen_on", name, c), item(host, "Bad Name", name, c), item(F.lit("10.0.0.1"), "kind_of", name, c)), F.lit("]\n```"))
    said = F.when(F.col("p_partkey") % 5 == 0, "nothing found").otherwise(said)
    items = v.table("part").select("p_partkey", sanitize_proposals(parse_proposals(said)).alias("p"))
    first = F.get("p", F.lit(0))
    return items.select("p_partkey", F.size("p").alias("n"), first["subject"].alias("subject"), first["confidence"].alias("confidence"))


@query(sql(f"SELECT obs_id, ts, kind, src FROM (SELECT obs_id, ts, kind, 'observation' AS src FROM obs UNION ALL SELECT 't' || conv_id || '-' || turn, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id * 60 + turn), role, 'turn' FROM conversations) ORDER BY ts DESC, src, kind, obs_id LIMIT 100 OFFSET 20"))
def union_events(v: Views) -> DataFrame:
    turns = v.table("conversations").selectExpr("concat('t', conv_id, '-', turn) AS obs_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(conv_id * 60 + turn AS int)) AS ts", "role AS kind", "'turn' AS src")
    both = v.obs().select("obs_id", "ts", "kind", F.lit("observation").alias("src")).unionByName(turns)
    return both.orderBy(F.col("ts").desc(), "src", "kind", "obs_id").offset(20).limit(100)


def _asserted(v: Views):
    """A new fact for each scope, subject and predicate, and another a year later for every second subject; a third of the
    first ones name an object."""
    k = F.col("subject_id").cast("long")
    groups = v.stored_facts().select("scope", "subject_id", "predicate").distinct()
    said = F.explode(F.when(k % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("turn")
    new = groups.select("*", said).select("scope", "subject_id", "predicate", F.concat(F.lit("N"), F.col("turn").cast("string")).alias("object_value"), F.when((k % 3 == 0) & (F.col("turn") == 1), F.concat(F.lit("t"), (k % 13).cast("string"))).alias("object_id"), F.lit(0.9).alias("confidence"), F.lit(None).cast("string").alias("source_obs"), F.lit("human").alias("actor_type"), F.lit("u1").alias("actor_id"), F.lit(None).cast("string").alias("visibility"), F.make_timestamp_ltz(F.col("turn") + 2029, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("asserted_at"))
    return facts.assert_facts(new, v.stored_facts(), v.stored_edges(), ids=False)


_Y1, _Y2, _EVER = "TIMESTAMP '2030-01-01'", "TIMESTAMP '2031-01-01'", "TIMESTAMP '2105-12-31 23:59:59'"
_NEW_ID = stable_id_sql("'fact'", "scope", "subject_id", "predicate", "object_value", "'u1'", "strftime(valid_from, '%Y-%m-%d %H:%M:%S')")
_NEW = f"""new AS (SELECT *, {_NEW_ID} AS fact_id FROM (SELECT scope, subject_id, predicate, 'N' || turn AS object_value, CASE WHEN subject_id::BIGINT % 3 = 0 AND turn = 1 THEN 't' || (subject_id::BIGINT % 13) END AS object_id, CASE turn WHEN 1 THEN {_Y1} ELSE {_Y2} END AS valid_from,
 CASE WHEN turn = 1 AND subject_id::BIGINT % 2 = 0 THEN {_Y2} ELSE {_EVER} END AS valid_to, turn FROM (SELECT DISTINCT scope, subject_id, predicate FROM stored) g JOIN (SELECT unnest([1, 2]) AS turn) t ON turn = 1 OR subject_id::BIGINT % 2 = 0))"""
_ENDED = f"ended AS (SELECT * FROM latest_stored WHERE status = 'active' AND valid_to > {_Y1})"


@query(_with([_NEW, _ENDED], f"SELECT fact_id, {_SAME}, 'active' AS status, 'u1' AS written_by, valid_from, valid_to, valid_from AS updated_at, 'org' AS visibility FROM new UNION ALL SELECT fact_id, {_SAME}, status, written_by, valid_from, {_Y1}, updated_at, visibility FROM ended"))
def assert_batch(v: Views) -> DataFrame:
    return _plain(_asserted(v).facts, _FACT)


@query(_with([_NEW], f"SELECT {stable_id_sql(chr(39) + 'edge' + chr(39), 'fact_id')} AS edge_id, scope, subject_id AS src_id, object_id AS dst_id, predicate AS relation, fact_id AS from_fact, valid_from, valid_to, CASE WHEN valid_to < {_EVER} THEN valid_to ELSE valid_from END AS updated_at FROM new WHERE object_id IS NOT NULL UNION ALL SELECT edge_id, scope, src_id, dst_id, relation, from_fact, valid_from, {_Y1}, {_Y1} FROM stored_edges WHERE valid_to > {_Y1}"))
def assert_edges(v: Views) -> DataFrame:
    return _plain(_asserted(v).edges, _EDGE)


@query(_with([_NEW, _ENDED], "SELECT fact_id AS target_id, 'status=active confidence=0.90 superseded=' || CASE turn WHEN 1 THEN (SELECT count(*) FROM ended e WHERE e.scope = n.scope AND e.subject_id = n.subject_id AND e.predicate = n.predicate) ELSE 1 END || ' edge=' || CASE WHEN object_id IS NULL THEN 'n' ELSE 'y' END || ' vis=org' AS payload_summary FROM new n"))
def assert_audit(v: Views) -> DataFrame:
    return _asserted(v).audit.select("target_id", "payload_summary")


_AGAIN_ID = stable_id_sql("'edge'", stable_id_sql("'fact'", "scope", "src_id", "relation", "'again'", "'u1'", "'2030-01-01 00:00:00'"))


@query(_with([f"applied AS (SELECT edge_id, src_id, dst_id, relation, least(valid_to, {_Y1}) AS valid_to, CASE WHEN valid_to > {_Y1} THEN {_Y1} ELSE updated_at END AS updated_at FROM stored_edges UNION ALL SELECT {_AGAIN_ID}, src_id, dst_id, relation, {_EVER}, {_Y1} FROM (SELECT scope, src_id, relation, min(dst_id) AS dst_id FROM stored_edges GROUP BY ALL))"],
 "SELECT via, src_id, dst_id, relation FROM (SELECT * FROM applied QUALIFY row_number() OVER (PARTITION BY src_id, dst_id ORDER BY updated_at DESC, valid_to DESC, edge_id DESC) = 1), (SELECT unnest(['state', 'rebuild']) AS via) WHERE valid_to > TIMESTAMP '2030-06-01'"))
def assert_graph(v: Views) -> DataFrame:
    """The graph after each source and relation was told again that it has its first object: that edge ended, and began
    anew, at one time. By state, and rebuilt."""
    edges = v.stored_edges()
    groups = edges.groupBy("scope", F.col("src_id").alias("subject_id"), F.col("relation").alias("predicate")).agg(F.min("dst_id").alias("object_id"))
    none = F.lit(None).cast("string")
    new = groups.select("scope", "subject_id", "predicate", F.lit("again").alias("object_value"), "object_id", F.lit(0.9).alias("confidence"), none.alias("source_obs"), F.lit("human").alias("actor_type"), F.lit("u1").alias("actor_id"), none.alias("visibility"), F.lit("2030-01-01").cast("timestamp").alias("asserted_at"))
    applied = materialise(facts.assert_facts(new, v.stored_facts(), edges, ids=False).applied_edges(edges), "applied")
    then = F.lit("2030-06-01").cast("timestamp")
    ids = applied.select(F.col("src_id").alias("entity_id")).union(applied.select("dst_id")).distinct()
    known = ids.select("entity_id", F.lit("a").alias("scope"), F.col("entity_id").alias("key"), F.lit("x").alias("entity_type"), F.lit("").alias("display_name"), then.alias("first_seen"), then.alias("last_seen"), then.alias("updated_at"))
    told = lambda df, via: df.select(F.lit(via).alias("via"), "src_id", "dst_id", "relation")
    return told(graph.graph_state(applied, then), "state").unionByName(told(graph.rebuild(known, applied, then).edges, "rebuild"))


_HOST_OK = "c_custkey % 7 <> 0 AND c_custkey % 5 <> 1"


@query(_with([_STATE, _LINKS], f"""SELECT query_id, node, depth, a || '>' || b AS keys FROM (SELECT query_id, node, 1 AS depth, start, row_number() OVER (PARTITION BY query_id ORDER BY node) AS n FROM (SELECT DISTINCT c_custkey AS query_id, 'c' || c_custkey AS start, other AS node FROM customer JOIN links ON links.node = 'c' || c_custkey WHERE relation = 'rel_n' AND {_HOST_OK}))
JOIN (SELECT entity_id, key AS a FROM entities) x ON x.entity_id = start JOIN (SELECT entity_id, key AS b FROM entities) y ON y.entity_id = node WHERE n <= 100"""))
def traverse(v: Views) -> DataFrame:
    """From every customer's host name, asked for as it may be written; some ask for a type that it doesn't have."""
    k = F.col("c_custkey")
    kind = F.when(k % 5 == 1, "ioc_ip").when(k % 5 == 2, "ioc_domain")
    asked = v.table("customer").select(k.alias("query_id"), F.lit("team-0").alias("caller"), F.concat(F.lit(" C"), k.cast("string"), F.lit(".Example.com. ")).alias("key"), kind.alias("type"))
    paths = graph.traverse(asked, v.entities(), graph.graph_state(v.edges(), as_of()), graph.vertices(v.entities()), "rel_n", 1)
    return paths.select("query_id", "node", "depth", F.array_join("keys", ">").alias("keys"))


_BOTH = f"SELECT src_id, dst_id, relation, edge_id FROM (SELECT * FROM edges WHERE src_id IN (SELECT entity_id FROM entities) AND dst_id IN (SELECT entity_id FROM entities) QUALIFY row_number() OVER (PARTITION BY src_id, dst_id ORDER BY updated_at DESC, valid_to DESC, edge_id DESC) = 1) WHERE valid_to > {AS_OF_SQL}"


def _stored_links(v: Views) -> DataFrame:
    return v.edges().withColumns({c: F.col(c).cast("timestamp") for c in ("valid_from", "valid_to", "updated_at")})


def _projected(v: Views):
    """Three pages of edges, and as large ones of entities."""
    entities, links = v.entities(), materialise(_stored_links(v).dropDuplicates(["edge_id"]), "links")
    none = graph.Projection(graph.vertices(entities).limit(0), links.limit(0), graph.cursor_start(), graph.cursor_start())
    return graph.drain(none, entities, links, as_of().cast("timestamp"), max(graph.PAGE, links.count() // 2 + 1))


@query(sql(_BOTH))
def graph_projection(v: Views) -> DataFrame:
    return _projected(v)[0].edges.select("src_id", "dst_id", "relation", "edge_id")


@query(sql("SELECT (SELECT count(*) FROM entities) AS entities, count(*) FILTER (ok) AS processed, count(*) FILTER (NOT ok) AS orphans, 0::BIGINT AS deferred FROM (SELECT DISTINCT edge_id, src_id IN (SELECT entity_id FROM entities) AND dst_id IN (SELECT entity_id FROM entities) AS ok FROM edges)"))
def projection_counts(v: Views) -> DataFrame:
    done = _projected(v)[2]
    return v.spark.createDataFrame([tuple(done.values())], ", ".join(f"{k} long" for k in done))


@query(sql(_BOTH))
def graph_rebuild(v: Views) -> DataFrame:
    return graph.rebuild(v.entities(), _stored_links(v), as_of().cast("timestamp")).edges.select("src_id", "dst_id", "relation", "edge_id")


@query(sql(f"SELECT edge_id FROM edges WHERE relation = 'rel_r' AND length(edge_id) % 5 <> 0 AND (length(edge_id) % 7 = 0 OR valid_from <= {AS_OF_SQL}) AND valid_to > {AS_OF_SQL}"))
def facet_edges(v: Views) -> DataFrame:
    """Edges whose facets are texts: some ends are no times, some beginnings are missing."""
    n = F.length("edge_id")
    stamp = lambda c: text.rfc3339(F.col(c).cast("timestamp"))
    texts = v.edges().select("edge_id", "relation", F.when(n % 7 == 0, "").otherwise(stamp("valid_from")).alias("valid_from"), F.when(n % 5 == 0, "soon").otherwise(stamp("valid_to")).alias("valid_to"))
    return texts.where(graph.facet_ok(as_of().cast("timestamp"), "rel_r")).select("edge_id")


@query(sql("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 OR x.entity_id IS NULL OR y.entity_id IS NULL THEN 'rejected' ELSE 'accepted' END AS outcome, CASE WHEN o_orderkey % 9 <> 0 AND y.entity_id IS NOT NULL THEN x.entity_id END AS subject_id FROM orders LEFT JOIN entities x ON x.entity_id = 'c' || o_custkey AND x.scope = 'team-' || (o_custkey % 3) LEFT JOIN entities y ON y.entity_id = 's' || (1 + o_orderkey % 9)"))
def ingest_facts(v: Views) -> DataFrame:
    """A line of JSON for each order; some are broken, some name what isn't known."""
    k = F.col("o_orderkey")
    host = lambda letter, n: F.concat(F.lit(letter), n.cast("string"), F.lit(".example.com"))
    team = F.concat(F.lit("team-"), (F.col("o_custkey") % 3).cast("string"))
    fields = F.struct(team.alias("scope"), host("c", F.col("o_custkey")).alias("subject_key"), F.lit("uses").alias("predicate"), k.cast("string").alias("object_value"), host("s", 1 + k % 9).alias("object_key"))
    lines = v.table("orders").select(F.when(k % 9 == 0, "{broken").otherwise(F.to_json(fields)).alias("value"), k)
    good, _ = parse_lines(lines.drop("o_orderkey"), FACT_LINES)
    everywhere = v.entities().select("entity_id", "entity_type", "key", "display_name", "attrs", "first_seen", "last_seen", "updated_at").crossJoin(F.broadcast(v.spark.range(3).select(F.concat(F.lit("team-"), F.col("id").cast("string")).alias("scope"))))
    mine = everywhere.where("entity_id like 's%'").unionByName(v.entities().where("entity_id like 'c%'"))
    done, _ = resolve_facts(good, mine)
    done = done.select(F.col("object_value").cast("long").alias("o_orderkey"), "subject_id")
    return v.table("orders").select("o_orderkey").join(done, "o_orderkey", "left").select("o_orderkey", F.when(F.col("subject_id").isNull(), "rejected").otherwise("accepted").alias("outcome"), "subject_id")


_UUID = r"regexp_replace(md5(doc_id::VARCHAR), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5')"


@query(rf"SELECT doc_id, 'a ' || doc_id || chr(160) || 'b' AS trimmed, CASE WHEN doc_id % 5 < 4 THEN {_UUID} END AS id, substr(regexp_replace(coalesce(text, ''), '^[\s]+|[\s]+$', '', 'g'), 1, 120) AS reason, TIMESTAMP '2024-01-01 00:00:00' + to_milliseconds(doc_id) AS at, '2024-01-01T00:00:' || lpad((doc_id % 60)::VARCHAR, 2, '0') || 'Z' AS stamp FROM documents")
def text_functions(v: Views) -> DataFrame:
    """White space of all kinds at either end, ids in all their forms and a wrong one, reasons, and times to the millisecond."""
    k = F.col("doc_id")
    digits, plain = F.md5(k.cast("string")), F.regexp_replace(F.md5(k.cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    form = F.when(k % 5 == 0, F.concat(F.lit("{"), F.upper(plain), F.lit("}"))).when(k % 5 == 1, F.concat(F.lit("urn:uuid:"), plain)).when(k % 5 == 2, digits).when(k % 5 == 3, plain).otherwise(F.concat(digits, F.lit("0")))
    told = F.concat(F.lit("\t\u00a0 a "), k.cast("string"), F.lit("\u00a0b\u2003\n"))
    return v.table("documents").select(
        "doc_id", text.trim(told).alias("trimmed"), text.canonical_uuid(form).alias("id"), text.reason(F.coalesce("text", F.lit(""))).alias("reason"),
        text.to_millis(F.timestamp_millis(F.lit(1704067200000) + k) + F.make_interval(secs=F.lit("0.000007").cast("decimal(18,6)"))).cast("timestamp_ntz").alias("at"),
        text.rfc3339(F.timestamp_seconds(F.lit(1704067200) + k % 60)).alias("stamp"),
    )


_SCOPED = "scoped AS (SELECT entity_id, scope, entity_type, key FROM entities UNION ALL SELECT 'x' || entity_id, 'team-9', entity_type, key FROM entities WHERE entity_id LIKE '%2')"


@query(_with([_SCOPED], "SELECT query_id, entity_id, scope AS origin_scope, key FROM (SELECT c_custkey AS query_id, CASE WHEN c_custkey % 2 = 0 THEN 'team-9' ELSE 'team-1' END AS caller, 'c' || c_custkey || '.example.com' AS k FROM customer) q JOIN scoped s ON s.key = q.k QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY (scope = caller) DESC, scope, entity_id) = 1"))
def enrich_entity(v: Views) -> DataFrame:
    """The entity of each customer's host name: the caller's own, or else that of the least scope."""
    e = v.entities()
    more = e.where("entity_id like '%2'").withColumns({"entity_id": F.concat(F.lit("x"), "entity_id"), "scope": F.lit("team-9")})
    k = F.col("c_custkey")
    asked = v.table("customer").select(k.alias("query_id"), F.when(k % 2 == 0, "team-9").otherwise("team-1").alias("caller"), F.format_string("C%d.EXAMPLE.com.", k).alias("key"), F.lit(None).cast("string").alias("type"))
    known = enrich.enrich(asked, e.unionByName(more), v.stored_facts(), v.obs().limit(0), v.stored_edges(), as_of().cast("timestamp"))
    return known.entity.select("query_id", "entity_id", "origin_scope", "key")


@query("SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 'scope is blank' WHEN 1 THEN 'subject_id is no id' WHEN 2 THEN 'predicate is blank' WHEN 3 THEN 'object_value is blank' WHEN 4 THEN 'a field is too long' WHEN 5 THEN 'object_id is no id' WHEN 6 THEN 'actor_type is unknown' WHEN 7 THEN 'actor_id is blank' WHEN 8 THEN 'visibility is unknown' END AS error FROM orders")
def validate_facts(v: Views) -> DataFrame:
    """A fact of each order, most of them with a rule broken."""
    k = F.col("o_orderkey")
    uuid = text.stable_id(k)
    unless = lambda n, good, bad: F.when(k % 10 == n, F.lit(bad)).otherwise(good)
    rows = v.table("orders").select(
        k, unless(0, F.lit("t"), " \t").alias("scope"), unless(1, uuid, "s1").alias("subject_id"), unless(2, F.lit("is"), "").alias("predicate"), F.when(k % 10 == 4, F.repeat(F.lit("é"), F.lit(1001))).otherwise(unless(3, F.lit("v"), " ")).alias("object_value"),
        unless(5, uuid, "x").alias("object_id"), F.lit(None).cast("string").alias("source_obs"), unless(6, F.lit("agent"), "cat").alias("actor_type"), unless(7, F.lit("u"), "").alias("actor_id"), unless(8, F.lit("org"), "all").alias("visibility"),
    )
    return facts.check_assertions(rows).select("o_orderkey", "error")


@query("SELECT n_nationkey, '<memory-context>' || chr(10) || 'nations' || chr(10) || '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' || chr(10) || '</memory-context>' AS context FROM nation")
def fenced_results(v: Views) -> DataFrame:
    return v.table("nation").select("n_nationkey", text.memory_context("nations", F.struct("n_nationkey", "n_name")).alias("context"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that observations name, each with how many name it and the latest that does."""
    v = Views(spark, sf_dir)
    rows = ent.entity_candidates(v.obs(), "obs_id").join(v.obs().select("obs_id", "ts", "scope"), "obs_id")
    last = Window.partitionBy("type", "entity_key").orderBy(F.col("ts").desc(), "obs_id")
    n = F.count("*").over(Window.partitionBy("type", "entity_key"))
    return rows.withColumn("n", n).withColumn("r", F.row_number().over(last)).where("r = 1").select("type", "entity_key", "n", F.col("obs_id").alias("last_obs"), "ts", F.col("scope").alias("origin_scope"))

