"""The store's relations derived from the driver's tables, the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.schemas import KINDS

FOREVER = "timestamp_ntz'2105-12-31 23:59:59'"


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def obs(self) -> DataFrame:
        i = F.col("doc_id")
        kinds = F.array(*[F.lit(k) for k in KINDS])
        return self.table("documents").select(
            F.lpad(i.cast("string"), 9, "0").alias("obs_id"),
            F.col("source").alias("scope"),
            F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(doc_id AS int))").alias("ts"),
            F.element_at(kinds, (i % 6 + 1).cast("int")).alias("kind"),
            F.lit("human").alias("actor_type"),
            F.concat(F.lit("a"), (i % 11).cast("string")).alias("actor_id"),
            F.when(i % 7 != 0, (i % 50).cast("string")).alias("case_id"),
            F.when(i % 10 == 0, "restricted").otherwise("internal").alias("confidentiality"),
            F.col("text").alias("content"),
            F.array((i % 97).cast("string"), (i % 89).cast("string")).alias("entity_refs"),
        )

    def obs_vec(self) -> DataFrame:
        e = self.table("embeddings").select(F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("obs_id"), F.col("embedding").alias("content_vec"))
        return self.obs().join(e, "obs_id", "left")

    def entity_versions(self) -> DataFrame:
        return self.table("events").select(
            F.concat_ws("-", F.lit("e"), F.pmod("user_id", F.lit(3)).cast("string"), "event_type", F.col("user_id").cast("string")).alias("entity_id"),
            F.concat(F.lit("team-"), F.pmod("user_id", F.lit(3)).cast("string")).alias("scope"),
            F.col("event_type").alias("entity_type"),
            F.col("user_id").cast("string").alias("key"),
            F.col("ts").alias("updated_at"),
            F.col("event_id").cast("string").alias("version_id"),
            F.col("value"),
        )

    def entities(self) -> DataFrame:
        """Customers and suppliers as domains, each in one scope of three; some of either aren't known."""

        def some(table: str, column: str, letter: str, gap: int) -> DataFrame:
            k = F.col(column)
            at = F.expr("timestamp'1996-01-01 00:00:00'") + F.make_interval(mins=(k % 1000).cast("int"))
            t = self.table(table).where(k % gap != 0)
            name = F.concat(F.lit(letter), k.cast("string"))
            host = F.concat(name, F.lit(".example.com"))
            return t.select(name.alias("entity_id"), F.concat(F.lit("team-"), (k % 3).cast("string")).alias("scope"), F.lit("ioc_domain").alias("entity_type"), host.alias("key"), host.alias("display_name"), F.create_map().cast("map<string,string>").alias("attrs"), at.alias("first_seen"), at.alias("last_seen"), at.alias("updated_at"))

        return some("customer", "c_custkey", "c", 7).unionByName(some("supplier", "s_suppkey", "s", 5))

    def stored_facts(self) -> DataFrame:
        """facts with objects for every third, and ends that are past for some and still to come for others."""
        k = F.col("fact_id").cast("long")
        end = F.when(k % 11 == 0, F.lit("2025-01-01").cast("timestamp")).when(k % 7 == 0, F.lit("2035-01-01").cast("timestamp")).otherwise(F.lit("2105-12-31 23:59:59").cast("timestamp"))
        f = self.facts().withColumns({c: F.col(c).cast("timestamp") for c in ("valid_from", "updated_at")} | {"valid_to": end, "confidence": F.col("confidence").cast("float")})
        return f.withColumn("object_id", F.when(k % 3 == 0, F.concat(F.lit("x"), (k % 50).cast("string"))))

    def stored_edges(self) -> DataFrame:
        """An edge of each active fact of stored_facts with an object."""
        f = self.stored_facts().where("status = 'active' and object_id is not null")
        return f.select(F.concat(F.lit("e"), "fact_id").alias("edge_id"), "scope", F.col("subject_id").alias("src_id"), F.col("object_id").alias("dst_id"), F.col("predicate").alias("relation"), F.col("fact_id").alias("from_fact"), "valid_from", "valid_to", F.col("valid_from").alias("updated_at"))

    def facts(self) -> DataFrame:
        return self.table("orders").select(
            F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("fact_id"),
            F.concat(F.lit("team-"), (F.col("o_orderkey") % 4).cast("string")).alias("scope"),
            F.col("o_custkey").cast("string").alias("subject_id"),
            F.regexp_replace(F.lower("o_orderpriority"), "[^a-z0-9]+", "_").alias("predicate"),
            F.col("o_orderstatus").alias("object_value"),
            F.when(F.col("o_orderstatus") == "P", "proposed").otherwise("active").alias("status"),
            # DuckDB rounds the double, Spark its shortest digits: these differ where they end in a five.
            (F.round(F.col("o_totalprice") / 500000 * 1e6) / 1e6).alias("confidence"),
            F.lit("seed").alias("source_obs"),
            F.concat(F.lit("w"), (F.col("o_orderkey") % 5).cast("string")).alias("written_by"),
            F.col("o_orderdate").alias("valid_from"),
            F.expr(FOREVER).alias("valid_to"),
            F.col("o_orderdate").alias("updated_at"),
            F.when(F.col("o_orderkey") % 5 == 0, "scope").otherwise("org").alias("visibility"),
        )

    def edges(self) -> DataFrame:
        # One row an order and line: the join is on the orders' key, which both tables spread evenly.
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        li = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate")
        j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
        return j.select(
            F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("edge_id"),
            F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src_id"),
            F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst_id"),
            F.concat(F.lit("rel_"), F.lower("l_returnflag")).alias("relation"),
            F.col("o_orderdate").alias("valid_from"),
            F.when(F.col("l_shipdate") > F.col("o_orderdate"), F.col("l_shipdate")).otherwise(F.expr(FOREVER)).alias("valid_to"),
            F.greatest("o_orderdate", "l_shipdate").alias("updated_at"),
        )


#: DuckDB: the same relations as common table expressions.
_OBS = """obs AS (SELECT lpad(doc_id::VARCHAR, 9, '0') AS obs_id, source AS scope, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS ts,
 ['alert','triage_decision','investigation_note','hunt_finding','agent_action','human_statement'][doc_id % 6 + 1] AS kind, 'human' AS actor_type, 'a' || (doc_id % 11) AS actor_id,
 CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 50)::VARCHAR END AS case_id, CASE WHEN doc_id % 10 = 0 THEN 'restricted' ELSE 'internal' END AS confidentiality, text AS content,
 [(doc_id % 97)::VARCHAR, (doc_id % 89)::VARCHAR] AS entity_refs FROM documents)"""
_VERSIONS = """entity_versions AS (SELECT 'e-' || (user_id % 3) || '-' || event_type || '-' || user_id AS entity_id, 'team-' || (user_id % 3) AS scope, event_type AS entity_type, user_id::VARCHAR AS key, ts AS updated_at, event_id::VARCHAR AS version_id, value FROM events)"""
_FACTS = """facts AS (SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS fact_id, 'team-' || (o_orderkey % 4) AS scope, o_custkey::VARCHAR AS subject_id, regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g') AS predicate,
 o_orderstatus AS object_value, CASE WHEN o_orderstatus = 'P' THEN 'proposed' ELSE 'active' END AS status, round(o_totalprice / 500000, 6) AS confidence, 'seed' AS source_obs, 'w' || (o_orderkey % 5) AS written_by,
 o_orderdate AS valid_from, TIMESTAMP '2105-12-31 23:59:59' AS valid_to, o_orderdate AS updated_at, CASE WHEN o_orderkey % 5 = 0 THEN 'scope' ELSE 'org' END AS visibility FROM orders)"""
_EDGES = """edges AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS edge_id, 'c' || o_custkey AS src_id, 's' || l_suppkey AS dst_id, 'rel_' || lower(l_returnflag) AS relation, o_orderdate AS valid_from,
 CASE WHEN l_shipdate > o_orderdate THEN l_shipdate ELSE TIMESTAMP '2105-12-31 23:59:59' END AS valid_to, greatest(o_orderdate, l_shipdate) AS updated_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_ENTITIES = """entities AS (SELECT 'c' || c_custkey AS entity_id, 'team-' || (c_custkey % 3) AS scope, 'ioc_domain' AS entity_type, 'c' || c_custkey || '.example.com' AS key, TIMESTAMP '1996-01-01 00:00:00' + to_minutes(c_custkey % 1000) AS updated_at FROM customer WHERE c_custkey % 7 <> 0
 UNION ALL SELECT 's' || s_suppkey, 'team-' || (s_suppkey % 3), 'ioc_domain', 's' || s_suppkey || '.example.com', TIMESTAMP '1996-01-01 00:00:00' + to_minutes(s_suppkey % 1000) FROM supplier WHERE s_suppkey % 5 <> 0)"""
_STORED = """stored AS (SELECT * EXCLUDE (valid_to, confidence), confidence::FLOAT AS confidence, CASE WHEN fact_id::BIGINT % 11 = 0 THEN TIMESTAMP '2025-01-01' WHEN fact_id::BIGINT % 7 = 0 THEN TIMESTAMP '2035-01-01' ELSE valid_to END AS valid_to,
 CASE WHEN fact_id::BIGINT % 3 = 0 THEN 'x' || (fact_id::BIGINT % 50) END AS object_id FROM facts)"""
_LATEST_STORED = "latest_stored AS (SELECT * FROM stored QUALIFY row_number() OVER (PARTITION BY scope, subject_id, predicate, object_value ORDER BY updated_at DESC, fact_id DESC) = 1)"
_STORED_EDGES = """stored_edges AS (SELECT 'e' || fact_id AS edge_id, scope, subject_id AS src_id, object_id AS dst_id, predicate AS relation, fact_id AS from_fact, valid_from, valid_to, valid_from AS updated_at FROM stored WHERE status = 'active' AND object_id IS NOT NULL)"""
_LATEST_FACTS = "latest_facts AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY scope, subject_id, predicate, object_value ORDER BY updated_at DESC, fact_id DESC) = 1)"


def stable_id_sql(*parts: str) -> str:
    """DuckDB for functions.text.stable_id."""
    listed = ", ".join(f"coalesce(({p})::VARCHAR, chr(0))" for p in parts)
    return rf"regexp_replace(md5(concat_ws(chr(31), {listed})), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5')"


def sql(body: str) -> str:
    """body with the relations that it names in front."""
    known = [("entity_versions", _VERSIONS), ("entities", _ENTITIES), ("latest_stored", _LATEST_STORED), ("stored_edges", _STORED_EDGES), ("stored", _STORED), ("latest_facts", _LATEST_FACTS), ("facts", _FACTS), ("edges", _EDGES), ("obs", _OBS)]
    import re

    used, text = [], body
    for name, cte in known:
        if re.search(rf"\b{name}\b", text):
            used.insert(0, cte)
            text += cte
    return "WITH " + ",\n".join(used) + ("\n" if used and not body.lstrip().startswith(",") else "") + body if used else body
