"""What is known about entities now: many keys in one batch of joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.entities import named_requests
from ..functions.text import excerpt
from .versioned import ENTITY_KEY, FACT_KEY, latest, open_at, valid_at, visible

FACTS, OBSERVATIONS, NEIGHBORS = 200, 10, 50


@dataclass
class Enrichment:
    entity: DataFrame
    facts: DataFrame
    observations: DataFrame
    neighbors: DataFrame


def top(df: DataFrame, per: str, order: list[Column], most: int) -> DataFrame:
    """The first rows of each `per`, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(*order))).where(F.col("rank") <= most)


def siblings(requests: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, caller, entity_id, scope, ...): the current entities of each request's type and key, in all scopes.

    Requests (query_id, caller, key, type) are normalised; blank callers, and types that the key doesn't have, match none."""
    asked = named_requests(requests.where(F.trim("caller") != ""))
    return asked.join(latest(entities, ENTITY_KEY, "updated_at", "entity_id"), ["entity_type", "key"])


def facts_leg(ids: DataFrame, facts: DataFrame, as_of: Column) -> DataFrame:
    """ids: (query_id, caller, id). Versions collapse before status and validity are looked at."""
    now = latest(facts, FACT_KEY, "updated_at", "fact_id").where(valid_at(as_of))
    rows = now.join(ids, F.col("subject_id") == F.col("id")).where(visible(F.col("caller"), "visibility", "org"))
    rows = rows.select("query_id", F.col("fact_id").alias("id"), "predicate", "object_value", "status", "confidence", "valid_from", "written_by", "source_obs", F.col("scope").alias("origin_scope"))
    return top(rows, "query_id", [F.col("confidence").desc(), F.col("id")], FACTS)


def observations_leg(ids: DataFrame, observations: DataFrame) -> DataFrame:
    """Newest first. A row counts once for a request, however many of its references match; repeated rows count each."""
    rows = observations.withColumn("_row", F.monotonically_increasing_id()).withColumn("ref", F.explode(F.array_distinct("entity_refs")))
    rows = rows.join(ids, F.col("ref") == F.col("id")).where(visible(F.col("caller"), "confidentiality", "internal")).dropDuplicates(["query_id", "_row"])
    rows = rows.select("query_id", F.col("obs_id").alias("id"), "ts", "kind", excerpt(F.col("content")).alias("excerpt"), F.col("scope").alias("origin_scope"))
    return top(rows, "query_id", [F.col("ts").desc(), F.col("id")], OBSERVATIONS)


def neighbors_leg(ids: DataFrame, edges: DataFrame, as_of: Column, most: int = NEIGHBORS) -> DataFrame:
    """Both directions of open edges, each neighbour, relation and direction once, in that order."""
    live = edges.where(open_at(as_of))
    out = live.join(ids, F.col("src_id") == F.col("id")).select("query_id", F.col("dst_id").alias("entity_id"), "relation", F.lit("out").alias("direction"))
    back = live.join(ids, F.col("dst_id") == F.col("id")).select("query_id", F.col("src_id").alias("entity_id"), "relation", F.lit("in").alias("direction"))
    return top(out.unionByName(back).distinct(), "query_id", [F.col("entity_id"), F.col("relation"), F.col("direction")], most)


def enrich(requests: DataFrame, entities: DataFrame, facts: DataFrame, observations: DataFrame, edges: DataFrame, as_of: Column) -> Enrichment:
    """All four parts for requests (query_id, caller, key, type); a request that finds no entity has no rows."""
    found = siblings(requests, entities)
    first = Window.partitionBy("query_id").orderBy((F.col("scope") == F.col("caller")).desc(), "scope", "entity_id")
    entity = found.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first", "caller").withColumnRenamed("scope", "origin_scope")
    ids = found.select("query_id", "caller", F.col("entity_id").alias("id"))
    return Enrichment(entity, facts_leg(ids, facts, as_of), observations_leg(ids, observations), neighbors_leg(ids, edges, as_of))
