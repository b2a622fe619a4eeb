"""What happened to a case or an entity, newest first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..functions.text import excerpt
from .versioned import FACT_KEY, latest, visible

MOST, CAP = 500, 200


def observation_events(observations: DataFrame) -> DataFrame:
    return observations.select(F.col("obs_id").alias("id"), F.lit("observation").alias("src"), "ts", "kind", F.concat_ws(":", "actor_type", "actor_id").alias("actor"), excerpt(F.col("content")).alias("txt"), F.col("scope").alias("origin_scope"))


def fact_events(facts: DataFrame) -> DataFrame:
    """Current rows that aren't retracted, whether or not they are still valid."""
    text = F.concat("predicate", F.lit(": "), "object_value")
    return facts.where("status <> 'retracted'").select(F.col("fact_id").alias("id"), F.lit("fact").alias("src"), F.col("valid_from").alias("ts"), F.concat(F.lit("fact:"), "predicate").alias("kind"), F.col("written_by").alias("actor"), text.alias("txt"), F.col("scope").alias("origin_scope"))


def page(events: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= MOST or offset < 0:
        raise InvalidInput(f"limit is from 1 to {MOST}, offset from 0")
    return events.orderBy(F.col("ts").desc(), "src", "txt", "id").offset(offset).limit(limit)


def first_ids(ids: DataFrame, most: int = CAP) -> DataFrame:
    """The first ids in order of text, each once."""
    return ids.select("id").distinct().orderBy("id").limit(most)


def timeline_entity(observations, facts, entities, scope: str, entity_id: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Events of an entity and its siblings in other scopes, as far as the scope may see them; unknown: none."""
    if not scope.strip():
        raise InvalidInput("a scope is needed")
    anchor = entities.where(F.col("entity_id") == entity_id).select("entity_type", "key").distinct()
    ids = F.broadcast(first_ids(entities.join(anchor, ["entity_type", "key"], "left_semi").select(F.col("entity_id").alias("id"))))
    # At most CAP ids: one array of them, which each row's references are held against, in place of a join on membership.
    listed = F.broadcast(ids.agg(F.collect_list("id").alias("_ids")))
    seen = observations.where(visible(scope, "confidentiality", "internal")).crossJoin(listed).where(F.arrays_overlap("entity_refs", "_ids")).drop("_ids")
    known = latest(facts, FACT_KEY, "updated_at", "fact_id").where(visible(scope, "visibility", "org")).join(ids, F.col("subject_id") == F.col("id"), "left_semi")
    return page(observation_events(seen).unionByName(fact_events(known)), limit, offset)


def timeline_case(observations, facts, scope: str, case_id: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Events of a case, within the scope alone: its observations, and the facts of the entities that they name."""
    if not scope.strip():
        raise InvalidInput("a scope is needed")
    seen = observations.where((F.col("case_id") == case_id) & (F.col("scope") == scope))
    ids = F.broadcast(first_ids(seen.select(F.explode("entity_refs").alias("id"))))
    known = latest(facts.where(F.col("scope") == scope), FACT_KEY, "updated_at", "fact_id").join(ids, F.col("subject_id") == F.col("id"), "left_semi")
    return page(observation_events(seen).unionByName(fact_events(known)), limit, offset)
