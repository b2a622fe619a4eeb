"""Recording observations: validation, entity resolution, references and audit, as deltas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.embedding import Embedder, with_vectors
from ..functions.entities import entity_candidates, normalize
from ..functions.text import canonical_uuid, stable_id, to_millis
from ..sources.schemas import CONFIDENTIALITY, KINDS
from .facts import audit_rows
from .versioned import ENTITY_KEY, latest

CONTENT_BYTES = 10_000


@dataclass
class Recorded:
    observations: DataFrame
    entities: DataFrame
    audit: DataFrame
    rejects: DataFrame


def check_observations(inputs: DataFrame) -> DataFrame:
    """inputs with `error`: null, or what is wrong with the row."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    one_of = lambda c, names: F.coalesce(F.col(c).isin(*names), F.lit(False))
    error = (
        F.when(blank("scope"), "scope is blank")
        .when(~one_of("kind", KINDS), "kind is unknown")
        .when(~one_of("actor_type", ["human", "agent"]), "actor_type is unknown")
        .when(blank("actor_id"), "actor_id is blank")
        .when(F.col("confidentiality").isNotNull() & ~one_of("confidentiality", CONFIDENTIALITY), "confidentiality is unknown")
        .when(blank("content"), "content is blank")
        .when(F.octet_length("content") > CONTENT_BYTES, "content is too long")
        .when(F.col("case_id").isNotNull() & canonical_uuid(F.col("case_id")).isNull(), "case_id is no id")
    )
    return inputs.withColumn("error", error)


def resolve_batch(raws: DataFrame, entities: DataFrame, as_of: Column, ipv6: bool = True) -> tuple[DataFrame, DataFrame]:
    """(resolved, delta) for raws (scope, pos, raw, and entity_type and key where they are known already): resolved has
    each raw's entity_id, null if it is no entity; delta has a new version of each entity named: seen again, or created
    with the first raw as its display name. New ids follow from the key, so both come from one join."""
    if "key" not in raws.columns:
        raws = raws.withColumn("n", normalize(F.col("raw"), ipv6)).select("scope", "pos", "raw", F.col("n.type").alias("entity_type"), F.col("n.key").alias("key"))
    known = latest(entities, ENTITY_KEY, "updated_at", "entity_id").select(*ENTITY_KEY, "entity_id", "display_name", "attrs", "first_seen")
    new_id = stable_id(F.lit("entity"), *[F.col(c) for c in ENTITY_KEY])
    both = raws.join(known, ENTITY_KEY, "left").withColumn("entity_id", F.when(F.col("key").isNotNull(), F.coalesce("entity_id", new_id)))
    resolved = both.select("scope", "pos", "raw", "entity_type", "key", "entity_id")
    first = lambda c: F.first(c).alias(c)
    seen = both.where("key is not null").groupBy(*ENTITY_KEY).agg(first("entity_id"), F.min_by("raw", "pos").alias("raw_name"), first("display_name"), first("attrs"), first("first_seen"))
    delta = seen.select("entity_id", *ENTITY_KEY, F.coalesce("display_name", F.trim("raw_name")).alias("display_name"), F.coalesce("attrs", F.create_map().cast("map<string,string>")).alias("attrs"), F.coalesce("first_seen", as_of).alias("first_seen"), as_of.alias("last_seen"), as_of.alias("updated_at"))
    return resolved, delta


def record_observations(inputs: DataFrame, entities: DataFrame, as_of: Column, ipv6: bool = True, embed: Embedder | None = None) -> Recorded:
    """inputs: (scope, kind, actor_type, actor_id, on_behalf_of, case_id, client_event_id, confidentiality, ts, content).

    A client's event id names its observation, so a retry yields the same id; entity_refs follow the text's order. With
    an embedder, each content gets its vector; without one, or where it fails, an empty one. Times are cut to
    milliseconds."""
    checked = check_observations(inputs)
    good = checked.where("error is null").drop("error")
    own = F.coalesce(F.col("client_event_id"), F.col("content"))
    good = good.withColumn("obs_id", stable_id(F.lit("obs"), F.col("scope"), F.col("actor_id"), own, F.when(F.col("client_event_id").isNull(), F.col("ts"))))
    good = good.withColumns({"ts": to_millis(F.coalesce("ts", as_of)), "confidentiality": F.coalesce("confidentiality", F.lit("internal")), "case_id": canonical_uuid(F.col("case_id"))})
    found = entity_candidates(good.dropDuplicates(["obs_id"]), "obs_id", ipv6=ipv6).join(good.select("obs_id", "scope").distinct(), "obs_id")
    resolved, delta = resolve_batch(found.select("scope", F.struct("obs_id", "pos").alias("pos"), "raw", F.col("type").alias("entity_type"), F.col("entity_key").alias("key")), entities, as_of, ipv6)
    refs = resolved.groupBy(F.col("pos.obs_id").alias("obs_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos.pos", "entity_id"))), lambda x: x["entity_id"]).alias("entity_refs"))
    rows = good.join(refs, "obs_id", "left").withColumn("entity_refs", F.coalesce("entity_refs", F.array().cast("array<string>")))
    summary = F.format_string("kind=%s entities=%d chars=%d", F.col("kind"), F.size("entity_refs"), F.length("content"))
    audit = audit_rows(rows, "record_observation", "observations", "obs_id", summary, as_of)
    out = with_vectors(rows, embed, "document") if embed else rows.withColumn("content_vec", F.array().cast("array<float>"))
    return Recorded(out.select("obs_id", "scope", "ts", "kind", "actor_type", "actor_id", "on_behalf_of", "case_id", "confidentiality", "content", "content_vec", "entity_refs"), delta, audit, checked.where("error is not null"))
