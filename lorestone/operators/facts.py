"""Writes as deltas: assertions in batches, promotion, retraction, and the edges and audit rows that follow.

A delta holds new rows, and new states of rows that are there, by their ids: `merge_snapshot` applies it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import clamp_confidence, trust_status, two_decimals
from ..functions.text import canonical_uuid, reason, stable_id, trim
from ..scratch import materialise
from ..sources.schemas import EDGES, FOREVER, NIL, VISIBILITIES
from .versioned import FACT_KEY, latest, merge_snapshot

GROUP = ["scope", "subject_id", "predicate"]
LINK = ["scope", "src_id", "relation"]
#: Rows of a group that one task closes.
HOT_GROUP = 1_000_000
#: Ranges that groups are cut into, unless they would hold more than half of HOT_GROUP rows each.
RANGES = 256
#: Bytes of each string of a fact.
FACT_BYTES = 2_000


@dataclass
class WriteResult:
    facts: DataFrame
    edges: DataFrame
    audit: DataFrame
    rejects: DataFrame

    def applied(self, facts: DataFrame) -> DataFrame:
        """The facts with this result's rows in place of those with their ids."""
        return merge_snapshot(facts, self.facts, ["fact_id"])

    def applied_edges(self, edges: DataFrame) -> DataFrame:
        return merge_snapshot(edges, self.edges, ["edge_id"])


def _forever() -> Column:
    return F.lit(FOREVER).cast("timestamp")


def _later(group: list[str], *order: str):
    """The rows of a group that follow in this order. They are told as those before in the reverse order: Spark adds up a
    frame that begins at the first row as it goes, but one that ends at the last row anew for each row."""
    return Window.partitionBy(*group).orderBy(*[F.col(c).desc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, -1)


def supersede(facts: DataFrame) -> DataFrame:
    """facts with valid_to cut to the valid_from of the next row of the same scope, subject and predicate that closes.

    Rows need `closes`: whether they are fresh active assertions. Only active rows are closed; what promotion made active
    closes nothing; an earlier end stays. One window replaces one-at-a-time application in order of valid_from."""
    after = _later(GROUP, "valid_from", "fact_id")
    nxt = F.min(F.when(F.col("closes"), F.col("valid_from"))).over(after)
    return facts.withColumn("valid_to", F.when((F.col("status") == "active") & nxt.isNotNull(), F.least("valid_to", nxt)).otherwise(F.col("valid_to")))


def supersede_split(facts: DataFrame, most: int = HOT_GROUP) -> DataFrame:
    """As `supersede`, where a group may have any number of rows: those of more than `most` are cut into ranges of time.

    A range finds the next row that closes among its own; after its last one it takes the first of the ranges to come:
    a suffix minimum over as many values as there are ranges. These are RANGES at most as long as they stay small, since
    each is a task and a file. Groups that large are as few as all rows over `most`, so
    they are told to all tasks, and the others take the plain way."""
    hot = materialise(facts.groupBy(*GROUP).agg(F.count("*").alias("_n")).where(F.col("_n") > most), "hot-groups")
    total = hot.agg(F.sum("_n")).first()[0]
    if not total:
        return supersede(facts)
    marked = facts.join(F.broadcast(hot.select(*GROUP, F.lit(True).alias("_hot"))), GROUP, "left")
    parts = min(2 * -(-total // most), max(RANGES, 2 * -(-total // HOT_GROUP)))
    laid = marked.where("_hot").drop("_hot").repartitionByRange(parts, *GROUP, "valid_from", "fact_id").withColumn("_range", F.spark_partition_id())
    laid = materialise(laid, "group-ranges")
    first = F.min(F.when(F.col("closes"), F.col("valid_from")))
    firsts = laid.groupBy("_range", *GROUP).agg(first.alias("_first"))
    to_come = Window.partitionBy(*GROUP).orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = firsts.withColumn("_carry", F.min("_first").over(to_come)).drop("_first")
    inside = _later(["_range", *GROUP], "valid_from", "fact_id")
    rows = laid.withColumn("_next", first.over(inside)).join(F.broadcast(carry), ["_range", *GROUP])
    nxt = F.coalesce("_next", "_carry")
    ends = F.when((F.col("status") == "active") & nxt.isNotNull(), F.least("valid_to", nxt)).otherwise(F.col("valid_to"))
    return rows.withColumn("valid_to", ends).select(*facts.columns).unionByName(supersede(marked.where("_hot IS NULL").drop("_hot")).select(*facts.columns))


def _blank(c: str) -> Column:
    return F.coalesce(trim(F.col(c)), F.lit("")) == ""


def check_assertions(inputs: DataFrame, ids: bool = True) -> DataFrame:
    """inputs with `error`: null, or what is wrong with the row. `ids`: whether subjects, objects, sources and a client's
    event ids must be UUIDs."""
    no_id = lambda c: F.lit(ids) & ~_blank(c) & canonical_uuid(trim(F.col(c))).isNull()
    long = lambda *names: F.greatest(*[F.coalesce(F.octet_length(c), F.lit(0)) for c in names]) > FACT_BYTES
    error = (
        F.when(_blank("scope"), "scope is blank")
        .when(_blank("subject_id"), "subject_id is blank")
        .when(no_id("subject_id"), "subject_id is no id")
        .when(_blank("predicate"), "predicate is blank")
        .when(_blank("object_value"), "object_value is blank")
        .when(long("scope", "subject_id", "predicate", "object_value", "object_id", "source_obs", "actor_id"), "a field is too long")
        .when(no_id("object_id"), "object_id is no id")
        .when(no_id("source_obs"), "source_obs is no id")
        .when(~F.coalesce(F.col("actor_type").isin("human", "agent"), F.lit(False)), "actor_type is unknown")
        .when(_blank("actor_id"), "actor_id is blank")
        .when(~_blank("visibility") & ~trim(F.col("visibility")).isin(*VISIBILITIES), "visibility is unknown")
    )
    if "client_event_id" in inputs.columns:
        error = error.when(no_id("client_event_id"), "client_event_id is no id")
    return inputs.withColumn("error", error)


def mint_edges(facts: DataFrame) -> DataFrame:
    """An edge of each active fact that names an object entity, as long as the fact; one that has ended says when."""
    named = facts.where((F.col("status") == "active") & F.col("object_id").isNotNull())
    changed = F.when(F.col("valid_to") < _forever(), F.col("valid_to")).otherwise(F.col("valid_from"))
    return named.select(stable_id(F.lit("edge"), F.col("fact_id")).alias("edge_id"), "scope", F.col("subject_id").alias("src_id"), F.col("object_id").alias("dst_id"), F.col("predicate").alias("relation"), F.col("fact_id").alias("from_fact"), "valid_from", "valid_to", changed.alias("updated_at"))


def audit_rows(rows: DataFrame, operation: str, table: str, target: str, summary: Column, ts: Column) -> DataFrame:
    """Audit rows whose summaries hold no content."""
    return rows.select(ts.alias("ts"), "actor_type", "actor_id", F.lit(operation).alias("operation"), F.lit(table).alias("target_table"), F.col(target).alias("target_id"), summary.alias("payload_summary"))


def superseded_edges(edges: DataFrame, closers: DataFrame) -> DataFrame:
    """New states of the edges that assertions end: closers (scope, src_id, relation, at). The first after an edge begins
    ends it, if it is open then; its change is stamped with that time, so that projection sees it."""
    live = edges.join(closers.select(*LINK).distinct(), LINK, "left_semi")
    rows = live.select(*LINK, F.col("valid_from").alias("t"), F.lit(False).alias("ends"), F.struct(*edges.columns).alias("edge"))
    ends = closers.select(*LINK, F.col("at").cast(dict(edges.dtypes)["valid_from"]).alias("t"), F.lit(True).alias("ends"), F.lit(None).cast(rows.schema["edge"].dataType).alias("edge"))
    after = _later(LINK, "t", "ends")
    hit = rows.unionByName(ends).withColumn("at", F.min(F.when(F.col("ends"), F.col("t"))).over(after)).where(~F.col("ends"))
    hit = hit.where(F.col("edge.valid_to") > F.col("at")).select("edge.*", "at")
    return hit.withColumns({"valid_to": F.col("at"), "updated_at": F.col("at")}).select(*edges.columns)


def _no_edges(facts: DataFrame) -> DataFrame:
    return facts.sparkSession.createDataFrame([], EDGES)


def assert_facts(inputs: DataFrame, facts: DataFrame, edges: DataFrame | None = None, whitelist: list[str] | None = None, floor: float | None = None, ids: bool = True) -> WriteResult:
    """Assert a batch (scope, subject_id, predicate, object_value, object_id, confidence, source_obs, actor_type,
    actor_id, visibility, asserted_at, and client_event_id if there is one) against the current facts and edges.

    The result's facts are the new rows and the new states of the rows that they close: active ones of their scope,
    subject and predicate whose end lies after the assertion, be it set or not. Open edges of that scope, source and
    relation end with them. Actives of one group close each other in order of time, as if asserted one at a time. A
    client's event id names its fact, so a retry gives the same."""
    checked = check_assertions(inputs, ids)
    good = checked.where("error is null").drop("error")
    conf = clamp_confidence(F.coalesce(F.col("confidence"), F.lit(0.0)))
    own_id = lambda c: F.coalesce(canonical_uuid(trim(F.col(c))), trim(F.col(c)))
    or_null = lambda c: F.when(~_blank(c), own_id(c))
    minted = stable_id(F.lit("fact"), *[F.col(c) for c in ("scope", "subject_id", "predicate", "object_value", "actor_id", "asserted_at")])
    named = F.coalesce(or_null("client_event_id"), minted) if "client_event_id" in inputs.columns else minted
    fresh = good.select(
        named.alias("fact_id"), trim(F.col("scope")).alias("scope"), own_id("subject_id").alias("subject_id"), trim(F.col("predicate")).alias("predicate"),
        trim(F.col("object_value")).alias("object_value"), or_null("object_id").alias("object_id"),
        trust_status(F.col("actor_type"), F.col("actor_id"), conf, whitelist, floor).alias("status"),
        conf.cast("float").alias("confidence"), F.coalesce(or_null("source_obs"), F.lit(NIL)).alias("source_obs"), trim(F.col("actor_id")).alias("written_by"),
        F.col("asserted_at").alias("valid_from"), _forever().alias("valid_to"), F.col("asserted_at").alias("updated_at"),
        F.when(_blank("visibility"), "org").otherwise(trim(F.col("visibility"))).alias("visibility"), "actor_type", trim(F.col("actor_id")).alias("actor_id"),
    )
    fresh = fresh.dropDuplicates(["fact_id"])
    touched = latest(facts, FACT_KEY, "updated_at", "fact_id").join(fresh.select(*GROUP).distinct(), GROUP, "left_semi")
    old = touched.withColumns({"closes": F.lit(False), "fresh": F.lit(False), "was": F.col("valid_to"), "actor_type": F.lit(None).cast("string"), "actor_id": F.lit(None).cast("string")})
    every = supersede(old.unionByName(fresh.withColumns({"closes": F.col("status") == "active", "fresh": F.lit(True), "was": _forever()}), allowMissingColumns=True))
    changed = every.where(F.col("fresh") | (F.col("valid_to") < F.col("was")))
    delta = changed.select(*facts.columns)
    # What each active assertion closes: the rows of its group that end where it begins.
    ends = every.where("status = 'active' and valid_to < was").groupBy(*GROUP, F.col("valid_to").alias("valid_from")).agg(F.count("*").alias("superseded"))
    mine = changed.where("fresh").join(ends, [*GROUP, "valid_from"], "left")
    closes = F.when(F.col("status") == "active", F.coalesce("superseded", F.lit(0))).otherwise(0)
    edge = F.when((F.col("status") == "active") & F.col("object_id").isNotNull(), "y").otherwise("n")
    summary = F.format_string("status=%s confidence=%.2f superseded=%d edge=%s vis=%s", F.col("status"), two_decimals(F.col("confidence")), closes, edge, F.col("visibility"))
    audit = audit_rows(mine, "assert_fact", "facts", "fact_id", summary, F.col("valid_from"))
    fresh_edges = mint_edges(changed.where("fresh").select(*facts.columns))
    if edges is not None:
        closers = fresh.where("status = 'active'").select("scope", F.col("subject_id").alias("src_id"), F.col("predicate").alias("relation"), F.col("valid_from").alias("at"))
        fresh_edges = fresh_edges.select(*edges.columns).unionByName(superseded_edges(edges, closers))
    return WriteResult(delta, fresh_edges, audit, checked.where("error is not null"))


def _transition(requests: DataFrame, facts: DataFrame, wrong: Column) -> DataFrame:
    """requests with the current row of their fact, and `error`: only humans, who say who they are, move facts."""
    now = latest(facts, FACT_KEY, "updated_at", "fact_id")
    error = F.when(~F.coalesce(F.col("actor_type") == "human", F.lit(False)), "HumanGated").when(_blank("actor_id") | _blank("fact_id"), "InvalidInput").when(F.col("scope").isNull(), "NotFound").when(wrong, "Conflict")
    return requests.join(now, "fact_id", "left").withColumn("error", error).withColumns({"prior": F.col("fact_id"), "prior_status": F.col("status"), "actor_id": trim(F.col("actor_id"))})


def promote_facts(requests: DataFrame, facts: DataFrame) -> WriteResult:
    """requests: (fact_id, actor_type, actor_id, at). Humans make proposals active: a new id and version with the same
    key, and an edge if it names an object; the old row ends; other actives of the group stay open."""
    asked = _transition(requests, facts, F.col("status") != "proposed")
    good = asked.where("error is null")
    new = good.withColumns({"fact_id": stable_id(F.lit("promoted"), F.col("fact_id")), "status": F.lit("active"), "valid_from": F.col("at"), "valid_to": _forever(), "updated_at": F.col("at"), "written_by": F.col("actor_id")})
    delta = new.select(*facts.columns).unionByName(good.withColumn("valid_to", F.col("at")).select(*facts.columns))
    edge = F.when(F.col("object_id").isNotNull(), "y").otherwise("n")
    summary = F.format_string("from=proposed to=active confidence=%.2f prior=%s edge=%s vis=%s", two_decimals(F.col("confidence")), F.col("prior"), edge, F.col("visibility"))
    audit = audit_rows(new, "promote_fact", "facts", "fact_id", summary, F.col("at"))
    return WriteResult(delta, mint_edges(new.select(*facts.columns)), audit, asked.where("error is not null").select(*requests.columns, "error"))


def retract_facts(requests: DataFrame, facts: DataFrame, edges: DataFrame) -> WriteResult:
    """requests: (fact_id, actor_type, actor_id, at, and reason if there is one). Humans retract: a new id and version
    that is born closed; the old row ends, and so do the open edges that it made. The reason goes to the audit, cut."""
    asked = _transition(requests, facts, F.col("status") == "retracted")
    good = asked.where("error is null")
    new = good.withColumns({"fact_id": stable_id(F.lit("retracted"), F.col("fact_id")), "status": F.lit("retracted"), "valid_from": F.col("at"), "valid_to": F.col("at"), "updated_at": F.col("at"), "written_by": F.col("actor_id")})
    delta = new.select(*facts.columns).unionByName(good.withColumn("valid_to", F.col("at")).select(*facts.columns))
    why = F.coalesce(reason(F.col("reason")), F.lit("")) if "reason" in requests.columns else F.lit("")
    edge = F.when(F.col("object_id").isNotNull(), "y").otherwise("n")
    told = F.when(why != "", F.concat(F.lit(" reason="), why)).otherwise("")
    summary = F.format_string("from=%s%s prior=%s edge=%s vis=%s", F.col("prior_status"), told, F.col("prior"), edge, F.col("visibility"))
    audit = audit_rows(new, "retract_fact", "facts", "fact_id", summary, F.col("at"))
    closed = close_edges(edges, good.select(F.col("prior").alias("from_fact"), "at"), ["from_fact"])
    return WriteResult(delta, closed, audit, asked.where("error is not null").select(*requests.columns, "error"))


def close_edges(edges: DataFrame, closing: DataFrame, on: list[str]) -> DataFrame:
    """New states of the edges that match `closing` (on..., at) and are open then: they end, and say when they changed."""
    hit = edges.join(closing, on).where(F.col("valid_to") > F.col("at"))
    return hit.withColumns({"valid_to": F.col("at"), "updated_at": F.col("at")}).select(*edges.columns)


def list_predicates(facts: DataFrame) -> DataFrame:
    """Relation names in use, most used first, over all rows as they are stored."""
    return facts.groupBy("predicate").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "predicate")
