"""The store for one caller at a time: what a server or a tool would call, with its defaults, limits and error codes."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import Conflict, HumanGated, InvalidInput, NotFound, StoreError
from .functions.embedding import Embedder
from .functions.text import memory_context
from .operators import enrich as enriching
from .operators import facts as writing
from .operators import graph, observations, similar, timeline
from .sources.bootstrap import ensure_tables
from .sources.configs import Identity, Trust
from .sources.schemas import AUDIT, EDGES, ENTITIES, FACTS, OBSERVATIONS
from .sources.snapshots import SnapshotStore
from .streaming.pipelines import Budget

#: What a request that doesn't say gets.
K, LIMIT, OFFSET, HOPS, CONFIDENCE = 10, 50, 0, 1, 0.5
TABLES = {"entities": ENTITIES, "observations": OBSERVATIONS, "facts": FACTS, "edges": EDGES, "audit": AUDIT}
STATUS = {InvalidInput: (400, "invalid_request"), HumanGated: (403, "human_gated"), NotFound: (404, "fact_not_found"), Conflict: (409, "conflict")}
_ERRORS = {"HumanGated": HumanGated, "NotFound": NotFound, "Conflict": Conflict}


class Limited(StoreError):
    """An agent writes faster than it may."""


def status(error: Exception) -> tuple[int, str]:
    """(HTTP status, code) of an error. What isn't the store's own is the storage's fault, and its text stays inside."""
    if isinstance(error, Limited):
        return 429, "rate_limited"
    return next((s for kind, s in STATUS.items() if isinstance(error, kind)), (502, "storage_error"))


def _now() -> Column:
    """The time of a call: one value, however often a plan is run."""
    return F.lit(datetime.now(timezone.utc))


@dataclass
class Memory:
    """A store of snapshots as one caller sees it. Identity comes with each call, beside the request's own fields."""

    store: SnapshotStore
    trust: Trust = Trust()
    embed: Embedder | None = None
    clock: Callable[[], Column] = _now
    budget: Budget | None = None

    def __post_init__(self):
        ensure_tables(self.store, TABLES)

    def _table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def _gate(self, who: Identity) -> None:
        if self.budget and (wait := self.budget.wait(who.actor_type, who.actor_id, time.monotonic())):
            raise Limited(f"try again in {wait:.1f} seconds")

    def _rows(self, who: Identity, row: dict, schema: str) -> DataFrame:
        known = [f.split()[0] for f in schema.split(", ")]
        if extra := set(row) - set(known):
            raise InvalidInput(f"unknown fields: {', '.join(sorted(extra))}")
        told = {"actor_type": who.actor_type, "actor_id": who.actor_id, "scope": who.scope} | {k: v for k, v in row.items() if k not in ("actor_type", "actor_id", "scope")}
        return self.store.spark.createDataFrame([tuple(told.get(k) for k in known)], schema)

    def record_observation(self, who: Identity, **row) -> str:
        """The id of a new observation; its entities are resolved, its vector is made, and it leaves a line in the audit."""
        self._gate(who)
        asked = self._rows(who, row, "scope string, kind string, actor_type string, actor_id string, on_behalf_of string, case_id string, client_event_id string, confidentiality string, ts timestamp, content string")
        done = observations.record_observations(asked, self._table("entities"), self.clock(), embed=self.embed)
        if bad := done.rejects.first():
            raise InvalidInput(bad["error"])
        # Read before any table moves: what follows refers to the versions that this call began with.
        rows = done.observations.select(*self._table("observations").columns).collect()
        entities, audit = done.entities.collect(), done.audit.collect()
        make = self.store.spark.createDataFrame
        if entities:
            self.store.merge("entities", make(entities, ENTITIES), ["entity_id"])
        self.store.append("observations", make(rows, OBSERVATIONS))
        self.store.append("audit", make(audit, AUDIT))
        return rows[0]["obs_id"]

    def _write(self, result: writing.WriteResult) -> str:
        """Commit a write of one fact: facts, edges, audit. The new fact's id is the audit's target."""
        if bad := result.rejects.first():
            raise _ERRORS.get(bad["error"], InvalidInput)(bad["error"])
        facts, edges, audit = result.facts.collect(), result.edges.collect(), result.audit.collect()
        make = self.store.spark.createDataFrame
        self.store.merge("facts", make(facts, result.facts.schema), ["fact_id"])
        if edges:
            self.store.merge("edges", make(edges, result.edges.schema), ["edge_id"])
        self.store.append("audit", make(audit, AUDIT))
        return audit[0]["target_id"]

    def assert_fact(self, who: Identity, **row) -> str:
        self._gate(who)
        row = {"confidence": CONFIDENCE} | row
        schema = "scope string, subject_id string, predicate string, object_value string, object_id string, confidence double, source_obs string, actor_type string, actor_id string, visibility string, client_event_id string"
        asked = self._rows(who, row, schema).withColumn("asserted_at", self.clock())
        return self._write(writing.assert_facts(asked, self._table("facts"), self._table("edges"), list(self.trust.whitelist), self.trust.floor))

    def promote_fact(self, who: Identity, fact_id: str) -> str:
        self._gate(who)
        asked = self._rows(who, {"fact_id": fact_id}, "fact_id string, actor_type string, actor_id string").withColumn("at", self.clock())
        return self._write(writing.promote_facts(asked, self._table("facts")))

    def retract_fact(self, who: Identity, fact_id: str, reason: str = "") -> str:
        self._gate(who)
        asked = self._rows(who, {"fact_id": fact_id, "reason": reason}, "fact_id string, reason string, actor_type string, actor_id string").withColumn("at", self.clock())
        return self._write(writing.retract_facts(asked, self._table("facts"), self._table("edges")))

    def _request(self, who: Identity, key: str, kind: str | None) -> DataFrame:
        if not who.scope.strip() or not key.strip():
            raise InvalidInput("a scope and a key are needed")
        return self.store.spark.createDataFrame([(0, who.scope, key, kind)], "query_id long, caller string, key string, type string")

    def enrich(self, who: Identity, key: str, kind: str | None = None) -> enriching.Enrichment:
        t = self._table
        return enriching.enrich(self._request(who, key, kind), t("entities"), t("facts"), t("observations"), t("edges"), self.clock())

    def search(self, who: Identity, query: str, k: int = K) -> DataFrame:
        vector = None
        if self.embed:
            try:
                vector = self.embed("query", [query])[0]
            except Exception:  # noqa: BLE001  the other leg answers alone
                vector = None
        return similar.similar(self._table("observations"), who.scope, query, vector, k)

    def timeline(self, who: Identity, case_id: str | None = None, entity_id: str | None = None, limit: int = LIMIT, offset: int = OFFSET) -> DataFrame:
        if bool(case_id) == bool(entity_id):
            raise InvalidInput("a case or an entity is needed, and not both")
        t = self._table
        if case_id:
            return timeline.timeline_case(t("observations"), t("facts"), who.scope, case_id, limit, offset)
        return timeline.timeline_entity(t("observations"), t("facts"), t("entities"), who.scope, entity_id, limit, offset)

    def traverse(self, who: Identity, key: str, kind: str | None = None, relation: str | None = None, hops: int = HOPS, projected: graph.Projection | None = None) -> DataFrame:
        """Along a projected graph, or, without one, one hop over the stored edges, however many are asked for."""
        asked, entities, now = self._request(who, key, kind), self._table("entities"), self.clock()
        if projected:
            return graph.traverse(asked, entities, projected.edges, projected.nodes, relation, hops)
        graph.check_walk(relation, hops)
        start = graph.starts(asked, entities).first()
        none = self.store.spark.createDataFrame([], "nid string, relation string, ts timestamp, ek string")
        return graph.neighbors_fallback(self._table("edges"), [start["node"]], now, relation) if start else none

    def list_predicates(self) -> DataFrame:
        return writing.list_predicates(self._table("facts"))

    @staticmethod
    def as_context(rows: DataFrame, note: str) -> DataFrame:
        """Each row as JSON in a fenced block, for a model to read."""
        return rows.select(memory_context(note, F.struct(*rows.columns)).alias("context"))
