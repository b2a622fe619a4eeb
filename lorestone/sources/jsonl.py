"""JSON lines: observations and facts, with what is wrong kept apart and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a line. The names are the files' format.
OBSERVATION_LINES = "ts string, kind string, actor_type string, actor_id string, scope string, case_id string, client_event_id string, on_behalf_of string, confidentiality string, content string"
FACT_LINES = "scope string, subject_key string, predicate string, object_value string, object_key string, confidence double, actor_type string, actor_id string, client_event_id string"
LINE_BYTES = 1 << 20


def read_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): the parsed lines, and the lines with why they aren't. Blank lines and # comments count for
    neither; ts, where there is one, must be a timestamp."""
    return parse_lines(spark.read.text(path), schema)


def parse_lines(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    lines = lines.where(~F.col("value").rlike(r"^\s*(#|$)"))
    row = F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = lines.withColumn("row", row)
    has_ts = schema.startswith("ts ")
    bad_ts = F.col("row.ts").isNotNull() & F.try_to_timestamp(F.col("row.ts")).isNull() if has_ts else F.lit(False)
    error = F.when(F.octet_length("value") > LINE_BYTES, "line is too long").when(F.col("row").isNull() | F.col("row._bad").isNotNull(), "line is no JSON object").when(bad_ts, "ts is no timestamp")
    parsed = parsed.withColumn("error", error)
    good = parsed.where("error is null").select("row.*").drop("_bad")
    if has_ts:
        good = good.withColumn("ts", F.try_to_timestamp("ts"))
    return good, parsed.where("error is not null").select("value", "error")


def dry_run(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """(outcome, n): what an ingest would take, without writing."""
    return accepted.select(F.lit("accepted").alias("outcome")).unionByName(rejected.select(F.lit("rejected").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))


def resolve_facts(lines: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts to assert, unresolved lines): subjects and objects by key in the scope; actor human/seeder by default. The
    client's event id isn't used."""
    from ..functions.entities import normalize
    from ..operators.versioned import ENTITY_KEY, latest

    known = latest(entities, ENTITY_KEY, "updated_at", "entity_id").select("scope", "entity_type", "key", "entity_id")
    for end in ("subject", "object"):
        n = lines.withColumn("_n", normalize(F.col(f"{end}_key"))).withColumns({"_t": F.col("_n.type"), "_k": F.col("_n.key")}).drop("_n")
        names = known.select(F.col("scope"), F.col("entity_type").alias("_t"), F.col("key").alias("_k"), F.col("entity_id").alias(f"{end}_id"))
        lines = n.join(names, ["scope", "_t", "_k"], "left").drop("_t", "_k")
    fine = F.col("subject_id").isNotNull() & (F.col("object_key").isNull() | F.col("object_id").isNotNull())
    out = lines.withColumns({"actor_type": F.coalesce("actor_type", F.lit("human")), "actor_id": F.coalesce("actor_id", F.lit("seeder"))})
    return out.where(fine), out.where(~fine)
