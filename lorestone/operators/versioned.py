"""Versions, validity and visibility: what nearly every read begins with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise

#: Rows that one task brings in order.
TOP_ROWS = 100_000
#: Columns that name a row of which the change log holds versions.
ENTITY_KEY = ["scope", "entity_type", "key"]
FACT_KEY = ["scope", "subject_id", "predicate", "object_value"]


def latest(df: DataFrame, key: list[str], version: str, *ties: str) -> DataFrame:
    """The newest version of each key, before any filter on other columns; ties go to the greatest of `ties`, in order.

    Spark keeps one row a key on the map side already (a window group limit), and filters on key columns pass below."""
    order = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in (version, *ties)])
    return df.withColumn("_version", F.row_number().over(order)).where("_version = 1").drop("_version")


def visible(scope: str | Column, gate: str, open_value: str, scope_col: str = "scope") -> Column:
    """A row of the caller's scope, or one whose gate is open to all."""
    return (F.col(scope_col) == scope) | (F.col(gate) == open_value)


def open_at(as_of: Column) -> Column:
    return F.col("valid_to") > as_of


def valid_at(as_of: Column) -> Column:
    """Within [valid_from, valid_to) and active."""
    return (F.col("status") == "active") & (F.col("valid_from") <= as_of) & open_at(as_of)


def keep_by_ttl(as_of: Column, days: int = 365) -> Column:
    """Alerts leave after so many days, other kinds stay."""
    return ~((F.col("kind") == "alert") & (F.col("ts") + F.make_interval(days=F.lit(days)) <= as_of))


def keyset_page(df: DataFrame, ts: str, tie: str, after_ts: Column, after_id: Column, size: int) -> DataFrame:
    """The next rows after a cursor in order of (ts, id). The bound on ts alone reaches the scan."""
    after = (F.col(ts) >= after_ts) & ((F.col(ts) > after_ts) | (F.col(tie) > after_id))
    rows = df.where(after)
    return rows.orderBy(ts, tie).limit(size) if size <= TOP_ROWS else first_rows(rows, [ts, tie], size)


def first_rows(rows: DataFrame, key: list[str], size: int) -> DataFrame:
    """The first `size` rows by a key, and those equal to the last one, where they are too many for one task: rows are
    laid out by ranges and counted, and only the range in which the last one lies is brought in order."""
    total = rows.count()
    if total <= size:
        return rows
    laid = materialise(rows.repartitionByRange(-(-total // TOP_ROWS), *key).withColumn("_range", F.spark_partition_id()), "first-rows")
    before = 0
    for r in laid.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():
        if before + r["n"] >= size:
            break
        before += r["n"]
    inside = laid.where(F.col("_range") == r["_range"]).select(*key).orderBy(*key).limit(size - before)
    last = inside.agg(F.max(F.struct(*key)).alias("_last"))
    page = laid.where(F.col("_range") <= r["_range"]).crossJoin(F.broadcast(last))
    return page.where(F.struct(*key) <= F.col("_last")).select(*rows.columns)


def merge_snapshot(snapshot: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """The snapshot with the rows of the delta in place of those with equal keys."""
    return snapshot.join(delta.select(*key).distinct(), key, "left_anti").unionByName(delta)
