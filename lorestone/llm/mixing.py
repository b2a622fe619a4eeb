"""Mixing sources to target weights: repeat or thin each source's documents until its words meet its target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, documents

WEIGHTS = (5, 2, 1)
MOST = 3
#: Up to so many sources, their rates are sent to every executor; beyond, the join shuffles.
BROADCAST_SOURCES = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    The sources in order of code points, null last, weigh `weights` in turn and share the whole size; no target is over
    `most` times its source's size, and what such a source can't take goes to the rest by weight. With the sources
    ordered by cap over weight, those at their cap are a prefix, so running sums give the common level in one pass;
    the window holds one row a source."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("w", F.get(w, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    tied = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = tied.rowsBetween(Window.unboundedPreceding, -1)
    after = tied.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(all_rows).cast("double"))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    s = s.withColumn("free", F.col("level") * F.col("w") <= F.col("cap"))
    # The first source that isn't held by its cap sets the level for itself and all after it.
    s = s.withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), "level"))).over(all_rows)["level"])
    return s.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap"), F.lit(0.0)).alias("target"))


def unit_hash(*keys: Column, seed: str) -> Column:
    """A number in [0, 1) from the keys: 52 bits of an MD5."""
    text = F.concat_ws("\x1f", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("\x00")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, seed: str = "mix", id_col: str = "doc_id") -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies: how often the mix holds each document.

    The rate of a source is target over size; a document comes floor(rate) times, and once more where its hash is below
    the fraction, so reruns agree and no document is taken over `most` times. Null and empty texts have size 0; a source
    of only such has target 0 and is left out; null is a source of its own; repeated rows with one id are taken alike;
    an empty table gives an empty plan. Columns named mix_* in docs are replaced."""
    extra = [c for c in docs.columns if c.startswith("mix_")]
    docs = docs.drop(*extra).withColumn("mix_size", n_words(F.col("text")))
    sizes = docs.groupBy("source").agg(F.sum("mix_size").alias("source_size"))
    targets = source_targets(sizes, weights, most).select(F.col("source").alias("mix_key"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    if targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    out = docs.join(targets, docs["source"].eqNullSafe(targets["mix_key"])).drop("mix_key")
    rate = F.least(F.coalesce(F.try_divide("mix_target", F.col("mix_source_size").cast("double")), F.lit(0.0)), F.lit(float(most)))
    return out.withColumn("mix_copies", (F.floor(rate) + F.when(unit_hash(F.col(id_col), seed=seed) < rate - F.floor(rate), 1).otherwise(0)).cast("long"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of docs, each document as often as mix_plan says."""
    plan = mix_plan(docs, **options)
    copies = F.explode(F.array_repeat(F.lit(1), F.col("mix_copies").cast("int")))
    return plan.where("mix_copies > 0").withColumn("mix_copy", copies).select(*[c for c in docs.columns if not c.startswith("mix_")])


def op3_mix_sources(spark, sf_dir):
    plan = mix_plan(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return plan.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.col("mix_copies").alias("copies"))


def mix_sql(docs: str) -> str:
    """DuckDB: the plan of mix_plan over the relation `docs`."""
    return f"""
WITH d AS (SELECT *, coalesce(length(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS w, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(w) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
v AS (SELECT arg_min(level, cap / w) AS level FROM l WHERE level * w <= cap),
t AS (SELECT l.source, l.source_size, coalesce(least(l.cap, v.level * l.w), l.cap, 0.0) AS target FROM l CROSS JOIN v),
r AS (SELECT d.*, t.source_size, t.target, least(CASE WHEN t.source_size = 0 THEN 0.0 ELSE t.target / t.source_size END, 3.0) AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor(rate) + CASE WHEN ('0x' || substr(md5('mix' || chr(31) || coalesce(doc_id::VARCHAR, chr(0))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM r)
"""


OP3_SQL = mix_sql("documents") + "SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c"
