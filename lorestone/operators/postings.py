"""Indexes of observations: by token, laid out by ranges, and by entity, in buckets. Both answer many requests at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import content_tokens, excerpt, query_tokens
from ..scratch import materialise, small
from ..sources.ranged import RangedTable
from .enrich import OBSERVATIONS, top

TOKEN_KEY = ["token", "ts", "obs_id"]
#: Tokens that are asked for by name, from the driver; more are joined.
ASKED = 1_000
#: References of one entity in one bucket; an entity of more is dealt over several.
HOT_REFS = 1_000_000


def token_postings(observations: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(token, ts, obs_id, scope, open, row): each token of each content once, or only those that are `asked` (token).

    row numbers the rows, so that one that is found by two tokens can be told from two alike. Contents that are null, and
    what stands between separators without a character, have no posting."""
    rows = observations.select("ts", "obs_id", "scope", (F.col("confidentiality") == "internal").alias("open"), F.monotonically_increasing_id().alias("row"), "content")
    each = rows.select(F.explode(F.array_distinct(content_tokens(F.col("content")))).alias("token"), "ts", "obs_id", "scope", F.coalesce("open", F.lit(False)).alias("open"), "row").where("token <> ''")
    return each if asked is None else each.join(asked, "token", "left_semi")


class TokenIndex:
    """Postings as a table laid out by token and time: a token of many rows spans several ranges, a range holds many rare
    tokens, and observations that come later are added as deltas."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = RangedTable(spark, path, TOKEN_KEY)

    def add(self, observations: DataFrame, batch: int = 0, parts: int = 8) -> None:
        self.table.write(token_postings(observations), batch, parts)

    def of(self, asked: DataFrame) -> DataFrame:
        """The postings of the tokens that are asked for (token)."""
        listed = [r["token"] for r in asked.limit(ASKED + 1).collect()]
        if len(listed) <= ASKED:
            return self.table.among(listed)
        return self.table.read().join(small(asked, 50_000), "token", "left_semi")


def asked_tokens(requests: DataFrame) -> DataFrame:
    """(query_id, scope, token) of requests (query_id, scope, q): the first few tokens of each question."""
    return requests.select("query_id", "scope", F.explode(query_tokens(F.col("q"))).alias("token"))


def text_legs(postings: DataFrame, asked: DataFrame, leg: int) -> DataFrame:
    """(query_id, obs_id, src, rank): of each request the newest rows that hold one of its tokens and that it may see.

    Of a token, no request takes more than its `leg` newest rows open to all, and as many of its own scope's. These are
    cut first, on the map side already, so neither a frequent token nor one that many ask for joins more."""
    gate = F.when(~F.col("open"), F.col("scope"))
    order = [F.col("ts").desc(), F.col("obs_id")]
    # Rows that are closed and of no scope are seen by nobody.
    rows = postings.where("open or scope is not null").withColumn("gate", gate)
    if "batch" not in rows.columns:
        rows = rows.withColumn("batch", F.lit(0))
    newest = rows.withColumn("n", F.row_number().over(Window.partitionBy("token", "gate").orderBy(*order, "batch", "row"))).where(F.col("n") <= leg)
    # What is open to all goes by the empty gate; other scopes' closed rows are never joined.
    newest = newest.select("token", F.col("gate").isNull().alias("free"), F.coalesce("gate", F.lit("")).alias("gate"), "ts", "obs_id", "batch", "row")
    gates = F.array(F.struct(F.lit(True).alias("free"), F.lit("").alias("gate")), F.struct(F.lit(False).alias("free"), F.col("scope").alias("gate")))
    hits = asked.select("query_id", "token", F.inline(gates)).join(newest, ["token", "free", "gate"])
    hits = hits.dropDuplicates(["query_id", "batch", "row"])
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= leg)
    return ranked.select("query_id", "obs_id", F.lit("txt").alias("src"), "rank")


@dataclass
class ReferenceIndex:
    """Which rows name an entity: a table in buckets of (ref, shard), and how many shards the entities of very many have."""

    table: str
    shards: DataFrame

    def drop(self) -> None:
        self.shards.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table}")


def index_references(observations: DataFrame, table: str, path: str, buckets: int = 8, hot: int = HOT_REFS) -> ReferenceIndex:
    """Write the references of observations as `table`, with what a hit shows of its row.

    Each entity's rows lie in one bucket, so requests that are dealt out by entity meet them where they are. An entity
    that more than `hot` rows name is dealt over shards of about as many: only a total over `hot` of such entities are
    there, which are broadcast. Null references, and rows without any, have no posting; a row that names an entity twice
    has one."""
    rows = observations.withColumn("row", F.monotonically_increasing_id())
    each = rows.select(F.explode(F.array_distinct("entity_refs")).alias("ref"), "row", "obs_id", "ts", "kind", excerpt(F.col("content")).alias("excerpt"), "scope", "confidentiality").where("ref is not null")
    counts = each.groupBy("ref").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    shards = materialise(counts.select("ref", F.ceil(F.col("n") / hot).cast("int").alias("shards")), "hot-references")
    each = each.join(F.broadcast(shards), "ref", "left").withColumn("shard", F.pmod(F.hash("row"), F.coalesce("shards", F.lit(1)))).drop("shards")
    each.repartition(buckets, "ref", "shard").write.bucketBy(buckets, "ref", "shard").sortBy("ref", "shard").option("path", path).mode("overwrite").saveAsTable(table)
    return ReferenceIndex(table, shards)


def observations_by_reference(ids: DataFrame, index: ReferenceIndex) -> DataFrame:
    """As `enrich.observations_leg`, over the index: ids (query_id, caller, id).

    The postings stay in their buckets: requests come to them, and each entity's newest rows for a request are cut there,
    before what is left, a few rows for each id, goes to its request. There a row that several ids name counts once."""
    postings = index.shards.sparkSession.table(index.table)
    spread = ids.join(F.broadcast(index.shards), F.col("id") == F.col("ref"), "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.coalesce("shards", F.lit(1)) - 1)))
    asked = spread.select("query_id", "caller", F.col("id").alias("ref"), "shard")
    seen = postings.join(asked, ["ref", "shard"]).where((F.col("scope") == F.col("caller")) | (F.col("confidentiality") == "internal"))
    order = [F.col("ts").desc(), F.col("obs_id"), F.col("row")]
    near = seen.withColumn("n", F.row_number().over(Window.partitionBy("ref", "shard", "query_id").orderBy(*order))).where(F.col("n") <= OBSERVATIONS)
    rows = near.dropDuplicates(["query_id", "row"]).select("query_id", F.col("obs_id").alias("id"), "ts", "kind", "excerpt", F.col("scope").alias("origin_scope"))
    return top(rows, "query_id", [F.col("ts").desc(), F.col("id")], OBSERVATIONS)
