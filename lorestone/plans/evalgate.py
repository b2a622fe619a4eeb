"""The recall gate: questions, the entities that their hits must name, and a score that may not fall."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.embedding import Embedder
from ..functions.entities import normalize
from ..operators.similar import request_error, similar_many
from ..operators.versioned import ENTITY_KEY, latest
from ..scratch import materialise
from ..sources.configs import EvalFile


def recall(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """(passed, total, score) from hits (query_id, entity_ids) and expectations (query_id, entity_id; null for a key that
    doesn't resolve). A question passes if every expectation is among its hits' entities."""
    got = hits.select("query_id", F.explode("entity_ids").alias("entity_id")).distinct().withColumn("hit", F.lit(True))
    each = expected.join(got, ["query_id", "entity_id"], "left").groupBy("query_id").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("passed"))
    return each.agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"), F.avg(F.col("passed").cast("double")).alias("score"))


def regressed(score: float, last: float | None) -> bool:
    return last is not None and score + 1e-9 < last


@dataclass
class Score:
    passed: int
    total: int
    errored: int

    @property
    def value(self) -> float:
        return self.passed / self.total if self.total else 0.0


def ask(questions: DataFrame, expected: DataFrame, observations: DataFrame, entities: DataFrame) -> DataFrame:
    """questions (query_id, scope, q, qvec, k) with `error` and `passed`: whether the hits of a question name every entity
    that it must, by expected (query_id, raw): a key in the question's scope.

    One plan asks all questions. A question with an error isn't asked and passes nothing; one that expects nothing passes
    if it can be asked; a key that is no entity's is missed."""
    checked = questions.withColumn("error", request_error())
    hits = similar_many(observations, questions)
    got = hits.select("query_id", F.explode("entity_ids").alias("entity_id")).distinct().withColumn("hit", F.lit(True))
    keys = expected.join(questions.select("query_id", "scope"), "query_id").withColumn("n", normalize(F.col("raw"))).select("query_id", "scope", F.col("n.type").alias("entity_type"), F.col("n.key").alias("key"))
    known = latest(entities, ENTITY_KEY, "updated_at", "entity_id").select(*ENTITY_KEY, "entity_id")
    each = keys.join(known, ENTITY_KEY, "left").join(got, ["query_id", "entity_id"], "left")
    missed = each.where("hit is null").select("query_id").distinct().withColumn("missed", F.lit(True))
    return checked.join(missed, "query_id", "left").withColumn("passed", F.col("missed").isNull() & F.col("error").isNull()).drop("missed")


def run_evals(files: list[EvalFile], observations: DataFrame, entities: DataFrame, embed: Embedder | None = None) -> tuple[Score, DataFrame]:
    """(score, rows): each question asked, and whether the entities that it must reference, by key in the file's scope,
    are among those of its hits, as in `ask`. Questions that can't be asked are counted apart and take no part in the
    score. Rows are (query_id, scope, q, passed)."""
    spark = observations.sparkSession
    every = [(f"{i:06d}", f.scope, q) for i, (f, q) in enumerate((f, q) for f in files for q in f.queries)]
    vectors = embed("query", [q.q for _, _, q in every]) if embed and every else [None] * len(every)
    questions = spark.createDataFrame([(i, scope, q.q, v, q.k) for (i, scope, q), v in zip(every, vectors)], "query_id string, scope string, q string, qvec array<double>, k int")
    expected = spark.createDataFrame([(i, k) for i, _, q in every for k in q.must_reference_entities], "query_id string, raw string")
    rows = materialise(ask(questions, expected, observations, entities).select("query_id", "scope", "q", "passed", "error"), "evals")
    passed, asked, errored = rows.agg(F.count_if("passed"), F.count_if(F.col("error").isNull()), F.count_if(F.col("error").isNotNull())).first()
    return Score(passed, asked, errored), rows.where("error is null").drop("error")


def keep_score(path: str, score: float) -> bool:
    """Whether the score holds up against the one in a file, which it then replaces; a worse one leaves the file."""
    file = Path(path)
    try:
        last = float(file.read_text().strip())
    except (OSError, ValueError):
        last = None
    if regressed(score, last):
        return False
    file.write_text(f"{score:.4f}\n")
    return True
