"""Language identification by rank-order profiles: how far a text's most frequent n-grams are from each language's ranks."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, lean, small_batches

#: Ranks in a profile, and the longest n-gram.
RANKS, ORDER = 400, 3
#: Bits of a character in an n-gram: its code point and one, so that three fit 63 bits and none is 0.
BITS = 21
SPACE = 33
UNKNOWN = "und"
#: A profile's n-grams are collected for so many languages at most; more labels than this are no languages.
MOST_LANGUAGES = 2000
#: The pipeline keeps a document from so much of a low quantile of the labelled rows' scores on, by number of letters;
#: sizes with too few labelled rows go by all of them, and where those are too few too, LEAST_SCORE is all that is asked.
LOW, SLACK, ENOUGH = 0.01, 0.85, 200
LEAST_SCORE = 0.1
#: What is neither letter nor mark: of Latin-1 text, the classes of the standard library tell it but for a few numbers;
#: of other text, the categories of Unicode do.
_LATIN_REST = re.compile(r"[\W\d_\u00b2\u00b3\u00b9\u00bc-\u00be]+")
_REST, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def codes(text: str) -> np.ndarray:
    """Lower-case letters of a text, with their marks, as codes; each run of other characters as one space, a space at
    either end. Nothing, if the text has no letter."""
    latin = _is_latin(text)
    if not latin and not _LETTER.search(text):
        return np.zeros(0, np.uint64)
    text = (_LATIN_REST if latin else _REST).sub(" ", text.lower()).strip()
    return np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1) if text else np.zeros(0, np.uint64)


def grams(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of up to three codes, packed, and their counts. Spaces alone don't count."""
    one, two = np.uint64(BITS), np.uint64(2 * BITS)
    g = np.concatenate([c[c != SPACE], (c[:-1] << one) | c[1:], (c[:-2] << two) | (c[1:-1] << one) | c[2:]])
    g.sort()
    cut = np.flatnonzero(np.diff(g, prepend=np.uint64(0)))
    return g[cut], np.diff(np.append(cut, len(g)))


def ranked(g: np.ndarray, n: np.ndarray, most: int = RANKS) -> np.ndarray:
    """The most frequent n-grams, ties by code."""
    if len(g) > most:
        least = np.partition(n, len(n) - most)[len(n) - most]
        keep = n >= least
        g, n = g[keep], n[keep]
    return g[np.lexsort((g, -n))][:most]


def _count(batches):
    """n-gram counts of each language in a partition; flushed when the table grows, so memory is bounded."""
    held: dict[str, list] = {}

    def flush():
        for lang, parts in held.items():
            g, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
        held.clear()

    size = 0
    for b in batches:
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
            c = codes(text)
            if not len(c):
                continue
            g, n = grams(c)
            held.setdefault(lang, []).append((g, n))
            size += len(g)
            if size > 4_000_000:
                yield from flush()
                size = 0
    yield from flush()


def train(docs: DataFrame, ranks: int = RANKS) -> dict[str, list[int]]:
    """{language: its most frequent n-grams, most frequent first} from all rows of docs (text, lang) with both.

    Counts are added up over the whole table; only the top `ranks` of each language reach the driver."""
    small_batches(docs.sparkSession)
    counts = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(lean(_count), "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # A sorted prefix in each language, without a task that holds all n-grams of one: candidates from each of 64 parts first.
    from pyspark.sql import Window

    part = F.pmod(F.xxhash64("gram"), F.lit(64))
    order = [F.col("n").desc(), F.col("gram")]
    near = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("r") <= ranks)
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= ranks)
    rows = top.select("lang", "gram", "r").limit(MOST_LANGUAGES * ranks + 1).collect()
    if len(rows) > MOST_LANGUAGES * ranks:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    out: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["r"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def predict(docs: DataFrame, profiles: dict[str, list[int]], ranks: int = RANKS) -> DataFrame:
    """docs with lang_pred and lang_score (0 to 1); columns of these names are replaced.

    A text's most frequent n-grams, ranked, are compared with each profile: the sum of how far each is out of place,
    `ranks` for those a profile lacks. The least distance wins, ties by name; the score is one less the distance over
    the greatest there could be. Texts that are null or hold no letter are `und` with score 0, as is every text where
    nothing was learned; texts are taken whole, whatever their length; repeated rows are judged each, other columns
    stay, and an empty table gives no rows."""
    names = sorted(profiles)
    vocabulary = np.unique(np.array([g for p in profiles.values() for g in p], np.uint64))
    table = np.full((len(vocabulary) + 1, len(names)), -1, np.int32)
    for k, name in enumerate(names):
        table[np.searchsorted(vocabulary, np.array(profiles[name], np.uint64)), k] = np.arange(len(profiles[name]))
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "lang_score")

    def one(text):
        if text is None or not names:
            return UNKNOWN, 0.0
        c = codes(text)
        if not len(c):
            return UNKNOWN, 0.0
        g = ranked(*grams(c), ranks)
        at = np.minimum(np.searchsorted(vocabulary, g), len(vocabulary) - 1)
        there = table[np.where(vocabulary[at] == g, at, len(vocabulary))]
        far = np.where(there >= 0, np.minimum(np.abs(there - np.arange(len(g))[:, None]), ranks), ranks).sum(axis=0)
        k = int(far.argmin())
        return names[k], float(1 - far[k] / (ranks * len(g)))

    def label(batches):
        for b in batches:
            found = [one(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*b.schema.names, "lang_pred", "lang_score"])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return docs.mapInArrow(lean(label), schema)


def size_class() -> Column:
    """The power of two that a text's number of letters reaches."""
    return F.floor(F.log2(F.greatest(F.length(F.regexp_replace("text", r"\P{L}+", "")), F.lit(1))))


def least_score(scored: DataFrame) -> Column:
    """The score asked of a row of `scored` (lang, lang_pred, lang_score, and lang_size by size_class), told from its rows
    with a label."""
    known = scored.where(F.col("lang").isNotNull() & (F.col("lang_pred") != UNKNOWN))
    stats = [F.count("*").alias("n"), F.percentile_approx("lang_score", LOW, 10_000).alias("low")]
    asked = lambda r: max(LEAST_SCORE, SLACK * r["low"]) if r["n"] >= ENOUGH else None
    every = asked(known.agg(*stats).first()) or LEAST_SCORE
    out = F.lit(every)
    for r in known.groupBy("lang_size").agg(*stats).collect():
        out = F.when(F.col("lang_size") == r["lang_size"], asked(r) or every).otherwise(out)
    return out


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def op8_rank_order_profiles(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    # Rows without an id are held out of training too: their remainder isn't known.
    profiles = train(docs.where(~F.coalesce(held_out(), F.lit(True))))
    out = predict(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(True)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
