"""From raw documents to packed training sequences: five stages, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestone.llm.common import documents, forget, materialise, unused
from lorestone.llm.language import UNKNOWN, least_score, predict, size_class, train
from lorestone.llm.lines import dedup_lines
from lorestone.llm.minhash import near_duplicates
from lorestone.llm.mixing import mix
from lorestone.llm.packing import pack
from lorestone.llm.tokens import public_path


def aside(docs: DataFrame, prefix: str) -> tuple[DataFrame, list[Column]]:
    """docs with the columns that an operator would take for its own under other names, and what brings them back."""
    names = {c: unused(docs, f"aside_{i}") if c.lower().startswith(prefix) else c for i, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed({c: n for c, n in names.items() if c != n}), [F.col(n).alias(c) for c, n in names.items()]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without a letter, or like no profile, go. Null languages are filled in.

    Null and empty texts have no letter, so they go; texts of any length are judged as a whole; rows with equal texts, or
    one id, are judged each; ids play no part; all columns stay; an empty table stays empty."""
    slim, back = aside(docs, "lang_")
    out = materialise(predict(slim, train(slim)).withColumn("lang_size", size_class()), "languages")
    keep = (F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= least_score(out))
    out = out.where(keep).withColumn("lang", F.coalesce("lang", "lang_pred"))
    return out.select(*back)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each repeated line at its first place only, from two documents on; a document of such lines alone goes.

    Null and empty texts and rows without an id stay as they are; of rows that repeat an id, equal lines at equal places
    are one place, so all keep or lose it alike; ties go to the smaller id and line; other columns stay, whatever their
    names, and n_chars is counted anew; an empty table stays empty."""
    slim, back = aside(docs, "ld_")
    out = dedup_lines(slim, short=True)
    out = out.where((F.col("ld_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Rows without an id stay, as do texts that are null or hold no word; of rows that share the smallest id, one text of
    the group stays, and repeated rows of it once, that with the least hash of its JSON; rows of one id with texts that aren't alike stay each; other columns
    stay, whatever their names; an empty table stays empty."""
    found = near_duplicates(docs).where("doc_id is not null and component is not null")
    one = found.groupBy("component", "doc_id", "text_key").agg(F.count("*").alias("n")).groupBy("component").agg(F.min(F.struct("doc_id", "text_key", "n")).alias("k"))
    own_id, own_key, n, place = (unused(docs, c) for c in ("nd_id", "nd_key", "nd_n", "nd_row"))
    kept = materialise(one.select(F.col("k.doc_id").alias(own_id), F.col("k.text_key").alias(own_key), F.col("k.n").alias(n)), "kept")
    named = docs.join(kept, (F.col("doc_id") == F.col(own_id)) & (F.xxhash64("text") == F.col(own_key)))
    # Copies combine where they are: of a row that stands in a third of the table each task sends one.
    row = F.struct(*docs.columns)
    again = named.where(F.col(n) > 1).groupBy(own_id, own_key).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias(place)).select(f"{place}.*")
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rest = docs.where(F.col("doc_id").isNull() | wordless)
    return named.where(F.col(n) == 1).select(*docs.columns).unionByName(again.select(*docs.columns)).unionByName(rest)


def mix_by_weight(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source repeated or thinned to its target weight, a document as a whole.

    Null and empty texts have no size and come as often as their source's rate says; a source of such alone has the
    target 0 and goes; null is a source of its own; rows that repeat an id are drawn alike; other columns stay, whatever
    their names; an empty table stays empty."""
    slim, back = aside(docs, "mix_")
    return mix(slim).select(*back)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 token ids, like documents together: the columns of `pack`, and none of the documents'.

    Null and empty texts are the end id alone; long texts span several sequences; repeated rows are packed each, in the
    order of ids where texts tie; a null id stays null; an empty table gives no rows."""
    return pack(docs, public_path("byte_bpe_50k.json"))


STAGES = [
    ("language", identify_language),
    ("lines", drop_boilerplate),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix_by_weight),
    ("pack", pack_sequences),
]
#: Language profiles, near duplicates and token ids can't be told in SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
