"""Resampling towards a target: documents whose n-grams are more frequent in the target than in the corpus are drawn first."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, chunks, documents, lean, materialise, small_batches

#: Words in a feature, buckets that features are hashed to, words that a document needs to be drawn, percent that are drawn.
N_GRAM, BUCKETS, LEAST_WORDS, PERCENT = 1, 10_000, 20, 10
SEED = "2024"
#: Bytes of text in one suffix array: some 700,000 words.
SLICE = 4 << 20
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def word_ids(data: np.ndarray, at: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(id, doc) of each word of the documents a..b, and the words by id: lower-cased runs of letters, digits and all
    beyond ASCII. Words are told apart by their bytes, not by a hash."""
    seg, edge = _LOWERED[data[at[a] : at[b]]], at[a : b + 1] - at[a]
    solid = _IN_WORD[seg]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = edge[1:-1]
    inner = inner[(inner > 0) & (inner < len(seg))]
    first[inner], last[inner - 1] = solid[inner], solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(seg[solid])])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), np.searchsorted(edge, start, "right") - 1, coded.dictionary.to_pylist()


def suffix_array(ids: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, lcp, left): suffixes of the documents' word ids in order of their first n words, how many words each has in
    common with the one before it, and how many of n each has left in its document."""
    size = len(ids)
    left = np.minimum(np.searchsorted(doc, doc, "right") - np.arange(size), n)
    keys = np.zeros((n, size), np.int64)
    for k in range(n):
        keys[k, : size - k] = ids[k:] + 1
        keys[k, left <= k] = 0
    order = np.argsort(keys[0], kind="stable") if n == 1 else np.lexsort(keys[::-1])
    lcp, same = np.zeros(size, np.int64), np.ones(max(size - 1, 0), bool)
    for k in range(n):
        own = keys[k, order]
        same = same & (own[1:] == own[:-1]) & (own[1:] > 0)
        lcp[1:] += same
    return order, lcp, left


def features(column: pa.Array, n: int = N_GRAM, buckets: int = BUCKETS) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
    """(first row, last row, words of each row, [(row, bucket) of every occurrence of a run of 1 to n words]) by slices.

    Of a slice's suffix array, rows whose common prefix is k words or more in a row are the occurrences of one k-gram. It
    is hashed once, and its bucket goes back to the places of all of them."""
    data, at = buffers(column)
    for i, j in chunks(at, SLICE):
        ids, doc, words = word_ids(data, at, i, j)
        order, lcp, left = suffix_array(ids, doc, n)
        found = []
        for k in range(1, n + 1):
            long = left[order] >= k
            own, new = order[long], (lcp < k)[long]
            first = own[new]
            if k == 1:
                grams = (words[w] for w in ids[first].tolist())
            else:
                grams = (b" ".join([words[w] for w in ids[p : p + k].tolist()]) for p in first.tolist())
            bucket = np.array([zlib.crc32(g) % buckets for g in grams], np.int64)
            place = np.zeros(len(ids), np.int64)
            place[own] = bucket[np.cumsum(new) - 1]
            holds = left >= k
            found.append((doc[holds], place[holds]))
        yield i, j, np.bincount(doc, minlength=j - i), found


def bucket_counts(texts: DataFrame, n: int = N_GRAM, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of features in each bucket, over all texts. Each task adds up its own, so that at most `buckets` rows of
    a task are shuffled and as many reach the driver."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, _, found in features(b.column("text"), n, buckets):
                for _, bucket in found:
                    total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(lean(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousandth of a natural logarithm is one: how much likelier a bucket's features are in the target, each count one
    more than it is."""
    all_s, all_t, many = int(corpus.sum()), int(target.sum()), len(corpus)
    pairs = zip(corpus.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (all_s + many)) / float((s + 1) * (all_t + many)))) for s, t in pairs], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, n: int = N_GRAM, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_features, weight): weight is the floored mean of the gains of a document's features."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for b in batches:
            for i, j, n_words, found in features(b.column("text"), n, len(gain)):
                size, total = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                for doc, bucket in found:
                    ends = np.searchsorted(doc, np.arange(j - i + 1))
                    sums = np.concatenate([[0], np.cumsum(gain[bucket])])
                    size, total = size + np.diff(ends), total + np.diff(sums[ends])
                weight = np.where(size > 0, total // np.maximum(size, 1), 0)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(n_words), pa.array(size), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).alias("doc_id"), "text").mapInArrow(lean(run), f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, n: int = N_GRAM, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document: rank says in which order those drawn come, or is null.

    Features are runs of 1 to n words. Each is hashed to one of `buckets`; a bucket's gain tells target from corpus, and
    a document's weight is the mean over its features. Noise of a Gumbel distribution, by a hash of seed and id, makes
    taking the highest scores a draw without replacement by weight. Of the documents with least_words or more, `percent`
    in a hundred are drawn, rounded down; ties go to the smaller id, null ids last.
    Scores are whole numbers of a range that follows from `buckets` and the noise, some 100,000 at most, so their
    histogram is bounded: it gives each score's first rank, and only places among equal scores are told by a window.
    Null and empty texts have no features, weight 0, and aren't drawn; a text of any length is counted as a whole; a null
    id is hashed as an empty one; repeated rows are drawn each; an empty corpus gives no rows, an empty target only
    flattens the gains; other columns are left out."""
    small_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = materialise(weigh(docs, gain, n, id_col).withColumn("score", F.col("weight") + noise), "scored")
    fit = F.col("n_words") >= least_words
    first, before, cut = [], 0, None
    by_score = [(r["score"], r["count"]) for r in scored.where(fit).groupBy("score").count().orderBy(F.desc("score")).collect()]
    most = sum(c for _, c in by_score) * percent // 100
    for score, count in by_score:
        if before >= most:
            break
        first.append((score, before))
        before, cut = before + count, score
    drawn = fit & (F.col("score") >= cut) if cut is not None else F.lit(False)
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "weight", "n_features"))
    starts = F.broadcast(docs.sparkSession.createDataFrame(first, "score long, before long"))
    rank = F.col("before") + place
    best = scored.where(drawn).join(starts, "score").withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    rest = scored.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    told = ["doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank")]
    return best.select(*told).unionByName(rest.select(*told))


def op11_resample(spark, sf_dir):
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: crc32 of each distinct word, byte by byte, by the table that eight steps of its polynomial give.
OP11_SQL = """WITH RECURSIVE steps AS (SELECT range AS b, range::BIGINT AS c, 0 AS k FROM range(256) UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
said AS (SELECT doc_id, false AS target, text FROM documents UNION ALL SELECT NULL, true, text FROM benchmark),
rows AS (SELECT doc_id, target, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM said),
words AS (SELECT r, target, unnest(ws) AS w FROM rows),
known AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(hex(encode(w))) // 2), lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::INT, 2))::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT w FROM words), crc),
counts AS (SELECT bucket, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM words JOIN known USING (w) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM counts) + 10000))::DOUBLE / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000))::DOUBLE))::BIGINT AS g FROM counts),
weighed AS (SELECT r, floor(sum(g) / count(*))::BIGINT AS weight FROM words JOIN known USING (w) JOIN gain USING (bucket) WHERE NOT target GROUP BY r),
scored AS (SELECT doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM rows LEFT JOIN weighed USING (r) WHERE NOT target),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS n FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_features >= 20 AND n <= (SELECT count(*) * 10 // 100 FROM scored WHERE n_features >= 20) THEN n END AS rank FROM ranked"""
