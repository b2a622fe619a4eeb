"""Token ids in directly addressable codes: any id can be read without decoding what comes before it.

A shard's ids are cut into chunks of `BITS` bits, lowest first. Level 0 holds the lowest chunk of every id, level k that
of the ids which need more than k chunks, in order. A bitmap beside each level says which ids go on, and its rank
directory holds the number of ones before each word of 64 bits; so the place of an id in the next level is one rank."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, gathered, lean, partitions, scratch, small_batches
from .tokens import SLICE, encoded, encoder, id_dtype, public_path

MAGIC = b"DAC1"
BITS = 8
END_ID = 2
#: Ids in a shard, at least; a document is never split over shards.
SHARD_IDS = 1 << 20
#: Up to so many shards, 24 bytes each, their starts are sent to every executor, and no block moves; beyond, the join
#: shuffles.
BROADCAST_SHARDS = 100_000


def dac_encode(ids: np.ndarray) -> bytes:
    """Header: magic, number of ids, number of levels; then for each level: its length, chunks, bitmap words, ranks."""
    out, left, levels = [], ids.astype(np.uint32), 0
    while True:
        more = left >> BITS
        goes_on = more > 0
        words = np.packbits(np.pad(goes_on, (0, -len(left) % 64)), bitorder="little").view("<u8")
        ones = np.bitwise_count(words).astype(np.uint32)
        ranks = (np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4")
        out += [struct.pack("<I", len(left)), (left & ((1 << BITS) - 1)).astype(np.uint8).tobytes(), words.tobytes(), ranks.tobytes()]
        levels += 1
        if not goes_on.any():
            return MAGIC + struct.pack("<IB", len(ids), levels) + b"".join(out)
        left = more[goes_on]


class Dac:
    """Random access to the ids of one shard."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a shard of directly addressable codes")
        self.n, levels = struct.unpack_from("<IB", blob, 4)
        at, self.levels = 9, []
        for _ in range(levels):
            (n,) = struct.unpack_from("<I", blob, at)
            at, words = at + 4, -(-n // 64)
            chunk = np.frombuffer(blob, np.uint8, n, at)
            bits = np.frombuffer(blob, "<u8", words, at + n)
            ranks = np.frombuffer(blob, "<u4", words, at + n + 8 * words)
            at += n + 12 * words
            self.levels.append((chunk, bits, ranks))

    def take(self, places: np.ndarray) -> np.ndarray:
        """The ids at these places, whichever they are."""
        places = np.asarray(places, np.int64)
        out, who = np.zeros(len(places), np.uint32), np.arange(len(places))
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            out[who] |= chunk[places].astype(np.uint32) << np.uint32(BITS * k)
            word, bit = places >> 6, (places & 63).astype(np.uint64)
            on = (bits[word] >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            who, places = who[on], (ranks[word].astype(np.int64) + below)[on]
            if not len(who):
                break
        return out


def range_bounds(docs: DataFrame, parts: int) -> list[tuple]:
    """Where each of at most `parts` ranges of about as many rows begins: (id is given, id, hash of the text, row)."""
    slim = docs.select("given", "doc_id", "h", "row")
    firsts = slim.repartitionByRange(parts, *slim.columns).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*slim.columns)).alias("k"))
    return sorted(tuple(r["k"]) for r in firsts.collect())


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id") -> DataFrame:
    """Encode all documents, write them as shards in ascending order of id (null first, ties by a hash of the text), and
    read them back.

    A row of the written table is a shard: its number (partition and place there), the ids of its documents, how many
    token ids each has, and the encoded block. Ranges are laid over ids and hashes, of which as many bounds as there are
    shuffle partitions reach the driver; each text is then encoded where it is read, and the shuffle moves token ids.
    Rows that share an id, even with one text, are spread over ranges. Null and empty texts are the end id alone;
    repeated rows are kept; an empty table gives no shards."""
    small_batches(docs.sparkSession)
    dtype = id_dtype(tokenizer)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text")
    docs = docs.select(F.col("doc_id").isNotNull().cast("int").alias("given"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"), "text")
    bounds = range_bounds(docs, partitions(docs.sparkSession))

    def encode(batches):
        from_text = encoder(tokenizer)
        for b in gathered(batches, "text", SLICE):
            places = [bisect_right(bounds, k) - 1 for k in zip(*(b.column(c).to_pylist() for c in ("given", "doc_id", "h", "row")))]
            for i, j, ids in encoded(b.column("text"), from_text):
                own = [b.column(c).slice(i, j - i) for c in ("given", "doc_id", "h", "row")]
                yield pa.RecordBatch.from_arrays([pa.array(places[i:j], pa.int32()), *own, ids.cast(pa.binary())], names=["range", "given", "doc_id", "h", "row", "ids"])

    def shards(batches):
        part, place = TaskContext.get().partitionId(), 0
        end, held, total = np.array([end_id], dtype).tobytes(), [], 0

        def shard():
            ids = np.frombuffer(b"".join(raw for _, raw in held), dtype)
            counts = [len(raw) // dtype.itemsize for _, raw in held]
            columns = [pa.array([part]), pa.array([place]), pa.array([[d for d, _ in held]], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([dac_encode(ids)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "place", "doc_ids", "counts", "block"])

        for b in batches:
            for given, doc_id, raw in zip(*(b.column(c).to_pylist() for c in ("given", "doc_id", "ids"))):
                held.append((doc_id if given else None, raw + end))
                total += len(raw) // dtype.itemsize + 1
                if total >= SHARD_IDS:
                    yield shard()
                    held, total, place = [], 0, place + 1
        if held:
            yield shard()

    coded = docs.mapInArrow(lean(encode), "range int, given int, doc_id long, h long, row long, ids binary")
    ordered = coded.repartitionById(max(1, len(bounds)), "range").sortWithinPartitions("given", "doc_id", "h", "row").select("given", "doc_id", "ids")
    schema = "part long, place long, doc_ids array<long>, counts array<long>, block binary"
    ordered.mapInArrow(lean(shards), schema).write.parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """shards with `start`: the token ids of all shards before it.

    Totals of parts are a row for each written partition, so the only window without a key is as short as their number;
    within a part a window runs over the part's shards."""
    from pyspark.sql import Window

    slim = shards.select("part", "place", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"))
    parts = slim.groupBy("part").agg(F.sum("ids").alias("total"))
    parts = parts.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = slim.select("part", "place", inside.alias("inside")).join(parts, "part")
    starts = starts.select("part", "place", (F.col("before") + F.col("inside")).alias("start"))
    if shards.select("part").limit(BROADCAST_SHARDS + 1).count() <= BROADCAST_SHARDS:
        starts = F.broadcast(starts)
    return shards.join(starts, ["part", "place"])


def read_ids(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the written codes."""

    def decode(batches):
        for b in batches:
            for doc_ids, counts, block, start in zip(*(b.column(c).to_pylist() for c in ("doc_ids", "counts", "block", "start"))):
                ends = np.cumsum(counts)
                ids = Dac(block).take(np.arange(ends[-1]))
                crc = [zlib.crc32(ids[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends.tolist(), counts)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends - np.array(counts)), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shard_starts(shards).select("doc_ids", "counts", "block", "start").mapInArrow(lean(decode), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_dac_ids(spark, sf_dir):
    return read_ids(write_ids(documents(spark, sf_dir), scratch(spark, "ids"), public_path("word_bpe_49k.json")))
