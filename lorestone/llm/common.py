"""Shared pieces of the corpus operators: scratch tables, vectorised words and hashes, key-scattered blobs."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import forget, scratch, sweep  # noqa: F401
from ..scratch import materialise as write_scratch

#: One or more characters that are neither blank nor \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Bytes of text handled at once: arrays of eight bytes for each fit the caches, and memory stays flat.
CHUNK = 1 << 19
#: Rows and bytes of an Arrow batch between the JVM and Python, where the session leaves Spark's own: 10,000 documents
#: would be held several times over by either side.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
_ROWS, _BYTE_LIMIT = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless it has bounds of its own."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(BATCH_ROWS))
        spark.conf.set(_BYTE_LIMIT, str(BATCH_BYTES))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df as a written table, by small batches."""
    small_batches(df.sparkSession)
    return write_scratch(df, name)


def _release() -> None:
    """Give back memory that this worker, which tasks of other stages will use, no longer needs."""
    powers.cache_clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(run: Callable) -> Callable:
    """run, for mapInArrow: over batches with rows only, and without memory kept after the task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(b for b in batches if b.num_rows)
        finally:
            _release()

    return task


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches, joined to batches of about `most` bytes of a text column."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random uint64."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15))


_BASE = 0x5851F42D4C957F2D
_BYTES = stream(1, 256)
#: The same table with A-Z hashed as a-z.
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, _BASE, np.uint64)) * np.uint64(inverse)
        down = np.cumprod(np.full(n, inverse, np.uint64)) * np.uint64(_BASE)
    return up, down


def prefix_hash(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums, inverse powers): the hash of values[i:j] is (p[j] - p[i]) * inv[i], whatever i is."""
    n = 1 << max(16, (len(values) + 1).bit_length())
    up, down = powers(n)
    p = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=p[1:])
    return p, down


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data, at


def chunks(at: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes; a longer document comes alone."""
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


class Words:
    """Words of the documents a..b of a text column: start, end (in `seg`), doc (from 0), hash."""

    def __init__(self, data: np.ndarray, at: np.ndarray, a: int, b: int, lower: bool = False, hashed: bool = True):
        self.seg = seg = data[at[a] : at[b]]
        self.at = at[a : b + 1] - at[a]
        solid = ~SPACE[seg]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        edges = self.at[1:-1]
        edges = edges[(edges > 0) & (edges < len(seg))]
        first[edges] = solid[edges]
        last[edges - 1] = solid[edges - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.at, self.start, "right") - 1
        self.n = np.bincount(self.doc, minlength=b - a)
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        if hashed:
            p, inverse = prefix_hash((_LOWER if lower else _BYTES)[seg])
            self.hash = mix64((p[self.end] - p[self.start]) * inverse[self.start])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word windows, and whether each lies in one document."""
        m = len(self.hash) - k + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = np.zeros(m, np.uint64)
        for i, c in enumerate(stream(2, k) | np.uint64(1)):
            out += self.hash[i : m + i] * c
        return mix64(out), self.doc[:m] == self.doc[k - 1 :]


def scatter(key: np.ndarray, columns: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Rows (bucket, payload): the entries of each bucket, packed column after column; key % buckets deals them out.

    Moving blobs instead of rows keeps the per-row cost of the JVM off tens of millions of tiny entries."""
    bucket = (key % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    ends = np.append(cuts[1:], len(order))
    columns = [c[order] for c in columns]
    blobs = [b"".join(c[i:j].tobytes() for c in columns) for i, j in zip(cuts, ends)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[order][cuts], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "payload"])


def gather(payloads: list[bytes], kinds: list[np.dtype]) -> list[np.ndarray]:
    """The columns of scattered blobs."""
    width, parts = sum(np.dtype(k).itemsize for k in kinds), [[] for _ in kinds]
    for p in payloads:
        n, i = len(p) // width, 0
        for part, k in zip(parts, kinds):
            part.append(np.frombuffer(p, k, n, i))
            i += n * np.dtype(k).itemsize
    return [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds)]


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


#: Rows of one key that a task may hold before its key counts as hot, and hot keys at most, as a share of all rows.
HOT_ROWS, HOT_KEYS = 10_000, 20_000


def split_join(rows: DataFrame, small: DataFrame, key: str, sizes: DataFrame, count: str) -> DataFrame:
    """rows joined to `small`, which has one row a key; sizes (key, count) says how many rows a key has at least.

    Rows of hot keys stay where they are and meet a broadcast copy: a key is hot from HOT_ROWS rows on, or from as many as
    leave HOT_KEYS hot keys at most, so the copy is bounded whatever the table. The rest is joined by key."""
    total = sizes.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(sizes.where(F.col(count) >= max(HOT_ROWS, total // HOT_KEYS)).select(key))
    mark = unused(rows, "is_hot")
    cold = rows.join(hot.withColumn(mark, F.lit(True)), key, "left").where(F.col(mark).isNull()).drop(mark)
    return rows.join(F.broadcast(small.join(hot, key, "left_semi")), key).unionByName(cold.join(small, key))


class Forest:
    """Union-find over 0..n-1; the smallest member leads."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


#: Up to so many edges of partitions' forests, one task joins them: 16 MB. More are joined by rounds over all executors.
EDGES_AT_ONCE = 1_000_000


def _thin(batches):
    """Each partition's edges as a forest of stars that lead to the smallest member; folded now and then."""
    lead: dict[int, int] = {}

    def find(x):
        top = x
        while (up := lead.get(top, top)) != top:
            top = up
        while (up := lead.get(x, x)) != top and x != top:
            lead[x], x = top, up
        return top

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                lead[max(x, y)] = min(x, y)
    nodes = list(lead)
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b: long): comp is the smallest node reachable.

    Partitions first reduce their edges to forests. If these hold EDGES_AT_ONCE at most, a single task joins them.
    Otherwise stars alternate over DataFrames: minima per node combine on the map side, the joins back to a node's edges
    can be split where a node is hot, each round is a written table, and only one count a round reaches the driver."""
    thin = lambda df: df.mapInArrow(lean(_thin), "a long, b long")
    stars = materialise(thin(edges.select("a", "b").where("a <> b")), "stars")
    if stars.limit(EDGES_AT_ONCE + 1).count() <= EDGES_AT_ONCE:
        one = materialise(thin(stars.coalesce(1)), "stars")
        forget(stars)
        return _named(one)
    was = None
    while True:
        both = stars.select("a", "b").unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        now = materialise(small, "stars")
        forget(stars)
        stars = now
        is_now = stars.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)), F.count_distinct("a")).first()
        if tuple(is_now) == was:
            break
        was = tuple(is_now)
    return _named(stars)


def _named(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
