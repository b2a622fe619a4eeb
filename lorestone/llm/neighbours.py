"""Approximate nearest neighbours: four-bit product codes fitted with a score-aware loss, scanned in blocks, then reranked."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import gather, lean, materialise, scatter

#: Rows the codebooks are fitted on, by the order of a hash of their ids: bounded, whatever the table holds.
SAMPLE = 20_000
#: Components in a subspace, codes of each, and how much heavier the parallel part of a residual weighs.
SUB, CODES, ETA = 2, 16, 4.0
#: Best candidates of each query by codes, in each block at most and of all blocks, that are measured on the original
#: vectors. Rows are dealt to blocks by number, so that several blocks are asked for twice their share of the best.
RERANK, RERANK_ALL = 1000, 1000
#: Rows in a block, least and most; queries in a group, most and least: small tables are dealt over tasks by their queries,
#: so what blocks emit grows with the queries.
BLOCK_LEAST, BLOCK_MOST, GROUP, GROUP_LEAST = 131_072, 131_072, 4096, 64


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that are neither null nor zero, and hold finite numbers only."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>").alias("v"))


def _pad(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % SUB)))


def _split(x: np.ndarray) -> np.ndarray:
    """[n, subspaces, SUB]"""
    return x.reshape(len(x), -1, SUB)


def _directions(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def encode(x: np.ndarray, books: np.ndarray, eta: float = ETA, rounds: int = 2) -> np.ndarray:
    """Codes [n, subspaces] by coordinate descent on |r|^2 + (eta - 1) (r . x/|x|)^2, where r is the residual.

    A residual along the vector shifts its inner products with the queries that lie near, so it weighs more."""
    xs, us = _split(x), _split(_directions(x))
    n, m = xs.shape[:2]
    codes = np.zeros((n, m), np.uint8)
    for s in range(m):
        codes[:, s] = ((xs[:, s, None, :] - books[s][None]) ** 2).sum(-1).argmin(1)
    along = np.zeros(n)
    for s in range(m):
        along += ((xs[:, s] - books[s][codes[:, s]]) * us[:, s]).sum(-1)
    for _ in range(rounds):
        for s in range(m):
            rest = along - ((xs[:, s] - books[s][codes[:, s]]) * us[:, s]).sum(-1)
            r = xs[:, s, None, :] - books[s][None]
            part = (r * us[:, s, None, :]).sum(-1)
            loss = (r**2).sum(-1) + (eta - 1) * (rest[:, None] + part) ** 2
            codes[:, s] = loss.argmin(1)
            along = rest + part[np.arange(n), codes[:, s]]
    return codes


def fit(x: np.ndarray, eta: float = ETA, rounds: int = 6) -> np.ndarray:
    """Codebooks [subspaces, CODES, SUB]: k-means of each subspace, then steps that lower the score-aware loss.

    With the other subspaces held, a code's best place solves a small linear system over the rows that it stands for."""
    xs, us = _split(x), _split(_directions(x))
    n, m = xs.shape[:2]
    rng = np.random.default_rng(0)
    books = np.zeros((m, CODES, SUB))
    for s in range(m):
        books[s] = xs[rng.choice(n, CODES, replace=n < CODES), s]
        for _ in range(8):
            code = ((xs[:, s, None, :] - books[s][None]) ** 2).sum(-1).argmin(1)
            for k in range(CODES):
                if (own := code == k).any():
                    books[s, k] = xs[own, s].mean(0)
    for _ in range(rounds):
        codes = encode(x, books, eta, rounds=1)
        along = sum(((xs[:, s] - books[s][codes[:, s]]) * us[:, s]).sum(-1) for s in range(m))
        for s in range(m):
            rest = along - ((xs[:, s] - books[s][codes[:, s]]) * us[:, s]).sum(-1)
            weight = np.eye(SUB) + (eta - 1) * us[:, s, :, None] * us[:, s, None, :]
            aim = (weight @ xs[:, s, :, None])[..., 0] + (eta - 1) * rest[:, None] * us[:, s]
            for k in range(CODES):
                own = codes[:, s] == k
                if own.any():
                    books[s, k] = np.linalg.lstsq(weight[own].sum(0), aim[own].sum(0), rcond=None)[0]
            along = rest + ((xs[:, s] - books[s][codes[:, s]]) * us[:, s]).sum(-1)
    return books


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _scan(q_ids, q, rows, ids, codes, half, books, rerank):
    """(query_id, row, vec_id, by codes) of each query's best in a block, by table scan; ties go to the smaller vec_id."""
    m = codes.shape[1]
    for i in range(0, len(q), 64):
        qs, q_id = q[i : i + 64], q_ids[i : i + 64]
        tables = np.einsum("qsd,scd->sqc", _split(_pad(qs.astype(np.float64))), books).astype(np.float32)
        score = np.repeat(-half[None], len(qs), 0)
        for s in range(m):
            score += np.take(tables[s], codes[:, s], axis=1)
        score[q_id[:, None] == ids[None]] = -np.inf
        for row in range(len(qs)):
            own = score[row]
            near = np.flatnonzero(own >= np.partition(own, len(own) - rerank)[len(own) - rerank]) if len(own) > rerank else np.arange(len(own))
            near = near[own[near] > -np.inf]
            near = near[np.lexsort((ids[near], -own[near]))][:rerank]
            yield np.full(len(near), q_id[row]), rows[near], ids[near], own[near]


def _measure(batches):
    """The distance of each candidate's vector to its query's, in double precision."""
    for b in batches:
        columns = [b.column(c).combine_chunks() if isinstance(b.column(c), pa.ChunkedArray) else b.column(c) for c in ("q", "v")]
        q, v = (c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1) for c in columns)
        far = np.sqrt(((v - q) ** 2).sum(1))
        yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("vec_id"), pa.array(far)], names=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, rerank: int = RERANK, rerank_all: int = RERANK_ALL, eta: float = ETA, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each query its k nearest vectors by Euclidean distance, its own id left out.

    Least distance is greatest q.x - |x|^2 / 2, an inner product once half the squared norm is kept beside the codes. The
    codebooks are fitted on SAMPLE rows; every row is encoded. Blocks of codes, without their vectors, meet groups of
    queries, so that each pair of them is one bounded task; within it a table of sixteen entries a subspace scores all
    rows. The best of a block, `rerank` or fewer, and of these the best `rerank_all`, are joined to the original vectors and
    measured exactly, in double precision; ties go to the smaller vec_id.
    Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids; vectors of each
    length are searched among themselves, by codebooks of their own; of queries with one id and length, the least vector
    asks; repeated candidate rows are all candidates; with fewer than k, all are returned; an empty table gives no rows;
    other columns are left out."""
    all_v, all_q = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col)
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for (dim,) in all_q.select(F.size("v")).distinct().orderBy(F.size("v")).collect():
        mine = all_q.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
        out = out.unionByName(_of_length(all_v.where(F.size("v") == dim), mine, dim, k, rerank, rerank_all, eta))
    return out


def _of_length(all_v: DataFrame, all_q: DataFrame, dim: int, k: int, rerank: int, rerank_all: int, eta: float) -> DataFrame:
    """`nearest` for vectors of one length."""
    n, n_q = all_v.count(), all_q.count()
    if not n:
        return all_v.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    all_v = materialise(all_v.withColumn("row", F.monotonically_increasing_id()), "vectors")
    sample = all_v.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).toArrow()
    books = fit(_pad(_matrix(sample.column("v"), dim).astype(np.float64)), eta)
    m = books.shape[0]
    blocks = max(1, -(-n // min(BLOCK_MOST, max(BLOCK_LEAST, n // 64))))
    groups = max(1, -(-n_q // min(GROUP, max(GROUP_LEAST, n_q // 16))))
    rerank = max(4 * k, min(rerank, 2 * rerank_all // blocks))

    def index(batches):
        for b in batches:
            x, ids, rows = _matrix(b.column("v"), dim), b.column("vec_id").to_numpy().astype(np.int64), b.column("row").to_numpy().astype(np.int64)
            for i in range(0, len(x), 8192):
                part, own = x[i : i + 8192], rows[i : i + 8192]
                codes = encode(_pad(part.astype(np.float64)), books, eta)
                codes = np.pad(codes, ((0, 0), (0, m % 2)))
                packed = codes[:, ::2] | codes[:, 1::2] << 4
                half = (part.astype(np.float64) ** 2).sum(1).astype(np.float32) / 2
                yield scatter(own.view(np.uint64), [own, ids[i : i + 8192], half, np.ascontiguousarray(packed).view(f"V{packed.shape[1]}").ravel()], blocks)

    def pack(batches):
        for b in batches:
            x, ids = _matrix(b.column("v"), dim), b.column("vec_id").to_numpy().astype(np.int64)
            yield scatter(ids.view(np.uint64) // np.uint64(7), [ids, x.view(f"V{4 * dim}").ravel()], groups)

    half_m = (m + 1) // 2

    def search(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        data = [p for p, a in zip(rows["payload"], rows["asks"]) if not a]
        asks = [p for p, a in zip(rows["payload"], rows["asks"]) if a]
        own, ids, half, packed = gather(data, [np.dtype(np.int64), np.dtype(np.int64), np.dtype(np.float32), np.dtype(f"V{half_m}")])
        q_ids, q = gather(asks, [np.dtype(np.int64), np.dtype(f"V{4 * dim}")])
        found = []
        if len(ids) and len(q_ids):
            packed = packed.view(np.uint8).reshape(-1, half_m)
            codes = np.stack([packed & 15, packed >> 4], 2).reshape(len(packed), -1)[:, :m]
            found = list(_scan(q_ids, q.view(np.float32).reshape(-1, dim), own, ids, codes, half, books, rerank))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.float32)]
        return pa.table({"query_id": columns[0], "row": columns[1], "vec_id": columns[2], "close": columns[3].astype(np.float64)})

    data = all_v.mapInArrow(lean(index), "bucket int, payload binary")
    data = data.select(F.col("bucket").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(False).alias("asks"), "payload")
    asks = all_q.mapInArrow(lean(pack), "bucket int, payload binary")
    asks = asks.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col("bucket").alias("grp"), F.lit(True).alias("asks"), "payload")
    near = data.unionByName(asks).groupBy("block", "grp").applyInArrow(search, "query_id long, row long, vec_id long, close double")
    best = Window.partitionBy("query_id").orderBy(F.col("close").desc(), "vec_id", "row")
    near = near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= rerank_all).select("query_id", "row")
    near = near.join(all_v, "row").join(all_q.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    near = near.select("query_id", "vec_id", "q", "v").mapInArrow(lean(_measure), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_anisotropic_search(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))
