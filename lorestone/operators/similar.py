"""Which observations resemble a text: vector and token legs, fused by reciprocal rank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..functions.scores import cosine_distance, rrf_term
from ..functions.text import excerpt, has_any_token, query_tokens, trim
from ..scratch import materialise, small
from ..sources.schemas import NIL
from .postings import TokenIndex, text_legs, token_postings
from .versioned import visible

LEG, MOST = 20, 50
#: Bytes of question vectors, and of rows' vectors, that a task holds at once, by eight a number; each block of questions
#: meets each part of the rows.
QUESTION_BYTES, ROW_BYTES = 32 << 20, 64 << 20
#: Bytes of vectors that are packed into one row.
SLAB_BYTES = 2 << 20
#: Blocks are made smaller for parallel work, as long as a task still compares so many pairs.
CELL = 1 << 26
#: Asked tokens, and their characters, up to which they are sent to every executor.
TOKENS, TOKEN_BYTES = 400_000, 16 << 20
#: Rows times questions that are compared at once.
PAIRS = 1 << 20
#: Rows of a block of them, and questions whose results are emitted at once.
ROWS = 4_096
#: Lengths of vectors between which matrix products in single precision tell what may be near.
TAME = 1e-100, 1e100


def _ranked(rows: DataFrame, order, leg: int) -> DataFrame:
    """The first rows with their rank among physical rows. The limit leaves so few that the window is no matter."""
    return rows.orderBy(*order).limit(leg).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def vector_leg(observations: DataFrame, scope: str, qvec: list[float], leg: int = LEG) -> DataFrame:
    """(obs_id, src, rank) of the nearest by cosine; vectors of another length, and zero vectors, take no part."""
    q = F.array(*[F.lit(float(x)) for x in qvec])
    near = observations.where((F.size("content_vec") == len(qvec)) & visible(scope, "confidentiality", "internal"))
    near = near.select("obs_id", cosine_distance(F.col("content_vec"), q).alias("dist")).where("dist is not null")
    return _ranked(near, [F.col("dist"), F.col("obs_id")], leg).select("obs_id", F.lit("vec").alias("src"), "rank")


def text_leg(observations: DataFrame, scope: str, query: str, leg: int = LEG) -> DataFrame:
    """(obs_id, src, rank) of the newest that hold one of the query's tokens."""
    tokens = query_tokens(F.lit(query))
    hits = observations.where(visible(scope, "confidentiality", "internal") & has_any_token(F.col("content"), tokens)).select("obs_id", "ts")
    return _ranked(hits, [F.col("ts").desc(), F.col("obs_id")], leg).select("obs_id", F.lit("txt").alias("src"), "rank")


def fuse(legs: DataFrame, k: int) -> DataFrame:
    """(obs_id, score, matched_by): the best rank of each leg counts, and the k best are kept."""
    best = legs.groupBy("obs_id", "src").agg(F.min("rank").alias("rank"))
    fused = best.groupBy("obs_id").agg(F.sum(rrf_term(F.col("rank"))).alias("score"), F.sort_array(F.collect_set("src")).alias("matched_by"))
    return fused.orderBy(F.col("score").desc(), "obs_id").limit(k)


def similar(observations: DataFrame, scope: str, query: str, qvec: list[float] | None = None, k: int = 10) -> DataFrame:
    """(obs_id, score, matched_by, ts, kind, excerpt, entity_ids, origin_scope), best first.

    Without a vector, or without a token in the query, the other leg answers alone; without both the result is empty. Of
    repeated rows the earliest is shown, ties by content; an id that the gate hides is dropped and not replaced."""
    if not query.strip() or not scope.strip() or not 1 <= k <= 50:
        raise InvalidInput("a query, a scope, and k from 1 to 50 are needed")
    legs = []
    if qvec:
        legs.append(vector_leg(observations, scope, qvec))
    if any(c.isascii() and c.isalnum() for c in query):
        legs.append(text_leg(observations, scope, query))
    none = observations.sparkSession.createDataFrame([], "obs_id string, src string, rank int")
    hits = fuse(legs[0] if len(legs) == 1 else legs[0].unionByName(legs[1]) if legs else none, k)
    # At most k ids: a proven bound.
    rows = observations.where(visible(scope, "confidentiality", "internal")).join(F.broadcast(hits), "obs_id")
    first = Window.partitionBy("obs_id").orderBy("ts", "content")
    rows = rows.withColumn("_first", F.row_number().over(first)).where("_first = 1")
    ids = F.filter(F.coalesce("entity_refs", F.array().cast("array<string>")), lambda x: x != NIL)
    return rows.select("obs_id", "score", "matched_by", "ts", "kind", excerpt(F.col("content")).alias("excerpt"), ids.alias("entity_ids"), F.col("scope").alias("origin_scope")).orderBy(F.col("score").desc(), "obs_id")


def request_error(k_most: int = MOST) -> Column:
    """What is wrong with a request (q, scope, k), or null."""
    blank = lambda c: ~F.coalesce(F.col(c).rlike(r"(?U)[^\s]"), F.lit(False))
    return F.when(blank("q"), "the question is blank").when(blank("scope"), "the scope is blank").when(~F.coalesce(F.col("k").between(1, k_most), F.lit(False)), "k is out of range")


class _Nearest:
    """The nearest rows of each question so far, in a task: they are cut again with each block of rows, so a task holds
    and emits `leg` rows a question at most, and any two tasks' results merge the same way."""

    def __init__(self, names: list, scopes: list, q: np.ndarray, leg: int):
        self.names, self.q, self.leg = names, q, leg
        # Scopes and ids are compared by their numbers; those of ids are in the order of the ids.
        self.codes = {c: i for i, c in enumerate(dict.fromkeys(c for c in scopes if c is not None))}
        self.scopes = np.array([self.codes.get(c, -2) for c in scopes], np.int32)
        self.norm = np.sqrt(self._dots(q, q))
        self.unit = self._unit(q, self.norm)
        # Products of vectors of length one in single precision are off by half of that at most.
        self.slack = (q.shape[1] + 8) * 2.0**-23
        self.kth = np.full(len(q), np.inf)
        self.count = np.zeros(len(q), np.int64)
        self.far, self.code, self.table = np.zeros((len(q), leg)), np.zeros((len(q), leg), np.int64), np.empty(0, object)

    @property
    def ids(self) -> np.ndarray:
        return self.table[self.code]

    @staticmethod
    def _unit(x: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Vectors of length one in single precision; no numbers for those whose length isn't tame, so that nothing is
        told of them."""
        with np.errstate(all="ignore"):
            tame = (norm > TAME[0]) & (norm < TAME[1])
            return (x / np.where(tame, norm, np.nan)[:, None]).astype(np.float32)

    @staticmethod
    def _dots(a: np.ndarray, b: np.ndarray, i=slice(None), j=slice(None)) -> np.ndarray:
        """Inner products of pairs (rows i of a, rows j of b), summed term by term from the first on: a column at a time,
        so that no more than a number a pair is held."""
        total = a[i, 0] * b[j, 0] if a.shape[1] else np.zeros(len(a[i]))
        for d in range(1, a.shape[1]):
            total += a[i, d] * b[j, d]
        return total

    def see(self, x: np.ndarray, ids: np.ndarray, scopes: np.ndarray, opens: np.ndarray) -> None:
        norm = np.sqrt(self._dots(x, x))
        some = np.flatnonzero(norm != 0)
        held = np.arange(self.leg)[None] < self.count[:, None]
        used = np.unique(self.code[held])
        table, code = np.unique(np.concatenate([self.table[used], ids[some]]), return_inverse=True)
        self.code[held], self.table, code = code[: len(used)][np.searchsorted(used, self.code[held])], table, code[len(used) :]
        # In order of ids, so that equally near rows of a block come in that order.
        order = np.argsort(code, kind="stable")
        code, some = code[order], some[order]
        scopes = np.array([self.codes.get(c, -1) for c in scopes[some].tolist()], np.int32)
        for i in range(0, len(some), ROWS):
            block = slice(i, i + ROWS)
            at = some[block]
            self._see(x[at], code[block], scopes[block], opens[at], norm[at])

    def _see(self, x: np.ndarray, code: np.ndarray, scopes: np.ndarray, opens: np.ndarray, norm: np.ndarray) -> None:
        step, unit, n = max(1, PAIRS // len(x)), np.ascontiguousarray(self._unit(x, norm).T), len(x)
        found, size = [], 0
        for i in range(0, len(self.q), step):
            own = slice(i, i + step)
            near = self.unit[own] @ unit
            bound = 1 - self.kth[own] - self.slack
            if n > self.leg and np.isinf(bound).any():
                seen = (opens[None] | (scopes[None] == self.scopes[own, None])) & ~np.isnan(near)
                least = np.partition(np.where(seen, near, -np.inf), n - self.leg, axis=1)[:, n - self.leg]
                bound = np.maximum(bound, least - 2 * self.slack)
            # What is no number may be near.
            at = _unset(np.less(near, bound.astype(np.float32)[:, None]).ravel())
            asked, row = at // n + i, at % n
            fit = opens[row] | (scopes[row] == self.scopes[asked])
            row, asked = row[fit], asked[fit]
            if found and size + len(row) > PAIRS:
                self._merge(*map(np.concatenate, zip(*found)), x, code, norm)
                found, size = [], 0
            if len(row):
                found.append((row, asked))
                size += len(row)
        if found:
            self._merge(*(map(np.concatenate, zip(*found)) if len(found) > 1 else found[0]), x, code, norm)

    def _merge(self, row: np.ndarray, asked: np.ndarray, x: np.ndarray, code: np.ndarray, norm: np.ndarray) -> None:
        """Measure pairs of a block's rows and questions, and keep each question's nearest."""
        far = 1 - self._dots(x, self.q, row, asked) / (norm[row] * self.norm[asked])
        order = np.lexsort((row, far, asked))
        place = np.arange(len(order)) - np.searchsorted(asked[order], asked[order])
        order = order[place < self.leg]
        row, asked, far = row[order], asked[order], far[order]
        some = np.unique(asked)
        old = self.count[some]
        kept = np.repeat(some, old)
        slot = np.arange(len(kept)) - np.repeat(np.cumsum(old) - old, old)
        every = np.concatenate([kept, asked])
        dist = np.concatenate([self.far[kept, slot], far])
        names = np.concatenate([self.code[kept, slot], code[row]])
        order = np.lexsort((names, dist, every))
        every = every[order]
        place = np.arange(len(order)) - np.searchsorted(every, every)
        fit = place < self.leg
        every, place, order = every[fit], place[fit], order[fit]
        self.far[every, place], self.code[every, place] = dist[order], names[order]
        self.count[some] = np.bincount(np.searchsorted(some, every), minlength=len(some))
        full = some[self.count[some] >= self.leg]
        last = self.far[full, self.leg - 1]
        self.kth[full] = np.where(np.isnan(last), np.inf, last)

    def batches(self):
        table = pa.array(self.table.tolist(), pa.string())
        for i in range(0, len(self.q), ROWS):
            n = self.count[i : i + ROWS]
            has = np.arange(self.leg)[None] < n[:, None]
            names = self.names[i : i + ROWS]
            names = (names if isinstance(names, pa.Array) else pa.array(names)).take(pa.array(np.repeat(np.arange(len(n)), n)))
            if len(names):
                yield pa.RecordBatch.from_arrays([names, table.take(pa.array(self.code[i : i + ROWS][has])), pa.array(self.far[i : i + ROWS][has])], names=["query_id", "obs_id", "dist"])


def _unset(flags: np.ndarray) -> np.ndarray:
    """Where flags, nearly all of which are set, aren't: they are looked through eight at a time."""
    whole = len(flags) // 8 * 8
    some = np.flatnonzero(flags[:whole].view(np.uint64) != np.uint64(0x0101010101010101))
    some = (some[:, None] * 8 + np.arange(8)).ravel()
    some = np.concatenate([some, np.arange(whole, len(flags))])
    return some[~flags[some]]


def vector_legs(observations: DataFrame, requests: DataFrame, leg: int = LEG) -> DataFrame:
    """(query_id, obs_id, src, rank) for requests (query_id, scope, qvec): as `vector_leg`, for all of them in one scan.

    Rows and questions are packed, and each block of questions meets each part of the rows in a task, of QUESTION_BYTES and
    ROW_BYTES; only numbers of rows reach the driver. Matrix products find what may be near; that is measured term by
    term, so equal vectors are equally far. Of each part the nearest few of each question are kept, and these merge by
    the same rule."""
    spark, kind = requests.sparkSession, dict(requests.dtypes)["query_id"]
    asked = requests.where("size(qvec) > 0").select("query_id", "scope", "qvec")
    counts = {r["dim"]: r["n"] for r in asked.groupBy(F.size("qvec").alias("dim")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return requests.select("query_id", F.lit("").alias("obs_id"), F.lit("vec").alias("src"), F.lit(0).alias("rank")).where("false")
    rows = observations.where(F.size("content_vec").isin(*counts) & F.col("obs_id").isNotNull())
    rows = rows.select(F.size("content_vec").alias("dim"), "obs_id", "scope", F.coalesce(F.col("confidentiality") == "internal", F.lit(False)).alias("open"), F.col("content_vec").alias("v"))
    rows = materialise(rows.mapInArrow(_slabs(_width(observations, "content_vec")), "dim int, n long, slab string, ids array<string>, scopes array<string>, opens array<boolean>, v binary"), "vectors")
    held = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    parts = None
    for dim, n in sorted(counts.items()):
        m = held.get(dim, 0)
        cuts = max(1, -(-m * dim * 8 // ROW_BYTES))
        blocks = max(-(-n * dim * 8 // QUESTION_BYTES), min(-(-n * m // CELL), -(-2 * spark.sparkContext.defaultParallelism // cuts)))
        mine = asked.where(F.size("qvec") == dim).mapInArrow(_dealt(blocks, _width(requests, "qvec")), f"block int, names array<{kind}>, scopes array<string>, v binary")
        mine = mine.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))))
        theirs = rows.where(F.col("dim") == dim).withColumn("part", F.pmod(F.xxhash64("slab"), F.lit(cuts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        search = _search(dim, leg, _width(requests, "qvec"), _width(observations, "content_vec"))
        found = mine.groupBy("part", "block").cogroup(theirs.groupBy("part", "block")).applyInArrow(search, f"query_id {kind}, obs_id string, dist double")
        parts = found if parts is None else parts.unionByName(found)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "obs_id"))).where(F.col("rank") <= leg)
    return ranked.select("query_id", "obs_id", F.lit("vec").alias("src"), "rank")


def _width(df: DataFrame, column: str) -> type:
    """How a column's numbers are packed without loss."""
    return np.float32 if dict(df.dtypes)[column] == "array<float>" else np.float64


def _packed(column: pa.Array, kind: type) -> np.ndarray:
    """The numbers of all vectors in a row; nulls are no numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)


def _slabs(kind: type):
    """Rows packed by the lengths of their vectors; those with a null in it are left out."""

    def pack(dim: int, b: pa.RecordBatch, name: str) -> pa.RecordBatch:
        one = [[dim], [b.num_rows], [name], *([b.column(c).to_pylist()] for c in ("obs_id", "scope", "open")), [_packed(b.column("v"), kind).tobytes()]]
        types = [pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(one, types)], names=["dim", "n", "slab", "ids", "scopes", "opens", "v"])

    def run(batches):
        held: dict[int, list] = {}
        task, made = TaskContext.get().partitionId(), 0
        for b in batches:
            b = b.filter(pa.array([None not in v for v in b.column("v").to_pylist()], pa.bool_())) if b.column("v").flatten().null_count else b
            for dim in np.unique(b.column("dim").to_numpy()).tolist():
                own = b.filter(pc.equal(b.column("dim"), dim))
                most = max(1, SLAB_BYTES // (8 * dim))
                held.setdefault(dim, []).append(own)
                if sum(x.num_rows for x in held[dim]) >= most:
                    all_ = pa.concat_batches(held.pop(dim))
                    for i in range(0, all_.num_rows, most):
                        made += 1
                        yield pack(dim, all_.slice(i, most), f"{task}-{made}")
        for dim, own in held.items():
            made += 1
            yield pack(dim, pa.concat_batches(own), f"{task}-{made}")

    return run


def _dealt(blocks: int, kind: type):
    """Questions packed, dealt over blocks in turn."""

    def run(batches):
        at = TaskContext.get().partitionId()
        for b in batches:
            block = (np.arange(b.num_rows) + at) % blocks
            at += b.num_rows
            for k in np.unique(block).tolist():
                own = b.filter(pa.array(block == k))
                names = own.column("query_id")
                names = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), names, pa.array([own.column("scope").to_pylist()], pa.list_(pa.string())), pa.array([_packed(own.column("qvec"), kind).tobytes()], pa.binary())], names=["block", "names", "scopes", "v"])

    return run


def _search(dim: int, leg: int, asks: type, holds: type):
    def vectors(table: pa.Table, kind: type) -> np.ndarray:
        parts = [np.frombuffer(v.as_buffer(), kind) for chunk in table.column("v").chunks for v in chunk]
        return np.concatenate(parts).astype(np.float64).reshape(-1, dim)

    def flat(table: pa.Table, column: str) -> pa.Array:
        return table.column(column).combine_chunks().flatten()

    def run(questions: pa.Table, rows: pa.Table) -> pa.Table:
        kind = questions.schema.field("names").type.value_type
        found = []
        if questions.num_rows and rows.num_rows:
            q = vectors(questions, asks)
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                told = np.sqrt(_Nearest._dots(q, q)) != 0
                names, scopes = (flat(questions, c).filter(pa.array(told)) for c in ("names", "scopes"))
                near = _Nearest(names, scopes.to_pylist(), q[told], leg)
                if len(near.q):
                    near.see(vectors(rows, holds), *(np.array(flat(rows, c).to_pylist(), object) for c in ("ids", "scopes")), flat(rows, "opens").to_numpy(zero_copy_only=False))
                    found = list(near.batches())
        return pa.Table.from_batches(found) if found else pa.table({"query_id": pa.array([], kind), "obs_id": pa.array([], pa.string()), "dist": pa.array([], pa.float64())})

    return run


def fuse_many(legs: DataFrame, requests: DataFrame) -> DataFrame:
    """(query_id, obs_id, score, matched_by, rank): as `fuse`, for requests (query_id, k)."""
    best = legs.groupBy("query_id", "obs_id", "src").agg(F.min("rank").alias("rank"))
    fused = best.groupBy("query_id", "obs_id").agg(F.sum(rrf_term(F.col("rank"))).alias("score"), F.sort_array(F.collect_set("src")).alias("matched_by"))
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "obs_id"))).where(F.col("rank") <= MOST)
    return ranked.join(requests.select("query_id", "k"), "query_id").where(F.col("rank") <= F.col("k")).drop("k")


def similar_many(observations: DataFrame, requests: DataFrame, index: TokenIndex | None = None) -> DataFrame:
    """(query_id, rank, obs_id, score, matched_by, ts, kind, excerpt, entity_ids, origin_scope) for requests (query_id,
    scope, q, qvec, k): what `similar` answers to each, in one plan for all.

    Requests without a vector are answered by tokens alone, those without a token by vectors; those for which
    `request_error` names an error have no rows. Tokens are looked up in the index, if there is one, or else found in a
    scan that all requests share. Of one query_id the requests count as one with all their hits, so ids should differ."""
    vector = F.col("qvec") if dict(requests.dtypes)["qvec"] == "array<float>" else F.col("qvec").cast("array<double>").alias("qvec")
    # Texts of questions are read once.
    requests = materialise(requests.where(request_error().isNull()).select("query_id", "scope", vector, "k", query_tokens(F.col("q")).alias("tokens")), "requests")
    asked = materialise(requests.select("query_id", "scope", F.explode("tokens").alias("token")).distinct(), "asked-tokens")
    tokens = materialise(asked.select("token").distinct(), "tokens")
    if not index:
        size = tokens.agg(F.coalesce(F.sum(F.length("token")), F.lit(0))).first()[0]
        postings = token_postings(observations, small(tokens, TOKENS) if size <= TOKEN_BYTES else tokens)
    else:
        postings = index.of(tokens)
    legs = vector_legs(observations, requests, LEG).unionByName(text_legs(postings, asked, LEG))
    hits = materialise(fuse_many(legs, requests).join(requests.select("query_id", F.col("scope").alias("caller")), "query_id"), "hits")
    rows = observations.join(small(hits), "obs_id").where(visible(F.col("caller"), "confidentiality", "internal"))
    first = Window.partitionBy("query_id", "obs_id").orderBy("ts", "content")
    rows = rows.withColumn("_first", F.row_number().over(first)).where("_first = 1")
    ids = F.filter(F.coalesce("entity_refs", F.array().cast("array<string>")), lambda x: x != NIL)
    return rows.select("query_id", "rank", "obs_id", "score", "matched_by", "ts", "kind", excerpt(F.col("content")).alias("excerpt"), ids.alias("entity_ids"), F.col("scope").alias("origin_scope"))
