"""Line dedup: an edit-distance join of all lines by partitioned segments, verified with a banded bit-parallel automaton."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Forest, components, documents, forget, gather, lean, materialise, mix64, partitions, prefix_hash, scatter, split_join, stream

#: Edits between near-duplicate lines, and the least length in code points of a line that is compared by edits.
EDITS, LEAST = 2, 32
#: Lines in a verified group; of larger ones, each two blocks of lines meet in a group of their own.
GROUP = 512
#: Up to so many candidate lines, their names are sent to every executor; beyond, the join shuffles.
BROADCAST_ROWS = 100_000
_KINDS = [np.dtype(np.uint64), np.dtype(np.int64), np.dtype(np.uint32)]


def segments(length: np.ndarray, parts: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, size) of each of `parts` even segments of strings of these lengths; the longer ones come last."""
    size, more = length // parts, length % parts
    return [(i * size + np.maximum(0, i - (parts - more)), size + (i >= parts - more)) for i in range(parts)]


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of two strings is at most `most`.

    What they share at either end is stripped. Then an automaton of most + 1 rows of bits runs over b, a bit for each
    prefix of a, and only those within the band of the diagonal are kept."""
    if abs(len(a) - len(b)) > most:
        return False
    n, i = min(len(a), len(b)), 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if max(len(a), len(b)) <= most:
        return True
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    width, whole = 2 * most + 1, (1 << (len(a) + 1)) - 1
    rows = [(1 << (d + 1)) - 1 for d in range(most + 1)]
    for k, c in enumerate(b, 1):
        band = ((1 << width) - 1) << (k - most) if k > most else (1 << (k + most + 1)) - 1
        band &= whole
        same, old = at.get(c, 0), rows
        rows = [((old[0] & same) << 1) & band]
        for d in range(1, most + 1):
            rows.append((((old[d] & same) << 1) | old[d - 1] | (old[d - 1] << 1) | (rows[d - 1] << 1)) & band)
        if not rows[most]:
            return False
    return bool(rows[most] >> len(a) & 1)


def _bags(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts of eight classes of characters, four bits each: an edit changes two of them by one at most."""
    kind = (mix64(values.astype(np.uint64)) >> np.uint64(61)).astype(np.int64)
    out = np.zeros(len(at) - 1, np.uint32)
    for k in range(8):
        n = np.concatenate([[0], np.cumsum(kind == k)])
        out |= ((n[at[1:]] - n[at[:-1]]).astype(np.uint32) & np.uint32(15)) << np.uint32(4 * k)
    return out


def _near_bags(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    total = np.zeros(np.broadcast(a, b).shape, np.int32)
    for k in range(8):
        d = ((a >> np.uint32(4 * k)) - (b >> np.uint32(4 * k))) & np.uint32(15)
        total += np.minimum(d, np.uint32(16) - d).astype(np.int32)
    return total <= 2 * most


def segment_keys(lines: list[str], ids: np.ndarray, edits: int):
    """Entries (key, id, bag) for the substring indexes: one for each segment of a line, its lowest bit 0, and one for
    each substring that may equal a segment of a line not longer, its lowest bit 1.

    With edits + 1 segments, edits leave one whole. Matching the i-th from the left, i - 1 segments before it hold an
    edit each, as do those after it, so a substring's start is tied to few places (multi-match-aware selection)."""
    values = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    at = np.concatenate([[0], np.cumsum(length)])
    p, inverse = prefix_hash(mix64(values.astype(np.uint64) + np.uint64(1)))
    bags, base, parts = _bags(values, at), at[:-1], edits + 1
    salt = stream(23, parts)
    out = []

    def entry(start, size, of, i, role, fine):
        i0, j0 = base[fine] + start[fine], base[fine] + (start + size)[fine]
        key = mix64((p[j0] - p[i0]) * inverse[i0] + salt[i] * (of[fine].astype(np.uint64) * np.uint64(2) + np.uint64(1)))
        out.append(((key & ~np.uint64(1)) | np.uint64(role), ids[fine], bags[fine]))

    for i, (start, size) in enumerate(segments(length, parts)):
        entry(start, size, length, i, 0, size > 0)
    for less in range(edits + 1):
        of = length - less
        for i, (start, size) in enumerate(segments(np.maximum(of, 0), parts)):
            low, high = max(-i, less - (edits - i)), min(i, less + (edits - i))
            for shift in range(low, high + 1):
                q = start + shift
                entry(q, size, of, i, 1, (of > 0) & (size > 0) & (q >= 0) & (q + size <= length))
    return [np.concatenate(c) for c in zip(*out)]


def candidate_groups(lines: DataFrame, edits: int) -> DataFrame:
    """(grp, id) rows: lines whose edit distance may be at most `edits` share a group. From lines (id: long, line),
    where a line may stand often: each batch indexes it once.

    Lines that share a segment are a run. A short one is compared by bags of characters at once; of a long one, only the
    blocks are named here, and each two of them meet in a group of their own in a step of its own, over all tasks."""
    buckets = 4 * partitions(lines.sparkSession)

    def index(batches):
        for b in batches:
            ids, first = np.unique(b.column("id").to_numpy(), return_index=True)
            text = b.column("line").take(pa.array(first)).to_pylist()
            at, size = 0, 0
            with np.errstate(over="ignore"):
                for k, t in enumerate(text):
                    size += len(t)
                    if size > 1 << 19 or k == len(text) - 1:
                        key, own, bag = segment_keys(text[at : k + 1], ids[at : k + 1], edits)
                        if len(key):
                            yield scatter(key >> np.uint64(1), [key, own, bag], buckets)
                        at, size = k + 1, 0

    def match(table: pa.Table) -> pa.Table:
        key, own, bag = gather(table.column("payload").to_pylist(), _KINDS)
        order = np.lexsort((own, key))
        key, own, bag = key[order], own[order], bag[order]
        run = key >> np.uint64(1)
        at = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
        ends = np.append(at[1:], len(run))
        asks = np.concatenate([[0], np.cumsum(key & np.uint64(1))]).astype(np.int64)
        # Runs in which some line asks, some is indexed, and there are two lines.
        n_ask = asks[ends] - asks[at]
        low, high = np.minimum.reduceat(own, at) if len(at) else at, np.maximum.reduceat(own, at) if len(at) else at
        some = (n_ask > 0) & (n_ask < ends - at) & (low < high)
        grp, ids, block = [], [], []
        for i, j in zip(at[some].tolist(), ends[some].tolist()):
            members, first = np.unique(own[i:j], return_index=True)
            bags = bag[i:j][first]
            if len(members) <= GROUP:
                near = _near_bags(bags[:, None], bags[None], edits)
                np.fill_diagonal(near, False)
                # The groups are the pieces of the graph of near bags: nothing is compared across them.
                f = Forest(len(members))
                for a, c in zip(*np.nonzero(np.triu(near))):
                    f.union(int(a), int(c))
                lead = np.array([f.find(k) for k in range(len(members))])
                kept = near.any(1)
                grp.append(members[lead[kept]])
                ids.append(members[kept])
                block.append(np.full(int(kept.sum()), -1))
            else:
                grp.append(np.full(len(members), run[i].view(np.int64)))
                ids.append(members)
                block.append(np.arange(len(members)) // (GROUP // 2))
        columns = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (grp, ids, block)]
        blocks = np.zeros(len(columns[0]), np.int64)
        at = 0
        for b in block:
            blocks[at : at + len(b)], at = (b[-1] + 1 if len(b) else 0), at + len(b)
        return pa.table({"grp": columns[0], "id": columns[1], "block": columns[2], "blocks": blocks})

    runs = lines.mapInArrow(lean(index), "bucket int, payload binary").groupBy("bucket").applyInArrow(match, "grp long, id long, block long, blocks long")
    runs = materialise(runs, "line-runs")
    groups = runs.where("block < 0").select("grp", "id")
    # Each two blocks of a long run share a group, so that no pair is missed and no group is large.
    long = runs.where("block >= 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block <> other")
    pair = F.xxhash64("grp", F.least("block", "other"), F.greatest("block", "other"))
    groups = materialise(groups.unionByName(long.select(pair.alias("grp"), "id")).distinct(), "line-groups")
    forget(runs)
    return groups


def verified(table: pa.Table, edits: int) -> pa.Table:
    """Edges (a, b) that span each set of lines linked within a group; what is linked already isn't compared again."""
    ids, lines = table.column("id").to_pylist(), table.column("line").to_pylist()
    order = sorted(range(len(ids)), key=lambda k: (len(lines[k]), ids[k]))
    f, out = Forest(len(ids)), []
    values = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    bags = _bags(values, np.concatenate([[0], np.cumsum([len(t) for t in lines])]).astype(np.int64))
    length = np.array([len(lines[k]) for k in order])
    sorted_bags = bags[order]
    for x, i in enumerate(order):
        stop = int(np.searchsorted(length, length[x] + edits, "right"))
        for y in np.flatnonzero(_near_bags(sorted_bags[x], sorted_bags[x + 1 : stop], edits)) if stop > x + 1 else ():
            j = order[x + 1 + int(y)]
            if f.find(i) != f.find(j) and within(lines[i], lines[j], edits):
                f.union(i, j)
                out.append((ids[i], ids[j]))
    return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})


def _takes_part(line: Column, least: int, short: bool) -> Column:
    return (F.length(line) >= least) | line.rlike(r"[^\x20\x09-\x0D]") if short else F.length(line) >= least


def _positions(docs: DataFrame, least: int, short: bool) -> DataFrame:
    """(doc_id, line_no, line) of the lines that take part; line_no counts from 0."""
    lines = docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.where(_takes_part(F.col("line"), least, short))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def line_classes(docs: DataFrame, edits: int = EDITS, least: int = LEAST, short: bool = False) -> DataFrame:
    """(doc_id, line_no, hash, class_hash, n_docs, first_doc, first_line) of each line whose class has two places or more:
    its class's name, number of documents, and first place by doc_id and line_no.

    Equal lines are one by MD5, of which 60 bits name a line; lines within `edits` of each other are linked, and classes
    are what links connect. Texts are read for the index and for candidates only; all else works on places."""
    hashed = lambda df: df.withColumn("hash", F.conv(F.substring(F.md5("line"), 1, 15), 16, 10).cast("long"))
    places = materialise(hashed(_positions(docs, least, short)).select("doc_id", "line_no", "hash"), "line-places")
    with_text = hashed(_positions(docs, least, False))
    groups = candidate_groups(with_text.select(F.col("hash").alias("id"), "line"), edits)
    ids = _small(groups.select(F.col("id").alias("hash")).distinct())
    text = with_text.select("hash", "line").join(ids, "hash", "left_semi").groupBy(F.col("hash").alias("id")).agg(F.first("line").alias("line"))
    edges = groups.join(text, "id").select("grp", "id", "line").groupBy("grp").applyInArrow(lambda t: verified(t, edits), "a long, b long")
    comp = components(edges).select(F.col("node").alias("hash"), F.col("comp").alias("class_hash"))
    # A document's own repeats combine first, so that documents are counted by plain sums.
    own = places.groupBy("hash", "doc_id").agg(F.min("line_no").alias("line_no"), F.count("*").alias("n"))
    stats = lambda df, key: df.groupBy(key).agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"), F.min(F.struct("doc_id", "line_no")).alias("first"))
    each = materialise(stats(own, "hash"), "line-stats")
    # Of lines that are linked, a document's count once for the class; frequent ones are named where they are.
    linked = split_join(own, comp, "hash", each.join(comp, "hash", "left_semi").select("hash", F.col("n_docs").alias("n_rows")), "n_rows")
    linked = linked.groupBy("class_hash", "doc_id").agg(F.min("line_no").alias("line_no"), F.sum("n").alias("n"))
    linked = stats(linked, "class_hash").join(comp, "class_hash")
    alone = each.join(comp, "hash", "left_anti").where("n > 1").withColumn("class_hash", F.col("hash"))
    named = alone.unionByName(linked, allowMissingColumns=True).select("hash", "class_hash", "n_docs", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"))
    named = materialise(named, "line-named")
    forget(groups)
    sizes = each.where("n > 1").select("hash", F.col("n").alias("n_rows"))
    return split_join(places, named, "hash", sizes, "n_rows").select("doc_id", "line_no", "hash", "class_hash", "n_docs", "first_doc", "first_line")


def dedup_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST, min_docs: int = 2, short: bool = False) -> DataFrame:
    """docs with `text` freed of repeated lines, and ld_lines, ld_linked and ld_removed: its lines that take part, those of
    a class with other places, and those removed.

    A line of `least` code points or more is repeated if its class (lines connected by at most `edits` edits) stands at
    another place; of a class, the first place stays, by doc_id and line_no, and the others go if the class is found in
    `min_docs` documents, or more than once in this one. Lines are what \\n separates, of any length. Shorter ones stay, unless `short`:
    then each that holds a word takes part too, with the lines equal to it as its class.
    Null and empty texts stay as they are, as do rows without doc_id; of repeated rows with one id, equal lines at equal
    places are one place, so all stay or go alike; other columns stay, but for those named ld_*, which are replaced."""
    docs = docs.drop(*[c for c in docs.columns if c.startswith("ld_")])
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = line_classes(slim, edits, least, short).distinct()
    is_first = (F.col("doc_id") == F.col("first_doc")) & (F.col("line_no") == F.col("first_line"))
    own = Window.partitionBy("doc_id", "class_hash")
    lines = lines.withColumn("own", F.count("*").over(own))
    gone = ~is_first & ((F.col("n_docs") >= min_docs) | (F.col("own") > 1))
    # Without other documents enough, a document keeps its own first line of the class.
    gone = gone & ((F.col("n_docs") >= min_docs) | (F.col("line_no") > F.min("line_no").over(own)))
    linked = (F.col("n_docs") > 1) | (F.col("own") > 1)
    per_doc = lines.withColumn("gone", gone).groupBy("doc_id").agg(
        F.count_if(linked).alias("ld_linked"),
        F.count_if("gone").alias("ld_removed"),
        F.collect_list(F.when(F.col("gone"), F.struct(F.col("line_no").alias("i"), F.col("hash").alias("h")))).alias("ld_gone"),
    )
    out = docs.join(per_doc.withColumnRenamed("doc_id", "ld_id"), docs["doc_id"].cast("long") == F.col("ld_id"), "left").drop("ld_id")
    own_hash = lambda x: F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long")
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("ld_gone", F.struct(i.alias("i"), own_hash(x).alias("h"))))
    text = F.when(F.col("ld_removed") > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    in_line = F.size(F.filter(F.split("text", "\n", -1), lambda x: _takes_part(x, least, short)))
    out = out.withColumn("ld_lines", F.when(F.col("doc_id").isNotNull() & F.col("text").isNotNull(), in_line))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("ld_lines", "ld_linked", "ld_removed")]
    return out.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], *counts)


def op10_line_dedup(spark, sf_dir):
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), short=True)
    return out.select("doc_id", F.col("ld_lines").alias("n_lines"), F.col("ld_linked").alias("n_linked"), F.col("ld_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
