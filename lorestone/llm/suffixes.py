"""Suffix-array dedup: strings of LENGTH bytes that start at two places or more, anywhere in the corpus, are taken out.

Every string of LENGTH bytes holds an anchor, the least of its short strings by a hash, which is the same wherever the string
stands. So suffixes need to be compared only where their anchors are equal: strings in a row that share an anchor are one
block; equal blocks are told by digest, and blocks that differ around an equal anchor meet in a suffix array."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTES, buffers, chunks, documents, forget, gather, lean, materialise, mix64, partitions, prefix_hash, scatter, scratch, small_batches

LENGTH = 200
#: Bytes of text whose blocks share a bucket: about 100,000 blocks of 37 bytes.
BUCKET_BYTES = 8 << 20
#: Bytes of the blocks that share a suffix array's task, and blocks of one anchor in it; an anchor of more is dealt to
#: several tasks by the hashes of its strings.
LOOK_BYTES, LOOK_BLOCKS = 2 << 20, 2000
#: Blocks of one anchor that may meet in one task, and anchors with more at most, as a share of all blocks.
HOT_PLACES, HOT_KEYS = 1 << 20, 20_000
#: Strings of one slice: their numbers fit the low bits of a hash.
SLICE, PLACE = 1 << 19, np.uint64((1 << 20) - 1)
_U8, _I8, _U4, _U1 = (np.dtype(k) for k in (np.uint64, np.int64, np.uint32, np.uint8))
_ENTRY = [_U8, _U8, _U8, _I8, _U4, _U4]
_SPAN = [_I8, _U4, _U4]
_OPEN = [_I8, _U8, _U4, _U4, _U4, _U1]


def core(length: int) -> int:
    """Bytes of an anchor: longer ones are shared by less that isn't repeated, shorter ones leave fewer blocks."""
    return max(1, length * 24 // 100)


def blocks(seg: np.ndarray, edge: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, key): where the first and the last of a row of strings start that share an anchor, and its hash.
    edge: where the texts of seg begin and end. Each string of `length` bytes of a text is in exactly one block."""
    n, k = len(seg), core(length)
    own = np.flatnonzero(np.arange(n) + length <= np.repeat(edge[1:], np.diff(edge)))
    if not len(own):
        return own, own, np.zeros(0, np.uint64)
    p, inverse = prefix_hash(_BYTES[seg])
    key = mix64((p[k:] - p[:-k]) * inverse[: n - k + 1])
    low, width, wanted = key & ~PLACE | np.arange(len(key), dtype=np.uint64), 1, length - k + 1
    while width * 2 <= wanted:  # the least of twice as many
        low, width = np.minimum(low[:-width], low[width:]), width * 2
    if wanted > width:
        low = np.minimum(low[: len(low) - (wanted - width)], low[wanted - width :])
    anchor = (low[own] & PLACE).astype(np.int64)
    new = np.ones(len(own), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1] + 1)
    at = np.flatnonzero(new)
    return own[at], own[np.append(at[1:], len(own)) - 1], key[anchor[at]]


def slices(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, edges, first row, bytes of that row left out) of a text column, slice by slice; a longer text comes in
    several, which overlap so that each string lies in one of them."""
    data, at = buffers(column)
    for i, j in chunks(at, SLICE):
        if j - i > 1 or at[j] - at[i] <= SLICE:
            yield data[at[i] : at[j]], at[i : j + 1] - at[i], i, 0
            continue
        for start in range(int(at[i]), int(at[j]), SLICE):
            seg = data[start : min(start + SLICE + length - 1, int(at[j]))]
            yield seg, np.array([0, len(seg)]), i, start - int(at[i])


class Suffixes:
    """Suffixes of a few strings, compared by hashes of their prefixes."""

    def __init__(self, strings: list[bytes]):
        self.raw = b"".join(strings)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.edge = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
        self.string = np.repeat(np.arange(len(strings)), np.diff(self.edge))
        self.end = self.edge[self.string + 1] if len(strings) else np.zeros(0, np.int64)
        self.p, self.inverse = prefix_hash(_BYTES[self.data])

    def hash(self, x: np.ndarray, size) -> np.ndarray:
        return (self.p[x + size] - self.p[x]) * self.inverse[x]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at x and y have in common: a binary search over equal hashes of prefixes."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.end[x] - x, self.end[y] - y)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.hash(x, mid) == self.hash(y, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: how the suffixes at x stand to those at y; an end stands before any byte."""
        n = self.common(x, y)
        next_byte = lambda z: np.where(z + n < self.end[z], self.data[np.minimum(z + n, len(self.data) - 1)].astype(np.int64), -1)
        return np.sign(next_byte(x) - next_byte(y))

    def sort(self, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(suffixes, groups) in order of groups, within a group of suffixes. A mergesort of all groups at once: runs of
        twice the width a round, in which each suffix looks for its place in the other run by bisection."""
        order = np.argsort(group, kind="stable")
        at, group = at[order], group[order]
        first = np.searchsorted(group, group)
        size = np.searchsorted(group, group, "right") - first
        place, width = np.arange(len(at)) - first, 1
        while width < size.max(initial=0):
            run = place // width
            low = np.minimum((run ^ 1) * width, size)
            high = np.minimum(low + width, size)
            rank_from, left = low.copy(), run % 2 == 0
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) >> 1
                sign = self.before(at[first[open_] + mid], at[open_])
                goes_on = np.where(left[open_], sign < 0, sign <= 0)  # of equal suffixes, those of the left run come first
                low[open_] = np.where(goes_on, mid + 1, low[open_])
                high[open_] = np.where(goes_on, high[open_], mid)
            to = first + (run // 2) * 2 * width + place % width + (low - rank_from)
            moved = np.empty_like(at)
            moved[to] = at
            at, width = moved, width * 2
        return at, group

    def longest(self, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(suffixes, bytes): of each suffix, the most that it has in common with another of its group.

        Neighbours in order have the most in common. Equal hashes are held against the bytes; where these differ, the
        group is sorted by its bytes instead."""
        at, group = self.sort(at, group)
        shared = np.zeros(len(at) + 1, np.int64)
        pair = np.flatnonzero(group[1:] == group[:-1])
        shared[pair + 1] = self.common(at[pair], at[pair + 1])
        wrong = set()
        for i, x, y, n in zip(pair.tolist(), at[pair].tolist(), at[pair + 1].tolist(), shared[pair + 1].tolist()):
            if self.raw[x : x + n] != self.raw[y : y + n]:
                wrong.add(int(group[i]))
        for g in wrong:
            i, j = np.searchsorted(group, np.uint64(g)), np.searchsorted(group, np.uint64(g), "right")
            text = lambda x: self.raw[x : self.end[x]]
            at[i:j] = sorted(at[i:j].tolist(), key=text)
            for k in range(i + 1, j):
                x, y = (np.frombuffer(text(at[m]), np.uint8) for m in (k - 1, k))
                n = min(len(x), len(y))
                differ = np.flatnonzero(x[:n] != y[:n])
                shared[k] = differ[0] if len(differ) else n
        return at, np.maximum(shared[:-1], shared[1:])

    def repeated(self, group: np.ndarray, length: int, asked: np.ndarray | None = None) -> np.ndarray:
        """Which bytes lie in a string of `length` that starts at another place of a string of the same group too. group:
        of each string; asked: of each byte, whether the string that starts there takes part.

        Only suffixes whose first `length` bytes have the hash of another's can be such. Those that begin a row of them
        are sorted, with all that may match them; the most that one has in common with a neighbour settles all strings
        within. What isn't settled then begins a row of the next round."""
        covered = np.zeros(len(self.data) + 1, np.int64)
        own = np.arange(len(self.data)) + length <= self.end
        at = np.flatnonzero(own & asked if asked is not None else own)
        names = group.astype(np.uint64)
        kind, count = np.unique(mix64(self.hash(at, length)) ^ mix64(names[self.string[at]]), return_inverse=True, return_counts=True)[1:]
        at, kind = at[count[kind] > 1], kind[count[kind] > 1]
        todo = np.zeros(len(self.data) + 1, bool)
        todo[at] = True
        while todo.any():
            starts = np.flatnonzero(todo & ~np.concatenate([[False], todo[:-1]]))
            # A row ends with its string.
            mates = np.isin(kind, kind[np.searchsorted(at, starts)])
            x, n = self.longest(at[mates], names[self.string[at[mates]]])
            todo[starts] = False
            x, n = x[n >= length], n[n >= length]
            np.add.at(covered, x, 1)
            np.add.at(covered, x + n, -1)
            settled = np.zeros(len(todo) + 1, np.int64)
            np.add.at(settled, x, 1)
            np.add.at(settled, x + n - length + 1, -1)
            todo &= np.cumsum(settled)[:-1] == 0
        return np.cumsum(covered)[:-1] > 0

    def spans(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, start, end) of the rows of bytes that are flagged."""
        inner = np.flatnonzero(flags)
        new = np.ones(len(inner), bool)
        new[1:] = (inner[1:] != inner[:-1] + 1) | (self.string[inner[1:]] != self.string[inner[:-1]])
        cut = np.flatnonzero(new)
        start, end = inner[cut], inner[np.append(cut[1:], len(inner)) - 1] + 1 if len(inner) else inner
        string = self.string[start]
        return string, start - self.edge[string], end - self.edge[string]


def _keep(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """The texts as a table in buckets of `row`, a number of each row, so that joins by row leave them where they are."""
    spark, name = docs.sparkSession, f"lorestone_texts_{uuid.uuid4().hex}"
    path, n = scratch(spark, "texts"), partitions(spark)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts.repartition(n, "row").write.bucketBy(n, "row").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._scratch = path
    return out, name


def release(found: DataFrame) -> None:
    """Forget the tables behind a result of remove_repeats, once it was written or isn't needed."""
    texts, name = found._texts
    texts.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    forget(texts, found._held)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text, spans, kept) of every document: spans lists (start, end) in bytes of UTF-8, the longest rows of
    bytes of which each lies in a string of `length` bytes that also starts anywhere else; kept are the other bytes.

    A string that starts at two places is found at both: all are judged on the input, so nothing stays of a repeat. Each
    text is cut into blocks, rows of strings that share their anchor, about one for each 77 bytes; blocks are dealt out
    by anchor, and those of one digest (128 bits) are repeated as a whole. Where an anchor has blocks that differ, one of
    each digest is sent to a suffix array of that anchor's blocks, which finds the strings they share.
    An anchor of more than HOT_PLACES blocks would fill its task. Such anchors, HOT_KEYS at most, are counted first and
    dealt out by digest; a digest of as many is told to all tasks. Their blocks meet in several suffix arrays, by the
    hashes of strings, after each task has told repeats among its own and kept one of each.
    Null and empty texts, and those under `length`, have no span; null ids stay null; repeated rows are places of their
    own, so a text of `length` or more that stands in two rows goes as a whole; texts of any length are cut in slices;
    other columns are left out; an empty table gives no rows. Call `release` once the result was written."""
    spark = docs.sparkSession
    small_batches(spark)
    texts, name = _keep(docs, id_col)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    keys, many, digests = _hot(texts, length, size, buckets)

    def cut(batches):
        held, count = [], 0

        def dealt():
            key, e1, e2, row, first, last = (np.concatenate(c) for c in zip(*held))
            own = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            hot = keys[own] == key if len(keys) else np.zeros(len(key), bool)
            told = np.zeros(len(key), bool)
            for i in np.flatnonzero(hot).tolist() if digests else []:
                if (place := digests.get((int(e1[i]), int(e2[i])))) is not None:
                    told[i] = True
                    if place == (int(row[i]), int(first[i])):
                        yield _say(scatter(mix64(row[i : i + 1].view(np.uint64)), [row[i : i + 1], key[i : i + 1], first[i : i + 1], last[i : i + 1], _parts(many[own[i : i + 1]]), np.zeros(1, np.uint8)], buckets), "open")
            if told.any():
                yield _say(scatter(mix64(row[told].view(np.uint64)), [row[told], first[told], last[told] + np.uint32(length)], buckets), "span")
            rest = [c[~told] for c in (key, e1, e2, row, first, last)]
            if len(rest[0]):
                yield _say(scatter(np.where(hot[~told], rest[1], rest[0]), rest, buckets), "block")

        for b in batches:
            rows = b.column("row").to_numpy()
            with np.errstate(over="ignore"):
                for seg, edge, i, skipped in slices(b.column("text"), length):
                    first, last, key = blocks(seg, edge, length)
                    if len(first):
                        e1, e2 = _digests(seg, first, last + length)
                        doc = np.searchsorted(edge, first, "right") - 1
                        shift = edge[doc] - skipped
                        held.append((key, e1, e2, rows[i + doc], (first - shift).astype(np.uint32), (last - shift).astype(np.uint32)))
                        count += len(first)
                        if count >= 500_000:
                            yield from dealt()
                            held, count = [], 0
        if count:
            yield from dealt()

    def match(table: pa.Table) -> pa.Table:
        key, e1, e2, row, first, last = gather(table.column("payload").to_pylist(), _ENTRY)
        order = np.lexsort((first, row, e2, e1, key))
        key, e1, e2, row, first, last = (c[order] for c in (key, e1, e2, row, first, last))
        new_key, new = np.ones(len(key), bool), np.ones(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        new[1:] = new_key[1:] | (e1[1:] != e1[:-1]) | (e2[1:] != e2[:-1])
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(key)))
        again = np.repeat(n > 1, n)
        kinds = np.bincount(np.cumsum(new_key)[at] - 1) if len(at) else np.zeros(0, np.int64)
        kinds = kinds[np.cumsum(new_key)[at] - 1]
        if len(keys):
            own = np.minimum(np.searchsorted(keys, key[at]), len(keys) - 1)
            kinds = np.where(keys[own] == key[at], np.maximum(many[own], 2), kinds)
        differ = kinds > 1
        one = at[differ]
        out = []
        if again.any():
            out.append(_say(scatter(mix64(row[again].view(np.uint64)), [row[again], first[again], last[again] + np.uint32(length)], buckets), "span"))
        if len(one):
            out.append(_say(scatter(mix64(row[one].view(np.uint64)), [row[one], key[one], first[one], last[one], _parts(kinds[differ]), (n[differ] == 1).astype(np.uint8)], buckets), "open"))
        return pa.Table.from_batches(out, _SAID)

    said = "bucket int, payload binary, kind string"
    dealt_out = texts.select("row", "text").mapInArrow(lean(cut), said)
    if len(keys):
        dealt_out = materialise(dealt_out, "blocks")
    matched = dealt_out.where("kind = 'block'").groupBy("bucket").applyInArrow(match, said)
    if len(keys):
        matched = matched.unionByName(dealt_out.where("kind <> 'block'"))
    matched = materialise(matched, "matched")
    if len(keys):
        forget(dealt_out)
    spans = matched.where("kind = 'span'").select("bucket", "payload").unionByName(_look(texts, matched.where("kind = 'open'"), length, buckets))
    spans = spans.groupBy("bucket").applyInArrow(_merged, "row long, starts array<long>, ends array<long>")
    out = texts.join(spans.hint("shuffle_hash"), "row", "left").mapInArrow(lean(_cut_out), f"doc_id {dict(texts.dtypes)['doc_id']}, text string, spans array<struct<start:long,end:long>>, kept binary")
    out._texts, out._held = (texts, name), matched
    return out


_SAID = pa.schema([("bucket", pa.int32()), ("payload", pa.binary()), ("kind", pa.string())])


def _say(batch: pa.RecordBatch, kind: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array([kind] * batch.num_rows)], schema=_SAID)


def _parts(n: np.ndarray) -> np.ndarray:
    """Tasks that an anchor of n blocks is dealt to."""
    return (-(-n // LOOK_BLOCKS)).astype(np.uint32)


def _digests(seg: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = seg.tobytes()
    found = np.frombuffer(b"".join([hashlib.md5(raw[i:j], usedforsecurity=False).digest() for i, j in zip(start.tolist(), end.tolist())]), np.uint64)
    return found[::2].copy(), found[1::2].copy()


def _hot(texts: DataFrame, length: int, size: int, buckets: int) -> tuple[np.ndarray, np.ndarray, dict]:
    """(anchors, blocks of each, {digest: first place}): anchors of too many blocks for one task, and digests of too many
    among these. Both are HOT_KEYS at most, by the threshold."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), {}
    total = 2 * size // (length - core(length) + 1)
    most = max(HOT_PLACES, total // HOT_KEYS)
    if total <= most:
        return none

    def count(batches):
        """Anchors of a task's blocks with their numbers, combined now and then."""
        held, many = [], 0

        def dealt():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return scatter(key, [key, n.astype(np.int64)], buckets)

        for b in batches:
            with np.errstate(over="ignore"):
                for seg, edge, _, _ in slices(b.column("text"), length):
                    held.append(blocks(seg, edge, length)[2])
                    many += len(held[-1])
                    if many >= 2_000_000:
                        yield dealt()
                        held, many = [], 0
        if many:
            yield dealt()

    def frequent(table: pa.Table) -> pa.Table:
        key, n = gather(table.column("payload").to_pylist(), [_U8, _I8])
        key, at = np.unique(key, return_inverse=True)
        n = np.bincount(at, n).astype(np.int64)
        return pa.table({"key": key[n > most].view(np.int64), "n": n[n > most]})

    found = texts.select("text").mapInArrow(lean(count), "bucket int, payload binary").groupBy("bucket").applyInArrow(frequent, "key long, n long").collect()
    if not found:
        return none
    rows = sorted((int(np.int64(r["key"]).view(np.uint64)), r["n"]) for r in found)
    keys, many = np.array([k for k, _ in rows], np.uint64), np.array([n for _, n in rows], np.int64)

    def places(batches):
        """Digests of these anchors' blocks with their numbers and first places, combined over a task."""
        held: dict[tuple, tuple] = {}
        for b in batches:
            ids = b.column("row").to_numpy()
            with np.errstate(over="ignore"):
                for seg, edge, i, skipped in slices(b.column("text"), length):
                    first, last, key = blocks(seg, edge, length)
                    hot = np.isin(key, keys)
                    if hot.any():
                        first, last = first[hot], last[hot]
                        doc = np.searchsorted(edge, first, "right") - 1
                        for e1, e2, row, at in zip(*(c.tolist() for c in (*_digests(seg, first, last + length), ids[i + doc], first - edge[doc] + skipped))):
                            n, place = held.get((e1, e2), (0, (row, at)))
                            held[e1, e2] = n + 1, min(place, (row, at))
                if len(held) >= 200_000:
                    yield told(held)
                    held = {}
        yield told(held)

    def told(held):
        columns = [np.array([k[c] for k in held], np.uint64).view(np.int64) for c in (0, 1)] + [np.array(c, np.int64) for c in ([v[0] for v in held.values()], [v[1][0] for v in held.values()], [v[1][1] for v in held.values()])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["e1", "e2", "n", "row", "at"])

    each = texts.select("row", "text").mapInArrow(lean(places), "e1 long, e2 long, n long, row long, at long")
    each = each.groupBy("e1", "e2").agg(F.sum("n").alias("n"), F.min(F.struct("row", "at")).alias("place")).where(F.col("n") > most)
    unsigned = lambda v: int(np.int64(v).view(np.uint64))
    return keys, many, {(unsigned(r["e1"]), unsigned(r["e2"])): tuple(r["place"]) for r in each.collect()}


def _look(texts: DataFrame, opened: DataFrame, length: int, buckets: int) -> DataFrame:
    """(bucket, payload) of the spans that blocks of an anchor with different ones have in common with others."""

    def per_row(table: pa.Table) -> pa.Table:
        row, key, first, last, parts, alone = gather(table.column("payload").to_pylist(), _OPEN)
        order = np.lexsort((first, row))
        row, key, first, last, parts, alone = (c[order] for c in (row, key, first, last, parts, alone))
        at = np.flatnonzero(np.diff(row, prepend=row[0] - 1)) if len(row) else np.zeros(0, np.int64)
        listed = lambda c, kind: pa.ListArray.from_arrays(pa.array(np.append(at, len(row)).astype(np.int32)), pa.array(c.astype(kind)))
        return pa.table({"row": row[at], "keys": listed(key.view(np.int64), np.int64), "firsts": listed(first, np.int64), "lasts": listed(last, np.int64), "parts": listed(parts, np.int64), "alone": listed(alone, np.int64)})

    each = "keys array<long>, firsts array<long>, lasts array<long>, parts array<long>, alone array<long>"
    places = materialise(opened.select("bucket", "payload").groupBy("bucket").applyInArrow(per_row, f"row long, {each}"), "open-blocks")
    n = places.agg(F.sum(F.size("keys"))).first()[0] or 0
    tasks = max(1, -(-n * length * 3 // 2 // LOOK_BYTES))

    def extract(batches):
        for b in batches:
            out, hot = [], []
            rows = zip(*(b.column(c).to_pylist() for c in ("row", "keys", "firsts", "lasts", "parts", "alone")))
            data, at = buffers(b.column("text"))
            for i, (row, *lists) in enumerate(rows):
                for key, first, last, parts, alone in zip(*lists):
                    block = data[at[i] + first : at[i] + last + length].tobytes()
                    if parts > 1:
                        hot.append((row, key, first, alone, block, parts))
                    else:
                        out.append((int(np.int64(key).view(np.uint64)) % tasks, row, key, first, alone, block, None))
            if hot:
                yield from shared(hot)
            if out:
                yield batch(out)

    def batch(out):
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["task", "row", "key", "first", "alone", "block", "asked"])

    def shared(hot):
        """Blocks of anchors that several tasks look at: repeats among them are told at once, of which one goes on."""
        with np.errstate(over="ignore"):
            s = Suffixes([h[4] for h in hot])
            key = np.array([h[1] for h in hot], np.int64)
            parts = np.array([h[5] for h in hot], np.uint64)
            at = np.flatnonzero(np.arange(len(s.data)) + length <= s.end)
            string = s.string[at]
            name = mix64(s.hash(at, length)) ^ mix64(key[string].view(np.uint64))
            known = s.repeated(key, length)
            one = np.zeros(len(at), bool)
            one[np.unique(name, return_index=True)[1]] = True
            # A string all of whose bytes are told as repeated, and whose mate goes on, has nothing more to find.
            told = np.concatenate([[0], np.cumsum(known)])
            on = one | (told[at + length] - told[at] < length)
            part = name % parts[string]
            out = []
            for i, p in sorted(set(zip(string[on].tolist(), part[on].tolist()))):
                row, k, first, alone, block, _ = hot[i]
                lo, hi = np.searchsorted(string, i), np.searchsorted(string, i, "right")
                own = on[lo:hi] & (part[lo:hi] == np.uint64(p))
                task = int(mix64(np.array([k], np.int64).view(np.uint64) + np.uint64(p))[0] % np.uint64(tasks))
                out.append((task, row, k, first, alone, block, own.tobytes()))
            if out:
                yield batch(out)
            string, start, end = s.spans(known)
            found = [(-1, hot[i][0], hot[i][1], hot[i][2] + a, b - a, None, None) for i, a, b in zip(string.tolist(), start.tolist(), end.tolist()) if hot[i][3]]
            if found:
                yield batch(found)

    def look(table: pa.Table) -> pa.Table:
        strings, asked = table.column("block").to_pylist(), table.column("asked").to_pylist()
        row, key, first, alone = (table.column(c).to_numpy() for c in ("row", "key", "first", "alone"))
        with np.errstate(over="ignore"):
            s = Suffixes(strings)
            flags = np.ones(len(s.data), bool)
            for i, a in enumerate(asked):
                if a is not None:
                    flags[s.edge[i] : s.edge[i] + len(a)] = np.frombuffer(a, bool)
            string, start, end = s.spans(s.repeated(key, length, flags))
            own = alone[string] > 0
            string, start, end = string[own], start[own], end[own]
            row = row[string].astype(np.int64)
            if not len(row):
                return pa.table({"bucket": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})
            return pa.Table.from_batches([scatter(mix64(row.view(np.uint64)), [row, (first[string] + start).astype(np.uint32), (first[string] + end).astype(np.uint32)], buckets)])

    def ready(batches):
        for b in batches:
            row, first, size = (b.column(c).to_numpy().astype(np.int64) for c in ("row", "first", "alone"))
            yield scatter(mix64(row.view(np.uint64)), [row, first.astype(np.uint32), (first + size).astype(np.uint32)], buckets)

    schema, blob = "task int, row long, key long, first long, alone long, block binary, asked binary", "bucket int, payload binary"
    sent = texts.join(places.hint("shuffle_hash"), "row").mapInArrow(lean(extract), schema)
    sent = materialise(sent, "sent-blocks")
    forget(places)
    found = sent.where("task >= 0").groupBy("task").applyInArrow(look, blob)
    return found.unionByName(sent.where("task < 0").select("row", "first", "alone").mapInArrow(lean(ready), blob))


def _merged(table: pa.Table) -> pa.Table:
    """The spans of each row, joined where they meet."""
    row, start, end = gather(table.column("payload").to_pylist(), _SPAN)
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order].astype(np.int64), end[order].astype(np.int64)
    # Rows lie one after the other on a line, so that no span reaches into the next row.
    number = np.cumsum(np.diff(row, prepend=row[:1]) != 0)
    far = int(end.max(initial=0)) + 2
    reach = np.maximum.accumulate(end + number * far)
    new = np.ones(len(row), bool)
    new[1:] = (start + number * far)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    starts, ends = start[at], (reach - number * far)[np.append(at[1:], len(row)) - 1] if len(row) else end
    owner = row[at]
    first = np.flatnonzero(np.diff(owner, prepend=owner[0] - 1)) if len(owner) else np.zeros(0, np.int64)
    listed = lambda c: pa.ListArray.from_arrays(pa.array(np.append(first, len(owner)).astype(np.int32)), pa.array(c))
    return pa.table({"row": owner[first], "starts": listed(starts), "ends": listed(ends)})


def _cut_out(batches):
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    for b in batches:
        spans, kept = [], []
        data, at = buffers(b.column("text"))
        for i, (starts, ends) in enumerate(zip(b.column("starts").to_pylist(), b.column("ends").to_pylist())):
            raw = data[at[i] : at[i + 1]]
            stay = np.ones(len(raw), bool)
            for x, y in zip(starts or [], ends or []):
                stay[x:y] = False
            spans.append([{"start": x, "end": y} for x, y in zip(starts or [], ends or [])])
            kept.append(raw[stay].tobytes() if starts else raw.tobytes())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(spans, pa.list_(kind)), pa.array(kept, pa.binary())], names=["doc_id", "text", "spans", "kept"])


def op12_suffix_dedup(spark, sf_dir):
    found = remove_repeats(documents(spark, sf_dir))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    told = found.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    out = materialise(told, "suffix-dedup")
    release(found)
    return out
