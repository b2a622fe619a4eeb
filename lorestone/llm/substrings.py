"""Substring dedup by content-defined chunks: a gear hash cuts, a digest of each chunk finds its copies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, buffers, chunks, documents, gather, lean, materialise, mix64, prefix_hash, scatter, small_batches, stream, unused

#: The gear hash sums a random number for each of the last 16 bytes, doubled once a byte; a byte whose hash is below the
#: limit ends a chunk, one in `MEAN`.
WINDOW, MEAN = 16, 20
_GEAR = (stream(11, 256) >> np.uint64(32)).astype(np.uint32)
#: A passage is reported from so many words on in a row of repeated chunks. Up to a window and two chunks of a repeat
#: lie outside such a row, so that repeats of over 50 words are found and those of under 30 are not.
LEAST_WORDS = 30
#: Bytes of text whose chunks share a bucket, on average: 400,000 chunks, 12 MB, whatever the table and the cluster hold.
BUCKET_BYTES = 8 << 20
_KINDS = [np.dtype(np.uint64), np.dtype(np.int64), np.dtype(np.uint32), np.dtype(np.uint32), np.dtype(np.uint16)]
#: Places of one digest, of 26 bytes each, that may meet in one task, and digests with more, as a share of all chunks.
HOT_PLACES, HOT_KEYS = 1 << 20, 20_000


def cuts(seg: np.ndarray, starts: np.ndarray, mean: int = MEAN) -> np.ndarray:
    """Where chunks end: after each byte whose gear hash is low, and at each text's end. `starts`: of the texts.

    Only the last WINDOW bytes matter, so that a cut depends on what is around it and an insertion shifts no other."""
    h = _GEAR[seg]
    width = 1
    while width < WINDOW:  # sums over windows of twice the width
        more = np.zeros_like(h)
        more[width:] = h[:-width] << np.uint32(width)
        h = h + more
        width *= 2
    # A text's first bytes have fewer before them; what stands before the text, in whatever batch, doesn't count.
    at, own = starts.astype(np.int64), np.zeros(len(starts), np.uint32)
    ends = np.append(starts[1:], len(seg))
    for k in range(WINDOW - 1):
        here = at + k < ends
        at, ends, own = at[here], ends[here], own[here]
        own = (own << np.uint32(1)) + _GEAR[seg[at + k]]
        h[at + k] = own
    low = h * np.uint32(0x9E3779B1) < np.uint32((1 << 32) // mean)
    return np.unique(np.concatenate([np.flatnonzero(low) + 1, starts[starts > 0], [len(seg)]]))


def chunk_table(data: np.ndarray, at: np.ndarray, a: int, b: int, mean: int = MEAN):
    """(doc, digest, start, length, words) of the chunks of the documents a..b; starts are bytes in the text."""
    seg, own = data[at[a] : at[b]], at[a : b + 1] - at[a]
    if not len(seg):
        return (np.zeros(0, np.int64), *(np.zeros(0, k) for k in _KINDS[:1] + _KINDS[2:]))
    end = cuts(seg, own[:-1], mean)
    start = np.concatenate([[0], end[:-1]])
    doc = np.searchsorted(own, start, "right") - 1
    p, inverse = prefix_hash(stream(1, 256)[seg])
    digest = mix64((p[end] - p[start]) * inverse[start] + (end - start).astype(np.uint64))
    solid = ~SPACE[seg]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    words = np.concatenate([[0], np.cumsum(first)])
    return doc, digest, (start - own[doc]).astype(np.uint32), (end - start).astype(np.uint32), np.minimum(words[end] - words[start], 65535).astype(np.uint16)


def repeats(docs: DataFrame, least_words: int = LEAST_WORDS, mean: int = MEAN, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_passages, repeated_bytes, removed_bytes, first_doc_id, spans, removed): each document that holds a repeated passage.

    All chunks of all texts are dealt out by digest, as packed blobs; a digest found at two places or more is repeated,
    and its first place, by id and start, is the one to keep. Repeated chunks go on to their document, where those in a
    row make passages of `least_words` or more. `spans` lists start:end in bytes of UTF-8; `removed` the parts of them,
    again of `least_words` or more, whose chunks all have an earlier place, which dedup takes out; first_doc_id is the smallest id among
    the first places of its chunks. Documents without such a passage aren't returned.
    Pairs of places are never formed. A digest of more than HOT_PLACES places would fill its task: where texts are long
    enough for one, digests are counted first, partition by partition, and the few that are so frequent are told to all
    tasks with their first places, so their chunks go to their documents at once. Null texts hold no passage, nor do
    null ids; of repeated rows with one id, equal places count once, so rows that repeat an id and its text hold nothing
    new; other columns are left out; an empty table gives no rows."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    small_batches(docs.sparkSession)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    most = max(HOT_PLACES, size // mean // HOT_KEYS)

    def count(batches):
        """Digests of a partition's chunks with their numbers, combined now and then."""
        held, size = [], 0

        def dealt():
            digest, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            return digest, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        for b in batches:
            data, at = buffers(b.column("text"))
            with np.errstate(over="ignore"):
                for i, j in chunks(at):
                    digest = chunk_table(data, at, i, j, mean)[1]
                    held.append((digest, np.ones(len(digest), np.int64)))
                    size += len(digest)
                    if size >= 1_000_000:
                        yield scatter(*(lambda d, n: (d, [d, n]))(*dealt()), buckets)
                        held, size = [], 0
        if size:
            yield scatter(*(lambda d, n: (d, [d, n]))(*dealt()), buckets)

    def frequent(table: pa.Table) -> pa.Table:
        digest, n = gather(table.column("payload").to_pylist(), [np.dtype(np.uint64), np.dtype(np.int64)])
        digest, at = np.unique(digest, return_inverse=True)
        return pa.table({"digest": digest[np.bincount(at, n) > most].view(np.int64)})

    def first_places(batches):
        """Of each hot digest a partition's first and last place."""
        held = {}
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            data, at = buffers(b.column("text"))
            with np.errstate(over="ignore"):
                for i, j in chunks(at):
                    doc, digest, start, _, _ = chunk_table(data, at, i, j, mean)
                    own = np.isin(digest, hot)
                    digest, doc, start = digest[own], ids[i + doc[own]], start[own]
                    order = np.lexsort((start, doc, digest))
                    digest, doc, start = digest[order], doc[order].tolist(), start[order].tolist()
                    first = np.flatnonzero(np.diff(digest, prepend=~digest[:1]) != 0)
                    for d, a, b in zip(digest[first].tolist(), first.tolist(), np.append(first[1:], len(digest)).tolist()):
                        low, high = held.get(d, ((doc[a], start[a]), (doc[b - 1], start[b - 1])))
                        held[d] = min(low, (doc[a], start[a])), max(high, (doc[b - 1], start[b - 1]))
        if held:
            columns = [np.array(list(held), np.uint64).view(np.int64), *np.array([a + b for a, b in held.values()], np.int64).T]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["digest", "doc", "start", "last_doc", "last_start"])

    hot, hot_doc, hot_start, hot_alone = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    if size > most:
        found = texts.mapInArrow(lean(count), "bucket int, payload binary").groupBy("bucket").applyInArrow(frequent, "digest long")
        # HOT_KEYS at most, about, since as many chunks as that have more places each than there are.
        hot = np.sort(np.array([r["digest"] for r in found.collect()], np.int64).view(np.uint64))
        if len(hot):
            first = texts.mapInArrow(lean(first_places), "digest long, doc long, start long, last_doc long, last_start long")
            first = first.groupBy("digest").agg(F.min(F.struct("doc", "start")).alias("low"), F.max(F.struct("last_doc", "last_start")).alias("high"))
            rows = {np.int64(r["digest"]).view(np.uint64): (*r["low"], tuple(r["low"]) == tuple(r["high"])) for r in first.collect()}
            hot_doc, hot_start = (np.array([rows[d][k] for d in hot], np.int64) for k in (0, 1))
            # One place that repeated rows hold over and over is no repeat.
            hot_alone = np.array([rows[d][2] for d in hot], bool)

    def cut(batches):
        held, size = [], 0

        def dealt():
            columns = [np.concatenate(c) for c in zip(*held)]
            own = np.minimum(np.searchsorted(hot, columns[0]), max(len(hot) - 1, 0))
            known = hot[own] == columns[0] if len(hot) else np.zeros(len(columns[0]), bool)
            if known.any():
                again = known.copy()
                again[known] = ~hot_alone[own[known]]
                digest, doc, start, length, words = (c[again] for c in columns)
                place = own[again]
                keep = (hot_doc[place] == doc) & (hot_start[place] == start)
                flags = words.astype(np.uint32) << np.uint32(1) | keep
                if len(doc):
                    yield told(scatter(mix64(doc.view(np.uint64)), [doc, hot_doc[place], start, length, flags.astype(np.uint32)], buckets), True)
                columns = [c[~known] for c in columns]
            if len(columns[0]):
                yield told(scatter(columns[0], columns, buckets), False)

        def told(batch, hot):
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, hot))], names=["bucket", "payload", "hot"])

        for b in batches:
            ids = b.column("doc_id").to_numpy()
            data, at = buffers(b.column("text"))
            with np.errstate(over="ignore"):
                for i, j in chunks(at):
                    doc, digest, start, length, words = chunk_table(data, at, i, j, mean)
                    held.append([digest, ids[i + doc], start, length, words])
                    size += len(digest)
                    if size >= 1_000_000:
                        yield from dealt()
                        held, size = [], 0
        if size:
            yield from dealt()

    def match(table: pa.Table) -> pa.Table:
        digest, doc, start, length, words = gather(table.column("payload").to_pylist(), _KINDS)
        order = np.lexsort((start, doc, digest))
        digest, doc, start, length, words = (x[order] for x in (digest, doc, start, length, words))
        new_digest = np.ones(len(digest), bool)
        new_digest[1:] = digest[1:] != digest[:-1]
        new_place = new_digest.copy()
        new_place[1:] |= (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])
        digest, doc, start, length, words, new_digest = (x[new_place] for x in (digest, doc, start, length, words, new_digest))
        at = np.flatnonzero(new_digest)
        count = np.diff(np.append(at, len(digest)))
        first = np.repeat(doc[at], count)
        again = np.repeat(count > 1, count)
        own = mix64(doc[again].view(np.uint64))
        if not len(own):
            return pa.table({"bucket": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})
        flags = words[again].astype(np.uint32) << np.uint32(1) | new_digest[again]
        return pa.Table.from_batches([scatter(own, [doc[again], first[again], start[again], length[again], flags.astype(np.uint32)], buckets)])

    def join(table: pa.Table) -> pa.Table:
        kinds = [np.dtype(np.int64), np.dtype(np.int64)] + [np.dtype(np.uint32)] * 3
        doc, first, start, length, flags = gather(table.column("payload").to_pylist(), kinds)
        order = np.lexsort((flags, first, length, start, doc))
        columns = [x[order].astype(np.int64) for x in (doc, first, start, length, flags)]
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
        doc, first, start, length, flags = (x[new] for x in columns)
        end, words, keep = start + length, flags >> 1, (flags & 1).astype(bool)

        def passages(own):
            """(doc, start, end, smallest first id) of rows of chunks with enough words."""
            d, i, j, n, f = doc[own], start[own], end[own], words[own], first[own]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (i[1:] != j[:-1])
            at = np.flatnonzero(new)
            if len(at):
                long = np.add.reduceat(n, at) >= least_words
                last = np.append(at[1:], len(d)) - 1
                yield from zip(d[at][long].tolist(), i[at][long].tolist(), j[last][long].tolist(), np.minimum.reduceat(f, at)[long].tolist())

        rows: dict[int, tuple[list, list]] = {}
        for d, i, j, f in passages(np.ones(len(doc), bool)):
            rows.setdefault(d, ([], []))[0].append((i, j, f))
        for d, i, j, _ in passages(~keep):
            rows[d][1].append((i, j))
        say = lambda spans: ",".join(f"{a}:{b}" for a, b in spans)
        size = lambda spans: sum(b - a for a, b in spans)
        out = [(d, len(found), size(f[:2] for f in found), size(gone), min(f[2] for f in found), say(f[:2] for f in found), say(gone)) for d, (found, gone) in rows.items()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, [pa.int64()] * 5 + [pa.string()] * 2)], names=["doc_id", "n_passages", "repeated_bytes", "removed_bytes", "first_doc_id", "spans", "removed"])

    blob = "bucket int, payload binary"
    dealt_out = texts.mapInArrow(lean(cut), f"{blob}, hot boolean")
    if len(hot):
        dealt_out = materialise(dealt_out, "chunks")
    again = dealt_out.where("not hot").select("bucket", "payload").groupBy("bucket").applyInArrow(match, blob)
    if len(hot):
        again = again.unionByName(dealt_out.where("hot").select("bucket", "payload"))
    schema = "doc_id long, n_passages long, repeated_bytes long, removed_bytes long, first_doc_id long, spans string, removed string"
    return again.groupBy("bucket").applyInArrow(join, schema)


def dedup_substrings(docs: DataFrame, **options) -> DataFrame:
    """docs with the repeated passages cut from `text`, but for their first places; all other columns and rows stay.

    Cut texts are decoded again with stray bytes of a split character dropped. Null and empty texts, rows without an id
    and texts without a repeat stay as they are; rows that repeat an id are cut alike, at the places told for the id, so
    ids should name one text; columns may have any names; an empty table stays empty."""
    id_col = options.get("id_col", "doc_id")
    own, spans_col = unused(docs, "rep_id"), unused(docs, "rep_spans")
    found = repeats(docs, **options).where("removed <> ''").select(F.col("doc_id").alias(own), F.col("removed").alias(spans_col))
    joined = docs.join(found, F.col(id_col).cast("long") == F.col(own), "left").drop(own)

    def apply(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, spans in enumerate(b.column(spans_col).to_pylist()):
                if spans and texts[i] is not None:
                    raw, at, out = texts[i].encode(), 0, []
                    for s in spans.split(","):
                        lo, hi = map(int, s.split(":"))
                        out.append(raw[at:lo])
                        at = hi
                    texts[i] = b"".join([*out, raw[at:]]).decode(errors="ignore")
            b = b.set_column(b.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
            yield b.drop_columns([spans_col])

    return joined.mapInArrow(lean(apply), docs.schema)


def op4_chunk_dedup(spark, sf_dir):
    return repeats(documents(spark, sf_dir))
