"""Packing along a space-filling curve: like documents share sequences, and no sequence is padded."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, buffers, chunks, documents, gathered, lean, materialise, stream
from .tokens import SLICE, encoded, encoder, id_dtype, public_path

LENGTH = 1024
END_ID = 0
#: Dimensions of the curve, bits of each coordinate, hashed features.
DIMS, BITS, FEATURES = 4, 12, 256


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """The index along the Hilbert curve of integer points [n, dims] (Skilling's transpose form)."""
    x = coords.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


#: Fixed signs that project hashed features to the curve's dimensions.
_SIGNS = np.where(stream(7, FEATURES * DIMS).reshape(FEATURES, DIMS) & np.uint64(1), 1.0, -1.0)


def curve_keys(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A document's key: its hashed word counts at unit length, projected, cut to a grid, and placed on the curve."""
    out = []
    with np.errstate(over="ignore"):
        for a, b in chunks(at):
            w = Words(data, at, a, b, lower=True)
            slot = w.doc * FEATURES + (w.hash % np.uint64(FEATURES)).astype(np.int64)
            v = np.log1p(np.bincount(slot, minlength=(b - a) * FEATURES).reshape(b - a, FEATURES))
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            # A projection is near a normal deviate; a sigmoid spreads it over the grid.
            grid = (1 << BITS) / (1 + np.exp(-1.7 * (v @ _SIGNS)))
            out.append(hilbert_index(np.clip(grid, 0, (1 << BITS) - 1).astype(np.int64), BITS))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Sequences:
    """Cuts a stream of documents into sequences; the last is cut into powers of two, which need no padding."""

    def __init__(self, length: int, base: int):
        self.length, self.next, self.room, self.rows, self.tail = length, base, length, [], []

    def _emit(self, piece, take, seq, offset):
        doc_id, start, ids, width, total = piece
        part = ids[:take]
        self.rows.append((doc_id, start, take, zlib.crc32(part.astype("<u4").tobytes()), total, seq, offset, part.tobytes()))

    def add(self, doc_id, ids: np.ndarray) -> None:
        start, total = 0, len(ids)
        while start < total:
            take = min(self.room, total - start)
            self.tail.append((doc_id, start, ids[start : start + take], None, total))
            start, self.room = start + take, self.room - take
            if not self.room:
                self._close([self.length])

    def _close(self, lengths: list[int]) -> None:
        """Emit the open pieces as sequences of these lengths."""
        left, offset = lengths[0], 0
        for doc_id, start, ids, _, total in self.tail:
            while len(ids):
                take = min(left, len(ids))
                self._emit((doc_id, start, ids, None, total), take, self.next, offset)
                start, ids, left, offset = start + take, ids[take:], left - take, offset + take
                if not left:
                    self.next += 1
                    lengths = lengths[1:]
                    left, offset = (lengths or [0])[0], 0
        self.tail, self.room = [], self.length

    def finish(self) -> None:
        if used := self.length - self.room:
            self._close([1 << b for b in range(used.bit_length() - 1, -1, -1) if used >> b & 1])

    def drain(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        kinds = [pa.int64()] * 7 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of all documents.

    Each text is encoded and keyed once, into a table of ids. Its rows are range-sorted by their place on the curve (then
    by id and token ids, so that ties are settled), which is the one shuffle and moves no text; each partition then cuts
    its stream at `length` ids. What is left at a partition's end becomes sequences whose lengths are powers of two, so
    nothing is padded. A sequence's number is the partition's number times 2**40 plus its place there. `ids` packs the
    piece's ids in two bytes each (four for large vocabularies). Null and empty texts are the end id alone; a document
    over `length` ids spans several sequences; repeated rows are packed each; a null id stays null; other columns are
    left out; an empty table gives no rows."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    dtype = id_dtype(tokenizer)

    def keyed(batches):
        from_text = encoder(tokenizer)
        for b in gathered(batches, "text", SLICE):
            doc_ids, texts = b.column("doc_id"), b.column("text")
            for i, j, ids in encoded(texts, from_text):
                keys = pa.array(curve_keys(*buffers(texts.slice(i, j - i))), pa.int64())
                yield pa.RecordBatch.from_arrays([doc_ids.slice(i, j - i), keys, ids.cast(pa.binary())], names=["doc_id", "pack_key", "ids"])

    def cut(batches):
        end = np.array([end_id], dtype)
        seqs = Sequences(length, TaskContext.get().partitionId() << 40)
        for b in batches:
            for doc_id, raw in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                seqs.add(doc_id, np.concatenate([np.frombuffer(raw, dtype), end]))
            yield slim(seqs.drain())
        seqs.finish()
        yield slim(seqs.drain())

    def slim(batch):
        return batch if with_ids else batch.drop_columns(["ids"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text")
    table = materialise(docs.mapInArrow(lean(keyed), "doc_id long, pack_key long, ids binary"), "pack-ids")
    ranged = table.repartitionByRange("pack_key", "doc_id").sortWithinPartitions("pack_key", "doc_id", "ids").select("doc_id", "ids")
    return ranged.mapInArrow(lean(cut), schema if with_ids else schema.removesuffix(", ids binary"))


def op2_pack_hilbert(spark, sf_dir):
    return pack(documents(spark, sf_dir), public_path("byte_bpe_50k.json"), with_ids=False)
