"""Quality rules by compression bands, over base counts of words, symbols, lines and repeated windows."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, buffers, chunks, documents, lean, prefix_hash, small_batches, stream

#: zstandard level, and the size of the fixed chunks in bytes.
LEVEL, PART = 3, 2048
#: (texts of up to so many bytes, least ratio, most ratio): compressed over raw size of the whole document. The longer
#: a text, the better its prose compresses; symbols and repeats compress better still, random strings hardly. The least
#: ratios lie a few hundredths below those of prose of that length in four languages.
BANDS = (
    (512, 0.50, 0.90),
    (1024, 0.47, 0.80),
    (1448, 0.46, 0.75),
    (2048, 0.44, 0.75),
    (2896, 0.44, 0.68),
    (4096, 0.43, 0.66),
    (5792, 0.415, 0.65),
    (8192, 0.41, 0.65),
    (11585, 0.40, 0.62),
    (16384, 0.392, 0.62),
    (23170, 0.386, 0.60),
    (32768, 0.383, 0.60),
    (65536, 0.37, 0.60),
    (1 << 62, 0.35, 0.60),
)
#: The same for a chunk, and the share of chunks that may lie outside: those of clean texts of sf0.1 keep below a tenth.
PART_BAND, PART_SHARE = (0.42, 0.75), 0.125
#: The least size of a text's last chunk that is judged: shorter ones don't compress well, whatever they hold.
LEAST_PART = 1024

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _runs(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): rows sorted by doc and key, stably, and whether each is the first of its equals."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    first = np.ones(len(order), bool)
    first[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    return order, first


def base_counts(data: np.ndarray, at: np.ndarray, a: int, b: int) -> list[np.ndarray]:
    """_COUNTS of the documents a..b."""
    w, n = Words(data, at, a, b), b - a
    sums = lambda doc, x=None: np.bincount(doc, x, minlength=n).astype(np.int64)
    # Code points are the bytes that don't continue a character.
    lead = np.concatenate([[0], np.cumsum((w.seg & 0xC0) != 0x80)])
    chars = sums(w.doc, (lead[w.end] - lead[w.start]).astype(float))
    symbol = np.concatenate([[0], np.cumsum(_SYMBOL[w.seg])])
    symbols = symbol[w.at[1:]] - symbol[w.at[:-1]]
    # Lines: a document starts one, and so does each \n.
    breaks = np.flatnonzero(w.seg == 10)
    start = np.concatenate([w.at[:-1], breaks + 1])
    doc = np.concatenate([np.arange(n), np.searchsorted(w.at, breaks, "right") - 1])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    end = np.append(start[1:] - 1, len(w.seg))
    last = np.append(doc[1:] != doc[:-1], True)
    end[last] = w.at[doc[last] + 1]
    held = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, doc = start[held], end[held], doc[held]
    p, inverse = prefix_hash(stream(1, 256)[w.seg])
    key = (p[end] - p[start]) * inverse[np.minimum(start, len(inverse) - 1)]
    order, first = _runs(doc, key)
    dup_lines = sums(doc[order][~first])
    # Words in three-word windows that the document holds twice or more.
    key, whole = w.windows(3)
    where = np.flatnonzero(whole)
    order, first = _runs(w.doc[where], key[where])
    again = ~first
    again[:-1] |= ~first[1:]
    where = where[order[again]]
    covered = np.zeros(len(w.doc), bool)
    for k in range(3):
        covered[where + k] = True
    return [w.n.astype(np.int64), chars, symbols, dup_lines, sums(w.doc, covered.astype(float))]


def ratios(texts: Iterable[memoryview], level: int = LEVEL, part: int = PART) -> tuple[list[float], list[list[float]]]:
    """Of each text: compressed over raw size of the whole, and of each chunk of `part` bytes, the last one too if it isn't short."""
    compress = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False).compress
    whole, parts = [], []
    for t in texts:
        n = len(t)
        whole.append(len(compress(t)) / n if n else 0.0)
        cuts = range(0, n, part) if n >= 2 * part else ()
        parts.append([len(compress(t[i : i + part])) / min(part, n - i) for i in cuts if n - i >= LEAST_PART])
    return whole, parts


def band(n_bytes: int, bands=BANDS) -> tuple[float, float]:
    return next((low, high) for most, low, high in bands if n_bytes <= most)


def quality(docs: DataFrame, level: int = LEVEL, part: int = PART, bands=BANDS, part_band=PART_BAND, part_share: float = PART_SHARE, id_col: str = "doc_id") -> DataFrame:
    """doc_id, the base counts, zstd_ratio, n_parts, n_odd_parts, base_failed and kept of every document.

    A document fails its base with under 50 words, or more than half of its words in repeated windows. Else the method
    rules: the whole text's ratio must lie in the band of its length, and at most `part_share` of its fixed chunks may
    lie outside theirs. Texts are taken whole, in UTF-8. Null and empty texts have ratio 0 and fail their base; repeated
    rows are judged each; a null id stays null; other columns are left out; an empty table gives no rows."""

    def judge(batches):
        for b in batches:
            data, at = buffers(b.column("text"))
            counts = [[] for _ in _COUNTS]
            with np.errstate(over="ignore"):
                for i, j in chunks(at):
                    for into, x in zip(counts, base_counts(data, at, i, j)):
                        into.append(x)
            counts = [np.concatenate(x) for x in counts]
            view = memoryview(data)
            whole, parts = ratios((view[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())), level, part)
            odd = [sum(not part_band[0] <= r <= part_band[1] for r in p) for p in parts]
            n_parts = [len(p) for p in parts]
            failed = (counts[0] < 50) | (100 * counts[4] > 50 * counts[0])
            inside = [lo <= r <= hi and o <= part_share * n for r, o, n, (lo, hi) in zip(whole, odd, n_parts, (band(x, bands) for x in np.diff(at).tolist()))]
            columns = [b.column("doc_id"), *counts, whole, n_parts, odd, failed, np.array(inside, bool) & ~failed]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[x.split()[0] for x in schema.split(", ")])

    small_batches(docs.sparkSession)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", zstd_ratio double, n_parts long, n_odd_parts long, base_failed boolean, kept boolean"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), "text").mapInArrow(lean(judge), schema)


def op5_compression_bands(spark, sf_dir):
    return quality(documents(spark, sf_dir))
