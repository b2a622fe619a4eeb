"""Suffix-array dedup against brute force over every string of every text."""

import collections
import hashlib
import random

import numpy as np
import pytest

from lorestone.llm import suffixes
from lorestone.llm.queries import QUERIES

L = suffixes.LENGTH


def brute(texts, length=L):
    """(bytes, removed, spans, digest of the rest) of each text."""
    raws = [(t or "").encode() for t in texts]
    n = collections.Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if n[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes()
        out.append((len(r), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def found(spark, texts, length=L):
    rows = spark.createDataFrame([(i, t, 1, b"x") for i, t in enumerate(texts)], "doc_id long, text string, row long, spans binary").repartition(3)
    df = suffixes.remove_repeats(rows, length)
    out = {}
    for r in df.collect():
        raw, kept = r["text"].encode(), bytes(r["kept"])
        spans = [(s["start"], s["end"]) for s in r["spans"]]
        ends = [0, *(x for s in spans for x in s), len(raw)]
        assert b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2])) == kept
        out[r["doc_id"]] = (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    suffixes.release(df)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lorestone_texts")]
    return [out[i] for i in range(len(texts))]


def corpus(seed):
    r = random.Random(seed)
    prose = lambda n: "".join(r.choice("abcdefghij klmnop é") for _ in range(n))
    texts = [prose(r.randint(0, 1500)) for _ in range(40)]
    passage, long = prose(230), prose(900)
    for _ in range(25):
        texts.append(prose(r.randint(0, 300)) + passage[r.randint(0, 60) : 230 - r.randint(0, 20)] + prose(r.randint(0, 300)))
    for _ in range(20):
        t = list(long)
        for _ in range(r.randint(0, 3)):
            t[r.randrange(len(t))] = "#"
        texts.append("".join(t))
    return [*texts, texts[0], texts[0], "", None, " \n", "ab" * 700, "x" * 1000, "x" * 199, "x" * 200, "y" * 200, "z" * 201, long + long, passage * 4]


@pytest.mark.parametrize("hot,look,part", [(1 << 20, 2 << 20, 2000), (5, 1 << 14, 3), (15, 1 << 12, 2)])
def test_against_brute_force(spark, monkeypatch, hot, look, part):
    monkeypatch.setattr(suffixes, "HOT_PLACES", hot)
    monkeypatch.setattr(suffixes, "LOOK_BYTES", look)
    monkeypatch.setattr(suffixes, "LOOK_BLOCKS", part)
    if hot < 100:
        monkeypatch.setattr(suffixes, "HOT_KEYS", 10**9)
    texts = corpus(hot)
    assert found(spark, texts) == brute(texts)


def test_long_texts_come_in_slices(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SLICE", 700)
    texts = corpus(3) + ["".join(random.Random(4).choice("ab") for _ in range(20_000))]
    assert found(spark, texts) == brute(texts)


def test_other_lengths(spark):
    texts = corpus(6)
    for length in (1, 2, 50):
        assert found(spark, texts[-30:], length) == brute(texts[-30:], length)


def test_suffix_order_and_common_bytes():
    r = random.Random(1)
    strings = ["".join(r.choice("ab") for _ in range(r.randint(1, 60))).encode() for _ in range(40)]
    s = suffixes.Suffixes(strings)
    text = lambda x: s.raw[x : s.end[x]]
    at = np.arange(len(s.data))
    group = s.string % 3
    with np.errstate(over="ignore"):
        out, own = s.sort(at, group)
        longest = dict(zip(*(c.tolist() for c in s.longest(at, group))))
    assert [(g, text(x)) for g, x in zip(own, out)] == sorted((g, text(x)) for g, x in zip(group, at))
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for x in r.sample(range(len(s.data)), 60):
        assert longest[x] == max(common(text(x), text(y)) for y in at.tolist() if y != x and group[y] == group[x])


def test_collisions_of_hashes_are_found_out(monkeypatch):
    """With one hash for all strings, the bytes alone decide."""
    monkeypatch.setattr(suffixes, "prefix_hash", lambda values: (np.zeros(len(values) + 1, np.uint64), np.zeros(len(values) + 1, np.uint64)))
    r = random.Random(2)
    shared = bytes(r.randrange(97, 123) for _ in range(30))
    strings = [bytes(r.randrange(97, 123) for _ in range(40)) for _ in range(5)] + [b"1" + shared + b"2", b"34" + shared]
    s = suffixes.Suffixes(strings)
    with np.errstate(over="ignore"):
        string, start, end = s.spans(s.repeated(np.zeros(len(strings), np.int64), 20))
    assert sorted(zip(string.tolist(), start.tolist(), end.tolist())) == [(5, 1, 31), (6, 2, 32)]


def test_query(spark, tmp_path):
    texts = corpus(8)
    rows = [(None if i == 7 else i, t, "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op12_suffix_dedup"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = [(r[0], *b) for r, b in zip(rows, brute(texts))]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["op12_suffix_dedup"](spark, str(tmp_path)).collect() == []
