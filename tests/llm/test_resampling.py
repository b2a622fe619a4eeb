"""Importance resampling against brute force: n-grams, gains, weights, noise and ranks, each worked out one by one."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lorestone.llm import resampling
from lorestone.llm.queries import QUERIES


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def grams(text, n):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, n=1, buckets=10_000, least=20, percent=10):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (collections.Counter(bucket(g) for x in texts for g in grams(x, n)) for texts in ([d[1] for d in docs], target))
    gain = lambda b: math.floor(1000 * math.log(float((t[b] + 1) * (s.total() + buckets)) / float((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, text in docs:
        own = [gain(bucket(g)) for g in grams(text, n)]
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(own) // len(own) if own else 0
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text)) >= least])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0], r[2], r[1]))
    for rank, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def made(seed, size=300):
    r = random.Random(seed)
    vocabulary = ["Alpha", "beta", "GAMMA", "délta", "x9", "10", "über-all", "日本 語", "it's", "Ångström"]
    say = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", "\n", ", ", "_", "\x7f"]) for _ in range(n))
    docs = [(i, say(r.randint(0, 80))) for i in range(size)]
    # Repeated rows, one id for many, ids and texts that are null, texts without a word, and a long one.
    docs += [docs[3]] * 5 + [(7, say(30))] * 3 + [(None, say(40)), (None, say(41)), (900, None), (901, ""), (902, "_-_ \x7f"), (903, "long WORD " * 30_000)]
    return docs, [say(r.randint(0, 20)) for _ in range(30)] + [None, ""]


@pytest.mark.parametrize("n,buckets,least,percent", [(1, 10_000, 20, 10), (2, 97, 1, 100), (4, 1000, 5, 33), (1, 1, 20, 0)])
def test_against_brute_force(spark, n, buckets, least, percent):
    docs, target = made(n)
    corpus = spark.createDataFrame([(*d, 1, "a", 2) for d in docs], "doc_id long, text string, score long, bucket string, weight int").repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(corpus, aim, n, buckets, least, percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, target, n, buckets, least, percent)


def test_suffix_array_lists_every_run(monkeypatch):
    r = random.Random(5)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in range(40)]
    for n in (1, 2, 3, 5):
        for size in (64, 1 << 20):
            monkeypatch.setattr(resampling, "SLICE", size)
            got = [[] for _ in texts]
            for i, _, _, found in resampling.features(pa.array(texts), n, 1 << 30):
                for doc, bucket in found:
                    for d, b in zip(doc.tolist(), bucket.tolist()):
                        got[i + d].append(b)
            assert [sorted(g) for g in got] == [sorted(zlib.crc32(g.encode()) % (1 << 30) for g in grams(t, n)) for t in texts]
    ids, doc, _ = resampling.word_ids(np.frombuffer(b"b a b a", np.uint8), np.array([0, 7]), 0, 1)
    order, lcp, left = resampling.suffix_array(ids, doc, 3)
    assert sorted(order.tolist()) == [0, 1, 2, 3] and sorted(lcp.tolist()) == [0, 0, 1, 2] and left.tolist() == [3, 3, 2, 1]


def test_query(spark, tmp_path):
    docs, target = made(9)
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(t,) for t in target], "text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted((tuple(r) for r in QUERIES["op11_resample"](spark, str(tmp_path)).collect()), key=repr) == brute(docs, target)


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert resampling.resample(none, some).collect() == []
    assert [tuple(r) for r in resampling.resample(some, none, percent=100).select("n_features", "rank").collect()] == [(40, 1)]
