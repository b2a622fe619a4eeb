"""Each registered query over a small corpus, against brute force; and the pipeline's stages on awkward tables."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lorestone.llm import common, language, minhash, mixing, neighbours, packing, quality, substrings, tokens
from lorestone.llm.queries import QUERIES

from .test_llm import PLAIN, WORD, holds, linked, prose, shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def made():
    r = random.Random(21)
    texts = [prose(r, r.randint(30, 160)) for _ in range(50)]
    passage = prose(r, 70)
    for i in (3, 9, 17):
        texts[i] = f"{prose(r, 40)}\n{passage}\n{prose(r, 20)}"
    near = prose(r, 100).split()
    for k in range(6):
        w = list(near)
        w[k * 9] = f"edit{k}"
        texts.append(" ".join(w))
    texts += [texts[0], texts[0], "", None, " \n", "½ ² ①", "x@y.example or 10.1.2.3, +1 (555) 123-4567 and 4111 1111 1111 1111", "a b", "long " * 9000]
    return [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "s3"][i % 4], len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def data():
    return made()


@pytest.fixture(scope="module")
def sf(spark, data, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(data, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


def run(spark, sf, name):
    return QUERIES[name](spark, sf).collect()


def test_op1(spark, sf, data):
    sets = [shingles(d[1], 4) for d in data]
    want = {d[0]: (len(s), c, d[0] == c) for d, s, c in zip(data, sets, linked(sets, 80))}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in run(spark, sf, "op1_chosen_path")} == want


def test_rows_of_one_id_are_linked_each(spark):
    w, w2 = prose(random.Random(1), 40), prose(random.Random(2), 40)
    docs = spark.createDataFrame([(1, w), (1, w2), (2, w), (3, w2 + " tail"), (4, None), (4, "")], "doc_id long, text string")
    got = minhash.near_duplicates(docs, words=4).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4)]
    assert len({r["component"] for r in got if r["component"] is not None}) == 2
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_many_large_nodes(spark, monkeypatch):
    """Pivots that are too many to be sent to all tasks meet parts of their nodes."""
    monkeypatch.setattr(minhash, "HEADS", 0)
    monkeypatch.setattr(minhash, "CONFIRM_BYTES", 3000)
    monkeypatch.setattr(minhash, "NODE", 6)
    monkeypatch.setattr(minhash, "SALTS", 3)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    r = random.Random(3)
    base = prose(r, 60).split()
    texts = []
    for k in range(60):
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(60)] = f"v{r.randrange(40)}"
        texts.append(" ".join(w if k % 3 else base))
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=4).collect()}
    assert got == dict(enumerate(linked([shingles(t, 4) for t in texts], 80)))


def encoded(name, texts):
    t = Tokenizer.from_file(tokens.public_path(name))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def packed(rows, whole):
    """Whether the rows of a packing hold each of the documents' ids in one piece, gapless, without padding."""
    parts, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == crc(whole[r["doc_id"]][r["start"] : r["start"] + r["length"]])
        assert r["doc_tokens"] == len(whole[r["doc_id"]])
        parts[r["doc_id"]].append((r["start"], r["length"]))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for of, size in ((parts, {d: len(x) for d, x in whole.items()}), (seqs, None)):
        for k, p in of.items():
            at = 0
            for start, n in sorted(p):
                assert start == at
                at += n
            assert at == size[k] if size else at <= 1024 and at & (at - 1) == 0
    assert set(parts) == set(whole)


def test_op2(spark, sf, data):
    packed(run(spark, sf, "op2_pack_hilbert"), {d[0]: [*ids, 0] for d, ids in zip(data, encoded("byte_bpe_50k.json", [d[1] for d in data]))})


def test_id_width():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = tokens.encoder(tokens.public_path(name))
        assert e.dtype == np.dtype("<u2")
        assert e.lengths.shape[0] <= 1 << 16


def test_op4(spark, sf, data, monkeypatch):
    """Chunks cut by a plain loop over bytes, places in a dictionary, rows of repeated ones by words; hot digests too."""
    places, chunks, gear = collections.defaultdict(list), {}, substrings._GEAR.tolist()
    for d, t, *_ in data:
        raw = (t or "").encode()
        start, own = 0, []
        for i in range(len(raw)):
            h = sum(gear[raw[i - k]] << k for k in range(min(16, i + 1))) % 2**32
            if h * 0x9E3779B1 % 2**32 < 2**32 // substrings.MEAN or i == len(raw) - 1:
                own.append((start, i + 1, raw[start : i + 1]))
                places[raw[start : i + 1]].append((d, start))
                start = i + 1
        chunks[d] = own

    def spans(own, raw):
        """Rows of chunks side by side that begin enough words."""
        for _, g in itertools.groupby(enumerate(own), lambda x: x[1][2] - x[0]):
            g = [x for _, x in g]
            a, b = g[0][0], g[-1][1]
            begins = sum(m.start() >= a for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw[:b]) if m.start() < b)
            if begins >= substrings.LEAST_WORDS:
                yield a, b, min(places[raw[x:y]][0][0] for x, y, _ in g)

    want = {}
    for d, t, *_ in data:
        raw = (t or "").encode()
        again = [(a, b, k) for k, (a, b, c) in enumerate(chunks[d]) if len(places[c]) > 1]
        found = list(spans(again, raw))
        gone = list(spans([x for x in again if places[raw[x[0] : x[1]]][0] != (d, x[0])], raw))
        if found:
            listed = [",".join(f"{a}:{b}" for a, b, _ in x) for x in (found, gone)]
            want[d] = (d, len(found), sum(b - a for a, b, _ in found), sum(b - a for a, b, _ in gone), min(f for *_, f in found), *listed)
    assert {3, 9, 17} <= set(want)
    got = {r["doc_id"]: tuple(r) for r in run(spark, sf, "op4_chunk_dedup")}
    assert got == want
    monkeypatch.setattr(substrings, "HOT_PLACES", 2)
    assert {r["doc_id"]: tuple(r) for r in run(spark, sf, "op4_chunk_dedup")} == want


def test_repeated_rows_of_one_id_are_no_repeat_even_if_hot(spark, monkeypatch):
    text = prose(random.Random(5), 200)
    docs = spark.createDataFrame([(1, text)] * 6, "doc_id long, text string")
    assert substrings.repeats(docs).count() == 0
    monkeypatch.setattr(substrings, "HOT_PLACES", 2)
    assert substrings.repeats(docs).count() == 0


def test_dedup_substrings_with_any_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"rep_id": F.lit(1), "Rep_Spans": F.lit("x"), "removed": F.lit(0)})
    out = substrings.dedup_substrings(docs)
    assert out.columns == docs.columns
    assert out.count() == docs.count()
    assert substrings.dedup_substrings(docs.limit(0)).count() == 0


def test_op5(spark, sf, data):
    got = {r["doc_id"]: r for r in run(spark, sf, "op5_compression_bands")}
    c = zstandard.ZstdCompressor(level=quality.LEVEL, write_content_size=False, write_checksum=False)
    for d, t, *_ in data:
        w, raw = WORD.findall(t or ""), (t or "").encode()
        n3 = collections.Counter(zip(w, w[1:], w[2:]))
        again = {i + k for i in range(len(w) - 2) if n3[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        low, high = next((a, b) for n, a, b in quality.BANDS if len(raw) <= n)
        ratio = len(c.compress(raw)) / len(raw) if raw else 0
        parts = [raw[i : i + quality.PART] for i in range(0, len(raw), quality.PART)] if len(raw) >= 2 * quality.PART else []
        parts = [p for p in parts if len(p) >= quality.LEAST_PART]
        odd = sum(not quality.PART_BAND[0] <= len(c.compress(p)) / len(p) <= quality.PART_BAND[1] for p in parts)
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again))
        assert (r["base_failed"], r["kept"]) == (failed, not failed and low <= ratio <= high and odd <= quality.PART_SHARE * len(parts))


def test_op6(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 12)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2100, [0.0] * 12)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4).write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(neighbours, "BLOCK_LEAST", 300)
    monkeypatch.setattr(neighbours, "GROUP", 4)
    got = collections.defaultdict(list)
    for r in QUERIES["op6_anisotropic_search"](spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 1500, 100))
    hit = 0
    for q, found in got.items():
        far = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        far[q] = np.inf
        assert all(abs(far[v] - s) < 1e-12 for v, s in found)
        hit += len(set(np.argsort(far, kind="stable")[:10].tolist()) & {v for v, _ in found})
    assert hit >= 0.9 * 10 * len(got)


def test_op6_ties_go_to_the_smaller_ids(spark, monkeypatch):
    """3,000 equal vectors among others, over ten blocks, in falling order of ids."""
    monkeypatch.setattr(neighbours, "BLOCK_MOST", 400)
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(3000, 0, -1)] + [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(4000, 5000)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(2)
    got = neighbours.nearest(vectors, vectors.where("vec_id in (100, 7)")).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 5, 6, 8, 9, 10, 11, *range(1, 11)]
    assert {r["score"] for r in got} == {0.0}


def test_op6_searches_vectors_of_each_length(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 40)] + [(i, [float(i), 1.0, 2.0]) for i in range(40, 52)] + [(100, [5.0]), (200, [1.0, 2.0, 3.0, 4.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = vectors.where("vec_id in (1, 40, 100, 200)").unionByName(spark.createDataFrame([(300, [0.0, 0.0, 0.0, 1.0, 1.0])], vectors.schema))
    got = neighbours.nearest(vectors, asked, 3)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2, 1.0), (1, 2, 3, 2.0), (1, 3, 4, 3.0), (40, 1, 41, 1.0), (40, 2, 42, 2.0), (40, 3, 43, 3.0)]


def test_op7(spark, sf, data):
    at = 0
    for r, d, ids in zip(sorted(run(spark, sf, "op7_dac_ids"), key=lambda r: r["doc_id"]), data, encoded("word_bpe_49k.json", [d[1] for d in data]), strict=True):
        ids = [*ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d[0], at, len(ids), crc(ids))
        at += len(ids)


def plain_grams(t):
    import unicodedata

    letters = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in t.lower())
    if not any(unicodedata.category(c)[0] == "L" for c in letters):
        return []
    t = f" {' '.join(letters.split())} "
    n = collections.Counter(t[i : i + k] for k in (1, 2, 3) for i in range(len(t) - k + 1))
    del n[" "]
    pack = lambda g: sum((ord(c) + 1) << (21 * i) for i, c in enumerate(reversed(g)))
    return sorted(n.items(), key=lambda x: (-x[1], pack(x[0])))


def test_op8(spark, sf, data):
    counts = collections.defaultdict(collections.Counter)
    out = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    for d, t, lang, *_ in data:
        if t is not None and lang and not out(d):
            counts[lang].update(dict(plain_grams(t)))
    pack = lambda g: sum((ord(c) + 1) << (21 * i) for i, c in enumerate(reversed(g)))
    profiles = {k: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], pack(x[0])))[: language.RANKS]] for k, c in counts.items()}
    got = {r["doc_id"]: r for r in run(spark, sf, "op8_rank_order_profiles")}
    for d, t, *_ in data:
        r = got[d]
        assert r["held_out"] == out(d)
        own = [g for g, _ in plain_grams(t or "")][: language.RANKS]
        if not own:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        far = {k: sum(min(abs(p.index(g) - i), language.RANKS) if g in p else language.RANKS for i, g in enumerate(own)) for k, p in profiles.items()}
        assert r["lang_pred"] == min(sorted(far), key=far.get)
        assert r["score"] == pytest.approx(1 - min(far.values()) / (language.RANKS * len(own)))


def test_letters_of_any_script(spark):
    say = {"hi": "यह एक वाक्य है और यह दूसरा वाक्य है", "ta": "இது ஒரு வாக்கியம் மற்றும் இது இரண்டாவது", "zh": "这是一个句子这也是一个句子", "th": "นี่คือประโยคหนึ่งและนี่คืออีกประโยค"}
    docs = spark.createDataFrame([(t, k) for k, t in say.items()], "text string, lang string")
    profiles = language.train(docs)
    asked = spark.createDataFrame([(t[2:], k) for k, t in say.items()] + [(x, "und") for x in ("½ ² ① ½ ²", "́̂", "12 ١٢ Ⅷ", "😀 ...")], "text string, lang string")
    assert all(r["lang_pred"] == r["lang"] for r in language.predict(asked, profiles).collect())
    assert len(language.codes("क्षि")) == 4 + 2


def test_op9(spark, sf, data):
    got = {r["doc_id"]: r for r in run(spark, sf, "op9_disclosure")}
    for d, t, *_ in data:
        spans = [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, t or "") if holds(k, m.group())]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        r = got[d]
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in spans) for k in PLAIN]
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert r["spans"].startswith(listed)


def test_op3_and_10(spark, sf, data):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet/*.parquet'")
    want = con.sql(mixing.OP3_SQL).fetchall()
    key = lambda r: tuple(-1 if x is None else float(x) for x in r)
    assert sorted(map(key, run(spark, sf, "op3_mix_sources"))) == sorted(map(key, want))
    got = {r["doc_id"]: r for r in run(spark, sf, "op10_line_dedup")}
    assert got[0]["n_removed"] == 0
    assert got[56]["n_removed"] == got[57]["n_removed"] == 1
    assert got[57]["text_sha256"] == hashlib.sha256(b"").hexdigest()


AWKWARD = DOCS + ", nd_row string, nd_n int, lang_pred string, LANG_SCORE string, lang_size int, ld_removed string, ld_x int, mix_size string, Mix_Copies int"


def awkward(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, "b", "c", 2, "d", 3, "e", 4) for r in rows], AWKWARD)


def test_stages_keep_columns_and_empty_tables(spark, sf, data):
    docs = awkward(spark, data)
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, sf)
        assert out.columns == docs.columns, name
        kept = out.drop(*DOCS.replace(" long", "").replace(" string", "").split(", ")).distinct().collect()
        assert [tuple(r) for r in kept] == [("a", 1, "b", "c", 2, "d", 3, "e", 4)], name
        assert f(spark, docs.limit(0), sf).count() == 0, name
    assert corpus_pipeline.pack_sequences(spark, docs.limit(0), sf).count() == 0


def test_stage_near_duplicates_judges_texts_of_one_id(spark):
    r = random.Random(12)
    a, b, c = (prose(r, 60) for _ in range(3))
    rows = [(1, a), (1, b), (1, b), (2, a + " x"), (3, c), (3, c), (4, None), (5, ""), (None, a), (6, b + " y")]
    docs = spark.createDataFrame([(*x, "en", "s", 0) for x in rows], DOCS)
    got = collections.Counter((x["doc_id"], x["text"]) for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == collections.Counter([(1, a), (1, b), (3, c), (4, None), (5, ""), (None, a)])


def test_stage_near_duplicates_takes_columns_of_any_type(spark):
    """Of repeated rows one stays, whole, also where a column can't be ordered."""
    text = prose(random.Random(3), 60)
    rows = [(1, text, {"k": str(i % 3)}, [i % 3], bytes([i % 3])) for i in range(30)] + [(2, text + " x", {}, [], b""), (3, "other words", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,string>, parts array<int>, raw binary").repartition(5)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.schema == docs.schema
    one, other = sorted(got.collect(), key=lambda r: r["doc_id"])
    assert (one["doc_id"], one["tags"]["k"], bytes(one["raw"])) == (1, str(one["parts"][0]), bytes(one["parts"])) and other["doc_id"] == 3
    again = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(3), "").where("doc_id = 1").first()
    assert again["parts"] == one["parts"]


def test_stages_mix_and_pack(spark, sf, data):
    docs = spark.createDataFrame(data, DOCS)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet/*.parquet'")
    copies = {d: n for d, n in con.sql(mixing.mix_sql("documents") + "SELECT doc_id, copies FROM c").fetchall()}
    mixed = corpus_pipeline.mix_by_weight(spark, docs, sf)
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == collections.Counter({d: n for d, n in copies.items() if n})
    packed(corpus_pipeline.pack_sequences(spark, docs, sf).collect(), {d[0]: [*ids, 0] for d, ids in zip(data, encoded("byte_bpe_50k.json", [d[1] for d in data]))})


def test_hot_lines_and_long_runs(spark, monkeypatch):
    """Lines that most documents share are joined where they are, and long runs are compared in blocks."""
    from lorestone.llm import lines

    r = random.Random(4)
    head = prose(r, 5)[:24].ljust(24, "q")
    rows = [(i, "\n".join([head + f" tail {r.randrange(10**8):08d} end", "All rights reserved.", prose(r, 12)])) for i in range(60)]
    rows += [(100 + i, rows[i][1].split("\n")[0][:-1]) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(map(tuple, lines.dedup_lines(docs, short=True).collect()))
    monkeypatch.setattr(lines, "GROUP", 8)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    assert sorted(map(tuple, lines.dedup_lines(docs, short=True).collect())) == want
    assert sum(w[1].count("All rights") for w in want) == 1
    assert all(w[4] == 1 for w in want if w[0] >= 100)


def test_scratch_is_shared_and_swept(spark, tmp_path, monkeypatch):
    from lorestone import scratch

    table = common.materialise(spark.range(3), "t")
    assert spark.sparkContext.applicationId in table._scratch
    common.forget(table)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(table._scratch).count()

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.scratch(Far, "x")


def test_curve_places_copies_together():
    t = [prose(random.Random(k), 60) for k in range(5)] * 2
    raw = "".join(t).encode()
    at = np.concatenate([[0], np.cumsum([len(x.encode()) for x in t])])
    keys = packing.curve_keys(np.frombuffer(raw, np.uint8), at)
    assert keys[:5].tolist() == keys[5:].tolist()
    assert len(set(keys.tolist())) == 5
    assert all(len(x) for x in itertools.chain(t))
