"""Each corpus operator against brute force, exact round trips, or planted cases, with nulls, ties and empty tables."""

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lorestone.llm import binary_ids, common, language, lines, minhash, mixing, neighbours, packing, privacy, quality, substrings, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
R = random.Random(5)
VOCABULARY = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 9))) for _ in range(400)]


def prose(r, n):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def corpus():
    """Prose, copies, near copies, repeated lines, very long, empty and null texts, and a repeated row."""
    r = random.Random(1)
    texts = [prose(r, r.randint(20, 200)) for _ in range(60)]
    base = prose(r, 120).split()
    for k in range(30):
        w = list(base)
        for _ in range(k % 12):
            w[r.randrange(len(w))] = r.choice(VOCABULARY)
        texts.append(" ".join(w))
    texts += [texts[0]] * 4 + ["", " \n\t ", None, "one two", "one TWO", "x" * 20_000, "a\nb\n" + prose(r, 30) + "\n" + prose(r, 12), "日本語 テスト 😀"]
    line = prose(r, 15)
    texts += [line + "\n" + prose(r, 40), prose(r, 40) + "\n" + line[:-1] + "Z", line[1:] + "\n" + prose(r, 5)]
    rows = [(i, t, "en" if i % 3 else None, [None, "s1", "s2"][i % 3], len(t or ""), 7) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, "no id here", None, None, None, 7)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(t, k):
    w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def linked(sets, percent):
    f = common.Forest(len(sets))
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            f.union(i, j)
    return [f.find(i) for i in range(len(sets))]


@pytest.mark.parametrize("node", [512, 8])
def test_near_duplicates(docs, rows, monkeypatch, node):
    """With nodes of 8 documents at most, pivots, strays and blocks have work too."""
    monkeypatch.setattr(minhash, "NODE", node)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, words=4).collect()}
    ids = [r[0] for r in rows[:-2]]
    sets = [shingles(r[1], 4) for r in rows[:-2]]
    want = {i: (len(s), ids[c]) for i, s, c in zip(ids, sets, linked(sets, 80))}
    assert {k: v for k, v in got.items() if k is not None} == want
    assert got[None][1] is None


def test_equal_sets_have_one_name():
    """Wherever in a batch a text stands, its set has the same two sums: copies are one document to all that follows."""
    r = random.Random(8)
    copy = prose(r, 60)
    texts = [x for _ in range(20) for x in (prose(r, 50), copy)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text_key": list(range(40)), "text": texts})
    signed = pa.Table.from_batches(minhash._sign(4)([batch]))
    names = list(zip(signed["f1"].to_pylist(), signed["f2"].to_pylist()))
    assert len(set(names[1::2])) == 1 and len(set(names)) == 21


def test_keys_are_cut_whole():
    """However rows come in batches, all of a key are seen at once."""
    for seed in range(30):
        r = random.Random(seed)
        keys = sorted((r.randrange(6), r.randrange(3)) for _ in range(60))
        cuts = sorted({0, 60, *(r.randrange(1, 60) for _ in range(r.randrange(12)))})
        rows = pa.RecordBatch.from_pydict({"a": [k[0] for k in keys], "b": [k[1] for k in keys], "n": list(range(60))})
        got = [b.to_pydict() for b in minhash.whole((rows.slice(i, j - i) for i, j in itertools.pairwise(cuts)), ["a", "b"])]
        assert [n for b in got for n in b["n"]] == list(range(60))
        seen = [set(zip(b["a"], b["b"])) for b in got]
        assert sum(map(len, seen)) == len(set(keys))


def test_small_nodes_are_no_groups(spark, docs, monkeypatch):
    """Nodes and groups of two documents are many; neither is a group of its own to Spark."""
    plans = []
    real = minhash.materialise
    monkeypatch.setattr(minhash, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, name))
    minhash.near_duplicates(docs, words=4)
    assert plans and not any("FlatMapGroups" in p for p in plans)


def test_branching_groups(spark, monkeypatch):
    monkeypatch.setattr(minhash, "NODE", 6)
    monkeypatch.setattr(minhash, "BLOCKED", 10)
    r = random.Random(3)
    base = prose(r, 60).split()
    texts = []
    for _ in range(80):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(60)] = r.choice(VOCABULARY)
        texts.append(" ".join(w))
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=4).collect()}
    assert got == dict(enumerate(linked([shingles(t, 4) for t in texts], 80)))


def test_components_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(common, "EDGES_AT_ONCE", 0)
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    f = common.Forest(1100)
    for a, b in edges:
        f.union(a, b)
    got = {x["node"]: x["comp"] for x in common.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {n: f.find(n) for n in {n for e in edges for n in e if e[0] != e[1]}}


BYTE, LOWER = tokens.public_path("byte_bpe_50k.json"), tokens.public_path("word_bpe_49k.json")


def direct(path, texts):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab'éßΣ0 \n\t\x1c\x00 ́.,#日😀İ\x85\xa0\u2003\u3000à")), max_size=30), max_size=6))
def test_tokens(texts):
    for path in (BYTE, LOWER):
        e = tokens.encoder(path)
        assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts)] == direct(path, texts)


def test_tokens_survive_forgetting(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBER", 20)
    e, r = tokens.Encoder(BYTE), random.Random(1)
    for _ in range(30):
        texts = [prose(r, 20) for _ in range(3)]
        assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts)] == direct(BYTE, texts)


def test_packing(docs, rows, empty):
    got = packing.pack(docs, BYTE).toPandas()
    want = collections.Counter()
    for (doc_id, text, *_), ids in zip(rows, direct(BYTE, [r[1] or "" for r in rows])):
        want[doc_id, len(ids) + 1] += len(ids) + 1
    have = collections.Counter()
    for r in got.itertuples():
        have[None if pd.isna(r.doc_id) else int(r.doc_id), r.doc_tokens] += r.length
        assert zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) == r.ids_crc32
    assert have == want
    whole = {r[0]: [*ids, 0] for r, ids in zip(rows, direct(BYTE, [r[1] or "" for r in rows]))}
    for r in got[got.doc_id.notna()].itertuples():
        assert np.frombuffer(r.ids, "<u2").tolist() == whole[int(r.doc_id)][r.start : r.start + r.length]
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.to_numpy() == np.concatenate([[0], s.length.cumsum()[:-1]])).all()
        n = int(s.length.sum())
        assert n <= 1024
        assert n & (n - 1) == 0
    assert packing.pack(empty, BYTE).count() == 0


def test_hilbert_is_a_curve():
    """All points of a grid are visited once, each a step from the one before."""
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    order = packing.hilbert_index(side, 3)
    assert sorted(order) == list(range(512))
    assert (np.abs(np.diff(side[np.argsort(order)], axis=0)).sum(1) == 1).all()


def test_mixing(spark, docs, rows, empty):
    plan = mixing.mix_plan(docs)
    got = plan.select("doc_id", "mix_size", "mix_source_size", "mix_target", "mix_copies").collect()
    con = duckdb.connect()
    pdf = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars", "bucket"])
    pdf["doc_id"] = pdf["doc_id"].astype("Int64")
    con.register("docs", pdf)
    want = con.sql(mixing.mix_sql("docs") + "SELECT doc_id, size, source_size, target, copies FROM c").fetchall()
    key = lambda r: tuple(-1 if x is None or x is pd.NA else float(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(docs).count() == sum(r["mix_copies"] for r in got)
    assert mixing.mix_plan(empty).count() == 0
    caps = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 0), (None, 5)], "source string, source_size long")
    t = {r["source"]: r["target"] for r in mixing.source_targets(caps).collect()}
    assert t["a"] == 30.0
    assert t["c"] == 0.0
    assert sum(t.values()) == pytest.approx(1015)


def test_substrings(spark, empty):
    r = random.Random(4)
    texts = [prose(r, 250).split() for _ in range(60)]
    planted = set()
    for n in (60, 80):
        for _ in range(8):
            p, (i, j) = prose(r, n).split(), r.sample(range(60), 2)
            for x in (i, j):
                at = r.randrange(len(texts[x]))
                texts[x][at:at] = p
            planted |= {i, j}
    data = [(i, " ".join(t), "x") for i, t in enumerate(texts)] + [(100, None, "x"), (101, "", "x"), (None, " ".join(texts[0]), "x"), (0, " ".join(texts[0]), "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, rep_id string").repartition(3)
    assert {x["doc_id"] for x in substrings.repeats(df).collect()} == planted
    assert substrings.repeats(empty).count() == 0
    out = {x["doc_id"]: x["text"] for x in substrings.dedup_substrings(df.drop("rep_id")).collect() if x["doc_id"] is not None}
    assert sum(len(out[i].split()) < len(texts[i]) for i in range(60)) >= 6
    assert all(out[i] == " ".join(texts[i]) for i in range(60) if i not in planted)


def test_cuts_resist_shifts():
    a = np.frombuffer(prose(random.Random(1), 500).encode(), np.uint8)
    b = np.concatenate([np.frombuffer(b"inserted ", np.uint8), a])
    ends = [set((substrings.cuts(x, np.array([0])) - k).tolist()) for x, k in ((a, 0), (b, 9))]
    assert {e for e in ends[0] if e > 32} == {e for e in ends[1] if e > 32}


def test_quality(docs, rows, empty):
    got = quality.quality(docs).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        t = texts[r["doc_id"]]
        w = WORD.findall(t)
        full = [x for x in t.split("\n") if WORD.search(x)]
        n3 = collections.Counter(zip(w, w[1:], w[2:]))
        again = {i + k for i in range(len(w) - 2) if n3[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(full) - len(set(full)), len(again))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality(empty).count() == 0
    lo, hi = quality.band(3000)
    r = random.Random(0)
    noise = " ".join("".join(r.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/") for _ in range(40)) for _ in range(75)).encode()
    assert quality.ratios([memoryview(noise)])[0][0] > hi
    assert quality.ratios([memoryview(b"again and again " * 190)])[0][0] < lo


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[50:80] = x[0]
    data = [(i, v.tolist(), "s") for i, v in enumerate(x)] + [(5000, None, "s"), (5001, [0.0] * 16, "s"), (5002, [float("nan")] * 16, "s"), (5003, [None] * 16, "s"), (5004, [1.0], "s")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, score string").repartition(4)
    got = neighbours.nearest(df, df.where("vec_id % 100 = 0"), rerank=100).toPandas()
    hit, total = 0, 0
    for q, g in got.groupby("query_id"):
        far = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        far[q] = np.inf
        g = g.sort_values("rank")
        assert (far[g.vec_id] == g.score).all()
        hit += len(set(np.lexsort((np.arange(len(x)), far))[:10]) & set(g.vec_id))
        total += 10
    assert hit / total >= 0.9
    assert got[got.query_id == 0].sort_values("rank").vec_id.tolist() == list(range(50, 60))
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_score_aware_loss():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 8))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)

    def parallel(eta):
        books = neighbours.fit(x, eta)
        codes = neighbours.encode(x, books, eta)
        r = x - np.concatenate([books[s][codes[:, s]] for s in range(4)], 1)
        return ((r * u).sum(1) ** 2).mean()

    assert parallel(8.0) < parallel(1.0)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 49407), max_size=300))
def test_codes_round_trip(ids):
    ids = np.array(ids, np.uint32)
    d = binary_ids.Dac(binary_ids.dac_encode(ids))
    assert d.take(np.arange(len(ids))).tolist() == ids.tolist()
    some = np.arange(len(ids))[::-3]
    assert d.take(some).tolist() == ids[some].tolist()


def test_binary_ids(spark, docs, rows, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(binary_ids, "SHARD_IDS", 500)
    got = binary_ids.read_ids(binary_ids.write_ids(docs, str(tmp_path / "ids"), LOWER)).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, row, ids in zip(got, order, direct(LOWER, [r[1] or "" for r in order]), strict=True):
        ids = np.array([*ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (row[0], at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert binary_ids.read_ids(binary_ids.write_ids(empty, str(tmp_path / "none"), LOWER)).count() == 0


def test_language(spark, empty):
    r = random.Random(1)
    made = {"aa": "abcde", "bb": "defgh", "cc": "éèçàù"}
    data = [(i, " ".join("".join(r.choice(made[k]) for _ in range(5)) for _ in range(40)), k) for i, k in enumerate(list(made) * 40)]
    profiles = language.train(spark.createDataFrame([*data, (0, None, "aa"), (1, "abc", None), (2, "", "aa")], "doc_id long, text string, lang string"))
    asked = [*data, (900, None, None), (901, "12 ... !!", None), (902, "", None)]
    got = {x["doc_id"]: x for x in language.predict(spark.createDataFrame([(*d, 1) for d in asked], "doc_id long, text string, lang string, lang_score int"), profiles).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in data)
    assert {got[i]["lang_pred"] for i in (900, 901, 902)} == {"und"}
    assert all(0 <= x["lang_score"] <= 1 for x in got.values())
    assert language.train(empty) == {}
    assert language.predict(spark.createDataFrame(data, "doc_id long, text string, lang string"), {}).first()["lang_pred"] == "und"


SPOKEN = {
    "en": "the of and to in that is was for it with as his on be at by had not are but from or have they which one you were all her she there would their we him been has when who will no more if out so said what up its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years where much your way down should because long each just state those people too little good world",
    "es": "el la de que y a en un ser se no haber por con su para como estar tener le lo todo pero hacer o poder decir este ir otro ese si me ya ver porque dar cuando muy sin vez mucho saber sobre mi alguno mismo yo tambien hasta donde entre siempre ahora quien durante mundo tiempo casa dia hombre parte vida ciudad mujer lugar persona hora trabajo punto mano manera gobierno guerra noche agua cosa nombre pueblo cabeza cuerpo palabra momento historia ejemplo",
}
UNLEARNED = [
    "W Szczebrzeszynie chrząszcz brzmi w trzcinie i Szczebrzeszyn z tego słynie, a wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw, są oni obdarzeni rozumem i sumieniem.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan, heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
]


def test_stage_language_rejects_what_it_has_not_learned(spark):
    """Latin-script languages without a profile, random letters, base64 and hex go; what was learned stays, labelled or not."""
    r = random.Random(11)
    say = lambda k: " ".join(r.choice(SPOKEN[k].split()) for _ in range(r.randint(40, 160)))
    data = [(i, say(k), k if i < 500 else None) for i, k in enumerate(["en", "es"] * 270)]
    noise = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(600)), base64.b64encode(r.randbytes(450)).decode(), r.randbytes(300).hex()]
    data += [(1000 + i, t, None) for i, t in enumerate(UNLEARNED + noise)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    got = {x["doc_id"]: x["lang"] for x in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert not [i for i in got if i >= 1000]
    assert got == {i: ["en", "es"][i % 2] for i in range(540)}


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "phone":
        return 8 <= len(d) <= 15
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 16 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0
    return True


def test_private_patterns(spark, empty):
    r = random.Random(6)
    parts = ["a@b.c_d@e.f", "x.y%z+1@host-1.example.com", "@", "1.2.3.4.5.6.7.8", "256.1.1.1", "007.1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "é日😀", "a@b", "..", "+49 30 1234567890123", "1234", " ", "\n", "9" * 30]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", ".", "\n"]) for _ in range(r.randint(0, 12))) for _ in range(300)] + ["", None, "7" * 30_000, "a" * 60_000 + "@", "1 " * 9000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pii string")
    for row in privacy.find_private(df).collect():
        t = texts[row["doc_id"]] or ""
        want = [(k, m.start(), m.end(), m.group()) for k, p in PLAIN.items() for m in re.finditer(p, t) if holds(k, m.group())]
        assert [tuple(s) for s in row["pii"]] == want
    assert privacy.find_private(empty).count() == 0


def test_disclosing_terms(spark):
    """A word that only stands beside one address is a span; words that stand elsewhere too aren't."""
    r = random.Random(31)
    data = [(i, f"{prose(r, 40)} write to boss@corp.example about projectzeta and common {prose(r, 20)}\nmore common lines") for i in range(6)]
    data += [(10 + i, f"common talk about things and lines {prose(r, 60)} to write more") for i in range(600)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    found = {r["doc_id"]: [s["value"] for s in r["pii"]] for r in privacy.find_private(df).collect()}
    assert all(found[i] == ["boss@corp.example", "projectzeta"] for i in range(6))
    assert not any(found[10 + i] for i in range(600))
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitise(df).collect()}
    assert clean[0] == data[0][1].replace("boss@corp.example", "[EMAIL]").replace("projectzeta", "[TERM]")
    assert clean[10] == data[6][1]


def test_phones_with_many_separators(spark, tmp_path):
    """Digits that are all two separators apart are a phone number still."""
    docs = spark.createDataFrame([(1, "call +4--4--2--0--7--9--4--6 now", "s")], "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "sf/documents.parquet"))
    row = privacy.op9_disclosure(spark, str(tmp_path / "sf")).first()
    assert (row["n_phone"], row["spans"]) == (1, "phone:5:28")


def test_told_terms_go_everywhere(spark):
    """A term told by some documents is a span in others too, where its entity is absent."""
    r = random.Random(32)
    data = [(i, f"{prose(r, 40)} write to boss@corp.example about projectzeta and common {prose(r, 20)}") for i in range(12)]
    data += [(14 + i, f"common talk about things and projectzeta {prose(r, 60)} to write") for i in range(3)]
    data += [(20 + i, f"common talk about things and lines {prose(r, 60)} to write") for i in range(600)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    found = {r["doc_id"]: [s["value"] for s in r["pii"]] for r in privacy.find_private(df).collect()}
    assert all(found[i] == ["boss@corp.example", "projectzeta"] for i in range(12))
    assert all(found[14 + i] == ["projectzeta"] for i in range(3))
    assert not any(found[20 + i] for i in range(600))


def test_terms_of_any_shape_and_line(spark):
    """Names, ids and words with a backslash are told from other lines of the document than the entity's."""
    told = ["Ana", "EMP-48213", r"CORP\ana", r"a\Eb", "李明", "@ana", "(x|y)+?", "ana"]
    r = random.Random(33)
    data = [(i, f"{prose(r, 60)} from " + " ".join(told) + f"\nsome lines to talk about\nana@corp.example {prose(r, 9)}") for i in range(12)]
    data += [(20 + i, f"some lines from {prose(r, 60)} to talk about 12 34") for i in range(600)]
    found = {r["doc_id"]: [(s["kind"], s["value"]) for s in r["pii"]] for r in privacy.find_private(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(found[i] == [("email", "ana@corp.example")] + [("term", t) for t in told] for i in range(12))
    assert not any(found[20 + i] for i in range(600))


def test_copies_are_one_piece_of_evidence(spark):
    """A text that was copied, with an address and words that stand nowhere else, tells nothing of those words."""
    r = random.Random(34)
    text = f"{' '.join(f'copied{k}' for k in range(60))} beside boss@corp.example and {' '.join(f'tail{k}' for k in range(60))}".split()
    data = []
    for i in range(40):
        w = list(text)
        w[r.choice([59, 62])] = f"edit{i % 5}"
        data.append((i, " ".join(w)))
    data += [(100 + i, prose(r, 60)) for i in range(400)]
    found = privacy.find_private(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {s["kind"] for r in found for s in r["pii"]} == {"email"}


def test_credentials_and_what_goes_with_them(spark):
    r = random.Random(35)
    data = [(i, f"{prose(r, 50)}\nservicekey follows: token = \"{i:04x}{'0f' * 16}\" end{i}") for i in range(8)]
    data += [(10, "password=hunter2hunter"), (11, "AKIA" + "Q" * 16), (12, "a token = unit of text; the password: is secret"), (13, "token: everything")]
    data += [(100 + i, f"{prose(r, 50)} follows another line, and so on to the end of it") for i in range(300)]
    found = {r["doc_id"]: {(s["kind"], s["value"]) for s in r["pii"]} for r in privacy.find_private(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    for i in range(8):
        assert {k for k, _ in found[i]} == {"secret", "term"}
        assert ("term", "servicekey") in found[i]
    assert [k for k, _ in found[10] | found[11]] == ["secret", "secret"]
    assert not any(k == "secret" for i in (12, 13) for k, _ in found[i])
    assert not any(found[i] for i in found if i >= 100)


def test_information_by_brute_force(spark, monkeypatch):
    r = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    texts = []
    for _ in range(300):
        t = [r.choice(words) for _ in range(r.randint(3, 12))]
        if r.random() < 0.3:
            t.insert(r.randrange(len(t)), f"m{r.randint(0, 9)}@d{r.randint(0, 1)}.example")
        texts.append(" ".join(t))
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    mail = re.compile(PLAIN["email"])
    classes = [{k for m in mail.finditer(t) for k in ("email", "email:of:" + m.group().split("@")[1], "email:is:" + m.group())} for t in texts]
    sets = [set(t.split()) for t in texts]
    for limit in (privacy.BROADCAST_BYTES, 0):
        monkeypatch.setattr(privacy, "BROADCAST_BYTES", limit)
        got = privacy.term_information(docs, 2).collect()
        assert len(got) > 100
        for x in got:
            have, own = [x["class"] in c for c in classes], [x["term"] in s for s in sets]
            both = [a and b for a, b in zip(have, own)]
            assert (x["n_c"], x["n_t"], x["n_ct"], x["total"]) == (sum(have), sum(own), sum(both), 300)
            if x["class"] == "email":
                told = {m.group() for t, b in zip(texts, both) if b for m in mail.finditer(t)}
                assert 2 <= x["evidence"] <= len(told)
        asked = [F.lit(float(v)) for v in (20, 10, 8)]
        row = docs.limit(1).select(privacy.information(*asked, F.lit(300)).alias("i"), privacy.surprise(*asked, F.lit(4), F.lit(300)).alias("s")).first()
        assert abs(row["i"] - (1 - np.log(0.8) / np.log(20 / 300))) < 1e-12
        assert abs(row["s"] - 5 * (0.8 * np.log(0.8 / (20 / 300)) + 0.2 * np.log(0.2 / (1 - 20 / 300)))) < 1e-9


def test_told_terms_by_either_path(spark, monkeypatch):
    r = random.Random(36)
    data = [(i, f"{prose(r, 50)} write to boss@corp.example about projectzeta and common {prose(r, 9)}") for i in range(6)]
    data += [(20 + i, f"common talk about things and lines {prose(r, 50)} to write") for i in range(300)] + [(1500, None), (1501, ""), (1502, "projectzeta projectzeta")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = sorted(map(str, privacy.find_private(df).collect()))
    monkeypatch.setattr(privacy, "AT_HAND", 0)
    assert sorted(map(str, privacy.find_private(df).collect())) == want
    assert sum("kind='term'" in w for w in want) == 7


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=12), st.text("ab", max_size=12), st.integers(0, 3))
def test_banded_automaton(a, b, most):
    assert lines.within(a, b, most) == (distance(a, b) <= most)


@pytest.mark.parametrize("group", [512, 4])
def test_lines(spark, empty, monkeypatch, group):
    monkeypatch.setattr(lines, "GROUP", group)
    r = random.Random(8)
    base = [prose(r, 8)[:40].ljust(34, "q") for _ in range(6)]

    def typo(s):
        for _ in range(r.randrange(4)):
            k = r.randrange(len(s))
            s = r.choice([s[:k] + s[k + 1 :], s[:k] + r.choice("xyzé") + s[k:], s[:k] + r.choice("xyz") + s[k + 1 :]])
        return s

    data = [(i, "\n".join([typo(r.choice(base)) for _ in range(r.randint(1, 4))] + ["short", prose(r, 12)]), "k") for i in range(60)]
    data += [(100, None, "k"), (101, "", "k"), (None, base[0], "k"), data[5]]
    out = lines.dedup_lines(spark.createDataFrame(data, "doc_id long, text string, ld_lines string").repartition(3))
    places = [(d, k, x) for d, t, _ in data[:60] for k, x in enumerate(t.split("\n")) if len(x) >= 32]
    names = sorted({p[2] for p in places})
    f = common.Forest(len(names))
    for i, j in itertools.combinations(range(len(names)), 2):
        if abs(len(names[i]) - len(names[j])) <= 2 and distance(names[i], names[j]) <= 2:
            f.union(i, j)
    cls = {x: f.find(i) for i, x in enumerate(names)}
    first = {}
    for d, k, x in sorted(places):
        first.setdefault(cls[x], (d, k))
    want = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if len(x) < 32 or first[cls[x]] == (d, k)) for d, t, _ in data[:60]}
    got = [(x["doc_id"], x["text"]) for x in out.collect()]
    assert sorted(g for g in got if g[0] is not None and g[0] < 100) == sorted([*want.items(), (5, want[5])])
    assert {g for g in got if g[0] is None or g[0] >= 100} == {(100, None), (101, ""), (None, base[0])}
    assert lines.dedup_lines(empty).count() == 0


def test_short_lines(spark, tmp_path):
    """Short lines with a word stay at their first place only, in op10 and the pipeline's stage; near ones and blank ones stay."""
    r = random.Random(9)
    data = [(i, f"All rights reserved.\n{prose(r, 12)}\n \n\nVersion {i}" + "\nAll rights reserved." * (i % 3 == 1), "en", "s", 0) for i in range(12)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if x != "All rights reserved." or (i, k) == (0, 0)) for i, t, *_ in data}
    assert {x["doc_id"]: x["text"] for x in lines.dedup_lines(docs, short=True).collect()} == want
    assert {x["doc_id"]: x["text"] for x in corpus_pipeline.drop_boilerplate(spark, docs, "").collect()} == want
    docs.write.parquet(str(tmp_path / "sf/documents.parquet"))
    got = {x["doc_id"]: (x["n_lines"], x["n_linked"], x["n_removed"], x["text_sha256"]) for x in lines.op10_line_dedup(spark, str(tmp_path / "sf")).collect()}
    n = {i: t.count("All rights") for i, t, *_ in data}
    assert got == {i: (2 + n[i], n[i], n[i] - (i == 0), hashlib.sha256(t.encode()).hexdigest()) for i, t in want.items()}


def test_stage_drops_lines_of_two_documents(spark):
    """Unlike documents share one line: it stays in the first. An exact copy of a document goes whole."""
    r = random.Random(10)
    shared, texts = prose(r, 15), [prose(r, 40) for _ in range(4)]
    data = [(0, f"{shared}\n{texts[0]}"), (1, f"{texts[1]}\n{shared}"), (2, f"{texts[2]}\n{texts[3]}"), (3, f"{texts[2]}\n{texts[3]}")]
    docs = spark.createDataFrame([(*d, "en", "s", 0) for d in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x["doc_id"]: (x["text"], x["n_chars"]) for x in corpus_pipeline.drop_boilerplate(spark, docs, "").collect()}
    assert got == {i: (t, len(t)) for i, t in ((0, data[0][1]), (1, texts[1]), (2, data[2][1]))}


def test_pipeline(spark, rows, tmp_path):
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "sf/documents.parquet"))
    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        before = stage.collect()
        stage = common.materialise(f(spark, stage, str(tmp_path / "sf")), name)
        after = stage.collect()
        assert stage.columns == docs.columns
        if name == "language":
            # One letter 20,000 times and the one text in another script are like no profile.
            strange = {r[0] for r in rows if r[1] and (r[1].startswith("xxxx") or "日" in r[1])}
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or "")} - strange
        if name == "near_duplicates":
            named = [r for r in before if r["doc_id"] is not None]
            ids = [r["doc_id"] for r in named]
            heads = {min(ids[i] for i in g) for g in _groups(linked([shingles(r["text"], 5) for r in named], 80), ids)}
            assert sorted(r["doc_id"] for r in after if r["doc_id"] is not None) == sorted(heads)
    assert corpus_pipeline.run(spark, str(tmp_path / "sf")).agg(F.sum("length")).first()[0] > 0


def _groups(leads, ids):
    """Positions of one component, where positions of one id are joined too."""
    by = collections.defaultdict(list)
    for i, c in enumerate(leads):
        by[c].append(i)
    return by.values()
