import pytest
from pyspark.sql import functions as F

from lorestone.functions import entities, proposals, scores, text

HEX = "0123456789abcdef"
CASES = {
    # Domains: case folds, one final dot goes, at least two labels, and a letter in the last.
    "Mail.Lorestone.Test": ("ioc_domain", "mail.lorestone.test"),
    "\tx-1.lorestone.test.\n": ("ioc_domain", "x-1.lorestone.test"),
    "a.b.c.d.e": ("ioc_domain", "a.b.c.d.e"),
    **dict.fromkeys(["lorestone", "-a.test", "a-.test", "a..test", "lorestone.123", "two words.test", "https://lorestone.test", "lorestone.test:443"]),
    # IPv4: four numbers to 255 without leading zeros.
    "10.20.30.255": ("ioc_ip", "10.20.30.255"),
    **dict.fromkeys(["10.20.30.256", "10.20.030.4", "10.20.30", "10.20.30.4.5"]),
    # IPv6: the shortest form; a mapped address is an IPv4 one; zones are none.
    "FE80:0:0:0:0:0:0:A": ("ioc_ip", "fe80::a"),
    "::ffff:10.20.30.40": ("ioc_ip", "10.20.30.40"),
    **dict.fromkeys(["fe80::a%1", "12345::", "a:b"]),
    # Hashes by length, technique ids by shape.
    **{(HEX * 8)[:n].upper(): ("ioc_hash", (HEX * 8)[:n]) for n in (32, 40, 64, 128)},
    **dict.fromkeys([(HEX * 8)[:n] for n in (31, 33, 48)]),
    "t0042": ("technique", "T0042"),
    "T0042.007": ("technique", "T0042.007"),
    **dict.fromkeys(["T042", "T0042.07", "U0042", "T0042\ny", " "]),
}


def test_normalize(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "raw string").select("raw", entities.normalize(F.col("raw")).alias("n"))
    got = {r["raw"]: (r["n"]["type"], r["n"]["key"]) if r["n"] else None for r in df.collect()}
    assert got == CASES


def _numbered(n, first=1):
    return [f"172.16.0.{i}" for i in range(first, first + n)]


@pytest.mark.parametrize(
    ("content", "expected"),
    [
        ("db7.lorestone.test answered 172.16.0.9, then db7.lorestone.test again", ["db7.lorestone.test", "172.16.0.9"]),
        ("ports go: 172.16.0.9:8443, db7.lorestone.test:5432", ["172.16.0.9", "db7.lorestone.test"]),
        ("in brackets [2001:db8:0::7]:22 (and fe80::7)", ["2001:db8::7", "fe80::7"]),
        ("no times like 09:45, ratios like 3:2:1, or ranges like 172.16.0.1-9", []),
        ("The end. Another end.", []),
        ("files look like hosts: setup.tar", ["setup.tar"]),
        ("T0042:80 and " + "0a" * 16 + ":1", ["T0042", "0a" * 16]),
        (" ".join(_numbered(50)), _numbered(32)),
        (" ".join(f"word{i}" for i in range(100)) + " " + " ".join(_numbered(2)), _numbered(2)),
    ],
)
def test_candidates(spark, content, expected):
    df = entities.entity_candidates(spark.createDataFrame([(1, content)], "id int, content string"), "id")
    assert [r["entity_key"] for r in df.orderBy("pos").collect()] == expected


def test_confidence_and_trust(spark):
    df = spark.createDataFrame([(0.42, 0.42), (-0.5, 0.0), (1.7, 1.0), (float("nan"), 0.0)], "c double, e double")
    assert all(r["x"] == r["e"] for r in df.select("e", scores.clamp_confidence(F.col("c")).alias("x")).collect())
    rows = [("human", "x", 0.0, "active"), ("agent", "a", 0.8, "active"), ("agent", "a", 0.79, "proposed"), ("agent", "b", 1.0, "proposed"), ("robot", "a", 1.0, "proposed")]
    df = spark.createDataFrame(rows, "t string, i string, c double, e string")
    assert all(r["x"] == r["e"] for r in df.select("e", scores.trust_status(F.col("t"), F.col("i"), F.col("c"), ["a"]).alias("x")).collect())
    assert [scores.trust_floor(x) for x in (None, -0.5, 1.5, float("nan"), 0.0, 1.0)] == [0.8, 0.8, 0.8, 0.8, 0.0, 1.0]


def test_proposals(spark):
    said = '<think>[x]</think>Sure:\n```json\n[{"subject":" Host.Lorestone.Test ","predicate":"is","object_value":" red ","confidence":1.7},{"subject":"no entity","predicate":"is","object_value":"x"},{"subject":"1.1.1.1","predicate":"Bad","object_value":"x"},{"subject":"1.1.1.1","predicate":"is","object_value":"' + "y" * 501 + '"}]\n```'
    df = spark.createDataFrame([(said,), ("none",), ("[oops]",)], "t string").select(proposals.parse_proposals(F.col("t")).alias("p")).select(proposals.sanitize_proposals(F.col("p")).alias("p"))
    got = [r["p"] for r in df.collect()]
    assert [tuple(x) for x in got[0]] == [("host.lorestone.test", "is", "red", 1.0)]
    assert got[1] == []
    assert not got[2]


def test_text(spark):
    row = spark.range(1).select(
        text.query_tokens(F.lit("The the A-b c_d! 1 2 3 4 5 6 7")).alias("q"),
        text.trim(F.lit("\t  x y \n")).alias("t"),
        text.has_any_token(F.lit("São Paulo ERROR"), F.array(F.lit("error"))).alias("no"),
        text.canonical_uuid(F.lit("{0190A0B0-0000-7000-8000-00000000000F}")).alias("u"),
        text.excerpt(F.lit("é" * 300)).alias("e"),
    ).first()
    assert row["q"] == ["the", "a", "b", "c", "d", "1", "2", "3"]
    assert row["t"] == "x y"
    assert not row["no"]
    assert row["u"] == "0190a0b0-0000-7000-8000-00000000000f"
    assert row["e"] == "é" * 200
