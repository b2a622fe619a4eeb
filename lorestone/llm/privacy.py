"""Information-theoretic sanitisation: personal data by pattern, and the terms that give it away by co-occurrence.

DataFrame functions only: patterns run in the JVM, positions come from the lengths of what lies between matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, documents, forget, materialise, split_join

KINDS = ("email", "ip", "card", "phone")
#: Credentials are protected too, beside the kinds that are counted.
PROTECTED = (*KINDS, "secret")
#: A term is held to disclose an entity, or a class of them, from this share of its information on; if at least so many
#: pieces of evidence differ; and if chance would bring as many together with a probability of e**-SURPRISE at most.
DISCLOSURE, SUPPORT, SURPRISE = 0.9, 3, 12.0
#: Candidate terms are sent to every executor up to so many bytes; beyond, words are counted first and then joined.
BROADCAST_BYTES = 8 << 20
#: Up to so many told terms, each text is held against all of them where it is read; beyond, words are joined to them.
AT_HAND = 2000
#: Code points on either side of a value that make its context, and minwise words that make a text's print.
CONTEXT, PRINTS = 30, 4
#: Documents for each piece of evidence, at most.
COPIES = 4
_LOCAL, _OCTET = r"A-Za-z0-9._%+-", r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: Each finds what the plain pattern finds. Repeats that can't give way are possessive, and a match begins at a run's
#: start or where the last one ended, so that long runs cost no more than their length and no recursion.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # What a name of credentials is set to, if it holds a digit; and forms that issuers of keys have published.
    "secret": r"""(?i:(?<![A-Za-z])(?:pass(?:word|wd|phrase)|pwd|secret|token|(?:api|access|private|auth)[_-]?key)["']?[\x20]{0,2}[=:][\x20]{0,2}["']?(?=[^\s"',;]{0,200}[0-9])[^\s"',;]{8,})"""
    r"""|(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,})(?![A-Za-z0-9])""",
}
#: Names that the pattern of credentials asks for: a word that holds one stands with that kind by the pattern alone.
ASKED = r"(?i)pass(?:word|wd|phrase)|pwd|secret|token|(?:api|access|private|auth)[_-]?key"
#: What a text must hold for a kind to be looked for.
_NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "secret": r"""[=:][\x20]{0,2}["']?[^\s"',;]{8}|AKIA|ASIA|gh[pousr]_|xox|sk-"""}
_SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def spans(text: Column, pattern: Column, kind: str) -> Column:
    """All matches as structs (kind, start, end, value), in code points, end exclusive, in order of start."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, pattern, -1)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.length(x))

    def place(m, i):
        start = total(F.slice(between, 1, i + 1)) + total(F.slice(found, 1, i))
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"))

    return F.transform(found, place)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def step(total, i):
        d = digits.substr(n - i, F.lit(1)).cast("int")
        doubled = d * 2
        return total + F.when(i % 2 == 1, F.when(doubled > 9, doubled - 9).otherwise(doubled)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z")
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _holds(kind: str):
    return lambda s: _valid(kind, s["value"])


def _is(kind: str):
    return lambda s: s["kind"] == kind


def base_spans(text: Column) -> Column:
    """Matches of every protected kind that hold, by kind as listed, then by start."""
    none = F.array().cast(_SPAN)
    each = [F.when(text.rlike(_NEEDS[k]), F.filter(spans(text, F.lit(PATTERNS[k]), k), _holds(k))).otherwise(none).cast(_SPAN) for k in PROTECTED]
    return F.concat(*each)


def may_match(text: Column) -> Column:
    """Whether a text holds what some kind needs."""
    return text.rlike("|".join(_NEEDS.values()))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def _group(s: Column) -> Column:
    """The class between a value and its kind: an address's domain, a network, an issuer, a place; none for credentials."""
    kind, value = s["kind"], s["value"]
    return (
        F.when(kind == "email", F.lower(F.substring_index(value, "@", -1)))
        .when(kind == "ip", F.substring_index(value, ".", 2))
        .when(kind == "card", F.substring(_digits(value), 1, 6))
        .when(kind == "phone", F.substring(_digits(value), 1, 4))
    )


def _entries(text: Column, s: Column) -> Column:
    """For each span its protected classes, each with what is evidence of it: of a kind or a group the value found, of a
    value its context, so that copies of a passage are one piece of evidence."""
    entry = lambda name, of: F.struct(name.alias("c"), F.xxhash64(of).alias("e"))

    def classes(x):
        start, end = x["start"].cast("int"), x["end"].cast("int")
        before = F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))
        context = F.concat(before, F.lit("\x00"), F.substring(text, end + 1, F.lit(CONTEXT)))
        return F.array(
            entry(x["kind"], x["value"]),
            entry(F.concat_ws(":", x["kind"], F.lit("of"), _group(x)), x["value"]),
            entry(F.concat_ws(":", x["kind"], F.lit("is"), x["value"]), context),
        )

    return F.flatten(F.transform(s, classes))


def information(n_c: Column, n_t: Column, n_ct: Column, total: Column) -> Column:
    """The pointwise mutual information of a term and a class over the class's own information, from the documents that
    hold the class, the term, and both: 1 if the term stands with the class only, 0 or less if it tells nothing."""
    alone = F.log(n_c / total)
    return F.when(alone < 0, 1 - F.log(n_ct / n_t) / alone).otherwise(0.0)


def surprise(n_c: Column, n_t: Column, n_ct: Column, evidence: Column, total: Column) -> Column:
    """How unlikely chance is to bring them together so often, in nats: Chernoff's bound for as many hits as there are
    pieces of evidence, among terms that hit at the rate seen."""
    rate, base = n_ct / n_t, n_c / total
    miss = F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - base))).otherwise(0.0)
    return F.when((rate > base) & (base < 1), evidence / rate * (rate * F.log(rate / base) + miss)).otherwise(0.0)


def term_information(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(class, term, n_c, n_t, n_ct, evidence, total) of the terms that stand with a protected class, by `support` pieces
    of evidence at least, as a written table.

    Classes are each value, its group and its kind. A term is a word with a letter that holds no match itself, and no
    name that a pattern asks for, since that tells of its kind by the pattern alone. Counts are of documents, over all of them. Evidence is what differs: values or contexts, and texts, of which near copies share
    most of their minwise words. It is counted as set bits of 64 by its hash, a lower bound that partitions combine like a
    sum, so no group of equal terms or classes meets in one task as it is. Where there are more than COPIES documents for
    each piece of it, up to 32, they are copies for the most part and tell nothing."""
    text = F.col("text")
    hits = docs.where(may_match(text)).select(text, base_spans(text).alias("s")).where(F.size("s") > 0)
    hits = hits.select(F.monotonically_increasing_id().alias("row"), _entries(text, F.col("s")).alias("entries"), _words(text).alias("terms"))
    bit = lambda h: F.expr(f"shiftleft(1L, cast(pmod({h}, 64) as int))")
    prints = [bit(f"array_min(transform(terms, t -> xxhash64(t, {k})))").alias(f"print{k}") for k in range(PRINTS)]
    hits = materialise(hits.select("row", "entries", "terms", *prints), "private-hits")
    each = hits.select("row", F.explode("entries").alias("x")).select("row", F.col("x.c").alias("class"), bit("x.e").alias("bits"))
    each = materialise(each.groupBy("row", "class").agg(F.bit_or("bits").alias("bits")), "private-classes")
    known = each.groupBy("class").agg(F.count("*").alias("n_c"), F.bit_count(F.bit_or("bits")).alias("evidence")).where(F.col("evidence") >= support)
    known = materialise(known.select("class", "n_c"), "private-known")
    asked = split_join(each, known, "class", known, "n_c").groupBy("row").agg(F.collect_list(F.struct("class", "n_c", "bits")).alias("classes"))
    texts = [f"print{k}" for k in range(PRINTS)]
    pairs = hits.drop("entries").join(asked, "row").select("classes", *texts, F.explode("terms").alias("term")).select("term", *texts, F.explode("classes").alias("k"))
    # A word that all of them share may be the minwise one of a print, hence not the least of four but the second.
    own, *others = (F.bit_count(F.bit_or(c)) for c in ("k.bits", *texts))
    evidence = F.least(own, F.sort_array(F.array(*others))[1])
    both = pairs.groupBy(F.col("k.class").alias("class"), "term").agg(F.count("*").alias("n_ct"), F.first("k.n_c").alias("n_c"), evidence.alias("evidence"))
    both = both.where((F.col("evidence") >= support) & (F.col("evidence") * COPIES >= F.least("n_ct", F.lit(32))))
    t = F.col("term")
    both = materialise(both.where(t.rlike(r"\p{L}") & ~t.rlike(ASKED) & (F.size(base_spans(t)) == 0)), "private-pairs")
    terms = both.select("term").distinct()
    bytes_ = terms.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    words = docs.select(F.explode(_words(text)).alias("term"))
    if bytes_ <= BROADCAST_BYTES:
        words = words.join(F.broadcast(terms), "term", "left_semi")
    counts = words.groupBy("term").agg(F.count("*").alias("n_t"))
    out = materialise(both.join(counts, "term").withColumn("total", F.lit(docs.count())), "private-terms")
    forget(hits, each, known, both)
    return out


def told_terms(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, least: float = SURPRISE) -> DataFrame:
    """(term): those that give a protected class away, as a written table."""
    found = term_information(docs, support)
    n = [F.col(c) for c in ("n_c", "n_t", "n_ct")]
    share, odds = information(*n, F.col("total")), surprise(*n, F.col("evidence"), F.col("total"))
    told = materialise(found.where((share >= disclosure) & (odds >= least)).select("term").distinct(), "private-told")
    forget(found)
    return told


def _with_terms(docs: DataFrame, told: DataFrame) -> DataFrame:
    """docs with pii_terms: the told terms that each text holds, whether the entity is there or not."""
    if told.limit(AT_HAND + 1).count() <= AT_HAND:
        listed = F.broadcast(told.agg(F.collect_list("term").alias("pii_told")))  # one row, bounded by AT_HAND words
        held = F.when(F.size("pii_told") > 0, F.array_intersect(_words(F.col("text")), F.col("pii_told"))).otherwise(F.array().cast("array<string>"))
        return docs.crossJoin(listed).withColumn("pii_terms", held).drop("pii_told")
    key = F.md5("text").alias("pii_key")
    words = docs.select(key, F.explode(_words(F.col("text"))).alias("term")).join(told, "term", "left_semi")
    terms = words.groupBy("pii_key").agg(F.collect_set("term").alias("pii_terms"))
    return docs.withColumn("pii_key", F.md5("text")).join(terms, "pii_key", "left").drop("pii_key").withColumn("pii_terms", F.coalesce("pii_terms", F.array().cast("array<string>")))


def find_private(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, least: float = SURPRISE, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text, pii): pii holds all spans (kind, start, end, value), the protected kinds as listed, then `term`.

    Null texts are empty; empty texts hold nothing; texts of any length are looked at as a whole; copies and repeated rows
    are treated alike; a null id stays null; other columns, whatever their names, are left out; an empty table gives no
    rows. Where two kinds overlap, both spans stand; spans of one kind don't overlap."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = _with_terms(docs, told_terms(docs, disclosure, support, least))
    edge = r"[^\x20\x09-\x0D]"
    either = F.array_join(F.transform(F.sort_array("pii_terms", asc=False), lambda t: F.regexp_replace(t, r"([\\\[\](){}.*+?^$|])", r"\\$1")), "|")
    pattern = F.concat(F.lit(f"(?<!{edge})(?:"), either, F.lit(f")(?!{edge})"))
    none = F.array().cast(_SPAN)
    term_spans = F.when(F.size("pii_terms") > 0, spans(F.col("text"), pattern, "term")).otherwise(none).cast(_SPAN)
    base = F.when(may_match(F.col("text")), base_spans(F.col("text"))).otherwise(none)
    return out.select("doc_id", "text", F.concat(base, term_spans).alias("pii"))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text) with every span of find_private generalised to its kind, as [EMAIL]; of spans that overlap, the first
    stands for all. Rows, nulls, ids and other columns are as there: null and empty texts are empty, repeated rows stay,
    an empty table gives no rows."""
    found = find_private(docs, **options)
    order = F.sort_array(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = F.col("text")
    cut = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, s):
        new = F.concat(acc["out"], cut(acc["at"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate(order, start, step, lambda acc: F.concat(acc["out"], cut(acc["at"], F.length(text).cast("long"))))
    return found.select("doc_id", done.alias("text"))


def _listed(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op9_disclosure(spark, sf_dir):
    found = find_private(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(*KINDS))
    counts = [F.size(F.filter("pii", _is(k))).cast("long").alias(f"n_{k}") for k in (*PROTECTED, "term")]
    n_spans = F.size("pii").cast("long").alias("n_spans")
    return found.select("doc_id", *counts, n_spans, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"))
