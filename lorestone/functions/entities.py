"""Recognition and canonical form of entities in text."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import trim

#: The shapes that are recognised, and the most candidates kept of one content.
TECHNIQUE = r"^[Tt][0-9]{4}(\.[0-9]{3})?\z"
HASH = r"^([0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|[0-9a-fA-F]{128})\z"
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}\z"
_LABEL = r"[a-z0-9]([a-z0-9-]*[a-z0-9])?"
DOMAIN = rf"^{_LABEL}(\.{_LABEL})+\z"
TOKEN = r"[A-Za-z0-9.:-]+"
MOST = 32


@F.pandas_udf(StringType())
def canonical_ipv6(raw: pd.Series) -> pd.Series:
    """Canonical text of IPv6 addresses; of those that map an IPv4 address, that. Zones are no addresses."""

    def one(x):
        if x is None or "%" in x:
            return None
        try:
            ip = ipaddress.IPv6Address(x)
        except ValueError:
            return None
        return str(ip.ipv4_mapped or ip)

    return raw.map(one)


def normalize_native(raw: Column) -> Column:
    """struct(type, key) of all shapes but IPv6, or null. The first shape that fits wins."""
    t = trim(raw)
    domain = F.regexp_replace(F.lower(t), r"\.\z", "")
    pair = lambda kind, key: F.struct(F.lit(kind).alias("type"), key.alias("key"))
    return (
        F.when(t.rlike(TECHNIQUE), pair("technique", F.upper(t)))
        .when(t.rlike(HASH), pair("ioc_hash", F.lower(t)))
        .when(t.rlike(IPV4), pair("ioc_ip", t))
        .when(domain.rlike(DOMAIN) & F.element_at(F.split(domain, r"\."), -1).rlike("[a-z]"), pair("ioc_domain", domain))
    )


def normalize(raw: Column, ipv6: bool = True) -> Column:
    """struct(type, key) of a raw name, or null. Only names with two colons are sent to Python, for IPv6."""
    native = normalize_native(raw)
    if not ipv6:
        return native
    t = trim(raw)
    six = canonical_ipv6(F.when(t.rlike(":.*:"), t))
    return F.coalesce(native, F.when(six.isNotNull(), F.struct(F.lit("ioc_ip").alias("type"), six.alias("key"))))


def named_requests(requests: DataFrame) -> DataFrame:
    """(query_id, caller, entity_type, key) of requests (query_id, caller, key, type), by what their keys are in canonical
    form; a key that is no entity, or not of the type that is asked for, goes.

    A request is a few bytes and much work, so all may lie in one file: they are dealt over tasks first. A filter on a
    generated column stays above it, so each key is normalised once, not for each mention."""
    dealt = requests.repartition("query_id", "key")
    named = dealt.select("query_id", "caller", "type", F.explode(F.array(normalize(F.col("key")))).alias("n"))
    named = named.where(F.col("n.type") == F.coalesce("type", F.col("n.type")))
    return named.select("query_id", "caller", F.col("n.type").alias("entity_type"), F.col("n.key").alias("key"))


def strip_port(token: Column) -> Column:
    """The host of host:port, if it is an entity; else the token."""
    host = F.substring_index(token, ":", 1)
    return F.when(token.rlike(r"^[^:]+:[0-9]+\z") & normalize_native(host).isNotNull(), host).otherwise(token)


#: What any recognised shape holds: an inner dot, two colons, or the beginnings of the other two.
MAY_BE = r"\.[A-Za-z0-9]|:.*:|^[Tt][0-9]{4}|^[0-9a-fA-F]{32}"


def raw_tokens(content: Column) -> Column:
    """Tokens that may be entities, in order of first appearance, ports stripped, each once."""
    tokens = F.filter(F.regexp_extract_all(content, F.lit(TOKEN), F.lit(0)), lambda t: t.rlike(MAY_BE))
    return F.array_distinct(F.transform(F.array_distinct(tokens), strip_port))


def entity_candidates(df: DataFrame, key: str, content: str = "content", most: int = MOST, ipv6: bool = True) -> DataFrame:
    """(key, pos, raw, type, entity_key): the first `most` entities of each content, pos counting from 1.

    Few tokens may be entities at all; only those leave their row, and those that are go on to be numbered."""
    tokens = df.select(key, raw_tokens(F.col(content)).alias("raws")).where(F.size("raws") > 0).select(key, F.posexplode("raws").alias("at", "raw"))
    named = tokens.withColumn("n", normalize(F.col("raw"), ipv6)).where("n is not null")
    pos = F.row_number().over(Window.partitionBy(key).orderBy("at"))
    return named.select(key, pos.alias("pos"), "raw", F.col("n.type").alias("type"), F.col("n.key").alias("entity_key")).where(F.col("pos") <= most)
