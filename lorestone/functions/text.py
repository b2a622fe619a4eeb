"""Scalar text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole-token index: ASCII characters that are neither letters nor digits separate.
NOT_TOKEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
QUERY_TOKENS = 8
EXCERPT = 200
REASON = 120


def trim(c: Column) -> Column:
    """Without white space, of all of Unicode, at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def content_tokens(c: Column) -> Column:
    """Case-sensitive tokens of a content."""
    return F.split(c, NOT_TOKEN)


def query_tokens(c: Column, most: int = QUERY_TOKENS) -> Column:
    """Lower-case alphanumeric tokens of a query, each once, the first few."""
    return F.slice(F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")), 1, most)


def has_any_token(content: Column, tokens: Column) -> Column:
    return F.coalesce(F.arrays_overlap(content_tokens(content), tokens), F.lit(False))


def excerpt(c: Column, most: int = EXCERPT) -> Column:
    return F.substring(c, 1, most)


def reason(c: Column) -> Column:
    """A retraction's reason, trimmed and cut."""
    return F.substring(trim(c), 1, REASON)


def canonical_uuid(c: Column) -> Column:
    """Lower-case text of an id, from the forms with urn:uuid:, braces or without hyphens too; null if it is none."""
    bare = F.regexp_replace(F.lower(c), r"^urn:uuid:|^\{|\}$", "")
    plain = F.when(bare.rlike(r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z"), bare)
    packed = F.when(bare.rlike(r"^[0-9a-f]{32}\z"), F.regexp_replace(bare, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    return F.coalesce(plain, packed)


def stable_id(*parts: Column) -> Column:
    """An id in the form of a UUID from its parts, the same on each run."""
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]))
    return F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def to_millis(c: Column) -> Column:
    return F.date_trunc("MILLISECOND", c)


def rfc3339(c: Column) -> Column:
    """A time as text, in UTC and to the second, as foreign graphs keep it."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def memory_context(note: str, row: Column) -> Column:
    """A result as JSON in a fenced block with a note."""
    return F.concat(F.lit(f"<memory-context>\n{note}\n"), F.to_json(row), F.lit("\n</memory-context>"))
