"""Facts that a model proposes in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schemas import PROPOSALS
from .entities import normalize_native
from .scores import clamp_confidence
from .text import trim

PREDICATE = r"^[a-z][a-z0-9_]{0,40}\z"
OBJECT_BYTES, MOST = 500, 20


def parse_proposals(text: Column) -> Column:
    """The JSON array in a model's text: fences and thinking go, then first [ to last ]; empty if there is none, null if
    it doesn't parse."""
    t = F.regexp_replace(text, r"(?s)```[a-zA-Z]*\s*|```", "")
    t = F.regexp_replace(t, r"(?s)<think>.*?</think>", "")
    t = F.regexp_replace(t, r"(?s)<think>.*\z", "")
    found = F.regexp_extract(t, r"(?s)(\[.*\])", 1)
    return F.when(found == "", F.array().cast(PROPOSALS)).otherwise(F.from_json(found, PROPOSALS))


def sanitize_proposals(items: Column, most: int = MOST) -> Column:
    """The first valid ones: a subject that normalises, a predicate of the allowed shape, a bounded object; fields
    trimmed, confidence clamped."""
    clean = F.transform(
        items,
        lambda p: F.struct(
            normalize_native(p["subject"])["key"].alias("subject"),
            trim(p["predicate"]).alias("predicate"),
            trim(p["object_value"]).alias("object_value"),
            clamp_confidence(F.coalesce(p["confidence"], F.lit(0.0))).alias("confidence"),
        ),
    )
    fine = lambda p: p["subject"].isNotNull() & p["predicate"].rlike(PREDICATE) & (F.octet_length(p["object_value"]) > 0) & (F.octet_length(p["object_value"]) <= OBJECT_BYTES)
    return F.slice(F.filter(clean, fine), 1, most)
