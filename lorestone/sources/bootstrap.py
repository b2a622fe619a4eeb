"""SQL scripts that set a store up: each runs once, in order of name, and is remembered by its name."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .snapshots import SnapshotStore

_PART = re.compile(
    r"""(?P<space>\s+)
    | (?P<comment>--[^\n]*|/\*.*?(?:\*/|\Z))
    | (?P<quoted>'(?:\\.|''|[^'\\])*(?:'|\Z)|"[^"]*(?:"|\Z)|`[^`]*(?:`|\Z))
    | (?P<end>;)
    | (?P<other>[^\s;'"`/-]+|.)""",
    re.X | re.S,
)


def split_statements(script: str) -> list[str]:
    """Statements between semicolons; those in quotes and comments separate nothing. What holds comments alone is none."""
    out, text, solid = [], [], False
    for m in (*_PART.finditer(script), None):
        if m is None or m.lastgroup == "end":
            if solid:
                out.append("".join(text).strip())
            text, solid = [], False
        elif m.lastgroup != "comment" or m.group().startswith("/*"):
            text.append(m.group())
            solid |= m.lastgroup in ("quoted", "other")
    return out


def migrate(spark: SparkSession, store: SnapshotStore, scripts: dict[str, str]) -> list[str]:
    """Run the scripts that the store doesn't know yet, in order of their names, and say which. Each is remembered once
    all its statements have run, so a script that fails runs again as a whole: statements should bear that."""
    ran = []
    known = {r["name"] for r in store.read("migrations").collect()} if store.versions("migrations") else set()
    for name in sorted(set(scripts) - known):
        for statement in split_statements(scripts[name]):
            spark.sql(statement)
        known.add(name)
        store.write("migrations", spark.createDataFrame([(n,) for n in sorted(known)], "name string"))
        ran.append(name)
    return ran


def ensure_tables(store: SnapshotStore, schemas: dict[str, str]) -> list[str]:
    """Give each table that has no version yet an empty one of its schema; those that do stay as they are."""
    new = [t for t in schemas if not store.versions(t)]
    for t in new:
        store.write(t, empty(store.spark, schemas[t]))
    return new


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
