"""Snapshots of tables: each write is a new immutable directory, and a small pointer table names the current one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.versioned import merge_snapshot


class SnapshotStore:
    """Tables under a root that any of Spark's file systems holds. A reader resolves the pointer once, and so sees one
    consistent snapshot, whatever is written meanwhile."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(p)

    def versions(self, table: str) -> list[str]:
        folder = self._path(f"{self.root}/{table}")
        if not self.fs.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(folder) if s.getPath().getName().startswith("v") and self.fs.exists(self._path(f"{self.root}/{table}/{s.getPath().getName()}/_SUCCESS")))

    def write(self, table: str, df: DataFrame, sort: list[str] | None = None) -> str:
        """The table's next version. Its name sorts after all before it; it counts once Spark has committed it."""
        name = f"v{len(self.versions(table)):012d}-{uuid.uuid4().hex[:8]}"
        (df.sortWithinPartitions(*sort) if sort else df).write.parquet(f"{self.root}/{table}/{name}")
        return name

    def read(self, table: str) -> DataFrame:
        found = self.versions(table)
        if not found:
            raise FileNotFoundError(f"{table} has no version")
        return self.spark.read.parquet(f"{self.root}/{table}/{found[-1]}")

    def append(self, table: str, rows: DataFrame) -> str:
        """A version with these rows after those that are there."""
        return self.write(table, self.read(table).unionByName(rows) if self.versions(table) else rows)

    def merge(self, table: str, delta: DataFrame, key: list[str]) -> str:
        """A version with the rows of the delta in place of those with their keys."""
        return self.write(table, merge_snapshot(self.read(table), delta, key) if self.versions(table) else delta)

    def delete(self, table: str, keys: DataFrame) -> str:
        """A version without the rows that have one of these keys, by all columns that `keys` has."""
        return self.write(table, self.read(table).join(keys.distinct(), keys.columns, "left_anti"))

    def truncate(self, table: str, seed: DataFrame | None = None) -> str:
        """A version with the seed's rows alone, or none: cursors go back to their start that way."""
        return self.write(table, seed if seed is not None else self.read(table).limit(0))

    def swap(self, table: str, key: dict[str, str], before: tuple, after: dict) -> bool:
        """Whether the one row of `key` moved forward from what was read `before` it: compare and set, by one writer. A
        row at or beyond the new values, or one that isn't there as it was read, stays."""
        from pyspark.sql import functions as F

        rows = self.read(table)
        mine = F.lit(True)
        for k, v in key.items():
            mine = mine & (F.col(k) == v)
        now = rows.where(mine).select(*after).first()
        if now is None or tuple(now) != tuple(before) or tuple(now) >= tuple(after.values()):
            return False
        new = rows.where(mine).withColumns({c: F.lit(v).cast(dict(rows.dtypes)[c]) for c, v in after.items()})
        self.write(table, rows.where(~F.coalesce(mine, F.lit(False))).unionByName(new))
        return True
