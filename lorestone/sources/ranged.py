"""Tables laid out by ranges of a key: who knows which keys it asks for reads their files alone."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import forget, materialise

#: Ranges that a table may have: their bounds go to the driver and into expressions.
PARTS = 4_096
#: Ranges that a reader's filter names one by one; more are left to a filter on the key.
LISTED = 1_000
#: Rows that a range holds, and a task sorts, at most, as long as PARTS allows.
PART_ROWS = 2_000_000


@dataclass(frozen=True)
class Part:
    """A range: its number, its least key, and the greatest that it held when it was made."""

    part: int
    low: tuple
    high: tuple


class RangedTable:
    """Rows under `path`, in one folder for each batch and range. Within a range rows are sorted by the key.

    The first batch sets the ranges, which hold about as many rows each, whatever a single key has of them. Later batches
    are dealt to these; of a table that `grows`, such as a log by time, rows beyond all that was there make ranges of
    their own. A batch is written as a whole under its number, so writing it again changes nothing."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], grows: bool = False):
        self.spark, self.path, self.key, self.grows = spark, path.rstrip("/"), key, grows

    def exists(self) -> bool:
        return self._exists("schema")

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def ranges(self, but: int | None = None) -> list[Part]:
        """All ranges in order, those that batch `but` made left out."""
        if not self._exists("ranges"):
            return []
        rows = self.spark.read.parquet(f"{self.path}/ranges")
        rows = rows if but is None else rows.where(F.col("batch") != but)
        found = [Part(r["part"], tuple(r["low"]), tuple(r["high"])) for r in rows.limit(PARTS + 1).collect()]
        if len(found) > PARTS:
            raise ValueError(f"more than {PARTS} ranges: lay the table out anew with fewer")
        return sorted(found, key=lambda p: p.low)

    def _struct(self) -> Column:
        return F.struct(*self.key)

    def _literal(self, df: DataFrame, key: tuple) -> Column:
        kinds = dict(df.dtypes)
        return F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(self.key, key)])

    def write(self, rows: DataFrame, batch: int = 0, parts: int = 8) -> None:
        """A batch of rows, in place of what was written under its number before. `parts`: the ranges that it makes; it
        makes more if they would hold over PART_ROWS rows each. The rows are written first, so that they are computed
        once, counted, and dealt to tasks by their number."""
        rows = materialise(rows, "ranged-rows")
        known = self.ranges(but=batch)
        first = max((p.part for p in known), default=-1) + 1
        if not known:
            laid = self._lay(rows, parts, first, PARTS // 2)
        elif self.grows:
            top = self._literal(rows, max(p.high for p in known))
            beyond = self._struct() > top
            laid = self._dealt(rows.where(~beyond), known).unionByName(self._lay(rows.where(beyond), parts, first, (PARTS - len(known)) // 2))
        else:
            laid = self._dealt(rows, known)
        if not self.exists():
            rows.limit(0).write.mode("overwrite").parquet(f"{self.path}/schema")
        folder = f"{self.path}/rows/batch={batch}"
        laid.write.mode("overwrite").partitionBy("part").parquet(folder)
        if not known or self.grows:
            made = self.spark.read.schema(laid.schema).parquet(folder).where(F.col("part") >= first)
            made = made.groupBy("part").agg(F.min(self._struct()).alias("low"), F.max(self._struct()).alias("high"))
            made.write.mode("overwrite").parquet(f"{self.path}/ranges/batch={batch}")
        forget(rows)

    def _lay(self, rows: DataFrame, parts: int, first: int, most: int) -> DataFrame:
        parts = max(parts, min(-(-rows.count() // PART_ROWS), most))
        laid = rows.repartitionByRange(parts, *self.key).withColumn("part", F.spark_partition_id() + first)
        return laid.sortWithinPartitions("part", *self.key)

    def _dealt(self, rows: DataFrame, known: list[Part]) -> DataFrame:
        """rows with the last range whose least key isn't beyond theirs; keys before all ranges go to the first. Ranges are
        looked up by runs of them, so that a row meets a few and not all. Many rows are dealt to tasks by their own keys,
        so a range may get several files, each sorted."""
        one = lambda p: F.struct(F.lit(p.part).alias("part"), self._literal(rows, p.low).alias("low"))
        run = math.isqrt(len(known))
        runs = F.array(*[F.struct(self._literal(rows, known[i].low).alias("low"), F.array(*[one(p) for p in known[i : i + run]]).alias("parts")) for i in range(0, len(known), run)])
        last = lambda listed: F.try_element_at(F.filter(listed, lambda p: p["low"] <= self._struct()), F.lit(-1))
        part = F.coalesce(last(last(runs)["parts"])["part"], F.lit(known[0].part))
        tasks = -(-rows.count() // PART_ROWS)
        dealt = rows.repartitionByRange(tasks, *self.key).withColumn("part", part) if tasks > 1 else rows.withColumn("part", part).repartition("part")
        return dealt.sortWithinPartitions("part", *self.key)

    def read(self) -> DataFrame:
        """All rows, with `batch` and `part`."""
        schema = self.spark.read.parquet(f"{self.path}/schema").schema.add("batch", "integer").add("part", "integer")
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    def among(self, values: list) -> DataFrame:
        """The rows whose first key column has one of these values. The scan opens the files of their ranges alone, and in
        these skips what is out of range."""
        rows, known = self.read(), self.ranges()
        wanted = sorted(set(values))
        name = self.key[0]
        if not wanted or not known:
            return rows.where(F.lit(False))
        parts = {p.part for i, p in enumerate(known) for v in wanted if (i == 0 or p.low[0] <= v) and (i + 1 == len(known) or v <= known[i + 1].low[0])}
        rows = rows.where(F.col("part").isin(*sorted(parts))) if len(parts) <= LISTED else rows
        return rows.where(F.col(name).isin(*wanted)) if len(wanted) <= LISTED else rows.where(F.col(name).between(wanted[0], wanted[-1]))

    def after(self, key: tuple) -> DataFrame:
        """The rows beyond a key, by files of the ranges that may hold some."""
        rows, known = self.read(), self.ranges()
        ends = [p.part for i, p in enumerate(known) if i + 1 == len(known) or known[i + 1].low > key]
        rows = rows.where(F.col("part").isin(*ends)) if len(ends) <= LISTED else rows
        return rows.where(self._struct() > self._literal(rows, key))

    def page(self, key: tuple, size: int) -> DataFrame:
        """The next `size` rows beyond a key, in its order. Ranges are in order too, so that only as many are read as hold
        the page: their sizes were counted where they were written."""
        known = self.ranges()
        ends = [p.part for i, p in enumerate(known) if i + 1 == len(known) or known[i + 1].low > key]
        rows, taken, beyond = self.read(), [], 0
        for i, part in enumerate(ends):
            taken.append(part)
            inner = rows.where(F.col("part") == part)
            inner = inner.where(self._struct() > self._literal(rows, key)) if i == 0 else inner
            beyond += inner.limit(size).count()
            if beyond >= size:
                break
        if not taken:
            return rows.where(F.lit(False))
        return rows.where(F.col("part").isin(*taken)).where(self._struct() > self._literal(rows, key)).orderBy(*self.key).limit(size)
