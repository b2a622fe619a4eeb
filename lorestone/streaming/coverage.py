"""Which observations were looked at: a mark below which all were, but for those that came late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialise, small
from ..sources.ranged import RangedTable
from .pipelines import BATCH

KEY = ["ts", "obs_id"]


class Coverage:
    """Observations under a path, laid out by time, and what of them was covered.

    All rows up to the mark (ts, obs_id) are covered, except those of `late`: they came below the mark that was valid when
    they were written, and are few. So the next rows to look at are a page beyond the mark, from the files of its ranges,
    and what is late; their ids alone are looked up among those covered. Marks are kept as a log, each of which lies
    beyond those before it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = RangedTable(spark, f"{self.path}/observations", KEY, grows=True)
        self.covered = RangedTable(spark, f"{self.path}/covered", ["obs_id"])

    def _rows(self, name: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}") if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path) else None

    def mark(self) -> tuple | None:
        marks = self._rows("marks")
        found = marks.agg(F.max(F.struct(*KEY)).alias("m")).first()["m"] if marks is not None else None
        return tuple(found) if found else None

    def add(self, observations: DataFrame, batch: int, parts: int = 8) -> None:
        """Write a batch of observations; the same number again replaces it. Those at or below the mark are late."""
        mark = self.mark()
        if mark:
            key = F.struct(*KEY) <= F.struct(*[F.lit(v).cast(dict(observations.dtypes)[c]) for v, c in zip(mark, KEY)])
            observations.where(key).select(*KEY).write.mode("overwrite").parquet(f"{self.path}/late/batch={batch}")
        self.log.write(observations, batch, parts)

    def _late(self) -> DataFrame | None:
        """Keys of late rows that weren't covered yet."""
        late, done = self._rows("late"), self._rows("late-done")
        if late is None or done is None:
            return late
        return late.join(done.select("obs_id", F.col("batch")), ["obs_id", "batch"], "left_anti")

    def next(self, size: int = BATCH) -> DataFrame:
        """The oldest rows whose ids weren't covered, each id once: late ones, and those beyond the mark. Pages that hold
        nothing but further rows of covered ids are passed over."""
        while True:
            mark, late = self.mark(), self._late()
            page = self.log.page(mark, size) if mark else self.log.read().orderBy(*KEY).limit(size)
            if late is not None:
                page = page.unionByName(self.log.read().join(small(late.select("obs_id", "batch").distinct()), ["obs_id", "batch"], "left_semi").select(*page.columns))
            page = materialise(page.orderBy(*KEY).limit(size), "coverage-page")
            ids = [r["obs_id"] for r in page.select("obs_id").distinct().collect()]  # `size` at most
            rows = page.dropDuplicates(["obs_id"])
            if self.covered.exists():
                rows = rows.join(F.broadcast(self.covered.among(ids).select("obs_id").distinct()), "obs_id", "left_anti").select(*page.columns)
            if not ids or rows.limit(1).count():
                return rows
            self._pass(page)

    def _pass(self, page: DataFrame) -> None:
        mark, late = self.mark(), self._late()
        if late is not None:
            late.join(page.select("obs_id", "batch").distinct(), ["obs_id", "batch"], "left_semi").write.mode("append").parquet(f"{self.path}/late-done")
        last = page.agg(F.max(F.struct(*KEY)).alias("m")).first()["m"]
        if last is not None and (mark is None or tuple(last) > mark):
            page.where((F.col("ts") == last["ts"]) & (F.col("obs_id") == last["obs_id"])).select(*KEY).limit(1).write.mode("append").parquet(f"{self.path}/marks")

    def cover(self, rows: DataFrame, number: int) -> None:
        """Count rows that `next` gave as covered, under a number; the same number again changes nothing more."""
        rows = materialise(rows, "covered")
        self.covered.write(rows.select("obs_id"), number, 4)
        self._pass(rows)
