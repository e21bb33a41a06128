"""Rows of a stream in order of their times: each waits until the watermark passes it.

The watermark is the latest time seen less the lateness. A row is due when its moment (its time, or the end
of the minute it belongs to) is at or before the watermark; a row that arrives when its moment has
already passed is late and put aside, counted exactly. State is a folder per batch: what waits, the
watermark, and the late rows. A batch reads the folders of the last batch before it and replaces its own,
so a replayed batch changes nothing. What waits is bounded by the lateness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.functions import clock
from eventide.sources.tables import KeyedTable


class InOrder:
    """``ts`` names the time column; ``due`` gives the moment in microseconds (default: the time itself)."""

    def __init__(self, spark: SparkSession, path: str, ts: str = "ts", lateness: int = 0, due: Column | None = None):
        self.spark, self.path, self.ts, self.lateness = spark, path, ts, lateness
        self.due = clock.micros(F.col(ts)) if due is None else due
        self.marks = KeyedTable(spark, f"{path}/marks", ["batch"])
        self.late_rows = KeyedTable(spark, f"{path}/late", [])

    def _state(self, before: int) -> tuple[int | None, int | None]:
        """Number and watermark of the last batch."""
        held = self.marks.read(before)
        last = held and held.orderBy(F.col("batch").desc()).select("batch", "mark").first()
        return (last.batch, last.mark) if last else (None, None)

    def _waiting(self, batch: int, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/waiting/batch={batch}")

    def step(self, rows: DataFrame, batch: int) -> DataFrame:
        """The rows that this batch makes due, late ones left out."""
        last, mark = self._state(batch)
        self.marks._write(rows.agg(F.greatest(F.max(clock.micros(F.col(self.ts))) - self.lateness * 1_000_000, F.lit(mark).cast("long")).alias("mark")), batch)
        new = self._state(batch + 1)[1]
        late = F.lit(False) if mark is None else F.coalesce(self.due <= mark, F.lit(False))
        self.late_rows._write(rows.filter(late), batch)
        every = rows.filter(~late)
        if last is not None:
            every = every.unionByName(self._waiting(last, rows))
        due = F.lit(False) if new is None else F.coalesce(self.due <= new, F.lit(False))
        every.filter(~due).write.mode("overwrite").parquet(f"{self.path}/waiting/batch={batch}")
        return every.filter(due)

    def rest(self, like: DataFrame) -> DataFrame:
        """What still waits after the last batch: for the end of a session. Rows without a time are among it."""
        last, _ = self._state(1 << 62)
        return like.limit(0) if last is None else self._waiting(last, like)

    def late(self) -> DataFrame | None:
        return self.late_rows.read()
