"""The off-hours buffer: rows that arrive while the market is closed wait until it is open again.

Every row has its own time. A row is scored by the first open moment at or after that time, its
own included; rows no open moment has followed yet wait. The outcome therefore does not depend on
how a stream is cut into batches, and one batch may hold both kinds of rows.

State is two tables with a folder per batch: the rows each batch put aside and the last open moment
it saw. A batch reads folders before its own only and replaces its own, so a replayed batch neither
scores twice nor loses what waits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.operators import evaluate, labels, state
from eventide.sources.tables import KeyedTable


def is_open(at: Column) -> Column:
    """The scoring session by the clock, without a calendar."""
    return evaluate.in_clock(at, evaluate.SCORING_OPEN, evaluate.MARKET_CLOSE)


def bias_signals(rows: DataFrame, at: str) -> DataFrame:
    """What is shown of rows that wait: a bias from the sentiment alone."""
    bias = labels.night_bias(F.col("sentiment"), F.col("confidence"))
    shown = F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit(" IST"))
    return rows.withColumns({**bias, "model_version": F.lit("overnight_bias"), "predicted_at": shown, "is_overnight": F.lit(True)})


class OffHours:
    """The buffer of one pipeline. ``at`` names the column with a row's time; a row without one counts as open."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], at: str):
        self.keys, self.at = list(keys), at
        self.waiting = KeyedTable(spark, f"{root}/waiting", keys)
        self.moments = KeyedTable(spark, f"{root}/moments", ["batch"])

    def _last_open(self, before: int | None) -> Column:
        """The last open moment of earlier batches, as a literal: one value, read from one row a batch."""
        seen = self.moments.read(before)
        last = seen and seen.agg(F.max("moment")).first()[0]
        return F.lit(None if last is None else str(last)).cast("timestamp_ntz")

    def pending(self, before: int | None = None) -> DataFrame | None:
        """Rows that wait (before a batch); of one key the last one."""
        held = self.waiting.read(before)
        if held is None:
            return None
        last = self._last_open(before)
        held = state.first_per_key(held, self.keys, [F.col("batch").desc(), F.col(self.at).desc()])
        return held.filter(last.isNull() | (F.col(self.at) > last)).drop("batch")

    def step(self, rows: DataFrame | None, batch: int, seen: DataFrame | None = None) -> DataFrame | None:
        """The rows to score now: those of this batch and those it releases. None if there are neither rows nor a buffer.

        ``seen`` holds the times (column ``at``) of all that arrived, if ``rows`` is only a part of it: rows that
        wait are released by any open moment.
        """
        at = F.col(self.at)
        earlier = self._last_open(batch)
        times = (rows if seen is None else seen).agg(F.max(F.when(is_open(at), at)).alias("moment"))
        self.moments._write(times, batch)
        last = F.greatest(earlier, self._moment(batch))
        pending = self.pending(batch)
        if rows is None:
            return None if pending is None else pending.filter(at <= last)
        waits = F.coalesce(~is_open(at) & (last.isNull() | (at > last)), F.lit(False))
        self.waiting._write(rows.filter(waits), batch)
        ready = rows.filter(~waits)
        if pending is None:
            return ready
        # A key that comes again replaces what waited for it.
        own = rows.select(*self.keys).distinct().alias("k")
        released = pending.filter(at <= last).alias("b").join(own, state.same_keys("b", "k", self.keys), "left_anti")
        return ready.unionByName(released, allowMissingColumns=True)

    def _moment(self, batch: int) -> Column:
        found = self.moments.read().filter(F.col("batch") == batch).select("moment").first()
        return F.lit(None if found is None or found[0] is None else str(found[0])).cast("timestamp_ntz")
