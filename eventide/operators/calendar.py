"""Trading days, neighbouring sessions, market status and regime."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide.functions import clock
from eventide.operators.evaluate import MARKET_CLOSE, MARKET_OPEN, SCORING_OPEN, in_clock

# Exchange holidays of 2026.
HOLIDAYS_2026 = (
    "2026-01-15",
    "2026-01-26",
    "2026-03-03",
    "2026-03-26",
    "2026-03-31",
    "2026-04-03",
    "2026-04-14",
    "2026-05-01",
    "2026-05-28",
    "2026-06-26",
    "2026-09-14",
    "2026-10-02",
    "2026-10-20",
    "2026-11-10",
    "2026-11-24",
    "2026-12-25",
)
REACH_DAYS = 30


def calendar_table(
    spark: SparkSession,
    holidays: Sequence[str] = HOLIDAYS_2026,
    start: str = "1990-01-01",
    end: str = "2060-12-31",
    reach: int = REACH_DAYS,
) -> DataFrame:
    """One row per day: is_trading, reason, prev_session, next_session (null when further than ``reach``).

    The table grows with the calendar only (a century has 36,525 rows), which is why its
    one window may run unpartitioned, and Spark knows its size from the start: a join to
    it is broadcast by size, without shuffling the events by date.
    """
    first, last = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    day = F.date_add(F.lit(first), F.col("id").cast("int"))
    rows = spark.range((last - first).days + 1).select(day.alias("d"))
    closed = F.date_format("d", "yyyy-MM-dd").isin(*holidays) if holidays else F.lit(False)
    weekend = F.weekday("d") >= 5
    line = W.orderBy("d")
    open_day = F.when(F.col("is_trading"), F.col("d"))
    before = F.max(open_day).over(line.rowsBetween(-reach, -1))
    after = F.min(open_day).over(line.rowsBetween(1, reach))
    reason = (
        F.when(weekend, F.format_string("Weekend (%s)", F.date_format("d", "EEEE")))
        .when(closed, F.format_string("NSE Holiday (%s)", F.date_format("d", "yyyy-MM-dd")))
        .otherwise("Trading Day")
    )
    return rows.select("d", (~weekend & ~closed).alias("is_trading"), reason.alias("reason")).withColumns(
        {"prev_session": before, "next_session": after}
    )


def day_columns(day: Column, holidays: Sequence[str] = HOLIDAYS_2026, reach: int = REACH_DAYS) -> dict[str, Column]:
    """The calendar columns of any date, computed in the row."""

    def opens(d: Column) -> Column:
        closed = F.date_format(d, "yyyy-MM-dd").isin(*holidays) if holidays else F.lit(False)
        return (F.weekday(d) < 5) & ~closed

    def nearest(sign: int) -> Column:
        days = F.transform(F.sequence(F.lit(1), F.lit(reach)), lambda i: F.date_add(day, i * sign))
        return F.get(F.filter(days, opens), F.lit(0))

    reason = (
        F.when(F.weekday(day) >= 5, F.format_string("Weekend (%s)", F.date_format(day, "EEEE")))
        .when(~opens(day), F.format_string("NSE Holiday (%s)", F.date_format(day, "yyyy-MM-dd")))
        .when(day.isNotNull(), "Trading Day")
    )
    return {"is_trading": opens(day), "reason": reason, "prev_session": nearest(-1), "next_session": nearest(1)}


def with_sessions(
    df: DataFrame, table: DataFrame, date: str = "event_date", holidays: Sequence[str] = HOLIDAYS_2026, reach: int = REACH_DAYS
) -> DataFrame:
    """Add the calendar columns for a date column; dates outside the table are computed."""
    joined = df.join(table.withColumnRenamed("d", date), date, "left")
    inside = F.col("reason").isNotNull()
    own = day_columns(F.col(date), holidays, reach)
    return joined.withColumns({c: F.when(inside, F.col(c)).otherwise(v) for c, v in own.items()})


def market_status(ts: Column, is_trading: Column, reason: Column) -> Column:
    """The reason why the market is open or closed at an exchange-local time."""
    sec = clock.second_of_day(ts)
    return (
        F.when(~is_trading, reason)
        .when(sec < clock.clock_seconds(MARKET_OPEN), "Before Market Open")
        .when(sec > clock.clock_seconds(MARKET_CLOSE), "After Market Close")
        .otherwise("Market Hours")
    )


def regime(ts: Column, is_trading: Column) -> Column:
    """intraday, after_market, or weekend_holiday (also before the open and without a time)."""
    sec = clock.second_of_day(ts)
    return (
        F.when(ts.isNull() | ~F.coalesce(is_trading, F.lit(False)), "weekend_holiday")
        .when(in_clock(ts), "intraday")
        .when(sec > clock.clock_seconds(MARKET_CLOSE), "after_market")
        .otherwise("weekend_holiday")
    )


def scoring_open(ts: Column) -> Column:
    """Clock gate of the scoring step; it starts later than the market and ignores the calendar."""
    return in_clock(ts, SCORING_OPEN, MARKET_CLOSE)
