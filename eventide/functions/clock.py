"""The one place that knows how wall-clock times become numbers.

Bars carry zone-less exchange-local times (``timestamp_ntz``). Joins and windows use a
half-minute *axis*: a bar at minute ``m`` sits at ``2m``; an event sits at ``2m`` when it
falls exactly on a minute and at ``2m + 1`` when it falls inside one. Every "at or
before", "before", "at or after" and "within k minutes" question about minute bars
then is a constant integer range on that axis.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE_US = 60_000_000
EXCHANGE_ZONE = "Asia/Kolkata"


# Minutes from the first day of year 1, where the calendar begins, to 1970.
MINUTES_TO_1970 = 719_162 * 1_440


def since_year_one(ts: Column) -> Column:
    """Interval from the first wall-clock value, never negative.

    It names its argument once and knows no zone; a cast to an instant would go through the session's zone,
    where an hour is missing or doubled twice a year.
    """
    return ts.cast("timestamp_ntz") - F.expr("timestamp_ntz'0001-01-01 00:00:00'")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of the wall-clock value, whatever the session's zone."""
    return minute_no(ts) * MINUTE_US + (F.extract(F.lit("SECOND"), since_year_one(ts)) * 1_000_000).cast("long")


def minute_no(ts: Column) -> Column:
    """Whole minutes since 1970, downward."""
    return since_year_one(ts).cast("interval minute").cast("long") - F.lit(MINUTES_TO_1970)


def minute_ts(minute: Column) -> Column:
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(mins=minute.cast("int"))


def floor_minute(ts: Column) -> Column:
    return minute_ts(minute_no(ts))


def axis(ts: Column) -> Column:
    """Position on the half-minute axis."""
    inside = F.extract(F.lit("SECOND"), since_year_one(ts)) != 0
    return minute_no(ts) * 2 + inside.cast("long")


def second_of_day(ts: Column) -> Column:
    """Seconds since midnight, fraction kept."""
    return F.pmod(micros(ts), F.lit(86_400_000_000)) / F.lit(1_000_000.0)


def order_key(ts: Column, seq: Column | None = None) -> Column:
    """One primitive, total order: time, then arrival number.

    A struct would order the same way but forces sort-based aggregation; a 38-digit
    decimal keeps ``min_by``/``max_by`` in hash aggregation.
    """
    if seq is None:
        return micros(ts)
    shift = F.expr("cast(1e19 as decimal(20,0))")
    return (micros(ts).cast("decimal(18,0)") * shift + seq.cast("decimal(19,0)")).cast("decimal(38,0)")


def shift_minutes(ts: Column, minutes: int) -> Column:
    return (ts + F.make_dt_interval(mins=F.lit(minutes))).cast("timestamp_ntz")


def clock_seconds(text: str) -> int:
    """``'09:15'`` or ``'09:15:30'`` to seconds since midnight (for parameters)."""
    parts = [int(p) for p in text.split(":")] + [0, 0]
    return parts[0] * 3600 + parts[1] * 60 + parts[2]
