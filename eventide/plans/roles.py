"""Roles of the driver tables: which columns play ticks, anchors, articles and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators.bars import tick_bars
from eventide.plans import Tables

# The driver data has about 27 minutes between bars of a symbol, so offsets and windows
# are parameters wider than the defaults.
LOOKBACKS = (5, 15, 30, 60, 120)
FORWARDS = (30, 60, 120, 240)
TOLERANCE = 60
REACTION = 60


def symbol():
    return F.pmod(F.col("user_id"), F.lit(5)).alias("symbol")


def ticks(t: Tables) -> DataFrame:
    return t.events.filter(F.col("event_type") != "signup").select(
        "event_id",
        symbol(),
        "ts",
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("int").alias("qty"),
    )


def anchors(t: Tables) -> DataFrame:
    return t.events.filter(F.col("event_type") == "signup").select(
        "event_id", symbol(), "ts", F.to_date("ts").alias("trade_date")
    )


def bars(t: Tables) -> DataFrame:
    return tick_bars(ticks(t), seq="event_id")


TICKS_SQL = """
ticks AS (
  SELECT event_id, user_id % 5 AS symbol, ts, value AS price,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS qty
  FROM events WHERE event_type <> 'signup')"""

BARS_SQL = (
    TICKS_SQL
    + """,
bars AS (
  SELECT symbol, CAST(ts AS DATE) AS trade_date, date_trunc('minute', ts) AS ts,
         first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY ts, event_id) AS close, CAST(sum(qty) AS BIGINT) AS volume,
         count(*) AS n_ticks
  FROM ticks GROUP BY ALL)"""
)

ANCHORS_SQL = """
anchors AS (
  SELECT event_id, user_id % 5 AS symbol, ts, CAST(ts AS DATE) AS trade_date
  FROM events WHERE event_type = 'signup')"""

# ``ts`` inside an aggregate's ORDER BY is the tick time, in GROUP BY ALL the minute.
STUDY_SQL = BARS_SQL + "," + ANCHORS_SQL
