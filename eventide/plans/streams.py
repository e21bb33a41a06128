"""Streaming queries: ``availableNow`` runs over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventide.functions import clock, timeparse
from eventide.plans import Tables, query
from eventide.plans.market import HV_SQL
from eventide.plans.roles import BARS_SQL, TICKS_SQL, symbol
from eventide.plans.study import PAIRS_SQL
from eventide.session import scratch
from eventide.sources.tables import KeySet
from eventide.streaming import jobs
from eventide.streaming.offhours import OffHours, bias_signals


SLICES = 3


def arriving(t: Tables, name: str, order: Column, run: Callable[[DataFrame], StreamingQuery], slices: int = SLICES) -> None:
    """Let a table arrive in slices of ``order``, cut at approximate quantiles."""
    together(t, {name: getattr(t, name)}, order, lambda streams: run(streams[name]), slices)


def in_parts(t: Tables, rows: DataFrame, part: Column, parts: int, run: Callable[[DataFrame], StreamingQuery]) -> None:
    """Let rows arrive by the number ``part``: each part is stored and met by a run that goes on from the last one.

    Every part is at least one micro-batch.
    """
    path = scratch(t.spark, "arriving")
    for i in range(parts):
        rows.filter(part == i).write.parquet(f"{path}/{i}")
        run(t.spark.readStream.schema(rows.schema).parquet(f"{path}/*")).awaitTermination()


def together(t: Tables, tables: dict[str, DataFrame], order: Column, run: Callable[[dict[str, DataFrame]], StreamingQuery], slices: int = SLICES) -> None:
    """Let several tables arrive side by side, each in slices of its own ``order``."""
    path = scratch(t.spark, "arriving")
    shares = [i / slices for i in range(1, slices)]
    parts = {}
    for name, rows in tables.items():
        cuts = rows.agg(F.percentile_approx(order, F.array(*[F.lit(s) for s in shares]))).first()[0] or []
        parts[name] = sum((F.coalesce((order > c).cast("int"), F.lit(0)) for c in cuts), F.lit(0))
    for i in range(slices):
        for name, rows in tables.items():
            rows.filter(parts[name] == i).write.parquet(f"{path}/{name}/{i}")
        run({name: t.spark.readStream.schema(rows.schema).parquet(f"{path}/{name}/*") for name, rows in tables.items()}).awaitTermination()


def ticks_of(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type") != "signup").select(
        "event_id",
        symbol(),
        "ts",
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("int").alias("qty"),
    )


@query(f"WITH {BARS_SQL} SELECT * FROM bars")
def stream_bars(t: Tables) -> DataFrame:
    """Candles closed by the watermark of two micro-batches, and the open ones flushed at the end."""
    path = scratch(t.spark, "candles")

    def run(events: DataFrame) -> StreamingQuery:
        return jobs.run_available(jobs.candles(ticks_of(events), seq="event_id"), f"{path}/out", f"{path}/log")

    arriving(t, "events", clock.micros(F.col("ts")), run, slices=2)
    return t.spark.read.parquet(f"{path}/out").unionByName(jobs.open_candles(ticks_of(t.events), seq="event_id"))


@query("SELECT md5(text) AS text_id, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def stream_dedup(t: Tables) -> DataFrame:
    """First document of every text across micro-batches; a batch reads the stored keys of its own hash prefixes."""
    path = scratch(t.spark, "dedup")
    known = KeySet(t.spark, f"{path}/keys", ["text_id"], prefixes=16)

    def run(docs: DataFrame) -> StreamingQuery:
        rows = docs.select("doc_id", F.md5("text").alias("text_id"))
        return jobs.run_batches(rows, jobs.dedup_by_prefix(known, f"{path}/out", ["doc_id"]), f"{path}/log")

    arriving(t, "documents", F.col("doc_id"), run)
    return t.spark.read.parquet(f"{path}/out").select("text_id", "doc_id")


@query(f"WITH {HV_SQL} SELECT event_id, symbol, trade_date, round(hv, 4) AS hv FROM hvs")
def stream_hv_state(t: Tables) -> DataFrame:
    """Rolling volatility carried across micro-batches; each tick arrives up to a day late, out of order."""
    path = scratch(t.spark, "hv")
    day = 86_400
    hv = jobs.HvStream(t.spark, path, lateness=day)

    def run(events: DataFrame) -> StreamingQuery:
        rows = ticks_of(events).withColumn("trade_date", F.to_date("ts"))
        return jobs.run_batches(rows, hv.step, f"{path}/log")

    delay = F.pmod(F.xxhash64("event_id"), F.lit(day)) * 1_000_000
    arriving(t, "events", clock.micros(F.col("ts")) + delay, run)
    hv.flush(ticks_of(t.events).withColumn("trade_date", F.to_date("ts")), SLICES)
    done = t.spark.read.parquet(f"{path}/hv")
    return done.select("event_id", "symbol", "trade_date", F.round("hv", 4).alias("hv"))


# Every seventh tick comes three days after its time; slices are thirds of the time of arrival.
DELAY_US = 3 * 86_400_000_000


@query(
    f"""WITH {TICKS_SQL},
    b AS (SELECT min(epoch_us(ts)) AS t0, max(epoch_us(ts)) AS t1 FROM ticks),
    s AS (SELECT t.*, epoch_us(ts) AS us, least(2, 3 * (epoch_us(ts) + CASE WHEN event_id % 7 = 0 THEN {DELAY_US} ELSE 0 END - t0) // (t1 - t0 + 1)) AS slice
      FROM ticks t, b),
    m AS (SELECT x.slice, max(y.us) - 2000000 AS mark FROM (SELECT DISTINCT slice FROM s) x JOIN s y ON y.slice < x.slice GROUP BY x.slice),
    l AS (SELECT s.*, coalesce((us // 60000000 + 1) * 60000000 <= mark, false) AS late FROM s LEFT JOIN m USING (slice))
    SELECT symbol, date_trunc('minute', ts) AS ts,
      first(price ORDER BY ts, event_id) FILTER (NOT late) AS open, max(price) FILTER (NOT late) AS high,
      min(price) FILTER (NOT late) AS low, last(price ORDER BY ts, event_id) FILTER (NOT late) AS close,
      count(*) FILTER (NOT late) AS n_ticks, count(*) FILTER (late) AS n_late
    FROM l GROUP BY ALL"""
)
def stream_closed_minutes(t: Tables) -> DataFrame:
    """Candles of a stream with late ticks, and how many ticks came when their minute was closed."""
    path = scratch(t.spark, "closed")
    rows = ticks_of(t.events)
    us = clock.micros(F.col("ts"))
    first, last = rows.agg(F.min(us), F.max(us)).first()
    arrived = us + F.when(F.col("event_id") % 7 == 0, DELAY_US).otherwise(0) - (first or 0)
    part = F.least(F.lit(2), F.floor(arrived * 3 / ((last or 0) - (first or 0) + 1)).cast("int"))
    candles = jobs.CandleStream(t.spark, path, seq="event_id")

    def run(ticks: DataFrame) -> StreamingQuery:
        return jobs.run_batches(ticks, candles.step, f"{path}/log")

    in_parts(t, rows, part, 3, run)
    made = t.spark.read.parquet(f"{path}/out").drop("batch").unionByName(candles.open_candles(rows))
    late = candles.order.late().groupBy("symbol", clock.floor_minute(F.col("ts")).alias("ts")).agg(F.count(F.lit(1)).alias("n_late"))
    both = made.join(late, ["symbol", "ts"], "full")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_ticks", "n_late")]
    return both.select("symbol", "ts", "open", "high", "low", "close", *counts)


@query(f"WITH {PAIRS_SQL} SELECT predicted, actual, count(*) AS n FROM pairs GROUP BY ALL")
def stream_accuracy(t: Tables) -> DataFrame:
    """Predictions and labels both as streams: joined within an hour, counted batch by batch.

    A prediction is made at the second of its document's number, its label half a minute later.
    """
    path = scratch(t.spark, "accuracy")
    said = F.when(F.col("n_chars") > 2000, "BUY").when(F.col("lang") != "en", "SELL").otherwise("HOLD")
    real = F.when(F.col("toxic") == 1, "SELL").when(F.col("quality") == 1, "BUY").otherwise("HOLD")
    sides = {"documents": said.alias("signal"), "labels": real.alias("label")}
    tables = {}
    for wait, (name, value) in zip((0, 30), sides.items()):
        rows = getattr(t, name)
        tables[name] = rows.select("doc_id", value, F.timestamp_seconds(F.col("doc_id") + wait + 1_000_000_000).alias("ts"))

    def run(streams: dict[str, DataFrame]) -> StreamingQuery:
        pairs = jobs.live_pairs(streams["documents"], streams["labels"], "doc_id", "signal", "label")
        return jobs.run_batches(pairs, jobs.counts_into(f"{path}/out"), f"{path}/log")

    together(t, tables, F.col("ts").cast("long"), run)
    return t.spark.read.parquet(f"{path}/out").groupBy("predicted", "actual").agg(F.sum("n").alias("n"))


_NIGHT_SQL = """r AS (
  SELECT event_id, user_id, ts, CASE event_type WHEN 'purchase' THEN 'positive' WHEN 'error' THEN 'negative' WHEN 'signup' THEN NULL ELSE 'neutral' END AS sentiment,
    least(greatest(value / 100.0, 0), 1) AS confidence, CAST(ts AS TIME) BETWEEN TIME '09:30:00' AND TIME '15:30:00' AS open FROM events),
l AS (SELECT max(ts) FILTER (open) AS moment FROM r)"""


@query(
    f"""WITH {_NIGHT_SQL}
    SELECT event_id, user_id, CASE WHEN open OR ts <= moment THEN 'score' ELSE 'wait' END AS route,
      CASE WHEN open OR ts <= moment THEN NULL WHEN sentiment = 'positive' THEN 'BULLISH' WHEN sentiment = 'negative' THEN 'BEARISH' ELSE 'NEUTRAL' END AS bias,
      CASE WHEN NOT (open OR ts <= moment) THEN round(confidence, 4) END AS signal_confidence
    FROM r, l"""
)
def offhours_batches(t: Tables) -> DataFrame:
    """Rows that arrive in any order over three batches: scored by the first open moment after them, or still waiting with a bias."""
    path = scratch(t.spark, "nights")
    mood = F.when(F.col("event_type") == "purchase", "positive").when(F.col("event_type") == "error", "negative").when(F.col("event_type") == "signup", None)
    sure = F.least(F.greatest(F.col("value") / 100.0, F.lit(0.0)), F.lit(1.0))
    rows = t.events.select("event_id", "user_id", "ts", mood.otherwise("neutral").alias("sentiment"), sure.alias("confidence"))
    nights = OffHours(t.spark, path, ["event_id"], "ts")

    def step(batch: DataFrame, batch_id: int) -> None:
        nights.step(batch, batch_id).write.mode("overwrite").parquet(f"{path}/scored/batch={batch_id}")

    def run(stream: DataFrame) -> StreamingQuery:
        return jobs.run_batches(stream, step, f"{path}/log")

    in_parts(t, rows, F.pmod(F.xxhash64("event_id"), F.lit(3)), 3, run)
    scored = t.spark.read.parquet(f"{path}/scored").select("event_id", "user_id", F.lit("score").alias("route"))
    bias = bias_signals(nights.pending(), "ts").select("event_id", "user_id", F.lit("wait").alias("route"), F.col("predicted_signal").alias("bias"), "signal_confidence")
    return scored.unionByName(bias, allowMissingColumns=True)


@query(
    """WITH e AS (
      SELECT event_id, date_trunc('second', ts) AS tick, date_trunc('second', ts) + INTERVAL 1 SECOND * (event_id * 7 % 90) AS arrived
      FROM events)
    SELECT event_id, tick AS tick_time,
      date_trunc('minute', tick) = date_trunc('minute', arrived)
      OR (date_trunc('minute', tick) = date_trunc('minute', arrived) - INTERVAL 1 MINUTE AND second(arrived) <= 2) AS accepted
    FROM e"""
)
def late_tick_rule(t: Tables) -> DataFrame:
    """Epoch stamps (seconds, milliseconds, or already local) back to ticks, then the grace rule."""
    sec = F.date_trunc("second", F.col("ts")).cast("timestamp_ntz")
    n = F.col("event_id")
    arrived = (sec + F.make_dt_interval(secs=F.pmod(n * 7, F.lit(90)).cast("decimal(18,6)"))).cast("timestamp_ntz")
    local = F.unix_seconds(sec.cast("timestamp"))
    utc = local - 330 * 60
    kind = F.pmod(n, F.lit(3))
    epoch = F.when(kind == 0, utc).when(kind == 1, utc * 1000).otherwise(local)
    tick = timeparse.epoch_local(epoch, arrived)
    return t.events.select("event_id", tick.alias("tick_time"), jobs.tick_accepted(tick, arrived).alias("accepted"))
