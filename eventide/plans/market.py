"""Bars, as-of, interval and volatility queries over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators import asof, bars as bar_ops, labels
from eventide.plans import Tables, query
from eventide.plans.roles import (
    BARS_SQL,
    FORWARDS,
    LOOKBACKS,
    REACTION,
    STUDY_SQL,
    TICKS_SQL,
    TOLERANCE,
    anchors,
    bars,
    ticks,
)


@query(f"WITH {BARS_SQL} SELECT * FROM bars")
def ohlcv_minute_bars(t: Tables) -> DataFrame:
    return bars(t)


@query(
    f"""WITH {BARS_SQL}
    SELECT symbol, CAST(ts AS DATE) AS trade_date, date_trunc('hour', ts) AS ts,
           arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close,
           CAST(sum(volume) AS BIGINT) AS volume
    FROM (SELECT symbol, ts, open, high, low, close, volume FROM bars) b
    GROUP BY symbol, CAST(b.ts AS DATE), date_trunc('hour', b.ts)"""
)
def canonical_bars(t: Tables) -> DataFrame:
    return bar_ops.canonical_bars(bars(t), minutes=60)


@query(
    f"""WITH {STUDY_SQL}
    SELECT a.event_id, a.symbol, a.ts, b.ts AS bar_ts, b.close AS price
    FROM anchors a ASOF LEFT JOIN bars b
      ON a.symbol = b.symbol AND a.trade_date = b.trade_date AND a.ts >= b.ts"""
)
def asof_price_at_event(t: Tables) -> DataFrame:
    out = asof.Study(bars(t), anchors(t)).last_bar({"ts": "bar_ts", "close": "price"}).run()
    return out.select("event_id", "symbol", "ts", "bar_ts", "price")


def _lookback_sql() -> str:
    cols, joins = ["a.event_id", "b0.close AS close_at_signal", "b0.volume AS volume_at_signal"], []
    for k in (0, *LOOKBACKS):
        joins.append(
            f"ASOF LEFT JOIN bars b{k} ON a.symbol = b{k}.symbol AND a.trade_date = b{k}.trade_date "
            f"AND a.ts - INTERVAL {k} MINUTE >= b{k}.ts"
        )
        if k:
            cols += [
                f"b{k}.close AS pre_close_{k}m",
                f"b{k}.volume AS pre_volume_{k}m",
                f"round(CASE WHEN b{k}.open > 0 THEN (b{k}.high - b{k}.low) / b{k}.open WHEN b{k}.open IS NOT NULL THEN 0 END, 4) "
                f"AS pre_volatility_{k}m",
            ]
    return f"WITH {STUDY_SQL} SELECT {', '.join(cols)} FROM anchors a {' '.join(joins)}"


@query(_lookback_sql())
def asof_lookbacks(t: Tables) -> DataFrame:
    out = asof.Study(bars(t), anchors(t)).lookbacks(LOOKBACKS).run()
    per = [
        c
        for k in LOOKBACKS
        for c in (
            F.col(f"pre_close_{k}m"),
            F.col(f"pre_volume_{k}m"),
            F.round(f"pre_volatility_{k}m", 4).alias(f"pre_volatility_{k}m"),
        )
    ]
    return out.select("event_id", "close_at_signal", "volume_at_signal", *per)


def _forward_sql() -> str:
    cols, joins = ["a.event_id"], []
    for k in FORWARDS:
        joins.append(
            f"ASOF LEFT JOIN bars b{k} ON a.symbol = b{k}.symbol AND a.trade_date = b{k}.trade_date "
            f"AND a.ts + INTERVAL {k} MINUTE <= b{k}.ts"
        )
        cols.append(
            f"CASE WHEN b{k}.ts <= a.ts + INTERVAL {k + TOLERANCE} MINUTE THEN round(b{k}.close, 2) END "
            f"AS price_after_{k}min"
        )
    return f"WITH {STUDY_SQL} SELECT {', '.join(cols)} FROM anchors a {' '.join(joins)}"


@query(_forward_sql())
def forward_prices_tolerance(t: Tables) -> DataFrame:
    out = asof.Study(bars(t), anchors(t)).forward_prices(FORWARDS, TOLERANCE).run()
    return out.select("event_id", *[f"price_after_{k}min" for k in FORWARDS])


@query(
    f"""WITH {STUDY_SQL}, both_sides AS (
      SELECT a.event_id, p.close AS back, CASE WHEN n.ts <= a.ts + INTERVAL 60 MINUTE THEN n.close END AS fwd
      FROM anchors a
      ASOF LEFT JOIN bars p ON a.symbol = p.symbol AND a.trade_date = p.trade_date AND a.ts >= p.ts
      ASOF LEFT JOIN bars n ON a.symbol = n.symbol AND a.trade_date = n.trade_date AND a.ts < n.ts)
    SELECT event_id, round(coalesce(back, fwd), 2) AS price_at_signal,
           back IS NULL AND fwd IS NOT NULL AS price_at_signal_is_fallback
    FROM both_sides"""
)
def price_at_signal_fallback(t: Tables) -> DataFrame:
    out = asof.Study(bars(t), anchors(t)).price_at_signal(fallback=60).run()
    return out.select("event_id", "price_at_signal", "price_at_signal_is_fallback")


REACTION_SQL = f"""{STUDY_SQL}, starts AS (
  SELECT a.event_id, a.symbol, a.trade_date, n.ts AS start
  FROM anchors a ASOF LEFT JOIN bars n
    ON a.symbol = n.symbol AND a.trade_date = n.trade_date AND a.ts <= n.ts),
reactions AS (
  SELECT s.event_id, min(s.start) AS post_start, arg_min(b.open, b.ts) AS post_open, max(b.high) AS post_high,
         min(b.low) AS post_low, arg_max(b.close, b.ts) AS post_close, CAST(sum(b.volume) AS BIGINT) AS post_volume
  FROM starts s LEFT JOIN bars b
    ON s.symbol = b.symbol AND s.trade_date = b.trade_date AND b.ts >= s.start
   AND b.ts < s.start + INTERVAL {REACTION} MINUTE
  GROUP BY s.event_id),
returns AS (
  SELECT *, (post_close - post_open) / post_open * 100 AS ret FROM reactions)"""


@query(
    f"""WITH {REACTION_SQL}
    SELECT event_id, post_start, post_open AS post_open_60m, post_high AS post_high_60m, post_low AS post_low_60m,
           post_close AS post_close_60m, post_volume AS post_volume_60m, round(ret, 4) AS return_60m
    FROM returns"""
)
def forward_reaction_window(t: Tables) -> DataFrame:
    out = asof.Study(bars(t), anchors(t)).reaction(REACTION).run()
    return out.select(
        "event_id",
        "post_start",
        *[f"post_{c}_60m" for c in asof.PRICES],
        F.round("return_60m", 4).alias("return_60m"),
    )


@query(
    f"""WITH {STUDY_SQL}
    SELECT a.event_id, round(max(b.high), 2) AS highest_price, round(min(b.low), 2) AS lowest_price
    FROM anchors a LEFT JOIN bars b
      ON a.symbol = b.symbol AND a.trade_date = b.trade_date
     AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 240 MINUTE
    GROUP BY a.event_id"""
)
def price_range_after_event(t: Tables) -> DataFrame:
    return asof.Study(bars(t), anchors(t)).price_range(240).run().select("event_id", "highest_price", "lowest_price")


PRE_SQL = f"""{STUDY_SQL}, pre AS (
  SELECT a.event_id, b.ts, b.open, b.high, b.low, b.close, b.volume,
         row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts DESC) AS rn,
         count(*) OVER (PARTITION BY a.event_id) AS n
  FROM anchors a JOIN bars b ON a.symbol = b.symbol AND a.trade_date = b.trade_date AND b.ts < a.ts),
feats AS (
  SELECT event_id, max(n) AS n, arg_min(close, rn) AS last_close,
         max(open) FILTER (rn = 5) AS open5, max(open) FILTER (rn = 30) AS open30,
         max(volume) FILTER (rn = 1) AS last_volume, avg(volume) AS avg_volume,
         max(high) AS hi, min(low) AS lo, arg_min(open, ts) AS first_open
  FROM pre GROUP BY event_id HAVING max(n) >= 5)"""


@query(
    f"""WITH {PRE_SQL}
    , moves AS (
      SELECT event_id, n, CASE WHEN open5 > 0 THEN (last_close - open5) / open5 * 100 ELSE 0 END AS m5,
             CASE WHEN open30 > 0 THEN (last_close - open30) / open30 * 100 ELSE 0 END AS m30 FROM feats)
    SELECT a.event_id, round(m5, 4) AS pre_news_momentum_5m,
           round(CASE WHEN n >= 30 THEN m30 ELSE m5 END, 4) AS pre_news_momentum_30m
    FROM anchors a LEFT JOIN moves m ON a.event_id = m.event_id"""
)
def pre_event_momentum(t: Tables) -> DataFrame:
    out = asof.Study(bars(t), anchors(t)).pre_event().run()
    return out.select("event_id", "pre_news_momentum_5m", "pre_news_momentum_30m")


@query(
    f"""WITH {PRE_SQL}
    SELECT a.event_id,
           round(CASE WHEN avg_volume > 0 THEN last_volume / avg_volume
                      WHEN n IS NOT NULL THEN 1.0 END, 4) AS pre_news_volume_ratio,
           round(CASE WHEN first_open > 0 THEN (hi - lo) / first_open * 100 WHEN n IS NOT NULL THEN 0 END, 4)
             AS intraday_volatility,
           round(last_close, 2) AS pre_news_price
    FROM anchors a LEFT JOIN feats f ON a.event_id = f.event_id"""
)
def pre_event_volume_volatility(t: Tables) -> DataFrame:
    out = asof.Study(bars(t), anchors(t)).pre_event().run()
    return out.select("event_id", "pre_news_volume_ratio", "intraday_volatility", "pre_news_price")


@query(
    """WITH held AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type <> 'signup')
    SELECT a.event_id, a.user_id, CAST(a.ts AS DATE) AS event_date, max(h.d) AS trade_date
    FROM events a LEFT JOIN held h
      ON a.user_id = h.user_id AND h.d <= CAST(a.ts AS DATE) AND h.d >= CAST(a.ts AS DATE) - 5
    WHERE a.event_type = 'signup' GROUP BY ALL"""
)
def session_resolve(t: Tables) -> DataFrame:
    day = F.to_date("ts")
    held = t.events.filter("event_type <> 'signup'").select("user_id", day.alias("trade_date"))
    asked = t.events.filter("event_type = 'signup'").select("event_id", "user_id", day.alias("event_date"))
    out = asof.resolve_session(asked, held, key=["user_id"])
    return out.select("event_id", "user_id", "event_date", "trade_date")


@query(
    f"""WITH {BARS_SQL}
    SELECT symbol, trade_date, arg_max(close, ts) FILTER (CAST(ts AS TIME) <= TIME '15:30') AS session_close,
           max(high) FILTER (CAST(ts AS TIME) BETWEEN TIME '09:15' AND TIME '15:30') AS window_max
    FROM bars GROUP BY symbol, trade_date"""
)
def session_close_and_max(t: Tables) -> DataFrame:
    return asof.session_clock_prices(bars(t))


HV_SQL = f"""{TICKS_SQL}, steps AS (
  SELECT event_id, symbol, CAST(ts AS DATE) AS trade_date, ts, price, qty,
         ln(price / lag(price) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts, event_id)) AS r
  FROM ticks),
hvs AS (
  SELECT * EXCLUDE (dev), CASE WHEN isfinite(dev) THEN dev * sqrt(252 * 390) ELSE 0 END AS hv
  FROM (SELECT *, stddev_pop(r) OVER (PARTITION BY symbol, trade_date ORDER BY ts, event_id
          ROWS BETWEEN 58 PRECEDING AND CURRENT ROW) AS dev FROM steps))"""


@query(f"WITH {HV_SQL} SELECT event_id, symbol, trade_date, round(hv, 4) AS hv FROM hvs")
def rolling_hv(t: Tables) -> DataFrame:
    line = ticks(t).withColumn("trade_date", F.to_date("ts"))
    out = bar_ops.rolling_hv(line, seq="event_id")
    return out.select("event_id", "symbol", "trade_date", F.round("hv", 4).alias("hv"))


@query(
    f"""WITH {HV_SQL}
    SELECT symbol, date_trunc('minute', ts) AS ts, last(price ORDER BY ts, event_id) AS close, count(*) AS n_ticks,
           CASE WHEN count(*) = 1 THEN 0.0 ELSE round(last(hv ORDER BY ts, event_id), 4) END AS hv
    FROM hvs GROUP BY symbol, date_trunc('minute', hvs.ts)"""
)
def candle_hv(t: Tables) -> DataFrame:
    line = ticks(t).withColumn("trade_date", F.to_date("ts"))
    out = bar_ops.tick_bars(bar_ops.rolling_hv(line, seq="event_id"), seq="event_id", hv="hv")
    return out.select("symbol", "ts", "close", "n_ticks", F.round("hv", 4).alias("hv"))


def _label_sql(threshold: float) -> str:
    return f"""SELECT CAST({threshold} AS DOUBLE) AS threshold, label, count(*) AS n,
      round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct
    FROM (SELECT CASE WHEN ret >= {threshold} AND NOT isnan(ret) THEN 'BUY' WHEN ret <= -{threshold} THEN 'SELL' ELSE 'HOLD' END AS label
          FROM returns) GROUP BY label"""


@query(f"WITH {REACTION_SQL} {_label_sql(0.15)} UNION ALL {_label_sql(0.5)}")
def reaction_labels(t: Tables) -> DataFrame:
    """Live and historic thresholds side by side over one pass of the reactions."""
    from pyspark.sql import Window as W

    reacted = asof.Study(bars(t), anchors(t)).reaction(REACTION).run()
    both = F.array(F.lit(labels.LIVE_THRESHOLD), F.lit(labels.HISTORIC_THRESHOLD))
    rows = reacted.select("return_60m", F.explode(both).alias("threshold"))
    ret, cut = F.col("return_60m"), F.col("threshold")
    tagged = rows.select("threshold", labels.label_return(ret, cut)["label"].alias("label"))
    counts = tagged.groupBy("threshold", "label").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy("threshold"))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / total, 2))


@query(
    f"""WITH {STUDY_SQL}
    SELECT a.event_id, a.symbol, a.ts, b.ts AS anchor_ts
    FROM anchors a ASOF LEFT JOIN bars b ON a.symbol = b.symbol AND a.ts <= b.ts"""
)
def next_bar_anchor(t: Tables) -> DataFrame:
    return asof.next_bar(bars(t), anchors(t).drop("trade_date")).select("event_id", "symbol", "ts", "anchor_ts")


_FLAGSHIP_LABEL = "CASE WHEN ret >= 0.15 AND NOT isnan(ret) THEN 'BUY' WHEN ret <= -0.15 THEN 'SELL' ELSE 'HOLD' END"


@query(
    f"""WITH {REACTION_SQL}, seen AS (
      SELECT a.event_id, b.close AS pre_close FROM anchors a ASOF LEFT JOIN bars b
        ON a.symbol = b.symbol AND a.trade_date = b.trade_date AND a.ts - INTERVAL 30 MINUTE >= b.ts)
    SELECT {_FLAGSHIP_LABEL} AS label, count(*) AS n, count(pre_close) AS n_with_history,
           round(avg(ret), 4) AS avg_return
    FROM returns JOIN seen USING (event_id) GROUP BY 1"""
)
def flagship(t: Tables) -> DataFrame:
    """Bars, look-backs, reaction window and label counts in one plan."""
    reacted = asof.Study(bars(t), anchors(t)).lookbacks((30,), ("close",)).reaction(REACTION).run()
    tagged = reacted.withColumn("label", labels.label_return(F.col("return_60m"))["label"])
    return tagged.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("pre_close_30m").alias("n_with_history"),
        F.round(F.avg("return_60m"), 4).alias("avg_return"),
    )
