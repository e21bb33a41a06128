"""Ticks to minute bars, bar canonicalisation and rolling historical volatility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide.functions import clock

# Annualisation of intraday volatility and its price window.
TRADING_DAYS = 252
SESSION_MINUTES = 390
HV_PRICES = 60


def tick_bars(
    ticks: DataFrame,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    price: str = "price",
    qty: str = "qty",
    seq: str | None = None,
    minutes: int = 1,
    hv: str | None = None,
) -> DataFrame:
    """OHLCV bars of ``minutes`` length, first/last taken in (time, arrival) order.

    All aggregate buffers are primitive, so a busy symbol is folded on the map side
    and the exchange carries one row per bar and map task.
    """
    at = F.col(ts)
    order = clock.order_key(at, F.col(seq) if seq else None)
    slot = (F.floor(clock.minute_no(at) / minutes) * minutes).cast("long")
    base = ticks.select(
        *keys,
        slot.alias("__slot"),
        F.col(price).alias("__p"),
        F.coalesce(F.col(qty), F.lit(0)).cast("long").alias("__q"),
        order.alias("__o"),
        *([F.col(hv).alias("__hv")] if hv else []),
    )
    aggs = [
        F.min_by("__p", "__o").alias("open"),
        F.max("__p").alias("high"),
        F.min("__p").alias("low"),
        F.max_by("__p", "__o").alias("close"),
        F.sum("__q").alias("volume"),
        F.count(F.lit(1)).alias("n_ticks"),
    ]
    if hv:
        # A candle that saw a single tick keeps volatility 0.
        aggs.append(F.when(F.count(F.lit(1)) == 1, 0.0).otherwise(F.max_by("__hv", "__o")).alias("hv"))
    out = base.groupBy(*keys, "__slot").agg(*aggs)
    start = clock.minute_ts(F.col("__slot"))
    named = ["open", "high", "low", "close", "volume", "n_ticks"] + (["hv"] if hv else [])
    return out.select(*keys, F.to_date(start).alias("trade_date"), start.alias("ts"), *named)


def canonical_bars(
    bars: DataFrame,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    seq: str | None = None,
    minutes: int = 1,
) -> DataFrame:
    """Fold rows of one minute (or ``minutes``) into one bar.

    First and last skip nulls; ``hv`` and ``iv`` take the last value when present.
    """
    at = F.col(ts)
    order = clock.order_key(at, F.col(seq) if seq else None)
    slot = (F.floor(clock.minute_no(at) / minutes) * minutes).cast("long")
    extra = [c for c in ("hv", "iv") if c in bars.columns]
    base = bars.select(*keys, slot.alias("__slot"), order.alias("__o"), "open", "high", "low", "close", "volume", *extra)

    def seen(c: str):
        return F.when(F.col(c).isNotNull(), F.col("__o"))

    out = base.groupBy(*keys, "__slot").agg(
        F.min_by("open", seen("open")).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", seen("close")).alias("close"),
        F.coalesce(F.sum("volume"), F.lit(0)).alias("volume"),
        *[F.max_by(c, seen(c)).alias(c) for c in extra],
    )
    start = clock.minute_ts(F.col("__slot"))
    return out.select(
        *keys, F.to_date(start).alias("trade_date"), start.alias("ts"), "open", "high", "low", "close", "volume", *extra
    )


def position_in_group(
    df: DataFrame, keys: Sequence[str], ts: str, seq: str | None = None, bucket_minutes: int = 1, name: str = "rn"
) -> DataFrame:
    """1-based position of each row in its group's time order, without sorting a whole group.

    Rows are numbered inside (group, time bucket); the bucket's offset is a running sum
    over the bucket counts. A group that holds a third of all rows is thus spread over
    as many tasks as it has buckets.
    """
    keys = list(keys)
    bucket = F.floor(clock.minute_no(F.col(ts)) / bucket_minutes).cast("long")
    rows = df.withColumn("__b", bucket)
    counts = rows.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    order = [F.col(ts)] + ([F.col(seq)] if seq else [])
    inside = W.partitionBy(*keys, "__b").orderBy(*order)
    # Null keys and times are groups like any other.
    named = offsets.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, "__b"])], "__base")
    same = F.lit(True)
    for i, k in enumerate([*keys, "__b"]):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return (
        rows.withColumn("__i", F.row_number().over(inside))
        .join(named, same)
        .drop(*[c for c in named.columns if c != "__base"])
        .withColumn(name, (F.col("__base") + F.col("__i")).cast("long"))
        .drop("__b", "__i", "__base")
    )


def rolling_hv(
    ticks: DataFrame,
    keys: Sequence[str] = ("symbol", "trade_date"),
    ts: str = "ts",
    price: str = "price",
    seq: str | None = None,
    prices: int = HV_PRICES,
    block: int = 65_536,
    out: str = "hv",
) -> DataFrame:
    """Annualised population deviation of log returns over the last ``prices`` ticks.

    Fewer than two prices, no variance or a non-positive price give 0. Each group is
    cut into blocks of ``block`` rows, and the last ``prices - 1`` rows of a block are
    repeated ahead of the next one, so no task ever holds a whole busy symbol and every
    window still sees all its prices.
    """
    keys = list(keys)
    halo = prices - 1
    own = F.floor((F.col("rn") - 1) / block).cast("long")
    tail = F.pmod(F.col("rn") - 1, F.lit(block)) >= block - halo
    placed = (
        position_in_group(ticks, keys, ts, seq)
        .withColumn("__own", own)
        .withColumn("__blk", F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))))
    )
    line = W.partitionBy(*keys, "__blk").orderBy("rn")
    last = line.rowsBetween(-(prices - 2), 0)
    seen = line.rowsBetween(-(prices - 1), 0)
    good = F.when(F.col(price) > 0, F.col(price))
    dev = F.stddev_pop("__r").over(last) * F.sqrt(F.lit(float(TRADING_DAYS * SESSION_MINUTES)))
    bad = F.max((F.coalesce(F.col(price), F.lit(0.0)) <= 0).cast("int")).over(seen)
    return (
        placed.withColumn("__r", F.ln(good / F.lag(good).over(line)))
        .withColumn(out, F.when(bad == 1, 0.0).otherwise(F.coalesce(dev, F.lit(0.0))))
        .filter(F.col("__blk") == F.col("__own"))
        .drop("__own", "__blk", "__r", "rn")
    )
