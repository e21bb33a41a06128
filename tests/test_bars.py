import datetime as dt
import math
import random

import numpy as np
from pyspark.sql import functions as F

from eventide.operators import bars

T0 = dt.datetime(2024, 1, 3, 9, 15)


def at(minutes=0, seconds=0.0):
    return T0 + dt.timedelta(minutes=minutes, seconds=seconds)


def tick_frame(spark, rows):
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, seq bigint, price double, qty int")


def test_equal_times_are_ordered_by_arrival(spark):
    rows = [("A", at(0, 5), 3, 12.0, 1), ("A", at(0, 5), 1, 10.0, 2), ("A", at(0, 5), 2, 11.0, None)]
    bar = bars.tick_bars(tick_frame(spark, rows), seq="seq").first()
    assert (bar.open, bar.high, bar.low, bar.close, bar.volume, bar.n_ticks) == (10.0, 12.0, 10.0, 12.0, 3, 3)
    assert bar.ts == at() and bar.trade_date == T0.date()


def test_canonical_first_and_last_skip_nulls(spark):
    schema = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume bigint, hv double"
    rows = [
        ("A", at(0, 1), None, 5.0, 4.0, 4.5, 10, 1.0),
        ("A", at(0, 30), 4.6, 6.0, 3.0, None, 5, None),
        ("A", at(1), 7.0, 7.0, 7.0, 7.0, None, 2.0),
    ]
    got = {r.ts: r for r in bars.canonical_bars(spark.createDataFrame(rows, schema)).collect()}
    assert (got[at()].open, got[at()].close, got[at()].high, got[at()].low) == (4.6, 4.5, 6.0, 3.0)
    assert got[at()].volume == 15 and got[at()].hv == 1.0 and got[at(1)].volume == 0


def test_bars_aggregate_by_hash(spark):
    frame = bars.tick_bars(tick_frame(spark, [("A", at(), 1, 1.0, 1)]), seq="seq")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def hv_loop(prices, window=60):
    out, held = [], []
    for p in prices:
        held = (held + [p])[-window:]
        if len(held) < 2 or min(held) <= 0:
            out.append(0.0)
            continue
        r = np.diff(np.log(held))
        out.append(float(np.std(r) * math.sqrt(252 * 390)))
    return out


def test_hv_blocks_equal_a_plain_loop(spark):
    rnd = random.Random(5)
    rows, want = [], {}
    # One symbol holds nearly all ticks; blocks are far smaller than the symbol.
    for sym, n in (("HOT", 700), ("B", 61), ("C", 1), ("FLAT", 70)):
        prices = [100.0 if sym == "FLAT" else round(rnd.uniform(50, 150), 2) for _ in range(n)]
        if sym == "B":
            prices[10] = 0.0
        for i, p in enumerate(prices):
            rows.append((sym, at(0, i * 7), i, p, 1))
        want |= {(sym, i): v for i, v in enumerate(hv_loop(prices))}
    rnd.shuffle(rows)
    frame = tick_frame(spark, rows).withColumn("trade_date", F.to_date("ts"))
    got = bars.rolling_hv(frame, seq="seq", block=64).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.hv - want[(r.symbol, r.seq)]) < 1e-6, (r.symbol, r.seq)


def test_position_in_group(spark):
    rows = [("A", at(0, s), s, 1.0, 1) for s in range(0, 600, 7)]
    got = bars.position_in_group(tick_frame(spark, rows), ["symbol"], "ts", "seq").orderBy("ts").collect()
    assert [r.rn for r in got] == list(range(1, len(rows) + 1))


def test_candle_hv_is_zero_for_one_tick(spark):
    rows = [("A", at(0, 1), 1, 10.0, 1), ("A", at(1, 1), 2, 20.0, 1), ("A", at(1, 2), 3, 40.0, 1)]
    frame = tick_frame(spark, rows).withColumn("trade_date", F.to_date("ts"))
    candles = bars.tick_bars(bars.rolling_hv(frame, seq="seq"), seq="seq", hv="hv").orderBy("ts").collect()
    assert candles[0].hv == 0.0 and candles[1].hv == 0.0  # two equal returns have no variance


def test_volatility_keeps_ticks_with_null_keys(spark):
    from eventide.operators import bars

    rows = spark.sql("SELECT * FROM VALUES ('A', timestamp_ntz'2024-01-01 10:00:00', 1.0), (NULL, timestamp_ntz'2024-01-01 10:00:00', 2.0), ('A', NULL, 3.0) t(symbol, ts, price)")
    assert bars.rolling_hv(rows.selectExpr("*", "to_date(ts) AS trade_date")).count() == 3
