import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from eventide.operators import asof, labels

DAY = dt.datetime(2024, 1, 3)
BAR = "symbol string, trade_date date, ts timestamp_ntz, open double, high double, low double, close double, volume bigint"
EVENT = "event_id bigint, symbol string, trade_date date, ts timestamp_ntz"


def minute(m, day=0, sec=0):
    return DAY + dt.timedelta(days=day, minutes=m, seconds=sec)


def bar_row(sym, m, day=0, rnd=None, close=1.0, volume=10, open_=None):
    if rnd:
        o, c = round(rnd.uniform(90, 110), 2), round(rnd.uniform(90, 110), 2)
        return (sym, minute(m, day).date(), minute(m, day), o, max(o, c) + 1, min(o, c) - 1, c, rnd.randint(0, 50))
    o = close if open_ is None else open_
    return (sym, minute(m, day).date(), minute(m, day), o, max(o, close or o), min(o, close or o), close, volume)


def event(i, sym, m, sec=0, day=0):
    t = minute(m, day, sec)
    return (i, sym, t.date(), t)


@pytest.fixture(scope="module")
def market():
    rnd = random.Random(11)
    bars = [bar_row(s, m, d, rnd) for s in "AB" for d in (0, 1) for m in sorted(rnd.sample(range(555, 931), 90))]
    events = [event(i, rnd.choice("AAAB"), rnd.randint(540, 950), rnd.choice([0, 0, 1, 59]), rnd.randint(0, 1)) for i in range(300)]
    return bars, events


def session_bars(bars, ev):
    return sorted((b for b in bars if b[0] == ev[1] and b[1] == ev[2]), key=lambda b: b[2])


def test_all_questions_against_a_plain_loop(spark, market):
    bars, events = market
    k, tol = 15, 10
    out = (
        asof.Study(spark.createDataFrame(bars, BAR), spark.createDataFrame(events, EVENT))
        .lookbacks((1, k))
        .last_bar({"close": "strict_close"}, strict=True)
        .forward_prices((2, k), tol)
        .price_at_signal(15)
        .price_range(60)
        .reaction(15)
        .pre_event()
        .has_session()
        .run()
    )
    got = {r.event_id: r for r in out.collect()}
    assert len(got) == len(events)
    delta = dt.timedelta(minutes=1)
    for ev in events:
        own, t, r = session_bars(bars, ev), ev[3], got[ev[0]]
        back = [b for b in own if b[2] <= t]
        assert r.close_at_signal == (back[-1][6] if back else None)
        past = [b for b in own if b[2] <= t - k * delta]
        assert r[f"pre_open_{k}m"] == (past[-1][3] if past else None)
        if past:
            assert r[f"pre_volatility_{k}m"] == pytest.approx((past[-1][4] - past[-1][5]) / past[-1][3])
        strict = [b for b in own if b[2] < t]
        assert r.strict_close == (strict[-1][6] if strict else None)
        ahead = [b for b in own if t + k * delta <= b[2] <= t + (k + tol) * delta]
        assert r[f"price_after_{k}min"] == (ahead[0][6] if ahead else None)
        fall = [b for b in own if t < b[2] <= t + 15 * delta]
        want = back[-1][6] if back else (fall[0][6] if fall else None)
        assert r.price_at_signal == want and r.price_at_signal_is_fallback == (not back and bool(fall))
        near = [b for b in own if t <= b[2] <= t + 60 * delta]
        assert r.highest_price == (round(max(b[4] for b in near), 2) if near else None)
        assert r.lowest_price == (round(min(b[5] for b in near), 2) if near else None)
        nxt = [b for b in own if b[2] >= t]
        window = [b for b in nxt if b[2] < nxt[0][2] + 15 * delta] if nxt else []
        if window:
            assert (r.post_open_15m, r.post_close_15m) == (window[0][3], window[-1][6])
            assert (r.post_high_15m, r.post_low_15m) == (max(b[4] for b in window), min(b[5] for b in window))
            assert r.post_volume_15m == sum(b[7] for b in window) and r.post_start == window[0][2]
            assert r.return_15m == pytest.approx((window[-1][6] - window[0][3]) / window[0][3] * 100)
        else:
            assert r.return_15m is None
        if len(strict) < 5:
            assert r.pre_news_momentum_5m is None and r.pre_news_price is None
        else:
            m5 = (strict[-1][6] - strict[-5][3]) / strict[-5][3] * 100
            m30 = (strict[-1][6] - strict[-30][3]) / strict[-30][3] * 100 if len(strict) >= 30 else m5
            mean = sum(b[7] for b in strict) / len(strict)
            assert r.pre_news_momentum_5m == pytest.approx(m5, abs=1e-4)
            assert r.pre_news_momentum_30m == pytest.approx(m30, abs=1e-4)
            assert r.pre_news_volume_ratio == pytest.approx(strict[-1][7] / mean, abs=1e-4)
            span = (max(b[4] for b in strict) - min(b[5] for b in strict)) / strict[0][3] * 100
            assert r.intraday_volatility == pytest.approx(span, abs=1e-4)
        assert r.has_bars == bool(own)


def test_window_edges_and_nulls(spark):
    bars = [
        bar_row("A", 600, close=100.0),
        bar_row("A", 615, close=None, open_=101.0),
        bar_row("A", 630, close=102.0, volume=0),
    ]
    events = [event(1, "A", 600), event(2, "A", 585), event(3, "A", 584, 59), event(4, "A", 615), event(5, "Z", 600)]
    out = (
        asof.Study(spark.createDataFrame(bars, BAR), spark.createDataFrame(events, EVENT))
        .price_at_signal(15)
        .forward_prices((10, 15), 5)
        .reaction(15)
        .run()
    )
    got = {r.event_id: r for r in out.collect()}
    assert got[1].price_at_signal == 100.0 and not got[1].price_at_signal_is_fallback
    assert got[2].price_at_signal == 100.0 and got[2].price_at_signal_is_fallback  # +15 min is inclusive
    assert got[3].price_at_signal is None
    # The bar at +15 min is outside the reaction window; the null close of the first hit stays null.
    assert got[1].post_close_15m == 100.0 and got[1].price_after_15min is None and got[1].price_after_10min is None
    # A null close at the event itself is not skipped backwards: the forward bar is used.
    assert got[4].price_at_signal == 102.0 and got[4].price_at_signal_is_fallback
    assert got[5].price_at_signal is None and got[5].return_15m is None


def test_zero_open_and_zero_volume(spark):
    bars = [bar_row("A", 600 + i, close=5.0, open_=0.0, volume=0) for i in range(6)]
    r = asof.Study(spark.createDataFrame(bars, BAR), spark.createDataFrame([event(1, "A", 610)], EVENT)).pre_event().lookbacks((5,)).run().first()
    ahead = asof.Study(spark.createDataFrame(bars, BAR), spark.createDataFrame([event(1, "A", 600)], EVENT)).reaction().run()
    row = ahead.withColumns(labels.label_return(F.col("return_15m"))).first()
    assert row.return_15m == float("inf") and row.label == "BUY"
    flat = spark.range(1).select(*[c.alias(n) for n, c in labels.label_return(F.lit(float("nan"))).items()]).first()
    assert (flat.label, flat.label_reason) == ("HOLD", "flat_move")
    assert (r.pre_news_momentum_5m, r.pre_news_volume_ratio, r.intraday_volatility) == (0.0, 1.0, 0.0)
    assert r.pre_volatility_5m == 0.0


def test_session_resolve_and_next_bar(spark):
    bars = spark.createDataFrame([bar_row("A", 600, 0), bar_row("A", 700, 7), bar_row("A", 600, 7)], BAR)
    events = [event(i, "A", 601, 0, d) for i, d in enumerate((0, 5, 6, 7, 8))]
    frame = spark.createDataFrame(events, EVENT)
    asked = frame.drop("trade_date").withColumn("event_date", F.to_date("ts"))
    got = {r.event_id: r.trade_date for r in asof.resolve_session(asked, bars).collect()}
    d0, d7 = DAY.date(), minute(0, 7).date()
    assert got == {0: d0, 1: d0, 2: None, 3: d7, 4: d7}
    nxt = {r.event_id: r.anchor_ts for r in asof.next_bar(bars, frame.drop("trade_date")).collect()}
    assert nxt == {0: minute(600, 7), 1: minute(600, 7), 2: minute(600, 7), 3: minute(700, 7), 4: None}


def test_partitioning_does_not_change_results(spark, market):
    bars, events = market
    b, e = spark.createDataFrame(bars, BAR), spark.createDataFrame(events, EVENT)

    def run(x, y):
        out = asof.Study(x, y).lookbacks((5,)).reaction().run()
        return sorted(map(tuple, out.collect()), key=repr)

    assert run(b, e) == run(b.repartition(13).orderBy(F.rand(3)), e.repartition(7))


def test_many_events_on_one_minute_stay_one_probe_point(spark):
    bars = spark.createDataFrame([bar_row("A", 600)], BAR)
    hot = spark.range(20_000).select(
        F.col("id").alias("event_id"), F.lit("A").alias("symbol"),
        F.lit(str(DAY.date())).cast("date").alias("trade_date"), F.lit(str(minute(600))).cast("timestamp_ntz").alias("ts"),
    )
    study = asof.Study(bars, hot).last_bar({"close": "c"})
    assert study.answers().count() == 1
    assert study.run().filter("c = 1.0").count() == 20_000


def test_plan_has_one_timeline_and_no_nested_loop(spark, market):
    bars, events = market
    out = asof.Study(spark.createDataFrame(bars, BAR), spark.createDataFrame(events, EVENT)).lookbacks().reaction().pre_event().run()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert plan.count("REPARTITION_BY_COL") == 1


def test_enrichment_prunes_bar_partitions(spark, market, tmp_path):
    from eventide.operators import features

    bars, events = market
    spark.createDataFrame(bars, BAR).write.partitionBy("trade_date").parquet(str(tmp_path / "bars"))
    stored = spark.read.parquet(str(tmp_path / "bars"))
    rows = spark.createDataFrame(events, EVENT).filter(f"trade_date = date'{DAY.date()}'").drop("trade_date")
    rows = rows.withColumnRenamed("ts", "event_ts").withColumn("company_name", F.lit("c"))
    out = features.with_market(rows, stored)
    assert "dynamicpruning" in out._jdf.queryExecution().executedPlan().toString()
    plain = asof.Study(stored, rows.withColumn("trade_date", F.to_date("event_ts")), ts="event_ts").lookbacks().pre_event().reaction().run()
    cols = ["event_id", "pre_close_5m", "close_at_signal", "return_15m", "pre_news_momentum_30m"]
    assert sorted(map(repr, out.select(cols).collect())) == sorted(map(repr, plain.select(cols).collect()))
