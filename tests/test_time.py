import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventide.functions import clock, scalars, timeparse
from eventide.operators import calendar, evaluate, labels

D = dt.datetime
FORMS = [
    ("10:49:00 AM | 13 Feb 2026", D(2026, 2, 13, 10, 49), D(2026, 2, 13, 5, 19)),
    ("05:16 PM | 17 Jan 2026", D(2026, 1, 17, 17, 16), D(2026, 1, 17, 11, 46)),
    ("January 17, 2026/ 14:47 IST", D(2026, 1, 17, 14, 47), D(2026, 1, 17, 9, 17)),
    ("2026-01-17 17:25:29", D(2026, 1, 17, 17, 25, 29), D(2026, 1, 17, 11, 55, 29)),
    ("January 17, 2026 at 02:44 PM", D(2026, 1, 17, 14, 44), D(2026, 1, 17, 9, 14)),
    ("2022-10-23 20:30:20+05:30 IST", D(2022, 10, 23, 20, 30, 20), D(2022, 10, 23, 15, 0, 20)),
    ("2026-01-18 02:00:00", D(2026, 1, 18, 2), D(2026, 1, 17, 20, 30)),
    ("Updated : Oct 18, 2025", None, None),
    ("10:00 AM | 13 Feb 2026 | x", None, None),
    ("2026-01-17T17:25:29", None, None),
    ("", None, None),
    (None, None, None),
]


def texts(spark, values):
    return spark.createDataFrame([(v,) for v in values], "s string")


def test_published_forms(spark):
    rows = texts(spark, [f[0] for f in FORMS]).select(
        "s", timeparse.published_local(F.col("s")).alias("l"), timeparse.published_utc(F.col("s")).alias("u")
    ).collect()
    assert [(r.s, r.l, r.u) for r in rows] == FORMS


def test_signal_times_floor_and_differ(spark):
    cases = {
        "2026-01-23 14:30:49": D(2026, 1, 23, 14, 30),
        "January 23, 2026/ 15:53 IST": D(2026, 1, 23, 15, 53),
        "January 23, 2026/ 15:53": D(2026, 1, 23, 15, 53),
        "January 23, 2026 at 03:39 PM": D(2026, 1, 23, 15, 39),
        "03:56 PM | 23 Jan 2026": D(2026, 1, 23, 15, 56),
        "10:49:00 AM | 13 Feb 2026": None,
        "2026-01-23T09:00:30Z": D(2026, 1, 23, 14, 30),
        "2026-01-23T14:30:10+05:30": D(2026, 1, 23, 14, 30),
        "soon": None,
    }
    rows = texts(spark, list(cases)).select("s", timeparse.signal_local(F.col("s")).alias("l")).collect()
    assert {r.s: r.l for r in rows} == cases


def test_flexible_view_and_site_times(spark):
    df = texts(spark, ["2026-02-16T10:00:00", "February 16, 2026/ 10:35 IST", "10:49:00 AM | 13 Feb 2026", "x"])
    got = [r[0] for r in df.select(timeparse.flexible_local(F.col("s"))).collect()]
    assert got == [D(2026, 2, 16, 10), D(2026, 2, 16, 10, 35), D(2026, 2, 13, 10, 49), None]
    view = df.select(timeparse.view_local(F.col("s"), F.lit("2026-02-20 11:00:00 IST"))).collect()
    assert view[2][0] == D(2026, 2, 20, 11) and view[0][0] == D(2026, 2, 16, 10)
    raw = texts(spark, ["Oct 18, 2025, 09:05:07 AM IST", "Updated: 18 Oct 2025, 9:05 PM", "2025-10-18 01:02:03", "n/a"])
    site = [r[0] for r in raw.select(timeparse.site_display(F.col("s"))).collect()]
    assert site == ["09:05:07 AM | 18 Oct 2025", "09:05:00 PM | 18 Oct 2025", "01:02:03 AM | 18 Oct 2025", None]


def test_epoch(spark):
    arrived = F.lit("2026-01-23 10:00:00").cast("timestamp_ntz")
    utc = int(D(2026, 1, 23, 4, 30, tzinfo=dt.timezone.utc).timestamp())
    df = spark.createDataFrame([(utc,), (utc * 1000,), (utc + 19_800,)], "v bigint")
    assert {r[0] for r in df.select(timeparse.epoch_local(F.col("v"), arrived)).collect()} == {D(2026, 1, 23, 10)}


def test_calendar(spark):
    df = spark.createDataFrame([("2026-02-14",), ("2026-01-26",), ("2026-02-16",), ("2026-02-13",)], "d string")
    df = df.select(F.to_date("d").alias("event_date"))
    got = {str(r.event_date): r for r in calendar.with_sessions(df, calendar.calendar_table(spark)).collect()}
    plan = calendar.with_sessions(df, calendar.calendar_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert got["2026-02-14"].reason == "Weekend (Saturday)" and not got["2026-02-14"].is_trading
    assert got["2026-01-26"].reason == "NSE Holiday (2026-01-26)"
    assert got["2026-02-16"].is_trading and str(got["2026-02-16"].prev_session) == "2026-02-13"
    assert str(got["2026-02-14"].next_session) == "2026-02-16" and str(got["2026-01-26"].prev_session) == "2026-01-23"


@pytest.mark.parametrize(
    "clock,trading,status,regime,scoring",
    [
        ("09:14:59", True, "Before Market Open", "weekend_holiday", False),
        ("09:15:00", True, "Market Hours", "intraday", False),
        ("09:30:00", True, "Market Hours", "intraday", True),
        ("15:30:00", True, "Market Hours", "intraday", True),
        ("15:30:01", True, "After Market Close", "after_market", False),
        ("11:00:00", False, "closed", "weekend_holiday", True),
    ],
)
def test_market_hours(spark, clock, trading, status, regime, scoring):
    ts, is_open = F.lit(f"2026-02-16 {clock}").cast("timestamp_ntz"), F.lit(trading)
    row = spark.range(1).select(
        calendar.market_status(ts, is_open, F.lit("closed")).alias("s"),
        calendar.regime(ts, is_open).alias("r"),
        calendar.scoring_open(ts).alias("o"),
    ).first()
    assert (row.s, row.r, row.o) == (status, regime, scoring)


def test_time_decay(spark):
    now = F.lit("2026-01-01 10:00:00").cast("timestamp_ntz")
    df = spark.createDataFrame([(D(2026, 1, 1, 9, 45),), (D(2026, 1, 1, 11),), (None,)], "t timestamp_ntz")
    assert [r[0] for r in df.select(scalars.time_decay(F.col("t"), now)).collect()] == [0.3679, 1.0, 1.0]


def test_horizon_and_verdict(spark):
    assert [evaluate.horizon_minutes(x) for x in ("1h", "5m", "x", 30)] == [60, 5, 60, 30]
    cases = [("BUY", 10.0, 11.0, "Correct"), ("BUY", 10.0, 10.0, "Wrong"), ("SELL", 10.0, 9.0, "Correct"), ("SELL", 10.0, 10.0, "Wrong"), ("HOLD", 1.0, 2.0, "Neutral")]
    df = spark.createDataFrame(cases, "side string, a double, b double, want string")
    assert all(r.got == r.want for r in df.withColumn("got", labels.verdict(F.col("side"), F.col("a"), F.col("b"))).collect())
    zero = spark.range(1).select(labels.percent_change(F.lit(0.0), F.lit(5.0))).first()[0]
    assert zero == 0.0


BAR = "symbol string, trade_date date, ts timestamp_ntz, open double, high double, low double, close double, volume bigint"


def test_event_study_reasons_in_order(spark):
    day = dt.date(2026, 1, 23)

    def bar(m, c):
        return ("A", day, D(2026, 1, 23) + dt.timedelta(minutes=m), c, c, c, c, 1)

    bars = spark.createDataFrame([bar(600, 10.0), bar(660, 11.0), bar(720, 12.0)], BAR)
    t = D(2026, 1, 23, 10, 0, 30)
    rows = [
        (1, " ", "bad", None), (2, "A", "bad", None), (3, "A", "positive", None), (4, "A", "positive", D(2026, 1, 23, 15, 0)),
        (5, "Q", "positive", t), (6, "B", "positive", t), (7, "A", "positive", D(2026, 1, 23, 9, 30)),
        (8, "A", "negative", D(2026, 1, 23, 12, 30)), (9, "A", "positive", t), (10, "A", "Neutral", t),
    ]
    signals = spark.createDataFrame(rows, "event_id int, symbol string, sentiment string, ts timestamp_ntz")
    listed = spark.createDataFrame([("A",), ("B",)], "symbol string")
    out = evaluate.event_study(signals, bars, listed)
    got = {r.event_id: r for r in out.collect()}
    assert {k: r.skip_reason for k, r in got.items()} == {
        1: "NO_SYMBOL", 2: "INVALID_SENTIMENT", 3: "TIME_PARSE_FAIL", 4: "OUT_OF_MARKET", 5: "NO_MAPPING", 6: "NO_BARS",
        7: "MISSING_PRICE_T", 8: "MISSING_PRICE_AT_HORIZON", 9: None, 10: None,
    }
    assert (got[9].price_at_signal, got[9].price_after_60min, got[9].percent_change, got[9].result) == (10.0, 11.0, 10.0, "Correct")
    assert got[10].result == "Neutral"
    total = evaluate.study_summary(out).first()
    assert (total.sample_size, total.written, total.skipped) == (10, 2, 8)


def test_event_study_of_raw_bars(spark):
    """Rows of one minute are one bar, and symbols compare trimmed and in upper case."""
    day, t = dt.date(2026, 1, 23), D(2026, 1, 23, 10)
    hour = dt.timedelta(hours=1)
    raw = [(" a", day, t, 9.0, 9.5, 8.0, 9.0, 1), ("A", day, t, 9.0, 12.0, 9.0, 10.0, 1), ("a ", day, t + hour, 11.0, 11.0, 11.0, 11.0, 1)]
    other = [("A", dt.date(2026, 1, 24), t + 24 * hour, 1.0, 1.0, 1.0, 1.0, 1)]
    signals = spark.createDataFrame([(1, "a", "positive", t), (2, "a", "junk", t)], "event_id int, symbol string, sentiment string, ts timestamp_ntz")
    listed = spark.createDataFrame([("A ",)], "symbol string")
    for rows in (raw, raw[::-1]):
        out = evaluate.event_study(signals, spark.createDataFrame(rows + other, BAR), listed)
        got = {r.event_id: r for r in out.collect()}
        one = got[1]
        assert (one.symbol, one.price_at_signal, one.price_after_60min, one.highest_price, one.lowest_price, one.result) == ("A", 10.0, 11.0, 12.0, 8.0, "Correct")
        assert got[2].skip_reason == "INVALID_SENTIMENT" and got[2].price_at_signal_is_fallback is None


def test_clock_does_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([(D(2024, 3, 10, 2, 30),), (D(2024, 3, 10, 3, 30),), (D(1969, 12, 31, 23, 59, 58, 250_000),), (None,)], "t timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = df.select(clock.micros(F.col("t")).alias("m"), clock.floor_minute(F.col("t")).alias("f"), clock.axis(F.col("t")).alias("x")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    epoch = D(1970, 1, 1)
    assert [r.m for r in got] == [(v - epoch) // dt.timedelta(microseconds=1) if v else None for v in (D(2024, 3, 10, 2, 30), D(2024, 3, 10, 3, 30), D(1969, 12, 31, 23, 59, 58, 250_000), None)]
    assert [r.f for r in got] == [D(2024, 3, 10, 2, 30), D(2024, 3, 10, 3, 30), D(1969, 12, 31, 23, 59), None]
    assert got[1].x - got[0].x == 120 and got[2].x == -1


def test_accuracy_and_confusion(spark):
    preds = spark.createDataFrame([("1", "BUY"), ("2", "BUY"), ("3", "HOLD"), ("9", "SELL")], "article_id string, signal string")
    real = spark.createDataFrame([("1", 1, "SELL"), ("1", 2, "BUY"), ("2", 1, "SELL"), ("3", 1, "HOLD")], "article_id string, seq int, label string")
    pairs = evaluate.matched(preds, real, ["article_id"], "seq", "signal", "label")
    got = {r.scope: r for r in evaluate.accuracy_report(pairs).collect()}
    assert (got["ALL"].n_correct, got["ALL"].n_predicted, got["ALL"].precision_pct) == (2, 3, 66.67)
    assert got["SELL"].precision_pct is None and got["BUY"].precision_pct == 50.0
    m = evaluate.confusion_metrics(pairs).first()
    assert m.accuracy == 0.6667 and m.sell_recall == 0.0 and m.buy_recall == 1.0 and m.sell_as_buy == 1
    assert m.macro_f1 == round((2 / 3 + 0 + 1) / 3, 4)


def test_dates_outside_the_table_are_computed(spark):
    df = spark.sql("SELECT * FROM VALUES (date'1985-01-06'), (date'1985-01-07'), (date'2100-01-04') t(event_date)")
    got = {str(r.event_date): r for r in calendar.with_sessions(df, calendar.calendar_table(spark)).collect()}
    assert got["1985-01-06"].reason == "Weekend (Sunday)" and str(got["1985-01-06"].prev_session) == "1985-01-04"
    assert got["1985-01-07"].is_trading and str(got["2100-01-04"].next_session) == "2100-01-05"


def test_times_of_one_row_group_are_read_by_many_tasks(spark, tmp_path):
    """A file of many splits whose rows are one row group: the parsers' work is dealt out all the same."""
    from eventide.plans import Tables, load_all

    rows = spark.range(0, 4000, 1, 1).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 10:00:00' + make_dt_interval(0, 0, id, 0) AS ts")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in held:
            spark.conf.set(k, "1000")
        out = load_all()["parse_times"].build(Tables(spark, str(tmp_path)))
        per_task = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sum(per_task) == 32_000 and max(per_task) < 32_000 / 8


def test_marks_of_the_pipe_form_and_blanks_of_the_iso_form(spark):
    texts = ["10:20:30 AM | 05 Jan 2024", "10:20 AM | 5 Jan 2024", "10:20 AM | 5 Jan 2024 |", "| 10:20 AM | 5 Jan 2024", "|", "10 AM | 5 Jan 2024", "1:2:3:4 AM | 5 Jan 2024",
             "2024-01-05T10:20:30Z", "2024-01-05 10:20:30+05:30 IST", "2024-01-05T10:20 x:", " 10:20 AM|5 Jan 2024 "]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(timeparse.published_local(F.col("t")).cast("string").alias("x"))
    first, second = "2024-01-05 10:20:30", "2024-01-05 10:20:00"
    assert [r.x for r in df.collect()] == [first, second, None, None, None, None, None, None, first, None, second]
