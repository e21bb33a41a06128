import datetime as dt
import os
import random

from pyspark.sql import functions as F

from eventide.operators import bars
from eventide.operators import ml
from eventide.operators.features import TEXT_FEATURES
from eventide.sources.tables import KeyedTable, KeySet
from eventide.streaming import jobs
from eventide.streaming.offhours import OffHours, bias_signals
from eventide.streaming.pipeline import NewsPipeline

T0 = dt.datetime(2024, 1, 3, 9, 15)
TICK = "symbol string, trade_date date, ts timestamp_ntz, event_id bigint, price double, qty int"


def tick(sym, sec, i, p):
    return (sym, T0.date(), T0 + dt.timedelta(seconds=sec), i, p, 1)


def files(spark, folder, parts, schema):
    """One Parquet file per part; modification times give their order."""
    known = set()
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        for name in set(os.listdir(folder)) - known:
            os.utime(os.path.join(folder, name), (1_700_000_000 + i * 10,) * 2)
            known.add(name)


def test_hv_over_many_batches_equals_batch(spark, tmp_path):
    rnd = random.Random(2)
    rows = [tick("AB"[i % 5 == 0], i * 3, i, round(rnd.uniform(10, 20), 2)) for i in range(400)]
    files(spark, tmp_path / "in", [rows[:30], rows[30:150], rows[150:151], rows[151:]], TICK)
    src = jobs.file_stream(spark, str(tmp_path / "in"), "*.parquet", spark.createDataFrame([], TICK).schema, max_files=1)
    jobs.run_batches(src, jobs.hv_into(spark, str(tmp_path / "s")), str(tmp_path / "log")).awaitTermination()
    got = {r.event_id: round(r.hv, 6) for r in spark.read.parquet(str(tmp_path / "s" / "hv")).collect()}
    want = {r.event_id: round(r.hv, 6) for r in bars.rolling_hv(spark.createDataFrame(rows, TICK), seq="event_id").collect()}
    assert spark.read.parquet(str(tmp_path / "s" / "hv")).select("batch").distinct().count() == 4
    assert got == want


def test_dedup_over_batches(spark, tmp_path):
    schema = "article_id string, n int"
    files(spark, tmp_path / "in", [[("1", 1), ("1", 2), ("2", 3)], [("1", 4), ("3", 5), (None, 6)], [(None, 7)]], schema)
    src = jobs.file_stream(spark, str(tmp_path / "in"), "*.parquet", spark.createDataFrame([], schema).schema, max_files=1)
    table = KeyedTable(spark, str(tmp_path / "out"), ["article_id"])
    jobs.run_batches(src, jobs.dedup_into(table, ["n"]), str(tmp_path / "log")).awaitTermination()
    assert sorted(r.n for r in table.read().collect()) == [1, 3, 5, 6]


def test_candles_close_by_watermark_and_drop_late_ticks(spark, tmp_path):
    parts = [
        [tick("A", 10, 1, 10.0), tick("A", 50, 2, 12.0)],
        [tick("A", 61, 3, 11.0), tick("A", 59, 4, 9.0), tick("A", 200, 5, 8.0)],  # one minute back, within the open candle
        [tick("A", 210, 6, 8.5)],
        [tick("A", 30, 7, 99.0), tick("A", 400, 8, 7.0)],  # its candle was emitted: dropped
    ]
    files(spark, tmp_path / "in", parts, TICK)
    src = jobs.file_stream(spark, str(tmp_path / "in"), "*.parquet", spark.createDataFrame([], TICK).schema, max_files=1)
    jobs.run_available(jobs.candles(src, seq="event_id"), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = {r.ts: (r.open, r.high, r.low, r.close, r.volume) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    m = [T0 + dt.timedelta(minutes=i) for i in range(7)]
    assert got == {m[0]: (10.0, 12.0, 9.0, 9.0, 3), m[1]: (11.0,) * 4 + (1,), m[3]: (8.0, 8.5, 8.0, 8.5, 2)}


def test_hv_of_late_and_unordered_ticks_equals_batch(spark, tmp_path):
    rnd = random.Random(4)
    rows = [tick("AB"[i % 3 == 0], i * 3, i, round(rnd.uniform(10, 20), 2)) for i in range(300)]
    shuffled = sorted(rows, key=lambda r: r[2] + dt.timedelta(seconds=rnd.randrange(100)))
    late = tick("A", 0, 999, 1.0)
    parts = [shuffled[:80], shuffled[80:81], [], shuffled[81:200], [*shuffled[200:], late]]
    hv = jobs.HvStream(spark, str(tmp_path / "s"), lateness=100)
    for i, part in enumerate([*parts, parts[-1]]):  # the last batch is replayed
        hv.step(spark.createDataFrame(part, TICK), min(i, 4))
    hv.flush(spark.createDataFrame([], TICK), 5)
    got = {r.event_id: round(r.hv, 6) for r in spark.read.parquet(str(tmp_path / "s" / "hv")).collect()}
    want = {r.event_id: round(r.hv, 6) for r in bars.rolling_hv(spark.createDataFrame(rows, TICK), seq="event_id").collect()}
    assert got == want
    assert [r.event_id for r in hv.order.late().collect()] == [999]


def test_closed_minutes_are_counted(spark, tmp_path):
    stream = jobs.CandleStream(spark, str(tmp_path / "c"), seq="event_id")
    parts = [[tick("A", 10, 1, 5.0), tick("A", 61, 2, 6.0)], [tick("A", 59, 3, 7.0), tick("A", 125, 4, 8.0)], [tick("A", 30, 5, 99.0), tick("B", 40, 6, 98.0), tick("A", 300, 7, 9.0)]]
    for i, part in enumerate(parts):
        stream.step(spark.createDataFrame(part, TICK), i)
    got = {r.ts: (r.open, r.close, r.n_ticks) for r in spark.read.parquet(str(tmp_path / "c" / "out")).collect()}
    m = [T0 + dt.timedelta(minutes=i) for i in range(6)]
    assert got == {m[0]: (5.0, 7.0, 2), m[1]: (6.0, 6.0, 1), m[2]: (8.0, 8.0, 1)}
    assert sorted(r.event_id for r in stream.order.late().collect()) == [5, 6]
    assert [(r.ts, r.n_ticks) for r in stream.open_candles(spark.createDataFrame([], TICK)).collect()] == [(m[5], 1)]


def test_off_hours_rows_wait_and_are_scored_once(spark, tmp_path):
    schema = "id string, at timestamp_ntz, sentiment string, confidence double"

    def row(key, hour, minute=0, day=3):
        return (key, dt.datetime(2024, 1, day, hour, minute), "positive", 0.8)

    nights = OffHours(spark, str(tmp_path), ["id"], "at")

    def scored(rows, batch):
        return sorted(r.id for r in nights.step(spark.createDataFrame(rows, schema), batch).collect())

    def waiting():
        return sorted(r.id for r in nights.pending().collect())

    assert scored([row("a", 8), row("b", 9)], 0) == [] and waiting() == ["a", "b"]
    # One batch with both kinds: what an open moment follows goes, what comes after it waits.
    second = [row("c", 9, 29), row("d", 9, 30), row("e", 15, 30), row("f", 15, 31)]
    assert scored(second, 1) == ["a", "b", "c", "d", "e"] and waiting() == ["f"]
    assert scored(second, 1) == ["a", "b", "c", "d", "e"] and waiting() == ["f"]  # replayed: neither lost nor doubled
    assert scored([row("f", 20)], 2) == [] and waiting() == ["f"]
    seen = spark.createDataFrame([(dt.datetime(2024, 1, 4, 10),)], "at timestamp_ntz")
    assert [(r.id, r.at.hour) for r in nights.step(None, 3, seen).collect()] == [("f", 20)]
    assert waiting() == [] and scored([row("g", 10, day=4)], 4) == ["g"]
    shown = bias_signals(spark.createDataFrame([row("h", 20)], schema), "at").first()
    assert (shown.predicted_signal, shown.buy_prob, shown.sell_prob, shown.predicted_at) == ("BULLISH", 0.8, 0.0, "2024-01-03 20:00:00 IST")


def test_known_keys_are_read_by_prefix(spark, tmp_path):
    known = KeySet(spark, str(tmp_path / "k"), ["a", "b"], prefixes=8)
    schema = "a string, b int, n int"
    first = [(str(i), i % 3, i) for i in range(200)] + [(None, None, 1), (None, None, 2)]
    assert known.add_unseen(spark.createDataFrame(first, schema), 0, ["n"]).count() == 201
    batch = spark.createDataFrame([("1", 1, 7), ("1", 2, 8), (None, None, 9)], schema)
    for _ in range(2):  # replayed
        assert sorted(r.n for r in known.add_unseen(batch, 1).collect()) == [8]
    wanted = {r.prefix for r in known._placed(batch).select("prefix").collect()}
    held = known.known(sorted(wanted), 1)
    assert held.count() < 200
    scan = held.select("a")
    scan.collect()
    leaves = scan._jdf.queryExecution().executedPlan().collectLeaves()
    assert leaves.head().metrics().apply("numFiles").value() == len(wanted) < len(known.table.read(1).inputFiles())
    small = known.compact(str(tmp_path / "k2"))
    assert small.table.read().count() == 202 and len(small.table.read().inputFiles()) <= 8
    assert small.add_unseen(batch, 2).count() == 0


def test_bounded_dedup(spark, tmp_path):
    files(spark, tmp_path / "in", [[tick("A", 0, 1, 1.0), tick("A", 5, 2, 2.0), tick("B", 6, 3, 1.0)]], TICK)
    src = jobs.file_stream(spark, str(tmp_path / "in"), "*.parquet", spark.createDataFrame([], TICK).schema)
    jobs.run_available(jobs.dedup_within(src, ["symbol"], "ts", "10 minutes"), str(tmp_path / "o"), str(tmp_path / "l")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2


def test_late_rule(spark):
    def row(t, a):
        return (T0 + dt.timedelta(seconds=t), T0 + dt.timedelta(seconds=a))

    df = spark.createDataFrame([row(10, 50), row(59, 62), row(59, 63), row(59, 121), row(60, 59)], "t timestamp_ntz, a timestamp_ntz")
    assert [r[0] for r in df.select(jobs.tick_accepted(F.col("t"), F.col("a"))).collect()] == [True, True, False, False, False]


def test_pipeline_is_replayable(spark, tmp_path):
    mapping = spark.createDataFrame([(0, "Acme Steel Works", "ACME", "S", "I", "acme steel")], "_row int, CompanyName string, Symbol string, Sector string, Index string, Keyword string")
    day = dt.date(2026, 1, 23)
    rows = [("ACME", day, dt.datetime(2026, 1, 23, 9, 15) + dt.timedelta(minutes=i), 100.0 + i, 101.0 + i, 99.0 + i, 100.5 + i, 10) for i in range(120)]
    bars_df = spark.createDataFrame(rows, "symbol string, trade_date date, ts timestamp_ntz, open double, high double, low double, close double, volume bigint")
    art = "article_id string, headline string, content string, url string, published_time string, scraped_at string, source string"
    first = spark.createDataFrame(
        [("1", "Acme Steel posts profit", "acme steel grew.", "u1", "2026-01-23 10:05:00", "2026-01-23 10:06:00", "LiveMint"),
         ("1", "Acme Steel posts profit", "copy", "u1", "2026-01-23 10:05:00", "2026-01-23 10:07:00", "LiveMint"),
         ("2", "Nothing to tag", "x", "u2", "2026-01-23 10:05:00", "2026-01-23 10:06:00", "LiveMint")], art)
    second = spark.createDataFrame(
        [("1", "Acme Steel posts profit", "again", "u1", "2026-01-23 10:05:00", "2026-01-23 11:06:00", "LiveMint"),
         ("3", "Acme Steel wins order", "acme steel.", "u3", "2026-01-24 10:05:00", "2026-01-24 10:06:00", "LiveMint")], art)

    def scorer(df):
        probs = {"positive_prob": 0.7, "negative_prob": 0.1, "neutral_prob": 0.2, "confidence": 0.7}
        return df.withColumns({k: F.lit(v) for k, v in probs.items()}).withColumn("sentiment", F.lit("positive"))

    def predictor(df):
        return df.select("article_id", "symbol", "condensed_text", F.col("content").alias("full_content"), "url", "source", F.lit("BUY").alias("predicted_signal"))

    pipe = NewsPipeline(spark, str(tmp_path / "p"), mapping, bars_df, scorer, predictor, as_of=F.lit("2026-01-23 10:20:00").cast("timestamp_ntz"))

    def state():
        return {n: sorted(map(repr, pipe.table(n, "article_id").read().collect())) for n in ("articles", "tags", "sentiment", "labels", "signals")}

    pipe.step(first, 0)
    pipe.step(second, 1)
    once = state()
    pipe.step(second, 1)
    assert state() == once
    got = {r.article_id: r for r in pipe.table("labels", "article_id").read().collect()}
    assert set(got) == {"1", "3"} and got["1"].label == "BUY" and got["1"].pre_close_5m == 145.5
    # The Saturday article counts back from the last bar of Friday and has no reaction window.
    assert str(got["3"].trade_date if "trade_date" in got["3"] else got["3"].event_date)
    assert got["3"].label_reason == "missing_return" and got["3"].close_at_signal == 219.5 and got["3"].pre_close_10m == 209.5
    assert {r.article_id for r in pipe.signals().collect()} == {"1", "3"}
    empty = spark.createDataFrame([], art)
    pipe.step(empty, 2)


def test_pipeline_waits_trains_and_scores(spark, tmp_path):
    """Closed, open and replayed batches through labels, training and the deployed model."""
    mapping = spark.createDataFrame([(0, "Acme Steel Works", "ACME", "S", "I", "acme steel")], "_row int, CompanyName string, Symbol string, Sector string, Index string, Keyword string")
    day = dt.date(2026, 1, 23)
    rows = [("ACME", day, dt.datetime(2026, 1, 23, 9, 15) + dt.timedelta(minutes=i), 100.0 + i, 101.0 + i, 99.0 + i, 100.5 + i, 10) for i in range(300)]
    bars_df = spark.createDataFrame(rows, "symbol string, trade_date date, ts timestamp_ntz, open double, high double, low double, close double, volume bigint")
    art = "article_id string, headline string, content string, url string, published_time string, scraped_at string, source string"

    def article(key, published, scraped):
        return (key, "Acme Steel posts profit", "acme steel grew.", f"u{key}", f"2026-01-23 {published}", f"2026-01-23 {scraped}", "LiveMint")

    def scorer(df):
        probs = {"positive_prob": 0.7, "negative_prob": 0.1, "neutral_prob": 0.2, "confidence": 0.7}
        return df.withColumns({k: F.lit(v) for k, v in probs.items()}).withColumn("sentiment", F.lit("positive"))

    names = [c for c in TEXT_FEATURES if c != "time_decay_15m"]
    pipe = NewsPipeline(spark, str(tmp_path / "p"), mapping, bars_df, scorer)
    pipe.predictor = pipe.model_predictor(names)
    history = [article(f"h{i}", f"10:{i:02d}:00", f"10:{i:02d}:30") for i in range(30)]
    pipe.step(spark.createDataFrame(history, art), 0)
    assert pipe.signals().count() == 0  # no model yet
    assert pipe.train("v0", names, min_rows=500) == (False, "insufficient_data")
    assert pipe.train("v1", names, min_rows=10, trees=3, depth=2) == (True, "success")
    closed = spark.createDataFrame([article("n1", "08:00:00", "08:01:00"), article("n2", "16:00:00", "16:01:00")], art)
    pipe.step(closed, 1)
    # 08:01 lies before open moments the pipeline has seen; 16:01 waits with a bias.
    assert {r.article_id for r in pipe.signals().collect()} == {"n1"}
    night = pipe.overnight().collect()
    assert [(r.article_id, r.predicted_signal, r.full_content, r.url) for r in night] == [("n2", "BULLISH", "acme steel grew.", "un2")]
    opened = spark.createDataFrame([("x", "Nothing to tag", "x", "u", "2026-01-24 10:05:00", "2026-01-24 10:06:00", "LiveMint")], art)
    for _ in range(2):
        pipe.step(opened, 2)
        got = {r.article_id: r for r in pipe.signals().collect()}
        assert set(got) == {"n1", "n2"} and pipe.overnight().count() == 0
    one = got["n2"]
    assert (one.model_version, one.source, one.full_content, one.predicted_at) == ("v1", "LiveMint", "acme steel grew.", "2026-01-23 16:01:00 IST")
    assert abs(one.buy_prob + one.sell_prob + one.hold_prob - 1) < 0.001
    assert pipe.skipped(["confidence", "pre_volatility_30m"]).filter("skip_reason = 'missing_features'").first().missing == ["pre_volatility_30m"]
