
from pyspark.sql import functions as F

from eventide.operators import labels, state
from eventide.sources.tables import KeyedTable


def frame(spark, rows, schema="article_id string, symbol string, seq int, v string"):
    return spark.createDataFrame(rows, schema)


def test_first_per_key_treats_null_as_one_key(spark):
    df = frame(spark, [(None, "A", 2, "x"), (None, "B", 1, "y"), ("1", "A", 3, "z")])
    got = {(r.article_id, r.v) for r in state.first_per_key(df, ["article_id"], ["seq"]).collect()}
    assert got == {(None, "y"), ("1", "z")}


def test_ranked_filter_is_limited_before_the_shuffle(spark):
    df = frame(spark, [("1", "A", 1, "x")])
    plan = state.first_per_key(df, ["article_id"], ["seq"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_unseen_is_null_safe_and_keeps_batch_duplicates(spark):
    held = frame(spark, [("1", None, 0, "old"), (None, None, 0, "old")])
    batch = frame(spark, [("1", None, 1, "a"), (None, None, 2, "b"), ("2", "A", 3, "c"), ("2", "A", 4, "d")])
    keys = ["article_id", "symbol"]
    assert sorted(r.v for r in state.unseen(batch, held, keys).collect()) == ["c", "d"]
    assert [r.v for r in state.unseen(batch, held, keys, ["seq"]).collect()] == ["c"]


def test_and_or_rules(spark):
    held = spark.createDataFrame([("u1", "1"), ("u2", "2")], "url string, article_id string")
    batch = spark.createDataFrame(
        [("u1", "2"), ("u1", "9"), ("u9", "1"), ("u9", "9")], "url string, article_id string"
    )
    kept = {r.url + r.article_id for r in state.drop_known(batch, held).collect()}
    assert kept == {"u19", "u91", "u99"}  # (u1, 2) is known from two different rows
    assert {r.url + r.article_id for r in state.drop_known(batch, held, rule="or").collect()} == {"u99"}


def test_upsert(spark):
    held = spark.createDataFrame([("1", "A", "keep", "s1"), ("2", "B", "old", "s2")], "article_id string, symbol string, v string, source string")
    batch = frame(spark, [("2", "B", 1, "mid"), ("2", "B", 2, None), ("3", None, 1, "new")])
    out = state.upsert(held, batch, ["article_id", "symbol"], [F.col("seq").desc()])
    got = {r.article_id: (r.v, r.source, r.change) for r in out.collect()}
    assert got == {"1": ("keep", "s1", "keep"), "2": (None, "s2", "update"), "3": ("new", None, "insert")}
    again = state.upsert(out.drop("change"), batch, ["article_id", "symbol"], [F.col("seq").desc()])
    assert {r.article_id: r.v for r in again.collect()} == {"1": "keep", "2": None, "3": "new"}


def test_priority_lookup_chooses_whole_rows(spark):
    a = spark.createDataFrame([("1", 1, None, "a-text"), ("1", 2, None, "a-last")], "article_id string, seq int, url string, content string")
    b = spark.createDataFrame([("1", 9, "b-url", "b"), ("2", 9, "b-url", "b2")], a.schema)
    got = {r.article_id: (r.url, r.content) for r in state.priority_lookup([a, b], "article_id", "seq").collect()}
    assert got == {"1": (None, "a-last"), "2": ("b-url", "b2")}


def test_repair(spark):
    schema = "article_id string, source string, full_content string, condensed_text string, url string"
    signals = spark.createDataFrame(
        [("1", "Unknown", "short", "short", ""), ("2", "S", "full", "short", "u"), ("3", None, None, None, None)], schema
    )
    raw = spark.createDataFrame([("1", "Src", "long", "raw-url"), ("2", "X", "Y", "Z")], "article_id string, source string, content string, url string")
    got = {r.article_id: r for r in state.repair(signals, raw).collect()}
    assert (got["1"].source, got["1"].full_content, got["1"].url, got["1"].repaired) == ("Src", "long", "raw-url", True)
    assert (got["2"].source, got["2"].full_content, got["2"].url, got["2"].repaired) == ("S", "full", "u", False)
    assert got["3"].source is None and not got["3"].repaired


def test_buffer_is_filled_when_closed_and_released_when_open(spark):
    old, new = frame(spark, [("1", "A", 1, "old")]), frame(spark, [("1", "A", 2, "upd"), ("2", "B", 1, "new")])
    score, kept = state.buffer_or_release(new, old, is_open=False)
    assert score.count() == 0 and sorted(r.v for r in kept.collect()) == ["new", "upd"]
    score, left = state.buffer_or_release(new, kept, is_open=True)
    assert score.count() == 4 and left.count() == 0


def test_keyed_table_replay_changes_nothing(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["article_id"])
    first = frame(spark, [("1", "A", 1, "a"), ("1", "A", 2, "b")])
    second = frame(spark, [("1", "A", 3, "c"), ("2", "B", 4, "d")])
    assert table.read() is None
    assert table.append_unseen(first, 0, ["seq"]).count() == 1
    for _ in range(2):
        assert [r.v for r in table.append_unseen(second, 1, ["seq"]).collect()] == ["d"]
    assert sorted(r.v for r in table.read().collect()) == ["a", "d"]
    up = KeyedTable(spark, str(tmp_path / "u"), ["article_id"])
    up.upsert(first, 0, [F.col("seq").desc()])
    up.upsert(second, 1)
    assert {r.article_id: r.v for r in up.latest().collect()} == {"1": "c", "2": "d"}


def test_label_edges(spark):
    df = spark.createDataFrame([(0.15,), (-0.15,), (0.1499,), (None,), (0.0,)], "ret double")
    out = df.select("ret", *[c.alias(n) for n, c in labels.label_return(F.col("ret")).items()]).collect()
    assert [r.label for r in out] == ["BUY", "SELL", "HOLD", "HOLD", "HOLD"]
    assert [r.label_reason for r in out] == ["price_up_15m", "price_down_15m", "flat_move", "missing_return", "flat_move"]
    assert out[3].label_strength == 0.0


def test_gate_edge_and_ties(spark):
    df = spark.createDataFrame([(0.3999, 0.3, 0.3001), (0.40, 0.3, 0.3), (0.4, 0.4, 0.2)], "b double, s double, h double")
    out = df.select(*[c.alias(n) for n, c in labels.gated_signal([F.col("b"), F.col("s"), F.col("h")]).items()]).collect()
    assert [r.predicted_signal for r in out] == ["HOLD", "BUY", "BUY"]
    assert out[0].signal_confidence == 0.3999


def test_class_weights(spark):
    df = spark.createDataFrame([("BUY",)] * 1 + [("SELL",)] * 2 + [("HOLD",)] * 6 + [("?",)], "label string")
    got = {r.label: r.weight for r in labels.class_weights(df, "label").collect()}
    assert got == {"BUY": 9 / 3 * 1.5, "SELL": 9 / 6 * 1.5, "HOLD": 0.5}


def test_upsert_keeps_what_a_batch_lacks_and_takes_its_nulls(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "merge"), ["id"])
    table.upsert(spark.createDataFrame([("a", "u", "BUY"), ("b", "v", "SELL")], "id string, url string, signal string"), 0)
    table.upsert(spark.createDataFrame([("a", "HOLD", 1)], "id string, signal string, extra int"), 1)
    table.upsert(spark.createDataFrame([("b", None)], "id string, url string"), 2)
    got = {r.id: (r.url, r.signal, r.extra) for r in table.latest().collect()}
    assert got == {"a": ("u", "HOLD", 1), "b": (None, "SELL", None)}


def test_snapshots_bound_what_is_read(spark, tmp_path):
    table = tables_of(spark, tmp_path)
    for i in range(4):
        table.upsert(spark.createDataFrame([("a", f"u{i}"), (f"k{i}", "v")], "id string, url string"), i)
    table.upsert(spark.createDataFrame([("a", 4)], "id string, n int"), 4)
    whole = sorted(map(repr, table.latest().collect()))
    assert table.snapshot() == 4
    assert sorted(map(repr, table.latest().collect())) == whole
    plan = table.latest()._jdf.queryExecution().optimizedPlan().toString()
    assert "batch" in plan and "> 4" in plan  # folders up to the snapshot are pruned
    table.upsert(spark.createDataFrame([("k1", None), ("z", "w")], "id string, url string"), 5)
    got = {r.id: (r.url, r.n, r.batch) for r in table.latest().collect()}
    assert got["a"] == ("u3", 4, 4) and got["k1"] == (None, None, 5) and got["z"] == ("w", None, 5) and len(got) == 6


def tables_of(spark, tmp_path):
    from eventide.sources.tables import KeyedTable

    return KeyedTable(spark, str(tmp_path / "t"), ["id"])
