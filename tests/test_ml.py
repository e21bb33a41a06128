import pytest
from pyspark.sql import functions as F

from eventide.operators import features, ml
from eventide.plans.learning import model_columns


def test_sixty_two_features_and_no_leak():
    names = features.model_features()
    assert len(names) == len(set(names)) == 62
    assert not [n for n in names + model_columns() if n.startswith(("post_", "return_", "price_after"))]


def test_post_event_columns_are_refused(spark):
    with pytest.raises(ValueError):
        ml.feature_vector(spark.range(1), ["post_close_15m"])


def test_chronological_split_is_exact(spark):
    df = spark.range(1003).select("id", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(id div 3 as int) * 97)").alias("ts"))
    got = ml.chronological_split(df.repartition(7), "ts", ["id"]).collect()
    assert len(got) == 1003 and {r.id for r in got if r.is_train} == set(range(802))
    approx = ml.approximate_split(df, "ts").filter("is_train").count()
    assert abs(approx - 802) < 20


def test_chronological_split_with_one_hot_second(spark):
    df = spark.range(500).select("id", F.lit("2024-01-01 00:00:01").cast("timestamp_ntz").alias("ts"))
    got = ml.chronological_split(df, "ts", ["id"]).filter("is_train").collect()
    assert {r.id for r in got} == set(range(400))
    one = ml.chronological_split(df.filter("id = 7"), "ts", ["id"]).collect()
    assert [r.is_train for r in one] == [False]


def test_chronological_split_of_a_hot_second_is_one_scan(spark, tmp_path):
    """A third of all rows in one second, most of them in one microsecond, nulls among the order columns."""
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(secs=F.when(F.col("id") % 3 == 0, 5000).otherwise(F.col("id") * 5).cast("decimal(18,6)"))
    rows = spark.range(3000).select("id", F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("name"), at.cast("timestamp_ntz").alias("ts"))
    rows.repartition(6).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    want = {r.id for r in sorted(df.collect(), key=lambda r: (r.ts, r.name is not None, r.name or "", r.id))[: int(3000 * 0.4)]}
    out = ml.chronological_split(df, "ts", ["name", "id"], share=0.4)
    assert {r.id for r in out.collect() if r.is_train} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Join" not in plan
    assert {r.is_train for r in ml.chronological_split(df.limit(0), "ts", ["id"]).collect()} == set()


def test_boosted_trees_learn_three_classes(spark, tmp_path):
    rows = spark.range(300).select("id", (F.col("id") % 3).cast("double").alias("a"), F.rand(1).alias("b"), F.get(F.array(*[F.lit(c) for c in ("BUY", "SELL", "HOLD")]), (F.col("id") % 3).cast("int")).alias("label"))
    model = ml.train_boosted_model(rows, ["a", "b"], rounds=3, depth=2)
    model.write().overwrite().save(str(tmp_path / "m"))
    out = ml.score_boosted(ml.PipelineModel.load(str(tmp_path / "m")), rows, ["a", "b"]).collect()
    assert all(r.predicted_signal == r.label for r in out)
    assert all(abs(r.buy_prob + r.sell_prob + r.hold_prob - 1) < 0.001 for r in out)


def test_historic_job_from_files_to_a_stored_run(spark, tmp_path):
    import json

    from pyspark.sql import types as T

    from eventide.sources import readers

    schema = T.StructType()
    for name, kind in {"article_id": "string", "symbols": "string", "headline": "string", "published_time": "string", "is_regulatory_news": "integer", "is_negative_event": "integer",
                       "company_mentioned_count": "integer", "open_at_signal": "double", "close_15min": "double", "high_15min": "double", "low_15min": "double", "close_-15min": "double"}.items():
        schema = schema.add(name, kind)
    moves = (101.0, 99.0, 100.1)
    made = [{"article_id": str(i), "symbols": "A", "headline": "h", "published_time": "t", "company_mentioned_count": i % 3, "open_at_signal": 100.0,
             "close_15min": moves[i % 3], "close_-15min": moves[i % 3]} for i in range(150)]
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(made[i * 50 : i * 50 + 50]))
    (tmp_path / "in" / "bad.json").write_text("[{")
    raw, bad = readers.json_arrays(spark, str(tmp_path / "in"), schema)
    assert bad.count() == 1
    names, where = ["company_mention_strength", "pre_close_15m", "confidence"], (str(tmp_path / "models"), str(tmp_path / "runs"))
    assert ml.train_historic(raw.limit(99), names, "v0", *where) == (False, "insufficient_data")
    assert ml.train_historic(raw, names, "v1", *where, trees=5, depth=3) == (True, "success")
    version, model = ml.deployed_model(spark, *where)
    run = spark.read.parquet(where[1]).first()
    assert (version, run.data_source, run.training_rows) == ("v1", "historic", 150) and run.validation_metrics.accuracy > 0.9
    # The stored pipeline takes plain rows: text, NaN and null features are its own business.
    rows = spark.createDataFrame([("1", 99.0, None), ("x", float("nan"), "y")], "company_mention_strength string, pre_close_15m double, confidence string")
    assert [r.prediction for r in model.transform(rows).collect()][0] == 1.0


def test_retrain_gate(spark):
    few = spark.range(10).select(F.lit("BUY").alias("label"))
    assert ml.retrain(few, [], "ts", [], "v")[2] == "insufficient_data"


def test_stratified_split_repeats(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 3 == 0, "BUY").otherwise("HOLD").alias("label"))
    a = ml.stratified_split(df, "k", "label").filter("is_train")
    b = ml.stratified_split(df.repartition(5), "k", "label").filter("is_train")
    assert a.exceptAll(b).count() == 0
    share = {r.label: r.n for r in a.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert abs(share["BUY"] / 1667 - 0.8) < 0.05 and abs(share["HOLD"] / 3333 - 0.8) < 0.05


def test_train_score_and_run(spark, tmp_path):
    df = spark.range(600).select(
        F.col("id"),
        ((F.col("id") * 37 % 101) / 101.0).alias("pre_a"),
        F.when(F.col("id") % 50 == 0, float("nan")).otherwise((F.col("id") % 7) * 1.0).alias("pre_b"),
    )
    df = df.withColumn("label", F.when(F.col("pre_a") > 0.66, "BUY").when(F.col("pre_a") < 0.33, "SELL").otherwise("HOLD"))
    cols = ["pre_a", "pre_b"]
    model = ml.train_reaction_model(df, cols, trees=10, depth=4)
    m = ml.holdout_metrics(model, df, cols)
    assert m.first().accuracy > 0.95
    assert ml.score_reaction(model, df, cols).count() == 588  # rows with NaN are not scored
    assert ml.score_reaction(model, df, cols, null_policy="impute").count() == 600
    run = ml.model_run(m, df, "20260101_0000", "live", previous={"accuracy": 1.1, "macro_f1": 1.1})
    ml.save_run(model, run, str(tmp_path / "m"), str(tmp_path / "runs"), "20260101_0000")
    better = ml.model_run(m, df, "20260102_0000", "live", previous=None)
    ml.save_run(model, better, str(tmp_path / "m"), str(tmp_path / "runs"), "20260102_0000")
    last = ml.latest_run(spark.read.parquet(str(tmp_path / "runs"))).first()
    version, loaded = ml.deployed_model(spark, str(tmp_path / "m"), str(tmp_path / "runs"))
    assert version == "20260102_0000" and ml.score_reaction(loaded, df, cols).count() == 588
    assert last.model_version == "20260102_0000" and len(last.validation_metrics.confusion_matrix) == 3


def test_deploy_gate():
    now = {"accuracy": 0.6, "macro_f1": 0.5}
    assert ml.should_deploy(now, None) and ml.should_deploy(now, {"accuracy": 0.6, "macro_f1": 0.9})
    assert not ml.should_deploy(now, {"accuracy": 0.7, "macro_f1": 0.6})
    assert ml.should_deploy(now, {"accuracy": 0.7, "macro_f1": 0.6}, force=True)


def test_latest_run_reads_numbers_in_versions(spark):
    same = "timestamp'2026-01-01 00:00:00' as trained_at"
    runs = spark.createDataFrame([("v9", True), ("v10", True), ("v11", False)], "model_version string, deployed boolean").selectExpr("*", same)
    assert ml.latest_run(runs).first().model_version == "v10"
    later = runs.unionByName(spark.sql("select 'v2' as model_version, true as deployed, timestamp'2026-02-01 00:00:00' as trained_at"))
    assert ml.latest_run(later).first().model_version == "v2"


def test_sentiment_model(spark):
    rows = [("up gain profit strong", "positive"), ("loss fraud fall weak", "negative"), ("meeting held monday plain", "neutral")] * 10
    df = spark.createDataFrame(rows, "condensed_text string, sentiment string")
    model = ml.train_sentiment(df, buckets=256, iterations=20)
    out = ml.score_sentiment(model, spark.createDataFrame([("profit gain",), ("fraud loss",), (" ",)], "condensed_text string")).collect()
    assert [r.sentiment for r in out] == ["positive", "negative"]
    assert abs(out[0].positive_prob + out[0].negative_prob + out[0].neutral_prob - 1) < 1e-9


def test_historic_rows(spark):
    schema = (
        "article_id string, symbols string, headline string, published_time string, is_regulatory_news int, is_negative_event int, "
        "company_mentioned_count int, open_at_signal double, close_15min double, high_15min double, low_15min double, "
        "`close_-15min` double, volatility_15min_pre_news double"
    )
    df = spark.createDataFrame(
        [("1", "A", "h", "t", 0, 1, 2, 100.0, 100.5, 101.0, 99.0, 90.0, 0.3), ("2", "A", "h", "t", 0, 0, 0, 0.0, 1.0, 1.0, 1.0, 1.0, 0.1), ("3", "A", "", "t", 0, 0, 0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.1)],
        schema,
    )
    rows = ml.historic_rows(df).collect()
    assert len(rows) == 1
    r = rows[0]
    # The look-back comes from the column before the event, never from the one after it.
    assert (r.pre_close_15m, r.return_15m, r.label, r.volatility_15m, r.pre_volatility_15m, r.pre_volatility_1m) == (90.0, 0.5, "BUY", 2.0, 0.3, None)
    assert set(features.model_features()) - set(ml.historic_rows(df).columns) == {"sentiment_score", "confidence", "positive_prob", "negative_prob", "neutral_prob"}


def test_fits_read_as_many_parts_as_there_are_cores(spark, monkeypatch):
    """Rows that lie in one part, as a small stored table does, are dealt out before a fit."""

    class Seen:
        def __init__(self, stages):
            pass

        def fit(self, rows):
            return rows.rdd.getNumPartitions()

    monkeypatch.setattr(ml, "Pipeline", Seen)
    label = F.element_at(F.array(*[F.lit(c) for c in ("BUY", "SELL", "HOLD")]), (F.col("id") % 3 + 1).cast("int"))
    rows = spark.range(0, 90, 1, 1).select(label.alias("label"), F.col("id").cast("double").alias("f"))
    cores = spark.sparkContext.defaultParallelism
    assert ml.train_reaction_model(rows, ["f"]) == ml.train_boosted_model(rows, ["f"]) == cores > 1
