"""Three-class models on Spark ML: splits, training, scoring, model runs and the deploy gate."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide.functions import clock, scalars
from eventide.operators import evaluate, labels
from eventide.session import dealt, materialised

# Model shape, row gates and split share.
TREES, DEPTH, ROW_SHARE, SEED = 200, 5, 0.8, 42
MIN_TRAINING_ROWS = 300
MIN_HISTORIC_ROWS = 100
TRAIN_SHARE = 0.8


# --- splits --------------------------------------------------------------------------------


def _reach(rows: DataFrame, bucket: Column, base: int, cut: int | None, share: float = TRAIN_SHARE) -> tuple[int, int, int] | None:
    """(bucket, rows before it, cut): the bucket in which the running count from ``base`` reaches the cut.

    Without a cut it is ``floor(share * n)``. Only counts by bucket are sorted; one row comes back.
    """
    counts = rows.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy(F.lit(1))
    seen = F.sum("n").over(whole.orderBy("b").rowsBetween(W.unboundedPreceding, 0)) + base
    goal = F.floor(F.sum("n").over(whole) * share).cast("long") if cut is None else F.lit(cut)
    found = counts.withColumns({"seen": seen, "goal": goal}).filter(F.col("seen") >= F.col("goal")).orderBy("b").first()
    return found and (found.b, found.seen - found.n, found.goal)


def _literal(value, kind) -> Column:
    """A collected value as a literal of its column's type; times go as text, free of any zone."""
    return F.lit(str(value) if isinstance(value, dt.datetime) else value).cast(kind)


def _kth(ties: DataFrame, order: Sequence[str], k: int) -> list[Column]:
    """The ``order`` values of the k-th row: sorted over all tasks, then found by the counts of the sorted parts."""
    parts = ties.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_ = materialised(parts.select("*", F.spark_partition_id().alias("__part"), inside.alias("__i")), "split-ties")
    part, before, _ = _reach(sorted_, F.col("__part"), 0, k)
    row = sorted_.filter((F.col("__part") == part) & (F.col("__i") == k - before - 1)).select(*order).first()
    return [_literal(row[c], ties.schema[c].dataType) for c in order]


def chronological_split(
    df: DataFrame, ts: str, order: Sequence[str], share: float = TRAIN_SHARE, out: str = "is_train"
) -> DataFrame:
    """Flag the first ``floor(share * n)`` rows in time order, exactly.

    Counts by hour, by second of the hour that holds the cut, and by microsecond of that second select the time
    of the cut; if several rows have it, they alone are sorted by ``order``, over all tasks. The result is
    one scan that compares each row with the cut. Rows equal in time and ``order`` stay on one side. Rows
    without a time are left out. The cut is found when this is called.
    """
    rows = df.filter(F.col(ts).isNotNull())
    at = clock.micros(F.col(ts))
    hour, second = F.floor(at / 3_600_000_000).cast("long"), F.floor(at / 1_000_000).cast("long")
    edge = _reach(rows, hour, 0, None, share)
    if edge is None or edge[2] == 0:
        return rows.withColumn(out, F.lit(False))
    b, base, cut = edge
    b, base, _ = _reach(rows.filter(hour == b), second, base, cut)
    edge, base, _ = _reach(rows.filter(second == b), at, base, cut)
    ties = rows.filter(at == edge)
    if ties.count() == cut - base:
        return rows.withColumn(out, at <= edge)
    last = _kth(ties, order, cut - base)
    upto = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(order)]) <= F.struct(*[v.alias(f"c{i}") for i, v in enumerate(last)])
    return rows.withColumn(out, (at < edge) | (at == edge) & upto)


def approximate_split(df: DataFrame, ts: str, share: float = TRAIN_SHARE, out: str = "is_train") -> DataFrame:
    """Split at an approximate time quantile (one sketch, no sort)."""
    at = clock.micros(F.col(ts))
    return df.withColumn(out, at <= df.agg(F.percentile_approx(at, share)).scalar())


def stratified_split(df: DataFrame, key: str, label: str, share: float = TRAIN_SHARE, seed: int = SEED, out: str = "is_train") -> DataFrame:
    """Random split that is a function of key, class and seed: no shuffle, same result on every run.

    The draw is the first 32 bits of the MD5 of the three, which any other engine can repeat. A
    null key or class counts as empty text.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, label)]
    digest = F.md5(F.concat_ws("|", *parts, F.lit(str(seed))).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / float(1 << 32)
    return df.withColumn(out, draw < share)


# --- boosted-model replacement --------------------------------------------------------------


def feature_vector(df: DataFrame, features: Sequence[str], null_policy: str = "impute") -> DataFrame:
    """Dense vector of the features. ``impute`` turns null, NaN, infinity and text into 0;
    ``drop`` removes such rows, as the scoring step does."""
    if any(f.startswith("post_") or f.startswith("return_") for f in features):
        raise ValueError("post-event columns cannot be features")
    if null_policy == "drop":
        df = df.filter(scalars.all_valid([F.col(f) for f in features]))
    names = [f"__f{i}" for i in range(len(features))]
    wide = df.withColumns({n: scalars.imputed(F.col(f)) for n, f in zip(names, features)})
    return VectorAssembler(inputCols=names, outputCol="features").transform(wide).drop(*names)


def class_index(label: Column, classes: Sequence[str] = labels.CLASSES) -> Column:
    """Class position as double; an unknown class is null."""
    return (F.nullif(F.array_position(F.array(*[F.lit(c) for c in classes]), label), F.lit(0)) - 1).cast("double")


def fit_rows(rows: DataFrame, *targets: str) -> DataFrame:
    """Targets, weight and features, dealt out to all cores: a fit has as many tasks as its input, and a stored
    table of narrow rows has few, however much work they are."""
    return dealt(rows.select(*targets, "weight", "features"), each=1)


def train_reaction_model(rows: DataFrame, features: Sequence[str], trees: int = TREES, depth: int = DEPTH) -> PipelineModel:
    """Weighted three-class forest. Spark ML's boosted trees take two classes only."""
    known = rows.filter(F.col("label").isin(*labels.CLASSES))
    weighted = labels.class_weights(known, "label").withColumn("y", class_index(F.col("label")))
    forest = RandomForestClassifier(
        labelCol="y", weightCol="weight", numTrees=trees, maxDepth=depth, subsamplingRate=ROW_SHARE,
        featureSubsetStrategy="0.8", seed=SEED,
    )
    return Pipeline(stages=[forest]).fit(fit_rows(feature_vector(weighted, features), "y"))


def train_boosted_model(rows: DataFrame, features: Sequence[str], rounds: int = TREES, depth: int = DEPTH, rate: float = 0.1) -> PipelineModel:
    """Weighted boosted trees for three classes: one model a class against the others.

    Spark's boosted trees take two classes, so there are as many as classes, each a stage of one pipeline.
    """
    known = rows.filter(F.col("label").isin(*labels.CLASSES))
    weighted = labels.class_weights(known, "label")
    weighted = weighted.withColumns({f"__is_{c}": (F.col("label") == c).cast("double") for c in labels.CLASSES})
    stages = [
        GBTClassifier(
            labelCol=f"__is_{c}", weightCol="weight", predictionCol=f"__said_{c}",
            maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=ROW_SHARE, seed=SEED,
        ).setRawPredictionCol(f"__raw_{c}").setProbabilityCol(f"__p_{c}")
        for c in labels.CLASSES
    ]
    return Pipeline(stages=stages).fit(fit_rows(feature_vector(weighted, features), *[f"__is_{c}" for c in labels.CLASSES]))


def _signals(out: DataFrame, probs: dict[str, Column]) -> DataFrame:
    """Class probabilities, the gated signal and its confidence."""
    raw = out.withColumns(probs)
    signal = labels.gated_signal([F.col(c) for c in probs])
    return raw.withColumns({**signal, **{c: F.round(c, 4) for c in probs}})


def score_boosted(model: PipelineModel, rows: DataFrame, features: Sequence[str], null_policy: str = "drop") -> DataFrame:
    """As ``score_reaction``; the probabilities of the one-against-others models are divided by their sum."""
    out = model.transform(feature_vector(rows, features, null_policy))
    one = {c: F.get(vector_to_array(f"__p_{c}"), F.lit(1)) for c in labels.CLASSES}
    out = out.withColumns({f"__one_{c}": p for c, p in one.items()})
    total = sum([F.col(f"__one_{c}") for c in labels.CLASSES], F.lit(0.0))
    scored = _signals(out, {f"{c.lower()}_prob": F.col(f"__one_{c}") / total for c in labels.CLASSES})
    return scored.drop("features", *[f"__{kind}_{c}" for kind in ("said", "raw", "p", "one") for c in labels.CLASSES])


def score_reaction(model: PipelineModel, rows: DataFrame, features: Sequence[str], null_policy: str = "drop") -> DataFrame:
    """Class probabilities, the gated signal and its confidence. A class that was never trained has probability 0."""
    out = model.transform(feature_vector(rows, features, null_policy))
    p = vector_to_array("probability")
    probs = {f"{c.lower()}_prob": F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)) for i, c in enumerate(labels.CLASSES)}
    return _signals(out, probs).drop("features", "rawPrediction", "probability", "prediction")


def skip_reasons(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """``missing``: the features that are missing, no numbers or not finite; ``skip_reason``: missing_features if there are any."""
    found = rows.withColumn("missing", scalars.invalid_names({f: F.col(f) for f in features}))
    return found.withColumn("skip_reason", F.when(F.size("missing") > 0, "missing_features"))


def holdout_metrics(model: PipelineModel, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Metrics on rows with a known class, by plain arg-max as in training."""
    out = model.transform(feature_vector(rows.filter(F.col("label").isin(*labels.CLASSES)), features))
    names = F.array(*[F.lit(c) for c in labels.CLASSES])
    pairs = out.select(F.get(names, F.col("prediction").cast("int")).alias("predicted"), F.col("label").alias("actual"))
    return evaluate.confusion_metrics(pairs)


def should_deploy(current: dict, previous: dict | None, force: bool = False) -> bool:
    """No previous model, or accuracy or macro-F1 at least as good."""
    if force or previous is None:
        return True
    return current["accuracy"] >= previous["accuracy"] or current["macro_f1"] >= previous["macro_f1"]


def deployable(runs: DataFrame, keys: Sequence[str], order: str, out: str = "deployed") -> DataFrame:
    """``should_deploy`` for every run of a table against the run before it (per ``keys``, by ``order``)."""
    line = W.partitionBy(*keys).orderBy(order)
    first = F.lag(F.lit(1)).over(line).isNull()
    better = [F.coalesce(F.col(c) >= F.lag(c).over(line), F.lit(False)) for c in ("accuracy", "macro_f1")]
    return runs.withColumn(out, first | better[0] | better[1])


def model_run(metrics: DataFrame, rows: DataFrame, version: str, source: str, previous: dict | None = None, force: bool = False) -> DataFrame:
    """One row for the ``model_runs`` table: version, counts, class mix, metrics, deploy flag."""
    spark = metrics.sparkSession
    m = metrics.first().asDict()
    mix = rows.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("label") == c).alias(c) for c in labels.CLASSES]
    ).first()
    share = [round(100.0 * mix[c] / mix["n"], 2) if mix["n"] else 0.0 for c in labels.CLASSES]
    matrix = [[m[f"{a}_as_{p}".lower()] for p in labels.CLASSES] for a in labels.CLASSES]
    schema = (
        "model_version string, data_source string, training_rows bigint, "
        "class_distribution struct<BUY: double, SELL: double, HOLD: double>, "
        "validation_metrics struct<accuracy: double, macro_f1: double, buy_recall: double, sell_recall: double, "
        "confusion_matrix: array<array<bigint>>>, deployed boolean"
    )
    kept = (m["accuracy"], m["macro_f1"], m["buy_recall"], m["sell_recall"], matrix)
    row = (version, source, mix["n"], tuple(share), kept, should_deploy(m, previous, force))
    return spark.createDataFrame([row], schema).withColumn("trained_at", F.current_timestamp())


def retrain(
    rows: DataFrame,
    features: Sequence[str],
    ts: str,
    order: Sequence[str],
    version: str,
    source: str = "live",
    previous: dict | None = None,
    min_rows: int = MIN_TRAINING_ROWS,
    force: bool = False,
    **shape: int,
) -> tuple[PipelineModel | None, DataFrame | None, str]:
    """Row gate, time split, fit, hold-out metrics and model run: (model, run, reason).

    ``rows`` should be a stored table: the fit reads it several times.
    """
    if rows.limit(min_rows).count() < min_rows:
        return None, None, "insufficient_data"
    split = chronological_split(rows.filter(F.col("label").isin(*labels.CLASSES)), ts, order)
    model = train_reaction_model(split.filter("is_train"), features, **shape)
    metrics = holdout_metrics(model, split.filter("not is_train"), features)
    run = model_run(metrics, rows, version, source, previous, force)
    return model, run, "success"


def save_run(model: PipelineModel, run: DataFrame, model_folder: str, runs_path: str, version: str) -> None:
    """Versioned model plus a row in ``model_runs``; "latest" is the last deployed version there."""
    model.write().overwrite().save(f"{model_folder}/{version}")
    run.write.mode("append").parquet(runs_path)


def latest_run(runs: DataFrame) -> DataFrame:
    """The last deployed run: by time of training, then by the numbers in the version (v10 after v9)."""
    numbers = F.transform(F.regexp_extract_all("model_version", F.lit(r"\d+"), 0), lambda x: x.cast("decimal(38,0)"))
    return runs.filter("deployed").orderBy(F.col("trained_at").desc(), numbers.desc(), F.col("model_version").desc()).limit(1)


def deployed_model(spark: SparkSession, model_folder: str, runs_path: str) -> tuple[str, PipelineModel] | None:
    """Version and model of the last deployed run; None when no run was deployed."""
    run = latest_run(spark.read.parquet(runs_path)).first()
    return run and (run.model_version, PipelineModel.load(f"{model_folder}/{run.model_version}"))


# --- text classifier -------------------------------------------------------------------------

SENTIMENTS = ("negative", "neutral", "positive")


def text_pipeline(text: str = "condensed_text", buckets: int = 1 << 14, iterations: int = 30) -> Pipeline:
    words = RegexTokenizer(inputCol=text, outputCol="__w", pattern=r"[^\p{L}\p{N}]+", minTokenLength=2)
    counts = HashingTF(inputCol="__w", outputCol="__tf", numFeatures=buckets)
    idf = IDF(inputCol="__tf", outputCol="features", minDocFreq=2)
    model = LogisticRegression(labelCol="y", family="multinomial", maxIter=iterations, regParam=0.01)
    return Pipeline(stages=[words, counts, idf, model])


def train_sentiment(rows: DataFrame, text: str = "condensed_text", sentiment: str = "sentiment", **options) -> PipelineModel:
    known = rows.withColumn("y", class_index(F.col(sentiment), SENTIMENTS)).filter(F.col("y").isNotNull())
    return text_pipeline(text, **options).fit(known.filter(F.trim(F.coalesce(text, F.lit(""))) != ""))


def score_sentiment(model: PipelineModel, rows: DataFrame, text: str = "condensed_text") -> DataFrame:
    """Sentiment, probabilities, confidence and score; empty texts give no row."""
    out = model.transform(rows.filter(F.trim(F.coalesce(text, F.lit(""))) != ""))
    p = vector_to_array("probability")
    top = scalars.arg_max(p)
    named = {f"{s}_prob": F.get(p, F.lit(i)) for i, s in enumerate(SENTIMENTS)}
    named["sentiment"] = F.get(F.array(*[F.lit(s) for s in SENTIMENTS]), top)
    named["confidence"] = F.array_max(p)
    named["sentiment_score"] = F.get(p, F.lit(2)) - F.get(p, F.lit(0))
    return out.withColumns(named).drop("__w", "__tf", "features", "rawPrediction", "probability", "prediction")


# --- historic rows -----------------------------------------------------------------------------

HISTORIC_OFFSETS = (1, 2, 5, 10, 15, 20, 30)


def historic_rows(raw: DataFrame) -> DataFrame:
    """Stored historic records to training rows.

    ``<price>_-<k>min`` columns lie before the event and become ``pre_*``; columns without
    the minus sign lie after it and only feed the label. Records without a headline or a
    usable open are dropped; ``volatility_1min`` does not exist there and stays null.
    """
    held = set(raw.columns)

    def col(name: str, default=None) -> Column:
        return F.col(f"`{name}`") if name in held else F.lit(default).cast("double")

    out = {
        "article_id": F.col("article_id"),
        "symbol": F.coalesce("symbols", F.lit("")),
        "headline": F.col("headline"),
        "published_time": F.col("published_time"),
        "news_source_score": F.coalesce(col("news_source_score"), F.lit(0.7)),
        "is_regulatory_news": F.coalesce(F.col("is_regulatory_news"), F.lit(0)),
        "is_negative_event": F.coalesce(F.col("is_negative_event"), F.lit(0)),
        "company_mention_strength": F.coalesce(F.col("company_mentioned_count"), F.lit(0)),
        "time_decay_15m": F.lit(1.0),
        "pre_news_momentum_5m": F.coalesce(col("pre_news_momentum_5m"), F.lit(0.0)),
        "pre_news_momentum_30m": F.coalesce(col("pre_news_momentum_30m"), F.lit(0.0)),
        "pre_news_volume_ratio": F.coalesce(col("pre_news_volume_ratio"), F.lit(1.0)),
        "intraday_volatility": F.coalesce(col("intraday_volatility"), F.lit(0.0)),
        "pre_news_price": F.coalesce(col("pre_news_price"), F.lit(0.0)),
    }
    prices = ("open", "high", "low", "close", "volume")
    out |= {f"{c}_at_signal": col(f"{c}_at_signal") for c in prices}
    for k in HISTORIC_OFFSETS:
        out |= {f"pre_{c}_{k}m": col(f"{c}_-{k}min") for c in prices}
        out[f"pre_volatility_{k}m"] = col(f"volatility_{k}min_pre_news")
    moved = labels.historic_return(col("open_at_signal"), col("close_15min"), col("high_15min"), col("low_15min"))
    tagged = labels.label_return(moved["return_15m"], labels.HISTORIC_THRESHOLD)
    ready = raw.filter((F.coalesce("headline", F.lit("")) != "") & moved["return_15m"].isNotNull())
    return ready.select(
        *[c.alias(n) for n, c in out.items()],
        *[F.round(c, 4).alias(n) for n, c in moved.items()],
        *[c.alias(n) for n, c in tagged.items()],
    )


def feature_stages(features: Sequence[str]) -> list:
    """The feature map as stages of a pipeline, so that a stored model carries it: invalid values become 0."""
    number = "try_cast({0} as double)"
    clean = ", ".join(
        f"coalesce(if(isnan({number}) or abs({number}) = double('inf'), null, {number}), 0.0d) as __f{i}".format(f"`{f}`") for i, f in enumerate(features)
    )
    assemble = VectorAssembler(inputCols=[f"__f{i}" for i in range(len(features))], outputCol="features")
    return [SQLTransformer(statement=f"SELECT *, {clean} FROM __THIS__"), assemble]


def train_historic(
    raw: DataFrame, features: Sequence[str], version: str, model_folder: str, runs_path: str, min_rows: int = MIN_HISTORIC_ROWS,
    trees: int = TREES, depth: int = DEPTH, force: bool = False, previous: dict | None = None,
) -> tuple[bool, str]:
    """The historic job: records to rows, row gate, stratified split, fit, hold-out metrics, stored run: (trained, reason).

    The stored model is a pipeline that begins with the feature map, so it scores plain rows. Features that the
    records do not have are 0 for every row.
    """
    rows = materialised(historic_rows(raw), "historic-rows")
    if rows.limit(min_rows).count() < min_rows:
        return False, "insufficient_data"
    wide = rows.withColumns({f: F.lit(None).cast("double") for f in features if f not in rows.columns})
    split = stratified_split(wide, "article_id", "label")
    train = labels.class_weights(split.filter("is_train"), "label").withColumn("y", class_index(F.col("label")))
    forest = RandomForestClassifier(
        labelCol="y", weightCol="weight", numTrees=trees, maxDepth=depth, subsamplingRate=ROW_SHARE, featureSubsetStrategy="0.8", seed=SEED,
    )
    model = Pipeline(stages=[*feature_stages(features), forest]).fit(train)
    names = F.array(*[F.lit(c) for c in labels.CLASSES])
    out = model.transform(split.filter("not is_train"))
    pairs = out.select(F.get(names, F.col("prediction").cast("int")).alias("predicted"), F.col("label").alias("actual"))
    run = model_run(evaluate.confusion_metrics(pairs), rows, version, "historic", previous, force)
    save_run(model, run, model_folder, runs_path, version)
    return True, "success"
