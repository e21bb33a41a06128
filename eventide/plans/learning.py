"""Model queries (no SQL twin: the fits are iterative) and the exact time split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators import asof, labels, ml
from eventide.plans import Tables, query
from eventide.session import materialised
from eventide.plans.roles import LOOKBACKS, REACTION, anchors, bars


@query(
    """SELECT event_id, row_number() OVER (ORDER BY ts, event_id) <= floor(0.8 * (SELECT count(*) FROM events)) AS is_train
    FROM events"""
)
def chronological_split(t: Tables) -> DataFrame:
    return ml.chronological_split(t.events.select("event_id", "ts"), "ts", ["event_id"]).select("event_id", "is_train")


def labelled(t: Tables) -> DataFrame:
    study = asof.Study(bars(t), anchors(t)).pre_event().lookbacks(LOOKBACKS).reaction(REACTION)
    rows = study.run()
    tag = labels.label_return(F.col(f"return_{REACTION}m"))
    return rows.withColumns({**tag, "has_return": F.col(f"return_{REACTION}m").isNotNull()})


def model_columns() -> list[str]:
    from eventide.operators.features import MARKET_FEATURES, SNAPSHOT

    per = [f"pre_{c}_{k}m" for k in LOOKBACKS for c in (*asof.PRICES, "volatility")]
    return [*MARKET_FEATURES, *SNAPSHOT, *per]


@query()
def reaction_model(t: Tables) -> DataFrame:
    """Weighted forest on pre-event features: time split, fit, hold-out metrics."""
    rows = ml.chronological_split(materialised(labelled(t).filter("has_return"), "reactions"), "ts", ["event_id"])
    rows = materialised(rows, "reaction-split")
    model = ml.train_reaction_model(rows.filter("is_train"), model_columns())
    return ml.holdout_metrics(model, rows.filter("not is_train"), model_columns())


@query()
def reaction_scores(t: Tables) -> DataFrame:
    """Scoring over all anchors; one whose features are not all valid keeps its row with the reason.

    The fit reads the first part of the time split, so that later anchors are scored unseen.
    """
    rows = materialised(labelled(t), "reactions")
    fit = materialised(ml.chronological_split(rows.filter("has_return"), "ts", ["event_id"]).filter("is_train"), "reaction-fit")
    out = ml.score_reaction(ml.train_reaction_model(fit, model_columns(), trees=20), rows, model_columns())
    said = ("predicted_signal", "signal_confidence", "buy_prob", "sell_prob", "hold_prob")
    all_rows = rows.select("event_id", "symbol").join(out.select("event_id", *said), "event_id", "left")
    return all_rows.withColumn("skip_reason", F.when(F.col("buy_prob").isNull(), "missing_features"))


@query(
    """SELECT event_id, user_id % 5 AS symbol, true AS sums_to_one, true AS gate_holds, 'BUY,SELL,HOLD' AS classes
    FROM events WHERE event_type = 'signup'"""
)
def boosted_scores(t: Tables) -> DataFrame:
    """Boosted trees of three classes over all anchors: what must hold of every score, whatever the fit."""
    rows = materialised(labelled(t), "reactions")
    fit = materialised(ml.chronological_split(rows.filter("has_return"), "ts", ["event_id"]).filter("is_train"), "boosted-fit")
    names = [f for f in model_columns() if "volatility_" not in f]
    out = ml.score_boosted(ml.train_boosted_model(fit, names, rounds=4, depth=3), rows, names, null_policy="impute")
    probs = [F.col(f"{c.lower()}_prob") for c in labels.CLASSES]
    top = F.greatest(*probs)
    said = F.get(F.array(*[F.lit(c) for c in labels.CLASSES]), (F.array_position(F.array(*probs), top) - 1).cast("int"))
    near = F.abs(top - labels.MIN_CONFIDENCE) < 0.001  # probabilities are shown rounded, the gate is not
    tie = F.size(F.filter(F.array(*probs), lambda p: F.abs(p - top) < 0.001)) > 1
    holds = (F.col("predicted_signal") == F.when(top < labels.MIN_CONFIDENCE, "HOLD").otherwise(said)) | near | tie
    sums = F.abs(sum(probs, F.lit(0.0)) - 1) < 0.001
    known = F.lit(",".join(labels.CLASSES)).alias("classes")
    return out.select("event_id", "symbol", sums.alias("sums_to_one"), (holds & (F.abs(F.col("signal_confidence") - top) < 0.001)).alias("gate_holds"), known)


@query()
def text_classifier(t: Tables) -> DataFrame:
    """Sentiment model fitted on labelled documents and applied to all of them."""
    mood = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    docs = t.documents.select("doc_id", "text")
    train = docs.join(t.labels, "doc_id").select("doc_id", "text", mood.alias("sentiment"))
    model = ml.train_sentiment(train, "text")
    out = ml.score_sentiment(model, docs, "text")
    return out.select(
        "doc_id", "sentiment", *[F.round(c, 4).alias(c) for c in ("positive_prob", "negative_prob", "neutral_prob", "confidence")]
    )
