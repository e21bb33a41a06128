"""Labels, verdicts and class columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label thresholds in percent, class order, boost of the directional classes.
LIVE_THRESHOLD = 0.15
HISTORIC_THRESHOLD = 0.5
CLASSES = ("BUY", "SELL", "HOLD")
DIRECTION_BOOST = 1.5
MIN_CONFIDENCE = 0.40


def label_return(ret: Column, threshold: float = LIVE_THRESHOLD, minutes: int = 15) -> dict[str, Column]:
    """Label, strength and reason of a return in percent; thresholds are inclusive, NaN is flat."""
    up, down = (ret >= threshold) & ~F.isnan(ret), ret <= -threshold
    return {
        "label": F.when(up, "BUY").when(down, "SELL").otherwise("HOLD"),
        "label_strength": F.round(F.coalesce(F.abs(ret), F.lit(0.0)), 4),
        "label_reason": F.when(ret.isNull(), "missing_return")
        .when(up, f"price_up_{minutes}m")
        .when(down, f"price_down_{minutes}m")
        .otherwise("flat_move"),
    }


def historic_return(open_at: Column, close: Column, high: Column, low: Column) -> dict[str, Column]:
    """Return % and range % against the signal's open; null or zero open makes both null."""
    base = F.when(open_at != 0, open_at)
    return {
        "return_15m": F.try_divide(close - base, base) * 100,
        "volatility_15m": F.try_divide(F.coalesce(high, close) - F.coalesce(low, close), base) * 100,
    }


def side_of(sentiment: Column) -> Column:
    """positive/negative/neutral to BUY/SELL/HOLD; anything else is null."""
    s = F.lower(F.trim(sentiment))
    return F.when(s == "positive", "BUY").when(s == "negative", "SELL").when(s == "neutral", "HOLD")


def percent_change(before: Column, after: Column) -> Column:
    return F.round(F.when(before != 0, F.try_divide(after - before, before) * 100).otherwise(0.0), 2)


def verdict(side: Column, before: Column, after: Column) -> Column:
    """Correct / Wrong by the strict price move; HOLD is Neutral; an equal price is Wrong."""
    hit = F.when(side == "BUY", after > before).otherwise(after < before)
    return F.when(side == "HOLD", "Neutral").when(hit, "Correct").otherwise("Wrong")


def night_bias(sentiment: Column, confidence: Column) -> dict[str, Column]:
    """Off-hours bias and one-hot probabilities from the sentiment alone."""
    side = F.coalesce(side_of(sentiment), F.lit("HOLD"))
    sure = F.round(F.coalesce(confidence, F.lit(0.0)), 4)
    return {
        "predicted_signal": F.when(side == "BUY", "BULLISH").when(side == "SELL", "BEARISH").otherwise("NEUTRAL"),
        "signal_confidence": sure,
        "buy_prob": F.when(side == "BUY", sure).otherwise(0.0),
        "sell_prob": F.when(side == "SELL", sure).otherwise(0.0),
        "hold_prob": F.when(side == "HOLD", sure).otherwise(0.0),
    }


def gated_signal(probs: Sequence[Column], floor: float = MIN_CONFIDENCE) -> dict[str, Column]:
    """Arg-max class (ties to the first) with a floor below which the signal is HOLD."""
    top = F.greatest(*probs)
    pick = F.lit(None).cast("string")
    for name, p in reversed(list(zip(CLASSES, probs))):
        pick = F.when(p == top, name).otherwise(pick)
    return {
        "predicted_signal": F.when(top < floor, "HOLD").otherwise(pick),
        "signal_confidence": F.round(top, 4),
    }


def class_share(df: DataFrame, column: str, places: int = 2) -> DataFrame:
    """Count and percentage of each value; only the counts are shuffled."""
    from pyspark.sql import Window as W

    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / total, places))


def class_weights(
    df: DataFrame,
    label: str,
    boosted: Sequence[str] = ("BUY", "SELL"),
    boost: float = DIRECTION_BOOST,
    out: str = "weight",
    classes: Sequence[str] = CLASSES,
) -> DataFrame:
    """Balanced weight N / (K * n_c), times ``boost`` for the directional classes.

    Rows outside ``classes`` are dropped, so the broadcast side has at most
    ``len(classes)`` rows and a class that holds most rows is never shuffled.
    """
    from pyspark.sql import Window as W

    everything = W.partitionBy(F.lit(1))
    counts = df.filter(F.col(label).isin(*classes)).groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    balanced = F.sum("__n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("__n"))
    scale = F.when(F.col(label).isin(*boosted), boost).otherwise(1.0)
    weights = counts.select(F.col(label), (balanced * scale).alias(out))
    return df.join(F.broadcast(weights), label)
