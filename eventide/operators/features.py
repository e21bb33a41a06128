"""Feature rows: text features plus pre-event market features, and the model's feature list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.functions import clock, scalars, timeparse
from eventide.operators import asof

TEXT_FEATURES = (
    "sentiment_score", "confidence", "positive_prob", "negative_prob", "neutral_prob", "news_source_score",
    "is_regulatory_news", "is_negative_event", "company_mention_strength", "time_decay_15m",
)
MARKET_FEATURES = (
    "pre_news_momentum_5m", "pre_news_momentum_30m", "pre_news_volume_ratio", "intraday_volatility", "pre_news_price",
)
SNAPSHOT = tuple(f"{c}_at_signal" for c in asof.PRICES)
MODEL_LOOKBACKS = (1, 2, 5, 10, 15, 20, 30)


def model_features(minutes: tuple[int, ...] = MODEL_LOOKBACKS) -> list[str]:
    """10 text, 5 market, 5 snapshot and 6 columns per look-back: 62 by default.

    Post-event columns have another prefix and can never be listed here.
    """
    per = [f"pre_{c}_{k}m" for k in minutes for c in (*asof.PRICES, "volatility")]
    return [*TEXT_FEATURES, *MARKET_FEATURES, *SNAPSHOT, *per]


def text_features(news: DataFrame, as_of: Column) -> DataFrame:
    """Feature columns that need only the scored article; rows without a score are dropped."""
    blob = scalars.text_blob(F.col("headline"), F.col("condensed_text"))
    published = timeparse.published_local(F.col("published_time"))
    rows = news.filter(F.col("sentiment").isNotNull() & F.col("confidence").isNotNull())
    return rows.withColumns(
        {
            "sentiment_score": scalars.sentiment_score(F.col("positive_prob"), F.col("negative_prob")),
            "positive_prob": F.coalesce("positive_prob", F.lit(0.0)),
            "negative_prob": F.coalesce("negative_prob", F.lit(0.0)),
            "neutral_prob": F.coalesce("neutral_prob", F.lit(0.0)),
            "news_source_score": scalars.source_score(F.col("source")),
            "is_regulatory_news": scalars.is_regulatory(blob),
            "is_negative_event": scalars.is_negative_event(blob),
            "company_mention_strength": scalars.mention_strength(blob, F.col("company_name")),
            "time_decay_15m": scalars.time_decay(published, as_of),
            "event_ts": published,
        }
    )


def with_market(
    rows: DataFrame,
    bars: DataFrame,
    key: str = "symbol",
    ts: str = "event_ts",
    lookbacks: tuple[int, ...] = asof.LOOKBACKS,
    reaction: int = asof.REACTION,
) -> DataFrame:
    """Pre-event features, look-back snapshots and the reaction window of every dated row.

    Rows without a company or a readable time are dropped. The session is the event's date
    or the latest one within five days; on an earlier session the look-backs count from its
    last bar, the features use the whole session and there is no reaction window. All
    questions share one timeline, which holds only the bar dates the rows need.
    """
    dated = rows.filter(F.col("company_name").isNotNull() & F.col(ts).isNotNull())
    dated = dated.withColumn("event_date", F.to_date(ts))
    placed = asof.resolve_session(dated, bars, key=[key], last_bar="last_ts", prune=True)
    moved = F.col("trade_date") < F.col("event_date")
    # Half a minute after the last bar: every bar of the earlier session lies before it.
    point = F.when(moved, clock.axis(F.col("last_ts")) + 1).otherwise(clock.axis(F.col(ts)))
    placed = placed.withColumn("__point", point).drop("last_ts")
    study = asof.Study(bars, placed, [key], point="__point", prune=True).pre_event().lookbacks(lookbacks)
    return study.reaction(reaction).run().drop("__point")
