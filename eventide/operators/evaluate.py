"""Event study, accuracy and hold-out metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.functions import clock
from eventide.operators import asof, labels, state
from eventide.operators.bars import canonical_bars

# Session hours, scoring gate and default horizon of the event study.
MARKET_OPEN = "09:15"
MARKET_CLOSE = "15:30"
SCORING_OPEN = "09:30"
HORIZON = 60


def in_clock(ts: Column, start: str = MARKET_OPEN, end: str = MARKET_CLOSE, plus_minutes: int = 0) -> Column:
    """Clock time (optionally ``plus_minutes`` later) inside [start, end]; the date is ignored."""
    sec = F.pmod(clock.second_of_day(ts) + plus_minutes * 60, F.lit(86_400.0))
    return sec.between(clock.clock_seconds(start), clock.clock_seconds(end))


def in_window(minute: Column, horizon: int = HORIZON) -> Column:
    """A minute number whose clock time, and the one ``horizon`` minutes later, lie in the session."""
    first, last = (clock.clock_seconds(c) // 60 for c in (MARKET_OPEN, MARKET_CLOSE))
    return F.pmod(minute, F.lit(1_440)).between(first, last) & F.pmod(minute + horizon, F.lit(1_440)).between(first, last)


def horizon_minutes(text: str | int, default: int = HORIZON) -> int:
    """``'1h'``, ``'5m'`` or a number of minutes; anything else is the default."""
    t = str(text).strip().lower()
    if t[-1:] == "h" and t[:-1].isdigit():
        return int(t[:-1]) * 60
    if t[-1:] == "m" and t[:-1].isdigit():
        return int(t[:-1])
    return int(t) if t.isdigit() else default


def with_plain_key(df: DataFrame, key: str) -> DataFrame:
    """Text keys trimmed and in upper case; other keys as they are."""
    return df.withColumn(key, F.upper(F.trim(key))) if dict(df.dtypes)[key] == "string" else df


def minute_bars(rows: DataFrame, keys: Sequence[str], ts: str = "ts", seq: str | None = None) -> DataFrame:
    """One bar a minute; without ``seq`` rows of one time go by their prices, so reruns agree."""
    if seq is None:
        rows = rows.groupBy(*keys, ts).agg(
            F.min_by("open", F.struct("low", "high", "open", "close")).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", F.struct("low", "high", "open", "close")).alias("close"), F.sum("volume").alias("volume"),
        )
    return canonical_bars(rows, keys, ts, seq)


def event_study(
    signals: DataFrame,
    bars: DataFrame,
    mapping: DataFrame | None = None,
    horizon: str | int = HORIZON,
    forwards: Sequence[int] = asof.FORWARDS,
    tolerance: int = asof.TOLERANCE,
    fallback: int = asof.FALLBACK,
    key: str = "symbol",
    ts: str = "ts",
    seq: str | None = None,
    canonical: bool = False,
    prune: bool = True,
) -> DataFrame:
    """Every signal with either its measured prices and verdict or a ``skip_reason``.

    Signals carry ``symbol``, ``sentiment`` and the parsed event time ``ts`` (floored to
    the minute here). ``mapping`` lists the known symbols. Text symbols are compared trimmed
    and in upper case on all three sides. The first failing test names the reason; rows that
    fail a cheap test never reach the bars.

    Raw bars are folded to one bar a minute first (``seq`` orders rows of one time; without
    it such rows are ordered by their prices, so that repeated runs agree), unless they are
    ``canonical``. ``prune`` reads only the bar dates the signals need.
    """
    signals, bars = with_plain_key(signals, key), with_plain_key(bars, key)
    minutes = horizon_minutes(horizon)
    forwards = sorted({*forwards, minutes})
    # All that follows is made of the minute number, which names the time once.
    rows = signals.withColumn("__minute", clock.minute_no(F.col(ts))).withColumns(
        {ts: clock.minute_ts(F.col("__minute")), "side": labels.side_of(F.col("sentiment"))}
    )
    mapped = F.lit(True)
    if mapping is not None:
        rows = rows.join(with_plain_key(mapping.select(key), key).distinct().withColumn("__mapped", F.lit(True)), key, "left")
        mapped = F.col("__mapped").isNotNull()
    reason = (
        F.when(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == "", "NO_SYMBOL")
        .when(F.col("side").isNull(), "INVALID_SENTIMENT")
        .when(F.col("__minute").isNull(), "TIME_PARSE_FAIL")
        .when(~in_window(F.col("__minute"), minutes), "OUT_OF_MARKET")
        .when(~mapped, "NO_MAPPING")
    )
    rows = rows.withColumn("skip_reason", reason).drop("__mapped")
    rejected = rows.filter(F.col("skip_reason").isNotNull()).drop("__minute")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("__minute") / 1_440).cast("int"))
    passed = rows.filter(F.col("skip_reason").isNull()).withColumns({"trade_date": day, "__point": F.col("__minute") * 2})
    if prune:
        bars = asof.on_dates(bars, passed.select("trade_date"), "trade_date")
    if not canonical:
        bars = minute_bars(bars, [key], ts="ts", seq=seq)

    seen = (
        asof.Study(bars, passed.drop("__minute"), [key], "trade_date", ts, point="__point")
        .has_session("has_bars")
        .price_at_signal(fallback, places=None)
        .price_range(max(forwards))
        .forward_prices(forwards, tolerance)
        .run()
    )
    p0, p1 = F.col("price_at_signal"), F.col(f"price_after_{minutes}min")
    seen = seen.withColumns(
        {
            "skip_reason": F.when(~F.col("has_bars"), "NO_BARS")
            .when(p0.isNull(), "MISSING_PRICE_T")
            .when(p1.isNull(), "MISSING_PRICE_AT_HORIZON"),
            "percent_change": F.when(p0.isNotNull() & p1.isNotNull(), labels.percent_change(p0, p1)),
            "result": F.when(p0.isNotNull() & p1.isNotNull(), labels.verdict(F.col("side"), p0, p1)),
            "price_at_signal": F.round(p0, 2),
        }
    ).drop("has_bars", "trade_date", "__point")
    return seen.unionByName(rejected, allowMissingColumns=True)


def written(study: DataFrame) -> DataFrame:
    """Measured signals only."""
    return study.filter(F.col("skip_reason").isNull())


def skip_counts(study: DataFrame) -> DataFrame:
    return study.groupBy(F.coalesce("skip_reason", F.lit("WRITTEN")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )


def study_summary(study: DataFrame) -> DataFrame:
    skipped = F.count("skip_reason")
    total = F.count(F.lit(1))
    return study.agg(
        total.alias("sample_size"), (total - skipped).alias("written"), skipped.alias("skipped")
    )


def matched(
    predictions: DataFrame, actuals: DataFrame, keys: Sequence[str], seq: str, pred: str, actual: str
) -> DataFrame:
    """Predictions with the last label of their key; unmatched predictions are left out."""
    last = state.first_per_key(actuals, keys, [F.col(seq).desc()]).select(*keys, F.col(actual).alias("actual"))
    return predictions.withColumnRenamed(pred, "predicted").join(last, list(keys))


def recent_matches(pairs: DataFrame, order: Sequence[str | Column], n: int = 10) -> DataFrame:
    """The ``n`` last matches by ``order`` (latest first), with whether the prediction held."""
    return pairs.withColumn("hit", F.coalesce(F.col("predicted") == F.col("actual"), F.lit(False))).orderBy(*order).limit(n)


def accuracy_report(pairs: DataFrame, classes: Sequence[str] = labels.CLASSES) -> DataFrame:
    """Accuracy and per-class precision in one aggregate; a class never predicted has null."""
    p, a = F.col("predicted"), F.col("actual")
    scopes = [("ALL", F.lit(True)), *[(c, p == c) for c in classes]]
    aggs = []
    for name, test in scopes:
        aggs += [
            F.count_if(test).alias(f"n_{name}"),
            F.count_if(test & (p == a)).alias(f"ok_{name}"),
        ]
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("scope"),
                    F.col(f"ok_{name}").alias("n_correct"),
                    F.col(f"n_{name}").alias("n_predicted"),
                    F.round(F.try_divide(F.col(f"ok_{name}") * 100.0, F.col(f"n_{name}")), 2).alias("precision_pct"),
                )
                for name, _ in scopes
            ]
        )
    )
    return pairs.agg(*aggs).select(rows.alias("r")).select("r.*")


def confusion_metrics(pairs: DataFrame, classes: Sequence[str] = labels.CLASSES, places: int = 4) -> DataFrame:
    """One row: the K x K counts, accuracy, macro-F1 and per-class recall."""
    p, a = F.col("predicted"), F.col("actual")
    counted = pairs.agg(
        *[F.count_if((a == x) & (p == y)).alias(f"{x}_as_{y}".lower()) for x in classes for y in classes]
    )

    def cell(x: str, y: str) -> Column:
        return F.col(f"{x}_as_{y}".lower())

    def total(cells: Sequence[Column]) -> Column:
        return sum(cells[1:], cells[0])

    diag = total([cell(c, c) for c in classes])
    every = total([cell(x, y) for x in classes for y in classes])
    f1, present, recall = [], [], {}
    for c in classes:
        real = total([cell(c, y) for y in classes])
        said = total([cell(x, c) for x in classes])
        f1.append(F.coalesce(F.try_divide(2.0 * cell(c, c), real + said), F.lit(0.0)))
        present.append((real + said > 0).cast("int"))
        recall[f"{c.lower()}_recall"] = F.round(F.coalesce(F.try_divide(cell(c, c) * 1.0, real), F.lit(0.0)), places)
    return counted.withColumns(
        {
            "accuracy": F.round(F.try_divide(diag * 1.0, every), places),
            "macro_f1": F.round(F.try_divide(total(f1), total(present)), places),
            **recall,
        }
    )
