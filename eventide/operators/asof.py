"""As-of, tolerance and interval questions between events and minute bars.

Shape of every plan here:

1. events collapse to distinct *probe points* (key, session, axis position);
2. probe points and bars form one *timeline*, hash-partitioned by (key, session);
3. constant range frames over the sorted timeline answer all questions at once;
4. the answers join back to the events on the probe point.

A session has at most 1,440 minutes, so a timeline partition has at most 1,440 bars and
2,880 probe points however many events or ticks a key has. No event is ever paired with
the bars of its session, and adding another offset adds a frame, not a join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide.functions import clock

PRICES = ("open", "high", "low", "close", "volume")
AXIS = "__axis"

# Look-back, forward and tolerance minutes of the event study.
LOOKBACKS = (1, 2, 5, 10, 15, 20, 30, 45, 60, 90, 120)
FORWARDS = (2, 5, 10, 15, 20, 30, 45, 60, 90, 120, 180, 240)
TOLERANCE = 10
REACTION = 15
FALLBACK = 15
SESSION_LOOKBACK_DAYS = 5


class Timeline:
    """Frames over the merged bars and probe points of one (key, session)."""

    def __init__(self, key: Sequence[str], session: str):
        self.whole = W.partitionBy(*key, session)
        self._fwd = self.whole.orderBy(F.col(AXIS))
        self._rev = self.whole.orderBy(F.col(AXIS).desc())
        self.bars_only = W.partitionBy(*key, session, F.col("bar").isNull()).orderBy(AXIS)

    def back(self, minutes: int = 0, strict: bool = False, of: str = "bar") -> Column:
        """Last bar at or before (``strict``: before) the point minus ``minutes``."""
        end = -2 * minutes - (1 if strict else 0)
        return F.last(of, ignorenulls=True).over(self._fwd.rangeBetween(W.unboundedPreceding, end))

    def ahead(self, of: str = "bar") -> Column:
        """First bar at or after the point; read on the reversed line so that it streams."""
        return F.last(of, ignorenulls=True).over(self._rev.rangeBetween(W.unboundedPreceding, 0))

    def between(self, start: int, end: int, after: bool = False) -> Column:
        """First bar in [point + start, point + end] (``after``: strictly after the start)."""
        return F.first("bar", ignorenulls=True).over(self._fwd.rangeBetween(2 * start + int(after), 2 * end))

    def over(self, agg: Column, start: int, end: int, open_end: bool = False) -> Column:
        """An aggregate over the bars in [point + start, point + end] or [.., end)."""
        return agg.over(self._fwd.rangeBetween(2 * start, 2 * end - int(open_end)))


def timeline(
    bars: DataFrame,
    points: DataFrame,
    key: Sequence[str],
    session: str,
    bar_ts: str = "ts",
    columns: Sequence[str] = PRICES,
) -> DataFrame:
    """Bars and distinct probe points on one axis, co-located by (key, session)."""
    bar = F.struct(F.col(bar_ts).alias("ts"), *[F.col(c) for c in columns])
    rows = bars.select(*key, session, (clock.minute_no(F.col(bar_ts)) * 2).alias(AXIS), bar.alias("bar"))
    empty = F.lit(None).cast(rows.schema["bar"].dataType)
    slots = points.select(*key, session, AXIS).filter(F.col(session).isNotNull() & F.col(AXIS).isNotNull()).distinct().withColumn("bar", empty)
    return rows.unionByName(slots).repartition(*key, session)


def on_dates(bars: DataFrame, dates: DataFrame, session: str) -> DataFrame:
    """Bars of the given dates only.

    The broadcast side has at most one row per calendar day; against a table partitioned by
    ``session`` the join prunes partitions at run time.
    """
    wanted = dates.filter(F.col(session).isNotNull()).distinct()
    return bars.join(F.broadcast(wanted), session, "left_semi")


def attach(events: DataFrame, answers: DataFrame, key: Sequence[str], session: str) -> DataFrame:
    """Bring per-point answers back to the events (one answer row per point).

    Only the event side can be skewed, which is the side an AQE skew join splits.
    """
    return events.join(answers, [*key, session, AXIS], "left").drop(AXIS)


class Study:
    """Collects questions about events and answers all of them on one timeline.

    Each method adds output columns and returns the study; ``run`` builds the plan: one
    exchange of bars and points however many questions were asked.
    """

    def __init__(
        self,
        bars: DataFrame,
        events: DataFrame,
        key: Sequence[str] = ("symbol",),
        session: str = "trade_date",
        ts: str = "ts",
        point: str | None = None,
        prune: bool = False,
    ):
        """``point`` names a ready axis column for events that were moved to an earlier session.

        ``prune`` reads only the bar dates the events need, for a batch of events against a
        long history of bars partitioned by session date.
        """
        if prune:
            bars = on_dates(bars, events.select(session), session)
        self.bars, self.key, self.session = bars, list(key), session
        self.events = events.withColumn(AXIS, F.col(point) if point else clock.axis(F.col(ts)))
        self.line = Timeline(self.key, session)
        self._bar_columns: dict[str, None] = {}
        self._own: dict[str, Column] = {}
        self._asked: dict[str, Column] = {}
        self._named: dict[str, Column] = {}
        self._after: dict[str, Column] = {}

    def _needs(self, *columns: str) -> None:
        self._bar_columns.update(dict.fromkeys(columns))

    def _ask(self, name: str, question: Column) -> Column:
        self._asked[name] = question
        return F.col(name)

    def last_bar(self, columns: Mapping[str, str], minutes: int = 0, strict: bool = False) -> Study:
        """Fields of the last bar at or before the event: ``{bar column: output name}``."""
        self._needs(*[c for c in columns if c != "ts"])
        bar = self._ask(f"__back{minutes}{'s' if strict else ''}", self.line.back(minutes, strict))
        self._named |= {out: bar[c] for c, out in columns.items()}
        return self

    def lookbacks(
        self,
        minutes: Sequence[int] = LOOKBACKS,
        columns: Sequence[str] = PRICES,
        strict: bool = False,
        volatility: bool = True,
    ) -> Study:
        """Bar snapshot at the event and at every look-back offset; a missing offset is null.

        ``strict`` uses bars before the event only (a bar stamped T covers the minute after T).
        """
        self.last_bar({c: f"{c}_at_signal" for c in columns}, 0, strict)
        for k in minutes:
            self.last_bar({c: f"pre_{c}_{k}m" for c in columns}, k, strict)
            if volatility and {"open", "high", "low"} <= set(columns):
                o, h, lo = (F.col(f"pre_{c}_{k}m") for c in ("open", "high", "low"))
                span = F.when(o > 0, F.try_divide(h - lo, o)).when(o.isNotNull(), 0.0)
                self._late(f"pre_volatility_{k}m", span)
        return self

    def _late(self, name: str, column: Column) -> None:
        self._after[name] = column

    def forward_prices(self, minutes: Sequence[int] = FORWARDS, tolerance: int = TOLERANCE) -> Study:
        """Close of the first bar in [T+k, T+k+tolerance]; a null close there stays null."""
        self._needs("close")
        for k in minutes:
            bar = self._ask(f"__fwd{k}", self.line.between(k, k + tolerance))
            self._named[f"price_after_{k}min"] = F.round(bar["close"], 2)
        return self

    def price_at_signal(self, fallback: int = FALLBACK, places: int | None = 2) -> Study:
        """Last close at or before T, else the first close in (T, T+fallback], flagged."""
        self._needs("close")
        back = self._ask("__back0", self.line.back())
        ahead = self._ask("__fallback", self.line.between(0, fallback, after=True))
        price = F.coalesce(back["close"], ahead["close"])
        self._named["price_at_signal"] = price if places is None else F.round(price, places)
        self._named["price_at_signal_is_fallback"] = back["close"].isNull() & ahead["close"].isNotNull()
        return self

    def price_range(self, minutes: int = max(FORWARDS)) -> Study:
        """Highest high and lowest low in [T, T+minutes]."""
        self._needs("high", "low")
        top = self._ask("__high", self.line.over(F.max("bar.high"), 0, minutes))
        low = self._ask("__low", self.line.over(F.min("bar.low"), 0, minutes))
        self._named |= {"highest_price": F.round(top, 2), "lowest_price": F.round(low, 2)}
        return self

    def has_session(self, out: str = "has_bars") -> Study:
        """Whether the event's (key, session) has any bar."""
        found = self._ask("__any", F.max(F.col("bar").isNotNull()).over(self.line.whole))
        self._named[out] = F.coalesce(found, F.lit(False))
        return self

    def next_in_session(self, out: str) -> Study:
        """Time of the first bar at or after the event inside its session."""
        self._named[out] = self._ask("__ahead", self.line.ahead())["ts"]
        return self

    def reaction(self, minutes: int = REACTION) -> Study:
        """OHLCV and return % of [s, s+minutes), s being the first bar at or after the event.

        Every bar first aggregates its own forward window; a point takes the next bar's.
        """
        self._needs(*PRICES)
        over, name = self.line.over, f"__react{minutes}"
        self._own[name] = F.struct(
            F.col("bar.open").alias("open"),
            over(F.max("bar.high"), 0, minutes, True).alias("high"),
            over(F.min("bar.low"), 0, minutes, True).alias("low"),
            over(F.last("bar", ignorenulls=True), 0, minutes, True)["close"].alias("close"),
            over(F.sum("bar.volume"), 0, minutes, True).alias("volume"),
            F.col("bar.ts").alias("start"),
        )
        w = self._ask(f"{name}_w", self.line.ahead(name))
        self._named |= {f"post_{c}_{minutes}m": w[c] for c in PRICES}
        self._named["post_start"] = w["start"]
        # Floating-point division: a zero open gives an infinite return, or NaN without a move.
        move = w["close"] - w["open"]
        self._named[f"return_{minutes}m"] = (
            F.when(w["open"] != 0, F.try_divide(move, w["open"]) * 100)
            .when(move > 0, float("inf"))
            .when(move < 0, float("-inf"))
            .when(move == 0, float("nan"))
        )
        return self

    def pre_event(self, short: int = 5, long: int = 30, min_bars: int = 5) -> Study:
        """Momentum over the last 5 and 30 bars, volume ratio, range % and price before T.

        Bars carry their running statistics, so one strictly-before as-of answers all five.
        Fewer than ``min_bars`` bars leave every feature null; fewer than ``long`` bars make
        the long momentum equal the short one.
        """
        self._needs(*PRICES)
        rows = self.line.bars_only
        run = rows.rowsBetween(W.unboundedPreceding, 0)
        self._own["__run"] = F.struct(
            F.count(F.lit(1)).over(run).alias("n"),
            F.lag(F.col("bar.open"), short - 1).over(rows).alias("open_short"),
            F.lag(F.col("bar.open"), long - 1).over(rows).alias("open_long"),
            F.col("bar.close").alias("close"),
            F.col("bar.volume").alias("volume"),
            F.avg("bar.volume").over(run).alias("avg_volume"),
            F.max("bar.high").over(run).alias("high"),
            F.min("bar.low").over(run).alias("low"),
            F.first("bar.open").over(run).alias("first_open"),
        )
        s = self._ask("__stats", self.line.back(0, strict=True, of="__run"))

        def move(start: Column) -> Column:
            # A non-positive or missing open counts as no movement.
            return F.when(start > 0, F.try_divide(s["close"] - start, start) * 100).otherwise(0.0)

        span = F.try_divide(s["high"] - s["low"], s["first_open"]) * 100
        features = {
            "pre_news_momentum_5m": F.round(move(s["open_short"]), 4),
            "pre_news_momentum_30m": F.round(
                F.when(s["n"] >= long, move(s["open_long"])).otherwise(move(s["open_short"])), 4
            ),
            "pre_news_volume_ratio": F.round(
                F.when(s["avg_volume"] > 0, s["volume"] / s["avg_volume"]).otherwise(1.0), 4
            ),
            "intraday_volatility": F.round(F.when(s["first_open"] > 0, span).otherwise(0.0), 4),
            "pre_news_price": F.round(s["close"], 2),
        }
        self._named |= {n: F.when(s["n"] >= min_bars, c) for n, c in features.items()}
        return self

    def answers(self) -> DataFrame:
        """One row per probe point with the raw answers."""
        line = timeline(self.bars, self.events, self.key, self.session, columns=list(self._bar_columns))
        is_bar = F.col("bar").isNotNull()
        for name, own in self._own.items():
            line = line.withColumn(name, own).withColumn(name, F.when(is_bar, F.col(name)))
        asked = [c.alias(n) for n, c in self._asked.items()]
        out = line.select(*self.key, self.session, AXIS, "bar", *asked)
        return out.filter(F.col("bar").isNull()).drop("bar")

    def run(self) -> DataFrame:
        out = attach(self.events, self.answers(), self.key, self.session)
        out = out.withColumns(self._named).drop(*self._asked)
        return out.withColumns(self._after) if self._after else out


def sessions_of(bars: DataFrame, key: Sequence[str], session: str = "trade_date", ts: str = "ts") -> DataFrame:
    """One row per (key, session) with its first and last bar time."""
    return bars.groupBy(*key, session).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def resolve_session(
    events: DataFrame,
    bars: DataFrame,
    max_days: int = SESSION_LOOKBACK_DAYS,
    key: Sequence[str] = ("symbol",),
    date: str = "event_date",
    session: str = "trade_date",
    last_bar: str | None = None,
    prune: bool = False,
) -> DataFrame:
    """Latest session on or before the event date, at most ``max_days`` back (else null).

    Works on distinct (key, date) pairs; the window is one row per key and calendar day.
    ``last_bar`` also adds the time of that session's last bar under this name; ``prune``
    reads only the bar dates within reach of the events.
    """
    if prune:
        reach = F.explode(F.sequence(F.date_sub(date, max_days), F.col(date)))
        days = events.select(date).filter(F.col(date).isNotNull()).distinct()
        bars = on_dates(bars, days.select(reach.alias(session)), session)
    held = bars.groupBy(*key, F.col(session).alias("__d"))
    held = held.agg(F.max("ts").alias("__last")) if last_bar else held.agg(F.lit(None).cast("timestamp_ntz").alias("__last"))
    asked = events.select(*key, F.col(date).alias("__d")).distinct()
    day = W.partitionBy(*key).orderBy(F.unix_date("__d")).rangeBetween(-max_days, 0)
    best = F.max_by(F.struct(F.col("__s").alias("s"), F.col("__last").alias("l")), F.col("__s")).over(day)
    found = (
        held.withColumn("__s", F.col("__d"))
        .unionByName(asked.withColumns({"__s": F.lit(None).cast("date"), "__last": F.lit(None).cast("timestamp_ntz")}))
        .withColumn("__ask", F.col("__s").isNull())
        .withColumn("__found", best)
        .filter("__ask")
        .select(
            *key,
            F.col("__d").alias(date),
            F.col("__found.s").alias(session),
            *([F.col("__found.l").alias(last_bar)] if last_bar else []),
        )
    )
    return events.join(found, [*key, date], "left")


def next_bar(
    bars: DataFrame,
    events: DataFrame,
    key: Sequence[str] = ("symbol",),
    session: str = "trade_date",
    ts: str = "ts",
    out: str = "anchor_ts",
) -> DataFrame:
    """First bar at or after the event with no session bound: nights and holidays roll over.

    The bar is looked for inside the event's own date first; otherwise it is the opening
    bar of the next session, found on the (key, session) table. No window runs over the
    whole history of a key's bars.
    """
    own_day = events.withColumn(session, F.to_date(ts))
    study = Study(bars, own_day, key, session, ts).next_in_session("__in")
    inside = study.answers().select(*key, session, AXIS, F.col("__ahead.ts").alias("__in"))
    probed = study.events
    opens = sessions_of(bars, key, session).select(*key, session, "first_ts")
    dates = probed.select(*key, session).distinct().withColumn("first_ts", F.lit(None).cast("timestamp_ntz"))
    later = W.partitionBy(*key).orderBy(F.unix_date(session).desc()).rangeBetween(W.unboundedPreceding, -1)
    following = (
        opens.unionByName(dates)
        .withColumn("__next", F.min("first_ts").over(later))
        .groupBy(*key, session)
        .agg(F.min("__next").alias("__next"))
    )
    answers = inside.join(following, [*key, session], "left").select(
        *key, session, AXIS, F.coalesce("__in", "__next").alias(out)
    )
    return attach(probed, answers, key, session).drop(session)


def session_clock_prices(
    bars: DataFrame,
    close_at: str = "15:30",
    window: tuple[str, str] = ("09:15", "15:30"),
    key: Sequence[str] = ("symbol",),
    session: str = "trade_date",
    ts: str = "ts",
) -> DataFrame:
    """Close of the last bar at or before a clock time and the highest high of a clock window."""
    sec = clock.second_of_day(F.col(ts))
    at = clock.micros(F.col(ts))
    lo, hi = (clock.clock_seconds(t) for t in window)
    return bars.groupBy(*key, session).agg(
        F.max_by("close", F.when(sec <= clock.clock_seconds(close_at), at)).alias("session_close"),
        F.max(F.when(sec.between(lo, hi), F.col("high"))).alias("window_max"),
    )
