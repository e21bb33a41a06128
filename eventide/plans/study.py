"""Event study, accuracy, calendar, time and feature queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions import clock, fixed, scalars, timeparse
from eventide.operators import calendar, evaluate, labels
from eventide.plans import Tables, query
from eventide.plans.roles import BARS_SQL, FORWARDS, TOLERANCE, bars, ticks
from eventide.session import dealt, spread

# --- event study ---------------------------------------------------------------------------


def signals(t: Tables) -> DataFrame:
    """``signup`` events as scored articles; ``props.k`` chooses sentiment and missing symbols."""
    k = F.get_json_object("props", "$.k").cast("int")
    mood = F.array(*[F.lit(s) for s in ("positive", "NEGATIVE", "neutral", "mixed")])
    return t.events.filter(F.col("event_type") == "signup").select(
        "event_id",
        F.when(k >= 10, F.pmod(F.col("user_id"), F.lit(7))).cast("long").alias("symbol"),
        F.get(mood, F.pmod(k, F.lit(4))).alias("sentiment"),
        F.when(k != 13, F.col("ts")).alias("ts"),
    )


def listed(t: Tables) -> DataFrame:
    """Symbols with a mapping: six of the seven that signals use, one of them without bars."""
    return t.events.select(F.pmod(F.col("user_id"), F.lit(6)).cast("long").alias("symbol"))


STUDY_CTES = f"""{BARS_SQL},
signals AS (
  SELECT event_id, CASE WHEN k >= 10 THEN user_id % 7 END AS symbol,
         CASE k % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'NEGATIVE' WHEN 2 THEN 'neutral' ELSE 'mixed' END AS sentiment,
         CASE WHEN k <> 13 THEN date_trunc('minute', ts) END AS ts
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'signup')),
listed AS (SELECT DISTINCT user_id % 6 AS symbol FROM events),
gated AS (
  SELECT s.*, CASE sentiment WHEN 'positive' THEN 'BUY' WHEN 'NEGATIVE' THEN 'SELL' WHEN 'neutral' THEN 'HOLD' END AS side,
    CASE WHEN s.symbol IS NULL THEN 'NO_SYMBOL' WHEN sentiment = 'mixed' THEN 'INVALID_SENTIMENT'
         WHEN ts IS NULL THEN 'TIME_PARSE_FAIL'
         WHEN NOT (CAST(ts AS TIME) BETWEEN TIME '09:15' AND TIME '15:30'
                   AND CAST(ts + INTERVAL 60 MINUTE AS TIME) BETWEEN TIME '09:15' AND TIME '15:30') THEN 'OUT_OF_MARKET'
         WHEN l.symbol IS NULL THEN 'NO_MAPPING' END AS gate
  FROM signals s LEFT JOIN listed l ON s.symbol = l.symbol),
priced AS (
  SELECT g.event_id, any_value(g.side) AS side, any_value(g.gate) AS gate, count(b.ts) AS n_bars,
    arg_max(b.close, b.ts) FILTER (b.ts <= g.ts) AS back,
    arg_min(b.close, b.ts) FILTER (b.ts > g.ts AND b.ts <= g.ts + INTERVAL 60 MINUTE) AS ahead,
    {", ".join(
        f"round(arg_min(b.close, b.ts) FILTER (b.ts BETWEEN g.ts + INTERVAL {k} MINUTE "
        f"AND g.ts + INTERVAL {k + TOLERANCE} MINUTE), 2) AS price_after_{k}min" for k in sorted({*FORWARDS, 60}))},
    round(max(b.high) FILTER (b.ts BETWEEN g.ts AND g.ts + INTERVAL 240 MINUTE), 2) AS highest_price,
    round(min(b.low) FILTER (b.ts BETWEEN g.ts AND g.ts + INTERVAL 240 MINUTE), 2) AS lowest_price
  FROM gated g LEFT JOIN bars b
    ON g.gate IS NULL AND g.symbol = b.symbol AND CAST(g.ts AS DATE) = b.trade_date
  GROUP BY g.event_id),
judged AS (
  SELECT *, coalesce(back, ahead) AS p0, price_after_60min AS p1,
    CASE WHEN gate IS NOT NULL THEN gate WHEN n_bars = 0 THEN 'NO_BARS'
         WHEN coalesce(back, ahead) IS NULL THEN 'MISSING_PRICE_T'
         WHEN price_after_60min IS NULL THEN 'MISSING_PRICE_AT_HORIZON' END AS skip_reason
  FROM priced)"""


def studied(t: Tables) -> DataFrame:
    # The bars are made of ticks here, one a minute and for every date, so neither folding nor pruning helps.
    return evaluate.event_study(
        signals(t), bars(t), listed(t), horizon="1h", forwards=FORWARDS, tolerance=TOLERANCE, fallback=60, canonical=True, prune=False
    )


_SHOWN = (
    "event_id", "side", "skip_reason", "price_at_signal", "price_at_signal_is_fallback", *[f"price_after_{k}min" for k in FORWARDS],
    "highest_price", "lowest_price", "percent_change", "result",
)
_STUDY_ROWS_SQL = f"""WITH {STUDY_CTES}
    SELECT event_id, side, skip_reason, round(p0, 2) AS price_at_signal,
      CASE WHEN gate IS NULL THEN back IS NULL AND ahead IS NOT NULL END AS price_at_signal_is_fallback,
      price_after_30min, price_after_60min, price_after_120min, price_after_240min, highest_price, lowest_price,
      CASE WHEN p0 IS NOT NULL AND p1 IS NOT NULL THEN
        round(CASE WHEN p0 <> 0 THEN (p1 - p0) / p0 * 100 ELSE 0 END, 2) END AS percent_change,
      CASE WHEN p0 IS NULL OR p1 IS NULL THEN NULL WHEN side = 'HOLD' THEN 'Neutral'
           WHEN (side = 'BUY' AND p1 > p0) OR (side = 'SELL' AND p1 < p0) THEN 'Correct' ELSE 'Wrong' END AS result
    FROM judged"""


@query(_STUDY_ROWS_SQL)
def event_study(t: Tables) -> DataFrame:
    return studied(t).select(*_SHOWN)


@query(_STUDY_ROWS_SQL)
def event_study_raw(t: Tables) -> DataFrame:
    """The same study on raw rows, many a minute and out of order: folded first, read for the signals' dates only."""
    one = [F.col("price").alias(c) for c in ("open", "high", "low", "close")]
    raw = ticks(t).select("event_id", "symbol", "ts", F.to_date("ts").alias("trade_date"), *one, F.col("qty").cast("long").alias("volume"))
    out = evaluate.event_study(signals(t), raw, listed(t), horizon="1h", forwards=FORWARDS, tolerance=TOLERANCE, fallback=60, seq="event_id")
    return out.select(*_SHOWN)


@query(
    f"""WITH {STUDY_CTES}
    SELECT coalesce(skip_reason, 'WRITTEN') AS reason, count(*) AS n FROM judged GROUP BY 1"""
)
def skip_reason_counts(t: Tables) -> DataFrame:
    return evaluate.skip_counts(studied(t))


@query(
    f"""WITH {STUDY_CTES}
    SELECT count(*) AS sample_size, count(*) FILTER (skip_reason IS NULL) AS written, count(skip_reason) AS skipped
    FROM judged"""
)
def study_summary(t: Tables) -> DataFrame:
    return evaluate.study_summary(studied(t))


# --- accuracy ------------------------------------------------------------------------------

PAIRS_SQL = """pairs AS (
  SELECT CASE WHEN n_chars > 2000 THEN 'BUY' WHEN lang <> 'en' THEN 'SELL' ELSE 'HOLD' END AS predicted,
         CASE WHEN toxic = 1 THEN 'SELL' WHEN quality = 1 THEN 'BUY' ELSE 'HOLD' END AS actual
  FROM documents JOIN labels USING (doc_id))"""


def pairs(t: Tables) -> DataFrame:
    """A rule on ``documents`` against the classes in ``labels``; the last label of a document counts."""
    said = F.when(F.col("n_chars") > 2000, "BUY").when(F.col("lang") != "en", "SELL").otherwise("HOLD")
    real = F.when(F.col("toxic") == 1, "SELL").when(F.col("quality") == 1, "BUY").otherwise("HOLD")
    predicted = t.documents.select("doc_id", said.alias("signal"))
    actual = t.labels.select("doc_id", real.alias("label"), F.col("doc_id").alias("seq"))
    return evaluate.matched(predicted, actual, ["doc_id"], "seq", "signal", "label")


@query(
    f"""WITH {PAIRS_SQL}, scopes AS (
      SELECT 'ALL' AS scope UNION ALL SELECT unnest(['BUY', 'SELL', 'HOLD']))
    SELECT scope, count(*) FILTER (predicted = actual) AS n_correct, count(predicted) AS n_predicted,
           round(count(*) FILTER (predicted = actual) * 100.0 / nullif(count(predicted), 0), 2) AS precision_pct
    FROM scopes LEFT JOIN pairs ON scope = 'ALL' OR scope = predicted GROUP BY scope"""
)
def accuracy_report(t: Tables) -> DataFrame:
    return evaluate.accuracy_report(pairs(t))


def _confusion_sql() -> str:
    cls = labels.CLASSES
    cells = [f"count(*) FILTER (actual = '{a}' AND predicted = '{p}') AS {a.lower()}_as_{p.lower()}" for a in cls for p in cls]
    recalls = [f"round(sum(hit) FILTER (c = '{c}') / sum(n_real) FILTER (c = '{c}'), 4) AS {c.lower()}_recall" for c in cls]
    return f"""WITH {PAIRS_SQL}, per AS (
      SELECT c, CAST(count(*) FILTER (actual = c AND predicted = c) AS DOUBLE) AS hit,
             CAST(count(*) FILTER (actual = c) AS DOUBLE) AS n_real,
             CAST(count(*) FILTER (predicted = c) AS DOUBLE) AS n_said
      FROM pairs, (SELECT unnest(['BUY', 'SELL', 'HOLD']) AS c) GROUP BY c)
    SELECT {", ".join(cells)}, (SELECT round(sum(hit) / sum(n_real), 4) FROM per) AS accuracy,
      (SELECT round(avg(2 * hit / (n_real + n_said)), 4) FROM per) AS macro_f1,
      {", ".join(f"(SELECT {r.split(' AS ')[0]} FROM per) AS {r.split(' AS ')[1]}" for r in recalls)}
    FROM pairs"""


@query(_confusion_sql())
def confusion_metrics(t: Tables) -> DataFrame:
    return evaluate.confusion_metrics(pairs(t))


@query(
    """WITH counts AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT l_orderkey, l_linenumber, l_returnflag,
      round((SELECT sum(n) FROM counts) / (3.0 * c.n) * CASE WHEN l_returnflag IN ('A', 'R') THEN 1.5 ELSE 1 END, 6) AS weight
    FROM lineitem JOIN counts c USING (l_returnflag)"""
)
def class_weights(t: Tables) -> DataFrame:
    out = labels.class_weights(
        t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag"),
        "l_returnflag",
        boosted=("A", "R"),
        classes=("A", "R", "N"),
    )
    return out.withColumn("weight", F.round("weight", 6))


# --- times and calendar --------------------------------------------------------------------

STYLES = {
    "pipe_seconds": ("hh:mm:ss a '|' dd MMM yyyy", "%I:%M:%S %p | %d %b %Y"),
    "pipe_minutes": ("hh:mm a '|' dd MMM yyyy", "%I:%M %p | %d %b %Y"),
    "slash": ("MMMM dd, yyyy'/' HH:mm 'IST'", "%B %d, %Y/ %H:%M IST"),
    "iso": ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    "at": ("MMMM dd, yyyy 'at' hh:mm a", "%B %d, %Y at %I:%M %p"),
    "historic": ("yyyy-MM-dd HH:mm:ss'+05:30 IST'", "%Y-%m-%d %H:%M:%S+05:30 IST"),
    "zulu": ("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ"),
    "visible": ("'Updated : 'MMM dd, yyyy", "Updated : %b %d, %Y"),
}

_HAS_SECONDS = "style IN ('pipe_seconds', 'iso', 'historic')"
_TIMES_SQL = f"""WITH texts AS (
  {" UNION ALL ".join(
      f"SELECT event_id, '{n}' AS style, ts, strftime(ts, '{duck}') AS published_time FROM events"
      for n, (_, duck) in STYLES.items())}),
cut AS (SELECT *, date_trunc('second', ts) AS sec, date_trunc('minute', ts) AS mi FROM texts)
SELECT event_id, style, published_time,
  CASE WHEN {_HAS_SECONDS} THEN sec WHEN style IN ('pipe_minutes', 'slash', 'at') THEN mi END AS local_time,
  CASE WHEN {_HAS_SECONDS} THEN sec WHEN style IN ('pipe_minutes', 'slash', 'at') THEN mi END
    - INTERVAL 330 MINUTE AS utc_time,
  CASE WHEN style IN ('iso', 'pipe_minutes', 'slash', 'at') THEN mi
       WHEN style = 'zulu' THEN mi + INTERVAL 330 MINUTE END AS signal_time,
  CASE WHEN {_HAS_SECONDS} THEN sec WHEN style IN ('pipe_minutes', 'slash', 'at') THEN mi
       WHEN style = 'zulu' THEN sec + INTERVAL 330 MINUTE END AS flexible_time,
  CASE WHEN style = 'iso' THEN strftime(sec, '%I:%M:%S %p | %d %b %Y') END AS site_display
FROM cut"""


@query(_TIMES_SQL)
def parse_times(t: Tables) -> DataFrame:
    """Every event time written in every published form and read back by each parser."""
    forms = F.array(*[F.struct(F.lit(n).alias("style"), F.date_format("ts", f).alias("text")) for n, (f, _) in STYLES.items()])
    rows = dealt(t.events.select("event_id", "ts"), "event_id", "ts").select("event_id", F.explode(forms).alias("s")).select(
        "event_id", "s.style", F.col("s.text").alias("published_time")
    )
    text = F.col("published_time")
    return rows.withColumns(
        {
            "local_time": timeparse.published_local(text),
            "utc_time": timeparse.published_utc(text),
            "signal_time": timeparse.signal_local(text),
            "flexible_time": timeparse.flexible_local(text),
            "site_display": timeparse.site_display(text),
        }
    )


HOLIDAYS = ("2024-01-15", "2024-01-22", "2024-01-26")

_HOLIDAY_SQL = "holidays AS (SELECT unnest([DATE '2024-01-15', DATE '2024-01-22', DATE '2024-01-26']) AS h)"
_CALENDAR_SQL = f"""{_HOLIDAY_SQL},
days AS (
  SELECT CAST(d AS DATE) AS d, isodow(d) < 6 AND CAST(d AS DATE) NOT IN (SELECT h FROM holidays) AS is_open
  FROM (SELECT unnest(generate_series(TIMESTAMP '2023-11-01', TIMESTAMP '2024-03-31', INTERVAL 1 DAY)) AS d)),
around AS (
  SELECT d, is_open,
    max(CASE WHEN is_open THEN d END) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_session,
    min(CASE WHEN is_open THEN d END) OVER (ORDER BY d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_session,
    CASE WHEN isodow(d) >= 6 THEN 'Weekend (' || dayname(d) || ')'
         WHEN d IN (SELECT h FROM holidays) THEN 'NSE Holiday (' || strftime(d, '%Y-%m-%d') || ')'
         ELSE 'Trading Day' END AS reason
  FROM days)"""


def dated(t: Tables) -> DataFrame:
    rows = t.events.withColumn("event_date", F.to_date("ts"))
    return calendar.with_sessions(rows, calendar.calendar_table(t.spark, HOLIDAYS), holidays=HOLIDAYS)


@query(
    f"""WITH {_CALENDAR_SQL}
    SELECT event_id, CAST(ts AS DATE) AS event_date, is_open AS is_trading, reason, prev_session, next_session
    FROM events JOIN around ON d = CAST(ts AS DATE)"""
)
def trading_calendar(t: Tables) -> DataFrame:
    return dated(t).select("event_id", "event_date", "is_trading", "reason", "prev_session", "next_session")


_SIDE_SQL = "CASE event_type WHEN 'purchase' THEN 'BULLISH' WHEN 'error' THEN 'BEARISH' ELSE 'NEUTRAL' END"


@query(
    f"""WITH {_CALENDAR_SQL}, e AS (
      SELECT *, CAST(ts AS TIME) AS c, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 128 AS conf
      FROM events JOIN around ON d = CAST(ts AS DATE))
    SELECT event_id,
      CASE WHEN NOT is_open THEN reason WHEN c < TIME '09:15' THEN 'Before Market Open'
           WHEN c > TIME '15:30' THEN 'After Market Close' ELSE 'Market Hours' END AS market_status,
      CASE WHEN NOT is_open OR c < TIME '09:15' THEN 'weekend_holiday' WHEN c > TIME '15:30' THEN 'after_market'
           ELSE 'intraday' END AS regime,
      c BETWEEN TIME '09:30' AND TIME '15:30' AS scoring_open,
      CASE WHEN c NOT BETWEEN TIME '09:30' AND TIME '15:30' THEN {_SIDE_SQL} END AS night_signal,
      CASE WHEN c NOT BETWEEN TIME '09:30' AND TIME '15:30' THEN
        CASE WHEN event_type = 'purchase' THEN round(conf, 4) ELSE 0 END END AS buy_prob,
      CASE WHEN c NOT BETWEEN TIME '09:30' AND TIME '15:30' THEN
        CASE WHEN event_type = 'error' THEN round(conf, 4) ELSE 0 END END AS sell_prob
    FROM e"""
)
def regime(t: Tables) -> DataFrame:
    """Market status, regime, scoring gate, and the off-hours bias of rows the gate holds back."""
    ts, is_open, kind = F.col("ts"), F.col("is_trading"), F.col("event_type")
    mood = F.when(kind == "purchase", "Positive").when(kind == "error", "Negative").otherwise("Neutral")
    night = labels.night_bias(mood, F.get_json_object("props", "$.k").cast("double") / 128)
    gate = calendar.scoring_open(ts)
    return dated(t).select(
        "event_id",
        calendar.market_status(ts, is_open, F.col("reason")).alias("market_status"),
        calendar.regime(ts, is_open).alias("regime"),
        gate.alias("scoring_open"),
        F.when(~gate, night["predicted_signal"]).alias("night_signal"),
        F.when(~gate, night["buy_prob"]).alias("buy_prob"),
        F.when(~gate, night["sell_prob"]).alias("sell_prob"),
    )


# --- features ------------------------------------------------------------------------------

_SITES = ("Moneycontrol", "CNBC-TV18", "Economic Times", "LiveMint")
_HEAD_SQL = "split_part(text, chr(10), 1)"
_REST_SQL = "CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END"


def headline(text="text"):
    return F.get(F.split(F.col(text), "\n", 2), F.lit(0))


def content(text="text"):
    return F.coalesce(F.get(F.split(F.col(text), "\n", 2), F.lit(1)), F.lit(""))


def _words_sql(words) -> str:
    return "CAST((" + " OR ".join(f"contains(blob, '{w}')" for w in words) + ") AS INTEGER)"


# Words of the generated prose join the lists so that both outcomes occur.
_REGULATORY = (*fixed.REGULATORY_WORDS, "therha")
_NEGATIVE = (*fixed.NEGATIVE_EVENT_WORDS, "ingen")


@query(
    f"""WITH d AS (
      SELECT doc_id, lower({_HEAD_SQL} || ' ' || {_REST_SQL}) AS blob,
        array_to_string(string_split({_HEAD_SQL}, ' ')[1:3], ' ') || ' Limited' AS company,
        ['Moneycontrol', 'CNBC-TV18', 'Economic Times', 'LiveMint'][CAST(doc_id % 4 AS INTEGER) + 1] AS site
      FROM documents),
    words AS (
      SELECT doc_id, any_value(blob) AS blob, any_value(company) AS company, any_value(site) AS site,
        list(w) FILTER (length(w) > 2 AND w NOT IN ('limited', 'ltd', 'ltd.', 'inc', 'corp', 'corporation', 'company', 'co')) AS kept
      FROM (SELECT *, unnest(regexp_split_to_array(trim(lower(company), ' ' || chr(9) || chr(10) || chr(13)), '\\s+')) AS w FROM d)
      GROUP BY doc_id)
    SELECT doc_id, {_words_sql(_REGULATORY)} AS is_regulatory_news, {_words_sql(_NEGATIVE)} AS is_negative_event,
      CAST(CASE WHEN kept IS NOT NULL THEN
        list_sum(list_transform(kept, lambda w: (length(blob) - length(replace(blob, w, ''))) // length(w)))
        ELSE (length(blob) - length(replace(blob, lower(company), ''))) // length(company) END AS INTEGER)
        AS company_mention_strength,
      CASE site WHEN 'Moneycontrol' THEN 0.9 WHEN 'CNBC-TV18' THEN 0.95 WHEN 'Economic Times' THEN 0.85 ELSE 0.7 END
        ::DOUBLE AS news_source_score,
      coalesce(nullif(trim(regexp_replace(company, '[^A-Za-z0-9 _.\\-]', '', 'g')), ''), 'UNKNOWN') AS file_name,
      translate(company, ' /\\', '___') AS path_name, upper(site) AS site_label
    FROM words"""
)
def text_flags_mentions(t: Tables) -> DataFrame:
    """Flags, mention counts and source scores over whole document texts."""
    first_words = F.slice(F.split(headline(), " "), 1, 3)
    company = F.concat(F.array_join(first_words, " "), F.lit(" Limited"))
    site = F.get(F.array(*[F.lit(s) for s in _SITES]), F.pmod("doc_id", F.lit(4)).cast("int"))
    rows = spread(t.documents.select("doc_id", "text")).select(
        "doc_id",
        scalars.text_blob(headline(), content()).alias("blob"),
        company.alias("company"),
        site.alias("site"),
    )
    blob, name = F.col("blob"), F.col("company")
    return rows.select(
        "doc_id",
        scalars.is_regulatory(blob, _REGULATORY).alias("is_regulatory_news"),
        scalars.is_negative_event(blob, _NEGATIVE).alias("is_negative_event"),
        scalars.mention_strength(blob, name).alias("company_mention_strength"),
        scalars.source_score(F.col("site")).alias("news_source_score"),
        scalars.sanitized_name(name).alias("file_name"),
        scalars.path_name(name).alias("path_name"),
        F.upper("site").alias("site_label"),
    )


@query(
    """SELECT event_id, round(exp(-greatest(date_diff('microsecond', ts, date_trunc('hour', ts) + INTERVAL 45 MINUTE)
        / 60000000.0, 0.0) / 15), 4) AS time_decay_15m
    FROM events WHERE event_type <> 'error'
    UNION ALL SELECT event_id, 1.0 FROM events WHERE event_type = 'error'"""
)
def time_decay(t: Tables) -> DataFrame:
    """Decay against minute 45 of the event's hour; ``error`` events play unparsable times."""
    at = clock.minute_ts(F.floor(clock.minute_no(F.col("ts")) / 60) * 60 + 45)
    known = F.when(F.col("event_type") != "error", F.col("ts"))
    return t.events.select("event_id", scalars.time_decay(known, at).alias("time_decay_15m"))


_ODD_SQL = """odd AS (
  SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS a,
    CASE WHEN l_discount = 0 THEN 'NaN'::DOUBLE ELSE l_extendedprice END AS b,
    CASE WHEN l_tax = 0 THEN '-Infinity'::DOUBLE ELSE l_tax END AS c,
    CASE WHEN l_linenumber = 4 THEN 'n/a' ELSE CAST(l_linenumber AS VARCHAR) || '.5' END AS d,
    CASE WHEN l_discount > 0.05 THEN l_discount WHEN l_discount > 0.02 THEN 0.0 END AS e
  FROM lineitem)"""


@query(
    f"""WITH {_ODD_SQL}, clean AS (
      SELECT *, CASE WHEN isfinite(b) THEN b END AS b1, CASE WHEN isfinite(c) THEN c END AS c1,
             TRY_CAST(d AS DOUBLE) AS d1 FROM odd)
    SELECT l_orderkey, l_linenumber, l_partkey,
      a IS NOT NULL AND b1 IS NOT NULL AND c1 IS NOT NULL AND d1 IS NOT NULL AS is_valid,
      coalesce(a, 0) AS a, coalesce(b1, 0) AS b, coalesce(c1, 0) AS c, coalesce(d1, 0) AS d,
      coalesce(e, 9.0) AS keeps_zero, CASE WHEN e IS NOT NULL AND e <> 0 THEN e ELSE 9.0 END AS skips_zero
    FROM clean"""
)
def feature_validity_impute(t: Tables) -> DataFrame:
    """Null, NaN, infinite and text values: validity, imputation and the two fallback rules."""
    odd = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("a"),
        F.when(F.col("l_discount") == 0, float("nan")).otherwise(F.col("l_extendedprice")).alias("b"),
        F.when(F.col("l_tax") == 0, float("-inf")).otherwise(F.col("l_tax")).alias("c"),
        F.when(F.col("l_linenumber") == 4, "n/a")
        .otherwise(F.concat(F.col("l_linenumber").cast("string"), F.lit(".5")))
        .alias("d"),
        F.when(F.col("l_discount") > 0.05, F.col("l_discount")).when(F.col("l_discount") > 0.02, 0.0).alias("e"),
    )
    cols = [F.col(c) for c in "abcd"]
    return odd.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        scalars.all_valid(cols).alias("is_valid"),
        *[scalars.imputed(F.col(c)).alias(c) for c in "abcd"],
        F.coalesce("e", F.lit(9.0)).alias("keeps_zero"),
        scalars.falsy_or(F.col("e"), F.lit(9.0)).alias("skips_zero"),
    )
