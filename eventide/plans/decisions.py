"""Queries of the small decision rules: gates, softmax, historic labels, displayed times, buffers, splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.functions import scalars
from eventide.operators import evaluate, labels, ml, state
from eventide.plans import Tables, query
from eventide.sources import readers


def _k(t: Tables) -> Column:
    return F.get_json_object("props", "$.k").cast("int")


@query(
    """WITH p AS (SELECT event_id, 1 + event_id % 3 AS a, 1 + user_id % 3 AS b, 1 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS c
      FROM events),
    q AS (SELECT event_id, a / CAST(a + b + c AS DOUBLE) AS buy, b / CAST(a + b + c AS DOUBLE) AS sell, c / CAST(a + b + c AS DOUBLE) AS hold FROM p)
    SELECT event_id, round(buy, 4) AS buy_prob, round(sell, 4) AS sell_prob, round(hold, 4) AS hold_prob,
      CASE WHEN greatest(buy, sell, hold) < 0.4 THEN 'HOLD' WHEN buy >= sell AND buy >= hold THEN 'BUY'
           WHEN sell >= hold THEN 'SELL' ELSE 'HOLD' END AS predicted_signal,
      round(greatest(buy, sell, hold), 4) AS signal_confidence FROM q"""
)
def signal_gate(t: Tables) -> DataFrame:
    """The gated signal on given probabilities: ties go to the first class, a low top is HOLD."""
    a, b, c = F.col("event_id") % 3 + 1, F.col("user_id") % 3 + 1, _k(t) % 4 + 1
    total = (a + b + c).cast("double")
    probs = {"buy_prob": a / total, "sell_prob": b / total, "hold_prob": c / total}
    rows = t.events.select("event_id", *[p.alias(n) for n, p in probs.items()])
    signal = labels.gated_signal([F.col(n) for n in probs])
    return rows.select("event_id", *[F.round(n, 4).alias(n) for n in probs], *[v.alias(n) for n, v in signal.items()])


@query(
    """WITH x AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings),
    e AS (SELECT vec_id, exp(a) AS a, exp(b) AS b, exp(c) AS c FROM x),
    p AS (SELECT vec_id, a / (a + b + c) AS n, b / (a + b + c) AS u, c / (a + b + c) AS p FROM e)
    SELECT vec_id, round(n, 6) AS negative_prob, round(u, 6) AS neutral_prob, round(p, 6) AS positive_prob,
      CASE WHEN n >= u AND n >= p THEN 'negative' WHEN u >= p THEN 'neutral' ELSE 'positive' END AS sentiment,
      round(greatest(n, u, p), 6) AS confidence, round(p - n, 6) AS sentiment_score FROM p"""
)
def softmax_sentiment(t: Tables) -> DataFrame:
    """Sentiment of three logits: here the first three components of every vector."""
    logits = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    found = scalars.sentiment_from_logits(F.col("logits"))
    rows = t.embeddings.select("vec_id", logits.alias("logits"))
    return rows.select("vec_id", *[(c if n == "sentiment" else F.round(c, 6)).alias(n) for n, c in found.items()])


@query(
    """WITH r AS (
      SELECT o_orderkey, o_orderstatus, o_totalprice, floor(o_totalprice) AS open_at FROM orders),
    m AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderkey % 11 = 0 THEN NULL ELSE open_at END AS base,
      open_at * (1 + (o_orderkey % 5 - 2) / 200.0) AS close_15, CASE WHEN o_orderkey % 3 > 0 THEN open_at * 1.03 END AS high_15,
      open_at * 0.98 AS low_15 FROM r),
    w AS (SELECT o_orderkey, (close_15 - base) / base * 100 AS ret,
      (coalesce(high_15, close_15) - low_15) / base * 100 AS vol FROM m)
    SELECT o_orderkey, round(ret, 4) AS return_15m, round(vol, 4) AS volatility_15m,
      CASE WHEN round(ret, 4) >= 0.5 THEN 'BUY' WHEN round(ret, 4) <= -0.5 THEN 'SELL' ELSE 'HOLD' END AS label,
      round(coalesce(abs(round(ret, 4)), 0), 4) AS label_strength,
      CASE WHEN ret IS NULL THEN 'missing_return' WHEN round(ret, 4) >= 0.5 THEN 'price_up_15m'
           WHEN round(ret, 4) <= -0.5 THEN 'price_down_15m' ELSE 'flat_move' END AS label_reason FROM w"""
)
def historic_labels(t: Tables) -> DataFrame:
    """Return and range against the open, and the label at the historic threshold.

    A missing open (status P) and an open of zero (each eleventh order) have no return; each
    third order lacks its high, so its close stands in.
    """
    key, open_at = F.col("o_orderkey"), F.floor("o_totalprice").cast("double")
    base = F.when(F.col("o_orderstatus") == "P", None).when(key % 11 == 0, 0.0).otherwise(open_at)
    close = open_at * (1 + (key % 5 - 2) / 200.0)
    moved = labels.historic_return(base, close, F.when(key % 3 > 0, open_at * 1.03), open_at * 0.98)
    rows = t.orders.select("o_orderkey", *[F.round(c, 4).alias(n) for n, c in moved.items()])
    return rows.withColumns(labels.label_return(F.col("return_15m"), labels.HISTORIC_THRESHOLD))


@query(
    """WITH e AS (SELECT event_id, CASE WHEN user_id % 5 > 0 THEN ts END AS ts, event_type, value FROM events)
    SELECT event_id, CAST(ts AS DATE) AS date, coalesce(strftime(ts, '%d %b %Y'), 'Date N/A') AS formatted_date,
      coalesce(strftime(ts, '%H:%M'), '--:--') AS time, upper(event_type) AS sentiment_label,
      round(value * 100, 2) AS confidence_pct FROM e"""
)
def view_times(t: Tables) -> DataFrame:
    """Columns shown to a reader; users divisible by five have no time."""
    at = F.when(F.col("user_id") % 5 > 0, F.col("ts"))
    shown = scalars.display_columns(at, F.col("event_type"), F.col("value"))
    return t.events.select("event_id", *[c.alias(n) for n, c in shown.items()])


@query(
    """SELECT event_id, coalesce(c_name, CAST(user_id * 11 AS VARCHAR)) AS symbol, value AS price
    FROM events LEFT JOIN customer ON user_id * 11 = c_custkey"""
)
def security_names(t: Tables) -> DataFrame:
    """Company names of security ids; ids beyond the mapping stand for themselves."""
    rows = t.events.select("event_id", (F.col("user_id") * 11).cast("string").alias("secid"), F.col("value").alias("price"))
    names = t.customer.select(F.col("c_custkey").alias("SECURITY_ID"), F.col("c_name").alias("CompanyName"))
    return readers.security_names(rows, names).select("event_id", "symbol", "price")


@query(
    """WITH f AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price,
      CASE WHEN o_orderkey % 7 = 0 THEN CAST('nan' AS DOUBLE) WHEN o_orderkey % 11 = 0 THEN CAST('inf' AS DOUBLE) ELSE o_totalprice / 3 END AS part,
      o_orderpriority AS said FROM orders),
    m AS (SELECT o_orderkey, concat_ws(',', CASE WHEN price IS NULL THEN 'price' END, CASE WHEN isnan(part) OR isinf(part) THEN 'part' END, 'said') AS missing,
      concat_ws(',', CASE WHEN price IS NULL THEN 'price' END, CASE WHEN isnan(part) OR isinf(part) THEN 'part' END) AS numbers FROM f)
    SELECT o_orderkey, missing, CASE WHEN numbers <> '' THEN 'missing_features' END AS skip_reason FROM m"""
)
def feature_skip_reasons(t: Tables) -> DataFrame:
    """Which features keep a row from being scored: null prices, NaN and infinite parts; a text column never is a number."""
    key = F.col("o_orderkey")
    part = F.when(key % 7 == 0, float("nan")).when(key % 11 == 0, float("inf")).otherwise(F.col("o_totalprice") / 3)
    rows = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"), part.alias("part"), F.col("o_orderpriority").alias("said")
    )
    every = ml.skip_reasons(rows, ["price", "part", "said"]).withColumn("all_missing", F.array_join("missing", ",")).select("o_orderkey", "price", "part", "all_missing")
    out = ml.skip_reasons(every, ["price", "part"])
    return out.select("o_orderkey", F.col("all_missing").alias("missing"), "skip_reason")


@query(
    """WITH p AS (SELECT d.doc_id, CASE WHEN n_chars > 2000 THEN 'BUY' WHEN lang <> 'en' THEN 'SELL' ELSE 'HOLD' END AS predicted,
      CASE WHEN toxic = 1 THEN 'SELL' WHEN quality = 1 THEN 'BUY' ELSE 'HOLD' END AS actual FROM documents d JOIN labels USING (doc_id))
    SELECT doc_id, predicted, actual, predicted = actual AS hit FROM p ORDER BY doc_id DESC LIMIT 10"""
)
def recent_matches(t: Tables) -> DataFrame:
    """The ten most recent predictions that have a label."""
    said = F.when(F.col("n_chars") > 2000, "BUY").when(F.col("lang") != "en", "SELL").otherwise("HOLD")
    real = F.when(F.col("toxic") == 1, "SELL").when(F.col("quality") == 1, "BUY").otherwise("HOLD")
    predictions = t.documents.select("doc_id", said.alias("signal"))
    actuals = t.labels.select("doc_id", real.alias("label"), F.col("doc_id").alias("seq"))
    pairs = evaluate.matched(predictions, actuals, ["doc_id"], "seq", "signal", "label")
    return evaluate.recent_matches(pairs, [F.col("doc_id").desc()]).select("doc_id", "predicted", "actual", "hit")


# The buffer holds the last order of each customer before 1996, the batch the last one since.
@query(
    """WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate < TIMESTAMP '1996-01-01' AS early, o_orderdate FROM orders),
    l AS (SELECT early, o_custkey, max((o_orderdate, o_orderkey)) AS top FROM o GROUP BY ALL),
    s AS (SELECT l.early, o.o_custkey, o.o_orderkey, o.o_totalprice FROM l JOIN o ON o.o_orderkey = l.top[2])
    SELECT 'open' AS market, 'score' AS route, o_custkey, o_orderkey, o_totalprice FROM s
    UNION ALL SELECT 'closed', 'buffer', o_custkey, o_orderkey, o_totalprice FROM s a
      WHERE NOT early OR NOT EXISTS (SELECT 1 FROM s b WHERE b.o_custkey = a.o_custkey AND NOT b.early)"""
)
def buffer_route(t: Tables) -> DataFrame:
    """Both routes: an open market scores buffer and batch, a closed one merges the batch into the buffer."""
    newest = [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]
    day = F.lit("1996-01-01").cast("timestamp_ntz")
    sides = [t.orders.filter(F.col("o_orderdate") < day), t.orders.filter(F.col("o_orderdate") >= day)]
    buffer, batch = (state.first_per_key(s, ["o_custkey"], newest).select("o_custkey", "o_orderkey", "o_totalprice") for s in sides)
    out = []
    for market, is_open in (("open", True), ("closed", False)):
        score, kept = state.buffer_or_release(batch, buffer, is_open, ["o_custkey"])
        out += [rows.select(F.lit(market).alias("market"), F.lit(route).alias("route"), "*") for route, rows in (("score", score), ("buffer", kept))]
    return reduce(DataFrame.unionByName, out)


@query(
    """WITH draw AS (SELECT doc_id, quality, CAST('0x' || substr(md5(doc_id || '|' || quality || '|42'), 1, 8) AS BIGINT) AS h
      FROM labels WHERE quality IS NOT NULL)
    SELECT doc_id, quality, h / 4294967296.0 < 0.8 AS is_train FROM draw"""
)
def stratified_split(t: Tables) -> DataFrame:
    """The repeatable random split: a draw from key, class and seed."""
    rows = t.labels.filter("quality is not null").select("doc_id", "quality")
    return ml.stratified_split(rows, "doc_id", "quality")


_RUNS_SQL = """runs AS (
  SELECT o_custkey AS feed, o_orderkey AS run, o_totalprice / 1000000 AS accuracy, (o_orderkey % 7) / 10.0 AS macro_f1 FROM orders)"""


@query(
    f"""WITH {_RUNS_SQL}, before AS (
      SELECT *, lag(accuracy) OVER w AS last_accuracy, lag(macro_f1) OVER w AS last_f1, lag(run) OVER w AS last_run
      FROM runs WINDOW w AS (PARTITION BY feed ORDER BY run))
    SELECT feed, run, last_run IS NULL OR accuracy >= last_accuracy OR macro_f1 >= last_f1 AS deployed FROM before"""
)
def deploy_gate(t: Tables) -> DataFrame:
    """Which run of a feed may be deployed after the one before it."""
    rows = t.orders.select(
        F.col("o_custkey").alias("feed"), F.col("o_orderkey").alias("run"),
        (F.col("o_totalprice") / 1000000).alias("accuracy"), ((F.col("o_orderkey") % 7) / 10.0).alias("macro_f1"),
    )
    return ml.deployable(rows, ["feed"], "run").select("feed", "run", "deployed")
