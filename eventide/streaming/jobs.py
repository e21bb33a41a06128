"""Streaming twins of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventide.functions import clock
from eventide.operators import bars as bar_ops
from eventide.operators import evaluate, state
from eventide.sources.tables import KeyedTable, KeySet
from eventide.streaming.ordered import InOrder

# Fixed value: seconds a tick of the previous minute is still accepted.
GRACE_SECONDS = 2


def file_stream(spark: SparkSession, folder: str, name: str, schema, max_files: int | None = None) -> DataFrame:
    """A Parquet file stream over the files called ``name`` (a glob) in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def run_available(
    df: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = (), trigger: dict | None = None
) -> StreamingQuery:
    """Append a stream to a Parquet table (exactly once, by the sink's own log)."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path)
    writer = writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.start()


def run_batches(df: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def candles(
    ticks: DataFrame,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    price: str = "price",
    qty: str = "qty",
    seq: str | None = None,
    minutes: int = 1,
    lateness: str = f"{GRACE_SECONDS} seconds",
) -> DataFrame:
    """Tumbling OHLCV candles of a tick stream.

    The watermark plays the grace period: a candle is emitted once, when the watermark
    passes its end; later ticks for it are dropped and counted by Spark. Buffers are
    primitive, so ticks of a busy symbol are folded before the exchange. Candles still
    open at the end of a session come from ``tick_bars`` over the day's stored ticks.
    """
    order = clock.order_key(F.col(ts), F.col(seq) if seq else None)
    # Watermarks need a zoned type; in the pinned UTC session the cast keeps the wall-clock value.
    zoned = ticks.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = zoned.withWatermark(ts, lateness).select(
        *keys, ts, F.col(price).alias("__p"), F.coalesce(F.col(qty), F.lit(0)).cast("long").alias("__q"), order.alias("__o")
    )
    out = rows.groupBy(*keys, F.window(ts, f"{minutes} minutes").alias("w")).agg(
        F.min_by("__p", "__o").alias("open"),
        F.max("__p").alias("high"),
        F.min("__p").alias("low"),
        F.max_by("__p", "__o").alias("close"),
        F.sum("__q").alias("volume"),
        F.count(F.lit(1)).alias("n_ticks"),
    )
    start = F.col("w.start").cast("timestamp_ntz")
    return out.select(
        *keys, F.to_date(start).alias("trade_date"), start.alias("ts"), "open", "high", "low", "close", "volume", "n_ticks"
    )


def open_candles(ticks: DataFrame, ts: str = "ts", seq: str | None = None, minutes: int = 1, lateness: int = GRACE_SECONDS) -> DataFrame:
    """The candles that ``candles`` still holds open after all of ``ticks``: the flush at the end of a session.

    Only the stored ticks after the last watermark's candle are read, found by one maximum.
    """
    last = ticks.agg(F.max(clock.micros(F.col(ts))) - lateness * 1_000_000).scalar()
    size = minutes * clock.MINUTE_US
    end = (F.floor(clock.micros(F.col(ts)) / size) + 1) * size
    return bar_ops.tick_bars(ticks.filter(end > last), ts=ts, seq=seq, minutes=minutes)


def tick_accepted(ts: Column, arrived: Column, grace: int = GRACE_SECONDS) -> Column:
    """Wall-clock rule: the running minute, or the one before during the first seconds."""
    behind = clock.minute_no(arrived) - clock.minute_no(ts)
    second = F.floor(F.pmod(clock.micros(arrived), F.lit(clock.MINUTE_US)) / 1_000_000)
    return (behind == 0) | ((behind == 1) & (second <= grace))


def dedup_into(table: KeyedTable, order: Sequence) -> Callable[[DataFrame, int], None]:
    """Batch step that stores only keys never stored before, whatever their age.

    A batch is reduced to one row per key on the map side before it meets the stored keys.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        table.append_unseen(batch, batch_id, order)

    return step


def dedup_within(df: DataFrame, keys: Sequence[str], ts: str, horizon: str) -> DataFrame:
    """Bounded-state dedup: duplicates are recognised within the horizon."""
    zoned = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return zoned.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(list(keys))


class HvStream:
    """Rolling volatility across micro-batches, of ticks that may come late and in any order.

    Ticks wait in ``InOrder`` until the watermark passes them. State is a table: the last ``prices - 1``
    ticks of each running (symbol, session). A batch runs the block-wise batch operator over state and due
    ticks together, so a busy symbol is spread over tasks in the stream as well, and a replayed
    batch reads the same earlier state. Ticks behind the watermark are put aside in ``order.late()``.
    """

    def __init__(
        self, spark: SparkSession, path: str, key: str = "symbol", session: str = "trade_date", ts: str = "ts", price: str = "price",
        seq: str = "event_id", prices: int = bar_ops.HV_PRICES, lateness: int = 0,
    ):
        self.spark, self.path, self.keys, self.ts, self.price, self.seq, self.prices = spark, path, [key, session], ts, price, seq, prices
        self.order = InOrder(spark, f"{path}/order", ts, lateness)

    def step(self, batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        self._advance(self.order.step(batch, batch_id), batch_id)
        batch.unpersist()

    def flush(self, like: DataFrame, batch_id: int) -> None:
        """The ticks that still wait, as a last batch of its own."""
        self._advance(self.order.rest(like), batch_id)

    def _advance(self, due: DataFrame, batch_id: int) -> None:
        rows = due.withColumn("__old", F.lit(False))
        if batch_id > 0:
            held = self.spark.read.schema(due.schema).parquet(f"{self.path}/tail/batch={batch_id - 1}")
            rows = rows.unionByName(held.withColumn("__old", F.lit(True)))
        done = bar_ops.rolling_hv(rows, self.keys, self.ts, self.price, self.seq, self.prices)
        done.filter(~F.col("__old")).drop("__old").write.mode("overwrite").parquet(f"{self.path}/hv/batch={batch_id}")
        key, session = self.keys
        current = rows.groupBy(key).agg(F.max(session).alias(session))
        last = state.top_per_key(rows, self.keys, [F.col(self.ts).desc(), F.col(self.seq).desc()], self.prices - 1)
        last.join(current, self.keys, "left_semi").drop("__old").write.mode("overwrite").parquet(f"{self.path}/tail/batch={batch_id}")


def hv_into(spark: SparkSession, path: str, **how) -> Callable[[DataFrame, int], None]:
    """Batch step of ``HvStream``."""
    return HvStream(spark, path, **how).step


class CandleStream:
    """Candles with an exact account of the ticks that come for a minute already closed.

    A minute closes when the watermark passes its end; its ticks are folded once, then. ``late`` holds
    every tick that was left out, in contrast to the counter of ``candles``, which counts after folding.
    """

    def __init__(self, spark: SparkSession, path: str, ts: str = "ts", seq: str | None = None, minutes: int = 1, lateness: int = GRACE_SECONDS):
        size = minutes * clock.MINUTE_US
        end = (F.floor(clock.micros(F.col(ts)) / size) + 1) * size
        self.order = InOrder(spark, f"{path}/order", ts, lateness, end)
        self.path, self.how = path, {"ts": ts, "seq": seq, "minutes": minutes}

    def step(self, batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        due = self.order.step(batch, batch_id)
        bar_ops.tick_bars(due, **self.how).write.mode("overwrite").parquet(f"{self.path}/out/batch={batch_id}")
        batch.unpersist()

    def open_candles(self, like: DataFrame) -> DataFrame:
        """The candles of the minutes that are still open."""
        return bar_ops.tick_bars(self.order.rest(like), **self.how)


def dedup_by_prefix(known: KeySet, path: str, order: Sequence) -> Callable[[DataFrame, int], None]:
    """Batch step that stores rows with keys never stored before; only the hash prefixes of the batch are read."""

    def step(batch: DataFrame, batch_id: int) -> None:
        known.add_unseen(batch, batch_id, order).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return step


def live_pairs(
    predictions: DataFrame, labels: DataFrame, key: str, pred: str, actual: str, ts: str = "ts", horizon: str = "1 hour", lateness: str = "1 minute"
) -> DataFrame:
    """Both sides as streams: every label with the prediction of its key made within ``horizon`` before it.

    Both watermarks and the interval bound what Spark keeps: a prediction is dropped once no label in time can come.
    """
    p = predictions.select(F.col(key), F.col(pred).alias("predicted"), F.col(ts).cast("timestamp").alias("__made")).withWatermark("__made", lateness)
    a = labels.select(F.col(key).alias("__key"), F.col(actual).alias("actual"), F.col(ts).cast("timestamp").alias("__told")).withWatermark("__told", lateness)
    near = F.expr(f"__key = {key} AND __told >= __made AND __told <= __made + INTERVAL {horizon}")
    return p.join(a, near).select(key, "predicted", "actual")


def counts_into(path: str) -> Callable[[DataFrame, int], None]:
    """Batch step: the (predicted, actual) counts of a batch of pairs under its number; their sum is the running state."""

    def step(batch: DataFrame, batch_id: int) -> None:
        counted = batch.groupBy("predicted", "actual").agg(F.count(F.lit(1)).alias("n"))
        counted.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return step


def live_confusion(labels: DataFrame, predictions: DataFrame, key: str, pred: str, actual: str) -> DataFrame:
    """Stream of labels against stored predictions: running (predicted, actual) counts (complete mode)."""
    known = predictions.select(F.col(key), F.col(pred).alias("predicted"))
    return (
        labels.select(F.col(key), F.col(actual).alias("actual"))
        .join(known, key)
        .groupBy("predicted", "actual")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def accuracy_from_counts(counts: DataFrame, classes: Sequence[str] = evaluate.labels.CLASSES) -> DataFrame:
    """The accuracy report from the K x K running counts."""
    hit = F.col("predicted") == F.col("actual")
    per = counts.groupBy(F.col("predicted").alias("scope")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_correct"), F.sum("n").alias("n_predicted")
    )
    whole = counts.agg(
        F.lit("ALL").alias("scope"),
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_correct"),
        F.sum("n").alias("n_predicted"),
    )
    listed = per.filter(F.col("scope").isin(*classes)).unionByName(whole)
    return listed.withColumn("precision_pct", F.round(F.try_divide(F.col("n_correct") * 100.0, F.col("n_predicted")), 2))
