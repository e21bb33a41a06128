"""Stored tables that survive lost executors and replayed batches.

Every run writes its own sub-folder ``batch=<id>`` in overwrite mode, so a replayed batch
replaces its own output and nothing else. Readers prune by ``batch``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.operators import state


def rounded(df: DataFrame, columns: Sequence[str], places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns if c in df.columns})


def overwrite(df: DataFrame, path: str) -> None:
    """Replace a table; the target must not be read by ``df``."""
    df.write.mode("overwrite").parquet(path)


def write_bars(bars: DataFrame, path: str, mode: str = "append") -> None:
    """Bars by trade date: prices with 2 places, volatilities with 4."""
    out = rounded(rounded(bars, ("open", "high", "low", "close"), 2), ("hv", "iv"), 4)
    out.write.mode(mode).partitionBy("trade_date").parquet(path)


COLUMNS = "__columns"


class KeyedTable:
    """An append or upsert table of batches keyed by ``keys``."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path, list(keys)

    def read(self, before: int | None = None) -> DataFrame | None:
        """All batches (below ``before``), or None while nothing is stored."""
        try:
            rows = self.spark.read.option("mergeSchema", "true").parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        return rows if before is None else rows.filter(F.col("batch") < before)

    def _write(self, rows: DataFrame, batch: int) -> DataFrame:
        target = f"{self.path}/batch={batch}"
        rows.write.mode("overwrite").parquet(target)
        return self.spark.read.schema(rows.schema).parquet(target)

    def append_unseen(self, rows: DataFrame, batch: int, order: Sequence | None = None) -> DataFrame:
        """Store rows with unknown keys; the result is what this batch added."""
        held = self.read(before=batch)
        if held is not None:
            rows = state.unseen(rows, held, self.keys, order)
        elif order is not None:
            rows = state.first_per_key(rows, self.keys, order)
        return self._write(rows, batch)

    def upsert(self, rows: DataFrame, batch: int, order: Sequence | None = None) -> DataFrame:
        """Store the batch's last row per key; ``latest`` merges batches on read.

        The batch keeps the names of its columns, so that a column it lacks is told from a null.
        """
        if order is not None:
            rows = state.first_per_key(rows, self.keys, order)
        return self._write(rows.withColumn(COLUMNS, F.array(*[F.lit(c) for c in rows.columns])), batch).drop(COLUMNS)

    def latest(self) -> DataFrame | None:
        """One row per key: each column from the newest batch that has the column, null or not.

        Batches up to the last snapshot are not read.
        """
        upto, base = self._snapshot()
        rows = self.read()
        if rows is None:
            return None
        rows = rows.filter(F.col("batch") > upto) if base is not None else rows
        if COLUMNS not in rows.columns:
            every = rows if base is None else base.unionByName(rows, allowMissingColumns=True)
            return state.first_per_key(every, self.keys, [F.col("batch").desc()])
        if base is not None:
            held = [c for c in base.columns if c != "batch"]
            rows = base.withColumn(COLUMNS, F.array(*[F.lit(c) for c in held])).unionByName(rows, allowMissingColumns=True)
        rest = [c for c in rows.columns if c not in (*self.keys, COLUMNS, "batch")]
        # The newest batch may hold a null: max_by takes it as it is, only batches without the column are passed over.
        newest = [F.max_by(c, F.when(F.array_contains(COLUMNS, c), F.col("batch"))).alias(c) for c in rest]
        return rows.groupBy(*self.keys).agg(*newest, F.max("batch").alias("batch")).select(*self.keys, *rest, "batch")

    def _snapshot(self) -> tuple[int, DataFrame | None]:
        try:
            held = self.spark.read.parquet(f"{self.path}_snapshots")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return -1, None
        upto = held.agg(F.max("upto")).first()[0]
        return (-1, None) if upto is None else (upto, self.spark.read.parquet(f"{self.path}_snapshots/upto={upto}"))

    def snapshot(self) -> int:
        """Store what ``latest`` gives, so that later reads fold only newer batches; returns the last batch in it."""
        rows = self.latest()
        upto = -1 if rows is None else rows.agg(F.max("batch")).first()[0]
        if upto is not None and upto >= 0:
            rows.write.mode("overwrite").parquet(f"{self.path}_snapshots/upto={upto}")
        return -1 if upto is None else upto


class KeySet:
    """Keys seen so far, by a prefix of their hash: a batch reads the prefixes of its own keys and no others."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], prefixes: int = 256):
        self.table, self.path, self.keys, self.prefixes = KeyedTable(spark, path, keys), path, list(keys), prefixes

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("prefix", F.pmod(F.xxhash64(*self.keys), F.lit(self.prefixes)).cast("int"))

    def known(self, prefixes: Sequence[int], before: int | None = None) -> DataFrame | None:
        """The keys under some prefixes; other folders are not opened."""
        held = self.table.read(before)
        return None if held is None or "prefix" not in held.columns else held.filter(F.col("prefix").isin(list(prefixes)))

    def add_unseen(self, rows: DataFrame, batch: int, order: Sequence | None = None) -> DataFrame:
        """Rows with unknown keys, whose keys are stored under ``batch``; a replayed batch gives the same rows."""
        if order is not None:
            rows = state.first_per_key(rows, self.keys, order)
        placed = self._placed(rows)
        wanted = [r.prefix for r in placed.select("prefix").distinct().collect()]  # at most ``prefixes`` numbers
        held = self.known(wanted, batch)
        fresh = placed if held is None else state.unseen(placed, held, ["prefix", *self.keys])
        keys = fresh.select("prefix", *self.keys).distinct().repartition("prefix")
        keys.write.mode("overwrite").partitionBy("prefix").parquet(f"{self.path}/batch={batch}")
        return fresh.drop("prefix")

    def compact(self, path: str) -> KeySet:
        """The same keys in one batch at another path, one file a prefix: for a set of many small batches."""
        held = self.table.read()
        last = held.agg(F.max("batch")).first()[0]
        kept = held.select("prefix", *self.keys).distinct().repartition("prefix")
        kept.write.mode("overwrite").partitionBy("prefix").parquet(f"{path}/batch={last}")
        return KeySet(self.table.spark, path, self.keys, self.prefixes)
