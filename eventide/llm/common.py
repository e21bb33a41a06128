"""Helpers the corpus operators share: Arrow batches, hashes, written tables, key runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.session import scratch

# White space of the contracts: blank, tab to carriage return.
BLANKS = b" \t\n\x0b\x0c\r"
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def digests(keys: list[bytes]) -> np.ndarray:
    """128-bit hashes as an (n, 2) array of signed 64-bit halves."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype=">i8").astype(np.int64).reshape(-1, 2)


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """Set the column, or add it at the end."""
    at = batch.schema.get_field_index(name)
    if at < 0:
        return batch.append_column(name, values)
    return batch.set_column(at, pa.field(name, values.type), values)


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table for each run of equal keys of a partition that is sorted by them."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` in batches of at most ``BATCH_BYTES`` (a longer row stands alone).

    The default bound counts in tens of megabytes of text, which a Python worker and the Arrow
    buffers of its executor hold several times over. This sets the session's bound; a task hands
    back what its Arrow pool kept before its worker idles.
    """
    df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(bounded, schema)


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """Without the columns whose names an operator gives to its own results."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def row_hash(*columns: str, seed: int = 0):
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns])
