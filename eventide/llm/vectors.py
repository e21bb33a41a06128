"""Vector tables: which rows take part, equal vectors, queries in blocks, the best of all blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUERY_BLOCK = 2048


def usable(v: Column, nonzero: bool) -> Column:
    """Not null or empty, every component finite, and (if asked) not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False))
    return ok & F.exists(v, lambda x: x != 0) if nonzero else ok


def smallest_ids(rows: DataFrame, keep: int) -> DataFrame:
    """At most ``keep`` rows of equal vectors ``v``, those with the smallest ids.

    No search for fewer neighbours than that can return others, since they tie with these in
    every score and lose the tie. Spark limits the rows of a vector before they are shuffled.
    """
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    return rows.withColumn("_n", place).where(F.col("_n") <= keep).drop("_n")


def query_blocks(queries: DataFrame, shards: int) -> DataFrame:
    """(shard, ids, vectors) for every shard and every block of about ``QUERY_BLOCK`` queries (id, v)."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    at = F.pmod(F.xxhash64(F.lit("queries"), "id"), F.lit(blocks))
    packed = queries.groupBy(at.alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("q"))
    one = packed.select("block", F.col("q.id").alias("ids"), F.col("q.v").alias("vectors"))
    return one.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))


def matrix(lists: list, width: int, dtype) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros, longer ones are cut to ``width``, which adds nothing to a product."""
    out = np.zeros((len(lists), width), dtype=dtype)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v[:width]
    return out


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows (query_id, vec_id, score) of each query with their ``rank``."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
