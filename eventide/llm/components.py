"""Connected components of an edge table by alternating star contractions.

Large-star: every node hands its larger neighbours to its smallest neighbour. Small-star: every
node hands its smaller neighbours to the smallest. Both keep the components; the edges end as
one star per component around its smallest node. A hub is summed up by a hash aggregate with
map-side partials, and it is the skewed side only of a join that AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import written


def _sides(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _sides(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of the edges ``u``, ``v`` (longs): the smallest node reachable.

    Loops and repeated edges do no harm; no edges give an empty table. The table of edges is
    written to the shared folder in each round, and the loop ends when a round changes nothing.
    """
    edges = edges.where("u <> v").select("u", "v").distinct()
    said = None
    while True:
        edges = written(_small_star(_large_star(edges)), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == said:
            break
        said = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
