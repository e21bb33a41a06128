"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is one line of words: its documents in the order of a hash, cut into blocks of equal
length. A source's quota is a number of whole passes over its blocks plus the first blocks of a
permuted order, the last of them cut, so that the words taken equal the target. A binary tree
over the output shards splits the vector of block quotas: each node draws the part of its left
half from a multivariate hypergeometric distribution, seeded by the node, so every shard can
walk down from the root alone. Shards then own disjoint ranges of the permuted draws and are
shuffled locally.

Word offsets come from sums per (source, hash bucket) and a window inside a bucket, so no task
sorts a whole source, however large its share. Only per-source totals reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from eventide.llm.common import BLANKS, as_bytes, fresh, in_batches, with_column, written

BLOCK_WORDS = 1024
MOST_BLOCKS = 500_000_000  # blocks of all sources; blocks grow beyond it
BUCKET_ROWS = 10_000
STEP = 2_147_483_629  # a prime above any number of blocks of a source: coprime to all of them
DRAWS = 64  # draws per lookup bucket
MOST_PARTITIONS = 20_000  # of the output; with more shards than that a partition holds several, one after the other
OWN = ("_src", "_h", "_bits", "_bucket", "_before", "_start", "_size", "_total", "_target", "_full", "_blocks", "_passes", "_rest", "_pieces")

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(rows: DataFrame, source_col: str, weights: tuple[int, ...], most: int) -> DataFrame:
    """Per source: ``_total``, rows and ``_target``, water-filled under ``most`` times the total.

    Sources in code point order, null last, take the weights in turn. Sorted by what their cap
    allows per weight, the sources before a cut are at their cap, and the level of the others is
    what is left over their weights.
    """
    per = rows.groupBy(source_col, "_src").agg(F.sum("_size").alias("_total"), F.count("*").alias("_rows"))
    place = F.row_number().over(Window.orderBy(F.col(source_col).asc_nulls_last())) - 1
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    cap = F.col("_total").cast("double") * most
    line = Window.orderBy(cap / F.col("_w"), F.col(source_col).asc_nulls_last())
    before = F.coalesce(F.sum(cap).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    behind = F.sum("_w").over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("_total").over(everything).cast("double")
    per = per.withColumn("_level", (total - before) / behind)
    # The first source, in this order, whose share at its level is within its cap sets the level.
    free = F.when(cap >= F.col("_level") * F.col("_w"), F.struct((cap / F.col("_w")).alias("k"), F.col("_src").alias("s"), F.col("_level").alias("v")))
    level = F.coalesce(F.min(free).over(everything)["v"], F.lit(0.0))
    return per.withColumn("_target", F.least(cap, level * F.col("_w"))).drop("_level", "_w")


def split_quotas(quotas: np.ndarray, shards: int, shard: int, seed: int) -> np.ndarray:
    """Blocks per source of one shard: the leaf of the splitting tree."""
    lo, hi, left = 0, shards, quotas.copy()
    total = int(quotas.sum())
    edge = lambda i: total * i // shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        part = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(left, edge(mid) - edge(lo), method="marginals")
        if shard < mid:
            hi, left = mid, part
        else:
            lo, left = mid, left - part
    return left


def shard_ranges(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(_src, shard, _lo, _hi, _part): the draws each shard owns, with a row per lookup bucket."""
    spark = quotas.sparkSession
    rows = sorted((r._src, int(r._quota)) for r in quotas.select("_src", "_quota").collect())  # one row a source
    names, counts = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                own = split_quotas(counts, shards, shard, seed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array([shard] * len(names), pa.int64()), pa.array(own, pa.int64())], names=["_src", "shard", "_n"]
                )

    if not names:
        return spark.createDataFrame([], "_src string, shard long, _lo long, _hi long, _part long")
    leaves = in_batches(spark.range(shards), run, "_src string, shard long, _n long")
    hi = F.sum("_n").over(Window.partitionBy("_src").orderBy("shard"))
    ranges = leaves.withColumn("_hi", hi).withColumn("_lo", F.col("_hi") - F.col("_n")).where("_n > 0").drop("_n")
    return ranges.withColumn("_part", F.explode(F.sequence(F.expr(f"_lo div {DRAWS}"), F.expr(f"(_hi - 1) div {DRAWS}"))))


def _pieces(block: int, seed: int) -> Column:
    """The parts of a document that the mix takes: pass, words from and to (of the document), draw."""
    c = F.col
    first, last = F.expr(f"_start div {block}"), F.expr(f"(_start + _size - 1) div {block}")

    def place(b: Column) -> Column:
        # Full blocks are permuted; a short last block keeps the last place.
        return F.when(b < c("_full"), (b * STEP + seed) % c("_full")).otherwise(c("_full"))

    def piece(k: Column, b: Column) -> Column:
        lo = F.greatest(c("_start"), b * block)
        cut = F.when(k < c("_passes"), F.lit(block)).otherwise(F.least(F.lit(block), F.greatest(F.lit(0), c("_rest") - place(b) * block)))
        hi = F.least(c("_start") + c("_size"), b * block + cut)
        return F.struct(
            k.cast("int").alias("pass"), (lo - c("_start")).alias("from"), (hi - c("_start")).alias("to"), (k * c("_blocks") + place(b)).alias("draw")
        )

    passes = F.sequence(F.lit(0).cast("long"), c("_passes"))
    every = F.flatten(F.transform(passes, lambda k: F.transform(F.sequence(first, last), lambda b: piece(k, b))))
    kept = F.filter(every, lambda p: p["to"] > p["from"])
    return F.when(c("_size") > 0, kept).otherwise(F.filter(F.array(piece(F.lit(0).cast("long"), F.lit(0).cast("long"))), lambda p: F.lit(False)))


def plan(
    docs: DataFrame, size: Column, id_col: str, source_col: str, weights: tuple[int, ...], most: int, seed: int
) -> tuple[DataFrame, DataFrame, int]:
    """The rows with ``_start``, ``_total``, ``_target`` and ``_pieces``; the quotas per source; the words taken."""
    docs = fresh(docs, *OWN)
    rows = docs.withColumn("_size", size).withColumn("_src", F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")))
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), F.col(id_col), F.col("_size")))
    per = written(targets(rows, source_col, weights, most).drop(source_col), "mix-targets")
    words, taken = per.agg(F.coalesce(F.sum("_total"), F.lit(0)), F.coalesce(F.sum(F.floor("_target")), F.lit(0))).first()
    block = max(BLOCK_WORDS, -(-int(words) * most // MOST_BLOCKS))
    want = F.floor(F.col("_target")).cast("long")
    full, total = F.expr(f"_total div {block}"), F.col("_total")
    passes = F.when(total > 0, F.expr("floor(_target) div greatest(_total, 1)")).otherwise(F.lit(0).cast("long"))
    rest = want - passes * total
    blocks = F.ceil(total / block).cast("long")
    per = per.select(
        "_src", "_total", "_target", full.alias("_full"), blocks.alias("_blocks"), passes.alias("_passes"), rest.alias("_rest"),
        (passes * blocks + F.ceil(rest / block).cast("long")).alias("_quota"),
        F.least(F.lit(40), F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.lit(1), F.col("_rows")) / BUCKET_ROWS)).cast("int"))).alias("_bits"),
    )
    rows = rows.join(per.drop("_quota"), "_src")
    rows = rows.withColumn("_bucket", F.expr("shiftrightunsigned(_h, 64 - _bits)"))
    sums = rows.groupBy("_src", "_bucket").agg(F.sum("_size").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("_src").orderBy("_bucket")) - F.col("_sum")
    rows = rows.join(sums.select("_src", "_bucket", before.alias("_before")), ["_src", "_bucket"])
    inside = Window.partitionBy("_src", "_bucket").orderBy("_h", id_col, "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_start", F.col("_before") + F.sum("_size").over(inside) - F.col("_size"))
    return rows.withColumn("_pieces", _pieces(block, seed)), per.select("_src", "_quota"), int(taken)


def shards_for(taken: int, shard_words: int) -> int:
    return max(1, -(-taken // shard_words))


def draws(
    docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3,
    seed: int = 17, shard_words: int = 2_000_000,
) -> tuple[DataFrame, DataFrame]:
    """The mix as two tables.

    The first has a row per document: its columns, ``_size``, ``_total`` (of its source),
    ``_target`` and ``_start`` (its place in its source). The second has a row per piece the mix
    takes: ``_src``, ``_start``, ``shard``, ``pass``, ``from``, ``to`` (words of the document).

    Sources, null last, take the weights in turn and share all words; a target stops at ``most``
    times its source, and the excess goes to the others by weight. The words taken from a source
    are its target rounded down, and no document is taken more than ``most`` times. Null texts
    and texts without words have size 0 and no pieces. Null ids and repeated rows are rows like
    any other. Columns with the names in ``OWN`` are dropped. Equal input gives equal output, however
    it is partitioned; rows of equal id, source and size may trade places. An empty table gives
    empty tables.
    """
    rows, quotas, taken = plan(docs, size, id_col, source_col, weights, most, seed)
    ranges = shard_ranges(quotas, shards_for(taken, shard_words), seed)
    pieces = rows.select("_src", "_start", F.inline("_pieces")).withColumn("_part", F.expr(f"draw div {DRAWS}"))
    placed = pieces.join(ranges, ["_src", "_part"]).where("draw >= _lo and draw < _hi")
    return rows.drop("_pieces"), placed.select("_src", "_start", "shard", "pass", "from", "to")


def _slices(text_col: str):
    blank = bytes.maketrans(BLANKS, b" " * len(BLANKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(batch.schema.get_field_index(text_col)))
            rows, out, draw = [], [], []
            for i, pieces in enumerate(batch.column(batch.schema.get_field_index("_pieces")).to_pylist()):
                runs: list[list[int]] = []  # neighbouring pieces of one pass are one text
                for p in sorted(pieces, key=lambda p: (p["pass"], p["from"])):
                    if runs and runs[-1][0] == p["pass"] and runs[-1][2] == p["from"]:
                        runs[-1][2] = p["to"]
                    else:
                        runs.append([p["pass"], p["from"], p["to"], p["draw"]])
                if not runs:
                    continue
                text = texts[i] or b""
                plain = np.frombuffer(text.translate(blank), dtype=np.uint8) != 32
                edges = np.flatnonzero(np.diff(np.concatenate([[0], plain.view(np.int8), [0]])))
                begins, n = edges[::2], len(edges) // 2
                for _, a, b, d in runs:
                    at = 0 if a == 0 else int(begins[a])
                    to = len(text) if b == n else int(begins[b])
                    out.append(text[at:to] if (a, b) == (0, n) else text[at:to].rstrip(BLANKS))
                    rows.append(i)
                    draw.append(d)
            if rows:
                made = batch.drop_columns(["_pieces"]).take(pa.array(rows, pa.int64()))
                made = with_column(made, text_col, pa.array(out, pa.binary()).cast(pa.string()))
                yield with_column(made, "_draw", pa.array(draw, pa.int64()))

    return run


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, shard_words: int = 2_000_000) -> DataFrame:
    """The mixed texts in the columns of ``docs``, dealt to shards and shuffled inside each.

    A document stands once for every pass that takes it whole; where a pass takes a part of it,
    the part stands alone (from word to word, inner white space as it was). Texts without words
    are not taken. See ``draws`` for everything else. The caller's columns travel in one struct, so their
    names do not matter.
    """
    columns, others = docs.columns, [c for c in docs.columns if c != text_col]
    held = F.struct(F.lit(0).alias("c"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)]).alias("_row")
    packed = docs.select(held, F.col(id_col).alias("_doc"), F.col(source_col).alias("_from"), F.col(text_col).cast("string").alias("_text"))
    rows, quotas, taken = plan(packed, word_count(F.col("_text")), "_doc", "_from", (1, 2, 3), 3, seed)
    shards = shards_for(taken, shard_words)
    rows = rows.select("_row", "_doc", "_text", "_src", "_pieces")
    schema = T.StructType([*[f for f in rows.schema if f.name != "_pieces"], T.StructField("_draw", T.LongType())])
    texts = in_batches(rows, _slices("_text"), schema).withColumn("_part", F.expr(f"_draw div {DRAWS}"))
    ranges = shard_ranges(quotas, shards, seed)
    placed = texts.join(ranges, ["_src", "_part"]).where("_draw >= _lo and _draw < _hi")
    local = F.xxhash64(F.lit(seed + 1), "_src", "_draw", F.col("_doc"))
    back = [F.col("_text").alias(c) if c == text_col else F.col("_row")[f"c{others.index(c)}"].alias(c) for c in columns]
    # By number, not by hash: each partition gets equally many shards, none stays empty.
    n = min(shards, MOST_PARTITIONS)
    return placed.repartitionById(n, F.pmod("shard", F.lit(n)).cast("int")).sortWithinPartitions("shard", local).select(*back)
