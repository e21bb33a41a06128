"""Keyed state between runs: dedup, append, upsert, lookup, repair and buffering.

Keys compare null-safe (a missing key equals a missing key). "First" and "latest" rows
are taken with a ranked filter, which Spark limits on the map side before the shuffle,
so a key that holds a third of all rows leaves at most one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _cols(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*_cols(order)))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1)


def same_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    return reduce(and_, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def unseen(
    batch: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[str | Column] | None = None
) -> DataFrame:
    """Rows of the batch whose key the target does not hold.

    Duplicates inside the batch stay unless ``order`` says which one to keep. The known
    keys are reduced to distinct ones first, so only the batch side can be skewed.
    """
    if order is not None:
        batch = first_per_key(batch, keys, order)
    known = existing.select(*keys).distinct()
    return batch.alias("b").join(known.alias("k"), same_keys("b", "k", keys), "left_anti")


def appended(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    return existing.unionByName(fresh, allowMissingColumns=True)


def known_flags(batch: DataFrame, existing: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column, whether any row of the target holds the batch row's value: ``<c>_known``."""
    out = batch
    for c in columns:
        held = existing.select(c).distinct().withColumn(f"{c}_known", F.lit(True))
        out = (
            out.alias("b")
            .join(held.alias("k"), same_keys("b", "k", [c]), "left")
            .select("b.*", F.coalesce(f"k.{c}_known", F.lit(False)).alias(f"{c}_known"))
        )
    return out


def drop_known(batch: DataFrame, existing: DataFrame, url: str = "url", key: str = "article_id", rule: str = "and"):
    """Drop rows whose url AND (or OR) id are known, possibly from different rows."""
    flagged = known_flags(batch, existing, [url, key])
    u, i = F.col(f"{url}_known"), F.col(f"{key}_known")
    known = (u & i) if rule == "and" else (u | i)
    return flagged.filter(~known).drop(f"{url}_known", f"{key}_known")


def upsert(
    existing: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str | Column] | None = None
) -> DataFrame:
    """Keyed merge: a column of the batch overwrites (also with null), others keep their value.

    ``order`` ranks rows of one key inside the batch, best first. The result carries
    ``change``: insert, update or keep. Keys compare as text.
    """
    latest = first_per_key(batch, keys, order) if order is not None else batch
    e = existing.withColumns({f"__k{i}": F.col(k).cast("string") for i, k in enumerate(keys)})
    b = latest.withColumns({f"__k{i}": F.col(k).cast("string") for i, k in enumerate(keys)})
    e, b = e.withColumn("__in", F.lit(True)), b.withColumn("__in", F.lit(True))
    both = e.alias("e").join(b.alias("b"), same_keys("e", "b", [f"__k{i}" for i in range(len(keys))]), "full")
    in_e, in_b = F.col("e.__in").isNotNull(), F.col("b.__in").isNotNull()
    cols = []
    for c in existing.columns:
        old = F.col(f"e.{c}")
        cols.append((F.when(in_b, F.col(f"b.{c}")).otherwise(old) if c in batch.columns else old).alias(c))
    cols += [F.col(f"b.{c}").alias(c) for c in batch.columns if c not in existing.columns]
    change = F.when(in_e & in_b, "update").when(in_b, "insert").otherwise("keep").alias("change")
    return both.select(*cols, change)


def priority_lookup(tables: Sequence[DataFrame], key: str, seq: str) -> DataFrame:
    """One whole row per key: the earliest table in the list wins, inside it the last row."""
    ranked = [t.withColumn("__p", F.lit(i)) for i, t in enumerate(tables)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    return first_per_key(every, [key], ["__p", F.col(seq).desc()]).drop("__p")


UNKNOWN_SOURCES = ("Unknown", "Unknown Source")


def repair(signals: DataFrame, raw: DataFrame, key: str = "article_id") -> DataFrame:
    """Fill missing source, content and url from the raw articles (one row per key).

    ``repaired`` tells whether any of the three was filled; rows without a raw article
    stay as they are.
    """
    r = raw.select(key, F.col("source").alias("__s"), F.col("content").alias("__c"), F.col("url").alias("__u"))
    joined = signals.join(r.withColumn("__hit", F.lit(True)), key, "left")
    hit = F.col("__hit").isNotNull()
    no_source = hit & (F.col("source").isNull() | F.col("source").isin(*UNKNOWN_SOURCES))
    content, short = F.col("full_content"), F.col("condensed_text")
    no_content = hit & (F.coalesce(content, F.lit("")) == "") | hit & F.coalesce(content == short, F.lit(False))
    no_url = hit & (F.coalesce(F.col("url"), F.lit("")) == "")
    filled = {
        "source": F.when(no_source, F.coalesce("__s", F.lit("Unknown"))).otherwise(F.col("source")),
        "full_content": F.when(no_content, F.coalesce("__c", short, F.lit(""))).otherwise(content),
        "url": F.when(no_url, F.coalesce("__u", F.lit(""))).otherwise(F.col("url")),
        "repaired": no_source | no_content | no_url,
    }
    return joined.withColumns(filled).drop("__s", "__c", "__u", "__hit")


def enriched(
    signals: DataFrame, sentiments: Sequence[DataFrame], articles: Sequence[DataFrame], key: str = "article_id", seq: str = "batch"
) -> DataFrame:
    """Signals with the texts of their articles: headline, source, condensed_text, full_content and url.

    ``sentiments`` (headline, source, condensed_text) and ``articles`` (source, content, url) are lists of tables
    by priority, from which each key takes one whole row (``priority_lookup``). The headline is that of
    the scored text, or else the signal's; the source that of the scored text, else of the article, else
    Unknown; the content that of the article, else the condensed text. A row that is found counts even where its
    value is null; only a signal without any row falls back. Keys compare as text; a null key finds nothing.
    """
    def picked(tables: Sequence[DataFrame], mark: str, columns: dict[str, str]) -> DataFrame:
        rows = [t.select(F.col(key).cast("string").alias("__key"), *[F.col(c).alias(n) for n, c in columns.items()], F.col(seq).alias("__seq")) for t in tables]
        return priority_lookup(rows, "__key", "__seq").drop("__seq").withColumn(mark, F.lit(True))

    scored = picked(sentiments, "__s", {"__headline": "headline", "__source": "source", "__condensed": "condensed_text"})
    raw = picked(articles, "__r", {"__raw_source": "source", "__content": "content", "__url": "url"})
    keyed = signals.withColumn("__key", F.col(key).cast("string"))
    both = keyed.join(scored, "__key", "left").join(raw, "__key", "left")
    has_text, has_raw = F.col("__s").isNotNull(), F.col("__r").isNotNull()
    own = F.col("headline") if "headline" in signals.columns else F.lit(None).cast("string")
    short = F.when(has_text, F.col("__condensed")).otherwise("")
    filled = {
        "headline": F.when(has_text, F.col("__headline")).otherwise(own),
        "source": F.when(has_text, F.col("__source")).when(has_raw, F.col("__raw_source")).otherwise("Unknown"),
        "condensed_text": short,
        "full_content": F.when(has_raw, F.col("__content")).otherwise(short),
        "url": F.when(has_raw, F.col("__url")).otherwise(""),
    }
    return both.withColumns(filled).drop("__key", "__s", "__r", "__headline", "__source", "__condensed", "__raw_source", "__content", "__url")


def buffer_or_release(
    features: DataFrame, buffer: DataFrame, is_open: bool, keys: Sequence[str] = ("article_id", "symbol")
) -> tuple[DataFrame, DataFrame]:
    """(rows to score now, rows to keep buffered).

    A closed market adds the rows to the buffer by key and scores nothing; an open one
    releases buffer and rows together and leaves the buffer empty.
    """
    if is_open:
        return buffer.unionByName(features, allowMissingColumns=True), buffer.limit(0)
    return features.limit(0), upsert(buffer, features, keys).drop("change")
