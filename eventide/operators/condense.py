"""Extractive condensation: the sentences closest to their document."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.functions import scalars

# Fixed value: sentences kept per document.
TOP_SENTENCES = 5
# Bytes of words that go to Python at once (a longer text stands alone): the counts take many times their size.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by white space; empty pieces are dropped."""
    marked = F.regexp_replace(text, r"([.!?])[ \t\n\r\f]+", "$1\x01")
    return F.filter(F.split(marked, "\x01"), lambda s: F.trim(s) != "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two double arrays; null when one has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _central(words: pa.Array, k: int) -> pa.Array:
    """Per document (a list of sentences, each a list of words) the places of its ``k`` best sentences, ascending.

    A sentence is scored by the cosine between its word counts and those of the whole document.
    """
    per_doc = words.value_lengths().fill_null(0).to_numpy()
    lists = words.flatten()
    per_sentence = lists.value_lengths().fill_null(0).to_numpy()
    coded = lists.flatten().dictionary_encode()
    n_docs, n_sentences, width = len(per_doc), len(per_sentence), max(1, len(coded.dictionary))
    doc = np.repeat(np.arange(n_docs), per_doc)
    place = np.arange(n_sentences) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    said = np.repeat(np.arange(n_sentences), per_sentence) * width + coded.indices.to_numpy()
    cells, c = np.unique(said, return_counts=True)
    sentence, word = cells // width, cells % width
    _, pair = np.unique(doc[sentence] * width + word, return_inverse=True)
    d = np.bincount(pair, c)[pair] if len(pair) else np.zeros(0)
    dot = np.bincount(sentence, c * d, n_sentences)
    # The squared length of the document vector is the sum of count * document count over its sentences.
    whole = np.bincount(doc, dot, n_docs)[doc]
    length = np.sqrt(np.bincount(sentence, c * c, n_sentences)) * np.sqrt(whole)
    score = np.round(np.divide(dot, length, out=np.full(n_sentences, -1.0), where=length > 0), 9)
    best = np.lexsort((place, -score, doc))  # sentences without words come last in their document
    rank = np.arange(n_sentences) - (np.cumsum(per_doc) - per_doc)[doc[best]]
    kept = np.sort(best[(rank < k) & (score[best] >= 0)])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[kept], minlength=n_docs))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(place[kept], pa.int32()))


def top_sentences(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = TOP_SENTENCES, max_sentences: int | None = None
) -> DataFrame:
    """``condensed_text``: the ``k`` best sentences in text order; short texts stay unchanged.

    A document's scores depend on its own words alone, so nothing is shuffled: the words of the
    longer texts go to an Arrow function, which counts them batch by batch and answers with the
    places of the sentences. Every sentence is considered unless ``max_sentences`` is given.
    """

    docs.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def central(words: pa.Array) -> pa.Array:
        return _central(words, k)

    parts = sentences(F.col(text))
    scored = parts if max_sentences is None else F.slice(parts, 1, max_sentences)
    rows = docs.withColumn("__words", F.when(F.size(parts) > k, F.transform(scored, tokens)))
    rows = rows.withColumn("__picked", central("__words"))

    def chosen(parts: Column) -> Column:
        best_parts = F.array_join(F.transform("__picked", lambda i: F.get(parts, i)), " ")
        return F.when((F.size(parts) <= k) | (F.size("__picked") == 0), F.col(text)).otherwise(best_parts)

    return rows.withColumn("condensed_text", scalars.once([parts], chosen)).drop("__words", "__picked")


def encoded_top_sentences(
    docs: DataFrame,
    encoder: Callable[[Column], Column],
    key: str = "doc_id",
    text: str = "text",
    k: int = TOP_SENTENCES,
) -> DataFrame:
    """The same with an encoder: a function (for instance a ``pandas_udf``) from text to a vector column."""
    parts = sentences(F.col(text))
    rows = docs.filter(F.size(parts) > k).withColumn("__doc", encoder(F.col(text)))
    split = rows.select(key, "__doc", F.posexplode(sentences(F.col(text))).alias("sent", "sentence"))
    scored = split.withColumn("score", cosine(F.col("__doc"), encoder(F.col("sentence"))))
    best = W.partitionBy(key).orderBy(F.col("score").desc(), "sent")
    picked = (
        scored.withColumn("rn", F.row_number().over(best))
        .filter(F.col("rn") <= k)
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("sent", "sentence"))).alias("p"))
    )
    chosen = picked.select(key, F.array_join(F.transform("p", lambda s: s["sentence"]), " ").alias("__c"))
    # Texts of up to ``k`` sentences, and those without any, stay as they are.
    return docs.join(chosen, key, "left").select(key, F.coalesce("__c", F.col(text)).alias("condensed_text"))


def closest_to_centre(
    vectors: DataFrame, group: str, key: str, vector: str, size: int, k: int = TOP_SENTENCES
) -> DataFrame:
    """The ``k`` vectors of each group closest to the group's mean vector.

    The means are one aggregate of ``size`` running sums per group, folded on the map
    side; the ranked filter is limited on the map side, too, so a group that holds a third
    of all vectors costs no more than another.
    """
    v = F.col(vector)
    means = vectors.groupBy(group).agg(*[F.avg(F.get(v, F.lit(i)).cast("double")).alias(f"m{i}") for i in range(size)])
    centre = means.select(group, F.array(*[F.col(f"m{i}") for i in range(size)]).alias("__m"))
    wide = F.transform(v, lambda x: x.cast("double"))
    scored = vectors.join(centre, group).withColumn("score", cosine(wide, F.col("__m"))).drop("__m")
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.round("score", 9).desc(), key))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)
