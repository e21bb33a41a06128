"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models. The model of a category reads
word features and the probabilities of all earlier categories. In training those probabilities
are out-of-fold predictions, so a later model never sees an earlier one judge its own rows.

Words are chosen by chi-square on the labelled sample. Scoring is row-local: each task looks
the words of its texts up in the chosen vocabulary, whose size is a parameter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.llm.common import fresh, in_batches, partitions, with_column, written

WORD = re.compile(r"[^\W\d_]+")
STEM = 5


@dataclass(frozen=True)
class Settings:
    """The bounds of the fit. They bound training only; scoring covers every row and whole texts."""

    sample_rows: int = 20_000  # labelled rows, taken in the order of a hash of their id
    features: int = 2_000  # words and stems kept
    min_docs: int = 5  # labelled rows that hold a feature
    min_chi2: float = 25.0
    folds: int = 3
    max_iter: int = 30
    reg: float = 1e-4
    threshold: float = 0.5


def terms(text: str | None) -> set[str]:
    """The words of a text, and the beginnings of the longer ones (marked by a hyphen)."""
    words = set(WORD.findall((text or "").lower()))
    return words | {w[:STEM] + "-" for w in words if len(w) > STEM}


@dataclass(frozen=True)
class Chain:
    categories: tuple[str, ...]
    vocabulary: tuple[str, ...]
    weights: np.ndarray  # a row per category: words, then earlier probabilities
    bias: np.ndarray
    threshold: float

    def probabilities(self, rows: list[list[int]]) -> np.ndarray:
        n, k = len(self.vocabulary), len(self.categories)
        out = np.zeros((len(rows), k))
        base = np.zeros((len(rows), k))
        words = self.weights[:, :n].T
        for i, at in enumerate(rows):
            if at:
                base[i] = words[at].sum(axis=0)
        for c in range(k):
            z = base[:, c] + self.bias[c] + out[:, :c] @ self.weights[c, n : n + c]
            out[:, c] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return out


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [list(terms(t)) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        yield with_column(batch.drop_columns(["text"]), "terms", pa.array(found, pa.list_(pa.string())))


def choose_terms(rows: DataFrame, categories: tuple[str, ...], s: Settings) -> list[str]:
    """Terms with the highest chi-square against any category, at most ``features``."""
    n, *sums = rows.agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in categories]).first()
    each = rows.select(F.explode("terms").alias("term"), *categories)
    counts = each.groupBy("term").agg(F.count("*").alias("_df"), *[F.sum(c).alias(c) for c in categories])

    def chi2(c: str, total: int) -> Column:
        a, df = F.col(c).cast("double"), F.col("_df").cast("double")
        spread = df * (n - df) * float(total) * float(n - total)
        return F.when(spread > 0, n * F.pow(a * n - df * float(total), 2) / spread).otherwise(F.lit(0.0))

    best = counts.where(F.col("_df") >= s.min_docs).withColumn("_x", F.greatest(*[chi2(c, t) for c, t in zip(categories, sums)], F.lit(0.0)))
    top = best.where(F.col("_x") >= s.min_chi2).orderBy(F.desc("_x"), "term").limit(s.features)
    return sorted(r.term for r in top.select("term").collect())


def logistic(flat: np.ndarray, begin: np.ndarray, extra: np.ndarray, y: np.ndarray, width: int, s: Settings) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps with preconditioned conjugate gradients.

    Row i has ones at ``flat[begin[i]:begin[i + 1]]`` and the dense values ``extra[i]`` behind them.
    One class only: weights of zero and the smoothed rate.
    """
    n, k = len(y), extra.shape[1]
    pos = y.sum()
    if n == 0 or pos == 0 or pos == n:
        rate = (pos + 0.5) / (n + 1)
        return np.zeros(width + k), float(np.log(rate / (1 - rate)))
    row = np.repeat(np.arange(n), np.diff(begin))

    def forward(v: np.ndarray) -> np.ndarray:
        return np.bincount(row, v[flat], n) + extra @ v[width:-1] + v[-1]

    def back(r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(flat, r[row], width), extra.T @ r, [r.sum()]])

    ridge = np.full(width + k + 1, s.reg * n)
    ridge[-1] = 0

    def loss(v: np.ndarray) -> float:
        z = forward(v)
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * ridge @ (v * v))

    v, now = np.zeros(width + k + 1), n * np.log(2)
    for _ in range(s.max_iter):
        p = 1 / (1 + np.exp(-np.clip(forward(v), -500, 500)))
        grad = back(p - y) + ridge * v
        h = p * (1 - p)
        scale = np.concatenate([np.bincount(flat, h[row], width), (extra**2).T @ h, [h.sum()]]) + ridge + 1e-9
        step, r = np.zeros_like(v), -grad
        z = r / scale
        d, rz, stop = z.copy(), r @ z, 1e-4 * np.sqrt(r @ r)
        for _ in range(50):
            hd = back(h * forward(d)) + ridge * d
            a = rz / max(d @ hd, 1e-300)
            step += a * d
            r -= a * hd
            if np.sqrt(r @ r) <= stop:
                break
            z = r / scale
            new = r @ z
            d, rz = z + new / rz * d, new
        size = 1.0
        while (after := loss(v + size * step)) > now and size > 1e-4:
            size /= 2
        done = now - after < 1e-7 * now
        if after < now:
            v, now = v + size * step, after
        if done:
            break
    return v[:-1], float(v[-1])


def _laid_out(pdf) -> tuple[np.ndarray, np.ndarray]:
    lists = [np.asarray(x, dtype=np.int64) for x in pdf["at"]]
    begin = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return (np.concatenate(lists) if lists else np.zeros(0)).astype(np.int64), begin


def _earlier(pdf, width: int, fits: list[list[tuple[np.ndarray, float]]]) -> np.ndarray:
    """Out-of-fold probabilities of the categories already fitted: a row by the fit without its fold."""
    flat, begin = _laid_out(pdf)
    fold, n = pdf["fold"].to_numpy(), len(pdf)
    row, p = np.repeat(np.arange(n), np.diff(begin)), np.zeros((n, len(fits)))
    for c, by_fold in enumerate(fits):
        for f, (w, b) in enumerate(by_fold[:-1]):
            z = np.bincount(row, w[:width][flat], n) + p[:, :c] @ w[width : width + c] + b
            p[fold == f, c] = (1 / (1 + np.exp(-np.clip(z, -500, 500))))[fold == f]
    return p


def fit_category(rows: DataFrame, label: str, width: int, fits: list, s: Settings) -> list[tuple[np.ndarray, float]]:
    """One fit without each fold and, last, one on all rows; each runs in a task of its own on the bounded sample."""

    def fit(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("order", kind="stable")
        flat, begin = _laid_out(pdf)
        w, b = logistic(flat, begin, _earlier(pdf, width, fits), pdf[label].to_numpy(dtype=float), width, s)
        return pd.DataFrame({"without": [key[0]], "w": [w], "b": [b]})

    each = rows.withColumn("without", F.explode(F.sequence(F.lit(0), F.lit(s.folds)))).where("fold <> without")
    found = each.groupBy("without").applyInPandas(fit, "without int, w array<double>, b double").collect()
    got = {r.without: (np.array(r.w), r.b) for r in found}
    empty = (np.zeros(width + len(fits)), 0.0)
    return [got.get(f, empty) for f in range(s.folds + 1)]


def train_chain(labelled: DataFrame, categories: list[str], id_col: str, text_col: str, s: Settings = Settings()) -> Chain:
    """Fit the chain on ``labelled``: an id, a text and a 0/1 column per category.

    Rows with a null id or a null label are left out. At most ``sample_rows`` rows are used, those
    with the smallest hash of their id. Without any row all probabilities are one half.
    """
    keep = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (id_col, *categories)])
    names = [f"c{i}" for i in range(len(categories))]
    order = F.xxhash64(F.lit("chain"), F.col(id_col))
    picked = labelled.where(keep).select(
        order.alias("order"), F.col(text_col).alias("text"), *[F.col(c).cast("double").alias(n) for c, n in zip(categories, names)]
    )
    picked = picked.orderBy("order", *names, F.xxhash64("text")).limit(s.sample_rows)
    schema = T.StructType(
        [T.StructField("order", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names], T.StructField("terms", T.ArrayType(T.StringType()))]
    )
    rows = written(in_batches(picked.repartition(partitions(labelled), "order"), _terms_of, schema), "chain-rows")
    vocabulary = tuple(choose_terms(rows, tuple(names), s))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {w: i for i, w in enumerate(vocabulary)}
        for batch in batches:
            own = [sorted(at[w] for w in found if w in at) for found in batch.column(batch.schema.get_field_index("terms")).to_pylist()]
            yield with_column(batch.drop_columns(["terms"]), "at", pa.array(own, pa.list_(pa.int32())))

    kinds = T.StructType([*schema.fields[:-1], T.StructField("at", T.ArrayType(T.IntegerType()))])
    small = in_batches(rows, numbered, kinds).withColumn("fold", F.pmod(F.shiftright("order", 8), F.lit(s.folds)).cast("int"))
    small = written(small, "chain-features")
    width = len(vocabulary)
    fits: list[list[tuple[np.ndarray, float]]] = []
    for name in names:
        fits.append(fit_category(small, name, width, fits, s))
    weights, bias = np.zeros((len(names), width + len(names))), np.zeros(len(names))
    for c, by_fold in enumerate(fits):
        w, b = by_fold[-1]
        weights[c, : len(w)], bias[c] = w, b
    return Chain(tuple(categories), vocabulary, weights, bias, s.threshold)


def score_chain(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """Adds ``p_<category>`` for every category and ``rejected`` (the last one over the threshold).

    Every row is judged alone and by its whole text; null and empty texts get the probabilities
    of a text without known words. Columns with the names of the results are replaced.
    """
    results = [*[f"p_{c}" for c in chain.categories], "rejected"]
    docs = fresh(docs, *results)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {w: i for i, w in enumerate(chain.vocabulary)}
        known = at.keys()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            p = chain.probabilities([sorted(at[w] for w in known & terms(t)) for t in texts])
            for c, name in enumerate(results[:-1]):
                batch = with_column(batch, name, pa.array(p[:, c]))
            yield with_column(batch, "rejected", pa.array(p[:, -1] >= chain.threshold))

    added = [*[T.StructField(n, T.DoubleType()) for n in results[:-1]], T.StructField("rejected", T.BooleanType())]
    return in_batches(docs, run, T.StructType([*docs.schema.fields, *added]))


CATEGORIES = ["toxic_junk", "toxic_prose", "toxic"]


def labelled_documents(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Labelled texts with the chain's categories: toxic rows of low and of good quality, then all toxic rows.

    ``labels`` (doc_id, quality, toxic) may repeat ids; such an id counts with its highest marks.
    The sample is bounded before the texts are joined, so that side can be broadcast.
    """
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    few = one.orderBy(F.xxhash64(F.lit("chain"), F.col("doc_id"))).limit(s.sample_rows)
    toxic, good = F.col("toxic") == 1, F.coalesce(F.col("quality"), F.lit(1)) == 1
    marks = few.select(
        "doc_id", (toxic & ~good).cast("int").alias("toxic_junk"), (toxic & good).cast("int").alias("toxic_prose"), toxic.cast("int").alias("toxic")
    )
    return docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")


def judge(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, s: Settings = Settings()) -> DataFrame:
    """Fit on the labelled rows of ``corpus`` (default: ``docs``) and score all of ``docs``."""
    chain = train_chain(labelled_documents(docs if corpus is None else corpus, labels, s), CATEGORIES, "doc_id", "text", s)
    return score_chain(docs, chain)
