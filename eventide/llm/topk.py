"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are dealt to shards by hash. Inside a shard they are sorted by length and cut into
buckets. For a query, the score to beat divided by its length and the longest length of a bucket
is the cosine a vector of the bucket must reach. Above one, the bucket and all shorter ones are
out (length pruning). At a high cosine the bucket is narrowed by the feasible range of the
query's largest coordinates (coordinate pruning); at a low one all of its vectors are kept. What
is left is verified with exact integer products. Queries come in blocks, and a bucket meets all
queries of a block at once that it can still serve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import in_batches, key_runs, partitions, written
from eventide.llm.vectors import QUERY_BLOCK, best, smallest_ids, usable

SHARD_ROWS = 8192
BUCKET = 256
FOCUS = 4  # coordinates of a query that narrow a bucket
HIGH_COSINE = 0.6
SLACK = 1e-6  # of a coordinate's range, whose vectors are in single precision
# Types of a product of integers, each with the sum from which it may not be exact.
EXACT = ((np.float32, 2.0**24), (np.float64, 2.0**53), (np.int64, np.inf))


class Held:
    """The best ``k`` so far of every query of a block: largest score first, then smallest id."""

    def __init__(self, queries: int, k: int):
        self.n = np.zeros(queries, np.int64)
        self.ids, self.scores = np.zeros((queries, k), np.int64), np.zeros((queries, k), np.int64)

    def full(self, at: np.ndarray) -> np.ndarray:
        return self.n[at] == self.ids.shape[1]

    def rows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of what the queries ``at`` hold."""
        kept = np.arange(self.ids.shape[1]) < self.n[at][:, None]
        return np.repeat(at, self.n[at]), self.ids[at][kept], self.scores[at][kept]

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates (query, id, score) that the queries do not hold yet."""
        at = np.unique(q)
        q, ids, scores = (np.concatenate(x) for x in zip(self.rows(at), (q, ids, scores)))
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        first = np.searchsorted(q, at)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        best = place < self.ids.shape[1]
        self.ids[q[best], place[best]], self.scores[q[best], place[best]] = ids[best], scores[best]
        self.n[at] = np.bincount(np.searchsorted(at, q[best]), minlength=len(at))


class Block:
    """Queries with what every shard asks of them."""

    def __init__(self, own: np.ndarray, queries: np.ndarray):
        self.own, self.queries = own, queries
        self.lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        self.tops = np.abs(queries).max(axis=1, initial=0).astype(np.float64)
        unit = queries / np.maximum(self.lengths, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(unit), axis=1)[:, :FOCUS]
        self.peaks = np.take_along_axis(unit, self.focus, axis=1)
        self._cast: dict[type, np.ndarray] = {}

    def cast(self, kind: type) -> np.ndarray:
        if kind not in self._cast:
            self._cast[kind] = self.queries.astype(kind)
        return self._cast[kind]

    def fitted(self, width: int) -> Block:
        """As wide as the vectors of a shard: what lies beyond adds nothing to a product."""
        if self.queries.shape[1] == width:
            return self
        out = np.zeros((len(self.own), width), np.int64)
        out[:, : self.queries.shape[1]] = self.queries[:, :width]
        return Block(self.own, out)


class NormBuckets:
    """The candidates of one shard, longest first, in buckets."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        order = np.lexsort((ids, -lengths))
        self.ids, self.vectors, self.lengths = ids[order], vectors[order], lengths[order]
        # A row for each coordinate, and its least and greatest values in each bucket, for the ranges.
        self.unit = np.ascontiguousarray((self.vectors / np.maximum(self.lengths, 1e-300)[:, None]).T.astype(np.float32))
        self.starts = np.arange(0, len(ids), BUCKET)
        self.least, self.most = (f.reduceat(self.unit, self.starts, axis=1) for f in (np.minimum, np.maximum))
        self.tops = np.maximum.reduceat(np.abs(self.vectors).max(axis=1), self.starts).astype(np.float64)
        self.cast = {np.int64: self.vectors}

    def rows(self, a: int, b: int, kind: type) -> np.ndarray:
        if kind not in self.cast:
            self.cast[kind] = self.vectors.astype(kind)
        return self.cast[kind][a:b]

    def survivors(self, bucket: int, peaks: np.ndarray, focus: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of queries of a high cosine each (a row each) those for which the bucket is narrowed, and to which of its vectors."""
        mid = peaks * cosine[:, None]
        spread = np.sqrt(np.maximum(0.0, 1 - cosine[:, None] ** 2) * np.maximum(0.0, 1 - peaks**2)) + SLACK
        # Beyond the cosine itself the cap still holds the query's own coordinate.
        low = np.where(-peaks >= cosine[:, None], -2.0, mid - spread).astype(np.float32)
        high = np.where(peaks >= cosine[:, None], 2.0, mid + spread).astype(np.float32)
        cuts = (low > self.least[focus, bucket]) | (high < self.most[focus, bucket])  # other ranges hold the whole bucket
        narrowed = np.flatnonzero(cuts.any(axis=1))
        a = self.starts[bucket]
        out = np.ones((len(narrowed), len(self.ids[a : a + BUCKET])), bool)
        for i in range(focus.shape[1]):
            row = np.flatnonzero(cuts[narrowed, i])
            q = narrowed[row]
            x = self.unit[focus[q, i], a : a + BUCKET]
            out[row] &= (x >= low[q, i][:, None]) & (x <= high[q, i][:, None])
        return narrowed, out

    def search_all(self, block: Block, held: Held) -> Held:
        """Adds the shard's best to what the queries of a block hold; a bucket meets all at once that it can still serve."""
        at = np.arange(len(block.own))
        for bucket, (top, length) in enumerate(zip(self.tops, self.lengths[self.starts])):
            need, longest = held.scores[at, -1].astype(np.float64), block.lengths[at] * length
            told = held.full(at) & (need > 0)  # else zero and negative products may count, which no bound leaves out
            stay = ~told | (longest * (1 + 1e-9) >= need)  # others are done with this bucket and all shorter ones
            at, need, longest, told = at[stay], need[stay], longest[stay], told[stay]
            if not len(at):
                break
            cosine = np.where(told, need / np.where(told, longest, 1.0) - 1e-9, -1.0)
            largest = self.vectors.shape[1] * top * block.tops[at]
            below = 0.0
            for kind, limit in EXACT:
                now = (largest >= below) & (largest < limit)
                below = limit
                if now.any():
                    self._meet(held, block, at[now], cosine[now], bucket, kind)
        return held

    def _meet(self, held: Held, block: Block, at: np.ndarray, cosine: np.ndarray, bucket: int, kind: type) -> None:
        """A bucket and the queries ``at``, whose products the type ``kind`` holds exactly."""
        a = self.starts[bucket]
        b = min(a + BUCKET, len(self.ids))
        high = np.flatnonzero(cosine >= HIGH_COSINE)
        narrowed, narrow = self.survivors(bucket, block.peaks[at[high]], block.focus[at[high]], cosine[high])
        some = narrow.any(axis=1)
        keep = np.ones(len(at), bool)
        keep[high[narrowed]] = some
        at, row, narrow = at[keep], np.cumsum(keep)[high[narrowed[some]]] - 1, narrow[some]
        if not len(at):
            return
        scores = block.cast(kind)[at] @ self.rows(a, b, kind).T
        need = held.scores[at, -1].astype(kind)
        new = np.flatnonzero(~held.full(at))
        if len(new):  # what the bucket's own best ones need
            least = -np.inf if kind is not np.int64 else np.iinfo(np.int64).min
            mine = np.where(self.ids[a:b] == block.own[at[new]][:, None], least, scores[new])
            k = min(held.ids.shape[1], b - a)
            need[new] = np.partition(mine, b - a - k, axis=1)[:, b - a - k]
        found = scores >= need[:, None]
        found[row] &= narrow
        place = np.flatnonzero(found)
        q, v = np.divmod(place, b - a)
        ids, scores, q = self.ids[a + v], scores.reshape(-1)[place].astype(np.int64), at[q]
        # A tie with the last one held counts if its id is smaller.
        fit = (ids != block.own[q]) & (~held.full(q) | (scores > held.scores[q, -1]) | (ids < held.ids[q, -1]))
        if fit.any():
            held.add(q[fit], ids[fit], scores[fit])

    def search(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        _, ids, scores = self.search_all(Block(np.array([own]), q[None, :]), Held(1, k)).rows(np.arange(1))
        return ids, scores


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Vectors as rows, as wide as the longest, in the smallest type that holds them; shorter ones end in zeros."""
    sizes, values = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    ends = values.min(), values.max()
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= ends[0] and ends[1] <= np.iinfo(t).max)
    out = np.zeros((len(lists), sizes.max()), kind)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def _pack(key: str):
    """The rows of a key (shard or block) as one row: ids, width and the matrix of integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in key_runs(batches, [key]):
            data = _matrix(rows.column("v").combine_chunks())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows.column(key)[0].as_py()], pa.int32()),
                    pa.array([rows.column("id").to_numpy().tobytes()], pa.binary()),
                    pa.array([data.shape[1]], pa.int32()),
                    pa.array([data.tobytes()], pa.binary()),
                ],
                names=[key, f"{key}_ids", f"{key}_width", f"{key}_data"],
            )

    return run


def _packed(rows: DataFrame, key: str, n: int) -> DataFrame:
    """A row for each of the ``n`` values of the key, written."""
    dealt = rows.withColumn(key, F.pmod(F.xxhash64(F.lit(key), "id", "v"), F.lit(n)).cast("int"))
    runs = dealt.repartitionById(n, key).sortWithinPartitions(key, "id")
    return written(in_batches(runs, _pack(key), f"{key} int, {key}_ids binary, {key}_width int, {key}_data binary"), f"topk-{key}s")


def _unpacked(row: dict, name: str) -> tuple[np.ndarray, np.ndarray]:
    ids, data = np.frombuffer(row[f"{name}_ids"], dtype=np.int64), row[f"{name}_data"]
    kind = f"i{len(data) // (len(ids) * row[f'{name}_width'])}"
    return ids, np.frombuffer(data, dtype=kind).reshape(len(ids), -1).astype(np.int64)


def _search(k: int):
    """Pairs of a shard and a block, those of a shard one after the other: what a block's queries hold goes from shard to shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, index = None, None
        blocks: dict[int, tuple[Block, Held]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    shard, index = row["shard"], NormBuckets(*_unpacked(row, "shard"))
                if row["block"] not in blocks:
                    own, queries = _unpacked(row, "block")
                    blocks[row["block"]] = Block(own, queries), Held(len(own), k)
                block, held = blocks[row["block"]]
                index.search_all(block.fitted(index.vectors.shape[1]), held)
        for block, held in blocks.values():
            q, ids, scores = held.rows(np.arange(len(block.own)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block.own[q], ids, scores)], names=["query_id", "vec_id", "score"])

    return run


def exact_top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest products of the scaled integer vectors.

    Components become floor(scale * x). Queries are the rows whose id is divisible by ``every``,
    candidates all rows of another id; fewer candidates than ``k`` are all returned. Ties go to
    the smaller id. Rows with a null id, a null or empty vector, or a null or non-finite component
    take no part; zero vectors do. Vectors of different lengths are compared as if the shorter one
    ended in zeros. Rows that repeat an id with another vector are candidates of their own, rows
    repeated whole count once. Extra columns are not read. An empty table gives an empty table.
    Scores are 64-bit integers: if the largest component and the longest vector allow a product beyond them, a
    ``ValueError`` says so before anything is searched; no score is ever cut off.
    """
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("raw"), whole.alias("v"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("raw"), nonzero=False))
    sizes = F.transform(F.col("raw"), lambda x: F.abs(F.floor(x.cast("double") * scale).cast("double")))
    top, width = rows.select(F.max(F.array_max(sizes)), F.max(F.size("raw"))).first()
    if top is not None and int(min(top, 1e300)) ** 2 * width >= 1 << 63:
        raise ValueError(f"products of vectors of {width} components up to {top / scale:g} do not fit 64-bit scores")
    rows = rows.drop("raw")
    queries = rows.where(F.col("id") % every == 0).dropDuplicates(["id", "v"])
    kept = written(smallest_ids(rows.dropDuplicates(["id", "v"]), k + 1), "topk-rows")
    shards, blocks = max(1, -(-kept.count() // SHARD_ROWS)), max(1, -(-queries.count() // QUERY_BLOCK))
    packed, asked = _packed(kept, "shard", shards), _packed(queries, "block", blocks)
    # A task has a block and a part of the shards, and reads both where they lie: neither side is copied for the other,
    # by a shuffle or over the driver. With more blocks the parts are fewer, so what is found grows as the queries.
    parts = min(shards, -(-partitions(vectors) // blocks))
    pairs = packed.coalesce(parts).hint("shuffle_replicate_nl").crossJoin(asked.repartitionById(blocks, "block"))
    found = in_batches(pairs, _search(k), "query_id long, vec_id long, score long")
    return best(found, k)
