"""Approximate nearest neighbours: robust-pruned directed graphs, one per shard.

Vectors are dealt to shards by hash; each shard builds a graph in one bounded task and is stored
as a row of an index table. Points enter in growing batches. A greedy beam search over the graph
so far proposes neighbours, and pruning keeps a candidate only if no kept neighbour is nearer to
it by the factor ``ALPHA`` (relaxed), which leaves long edges between diverse regions. A query
runs a beam search in every shard. Searches run in lockstep over a batch, one numpy step for all.

Largest inner product is searched as smallest distance after the usual lift by one coordinate.
Rounding of the lift grows with the longest vector, so a shard has one graph for each band of
lengths: from the longest vector left down to an eighth of it, scaled to at most length one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import in_batches, key_runs, partitions, written
from eventide.llm.vectors import best, matrix, query_blocks, smallest_ids, usable

SHARD_ROWS = 8192
DEGREE = 32
SLACK = 48  # edges a point may gather before it is pruned again
BEAM = 64
ALPHA = 1.2
ENTRIES = 16
BATCH = 256
BAND = 3.0  # binary logarithm of the ratio of lengths in a graph


def lifted(x: np.ndarray) -> np.ndarray:
    """One more coordinate that makes all lengths equal: then nearest is largest inner product."""
    sq = (x.astype(np.float64) ** 2).sum(axis=1)
    return np.concatenate([x, np.sqrt(np.maximum(sq.max(initial=0) - sq, 0))[:, None]], axis=1).astype(np.float32)


def log_lengths(x: np.ndarray) -> np.ndarray:
    """Binary logarithms of the lengths of nonzero vectors; no square overflows or vanishes."""
    m = np.abs(x).max(axis=1)
    return np.log2(m) + 0.5 * np.log2(((x / m[:, None]) ** 2).sum(axis=1))


def bands(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the vectors of each band of lengths, ascending, and the vectors scaled to at most length one."""
    size = log_lengths(x)
    order = np.argsort(-size, kind="stable")
    falling = -size[order]
    at = 0
    while at < len(order):
        end = int(np.searchsorted(falling, falling[at] + BAND, side="right"))
        own = np.sort(order[at:end])
        yield own, np.ldexp(x[own], -int(np.ceil(size[order[at]])))
        at = end


def beam_search(
    x: np.ndarray, graph: np.ndarray, entries: np.ndarray, q: np.ndarray, beam: int, product: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances of the beam of each query, nearest first; -1 fills up.

    ``product``: largest inner product first, whatever the lengths.
    """
    n = len(q)
    norms = np.zeros(len(x), dtype=x.dtype) if product else (x**2).sum(axis=1)

    def far(ids: np.ndarray) -> np.ndarray:
        d = norms[ids] - 2 * np.einsum("bkd,bd->bk", x[ids], q)
        return np.where(ids >= 0, d, np.inf).astype(np.float32)

    ids = np.full((n, beam), -1, dtype=np.int32)
    first = entries[:beam]
    ids[:, : len(first)] = first
    dist = far(ids)
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    done = ids < 0
    active = np.arange(n)
    while len(active):
        open_ = ~done[active]
        has = open_.any(axis=1)
        active = active[has]
        if not len(active):
            break
        pick = open_[has].argmax(axis=1)
        done[active, pick] = True
        near = graph[ids[active, pick]]
        # Those already in the beam, and repeats, are not proposed again.
        known = (near[:, :, None] == ids[active][:, None, :]).any(axis=2)
        near = np.where(known, -1, near)
        d = norms[near] - 2 * np.einsum("bkd,bd->bk", x[near], q[active])
        d = np.where(near >= 0, d, np.inf).astype(np.float32)
        all_ids = np.concatenate([ids[active], near], axis=1)
        all_d = np.concatenate([dist[active], d], axis=1)
        all_done = np.concatenate([done[active], near < 0], axis=1)
        keep = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        ids[active] = np.take_along_axis(all_ids, keep, 1)
        dist[active] = np.take_along_axis(all_d, keep, 1)
        done[active] = np.take_along_axis(all_done, keep, 1)
    return ids, dist


def robust_prune(x: np.ndarray, points: np.ndarray, near: np.ndarray) -> np.ndarray:
    """At most ``DEGREE`` diverse neighbours of each point among its candidates ``near`` (-1: none)."""
    n, c = near.shape
    near = np.where(near == points[:, None], -1, near)
    v = x[near]
    d = ((v - x[points][:, None, :]) ** 2).sum(axis=2)
    alive = near >= 0
    # Repeats go: of equal ids the first one stays.
    order = np.argsort(near, axis=1, kind="stable")
    srt = np.take_along_axis(near, order, 1)
    twice = np.zeros_like(alive)
    np.put_along_axis(twice, order[:, 1:], srt[:, 1:] == srt[:, :-1], 1)
    alive &= ~twice
    out = np.full((n, DEGREE), -1, dtype=np.int32)
    rows = np.arange(n)
    for k in range(DEGREE):
        best_ = np.where(alive, d, np.inf).argmin(axis=1)
        ok = alive[rows, best_]
        if not ok.any():
            break
        out[ok, k] = near[rows, best_][ok]
        alive[rows, best_] = False
        between = ((v - v[rows, best_][:, None, :]) ** 2).sum(axis=2)
        alive &= ~(ok[:, None] & (ALPHA**2 * between <= d))
    return out


class Graph:
    """The graph over the distinct vectors of a shard."""

    def __init__(self, x: np.ndarray, edges: np.ndarray, entries: np.ndarray):
        self.x, self.edges, self.entries = x, edges, entries

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 5) -> Graph:
        n = len(x)
        rng = np.random.default_rng(seed)
        order = rng.permutation(n)
        middle = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
        entries = order[:BEAM] if n <= BEAM else np.unique(np.append(order[: ENTRIES - 1], middle))
        edges = np.full((n, SLACK), -1, dtype=np.int32)
        # The first points know each other; the others enter in batches that grow with the graph.
        a = min(n, DEGREE)
        for p in order[:a].tolist():
            own = [i for i in order[:a].tolist() if i != p]
            edges[p, : len(own)] = own
        while a < n:
            b = min(n, a + min(BATCH, max(16, a // 8)))
            points = order[a:b]
            start = entries if a >= ENTRIES and np.isin(entries, order[:a]).all() else order[: min(a, ENTRIES)]
            ids, _ = beam_search(x, edges, start, x[points], BEAM)
            edges[points, :DEGREE] = robust_prune(x, points, ids)
            cls._join_back(x, edges, points)
            a = b
        crowded = np.flatnonzero((edges >= 0).sum(axis=1) > DEGREE)
        for i in range(0, len(crowded), BATCH):
            part = crowded[i : i + BATCH]
            kept = robust_prune(x, part, edges[part])
            edges[part] = -1
            edges[part, :DEGREE] = kept
        return cls(x, edges[:, :DEGREE].copy(), entries.astype(np.int32))

    @staticmethod
    def _join_back(x: np.ndarray, edges: np.ndarray, points: np.ndarray) -> None:
        """Edges from the chosen neighbours to the new points; who has too many is pruned."""
        to = edges[points, :DEGREE]
        src, dst = to[to >= 0], np.repeat(points, (to >= 0).sum(axis=1))
        order = np.argsort(src, kind="stable")
        src, dst = src[order], dst[order]
        begins = np.flatnonzero(np.append(True, src[1:] != src[:-1])) if len(src) else np.zeros(0, dtype=np.int64)
        for at, end in zip(begins.tolist(), np.append(begins[1:], len(src)).tolist()):
            p, new = int(src[at]), dst[at:end]
            have = edges[p][edges[p] >= 0]
            new = new[~np.isin(new, have)]
            both = np.concatenate([have, new])
            if len(both) > SLACK:
                kept = robust_prune(x, np.array([p]), both[None, :].astype(np.int32))[0]
                both = kept[kept >= 0]
            edges[p] = -1
            edges[p, : len(both)] = both

    def search(self, q: np.ndarray, beam: int) -> np.ndarray:
        parts = [beam_search(self.x, self.edges, self.entries, q[i : i + BATCH], beam, product=True)[0] for i in range(0, len(q), BATCH)]
        return np.concatenate(parts) if parts else np.zeros((0, beam), dtype=np.int32)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per shard and band: original vectors and ids in the order of the distinct vectors, and the graph."""
    for rows in key_runs(batches, ["shard"]):
        lists = rows.column("v").to_pylist()
        full = matrix(lists, max(map(len, lists)), np.float64)
        ids = rows.column("id").to_numpy()
        distinct, which = np.unique(full, axis=0, return_inverse=True)
        which = which.ravel()
        for own, scaled in bands(distinct):
            g = Graph.build(lifted(scaled))
            mine = np.flatnonzero(np.isin(which, own))
            place = np.searchsorted(own, which[mine])
            order = np.lexsort((ids[mine], place))
            parts = (full[mine[order]], ids[mine[order]], place[order].astype(np.int64), g.x, g.edges, g.entries)
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows.column("shard")[0].as_py()], pa.int32()), pa.array([full.shape[1]], pa.int32())]
                + [pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts],
                names=["shard", "width", "full", "own", "which", "x", "edges", "entries"],
            )


INDEX = "shard int, width int, full binary, own binary, which binary, x binary, edges binary, entries binary"


def _search(k: int, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                w = row["width"]
                full = np.frombuffer(row["full"], dtype=np.float64).reshape(-1, w)
                ids, which = (np.frombuffer(row[c], dtype=np.int64) for c in ("own", "which"))
                g = Graph(
                    np.frombuffer(row["x"], dtype=np.float32).reshape(-1, w + 1),
                    np.frombuffer(row["edges"], dtype=np.int32).reshape(-1, DEGREE),
                    np.frombuffer(row["entries"], dtype=np.int32),
                )
                begins = np.searchsorted(which, np.arange(len(g.x) + 1))
                queries = matrix(row["vectors"], w, np.float64)
                # The length of a query does not change the order; zero in the width of this shard stays zero.
                top = np.abs(queries).max(axis=1, keepdims=True)
                unit = queries / np.where(top > 0, top, 1)
                hits = g.search(np.concatenate([unit, np.zeros((len(queries), 1))], axis=1).astype(np.float32), beam)
                q, v, s = [], [], []
                for own, query, near in zip(row["ids"], queries, hits):
                    at = np.concatenate([np.arange(begins[i], begins[i + 1]) for i in near[near >= 0]] or [np.zeros(0, np.int64)])
                    at = at[ids[at] != own]
                    scores = (full[at] * query).sum(axis=1)
                    keep = np.lexsort((ids[at], -scores))[:k]
                    q.append(np.full(len(keep), own, dtype=np.int64))
                    v.append(ids[at][keep])
                    s.append(scores[keep])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (q, v, s)], names=["query_id", "vec_id", "score"])

    return run


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, beam: int = BEAM, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found by largest inner product in doubles.

    Queries are the rows whose id is divisible by ``every``, candidates all rows of another id.
    Every row is indexed; of equal vectors the k + 1 smallest ids, which all others tie with and lose
    to. Ties go to the smaller id; fewer candidates than ``k`` are all returned. Rows with a null
    id, or a vector that is null, empty, zero or holds a null or non-finite component take no
    part. Shorter vectors count as ending in zeros. Rows repeated whole count once. Extra columns
    are not read. An empty table gives an empty table.
    """
    doubles = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col), nonzero=True))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), doubles.alias("v"))
    queries = rows.where(F.col("id") % every == 0).dropDuplicates(["id", "v"])
    kept = written(smallest_ids(rows.dropDuplicates(["id", "v"]), k + 1), "ann-rows")
    shards = max(1, -(-kept.count() // SHARD_ROWS))
    dealt = kept.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    n = max(partitions(vectors), shards)
    index = written(in_batches(dealt.repartition(n, "shard").sortWithinPartitions("shard", "id"), _build, INDEX), "ann-index")
    tasks = query_blocks(queries, shards).join(index, "shard")
    found = in_batches(tasks.repartition(max(1, min(n, shards * 4)), "shard", "block"), _search(k, beam), "query_id long, vec_id long, score double")
    return best(found, k)
