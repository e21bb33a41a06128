"""Exact top-k: no side of the search goes over the driver; blocks of queries and shards against all products."""

from collections import defaultdict

import numpy as np
import pytest

from eventide.llm import topk


def expected(ids, vectors, queries, k=5):
    """The k best (score, id) of every query (id, vector) among rows of another id; rows of one query id stand together."""
    out = defaultdict(list)
    for own, q in queries:
        out[own] += [(-sum(a * b for a, b in zip(v, q)), i) for i, v in zip(ids, vectors) if i != own]
    return {own: [(i, -s) for s, i in sorted(found)[:k]] for own, found in out.items()}


def test_query_blocks_are_not_broadcast(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    out = topk.exact_top_k(df)
    assert len(out.collect()) == 30
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.integers(-3, 4, size=1 + i % 6).astype(float).tolist()) for i in range(240)]
    rows += [(20, [9.0, 9.0]), (21, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]), (22, [0.0]), (-40, [2.0, -2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in sorted(topk.exact_top_k(df, every=4, scale=1).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    ids, vectors = [i for i, _ in rows], [[int(x) for x in v] for _, v in rows]
    want = expected(ids, vectors, [(i, v) for i, v in zip(ids, vectors) if i % 4 == 0])
    assert dict(got) == want


@pytest.mark.parametrize("kind", ["ties", "clusters", "long", "zeros", "negative", "few"])
def test_a_block_gets_what_single_queries_get(kind):
    rng = np.random.default_rng(7)
    x = rng.integers(-2, 3, size=(900, 4))
    if kind == "clusters":
        centers = rng.normal(size=(9, 24)) * 90
        x = np.floor(centers[rng.integers(9, size=900)] + rng.normal(size=(900, 24)) * 15).astype(np.int64)
    elif kind == "long":  # products beyond singles, beyond doubles
        x[3], x[4], x[5] = 10**8, -(10**8), 10**5
    elif kind == "zeros":
        x[:] = 0
    elif kind == "negative":
        x = np.where(np.arange(900)[:, None] % 3 == 0, np.abs(x), -np.abs(x))
    elif kind == "few":
        x = x[:4]
    ids = rng.permutation(len(x))
    held = topk.Held(len(ids[::3]), 5)
    for part in (ids % 2 == 0, ids % 2 == 1):
        topk.NormBuckets(ids[part], x[part]).search_all(topk.Block(ids[::3], x[::3]), held)
    q, found, scores = held.rows(np.arange(len(ids[::3])))
    got = defaultdict(list)
    for own, i, s in zip(ids[::3][q].tolist(), found.tolist(), scores.tolist()):
        got[own].append((i, s))
    assert dict(got) == expected(ids.tolist(), x.tolist(), list(zip(ids[::3].tolist(), x[::3].tolist())))


@pytest.mark.parametrize("values", [(1, 2, 127), (1, 128, -5), (-129, 3, 0), (40_000, 1, 2), (-40_000, 2, 70_000), (3_000_000_000, 1, -1), (2, 3, -3_000_000_000)])
def test_integers_of_any_size_are_kept(spark, values):
    df = spark.createDataFrame([(50, [1.0])] + [(51 + i, [float(x)]) for i, x in enumerate(values)], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.exact_top_k(df, scale=1).orderBy("rank").collect()]
    assert got == sorted([(51 + i, x) for i, x in enumerate(values)], key=lambda r: (-r[1], r[0]))
