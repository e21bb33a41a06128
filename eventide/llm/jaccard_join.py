"""N-gram Jaccard join with a count-vector R-tree.

A text is the set of its word shingles, 64-bit hashes. Equal sets are one class. Shingles are
hashed into groups; the counts of a set's groups are its point. The overlap of two sets is at
most the sum of the coordinate minima of their points, and an R-tree whose nodes keep coordinate
maxima and size ranges cuts every branch whose bound cannot reach the needed overlap. Points are
kept sparse: there must be more groups than shingles under a node, or its maxima reach every query.

1. Linked sets must share one of their first shingles in a common order (prefix filter). The
   order puts shingles from crowded hash buckets last, so passages that very many documents share
   make no candidates. Rows of one shingle form a run; runs with equal members are one run.
2. Each run is searched with an R-tree over its points. What survives the bound joins a block.
3. The sets of a block are searched with an R-tree again and surviving pairs are verified.
   Pairs whose ends are connected already are passed over, so a group of near copies costs
   about one verification per member.

Large blocks are cut into chunks by size band and hash; every pair of chunks that can hold a
link is one bounded task, so no block is gathered whole and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import as_bytes, fresh, in_batches, key_runs, partitions, written
from eventide.llm.components import components

GROUPS = 1 << 16
COARSE = 1 << 10  # groups, in the points that travel, of sets with so many shingles
LEAF = 64
NO_GROUP, SEVERAL = -1, -2  # of the members under a node
BUCKETS = 1 << 20  # hash buckets whose crowding orders the shingles
CHUNK_SHINGLES = 1_000_000  # shingles of a chunk; a longer set is a chunk of its own
SALT_ROWS = 1 << 15  # rows of one shingle in one task
BROADCAST_ROWS = 500_000  # narrow rows; above it the join is left to the optimizer

MULTIPLIERS = np.array([int(xxhash.xxh64_intdigest(f"shingle {i}".encode()) | 1) for i in range(64)], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``k`` words; of the whole sequence if it is shorter."""
    found = text.lower().split() if text else []
    n = len(found)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, found)), dtype=np.uint64)
    width = min(k, n)
    total = np.full(n - width + 1, width, dtype=np.uint64)
    for i in range(width):
        total += h[i : n - width + 1 + i] * MULTIPLIERS[i]
    h = np.sort(mixed(total))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def set_digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def point(s: np.ndarray) -> bytes:
    """The group of every shingle, sorted; counts of ``COARSE`` groups from so many shingles on."""
    group = (s >> np.uint64(40)).astype(np.int64)
    if len(s) < COARSE:
        return np.sort((group % GROUPS).astype(np.uint16)).tobytes()
    counts = np.bincount(group % COARSE, minlength=COARSE)
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def grouped(groups: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    groups = np.sort(groups)
    at = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    return GROUPS, groups[at].astype(np.int64), np.diff(at, append=len(groups))


def counts_of(data: bytes, n: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Resolution of a point, its groups that are not empty and their counts."""
    if n < COARSE:
        return grouped(np.frombuffer(data, dtype=np.uint16))
    counts = np.frombuffer(data, dtype=f"u{len(data) // COARSE}")
    ids = np.flatnonzero(counts)
    return COARSE, ids, counts[ids].astype(np.int64)


def prefix_length(n: int, percent: int) -> int:
    """Shingles of which one must be shared: all but the needed overlap of the smallest partner, plus one."""
    return n - -(-percent * n // 100) + 1


def _scan(k: int, percent: int):
    """First pass: digests of the sets, and by how much the crowded buckets of the task stand out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, counts = set(), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            n, one, two, new, points = [], [], [], [], []
            for text in as_bytes(batch.column(1)):
                s = shingles(text, k)
                a, b = set_digest(s)
                n.append(len(s))
                one.append(a)
                two.append(b)
                points.append(point(s) if len(s) else None)
                if len(s) and (a, b) not in seen:
                    seen.add((a, b))
                    new.append(s)
            if new:
                counts += np.bincount((np.concatenate(new) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
            nil = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(points, pa.binary()), nil, nil],
                names=["id", "n", "h1", "h2", "point", "bucket", "crowd"],
            )
        mean = counts.mean()
        at = np.flatnonzero(counts > mean + 4 * np.sqrt(mean) + 4)
        if len(at):
            nil = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [nil, nil, nil, nil, pa.nulls(len(at), pa.binary()), pa.array(at), pa.array(counts[at] - int(mean))],
                names=["id", "n", "h1", "h2", "point", "bucket", "crowd"],
            )

    return run


def crowded(scan: DataFrame) -> np.ndarray:
    """A level per bucket: 0, or the bits of the documents above the mean. A table of fixed size."""
    levels = np.zeros(BUCKETS, dtype=np.uint8)
    rows = scan.where("bucket is not null").groupBy("bucket").agg(F.sum("crowd").alias("n")).where("n >= 16")
    for bucket, n in rows.collect():
        levels[bucket] = min(int(n).bit_length(), 255)
    return levels


def _prefixes(k: int, percent: int, levels_of):
    """Second pass: (token, salt, class) for the prefix of every set; equal sets once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, levels = set(), levels_of.value
        for batch in batches:
            tokens, owners, lengths, salts = [], [], [], []
            for text in as_bytes(batch.column(0)):
                s = shingles(text, k)
                if not len(s):
                    continue
                key = set_digest(s)
                if key in seen:
                    continue
                seen.add(key)
                level = levels[(s % np.uint64(BUCKETS)).astype(np.int64)]
                order = np.argsort(level, kind="stable")[: prefix_length(len(s), percent)]
                tokens.append(s[order])
                owners.append(key[0])
                lengths.append(len(order))
                # A crowded token is dealt out over several tasks by the class.
                parts = np.maximum(1, (1 << level[order].astype(np.int64).clip(0, 62)) // SALT_ROWS)
                salts.append(np.where(parts > 1, 1 + (key[1] & 0x7FFFFFFF) % parts, 0))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(tokens).view(np.int64)),
                        pa.array(np.concatenate(salts), pa.int64()),
                        pa.array(np.repeat(np.array(owners, dtype=np.int64), lengths)),
                    ],
                    names=["token", "salt", "class"],
                )

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (token, salt, class): (run, class) for every run of two classes and more.

    A run is named by a hash of its members, so equal runs of several tokens fall together. A
    token that was dealt out gives (class, lead) of each part instead, and the leads with the token.
    """
    seen: set[int] = set()

    def done(token, salt, owner):
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
        again = np.zeros(len(token), dtype=bool)
        again[1:] = ~new[1:] & (owner[1:] == owner[:-1])
        token, salt, owner, new = (x[~again] for x in (token, salt, owner, new))
        begins = np.flatnonzero(new)
        sizes = np.diff(np.append(begins, len(token)))
        names = np.add.reduceat(mixed(owner.view(np.uint64)), begins) + sizes.astype(np.uint64)
        keep = (sizes > 1) & (salt[begins] == 0)
        fresh_run = np.zeros(len(begins), dtype=bool)
        for i in np.flatnonzero(keep).tolist():
            if (name := int(names[i])) not in seen:
                seen.add(name)
                fresh_run[i] = True
        if len(seen) > 1_000_000:
            seen.clear()
        rows = np.repeat(fresh_run, sizes)
        if rows.any():
            run = np.repeat(names.view(np.int64), sizes)[rows]
            nil = pa.nulls(len(run), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(run), pa.array(owner[rows]), nil, nil], names=["run", "class", "lead", "token"])
        dealt = salt > 0
        if dealt.any():
            lead = np.repeat(owner[begins], sizes)[dealt]
            nil = pa.nulls(len(lead), pa.int64())
            first = new[dealt]
            yield pa.RecordBatch.from_arrays(
                [nil, pa.array(owner[dealt]), pa.array(lead), pa.array(token[dealt], mask=~first)], names=["run", "class", "lead", "token"]
            )

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy() for i in range(3)]
        if held:
            now = [np.concatenate(x) for x in zip(held, now)]
        token, salt, _ = now
        differs = np.flatnonzero((token != token[-1]) | (salt != salt[-1]))
        cut = int(differs[-1]) + 1 if len(differs) else 0  # the last run may go on in the next batch
        if cut:
            yield from done(*(x[:cut] for x in now))
        held = [x[cut:] for x in now]
    if held:
        yield from done(*held)


def reaches(bound: np.ndarray, low: np.ndarray, top: np.ndarray, size: int, percent: int) -> np.ndarray:
    """Sizes in the ratio, and a bound that reaches t / (1 + t) of both sizes together."""
    return ((100 + percent) * bound >= percent * (size + low)) & (percent * low <= 100 * size) & (100 * top >= percent * size)


class RTree:
    """Count vectors of one resolution; nodes hold coordinate maxima and size ranges.

    A level has about four groups per shingle under one of its nodes (``GROUPS`` at most), so that
    maxima of sets with nothing in common leave most of a query's coordinates empty. A node counts
    the firsts under it and knows the one group, if there is one, of its other members: a search
    walks only below nodes that can hold what it wants.
    """

    def __init__(self, members: np.ndarray, points: list[tuple[np.ndarray, np.ndarray]], sizes: np.ndarray, groups: int, percent: int):
        self.members, self.sizes, self.groups, self.percent = members, sizes, groups, percent
        self.place = {int(m): at for at, m in enumerate(members.tolist())}
        lengths = np.array([len(ids) for ids, _ in points], dtype=np.int64)
        self.ends = np.cumsum(lengths)
        self.begins = self.ends - lengths
        self.ids = np.concatenate([ids for ids, _ in points])
        self.counts = np.concatenate([counts for _, counts in points])
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.firsts: list[np.ndarray] = []
        self.labels: list[np.ndarray] = []
        self.checks = 0
        self._dense = empty_counts(groups)
        owner, width = np.repeat(np.arange(len(members)), lengths), LEAF
        while True:
            self._level(owner, width)
            if width >= len(members):
                break
            width *= LEAF

    def _level(self, owner: np.ndarray, width: int) -> None:
        at = np.arange(0, len(self.members), width)
        wanted = 4 * int(self.sizes.sum()) // len(at)
        groups = min(self.groups, 1 << max(wanted - 1, 1).bit_length())
        key, counts = owner * groups + (self.ids & (groups - 1)), self.counts
        if groups < self.groups:
            key, where = np.unique(key, return_inverse=True)
            counts = np.bincount(where, weights=counts).astype(np.int64)
        high = np.zeros(len(at) * groups, dtype=np.min_scalar_type(int(counts.max())))
        np.maximum.at(high, key // groups // width * groups + key % groups, counts.astype(high.dtype))
        self.levels.append((high.reshape(len(at), groups), np.minimum.reduceat(self.sizes, at), np.maximum.reduceat(self.sizes, at)))
        self.firsts.append(np.zeros(len(at), dtype=np.int64))
        self.labels.append(np.full(len(at), NO_GROUP, dtype=np.int64))

    def added(self, member: int, group: int, first: bool) -> None:
        at = self.place.get(member, -1)
        for firsts, labels in zip(self.firsts, self.labels) if at >= 0 else ():
            at //= LEAF
            if first:
                firsts[at] += 1
            else:
                labels[at] = group if labels[at] in (NO_GROUP, group) else SEVERAL

    def merged(self, joined: list[int], least: int) -> None:
        """Groups become one; their firsts are members like others from now on, but for ``least``."""
        for labels in self.labels:
            labels[np.isin(labels, joined)] = least
        for f in joined:
            at = self.place.get(f, -1)
            for firsts in self.firsts if at >= 0 and f != least else ():
                at //= LEAF
                firsts[at] -= 1
            if f != least:
                self.added(f, least, False)

    def reaches(self, bound: np.ndarray, low: np.ndarray, top: np.ndarray, size: int) -> np.ndarray:
        self.checks += len(bound)
        return reaches(bound, low, top, size, self.percent)

    def search(self, ids: np.ndarray, counts: np.ndarray, size: int, joined: list[int] | None, wanted) -> np.ndarray:
        """Members in ``wanted`` whose bound reaches the needed overlap: firsts, or others not in ``joined``."""
        at = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            if joined is None:
                at = at[self.firsts[depth][at] > 0]
            else:
                at = at[~np.isin(self.labels[depth][at], [NO_GROUP, *joined])]
            if not len(at):
                return at
            high, low, top = self.levels[depth]
            groups = high.shape[1]
            own, much = folded(ids, counts, groups) if groups < self.groups else (ids, counts)
            bound = np.minimum(high[at[:, None], own], much).sum(axis=1, dtype=np.int64)
            at = at[self.reaches(bound, low[at], top[at], size)]
            below = len(self.levels[depth - 1][1]) if depth else len(self.members)
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < below]
        at = at[wanted(self.members[at])]
        if not len(at):
            return at
        lengths = self.ends[at] - self.begins[at]
        ends = np.cumsum(lengths)
        rows = np.repeat(self.begins[at] - (ends - lengths), lengths) + np.arange(ends[-1])
        self._dense[ids] = counts
        bound = np.add.reduceat(np.minimum(self._dense[self.ids[rows]], self.counts[rows]), ends - lengths)
        self._dense[ids] = 0
        return self.members[at[self.reaches(bound, self.sizes[at], self.sizes[at], size)]]


@lru_cache(maxsize=2)
def empty_counts(groups: int) -> np.ndarray:
    """Counts of a query while it is held against points; zero before and after, so all trees share them."""
    return np.zeros(groups, dtype=np.int64)


def folded(ids: np.ndarray, counts: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """A point by fewer groups."""
    own, where = np.unique(ids & (groups - 1), return_inverse=True)
    return own, np.bincount(where, weights=counts).astype(np.int64)


def in_leaf(points: list[tuple[int, np.ndarray, np.ndarray]], sizes: np.ndarray, percent: int, confirm) -> list[tuple[int, int]]:
    """``spanning`` for the points of a tree of one leaf, held against each other directly."""
    dense = empty_counts(points[0][0])
    ids, counts = (np.concatenate([p[k] for p in points]) for k in (1, 2))
    begins = np.cumsum([0, *(len(p[1]) for p in points)])
    group, out = list(range(len(points))), []
    for i in range(1, len(points)):
        before, after = begins[i], begins[i + 1]
        dense[ids[before:after]] = counts[before:after]
        bound = np.add.reduceat(np.minimum(dense[ids[:before]], counts[:before]), begins[:i])
        dense[ids[before:after]] = 0
        joined: set[int] = set()
        for j in np.flatnonzero(reaches(bound, sizes[:i], sizes[:i], int(sizes[i]), percent)).tolist():
            if group[j] not in joined and confirm(i, j):
                joined.add(group[j])
                out.append((i, j))
        if joined:
            least = min(joined)
            group = [least if g in joined else g for g in group]
            group[i] = least
    return out


def trees_of(points: list[tuple[int, np.ndarray, np.ndarray]], sizes: np.ndarray, percent: int) -> tuple[np.ndarray, list[RTree]]:
    """The order in which to add the sets, and a tree for each resolution.

    Sets are packed by size band and by their lowest group, a min-hash: near copies lie together.
    Fine points that are large enough to link with a coarse one stand in the coarse tree as well.
    """
    band = np.floor(np.log(sizes) / np.log(1.25))
    lowest = np.array([ids[0] if groups == GROUPS else ids[counts.argmax()] for groups, ids, counts in points])
    order = np.lexsort((sizes, lowest, band))
    coarse = np.array([groups < GROUPS for groups, _, _ in points])
    trees = []
    if not coarse.all():
        at = order[~coarse[order]]
        trees.append(RTree(at, [points[i][1:] for i in at], sizes[at], GROUPS, percent))
    if coarse.any():
        at = order[(coarse | (100 * sizes >= percent * COARSE))[order]]
        trees.append(RTree(at, [points[i][1:] if coarse[i] else folded(*points[i][1:], COARSE) for i in at], sizes[at], COARSE, percent))
    return order, trees


def spanning(points: list[tuple[int, np.ndarray, np.ndarray]], sizes: np.ndarray, percent: int, confirm, trees=None) -> list[tuple[int, int]]:
    """Pairs that survive the bound and ``confirm``, as many as connect what such pairs connect.

    Members are added one by one. The trees are asked for the first member of each group found so
    far that the new one may link with, then for other members of the groups it has not joined.
    """
    n = len(sizes)
    if not trees and n <= LEAF and len({groups for groups, _, _ in points}) == 1:
        return in_leaf(points, sizes, percent, confirm)
    order, trees = trees or trees_of(points, sizes, percent)
    group = np.full(n, NO_GROUP, dtype=np.int64)  # by its first member
    is_first = np.zeros(n, dtype=bool)
    out = []
    for i in order.tolist():
        groups, ids, counts = points[i]
        asked = []
        for tree in trees:
            if tree.groups == groups:
                asked.append((tree, ids, counts))
            elif tree.groups < groups and 100 * sizes[i] >= percent * COARSE:
                asked.append((tree, *folded(ids, counts, tree.groups)))
        joined: list[int] = []
        for tree, own, much in asked:
            for f in tree.search(own, much, int(sizes[i]), None, lambda m: is_first[m]).tolist():
                if f not in joined and confirm(i, f):
                    joined.append(f)
                    out.append((i, f))
        for tree, own, much in asked:

            def others(m):
                return (group[m] != NO_GROUP) & ~is_first[m] & ~np.isin(group[m], joined)  # noqa: B023

            for j in tree.search(own, much, int(sizes[i]), joined, others).tolist():
                if group[j] not in joined and confirm(i, j):
                    joined.append(int(group[j]))
                    out.append((i, j))
        least = min(joined, default=i)
        group[i], is_first[i] = least, not joined
        if len(joined) > 1:
            group[np.isin(group, joined)] = least
            is_first[[f for f in joined if f != least]] = False
            for tree in trees:
                tree.merged(joined, least)
        for tree in trees:
            tree.added(i, least, not joined)
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _search_runs(percent: int):
    """Candidate links of each run of points; spanning ones, nothing is verified yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        for rows in key_runs(batches, ["run"]):
            if rows.num_rows < 2:
                continue
            sizes = rows.column("n").to_numpy()
            points = [counts_of(p, n) for p, n in zip(rows.column("point").to_pylist(), sizes.tolist())]
            ids = rows.column("class").to_numpy()
            for i, j in spanning(points, sizes, percent, lambda i, j: True):
                u.append(int(ids[i]))
                v.append(int(ids[j]))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t, k).tobytes() for t in as_bytes(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.binary())], names=["id", "pair", "side", "shingles"])

    return run


def _join_chunks(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_runs(batches, ["pair"]):
            ids = group.column("id").to_numpy()
            if len(ids) < 2:
                continue
            sets = [np.frombuffer(b, dtype=np.uint64) for b in group.column("shingles").to_pylist()]
            sizes = np.array([len(x) for x in sets], dtype=np.int64)
            points = [grouped((x >> np.uint64(40)).astype(np.int64) % GROUPS) for x in sets]
            found = spanning(points, sizes, percent, lambda i, j: linked(sets[i], sets[j], percent))  # noqa: B023
            if found:
                at = np.array(found)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], names=["u", "v"])

    return run


def chunk_pairs(members: DataFrame, percent: int = 80) -> DataFrame:
    """(id, n, pair, side) for every task in which a member of a block must stand.

    A block of up to ``CHUNK_SHINGLES`` is one task. A larger one is cut by size band (ratio 5/4, or
    a little over 100 / ``percent`` below 80, so that links join neighbouring bands at most) and hash; each pair of chunks of the same or of
    neighbouring bands is a task.
    """
    ratio = 1.25 if percent >= 80 else 100.1 / percent  # over the ratio: logarithms are rounded
    band = F.floor(F.log("n") / F.lit(float(np.log(ratio)))).cast("int")
    rows = members.withColumn("band", band)
    weigh = rows.groupBy("block", "band").agg(F.sum("n").alias("w"))
    total = weigh.groupBy("block").agg(F.sum("w").alias("all"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("w") / CHUNK_SHINGLES).cast("int")))).alias("parts"))
    rows = rows.join(total, "block")
    own = F.pmod(F.xxhash64("id"), F.element_at("parts", F.col("band"))).cast("int")
    rows = rows.withColumn("chunk", own)

    def chunks(b):
        return F.transform(F.sequence(F.lit(0), F.coalesce(F.try_element_at("parts", b), F.lit(0)) - 1), lambda j: F.struct(b.alias("band"), j.alias("chunk")))

    def neighbours(b):
        return F.when(F.try_element_at("parts", b).isNotNull(), chunks(b)).otherwise(F.array().cast("array<struct<band:int,chunk:int>>"))

    me = F.struct("band", "chunk")
    there = F.concat(*[neighbours(F.col("band") + d) for d in (-1, 0, 1)])
    large = F.transform(there, lambda o: F.xxhash64("block", F.least(o, me), F.greatest(o, me)))
    keys = F.when(F.col("all") <= CHUNK_SHINGLES, F.array(F.xxhash64("block"))).otherwise(large)
    return rows.select("id", "n", F.explode(keys).alias("pair"), F.col("chunk").alias("side"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) for every row: linked at Jaccard of ``percent`` / 100 and more.

    Words are runs without blank, tab to carriage return, A-Z lower-cased. Ids are integers.
    ``component_id`` is the smallest id reachable by links, the own id included.

    Null text and text without words have an empty set, no shingles and no links. Texts with
    fewer than ``k`` words are one shingle. Rows with a null id get their count and a null
    component and link nothing. Rows that repeat an id are one document: the links of any of its
    texts count for all. Extra columns are not read. An empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext
    scan = written(in_batches(rows, _scan(k, percent), "id long, n long, h1 long, h2 long, point binary, bucket long, crowd long"), "jaccard-scan")
    own = scan.where("bucket is null")
    full = own.where("id is not null and n > 0")
    classes = full.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("point").alias("point"))

    levels = shared.broadcast(crowded(scan))  # BUCKETS bytes
    n = partitions(docs)
    known = rows.where("id is not null")
    tokens = in_batches(known.select("text"), _prefixes(k, percent, levels), "token long, salt long, class long")
    sorted_tokens = tokens.repartition(n, "token", "salt").sortWithinPartitions("token", "salt", "class")
    runs = written(in_batches(sorted_tokens, _runs, "run long, class long, lead long, token long"), "jaccard-runs")
    placed_runs = runs.where("run is not null").select("run", "class").distinct()
    points = placed_runs.join(classes.select(F.col("h1").alias("class"), "n", "point"), "class")
    points = points.repartition(n, "run").sortWithinPartitions("run", "n", "class")
    shares = in_batches(points, _search_runs(percent), "u long, v long")
    # Parts of a token that was dealt out belong to one block, whatever their points say.
    dealt = runs.where("token is not null").select("lead", "token")
    first = dealt.groupBy("token").agg(F.min("lead").alias("v"))
    shares = shares.unionByName(runs.where("lead <> class").select(F.col("class").alias("u"), F.col("lead").alias("v")))
    shares = written(shares.unionByName(dealt.join(first, "token").select(F.col("lead").alias("u"), "v")), "jaccard-shares")
    blocks = components(shares, "jaccard-blocks").select(F.col("node").alias("h1"), F.col("component").alias("block"))

    members = classes.join(blocks, "h1").select(F.col("rep").alias("id"), "n", "block")
    placed = written(chunk_pairs(members, percent), "jaccard-members")
    few = placed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    wanted = placed.select("id", "pair", "side")
    texts = known.join(F.broadcast(wanted) if few else wanted, "id").select("id", "pair", "side", "text")
    sets = in_batches(texts, _sets(k), "id long, pair long, side int, shingles binary")
    dealt_sets = sets.repartition(n, "pair").sortWithinPartitions("pair", "id")
    links = in_batches(dealt_sets, _join_chunks(percent), "u long, v long")

    # All ids of a class are linked to its representative; so are the classes of a repeated id.
    reps = written(links, "jaccard-links").unionByName(_repeated_ids(full, classes))
    named = components(reps, "jaccard-components").select(F.col("node").alias("rep"), "component")
    found = own.join(classes.select("h1", "h2", "rep"), ["h1", "h2"], "left").join(named, "rep", "left")
    whole = F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), whole).alias("component_id"))


def _repeated_ids(full: DataFrame, classes: DataFrame) -> DataFrame:
    again = full.groupBy("id").agg(F.count("*").alias("times")).where("times > 1").select("id")
    return full.join(again, "id").join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select(F.col("id").alias("u"), F.col("rep").alias("v"))


def keep_first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id is the smallest of their component, and those with a null id; columns unchanged."""
    found = jaccard_components(docs, id_col, text_col)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    return fresh(docs, "_gone").join(gone, F.col(id_col) == F.col("_gone"), "left_anti")
