"""Substring dedup by sliding sentence spans and word windows.

Every sentence begins one span: as many consecutive sentences as it takes to reach
``min_sentences`` and ``min_words``. A sentence that has ``min_words`` alone is a span too. Where
a span ends depends on its own content alone, so a passage copied into another text has the same
spans there. Where ``RUN`` words hold no such span, a window of ``WINDOW`` of them is one: the
window with the least hash, so that any copy of those words chooses it too. Two texts that share
``RUN`` consecutive words, whatever their sentences and lines, thus share a span within them.
Spans are hashed and joined globally; only hashes, ids and positions are shuffled. What a
non-first copy of a repeated span covers is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.llm import bits
from eventide.llm.common import as_bytes, fresh, in_batches, with_column, written

RESULTS = ("n_sentences", "n_removed", "n_removed_words")

# A sentence ends with the white space behind closing punctuation, or with white space that holds a line end.
CLOSERS, ENDS = "\"'”’)]", ".!?。！？…"
BLANK, CLOSER, POINT, LINE = 1, 2, 4, 8
KINDS = np.zeros(0xFF21, dtype=np.uint8)  # the last place stands for all characters beyond
KINDS[[c for c in range(len(KINDS) - 1) if chr(c).isspace()]] = BLANK
KINDS[[ord(c) for c in CLOSERS]] = CLOSER
KINDS[[ord(c) for c in ENDS]] = POINT
KINDS[10] |= LINE
RUN, WINDOW = 50, 26  # a window is longer than the step to the next one, at most RUN - WINDOW + 1
HOT = 1000
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], dtype=np.uint64)


def marks(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where sentences end, whether each is closed by punctuation, and where words begin."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n = len(code)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
    kind = KINDS[np.minimum(code, len(KINDS) - 1)]
    blank = (kind & BLANK).astype(bool)
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    begins = np.concatenate([np.zeros(1 if blank[0] else 0, np.int64), edge[blank[edge]]])  # of white space
    stops = np.concatenate([edge[~blank[edge]], np.full(1 if blank[-1] else 0, n, np.int64)])
    words = np.concatenate([np.zeros(0 if blank[0] else 1, np.int64), edge[~blank[edge]]])
    # The last character before that closes nothing: punctuation or not.
    solid = np.maximum.accumulate(np.where(kind & CLOSER, -1, np.arange(n)))

    def closes(at: np.ndarray) -> np.ndarray:
        before = np.where(at > 0, solid[at - 1], -1)
        return (before >= 0) & (kind[before] & POINT).astype(bool)

    points = closes(begins)
    lines = np.concatenate([[0], np.cumsum(kind & LINE != 0)])
    ends = points | (lines[stops] > lines[begins])
    out, closed = stops[ends], points[ends]
    if not len(out) or out[-1] < n:
        out = np.append(out, n)
        closed = np.append(closed, not blank[-1] and bool(closes(np.array([n]))[0]))
    return out, closed, words


def _spans(begin: list[int], end: int, min_sentences: int, min_words: int) -> list[tuple[int, int]]:
    """Spans as word positions, of sentences that begin at the word positions ``begin``, the last one ending at ``end``."""
    edges, out = [*begin, end], []
    to, n = 0, len(begin)
    for i in range(n):
        if edges[i + 1] == edges[i]:
            continue
        if edges[i + 1] - edges[i] >= min_words and min_sentences > 1:
            out.append((edges[i], edges[i + 1]))
        to = max(to, i + min_sentences)
        while to <= n and edges[to] - edges[i] < min_words:
            to += 1
        if to <= n:
            out.append((edges[i], edges[to]))
    return out


def word_hashes(words: list[str]) -> np.ndarray:
    """A hash of every word; each distinct one is hashed once."""
    coded = pa.array(words, pa.string()).dictionary_encode()
    return bits.word_hashes(as_bytes(coded.dictionary))[coded.indices.to_numpy()] if words else np.zeros(0, np.uint64)


def _windows(hashes: np.ndarray, found: list[tuple[int, int]], closed: bool) -> list[int]:
    """Where windows begin: those that runs of ``RUN`` words without a span of ``found`` in them choose.

    A span that begins with the run does not count, nor one that the end of the text ends: the
    words before and behind the run decide on these.
    """
    n = len(hashes)
    if n < RUN:
        return []
    bare = np.ones(n - RUN + 1, dtype=bool)
    for a, b in found:
        if a and (b < n or closed):
            bare[max(b - RUN, 0) : a] = False
    if not bare.any():
        return []
    at = np.flatnonzero(bare)
    lo, hi = int(at[0]), int(at[-1]) + RUN
    h = hashes[lo:hi]
    m = len(h) - WINDOW + 1
    order = h[:m] * MIX[0] + h[1 : m + 1] * MIX[1] + h[2 : m + 2] * MIX[2]
    order = (order ^ (order >> np.uint64(31))) * MIX[3]
    least = np.lib.stride_tricks.sliding_window_view(order, RUN - WINDOW + 1)[at - lo].argmin(axis=1)
    return np.unique(least + at).tolist()


def split_words(text: str) -> list[str]:
    return text.lower().split()


class Outline:
    """A text's sentences, words and spans, the latter as word positions."""

    def __init__(self, text: str, hashes: np.ndarray, min_sentences: int, min_words: int):
        ends, closed, self.starts = marks(text)
        self.hashes, n = hashes, len(hashes)
        self.ends = ends.tolist()
        begins = np.searchsorted(self.starts, np.concatenate([[0], ends[:-1]])) if len(ends) else ends
        self.begin = begins.tolist()
        found = _spans(self.begin, n, min_sentences, min_words)
        # Line ends are white space: a copy may have others.
        whole = found
        if not closed[:-1].all():
            whole = _spans(begins[np.concatenate([[True], closed[:-1]])].tolist(), n, min_sentences, min_words)
        windows = _windows(self.hashes, whole, bool(len(closed)) and bool(closed[-1]))
        self.ranges = sorted({*found, *whole, *[(a, a + WINDOW) for a in windows]})


# Odd bases, their inverses modulo 2 ** 64, and the powers used so far.
BASES = [int(m) | 1 for m in MIX[:2]]
POWERS = {b: np.ones(1, dtype=np.uint64) for b in [*BASES, *(pow(b, -1, 1 << 64) for b in BASES)]}


def _powers(base: int, n: int) -> np.ndarray:
    if len(POWERS[base]) < n:
        steps = np.full(2 * n, base, dtype=np.uint64)
        steps[0] = 1
        POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return POWERS[base][:n]


def span_hashes(hashes: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """128 bits of every run of words, from running sums over the words' hashes: (n, 2) signed halves."""
    out = np.empty((len(ranges), 2), dtype=np.int64)
    for side, base in enumerate(BASES):
        h = bits.mixed(hashes + np.uint64(side))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(base, len(h)), dtype=np.uint64)])
        a, b = ranges[:, 0], ranges[:, 1]
        moved = (sums[b] - sums[a]) * _powers(pow(base, -1, 1 << 64), len(h))[a]
        out[:, side] = bits.mixed(moved + (b - a).astype(np.uint64)).view(np.int64)
    return out


def _keys(words: list[str], ranges: list[tuple[int, int]]) -> list[bytes]:
    return [" ".join(words[a:b]).encode() for a, b in ranges]


def _pieces(text: str, ends: list[int], begin: list[int], starts: np.ndarray, ranges: list[tuple[int, int]]) -> tuple[list[str], dict[int, int]]:
    """Pieces that joined give the text again, sentences cut where a range begins or ends, and which piece begins at a word."""
    n = len(starts)
    places = dict(zip([0, *ends], begin))  # word positions of the marks
    for w in {w for r in ranges for w in r} - {*begin, n}:
        places[int(starts[w])] = w
    cuts = sorted(places)
    pieces = [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]
    return pieces, {places[c]: i for i, c in enumerate(cuts)} | {n: len(pieces)}


def outline(text: str, min_sentences: int = 2, min_words: int = 20) -> tuple[list[str], list[int], list[int], list[bytes]]:
    """Pieces of the text, and starts, ends (in pieces) and normalised contents of the spans."""
    words = split_words(text)
    o = Outline(text, word_hashes(words), min_sentences, min_words)
    pieces, at = _pieces(text, o.ends, o.begin, o.starts, o.ranges)
    return pieces, [at[a] for a, _ in o.ranges], [at[b] for _, b in o.ranges], _keys(words, o.ranges)


def sentences(text: str) -> list[str]:
    """Pieces that joined give the text again; each carries the white space behind it."""
    return outline(text)[0]


def spans(pieces: list[str], min_sentences: int, min_words: int) -> tuple[list[int], list[int], list[bytes]]:
    """Starts, ends and normalised contents of the spans."""
    return outline("".join(pieces), min_sentences, min_words)[1:]


SPAN = T.StructType([T.StructField("_pos", T.IntegerType()), T.StructField("_n", T.IntegerType()), T.StructField("_h1", T.LongType()), T.StructField("_h2", T.LongType())])


def _hash_spans(min_sentences: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, pos = [], []
            counts = np.zeros(batch.num_rows, dtype=np.int64)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            words = [split_words(t) for t in texts]
            hashes = np.split(word_hashes([w for own in words for w in own]), np.cumsum([len(own) for own in words])[:-1])
            del words
            for i, (text, own) in enumerate(zip(texts, hashes)):
                if len(own):
                    o = Outline(text, own, min_sentences, min_words)
                    if o.ranges:
                        at = np.array(o.ranges, dtype=np.int64)
                        found.append(span_hashes(o.hashes, at))
                        pos.append(at)
                        counts[i] = len(at)
            if found:
                h, at = np.concatenate(found), np.concatenate(pos).astype(np.int32)
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), counts)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(at[:, 0]), pa.array(at[:, 1] - at[:, 0]), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["_id", "_pos", "_n", "_h1", "_h2"]
                )

    return run


def _cut(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_all, n_cut, w_cut = [], [], [], []
            column = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            for text, drop in zip(column, batch.column(batch.schema.get_field_index("_drop")).to_pylist()):
                text = text or ""
                ends, _, starts = marks(text)
                n_all.append(len(ends))
                n_cut.append(0)
                w_cut.append(0)
                if not drop:
                    texts.append(text)
                    continue
                ranges = [(d["_pos"], d["_pos"] + d["_n"]) for d in drop]
                begin = np.searchsorted(starts, np.concatenate([[0], ends[:-1]]))
                pieces, at = _pieces(text, ends.tolist(), begin.tolist(), starts, ranges)
                gone: set[int] = set()
                lost = np.zeros(len(starts) + 1, dtype=np.int64)
                for a, b in ranges:
                    gone.update(range(at[a], at[b]))
                    lost[a:b] = 1
                texts.append("".join(p for i, p in enumerate(pieces) if i not in gone))
                sums = np.concatenate([[0], np.cumsum(lost)])
                n_cut[-1] = int((sums[np.append(begin[1:], len(starts))] > sums[begin]).sum())
                w_cut[-1] = int(lost.sum())
            out = with_column(batch.drop_columns(["_drop"]), text_col, pa.array(texts, pa.string()))
            for name, values in zip(RESULTS, (n_all, n_cut, w_cut)):
                out = with_column(out, name, pa.array(values, pa.int64()))
            yield out

    return run


def _place(kind: T.DataType):
    """(id, position) as one value in their order: a number where the id is one, so that aggregation hashes."""
    if isinstance(kind, T.IntegralType):
        return (F.col("_id").cast("decimal(19,0)") * F.expr("cast(4294967296 as decimal(10,0))") + F.col("_pos")).cast("decimal(38,0)")
    return F.struct("_id", "_pos")


def _repeated(found: DataFrame, again: DataFrame) -> DataFrame:
    """The spans whose hash is in ``again``, with its columns.

    A Bloom filter of fixed size drops most others where they lie. Hashes that make up 1 / HOT of all spans
    are at most HOT: they are met by a broadcast and never shuffled; the rest is joined.
    """
    spark = found.sparkSession
    share = found.count() / HOT
    hot = again.where(F.col("_times") >= share)
    first = lambda b: b.column(0).to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(bits.build(again.select("_h1"), first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = bits.holds(shared.value, batch.column(3).to_numpy().view(np.uint64))
            if keep.any():
                yield batch.filter(pa.array(keep))

    some = in_batches(found, run, found.schema).select(*found.columns)
    keys = ["_h1", "_h2"]
    met = some.join(F.broadcast(hot), keys)
    rest = some.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(again.where(F.col("_times") < share), keys)
    return met.unionByName(rest)


def dedup_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = 2, min_words: int = 20
) -> DataFrame:
    """The documents without what a non-first repeated span covers.

    Of ``RUN`` consecutive words that an earlier document holds, some always go. Adds
    ``n_sentences`` (before), ``n_removed`` (those that lost words) and ``n_removed_words``. Spans compare without
    case and with white space as one blank. The first copy of a span is the one with the
    smallest (id, word number); all others go, also within one document.

    Null text counts as empty and comes back empty. Rows with a null id take no part and stay as
    they are. Rows that repeat an id are one document: what only they share stays. Other columns
    pass through; columns with the names of the results are replaced. A text with fewer
    words than a span has no spans. An empty table gives an empty table.
    """
    docs = fresh(docs, *RESULTS, "_drop", "_id")
    kind = docs.schema[id_col].dataType
    rows = docs.select(id_col, text_col).where(F.col(id_col).isNotNull())
    # Hashed once: both passes over the spans read the narrow table.
    found = written(in_batches(rows, _hash_spans(min_sentences, min_words), T.StructType([T.StructField("_id", kind), *SPAN.fields])), "spans")
    place = _place(kind)
    both = found.groupBy("_h1", "_h2").agg(F.min(place).alias("_first"), F.max(place).alias("_last"), F.count("*").alias("_times"))
    again = written(both.where("_first < _last").drop("_last"), "spans-again")
    hits = _repeated(found, again).where(place != F.col("_first"))
    drops = hits.groupBy("_id").agg(F.collect_list(F.struct("_pos", "_n")).alias("_drop"))
    joined = docs.join(drops, F.col(id_col) == F.col("_id"), "left").drop("_id")
    fields = [T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in docs.schema]
    schema = T.StructType([*fields, *[T.StructField(n, T.LongType()) for n in RESULTS]])
    return in_batches(joined, _cut(text_col), schema)
