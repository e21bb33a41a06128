"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often.

Every text is cut by a byte-level BPE (A) and a piece BPE (B). Byte offsets where tokens of both end
cut the text into groups; an A and a B token are linked where their byte ranges overlap. A link's
pair of ids is counted over the whole corpus, and a link is best if no pair of its B id counts more.

Counting spills to the shared folder. A task collects (pair, document) records, sorts them when its
block is full and writes one zstd run for each of RADIX partitions of B ids. A run has heads (pairs
with their links, in frames) and a body (for every pair, documents and links). Then

1. heads alone are merged with a heap over the frames of all runs of a radix partition. Keys have the
   B side first, so all pairs of a B id follow each other and its maximum is known when it ends;
2. the merged counts are streamed back over the bodies of the same partition, which gives sums by
   document, dense within a run;
3. the sums of a block meet the rows of its documents.

A pair that stands in all documents has one entry in the heads of a run. Bodies of a partition are
dealt over as many slots as their measured number of records asks for, so a hot pair is no hot task.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.llm.bpe import blocks, byte_symbols
from eventide.llm.common import in_batches, written

RADIX = 64  # partitions of B ids
HELD_LINKS = 4_000_000  # links of a block; a longer text stands alone
HELD_ROWS = 1 << 16  # rows of a block
ROW_BITS = 20
BLOCK_CHARS = 1_000_000  # texts that are cut together
FRAME = 1 << 16  # entries of a frame of heads
SLOT_RECORDS = 8_000_000  # records of bodies that one task streams back over
MERGE_ROWS = 1 << 20

RESULTS = {"n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"}


# ---------------------------------------------------------------- tokens


class Sides:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, byte_file: str, pattern: str, piece_file: bytes):
        stand = {c: b for b, c in enumerate(byte_symbols())}
        spec = json.loads(byte_file)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        # Merges of a byte-level vocabulary make its ids in order, so the ids are ranks.
        ranks = {bytes(stand[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_file)
        self.n_a, self.n_b = max(ranks.values()) + 1, self.b.get_piece_size()
        self.a_bytes = [b""] * self.n_a
        for word, i in ranks.items():
            self.a_bytes[i] = word
        self.b_bytes = [self.piece_bytes(i) for i in range(self.n_b)]
        self.a_size = np.fromiter(map(len, self.a_bytes), dtype=np.int64, count=self.n_a)
        self.b_size = np.fromiter(map(len, self.b_bytes), dtype=np.int64, count=self.n_b)
        # Ids as text with the mark behind them: "," inside a side of a group, "|" after A, ";" after B.
        a = [f"{i}{mark}" for i in range(self.n_a) for mark in ",|"]
        b = [f"{i}{mark}" for i in range(self.n_b) for mark in ",;"]
        self.said = np.array(a + b, dtype=object)
        self.width = -(-self.n_b // RADIX)
        if self.width * RADIX * self.n_a >= 1 << 64 - ROW_BITS:
            raise ValueError("the vocabularies are too large for 64-bit records")

    def piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of both sides in a row, how many each text has, and its bytes; none where the bytes differ."""
        a_ids, b_ids, sizes = [], [], np.zeros((3, len(texts)), dtype=np.int64)
        full = [i for i, t in enumerate(texts) if t]
        for i, b in zip(full, self.b.encode([texts[i] for i in full], num_threads=1)):
            text = " " + texts[i]
            raw = text.encode()
            a = self.a.encode_ordinary(text)
            if b"".join(map(self.b_bytes.__getitem__, b)) == raw and b"".join(map(self.a_bytes.__getitem__, a)) == raw:
                a_ids += a
                b_ids += b
                sizes[:, i] = len(a), len(b), len(raw)
        return np.array(a_ids, dtype=np.int64), np.array(b_ids, dtype=np.int64), *sizes

    def pack(self, b: np.ndarray, a: np.ndarray) -> np.ndarray:
        """One number for a pair of ids: radix partition, B id, A id."""
        return ((b % RADIX * self.width + b // RADIX) * self.n_a + a).astype(np.uint64)

    def unpack(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        side, a = np.divmod(keys.astype(np.int64), self.n_a)
        return a, side % self.width * RADIX + side // self.width


@lru_cache(maxsize=2)
def _sides(byte_file: str, pattern: str, piece_file: bytes) -> Sides:
    return Sides(byte_file, pattern, piece_file)


class Aligned:
    """The groups and links of texts that are laid out in one row of bytes."""

    def __init__(self, sides: Sides, texts: list[str]):
        self.a, self.b, self.n_a, self.n_b, size = sides.cut(texts)
        self.sides, self.n = sides, len(texts)
        a_end, b_end = np.cumsum(sides.a_size[self.a]), np.cumsum(sides.b_size[self.b])
        length = int(size.sum()) + 1
        in_a, in_b = np.zeros(length, dtype=bool), np.zeros(length, dtype=bool)
        in_a[a_end], in_b[b_end] = True, True
        row = np.repeat(np.arange(self.n), self.n_a)  # of A tokens
        # Between two neighbouring ends lies one overlap of one A and one B token.
        end = np.flatnonzero(in_a | in_b)
        self.link_a = (np.cumsum(in_a) - in_a)[end]
        self.link_b = (np.cumsum(in_b) - in_b)[end]
        self.link_row = row[self.link_a]
        self.n_links = np.bincount(self.link_row, minlength=self.n)
        both = in_a & in_b
        self.a_last, self.b_last = both[a_end], both[b_end]
        self.n_groups = np.bincount(row[self.a_last], minlength=self.n)

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for every text."""
        a_until = np.append(0, np.flatnonzero(self.a_last) + 1)  # A tokens before each group, and all
        b_until = np.append(0, np.flatnonzero(self.b_last) + 1)
        a_group = np.cumsum(self.a_last) - self.a_last
        b_group = np.cumsum(self.b_last) - self.b_last
        codes = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        codes[np.arange(len(self.a)) + b_until[a_group]] = self.a * 2 + self.a_last
        codes[np.arange(len(self.b)) + a_until[b_group + 1]] = (self.sides.n_a + self.b) * 2 + self.b_last
        said = self.sides.said[codes].tolist()
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(said[x:y])[:-1] for x, y in zip([0, *ends], ends)]

    def records(self, first_row: int) -> np.ndarray:
        """A number for every link: its pair, then its row."""
        keys = self.sides.pack(self.b[self.link_b], self.a[self.link_a])
        return keys << np.uint64(ROW_BITS) | (self.link_row + first_row).astype(np.uint64)


# ---------------------------------------------------------------- runs


def squeezed(values: np.ndarray) -> bytes:
    """Unsigned numbers, byte by byte of equal weight, as zstd."""
    wide = np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)
    used = max(1, int(values.max(initial=0)).bit_length() + 7 >> 3)
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(wide[:, :used].T.tobytes())


def opened(packed: bytes) -> np.ndarray:
    used = packed[0]
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), dtype=np.uint8).reshape(used, -1)
    wide = np.zeros((flat.shape[1], 8), dtype=np.uint8)
    wide[:, :used] = flat.T
    return wide.view("<u8").ravel()


def several(parts: list[np.ndarray]) -> bytes:
    packed = [squeezed(p) for p in parts]
    return struct.pack(f"<{len(packed)}Q", *map(len, packed)) + b"".join(packed)


def severed(packed: bytes, n: int) -> list[np.ndarray]:
    at, out = 8 * n, []
    for size in struct.unpack(f"<{n}Q", packed[: 8 * n]):
        out.append(opened(packed[at : at + size]))
        at += size
    return out


def frames(keys: np.ndarray, values: np.ndarray) -> list[bytes]:
    """Sorted keys with their values: frames that begin with their first key."""
    out = []
    for x in range(0, len(keys), FRAME):
        k = keys[x : x + FRAME]
        out.append(struct.pack("<Q", int(k[0])) + several([np.diff(k), values[x : x + FRAME]]))
    return out


def frame(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    first = struct.unpack("<Q", packed[:8])[0]
    gaps, values = severed(packed[8:], 2)
    return np.cumsum(np.append(np.uint64(first), gaps), dtype=np.uint64), values


def added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[cuts], np.add.reduceat(values, cuts)


def merged(runs: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sums of sorted runs in order of their keys. The heap has the next frame of every run."""
    heap = [(struct.unpack("<Q", r[0][:8])[0], i, 0) for i, r in enumerate(runs) if r]
    heapq.heapify(heap)
    keys, values, held, most = [], [], 0, MERGE_ROWS
    while heap:
        _, i, at = heapq.heappop(heap)
        k, v = frame(runs[i][at])
        keys.append(k)
        values.append(v)
        held += len(k)
        if at + 1 < len(runs[i]):
            heapq.heappush(heap, (struct.unpack("<Q", runs[i][at + 1][:8])[0], i, at + 1))
        if held >= most or not heap:
            k, v = added(np.concatenate(keys), np.concatenate(values))
            done = int(np.searchsorted(k, np.uint64(heap[0][0]))) if heap else len(k)
            if done:
                yield k[:done], v[:done]
            keys, values, held = [k[done:]], [v[done:]], len(k) - done
            most = held + MERGE_ROWS


def with_best(parts: Iterator[tuple[np.ndarray, np.ndarray]], n_a: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Adds to each count, doubled, whether it is its B id's highest. A B id is held back until it ends."""
    k, v = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def judged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        side = keys // np.uint64(n_a)
        new = np.append(True, side[1:] != side[:-1])
        highest = np.maximum.reduceat(counts, np.flatnonzero(new))[np.cumsum(new) - 1]
        return keys, counts * np.uint64(2) + (counts == highest).astype(np.uint64)

    for keys, values in parts:
        k, v = np.concatenate([k, keys]), np.concatenate([v, values])
        last = k[-1] // np.uint64(n_a) * np.uint64(n_a)
        done = int(np.searchsorted(k, last))
        if done:
            yield judged(k[:done], v[:done])
            k, v = k[done:], v[done:]
    if len(k):
        yield judged(k, v)


def runs_of(records: list[np.ndarray], sides: Sides) -> Iterator[tuple[int, int, list[bytes], bytes]]:
    """For every radix partition with records: itself, their number, heads and body."""
    every = np.sort(np.concatenate(records))
    cuts = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    links = np.diff(np.append(cuts, len(every)))
    every = every[cuts]
    keys, rows = every >> np.uint64(ROW_BITS), every & np.uint64((1 << ROW_BITS) - 1)
    radix = keys // np.uint64(sides.width * sides.n_a)
    starts = np.flatnonzero(np.append(True, radix[1:] != radix[:-1]))
    for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(every)]):
        k, r, m = keys[x:y], rows[x:y], links[x:y]
        new = np.append(True, k[1:] != k[:-1])
        at = np.flatnonzero(new)
        gaps = np.where(new, r, r - np.append(np.uint64(0), r[:-1]))  # rows rise within a pair
        body = several([np.diff(np.append(at, y - x)), gaps, m])
        yield int(radix[x]), y - x, frames(k[at], np.add.reduceat(m, at).astype(np.uint64)), body


def by_row(heads: list[bytes], body: bytes, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts and numbers of best links, by row of the block."""
    own = np.concatenate([frame(h)[0] for h in heads])
    n, gaps, links = severed(body, 3)
    n = n.astype(np.int64)
    count = counts[np.searchsorted(keys, own)].astype(np.int64)
    # Rows from gaps: running sums that begin anew with every pair.
    total = np.cumsum(gaps.astype(np.int64))
    first = np.cumsum(n) - n
    rows = total - np.repeat(np.where(first > 0, total[first - 1], 0), n)
    each = np.repeat(count, n)
    links = links.astype(np.int64)
    sums, best = np.zeros(int(rows.max()) + 1, np.int64), np.zeros(int(rows.max()) + 1, np.int64)
    np.add.at(sums, rows, links * (each >> 1))
    np.add.at(best, rows, links * (each & 1))
    return sums, best


# ---------------------------------------------------------------- jobs


def tokenizers(byte_path: str, piece_path: str, pattern: str) -> tuple[str, str, bytes]:
    """The files' contents, to travel with the tasks: both have a fixed size."""
    with open(byte_path, encoding="utf-8") as f, open(piece_path, "rb") as g:
        return f.read(), pattern, g.read()


def spilled(docs: DataFrame, files: tuple[str, str, bytes], keep: list[str], text_col: str) -> DataFrame:
    """Rows of documents (radix null) and runs of their records, written to the shared folder."""
    shared = docs.sparkSession.sparkContext.broadcast(files)
    rows = docs.select(F.struct(F.lit(0).alias("c"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]).alias("row"), F.col(text_col).cast("string").alias("text"))
    added = [("block", T.LongType()), ("n", T.LongType()), ("radix", T.IntegerType()), ("heads", T.ArrayType(T.BinaryType())), ("body", T.BinaryType())]
    measured = ["n_a", "n_b", "n_groups", "n_links"]
    added += [(c, T.LongType()) for c in measured] + [("groups_sha256", T.StringType())]
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), *[T.StructField(n, t) for n, t in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(*shared.value)
        names = [n for n, _ in added]
        block, row, links, records = TaskContext.get().partitionId() << 32, 0, 0, []

        def flushed() -> Iterator[pa.RecordBatch]:
            for radix, n, heads, body in runs_of(records, sides) if records else ():
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, kind), pa.array([block]), pa.array([n]), pa.array([radix], pa.int32()), pa.array([heads], pa.list_(pa.binary())),
                     pa.array([body], pa.binary()), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string())],
                    ["row", *names],
                )

        for batch in batches:
            kind = batch.column(0).type
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for x, y in blocks(texts, BLOCK_CHARS):
                if records and links >= HELD_LINKS or row + y - x > HELD_ROWS:
                    yield from flushed()
                    block, row, links, records = block + 1, 0, 0, []
                found = Aligned(sides, texts[x:y])
                digest = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found.groups()]
                m = y - x
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(x, m), pa.array([block] * m), pa.array(np.arange(row, row + m)), pa.nulls(m, pa.int32()),
                     pa.nulls(m, pa.list_(pa.binary())), pa.nulls(m, pa.binary()), *[pa.array(getattr(found, c)) for c in measured], pa.array(digest, pa.string())],
                    ["row", *names],
                )
                if len(found.link_row):
                    records.append(found.records(row))
                row, links = row + m, links + len(found.link_row)
        yield from flushed()

    return written(in_batches(rows, run, schema), "alignment-runs")


def counted(runs: DataFrame, files: tuple[str, str, bytes]) -> DataFrame:
    """Merged heads: radix and its frames of pairs with twice their count, plus one for the best of a B id."""
    shared = runs.sparkSession.sparkContext.broadcast(files)

    def merge(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[bytes]]] = {}
        for batch in batches:
            for radix, heads in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(radix, []).append(heads)
        for radix in sorted(held):
            parts = merged(held.pop(radix))
            out = [f for k, v in (with_best(parts, _sides(*shared.value).n_a) if last else parts) for f in frames(k, v)]
            yield pa.RecordBatch.from_arrays([pa.array([radix], pa.int32()), pa.array([out], pa.list_(pa.binary()))], ["radix", "heads"])

    schema = "radix int, heads array<binary>"
    once = in_batches(runs.select("radix", "heads"), lambda b: merge(b, False), schema)
    return written(in_batches(once.repartitionById(RADIX, "radix"), lambda b: merge(b, True), schema), "alignment-counts")


def pair_counts(docs: DataFrame, byte_path: str, piece_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """All linked pairs of the corpus: a_id, b_id, links, best (no pair of the B id has more). Texts as in ``align``."""
    files = tokenizers(byte_path, piece_path, pattern)
    totals = counted(spilled(docs, files, [], text_col).where("radix is not null"), files)
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(*shared.value)
        for batch in batches:
            for heads in batch.column(0).to_pylist():
                for k, v in map(frame, heads):
                    a, b = sides.unpack(k)
                    v = v.astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(v >> 1), pa.array((v & 1).astype(bool))], ["a_id", "b_id", "links", "best"])

    return in_batches(totals.select("heads"), run, "a_id long, b_id long, links long, best boolean")


def align(docs: DataFrame, byte_path: str, piece_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and ``RESULTS`` for every row of ``docs``.

    A cuts a blank + the text by the byte-level vocabulary ``byte_path`` (tokenizers JSON) after splitting
    it by ``pattern``, B cuts the text by the piece model ``piece_path``, which adds the blank itself.
    Strings of special tokens inside texts are plain text. n_a and n_b count tokens, n_groups groups,
    n_links links, n_best links whose pair counts as much as any of their B id, ties included; count_sum
    adds the corpus counts of the pairs of all links. groups_sha256 hashes the groups as ``a1,a2|b1;a3|b2``.

    A text that is null or empty, or whose tokens of either side do not spell a blank + the text, has no
    tokens: zeros and an empty string; it adds nothing to the counts. Texts are never cut; rows are told
    apart by place, so repeated rows and ids and null ids each count and are returned as often as they
    stand there. Columns of ``keep`` named like a result are left out; other columns are not read. An
    empty table gives an empty table.
    """
    files = tokenizers(byte_path, piece_path, pattern)
    keep = [c for c in keep if c.lower() not in RESULTS]
    every = spilled(docs, files, keep, text_col)
    runs = every.where("radix is not null").select("radix", "block", "n", "heads", "body")
    totals = counted(runs, files)

    # At most RADIX rows.
    slots = runs.groupBy("radix").agg(F.ceil(F.sum("n") / SLOT_RECORDS).cast("int").alias("slots"))
    dealt = runs.join(F.broadcast(slots), "radix").withColumn("slot", F.expr("pmod(xxhash64(block), slots)")).drop("slots", "n")
    totals = totals.join(F.broadcast(slots), "radix").withColumn("slot", F.explode(F.expr("sequence(0L, slots - 1L)"))).drop("slots")

    def back(left: pa.Table, right: pa.Table) -> pa.Table:
        blocks_, out = [], []
        if left.num_rows:
            parts = [frame(f) for heads in right.column("heads").to_pylist() for f in heads]
            keys, counts = (np.concatenate(x) for x in zip(*parts))
            for batch in left.select(["block", "heads", "body"]).to_batches(max_chunksize=1):
                block, heads, body = (c[0].as_py() for c in batch.columns)
                sums, best = by_row(heads, body, keys, counts)
                blocks_.append(block)
                out.append(several([sums, best]))
        return pa.table({"block": pa.array(blocks_, pa.int64()), "sums": pa.array(out, pa.binary())})

    sums = dealt.groupBy("radix", "slot").cogroup(totals.groupBy("radix", "slot")).applyInArrow(back, "block long, sums binary")

    rows = every.where("radix is null").drop("radix", "heads", "body")
    out_schema = T.StructType([f for f in rows.schema.fields if f.name not in ("block", "n")] + [T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        at = left.column("n").to_numpy()
        total = np.zeros((2, int(at.max(initial=-1)) + 1), dtype=np.int64)
        for packed in right.column("sums").to_pylist():
            sums, best = severed(packed, 2)
            total[0, : len(sums)] += sums.astype(np.int64)
            total[1, : len(best)] += best.astype(np.int64)
        left = left.drop_columns(["block", "n"])
        return left.append_column("n_best", pa.array(total[1, at])).append_column("count_sum", pa.array(total[0, at]))

    met = rows.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(meet, out_schema)
    return met.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(keep)], *RESULTS)
