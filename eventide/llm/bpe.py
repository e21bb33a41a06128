"""BPE encoding and decoding with a pair occurrence index.

A task gathers the distinct words of a block of texts and lays their symbols out in one array.
An index maps every adjacent pair that has a merge rank to all its positions in the block. The
active ranks are applied in ascending order: a merge rewrites all positions of its pair at once
and files the pairs it creates under their own ranks. Texts are then looked up word by word, so
the work of merging follows the vocabulary of a block, not its length.

The vocabulary file is a parameter and must be readable where the tasks run (it is small; its
content is read once on the driver and travels with the function).
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from eventide.llm.common import fresh, in_batches, with_column

RESULTS = ("ids", "decoded")
BLOCK_CHARS = 2_000_000  # texts whose new words are merged together
CACHE_WORDS = 300_000  # remembered words of a task; beyond that it starts anew

# White space as the normaliser of the vocabulary understands it (the Unicode property).
SPACE = regex.compile(r"[\t-\r\x20\x85\xa0  -     　]+")
# Control separators that str.split() takes for white space and the property does not.
ODD = regex.compile(r"[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in stand:
            stand[b] = chr(extra)
            extra += 1
    return [stand[b] for b in range(256)]


class Vocabulary:
    """Ids, merges and the pre-tokenizer of one vocabulary file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added = added
        self.tokens = [""] * (max([*vocab.values(), *added.values()]) + 1)
        for word, i in [*vocab.items(), *added.items()]:
            self.tokens[i] = word
        signs = byte_symbols()
        self.inner = np.array([vocab[c] for c in signs], dtype=np.int32)
        self.final = np.array([vocab[c + suffix] for c in signs], dtype=np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.left, self.right = left, right
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_rank = keys[order], order
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        self.special = sorted(added, key=len, reverse=True)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it has none."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], -1)


class PairIndex:
    """Merge ranks to the positions where their pair stands."""

    def __init__(self) -> None:
        self.places: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []

    def add(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        known = ranks >= 0
        if not known.any():
            return
        ranks, positions = ranks[known], positions[known]
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, part in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts)):
            if rank not in self.places:
                self.places[rank] = []
                heapq.heappush(self.active, rank)
            self.places[rank].append(part)

    def pop(self) -> tuple[int, np.ndarray]:
        rank = heapq.heappop(self.active)
        return rank, np.unique(np.concatenate(self.places.pop(rank)))


def merge_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words in a row, and how many each word has. Words are not empty."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.frombuffer(b"".join(words), dtype=np.uint8)
    n = len(flat)
    ends = np.cumsum(lengths) - 1
    begins = ends - lengths + 1
    sym = np.append(v.inner[flat], -1)
    sym[ends] = v.final[flat[ends]]
    # Neighbours within the word; n stands for none.
    after = np.append(np.arange(1, n + 1), n)
    after[ends] = n
    before = np.append(np.arange(-1, n - 1), n)
    before[begins] = n
    index = PairIndex()
    at = np.flatnonzero(after[:n] < n)
    index.add(v.ranks(sym[at], sym[after[at]]), at)
    while index.active:
        rank, at = index.pop()
        a, b, new = v.left[rank], v.right[rank], v.merged[rank]
        nxt = after[at]
        at = at[(sym[at] == a) & (nxt < n) & (sym[nxt] == b)]
        if a == b and len(at) > 1:  # in a run of equal symbols the pairs overlap: the left one goes first
            keep, last = [], -1
            for p in at.tolist():
                if p != last:
                    keep.append(p)
                    last = after[p]
            at = np.array(keep, dtype=np.int64)
        if not len(at):
            continue
        gone = after[at]
        beyond = after[gone]
        sym[at] = new
        sym[gone] = -2
        after[at] = beyond
        before[beyond] = at
        right = at[beyond < n]
        index.add(v.ranks(sym[right], sym[after[right]]), right)
        left = before[at]
        left = left[left < n]
        index.add(v.ranks(sym[left], sym[after[left]]), left)
    live = sym[:n] >= 0
    return sym[:n][live], np.add.reduceat(live.astype(np.int64), begins)


def normalised(text: str) -> str:
    """NFC and lower case, character by character (no final sigma)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Codes(dict):
    """Numbers chunks in the order in which they are met; ``new`` holds those not yet merged."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n


class Encoder:
    """Words seen so far by code, with their ids and token texts in flat arrays."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.split = regex.compile(v.pattern)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, v.special)) + ")") if v.special else None
        self.forget()

    def forget(self) -> None:
        self.code = Codes()
        self.count = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)
        self.said: list[str] = []

    def chunks(self, text: str) -> list[str]:
        """White-space separated runs. Special tokens are cut out of the raw text first and stand for themselves."""
        if self.cut and "<" in text and self.cut.search(text):
            out = []
            for part in self.cut.split(text):
                # A plain text cannot hold a blank inside a chunk, so a leading blank marks a special token.
                out += [" " + part] if part in self.v.added else self.plain(part)
            return out
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        low = normalised(text)
        return [c for c in SPACE.split(low) if c] if ODD.search(low) else low.split()

    def learn(self) -> None:
        """Merge the words of new chunks together."""
        new, self.code.new = self.code.new, []
        if not new:
            return
        # A chunk of letters only is one word; the pattern decides on the others.
        find = self.split.findall
        pieces = [c if c.isalpha() else () if c[0] == " " else find(c) for c in new]
        words: dict[str, int] = {}
        for p in pieces:
            if type(p) is str:
                words.setdefault(p, len(words))
            else:
                for w in p:
                    words.setdefault(w, len(words))
        found = merge_words([w.encode() for w in words], self.v) if words else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        ids, ends = found[0].tolist(), np.cumsum(found[1]).tolist()
        tokens = self.v.tokens
        own = [ids[a:b] for a, b in zip([0, *ends], ends)]
        said = [" ".join([tokens[t] for t in x]) for x in own]
        flat: list[int] = []
        counts: list[int] = []
        for c, p in zip(new, pieces):
            before = len(flat)
            if type(p) is str:
                w = words[p]
                flat += own[w]
                self.said.append(said[w])
            elif c[0] == " ":
                flat.append(self.v.added[c[1:]])
                self.said.append(c[1:])
            else:
                at = [words[w] for w in p]
                for w in at:
                    flat += own[w]
                self.said.append(" ".join([said[w] for w in at]))
            counts.append(len(flat) - before)
        self.count = np.concatenate([self.count, np.array(counts, dtype=np.int64)])
        self.flat = np.concatenate([self.flat, np.array(flat, dtype=np.int32)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts in a row, how many each has, and the decoded texts."""
        if len(self.code) > CACHE_WORDS:
            self.forget()
        code = self.code.__getitem__
        coded = []
        for t in texts:
            chunks = self.chunks(t)
            coded.append(np.fromiter(map(code, chunks), dtype=np.int64, count=len(chunks)))
        self.learn()
        starts = np.concatenate([[0], np.cumsum(self.count)])
        said = self.said.__getitem__
        ids, sizes, decoded = [], [], []
        for codes in coded:
            n = self.count[codes]
            total = int(n.sum())
            at = np.repeat(starts[codes] - (np.cumsum(n) - n), n) + np.arange(total)
            ids.append(self.flat[at])
            sizes.append(total)
            decoded.append(" ".join(map(said, codes.tolist())))
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.array(sizes, dtype=np.int64), decoded


@lru_cache(maxsize=2)
def _encoder(content: str) -> Encoder:
    return Encoder(Vocabulary(json.loads(content)))


def blocks(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters; a longer text stands alone."""
    begin = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def bpe(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """Adds ``ids`` (array of int, without special tokens of its own) and ``decoded`` (string).

    ``vocabulary`` is the path of a tokenizers JSON file with a word-end BPE model. Ids are those
    of its ``encode(add_special_tokens=False)``; the strings of special tokens inside a text
    become their ids. ``decoded`` is ``decode(ids, skip_special_tokens=False)``: the file has no
    decoder, so its tokens joined by blanks.

    Null or empty text, and text of white space only, gives no ids and an empty string. Every
    row is treated alone, so repeated rows and ids, null ids and other columns do not matter;
    columns named ``ids`` or ``decoded`` are replaced. An empty table gives an empty table.
    """
    with open(vocabulary, encoding="utf-8") as f:
        content = f.read()
    docs = fresh(docs, *RESULTS)
    shared = docs.sparkSession.sparkContext.broadcast(content)  # a file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            for a, b in blocks(texts, BLOCK_CHARS):
                ids, sizes, decoded = encoder.encode(texts[a:b])
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                out = with_column(batch.slice(a, b - a), "ids", pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32())))
                yield with_column(out, "decoded", pa.array(decoded, pa.string()))

    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return in_batches(docs, run, T.StructType([*docs.schema.fields, *added]))
