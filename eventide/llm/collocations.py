"""Phrase collocations by stripes: each prefix keys a counter of the words that come next.

Level n counts prefixes of n - 1 words. A task numbers the words of the texts it has read and makes,
for every prefix, one stripe: next words and how often they came. Stripes are dealt by prefix and
merged elementwise where they land. The merged stripes hold everything that is asked later: an entry
is the count of prefix + next and so the total of the prefix that goes on one level below, the empty
prefix has the number of all words, and the largest entry of the stripes that share all but the first
or the last word decides whether a phrase is part of a longer one.

A phrase of n words counts only if both of its parts of n - 1 words reach the threshold, so from the
second level on a task drops other words from its stripes. It asks a Bloom filter of fixed size built
from the level before (``bits``); what gets through by mistake fails the threshold after the merge.

Prefixes that hold a part of 1 / HOT of all words are at most HOT; the words after them, and those after the
empty prefix, are dealt over SEGMENTS by their hash. Tasks add up their own occurrences before anything is sent.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventide.llm import bits
from eventide.llm.common import as_bytes, in_batches, written

HELD_WORDS = 3_000_000  # occurrences that a task counts together before it hands stripes on
HOT, SEGMENTS = 4096, 64
END = "."  # stands for the end of a piece; no word holds one

# A-Z become a-z, the marks that end a piece become line ends, tabs become blanks.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


def words_of(texts: list[bytes]) -> pa.Array:
    """The words of texts in order, with ``END`` around their pieces."""
    joined = b"\n".join([b"", *texts, b""]).translate(PLAIN).replace(b"\n", b" . ")
    words = pc.ascii_split_whitespace(pa.array([joined], pa.large_binary()).cast(pa.large_string())).flatten()
    return words.filter(pc.not_equal(words, "")).cast(pa.string())


def phrase_hashes(lang: pa.Array, phrase: pa.Array) -> np.ndarray:
    """Hashes of whole phrases, as ``Block`` makes them word by word."""
    seeds = {code: bits.word_hashes([code.encode()])[0] for code in lang.unique().to_pylist()}
    h = np.fromiter(map(seeds.__getitem__, lang.to_pylist()), dtype=np.uint64, count=len(lang))
    parts = [p.split(b" ") for p in as_bytes(phrase)]
    for k in range(max(map(len, parts), default=0)):
        at = np.flatnonzero([len(p) > k for p in parts])
        h[at] = bits.longer(h[at], bits.word_hashes([parts[i][k] for i in at]))
    return h


class Block:
    """The words of one language in a block, and which of their phrases may count."""

    def __init__(self, lang: str, codes: np.ndarray, hashes: np.ndarray, filters: list[bytes]):
        self.codes = codes
        self.grams = codes  # numbers of the phrases that begin at each place
        self.valid = codes > 0
        if not filters:
            return
        h = bits.longer(bits.word_hashes([lang.encode()]), hashes)
        fits = bits.holds(filters[0], h)
        fits[0] = False
        self.valid = fits[codes]
        h = h[codes] if len(filters) > 1 else h
        for k, known in enumerate(filters[1:], start=1):
            # A phrase of k + 1 words: the phrase of k words here, that at the next place, and its own filter.
            at = np.flatnonzero(self.valid[:-1] & self.valid[1:])
            h[at] = bits.longer(h[at], hashes[codes[at + k]])
            keys, first, back = distinct(self.grams[at] << 32 | codes[at + k])
            fits = bits.holds(known, h[at[first]])
            self.grams, self.valid = np.zeros(len(codes), dtype=np.int64), np.zeros(len(codes), dtype=bool)
            self.grams[at] = back
            self.valid[at] = fits[back]

    def stripes(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where a prefix of n - 1 words begins, its number, the next word's code, and the count."""
        if n == 1:
            count = np.bincount(self.codes)
            count[0] = 0
            following = np.flatnonzero(count)
            return np.zeros(len(following), np.int64), np.zeros(len(following), np.int64), following, count[following]
        at = np.flatnonzero(self.valid[:-1] & self.valid[1:])
        keys = self.grams[at] << 32 | self.codes[at + n - 1]
        order = np.argsort(keys)
        keys = keys[order]
        cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return at[order[cuts]], keys[cuts] >> 32, keys[cuts] & 0xFFFFFFFF, np.diff(np.append(cuts, len(keys)))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each, and the number of every key among them."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    back = np.empty(len(keys), dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    return keys[new], order[new], back


def level(docs: DataFrame, n: int, filters: list[bytes], hot: set[tuple[str, str]], text_col: str, lang_col: str) -> DataFrame:
    """Merged stripes of prefixes of n - 1 words: lang, prefix, seg, next, count."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((filters, hot))  # filters of a fixed size, at most HOT prefixes

    def emit(held: dict[str, list[pa.Array]]) -> Iterator[pa.RecordBatch]:
        known, busy = shared.value
        # One numbering for the block; END is 0.
        numbered = pa.concat_arrays([pa.array([END]), *(p for parts in held.values() for p in parts)]).dictionary_encode()
        names, codes = numbered.dictionary, numbered.indices.to_numpy()[1:].astype(np.int64)
        hashes = bits.word_hashes(as_bytes(names))
        for lang, parts in held.items():
            own, codes = np.split(codes, [sum(map(len, parts))])
            block = Block(lang, own, hashes, known)
            begin, prefix, following, count = block.stripes(n)
            if not len(begin):
                continue
            change = np.append(True, prefix[1:] != prefix[:-1])
            number = np.cumsum(change) - 1
            start = begin[change]
            columns = [names.take(pa.array(block.codes[start + k])) for k in range(n - 1)]
            said = pc.binary_join_element_wise(*columns, " ") if columns else pa.array([""] * len(start), pa.string())
            large = pa.array([p for code, p in busy if code == lang], pa.string())
            split = pc.is_in(said, large).to_numpy(zero_copy_only=False) if columns else np.ones(1, dtype=bool)
            cut = split[number]
            seg = np.where(cut, (hashes[following] % np.uint64(SEGMENTS)).astype(np.int64), 0)
            if cut.any():
                order = np.lexsort((seg, number))
                number, seg, following, count = number[order], seg[order], following[order], count[order]
            cuts = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (seg[1:] != seg[:-1])))
            offsets = pa.array(np.append(cuts, len(number)).astype(np.int32))
            once = np.maximum.reduceat(count, cuts) == 1
            counts = pa.ListArray.from_arrays(offsets, pa.array(count).cast(pa.string()))
            out = pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(cuts), pa.string()), said.take(pa.array(number[cuts])), pa.array(seg[cuts].astype(np.int32)),
                 pc.binary_join(pa.ListArray.from_arrays(offsets, names.take(pa.array(following))), " "),
                 pc.if_else(pa.array(once), None, pc.binary_join(counts, " "))],
                ["lang", "prefix", "seg", "words", "counts"],
            )
            for a in range(0, out.num_rows, 20_000):
                yield out.slice(a, 20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = defaultdict(list), 0
        for batch in batches:
            texts = defaultdict(list)
            for lang, text in zip(batch.column(1).to_pylist(), as_bytes(batch.column(0))):
                texts["und" if lang is None else lang].append(text or b"")
            for lang, some in texts.items():
                words = words_of(some)
                held[lang].append(words)
                size += len(words)
            if size >= HELD_WORDS:
                yield from emit(held)
                held, size = defaultdict(list), 0
        if size:
            yield from emit(held)

    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    found = in_batches(texts, run, "lang string, prefix string, seg int, words string, counts string")
    place = ["lang", "prefix", "seg"]
    # A stripe travels as two short texts, words and counts (null: each once); the sums keep the dealing by stripe.
    found = found.repartition(*place).withColumn("words", F.split("words", " ")).withColumn("counts", F.split("counts", " "))
    found = found.select(*place, "counts", F.posexplode("words").alias("i", "next"))
    count = F.coalesce(F.get("counts", F.col("i")).cast("long"), F.lit(1))
    return found.select(*place, "next", count.alias("count")).groupBy(*place, "next").agg(F.sum("count").alias("count"))


def merged_levels(docs: DataFrame, min_count: int, longest: int, text_col: str, lang_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """Words of each lang, and by length of phrases rows (lang, prefix, next, count) that reach ``min_count``."""
    filters: list[bytes] = []
    hot: set[tuple[str, str]] = set()  # the empty prefix is always cut
    levels = []
    for n in range(1, longest + 1):
        found = level(docs, n, list(filters), hot, text_col, lang_col)
        if n == 1:
            # The empty prefix keeps its total: rarer words stay as the rest of each segment.
            found = found.withColumn("next", F.when(F.col("count") >= min_count, F.col("next")))
            found = found.groupBy("lang", "prefix", "seg", "next").agg(F.sum("count").alias("count"))
        else:
            found = found.where(F.col("count") >= min_count)
        found = written(found.drop("seg"), f"stripes-{n}")
        if n == 1:
            size = found.groupBy("lang").agg(F.sum("count").alias("n"))
            words = found.agg(F.sum("count")).first()[0] or 0
            found = found.where("next is not null")
        levels.append(found)
        if n < longest:
            named = found.select("lang", F.concat_ws(" ", F.expr("nullif(prefix, '')"), "next").alias("phrase"), "count")
            filters.append(bits.build(named.select("lang", "phrase"), lambda b: phrase_hashes(b.column(0), b.column(1))))
            hot = {(r["lang"], r["phrase"]) for r in named.where(F.col("count") * HOT >= F.lit(words)).select("lang", "phrase").collect()}
    return size, levels


def collocations(
    docs: DataFrame, min_count: int = 30, percent: int = 80, longest: int = 4, top: int | None = 2000, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Phrases of 2 to ``longest`` words by lang: lang, rank, phrase, a, l, r, n, score.

    Texts get lower-case A-Z and are split at ``. , ; : ! ?`` and line ends into pieces, those at blanks
    and tabs into words. n counts all words of the lang and a the occurrences of the phrase inside
    pieces, overlaps included. Candidates occur ``min_count`` times. A cut after the first k words has
    l and r, the counts of its parts, and the score floor(2000000 a / (l + r)); the lowest counts, of equal
    ones the one with the smallest k. A candidate that lies inside a longer phrase with
    100 f(longer) >= percent a is dropped (f of a longer phrase never passes that of the phrase with one
    word more, so those suffice). The first ``top`` of each lang by score, a and phrase are returned; None
    returns all. Products are decimals of 38 digits.

    Null texts are empty and a null lang is ``und``. Rows count as often as they stand there, whatever
    their ids are; other columns are not read, so their names do not matter. An empty table, and one
    whose texts have no words, gives no rows.
    """
    size, levels = merged_levels(docs, min_count, longest, text_col, lang_col)
    found = None
    for m, x in enumerate(levels, start=1):
        # The prefix of a word is empty, and a word holds no blank.
        words = F.split(F.concat_ws(" ", "prefix", "next"), " ") if m > 1 else F.array("next")
        rows = x.select("lang", words.alias("words"), F.col("count").alias("a"), F.lit(m).alias("m"))
        found = rows if found is None else found.unionByName(rows)
    found = found.withColumn("phrase", F.array_join("words", " "))

    parts = found.where(F.col("m") < longest).select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    found = found.where("m > 1")

    around = found.where("m > 2").select("lang", F.explode(F.array(F.expr("slice(words, 1, m - 1)"), F.expr("slice(words, 2, m - 1)"))).alias("w"), "a")
    around = around.groupBy("lang", F.array_join("w", " ").alias("phrase")).agg(F.max("a").alias("longer"))

    cuts = found.select("lang", "phrase", "a", "words", "m", F.explode(F.expr("sequence(1, m - 1)")).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("first"), F.expr("array_join(slice(words, k + 1, m - k), ' ')").alias("rest")
    )
    left = parts.select("lang", F.col("part").alias("first"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr("cast(2000000 as decimal(8,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    # Score and k in one number: its least is the cut that counts.
    scored = scored.withColumn("cut", score * 64 + F.col("k"))
    scored = scored.groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min("cut").alias("cut"), F.min_by("l", "cut").alias("l"), F.min_by("r", "cut").alias("r")
    )
    inside = F.expr(f"cast(100 as decimal(5,0)) * cast(longer as decimal(19,0)) >= cast({int(percent)} as decimal(5,0)) * cast(a as decimal(19,0))")
    kept = scored.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~inside)
    out = kept.join(size, "lang").withColumn("score", F.expr("cut div 64"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    out = out.withColumn("rank", F.row_number().over(best))
    if top is not None:
        out = out.where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
