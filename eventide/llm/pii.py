"""Personal data and the terms that reveal it, by information-theoretic sanitisation.

Protected entities are the values of e-mail addresses, IP addresses, payment cards and phone numbers.
The corpus says how strongly a term reveals one of them. Of an entity c and a term t that stands
within ``window`` words of it,

    pmi(c, t) = log2(p(t | c) / p(t))        ic(c) = -log2 p(c)

pmi / ic is the part of the entity's information that the term gives away. Terms that reach the
threshold are spans like the entities, wherever they stand, and ``sanitise`` generalises or removes them.

What goes with an entity is counted in distinct windows, so copies of a passage are one piece of
evidence, and a pair needs several. p(t) is the share of all documents that hold the term. The
documents whose windows hold it are a lower bound of them, which drops common words before the corpus
is searched. A Bloom filter of fixed size (``bits``) says which words of a text may be among the rest;
exact counts and joins decide.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.llm import bits
from eventide.llm.common import as_bytes, in_batches, with_column, written

KINDS = ("email", "ip", "card", "phone", "term")
TERM = KINDS.index("term")
KNOWN_WORDS = 500_000  # words that a task remembers the filter's answer for
SALTS = 16  # parts of a hot term's occurrences

# What follows the @ of an address; its local part is read backwards from there.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A failed start inside a run of digits fails at its other digits too, so runs are entered at their begin.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\W_]+(?:['’_-][^\W_]+)*")
DIGIT = re.compile(r"[0-9]")


@dataclass(frozen=True)
class Settings:
    """``window``: words to each side of an entity. ``evidence``: distinct windows that a pair needs.
    ``threshold``: the part of an entity's information that a term may not reach."""

    window: int = 8
    evidence: int = 3
    threshold: float = 0.9


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @, domain: the local part begins where the last match ended, or its run."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                done = domain.end()
                yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def entities(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) by start and kind: for each kind its leftmost matches that are valid."""
    found = []
    if "@" in text:
        found += [(a, 0, b, text[a:b].lower()) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
            if all(len(p) < 4 and int(p) < 256 for p in parts):
                found.append((m.start(), 1, m.end(), ".".join(parts)))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end(), digits))
        if "+" in text:
            for m in PHONE.finditer(text):
                digits = "".join(DIGIT.findall(m[0]))
                if 10 <= len(digits) <= 15:
                    found.append((m.start(), 3, m.end(), digits))
    return sorted(found)


def free_words(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, term) of the words that share nothing with an entity."""
    words = [(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(text)]
    if not taken:
        return words
    spans: list[list[int]] = []
    for a, _, b, _ in taken:
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    ends = [b for _, b in spans]
    out = []
    for w in words:
        i = bisect_left(ends, w[0] + 1)  # the first span that ends behind the word's begin
        if i == len(spans) or spans[i][0] >= w[1]:
            out.append(w)
    return out


def windows(text: str, window: int) -> Iterator[tuple[str, int, list[str]]]:
    """For every entity: kind and value, a hash of the words around it, and its distinct terms."""
    found = entities(text)
    if found:
        words = free_words(text, found)
        starts = [w[0] for w in words]
        for a, kind, b, value in found:
            i, j = bisect_left(starts, a), bisect_left(starts, b)
            left, right = [w[2] for w in words[max(0, i - window) : i]], [w[2] for w in words[j : j + window]]
            around = xxhash.xxh3_64_intdigest(" ".join([*left, "\n", *right]).encode())
            yield f"{KINDS[kind]}:{value}", around - (1 << 63), sorted({*left, *right})


def evidence(docs: DataFrame, text_col: str, window: int) -> DataFrame:
    """A row for every entity and window that it stands in: entity, place, terms. A null entity has all terms of a document's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                found = list(windows(text or "", window))
                if found:
                    rows += [*found, (None, None, sorted({t for *_, terms in found for t in terms}))]
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays(columns, ["entity", "place", "terms"])

    return written(in_batches(docs.select(F.col(text_col).cast("string").alias("text")), run, "entity string, place long, terms array<string>"), "pii-windows")


def term_hashes(batch: pa.RecordBatch) -> np.ndarray:
    return bits.word_hashes(as_bytes(batch.column(0)))


class Asked(dict):
    """Words to the term that they may be, or None."""

    def __init__(self, filled: bytes):
        super().__init__()
        self.filled = filled

    def learn(self, words: set[str]) -> None:
        """Asks for the words that are new."""
        new = [w for w in words if w not in self]
        if new:
            terms = [w.lower() for w in new]
            for w, t, fits in zip(new, terms, bits.holds(self.filled, bits.word_hashes([t.encode() for t in terms])).tolist()):
                self[w] = t if fits else None


def scanned(docs: DataFrame, filled: bytes, text_col: str) -> DataFrame:
    """Every row, numbered, with its entities and the words that may be revealing terms."""
    shared = docs.sparkSession.sparkContext.broadcast(filled)  # of a fixed size
    span = "array<struct<start: int, kind: int, end: int>>"
    rows = docs.select("row", F.col(text_col).alias("text"))
    added = T._parse_datatype_string(f"id long, base {span}, base_sha256 string, words array<struct<term: string, start: int, end: int>>")
    schema = T.StructType([rows.schema["row"], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, row = Asked(shared.value), TaskContext.get().partitionId() << 40
        for batch in batches:
            base, digest, words = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                found = entities(text)
                if len(asked) > KNOWN_WORDS:
                    asked.clear()
                said = set(WORD.findall(text))
                asked.learn(said)
                hits = [(t, a, b) for a, b, t in free_words(text, found) if asked.get(text[a:b])] if any(map(asked.get, said)) else []
                base.append([(a, k, b) for a, k, b, _ in found])
                digest.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in found).encode()).hexdigest())
                words.append(hits)
            n = batch.num_rows
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(row, row + n))], ["row", "id"])
            out = with_column(out, "base", structs(base, [("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
            out = with_column(out, "base_sha256", pa.array(digest, pa.string()))
            yield with_column(out, "words", structs(words, [("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            row += n

    return written(in_batches(rows, run, schema), "pii-scan")


def structs(rows: list[list[tuple]], fields: list[tuple[str, pa.DataType]]) -> pa.Array:
    return pa.array([[dict(zip([f for f, _ in fields], x)) for x in r] for r in rows], pa.list_(pa.struct(fields)))


def disclosing(pairs: DataFrame, common: DataFrame, documents: int, threshold: float) -> DataFrame:
    """The pairs (entity, term) whose term gives away too much of the entity, if ``common`` says how many documents hold a term."""
    ic = F.log2(F.lit(float(documents)) / F.col("n_entity"))
    pmi = F.log2(F.lit(float(documents)) * F.col("n_both") / (F.col("n_entity").cast("double") * F.col("n_term")))
    return pairs.join(common, "term").where((ic > 0) & (pmi >= ic * threshold)).select("entity", "term", "n_both", "n_entity")


def find(docs: DataFrame, settings: Settings = Settings(), keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep`` for every row, with ``base`` and ``terms`` (arrays of start, kind, end in code
    points, kinds numbered as in ``KINDS``), ``base_sha256``, and ``spans``, all of them by start and kind
    as ``kind:start:end``, joined by commas.

    Per kind the leftmost matches that do not overlap; those that fail (IP part above 255; card of other
    than 14 to 19 digits or failing Luhn; phone of other than 10 to 15 digits) are dropped and not
    tried again. Kinds may overlap each other. Terms never touch an entity. Ties at the threshold are
    revealing.

    A null text is empty and has no spans. Whole texts are searched. Rows are told apart by place, so
    repeated rows and ids and null ids do not matter; every row is a document. Names of ``keep`` that are
    results are left out, other columns are not read. An empty table gives an empty table.
    """
    keep = [c for c in keep if c.lower() not in ("base", "terms", "base_sha256", "spans")]
    rows = docs.select(F.struct(F.lit(0).alias("c"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]).alias("row"), F.col(text_col).cast("string").alias("text"))
    documents = rows.count()
    said = evidence(rows, "text", settings.window)
    named = said.where("entity is not null")
    seen = named.select("entity", "place").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    pairs = named.select("entity", "place", F.explode("terms").alias("term")).distinct().groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    pairs = pairs.where(F.col("n_both") >= settings.evidence).join(seen, "entity")
    least = said.where("entity is null").select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    pairs = written(disclosing(pairs, least, documents, settings.threshold), "pii-pairs")

    every = scanned(rows, bits.build(pairs.select("term"), term_hashes), "text")
    met = every.where(F.size("words") > 0).select("id", "words")
    common = met.select(F.explode(F.array_distinct("words.term")).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    terms = disclosing(pairs, common, documents, settings.threshold).select("term").distinct()
    terms = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = met.select("id", F.inline("words")).withColumn("salt", F.expr(f"cast(pmod(id, {SALTS}) as int)")).join(terms, ["term", "salt"])
    span = F.struct("start", F.lit(TERM).alias("kind"), "end")
    met = met.groupBy("id").agg(F.array_sort(F.collect_list(span)).alias("terms"))

    out = every.drop("words").join(met, "id", "left")
    none = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    out = out.withColumn("terms", F.coalesce("terms", none))
    names = F.array(*map(F.lit, KINDS))
    texted = F.transform(F.array_sort(F.concat("base", "terms")), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return out.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(keep)], "base", "terms", "base_sha256", F.array_join(texted, ",").alias("spans"))


def generalised(word: str) -> str:
    """What stands for a revealing term: its class, or nothing for a plain word."""
    if DIGIT.search(word):
        return "[NUMBER]" if word.isdecimal() else "[CODE]"
    return "[NAME]" if word[:1].isupper() else ""


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every run of overlapping spans replaced by the tag of its first."""
    out, done = [], 0
    for a, kind, b in sorted(spans):
        if a >= done:
            out += [text[done:a], generalised(text[a:b]) if kind == TERM else f"[{KINDS[kind].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, settings: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """``docs`` with entities and revealing terms replaced in its text. Other columns stay; edge cases as in ``find``; null stays null."""
    packed = docs.select(F.struct(*docs.columns).alias("packed"), F.col(text_col).alias("text"))
    found = find(packed, settings, ("packed", "text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            new = [t if t is None else replaced(t, [(s["start"], s["kind"], s["end"]) for s in x]) for t, x in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], ["packed", "text"])

    found = found.select("packed", F.col("text").cast("string"), F.concat("base", "terms").alias("spans"))
    out = in_batches(found, run, T.StructType([found.schema["packed"], T.StructField("text", T.StringType())]))
    return out.select(*[(F.col("text") if c == text_col else F.col("packed")[c]).alias(c) for c in docs.columns])
