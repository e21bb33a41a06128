"""Corpus operators against plain versions, with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import json
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from eventide.llm import ann, bpe, chain, chat, components, jaccard_join, line_dedup, mixing, pages, queries, span_dedup, topk
from tools.check_oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, n_lines string, _id string"


def docs(spark, rows):
    full = [(i, t, "en", s, len(t or ""), "x", "y", "z") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


def blank(spark):
    return docs(spark, [])


ODD = [
    (1, None, "a"), (2, "", None), (3, "one line only here\nAnother Line of text \n\nshort", "a"), (4, "  ONE line only here\t\nown words", "b"),
    (5, "one line only here\none line only here", None), (5, "one line only here\none line only here", None), (None, "one line only here", "a"), (7, " \n\t\n", "b"),
    (8, "w " * 30_000, "a"),
]


def test_sql_twins(spark):
    con, known = duck(FOLDER), queries.oracle_sql()
    for name, sql in known.items():
        df = queries.queries()[name](spark, FOLDER)
        cur = con.execute(sql)
        assert compare(df.columns, [tuple(r) for r in df.collect()], [d[0] for d in cur.description], cur.fetchall()) == "ok", name


# ---- lines

def plain_lines(rows):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                held[key(x)].add(i)
    gone = lambda i, x: i is not None and len(held[key(x)]) > 1 and min(held[key(x)]) != i
    return sorted((str(i), "\n".join(x for x in (t or "").split("\n") if not gone(i, x))) for i, t, _ in rows)


def test_line_dedup(spark):
    df = line_dedup.dedup_lines(docs(spark, ODD))
    assert sorted((str(r.doc_id), r.text) for r in df.collect()) == plain_lines(ODD)
    assert {"lang", "ids", "n_lines", "n_dropped"} <= set(df.columns)
    assert line_dedup.dedup_lines(blank(spark)).count() == 0
    few = line_dedup.dedup_lines(docs(spark, ODD), min_docs=4)
    assert few.agg(F.sum("n_dropped")).first()[0] == 0


def test_line_keys_keep_other_letters():
    assert line_dedup.line_key("\x0b ÀB \r".encode()) == "Àb".encode()
    assert line_dedup.long_enough("ééééééééé1".encode(), 10) and not line_dedup.long_enough("ééééééééé".encode(), 10)


# ---- spans

PASSAGE = "The first sentence of the passage has nine words. Then a second one follows it with a few more. And a third to end it all."


def test_span_dedup(spark):
    rows = [(3, f"Own start here. {PASSAGE} Own end of three.", "a"), (1, f"{PASSAGE} Something else entirely.", "a"), (2, None, "a"), (4, "", None),
            (9, f"x. {PASSAGE}\n{PASSAGE}", None), (None, PASSAGE, "a"), (6, "Short. Short.", "a"), (6, "Short. Short.", "a")]
    got = {str(r.doc_id): r for r in span_dedup.dedup_spans(docs(spark, rows)).collect()}
    assert got["1"].text == rows[1][1] and got["None"].text == PASSAGE
    assert got["3"].text == "Own start here. Own end of three." and got["3"].n_removed == 3
    assert got["9"].text == "x. " and got["2"].text == "" and got["4"].text == ""
    assert got["6"].text == "Short. Short."
    assert span_dedup.dedup_spans(blank(spark)).count() == 0


def test_sentences_join_to_the_text():
    for t in ("", "a", "A. B! C?\n\nD", "x.y z", "Say \"so.\" Then.\n", " lead. "):
        assert "".join(span_dedup.sentences(t)) == t


def test_span_query_equals_plain(spark):
    """Positions of spans by a dictionary over all texts."""
    src = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()
    first, gone = {}, collections.defaultdict(set)
    for i, t in src:
        for a, b, k in zip(*span_dedup.spans(span_dedup.sentences(t or ""), 2, 20)):
            if first.setdefault(k, (i, a)) != (i, a):
                gone[i].update(range(a, b))
    want = {}
    for i, t in src:
        kept = "".join(p for n, p in enumerate(span_dedup.sentences(t or "")) if n not in gone[i])
        want[i] = hashlib.sha256(kept.encode()).hexdigest()
    assert {r.doc_id: r.kept_sha256 for r in queries.op3_substring_dedup(spark, FOLDER).collect()} == want


def runs(text, n=50):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


BOUNDARY = re.compile(r"[.!?。！？…]+[\"'”’)\]]*\s+|\n\s*")
BITS_OF_TEXT = st.sampled_from(["a", "Bc", "İ", "日本", "🙂", ".", "!?", "…", "。", ")", "\"", "”", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u3000", "\xa0", "e.g. x", "\ud83d"])


@settings(max_examples=500, deadline=None)
@given(st.lists(BITS_OF_TEXT, max_size=25).map("".join))
def test_marks_equal_the_pattern(text):
    ends = [m.end() for m in BOUNDARY.finditer(text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    got, closed, words = span_dedup.marks(text)
    assert got.tolist() == ends and words.tolist() == [m.start() for m in re.finditer(r"\S+", text)]
    for a, b, c in zip([0, *ends], ends, closed.tolist()):
        own = text[a:b].split()
        assert c == (bool(own) and own[-1].rstrip("\"'”’)]").endswith(tuple(".!?。！？…")))


def test_span_hashes_follow_the_words():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 50, 400)
    h = span_dedup.word_hashes([f"w{w}" for w in words])
    ranges = np.array([(a, b) for a in range(0, 390, 3) for b in (a + 1, a + 2, a + 9)])
    got: dict = {}
    for (a, b), x in zip(ranges.tolist(), span_dedup.span_hashes(h, ranges).tolist()):
        assert got.setdefault(tuple(words[a:b]), tuple(x)) == tuple(x)
    assert len(set(got.values())) == len(got)


def test_hot_spans_and_ids_of_any_kind_give_the_same(spark, monkeypatch):
    rows = [(i, f"{PASSAGE} Own sentence number {i} stands here alone. {PASSAGE if i % 2 else ''}", "s") for i in range(-3, 40)]
    df = docs(spark, rows)
    want = sorted(map(repr, span_dedup.dedup_spans(df).collect()))
    monkeypatch.setattr(span_dedup, "HOT", 1)  # no hash is hot
    assert sorted(map(repr, span_dedup.dedup_spans(df).collect())) == want
    named = df.withColumn("doc_id", F.format_string("%03d", F.col("doc_id") + 3))
    texts = {r.doc_id: r.text for r in span_dedup.dedup_spans(named).collect()}
    assert texts == {f"{r.doc_id + 3:03d}": r.text for r in span_dedup.dedup_spans(df).collect()}


def test_no_run_of_fifty_words_stays_twice(spark):
    """A word-level search: of 50 words in a row that a smaller id holds, some go."""
    rng = random.Random(8)
    say = lambda n, low=10**6: [f"w{rng.randrange(low)}" for _ in range(n)]
    ended = lambda w, every: [x + "." if rng.random() < every else x for x in w]
    rows = []
    for i in range(0, 120, 2):
        passage = ended(say(rng.choice([50, 51, 60, 90, 300])), rng.choice([0, 0, 0.02, 0.06, 0.2]))
        around = [ended(say(rng.randrange(40)), rng.choice([0, 0.1])) for _ in range(4)]
        wrap = [x + rng.choice("   \n") for x in passage]
        rows += [(i, " ".join(around[0] + passage + around[1]), "a"), (i + 1, " ".join(around[2]) + " " + "".join(wrap).title() + " ".join(around[3]), "a")]
    whole = " ".join(say(60)) + "."
    rows += [(500, f"Before it. {whole} Behind it.", "a"), (501, f"Other words. {whole} More words.", "a"), (502, "own " + "same " * 400, "a"), (503, "same " * 400, "a")]
    assert sum(bool(runs(a[1]) & runs(b[1])) for a, b in zip(rows[::2], rows[1::2])) == len(rows) // 2
    got = {r.doc_id: r.text for r in span_dedup.dedup_spans(docs(spark, rows)).collect()}
    seen = set()
    for i, t, _ in rows:
        assert not runs(got[i]) & seen, (i, t)
        seen |= runs(t)
    assert all(got[i] == t for i, t, _ in rows[:120:2]) and got[501] == "Other words. More words."
    assert "same" in got[502]


def test_long_runs_leave_little():
    """Windows leave less than RUN - WINDOW + 1 words at either end of a long passage without sentences."""
    rng = random.Random(9)
    passage = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    one, two = (span_dedup.outline(" ".join(f"{s}{k}" for k in range(70)) + " " + " ".join(passage) + f" {s} " * 60) for s in "ab")
    known, gone = set(one[3]), set()
    for a, b, k in zip(*two[1:]):
        gone |= set(range(a, b)) if k in known else set()
    kept = "".join(p for i, p in enumerate(two[0]) if i not in gone).split()
    assert gone and len(set(kept) & set(passage)) <= 2 * (span_dedup.RUN - span_dedup.WINDOW)


# ---- toxicity

def test_chain_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(3)))
    out = chain.judge(d, labels.where("h > 0").drop("h")).join(labels.where("h = 0").select("doc_id", F.col("toxic").alias("real")), "doc_id")
    r = out.agg(F.sum(F.expr("int(rejected and real = 0)")), F.sum(F.expr("int(rejected and real = 1)")), F.sum("real"), F.count("*")).first()
    assert r[0] <= 0.02 * r[3] and r[1] >= 0.5 * r[2], r


def test_chain_edges(spark):
    rows = docs(spark, [(i, ("vile word here" if i % 3 == 0 else "calm word here") + f" w{i}", "a") for i in range(60)] + [(None, None, None), (61, "", "a")])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in chain.judge(rows, labels).collect()}
    assert len(got) == 62 and all(got[i].rejected == (i % 3 == 0) for i in range(60)) and not got[61].rejected
    assert got[3].p_toxic_junk < 0.1  # a category without any positive row
    none = chain.judge(rows, labels.limit(0)).collect()
    assert {round(r.p_toxic, 6) for r in none} == {0.5}
    assert chain.judge(blank(spark), labels).count() == 0


def dense_logistic(x, y, reg):
    """The ridge optimum by exact Newton steps; one class only gives its smoothed rate."""
    n, width = x.shape
    if y.sum() in (0, n):
        rate = (y.sum() + 0.5) / (n + 1)
        return np.append(np.zeros(width), np.log(rate / (1 - rate)))
    full, ridge, v = np.hstack([x, np.ones((n, 1))]), np.diag(np.append(np.full(width, reg * n), 0.0)), np.zeros(width + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ v))
        v = v - np.linalg.solve(full.T @ (full * (p * (1 - p))[:, None]) + ridge + 1e-12 * np.eye(width + 1), full.T @ (p - y) + ridge @ v)
    return v


def plain_chain(texts, marks, fold, folds, s):
    """Probabilities of every text: words by a 2 x 2 chi-square, then category after category with out-of-fold columns."""
    held = [{w for w in re.split(r"[\W\d_]+", t.lower()) if w} for t in texts]
    held = [ws | {w[:5] + "-" for w in ws if len(w) >= 6} for ws in held]

    def chi2(term, y):
        has = np.array([term in ws for ws in held])
        cells = [(a, b) for a in (0, 1) for b in (0, 1)]
        seen = {(a, b): float(((has == a) & (y == b)).sum()) for a, b in cells}
        hoped = {(a, b): (has == a).sum() * (y == b).sum() / len(y) for a, b in cells}
        return sum((seen[c] - hoped[c]) ** 2 / hoped[c] for c in cells) if all(hoped.values()) else 0.0

    known = [t for t in sorted(set().union(*held)) if sum(t in ws for ws in held) >= s.min_docs and max(chi2(t, y) for y in marks.T) >= s.min_chi2]
    x = np.array([[float(t in ws) for t in known] for ws in held])
    out_of_fold, final = np.zeros((len(texts), 0)), np.zeros((len(texts), 0))
    said = lambda v, e: 1 / (1 + np.exp(-(np.hstack([x, e]) @ v[:-1] + v[-1])))
    for y in marks.T:
        column, inputs = np.zeros(len(texts)), np.hstack([x, out_of_fold])
        for f in range(folds):
            column[fold == f] = said(dense_logistic(inputs[fold != f], y[fold != f], s.reg), out_of_fold)[fold == f]
        p = said(dense_logistic(inputs, y, s.reg), final)
        out_of_fold, final = np.column_stack([out_of_fold, column]), np.column_stack([final, p])
    return known, final


def test_chain_equals_a_plain_one(spark):
    """Chosen words, folds, chained columns and scores against dense algebra written apart."""
    rng = random.Random(11)
    neutral, vile = [f"neutral{chr(97 + k)}" for k in range(12)], ["scum", "vermin", "worthless", "filthier"]
    rows, marks = [], []
    for i in range(300):
        toxic, junk = rng.random() < 0.3, rng.random() < 0.4
        words = rng.choices(neutral, k=8) + (rng.choices(vile, k=1) if rng.random() < (0.8 if toxic else 0.1) else []) + (["click"] if rng.random() < (0.7 if junk else 0.2) else [])
        rows.append((i, " ".join(rng.sample(words, len(words))), "a"))
        marks.append((i, int(not junk), int(toxic)))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    s = chain.Settings(min_chi2=3.0, reg=1e-2)
    d = docs(spark, rows)
    got = {r.doc_id: r for r in chain.judge(d, labels, s=s).collect()}
    order = {r.doc_id: r.h for r in d.select("doc_id", F.xxhash64(F.lit("chain"), "doc_id").alias("h")).collect()}
    fold = np.array([(order[i] >> 8) % s.folds for i in range(300)])
    y = np.array([(t * (1 - q), t * q, t) for _, q, t in marks], dtype=float)
    known, want = plain_chain([t for _, t, _ in rows], y, fold, s.folds, s)
    model = chain.train_chain(chain.labelled_documents(d, labels, s), chain.CATEGORIES, "doc_id", "text", s)
    assert list(model.vocabulary) == known and {"scum", "click"} <= set(known)
    have = np.array([[got[i].p_toxic_junk, got[i].p_toxic_prose, got[i].p_toxic] for i in range(300)])
    assert np.abs(have - want).max() < 5e-3, np.abs(have - want).max()
    clear = np.abs(want[:, 2] - s.threshold) > 5e-3
    assert all(got[i].rejected == (want[i, 2] >= s.threshold) for i in range(300) if clear[i]) and clear.sum() > 250
    # Without the earlier columns the result would be another one.
    alone = plain_chain([t for _, t, _ in rows], y[:, 2:], fold, s.folds, s)[1]
    assert np.abs(alone[:, 0] - want[:, 2]).max() > 2e-2


def test_logistic_finds_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.random((200, 5)) < 0.4
    y = (rng.random(200) < 1 / (1 + np.exp(-(x @ np.array([2.0, -1, 0, 0, 1]) - 0.5)))).astype(float)
    flat, begin = np.nonzero(x)[1], np.concatenate([[0], np.cumsum(x.sum(axis=1))])
    extra, s = rng.random((200, 1)), chain.Settings(reg=1e-3)
    w, b = chain.logistic(flat, begin, extra, y, 5, s)
    full = np.concatenate([x, extra], axis=1)
    p = 1 / (1 + np.exp(-(full @ w + b)))
    assert np.abs(full.T @ (p - y) + 0.2 * w).max() < 1e-2 and abs((p - y).sum()) < 1e-2


# ---- BPE

def test_bpe_equals_library(spark):
    lib = Tokenizer.from_file(queries.VOCABULARY)
    rng = random.Random(3)
    letters = [chr(c) for c in (*range(1, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2070))]
    texts = ["", None, " \n\t", "aaaaaaaa aaa", "it's they're 123 4½²", "<|endoftext|>hi<|startoftext|> ok", "ΣΑΣ İstanbul", "a\x1cb\xa0c", "한국어 日本語 😀😀", "'''sss''t"]
    texts += ["".join(rng.choice(letters) for _ in range(200)) for _ in range(60)] + ["".join(rng.choice("abAB' .1") for _ in range(300)) for _ in range(60)]
    texts += ["long word " * 20_000]
    got = bpe.bpe(docs(spark, [(i, t, "a") for i, t in enumerate(texts)]), queries.VOCABULARY).collect()
    for r in got:
        want = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == lib.decode(want, skip_special_tokens=False), repr(texts[r.doc_id])[:80]
    assert bpe.bpe(blank(spark), queries.VOCABULARY).count() == 0


def test_bpe_blocks_and_forgetting(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    v = bpe.Vocabulary(json.load(open(queries.VOCABULARY)))
    e = bpe.Encoder(v)
    one = [e.encode([t])[0].tolist() for t in ("alpha beta gamma", "delta alpha", "beta epsilon", "alpha")]
    assert one == [bpe.Encoder(v).encode([t])[0].tolist() for t in ("alpha beta gamma", "delta alpha", "beta epsilon", "alpha")]
    assert list(bpe.blocks(["aa", "bbbb", "c", "d"], 3)) == [(0, 1), (1, 2), (2, 4)]


def test_bpe_query_digests(spark):
    lib = Tokenizer.from_file(queries.VOCABULARY)
    src = dict(duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall())
    for r in queries.op7_bpe(spark, FOLDER).collect():
        ids = lib.encode(src[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# ---- Jaccard join

def plain_components(rows):
    sets = []
    for i, t in rows:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if x]
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return sorted((str(i), len(x), None if i is None else find(i)) for i, x in sets)


def near_rows():
    rng = random.Random(5)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(rng.choice([3, 5, 40, 120, 1500]))] for _ in range(25)]
    shared = [f"s{k}" for k in range(30)]
    rows = []
    for w in base:
        for _ in range(rng.randrange(1, 6)):
            own = list(w)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            rows.append(" ".join(own + (shared if rng.random() < 0.3 else [])))
    rows += [rows[0], rows[1].upper(), None, "", " \t ", "one", "one", "One two", "a b c d e", "a b c d e f"]
    return [(i, t) for i, t in enumerate(rows)] + [(None, rows[0]), (3, rows[3])]


@pytest.mark.parametrize("chunk", [1_000_000, 60])
def test_jaccard_join(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard_join, "CHUNK_SHINGLES", chunk)  # small: blocks are cut into pairs of chunks
    rows = near_rows()
    got = jaccard_join.jaccard_components(docs(spark, [(i, t, "a") for i, t in rows])).collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == plain_components(rows)


def test_jaccard_join_edges(spark):
    assert jaccard_join.jaccard_components(blank(spark)).count() == 0
    rows = near_rows()
    kept = jaccard_join.keep_first_of_each(docs(spark, [(i, t, "a") for i, t in rows]))
    want = [i for i, _, c in plain_components(rows) if c is None or str(c) == i]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(want) and "lang" in kept.columns


@pytest.mark.parametrize("percent", [10, 50, 80, 100])
def test_chunk_pairs_hold_every_size_that_can_link(spark, monkeypatch, percent):
    monkeypatch.setattr(jaccard_join, "CHUNK_SHINGLES", 60)
    sizes = [*range(1, 60), 100, 190, 200, 1000, 1900]
    members = spark.createDataFrame([(i, n, 1) for i, n in enumerate(sizes)], "id long, n long, block long")
    tasks = collections.defaultdict(set)
    for r in jaccard_join.chunk_pairs(members, percent).collect():
        tasks[r.id].add(r.pair)
    lost = [(a, b) for i, a in enumerate(sizes) for j, b in enumerate(sizes) if a <= b and 100 * a >= percent * b and not tasks[i] & tasks[j]]
    assert not lost


def test_jaccard_join_at_half(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK_SHINGLES", 60)
    long = [f"w{i}" for i in range(194)]
    rows = [(1, " ".join(long[:104]), "a"), (2, " ".join(long), "a")]  # 100 of 190 shingles
    assert [r[2] for r in jaccard_join.jaccard_components(docs(spark, rows), percent=50).collect()] == [1, 1]


def test_many_near_copies_take_few_verifications():
    rng = np.random.default_rng(1)
    base = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    sets = [np.sort(np.concatenate([np.delete(base, rng.integers(0, 300, 8)), rng.integers(0, 2**63, 8).astype(np.uint64)])) for _ in range(400)]
    counts, asked = [jaccard_join.counts_of(jaccard_join.point(s), len(s)) for s in sets], []

    def confirm(i, j):
        asked.append((i, j))
        return jaccard_join.linked(sets[i], sets[j], 80)

    found = jaccard_join.spanning(counts, np.array([len(s) for s in sets]), 80, confirm)
    assert len(found) == 399 and len(asked) < 800


def links_of(sets, percent=80, decode=None):
    """Found links, the plain components and the number of bound checks."""
    decode = decode or (lambda s: jaccard_join.counts_of(jaccard_join.point(s), len(s)))
    sizes, points = np.array([len(s) for s in sets]), [decode(s) for s in sets]
    order, trees = jaccard_join.trees_of(points, sizes, percent)
    found = jaccard_join.spanning(points, sizes, percent, lambda i, j: jaccard_join.linked(sets[i], sets[j], percent), (order, trees))
    return found, sum(t.checks for t in trees)


def roots(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("size", [60, 600])
def test_the_tree_cuts_sets_without_links(size):
    rng = np.random.default_rng(2)
    n = 4000
    sets = [np.unique(rng.integers(0, 2**63, size).astype(np.uint64)) for _ in range(n)]
    found, checks = links_of(sets)
    assert not found and checks < n * (n - 1) // 2 // 10


@pytest.mark.parametrize("percent", [50, 80, 100])
@pytest.mark.parametrize("seed", range(4))
def test_the_tree_loses_no_link(percent, seed):
    """Sizes on both sides of the coarse points, copies of several depths, merged groups."""
    rng = np.random.default_rng(seed)
    sets = []
    for size in [1, 2, 7, 60, 300, 950, 1100, 2500]:
        base = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        for _ in range(12):
            keep = base[rng.random(len(base)) >= rng.choice([0, 0.02, 0.08, 0.12, 0.3])]
            new = rng.integers(0, 2**63, rng.integers(0, 2 + len(base) // 8)).astype(np.uint64)
            sets.append(np.unique(np.concatenate([keep, new])) if len(keep) + len(new) else base)
    sets = [sets[i] for i in rng.permutation(len(sets))]
    plain = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard_join.linked(sets[i], sets[j], percent)]
    whole = lambda s: jaccard_join.grouped((s >> np.uint64(40)).astype(np.int64) % jaccard_join.GROUPS)
    for decode in (None, whole):
        found, _ = links_of(sets, percent, decode)
        assert roots(len(sets), found) == roots(len(sets), plain)
    few = [whole(s) for s in sets[:60]]
    found = jaccard_join.spanning(few, np.array([len(s) for s in sets[:60]]), percent, lambda i, j: jaccard_join.linked(sets[i], sets[j], percent))
    assert roots(60, found) == roots(60, [(i, j) for i, j in plain if i < 60])


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (700, 600), (600, 700)], "u long, v long")
    got = dict(components.components(edges).collect())
    assert {got[i] for i in range(201)} == {0} and got[700] == 600 and got[600] == 600 and 500 not in got
    assert components.components(edges.limit(0)).count() == 0


# ---- mixing

def water_fill(sizes, weights):
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if level * weights[i] > 3 * sizes[i]}
        if not full:
            for i in open_:
                target[i] = level * weights[i]
            break
        for i in full:
            target[i] = 3.0 * sizes[i]
        left -= sum(target[i] for i in full)
        open_ -= full
    return target


def test_mixing(spark):
    rng = random.Random(2)
    many = [(i, "w " * rng.randrange(0, 4000), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    many += [(900, "tiny source", "Z"), (901, None, "empty"), (None, "no id here", "b"), (902, "same row", "a"), (902, "same row", "a")]
    df = docs(spark, many)
    rows, pieces = mixing.draws(df, mixing.word_count(F.col("text")), shard_words=20_000)
    words = pieces.groupBy("_src", "_start").agg(F.sum(F.col("to") - F.col("from")).alias("w"))
    got = rows.join(words, ["_src", "_start"], "left").selectExpr("source", "_size", "_total", "_target", "if(_size > 0, coalesce(w, 0), 0) as taken").collect()
    sizes = collections.Counter()
    for _, t, s in many:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, water_fill([sizes[s] for s in order], [1 + k % 3 for k in range(len(order))])))
    took = collections.Counter()
    for r in got:
        took[r.source] += r.taken
        assert r.taken <= 3 * r._size and r._total == sizes[r.source] and abs(r._target - want[r.source]) < 1e-6
    assert len(got) == len(many) and all(abs(took[s] - want[s]) <= 1 for s in order)
    shards = pieces.groupBy("shard").agg(F.sum(F.col("to") - F.col("from"))).collect()
    assert len(shards) > 5
    again = mixing.mixed_documents(df.repartition(7))
    assert again.columns == df.columns
    twice = [sorted((str(r.doc_id), r.text) for r in x.collect()) for x in (mixing.mixed_documents(df), again)]
    assert twice[0] == twice[1]
    assert sum(len(t.split()) for _, t in twice[0]) == sum(took.values())
    assert mixing.mixed_documents(blank(spark)).count() == 0


def test_mixed_columns_may_have_any_name(spark):
    rows = [(i, f"w{i} " * (i % 40), "ab"[i % 2]) for i in range(200)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clash = plain
    for name in ("shard", "_src", "_size", "_lo", "_hi", "_draw", "_part", "_pieces", "_row", "_text", "_doc", "c0", "draw"):
        clash = clash.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    out = mixing.mixed_documents(clash).collect()
    assert sorted((r.doc_id, r.text) for r in out) == sorted((r.doc_id, r.text) for r in mixing.mixed_documents(plain).collect())
    assert out and all(r[name] == f"{name}{r.doc_id}" for r in out for name in clash.columns[3:])


def test_split_quotas_are_exact():
    q = np.array([100, 3, 0, 57])
    leaves = [mixing.split_quotas(q, 7, i, 1) for i in range(7)]
    assert (sum(leaves) == q).all() and max(x.sum() for x in leaves) - min(x.sum() for x in leaves) <= 1


# ---- vectors

def vector_rows(n=700, d=16, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=d).astype(float).tolist(), i) for i in range(n)]
    rows += [(n + i, rows[5][1], 0) for i in range(60)] + [(2000, None, 0), (2050, [0.0] * d, 0), (2100, [float("nan")] * d, 0), (2150, [None] * d, 0), (None, rows[1][1], 0)]
    rows += [(40, rows[40][1], 0), (2200, [float("inf")] + [0.0] * (d - 1), 0)]
    return rows


def brute(rows, every, k, score, usable):
    seen = {(i, tuple(v)) for i, v, _ in rows if i is not None and usable(v)}
    out = {}
    for i, v in seen:
        if i % every == 0:
            best = sorted((-score(v, w), j) for j, w in seen if j != i)[:k]
            out[i] = [(j, -s) for s, j in best]
    return out


def whole(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def test_exact_top_k(spark):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score long")
    ints = [(i, [int(np.floor(256 * x)) for x in v] if whole(v) else None, 0) for i, v, _ in rows]
    want = brute(ints, 50, 5, lambda a, b: sum(x * y for x, y in zip(a, b)), lambda v: v is not None)
    got = collections.defaultdict(list)
    for r in sorted(topk.exact_top_k(df).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    assert dict(got) == want
    assert topk.exact_top_k(df.limit(0)).count() == 0
    assert topk.exact_top_k(df.where("vec_id in (50, 51)")).count() == 1


def test_products_beyond_64_bits_are_refused(spark):
    for big in (1e300, 4e15, 1e9):
        df = spark.createDataFrame([(50, [1.0, 1.0]), (51, [big, 0.0])], "vec_id long, embedding array<double>")
        with pytest.raises(ValueError, match="64-bit"):
            topk.exact_top_k(df)
    near = spark.createDataFrame([(50, [5e6, -5e6]), (51, [5e6, 5e6]), (52, [5e6, -5e6])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.exact_top_k(near).orderBy("rank").collect()] == [(52, 2 * 1_280_000_000**2), (51, 0)]


def test_norm_buckets_prune_and_stay_exact():
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(4000, 12)) * rng.gamma(2, 2, (4000, 1)) * 50).astype(np.int64)
    index = topk.NormBuckets(np.arange(4000), x)
    for q in range(0, 4000, 97):
        ids, scores = index.search(q, x[q], 5)
        s = x @ x[q]
        s[q] = -(2**60)
        want = np.lexsort((np.arange(4000), -s))[:5]
        assert ids.tolist() == want.tolist() and scores.tolist() == s[want].tolist()


def test_nearest_recall_and_edges(spark):
    rows = vector_rows(3000)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score long")
    want = brute(rows, 20, 20, lambda a, b: float((np.array(a) * np.array(b)).sum()), lambda v: whole(v) and any(v))
    got = collections.defaultdict(list)
    for r in sorted(ann.nearest(df).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    few = ann.nearest(df.where("vec_id < 12")).collect()
    assert sorted(r.vec_id for r in few if r.query_id == 0) == list(range(1, 12))
    assert ann.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("length", [3000.0, 1e20, 1e200])
def test_one_long_vector_leaves_the_neighbours_of_others(spark, length):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[7] *= length
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in ann.nearest(df, every=40).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 2000, 40):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.9 * 20 * 50, hits / 1000


def test_bands_hold_every_vector_once():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)) * 10.0 ** rng.integers(-300, 300, size=(300, 1))
    parts = list(ann.bands(x))
    assert sorted(np.concatenate([own for own, _ in parts]).tolist()) == list(range(300))
    for _, scaled in parts:
        n = np.linalg.norm(scaled, axis=1)
        assert n.max() <= 1 + 1e-9 and n.min() * 8 >= n.max() * (1 - 1e-9)


# ---- chat

def test_chat_round_trip(spark):
    odd = ["\\### Assistant: </turn> ok", "a </turn>\n### user: b", "\\e \\h\\t \\\\", "", None, "plain", "### ", "x: y\n", "\\", "end\\", " </turn>\n"]
    roles = ["user", "assistant", None, "we: ird", "a\nb", "### x", "assistant"]
    rows = [(c, k, roles[(c + k) % len(roles)], odd[(c * 3 + k) % len(odd)], 1) for c in range(20) for k in range(c % 6 + 1)]
    rows += [(3, 0, "user", "again", 1), (None, None, "assistant", "lost", 1), (50, None, None, None, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted long")
    out = chat.format_turns(df)
    back = {r.conv_id: r for r in chat.read_back(out).collect()}
    shown = {r.conv_id: r for r in out.collect()}
    want = collections.defaultdict(list)
    for c, k, r, t, _ in rows:
        want[c].append((k is not None, k or 0, r or "", t or ""))
    assert set(back) == set(want)
    for c, turns in want.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        assert [(x.role, x.text) for x in back[c].turns] == turns
        assert back[c].loss == [t for r, t in turns if r == "assistant"]
        assert back[c].formatted_chars == len(shown[c].formatted)
        for s, x in zip(shown[c].loss_spans, back[c].loss):
            raw = shown[c].formatted[s.start : s.start + s.length]
            assert raw == x or "\\" in raw
            assert "###" not in raw and "</turn>" not in raw
    assert chat.format_turns(df.limit(0)).count() == 0
    plan = queries.op4_chat_format(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- pages

PAGE = """<html><body><header><h2>Site name</h2></header><nav><ul><li><a href=x>Home</a><li><a href=y>More</a></ul></nav>
<div id="cookie-notice">We use cookies, many, many, many cookies on this site, please accept them all now.</div>
<aside class="sidebar"><p>Related stories, something long, long enough to be scored as a paragraph in the page.</p></aside>
<div class="content"><h1>Title &amp; more</h1><p>First paragraph, with a comma, and enough text to be scored as a real paragraph here.<p>Second &#8212; paragraph
  with <a href=z>a link</a> and   spaces.</p><ul><li>point one<li>point two</ul>
<form><p>Sign up, for the newsletter, right now please, it is free of charge.</p><input></form><script>var a="<p>x</p>";</script>
<p>Short end.</p></div><div class="comment-list"><p>Nice article, really, I enjoyed it a lot, thanks for writing all this up, great.</p></div>
<footer><p>Copyright</p></footer>"""
BODY = "Title & more|First paragraph, with a comma, and enough text to be scored as a real paragraph here.|Second — paragraph with a link and spaces.|point one|point two|Short end."


def test_main_text(spark):
    assert pages.main_text(PAGE) == BODY.replace("|", "\n\n")
    odd = {None: "", "": "", "hello": "hello", "<p>a": "a", "<!-- x": "", "<p title=\"a>b\">q</p>": "q", "<script>x": "", "<div><p>x</div></p>": "x", "a &lt; b": "a < b"}
    rows = [(i, "u", h, "t", 1) for i, h in enumerate(odd)]
    df = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string, text string, n_chars long")
    got = pages.extract(df).collect()
    assert [(r.text, r.n_chars) for r in sorted(got, key=lambda r: r.page_id) if r.page_id] == [(v, len(v)) for v in list(odd.values())[1:]]
    assert len(got) == len(rows) + 1 and pages.extract(df.limit(0)).count() == 0
    long = "<div>" * 3000 + "<p>" + "word, " * 50_000
    assert pages.main_text(long) == ("word, " * 50_000).strip()


@pytest.mark.parametrize("tag", ["<article>", "<main>", "<div>", "<div><div>"])
def test_sectioned_pages_stay_whole(tag):
    end = "".join(f"</{t}>" for t in reversed(tag.strip("<>").split("><")))
    part = "section" if tag in ("<article>", "<main>") else "div"
    long = [f"Paragraph {i}, with commas, and more commas, " + "and words that go on and on " * 9 + "to its end." for i in range(10)]
    last = "One paragraph of the last part, which is short but has a hundred and twenty characters or some more, as prose often has."
    page = (
        f"<html><body><nav><a href=x>Home</a></nav>{tag}<h1>Title</h1><{part}>{''.join(f'<p>{p}</p>' for p in long)}</{part}>"
        f"<{part}><h2>End</h2><p>{last}</p></{part}><{part} class='share'><p>Share this text, with friends, and all the others you know.</p></{part}>"
        f"<{part}><ul><li><a href=a>Another story of this site</a><li><a href=b>And yet another one</a></ul></{part}>{end}<footer><p>Copyright</p></footer>"
    )
    assert pages.main_text(page).split("\n\n") == ["Title", *long, "End", last]


def test_names_that_only_hold_a_word_of_furniture():
    text = "This is a paragraph of the article, with commas, and it is long enough to be read as one by anyone who looks at it."
    more = "Another paragraph stands here, also with commas, and also long enough, so that it counts as text in its own right."
    assert pages.main_text(f"<body><div class='post ad-free'><p>{text}</p></div></body>") == text
    assert pages.main_text(f"<article><p>{text}</p><section class='related-work'><p>{more}</p></section></article>") == f"{text}\n\n{more}"
    assert pages.main_text(f"<article><p class='skip-intro'>{more}</p><p>{text}</p></article>") == f"{more}\n\n{text}"
    listed = "<div class='col'><ul><li>the first point of a plain list</li><li>the second point of it</li></ul></div>"
    page = f"<body><div><div class='col'><p>{text}</p><p>{more}</p></div>{listed}</div></body>"
    assert pages.main_text(page).split("\n\n") == [text, more, "the first point of a plain list", "the second point of it"]
    inline = f"<article><p>{text} <button>Buy</button> <label for=x>Name <b>it</b></label>tail.</p><p>{more}</p></article>"
    assert pages.main_text(inline) == f"{text} tail.\n\n{more}"
    for name in ("ad", "ad-slot", "related-posts", "skip-link", "search-form", "share", "ads top"):
        assert pages.main_text(f"<article><p>{text}</p><div class='{name}'><p>{more}</p></div></article>") == text
    assert pages.main_text(f"<article><p>{text}<button>Buy</p><p>{more}</p></article>") == f"{text}\n\n{more}"


# ---- pipeline

def test_pipeline_stages(spark):
    d = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = d
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, kept, FOLDER)
        assert after.columns == d.columns, name
        kept = spark.createDataFrame(after.collect(), d.schema)
    assert 0 < kept.count() <= d.count()
    rows = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
    assert all(str(c) == i for i, _, c in plain_components(rows))
    mixed = corpus_pipeline.mix(spark, kept, FOLDER)
    assert mixed.columns == d.columns
    n = corpus_pipeline.encode(spark, mixed, FOLDER).agg(F.count("*"), F.sum("n_tokens")).first()
    assert n[0] == mixed.count() and n[1] > 0
    empty = d.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0


def test_pipeline_keeps_a_trace_of_decoding(spark):
    lib = Tokenizer.from_file(queries.VOCABULARY)
    texts = ["Plain words, then more.", "", "<|endoftext|>hi \u00e9\U0001f600", None]
    got = corpus_pipeline.encode(spark, docs(spark, [(i, t, "a") for i, t in enumerate(texts)]), FOLDER).collect()
    for r in got:
        want = lib.decode(r.ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(want.encode()).hexdigest() and r.n_tokens == len(r.ids)
    assert len(got) == len(texts)
