"""Token alignment against a plain version that pairs byte ranges one by one."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventide.llm import token_align
from eventide.llm.queries import BYTE_VOCABULARY, PIECE_MODEL

FILES = (BYTE_VOCABULARY, PIECE_MODEL, public_tokenizers.PATTERN)
ODD = [
    None, "", " ", "a", "  two  blanks ", "<|endoftext|> and <s> </s> <unk>", "<0x41>", "▁ under ▁▁", "naïve é é 日本語 🙂 \x00\x01", "x" * 5000,
    " " * 3000, "\n\n\t a\r\n", "1234567 12,345.67", "tie tie tie", "tie tie tie", "ﬁ Ⅳ ½ ​ ﻿ z", "“quotes” — dash…", "\U0010ffff",
]


def plain(rows):
    """Contract columns of (doc_id, text) rows, links found by comparing ranges."""
    a_side = Tokenizer.from_file(BYTE_VOCABULARY)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    stand = {c: b for b, c in enumerate(token_align.byte_symbols())}
    done = []
    for doc_id, text in rows:
        raw = (" " + (text or "")).encode()
        a = [(i, bytes(stand[c] for c in a_side.id_to_token(i))) for i in a_side.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = []
        for i in b_side.encode(text or ""):
            p = b_side.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode()))
        if not text or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            done.append((doc_id, [], [], [], ""))
            continue
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        a, b = spans
        links, j0 = [], 0
        for i, s, e in a:
            while b[j0][2] <= s:
                j0 += 1
            j = j0
            while j < len(b) and b[j][1] < e:
                links.append((i, b[j][0]))
                j += 1
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, last = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for i, s, _ in a if last <= s < c) + "|" + ",".join(str(i) for i, s, _ in b if last <= s < c))
            last = c
        done.append((doc_id, a, b, links, ";".join(groups)))
    counts = Counter(x for *_, links, _ in done for x in links)
    best = Counter()
    for (_, b), c in counts.items():
        best[b] = max(best[b], c)
    out = []
    for doc_id, a, b, links, groups in done:
        out.append((doc_id, len(a), len(b), groups.count(";") + 1 if groups else 0, len(links), sum(counts[x] == best[x[1]] for x in links),
                    sum(counts[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    return out, counts, best


def rows_of(frame):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in frame.select(columns).collect()), key=repr)


@pytest.fixture(scope="module")
def texts(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    return [(i, t) for i, t in docs if len(t) < 3000] + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (7, "again"), (7, "again")]


def test_equals_ranges_paired_one_by_one(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    expected, counts, best = plain(texts)
    assert rows_of(token_align.align(df, *FILES)) == sorted(expected, key=repr)
    pairs = {(r["a_id"], r["b_id"]): (r["links"], r["best"]) for r in token_align.pair_counts(df, *FILES).collect()}
    assert pairs == {p: (c, c == best[p[1]]) for p, c in counts.items()}


def test_many_small_runs_frames_and_slots_change_nothing(spark, texts, monkeypatch):
    for name, value in {"HELD_LINKS": 500, "HELD_ROWS": 9, "FRAME": 7, "MERGE_ROWS": 20, "BLOCK_CHARS": 300}.items():
        monkeypatch.setattr(token_align, name, value)
    some = texts[:60] + texts[-25:]
    blocks = list(token_align.merged([token_align.frames(*x) for x in _runs()]))
    assert [int(k) for ks, _ in blocks for k in ks] == sorted({int(k) for ks, _ in _runs() for k in ks})
    assert sum(int(v) for _, vs in blocks for v in vs) == sum(int(v) for _, vs in _runs() for v in vs)
    monkeypatch.setattr(token_align, "SLOT_RECORDS", 40)
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
    assert rows_of(token_align.align(df, *FILES)) == sorted(plain(some)[0], key=repr)


def _runs():
    import numpy as np

    r = np.random.default_rng(5)
    out = []
    for n in (0, 1, 30, 200, 55):
        keys = np.unique(r.integers(0, 300, n).astype(np.uint64))
        out.append((keys, r.integers(1, 9, len(keys)).astype(np.uint64)))
    return out


def test_packed_numbers_come_back():
    import numpy as np

    for values in ([], [0], [2**40, 0, 255, 256], list(range(1000))):
        assert token_align.opened(token_align.squeezed(np.array(values, dtype=np.uint64))).tolist() == values


def test_empty_tables_clashing_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_align.align(empty, *FILES).collect() == []
    assert token_align.pair_counts(empty, *FILES).collect() == []
    df = spark.createDataFrame([(1, "one two", "p", 3), (2, None, None, None)], "doc_id long, text string, block string, n_a int")
    df = df.withColumn("radix", F.lit("r")).withColumn("row", F.lit(1)).withColumn("n", F.lit(2))
    out = token_align.align(df, *FILES, keep=("doc_id", "block", "n_a", "radix", "row", "n"))
    assert out.columns == ["doc_id", "block", "radix", "row", "n", *token_align.RESULTS]
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["block"] == "p" and got[1]["n_a"] > 0 and got[2]["n_a"] == 0 and got[2]["groups_sha256"] == ""
