"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventide.llm import collocations


def plain(rows, min_count, percent, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= min_count:
            cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
            found[lang, p] = (a, *min(cuts))
    out = []
    for lang in n:
        kept = []
        for (code, p), (a, score, k) in found.items():
            inside = any(c == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * x[0] >= percent * a for (c, q), x in found.items())
            if code == lang and not inside:
                kept.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top], start=1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def texts(seed, n=120):
    r = random.Random(seed)
    words = ["de", "La", "x", "é", "ÉTÉ", "new", "york", "city", "a b", "1", "-"]
    out = []
    for _ in range(n):
        said = []
        while len(said) < r.randrange(60):
            said += r.choice([["new", "York", "city", "hall"], ["x", "x", "x", "x", "x"], [r.choice(words)], [r.choice(words)], [r.choice(words) + r.choice(".,;:!?\n\r\x0b\x0c")]])
        out.append((r.choice(["en", "en", "en", "fr", None, "und", "İ"]), r.choice([" ", "  ", "\t"]).join(said)))
    return [*out, ("en", None), ("xx", ""), (None, "..."), ("en", "\x00 \x1f " * 20), ("fr", "long " * 20_000)]


def rows_of(df, **how):
    return sorted(tuple(r) for r in collocations.collocations(df, **how).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_plain_count(spark, seed):
    rows = texts(seed)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    expected = plain(rows, 4, 80, 25)
    assert rows_of(df, min_count=4, top=25) == expected
    assert len(expected) > 30


def test_blocks_segments_and_a_full_filter_change_nothing(spark, monkeypatch):
    rows = texts(3, 80)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    expected = plain(rows, 3, 50, 1000)
    monkeypatch.setattr(collocations, "HELD_WORDS", 50)
    monkeypatch.setattr(collocations, "HOT", 10)
    monkeypatch.setattr(collocations, "SEGMENTS", 3)
    assert rows_of(df, min_count=3, percent=50, top=1000) == expected
    monkeypatch.setattr(collocations.bits, "holds", lambda filled, h: h == h)
    assert rows_of(df, min_count=3, percent=50, top=None) == expected


def test_empty_ties_and_extra_columns(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert rows_of(empty) == []
    assert rows_of(spark.createDataFrame([("en", None), ("en", " . ")], "lang string, text string")) == []
    df = spark.createDataFrame([("en", "b c. a b. " * 30)], "lang string, text string")
    for name in ("seg", "next", "prefix", "count", "words", "rank", "a"):
        df = df.withColumn(name, F.lit(1))
    # Equal scores and counts: in order of the phrase.
    assert rows_of(df) == [("en", 1, "a b", 30, 30, 60, 120, 666666), ("en", 2, "b c", 30, 60, 30, 120, 666666)]
