"""Personal data: the patterns as they are written, and the method, against plain versions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventide.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checksum(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_base(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(float(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and checksum(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


PARTS = st.sampled_from(["a", "Z9", "@", "@x", ".", "..", ".co", "@a-b.c", "1", "255", "256", "007", "1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "55500000000004",
                         "+", "+1 (555) 123-4567", " ", "-", "(", ")", "é", "İ", "\n", "%_+", "٣", "+44.20.7946.0958", "x@y.z@w.v"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert [(a, k, b) for a, k, b, _ in pii.entities(text)] == plain_base(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "a." * 100_000 + "@", "1" * 200_000, "1." * 100_000, "+1" + "(" * 100_000, "a@" * 100_000, "+" * 100_000):
        pii.entities(text)
    assert [k for _, k, *_ in pii.entities("9" * 100_000 + " 10.0.0.1")] == [1]


def plain_terms(texts, how):
    """Revealing terms, counted with sets."""
    windows, said = defaultdict(set), Counter()
    for text in texts:
        base = plain_base(text)
        words = [(m.start(), m.end(), m[0].lower()) for m in pii.WORD.finditer(text) if not any(a < m.end() and m.start() < b for a, _, b in base)]
        said.update({w for *_, w in words})
        for a, k, b, value in pii.entities(text):
            left = [w for _, e, w in words if e <= a][-how.window :]
            right = [w for s, _, w in words if s >= b][: how.window]
            windows[k, value].add((tuple(left), tuple(right)))
    n, found = len(texts), set()
    for places in windows.values():
        for w in {w for p in places for side in p for w in side}:
            both = sum(w in p[0] or w in p[1] for p in places)
            if both >= how.evidence and len(places) < n:
                part = math.log2(n * both / (len(places) * said[w])) / math.log2(n / len(places))
                if part >= how.threshold:
                    found.add(w)
    return found


def corpus():
    """An address that a nickname and a project go with, among other texts; copies of one passage that prove nothing."""
    texts = [f"filler{i} thanks to mail sent today by a team of common things {i % 7} and the weather of day{i}" for i in range(60)]
    texts += [f"note{i} by Blackbird of team X77-Q to mail jo.doe@example.org today word{i} thanks" for i in range(5)]
    texts += ["seen again: Blackbird walks alone", "X77-Q is done, they say"]
    texts += ["unique zebra copy sent to ann@example.org now"] * 9
    texts += ["", "call +1 (555) 010-9999 or 10.0.0.1", "card 4111 1111 1111 1111 here"]
    return texts


def test_terms_equal_the_plain_count(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None), (3, texts[3])], "doc_id long, text string").repartition(4)
    texts += ["", texts[3]]
    for how in (pii.Settings(), pii.Settings(window=3, evidence=2, threshold=0.6), pii.Settings(window=50, evidence=1, threshold=0.99)):
        terms = plain_terms(texts, how)
        got = pii.find(df, how, keep=("doc_id", "text")).collect()
        assert len(got) == len(texts)
        for r in got:
            text = r["text"] or ""
            base = plain_base(text)
            words = [(m.start(), 4, m.end()) for m in pii.WORD.finditer(text) if m[0].lower() in terms and not any(a < m.end() and m.start() < b for a, _, b in base)]
            listed = lambda spans: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
            assert r["spans"] == listed(sorted(base + words))
            assert r["base_sha256"] == hashlib.sha256(listed(base).encode()).hexdigest()
    assert plain_terms(texts, pii.Settings()) >= {"blackbird", "x77-q"} and "zebra" not in plain_terms(texts, pii.Settings())


def test_sanitised_text(spark):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(corpus())] + [(None, None, None)], "doc_id long, text string, source string")
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert out[62] == "note2 by [NAME] of team [CODE] to mail [EMAIL] today word2 thanks"
    assert out[65] == "seen again: [NAME] walks alone"
    assert out[67] == "unique zebra copy sent to [EMAIL] now"
    assert out[77] == "call [PHONE] or [IP]" and out[None] is None and out[0] == corpus()[0]
    assert pii.sanitise(df).columns == df.columns
    assert pii.replaced("ab12cd", [(0, 0, 4), (2, 1, 6)]) == "[EMAIL]"


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(empty).collect() == []
    df = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    for name in ("row", "id", "body", "words", "terms", "spans", "packed", "_", "salt", "term", "place", "entity"):
        df = df.withColumn(name, F.lit("v"))
    out = pii.find(df, keep=tuple(df.columns)).collect()[0]
    assert out["spans"] == "email:0:5" and out["row"] == out["id"] == out["salt"] == "v"
    clean = pii.sanitise(df).collect()[0]
    assert clean["text"] == "[EMAIL]" and clean["terms"] == clean["spans"] == clean["packed"] == "v"


def test_query_counts_each_kind(spark, tmp_path):
    """Several spans of every kind, so that a kind's number and a span's place in the list do not agree."""
    texts = ["a@b.co c@d.ef g@h.ij 10.0.0.1 10.0.0.2", "+1 (555) 123-4567 then 4111 1111 1111 1111 and x@y.zw", "10.0.0.256 none 4111 1111 1111 1112",
             "4111-1111-1111-1111, 55500000000004, 1.2.3.4, +44.20.7946.0958, +1 555 010 9999", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op12_pii(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        base = plain_base(text or "")
        assert [got[i][f"n_{kind}"] for kind in PATTERNS] == [sum(k == kind for _, k, _ in base) for kind in range(4)]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
