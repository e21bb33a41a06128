import re

from pyspark.sql import functions as F

from eventide.functions import fixed, pagetext, scalars
from eventide.operators import condense, features, pages, tagging

COMPANIES = [
    ("HDFC Bank Limited", "HDFCBANK", "hdfc bank, hdfc"),
    ("HDFC Life Insurance", "HDFCLIFE", "hdfc life, hdfc"),
    ("Reliance Industries", "RELIANCE", "reliance, reliance industries"),
    ("Reliance Retail Ventures", "RRVL", "reliance retail"),
    ("Campus Activewear", "CAMPUS", "campus, campus activewear"),
    ("Larsen & Toubro", "LT", "l&t finance, larsen & toubro, larsen"),
    ("State Power", "SPWR", "power, spwr, abc"),
    ("Ünlü Holding", "UNLU", "ünlü holding"),
]
ARTICLES = [
    (1, "HDFC Bank posts profit as HDFC Life rises", "hdfc bank said"),
    (2, "Reliance Retail opens stores", "reliance"),
    (3, "Reliance shares jump; Reliance Retail next", "reliance industries"),
    (4, "Protest on campus", "a college campus event"),
    (5, "Campus Activewear launches shoes", "campus"),
    (6, "L&T Finance and Larsen & Toubro win deal", ""),
    (7, "Power demand surges", "power"),
    (8, "Nifty ends higher, HDFC Bank leads", "hdfc bank"),
    (9, "", "hdfc bank"),
    (10, "SPWR ends flat", "nothing here"),
    (11, "Reliance Industries, reliance retail and hdfc bank buy", "x"),
    (12, "Ünlü Holding reports", "ünlü holding"),
    (13, "xhdfc bank y hdfc banks z", "hdfc bank"),
    (14, None, None),
]


def tag_loop(headline, content):
    """A plain restatement of the tagging rules."""
    if not headline or any(re.search(p, headline.lower()) for p in fixed.SKIP_HEADLINE_PATTERNS):
        return []
    low, body = headline.lower(), (content or "").lower()
    table = [(k.strip().lower(), i, n, s) for i, (n, s, ks) in enumerate(COMPANIES) for k in ks.split(",")]
    table = sorted((x for x in table if len(x[0]) >= 4), key=lambda x: -len(x[0]))
    tags, taken = [], []
    for kw, _, name, sym in table:
        hit = re.search(rf"\b{re.escape(kw)}\b", low)
        if not hit or any(sym == s for s, *_ in tags):
            continue
        after = [x for p, xs in fixed.KEYWORD_EXCLUSIONS.items() if kw == p or kw.startswith(p + " ") for x in xs]
        if any(re.search(rf"\b{re.escape(kw)}\s+{x}\b", low) for x in after):
            continue
        if any(f" {w} " in f" {low} {body} " for w in fixed.NEGATIVE_CONTEXT.get(kw, ())) or kw in fixed.GENERIC_KEYWORDS:
            continue
        if kw in name.lower() or name.lower() in kw:
            score = 2 if len(kw) >= 8 else 0
        else:
            score = 2 if " " in kw and len(kw) >= 10 else 0
        score += any(a in low for a in fixed.BUSINESS_ACTION_KEYWORDS)
        score += bool(re.search(rf"\b{re.escape(kw)}\b", body)) + 3 * (kw.upper() == sym)
        if score < 2:
            continue
        s, e = hit.span()
        if any((kw in k or k in kw) and (a <= s < b or a < e <= b) for k, a, b in taken):
            continue
        tags.append((sym, kw, score))
        taken.append((kw, s, e))
    return tags


def test_tagging_equals_a_plain_loop(spark):
    mapping = spark.createDataFrame(
        [(i, n, s, "sec", "idx", k) for i, (n, s, k) in enumerate(COMPANIES)],
        "row int, CompanyName string, Symbol string, Sector string, Index string, Keyword string",
    )
    arts = spark.createDataFrame(ARTICLES, "article_id int, headline string, content string")
    out = tagging.tag_articles(arts, tagging.keyword_table(mapping, "row"))
    got = sorted((r.article_id, r.Symbol, r.keyword, r.confidence) for r in out.collect())
    want = sorted((i, *t) for i, h, c in ARTICLES for t in tag_loop(h, c))
    assert got == want and len(want) >= 8


def test_match_positions(spark):
    mapping = spark.createDataFrame(
        [(0, "N", "S", "", "", "bank of, o'neil inc")], "row int, CompanyName string, Symbol string, Sector string, Index string, Keyword string"
    )
    arts = spark.createDataFrame([(1, "é bank ofx O'Neil Inc. bank of", "")], "article_id int, headline string, content string")
    found = tagging.candidates(arts, tagging.keyword_table(mapping, "row")).select(F.explode("matches").alias("m"))
    got = {r.m.keyword: (r.m.start, r.m.stop) for r in found.collect()}
    text = "é bank ofx o'neil inc. bank of"
    assert got == {k: re.search(rf"\b{k}\b", text).span() for k in ("bank of", "o'neil inc")}


def test_mentions_and_flags(spark):
    df = spark.createDataFrame(
        [("HAL hindustan hindustan aeronautics rbi", "Hindustan Aeronautics Limited"), ("the co co", "Co"), ("a fine day", ""), ("x", None)],
        "t string, c string",
    )
    rows = df.select(scalars.mention_strength(F.lower("t"), F.col("c")).alias("n"), scalars.is_regulatory(F.lower("t")).alias("r"), scalars.is_negative_event(F.lower("t")).alias("e")).collect()
    assert [r.n for r in rows] == [3, 2, 0, 0]
    assert rows[0].r == 1 and rows[2].e == 1 and rows[3].e == 0


def test_names_scores_and_softmax(spark):
    row = spark.range(1).select(
        scalars.sanitized_name(F.lit(" A/B & Co. ")).alias("a"), scalars.sanitized_name(F.lit("&&")).alias("b"),
        scalars.path_name(F.lit("A B/C\\D")).alias("c"), scalars.loose_name(F.lit("L.&T. Éa ")).alias("d"),
        scalars.source_score(F.lit("CNBC-TV18")).alias("e"), scalars.source_score(F.lit(None).cast("string")).alias("f"),
        *[c.alias(n) for n, c in scalars.sentiment_from_logits(F.array(F.lit(1.0), F.lit(1.0), F.lit(0.0))).items()],
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == ("AB  Co.", "UNKNOWN", "A_B_C_D", "lt éa", 0.95, 0.7)
    assert row.sentiment == "negative" and abs(row.confidence - 0.4223) < 1e-4  # ties go to the first class


def test_bad_numbers(spark):
    df = spark.createDataFrame([(float("nan"), "1"), (float("inf"), "x"), (None, None), (0.0, "2.5")], "a double, b string")
    rows = df.select(scalars.all_valid([F.col("a"), F.col("b")]).alias("ok"), scalars.imputed(F.col("a")).alias("a"), scalars.imputed(F.col("b")).alias("b")).collect()
    assert [(r.ok, r.a, r.b) for r in rows] == [(False, 0.0, 1.0), (False, 0.0, 0.0), (False, 0.0, 0.0), (True, 0.0, 2.5)]


PAGE = """<html><head><meta property="article:published_time" content="2026-01-17T10:00:00+05:30">
<script>var t="</p>";</script></head><body><nav><a href="/x">nav</a></nav>
<article><h1>Markets10:59 | Nov 17, 2025 Big &amp; bold</h1><p>First <b>part {0}<p>Second part {0}</p><p>Disclaimer: no</p></article>
<a href="/story/1">A headline that is long enough</a><a href="/story/1">again the same link, later</a><a href="mailto:x">m</a>
<a href="https://h.com/2"><span>Read more about this thing</span></a><p>outside</p></body></html>""".format("word " * 30)


def test_page_job(spark):
    df = spark.createDataFrame([(1, "https://h.com/a/12345678.html?x=1", PAGE), (2, "https://h.com/b", "<p>tiny</p>")], "page_id int, url string, html string")
    out = pages.articles(df, F.lit("Moneycontrol"), F.lit("2026-01-18 00:00:00").cast("timestamp"), verify=False).collect()
    assert len(out) == 1
    a = out[0]
    assert (a.article_id, a.headline, a.published_time) == ("12345678", "Big & bold", "2026-01-17 10:00:00")
    lines = a.content.split("\n")
    # This site has no line patterns of its own, so the disclaimer stays.
    assert len(lines) == 3 and lines[0].startswith("First part word") and lines[1].startswith("Second part")
    links = pages.page_links(df, keep=pagetext.link_title_ok(F.col("title"))).collect()
    assert [(r.link, r.title) for r in links] == [("https://h.com/story/1", "A headline that is long enough")]
    assert pages.page_links(df, limit=1).filter("page_id = 1").count() == 1


def test_json_ld_wins(spark):
    html = '<script type="application/ld+json">{"articleBody": " From LD "}</script><p>dom</p>'
    df = spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string")
    assert pages.with_text(df).first().content == "From LD"


def test_url_rules(spark):
    df = spark.createDataFrame([("https://b.in/markets/stocks",), ("https://b.in/markets/x-12345",), ("https://b.in/other",)], "u string")
    assert [r[0] for r in df.select(pagetext.is_section(F.col("u"))).collect()] == [True, False, False]
    row = spark.range(1).select(
        pagetext.article_id_by_source(F.lit("https://x/articleshow/77.cms?q=123456789"), F.lit("Economic Times")).alias("a"),
        pagetext.article_id_by_source(F.lit("https://x/n-19.htm?utm=1"), F.lit("CNBC-TV18")).alias("b"),
        pagetext.valid_article_url(F.lit("https://x/live/n-19.htm"), "https://x/", ".htm", ("/live/",)).alias("c"),
    ).first()
    assert (row.a, row.b, row.c) == ("77", "19", False)


def test_lines(spark):
    text = "Keep me\n  Disclaimer: x\n\n1,234.50 points\nGet with us\nCatch all the Business News here\nlast"
    ads = "Body text\nSubscribe to us\nTop 5 funds to buy\n" + "x" * 201 + "\nby John Smith\nEnd"
    row = spark.range(1).select(pagetext.cleaned_body(F.lit(text), F.lit("The Hindu Business Line")).alias("a"), pagetext.without_ad_lines(F.lit(ads)).alias("b"), pagetext.cleaned_synopsis(F.lit("a  b\nREAD MORE c")).alias("c")).first()
    assert (row.a, row.b, row.c) == ("Keep me\nlast", "Body text\nEnd", "a b")


def test_by_lines_of_any_length(spark):
    """One thread's stack must not bound a line; the JVM of the test would end with the stack, so the plain pattern tells first."""
    rx = pagetext.alternation((*fixed.AD_LINES, fixed.AD_LISTING_LINE))
    assert pagetext.looped(rx) != rx
    names = "By " + "John SMITH\t" * 100_000
    cases = [
        (names, True), (names + "x1", False), (names + ", editor", False), ("  by Ann", True), ("by A", False), ("by Ann B", False),
        ("by Ann\x0bBob", True), ("by Ann  Bob\u2028", True), ("by Ann Bob\u0085", True), ("Day by Ann", False), ("by Ann Bob - x", False), ("by  ", False), ("byAnn", False),
    ]
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "n int, text string")
    got = {r.n: r.left == "" for r in df.select("n", pagetext.without_ad_lines(F.col("text")).alias("left")).collect()}
    assert got == {i: dropped for i, (_, dropped) in enumerate(cases)}
    # What the plain pattern says of the short ones.
    short = df.where(F.length("text") < 100).select("n", (pagetext.trimmed_lines(F.col("text"))[0].rlike(rx)).alias("plain")).collect()
    assert {r.n: r.plain for r in short} == {i: dropped for i, (text, dropped) in enumerate(cases) if len(text) < 100}


def test_top_sentences(spark):
    long = "Alpha beta. Alpha gamma! Zeta? Alpha beta gamma. Beta gamma. Omega omega. Alpha beta gamma alpha."
    df = spark.createDataFrame([(1, long), (2, "One. Two."), (3, "")], "doc_id int, text string")
    got = {r.doc_id: r.condensed_text for r in condense.top_sentences(df).collect()}
    assert got[2] == "One. Two." and got[3] == ""
    assert got[1] == "Alpha beta. Alpha gamma! Alpha beta gamma. Beta gamma. Alpha beta gamma alpha."
    hook = lambda t: F.array(F.length(t).cast("double"), F.lit(1.0))
    assert condense.encoded_top_sentences(df.filter("doc_id = 1"), hook).count() == 1


def test_text_features(spark):
    schema = "headline string, condensed_text string, sentiment string, confidence double, positive_prob double, negative_prob double, neutral_prob double, source string, company_name string, published_time string"
    df = spark.createDataFrame([("SEBI fines Acme", "acme acme", "negative", 0.9, 0.1, 0.7, None, "LiveMint", "Acme Ltd", "2026-01-01 10:00:00"), ("h", "t", None, 0.1, 0.1, 0.1, 0.1, "x", "y", "")], schema)
    row = features.text_features(df, F.lit("2026-01-01 10:15:00").cast("timestamp_ntz")).collect()
    assert len(row) == 1
    r = row[0]
    assert (r.sentiment_score, r.neutral_prob, r.news_source_score, r.is_regulatory_news, r.is_negative_event, r.company_mention_strength, r.time_decay_15m) == (-0.6, 0.0, 0.7, 1, 1, 3, 0.3679)


def test_view_columns_and_day_filter(spark):
    df = spark.createDataFrame([("2026-01-17 10:05:00", "positive", 0.91234), (None, "neutral", 0.5)], "t string, s string, c double")
    df = df.withColumn("ts", F.col("t").cast("timestamp_ntz"))
    view = df.withColumns(scalars.display_columns(F.col("ts"), F.col("s"), F.col("c"))).collect()
    assert (view[0].formatted_date, view[0].time, view[0].sentiment_label, view[0].confidence_pct) == ("17 Jan 2026", "10:05", "POSITIVE", 91.23)
    assert (view[1].formatted_date, view[1].time) == ("Date N/A", "--:--")
    assert pages.published_on(df, F.col("ts"), "2026-01-17").count() == 1


def test_lines_are_judged_by_their_own_site_only(spark):
    body = "2 units of the company will be sold\n" + "A long paragraph about the company and its plans for the year. " * 4
    html = "<article><h1>Head</h1>" + "".join(f"<p>{x}</p>" for x in body.split("\n")) + "</article>"
    rows = [(i, f"http://x.example/{1000 + i}.html", html, s) for i, s in enumerate(("Moneycontrol", "LiveMint", "The Hindu Business Line"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, site string")
    out = pages.articles(df, F.col("site"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    got = {r.source: r.content.startswith("2 units") for r in out.collect()}
    assert got == {"Moneycontrol": True, "LiveMint": True, "The Hindu Business Line": False}


def test_links_and_marks_in_any_quotes(spark):
    html = "<a class=x href='/one?a=1'>first link</a><a href=/two>second</a><a href=\"/three\">third</a><meta property='article:published_time' content='2024-01-02T03:04:05Z'>"
    df = spark.createDataFrame([(1, "http://h.example/p", html)], "page_id long, url string, html string")
    assert [r.link for r in pages.page_links(df).orderBy("pos").collect()] == [f"http://h.example/{x}" for x in ("one?a=1", "two", "three")]
    assert df.select(pagetext.published_text(F.col("html")).alias("p")).first().p == "2024-01-02 03:04:05"


def test_encoded_condensation_keeps_all_documents(spark):
    few = "One. Two."
    df = spark.createDataFrame([(1, few), (2, ""), (3, None), (4, "A. B. C. D. E. F.")], "doc_id long, text string")
    got = dict(condense.encoded_top_sentences(df, lambda c: F.array(F.length(c).cast("double"), F.lit(1.0))).collect())
    assert got[1] == few and got[2] == "" and got[3] is None and len(got[4].split()) == 5


def test_hot_words_and_many_keywords_take_one_walk(spark, monkeypatch):
    """One word in every third headline and 10,000 keywords that begin with it: only true matches leave the walk."""
    names = [f"acme part{i}" for i in range(10_000)]
    mapping = spark.createDataFrame([(i, f"Acme {i}", f"S{i}", "", "", k) for i, k in enumerate(names)], "row int, CompanyName string, Symbol string, Sector string, Index string, Keyword string")
    heads = [(i, f"acme part{i * 7} wins" if i % 3 == 0 else f"other news {i}", "") for i in range(3000)]
    arts = spark.createDataFrame(heads, "article_id int, headline string, content string").repartition(6)
    keywords = tagging.keyword_table(mapping, "row")
    want = {i: f"acme part{i * 7}" for i, *_ in heads if i % 3 == 0 and i * 7 < 10_000}
    for shard in (100_000, 3_000):  # one automaton, and four
        monkeypatch.setattr(tagging, "SHARD_PHRASES", shard)
        texts = arts.select(F.col("article_id").alias("key"), tagging.marked(F.lower("headline")).alias("text"))
        found = tagging.phrase_matches(texts, keywords.select("phrase").distinct())
        assert found.count() == len(want)
        got = {r.article_id: [m.keyword for m in r.matches] for r in tagging.candidates(arts, keywords).collect()}
        assert got == {i: [k] for i, k in want.items()}


def test_references_are_decoded_once(spark):
    texts = ["a &rsquo;b&#8212;c&#x1F600; &nbsp;d", "&amp;lt; &lt;&amp;&gt;", "&unknown; &#0; &#xD800; &#99999999; & &; &amp", "plain", None, "&apos;&quot;&eacute;"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(pagetext.unescaped(F.col("t"))).collect()]
    assert got == ["a \u2019b\u2014c\U0001F600  d", "&lt; <&>", "&unknown; &#0; &#xD800; &#99999999; & &; &amp", "plain", None, "'\"\u00e9"]


def test_words_reach_python_in_small_batches(spark, monkeypatch):
    """One task of long texts: what its worker holds at once does not grow with the rows of the task."""
    plain = condense._central

    def bounded(words, k):
        if words.nbytes > 8 << 20:
            raise ValueError(f"{len(words)} texts at once, {words.nbytes} bytes")
        return plain(words, k)

    monkeypatch.setattr(condense, "_central", bounded)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    text = F.repeat(F.concat(F.repeat(F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" ")), 20), F.lit(". ")), 100)
    out = condense.top_sentences(spark.range(0, 800, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text")))
    assert out.filter(F.length("condensed_text") > 0).count() == 800
