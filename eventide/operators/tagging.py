"""Company tagging: keywords in headlines, context rules, confidence and greedy resolution.

Headlines are never paired with keywords, nor with the keywords that share a word with them. The distinct
phrases of the keywords are cut into shards of bounded size; a shard travels to the tasks as an
automaton (a trie with failure links) that finds all of its phrases in one walk over a headline,
at word boundaries marked by the engine. Only true matches leave the tasks, as (article, phrase, place).
The context rules and the resolution run inside the article row on built-in array functions.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.functions import fixed
from eventide.functions.scalars import once

WORDS = r"(?U)(\w+)"
MARK = "\x01"
SHARD_PHRASES = 100_000  # phrases of one automaton; more make further walks over the headlines


def marked(text: Column) -> Column:
    """The text with a mark at every word boundary.

    A phrase occurs between word boundaries exactly when its marked form (marks at both
    ends) is a substring of the marked text, so each text meets one regular expression and
    each keyword a plain substring search.
    """
    return F.regexp_replace(F.translate(text, MARK, " "), WORDS, f"{MARK}$1{MARK}")


def marked_phrase(phrase: Column) -> Column:
    inner = F.regexp_replace(phrase, WORDS, f"{MARK}$1{MARK}")
    return F.concat(F.lit(MARK), F.trim(inner, F.lit(MARK)), F.lit(MARK))


def keyword_table(
    mapping: DataFrame,
    order: str,
    generic: Sequence[str] = fixed.GENERIC_KEYWORDS,
    exclusions: Mapping[str, Sequence[str]] = fixed.KEYWORD_EXCLUSIONS,
    negative: Mapping[str, Sequence[str]] = fixed.NEGATIVE_CONTEXT,
    min_length: int = fixed.MIN_KEYWORD_LENGTH,
) -> DataFrame:
    """One row per usable keyword of the mapping (CompanyName, Symbol, Sector, Index, Keyword).

    ``order`` gives the file order. Everything that depends on the keyword alone is worked
    out here: its rank (longer first, then file order), its patterns, its generic flag,
    its negative context and the part of the confidence that needs no article. A keyword
    without any letter or digit cannot name a company and is left out.
    """
    parts = mapping.select(
        "CompanyName",
        "Symbol",
        "Sector",
        "Index",
        F.col(order).alias("row"),
        F.posexplode(F.split(F.coalesce("Keyword", F.lit("")), ",")).alias("pos", "raw"),
    )
    parts = parts.withColumn("keyword", F.lower(F.trim("raw"))).drop("raw")
    parts = parts.filter(F.length("keyword") >= min_length)
    kw, name = F.col("keyword"), F.lower("CompanyName")
    quoted = F.concat(F.lit("\\Q"), kw, F.lit("\\E"))
    suffixes = F.concat_ws(
        "|",
        *[
            F.when((kw == parent) | kw.startswith(parent + " "), "|".join(after))
            for parent, after in exclusions.items()
        ],
    )
    context = F.array().cast("array<string>")
    for word, bad in negative.items():
        context = F.when(kw == word, F.array(*[F.lit(b) for b in bad])).otherwise(context)
    inside = name.contains(kw) | kw.contains(name)
    long_alias = kw.contains(" ") & (F.length(kw) >= fixed.MULTI_WORD_LENGTH)
    full_name = F.when(inside, F.length(kw) >= fixed.FULL_NAME_LENGTH).otherwise(long_alias)
    return parts.withColumns(
        {
            "neg_length": -F.length(kw),
            "phrase": marked_phrase(kw),
            "excluded_by": F.when(
                suffixes != "", F.concat(F.lit(r"(?U)\b"), quoted, F.lit(r"\s+(?:"), suffixes, F.lit(r")\b"))
            ),
            "context": context,
            "is_generic": kw.isin(*generic),
            "base_score": F.when(F.coalesce(full_name, F.lit(False)), 2).otherwise(0)
            + F.when(F.upper(kw) == F.col("Symbol"), 3).otherwise(0),
        }
    ).filter(kw.rlike(WORDS))


FIELDS = (
    "neg_length", "row", "pos", "keyword", "CompanyName", "Symbol", "Sector", "Index",
    "phrase", "excluded_by", "context", "is_generic", "base_score",
)


_AUTOMATA: dict[int, ahocorasick.Automaton] = {}


def _automaton(number: int, phrases: Sequence[str]) -> ahocorasick.Automaton:
    """The automaton of a shard, built once a worker."""
    if number not in _AUTOMATA:
        made = ahocorasick.Automaton()
        for p in phrases:
            made.add_word(p, p)
        made.make_automaton()
        if len(_AUTOMATA) > 3:
            _AUTOMATA.clear()
        _AUTOMATA[number] = made
    return _AUTOMATA[number]


def phrase_matches(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(key, phrase, start) for every phrase that occurs in a marked text; start is the first place, without marks.

    ``texts`` has the columns key and text, ``phrases`` one column of distinct marked phrases. Each shard of about
    ``SHARD_PHRASES`` of them is collected, broadcast and walked in one pass over the texts, which are not shuffled.
    """
    spark = texts.sparkSession
    shards = -(-phrases.count() // SHARD_PHRASES)
    name = phrases.columns[0]
    schema = T.StructType([texts.schema["key"], T.StructField("phrase", T.StringType()), T.StructField("start", T.IntegerType())])
    found = spark.createDataFrame([], schema)
    for shard in range(shards):
        part = phrases.filter(F.pmod(F.xxhash64(name), F.lit(shards)) == shard)
        shared = spark.sparkContext.broadcast([r[0] for r in part.collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, number=shared._jbroadcast.id()) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(number, shared.value) if shared.value else None
            for batch in batches:
                at, said, starts = [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    first: dict[str, int] = {}
                    for end, phrase in automaton.iter(text) if automaton else ():
                        first.setdefault(phrase, end + 1 - len(phrase))
                    for phrase, begin in first.items():
                        at.append(i)
                        said.append(phrase)
                        starts.append(begin - text.count(MARK, 0, begin))
                columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(said, pa.string()), pa.array(starts, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "phrase", "start"])

        out = texts.select("key", "text").mapInArrow(run, schema)
        found = out if shards == 1 else found.unionByName(out)
    return found


FIELDS = (
    "neg_length", "row", "pos", "keyword", "CompanyName", "Symbol", "Sector", "Index",
    "phrase", "excluded_by", "context", "is_generic", "base_score",
)


def candidates(
    articles: DataFrame,
    keywords: DataFrame,
    key: str = "article_id",
    headline: str = "headline",
    skip: Sequence[str] = fixed.SKIP_HEADLINE_PATTERNS,
) -> DataFrame:
    """Articles whose headline holds a keyword, with ``matches`` in keyword rank order.

    ``key`` is unique. Headlines of macro news are skipped.
    """
    head = F.lower(headline)
    scanned = articles.filter((F.coalesce(F.col(headline), F.lit("")) != "") & ~head.rlike("|".join(skip)))
    texts = scanned.select(F.col(key).alias("key"), marked(head).alias("text"))
    found = phrase_matches(texts, keywords.select("phrase").distinct())
    fields = [f for f in FIELDS if f != "phrase"]
    named = found.join(keywords.select("phrase", *fields), "phrase")
    match = F.struct(*FIELDS, "start", (F.col("start") + F.length("keyword")).alias("stop"))
    grouped = named.groupBy("key").agg(F.sort_array(F.collect_list(match)).alias("matches"))
    return articles.join(grouped.withColumnRenamed("key", key), key)


def scored(
    matched: DataFrame,
    headline: str = "headline",
    content: str = "content",
    actions: Sequence[str] = fixed.BUSINESS_ACTION_KEYWORDS,
    min_score: int = fixed.MIN_CONFIDENCE_SIGNALS,
) -> DataFrame:
    """``matches`` reduced to those that pass the context rules, each with its confidence."""
    head = F.lower(headline)
    body = F.lower(F.coalesce(F.col(content), F.lit("")))
    padded = F.concat(F.lit(" "), head, F.lit(" "), body, F.lit(" "))
    action = F.when(head.rlike("|".join(actions)), 1).otherwise(0)

    def confident(k: Column, text: Column, acts: Column) -> Column:
        in_body = F.when(text.contains(k["phrase"]), 1).otherwise(0)
        return F.struct(
            *[k[f].alias(f) for f in ("keyword", "CompanyName", "Symbol", "Sector", "Index", "start", "stop")],
            (k["base_score"] + acts + in_body).alias("confidence"),
        )

    def allowed(k: Column, title: Column, whole: Column) -> Column:
        by_suffix = F.coalesce(F.rlike(title, k["excluded_by"]), F.lit(False))
        by_context = F.exists(k["context"], lambda w: whole.contains(F.concat(F.lit(" "), w, F.lit(" "))))
        return ~k["is_generic"] & ~by_suffix & ~by_context

    def kept(title: Column, text: Column, whole: Column, acts: Column) -> Column:
        good = F.filter("matches", lambda k: allowed(k, title, whole))
        return F.filter(F.transform(good, lambda k: confident(k, text, acts)), lambda k: k["confidence"] >= min_score)

    return matched.withColumn("matches", once([head, marked(body), padded, action], kept))


def resolved(matched: DataFrame) -> DataFrame:
    """Greedy choice in rank order: one tag per symbol, no overlapping nested keyword."""

    def clash(p: Column, k: Column) -> Column:
        nested = p["keyword"].contains(k["keyword"]) | k["keyword"].contains(p["keyword"])
        begins = (k["start"] >= p["start"]) & (k["start"] < p["stop"])
        ends = (k["stop"] > p["start"]) & (k["stop"] <= p["stop"])
        return p["Symbol"].eqNullSafe(k["Symbol"]) | (nested & (begins | ends))

    def chosen(ranked: Column) -> Column:
        return F.aggregate(
            ranked,
            F.slice(ranked, 1, 0),
            lambda acc, k: F.when(F.exists(acc, lambda p: clash(p, k)), acc).otherwise(F.array_append(acc, k)),
        )

    return matched.withColumn("matches", once([F.col("matches")], chosen))


def tag_articles(
    articles: DataFrame,
    keywords: DataFrame,
    key: str = "article_id",
    headline: str = "headline",
    content: str = "content",
) -> DataFrame:
    """One row per (article, company). Generic keywords never tag, so they do not enter the join."""
    found = resolved(scored(candidates(articles, keywords.filter(~F.col("is_generic")), key, headline), headline, content))
    kept = [c for c in articles.columns]
    # A plain ``inline`` would send a filter with the whole scoring expression into the join condition.
    rows = found.select(*kept, F.inline_outer("matches"))
    return rows.filter(F.col("keyword").isNotNull()).drop("start", "stop")
