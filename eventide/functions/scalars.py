"""Scalar feature expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventide.functions import clock, fixed


def once(values: Sequence[Column], use: Callable[..., Column]) -> Column:
    """``use(*values)`` with each value computed once per row.

    The optimizer may move a column that is named once into the lambda that uses it, where
    it would be computed again for every array element; a lambda variable cannot move.
    """
    names = [f"v{i}" for i in range(len(values))]
    packed = F.array(F.struct(*[v.alias(n) for v, n in zip(values, names)]))
    return F.get(F.transform(packed, lambda v: use(*[v[n] for n in names])), F.lit(0))


def time_decay(ts: Column, as_of: Column, minutes: float = 15.0, places: int = 4) -> Column:
    """exp(-age / 15 min); the future counts as age 0, an unknown time as fresh."""
    age = F.greatest((clock.micros(as_of) - clock.micros(ts)) / clock.MINUTE_US, F.lit(0.0))
    return F.coalesce(F.round(F.exp(-age / minutes), places), F.lit(1.0))


def any_word(text: Column, words: Sequence[str]) -> Column:
    """1 when any word is a substring of the (lower-case) text, else 0."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words]).cast("int")


def text_blob(headline: Column, body: Column) -> Column:
    return F.lower(F.concat(F.coalesce(headline, F.lit("")), F.lit(" "), F.coalesce(body, F.lit(""))))


def is_regulatory(blob: Column, words: Sequence[str] = fixed.REGULATORY_WORDS) -> Column:
    return any_word(blob, words)


def is_negative_event(blob: Column, words: Sequence[str] = fixed.NEGATIVE_EVENT_WORDS) -> Column:
    return any_word(blob, words)


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a non-empty substring."""
    gone = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.floor(F.try_divide(gone, F.length(part))).cast("int")


def mention_strength(blob: Column, company: Column, stop: Sequence[str] = fixed.COMPANY_STOP_WORDS) -> Column:
    """Mentions of the name's words longer than 2 that are no stop words (repeats count twice);
    with no such word, mentions of the whole name; 0 without a company."""
    name = F.lower(company)
    words = F.filter(
        F.split(F.trim(name), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*stop)
    )
    total = once([blob], lambda b: F.aggregate(words, F.lit(0), lambda acc, w: acc + occurrences(b, w)))
    mentions = F.when(F.size(words) > 0, total).otherwise(occurrences(blob, name))
    return F.when(F.coalesce(company, F.lit("")) == "", 0).otherwise(mentions).cast("int")


def source_score(
    source: Column, scores: Mapping[str, float] = fixed.SOURCE_SCORE, default: float = fixed.SOURCE_SCORE_DEFAULT
) -> Column:
    table = F.create_map(*[F.lit(x) for pair in scores.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.coalesce(source, F.lit(""))), F.lit(default))


def sentiment_score(positive: Column, negative: Column) -> Column:
    return F.coalesce(F.round(positive - negative, 4), F.lit(0.0))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def arg_max(values: Column) -> Column:
    """0-based position of the largest value, ties to the first."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def sentiment_from_logits(logits: Column, names: Sequence[str] = ("negative", "neutral", "positive")) -> dict[str, Column]:
    p = softmax(logits)
    top = arg_max(p)
    out = {f"{n}_prob": F.get(p, F.lit(i)) for i, n in enumerate(names)}
    out["sentiment"] = F.get(F.array(*[F.lit(n) for n in names]), top)
    out["confidence"] = F.array_max(p)
    out["sentiment_score"] = F.get(p, F.lit(names.index("positive"))) - F.get(p, F.lit(names.index("negative")))
    return out


def as_number(value: Column) -> Column:
    """The value as double; text that is no number, NaN and infinities become null."""
    d = value.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def all_valid(values: Sequence[Column]) -> Column:
    """Every value is present, numeric and finite."""
    return reduce(and_, [as_number(v).isNotNull() for v in values])


def invalid_names(values: dict[str, Column]) -> Column:
    """The names of the values that are missing, no numbers or not finite, in order."""
    return F.array_compact(F.array(*[F.when(as_number(v).isNull(), n) for n, v in values.items()]))


def imputed(value: Column) -> Column:
    return F.coalesce(as_number(value), F.lit(0.0))


def falsy_or(first: Column, second: Column) -> Column:
    """``first`` unless it is null or zero (empty text counts as null)."""
    return F.when(first.isNotNull() & (first != 0), first).otherwise(second)


def sanitized_name(name: Column) -> Column:
    """Keep ASCII letters, digits, space, ``-_.``; an empty result is UNKNOWN."""
    kept = F.trim(F.regexp_replace(name, r"[^A-Za-z0-9 \-_.]", ""))
    return F.when(F.coalesce(kept, F.lit("")) == "", "UNKNOWN").otherwise(kept)


def path_name(name: Column) -> Column:
    """Space, slash and backslash become underscores."""
    return F.translate(name, " /\\", "___")


def loose_name(name: Column) -> Column:
    """Lower case, letters, digits and spaces only: for matching names that differ in punctuation."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}\s]", ""))


def display_columns(ts: Column, sentiment: Column, confidence: Column) -> dict[str, Column]:
    return {
        "date": F.to_date(ts),
        "formatted_date": F.coalesce(F.date_format(ts, "dd MMM yyyy"), F.lit("Date N/A")),
        "time": F.coalesce(F.date_format(ts, "HH:mm"), F.lit("--:--")),
        "sentiment_label": F.upper(sentiment),
        "confidence_pct": F.round(confidence * 100, 2),
    }
