"""Publish-time texts to times. All results are exchange-local ``timestamp_ntz``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventide.functions.clock import EXCHANGE_ZONE, floor_minute

# The written forms of publish times. A failed parse is far more costly than a
# shape test, so parsers that try several forms test the shape first.
PIPE_SECONDS = "d MMM yyyy h:m:s a"
PIPE_MINUTES = "d MMM yyyy h:m a"
SLASH_FORM = "MMMM d, yyyy H:m"
ISO_FORM = "yyyy-M-d H:m:s"
AT_FORM = "MMMM d, yyyy 'at' h:m a"
SITE_FORMS = {
    "MMM d, yyyy, h:m:s a": r"^\p{L}+ \d+, \d+, \d+:\d+:\d+ \w+$",
    "MMM d, yyyy, h:m a": r"^\p{L}+ \d+, \d+, \d+:\d+ \w+$",
    "d MMM yyyy, h:m:s a": r"^\d+ \p{L}+ \d+, \d+:\d+:\d+ \w+$",
    "d MMM yyyy, h:m a": r"^\d+ \p{L}+ \d+, \d+:\d+ \w+$",
    "yyyy-M-d H:m:s": r"^\d+-\d+-\d+ \d+:\d+:\d+$",
}
DISPLAY_FORM = "hh:mm:ss a '|' dd MMM yyyy"


def _read(text: Column, form: str) -> Column:
    return F.try_to_timestamp(text, F.lit(form)).cast("timestamp_ntz")


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _iso_start(text: Column) -> Column:
    """The form has a blank, so a text without one (a ``T`` in its place) needs no failed parse."""
    start = F.substring(text, 1, 19)
    return F.when(start.contains(" "), _read(start, ISO_FORM))


def _pipe(text: Column, seconds: bool = True) -> Column:
    """``time | date``; more than one bar is not a time."""
    clock, day = (F.trim(F.substring_index(text, "|", side)) for side in (1, -1))
    joined = F.concat_ws(" ", day, clock)
    colons = _count(clock, ":")
    read = F.when(colons == 1, _read(joined, PIPE_MINUTES))
    if seconds:
        read = read.when(colons == 2, _read(joined, PIPE_SECONDS))
    return F.when(_count(text, "|") == 1, read)


def _slash(text: Column, gap: str = "") -> Column:
    bare = F.replace(F.replace(text, F.lit(" IST"), F.lit("")), F.lit("/"), F.lit(gap))
    return _read(F.trim(F.regexp_replace(bare, r"\s+", " ")), SLASH_FORM)


def _iso_any(text: Column) -> Column:
    """ISO date-times with optional ``T``, fraction and offset; an offset is moved to local time."""
    ok = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    zoned = text.rlike(r"\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$")
    moment = text.try_cast("timestamp")
    local = F.when(zoned, F.from_utc_timestamp(moment, EXCHANGE_ZONE)).otherwise(moment)
    return F.when(ok, local.cast("timestamp_ntz"))


def has(text: Column, *parts: str) -> Column:
    test = text.contains(parts[0])
    for p in parts[1:]:
        test = test & text.contains(p)
    return test


def published_local(text: Column) -> Column:
    """Pipeline parser: the first form whose mark is present decides; failure is null."""
    return (
        F.when(has(text, "|"), _pipe(text))
        .when(has(text, "/", "IST"), _slash(text))
        .when(has(text, "-", ":"), _iso_start(text))
        .when(has(text, " at "), _read(text, AT_FORM))
    )


def published_utc(text: Column) -> Column:
    """The same moment as zone-less UTC."""
    return local_to_utc(published_local(text))


def local_to_utc(ts: Column) -> Column:
    return F.to_utc_timestamp(ts.cast("timestamp"), EXCHANGE_ZONE).cast("timestamp_ntz")


def signal_local(text: Column) -> Column:
    """Event-study parser: ISO first, no seconds in the pipe form, floored to the minute."""
    t = F.trim(text)
    return floor_minute(
        F.coalesce(
            F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"), _read(t, ISO_FORM)),
            F.when(t.rlike(r"^\p{L}+ +\d+, *\d+[/ ] *\d+:\d+"), _slash(t, " ")),
            F.when(has(t, " at "), _read(t, AT_FORM)),
            F.when(has(t, "|"), _pipe(t, seconds=False)),
            _iso_any(t),
        )
    )


def flexible_local(text: Column) -> Column:
    """Calendar parser: ISO first, then every other form by its mark; the last test that fits wins."""
    t = F.trim(text)
    return F.coalesce(
        _iso_any(t),
        F.when(has(t, "-", ":"), _iso_start(t)),
        F.when(has(t, "|"), _pipe(t)),
        F.when(has(t, "/", "IST"), _slash(t)),
        F.when(has(t, " at "), _read(t, AT_FORM)),
    )


def view_local(text: Column, predicted_at: Column) -> Column:
    """Display time; falls back to the prediction time."""
    t = F.trim(text)
    own = F.coalesce(
        F.when(has(t, "|"), _pipe(t, seconds=False)),
        F.when(has(t, " at "), _read(t, AT_FORM)),
        F.when(~has(t, "|") & ~has(t, " at "), _iso_any(t)),
    )
    spare = F.replace(F.replace(predicted_at, F.lit(" IST"), F.lit("")), F.lit("T"), F.lit(" "))
    return F.coalesce(own, _iso_any(spare))


def epoch_local(epoch: Column, arrived: Column) -> Column:
    """Epoch seconds (or ms above 1e11) to local time.

    A result more than three hours after arrival was already local: the offset is taken back.
    """
    sec = F.when(epoch > 100_000_000_000, F.floor(epoch / 1000)).otherwise(epoch).cast("long")
    local = F.from_utc_timestamp(F.timestamp_seconds(sec), EXCHANGE_ZONE).cast("timestamp_ntz")
    late = local > arrived + F.expr("interval 3 hours")
    return F.when(late, local - F.expr("interval 330 minutes")).otherwise(local).cast("timestamp_ntz")


def site_display(raw: Column) -> Column:
    """Site time text to ``hh:mm:ss AM | dd Mon yyyy``; unknown forms are null."""
    bare = F.trim(F.replace(F.trim(raw), F.lit("IST"), F.lit("")))
    bare = F.regexp_replace(bare, r"(?i)updated:\s*", "")
    read = [F.when(bare.rlike(shape), _read(bare, form)) for form, shape in SITE_FORMS.items()]
    return F.date_format(F.coalesce(*read), DISPLAY_FORM)
