"""URL, HTML and line expressions for turning pages into articles.

Patterns avoid look-around so that any RE2 engine gives the same answer.
"""

from __future__ import annotations

import html.entities
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventide.functions import fixed


def normalized_url(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def article_id(url: Column, patterns: Sequence[str], strip: bool = False) -> Column:
    """First capture of the patterns in order, else the MD5 of the url."""
    u = normalized_url(url) if strip else url
    found = [F.nullif(F.regexp_extract(u, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*found, F.md5(u))


def article_id_by_source(url: Column, source: Column) -> Column:
    """Article id with the site's own patterns; an unknown site uses the MD5."""
    out = F.md5(url)
    for name, (patterns, strip) in fixed.ARTICLE_ID_PATTERNS.items():
        out = F.when(source == name, article_id(url, patterns, strip)).otherwise(out)
    return out


def article_signal(url: Column) -> Column:
    """The url itself says "article": .html, five digits, /story/ or /article/."""
    return (
        F.lower(url).contains(".html") | url.rlike(r"\d{5,}") | url.contains("/story/") | url.contains("/article/")
    )


def is_section(url: Column, prefixes: Sequence[str] = fixed.SECTION_PREFIXES) -> Column:
    """A known section path without an article signal."""
    return url.rlike("(?i)(" + "|".join(prefixes) + ")") & ~article_signal(url)


def is_media(url: Column, parts: Sequence[str] = fixed.MEDIA_URL_PARTS) -> Column:
    return url.rlike("|".join(parts))


def valid_article_url(url: Column, prefix: str, suffix: str, blocked: Sequence[str] = ()) -> Column:
    u = normalized_url(url)
    ok = u.startswith(prefix) & u.endswith(suffix)
    for b in blocked:
        ok = ok & ~u.contains(b)
    return F.coalesce(ok, F.lit(False))


def absolute_url(href: Column, base: Column) -> Column:
    """Absolute links stay, rooted ones get the page's scheme and host, others are dropped."""
    root = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    return F.when(href.startswith("http"), href).when(href.startswith("/"), F.concat(root, href))


JUNK_BLOCKS = ("script", "style", "nav", "footer", "noscript")
# Named characters by the standard's table; a hard space becomes a plain one.
NAMED = {**{name: chr(code) for name, code in html.entities.name2codepoint.items()}, "apos": "'", "nbsp": " "}


def unescaped(text: Column) -> Column:
    """Named, decimal and hexadecimal character references, each decoded once; unknown ones stay."""
    names = F.str_to_map(F.lit("\n".join(f"{name}\t{char}" for name, char in NAMED.items())), F.lit("\n"), F.lit("\t"))

    def decoded(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^&(#?\w+);", 1)
        number = F.when(name.rlike(r"^#[0-9]{1,7}$"), F.substring(name, 2, 9).cast("long")).when(
            name.rlike(r"^#[xX][0-9a-fA-F]{1,6}$"), F.conv(F.substring(name, 3, 9), 16, 10).cast("long")
        )
        fits = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        char = F.when(number == 160, " ").when(fits, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        said = F.coalesce(char, F.try_element_at(names, name))
        return F.when(said.isNotNull(), F.concat(said, F.substr(piece, F.length(name) + 3))).otherwise(piece)

    pieces = F.split(text, "(?=&)")
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, decoded), "")).otherwise(text)


def without_junk(html: Column) -> Column:
    """Drop comments and whole script/style/nav/footer blocks (a script may hold a ``</p>``)."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->", " ")
    for tag in JUNK_BLOCKS:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return out


def plain_text(fragment: Column) -> Column:
    """Tags to spaces, entities unescaped, whitespace squeezed."""
    bare = unescaped(F.regexp_replace(fragment, r"(?s)<[^>]*>", " "))
    return F.trim(F.regexp_replace(bare, r"[ \t\n\r\f]+", " "))


def container(html: Column, tag: str = "article") -> Column:
    return F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)


def paragraphs(html: Column) -> Column:
    """Text of every paragraph. A paragraph ends at ``</p>`` or where the next one starts,
    so an unclosed ``<p>`` keeps its text."""
    pieces = F.slice(F.split(html, r"(?i)<p\b[^>]*>"), 2, 2_000_000_000)
    bodies = F.transform(pieces, lambda p: plain_text(F.element_at(F.split(p, r"(?i)</p\s*>"), 1)))
    return F.filter(bodies, lambda p: p != "")


def joined_paragraphs(html: Column) -> Column:
    return F.array_join(paragraphs(html), "\n")


def ld_article_body(html: Column) -> Column:
    """``articleBody`` of the first JSON-LD script, if any."""
    script = F.regexp_extract(html, r"""(?is)<script[^>]*\btype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script>""", 1)
    return F.nullif(F.trim(F.get_json_object(F.nullif(script, F.lit("")), "$.articleBody")), F.lit(""))


def meta_content(html: Column, attribute: str, value: str) -> Column:
    tag = rf"""(?is)<meta\b[^>]*\b{attribute}\s*=\s*["']?{value}["']?(?=[\s/>])[^>]*>"""
    return F.nullif(F.regexp_extract(F.regexp_extract(html, tag, 0), r"""(?is)\bcontent\s*=\s*(["']?)(.*?)\1(?=[\s/>])""", 2), F.lit(""))


def looks_like_article(html: Column, text: Column) -> Column:
    """Length and long-line test; pages with a publish-time or og article mark need less."""
    marked = (
        meta_content(html, "property", "article:published_time").isNotNull()
        | meta_content(html, "name", "publication_date").isNotNull()
        | F.coalesce(F.lower(meta_content(html, "property", "og:type")).contains("article"), F.lit(False))
    )
    long_lines = F.size(F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 80))
    size = F.length(text)
    enough = ((size >= 300) & (long_lines >= 2)) & marked | ((size >= 500) & (long_lines >= 3)) & ~marked
    return F.coalesce(enough, F.lit(False))


def published_text(html: Column, scraped_at: Column | None = None) -> Column:
    """Publish-time text: meta tags, ``<time>``, a visible "Updated ..." text, other meta tags,
    then the scrape time when given."""

    def stamp(c: Column) -> Column:
        return F.replace(F.substring(c, 1, 19), F.lit("T"), F.lit(" "))

    clean = F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script\s*>", " ")
    time_tag = F.regexp_extract(clean, r"(?is)<time\b[^>]*>(.*?)</time>", 0)
    visible = F.trim(F.regexp_extract(clean, r"(?i)>([^<]*Updated[ \t]*[:\-][ \t]*\w+[^<]*)<", 1))
    steps = [
        stamp(meta_content(clean, "property", "article:published_time")),
        stamp(meta_content(clean, "name", "publication_date")),
        stamp(F.nullif(F.regexp_extract(time_tag, r"""(?is)\bdatetime\s*=\s*(["']?)(.*?)\1(?=[\s>])""", 2), F.lit(""))),
        F.nullif(plain_text(time_tag), F.lit("")),
        F.nullif(visible, F.lit("")),
        meta_content(clean, "name", "pubdate"),
        meta_content(clean, "name", "PublishDate"),
        meta_content(clean, "name", "DC.date.issued"),
    ]
    return F.coalesce(*steps, *([scraped_at] if scraped_at is not None else []))


# --- lines ---------------------------------------------------------------------------------

NAMES = r"(?:\s+[A-Z][a-z]+)*"  # of a by-line in ``fixed.AD_LINES``


def trimmed_lines(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\r\f")))
    return F.filter(lines, lambda x: x != "")


def alternation(patterns: Sequence[str]) -> str:
    """One pattern for many; a leading case flag becomes a flagged group.

    Patterns that start at the line start share one anchor, so at any other position the
    search gives up after a single test.
    """
    anchored, free = [], []
    for p in patterns:
        flag, body = ("?i:", p[4:]) if p.startswith("(?i)") else ("?:", p)
        if body.startswith("^"):
            anchored.append(f"({flag}{body[1:]})")
        else:
            free.append(f"({flag}{body})")
    groups = ([f"^(?:{'|'.join(anchored)})"] if anchored else []) + free
    return "|".join(groups)


def strip_lines(text: Column, patterns: Sequence[str]) -> Column:
    """Trimmed non-empty lines that match none of the patterns."""
    rx = alternation(patterns)
    return F.array_join(F.filter(trimmed_lines(text), lambda x: ~x.rlike(rx)), "\n")


def cleaned_body(text: Column, source: Column, lines: Mapping[str, Sequence[str]] | None = None) -> Column:
    """The text without the lines that its own site adds; texts of other sites keep all lines.

    ``lines``: patterns by site that stand in place of the known sites' own rules.
    """
    if lines is None:
        cleaned = {fixed.AD_SITE: without_ad_lines(text)} | {s: strip_lines(text, p) for s, p in fixed.SITE_LINES.items()}
    else:
        cleaned = {s: strip_lines(text, p) for s, p in lines.items()}
    out = text
    for site, own in cleaned.items():
        out = F.when(source == site, own).otherwise(out)
    return out


def looped(rx: str) -> str:
    """The pattern with a possessive run of names, which Java walks in a loop and RE2 does not know.

    Java walks the plain run by recursion, some calls for every name; a by-line of two thousand words overflows the stack,
    which ends the executor. The run finds the same: blanks and letters exclude each other, so giving names back never helps.
    """
    return rx.replace(NAMES, f"{NAMES}+")


def is_ad_line(line: Column, phrases: Sequence[str] = fixed.AD_PHRASES) -> Column:
    """Advert or navigation: a phrase, a pattern, a listing title, or a long line with few spaces."""
    phrase = F.lit(False)
    for p in phrases:
        phrase = phrase | line.contains(p)
    spaces = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    return (
        phrase
        | line.rlike(looped(alternation((*fixed.AD_LINES, fixed.AD_LISTING_LINE))))
        | ((F.length(line) > fixed.AD_LONG_LINE) & (spaces < fixed.AD_FEW_SPACES))
    )


def without_ad_lines(text: Column, phrases: Sequence[str] = fixed.AD_PHRASES) -> Column:
    return F.array_join(F.filter(trimmed_lines(text), lambda x: ~is_ad_line(x, phrases)), "\n")


def cleaned_headline(headline: Column) -> Column:
    """Without a leading category and time stamp."""
    names = "|".join(c.replace("-", r"\-") for c in fixed.HEADLINE_CATEGORIES)
    out = F.regexp_replace(headline, rf"(?i)^({names})\s*{fixed.HEADLINE_STAMP}", "")
    return F.trim(F.regexp_replace(out, rf"(?i)^{fixed.HEADLINE_STAMP}", ""))


def cleaned_synopsis(text: Column) -> Column:
    squeezed = F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))
    return F.coalesce(F.trim(F.regexp_replace(squeezed, fixed.SYNOPSIS_CUT, "")), F.lit(""))


def link_title_ok(title: Column, min_length: int = 20) -> Column:
    starts = F.lit(False)
    for word in fixed.LINK_TITLE_REJECT:
        starts = starts | F.lower(title).startswith(word)
    return (F.length(title) > min_length) & ~starts
