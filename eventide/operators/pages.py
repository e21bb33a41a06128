"""Raw pages to links and articles, as one job over a ``pages`` table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide.functions import pagetext as P

# The value of href with or without quotes (group 2), and the content (group 3).
ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(["']?)(.*?)\1(?=[\s>])[^>]*>(.*?)</a>"""


def page_links(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_title: int = 0,
    limit: int | None = None,
    keep: Column | None = None,
) -> DataFrame:
    """Anchors with absolute link and title, the first one per link and page, in page order.

    ``keep`` is a predicate on ``link`` and ``title``. ``limit`` is the articles-per-page
    feature of an index page; without it every link is returned. The exchange carries
    links and titles, never the page.
    """
    hrefs = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2))
    titles = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(3))
    rows = pages.select(
        key,
        F.posexplode(
            F.transform(
                F.arrays_zip(hrefs.alias("h"), titles.alias("t")),
                lambda a: F.struct(
                    P.absolute_url(F.trim(a["h"]), F.col(url)).alias("link"), P.plain_text(a["t"]).alias("title")
                ),
            )
        ).alias("pos", "a"),
    ).select(key, "pos", "a.link", "a.title")
    rows = rows.filter(F.col("link").isNotNull() & (F.length("title") > min_title))
    if keep is not None:
        rows = rows.filter(keep)
    first = rows.groupBy(key, "link").agg(F.min("pos").alias("pos"), F.min_by("title", "pos").alias("title"))
    if limit is not None:
        rank = F.row_number().over(W.partitionBy(key).orderBy("pos"))
        first = first.withColumn("__r", rank).filter(F.col("__r") <= limit).drop("__r")
    return first.select(key, "pos", "link", "title")


def with_text(pages: DataFrame, html: str = "html", min_length: int = 100) -> DataFrame:
    """Add ``headline`` and ``content``: JSON-LD text, else the paragraphs of the article
    container when they are long enough, else those of the whole page, else null.

    Each step is a column of its own, so that the page is stripped once per row.
    """
    return (
        pages.withColumn("__clean", P.without_junk(F.col(html)))
        .withColumn("__own", P.joined_paragraphs(P.container(F.col("__clean"))))
        .withColumn("__ld", P.ld_article_body(F.col(html)))
        .withColumn(
            "__all",
            F.when(
                F.col("__ld").isNull() & (F.length("__own") <= min_length), P.joined_paragraphs(F.col("__clean"))
            ),
        )
        .withColumns(
            {
                "headline": P.cleaned_headline(P.plain_text(P.container(F.col("__clean"), "h1"))),
                "content": F.coalesce(
                    "__ld",
                    F.when(F.length("__own") > min_length, F.col("__own")),
                    F.when(F.length("__all") >= min_length, F.col("__all")),
                ),
            }
        )
        .drop("__clean", "__own", "__ld", "__all")
    )


def articles(
    pages: DataFrame,
    source: Column,
    scraped_at: Column,
    min_length: int = 100,
    verify: bool = False,
    url: str = "url",
    html: str = "html",
    lines: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Pages to article rows; a page without enough text gives no row.

    ``verify`` also drops listing pages. ``lines``: as in ``cleaned_body``.
    """
    page = F.col(html)
    rows = with_text(pages.withColumn("source", source), html, min_length)
    # A generator of one row keeps the filters below from being pushed into the texts' expressions, which
    # would strip every page again for each of them.
    other = [c for c in rows.columns if c not in ("headline", "content")]
    rows = rows.select(*other, F.stack(F.lit(1), "headline", "content").alias("headline", "content"))
    rows = rows.filter(F.col("content").isNotNull())
    if verify:
        rows = rows.filter(P.looks_like_article(page, F.col("content")))
    scraped = F.date_format(scraped_at, "yyyy-MM-dd HH:mm:ss")
    return rows.select(
        P.article_id_by_source(F.col(url), F.col("source")).alias("article_id"),
        "headline",
        P.cleaned_body(F.col("content"), F.col("source"), lines).alias("content"),
        F.col(url),
        P.published_text(page, scraped).alias("published_time"),
        scraped.alias("scraped_at"),
        "source",
    )


def published_on(articles_df: DataFrame, local_time: Column, day: str) -> DataFrame:
    """Articles published on one exchange-local date."""
    return articles_df.filter(F.to_date(local_time) == F.lit(day).cast("date"))
