"""Keyed-state queries: dedup, append, upsert, lookup, repair, views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators import labels, state
from eventide.plans import Tables, query
from eventide.session import scratch
from eventide.sources.tables import KeyedTable


@query(
    """WITH d AS (SELECT doc_id, source, md5(text) AS text_id FROM documents)
    SELECT 'text' AS rule, text_id, CAST(NULL AS VARCHAR) AS source, min(doc_id) AS doc_id FROM d GROUP BY text_id
    UNION ALL SELECT 'text and source', text_id, source, min(doc_id) FROM d GROUP BY text_id, source"""
)
def dedup_first(t: Tables) -> DataFrame:
    """First document per text, and per (text, source)."""
    d = t.documents.select("doc_id", "source", F.md5("text").alias("text_id"))
    one = state.first_per_key(d, ["text_id"], ["doc_id"])
    two = state.first_per_key(d, ["text_id", "source"], ["doc_id"])
    none = F.lit(None).cast("string").alias("source")
    return one.select(F.lit("text").alias("rule"), "text_id", none, "doc_id").unionByName(
        two.select(F.lit("text and source").alias("rule"), "text_id", "source", "doc_id")
    )


# Shipments before 1997 are the target, those from 1996 on the batch; the year both hold overlaps.
_LINES_SQL = """held AS (SELECT l_partkey, CASE WHEN l_returnflag <> 'N' THEN l_suppkey END AS supp
  FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01'),
batch AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice, l_partkey,
    CASE WHEN l_returnflag <> 'N' THEN l_suppkey END AS supp
  FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01'),
fresh AS (SELECT * FROM batch b WHERE NOT EXISTS (
  SELECT 1 FROM held h WHERE h.l_partkey = b.l_partkey AND h.supp IS NOT DISTINCT FROM b.supp))"""


def _lines(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_shipdate",
        "l_extendedprice",
        "l_partkey",
        F.when(F.col("l_returnflag") != "N", F.col("l_suppkey")).alias("supp"),
    )
    held = rows.filter(F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    batch = rows.filter(F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    return held, batch


@query(f"WITH {_LINES_SQL} SELECT l_orderkey, l_linenumber, l_partkey, supp, l_extendedprice FROM fresh")
def append_unseen(t: Tables) -> DataFrame:
    """Null-safe anti-join append that keeps duplicates inside the batch."""
    held, batch = _lines(t)
    fresh = state.unseen(batch, held, ["l_partkey", "supp"])
    return fresh.select("l_orderkey", "l_linenumber", "l_partkey", "supp", "l_extendedprice")


@query(
    f"""WITH {_LINES_SQL}
    SELECT l_partkey, supp, min((l_shipdate, l_orderkey, l_linenumber))[2] AS l_orderkey FROM fresh
    GROUP BY l_partkey, supp"""
)
def append_unseen_once(t: Tables) -> DataFrame:
    """The same append with one row per key inside the batch."""
    held, batch = _lines(t)
    order = ["l_shipdate", "l_orderkey", "l_linenumber"]
    return state.unseen(batch, held, ["l_partkey", "supp"], order).select("l_partkey", "supp", "l_orderkey")


# A url known from one order and an id known from another must not count as one known row.
_KNOWN_SQL = """o AS (SELECT o_orderkey, o_custkey AS article_id, o_orderdate,
    o_orderpriority || '/' || strftime(o_orderdate, '%Y-%m-%d') AS url FROM orders),
held AS (SELECT * FROM o WHERE o_orderdate < TIMESTAMP '1997-01-01'),
flags AS (SELECT o_orderkey, url IN (SELECT url FROM held) AS url_known,
    article_id IN (SELECT article_id FROM held) AS id_known
  FROM o WHERE o_orderdate >= TIMESTAMP '1996-01-01')"""


@query(
    f"""WITH {_KNOWN_SQL}
    SELECT 'and' AS rule, o_orderkey, url_known, id_known FROM flags WHERE NOT (url_known AND id_known)
    UNION ALL SELECT 'or', o_orderkey, url_known, id_known FROM flags WHERE NOT (url_known OR id_known)"""
)
def dedup_and_or_rules(t: Tables) -> DataFrame:
    rows = t.orders.select(
        "o_orderkey",
        F.col("o_custkey").alias("article_id"),
        "o_orderdate",
        F.concat_ws("/", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("url"),
    )
    held = rows.filter(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    batch = rows.filter(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    flags = state.known_flags(batch, held, ["url", "article_id"])
    u, i = F.col("url_known"), F.col("article_id_known")
    rules = F.array(
        F.struct(F.lit("and").alias("rule"), (~(u & i)).alias("keep")),
        F.struct(F.lit("or").alias("rule"), (~(u | i)).alias("keep")),
    )
    return (
        flags.select("o_orderkey", "url_known", i.alias("id_known"), F.explode(rules).alias("r"))
        .filter("r.keep")
        .select("r.rule", "o_orderkey", "url_known", "id_known")
    )


@query(
    """WITH old AS (
      SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey,
        arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice,
        arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS o_orderpriority
      FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY o_custkey),
    new AS (
      SELECT o_custkey, max((o_orderdate, o_orderkey)) AS top FROM orders
      WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY o_custkey),
    picked AS (
      SELECT n.o_custkey, o.o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice, o_orderstatus
      FROM new n JOIN orders o ON o.o_orderkey = n.top[2])
    SELECT coalesce(p.o_custkey, old.o_custkey) AS o_custkey,
      CASE WHEN p.o_custkey IS NOT NULL THEN p.o_orderkey ELSE old.o_orderkey END AS o_orderkey,
      CASE WHEN p.o_custkey IS NOT NULL THEN p.o_totalprice ELSE old.o_totalprice END AS o_totalprice,
      old.o_orderpriority, p.o_orderstatus,
      CASE WHEN p.o_custkey IS NULL THEN 'keep' WHEN old.o_custkey IS NULL THEN 'insert' ELSE 'update' END AS change
    FROM old FULL JOIN picked p ON old.o_custkey = p.o_custkey"""
)
def upsert_merge(t: Tables) -> DataFrame:
    """Last order per customer before 1998, updated by the last one since; every order is on one side.

    The batch has no priority column (kept), a new status column (added) and null prices
    (which overwrite).
    """
    newest = [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]
    old = state.first_per_key(
        t.orders.filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")), ["o_custkey"], newest
    ).select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    batch = t.orders.filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select(
        "o_custkey",
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderstatus",
        "o_orderdate",
    )
    out = state.upsert(old, batch, ["o_custkey"], newest)
    return out.drop("o_orderdate")


_RAW_SQL = """raw AS (
  SELECT text_id, arg_max(source, doc_id) AS source, arg_max(text, doc_id) AS content, max(doc_id) AS doc_id
  FROM (SELECT *, md5(text) AS text_id, CASE WHEN lang = 'en' THEN 0 WHEN lang = 'de' THEN 1 ELSE 2 END AS p FROM documents)
  WHERE (text_id, p) IN (SELECT md5(text), min(CASE WHEN lang = 'en' THEN 0 WHEN lang = 'de' THEN 1 ELSE 2 END)
                         FROM documents GROUP BY 1)
  GROUP BY text_id)"""


@query(
    f"""WITH {_RAW_SQL}, signals AS (
      SELECT doc_id, md5(text) AS text_id, CASE WHEN quality = 1 THEN source WHEN toxic = 1 THEN 'Unknown' END AS source,
        CASE WHEN toxic = 0 THEN text ELSE '' END AS full_content, split_part(text, chr(10), 1) AS condensed_text,
        CASE WHEN doc_id % 2 = 1 THEN 'http://x/' || doc_id END AS url
      FROM documents JOIN labels USING (doc_id))
    SELECT s.doc_id,
      CASE WHEN s.source IS NULL OR s.source = 'Unknown' THEN r.source ELSE s.source END AS source,
      md5(CASE WHEN s.full_content = '' OR s.full_content = s.condensed_text THEN r.content ELSE s.full_content END) AS content_id,
      CASE WHEN s.url IS NULL THEN 'http://raw/' || r.doc_id ELSE s.url END AS url,
      s.source IS NULL OR s.source = 'Unknown' OR s.full_content = '' OR s.full_content = s.condensed_text
        OR s.url IS NULL AS repaired
    FROM signals s JOIN raw r USING (text_id)"""
)
def priority_lookup_repair(t: Tables) -> DataFrame:
    """Raw articles by priority of language (last row per text inside one), used to repair signals."""
    docs = t.documents.withColumn("text_id", F.md5("text"))
    cols = [
        "text_id",
        "source",
        F.col("text").alias("content"),
        F.concat(F.lit("http://raw/"), F.col("doc_id").cast("string")).alias("url"),
        "doc_id",
    ]
    raw = state.priority_lookup(
        [
            docs.filter("lang = 'en'").select(*cols),
            docs.filter("lang = 'de'").select(*cols),
            docs.filter("lang not in ('en', 'de')").select(*cols),
        ],
        "text_id",
        "doc_id",
    )
    headline = F.substring_index("text", "\n", 1)
    signals = docs.join(t.labels, "doc_id").select(
        "doc_id",
        "text_id",
        F.when(F.col("quality") == 1, F.col("source")).when(F.col("toxic") == 1, "Unknown").alias("source"),
        F.when(F.col("toxic") == 0, F.col("text")).otherwise("").alias("full_content"),
        headline.alias("condensed_text"),
        F.when(F.pmod("doc_id", F.lit(2)) == 1, F.concat(F.lit("http://x/"), F.col("doc_id").cast("string"))).alias("url"),
    )
    out = state.repair(signals, raw, "text_id")
    return out.select("doc_id", "source", F.md5("full_content").alias("content_id"), "url", "repaired")


@query(
    """SELECT conv_id, turn, role, md5(text) AS text_id FROM conversations
    WHERE (conv_id, turn) IN (SELECT conv_id, max(turn) FROM conversations GROUP BY conv_id)"""
)
def latest_per_id_view(t: Tables) -> DataFrame:
    """Latest row per id."""
    out = state.first_per_key(t.conversations, ["conv_id"], [F.col("turn").desc()])
    return out.select("conv_id", "turn", "role", F.md5("text").alias("text_id"))


@query(
    """SELECT source, doc_id, n_chars FROM (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 30"""
)
def articles_per_source(t: Tables) -> DataFrame:
    """Thirty articles per source: the collector's limit."""
    return state.top_per_key(
        t.documents.select("source", "doc_id", "n_chars"), ["source"], [F.col("n_chars").desc(), "doc_id"], 30
    )


@query(
    """SELECT event_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct
    FROM events GROUP BY event_type"""
)
def class_share(t: Tables) -> DataFrame:
    return labels.class_share(t.events, "event_type")


_ENRICHED_SQL = """d AS (SELECT doc_id, md5(text) AS id, split_part(text, chr(10), 1) AS headline, CASE WHEN doc_id % 5 > 0 THEN source END AS source,
    lang, n_chars, text FROM documents),
s AS (SELECT * FROM d WHERE lang <> 'es' QUALIFY row_number() OVER (PARTITION BY id ORDER BY lang <> 'en', doc_id DESC) = 1),
r AS (SELECT * FROM d WHERE n_chars > 500 QUALIFY row_number() OVER (PARTITION BY id ORDER BY n_chars <= 2000, doc_id DESC) = 1)"""


@query(
    f"""WITH {_ENRICHED_SQL}
    SELECT l.doc_id, CASE WHEN s.id IS NOT NULL THEN md5(s.headline) ELSE md5('own ' || l.doc_id) END AS headline_id,
      CASE WHEN s.id IS NOT NULL THEN s.source WHEN r.id IS NOT NULL THEN r.source ELSE 'Unknown' END AS source,
      CASE WHEN s.id IS NOT NULL THEN s.lang ELSE '' END AS condensed_text,
      md5(CASE WHEN r.id IS NOT NULL THEN r.text WHEN s.id IS NOT NULL THEN s.lang ELSE '' END) AS content_id,
      CASE WHEN r.id IS NOT NULL THEN 'http://raw/' || r.doc_id ELSE '' END AS url
    FROM labels l JOIN d USING (doc_id) LEFT JOIN s ON s.id = d.id LEFT JOIN r ON r.id = d.id"""
)
def enriched_signals(t: Tables) -> DataFrame:
    """Signals with the texts of their articles: scored texts first in English, articles first the long ones."""
    docs = t.documents.select(
        "doc_id", F.md5("text").alias("article_id"), F.substring_index("text", "\n", 1).alias("headline"),
        F.when(F.col("doc_id") % 5 > 0, F.col("source")).alias("source"), F.col("lang").alias("condensed_text"),
        F.col("text").alias("content"), F.concat(F.lit("http://raw/"), F.col("doc_id").cast("string")).alias("url"), "n_chars",
    )
    sentiments = [docs.filter("condensed_text = 'en'"), docs.filter("condensed_text not in ('en', 'es')")]
    articles = [docs.filter("n_chars > 2000"), docs.filter("n_chars between 501 and 2000")]
    own = F.concat(F.lit("own "), F.col("doc_id").cast("string")).alias("headline")
    signals = docs.join(t.labels.select("doc_id"), "doc_id").select("doc_id", "article_id", own)
    out = state.enriched(signals, sentiments, articles, seq="doc_id")
    return out.select("doc_id", F.md5("headline").alias("headline_id"), "source", "condensed_text", F.md5("full_content").alias("content_id"), "url")


@query(
    """WITH o AS (SELECT *, CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 0 WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 1 ELSE 2 END AS b FROM orders),
    l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY b, o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
    SELECT o_custkey,
      CASE WHEN bool_or(b = 1) THEN max(CASE WHEN b = 1 AND o_orderstatus <> 'P' THEN o_totalprice END) ELSE max(CASE WHEN b = 0 THEN o_totalprice END) END AS price,
      CASE WHEN bool_or(b = 2) THEN max(CASE WHEN b = 2 THEN o_orderpriority END) ELSE max(CASE WHEN b = 0 THEN o_orderpriority END) END AS priority,
      max(CASE WHEN b = 1 THEN o_orderstatus END) AS status, max(b) AS batch
    FROM l GROUP BY o_custkey"""
)
def keyed_upsert_batches(t: Tables) -> DataFrame:
    """Three stored batches with different columns, a snapshot after two of them: each column from the newest batch that has it."""
    table = KeyedTable(t.spark, scratch(t.spark, "upserts"), ["o_custkey"])
    when = [F.lit(f"{y}-01-01").cast("timestamp_ntz") for y in (1995, 1997)]
    day, price, status = F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_orderstatus")
    newest = [day.desc(), F.col("o_orderkey").desc()]
    batches = [
        (day < when[0], [price.alias("price"), F.col("o_orderpriority").alias("priority")]),
        ((day >= when[0]) & (day < when[1]), [F.when(status != "P", price).alias("price"), status.alias("status")]),
        (day >= when[1], [F.col("o_orderpriority").alias("priority")]),
    ]
    for i, (test, columns) in enumerate(batches):
        last = state.first_per_key(t.orders.filter(test), ["o_custkey"], newest)
        table.upsert(last.select("o_custkey", *columns), i)
        if i == 1:
            table.snapshot()
    return table.latest().select("o_custkey", "price", "priority", "status", "batch")
