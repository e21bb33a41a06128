"""Registered queries of the corpus operators, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm import ann, bpe, chain, chat, collocations, jaccard_join, line_dedup, mixing, pages, pii, span_dedup, token_align, topk
from eventide.llm.common import table, written

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY, PIECE_MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the probabilities of the chain and the decision ``toxic``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = chain.judge(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", *[f"p_{c}" for c in chain.CATEGORIES], F.col("rejected").alias("toxic"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = span_dedup.dedup_spans(docs)
    return out.select("doc_id", *span_dedup.RESULTS, F.sha2("text", 256).alias("kept_sha256"))


CONFLICT = "\\### Assistant: </turn> ok"  # the text of both turns of conversation -7


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONFLICT).alias("text"),
    )
    out = chat.read_back(chat.format_turns(turns.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.bpe(docs, VOCABULARY)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "mix-sizes")
    rows, pieces = mixing.draws(sized, F.col("size"))
    taken = pieces.groupBy("_src", "_start").agg(F.sum(F.col("to") - F.col("from")).alias("words"), F.count_distinct("shard").alias("n_shards"))
    # A document without words shares its place with the next one and has no pieces.
    words = F.when(F.col("_size") > 0, F.col("words"))
    return rows.join(taken, ["_src", "_start"], "left").select(
        "doc_id", "size", F.col("_total").alias("source_size"), F.col("_target").alias("target"),
        F.coalesce(words, F.lit(0)).cast("long").alias("taken"),
        F.when(F.col("_size") > 0, F.coalesce("n_shards", F.lit(0))).otherwise(0).cast("long").alias("n_shards"),
    )


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_align.align(docs, BYTE_VOCABULARY, PIECE_MODEL, public_tokenizers.PATTERN)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def spans_of(kind: str):
        # The function takes one parameter: a second one, even with a default, would be the span's place in the array.
        return F.size(F.filter("base", lambda s: s["kind"] == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    counts = [spans_of(kind) for kind in pii.KINDS[:pii.TERM]]
    return found.select("doc_id", *counts, "base_sha256", "spans", F.size("terms").cast("long").alias("n_terms"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""

# formatted_chars: "### ", ": ", " </turn>" and a line end around each turn, and one more character
# (codes minus plain) per escaped string.
CHAT_SQL = """
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\\### Assistant: </turn> ok' FROM range(2) t(i)),
sized AS (SELECT *, CASE WHEN contains(text, '###') OR contains(text, '</turn>') OR contains(text, '\\e') OR contains(text, '\\h') OR contains(text, '\\t')
    THEN length(replace(replace(replace(text, '\\', '\\e'), '###', '\\h'), '</turn>', '\\t')) ELSE length(text) END AS shown FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + shown + 9) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""

LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
again AS (SELECT key, min(doc_id) AS first_id FROM lines WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
marked AS (SELECT l.*, a.key IS NOT NULL AND l.doc_id <> a.first_id AS gone FROM lines l LEFT JOIN again a USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


# Phrases as lists of words; the parts of a candidate reach the threshold as often as it does.
COLLOCATIONS_SQL = r"""
WITH pieces AS (SELECT lang, list_filter(string_split(piece, ' '), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?' || chr(11) || chr(12) || chr(13) || chr(9),
      'abcdefghijklmnopqrstuvwxyz' || repeat(chr(10), 9) || ' '), chr(10))) AS piece FROM documents)),
grams AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= 30),
cuts AS (SELECT c.lang, c.m, c.phrase, c.a, k, array_to_string(c.w[1 : k], ' ') AS first, array_to_string(c.w[k + 1 : c.m], ' ') AS rest
  FROM cand c, (SELECT unnest([1, 2, 3]) AS k) WHERE k < c.m),
scored AS (SELECT c.lang, c.m, c.phrase, c.a, c.k, x.a AS l, y.a AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (x.a + y.a) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first AND x.m = c.k JOIN f y ON y.lang = c.lang AND y.phrase = c.rest AND y.m = c.m - c.k),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, part, max(a) AS longer FROM (SELECT lang, a, unnest(list_concat(
    [array_to_string(w[i : i + 1], ' ') for i in range(1, m)],
    CASE WHEN m = 4 THEN [array_to_string(w[i : i + 2], ' ') for i in range(1, 3)] ELSE [] END)) AS part FROM cand WHERE m > 2) GROUP BY lang, part),
kept AS (SELECT s.* FROM least s LEFT JOIN inside i ON i.lang = s.lang AND i.part = s.phrase
  WHERE i.part IS NULL OR 100 * CAST(i.longer AS HUGEINT) < 80 * CAST(s.a AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""


def queries() -> dict:
    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": LINES_SQL, "op4_chat_format": CHAT_SQL, "op10_exact_top_k": TOP_K_SQL, "op13_collocations": COLLOCATIONS_SQL}
