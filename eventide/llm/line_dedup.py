"""Line dedup: hash normalised lines, count the documents of each hash, drop repeats, reassemble.

Only ids and 128-bit line hashes are exploded and shuffled. The documents meet the list of
their own dropped hashes once, and each task rebuilds its texts line by line. Counting is a
hash aggregate with map-side partials, so a line that stands in a third of all documents
leaves one row per task; in the join back the busy hash is on the large side only, which an
AQE skew join splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.llm.common import BLANKS, as_bytes, digests, fresh, in_batches, with_column

RESULTS = ("n_lines", "n_dropped")


def line_key(line: bytes) -> bytes:
    """Stripped at both ends, A-Z lower-cased (``bytes.lower`` leaves all other characters)."""
    return line.strip(BLANKS).lower()


def long_enough(key: bytes, min_chars: int) -> bool:
    """At least so many code points: bytes that do not continue a character."""
    if len(key) < min_chars:
        return False
    return len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes] = []
            counts = np.zeros(batch.num_rows, dtype=np.int64)
            for i, text in enumerate(as_bytes(batch.column(1))):
                if text:
                    own = {k for k in map(line_key, text.split(b"\n")) if long_enough(k, min_chars)}
                    keys.extend(own)
                    counts[i] = len(own)
            if keys:
                h = digests(keys)
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), counts)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(h[:, 0]), pa.array(h[:, 1])], names=["_id", "_h1", "_h2"])

    return run


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """A row (_id, _h1, _h2) for every distinct line key of every document that has an id."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("_id", kind), T.StructField("_h1", T.LongType()), T.StructField("_h2", T.LongType())])
    rows = docs.select(id_col, text_col).where(F.col(id_col).isNotNull())
    return in_batches(rows, _hash_lines(min_chars), schema)


def repeated_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """Hashes that at least ``min_docs`` documents hold, with the smallest of their ids."""
    if min_docs <= 2:
        found = lines.groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"))
        return found.where("_first < _last").drop("_last")
    found = lines.groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"), F.count_distinct("_id").alias("_n"))
    return found.where(F.col("_n") >= min_docs).drop("_n")


def _reassemble(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drops = batch.column(batch.schema.get_field_index("_drop")).to_pylist()
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(as_bytes(batch.column(batch.schema.get_field_index(text_col))), drops):
                lines = (text or b"").split(b"\n")
                kept = lines
                if drop:
                    gone = {(d["_h1"], d["_h2"]) for d in drop}
                    held = map(tuple, digests([line_key(x) for x in lines]).tolist())
                    kept = [x for x, h in zip(lines, held) if h not in gone]
                texts.append(b"\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            out = batch.drop_columns(["_drop"])
            out = with_column(out, text_col, pa.array(texts, pa.binary()).cast(pa.string()))
            yield with_column(with_column(out, "n_lines", pa.array(n_lines, pa.int64())), "n_dropped", pa.array(n_dropped, pa.int64()))

    return run


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2
) -> DataFrame:
    """The documents with repeated lines removed, plus ``n_lines`` (before) and ``n_dropped``.

    A line counts by its key (stripped, A-Z lower-cased) if the key has at least ``min_chars``
    code points. A key that at least ``min_docs`` documents hold loses all its lines except in
    the smallest id that holds it, where repeats stay too. Other lines stay in order, joined by \\n.

    Null or empty text is one empty line and comes back as empty text. Rows with a null id take
    no part: nothing is counted or dropped in them. Rows that repeat an id are one document: a
    key only they hold stays in all of them. Other columns pass through; columns named
    ``n_lines`` or ``n_dropped`` are replaced. An empty table gives an empty table.
    """
    docs = fresh(docs, *RESULTS, "_drop", "_id")
    lines = line_hashes(docs, id_col, text_col, min_chars)
    hits = lines.join(repeated_lines(lines, min_docs), ["_h1", "_h2"]).where("_id <> _first")
    drops = hits.groupBy("_id").agg(F.collect_list(F.struct("_h1", "_h2")).alias("_drop"))
    joined = docs.join(drops, F.col(id_col) == F.col("_id"), "left").drop("_id")
    fields = [T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in docs.schema]
    schema = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return in_batches(joined, _reassemble(text_col), schema)
