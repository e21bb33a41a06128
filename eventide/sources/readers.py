"""Readers for JSON-array files, mapping and bar CSVs, packets and stored tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.functions.scalars import loose_name


CORRUPT = "__corrupt"


def json_arrays(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, unreadable) of a folder of JSON files holding an array or one object each.

    An empty array gives no rows. A file that cannot be read gives no rows either; it is
    listed by path in ``unreadable`` and never stops the others. Files are parsed as streams, record by record.
    """
    held = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    read = spark.read.schema(held).option("multiLine", True).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    # A record with a field of another type keeps its other fields; a file that is no JSON has none.
    blank = F.coalesce(*[F.col(f"`{f}`").cast("string") for f in schema.fieldNames()]).isNull()
    broken = F.col(CORRUPT).isNotNull() & blank
    file = F.col("_metadata.file_path").alias("file")
    return read.filter(~broken).drop(CORRUPT), read.filter(broken).select(file).distinct()


def table_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, or an empty one when the path does not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def pick_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """The first candidate present in any letter case."""
    held = {c.lower(): c for c in df.columns}
    return next((held[c.lower()] for c in candidates if c.lower() in held), None)


SYMBOL_COLUMNS = ("Symbol", "SYMBOL", "Ticker", "Entity")
NAME_COLUMNS = ("CompanyName", "Company Name", "Company", "Name")


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A headed CSV as text columns with ``_row``, its order in the file."""
    return spark.read.option("header", True).csv(path).withColumn("_row", F.monotonically_increasing_id())


def symbol_mapping(raw: DataFrame) -> DataFrame:
    """symbol (trimmed, upper case) to company name and its loose form; the last row of a symbol wins."""
    symbol, name = pick_column(raw, SYMBOL_COLUMNS), pick_column(raw, NAME_COLUMNS)
    if not symbol or not name:
        raise ValueError(f"mapping needs a symbol and a company name column, found {raw.columns}")
    rows = raw.select(
        F.upper(F.trim(symbol)).alias("symbol"), F.trim(name).alias("company_name"), F.col("_row")
    ).filter(F.coalesce("symbol", F.lit("")) != "")
    rank = F.row_number().over(W.partitionBy("symbol").orderBy(F.col("_row").desc()))
    last = rows.withColumn("__r", rank).filter("__r = 1").drop("__r", "_row")
    return last.withColumn("loose_name", loose_name(F.col("company_name")))


def security_names(ticks: DataFrame, mapping: DataFrame, secid: str = "secid") -> DataFrame:
    """Add the company name of a security id; an unknown id stands for itself.

    ``mapping`` has SECURITY_ID and CompanyName. No side is forced to broadcast: Spark
    does so by size.
    """
    names = mapping.select(F.col("SECURITY_ID").cast("string").alias(secid), F.col("CompanyName").alias("__n"))
    names = names.dropDuplicates([secid])
    return ticks.join(names, secid, "left").withColumn("symbol", F.coalesce("__n", secid)).drop("__n")


BAR_SCHEMA = "timestamp string, open double, high double, low double, close double, volume bigint, hv double, iv double"


def bar_files(spark: SparkSession, path: str) -> DataFrame:
    """Bars of files named ``<company>/<company> DD-MM-YYYY.csv``; company and day come from the path."""
    name = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    stem = F.regexp_extract(name, r"([^/]+) (\d{2}-\d{2}-\d{4})\.csv$", 1)
    day = F.regexp_extract(name, r" (\d{2}-\d{2}-\d{4})\.csv$", 1)
    rows = spark.read.option("header", True).schema(BAR_SCHEMA).csv(path).select("*", stem.alias("symbol"), day.alias("__d"))
    return rows.select(
        "symbol",
        F.to_date("__d", "dd-MM-yyyy").alias("trade_date"),
        F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("ts"),
        "open",
        "high",
        "low",
        "close",
        "volume",
        "hv",
        "iv",
    )


PACKET_BYTES, PACKET_HEADER = 62, 8


def packet_status(value: Column) -> Column:
    """too_short, wrong_header or processed."""
    first = F.conv(F.hex(F.substring(value, 1, 1)), 16, 10).cast("int")
    return (
        F.when(F.length(value) < PACKET_BYTES, "too_short")
        .when(first != PACKET_HEADER, "wrong_header")
        .otherwise("processed")
    )


TICK_FIELDS = (
    T.StructType().add("secid", "string").add("ltp", "double").add("ltq", "integer").add("ltt", "long")
)


@F.pandas_udf(TICK_FIELDS)
def _unpack(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    import numpy as np

    # Fixed layout, little endian: id u32 at 4, price f32 at 8, quantity u16 at 12, time u32 at 14.
    layout = np.dtype(
        {"names": ["id", "p", "q", "t"], "formats": ["<u4", "<f4", "<u2", "<u4"], "offsets": [4, 8, 12, 14], "itemsize": 18}
    )
    for batch in values:
        block = np.frombuffer(b"".join(bytes(v[:18]) for v in batch), dtype=layout)
        yield pd.DataFrame(
            {
                "secid": block["id"].astype(str),
                "ltp": block["p"].astype("float64"),
                "ltq": block["q"].astype("int32"),
                "ltt": block["t"].astype("int64"),
            }
        )


def decode_packets(packets: DataFrame, value: str = "value") -> DataFrame:
    """Binary tick packets to typed ticks; malformed ones are left out (count them with
    ``packet_counts``). Works on batch and streaming frames."""
    good = packets.filter(packet_status(F.col(value)) == "processed")
    return good.withColumn("__t", _unpack(F.col(value))).select(*[c for c in packets.columns if c != value], "__t.*")


def packet_counts(packets: DataFrame, value: str = "value") -> DataFrame:
    return packets.groupBy(packet_status(F.col(value)).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def newer_table(night: DataFrame, regular: DataFrame, at: str = "predicted_at") -> DataFrame:
    """The off-hours table when it has rows and its latest time is later, else the regular one."""
    n, r = (t.agg(F.max(at)).scalar() for t in (night, regular))
    use_night = n.isNotNull() & (r.isNull() | (n > r))
    every = night.withColumn("is_overnight", F.lit(True)).unionByName(
        regular.withColumn("is_overnight", F.lit(False)), allowMissingColumns=True
    )
    return every.filter(F.col("is_overnight") == F.coalesce(use_night, F.lit(False)))
