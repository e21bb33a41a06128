import datetime as dt
import json
import struct

from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.sources import readers, tables

SCHEMA = T.StructType().add("article_id", "string").add("headline", "string").add("score", "double")


def test_json_arrays(spark, tmp_path):
    files = {
        "a.json": json.dumps([{"article_id": "1", "headline": "x", "score": 1.5}, {"article_id": "2"}]),
        "b.json": "[]",
        "c.json": json.dumps({"article_id": "3", "other": 1}),
        "d.json": "[{broken",
    }
    for n, text in files.items():
        (tmp_path / n).write_text(text)
    rows, bad = readers.json_arrays(spark, str(tmp_path), SCHEMA)
    assert sorted(r.article_id for r in rows.collect()) == ["1", "2", "3"]
    assert [r.file.rsplit("/", 1)[1] for r in bad.collect()] == ["d.json"]


def test_missing_table_is_empty(spark, tmp_path):
    assert readers.table_or_empty(spark, str(tmp_path / "none"), SCHEMA).count() == 0
    tables.overwrite(spark.createDataFrame([("1", "x", 1.0)], SCHEMA), str(tmp_path / "t"))
    assert readers.table_or_empty(spark, str(tmp_path / "t"), SCHEMA).count() == 1


def test_symbol_mapping(spark, tmp_path):
    path = tmp_path / "map.csv"
    path.write_text("SECURITY_ID,TICKER,Company Name\n10, abc ,Old Ltd.\n11,ABC,New & Co.\n12,,None\n13,xyz,X-Y Z\n")
    raw = readers.csv_table(spark, str(path))
    got = {r.symbol: (r.company_name, r.loose_name) for r in readers.symbol_mapping(raw).collect()}
    assert got == {"ABC": ("New & Co.", "new  co"), "XYZ": ("X-Y Z", "xy z")}
    ticks = spark.createDataFrame([("10",), ("99",)], "secid string")
    named = readers.security_names(ticks, raw.withColumnRenamed("Company Name", "CompanyName"))
    assert {r.secid: r.symbol for r in named.collect()} == {"10": "Old Ltd.", "99": "99"}


def test_bar_files_and_sink(spark, tmp_path):
    folder = tmp_path / "in" / "A B Ltd"
    folder.mkdir(parents=True)
    (folder / "A B Ltd 23-01-2026.csv").write_text(
        "timestamp,open,high,low,close,volume,hv,iv\n2026-01-23 09:15:00,1.00,2.00,0.50,1.50,10,0.1234,0.0000\n"
    )
    bars = readers.bar_files(spark, str(tmp_path / "in" / "*"))
    r = bars.first()
    assert (r.symbol, r.trade_date, r.ts) == ("A B Ltd", dt.date(2026, 1, 23), dt.datetime(2026, 1, 23, 9, 15))
    tables.write_bars(bars.withColumn("close", F.lit(1.23456)).withColumn("hv", F.lit(0.98765)), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).first()
    assert (back.close, back.hv) == (1.23, 0.9877)
    plan = spark.read.parquet(str(tmp_path / "out")).filter("trade_date = date'2026-01-23'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(trade_date" in plan


def packet(secid, price, qty, t, head=8, size=62):
    body = bytes([head]) + b"\0" * 3 + struct.pack("<IfHI", secid, price, qty, t)
    return bytearray(body.ljust(size, b"\0"))


def test_packets(spark):
    rows = [(1, packet(500, 12.5, 65535, 1_700_000_000)), (2, packet(1, 1.0, 1, 1, head=9)), (3, packet(1, 1.0, 1, 1, size=40)), (4, packet(7, 0.25, 0, 5, size=100))]
    df = spark.createDataFrame(rows, "n int, value binary")
    got = [tuple(r) for r in readers.decode_packets(df).orderBy("n").collect()]
    assert got == [(1, "500", 12.5, 65535, 1_700_000_000), (4, "7", 0.25, 0, 5)]
    assert {r.status: r.n for r in readers.packet_counts(df).collect()} == {"processed": 2, "wrong_header": 1, "too_short": 1}


def test_newer_table(spark):
    night = spark.createDataFrame([("n", "2026-01-02 10:00:00 IST")], "id string, predicted_at string")
    day = spark.createDataFrame([("d", "2026-01-03 10:00:00 IST")], night.schema)
    assert [r.id for r in readers.newer_table(night, day).collect()] == ["d"]
    assert [r.id for r in readers.newer_table(night, day.limit(0)).collect()] == ["n"]
    assert [r.id for r in readers.newer_table(night.limit(0), day).collect()] == ["d"]
