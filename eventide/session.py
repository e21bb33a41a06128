"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on. The zone is pinned because bar times are
# zone-less wall-clock values; AQE coalesces small shuffles and splits skewed joins.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM never compiles a method of more than 8,000 bytes; Spark then had better not fuse the stage into one.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for name, value in RUNTIME.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def local_session(cores: int | str = "*", app: str = "eventide", **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        # Call-site capture costs about a millisecond per column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for name, value in {**RUNTIME, **conf}.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for tables that cut lineage or feed a stream sink.

    It lies under ``spark.checkpoint.dir``, or else in the warehouse, which all executors share too.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    base = base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for per-row CPU work on a table stored in fewer splits than cores.

    A table with enough splits is returned as it is, so large inputs gain no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, *keys: str, each: int = 4) -> DataFrame:
    """Deal narrow rows out, by ``keys`` or in turn, to ``each`` tasks a core: for costly work on few bytes a row.

    How a table is stored does not say how its rows lie: one row group is one task's, whatever the number of splits.
    """
    return df.repartition(each * df.sparkSession.sparkContext.defaultParallelism, *keys)


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared scratch folder and read back: for inputs of iterative fits."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
