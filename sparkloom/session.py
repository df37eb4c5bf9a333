"""Session settings that suit both a laptop and a large cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at every size; a cluster's own submit-time settings win where they are given first.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, memory: str = "8g", app: str = "sparkloom") -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", memory)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(cores)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: in the one that spark.checkpoint.dir names, else a temporary one, on a local master alone."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty() and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sparkloom-") if held.isEmpty() else held.get()
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, so that plans that use them several times read them in place of making them again. It goes with the JVM."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(rows: DataFrame) -> DataFrame:
    """The rows as the side of a join that is to be sorted and merged. Spark sends a side to all executors where it thinks it small, by the bytes of packed files; a side that grows with the input is ten times that and more in memory by then, and made by one thread."""
    return rows.hint("merge")


#: Rows that a task takes where it holds them at once, to sort or to gather them.
TASK_ROWS = 250_000


def parts_of(rows: DataFrame, most: int = TASK_ROWS) -> int:
    """How many parts hold about `most` rows each. The number goes with the input, where settings of a session leave it or let parts grow; rows of a file are counted without being read."""
    return max(1, -(-rows.count() // most))


#: Rows that a task takes where Python reads each: a file of short rows is one split, whatever their number.
PARSED_ROWS = 10_000


def spread(rows: DataFrame, key: str, most: int = PARSED_ROWS) -> DataFrame:
    """The rows dealt by a key to as many tasks as there are times `most` rows, for a step that costs far more than reading them."""
    return rows.repartition(parts_of(rows, most), key)
