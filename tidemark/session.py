"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(master: str = "local[*]", partitions: int = 8) -> SparkSession:
    """A session with UTC time, AQE and ANSI mode; a cluster brings its own master and partition count."""
    b = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    return b.config("spark.sql.ansi.enabled", "true").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.ui.enabled", "false").getOrCreate()


def _own(spark: SparkSession, prefix: str) -> str:
    """A temporary folder of this machine, for a local session only."""
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix=prefix)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint; a temporary folder only in a local session without spark.checkpoint.dir."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_own(spark, "spark-checkpoint-"))
    return df.checkpoint(eager=True)


#: Rows that one task sorts or aggregates.
ROWS_A_TASK = 1_000_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df`, which has `rows` rows, dealt by the keys to the session's number of partitions, or to so many that each
    has some ROWS_A_TASK rows: the memory of a task does not grow with the table."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-rows // ROWS_A_TASK)), *keys)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder, for tables that one job writes and another reads."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _own(spark, "spark-scratch-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows as a Parquet table in the shared folder, and its path. Rounds of a loop go on from such a table: its
    size is known, while a checkpoint hands on the planner's estimate, which joins multiply from round to round."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
