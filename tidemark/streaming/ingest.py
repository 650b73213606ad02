"""Incremental ingest of event files into daily counts of each account."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_counts(spark: SparkSession, folder: str, schema, out: str, checkpoint: str, *, late: str = "365 days") -> DataFrame:
    """Read the Parquet files that are new in `folder`, drop repeated events, and add (day, user, action, hour,
    n) to `out`. Runs until what is there is read; a rerun takes up where the last one ended."""
    stream = spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    unique = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    action = F.when(F.col("event_type").isin("view", "signup"), 0).when(F.col("event_type") == "purchase", 2).otherwise(1)
    rows = unique.select("event_id", F.col("user_id").alias("user"), action.alias("action"), F.to_date("ts").alias("day"), F.hour("ts").alias("hour"))

    def add(batch: DataFrame, batch_id: int) -> None:
        # a batch has a folder of its own, which a retry overwrites: each event counts once
        counts = batch.groupBy("day", "user", "action", "hour").agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).groupBy("day", "user", "action", "hour").agg(F.sum("n").alias("n"))
