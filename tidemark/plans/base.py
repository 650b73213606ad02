"""The event table, account roles and posts over the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS_SQL = """(SELECT event_id, user_id AS "user", epoch_us(ts) // 1000000 AS ts,
    CASE WHEN event_type IN ('view', 'signup') THEN 0 WHEN event_type = 'purchase' THEN 2 ELSE 1 END::BIGINT AS action,
    CASE WHEN user_id % 3 = 0 THEN 'op' ELSE 'organic' END AS pop, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS platform,
    event_type, value, json_extract_string(props, '$.k')::BIGINT AS k FROM events)"""
#: Draws an integer below 2^32 from the md5 of a text expression.
DRAW_SQL = "('0x' || substr(md5({}), 1, 8))::BIGINT"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user, ts (seconds), action, pop, platform, event_type, value, k."""
    t = table(spark, sf_dir, "events")
    user = F.col("user_id")
    action = F.when(F.col("event_type").isin("view", "signup"), 0).when(F.col("event_type") == "purchase", 2).otherwise(1)
    return t.select(
        "event_id", user.alias("user"), F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("ts"), action.cast("long").alias("action"),
        F.when(user % 3 == 0, "op").otherwise("organic").alias("pop"), F.when(user % 2 == 0, "A").otherwise("B").alias("platform"),
        "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines' sums in another order agree."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def sql(body: str) -> str:
    return body.replace("$EV", EVENTS_SQL)
