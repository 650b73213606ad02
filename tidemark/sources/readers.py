"""Readers and sinks: sequence CSV, archives of posts, JSON lines, per-account folders, fingerprints, stages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .records import records

#: Stores that workers read in blocks of so many bytes.
STREAMED, BLOCK = ("file", "hdfs", "s3", "gs"), 8 << 20
SEQUENCE = "user string, ts string, action string"
ARCHIVE = "user_screen_name string, tweet_time string, tweet_text string, hashtags string, urls string, is_retweet string, in_reply_to_tweetid string, quoted_tweet_tweetid string"
TIMELINE = "user struct<id_str: string>, full_text string, text string, created_at string, entities struct<urls: array<struct<expanded_url: string, url: string>>>, in_reply_to_status_id bigint, _corrupt_record string"


def read_named(spark: SparkSession, paths: str | list[str], schema: str, bad: bool = False) -> DataFrame:
    """The columns of `schema` and _path (the file) from CSV files with headers, taken by name.

    Files may hold further columns, lack some (null) and order them as they like; each is read by its own header.
    Quoted fields may hold line breaks, also where a file is divided among tasks (see `records`). Records of more
    fields than the header are dropped (with `bad`: they alone are given, all null but the path). What does not fit a
    column's type is null. Paths (folders, files or globs) without a file give no rows."""
    wanted = spark.createDataFrame([], schema).schema
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    there = [p for p in ([paths] if isinstance(paths, str) else paths) if (found := hadoop.Path(p).getFileSystem(conf).globStatus(hadoop.Path(p))) and len(found)]
    if not there:
        return spark.createDataFrame([], f"{schema}, _path string")
    rows = records(spark, there, wanted.fieldNames()).filter("bad" if bad else "not bad")
    return rows.select(*(F.col(f"c{i}").try_cast(f.dataType).alias(f.name) for i, f in enumerate(wanted)), F.col("path").alias("_path"))


def bad_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, records): how many records of each file have more fields than its header or are no CSV."""
    return read_named(spark, paths, "_x string", bad=True).groupBy(F.col("_path").alias("file")).agg(F.count(F.lit(1)).alias("records"))


def whole_number(text: Column) -> Column:
    """A whole number, also one written as a decimal fraction (cut towards zero); null where the text is no number."""
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def epoch_seconds(text: Column) -> Column:
    """Seconds of a number or an ISO time (UTC without an offset); null where the text is neither."""
    return F.coalesce(whole_number(text), F.unix_timestamp(F.try_to_timestamp(text)))


def read_sequences(spark: SparkSession, path: str | list[str], positive_only: bool = True) -> DataFrame:
    """user, ts (long), action (int). Times that are neither number nor ISO are dropped; an ISO time of 0 or
    less too if positive_only, but a number never."""
    raw = read_named(spark, path, SEQUENCE)
    number, iso = whole_number(F.col("ts")), F.unix_timestamp(F.try_to_timestamp("ts"))
    rows = raw.select("user", F.coalesce(number, iso).alias("ts"), whole_number(F.col("action")).try_cast("int").alias("action"), number.isNotNull().alias("_n")).filter("ts is not null")
    return (rows.filter("_n or ts > 0") if positive_only else rows).drop("_n")


def archive_action() -> Column:
    """0 post, 1 reply, 2 repost or quote; a reply wins."""
    reply = F.col("in_reply_to_tweetid").isNotNull()
    repost = (F.lower("is_retweet") == "true") | F.col("quoted_tweet_tweetid").isNotNull()
    return F.when(reply, 1).when(repost, 2).otherwise(0)


def read_archive(spark: SparkSession, paths: str | list[str], least: int = 1) -> DataFrame:
    """user (lower case), ts, action of accounts with at least `least` events; bad lines and times are dropped."""
    raw = read_named(spark, paths, ARCHIVE)
    rows = raw.select(F.lower("user_screen_name").alias("user"), F.unix_timestamp(F.try_to_timestamp("tweet_time")).alias("ts"), archive_action().alias("action")).filter("user is not null and ts is not null")
    return rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("user"))).filter(F.col("_n") >= least).drop("_n")


def read_timelines(spark: SparkSession, path: str | list[str], members: DataFrame | None = None, least_chars: int = 5) -> DataFrame:
    """user, ts, text, urls, is_reply from JSON lines (bz2 or not); corrupt lines are skipped."""
    raw = spark.read.schema(TIMELINE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    text = F.coalesce("full_text", "text")
    at = F.unix_timestamp(F.try_to_timestamp(F.substring("created_at", 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy")))
    links = F.transform("entities.urls", lambda u: F.coalesce(u.expanded_url, u.url))
    rows = raw.select(F.col("user.id_str").alias("user"), at.alias("ts"), text.alias("text"), F.coalesce(links, F.array().cast("array<string>")).alias("urls"), F.col("in_reply_to_status_id").isNotNull().cast("int").alias("is_reply"))
    rows = rows.filter(F.col("user").isNotNull() & F.col("ts").isNotNull() & (F.length("text") >= least_chars))
    return rows.join(members, "user", "left_semi") if members is not None else rows


def read_folders(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """One kind of file from a folder for each account; the folder's name, in lower case, is the user. Accounts
    without the file give no rows, columns that a file lacks are null."""
    user = F.lower(F.url_decode(F.element_at(F.split("_path", "/"), -2)))
    return read_named(spark, paths, schema).withColumn("user", user).drop("_path")


def fingerprints(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, bytes, sha256) of every file below the paths (folders, files or globs), empty ones too.

    Files are listed by the driver, as for any scan, and dealt to tasks, which read them in blocks, so a file may be
    of any size. Stores that only Spark's own readers reach are read by them, which bounds a file there to 2 GB."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    files = []
    for p in [path] if isinstance(path, str) else path:
        system = hadoop.Path(p).getFileSystem(conf)
        for found in system.globStatus(hadoop.Path(p)) or []:
            below = system.listFiles(found.getPath(), True)
            while below.hasNext():
                status = below.next()
                if not status.getPath().getName().startswith(("_", ".")):
                    files.append((status.getPath().toString(), status.getLen()))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for uri in batch.column(0).to_pylist():
                if uri.startswith("file:"):
                    system, where = pa.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
                else:
                    system, where = pa.fs.FileSystem.from_uri(quote(uri, safe=":/@"))
                sha = hashlib.sha256()
                with system.open_input_stream(where) as stream:
                    while block := stream.read(BLOCK):
                        sha.update(block)
                out.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["path", "bytes", "sha256"])

    known = [f for f in files if f[0].split(":")[0] in STREAMED]
    listed = spark.createDataFrame(known, "path string, bytes long").repartition(max(1, min(len(known), 10 * spark.sparkContext.defaultParallelism)))
    found = listed.mapInArrow(digest, "path string, bytes long, sha256 string")
    other = [f for f in files if f[0].split(":")[0] not in STREAMED]
    if other:
        content = spark.read.format("binaryFile").load([f for f, n in other if n] or [f for f, _ in other]).select("path", F.sha2("content", 256).alias("sha256"))
        rest = spark.createDataFrame(other, "path string, bytes long").join(content, "path", "left")
        found = found.unionByName(rest.select("path", "bytes", F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("sha256")))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256")


def stage(df: DataFrame, path: str, by: list[str] | None = None, inputs: str | list[str] | None = None) -> DataFrame:
    """Write a stage as Parquet and read it again; a stage that is there already is only read.

    With `inputs` (paths), a stage that was made of other contents is made anew: the digest of its inputs' fingerprints
    stands beside it."""
    spark = df.sparkSession
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    done, mark = hadoop.Path(f"{path}/_SUCCESS"), hadoop.Path(f"{path}/_inputs")
    system = done.getFileSystem(conf)
    key = None
    if inputs is not None:
        prints = fingerprints(spark, inputs).groupBy("sha256").count().agg(F.sort_array(F.collect_list(F.concat_ws(" ", "sha256", F.col("count").cast("string")))).alias("all"))  # a line for each file
        key = prints.select(F.sha2(F.array_join("all", ";"), 256)).first()[0]
    if system.exists(done) and key is not None:
        was = None
        if system.exists(mark):
            stream = system.open(mark)
            was = stream.readUTF()
            stream.close()
        if was != key:
            system.delete(hadoop.Path(path), True)
    if not system.exists(done):
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(path)
        if key is not None:
            stream = system.create(mark, True)
            stream.writeUTF(key)
            stream.close()
    return spark.read.parquet(path)


def read_posts(spark: SparkSession, paths: str | list[str], members: DataFrame, least_chars: int = 5) -> DataFrame:
    """user, ts, text, urls, is_reply of members' posts of at least `least_chars` characters."""
    raw = read_named(spark, paths, ARCHIVE)
    text = F.col("tweet_text")
    rows = raw.select(F.lower("user_screen_name").alias("user"), F.unix_timestamp(F.try_to_timestamp("tweet_time")).alias("ts"), text.alias("text"), F.regexp_extract_all(text, F.lit(r"(https?://\S+)"), 1).alias("urls"), F.col("in_reply_to_tweetid").isNotNull().cast("int").alias("is_reply"))
    return rows.filter(F.col("ts").isNotNull() & (F.length("text") >= least_chars)).join(members, "user", "left_semi")
