"""The corpus pipeline: language ID, exact dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of `documents`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid
from tidemark.llm.common import shared_folder, table
from tidemark.llm.decontam import drop_contaminated
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.minhash import drop_near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.queries import tokenizer_file


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what is no text in any of the languages that `lang` names: null texts, texts without a letter, and
    texts far off every language's model. A table without any language drops only the first two kinds."""
    model = langid.fit(docs.select("text", "lang"))
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return langid.identify(docs, model).filter(~F.col("rejected")).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, the one of the largest id."""
    return exact_dedup(docs).filter("kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8), the smallest id. Rows of
    a null id stay; rows that repeat an id share its fate."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item (a window of weighted similarity 0.8 or more), row by row."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document in sequences of at most 1024."""
    return pack(docs, tokenizer_path=tokenizer_file())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("packing", pack_sequences),
]

#: Character language models and tokenisation are not SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`, each written to the shared checkpoint folder and read again.

    A stage's table is deleted once the next one is written; the last one is the result. Null texts go with the
    first stage; null ids, repeated ids and repeated rows are rows like any other, but where stages say else. An
    empty table gives no rows."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            _delete(spark, before)
        before = out
    return docs


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
