"""The corpus pipeline: five stages over `documents`, each written and read again.

toxicity drops the documents it judges toxic; near_dedup keeps one document of each group of near
copies; secret_scan replaces every secret found in a text; mixing emits each document as often as the
mix takes it; packing cuts the ids of all of them into sequences. All but the last return the columns
of `documents`. Each stage works on all that the one before kept.

SQL cannot express the first two and the last; tests/llm compares the whole with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtable.llm import mixing, near_dedup, packing, secrets, toxicity
from flowtable.llm.common import table
from flowtable.llm.queries import tokenizer
from flowtable.session import new_path, prepare, scope


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(*toxicity.sample(docs, table(spark, sf_dir, "labels"))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_first(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, tokenizer("byte_bpe_50k.json"), "byte", end_id=0, length=1024)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with scope(spark):  # the intermediate tables of a stage end with it
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
