"""The training-data pipeline: five stages over `documents`, each one of the operators.

1. language: documents without a letter, or with no language that is likely, go.
2. quality: documents that the network scores under a half go.
3. near duplicates: one document of each group stays, and one of equal rows.
4. decontamination: documents that hold a passage of a benchmark item go.
5. packing: what is left, packed into sequences, one row per piece.

A stage works on what its predecessor kept and learns from those rows only. All but the last
return the columns of documents, rows as they were. Filters judge rows, not ids: every row has a
key, a hash of all its columns, so a row without doc_id is judged like any other, and rows
that share a doc_id but differ each have their own fate. Equal rows share theirs.
"""

from __future__ import annotations

import gc
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.llm import quality
from marginalia.llm.decontaminate import leaks
from marginalia.llm.langid import UNKNOWN, identify
from marginalia.llm.minhash import near_duplicates
from marginalia.llm.packing import pack
from marginalia.session import ship_package, use_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Least probability of the language, and of good quality, that a document is kept with.
LEAST_LANGUAGE = 0.5
LEAST_QUALITY = 0.5
TOKENIZER = "word_bpe_49k.json"


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents; models and plans of the stage before are given back first."""
    gc.collect()
    docs.sparkSession.sparkContext._jvm.System.gc()
    ship_package(docs.sparkSession)
    return docs.select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows for an operator: a key of the whole row (63 bits, never null) stands for doc_id."""
    key = F.xxhash64(*COLUMNS).bitwiseAND(F.lit((1 << 63) - 1))
    return _documents(docs).withColumn("_id", F.col("doc_id")).withColumn("doc_id", key)


def _without(keyed: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows whose key is not among the rejected, as they were; only keys are shuffled with them."""
    kept = keyed.join(rejected.select("doc_id").distinct(), "doc_id", "left_anti")
    return kept.withColumn("doc_id", F.col("_id")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    unclear = (F.col("lang_pred") == UNKNOWN) | (F.col("score") < LEAST_LANGUAGE)
    return _without(keyed, identify(keyed).filter(unclear))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("_id"), "quality")
    known = keyed.select("_id", "doc_id").join(labels, "_id").select("doc_id", "quality")
    return _without(keyed, quality.score(keyed, known).filter(F.col("score") < LEAST_QUALITY))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    others = near_duplicates(keyed).filter(~F.col("kept")).select("doc_id")
    # Of equal rows one stays; they are few, so only they are gathered.
    repeated = keyed.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    single = keyed.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    rest = keyed.join(repeated, "doc_id", "left_anti")
    return _without(rest.unionByName(single), others)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    return _without(keyed, leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(_documents(docs), public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("near_duplicates", distinct),
    ("decontamination", decontaminated),
    ("packing", packed),
]

# A learned model, hashing and a linear program are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    folder = f"{use_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
