"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  run() writes each stage's rows as Parquet to
the shared folder and reads them again for the next.

Defined cases: those of the operators that the stages call; rows with null or
empty texts pass the toxicity and near-duplicate stages, and are not taken by
the mix, where they have no words.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import bpe, jaccard, mixing, substrings, toxicity
from latticework.operators.graph import shared_folder

#: Documents scored at or above this are rejected.
TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the toxicity operator scores under TOXIC_FROM."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    return toxicity.keep_clean(docs, model, TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group whose sets of five-word shingles reach a Jaccard similarity of 0.8."""
    return jaccard.keep_one(docs, n=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words and more that an earlier document holds; n_chars follows the text."""
    out = substrings.dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources near their target weights."""
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add ids, n_tokens and digests of the ids and of their decoded bytes."""
    bpe.check_pattern(public_tokenizers.PATTERN)
    out = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return out.drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Model scores, content-defined symbols and BPE merges are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    at = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
        if done:  # the stage before it isn't read again
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(done)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        done = f"{at}/{k}-{name}"
    return docs
