"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    return score(_table(spark, sf_dir, "documents")).withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import digests

    return digests(_table(spark, sf_dir, "documents"))


#: Listed rules of op3_url_rules, in the contract's order.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .samples import held_out
    from .urlrules import judge, mine, page_labels

    pages, labels = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    # a page is bad if the document that it shows is marked toxic or of low quality
    bad = labels.select("doc_id", ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int").alias("bad"))
    mined = mine(page_labels(pages, _table(spark, sf_dir, "documents"), bad))
    return judge(pages, mined, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "antecedent")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .samples import held_out
    from .toxicity import fit, score

    docs = _table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")


def op5_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vptree import nearest

    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20, factor=1.2)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import components

    return components(_table(spark, sf_dir, "documents"), n=3, percent=90)


def op7_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jpeg import stored_documents

    return stored_documents(_table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import check_pattern, digest_documents

    check_pattern(public_tokenizers.PATTERN)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import plan_mix

    return plan_mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, score
    from .samples import held_out

    docs = _table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
