"""Bounded, repeatable samples of labelled rows, and the rows that are held out from learning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: Column) -> Column:
    """Rows from which no label is learned: crc32 of the id as text, modulo 4, is 2 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sample(ids: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """At most `most` rows, those whose key has the smallest hash."""
    return ids.orderBy(F.xxhash64(key), key).limit(most)


def learnable(labels: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """doc_id and y of the labelled rows that may be learned from; rows of one id count once, with their smallest label."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    return rows.groupBy(F.col(key).alias("doc_id")).agg(F.min(label).cast("int").alias("y"))
