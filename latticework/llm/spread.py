"""Helpers that lay work out over a cluster: bucket counts, checkpoints, bounded membership filters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import checkpoint  # noqa: F401

#: Slots of a membership filter; it takes SLOTS / 8 bytes wherever it is sent.
SLOTS = 1 << 26


def buckets(df: DataFrame, bytes_each: int = 8 << 20, least: int = 64) -> int:
    """How many hash buckets to deal df's content into: by Spark's estimate of its size, so that a bucket stays small at any size."""
    spark: SparkSession = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 60:  # unknown: rows that come from no file
        texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.simpleString() == "string"]
        size = df.agg(F.sum(sum(texts, F.lit(64)))).first()[0] or 0
    return int(min(1 << 20, max(least, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // bytes_each)))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df begins with."""
    taken = [c.lower() for c in df.columns]
    out = []
    for name in names:
        while any(c.startswith(name) for c in taken):
            name = "_" + name
        out.append(name)
    return out


def slot_filter(names: DataFrame):
    """A broadcast bitmap of the 64-bit names in the column `name`, by their low bits.

    It holds SLOTS / 8 bytes whatever the number of names, which bounds what is
    collected and broadcast.  It has false positives and no false negatives: it
    may only save work that an exact step would discard.
    """
    slots = names.select(F.col("name").bitwiseAND(F.lit(SLOTS - 1)).alias("s"))
    words = slots.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(SLOTS // 64, dtype=np.uint64)
    if words.num_rows:
        bitmap[words["w"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return names.sparkSession.sparkContext.broadcast(bitmap)


def hit(bitmap: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which of the 64-bit names may be in the bitmap."""
    s = names & np.uint64(SLOTS - 1)
    return (bitmap[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63))) & np.uint64(1) == 1
