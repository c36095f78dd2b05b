"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Removes a query's shuffle files once it has ended; a checkpoint doesn't need them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in spark.checkpoint.dir; the shuffles that led to it are removed.

    The folder must be shared by all executors, so there is no default: on a
    local master alone the warehouse's place is taken.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # planned anew, under the setting
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that all executors share: spark.checkpoint.dir of the session or its context."""
    context = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if place is None and context.master.startswith("local"):
        place = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    if place is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return place


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 100) -> DataFrame:
    """node and component (its smallest node) of every node that has an edge.

    Alternates the large-star and small-star steps of Kiveris et al. (2014):
    each round joins neighbourhoods to their smallest member, so the rounds grow
    with the logarithm of the longest path.  Neighbourhoods are never collected:
    a minimum is joined back to the edges, so a hub is split like any skewed key.
    """
    a, b = F.col(src), F.col(dst)
    now = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = checkpoint(now)
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        # large star: larger neighbours of u go to the smallest of u's neighbourhood
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(least, F.col("u") == F.col("k")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = checkpoint(small.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
        # done when every edge is a star edge: no node is both a centre and a leaf, and no leaf has two centres
        state = new.groupBy("u").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        chained = new.select(F.col("v").alias("u")).distinct().join(new.select("u").distinct(), "u", "left_semi").isEmpty()
        now = new
        if state == 1 and chained:
            break
    else:
        raise RuntimeError(f"components haven't settled in {most_rounds} rounds")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
