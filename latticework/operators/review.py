"""The review view: enrichment, attention order, filter tabs, the next undecided row, the cascade's funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enrich(icons: DataFrame, item: str, clusters: DataFrame, outliers: DataFrame, decisions: DataFrame, flags: DataFrame) -> DataFrame:
    """icons with cluster, is_keeper, outliers and flags (sorted kinds) and state (pending if undecided); left joins on the item.

    clusters: item, cluster, keeper; outliers and flags: item, kind; decisions: item, state.
    """
    kinds = outliers.groupBy(item).agg(F.array_sort(F.collect_set("kind")).alias("outliers"))
    marks = flags.groupBy(item).agg(F.array_sort(F.collect_set("kind")).alias("flags"))
    out = icons.join(marks, item, "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))
    out = out.join(clusters.select(item, "cluster", "keeper"), item, "left").join(kinds, item, "left").join(decisions.select(item, "state"), item, "left")
    return out.withColumn("is_keeper", F.coalesce(F.col("keeper") == F.col(item), F.lit(False))).withColumn("outliers", F.coalesce("outliers", F.array().cast("array<string>"))).withColumn("state", F.coalesce("state", F.lit("pending"))).drop("keeper")


def attention_rank() -> Column:
    """0 duplicate that isn't kept, 1 with quality flags, 2 outlier, decided or not; else 3 undecided, 4 decided; of an enriched row."""
    return F.when(F.col("cluster").isNotNull() & ~F.col("is_keeper"), 0).when(F.size("flags") > 0, 1).when(F.size("outliers") > 0, 2).when(F.col("state") == "pending", 3).otherwise(4)


TABS = {
    "all": lambda: F.lit(True),
    "pending": lambda: F.col("state") == "pending",
    "done": lambda: F.col("state") != "pending",
    "flagged": lambda: F.col("state") == "flagged",
    "duplicates": lambda: F.col("cluster").isNotNull(),
    "outliers": lambda: F.size("outliers") > 0,
}


def filter_rows(rows: DataFrame, tab: str) -> DataFrame:
    return rows.where(TABS[tab]())


def filter_counts(rows: DataFrame) -> DataFrame:
    """tab, n of all tabs in one aggregation."""
    one = rows.agg(*[F.coalesce(F.sum(p().cast("long")), F.lit(0)).alias(t) for t, p in TABS.items()])
    return one.unpivot([], list(TABS), "tab", "n")


def next_undecided(rows: DataFrame, group: str, order: list[str], item: str) -> DataFrame:
    """rows with next_item: the next pending row of its group in order, null after the last; never wraps."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("next_item", F.first(F.when(F.col("state") == "pending", F.col(item)), ignorenulls=True).over(w))


def pace(decided: Column, total: Column, elapsed_ms: Column, budget_ms: int = 20 * 60 * 1000) -> Column:
    """struct(projected_ms, in_budget): elapsed / decided * max(total, decided)."""
    projected = F.try_divide(elapsed_ms.cast("double"), decided.cast("double")) * F.greatest(total, decided)
    return F.struct(projected.alias("projected_ms"), (projected <= budget_ms).alias("in_budget"))


def funnel(candidates: DataFrame, verified: Column, confirmed: Column) -> DataFrame:
    """candidates, verified, confirmed counts of judged pairs."""
    return candidates.agg(F.count(F.lit(1)).alias("candidates"), F.coalesce(F.sum(verified.cast("long")), F.lit(0)).alias("verified"), F.coalesce(F.sum((verified & confirmed).cast("long")), F.lit(0)).alias("confirmed"))


def by_position(report: DataFrame, icons: DataFrame, position: str, item: str) -> DataFrame:
    """report's rows, which name icons by their position on the sheet, with the icons' ids."""
    return report.join(icons.select(position, item), position)


def duplicate_ids(clusters: DataFrame, item: str, members: str = "members") -> DataFrame:
    """Every id that is in a cluster, once."""
    return clusters.select(F.explode(members).alias(item)).distinct()


def ordered_clusters(clusters: DataFrame) -> DataFrame:
    """Clusters by keeper, then by members."""
    return clusters.orderBy("keeper", "members")


def ordered_outliers(outliers: DataFrame, item: str, kinds: list[str], kind: str = "kind") -> DataFrame:
    """Outliers by id, then by their kind's place in a fixed order."""
    return outliers.orderBy(item, F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col(kind)))


def screened(icons: DataFrame, width: int, height: int) -> DataFrame:
    """icons (x, y, w, h, document, ink) with row_no kept and reason: why an icon can't be reviewed, else null."""
    off = (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("w") > width) | (F.col("y") + F.col("h") > height)
    reason = F.when((F.col("w") <= 0) | (F.col("h") <= 0), "empty box").when(F.coalesce("document", F.lit("")) == "", "no document").when(off, "off sheet").when(F.col("ink") <= 0, "no ink").when(~F.col("document").startswith("<svg"), "unparsable")
    return icons.withColumn("reason", reason)
