"""Mixing sources to target weights, by hash-threshold histograms.

All words of all sources are shared out anew by weight.  A source's target is
met by taking each of its documents `floor(target / size)` times, and once more
those whose hash lies under the source's threshold.  The threshold is found by
histograms: words are summed by source and hash bucket, the bucket in which the
budget ends is the boundary, and only the documents of that bucket are looked
at on the next, finer level.  The last boundary is one hash: of its rows as many
are taken as come nearest to the budget.  Nothing is sorted by document, and only
DataFrame functions run.

Defined cases: a null or wordless text has size 0 and is taken 0 times; the null
source is a source of its own, ordered last; rows of one id (or of none) with
different texts have different hashes, and of rows equal in id and text as many
as fit are taken, whichever; an empty table gives an empty result; the id may
have any type that casts to text; columns other than the named ones are never
read and pass through `mix` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spread import checkpoint, fresh

WORD = r"[^\x20\x09-\x0D]+"
#: Hash bits that one histogram level resolves, and the number of levels (60 bits in all).
LEVEL_BITS, LEVELS = 12, 5
#: A source's documents are taken at most so many times.
MOST = 3
#: Source rows up to which the thresholds are broadcast; beyond it the join is left to adaptive execution, which splits hot sources.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(key: Column, text: Column) -> Column:
    """60 bits of the MD5 of the id and the text's MD5, which other engines can compute too."""
    whole = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit("|"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def source_order(sources: DataFrame) -> DataFrame:
    """Adds n, the rank from 0 in code-point order with null last, without bringing all rows to one task."""
    parts = checkpoint(sources.repartitionByRange(F.col("source").isNull(), "source").withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy("_p").orderBy(F.col("source").asc_nulls_last())
    per = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = per.alias("a").join(per.alias("b"), F.col("b._p") < F.col("a._p"), "left").groupBy(F.col("a._p").alias("_p")).agg(F.coalesce(F.sum("b._c"), F.lit(0)).alias("_before"))
    return parts.join(F.broadcast(before), "_p").withColumn("n", F.row_number().over(w) - 1 + F.col("_before")).drop("_p", "_before")


def source_targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target: weights 1, 2, 3 repeating over ordered sources share all words; targets stop at MOST times the size.

    The excess is reshared in rounds of one aggregate each; a round fixes every
    source above its stop, so the rounds are few.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = checkpoint(source_order(sources).select("source", "source_size", (F.col("n") % 3 + 1).alias("weight")))
    stop = F.col("source_size") * MOST
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    rate = (0, 1)  # words per unit of weight, as a fraction
    while True:
        # a source is held to its stop once stop < rate * weight; the rate only grows, so it stays held
        held = stop * F.lit(rate[1]) < F.lit(rate[0]) * F.col("weight") if rate[0] else F.lit(False)
        free, fixed = sources.agg(F.sum(F.when(~held, F.col("weight"))), F.sum(F.when(held, stop))).first()
        left = total - (fixed or 0)
        new = (left, free or 1)
        if not total or new[0] * rate[1] == rate[0] * new[1]:
            break
        rate = new
    share = F.lit(float(rate[0])) * F.col("weight") / F.lit(float(rate[1]))
    held = stop * F.lit(rate[1]) < F.lit(rate[0]) * F.col("weight")
    return sources.select("source", "source_size", F.when(held, stop.cast("double")).otherwise(share).alias("target"))


def _with(rows: DataFrame, small: DataFrame, n: int, how: str = "left") -> DataFrame:
    """rows with the columns of small, by source (null equals null)."""
    s = small.withColumnRenamed("source", "_source")
    if n <= BROADCAST_SOURCES:
        s = F.broadcast(s)
    return rows.join(s, rows["source"].eqNullSafe(s["_source"]), how).drop("_source")


def thresholds(sized: DataFrame) -> tuple[DataFrame, int]:
    """source, source_size, target, copies, cut, extra of checkpointed rows (source, size, h), and the number of sources.

    Rows are taken `copies` times and once more where h < cut; `extra` of the
    rows with h = cut are taken once more too.
    """
    targets = checkpoint(source_targets(sized))
    n = targets.count()
    base = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST))).otherwise(F.lit(0)).cast("int")
    state = targets.withColumn("copies", base).withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("copies") * F.col("source_size")))
    state = state.withColumn("cut", F.lit(0).cast("long"))  # budget: words still to take from it on
    open_rows = sized.select("source", "size", "h")
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        sums = open_rows.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("k"))
        up = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("w").over(up), F.lit(0)))
        # the boundary: the last bucket that starts within the budget
        edge = _with(sums, state.select("source", "budget"), n).where(F.col("before") <= F.col("budget"))
        edge = edge.groupBy("source").agg(F.max_by(F.struct("b", "w", "before", "k"), "b").alias("e")).select(F.col("source").alias("_s"), "e.*")
        state = state.join(edge, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        state = state.withColumn("cut", F.coalesce(F.shiftleft(F.col("b"), shift), F.col("cut"))).withColumn("budget", F.col("budget") - F.coalesce("before", F.lit(0)))
        last = level == LEVELS - 1  # a bucket is one hash
        extra = F.when(F.col("w") > 0, F.least(F.floor(F.col("budget") * F.col("k") / F.col("w") + 0.5), F.col("k"))).otherwise(F.lit(0)).cast("long")
        state = checkpoint(state.select("source", "source_size", "target", "copies", "cut", extra.alias("extra") if last else "budget"))
        if not last:
            rows = _with(open_rows, state.select("source", "cut"), n, "inner")
            open_rows = rows.where(F.shiftright("h", shift) == F.shiftright("cut", shift)).select("source", "size", "h")
            if level == 0:
                open_rows = checkpoint(open_rows)
    return state, n


def _times(rows: DataFrame, state: DataFrame, n: int, size: str, h: str, source: str, out: str) -> DataFrame:
    """rows with `out`: how often each is taken, 0 to MOST, and the state's columns as a struct `out`_of."""
    small = state.select(F.struct(*state.columns).alias(f"{out}_of"))
    small = F.broadcast(small) if n <= BROADCAST_SOURCES else small
    of = lambda c: F.col(f"{out}_of")[c]
    rows = rows.join(small, rows[source].eqNullSafe(small[f"{out}_of"]["source"]), "left")
    capped = lambda c: F.when(F.col(size) > 0, F.least(c, F.lit(MOST))).otherwise(F.lit(0)).cast("int")
    edge = (F.col(h) == of("cut")) & (F.col(size) > 0)
    plain = rows.where(~edge).withColumn(out, capped(of("copies") + (F.col(h) < of("cut")).cast("int")))
    # the rows at the boundary are numbered part by part, so that no task gathers them
    parts = checkpoint(rows.where(edge).withColumn(f"{out}_p", F.spark_partition_id()))
    per = parts.groupBy(F.col(source).alias("s"), F.col(f"{out}_p").alias("p")).agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select(F.struct("s", "p", F.coalesce(before, F.lit(0)).alias("n")).alias(f"{out}_per"))
    at = F.col(f"{out}_per")
    number = F.row_number().over(Window.partitionBy(source, f"{out}_p").orderBy(h)) + at["n"]
    cut = parts.join(per, parts[source].eqNullSafe(at["s"]) & (parts[f"{out}_p"] == at["p"]))
    cut = cut.withColumn(out, number).withColumn(out, capped(of("copies") + (F.col(out) <= of("extra")).cast("int")))
    return plain.unionByName(cut.drop(f"{out}_p", f"{out}_per"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken of each row; taken counts words, repeats included.

    A source's rows are taken in the order of their hash, up to the row whose end comes nearest to the budget.
    """
    text = F.col(text_col)
    sized = checkpoint(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), row_hash(F.col(id_col), text).alias("h")))
    state, n = thresholds(sized)
    out = _times(sized, state, n, "size", "h", "source", "times")
    return out.select("doc_id", "source", "size", "times_of.source_size", "times_of.target", (F.col("size") * F.col("times")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row repeated as often as the mix takes it; its columns are unchanged.  Texts stay where they are: only thresholds are sent."""
    size, h, times = fresh(docs, "size", "h", "times")
    rows = docs.withColumns({size: word_count(F.col(text_col)), h: row_hash(F.col(id_col), F.col(text_col))})
    sized = checkpoint(rows.select(F.col(source_col).alias("source"), F.col(size).alias("size"), F.col(h).alias("h")))
    state, n = thresholds(sized)
    taken = _times(rows, state, n, size, h, source_col, times)
    copies = F.explode(F.sequence(F.lit(1), F.col(times)))
    return taken.where(F.col(times) > 0).withColumn(size, copies).select(*docs.columns)
