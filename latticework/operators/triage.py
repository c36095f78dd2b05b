"""Event-sourced review decisions: replay with undo by windows, counts, CSV, journal lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import csv_line

# Actions in their fixed order, with the spellings that name them.
ACTIONS = ["approve", "reject", "flag", "duplicate", "bulk-approve"]
ALIASES = {"approve": "approve", "approved": "approve", "a": "approve", "reject": "reject", "rejected": "reject", "r": "reject", "flag": "flag", "flagged": "flag", "f": "flag", "duplicate": "duplicate", "dup": "duplicate", "d": "duplicate", "bulk-approve": "bulk-approve", "bulk_approve": "bulk-approve", "bulk": "bulk-approve", "shift+a": "bulk-approve"}
STATES = {"approve": "approved", "bulk-approve": "approved", "reject": "rejected", "flag": "flagged", "duplicate": "duplicate"}


def parse_action(c: Column) -> Column:
    key, out = F.lower(F.trim(c)), F.lit(None).cast("string")
    for spelling, action in ALIASES.items():
        out = F.when(key == spelling, action).otherwise(out)
    return out


def state_of(action: Column) -> Column:
    out = F.lit("pending")
    for name, state in STATES.items():
        out = F.when(action == name, state).otherwise(out)
    return out


def replay(events: DataFrame, session: str, order: list[str], action: str, icon: str, at: str) -> DataFrame:
    """session, icon, action, seq, at of the decisions that stand after all events.

    An event is an apply or, where the action is `undo`, takes back the newest
    standing apply; undo with nothing to take back does nothing.  With depth the
    running count of standing applies, an apply stands iff no later event gets
    below its depth.  seq counts applies and is never reused.
    """
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy(session).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    undo = F.col(action) == "undo"
    rows = events.withColumn("_s", F.sum(F.when(undo, -1).otherwise(1)).over(w))
    rows = rows.withColumn("_depth", F.col("_s") - F.least(F.lit(0), F.min("_s").over(w)))
    rows = rows.withColumn("_seq", F.sum(F.when(undo, 0).otherwise(1)).over(w) - 1)
    rows = rows.withColumn("_after", F.min("_depth").over(later))
    live = rows.where(~undo & (F.coalesce("_after", "_depth") >= F.col("_depth")))
    last = live.groupBy(session, icon).agg(F.max_by(F.struct(F.col(action).alias("action"), F.col("_seq").alias("seq"), F.col(at).alias("at")), "_seq").alias("d"))
    return last.select(session, icon, "d.action", F.col("d.seq").cast("long").alias("seq"), "d.at")


def counts(decisions: DataFrame, session: str) -> DataFrame:
    """session, action, n for every action in fixed order, zeros included."""
    every = decisions.select(session).distinct().crossJoin(F.broadcast(decisions.sparkSession.createDataFrame([(k, a) for k, a in enumerate(ACTIONS)], "ord int, action string")))
    have = decisions.groupBy(session, "action").agg(F.count(F.lit(1)).alias("n"))
    return every.join(have, [session, "action"], "left").select(session, "ord", "action", F.coalesce("n", F.lit(0)).alias("n"))


def to_csv(decisions: DataFrame, session: str, icon: str) -> DataFrame:
    """session, csv: seq,id,action,at_ms lines in seq order with CRLF."""
    rows = decisions.select(session, "seq", csv_line([F.col("seq"), F.col(icon), F.col("action"), F.col("at")]).alias("line"))
    lines = rows.groupBy(session).agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("l"))
    return lines.select(session, F.concat(F.lit("seq,id,action,at_ms\r\n"), F.array_join(F.transform("l", lambda x: x["line"]), "")).alias("csv"))


def from_csv(rows: DataFrame, session: str) -> DataFrame:
    """Decisions of imported rows (row_no, seq, id, action, at_ms): the later row of one id wins; next_seq is the largest seq + 1."""
    last = rows.groupBy(session, "id").agg(F.max_by(F.struct("seq", "action", "at_ms"), "row_no").alias("d"))
    top = rows.groupBy(session).agg((F.max("seq") + 1).alias("next_seq"))
    return last.join(top, session).select(session, "id", "d.seq", F.col("d.action").alias("action"), "d.at_ms", "next_seq")


def journal_line(action: Column, index: Column, seq: Column, at: Column) -> Column:
    apply = F.concat(F.lit("review/apply action="), action, F.lit(" index="), index.cast("string"), F.lit(" seq="), seq.cast("string"), F.lit(" at="), at.cast("string"))
    return F.when(action == "undo", F.concat(F.lit("review/undo at="), at.cast("string"))).otherwise(apply)


def parse_journal(df: DataFrame, line: str) -> DataFrame:
    """df with kind, action, index, seq, at of a journal line; a foreign line, or one with any field missing or bad, gives nulls.

    The line is trimmed; of fields named twice the last counts; numbers are whole and unsigned (index up to 32 bits, seq and at up to 63).
    """
    text = F.regexp_replace(line, r"^\s+|\s+$", "")
    fields = F.slice(F.split(text, r"\s+"), 2, 1 << 20)
    value = lambda k: F.try_element_at(F.filter(fields, lambda f: f.startswith(f"{k}=")), F.lit(-1))
    text_of = lambda k: F.substring(value(k), len(k) + 2, 1 << 20)
    number = lambda k: F.when(text_of(k).rlike(r"^\+?\d+$"), text_of(k).try_cast("long"))
    action, index, seq, at = text_of("action"), number("index"), number("seq"), number("at")
    apply = text.startswith("review/apply") & action.isin(ACTIONS) & (index < 1 << 32) & seq.isNotNull() & at.isNotNull()
    undo = text.startswith("review/undo") & at.isNotNull()
    return df.withColumns({"kind": F.when(undo, "undo").when(apply, "apply"), "action": F.when(apply, action), "index": F.when(apply, index), "seq": F.when(apply, seq), "at": F.when(apply | undo, at)})


def validate(events: DataFrame, session: str, order: list[str], action: str, recorded: str) -> DataFrame:
    """Sessions whose journal is corrupt: undo with nothing left, or a recorded seq that replay doesn't produce."""
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    undo = F.col(action) == "undo"
    rows = events.withColumn("_d", F.sum(F.when(undo, -1).otherwise(1)).over(w)).withColumn("_q", F.sum(F.when(undo, 0).otherwise(1)).over(w) - 1)
    return rows.groupBy(session).agg((F.min("_d") < 0).alias("undo_on_empty"), F.coalesce(F.bool_or(~undo & (F.col(recorded) != F.col("_q"))), F.lit(False)).alias("seq_mismatch")).where("undo_on_empty or seq_mismatch")
