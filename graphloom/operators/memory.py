"""Agent memory as tables: message chains, facts with validity, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import fts, vector_query


def instant(c: Column) -> Column:
    """An RFC 3339 time or a date as a timestamp; anything else is null."""
    return F.try_to_timestamp(c)


def add_messages(messages: DataFrame, new: DataFrame) -> DataFrame:
    """messages (id, session, seq, role, text, created_at) with new (session, role, text, created_at) appended in order of created_at."""
    last = messages.groupBy("session").agg(F.max("seq").alias("last"))
    top = messages.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    w = Window.partitionBy("session").orderBy("created_at", "role", "text")
    numbered = new.join(last, "session", "left").withColumn("seq", F.coalesce("last", F.lit(0)) + F.row_number().over(w))
    # ids only need to be new: a hash of session and seq above the ids in use
    return messages.unionByName(numbered.select((F.lit(top) + 1 + F.pmod(F.xxhash64("session", "seq"), F.lit(1 << 40))).alias("id"), "session", F.col("seq").cast("long").alias("seq"), "role", "text", "created_at"))


def next_edges(messages: DataFrame) -> DataFrame:
    """(src, dst): the NEXT chain of each session."""
    w = Window.partitionBy("session").orderBy("seq")
    return messages.withColumn("dst", F.lead("id").over(w)).filter("dst is not null").select(F.col("id").alias("src"), "dst")


def conversation(messages: DataFrame, session: str, limit: int) -> DataFrame:
    """The latest messages of a session, oldest first."""
    return messages.filter(F.col("session") == session).orderBy(F.desc("seq")).limit(limit).orderBy("seq")


def recall(messages: DataFrame, session: str, query: str, k: int) -> DataFrame:
    """Best messages of one session by full text; statistics are over the session."""
    return fts(messages.filter(F.col("session") == session).select("id", "text"), query, k)


def recall_vector(messages: DataFrame, session: str, vector: list[float], k: int) -> DataFrame:
    return vector_query(messages.filter(F.col("session") == session).select("id", F.col("embedding").alias("v")), vector, k)


def facts(assertions: DataFrame) -> DataFrame:
    """Validity of facts from a log: (subject, relation, object, op, exclusive, ts[, seq]) to (..., valid_from, valid_until).

    An assertion of a fact that holds changes nothing; an exclusive one closes the
    subject's other facts of the relation; a retraction closes the fact.  Half-open:
    valid_from <= t < valid_until.  Equal times follow seq; without it, or for equal seq,
    assertions by object, then retractions.  A fact closed at the time it began gives
    an empty stretch.
    """
    seq = F.col("seq") if "seq" in assertions.columns else F.lit(0)
    log = assertions.withColumn("at", F.struct("ts", seq.alias("seq"), (F.col("op") != "assert").alias("n"), F.col("object").alias("o")))
    # backwards in time, frames only grow: linear for a subject that holds many rows
    group = Window.partitionBy("subject", "relation").orderBy(F.desc("at"))
    own = Window.partitionBy("subject", "relation", "object")
    upto, later = (Window.unboundedPreceding, Window.currentRow), (Window.unboundedPreceding, -1)
    excl = F.when((F.col("op") == "assert") & F.col("exclusive"), F.struct("object", "at"))
    log = log.withColumns({"next": F.last(excl, True).over(group.rowsBetween(*upto)), "after": F.last(excl, True).over(group.rowsBetween(*later))})
    # where the exclusive assertions change their object: that ends the object before
    change = F.when(excl.isNotNull() & (F.col("after.object") != F.col("object")), F.col("after.at"))
    log = log.withColumn("change", F.last(change, True).over(group.rowsBetween(*upto)))
    by_other = F.when(F.col("next.object") != F.col("object"), F.col("next.at")).otherwise(F.col("change"))
    retract = F.last(F.when(F.col("op") == "retract", F.col("at")), True).over(own.orderBy(F.desc("at")).rowsBetween(*upto))
    log = log.withColumns({"by_other": by_other, "by_retract": retract}).filter("op = 'assert'").withColumn("until", F.least("by_other", "by_retract"))
    # a re-assertion inside an open stretch has the same end: the earliest stands
    first = log.withColumns({"before": F.lag("until").over(own.orderBy("at")), "row": F.row_number().over(own.orderBy("at"))})
    kept = first.filter("row = 1 or (before is not null and before <= at)")
    return kept.select("subject", "relation", "object", F.col("ts").alias("valid_from"), F.col("until.ts").alias("valid_until"))


def facts_at(table: DataFrame, name: str | None, at: str | None) -> DataFrame:
    """Facts that touch name and hold at a time (now if null)."""
    t = instant(F.lit(at)) if at is not None else F.current_timestamp()
    if at is not None and table.sparkSession.range(1).select(t.alias("t")).first()[0] is None:
        raise ValueError(f"asOf {at!r} is neither a time nor a date")
    start, end = instant(F.col("valid_from").cast("string")), instant(F.col("valid_until").cast("string"))
    out = table.filter((start <= t) & (end.isNull() | (t < end)))
    return out if name is None else out.filter((F.col("subject") == name) | (F.col("object") == name))


def evidence(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """quotes (fact, chunk, quote) with the offset of the quote in its chunk (id, text); quotes that don't occur go."""
    found = quotes.join(chunks.select(F.col("id").alias("chunk"), "text"), "chunk")
    at = F.instr("text", F.col("quote"))
    return found.withColumn("offset", at - 1).filter("offset >= 0").select("fact", "chunk", "quote", "offset")
