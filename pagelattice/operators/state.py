"""Analysis sessions kept in tables: creation, page upserts, expiry, progress and eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import valid_session_id

MOST_PAGES = 50


def created(events: DataFrame) -> DataFrame:
    """Sessions from create events (session_id, total, ts, seq): total and times.

    Raises on an id or total out of range, and on a total that changes.
    """
    total = F.col("total")
    fault = (
        F.when(~F.coalesce(valid_session_id(F.col("session_id")), F.lit(False)), "the session id is not valid")
        .when(total.isNull() | (total < 1) | (total > MOST_PAGES), "the number of pages must be 1 to 50")
    )
    checked = events.withColumn("total", F.when(fault.isNull(), total).otherwise(F.raise_error(fault).cast("int")))
    grouped = checked.groupBy("session_id").agg(
        F.min("total").alias("least"), F.max("total").alias("most"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at")
    )
    same = F.when(F.col("least") == F.col("most"), F.col("most")).otherwise(F.raise_error(F.lit("the number of pages changed")).cast("int"))
    return grouped.select("session_id", same.alias("total"), "created_at", "updated_at")


def latest_pages(pages: DataFrame) -> DataFrame:
    """The last write of each page (session_id, idx, name, ts, seq)."""
    last = F.max_by(F.struct("name", "ts"), F.struct("ts", "seq"))
    return pages.groupBy("session_id", "idx").agg(last.alias("p")).select("session_id", "idx", "p.name", "p.ts")


def touched(sessions: DataFrame, writes: DataFrame) -> DataFrame:
    """Sessions with the time of their last write; reads do not count."""
    last = writes.groupBy("session_id").agg(F.max("ts").alias("last_write"))
    out = sessions.join(last, "session_id", "left")
    return out.withColumn("updated_at", F.greatest("updated_at", F.coalesce("last_write", "updated_at"))).drop("last_write")


def alive(sessions: DataFrame, now: Column, ttl: Column) -> DataFrame:
    """Sessions not older than ttl; one that is exactly ttl old stays."""
    return sessions.where(F.col("updated_at") >= now - ttl)


def evicted(sessions: DataFrame, capacity: int) -> DataFrame:
    """What a full cache keeps: the sessions updated last, ties by id.

    A bounded sort (top capacity), not a global window.
    """
    return sessions.orderBy(F.desc("updated_at"), "session_id").limit(capacity)


def progress(sessions: DataFrame, pages: DataFrame) -> DataFrame:
    """Completed pages and percent with two places, rounded half up."""
    done = pages.join(sessions.select("session_id", "total"), "session_id").where("idx between 0 and total - 1")
    done = done.groupBy("session_id").agg(F.countDistinct("idx").alias("completed"))
    out = sessions.select("session_id", "total").join(done, "session_id", "left")
    n = F.coalesce("completed", F.lit(0))
    percent = F.floor(n / F.col("total") * 10000 + F.lit(0.5)) / 100
    return out.select("session_id", "total", n.alias("completed"), percent.alias("progress"), (n == F.col("total")).alias("complete"))


def ordered_pages(sessions: DataFrame, pages: DataFrame, whole: bool = False) -> DataFrame:
    """Every index of every session in order, pending ones with a null name; `whole` raises on those."""
    slots = sessions.select("session_id", F.explode(F.sequence(F.lit(0), F.col("total") - 1)).alias("idx"))
    out = slots.join(pages.select("session_id", "idx", "name", F.lit(True).alias("here")), ["session_id", "idx"], "left")
    status = F.when(F.col("here"), "completed").otherwise("pending")
    if whole:
        status = F.when(F.col("here"), "completed").otherwise(F.raise_error(F.concat(F.lit("page missing: "), F.col("idx") + 1)))
    return out.select("session_id", "idx", "name", status.alias("status"))


def with_quality(sessions: DataFrame, reports: DataFrame) -> DataFrame:
    """Sessions with the report stored last (session_id, report, ts, seq); storing touches the session."""
    last = reports.groupBy("session_id").agg(F.max_by("report", F.struct("ts", "seq")).alias("report"))
    return touched(sessions, reports).join(last, "session_id", "left")


def found(sessions: DataFrame, session_id: str, now: Column, ttl: Column) -> DataFrame:
    """The live session of that id: one row or none."""
    return alive(sessions, now, ttl).where(F.col("session_id") == session_id)


def required(sessions: DataFrame, session_id: str, now: Column, ttl: Column) -> DataFrame:
    """The live session of that id; raises, when it is read, where there is none."""
    one = found(sessions, session_id, now, ttl).agg(F.max_by(F.struct("*"), "updated_at").alias("s"))
    gone = F.raise_error(F.lit(f"session expired: {session_id}"))
    return one.select(F.when(F.col("s").isNull(), gone.cast(one.schema["s"].dataType)).otherwise(F.col("s")).alias("s")).select("s.*")


def deleted(sessions: DataFrame, pages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and pages without those of the ids (session_id)."""
    return sessions.join(ids, "session_id", "left_anti"), pages.join(ids, "session_id", "left_anti")


def settled(results: DataFrame) -> DataFrame:
    """Results (page_id, seq, value, error) with the status of each: fulfilled with its value, or rejected with a reason."""
    bad = F.col("error").isNotNull()
    state = F.struct(
        F.when(bad, "rejected").otherwise("fulfilled").alias("status"), F.when(~bad, F.col("value")).alias("value"),
        F.col("error").alias("reason"),
    )
    return results.withColumn("settled", state).drop("value", "error")


def oldest(sessions: DataFrame) -> DataFrame:
    """The session that a full cache gives up first."""
    return sessions.orderBy("updated_at", "session_id").limit(1)
