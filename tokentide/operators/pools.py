"""Which rows a lane takes up next: latest prices, re-scans, re-asks, re-checks, gaps and retries, and why others are left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentide.operators.listing import REAL, is_decline, plain_name, reply_class

#: Fixed value: latest return at or below which a call is wiped out.
WIPED = -99.0


def due_latest(rows: DataFrame, now: int, recent_age: int, recent: int, old: int) -> DataFrame:
    """Rows whose latest price is due: young calls without a rug after `recent`, others after `old`; young first, never read first.

    rows: call_id, entry_t, checked_t, status, entry_price, rugged; times and ages in one unit.
    """
    young = F.col("entry_t") > now - recent_age
    limit = F.when(young & ~F.coalesce("rugged", F.lit(False)), F.lit(now - recent)).otherwise(F.lit(now - old))
    due = rows.where(F.col("status").isin("tracking", "done") & F.col("entry_price").isNotNull() & (F.col("checked_t").isNull() | (F.col("checked_t") <= limit)))
    return due.select("*", young.alias("young")).orderBy(F.desc("young"), F.asc_nulls_first("checked_t"), "call_id")


def tracking_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("checked_t").alias("next_t"))


def rescan_pool(firsts: DataFrame, reports: DataFrame, tool: str = "gate") -> DataFrame:
    """First calls whose token has no usable verdict, with rugged, wiped, and how many re-scans failed.

    A re-scan failed if it ended so, or completed without a real verdict.
    """
    mine = reports.where(F.col("tool") == tool)
    real = F.coalesce(F.col("verdict_level").isin(*REAL), F.lit(False))
    per = mine.groupBy("token").agg(
        F.max(F.coalesce((F.col("status") == "completed") & real, F.lit(False))).alias("_usable"),
        F.count_if((F.col("scan_kind") == "rescan") & (F.col("status").isin("failed", "timeout") | ((F.col("status") == "completed") & ~real))).alias("failed_rescans"),
    )
    pool = firsts.join(per, "token", "left").where(~F.coalesce("_usable", F.lit(False)))
    return pool.select("call_id", "token", "message_date", F.coalesce("rugged", F.lit(False)).alias("rugged"), F.coalesce(F.col("latest_return_pct") <= WIPED, F.lit(False)).alias("wiped"), F.coalesce("failed_rescans", F.lit(0)).alias("failed_rescans"))


def reask_pool(firsts: DataFrame, reports: DataFrame, tool: str = "second") -> DataFrame:
    """First calls whose latest live answer is missing, empty or a decline, with the reason and what else the token has."""
    mine = reports.where(F.col("tool") == tool)
    latest = mine.where("scan_kind = 'live' and call_id is not null").groupBy("call_id").agg(F.max_by(F.struct("status", "report_text"), F.struct("requested_t", "id")).alias("x"))
    kind = reply_class(F.col("x.status"), F.col("x.report_text"))
    open_ = latest.select("call_id", kind.alias("reason")).where("reason <> 'report'")
    text = F.coalesce(F.col("report_text").rlike(r"\S"), F.lit(False)) & ~is_decline(F.col("report_text"))
    has = reports.groupBy("token").agg(F.max(F.col("scan_kind") == "reask").alias("reasked"), F.max((F.col("tool") == tool) & (F.col("status") == "completed") & (F.col("scan_kind") == "live") & text).alias("has_report"))
    return firsts.join(open_, "call_id").join(has, "token", "left").select("call_id", "token", "reason", F.coalesce("rugged", F.lit(False)).alias("rugged"), F.coalesce(F.col("latest_return_pct") <= WIPED, F.lit(False)).alias("wiped"), F.coalesce("reasked", F.lit(False)).alias("reasked"), F.coalesce("has_report", F.lit(False)).alias("has_report"))


def reask_summary(pool: DataFrame) -> DataFrame:
    """Rows by the first exclusion that holds, else ready."""
    why = F.when(F.col("rugged"), "rugged").when(F.col("wiped"), "wiped").when(F.col("reasked"), "asked again").when(F.col("has_report"), "has a report").otherwise("ready")
    return pool.groupBy(why.alias("state"), "reason").agg(F.count(F.lit(1)).alias("n"))


def recheck_pool(firsts: DataFrame, reports: DataFrame, tool: str = "gate") -> DataFrame:
    """First calls whose own live answer completed without a readable verdict: its moment, and whether the token has a usable one by now."""
    mine = reports.where((F.col("tool") == tool) & (F.col("status") == "completed"))
    unread = ~F.coalesce(F.col("verdict_level").isin(*REAL), F.lit(False))
    first = mine.where((F.col("scan_kind") == "live") & unread & F.col("call_id").isNotNull()).groupBy("call_id").agg(F.min_by(F.struct("id", "requested_t"), F.struct("requested_t", "id")).alias("x"))
    usable = mine.groupBy("token").agg(F.max(~unread).alias("usable"), F.count_if(F.col("scan_kind") == "rescan").alias("rechecks"))
    delivered = reports.where("call_id is not null").groupBy("call_id").agg(F.max("delivered").alias("delivered"))
    j = firsts.join(first, "call_id").join(usable, "token", "left").join(delivered, "call_id", "left")
    return j.select("call_id", "token", F.col("x.id").alias("held_id"), F.col("x.requested_t").alias("held_t"), F.coalesce("usable", F.lit(False)).alias("usable"), F.coalesce("rechecks", F.lit(0)).alias("rechecks"), F.coalesce("delivered", F.lit(False)).alias("delivered"))


def recheck_steps(pool: DataFrame, age: Column, after: int, most: int, after2: int, most2: int) -> DataFrame:
    """What to do with each row by its age: deliver, wait, first, second or nothing, and which steps were missed.

    A first re-check that found a usable verdict is delivered while it is young; the second is made unless one was usable.
    """
    first_done, second_done = F.col("rechecks") >= 1, F.col("rechecks") >= 2
    deliver = first_done & ~F.col("delivered") & F.col("usable")
    ask = ~first_done & ~F.col("delivered")
    step = (
        F.when(deliver & (age <= most), "deliver").when(F.col("usable"), "nothing").when(ask & (age < after), "wait").when(ask & (age <= most), "first")
        .when(F.lit(after2 <= 0) | second_done, "nothing").when(age < after2, "wait").when(age <= most2, "second").otherwise("nothing")
    )
    late = lambda c: F.coalesce(c, F.lit(False))
    return pool.select("call_id", step.alias("step"), late(deliver & (age > most)).alias("deliver_missed"), late(~F.col("usable") & ask & (age > most)).alias("first_missed"), late(~F.col("usable") & ~(ask & (age <= most)) & F.lit(after2 > 0) & ~second_done & (age > most2)).alias("second_missed"))


def gap(posts: DataFrame, known: DataFrame, cursor: int, position: str, key: list[str]) -> DataFrame:
    """Posts behind a cursor that aren't recorded yet."""
    return posts.where(F.col(position) > cursor).join(known.select(*key).distinct(), key, "left_anti")


def retry_groups(rows: DataFrame, statuses: list[str], places: list[str], name: str) -> DataFrame:
    """Rows of some statuses at some launch places (names compared without case and signs), counted by both."""
    wanted = rows.where(F.col("tracking_status").isin(*statuses)).withColumn("place", plain_name(F.col(name))).where(F.col("place").isin(*places))
    return wanted.groupBy("tracking_status", "place").agg(F.count(F.lit(1)).alias("n"), F.max("call_id").alias("newest"))


def reset(rows: DataFrame, chosen: Column) -> DataFrame:
    """rows set back to be tried again: status and attempts anew where chosen, what was found is kept."""
    return rows.withColumns({"tracking_status": F.when(chosen, "tracking").otherwise(F.col("tracking_status")), "attempts": F.when(chosen, 0).otherwise(F.col("attempts"))})


def find_answers(reports: DataFrame, tool: str | None = None, verdict: str | None = None, kinds: list[str] | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
    """Answers that pass every filter given."""
    rows = reports
    for wanted, test in ((tool, F.col("tool") == tool), (verdict, F.col("verdict_level") == verdict), (since, F.col("requested_t") >= (since or 0)), (until, F.col("requested_t") < (until or 0))):
        rows = rows.where(test) if wanted is not None else rows
    return rows.where(F.col("scan_kind").isin(*kinds)) if kinds else rows


def relabelled(reports: DataFrame) -> DataFrame:
    """Answers that read as unknown, though their text says that there isn't enough: insufficient. Doing it twice changes nothing."""
    says = F.coalesce(F.lower(F.col("report_text")).like("%not enough%"), F.lit(False))
    return reports.withColumn("verdict_level", F.when((F.col("verdict_level") == "unknown") & says, "insufficient").otherwise(F.col("verdict_level")))


def migrated(old: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """current with the rows of an older table that it doesn't have."""
    return current.unionByName(old.join(current.select(*key).distinct(), key, "left_anti").select(*current.columns))
