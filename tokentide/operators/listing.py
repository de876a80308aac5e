"""Views of calls, answers and tokens: latest verdicts and reports, the list row, counts, attributes, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Verdicts that say something; phrases of an answer that declines, their labels, and the length up to which it may.
REAL = ("clean", "caution", "red_flags")
DECLINES = {"not enough public": "not enough public signals", "too little liquidity": "too little liquidity or trading"}
DECLINE_LENGTH = 300
#: Fixed value: the largest market value that a supply may give.
MOST_MCAP = 1e13


def is_decline(text: Column) -> Column:
    """A short answer with a phrase of decline; long reports may mention one."""
    trimmed = F.regexp_replace(text, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")
    some = F.lit(False)
    for phrase in DECLINES:
        some = some | F.contains(F.lower(text), F.lit(phrase))
    return F.coalesce((F.char_length(trimmed) <= DECLINE_LENGTH) & some, F.lit(False))


def decline_reason(text: Column) -> Column:
    reason = F.lit("no reason given")
    for phrase, label in reversed(DECLINES.items()):
        reason = F.when(F.contains(F.lower(text), F.lit(phrase)), label).otherwise(reason)
    return reason


def report_id(links: Column) -> Column:
    """The 32 hex digits of a report's link, in lower case."""
    return F.lower(F.nullif(F.regexp_extract(links, r"/([0-9a-fA-F]{32})(?![0-9a-fA-F])", 1), F.lit("")))


def reply_class(status: Column, text: Column) -> Column:
    """What came of a request: its status unless completed, then empty, declined or report."""
    return F.when(status != "completed", status).when(~F.coalesce(text.rlike(r"\S"), F.lit(False)), "empty").when(is_decline(text), "declined").otherwise("report")


def clean_name(name: Column, most: int) -> Column:
    """No control characters, trimmed, cut at `most` characters; null for none."""
    return F.nullif(F.substring(F.trim(F.regexp_replace(name, r"\p{Cc}", "")), 1, most), F.lit(""))


def plain_name(name: Column) -> Column:
    """Lower case, letters and digits only: how launch places and exchanges are compared."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def pool_family(source: Column) -> Column:
    kind = F.regexp_extract(source, "^onchain-(.+)$", 1)
    return F.when(F.coalesce(source, F.lit("")) == "", "untracked").when(kind != "", kind).otherwise("gecko")


def level(verdict: Column) -> Column:
    return F.when(verdict.isin(*REAL, "insufficient"), verdict).otherwise("unknown")


def latest_verdict(reports: DataFrame, tool: str, kind: str) -> DataFrame:
    """token, verdict and its moment: the latest completed answer, real verdicts before others however old."""
    rows = reports.where((F.col("tool") == tool) & (F.col("status") == "completed") & (F.col("scan_kind") == kind))
    real = F.coalesce(F.col("verdict_level").isin(*REAL), F.lit(False))
    best = rows.groupBy("token").agg(F.max_by(F.struct(level(F.col("verdict_level")).alias("verdict"), "requested_t"), F.struct(real, "requested_t", "id")).alias("x"))
    return best.select("token", "x.verdict", "x.requested_t")


def best_report(reports: DataFrame, tool: str) -> DataFrame:
    """token and id of its best answer with text: reports before declines, calls before re-asks, then the newest."""
    rows = reports.where((F.col("tool") == tool) & (F.col("status") == "completed") & F.col("scan_kind").isin("live", "reask") & F.col("report_text").rlike(r"\S"))
    order = F.struct(~is_decline(F.col("report_text")), F.col("scan_kind") == "live", "requested_t", "id")
    best = rows.groupBy("token").agg(F.max_by(F.struct("id", "scan_kind", "requested_t"), order).alias("x"))
    return best.select("token", F.col("x.id").alias("report"), "x.scan_kind", F.col("x.requested_t").alias("report_t"))


def latest_of(live: Column, live_at: Column, today: Column, today_at: Column) -> Column:
    """The verdict at the call or of today: a real one beats another, then the newer, a tie is today's."""
    a, b = F.coalesce(live.isin(*REAL), F.lit(False)), F.coalesce(today.isin(*REAL), F.lit(False))
    return F.when(live.isNull(), today).when(today.isNull(), live).when(a & ~b, live).when(b & ~a, today).when(live_at > today_at, live).otherwise(today)


def positive(value: Column) -> Column:
    return F.when((value > 0) & ~F.isnan(value) & (value < float("inf")), value)


def market_values(rows: DataFrame) -> DataFrame:
    """call_id with the value at the call, now, and by supply; only calls priced in USD have any."""
    c, usd = F.col, F.col("price_unit") == "usd"
    base = F.coalesce(positive(c("mcap_usd")), positive(c("called_at_mcap_usd")))
    now = positive(base * positive(c("latest_price")) / positive(c("entry_price")))
    supply = positive(c("entry_price")) * positive(c("token_supply"))
    return rows.select("call_id", F.when(usd, F.coalesce(positive(c("called_at_mcap_usd")), positive(c("mcap_usd")))).alias("call_mcap"), F.when(usd, F.round(now, 3)).alias("latest_mcap"), F.when(usd & (supply > 0) & (supply <= MOST_MCAP), F.round(supply, 2)).alias("supply_mcap"))


def latest_return(rows: DataFrame) -> DataFrame:
    """call_id, return of the latest price against the entry (a rugged call has lost all), and whether there is one."""
    value = F.when(F.coalesce("rugged", F.lit(False)), F.lit(-100.0)).otherwise(F.round((F.col("latest_price") / positive(F.col("entry_price")) - 1) * 100, 6))
    return rows.select("call_id", value.alias("latest_return_pct"), value.isNotNull().alias("known"))


def answers(reports: DataFrame) -> DataFrame:
    """For each call the level of each tool side by side, and whether any answer was delivered."""
    of = lambda tool: F.max(F.when((F.col("tool") == tool) & (F.col("status") == "completed"), F.col("verdict_level")))
    return reports.where("call_id is not null").groupBy("call_id").agg(of("gate").alias("gate_level"), of("second").alias("second_level"), F.max("delivered").alias("delivered"), F.count(F.lit(1)).alias("answers"))


def passed_reports(reports: DataFrame) -> DataFrame:
    """Answers of the second tool for tokens that the gate found clean."""
    passed = reports.where("tool = 'gate' and status = 'completed' and verdict_level = 'clean'").select("token").distinct()
    return reports.where("tool = 'second' and status = 'completed'").join(passed, "token", "left_semi").select("id", "token", "verdict_level")


def reliability(reports: DataFrame, day: Column) -> DataFrame:
    """Requests of each tool and day, those completed, and the share."""
    done = F.count_if(F.col("status") == "completed")
    return reports.groupBy(day.alias("day"), "tool").agg(F.count(F.lit(1)).alias("n"), done.alias("completed"), F.round(done / F.count(F.lit(1)), 6).alias("share"))


def filled(rows: DataFrame, key: Column, value: str, order: list[Column], newest: bool) -> DataFrame:
    """rows with missing values copied from the same token: of its newest (or oldest) row that has one."""
    known = rows.where(F.col(value).isNotNull()).groupBy(key.alias("_k")).agg((F.max_by if newest else F.min_by)(value, F.struct(*order)).alias("_v"))
    return rows.join(known, key == F.col("_k"), "left").withColumn(value, F.coalesce(value, "_v")).drop("_k", "_v")


def missing_attribute(rows: DataFrame, key: str, value: str, order: str, usable: Column, block: str) -> DataFrame:
    """Tokens of which no row has the value: newest row and the first usable block."""
    return rows.groupBy(key).agg(F.max(order).alias("newest"), F.min_by(block, F.when(usable, F.col(order))).alias("first_block"), F.count(value).alias("_n")).where("_n = 0").drop("_n")


def fingerprint(rows: DataFrame) -> DataFrame:
    """One row that tells whether a table's content changed: its size and an order-free sum of row hashes."""
    text = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias("content"))


def token_list(calls: DataFrame, firsts: DataFrame, counts: DataFrame, live: DataFrame, today: DataFrame, report: DataFrame, values: DataFrame) -> DataFrame:
    """One row per token: its first call with what was tracked, how often it was called, verdicts, best report and market values."""
    rows = calls.join(firsts, "call_id", "left_semi").join(counts, "token", "left")
    rows = rows.join(live.select("token", F.col("verdict").alias("live_verdict"), F.col("requested_t").alias("_live_t")), "token", "left")
    rows = rows.join(today.select("token", F.col("verdict").alias("today_verdict"), F.col("requested_t").alias("_today_t")), "token", "left")
    rows = rows.join(report, "token", "left").join(values, "call_id", "left")
    shown = latest_of(F.col("live_verdict"), F.col("_live_t"), F.col("today_verdict"), F.col("_today_t"))
    return rows.withColumn("shown_verdict", shown).drop("_live_t", "_today_t")


def summary(rows: DataFrame) -> DataFrame:
    """Counts of the list in one row."""
    status = lambda s: F.count_if(F.col("tracking_status") == s)
    return rows.agg(
        F.count(F.lit(1)).alias("imported"), F.count("tracking_status").alias("tracked"), status("done").alias("done"), status("tracking").alias("tracking"), status("no_pool").alias("no_pool"), status("gave_up").alias("gave_up"),
        status("repeat").alias("repeats"), F.count_if(F.col("post_kind") == "update").alias("updates"), F.count_if(F.col("price_unit") != "usd").alias("no_usd"),
    )


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """How two sources of one figure agree."""
    x, y = F.col(a), F.col(b)
    return rows.agg(F.count_if(x.isNotNull() & y.isNotNull() & (x == y)).alias("equal"), F.count_if(x.isNotNull() & y.isNotNull() & (x != y)).alias("differ"), F.count_if(x.isNotNull() & y.isNull()).alias("only_a"), F.count_if(x.isNull() & y.isNotNull()).alias("only_b"))
