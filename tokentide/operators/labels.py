"""Labels of the four holding buckets, the rules of use, features, category levels and families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentide.functions.expressions import EXTREME, net_pct

#: Bucket, days, runner column and limit, return column, collapse limit, whether a rug is a collapse.
BUCKETS = {
    "short": (1, "max_gain_late_1d", ">=", 100.0, "ret_late_1d", -50.0, False),
    "3day": (3, "ret_late_3d", ">=", 50.0, "ret_late_3d", -60.0, False),
    "medium": (7, "ret_late_7d", ">=", 50.0, "ret_late_7d", -70.0, False),
    "long": (30, "ret_late_30d", ">", 0.0, "ret_late_30d", -90.0, True),
}
#: States without a pool to trade in, trades of a first day below which a call is dead, or no runner.
NO_POOL = ("no_pool", "gave_up")
DEAD_TRADES, RUNNER_TRADES = 50, 100
#: Reasons why the 7-day bucket can't use a row, in order.
REASONS = (("update", "update"), ("repeat", "repeat"), ("no_pool", "no pool"), ("not_usd", "not usd"), ("extreme", "extreme"))
#: Prefix of a posted exchange name without separators, and its family; the first that fits counts.
FAMILIES = (
    ("pons", "pons"), ("uniswapv2", "uniswap_v2"), ("uniswapv3", "uniswap_v3"), ("uniswapv4", "uniswap_v4"), ("uniswap", "uniswap"), ("longxyz", "longxyz"), ("pools", "pools"),
    ("bankr", "bankr"), ("o1", "o1"), ("letscash", "letscash"), ("varo", "varo"), ("flap", "flap"), ("sushi", "sushi"), ("lunch", "lunch"),
)


def known(c: Column) -> Column:
    """A number that is there: NaN counts as missing."""
    return F.when(~F.isnan(c), c)


def exchange_family(name: Column) -> Column:
    """Family of a posted exchange name; `other` where no rule fits, null for an empty name."""
    plain = F.nullif(F.regexp_replace(F.lower(name), r"[\s_\-./]+", ""), F.lit(""))
    family = F.when(plain.isNull(), F.lit(None).cast("string"))
    for prefix, to in FAMILIES:
        family = family.when(plain.startswith(prefix), to)
    return family.otherwise("other")


def extreme() -> Column:
    """Any outcome that a label reads is above the cap; a missing one isn't."""
    columns = sorted({c for b in BUCKETS.values() for c in (b[1], b[4])})
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(known(F.col(c)) > EXTREME, F.lit(False))
    return hit


def flags(rows: DataFrame) -> DataFrame:
    """rows with update, repeat (not the first call of its token, or set aside as one), no_pool, not_usd, extreme and dead.

    The first call is the earliest dated one that isn't an update. no_pool asks for the late entry's price; rows from
    before it was kept (no such column) are judged by the entry's.
    """
    update = F.coalesce(F.col("post_kind") == "update", F.lit(False))
    # rows without a date or token have no place; they are dealt by id, so that they don't meet in one window
    token = F.nullif(F.lower(F.trim(F.col("token").cast("string"))), F.lit(""))
    placed = ~update & token.isNotNull() & F.col("message_date").isNotNull()
    order = Window.partitionBy(placed, F.when(placed, token).otherwise(F.col("call_id").cast("string"))).orderBy("message_date", "call_id")
    later = placed & (F.row_number().over(order) > 1)
    late = "entry_late_price" if "entry_late_price" in rows.columns else "entry_price"
    return rows.select(
        "*", update.alias("update"),
        (~update & (later | F.coalesce(F.col("tracking_status") == "repeat", F.lit(False)))).alias("repeat"),
        (known(F.col(late).cast("double")).isNull() | F.coalesce(F.col("tracking_status").isin(*NO_POOL), F.lit(False))).alias("no_pool"),
        (~F.coalesce(F.col("price_unit") == "usd", F.lit(False))).alias("not_usd"),
        extreme().alias("extreme"),
        F.coalesce(F.col("trades_24h") < DEAD_TRADES, F.lit(False)).alias("dead"),
    )


def build_labels(rows: DataFrame, dead_collapses: bool = False, needs_trades: bool = False, keep: list[str] | None = None) -> DataFrame:
    """call_id, the flags, for each bucket usable, runner, collapse, collapse_plain and net_ret (null where unusable), and `keep` of rows.

    A row is usable once all of a bucket's outcomes are there and no flag but dead holds. With `dead_collapses` a dead
    call is a collapse; with `needs_trades` a call of few trades is no runner. Unknown trades leave both as they are.
    """
    marked = flags(rows)
    free = ~(F.col("update") | F.col("repeat") | F.col("no_pool") | F.col("not_usd") | F.col("extreme"))
    thin = F.coalesce(F.col("trades_24h") < RUNNER_TRADES, F.lit(False)) if needs_trades else F.lit(False)
    out = []
    for b, (_, gain, op, least, ret, most, or_rugged) in BUCKETS.items():
        usable = free & known(F.col(gain)).isNotNull() & known(F.col(ret)).isNotNull()
        net = lambda c: net_pct(F.col(c), F.col("tax_buy_pct"), F.col("tax_sell_pct"))
        run = (net(gain) >= least if op == ">=" else net(gain) > least) & ~thin
        plain = net(ret) <= most
        plain = plain | F.coalesce("rugged", F.lit(False)) if or_rugged else plain
        fall = plain | F.col("dead") if dead_collapses else plain
        shown = lambda c: F.when(usable, c.cast("int"))  # noqa: B023, E731
        out += [usable.alias(f"usable_{b}"), shown(run).alias(f"runner_{b}"), shown(fall).alias(f"collapse_{b}"), shown(plain).alias(f"collapse_plain_{b}"), F.when(usable, F.round(net(ret), 6)).alias(f"net_ret_{b}")]
    return marked.select("call_id", "update", "repeat", "no_pool", "not_usd", "extreme", "dead", *out, *(keep or []))


def not_usable_reasons(labelled: DataFrame) -> DataFrame:
    """Rows that the 7-day bucket can't use by the first reason that holds; the counts add up."""
    why = F.lit("no 7d outcome")
    for flag, name in reversed(REASONS):
        why = F.when(F.col(flag), name).otherwise(why)
    return labelled.where(~F.col("usable_medium")).groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def label_rates(labelled: DataFrame) -> DataFrame:
    """Usable rows, runner and collapse rate and mean net return of each bucket."""
    each = [F.struct(F.lit(b).alias("bucket"), *[F.col(f"{c}_{b}").alias(c) for c in ("usable", "runner", "collapse", "net_ret")]) for b in BUCKETS]
    long = labelled.select(F.explode(F.array(*each)).alias("x")).select("x.*").where("usable")
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return long.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), rate("runner").alias("runner_rate"), rate("collapse").alias("collapse_rate"), F.round(F.avg("net_ret"), 4).alias("mean_net_ret"))


def features(rows: DataFrame, keep: list[str | Column] | None = None) -> DataFrame:
    """Inputs known at the call: ratios (null where the denominator is zero or missing), shares, hour and weekday, family; and `keep` of rows."""
    ratio = lambda a, b: F.try_divide(a, F.when(b > 0, b))
    c = F.col
    live = F.when(c("elite_usd").isNotNull() | c("good_usd").isNotNull(), F.coalesce("elite_usd", F.lit(0.0)) + F.coalesce("good_usd", F.lit(0.0)))
    usd = lambda v: F.when(c("price_unit") == "usd", c(v))
    made = {
        "liq_to_mcap": ratio(c("liq_usd"), c("mcap_usd")), "live_usd_to_liq": ratio(live, c("liq_usd")), "live_usd_to_mcap": ratio(live, c("mcap_usd")), "mcap_vs_called": ratio(c("mcap_usd"), c("called_at_mcap_usd")),
        "pre_buy_sell_ratio": (c("pre_buys") + 1) / (c("pre_sells") + 1), "pre_buy_vol_share": ratio(usd("pre_buy_vol"), usd("pre_buy_vol") + usd("pre_sell_vol")),
    }
    return rows.select("call_id", *[F.round(v, 6).alias(k) for k, v in made.items()], usd("pre_buy_vol").alias("pre_buy_vol"), F.hour("message_date").alias("hour_utc"), F.weekday("message_date").alias("weekday_utc"), exchange_family(c("dex")).alias("dex_family"), *(keep or []))


#: Raw numbers of a call that are inputs as they are, and the windows of its last hour.
RAW = (
    "called_at_mcap_usd", "mcap_usd", "liq_usd", "liq_pct", "tax_buy_pct", "tax_sell_pct", "age_seconds", "holders", "proof_elite", "proof_good", "live_buys_elite_count", "live_buys_good_count",
    "live_buys_elite_usd", "live_buys_good_usd", "live_buy_max_usd", "calls_prev_1h", "calls_prev_24h", "pre_first_trade_age_s",
)
WINDOWS = ("5m", "15m", "60m")


def feature_table(rows: DataFrame, raw: tuple[str, ...] = RAW, windows: tuple[str, ...] = WINDOWS) -> DataFrame:
    """call_id and every numeric input: raw numbers, counts, volumes (only where quoted in USD), price changes, ratios, burst, calendar and family.

    A column that rows lack is null throughout, and what doesn't read as a finite number is null. Ratios with a zero or
    missing denominator are null; buys to sells are smoothed by one, so that they are finite.
    """
    have = set(rows.columns)

    def num(name: str) -> Column:
        if name not in have:
            return F.lit(None).cast("double")
        v = F.col(name).cast("string").try_cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)

    ratio = lambda a, b: F.try_divide(a, F.when(b > 0, b))
    usd = lambda name: F.when(F.col("pre_vol_unit") == "usd", num(name)) if "pre_vol_unit" in have else F.lit(None).cast("double")
    elite, good = num("live_buys_elite_usd"), num("live_buys_good_usd")
    live = F.when(elite.isNotNull() | good.isNotNull(), F.coalesce(elite, F.lit(0.0)) + F.coalesce(good, F.lit(0.0)))
    made = {c: num(c) for c in raw}
    for w in windows:
        made |= {f"pre_{k}_{w}": num(f"pre_{k}_{w}") for k in ("swaps", "buys", "sells")} | {f"pre_{k}_{w}": usd(f"pre_{k}_{w}") for k in ("buy_vol", "sell_vol")}
        made |= {f"pre_price_chg_{w}_pct": num(f"pre_price_chg_{w}_pct"), f"pre_buy_sell_ratio_{w}": (num(f"pre_buys_{w}") + 1) / (num(f"pre_sells_{w}") + 1)}
        made[f"pre_buy_vol_share_{w}"] = ratio(usd(f"pre_buy_vol_{w}"), usd(f"pre_buy_vol_{w}") + usd(f"pre_sell_vol_{w}"))
    made |= {"liq_to_mcap": ratio(num("liq_usd"), num("mcap_usd")), "live_usd_to_liq": ratio(live, num("liq_usd")), "live_usd_to_mcap": ratio(live, num("mcap_usd")), "mcap_vs_called": ratio(num("mcap_usd"), num("called_at_mcap_usd"))}
    made["calls_prev_burst"] = burst(num("calls_prev_1h"), num("calls_prev_24h"))
    when = F.col("message_date").try_cast("timestamp") if "message_date" in have else F.lit(None).cast("timestamp")
    family = exchange_family(F.col("dex")) if "dex" in have else F.lit(None).cast("string")
    return rows.select("call_id", *[v.alias(k) for k, v in made.items()], F.hour(when).alias("hour_utc"), F.weekday(when).alias("weekday_utc"), family.alias("dex_family"))


def burst(last_hour: Column, last_day: Column) -> Column:
    """Posting rate of the last hour relative to the last day's; a day without posts counts as one, a missing count gives null."""
    return last_hour * 24 / F.when(last_day.isNotNull(), F.greatest(last_day, F.lit(1)))


def category_levels(train: DataFrame, columns: dict[str, Column], least: int = 20) -> DataFrame:
    """column, level and code of the levels that training rows show at least `least` times, without regard to case and spaces."""
    cells = F.array(*[F.struct(F.lit(n).alias("column"), F.nullif(F.trim(F.lower(c)), F.lit("")).alias("level")) for n, c in columns.items()])
    counts = train.select(F.explode(cells).alias("x")).select("x.*").where("level is not null").groupBy("column", "level").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return counts.withColumn("code", F.row_number().over(Window.partitionBy("column").orderBy("level")) - 1)


def coded(rows: DataFrame, levels: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with <name>_code; an unknown level is null. levels is a handful of rows for each column."""
    mine = levels.where(F.col("column") == name).select(F.col("level").alias("_level"), F.col("code").alias(f"{name}_code"))
    return rows.withColumn("_value", F.nullif(F.trim(F.lower(value)), F.lit(""))).join(mine, F.col("_value") == F.col("_level"), "left").drop("_value", "_level")


def dead_waves(rows: DataFrame) -> DataFrame:
    """Dead calls of each Monday week, the share of all of them, and the commonest family among them."""
    dead = flags(rows).where("dead and not update").select(F.date_format(F.date_trunc("week", F.col("message_date")), "yyyy-MM-dd").alias("week"), F.coalesce(exchange_family(F.col("dex")), F.lit("missing")).alias("family"))
    families = dead.groupBy("week", "family").agg(F.count(F.lit(1)).alias("n"))
    weeks = families.groupBy("week").agg(F.sum("n").alias("n_dead"), F.max(F.struct("n", F.col("family"))).alias("top"))
    total = families.agg(F.sum("n").alias("total"))
    return weeks.crossJoin(F.broadcast(total)).select("week", "n_dead", F.round(F.col("n_dead") / F.col("total"), 6).alias("share"), F.col("top.family").alias("top_family"), F.col("top.n").alias("top_family_n"))  # one row


def dead_stats(rows: DataFrame, part: Column) -> DataFrame:
    """Known and dead calls of each part, and the dead share."""
    k = F.count("trades_24h")
    d = F.count_if(F.col("trades_24h") < DEAD_TRADES)
    return rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), k.alias("known"), d.alias("dead"), F.round(F.try_divide(d, k), 6).alias("dead_share"))
