"""Posts to tables: addresses, parsed numbers, live buys, post kind, and verdicts of report texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentide.functions.expressions import age_seconds, parse_usd

EVM = r"\b(0x[0-9a-fA-F]{40})\b"
BASE58 = r"\b([1-9A-HJ-NP-Za-km-z]{32,44})\b"
WALLET_LINK = r"(?i)/(tx|address|account|wallet)/"


def extract_addresses(posts: DataFrame) -> DataFrame:
    """Contract addresses of a post, text before links, once per address; links to wallets and transactions don't count."""
    links = F.filter("urls", lambda u: ~u.rlike(WALLET_LINK))
    sources = F.concat(F.array(F.coalesce("text", F.lit(""))), F.coalesce(links, F.array().cast("array<string>")))
    evm = F.flatten(F.transform(sources, lambda s: F.regexp_extract_all(s, F.lit(EVM), F.lit(1))))
    base58 = F.filter(F.flatten(F.transform(sources, lambda s: F.regexp_extract_all(s, F.lit(BASE58), F.lit(1)))), lambda a: a.rlike("[0-9]") & a.rlike("[A-Z]") & a.rlike("[a-z]"))
    found = posts.select("channel_id", "message_id", "message_date", F.posexplode(F.concat(evm, base58)).alias("pos", "address"))
    key = F.when(F.col("address").startswith("0x"), F.lower("address")).otherwise(F.col("address"))
    w = Window.partitionBy("channel_id", "message_id", "address_key").orderBy("pos")
    return found.withColumn("address_key", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("channel_id", "message_id", "message_date", "address", "address_key")


def parse_metrics(posts: DataFrame, text: str = "text") -> DataFrame:
    """Numbers of a call post; what isn't there is null."""
    t = F.col(text)
    first = lambda pattern, group=1: F.nullif(F.trim(F.regexp_extract(t, pattern, group)), F.lit(""))
    money = lambda pattern: parse_usd(first(pattern, 1), F.regexp_extract(t, pattern, 2))
    return posts.select(
        *[c for c in posts.columns if c != text],
        first(r"\$([A-Za-z0-9_]+)").alias("token_symbol"),
        money(r"(?i)called at:?\s*\$([\d,.]+)([kmb]?)").alias("called_at_mcap_usd"),
        money(r"(?i)mcap:?\s*\$([\d,.]+)([kmb]?)").alias("mcap_usd"),
        money(r"(?i)liq:?\s*\$([\d,.]+)([kmb]?)").alias("liq_usd"),
        first(r"(?i)liq:?[^\n|]*\|\s*([\d.]+)%").try_cast("double").alias("liq_pct"),
        first(r"(?i)tax:?\s*B\s*([\d.]+)%").try_cast("double").alias("tax_buy_pct"),
        first(r"(?i)tax:?[^\n]*S\s*([\d.]+)%").try_cast("double").alias("tax_sell_pct"),
        age_seconds(F.regexp_extract(t, r"(?i)age:?\s*([^\n|]+)", 1)).alias("age_seconds"),
        F.regexp_replace(first(r"(?i)holders:?\s*([\d,]+)"), ",", "").try_cast("long").alias("holders"),
        post_kind(t).alias("post_kind"),
    )


def post_kind(text: Column) -> Column:
    """`update` where a text says `hit 3x` and isn't a full call (market value and liquidity); an empty text is a call."""
    full = text.rlike(r"(?i)mcap:?\s*\$") & text.rlike(r"(?i)liq:?\s*\$")
    return F.when(F.coalesce(text.rlike(r"(?i)\bhit\s+\d+(\.\d+)?x\b") & ~full, F.lit(False)), "update").otherwise("call")


def live_buys(posts: DataFrame, text: str = "text") -> DataFrame:
    """Lines after the header `live buys`: position, tier, amount and wallet."""
    after = F.split_part(F.col(text), F.lit("Live buys"), F.lit(2))
    lines = posts.select("message_id", F.posexplode(F.split(after, "\n")).alias("line_no", "line"))
    pattern = r"^(Elite|Good)\s+\$([\d,.]+)([kmb]?)\s+(\w{4})\.\.\.(\w{4})$"
    hit = lines.where(F.col("line").rlike(pattern))
    part = lambda g: F.regexp_extract("line", pattern, g)
    w = Window.partitionBy("message_id").orderBy("line_no")
    return hit.select("message_id", F.row_number().over(w).alias("position"), F.lower(part(1)).alias("tier"), parse_usd(part(2), part(3)).alias("amount_usd"), part(4).alias("wallet_prefix"), part(5).alias("wallet_suffix"))


def has_marker(text: Column, marker: str) -> Column:
    """The marker starts a word, and `non-` before it cancels."""
    return F.lower(text).rlike(r"(?<![\p{L}\p{N}])(?<!(?<![\p{L}\p{N}])non-)" + marker.lower())


def text_verdict(text: Column, safe: str, caution: list[str], danger: list[str]) -> Column:
    """Level of a report text: danger before caution before clean; safe phrases are taken out first, but not within a longer number."""
    rest = F.regexp_replace(F.lower(text), r"(?<!\d)" + safe, " ")
    some = lambda markers: F.greatest(*[has_marker(rest, m) for m in markers], F.lit(False))
    return F.when(text.isNull() | ~text.rlike(r"\S"), "insufficient").when(some(danger), "red_flags").when(some(caution), "caution").otherwise("clean")


def page_titles(pages: DataFrame) -> DataFrame:
    title = F.nullif(F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    return pages.select("page_id", title.alias("title"))
