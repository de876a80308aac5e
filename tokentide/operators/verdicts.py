"""Verdicts read from a report's text or its page: levels of phrases, markers at word starts, safe phrases, tickers and summaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a report says of a token too new to judge, and how a clean one is labelled.
INSUFFICIENT, CLEAN = "not enough data yet", "No red flags found"
#: Fixed value: markers that only caution; all others are red flags.
SOFT = ("caution", "warning", "⚠️", "⚠")
#: Counts of zero red flags, and the ticker in front of an on-chain check.
ZERO_FLAGS = r"(?i)\b(?:0|zero)\s+red\s+flags?\b|\bred\s+flags?\s*:\s*(?:0|none|zero)\b"
TICKER = r"(?i)(\$[^\s$]+)\s+on-chain check"
WORD_RUNE = r"[\p{L}\p{Nd}]"


def _quoted(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def no_zero_flags(text: Column) -> Column:
    """text with counts of zero red flags as `no red flags`; only texts that speak of flags are searched for them."""
    return F.when(F.lower(text).contains("flag"), F.regexp_replace(text, ZERO_FLAGS, "no red flags")).otherwise(text)


def level_of(phrase: Column) -> Column:
    """clean, red_flags, caution, insufficient or unknown: the first of these that the phrase names; zero red flags are none."""
    return _named(F.lower(no_zero_flags(phrase)))


def _named(t: Column) -> Column:
    return F.when(t.contains("no red flag"), "clean").when(t.contains("red flag"), "red_flags").when(t.contains("caution") | t.contains("warning"), "caution").when(t.contains(INSUFFICIENT), "insufficient").otherwise("unknown")


def without_phrases(text: Column, phrases: list[str]) -> Column:
    """text (lower case) with each safe phrase a space; a digit at a phrase's edge must not be part of a longer number or word."""
    for p in phrases:
        before = f"(?<!{WORD_RUNE})" if p[0].isdigit() else ""
        after = f"(?!{WORD_RUNE})" if p[-1].isdigit() else ""
        text = F.when(text.contains(p), F.regexp_replace(text, before + _quoted(p) + after, " ")).otherwise(text)
    return text


def starts_with_marker(text: Column, marker: str) -> Column:
    """The marker stands in text (lower case) at the start of a word, not behind `non-`; one that begins with no letter or digit, anywhere."""
    if not re.match(r"[^\W_]", marker):
        return text.contains(marker)
    return text.contains(marker) & text.rlike(f"(?<!{WORD_RUNE})(?<!(?<!{WORD_RUNE})non-)" + _quoted(marker))


def first_marker(rest: Column, markers: list[str]) -> Column:
    """The first marker of the list that holds in a text in lower case without its safe phrases; null without one. Markers in lower case."""
    return F.coalesce(*[F.when(starts_with_marker(rest, m), F.lit(m)) for m in markers], F.lit(None).cast("string"))


def text_verdict(rows: DataFrame, text: str, markers: list[str], safe: list[str]) -> DataFrame:
    """rows with level, label and ticker of a report's text.

    A clean phrase is overturned by a marker elsewhere; the report's own "not enough data yet" wins over markers unless it
    names a flag; without either, a marker decides, and else the level is unknown (null texts too). The label is the marker
    that decided.
    """
    # each step's text is a column of its own: the next uses it many times
    plain = rows.withColumn("_plain", F.lower(no_zero_flags(F.col(text))))
    for k, p in enumerate(safe):
        plain = plain.withColumn(f"_rest{k}", without_phrases(F.col(f"_rest{k - 1}" if k else "_plain"), [p]))
    rest = F.col(f"_rest{len(safe) - 1}" if safe else "_plain")
    found = plain.withColumns({"_phrase": F.when(F.col(text).isNotNull(), _named(F.col("_plain"))), "_marker": first_marker(rest, markers)})
    m, phrase = F.col("_marker"), F.coalesce("_phrase", F.lit("unknown"))
    named = level_of(m)
    of_marker = F.when(named != "unknown", named).when(m.isin(*SOFT), "caution").otherwise("red_flags")
    level = F.when(phrase == "insufficient", "insufficient").when(m.isNotNull(), of_marker).when(phrase == "clean", "clean").otherwise("unknown")
    label = F.when(level == "insufficient", INSUFFICIENT).when(m.isNotNull(), m).when(level == "clean", CLEAN)
    ticker = F.when(phrase == "insufficient", F.nullif(F.regexp_extract(F.col(text), TICKER, 1), F.lit("")))
    return found.select(*rows.columns, level.alias("level"), label.alias("label"), ticker.alias("ticker"))


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _meta(html: Column, name: str) -> Column:
    """Content of a page's og: tag, whichever attribute comes first; entities resolved, trimmed; null where there is none."""
    tag = f"""(?:property|name)=["']og:{name}["']"""
    found = F.lit(None).cast("string")
    for pattern in (rf"""(?is)<meta[^>]+content=["']([^"']*)["'][^>]*{tag}""", rf"""(?is)<meta[^>]+{tag}[^>]*content=["']([^"']*)["']"""):
        found = F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 1)).otherwise(found)
    return _unescaped(found)


def _unescaped(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return _bare(text)


def page_verdict(pages: DataFrame, html: str = "html", site: str = "", credit: str = "") -> DataFrame:
    """pages with level, label, ticker and summary, from the title `ticker: label | site` and the description of a report's page.

    The og: tags count before the title element. A description that says that there is not enough data yet makes an
    unknown level insufficient. The summary is the description without `credit`, its leading sentence on the check, and
    its last full stop.
    """
    page = F.col(html)
    element = r"(?is)<title[^>]*>(.*?)</title>"
    title = F.coalesce(_meta(page, "title"), F.when(page.rlike(element), _unescaped(F.regexp_extract(page, element, 1))), F.lit(""))
    title = _bare(F.regexp_replace(title, _quoted(f"| {site}") + "$", "")) if site else title
    at = F.instr(title, ": ")
    about = F.coalesce(_meta(page, "description"), F.lit(""))
    named = pages.withColumns({"_title": title, "_at": at, "_about": about})
    c = F.col
    label = F.when(c("_at") > 1, _bare(F.expr("substr(_title, _at + 2)"))).otherwise(c("_title"))
    said = level_of(label)
    level = F.when((said == "unknown") & (level_of(c("_about")) == "insufficient"), "insufficient").otherwise(said)
    ticker = F.when(c("_at") > 1, F.expr("substr(_title, 1, _at - 1)"))
    ticker = F.when((level == "insufficient") & ticker.isNull(), F.nullif(F.regexp_extract(c("_about"), TICKER, 1), F.lit(""))).otherwise(ticker)
    text = _bare(F.regexp_replace(c("_about"), _quoted(credit) + "$", "")) if credit else c("_about")
    stop = F.instr(text, ". ")
    checked = lambda t: F.lower(t).contains("on-chain check")
    rest = F.when((stop > 1) & checked(F.substring_index(text, ". ", 1)), _bare(F.substr(text, stop + 2))).when(checked(text), "").otherwise(text)
    return named.select(*pages.columns, level.alias("level"), F.when(level == "insufficient", INSUFFICIENT).otherwise(label).alias("label"), ticker.alias("ticker"), F.regexp_replace(rest, r"\.$", "").alias("summary"))
