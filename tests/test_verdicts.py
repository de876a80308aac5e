"""Levels, markers, safe phrases and report pages on texts worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tokentide.operators import verdicts

MARKERS = ["red flag", "honeypot", "mintable", "scam", "caution", "🚩", "⚠️"]
SAFE = ["no red flag", "honeypot: no", "0 warnings", "no scam"]


@pytest.mark.parametrize(("phrase", "level"), [
    ("No red flags found", "clean"), ("0 red flags", "clean"), ("zero  Red Flag", "clean"), ("Red flags: 0", "clean"), ("red flag : none", "clean"), ("10 red flags", "red_flags"), ("Red flags: 0x12", "red_flags"),
    ("Red flags", "red_flags"), ("Caution", "caution"), ("a WARNING", "caution"), ("Not enough data yet", "insufficient"), ("hello", "unknown"), ("", "unknown"), ("caution and red flags", "red_flags"),
])
def test_levels(spark, phrase, level):
    assert spark.range(1).select(verdicts.level_of(F.lit(phrase)).alias("x")).first()["x"] == level


@pytest.mark.parametrize(("text", "level", "label", "ticker"), [
    ("No red flags found", "clean", "No red flags found", None), ("no red flags, but a Honeypot", "red_flags", "honeypot", None), ("No red flags. Caution advised", "caution", "caution", None),
    ("$SNIFF on-chain check: not enough data yet ⚠️", "insufficient", "not enough data yet", "$SNIFF"), ("not enough data yet, caution", "caution", "caution", None), ("honeypot: no", "unknown", None, None),
    ("unmintable and non-mintable", "unknown", None, None), ("canon-mintable", "red_flags", "mintable", None), ("not mintable", "red_flags", "mintable", None), ("precaution", "unknown", None, None), ("ok 🚩", "red_flags", "🚩", None),
    ("x⚠️y", "caution", "⚠️", None), ("scamper", "red_flags", "scam", None), ("no scam here", "unknown", None, None), ("0 red flags", "clean", "No red flags found", None), ("10 red flags", "red_flags", "red flag", None),
    ("nothing", "unknown", None, None), ("", "unknown", None, None), (None, "unknown", None, None),
])
def test_text_verdicts(spark, text, level, label, ticker):
    r = verdicts.text_verdict(spark.createDataFrame([(1, text)], "id long, text string"), "text", MARKERS, SAFE).first()
    assert (r["level"], r["label"], r["ticker"]) == (level, label, ticker)


def test_safe_phrases_with_digits_stand_alone(spark):
    one = lambda t: spark.range(1).select(verdicts.without_phrases(F.lit(t), ["0 warnings", "red flags: 0"]).alias("x")).first()["x"]
    assert one("0 warnings") == " " and one("20 warnings") == "20 warnings" and one("a 0 warnings b") == "a   b" and one("red flags: 0x1") == "red flags: 0x1" and one("red flags: 0.") == " ."


@pytest.mark.parametrize(("html", "want"), [
    ('<meta property="og:title" content="$ANYR: No red flags found | Site"><title>other</title>', ("clean", "No red flags found", "$ANYR", "")),
    ("<META content='$D: Caution | Site' name='og:title'>", ("caution", "Caution", "$D", "")),
    ('<title>\n$NH: Red flags | Site </title><meta name="og:description" content="$NH on-chain check: red flags. Top 10 hold 40%; Liquidity PULLED. By Site">', ("red_flags", "Red flags", "$NH", "Top 10 hold 40%; Liquidity PULLED")),
    ('<title>Report | Site</title><meta property="og:description" content="$SNIFF on-chain check: not enough data yet. By Site">', ("insufficient", "not enough data yet", "$SNIFF", "")),
    ("<title>A &amp; B: 0 red flags</title>", ("clean", "0 red flags", "A & B", "")), ('<meta property="og:description" content="Plain text.">', ("unknown", "", None, "Plain text")), ("", ("unknown", "", None, "")), (None, ("unknown", "", None, "")),
])
def test_page_verdicts(spark, html, want):
    r = verdicts.page_verdict(spark.createDataFrame([(1, html)], "id long, html string"), site="Site", credit="By Site").first()
    assert (r["level"], r["label"], r["ticker"], r["summary"]) == want
