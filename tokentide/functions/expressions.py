"""Column expressions of the call analytics: text parsing, labels, bands, intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper limits of the return bands; a value on a limit goes to the band away from zero.
BANDS = [-75.0, -50.0, -25.0, 0.0, 25.0, 50.0, 100.0, 300.0]
#: A return above this is a broken price, not a result.
EXTREME = 1e5


def parse_usd(number: Column, suffix: Column) -> Column:
    """Money text: commas out; k, m, b as powers of a thousand."""
    scale = F.when(F.lower(suffix) == "k", 1e3).when(F.lower(suffix) == "m", 1e6).when(F.lower(suffix) == "b", 1e9).otherwise(1.0)
    return F.regexp_replace(number, ",", "").try_cast("double") * scale


def age_seconds(text: Column) -> Column:
    """All parts of an age like `1d 2h` summed up in seconds; null if there is none."""
    numbers = F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)\s*([smhdw])"), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)\s*([smhdw])"), F.lit(2))
    unit = lambda u: F.when(u == "s", 1).when(u == "m", 60).when(u == "h", 3600).when(u == "d", 86400).otherwise(604800)
    total = F.aggregate(F.zip_with(numbers, units, lambda n, u: n.cast("double") * unit(u)), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(numbers) > 0, total.cast("long"))


def net_pct(gross: Column, buy_tax: Column, sell_tax: Column) -> Column:
    """Return after buy and sell tax in percent; a missing tax is zero."""
    after = lambda tax: 1 - F.coalesce(tax, F.lit(0.0)) / 100
    return ((1 + gross / 100) * after(buy_tax) * after(sell_tax) - 1) * 100


def band(value: Column) -> Column:
    """Number of the return band, 0 to 8: at and below zero limits belong to the lower band, above zero to the upper."""
    number = F.lit(0)
    for limit in BANDS:
        number = number + F.when((value > limit) if limit <= 0 else (value >= limit), 1).otherwise(0)
    return F.when(value.isNotNull(), number)


def outcome(value: Column, rugged: Column) -> Column:
    """Rugged first; a return of exactly 0 is no gain."""
    return F.when(F.coalesce(rugged, F.lit(False)), "rugged").when(value <= -50, "collapse").when(value <= 0, "loss").when(value < 100, "gain").when(value >= 100, "runner")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper end of the interval of a share k / n; null for n = 0."""
    p, n = k / F.nullif(n, F.lit(0)), F.nullif(n, F.lit(0))
    middle, width = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return middle - width, middle + width


def ratio(a: Column, b: Column) -> Column:
    """Null where the denominator is zero or missing."""
    return F.try_divide(a, F.nullif(b, F.lit(0)))
