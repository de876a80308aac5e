"""Whole numbers of 256 bits as 32-byte hex words (lower case, 64 digits): compared and subtracted exactly, on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hex digits of a limb: 60 bits, so that differences of limbs fit a long. The first limb has the four digits left.
DIGITS = 15
BASE = 1 << (4 * DIGITS)


def limbs(word: Column) -> Column:
    """Array of the word's limbs as longs, the lowest first."""
    starts = [1, *range(5, 65, DIGITS)]
    cut = lambda at: F.conv(F.substring(word, at, 4 if at == 1 else DIGITS), 16, 10).cast("long")
    return F.when(F.char_length(word) == 64, F.array(*[cut(at) for at in reversed(starts)]))


def _larger_less_smaller(larger: Column, smaller: Column) -> Column:
    """The difference as a double, added up from limbs after borrowing: no digit is lost before the last rounding."""
    pairs = F.zip_with(limbs(larger), limbs(smaller), lambda a, b: a - b)

    def step(acc: Column, d: Column) -> Column:
        left = d - acc["borrow"]
        return F.struct(
            F.when(left < 0, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("borrow"),
            (acc["size"] + F.when(left < 0, left + BASE).otherwise(left) * acc["scale"]).alias("size"),
            (acc["scale"] * float(BASE)).alias("scale"),
        )

    start = F.struct(F.lit(0).cast("long").alias("borrow"), F.lit(0.0).alias("size"), F.lit(1.0).alias("scale"))
    return F.aggregate(pairs, start, step, lambda acc: acc["size"])


def compared(a: Column, b: Column) -> Column:
    """Sign of a - b for words without sign: exact, since hex of one width sorts as its numbers do."""
    return F.when(a == b, 0).when(a > b, 1).when(a < b, -1)


def difference(a: Column, b: Column) -> Column:
    """a - b of words without sign as a double: its sign is exact, its size right to the double's last digits; null without either."""
    return F.when(a.isNotNull() & b.isNotNull(), compared(a, b) * _larger_less_smaller(F.greatest(a, b), F.least(a, b)))


def whole(word: Column) -> Column:
    """A word without sign as decimal(38, 0), exact; null from 10^38 on."""
    part = lambda k: F.get(limbs(word), F.lit(k)).cast("decimal(38,0)")
    base = F.lit(BASE).cast("decimal(38,0)")
    most = f"{10**38:064x}"
    return F.when(F.char_length(word).eqNullSafe(64) & (word < most), ((part(2) * base).cast("decimal(38,0)") + part(1)).cast("decimal(38,0)") * base + part(0)).cast("decimal(38,0)")
