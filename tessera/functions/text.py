"""Column functions on words, categories and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that part words besides the space. Apostrophes, hyphens and quotes stay in words.
PUNCTUATION = "([,.!?:;])\n\\"
STOP_WORDS = tuple(
    "a about all also an and any are as at be because been but by can could did do does for from get had has have he her here him his how i if in into is it its just like me my no not of on or our out she so some than that the their them then there these they this to up us very was we were what when which who will with would you your".split()
)


def words(text: Column | str) -> Column:
    """Lower-cased pieces between spaces and punctuation, empty ones included."""
    return F.split(F.translate(F.lower(text), PUNCTUATION, " " * len(PUNCTUATION)), " ")


def categories(cell: Column | str) -> Column:
    """Trimmed parts of a comma-separated cell."""
    return F.transform(F.split(cell, ","), lambda x: F.trim(x))


def year_prefix(date: Column | str) -> Column:
    return F.substring(date, 1, 4).cast("int")


def ordered_pair(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def guarded_ratio(numerator: Column, denominator: Column, otherwise: float = -1.0) -> Column:
    """The quotient, or ``otherwise`` where the denominator is 0."""
    return F.when(denominator == 0, F.lit(otherwise)).otherwise(numerator / F.when(denominator != 0, denominator))


def squared_distance(a: str, b: str) -> str:
    """SQL of the sum of squared differences of two arrays, given as SQL."""
    return f"aggregate(zip_with({a}, {b}, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v)"


def bucket(n: int, *columns: Column | str) -> Column:
    """A hash of the columns in 0..n-1, alike in every process."""
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def seeded_draw(seed: int, *columns: Column | str) -> Column:
    """A pseudorandom number in [0, 1) that depends on the seed and the columns alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 30)) / float(1 << 30)
