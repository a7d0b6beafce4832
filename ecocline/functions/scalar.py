"""Column functions. Missing input gives a missing result unless stated otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quote(name: str) -> str:
    """Column name as an identifier: exported names hold spaces, dots and plus signs."""
    return "`" + name.replace("`", "``") + "`"


def recode(c: Column | str, codes: Mapping[str, str], keep_other: bool = True) -> Column:
    """Replace coded values; others stay as they are, or become NULL with ``keep_other=False``."""
    source, chain = col(c), F
    if not codes:
        return source if keep_other else F.lit(None).cast("string")
    for old, new in codes.items():
        chain = chain.when(source == old, F.lit(new))
    return chain.otherwise(source) if keep_other else chain


def ratio(a: Column | str, b: Column | str) -> Column:
    """Division giving NULL, not an error, for a zero divisor."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def unite(columns: Sequence[Column | str], sep: str, drop_null: bool = False) -> Column:
    """Join text columns; a NULL part is skipped, or written as ``NA``."""
    parts = [col(c).cast("string") for c in columns]
    if not drop_null:
        parts = [F.coalesce(p, F.lit("NA")) for p in parts]
    return F.concat_ws(sep, *parts)


def separate(c: Column | str, pattern: str, into: Sequence[str | None]) -> list[Column]:
    """Split text into named parts; missing parts are NULL, extra or unnamed ones are dropped."""
    parts = F.split(col(c), pattern)
    return [F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(into) if n is not None]


def short_name(c: Column | str, exceptions: Mapping[str, str] | None = None) -> Column:
    """``Genus species`` as ``G.species``; one-word names stay whole, ``exceptions`` win."""
    words = F.split(col(c), " ")
    second = F.get(words, F.lit(1))
    short = F.concat(F.substring(F.get(words, F.lit(0)), 1, 1), F.lit("."), second)
    short = F.when(second.isNull(), col(c)).otherwise(short)
    return recode(short, exceptions) if exceptions else short


def decorate(c: Column | str, before: str, after: str, plain: Sequence[str] = ()) -> Column:
    """Wrap a label in a prefix and a suffix, leaving the ``plain`` ones bare."""
    wrapped = F.concat(F.lit(before), col(c), F.lit(after))
    return F.when(col(c).isin(*plain), col(c)).otherwise(wrapped) if plain else wrapped


def replace_matching(c: Column | str, pattern: str, value: str) -> Column:
    """Replace the whole text where ``pattern`` occurs in it."""
    return F.when(col(c).rlike(pattern), F.lit(value)).otherwise(col(c))


def round_even(c: Column | str, digits: int) -> Column:
    return F.bround(col(c), digits)


def round_r2(c: Column | str) -> Column:
    """Two decimals above 0.1, three at or below."""
    return F.when(col(c) > 0.1, F.bround(col(c), 2)).otherwise(F.bround(col(c), 3))


def signif(c: Column | str, digits: int) -> Column:
    """Round to significant digits."""
    x = col(c).cast("double")
    shift = F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))
    up, down = F.pow(F.lit(10.0), shift), F.pow(F.lit(10.0), -shift)
    small = F.bround(x * up, 0) / up
    large = F.bround(x / down, 0) * down
    return F.when(x == 0, F.lit(0.0)).when(shift >= 0, small).otherwise(large)


def coefficient_of_variation(c: Column | str) -> Column:
    """Sample sd over mean, in percent."""
    return ratio(F.stddev_samp(col(c)), F.avg(col(c))) * 100


def standard_error(c: Column | str) -> Column:
    """Sample sd over the square root of the number of non-null values."""
    return F.stddev_samp(col(c)) / F.sqrt(F.nullif(F.count(col(c)), F.lit(0)))


def strict_sum(c: Column | str) -> Column:
    """Sum that is NULL as soon as one value is missing."""
    return F.when(F.count_if(col(c).isNull()) == 0, F.sum(col(c)))


def row_mean(columns: Sequence[Column | str]) -> Column:
    """Mean across columns, NULL if any is missing."""
    total = col(columns[0]).cast("double")
    for c in columns[1:]:
        total = total + col(c).cast("double")
    return total / float(len(columns))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_lon), 2
    )
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))
