"""Long and wide forms. Wide form is for export: it needs the column values up front."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecocline.functions.scalar import quote


def wide_to_long(
    df: DataFrame,
    columns: Sequence[str],
    name: str = "parameter",
    value: str = "value",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """One row per listed column; missing values keep their row."""
    keep = [c for c in df.columns if c not in columns] if keep is None else list(keep)
    quoted = [quote(c) for c in keep], [quote(c) for c in columns]
    return df.select(*quoted[0], *quoted[1]).unpivot(*quoted, name, value)


def long_to_wide(
    df: DataFrame,
    keys: Sequence[str],
    name: str,
    value: str,
    values: Sequence[str],
    fill: float | None = None,
) -> DataFrame:
    """One column per entry of ``values``; absent cells are NULL or ``fill``."""
    cell = lambda v: F.max(F.when(F.col(name) == v, F.col(value)))
    wide = df.groupBy(*keys).agg(*[cell(v).alias(str(v)) for v in values])
    if fill is None:
        return wide
    return wide.withColumns({str(v): F.coalesce(F.col(quote(str(v))), F.lit(fill)) for v in values})


def dense_long(
    df: DataFrame, keys: Sequence[str], name: str, value: str, values: Sequence[str]
) -> DataFrame:
    """Long form with a zero row for every listed value a key does not have."""
    wide = long_to_wide(df, keys, name, value, values, fill=0.0)
    return wide_to_long(wide, [str(v) for v in values], name, value)


def crossed_long(
    df: DataFrame,
    dependents: Sequence[str],
    predictors: Sequence[str],
    keep: Sequence[str] = (),
) -> DataFrame:
    """Every dependent beside every predictor: ``(keep, dependent, y, parameter, x)``."""
    once = wide_to_long(df, predictors, "parameter", "x", keep=[*keep, *dependents])
    return wide_to_long(once, dependents, "dependent", "y", keep=[*keep, "parameter", "x"])


def parameter_beside(df: DataFrame, keys: Sequence[str], name: str, value: str, pick: str):
    """Put one parameter's value, as column ``pick``, beside every row of the same keys.

    A join of the long table with its own slice; the slice has one row per key.
    """
    slice_ = df.filter(F.col(name) == pick).select(*keys, F.col(value).alias(pick))
    return df.join(slice_, list(keys), "left")


def split_key(df: DataFrame, key: str, pattern: str, parts: Sequence[str]) -> DataFrame:
    """Unpack a composite key into one row ``(trait_group, trait)`` per part."""
    pieces = F.split(F.col(key), pattern)
    rows = [F.struct(F.lit(p).alias("trait_group"), F.get(pieces, F.lit(i)).alias("trait"))
            for i, p in enumerate(parts)]
    return df.select("*", F.inline(F.array(*rows)))
