"""Column-set helpers, joins on shared columns, rule-based exclusion and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecocline.functions.scalar import quote


def cols_between(df: DataFrame, first: str, last: str) -> list[str]:
    """Names of the columns from ``first`` to ``last`` in table order."""
    names = df.columns
    return names[names.index(first) : names.index(last) + 1]


def relocate(df: DataFrame, name: str, after: str | None = None, before: str | None = None):
    """Move one column next to another."""
    rest = [c for c in df.columns if c != name]
    at = rest.index(after) + 1 if after else rest.index(before) if before else 0
    return df.select(*[quote(c) for c in (*rest[:at], name, *rest[at:])])


def apply_to(df: DataFrame, names: Sequence[str], fn) -> DataFrame:
    """Replace each named column by ``fn(column)`` in one projection."""
    return df.withColumns({c: fn(F.col(quote(c))) for c in names})


def natural_join(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Equi-join on all shared columns, where a missing key matches a missing key.

    The null-safe comparison stays a hash-partitionable equi-join; a full or right join takes
    each key from whichever side has it.
    """
    keys = [c for c in left.columns if c in right.columns]
    hidden = {k: f"__right_{k}" for k in keys}
    renamed = right.withColumnsRenamed(hidden)
    match = reduce(
        Column.__and__, [left[quote(k)].eqNullSafe(renamed[quote(hidden[k])]) for k in keys]
    )
    joined = left.join(renamed, match, how)
    if how in ("left_semi", "left_anti"):
        return joined
    kept = [
        F.coalesce(F.col(quote(c)), F.col(quote(hidden[c]))).alias(c) if c in hidden else F.col(quote(c))
        for c in left.columns
    ]
    return joined.select(*kept, *[F.col(quote(c)) for c in right.columns if c not in hidden])


def keyed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` alone, where a missing key matches a missing key.

    Without keys ``right`` is the one row of a table-wide aggregate, put beside every row.
    """
    keys = list(keys)
    if not keys:
        beside = left.withColumn("__one", right.select(F.struct("*")).scalar())
        return beside.select(*[quote(c) for c in left.columns], "__one.*")
    return natural_join(left, right.select(*keys, *[c for c in right.columns if c not in left.columns]), how)


def exclude(df: DataFrame, *rules: Column) -> DataFrame:
    """Drop the rows for which some rule is true; a rule that is unknown keeps the row."""
    hit = reduce(Column.__or__, [F.coalesce(r, F.lit(False)) for r in rules])
    return df.filter(~hit)


def rule_hits(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """How many rows each named rule matches, in one pass: a rule with no hit is likely a typo."""
    counts = [
        F.struct(F.lit(n).alias("rule"), F.count_if(r).alias("n_rows")) for n, r in rules.items()
    ]
    return df.agg(F.array(*counts).alias("h")).select(F.inline("h"))


def stack(*tables: DataFrame) -> DataFrame:
    """Row union by column name; absent columns are filled with NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def scenarios(df: DataFrame, filters: Mapping[str, Column | None], name: str = "scenario"):
    """One tagged copy of the rows per named filter, from a single scan of the table."""
    tags = F.array_compact(
        F.array(
            *[
                F.lit(tag) if rule is None else F.when(F.coalesce(rule, F.lit(False)), F.lit(tag))
                for tag, rule in filters.items()
            ]
        )
    )
    return df.select("*", F.explode(tags).alias(name))
