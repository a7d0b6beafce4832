"""Grouped summaries, shares and deviations.

All of them combine on the map side before the shuffle. Totals are aggregated and joined back
rather than computed over a window, so one very large group is never sorted in a single task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ecocline.functions.scalar import coefficient_of_variation, standard_error
from ecocline.operators.relations import keyed_join

STATS = {
    "max": F.max,
    "min": F.min,
    "mean": F.avg,
    "sd": F.stddev_samp,
    "se": standard_error,
    "cv": coefficient_of_variation,
    "range": lambda c: F.max(c) - F.min(c),
    "sum": F.sum,
    "n": F.count,
}


def summarise(df: DataFrame, keys: Sequence[str], columns: Sequence[str], stats: Sequence[str]):
    """``<column>_<stat>`` of every column per group, in one aggregate; NULLs are skipped."""
    return df.groupBy(*keys).agg(
        *[STATS[s](F.col(c)).alias(f"{c}_{s}") for c in columns for s in stats]
    )


def summarise_long(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], stats: Sequence[str]
) -> DataFrame:
    """Same statistics as rows ``(keys, parameter, stats...)``.

    Aggregated wide and then unpacked: the rows shuffled are one per key, not one per value.
    """
    rows = [
        F.struct(
            F.lit(c).alias("parameter"), *[STATS[s](F.col(c)).alias(s) for s in stats]
        )
        for c in columns
    ]
    return df.groupBy(*keys).agg(F.array(*rows).alias("r")).select(*keys, F.inline("r"))


def variability(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Coefficient of variation (%) of each column per group, wide."""
    return df.groupBy(*keys).agg(*[coefficient_of_variation(c).alias(c) for c in columns])


def rolled_up(
    df: DataFrame,
    fine: str,
    columns: Sequence[str],
    groups: DataFrame,
    coarse: Sequence[str],
) -> DataFrame:
    """Count, mean, sd and CV of columns per coarse group, through per-``fine`` moments.

    ``groups`` maps the fine key to its coarse keys. The large table is reduced to one row per
    fine key before it meets that dimension, so its rows are never shuffled for the join. The
    variance is the one within fine keys plus the one between their means, so that values far
    from zero lose no digits.
    """
    moments = lambda c: F.struct(
        F.count(c).alias("n"), F.avg(c).alias("m"), F.var_pop(c).alias("v")
    )
    small = df.groupBy(fine).agg(*[moments(c).alias(c) for c in columns])
    joined = small.join(groups.select(fine, *coarse), fine)
    part = lambda c, p: F.coalesce(F.col(f"{c}.{p}"), F.lit(0.0))
    means = [
        F.try_divide(F.sum(part(c, "n") * part(c, "m")), F.sum(part(c, "n"))).alias(f"{c}_mean")
        for c in columns
    ]
    joined = keyed_join(joined, joined.groupBy(*coarse).agg(*means), coarse)
    parts = []
    for c in columns:
        n, m, v = (part(c, p) for p in "nmv")
        between = m - F.col(f"{c}_mean")
        parts += [F.sum(n).alias(f"{c}_n"), F.max(f"{c}_mean").alias(f"{c}_mean"),
                  F.sum(n * (v + between * between)).alias(f"{c}_q")]
    out = joined.groupBy(*coarse).agg(*parts)
    for c in columns:
        n, mean, q = (F.col(f"{c}_{p}") for p in ("n", "mean", "q"))
        sd = F.sqrt(F.try_divide(q, F.when(n > 1, n - 1)))
        out = out.withColumns({
            f"{c}_sd": sd, f"{c}_cv": F.try_divide(sd, mean) * 100
        })
    kept = [f"{c}_{p}" for c in columns for p in ("n", "mean", "sd", "cv")]
    return out.select(*coarse, *kept)


def with_group_stats(
    df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column]
) -> DataFrame:
    """Keep every row and add group statistics to it; rows with a missing key are a group too."""
    return keyed_join(df, df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()]), keys)


def share_of_total(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "share"
) -> DataFrame:
    """Value as a percentage of its group total."""
    out = with_group_stats(df, keys, {"__total": F.sum(value)})
    share = F.try_divide(F.col(value).cast("double"), F.col("__total").cast("double")) * 100
    return out.withColumn(name, share).drop("__total")


def pooled_shares(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Each column as a percentage of the group total over all of the columns."""
    sums = df.groupBy(*keys).agg(*[F.sum(c).cast("double").alias(c) for c in columns])
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns[1:]),
                F.coalesce(F.col(columns[0]), F.lit(0.0)))
    return sums.select(*keys, *[(F.try_divide(F.col(c), total) * 100).alias(c) for c in columns])


def attach(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Put the single row of an aggregate beside every row, as a struct.

    A scalar subquery held in one column: the plan carries it once, however often it is used.
    """
    return df.withColumn(name, one_row.select(F.struct("*")).scalar())


def with_global(df: DataFrame, stats: Mapping[str, Column]) -> DataFrame:
    """Add table-wide statistics to every row."""
    out = attach(df, df.agg(*[c.alias(n) for n, c in stats.items()]), "__all")
    return out.withColumns({n: F.col("__all")[n] for n in stats}).drop("__all")


def z_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Centre and scale columns by their table-wide mean and sample sd."""
    stats = [F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in columns]
    one = F.col("__all")
    scaled = {c: F.try_divide(F.col(c) - one[c]["m"], one[c]["s"]) for c in columns}
    return attach(df, df.agg(*stats), "__all").withColumns(scaled).drop("__all")


def spread_profile(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    probs: Sequence[float],
    accuracy: int = 10000,
    bins: int = 1024,
) -> DataFrame:
    """Exact quantiles of each column per group: the value of rank ``ceil(p * n)``.

    Sketches bracket the rank of every quantile. Values are counted in bins, ``bins`` of them inside a
    bracket and one behind it; cumulative counts locate the bins that hold the ranks, and only their
    values are ordered. The brackets decide how much is ordered, never the result.
    """
    names = [f"q{int(round(p * 100)):02d}" for p in probs]
    by, value = [*keys, "parameter"], F.col("__v")
    order = sorted(float(p) for p in probs)
    ends = [min(max(p + side / accuracy, 0.0), 1.0) for p in order for side in (-2, 2)]
    spans = df.groupBy(*keys).agg(*[
        F.struct(
            F.percentile_approx(F.col(c).cast("double"), ends, accuracy).alias("b"),
            F.count(c).alias("n"),
        ).alias(f"__{c}")
        for c in columns
    ])

    def entry(c: str) -> Column:
        v, edges, bin_ = F.col(c).cast("double"), F.col(f"__{c}.b"), F.lit(0)
        for i in range(len(order)):  # the last bracket that begins at or below the value
            low, high = edges[2 * i], edges[2 * i + 1]
            place = F.coalesce(F.floor(F.try_divide(v - low, high - low) * bins), F.lit(0))
            inside = F.when(v > high, bins).otherwise(F.least(place, F.lit(bins - 1)))
            bin_ = F.when(v >= low, 1 + i * (bins + 1) + inside).otherwise(bin_)
        return F.struct(
            F.lit(c).alias("parameter"), F.col(c).alias("__v"), F.col(f"__{c}.n").alias("n"),
            bin_.cast("long").alias("__bin"),
        )

    rows = F.array(*[entry(c) for c in columns])
    binned = keyed_join(df.select(*keys, *columns), spans, keys).select(*keys, F.inline(rows))
    binned = binned.filter("__v IS NOT NULL")
    sizes = binned.groupBy(*by, "__bin").agg(F.count("*").alias("__in"), F.max("n").alias("n"))
    running = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.withColumn("__before", F.sum("__in").over(running) - F.col("__in"))

    def rank(p: float) -> Column:
        over, under = Fraction(str(p)).as_integer_ratio()
        return F.greatest(F.lit(1), F.expr(f"(n * {over} + {under - 1}) div {under}"))

    first, last = F.col("__before"), F.col("__before") + F.col("__in")
    held = reduce(Column.__or__, [(rank(p) > first) & (rank(p) <= last) for p in probs])
    inside = keyed_join(binned.drop("n"), sizes.filter(held).drop("__in"), [*by, "__bin"])
    counted = inside.groupBy(*by, "__bin", "n", "__before", "__v").agg(F.count("*").alias("__n"))
    step = Window.partitionBy(*by, "__bin").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("__before") + F.sum("__n").over(step)
    ranked = counted.withColumn("__end", end).withColumn("__start", F.col("__end") - F.col("__n"))
    at = lambda p: F.max(
        F.when((rank(p) > F.col("__start")) & (rank(p) <= F.col("__end")), value)
    )
    found = ranked.groupBy(*by).agg(*[at(p).alias(name) for p, name in zip(probs, names, strict=True)])
    counts = F.array(*[
        F.struct(F.lit(c).alias("parameter"), F.col(f"__{c}.n").alias("n")) for c in columns
    ])
    every = spans.select(*keys, F.inline(counts))
    return keyed_join(every, found, by, "left").select(*by, "n", *names)


def histogram(df: DataFrame, keys: Sequence[str], value: str, width: float) -> DataFrame:
    """Counts per group in bins of fixed width, labelled by their lower edge."""
    bin_ = (F.floor(F.col(value) / width) * width).alias("bin")
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, bin_).agg(F.count("*").alias("n"))
