"""Ranks and exact quantiles that never sort a whole table or a whole group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ecocline.functions.scalar import quote
from ecocline.operators.relations import keyed_join
from ecocline.sources.storage import cut_lineage


def level_order(c: Column, levels: Sequence[str]) -> Column:
    """Position of a value in an explicit list of levels; unlisted values come last as NULL."""
    return F.create_map(*chain.from_iterable((F.lit(v), F.lit(i)) for i, v in enumerate(levels)))[c]


def _ranged(
    df: DataFrame, order: Sequence[str], extra: Sequence[Column] = (), ranges: int | None = None
) -> DataFrame:
    """Rows dealt by range of ``order``, with the number of their range in ``__part``.

    Spark cuts the ranges and, without ``ranges``, settles their number by the data; ``extra`` breaks ties.
    """
    by = [*[F.col(c) for c in order], *extra]
    dealt = df.repartitionByRange(*by) if ranges is None else df.repartitionByRange(ranges, *by)
    return dealt.withColumn("__part", F.spark_partition_id())


def positions(df: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """Place of every row, from 0 without gaps, in the order of the columns ``order`` (NULL first).

    Rows are sorted inside ranges and shifted by the sizes of the ranges before; only one row a range
    meets in one task. Rows that tie in all of ``order`` lie in one range, in no set order.
    """
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    placed = cut_lineage(_ranged(df, order).withColumn("__at", within))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")
    shifted = placed.join(sizes.select("__part", before.alias("__before")), "__part")
    place = (F.col("__before") + F.col("__at") - 1).alias(name)
    return shifted.select(*[quote(c) for c in df.columns], place)


def order_index(df: DataFrame, metric: str, name: str = "ord", levels: int | None = None) -> DataFrame:
    """Dense rank of every row by ``metric`` over the whole table (NULL metric, NULL rank).

    Rows keep all their columns: they are dealt by range of the metric, ties spread at random, and
    ranked inside each range. A range is shifted by the ranks of those before it, less one wherever a
    range begins with the value at which the one before it ends. Only one row a range meets in one task.
    The number of ranges follows the data, or is ``2 ** levels``.
    """
    c = F.col
    known = df.filter(c(metric).isNotNull())
    within = F.dense_rank().over(Window.partitionBy("__part").orderBy(metric))
    ranked = cut_lineage(_ranged(known, [metric], [F.rand(7)], levels and 2**levels).withColumn("__at", within))
    parts = ranked.groupBy("__part").agg(
        F.max("__at").alias("__n"), F.min(metric).alias("__low"), F.max(metric).alias("__high")
    )
    order = Window.orderBy("__part")
    again = F.when(c("__low") == F.lag("__high").over(order), 1).otherwise(0)
    parts = parts.withColumn("__again", again)
    before = F.sum(c("__n") - c("__again")).over(order) - c("__n")
    joined = ranked.join(parts.select("__part", before.alias("__before")), "__part")
    columns = [c(quote(x)) for x in df.columns]
    ranks = joined.select(*columns, (c("__before") + c("__at")).alias(name))
    unknown = df.filter(c(metric).isNull()).select(*columns, F.lit(None).cast("long").alias(name))
    return ranks.unionByName(unknown)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per group in a declared order.

    Spark keeps only ``n`` rows per group and input partition before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def exact_median(
    df: DataFrame,
    keys: Sequence[str],
    columns: Mapping[str, str],
    bins: int = 1024,
    accuracy: int = 1000,
) -> DataFrame:
    """Exact medians per group: ``columns`` maps value column to output name.

    Sketches bracket the middle ranks of each group. Values are counted in bins, ``bins`` of them
    inside the bracket and one on either side; cumulative counts locate the one or two bins that
    hold the middle ranks, and only their values are ordered. The bracket decides how much is
    ordered, never the result.
    """
    by, value = [*keys, "__name"], F.col("__v")
    ends = [0.5 - 2 / accuracy, 0.5 + 2 / accuracy]
    spans = df.groupBy(*keys).agg(*[
        F.struct(
            F.percentile_approx(F.col(c).cast("double"), ends, accuracy).alias("b"),
            F.count(c).alias("n"),
        ).alias(f"__{out}")
        for c, out in columns.items()
    ])

    def entry(c: str, out: str) -> Column:
        v, low, high = F.col(c).cast("double"), F.col(f"__{out}.b")[0], F.col(f"__{out}.b")[1]
        place = F.coalesce(F.floor(F.try_divide(v - low, high - low) * bins), F.lit(0))
        bin_ = F.when(v < low, -1).when(v > high, bins).otherwise(F.least(place, F.lit(bins - 1)))
        return F.struct(
            F.lit(out).alias("__name"), v.alias("__v"),
            F.col(f"__{out}.n").alias("__total"), bin_.alias("__bin"),
        )

    rows = F.array(*[entry(c, out) for c, out in columns.items()])
    binned = keyed_join(df.select(*keys, *columns), spans, keys).select(*keys, F.inline(rows))
    binned = binned.filter("__v IS NOT NULL")
    sizes = binned.groupBy(*by, "__bin").agg(
        F.count("*").alias("__in"), F.max("__total").alias("__total")
    )
    running = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.withColumn("__before", F.sum("__in").over(running) - F.col("__in"))
    lower, upper = F.expr("(__total - 1) div 2"), F.expr("__total div 2")
    first, last = F.col("__before"), F.col("__before") + F.col("__in")
    holds = lambda r: (r >= first) & (r < last)
    middle = sizes.filter(holds(lower) | holds(upper)).drop("__in")
    inside = keyed_join(binned.drop("__total"), middle, [*by, "__bin"])
    counted = inside.groupBy(*by, "__bin", "__total", "__before", "__v").agg(F.count("*").alias("__n"))
    step = Window.partitionBy(*by, "__bin").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("__before") + F.sum("__n").over(step)
    ranked = counted.withColumn("__end", end).withColumn("__start", F.col("__end") - F.col("__n"))
    at = lambda r: F.max(
        F.when((r >= F.col("__start")) & (r < F.col("__end")), value)
    )
    medians = ranked.groupBy(*by).agg(((at(lower) + at(upper)) / 2).alias("__median"))
    picked = [
        F.max(F.when(F.col("__name") == out, F.col("__median"))).alias(out)
        for out in columns.values()
    ]
    return medians.groupBy(*keys).agg(*picked)
