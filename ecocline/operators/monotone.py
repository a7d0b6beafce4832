"""Monotone regression of a table of any size: pool adjacent violators, in chunks.

The least-squares rising fit is unique whatever the order in which adjacent violators are pooled. So
values are sorted into chunks, each chunk is pooled where it lies, and the pools, fewer by then, are cut
into chunks anew, shifted by half a chunk from round to round, until no pool anywhere is above its
follower. A task holds one chunk; what one task sees of the whole is a row for each chunk.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ecocline.sources.storage import materialise

CHUNK = 50_000
_ROUNDS = 200


def pool(count: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, count and sum of every pool of one sorted stretch."""
    first: list[int] = []
    counts: list[float] = []
    totals: list[float] = []
    for i, (n, s) in enumerate(zip(count.tolist(), total.tolist())):
        at = i
        while counts and totals[-1] * n >= s * counts[-1]:
            n, s, at = n + counts.pop(), s + totals.pop(), first.pop()
        first.append(at)
        counts.append(n)
        totals.append(s)
    return np.array(first, dtype=np.int64), np.array(counts), np.array(totals)


_POOLS = "chunk long, pos long, low double, high double, n double, s double"


def _pooled(rows: DataFrame) -> DataFrame:
    """Pools of every chunk; ``rows`` have chunk, low, high, n and s."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("low")
        first, n, s = pool(pdf["n"].to_numpy(), pdf["s"].to_numpy())
        last = np.append(first[1:], len(pdf)) - 1
        return pd.DataFrame({
            "chunk": pdf["chunk"].iloc[0], "pos": np.arange(len(first)), "low": pdf["low"].to_numpy()[first],
            "high": pdf["high"].to_numpy()[last], "n": n, "s": s,
        })

    return materialise(rows.groupBy("chunk").applyInPandas(run, _POOLS), "pools")


def _ends(pools: DataFrame) -> DataFrame:
    """One row a chunk: its pools, how many lie before it, and whether its first belongs to the chunk before."""
    mean = F.col("s") / F.col("n")
    own = pools.groupBy("chunk").agg(
        F.count("*").alias("pools"), F.min_by(mean, "pos").alias("head"), F.max_by(mean, "pos").alias("tail")
    )
    along = Window.orderBy("chunk")
    before = F.sum("pools").over(along.rowsBetween(Window.unboundedPreceding, -1))
    return own.select(
        "chunk", "pools", F.coalesce(before, F.lit(0)).alias("before"),
        F.coalesce(F.lag("tail").over(along) >= F.col("head"), F.lit(False)).alias("broken"),
    )


def monotone_pools(rows: DataFrame, x: str, y: str, chunk: int = CHUNK) -> DataFrame:
    """``(low, high, fitted)``: the pools of the rising fit of ``y`` on ``x``; equal x are one value."""
    points = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(
        F.col(x).cast("double").alias("low")
    ).agg(F.count("*").cast("double").alias("n"), F.sum(F.col(y).cast("double")).alias("s"))
    points = materialise(points, "points")
    parts = max(1, -(-points.count() // chunk))
    ranged = points.repartitionByRange(parts, "low").withColumn("chunk", F.spark_partition_id().cast("long"))
    pools = _pooled(ranged.withColumn("high", F.col("low")))
    for turn in range(_ROUNDS):
        ends = materialise(_ends(pools), "ends")
        if not ends.filter("broken").head(1):
            break
        shift = chunk // 2 if turn % 2 else 0
        place = F.col("before") + F.col("pos") + shift
        again = pools.join(ends.select("chunk", "before"), "chunk").withColumn(
            "chunk", F.floor(place / chunk).cast("long")
        )
        pools = _pooled(again.select("chunk", "low", "high", "n", "s"))
    return pools.select("low", "high", (F.col("s") / F.col("n")).alias("fitted"))


def monotone_fit(rows: DataFrame, x: str, y: str, name: str = "fitted", chunk: int = CHUNK) -> DataFrame:
    """``rows`` with the rising least-squares fit of ``y`` on ``x`` (NULL where either is missing).

    Each different x meets its pool in the cell of x that both share: pools are cut at the cells' borders,
    and a cell is one short search. The rows then join on x itself, which is carried, not computed again.
    """
    rows = materialise(rows, "fit-rows")
    pools = materialise(monotone_pools(rows, x, y, chunk), "pools")
    values = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x).alias("__x"), F.col(x).cast("double").alias("v")
    ).distinct()
    parts = max(1, -(-pools.count() // chunk))
    # Both sides in one order: a pool starts at one of the values, and is the last start up to a value.
    starts = pools.select(F.lit(None).cast(rows.schema[x].dataType).alias("__x"), F.col("low").alias("v"), "fitted")
    both = starts.unionByName(values.withColumn("fitted", F.lit(None).cast("double")))
    sized = max(1, -(-values.count() // chunk)) + parts
    ranged = both.repartitionByRange(sized, "v").withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, "ranged")
    heads = ranged.filter("fitted IS NOT NULL").groupBy("part").agg(F.max_by("fitted", "v").alias("tail"))
    every = ranged.select("part").distinct().join(heads, "part", "left")
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("part", F.last("tail", ignorenulls=True).over(along).alias("carried"))
    inside = Window.partitionBy("part").orderBy("v", F.col("fitted").isNull()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    found = ranged.withColumn("held", F.last("fitted", ignorenulls=True).over(inside)).join(carried, "part")
    found = found.filter("`__x` IS NOT NULL").select("__x", F.coalesce("held", "carried").alias("__fit"))
    joined = rows.join(found, rows[x] == found["__x"], "left")
    fit = F.when(F.col(y).isNotNull(), F.col("__fit"))
    return joined.withColumn(name, fit).drop("__x", "__fit")
