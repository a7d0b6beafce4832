"""Reductions over all pairs, or all near pairs, in blocks, without ever emitting the pairs.

Rows of a group are hashed into blocks of about ``block`` rows. Each pair of blocks is one task
that compares its rows as arrays and returns a few partial sums. A task holds two blocks however
large the group is, and a group of n rows shuffles n * n / block rows instead of n * n pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecocline.operators.relations import keyed_join
from ecocline.sources.storage import cut_lineage


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash-partition by group keys at the full shuffle width.

    Grouped solves are heavy for their bytes; merging their small partitions would run them one
    after another. The grouping that follows needs no further shuffle.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width, *keys)


def block_reduce(
    df: DataFrame,
    keys: Sequence[str],
    row_id: str,
    columns: Sequence[str],
    compare: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame],
    schema: str,
    block: int = 1024,
    blocks: int | None = None,
) -> DataFrame:
    """Run ``compare(left, right, same)`` once for every unordered pair of blocks of a group.

    ``same`` tells that both sides are the one block, so that each pair should be counted once.
    The result has the group keys and the columns of ``schema``. Where an id has several rows, ``blocks``
    says how many blocks the ids of every group are dealt into.
    """
    rows = df.select(*keys, row_id, *columns)
    if blocks is None:
        sizes = df.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("__blocks"))
        rows = keyed_join(rows, sizes, keys)
    else:
        rows = rows.withColumn("__blocks", F.lit(blocks))
    rows = rows.withColumn(
        "__own", F.pmod(F.xxhash64(row_id), F.col("__blocks")).cast("int")
    ).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    rows = rows.withColumns({
        "__a": F.least("__own", "__other"), "__b": F.greatest("__own", "__other")
    }).drop("__blocks", "__other")
    names = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = pdf["__a"].iloc[0], pdf["__b"].iloc[0]
        left = pdf[pdf["__own"] == first]
        out = compare(left, pdf[pdf["__own"] == second], first == second)
        for i, k in enumerate(names):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    key_schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema]
    pairs = spread(rows, [*keys, "__a", "__b"]).groupBy(*keys, "__a", "__b")
    return pairs.applyInPandas(run, ", ".join([*key_schema, schema]))


def near_reduce(
    df: DataFrame,
    keys: Sequence[str],
    row_id: str,
    x: str,
    y: str,
    reach: str,
    columns: Sequence[str],
    compare: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame],
    schema: str,
    block: int = 1024,
) -> DataFrame:
    """``block_reduce`` for pairs of places at most ``reach`` (one value a group) apart.

    The square around a group is cut into cells that hold about ``block`` rows if they lie evenly; a cell
    that holds more is dealt into parts by hash. Only parts of cells with points within reach of each
    other meet, so at fixed density and reach the rows shuffled grow with the rows. Pairs that are
    farther apart may still be compared. Rows without a place take no part.
    """
    c, names = F.col, list(keys)
    placed = df.select(*names, row_id, x, y, reach, *[n for n in columns if n not in (x, y, reach)])
    placed = placed.dropna(subset=[x, y])
    frames = placed.groupBy(*names).agg(
        F.min(x).alias("__x0"), F.min(y).alias("__y0"), F.max(reach).alias("__reach"),
        F.greatest(F.max(x) - F.min(x), F.max(y) - F.min(y)).alias("__span"),
        F.ceil(F.sqrt(F.count("*") / float(block))).cast("long").alias("__m"),
    )
    side = F.when(c("__span") > 0, c("__span")).otherwise(1.0) / c("__m")
    frames = frames.withColumn("__side", side)
    at = lambda v, low: F.least(F.floor((c(v) - c(low)) / c("__side")).cast("long"), c("__m") - 1)
    celled = keyed_join(placed, frames.drop("__span"), names)
    celled = celled.withColumns({"__i": at(x, "__x0"), "__j": at(y, "__y0")})
    cell = [*names, "__i", "__j"]
    parts = celled.groupBy(*cell).agg(F.ceil(F.count("*") / block).cast("int").alias("__parts"))
    parts = cut_lineage(parts)
    away = F.ceil(F.least(c("__reach") / c("__side"), c("__m") - 1)).cast("long")
    ring = keyed_join(parts, frames.select(*names, "__reach", "__side", "__m"), names)
    # forward cells: to the right in any row, in the same column from the cell itself upwards
    ring = ring.withColumn("__di", F.explode(F.sequence(F.lit(0).cast("long"), away)))
    low = F.when(c("__di") == 0, F.lit(0).cast("long")).otherwise(-away)
    ring = ring.withColumn("__dj", F.explode(F.sequence(low, away)))
    gap = lambda d: F.pow(F.greatest(F.abs(c(d)) - 1, F.lit(0)) * c("__side"), F.lit(2))
    # a little beyond the reach, so that rounding parts no pair
    ring = ring.filter(gap("__di") + gap("__dj") <= F.pow(c("__reach") * (1 + 1e-9), F.lit(2)))
    ring = ring.select(*cell, "__parts", (c("__i") + c("__di")).alias("__i2"), (c("__j") + c("__dj")).alias("__j2"))
    others = parts.select(*names, c("__i").alias("__i2"), c("__j").alias("__j2"), c("__parts").alias("__parts2"))
    pairs = keyed_join(ring, others, [*names, "__i2", "__j2"])
    own = (c("__i") == c("__i2")) & (c("__j") == c("__j2"))
    pairs = pairs.withColumn("__p", F.explode(F.sequence(F.lit(0), c("__parts") - 1)))
    first = F.when(own, c("__p")).otherwise(0)
    pairs = pairs.withColumn("__p2", F.explode(F.sequence(first, c("__parts2") - 1)))
    pair = ["__i", "__j", "__p", "__i2", "__j2", "__p2"]
    sides = F.array(F.struct(F.lit(False).alias("__second"), *[c(n).alias(f"__at{n}") for n in pair[:3]]),
                    F.struct(F.lit(True).alias("__second"), *[c(n + "2").alias(f"__at{n}") for n in pair[:3]]))
    # a part that meets itself is sent once
    sides = F.when(own & (c("__p") == c("__p2")), F.slice(sides, 1, 1)).otherwise(sides)
    meets = pairs.select(*names, *pair, F.inline(sides))
    rows = keyed_join(celled, parts, cell)
    part = F.pmod(F.xxhash64(row_id), c("__parts")).cast("int")
    rows = rows.select(*names, row_id, x, y, reach, *[n for n in columns if n not in (x, y, reach)],
                       c("__i").alias("__at__i"), c("__j").alias("__at__j"), part.alias("__at__p"))
    met = keyed_join(rows, meets, [*names, "__at__i", "__at__j", "__at__p"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        same = tuple(head[n] for n in pair[:3]) == tuple(head[n] for n in pair[3:])
        left, right = pdf[~pdf["__second"]], pdf[pdf["__second"]]
        if left.empty or (right.empty and not same):  # the hash left a part without rows
            return pd.DataFrame()
        out = compare(left, left if same else right, same)
        for i, k in enumerate(names):
            out.insert(i, k, head[k])
        return out

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema]
    return spread(met, [*names, *pair]).groupBy(*names, *pair).applyInPandas(run, ", ".join([*kinds, schema]))
