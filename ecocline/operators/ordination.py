"""Site dissimilarity, ordination and the fit of environmental vectors and surfaces."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecocline.operators.blocks import block_reduce, spread
from ecocline.operators.monotone import monotone_fit
from ecocline.operators.ordering import positions
from ecocline.operators.scaling import principal_axes  # noqa: F401
from ecocline.operators.summaries import attach
from ecocline.sources.storage import cut_lineage, materialise


def standardise(
    cover: DataFrame, site: str, taxon: str, value: str, root: bool = True
) -> DataFrame:
    """Square root, then each value over its taxon's maximum, then over its site's total.

    Values over their maximum and totals are stored: a short list of totals is then sent to the rows by its
    measured size, and no site's rows are dealt to one task.
    """
    v = F.sqrt(F.col(value)) if root else F.col(value).cast("double")
    base = cover.filter(F.col(value) > 0).select(site, taxon, v.alias(value))
    top = base.groupBy(taxon).agg(F.max(value).alias("__top"))
    scaled = base.join(top, taxon).select(site, taxon, (F.col(value) / F.col("__top")).alias(value))
    scaled = materialise(scaled, "scaled")
    total = materialise(scaled.groupBy(site).agg(F.sum(value).alias("__total")), "totals")
    scaled = scaled.join(total, site).withColumn(value, F.col(value) / F.col("__total"))
    return scaled.select(site, taxon, value)


def all_pairs(sites: DataFrame, site: str, block: int = 256) -> DataFrame:
    """Every unordered pair ``(site_a, site_b)`` of a site list, the lesser one first.

    Sites are hashed into blocks of about ``block``, and blocks are joined with blocks.
    """
    listed = cut_lineage(sites.select(F.col(site).alias("s")).distinct())
    blocks = max(1, -(-listed.count() // block))
    packed = listed.groupBy(F.pmod(F.xxhash64("s"), F.lit(blocks)).cast("int").alias("own")).agg(
        F.collect_list("s").alias("members")
    )
    left = packed.select(
        F.explode(F.sequence("own", F.lit(blocks - 1))).alias("other"), "own", F.col("members").alias("l")
    )
    right = packed.select(F.col("own").alias("other"), F.col("members").alias("r"))
    met = left.join(right, "other").select("own", "other", F.explode("l").alias("a"), "r")
    met = met.select("own", "other", "a", F.explode("r").alias("b"))
    met = met.filter((F.col("own") != F.col("other")) | (F.col("a") < F.col("b")))
    return met.select(F.least("a", "b").alias("site_a"), F.greatest("a", "b").alias("site_b"))


#: Cells of a block that one task holds of either side at most, about.
_CELLS = 250_000


def _shared(left: pd.DataFrame, right: pd.DataFrame, sizes: tuple[int, int], slab: int = 512) -> np.ndarray:
    """Sum over taxa of the lesser value, for every site of two blocks; taxa a slab at a time.

    A side has a row for each cell: the number of its site (``row``), ``taxon`` and ``v``.
    """
    code, taxa = pd.factorize(pd.concat([left["taxon"], right["taxon"]], ignore_index=True), use_na_sentinel=False)
    ends = code[: len(left)], code[len(left) :]
    both = np.logical_and(*(np.bincount(c, minlength=len(taxa)) > 0 for c in ends))
    number = np.where(both, np.cumsum(both) - 1, -1)
    sides = []
    for side, c in zip((left, right), ends):
        column = number[c]
        order = np.argsort(column, kind="stable")
        order = order[np.searchsorted(column[order], 0) :]
        sides.append((side["row"].to_numpy()[order], column[order], side["v"].to_numpy()[order]))
    out = np.zeros(sizes)
    for low in range(0, int(both.sum()), slab):
        held = []
        for n, (row, column, v) in zip(sizes, sides):
            use = slice(*np.searchsorted(column, (low, low + slab)))
            dense = np.zeros((n, slab))
            dense[row[use], column[use] - low] = v[use]
            held.append(dense)
        for i, values in enumerate(held[0]):
            out[i] += np.minimum(values, held[1]).sum(axis=1)
    return out


def bray_curtis(
    cover: DataFrame, site: str, taxon: str, value: str, block: int = 256, cells: int = _CELLS
) -> DataFrame:
    """Bray-Curtis dissimilarity ``(site_a, site_b, dissimilarity)`` of every two sites.

    Two sites that share no taxon are at 1. Sites are hashed into blocks of about ``block``, and taxa into so
    many parts that a part of a block has about ``cells`` cells. A task compares one part of two blocks, its
    taxa a slab at a time; the shared sums of a pair are then added over the parts. So a task is bounded
    however many taxa a site has. A missing site takes no part; a missing taxon is shared with nobody.
    """
    kind = cover.schema[site].dataType.simpleString()
    present = cover.filter((F.col(value) > 0) & F.col(site).isNotNull())
    present = present.groupBy(F.col(site).alias("site"), F.col(taxon).alias("taxon")).agg(
        F.sum(value).cast("double").alias("v")
    )
    present = materialise(present, "cells")
    sites = materialise(present.groupBy("site").agg(
        F.sum("v").alias("v"), F.min("taxon").alias("taxon"), F.count("taxon").alias("cells")
    ), "sites")
    blocks = max(1, -(-sites.count() // block))
    own = F.pmod(F.xxhash64("site"), F.lit(blocks)).alias("own")
    most = sites.groupBy(own).agg(F.sum("cells").alias("cells")).agg(F.max("cells")).first()[0]
    parts = max(1, -(-(most or 0) // cells))
    part = F.pmod(F.xxhash64("taxon"), F.lit(parts)).cast("int").alias("part")
    rows = present.filter("taxon IS NOT NULL").select("site", "taxon", "v", part, F.lit(False).alias("whole"))
    # Part 0 also has every site's total, and lists pairs that share nothing.
    rows = rows.unionByName(
        sites.select("site", "taxon", "v", F.lit(0).alias("part"), F.lit(True).alias("whole"))
    )

    def compare(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        ids, totals, held = [], [], []
        for side in (left, right):
            row, names = pd.factorize(side["site"])
            whole = side["whole"].to_numpy(dtype=bool)
            total = np.zeros(len(names))
            total[row[whole]] = side["v"].to_numpy()[whole]
            ids.append(np.asarray(names))
            totals.append(total)
            held.append(side[["taxon", "v"]].assign(row=row)[~whole])
        shared = _shared(*held, (len(ids[0]), len(ids[1])))
        total = totals[0][:, None] + totals[1][None, :]
        a, b = ids
        use = (shared > 0) | (total != 0)
        i, j = np.nonzero(use & (a[:, None] < b[None, :]) if same else use)
        swap = a[i] > b[j]
        return pd.DataFrame({
            "site_a": np.where(swap, b[j], a[i]), "site_b": np.where(swap, a[i], b[j]),
            "shared": shared[i, j], "total": total[i, j],
        })

    out = block_reduce(
        rows, ["part"], "site", ["taxon", "v", "whole"], compare,
        f"site_a {kind}, site_b {kind}, shared double, total double", blocks=blocks,
    )
    if parts > 1:
        out = out.groupBy("site_a", "site_b").agg(F.sum("shared").alias("shared"), F.sum("total").alias("total"))
    return out.select("site_a", "site_b", (1 - 2 * F.col("shared") / F.col("total")).alias("dissimilarity"))


def pair_distances(
    pairs: DataFrame, points: DataFrame, key: str, axes: Sequence[str], name: str = "distance"
) -> DataFrame:
    """Euclidean distance, in the given axes, of every listed pair."""
    side = lambda end, p: points.select(
        F.col(key).alias(end), F.array(*[F.col(a) for a in axes]).alias(p)
    )
    both = pairs.join(side("site_a", "pa"), "site_a").join(side("site_b", "pb"), "site_b")
    squares = F.zip_with("pa", "pb", lambda x, y: (x - y) * (x - y))
    d = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, s: acc + s))
    return both.select(*pairs.columns, d.alias(name))


def shepard_fit(pairs: DataFrame, dissimilarity: str, distance: str) -> DataFrame:
    """Pairs with the monotone regression of ordination distance on dissimilarity."""
    return monotone_fit(pairs, dissimilarity, distance)


def stress(fit: DataFrame, distance: str) -> DataFrame:
    """Kruskal's stress of a Shepard fit."""
    gap = F.sum(F.pow(F.col(distance) - F.col("fitted"), 2))
    return fit.agg(F.sqrt(F.try_divide(gap, F.sum(F.pow(distance, F.lit(2))))).alias("stress"))


def taxon_scores(
    cover: DataFrame, scores: DataFrame, site: str, taxon: str, value: str, axes: Sequence[str]
) -> DataFrame:
    """Abundance-weighted mean of site scores per taxon."""
    joined = cover.join(scores.select(site, *axes), site)
    weighted = lambda a: F.try_divide(F.sum(F.col(value) * F.col(a)), F.sum(value))
    return joined.groupBy(taxon).agg(*[weighted(a).alias(a) for a in axes])


def _two_axis_fit(szz: Column, s1: Column, s2: Column) -> dict[str, Column]:
    """Slopes and R2 of z on two axes from central sums held in columns u11, u12, u22."""
    u11, u12, u22 = F.col("u11"), F.col("u12"), F.col("u22")
    det = u11 * u22 - u12 * u12
    b1, b2 = (s1 * u22 - s2 * u12) / det, (s2 * u11 - s1 * u12) / det
    return {"b1": b1, "b2": b2, "r2": F.try_divide(b1 * s1 + b2 * s2, szz)}


_ROUNDS, _PRIME, _AT_ONCE = 40, 2147483647, 64


def permuted(seed: int):
    """A function of columns (k, n, perm): the image of ``k`` under permutation ``perm`` of 0 to ``n`` - 1.

    A swap-or-not shuffle: a round pairs every x with key - x modulo n and swaps the two where a hash of the
    greater says so, which is one to one at any n. The hash is a squared linear form modulo a prime; its
    numbers and the key are cut from the MD5 of seed, permutation and round.
    """

    def keys(perm: int) -> list[tuple[int, ...]]:
        digests = [hashlib.md5(f"{seed}:{perm}:{r}".encode()).hexdigest() for r in range(1, _ROUNDS + 1)]
        cuts = ((0, 14), (14, 20), (20, 26), (26, 32))
        return [tuple(int(d[low:high], 16) for low, high in cuts) for d in digests]

    def image(k: pd.Series, n: pd.Series, perm: pd.Series) -> pd.Series:
        listed, at = np.unique(perm.to_numpy(), return_inverse=True)
        table = np.array([keys(int(p)) for p in listed], dtype=np.int64).reshape(-1, _ROUNDS, 4)
        x, n = k.to_numpy().astype(np.int64), n.to_numpy().astype(np.int64)
        for r in range(_ROUNDS):
            key, a, b, c = table[at, r].T
            other = (key - x) % n
            line = (np.maximum(x, other) % _PRIME * (a + 1) + b) % _PRIME
            x = np.where(((line * line + c) % _PRIME >> 16) & 1, other, x)
        return pd.Series(x)

    return F.pandas_udf(image, "long")


def vector_fit(
    table: DataFrame,
    site: str,
    axes: tuple[str, str],
    parameters: Sequence[str],
    permutations: int = 999,
    seed: int = 1,
    multiplier: float = 1.0,
) -> DataFrame:
    """Direction and R2 of each parameter on two ordination axes, with a permutation p-value.

    The sites of a parameter are numbered in order of their id. A permutation is arithmetic on that
    number (``permuted``), under keys that come from ``seed``, so reruns give the same shuffles and no
    permutation is sorted. The rows are sites x parameters x permutations; they meet the values on the
    permuted number and are summed by permutation. Arrow coordinates are direction times root R2,
    scaled by a common ``multiplier``.
    """
    c = F.col
    table = attach(table, table.agg(*[F.avg(a).alias(a) for a in axes]), "__mean")
    mean = c("__mean")
    long = cut_lineage(table.select(
        c(site).alias("site"),
        (c(axes[0]) - mean[axes[0]]).alias("a1"),
        (c(axes[1]) - mean[axes[1]]).alias("a2"),
        F.inline(F.array(*[
            F.struct(F.lit(p).alias("parameter"), c(p).cast("double").alias("z"))
            for p in parameters
        ])),
    ).filter("z IS NOT NULL AND a1 IS NOT NULL AND a2 IS NOT NULL"))
    fixed = long.groupBy("parameter").agg(
        F.count("*").alias("n"), F.avg("z").alias("zm"),
        F.sum("a1").alias("t1"), F.sum("a2").alias("t2"),
        (F.sum(c("a1") * c("a1")) - F.sum("a1") * F.avg("a1")).alias("u11"),
        (F.sum(c("a1") * c("a2")) - F.sum("a1") * F.avg("a2")).alias("u12"),
        (F.sum(c("a2") * c("a2")) - F.sum("a2") * F.avg("a2")).alias("u22"),
        (F.var_pop("z") * F.count("z")).alias("szz"),
    )
    numbered = positions(long, ["parameter", "site"], "pos")
    firsts = numbered.groupBy("parameter").agg(F.min("pos").alias("first"))
    seats = numbered.join(firsts, "parameter").select(
        "parameter", "a1", "a2", "z", (c("pos") - c("first")).alias("k")
    )
    draws = seats.drop("z").join(fixed.select("parameter", "n"), "parameter").withColumn(
        "low", F.explode(F.sequence(F.lit(1), F.lit(permutations), F.lit(_AT_ONCE)))
    )
    last = F.least(c("low") + (_AT_ONCE - 1), F.lit(permutations))
    draws = spread(draws, ["parameter", "k", "low"]).withColumn("perm", F.explode(F.sequence("low", last)))
    draws = draws.select("parameter", "perm", "a1", "a2", permuted(seed)("k", "n", "perm").alias("k"))
    drawn = draws.join(seats.select("parameter", "k", "z"), ["parameter", "k"]).drop("k")
    actual = seats.select("parameter", F.lit(0).alias("perm"), "a1", "a2", "z")
    sums = drawn.unionByName(actual).groupBy("parameter", "perm").agg(
        F.sum(c("a1") * c("z")).alias("s1"), F.sum(c("a2") * c("z")).alias("s2")
    )
    fits = sums.join(fixed, "parameter").withColumns({
        "s1": c("s1") - c("t1") * c("zm"), "s2": c("s2") - c("t2") * c("zm")
    }).withColumns(_two_axis_fit(c("szz"), c("s1"), c("s2")))
    real = fits.filter("perm = 0").select("parameter", "b1", "b2", "r2")
    trial = fits.filter("perm > 0").select("parameter", c("r2").alias("r2_perm"))
    beaten = trial.join(real, "parameter").groupBy("parameter").agg(
        (1 + F.count_if(c("r2_perm") >= c("r2") - 1e-12)).alias("hits")
    )
    size = F.sqrt(c("b1") * c("b1") + c("b2") * c("b2"))
    out = real.join(beaten, "parameter")
    return out.select(
        "parameter",
        F.try_divide(c("b1"), size).alias("axis1"), F.try_divide(c("b2"), size).alias("axis2"),
        "r2", (c("hits") / (1.0 + permutations)).alias("p"),
    ).withColumns({
        "arrow1": c("axis1") * F.sqrt("r2") * multiplier,
        "arrow2": c("axis2") * F.sqrt("r2") * multiplier,
    })


_POWERS = [(0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2)]


def trend_surface(
    df: DataFrame, x: str, y: str, parameters: Sequence[str]
) -> DataFrame:
    """Quadratic surface of each parameter over a plane: coefficients, from one aggregate.

    x and y are centred and scaled first. Each parameter is one row of power sums, and the rows
    are solved in batches.
    """
    c = F.col
    stats = [F.avg(x).alias("mx"), F.avg(y).alias("my"),
             F.stddev_samp(x).alias("dx"), F.stddev_samp(y).alias("dy")]
    frame = df.agg(*stats)
    one = c("__frame")
    long = attach(df, frame, "__frame").select(
        F.try_divide(c(x) - one["mx"], one["dx"]).alias("x"),
        F.try_divide(c(y) - one["my"], one["dy"]).alias("y"),
        F.inline(F.array(*[
            F.struct(F.lit(p).alias("parameter"), c(p).cast("double").alias("z"))
            for p in parameters
        ])),
    ).filter("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    power = lambda i, j: F.pow(c("x"), F.lit(i)) * F.pow(c("y"), F.lit(j))
    grid = [power(a + p, b + q) for a, b in _POWERS for p, q in _POWERS]
    sums = long.groupBy("parameter").agg(
        F.array(*[F.sum(g) for g in grid]).alias("xx"),
        F.array(*[F.sum(power(a, b) * c("z")) for a, b in _POWERS]).alias("xz"),
        F.count("*").alias("n"), F.min("x").alias("x_lo"), F.max("x").alias("x_hi"),
        F.min("y").alias("y_lo"), F.max("y").alias("y_hi"),
    )

    def solve(batches):
        for pdf in batches:
            size = len(_POWERS)
            pdf["coef"] = [
                np.linalg.lstsq(np.reshape(a, (size, size)), np.asarray(b), rcond=1e-10)[0]
                for a, b in zip(pdf["xx"], pdf["xz"])
            ]
            yield pdf.drop(columns=["xx", "xz"])

    fitted = sums.mapInPandas(
        solve, "parameter string, n long, x_lo double, x_hi double, y_lo double, y_hi double, "
        "coef array<double>",
    )
    return attach(fitted, frame, "frame")


def surface_grid(surfaces: DataFrame, pixels: int) -> DataFrame:
    """Values ``(parameter, x, y, z)`` of fitted surfaces on an even grid over their extent."""
    c = F.col
    steps = F.sequence(F.lit(0), F.lit(pixels - 1))
    cells = surfaces.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    u = c("x_lo") + (c("x_hi") - c("x_lo")) * c("i") / float(pixels - 1)
    v = c("y_lo") + (c("y_hi") - c("y_lo")) * c("j") / float(pixels - 1)
    cells = cells.withColumns({"u": u, "v": v})
    z = F.lit(0.0)
    for k, (a, b) in enumerate(_POWERS):
        z = z + c("coef")[k] * F.pow("u", F.lit(a)) * F.pow("v", F.lit(b))
    return cells.select(
        "parameter", (c("frame.mx") + c("frame.dx") * c("u")).alias("x"),
        (c("frame.my") + c("frame.dy") * c("v")).alias("y"), z.alias("z"),
    )


def scores_with(scores: DataFrame, details: DataFrame, key: str, columns: Mapping[str, str]):
    """Score table joined with chosen, renamed columns of an environment or trait table."""
    return scores.join(details.select(key, *[F.col(s).alias(t) for s, t in columns.items()]), key, "left")
