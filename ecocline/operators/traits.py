"""Trait-space operators on functional entities (distinct trait combinations).

For nominal traits with equal weights the Gower distance is one minus matches over traits, so
match counts, its moments and its principal coordinates follow from counts of shared trait values
and never need the table of entity pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecocline.operators.blocks import block_reduce
from ecocline.operators.relations import exclude
from ecocline.operators.summaries import attach, with_global

MAX_FEATURES = 6000


def _features(entities: DataFrame, entity: str, traits: Sequence[str], sizes: Sequence[int]):
    """``(entity, size, feature)`` for every trait subset of the given sizes.

    A missing trait is a state of its own. Each part of a feature states its length, so that no
    text of a trait value can be taken for another feature.
    """

    def part(i: int):
        value = F.col(traits[i]).cast("string")
        told = F.concat(F.lit(f"{i}="), F.length(value).cast("string"), F.lit(":"), value)
        return F.coalesce(told, F.lit(f"{i}"))

    rows = []
    for size in sizes:
        for subset in combinations(range(len(traits)), size):
            parts = [part(i) for i in subset]
            rows.append(
                F.struct(F.lit(size).alias("size"), F.concat_ws("&", *parts).alias("feature"))
            )
    return entities.select(entity, F.inline(F.array(*rows)))


def gower_profile(entities: DataFrame, entity: str, traits: Sequence[str]) -> DataFrame:
    """How many other entities lie at each Gower distance from an entity, and the mean distance.

    Entities agreeing with it on a trait subset are counted per subset value; the counts by
    subset size turn into counts by exact number of matches.
    """
    k = len(traits)
    features = _features(entities, entity, traits, range(1, k + 1))
    counts = features.groupBy("feature").agg(F.count("*").alias("c"))
    sums = features.join(counts, "feature").groupBy(entity)
    sums = sums.agg(*[F.sum(F.when(F.col("size") == j, F.col("c"))).alias(f"m{j}") for j in range(1, k + 1)])
    sums = sums.withColumn("n", entities.agg(F.count("*")).scalar())
    sums = sums.withColumn("m0", F.col("n"))
    exact = {}
    for m in range(k + 1):
        total = F.lit(0)
        for j in range(m, k + 1):
            total = total + (-1) ** (j - m) * comb(j, m) * F.col(f"m{j}")
        exact[m] = total - 1 if m == k else total
    rows = [F.struct(F.lit(1 - m / k).alias("distance"), exact[m].cast("long").alias("n_others"))
            for m in range(k, -1, -1)]
    mean = F.try_divide(F.col("n") - F.col("m1") / F.lit(float(k)), F.col("n") - 1)
    return sums.select(entity, mean.alias("mean_distance"), F.inline(F.array(*rows)))


def gower_between(
    pairs: DataFrame, entities: DataFrame, a: str, b: str, entity: str, traits: Sequence[str],
    numeric: Sequence[str] = (),
) -> DataFrame:
    """Gower distance of the given pairs; numeric traits count as difference over range."""
    side = lambda name, prefix: entities.select(
        F.col(entity).alias(name), *[F.col(t).alias(f"{prefix}{t}") for t in [*traits, *numeric]]
    )
    joined = pairs.join(side(a, "__a_"), a).join(side(b, "__b_"), b)
    if numeric:
        spans = [(F.max(c) - F.min(c)).cast("double").alias(c) for c in numeric]
        joined = attach(joined, entities.agg(*spans), "__range")
    parts = [F.when(F.col(f"__a_{t}").eqNullSafe(F.col(f"__b_{t}")), 0.0).otherwise(1.0) for t in traits]
    parts += [
        F.coalesce(F.try_divide(F.abs(F.col(f"__a_{t}") - F.col(f"__b_{t}")), F.col("__range")[t]), F.lit(0.0))
        for t in numeric
    ]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return joined.select(*pairs.columns, (total / float(len(parts))).alias("distance"))


def _solve_axes(table: pd.DataFrame, k: int) -> pd.DataFrame:
    """Axes from centred feature cross-products; one row per feature."""
    diagonal = table[table["fa"] == table["fb"]].sort_values("fa")
    names = diagonal["fa"].to_numpy()
    if len(names) > MAX_FEATURES:
        raise ValueError(f"{len(names)} trait features; a dense solve takes {MAX_FEATURES}")
    at = {f: i for i, f in enumerate(names)}
    n, traits = float(table["n"].iloc[0]), int(table["traits"].iloc[0])
    counts = np.zeros((len(names), len(names)))
    counts[table["fa"].map(at), table["fb"].map(at)] = table["c"]
    own = np.diag(counts)
    centred = counts - np.outer(own, own) / n
    single = (diagonal["size"] == 1).to_numpy()
    weight = np.where(single, 1 / traits - 1 / (2 * traits**2), -1 / traits**2)
    values, vectors = np.linalg.eigh(centred)
    keep = values > 1e-10 * max(values.max(), 1e-300)
    root = vectors[:, keep] * np.sqrt(values[keep])
    roots, turns = np.linalg.eigh(root.T @ (weight[:, None] * root))
    order = np.argsort(-roots)
    roots, turns = roots[order], turns[:, order]
    top = [i for i in range(min(k, len(roots))) if roots[i] > 1e-10 * roots[0]]
    loadings = (vectors[:, keep] / np.sqrt(values[keep])) @ turns[:, top] * np.sqrt(roots[top])
    for j in range(loadings.shape[1]):
        if loadings[np.argmax(np.abs(np.round(loadings[:, j], 9))), j] < 0:
            loadings[:, j] *= -1
    centre = own @ loadings / n
    return pd.DataFrame({
        "feature": names,
        "loading": list(loadings),
        "centre": [centre] * len(names),
        "eigenvalues": [roots] * len(names),
    })


def trait_axes(entities: DataFrame, entity: str, traits: Sequence[str], k: int = 4) -> DataFrame:
    """Principal coordinates of Gower distance, as loadings per trait value and value pair.

    Squared Gower distances are quadratic in match counts, so the double-centred matrix factors
    through single and paired trait values. Only their co-occurrence counts, whose number depends
    on the trait vocabulary and not on the entities, go into the one dense solve.
    """
    features = _features(entities, entity, traits, (1, 2))
    per_entity = features.groupBy(entity).agg(F.collect_list(F.struct("size", "feature")).alias("f"))
    both = per_entity.select(F.inline("f"), F.col("f.feature").alias("f"))
    both = both.select("size", F.col("feature").alias("fa"), F.explode("f").alias("fb"))
    counts = both.groupBy("size", "fa", "fb").agg(F.count("*").alias("c"))
    n = entities.agg(F.count("*")).scalar()
    table = counts.withColumns({"n": n, "traits": F.lit(len(traits))})
    return table.groupBy().applyInPandas(
        lambda pdf: _solve_axes(pdf, k),
        "feature string, loading array<double>, centre array<double>, eigenvalues array<double>",
    )


def entity_coordinates(
    entities: DataFrame, entity: str, traits: Sequence[str], axes: DataFrame, k: int = 4
) -> DataFrame:
    """Coordinates ``pc1..pck`` of every entity: the sum of its features' loadings, centred."""
    features = _features(entities, entity, traits, (1, 2)).select(entity, "feature")
    loaded = features.join(axes.select("feature", "loading", "centre"), "feature")
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    return loaded.groupBy(entity).agg(
        *[(F.sum(at("loading", i)) - F.max(at("centre", i))).alias(f"pc{i + 1}") for i in range(k)]
    )


def variance_explained(axes: DataFrame) -> DataFrame:
    """Eigenvalues by axis, with the running share of the positive ones."""
    positive = lambda v: F.greatest(v, F.lit(0.0))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + positive(v))
    one = axes.agg(F.first("eigenvalues").alias("e")).select("e", F.posexplode("e").alias("i", "v"))
    share = F.try_divide(total(F.slice("e", F.lit(1), F.col("i") + 1)), total(F.col("e")))
    return one.select(
        (F.col("i") + 1).alias("axis"), F.col("v").alias("eigenvalue"), share.alias("cumulative")
    )


def distance_sums(
    points: DataFrame, entity: str, axes: Sequence[str], block: int = 1024
) -> DataFrame:
    """Per entity: sum and sum of squares of Euclidean distances to all entities, and their number.

    The entity itself is among them, at distance 0.
    """
    axes = list(axes)

    def compare(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        a, b = left[axes].to_numpy(), right[axes].to_numpy()
        d2 = np.maximum(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2), 0.0)
        d = np.sqrt(d2)
        sides = [(left, d.sum(axis=1), d2.sum(axis=1), len(right))]
        if not same:
            sides.append((right, d.sum(axis=0), d2.sum(axis=0), len(left)))
        return pd.concat(
            [
                pd.DataFrame({entity: s[entity].to_numpy(), "n": m, "d": x, "d2": y})
                for s, x, y, m in sides
            ]
        )

    kind = points.schema[entity].dataType.simpleString()
    sums = block_reduce(
        points, [], entity, axes, compare, f"`{entity}` {kind}, n long, d double, d2 double", block
    )
    return sums.groupBy(entity).agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.sum("d2").alias("d2"))


def dispersion(
    presence: DataFrame, sums: DataFrame, site: str, entity: str, without: Column | None = None
) -> DataFrame:
    """Mean, sd and standard error of the distances from a site's entities to all entities.

    Sites for which ``without`` is true are left out, also of the mean over sites; their entities still
    count among all entities.

    Built from the per-entity sums, so each presence row meets one row, not a distance row. Also
    the deviation of each site's mean from the mean over sites.
    """
    c = F.col
    if without is not None:
        presence = exclude(presence, without)
    present = presence.select(site, entity).distinct().join(sums, entity)
    totals = present.groupBy(site).agg(*[F.sum(x).alias(x) for x in ("n", "d", "d2")])
    mean = c("d") / c("n")
    variance = F.try_divide(c("d2") - c("d") * c("d") / c("n"), c("n") - 1)
    out = totals.select(
        site, mean.alias("avg_dist"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("sd_dist"), "n"
    ).withColumn("se_dist", c("sd_dist") / F.sqrt("n"))
    out = with_global(out.drop("n"), {"comm_mean": F.avg("avg_dist")})
    return out.withColumn("dev_from_mean", c("avg_dist") - c("comm_mean"))


def space_quality(
    points: DataFrame,
    entity: str,
    traits: Sequence[str],
    axes: Sequence[str],
    dims: Sequence[int],
    block: int = 512,
) -> DataFrame:
    """Mean squared deviation between Gower and k-axis distances over all entity pairs.

    Distances in k axes are first scaled so that both have the same maximum. Block pairs return
    the sums and maxima from which the deviation follows.
    """
    traits, axes, dims = list(traits), list(axes), list(dims)

    def compare(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        use = np.ones((len(left), len(right)), dtype=bool)
        if same:
            use = np.triu(use, 1)
        differ = [left[t].to_numpy()[:, None] != right[t].to_numpy()[None, :] for t in traits]
        gower = (np.sum(differ, axis=0) / len(traits))[use]
        a, b = left[axes].to_numpy(), right[axes].to_numpy()
        rows = []
        for k in dims:
            d = np.sqrt(((a[:, None, :k] - b[None, :, :k]) ** 2).sum(axis=2))[use]
            rows.append((k, d.size, gower @ gower, gower @ d, d @ d,
                         gower.max(initial=0.0), d.max(initial=0.0)))
        return pd.DataFrame(rows, columns=["k", "n", "gg", "gd", "dd", "gmax", "dmax"])

    parts = block_reduce(
        points, [], entity, [*traits, *axes], compare,
        "k int, n long, gg double, gd double, dd double, gmax double, dmax double", block,
    )
    total = parts.groupBy("k").agg(
        *[F.sum(x).alias(x) for x in ("n", "gg", "gd", "dd")],
        F.max("gmax").alias("gmax"), F.max("dmax").alias("dmax"),
    )
    s = F.try_divide(F.col("gmax"), F.col("dmax"))
    msd = (F.col("gg") - 2 * s * F.col("gd") + s * s * F.col("dd")) / F.col("n")
    return total.select("k", msd.alias("msd"))
