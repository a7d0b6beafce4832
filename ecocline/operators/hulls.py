"""Convex hulls per group in two or more dimensions.

Points of a group are first cut to hull candidates: hashed into chunks of bounded size, each
reduced to the vertices of its own hull, again and again until a group fits one chunk. A vertex of
the whole is a vertex of every chunk that holds it, so nothing of the hull is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ecocline.operators.blocks import spread
from ecocline.operators.relations import keyed_join
from ecocline.sources.storage import cut_lineage

DIGITS = 12
_EPS = 1e-10


def ring_2d(points: np.ndarray) -> np.ndarray:
    """Hull vertices of distinct 2-D points, counter-clockwise from the lowest x."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts
    halves = []
    for ordered in (pts, pts[::-1]):
        half: list[np.ndarray] = []
        for p in ordered:
            while len(half) > 1:
                u, v = half[-1] - half[-2], p - half[-2]
                if u[0] * v[1] - u[1] * v[0] > 0:
                    break
                half.pop()
            half.append(p)
        halves.append(half[:-1])
    return np.array(halves[0] + halves[1])


def _simplex(pts: np.ndarray, eps: float) -> list[int] | None:
    """Indices of d + 1 affinely independent points, spread wide; None if there are none."""
    d = pts.shape[1]
    chosen = [int(np.argmin(pts[:, 0]))]
    rest = pts - pts[chosen[0]]
    for _ in range(d):
        size = np.einsum("ij,ij->i", rest, rest)
        far = int(np.argmax(size))
        if size[far] <= eps * eps:
            return None
        chosen.append(far)
        axis = rest[far] / np.sqrt(size[far])
        rest = rest - np.outer(rest @ axis, axis)
    return chosen


def _planes(pts: np.ndarray, facets: np.ndarray, inside: np.ndarray):
    """Outward unit normals and offsets of simplicial facets."""
    corners = pts[facets]
    edges = corners[:, 1:] - corners[:, :1]
    d = pts.shape[1]
    normals = np.empty((len(facets), d))
    for j in range(d):
        minor = np.delete(edges, j, axis=2)
        normals[:, j] = (-1) ** j * np.linalg.det(minor)
    normals /= np.linalg.norm(normals, axis=1, keepdims=True)
    offsets = np.einsum("ij,ij->i", normals, corners[:, 0])
    flip = normals @ inside > offsets
    normals[flip] *= -1
    offsets[flip] *= -1
    return normals, offsets


def hull_nd(points: np.ndarray) -> tuple[np.ndarray, float]:
    """Vertices and volume of the hull in d >= 2 dimensions; volume 0 for a flat set.

    Points are added one by one: facets they can see are replaced by facets from the horizon.
    """
    pts = np.unique(points, axis=0)
    d = pts.shape[1]
    scale = float(np.max(np.ptp(pts, axis=0))) if len(pts) else 0.0
    eps = _EPS * scale
    start = _simplex(pts, eps) if len(pts) > d else None
    if start is None:
        return pts, 0.0
    inside = pts[start].mean(axis=0)
    facets = np.array([[v for v in start if v != skip] for skip in start])
    normals, offsets = _planes(pts, facets, inside)
    order = np.argsort(-np.linalg.norm(pts - inside, axis=1))
    for i in order:
        seen = normals @ pts[i] - offsets > eps
        if not seen.any():
            continue
        lit = np.sort(facets[seen], axis=1)
        ridges = np.concatenate([np.delete(lit, j, axis=1) for j in range(d)])
        ridges, times = np.unique(ridges, axis=0, return_counts=True)
        horizon = ridges[times == 1]
        fresh = np.column_stack([horizon, np.full(len(horizon), i)])
        n, o = _planes(pts, fresh, inside)
        facets = np.concatenate([facets[~seen], fresh])
        normals, offsets = np.concatenate([normals[~seen], n]), np.concatenate([offsets[~seen], o])
    volume = np.abs(np.linalg.det(pts[facets] - inside)).sum() / np.prod(np.arange(1, d + 1))
    return pts[np.unique(facets)], float(volume)


def extent(points: np.ndarray) -> float:
    """Area or volume of the hull."""
    if points.shape[1] > 2:
        return hull_nd(points)[1]
    x, y = ring_2d(points).T
    return float(abs(np.sum(x * np.roll(y, -1) - y * np.roll(x, -1))) / 2)


def _vertices(points: np.ndarray) -> np.ndarray:
    if points.shape[1] == 2:
        return ring_2d(points)
    return hull_nd(points)[0]


def located(df: DataFrame, keys: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Group and coordinates of complete points; places equal to 12 digits are one place."""
    at = lambda a: (F.round(F.col(a).cast("double"), DIGITS) + 0.0).alias(a)
    return df.dropna(subset=list(axes)).select(*keys, *[at(a) for a in axes])


def _prune_partition(keys: list[str], axes: list[str], columns: list[str], keep: int):
    """Running hull vertices per group within a partition; at most ``keep`` rows are held."""

    def prune(batches):
        held: dict[tuple, pd.DataFrame] = {}
        size = 0
        for batch in batches:
            groups = batch.groupby(keys, dropna=False) if keys else [((), batch)]
            for key, rows in groups:
                known = held.get(key)
                rows = rows if known is None else pd.concat([known, rows])
                kept = pd.DataFrame(_vertices(rows[axes].to_numpy()), columns=axes)
                for k, v in zip(keys, key):
                    kept[k] = v
                size += len(kept) - (0 if known is None else len(known))
                held[key] = kept[columns]
            if size > keep:
                yield pd.concat(held.values())
                held, size = {}, 0
        if held:
            yield pd.concat(held.values())

    return prune


def hull_candidates(
    df: DataFrame, keys: Sequence[str], axes: Sequence[str], chunk: int = 20000
) -> DataFrame:
    """Distinct points that can be hull vertices, few enough per group for one task.

    Groups that fit one chunk are left as they are. The points of larger ones are first pruned in
    the partitions where they lie, without a shuffle, and then in rounds over hashed chunks. Each
    round is a reliable checkpoint, so a lost executor never replays earlier ones. Rounds stop
    when the survivors are hull vertices themselves and no longer shrink.
    """
    points, keys, axes = located(df, keys, axes), list(keys), list(axes)
    schema, settled, previous = points.schema, None, None
    columns = [f.name for f in schema]

    def reduce_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = pd.DataFrame(_vertices(pdf[axes].to_numpy()), columns=axes)
        for k in keys:
            kept[k] = pdf[k].iloc[0]
        return kept[columns]

    while True:
        sizes = points.groupBy(*keys).agg(F.count("*").alias("__n"))
        largest = sizes.agg(F.max("__n")).first()[0] or 0
        if largest <= chunk or (previous is not None and largest > 0.9 * previous):
            every = points if settled is None else settled.unionByName(points)
            return every.distinct()
        large = sizes.filter(F.col("__n") > chunk)
        if keys:
            small = points.join(large.select(*keys), keys, "left_anti")
            settled = small if settled is None else settled.unionByName(small)
            points = points.join(large, keys)
        else:
            points = points.withColumn("__n", F.lit(largest))
        if previous is None:
            prune = _prune_partition(keys, axes, columns, 10 * chunk)
            pruned = points.select(*columns).mapInPandas(prune, schema)
        else:
            parts = F.ceil(F.col("__n") / chunk).cast("int")
            part = F.pmod(F.xxhash64(*axes, F.lit(largest)), parts).alias("__part")
            chunks = spread(points.select(*columns, part), [*keys, "__part"])
            pruned = chunks.groupBy(*keys, "__part").applyInPandas(reduce_chunk, schema)
        previous = largest
        points = cut_lineage(pruned)


def hull_rings(df: DataFrame, key: str, x: str, y: str, chunk: int = 20000) -> DataFrame:
    """Ring of each group's 2-D hull as ``(key, seq, x, y)``; a single point is a ring of one."""
    points = hull_candidates(df, [key], [x, y], chunk)
    kind = points.schema[key].dataType.simpleString()

    def ring(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(ring_2d(pdf[[x, y]].to_numpy()), columns=[x, y])
        out.insert(0, "seq", np.arange(len(out), dtype="int32"))
        out.insert(0, key, pdf[key].iloc[0])
        return out

    schema = f"`{key}` {kind}, seq int, `{x}` double, `{y}` double"
    return spread(points, [key]).groupBy(key).applyInPandas(ring, schema)


def ring_areas(rings: DataFrame, key: str, x: str, y: str, name: str = "area") -> DataFrame:
    """Shoelace area of each ring, closing it from the last vertex to the first."""
    w = Window.partitionBy(key).orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx = F.coalesce(F.lead(x).over(w), F.first(x).over(whole))
    ny = F.coalesce(F.lead(y).over(w), F.first(y).over(whole))
    cross = rings.select(key, (F.col(x) * ny - nx * F.col(y)).alias("c"))
    return cross.groupBy(key).agg((F.abs(F.sum("c")) / 2).alias(name))


def hull_volumes(
    df: DataFrame, key: str, axes: Sequence[str], chunk: int = 5000, name: str = "volume"
) -> DataFrame:
    """Hull volume of each group and of the pool of all groups, and the share (%) of the pool.

    A group of points without full rank has volume 0; ``n_points`` counts all its distinct places.
    The pool's hull is computed once, from the candidates that the groups' own cuts leave.
    """
    axes = list(axes)
    places = located(df, [key], axes).distinct().groupBy(key).agg(F.count("*").alias("n_points"))
    groups = hull_candidates(df, [key], axes, chunk)
    pool = hull_candidates(groups.select(*axes).distinct(), [], axes, chunk)
    kind = groups.schema[key].dataType.simpleString()

    def volume(pdf: pd.DataFrame) -> pd.DataFrame:
        pts = pdf[axes].to_numpy()
        return pd.DataFrame({key: [pdf[key].iloc[0]], name: [extent(pts)]})

    schema = f"`{key}` {kind}, {name} double"
    out = spread(groups, [key]).groupBy(key).applyInPandas(volume, schema)
    tagged = pool.withColumn(key, F.lit(None).cast(kind))
    whole = tagged.groupBy(key).applyInPandas(volume, schema)
    total = whole.agg(F.max(name)).scalar()
    return keyed_join(places, out, [key]).withColumn("percent", F.try_divide(F.col(name), total) * 100)
