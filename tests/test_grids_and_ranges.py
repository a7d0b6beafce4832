"""Point in polygon by cells, ranks and places by ranges, and keyed permutations, against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ecocline.operators import ordering, ordination, spatial


def _inside(edges, x, y):
    odd = False
    for x1, y1, x2, y2 in edges:
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            odd = not odd
    return odd


def _edges(corners):
    return [(*a, *b) for a, b in zip(corners, corners[1:] + corners[:1])]


def _star(rng, n, cx, cy, size):
    turn = np.sort(rng.random(n)) * 2 * np.pi
    reach = size * (0.3 + 0.7 * rng.random(n))
    return [(float(cx + r * np.cos(t)), float(cy + r * np.sin(t))) for r, t in zip(reach, turn)]


def _polygons():
    rng = np.random.default_rng(3)
    return {
        "star": [_star(rng, 150, 0.0, 0.0, 4.0)],
        "ring": [_star(rng, 60, 3.0, 1.0, 3.0), [(2.5, 0.5), (3.5, 0.5), (3.5, 1.5), (2.5, 1.5)]],
        "two": [[(-4.0, -4.0), (-3.0, -4.0), (-3.0, -3.0), (-4.0, -3.0)], [(5.0, 5.0), (6.0, 5.0), (5.0, 6.0)]],
        "steps": [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (3.0, 4.0), (3.0, 1.0), (2.0, 1.0), (2.0, 4.0), (1.0, 4.0), (1.0, 1.0), (0.0, 1.0)]],
    }


def _rings(spark, polygons):
    rows = [(p, k, i, *at) for p, rings in polygons.items() for k, ring in enumerate(rings) for i, at in enumerate(ring)]
    vertices = spark.createDataFrame(rows, "poly string, ring int, seq int, lon double, lat double")
    return spatial.polygon_rings(vertices, "poly", "lon", "lat", ring_id="ring")


def _points():
    rng = np.random.default_rng(4)
    free = [tuple(map(float, p)) for p in rng.uniform(-5, 7, (600, 2))]
    corners = [at for rings in _polygons().values() for ring in rings for at in ring]
    lattice = [(i / 2, j / 2) for i in range(-9, 13) for j in range(-9, 13)]  # on borders of cells and on edges
    return free + corners + lattice


def test_points_in_any_polygon_as_by_casting_rays(spark):
    polygons, points = _polygons(), _points()
    edges = {p: [e for ring in rings for e in _edges(ring)] for p, rings in polygons.items()}
    df = spark.createDataFrame([(i, *at) for i, at in enumerate(points)] + [(-1, None, 0.0), (0, *points[0])], "i int, x double, y double")
    got = sorted(r.i for r in spatial.clip(df, _rings(spark, polygons), "x", "y").collect())
    want = [i for i, at in enumerate(points) if any(_inside(e, *at) for e in edges.values())]
    assert got == sorted(want + [i for i in want if i == 0])
    assert 100 < len(want) < len(points)


def test_points_in_their_own_polygon(spark):
    polygons, points = _polygons(), _points()
    edges = {p: [e for ring in rings for e in _edges(ring)] for p, rings in polygons.items()}
    names = [*polygons, "none", None]
    rows = [(i, names[i % len(names)], *at) for i, at in enumerate(points)]
    df = spark.createDataFrame(rows, "i int, poly string, x double, y double")
    out = spatial.clip(df, _rings(spark, polygons), "x", "y", on="poly")
    assert out.columns == df.columns
    assert sorted(r.i for r in out.collect()) == [i for i, p, x, y in rows if p in edges and _inside(edges[p], x, y)]


def test_clip_without_polygons_or_points(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5)], "i int, x double, y double")
    assert spatial.clip(df, _rings(spark, _polygons()).limit(0), "x", "y").count() == 0
    assert spatial.clip(df.limit(0), _rings(spark, _polygons()), "x", "y").count() == 0
    flat = {"line": [[(0.0, 0.5), (1.0, 0.5)]], "dot": [[(0.5, 0.5)]]}
    assert spatial.clip(df, _rings(spark, flat), "x", "y").count() == 0


@pytest.mark.parametrize("levels", [None, 4])
def test_ranks_where_one_value_holds_a_third_of_the_rows(spark, levels):
    n = 3000
    value = F.when(F.col("id") % 3 == 0, 0.5).when(F.col("id") % 50 != 1, F.sin("id")).alias("m")
    df = spark.range(n).select("id", value, F.lit("x").alias("a.b"))
    rows = ordering.order_index(df, "m", levels=levels).collect()
    rank = {v: i + 1 for i, v in enumerate(sorted({r.m for r in rows if r.m is not None}))}
    assert sorted(r.id for r in rows) == list(range(n))
    assert all(r.ord == rank.get(r.m) for r in rows)
    assert ordering.order_index(df.limit(0), "m").count() == 0


def test_places_have_no_gaps(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 500).alias("v"), (F.col("id") % 3).alias("g")).repartition(7)
    rows = ordering.positions(df, ["g", "v"]).collect()
    assert [r.pos for r in sorted(rows, key=lambda r: (r.g, r.v))] == list(range(500))
    assert ordering.positions(df.limit(0), ["v"]).count() == 0


def _images(spark, n, perms, seed):
    rows = spark.range(n).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(perms))).alias("perm"))
    return rows.select("perm", "k", ordination.permuted(seed)("k", F.lit(n), "perm").alias("to"))


@pytest.mark.parametrize("n", [1, 2, 25, 1000])
def test_every_permutation_is_one_to_one(spark, n):
    rows = _images(spark, n, 20, 1).collect()
    by_perm: dict = {}
    for r in rows:
        by_perm.setdefault(r.perm, {})[r.k] = r.to
    assert all(sorted(p.values()) == list(range(n)) for p in by_perm.values())
    if n == 1000:
        assert len({tuple(p[k] for k in range(n)) for p in by_perm.values()}) == 20


def test_permutations_are_even(spark):
    n, perms = 8, 4000
    rows = _images(spark, n, perms, 5)
    counts = {(r.k, r.to): r["count"] for r in rows.groupBy("k", "to").count().collect()}
    assert len(counts) == n * n and all(abs(v - perms / n) < 5 * (perms / n) ** 0.5 for v in counts.values())
    pairs = rows.filter("k < 2").groupBy("perm").pivot("k", [0, 1]).agg(F.first("to")).groupBy("0", "1").count().collect()
    mean = perms / (n * (n - 1))
    assert len(pairs) == n * (n - 1) and all(abs(r["count"] - mean) < 5 * mean**0.5 for r in pairs)
