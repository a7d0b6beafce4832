import itertools
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ecocline.operators import blocks, hulls, ordination, spatial, traits

TRAITS = ["a", "b", "c"]


def entities(spark, n=40, seed=1):
    rng = np.random.default_rng(seed)
    rows = sorted({tuple(f"{t}{v}" for t, v in zip(TRAITS, r)) for r in rng.integers(0, (5, 4, 3), (n, 3))})
    return spark.createDataFrame([(",".join(r), *r) for r in rows], "fe string, a string, b string, c string"), rows


def gower(rows):
    m = np.array(rows)
    return (m[:, None, :] != m[None, :, :]).mean(axis=2)


def classical(d):
    n = len(d)
    j = np.eye(n) - 1 / n
    return np.linalg.eigh(-0.5 * j @ (d * d) @ j)


def test_trait_axes_equal_classical_scaling(spark):
    df, rows = entities(spark)
    axes = traits.trait_axes(df, "fe", TRAITS, k=4)
    roots, vectors = classical(gower(rows))
    found = np.sort([r.eigenvalue for r in traits.variance_explained(axes).collect()])
    nonzero = np.sort(roots[np.abs(roots) > 1e-9])
    assert np.allclose(found[np.abs(found) > 1e-9], nonzero, atol=1e-9)
    out = traits.entity_coordinates(df, "fe", TRAITS, axes).orderBy("fe").toPandas()
    ours = out[["pc1", "pc2", "pc3", "pc4"]].to_numpy()
    order = np.argsort([",".join(r) for r in rows])
    theirs = (vectors[:, ::-1][:, :4] * np.sqrt(roots[::-1][:4]))[order]
    assert np.allclose(ours @ ours.T, theirs @ theirs.T, atol=1e-8)
    shares = [r.cumulative for r in traits.variance_explained(axes).orderBy("axis").collect()]
    assert shares[-1] == pytest.approx(1.0) and all(b >= a - 1e-12 for a, b in zip(shares, shares[1:]))


def test_gower_profile(spark):
    df, rows = entities(spark)
    d = gower(rows)
    out = traits.gower_profile(df, "fe", TRAITS).toPandas()
    for i, r in enumerate(rows):
        own = out[out.fe == ",".join(r)]
        others = np.delete(d[i], i)
        assert own.mean_distance.iloc[0] == pytest.approx(others.mean())
        for m, k in zip(own.distance, own.n_others):
            assert k == np.sum(np.isclose(others, m))


def test_gower_between_with_a_numeric_trait(spark):
    df = spark.createDataFrame([("x", "r", 1.0), ("y", "r", 3.0), ("z", "g", 5.0)], "id string, t string, size double")
    pairs = spark.createDataFrame([("x", "y"), ("x", "z")], "p string, q string")
    out = {(r.p, r.q): r.distance for r in traits.gower_between(pairs, df, "p", "q", "id", ["t"], ["size"]).collect()}
    assert out == {("x", "y"): pytest.approx(0.25), ("x", "z"): pytest.approx(1.0)}


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_block_pairs_cover_every_pair_once(spark, block):
    df = spark.range(50).select((F.col("id") % 3).alias("g"), "id")

    def pairs(left, right, same):
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        both = [(min(x, y), max(x, y)) for x in a for y in b if (x < y if same else True)]
        return pd.DataFrame(both, columns=["x", "y"])

    out = blocks.block_reduce(df, ["g"], "id", [], pairs, "x long, y long", block).collect()
    expected = {(g, x, y) for x, y in itertools.combinations(range(50), 2) for g in [x % 3] if x % 3 == y % 3}
    assert len(out) == len(expected) and {(r.g, r.x, r.y) for r in out} == expected


def test_dispersion_and_quality(spark):
    rng = np.random.default_rng(2)
    df, rows = entities(spark, 12)
    n = len(rows)
    pts = rng.normal(size=(n, 3))
    names = [",".join(r) for r in rows]
    schema = "fe string, a string, b string, c string, p1 double, p2 double, p3 double"
    points = spark.createDataFrame([(f, *r, *map(float, p)) for f, r, p in zip(names, rows, pts)], schema)
    d = np.linalg.norm(pts[:, None] - pts[None], axis=2)
    sums = traits.distance_sums(points, "fe", ["p1", "p2", "p3"], block=4)
    present = spark.createDataFrame([("s1", names[0]), ("s1", names[3]), ("s1", names[0]), ("s2", names[1])], "site string, fe string")
    out = {r.site: r for r in traits.dispersion(present, sums, "site", "fe").collect()}
    all_ = d[[0, 3]].ravel()
    assert out["s1"].avg_dist == pytest.approx(all_.mean())
    assert out["s1"].sd_dist == pytest.approx(all_.std(ddof=1))
    assert out["s1"].se_dist == pytest.approx(all_.std(ddof=1) / math.sqrt(len(all_)))
    assert out["s1"].dev_from_mean == pytest.approx(all_.mean() - (all_.mean() + d[1].mean()) / 2)
    g, up = gower(rows), np.triu_indices(n, 1)
    for r in traits.space_quality(points, "fe", TRAITS, ["p1", "p2", "p3"], [2, 3], block=4).collect():
        dk = np.linalg.norm(pts[:, None, : r.k] - pts[None, :, : r.k], axis=2)[up]
        assert r.msd == pytest.approx(np.mean((g[up] - dk * g[up].max() / dk.max()) ** 2))


@pytest.mark.parametrize("d", [2, 3, 4])
def test_hull_volume_of_known_shapes(d):
    cube = np.array(list(itertools.product([0.0, 1.0], repeat=d)))
    inner = np.random.default_rng(0).random((200, d))
    assert hulls.hull_nd(cube)[1] == pytest.approx(1.0)
    vertices, volume = hulls.hull_nd(np.vstack([inner, cube, cube]))
    assert volume == pytest.approx(1.0) and len(vertices) == 2**d
    simplex = np.vstack([np.zeros(d), np.eye(d)])
    assert hulls.hull_nd(simplex)[1] == pytest.approx(1 / math.factorial(d))
    cross = np.vstack([np.eye(d), -np.eye(d)])
    assert hulls.hull_nd(cross)[1] == pytest.approx(2**d / math.factorial(d))
    assert hulls.hull_nd(cube[:d])[1] == 0.0
    flat = np.column_stack([inner[:, : d - 1], np.zeros(len(inner))])
    assert hulls.hull_nd(flat)[1] == 0.0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-4, 4), st.integers(-4, 4)), min_size=3, max_size=40))
def test_ring_and_general_hull_agree_in_the_plane(points):
    pts = np.array(points, dtype=float)
    ring = hulls.ring_2d(pts)
    x, y = ring[:, 0], ring[:, 1]
    area = abs(np.sum(x * np.roll(y, -1) - y * np.roll(x, -1))) / 2
    assert hulls.hull_nd(pts)[1] == pytest.approx(area, abs=1e-9)
    assert hulls.extent(pts) == pytest.approx(area, abs=1e-9)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.integers(5, 60))
def test_hull_of_a_subset_is_no_larger(seed, n):
    pts = np.random.default_rng(seed).integers(0, 6, (n, 3)).astype(float)
    assert hulls.hull_nd(pts[: n // 2 + 1])[1] <= hulls.hull_nd(pts)[1] + 1e-9


def test_hull_rounds_keep_the_hull(spark):
    rng = np.random.default_rng(4)
    rows = [("hot", *map(float, p)) for p in rng.normal(size=(900, 2))] + [("one", 1.0, 1.0)] * 3
    rows += [("line", float(i), float(i)) for i in range(5)] + [("hot", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    few = hulls.hull_candidates(df, ["g"], ["x", "y"], chunk=50)
    assert few.filter("g = 'hot'").count() < 200
    areas = {r.g: r.area for r in hulls.ring_areas(hulls.hull_rings(df, "g", "x", "y", chunk=50), "g", "x", "y").collect()}
    hot = np.array([r[1:] for r in rows if r[0] == "hot" and r[1] is not None])
    assert areas["hot"] == pytest.approx(hulls.hull_nd(hot)[1])
    assert areas["one"] == 0.0 and areas["line"] == pytest.approx(0.0)
    vols = {r.g: r for r in hulls.hull_volumes(df, "g", ["x", "y"], chunk=50).collect()}
    pool = hulls.hull_nd(np.array([r[1:] for r in rows if r[1] is not None]))[1]
    assert vols["hot"].percent == pytest.approx(areas["hot"] / pool * 100) and vols["one"].volume == 0.0


@pytest.mark.parametrize("block", [2, 256])
def test_bray_curtis(spark, block):
    rng = np.random.default_rng(8)
    m = np.where(rng.random((9, 12)) < 0.5, rng.integers(1, 9, (9, 12)), 0).astype(float)
    rows = [(f"s{i}", f"t{j}", float(m[i, j])) for i in range(9) for j in range(12)]
    df = spark.createDataFrame(rows, "site string, taxon string, v double")
    out = {(r.site_a, r.site_b): r.dissimilarity for r in ordination.bray_curtis(df, "site", "taxon", "v", block).collect()}
    for i, j in itertools.combinations(range(9), 2):
        shared = np.minimum(m[i], m[j]).sum()
        expected = 1 - 2 * shared / (m[i].sum() + m[j].sum())
        assert out.get((f"s{i}", f"s{j}"), 1.0) == pytest.approx(expected)
        assert 0 <= expected <= 1


def test_principal_axes_and_stress(spark):
    pts = np.random.default_rng(3).normal(size=(8, 2))
    d = np.linalg.norm(pts[:, None] - pts[None], axis=2)
    sites = spark.createDataFrame([(i,) for i in range(8)], "site int")
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i, j in itertools.combinations(range(8), 2)], "site_a int, site_b int, d double")
    scores = ordination.principal_axes(sites, "site", pairs, "d")
    both = ordination.pair_distances(pairs, scores, "site", ["axis1", "axis2"])
    assert all(r.distance == pytest.approx(r.d, abs=1e-9) for r in both.collect())
    fit = ordination.shepard_fit(both, "d", "distance")
    assert ordination.stress(fit, "distance").first().stress == pytest.approx(0.0, abs=1e-9)
    bent = spark.createDataFrame([(0, 1, 1.0, 1.0), (0, 2, 2.0, 3.0), (1, 2, 3.0, 2.0)], "site_a int, site_b int, d double, distance double")
    value = ordination.stress(ordination.shepard_fit(bent, "d", "distance"), "distance").first().stress
    assert value == pytest.approx(math.sqrt(0.5 / 14))


def test_absent_pairs_are_at_one(spark):
    sites = spark.createDataFrame([(1,), (2,), (3,)], "site int")
    pairs = spark.createDataFrame([(1, 2, 0.0)], "site_a int, site_b int, d double")
    out = {r.site: r.axis1 for r in ordination.principal_axes(sites, "site", pairs, "d").collect()}
    assert out[1] == pytest.approx(out[2]) and abs(out[1] - out[3]) == pytest.approx(1.0)


def test_standardise(spark):
    df = spark.createDataFrame([("s", "a", 4.0), ("s", "b", 9.0), ("r", "a", 16.0), ("r", "c", 0.0)], "site string, taxon string, v double")
    out = {(r.site, r.taxon): r.v for r in ordination.standardise(df, "site", "taxon", "v").collect()}
    assert out == {("s", "a"): pytest.approx(1 / 3), ("s", "b"): pytest.approx(2 / 3), ("r", "a"): 1.0}


def test_vector_fit(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=(20, 2))
    z = 3 * a[:, 0] - 4 * a[:, 1]
    noise = rng.normal(size=20)
    rows = [(i, float(a[i, 0]), float(a[i, 1]), float(z[i]), float(noise[i])) for i in range(20)]
    df = spark.createDataFrame(rows, "site int, x double, y double, z double, noise double")
    out = {r.parameter: r for r in ordination.vector_fit(df, "site", ("x", "y"), ["z", "noise"], 199).collect()}
    assert (out["z"].axis1, out["z"].axis2) == (pytest.approx(0.6), pytest.approx(-0.8))
    assert out["z"].r2 == pytest.approx(1.0) and out["z"].p == pytest.approx(1 / 200)
    design = np.column_stack([np.ones(20), a])
    res = noise - design @ np.linalg.lstsq(design, noise, rcond=None)[0]
    assert out["noise"].r2 == pytest.approx(1 - res @ res / np.sum((noise - noise.mean()) ** 2))
    assert out["noise"].p > 0.01


def test_trend_surface_recovers_a_quadratic(spark):
    rng = np.random.default_rng(7)
    x, y = rng.normal(50, 3, 30), rng.normal(-20, 0.5, 30)
    f = lambda u, v: 2 + 0.3 * u - v + 0.1 * u * u - 0.2 * u * v + 0.7 * v * v
    df = spark.createDataFrame([(float(a), float(b), float(f(a, b))) for a, b in zip(x, y)], "x double, y double, z double")
    grid = ordination.surface_grid(ordination.trend_surface(df, "x", "y", ["z"]), 4).collect()
    assert len(grid) == 16
    assert all(r.z == pytest.approx(f(r.x, r.y), rel=1e-8) for r in grid)


def test_polygon_clip(spark):
    corners = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    vertices = spark.createDataFrame([("p", i, float(x), float(y)) for i, (x, y) in enumerate(corners)], "poly_id string, seq int, lon double, lat double")
    points = spark.createDataFrame([("in", 0.5, 1.0), ("notch", 2.0, 2.0), ("out", 5.0, 1.0), ("right", 3.9, 3.0)], "k string, x double, y double")
    rings = spatial.polygon_rings(vertices, "poly_id", "lon", "lat")
    assert sorted(r.k for r in spatial.clip(points, rings, "x", "y").collect()) == ["in", "right"]
    keyed = points.withColumn("poly_id", F.when(F.col("k") == "in", "p").otherwise("q"))
    assert [r.k for r in spatial.clip(keyed, rings, "x", "y", on="poly_id").collect()] == ["in"]


@pytest.mark.parametrize("block", [5, 1024])
def test_variogram(spark, block):
    rng = np.random.default_rng(9)
    p, z = rng.random((30, 2)), rng.random(30)
    df = spark.createDataFrame([("g", i, *map(float, p[i]), float(z[i])) for i in range(30)], "g string, id int, x double, y double, z double")
    out = {r.lag: r for r in spatial.variogram(df, ["g"], "id", "x", "y", "z", 3, block).collect()}
    reach = np.hypot(*np.ptp(p, axis=0)) / 3
    i, j = np.triu_indices(30, 1)
    d, g = np.hypot(*(p[i] - p[j]).T), (z[i] - z[j]) ** 2 / 2
    for lag in range(3):
        use = (d <= reach) & (np.minimum((d / (reach / 3)).astype(int), 2) == lag)
        assert out[lag].n_pairs == use.sum()
        assert out[lag].gamma == pytest.approx(g[use].mean()) and out[lag].distance == pytest.approx(d[use].mean())


def test_kriging_and_isolated_faults(spark):
    rng = np.random.default_rng(10)
    p = rng.random((15, 2)) * 10
    z = p[:, 0] + rng.normal(0, 0.1, 15)
    rows = [("ok", float(a), float(b), float(c)) for (a, b), c in zip(p, z)]
    rows += [("lone", 1.0, 1.0, 5.0), ("empty", 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double").withColumn("id", F.monotonically_increasing_id())
    model = spark.createDataFrame([("ok", 0.1, 8.0, 4.0)], "g string, nugget double, range double, sill double")
    weights = spatial.krige_weights(df, ["g"], "x", "y", "z", model)
    status = {r.g: r.status for r in weights.collect()}
    assert status["ok"] == "ok" and status["lone"] != "ok" and status["empty"] == "no samples"
    grid = spark.createDataFrame([("ok", 2.0, 3.0), ("ok", *map(float, p[0])), ("lone", 1.0, 1.0)], "g string, x double, y double")
    out = {(r.x, r.y): r.pred for r in spatial.krige(grid, weights, model, ["g"]).collect()}
    gamma = lambda d: np.where(d == 0, 0, 0.1 + 3.9 * (1.5 * np.minimum(d / 8, 1) - 0.5 * np.minimum(d / 8, 1) ** 3))
    k = np.ones((16, 16))
    k[:15, :15], k[15, 15] = gamma(np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))), 0
    lam = np.linalg.solve(k, np.append(gamma(np.hypot(*(p - [2.0, 3.0]).T)), 1.0))
    assert out[(2.0, 3.0)] == pytest.approx(lam[:15] @ z)
    assert out[tuple(map(float, p[0]))] == pytest.approx(z[0]) and len(out) == 2


def test_site_order_by_distance(spark):
    df = spark.createDataFrame([("seep", -149.9, -17.54), ("far", -149.8, -17.54), ("near", -149.899, -17.54)], "site string, lon double, lat double")
    out = {r.site: (r.ord, r.distance_m) for r in spatial.seep_order(df, "site", "lon", "lat", "seep").collect()}
    assert [out[s][0] for s in ("seep", "near", "far")] == [1, 2, 3] and out["seep"][1] == 0.0


def test_centroid_and_nudge(spark):
    df = spark.createDataFrame([("l", "a", 1.0, 5.0), ("l", "b", 3.0, 6.0), ("l", "c", 8.0, 9.0), ("l", "d", None, 7.0)], "loc string, site string, lon double, lat double")
    mid = spatial.centroids(df, "loc", "lon", "lat", 0.5).first()
    assert (mid.lon, mid.lat) == (3.5, 6.5)
    moved = {r.site: r.lat for r in spatial.nudge(df, "site", "lat", {"a": -1.0, "b": 2.0}).collect()}
    assert moved == {"a": 4.0, "b": 8.0, "c": 9.0, "d": 7.0}


def test_prediction_grid(spark):
    df = spark.createDataFrame([("g", 0.0, 0.0), ("g", 4.0, 2.0), ("point", 1.0, 1.0)], "g string, x double, y double")
    out = spatial.prediction_grid(df, ["g"], "x", "y", 8).collect()
    assert len(out) == 9 * 5 and max(r.y for r in out) == 2.0
