"""Groups far from each other, missing keys and traits, several polygons, pruned hulls."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ecocline.operators import diversity, hulls, ordering, ordination, regression, spatial, summaries, traits
from ecocline.sources import tables


@pytest.mark.parametrize("gap", [1e4, 1e6])
def test_fits_of_groups_far_from_each_other(spark, gap):
    rng = np.random.default_rng(5)
    rows, expected = [], {}
    for g in range(3):
        u = rng.normal(size=60)
        y = g * gap + 2 * u + 0.5 * u * u + rng.normal(scale=0.05, size=60)
        x = gap * g + u
        rows += [(str(g), float(a), float(b)) for a, b in zip(x, y)]
        design = np.column_stack([np.ones(60), x - x.mean(), (x - x.mean()) ** 2])
        expected[str(g)] = np.linalg.lstsq(design, y, rcond=None)[0]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    out = regression.quadratic_fits(regression.fit_sums(df, ["y"], ["x"], ["g"])).collect()
    for r in out:
        assert r.b2 == pytest.approx(expected[r.g][2], rel=1e-6)
        assert r.b1 == pytest.approx(expected[r.g][1], rel=1e-6)
    sums = regression.fit_sums(df, ["y"], ["x"], ["g"])
    whole = regression.linear_fits(regression.pool(sums, ["response", "predictor"])).first()
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    assert whole.slope == pytest.approx(np.polyfit(x - x.mean(), y, 1)[0], rel=1e-9)


def test_levels_without_spread_take_one_degree_of_freedom(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(x), float(2 * x + rng.normal())) for g in "ab" for x in range(8)]
    rows += [("one", 3.0, 1.0)] + [("flat", 4.0, float(y)) for y in (1, 2, 4)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    slopes = {r.g: r for r in regression.level_slopes(df, "y", "x", "g", "a").collect()}
    anova = regression.interaction_anova(df, "y", "x", "g").first()
    assert slopes["b"].df == anova.df_residual == 20 - 6
    sigma2, flat = 0.0, np.array([1, 2, 4.0])
    for g in "ab":
        x, y = (np.array([r[i] for r in rows if r[0] == g]) for i in (1, 2))
        sigma2 += ((y - np.polyval(np.polyfit(x, y, 1), x)) ** 2).sum()
    sigma2 = (sigma2 + ((flat - flat.mean()) ** 2).sum()) / 14
    assert slopes["a"].se_slope == pytest.approx(np.sqrt(sigma2 / 42))


def test_rows_without_a_key_are_a_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0), (None, 6.0)], "k string, v double")
    shares = sorted(r.share for r in summaries.share_of_total(df, ["k"], "v").collect())
    assert shares == pytest.approx([25, 25, 75, 75])
    medians = {r.k: r.m for r in ordering.exact_median(df, ["k"], {"v": "m"}).collect()}
    assert medians == {"a": 2.0, None: 4.0}
    rich = diversity.richness(df.withColumn("s", F.lit(1)), "s", "v", "n", "p", by=["k"]).collect()
    assert {r.k: (r.n, r.p) for r in rich} == {"a": (2, 100.0), None: (2, 100.0)}
    more = df.withColumn("x", F.col("v") * F.col("v")).union(
        spark.createDataFrame([(None, 9.0, 1.0)], "k string, v double, x double")
    )
    left = regression.with_residuals(more, {"v": "r"}, "x", by=["k"]).collect()
    assert len(left) == 5 and all(r.r is not None for r in left)
    points = spark.createDataFrame(
        [(None, i, float(i % 5), float(i // 5), float(i)) for i in range(25)],
        "k string, id int, x double, y double, z double",
    )
    assert spatial.variogram(points, ["k"], "id", "x", "y", "z").count() > 0


def test_rolled_up_far_from_zero(spark):
    values = 1e9 + np.random.default_rng(4).normal(scale=2.0, size=200)
    rows = [(i % 10, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "site int, v double")
    groups = spark.range(10).select(F.col("id").cast("int").alias("site"), F.lit("all").alias("g"))
    out = summaries.rolled_up(df, "site", ["v"], groups, ["g"]).first()
    assert out.v_sd == pytest.approx(values.std(ddof=1), rel=1e-6)
    assert out.v_n == 200 and out.v_mean == pytest.approx(values.mean())


def _square(name, x, y, side, ring=0):
    corners = [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]
    return [(name, ring, i, float(a), float(b)) for i, (a, b) in enumerate(corners)]


def test_clip_takes_every_polygon_and_leaves_holes(spark):
    rows = _square("a", 0, 0, 4) + _square("a", 1, 1, 2, ring=1) + _square("b", 10, 10, 2)
    vertices = spark.createDataFrame(rows, "poly string, ring int, seq int, x double, y double")
    rings = spatial.polygon_rings(vertices, "poly", "x", "y", ring_id="ring")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 11.0, 11.0), (4, 6.0, 6.0)],
                                   "id int, px double, py double")
    assert {r.id for r in spatial.clip(points, rings, "px", "py").collect()} == {1, 3}


def test_kml_holes_are_read(spark, tmp_path):
    ring = lambda text: f"<LinearRing><coordinates>{text}</coordinates></LinearRing>"
    (tmp_path / "areas.kml").write_text(
        "<kml><Document><Placemark><name>p</name><Polygon><outerBoundaryIs>"
        + ring("0,0,0 4,0,0 4,4,0 0,4,0 0,0,0") + "</outerBoundaryIs><innerBoundaryIs>"
        + ring("1,1,0 2,1,0 2,2,0 1,1,0") + "</innerBoundaryIs></Polygon></Placemark></Document></kml>"
    )
    out = tables.read_polygons(spark, str(tmp_path / "areas.kml")).collect()
    assert sorted((r.ring, r.seq) for r in out) == [(0, i) for i in range(5)] + [(1, i) for i in range(4)]


def test_gower_with_missing_traits_and_any_text(spark):
    rows = [("e1", "a", None), ("e2", "a", "x"), ("e3", None, "x"), ("e4", None, None), ("e5", "a&1=x", "q")]
    df = spark.createDataFrame(rows, "fe string, t1 string, t2 string")
    out = traits.gower_profile(df, "fe", ["t1", "t2"]).collect()
    by = {(r.fe, r.distance): r.n_others for r in out}
    for fe, *own in rows:
        for matches in range(3):
            n = sum(sum(a == b for a, b in zip(own, other)) == matches for o, *other in rows if o != fe)
            assert by[fe, 1 - matches / 2] == n
    plain = spark.createDataFrame([(e, *("p" if v == "a&1=x" else v for v in t)) for e, *t in rows],
                                  "fe string, t1 string, t2 string")
    roots = lambda d: [r.eigenvalue for r in traits.variance_explained(
        traits.trait_axes(d, "fe", ["t1", "t2"])).orderBy("axis").collect()]
    assert roots(df) == pytest.approx(roots(plain))


def test_hull_counts_all_places_whatever_the_chunk(spark):
    pts = np.random.default_rng(1).normal(size=(300, 2))
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in pts], "g string, x double, y double")
    small = hulls.hull_volumes(df, "g", ["x", "y"], chunk=50).first()
    large = hulls.hull_volumes(df, "g", ["x", "y"], chunk=5000).first()
    assert small.n_points == large.n_points == 300 and small.volume == pytest.approx(large.volume)


def test_sites_that_share_nothing_are_listed_at_one(spark):
    df = spark.createDataFrame([("a", "t", 1.0), ("b", "u", 2.0), ("c", "t", 1.0)], "s string, t string, v double")
    out = {(r.site_a, r.site_b): r.dissimilarity for r in ordination.bray_curtis(df, "s", "t", "v").collect()}
    assert out == {("a", "b"): 1.0, ("a", "c"): 0.0, ("b", "c"): 1.0}


def test_kriging_says_why_a_group_has_no_surface(spark):
    df = spark.createDataFrame([("x", 0.0, 0.0, 1.0), ("x", 1.0, 0.0, 2.0), ("none", 0.0, 0.0, None)],
                               "k string, x double, y double, z double")
    model = spark.createDataFrame([], "k string, nugget double, range double, sill double")
    out = {r.k: r.status for r in spatial.krige_weights(df, ["k"], "x", "y", "z", model).collect()}
    assert out == {"x": "no variogram model", "none": "no samples"}


def test_quantiles_of_a_large_group_are_exact(spark):
    """A group beyond the accuracy of a sketch, ties, a missing key, missing values and small groups."""
    rnd = np.random.default_rng(8)
    groups = {
        "hot": rnd.normal(0, 40_000, 60_000).round().tolist(), "ties": [1.0] * 30 + [2.0, 5.0],
        None: [3.0, None, 1.0, 2.0], "one": [7.0], "none": [None, None],
    }
    rows = [(k, v) for k, values in groups.items() for v in values]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(8)
    probs = [0.05, 0.25, 0.5, 0.75, 0.95]
    found = {r.k: r for r in summaries.spread_profile(frame, ["k"], ["v"], probs).collect()}
    assert set(found) == set(groups)
    for k, values in groups.items():
        held = sorted(v for v in values if v is not None)
        want = [held[max(1, -(-len(held) * round(p * 100) // 100)) - 1] if held else None for p in probs]
        assert (found[k].n, list(found[k])[3:]) == (len(held), want)
