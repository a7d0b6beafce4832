import numpy as np
import pytest
from pyspark.sql import functions as F

from ecocline.functions import tails
from ecocline.operators import diversity, regression, reports


def frame(spark, n=40, seed=3, offset=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(5, 2, n) + offset
    z = rng.normal(size=n)
    g = rng.integers(0, 3, n)
    y = 1.5 + 0.7 * (x - offset) - 0.2 * (x - offset) ** 2 + 0.5 * g + rng.normal(0, 0.5, n)
    rows = [(int(i), f"g{k}", float(a), float(b), float(c)) for i, (k, a, b, c) in enumerate(zip(g, x, z, y))]
    return spark.createDataFrame(rows, "id int, g string, x double, z double, y double"), g, x, z, y


def ols(design, y):
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    res = y - design @ beta
    df = len(y) - design.shape[1]
    s2 = res @ res / df
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * s2)
    return beta, se, res, df, s2


@pytest.mark.parametrize("offset", [0.0, 1e5])
def test_linear_and_quadratic_fits(spark, offset):
    df, _, x, _, y = frame(spark, offset=offset)
    sums = regression.fit_sums(df, ["y"], ["x"])
    lin = regression.linear_fits(sums).first()
    beta, se, res, dof, _ = ols(np.column_stack([np.ones_like(x), x]), y)
    assert lin.slope == pytest.approx(beta[1], rel=1e-6)
    assert lin.intercept == pytest.approx(beta[0], rel=1e-5)
    assert lin.se_slope == pytest.approx(se[1], rel=1e-6)
    assert lin.df == dof and lin.r2 == pytest.approx(1 - res @ res / ((y - y.mean()) @ (y - y.mean())))
    u = x - x.mean()
    basis, _ = np.linalg.qr(np.column_stack([np.ones_like(u), u, u * u]))
    beta, se, res, dof, _ = ols(basis, y)
    quad = regression.quadratic_fits(sums).first()
    assert abs(quad.t_linear) == pytest.approx(abs(beta[1] / se[1]), rel=1e-6)
    assert abs(quad.t_quadratic) == pytest.approx(abs(beta[2] / se[2]), rel=1e-6)
    n, rss, k = len(y), res @ res, 4
    aicc = n * np.log(rss / n) + n * (1 + np.log(2 * np.pi)) + 2 * k + 2 * k * (k + 1) / (n - k - 1)
    assert quad.aicc == pytest.approx(aicc, rel=1e-9)


def test_degenerate_groups_have_no_fit(spark):
    rows = [("flat", 1.0, float(i)) for i in range(5)] + [("two", float(i % 2), float(i)) for i in range(6)]
    rows += [("short", 1.0, 2.0), ("short", 2.0, 4.0), ("none", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    sums = regression.fit_sums(df, ["y"], ["x"], ["g"])
    lin = {r.g: r for r in regression.linear_fits(sums).collect()}
    quad = {r.g: r for r in regression.quadratic_fits(sums).collect()}
    assert lin["flat"].slope is None and lin["flat"].r2 is None
    assert lin["two"].slope is not None and quad["two"].r2 is None
    assert lin["short"].slope == pytest.approx(2.0) and lin["short"].se_slope is None
    assert "none" not in lin


def test_model_table_ranks_within_response(spark):
    df, *_ = frame(spark)
    rows = regression.model_table(df, ["y", "z"], ["x"]).collect()
    assert len(rows) == 4
    for response in ("y", "z"):
        own = [r for r in rows if r.response == response]
        assert min(r.del_aicc for r in own) == 0.0
        line, bend = (next(r for r in own if r.reg_type == t) for t in ("Linear", "Polynomial"))
        assert bend.r2 >= line.r2 - 1e-12
        assert 0 <= line.p <= 1
    assert {r.reg_type for r in regression.best_models(regression.model_table(df, ["y"], ["x"])).collect()} == {"Polynomial"}


@pytest.mark.parametrize("degree", [1, 2])
def test_residuals(spark, degree):
    df, g, x, z, y = frame(spark)
    df = df.union(spark.createDataFrame([(99, "g0", None, 0.0, 1.0)], df.schema))
    out = regression.with_residuals(df, {"y": "ry", "z": "rz"}, "x", degree).orderBy("id").collect()
    design = np.vander(x, degree + 1)
    for name, values in (("ry", y), ("rz", z)):
        expected = ols(design, values)[2]
        assert np.allclose([r[name] for r in out[:-1]], expected, atol=1e-8)
        assert out[-1][name] is None
    by = regression.with_residuals(df, {"y": "ry"}, "x", degree, ["g"]).filter("id < 99").orderBy("id").collect()
    for k in range(3):
        own = np.flatnonzero(g == k)
        assert np.allclose([by[i].ry for i in own], ols(design[own], y[own])[2], atol=1e-7)


def test_interaction_contrasts(spark):
    df, g, x, _, y = frame(spark, 60)
    d = np.eye(3)[g]
    design = np.column_stack([np.ones_like(x), x, d[:, 1:], x[:, None] * d[:, 1:]])
    beta, se, _, dof, _ = ols(design, y)
    out = {r.g: r for r in regression.level_slopes(df, "y", "x", "g", "g0").collect()}
    assert out["g1"].df == dof
    for level, (i, s) in {"g1": (2, 4), "g2": (3, 5)}.items():
        assert out[level].contrast_intercept == pytest.approx(beta[i], rel=1e-6)
        assert out[level].se_intercept == pytest.approx(se[i], rel=1e-6)
        assert out[level].contrast_slope == pytest.approx(beta[s], rel=1e-6)
        assert out[level].se_slope == pytest.approx(se[s], rel=1e-6)
    p = tails.t_two_sided_np([beta[4] / se[4]], [dof])[0]
    assert out["g1"].p_slope == pytest.approx(p, rel=1e-6)


@pytest.mark.parametrize("degree", [1, 2])
def test_interaction_anova(spark, degree):
    df, g, x, _, y = frame(spark, 60)
    d = np.eye(3)[g][:, 1:]
    powers = np.column_stack([(x - x.mean()) ** k for k in range(1, degree + 1)])
    crossed = np.column_stack([powers[:, [k]] * d for k in range(degree)])
    one = np.ones((len(x), 1))
    designs = [one, np.hstack([one, powers]), np.hstack([one, powers, d]), np.hstack([one, powers, d, crossed])]
    rss = [(lambda r: r @ r)(ols(m, y)[2]) for m in designs]
    dof = ols(designs[-1], y)[3]
    out = {r.term: r for r in regression.interaction_anova(df, "y", "x", "g", degree).collect()}
    for i, (term, size) in enumerate([("x", degree), ("group", 2), ("x:group", 2 * degree)]):
        ss = rss[i] - rss[i + 1]
        assert out[term].df_term == size and out[term].df_residual == dof
        assert out[term].ss == pytest.approx(ss, rel=1e-6)
        assert out[term].f == pytest.approx(ss / size / (rss[-1] / dof), rel=1e-6)


def test_trait_regressions_and_screen(spark):
    df, *_ = frame(spark, 60)
    rows = {r.g: r for r in regression.trait_regressions(df, "g", "y", "x", 2).collect()}
    assert set(rows) == {"g0", "g1", "g2"} and all(r.pvalue2 is not None for r in rows.values())
    lines = regression.trait_regressions(df, "g", "z", "x", 1)
    assert all(r.pvalue2 is None for r in lines.collect())
    kept = regression.significant(lines, 0.5).collect()
    assert all(r.pvalue1 < 0.5 for r in kept)


def test_confidence_band(spark):
    df, _, x, _, y = frame(spark)
    out = regression.fitted_curve(df, "y", "x", points=5).orderBy("step").collect()
    design = np.column_stack([np.ones_like(x), x])
    beta, _, _, dof, s2 = ols(design, y)
    cov = np.linalg.inv(design.T @ design) * s2
    for r in out:
        at = np.array([1, r.x])
        assert r.fit == pytest.approx(at @ beta, rel=1e-9)
        half = tails.t_quantile_np(0.95, [dof])[0] * np.sqrt(at @ cov @ at)
        assert r.hi - r.fit == pytest.approx(half, rel=1e-6)
    assert out[0].x == pytest.approx(x.min()) and out[-1].x == pytest.approx(x.max())


def test_model_report_order_and_rounding(spark):
    rows = [("nb_sp_p", "nn", "Linear", 146.6152, 0.02056, 0.558080, 9.6508), ("nb_sp_p", "ph x", "Linear", 141.78, 0.36022, 0.0101303, 0.0), ("other", "ph", "Linear", 1.0, 0.5, 0.5, 0.0)]
    models = spark.createDataFrame(rows, "response string, predictor string, reg_type string, aicc double, r2 double, p double, del_aicc double")
    out = reports.model_report(models, {"nb_sp_p": "% Taxon richness"}, {"nn": "Nitrate+Nitrite"}).collect()
    assert [(r.parameter, r.aicc, r.r2, r.p, r.delta_aicc) for r in out] == [
        ("ph", 141.8, 0.36, 0.01, 0.0), ("Nitrate+Nitrite", 146.6, 0.021, 0.56, 9.7)
    ]


def test_community(spark):
    counts = spark.createDataFrame([("s1", "a", 3), ("s1", "a", 1), ("s1", "b", 4), ("s2", "c", 5)], "site string, taxon string, n long")
    cover = diversity.relative_cover(counts, "site", "taxon", "n")
    assert {(r.site, r.taxon): r.cover for r in cover.collect()} == {("s1", "a"): 50.0, ("s1", "b"): 50.0, ("s2", "c"): 100.0}
    rich = {r.site: (r.n, r.p) for r in diversity.richness(cover, "site", "taxon", "n", "p").collect()}
    assert rich["s1"] == (2, pytest.approx(200 / 3)) and rich["s2"] == (1, pytest.approx(100 / 3))
    traits = spark.createDataFrame([("a", "Red", "Br"), ("b", "Red", "Br"), ("c", "Green", "Br")], "taxon string, g string, m string")
    fe = diversity.functional_entities(traits, "taxon", ["g", "m"])
    by_fe = {(r.site, r.fe): r.cover for r in diversity.entity_cover(cover, fe, "site", "taxon", "cover").collect()}
    assert by_fe == {("s1", "Red,Br"): 100.0, ("s2", "Green,Br"): 100.0}
    comp = diversity.trait_composition(cover, traits, "site", "taxon", "cover", ["g", "m"])
    sums = comp.groupBy("site", "trait_group").agg(F.sum("cover").alias("c")).collect()
    assert all(r.c == pytest.approx(100.0) for r in sums)
    group = diversity.classify("g", "taxon", {"Red": "Algae"}, {"b": "CCA"})
    assert {r.taxon: r.k for r in traits.select("taxon", group.alias("k")).collect()} == {"a": "Algae", "b": "CCA", "c": None}


def test_taxon_catalogue(spark):
    lit = spark.createDataFrame([("a", "Br", "NC", "Auto", "X 1990", None), ("b", "Cushion", "AC", "Mix", None, None)],
                                "taxon string, morphology string, calcification string, energetic_resource string, l1 string, l2 string")
    taxa = spark.createDataFrame([("a",), ("b",), ("c",)], "taxon string")
    out = {r.taxon: r for r in reports.taxon_catalogue(lit, taxa, "taxon", ["l1", "l2"], {"c": "c unknown"}).collect()}
    assert (out["a"].morphology, out["a"].calcification, out["a"].energetic_resource) == ("Branching", "Non-calcifying", "Autotroph")
    assert out["a"].source == "X 1990" and out["b"].source == " " and "c unknown" in out
