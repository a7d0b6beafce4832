"""Richness within scopes, residuals from lines and curves side by side, fits per entity, report tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ecocline.operators import diversity, regression, reports


def test_absent_sites_have_no_richness_and_empty_scopes_no_share(spark):
    present = spark.createDataFrame(
        [("a", "t1", "f1", "coral"), ("a", "t2", "f1", "coral"), ("a", "t2", "f1", "coral"),
         ("b", "t3", "f2", None), ("b", "t1", "f1", "coral"), ("c", "t3", "f2", "algae")],
        "site string, taxon string, fe string, broad string",
    )
    sites = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), ("none", 4.0)], "site string, z double")
    scopes = {"all": None, "coral": F.col("broad") == "coral", "sponge": F.col("broad") == "sponge"}
    out = diversity.scoped_richness(present, sites, scopes, "site", "taxon", "fe").collect()
    got = {(r.scope, r.site): (r.nb_sp, r.nb_fes, r.nb_sp_p, r.nb_fes_p) for r in out}
    assert len(out) == 12 and {r.z for r in out} == {1.0, 2.0, 3.0, 4.0}
    assert got["all", "b"] == (2, 2, pytest.approx(200 / 3), 100.0)
    assert got["coral", "a"] == (2, 1, 100.0, 100.0) and got["coral", "b"] == (1, 1, 50.0, 100.0)
    assert got["coral", "c"] == (0, 0, 0.0, 0.0) and got["all", "none"] == (0, 0, 0.0, 0.0)
    assert got["sponge", "a"] == (0, 0, None, None)


def test_residuals_of_lines_and_curves_side_by_side(spark):
    rng = np.random.default_rng(5)
    x, y, z = rng.normal(3, 1, (2, 20)), rng.normal(size=(2, 20)), rng.normal(size=(2, 20))
    rows = [(g, i, float(x[k, i]), float(y[k, i]), float(z[k, i])) for k, g in enumerate("ab") for i in range(20)]
    rows.append(("a", 99, None, 1.0, 2.0))
    df = spark.createDataFrame(rows, "g string, id int, x double, y double, z double")
    out = regression.chosen_residuals(df, {"y": "ry", "z": "rz"}, "x", {"y": F.col("g") == "b"}, ["g"]).collect()
    assert out[0].asDict().keys() == {"g", "id", "x", "y", "z", "ry", "rz"}
    for r in out:
        if r.id == 99:
            assert r.ry is None and r.rz is None
            continue
        k = "ab".index(r.g)
        fit = lambda v, d: v[k, r.id] - np.polyval(np.polyfit(x[k], v[k], d), x[k, r.id])
        assert r.ry == pytest.approx(fit(y, 1 + k), abs=1e-9)
        assert r.rz == pytest.approx(fit(z, 1), abs=1e-9)


def test_residuals_without_curves_are_those_of_lines(spark):
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(6)], "x double, y double")
    plain = regression.with_residuals(df, {"y": "r"}, "x").collect()
    assert regression.chosen_residuals(df, {"y": "r"}, "x", {}).collect() == plain


def test_the_better_form_of_every_entity(spark):
    rng = np.random.default_rng(8)
    x = np.linspace(0, 4, 30)
    shapes = {"bent": (x - 2) ** 2, "straight": 2 * x, "flat": 0 * x}
    rows = [(n, float(a), float(b)) for n, s in shapes.items() for a, b in zip(x, s + rng.normal(0, 0.1, 30))]
    rows += [("constant", 1.0, float(v)) for v in range(5)] + [("few", 1.0, 2.0), ("few", 2.0, 3.0)]
    df = spark.createDataFrame(rows, "taxon string, x double, y double")
    got = {r.taxon: r for r in regression.entity_regressions(df, "taxon", "y", "x").collect()}
    assert got["bent"].form == "Polynomial" and got["bent"].pvalue == got["bent"].p_curve_quadratic < 1e-6
    assert got["straight"].p_line < 1e-6 and got["straight"].slope == pytest.approx(2, abs=0.1)
    assert got["flat"].p_line > 0.01
    for name in ("constant", "few"):
        assert got[name].form is None and got[name].pvalue is None and got[name].r_squared is None
    assert got["bent"].parameter == "x" and got["bent"].n == 30


def test_report_rows_are_packed_by_section(spark):
    rows = [("coral", "nb", "b", "Linear", 10.04, 0.2345, 0.0123, 0.04), ("coral", "nb", "a", "Linear", 10.0, 0.01234, 0.5, 0.0),
            ("coral", "nf", "a", "Linear", 3.0, None, None, 0.0), ("coral", "res", "a", "Linear", 1.0, 0.5, 0.2, 0.0),
            ("coral", "other", "a", "Linear", 1.0, 0.5, 0.2, 0.0), ("algae", "nf", "z", "Linear", 1.0, 0.5, 0.2, 0.0)]
    models = spark.createDataFrame(
        rows, "scope string, response string, predictor string, reg_type string, aicc double, r2 double, p double, del_aicc double"
    )
    tables = {"raw": {"nb": "Richness", "nf": "Entities"}, "residuals": {"res": "Richness (residuals)"}}
    out = reports.report_tables(models, tables, {"a": "A", "b": "B"}, ["scope"]).collect()
    got = {(r.scope, r.report, r.row): (r.section, r.parameter, r.r2, r.p) for r in out}
    assert got == {
        ("coral", "raw", 1): ("Richness", "A", 0.012, 0.5),
        ("coral", "raw", 2): ("Richness", "B", 0.23, 0.012),
        ("coral", "raw", 3): ("Entities", "A", None, None),
        ("coral", "residuals", 1): ("Richness (residuals)", "A", 0.5, 0.2),
        ("algae", "raw", 1): ("Entities", "z", 0.5, 0.2),
    }
