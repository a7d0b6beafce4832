import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ecocline.functions import scalar, tails


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_t_tail_matches_tables():
    # 97.5% points of Student's t
    for df, t in [(1, 12.7062047), (5, 2.5705818), (17, 2.1098156), (30, 2.0422725), (1000, 1.9623391)]:
        assert tails.t_two_sided_np([t], [df])[0] == pytest.approx(0.05, abs=1e-7)
        assert tails.t_quantile_np(0.95, [df])[0] == pytest.approx(t, abs=1e-6)


def test_t_tail_of_huge_samples_is_normal():
    p = tails.t_two_sided_np([1.959963985], [1e9])[0]
    assert p == pytest.approx(0.05, abs=1e-7)


def test_t_tail_closed_forms():
    for t in (0.0, 0.3, 2.0, 40.0):
        cauchy = 1 - 2 / math.pi * math.atan(t)
        two = 1 - t / math.sqrt(2 + t * t)
        assert tails.t_two_sided_np([t], [1])[0] == pytest.approx(cauchy, abs=1e-12)
        assert tails.t_two_sided_np([t], [2])[0] == pytest.approx(two, abs=1e-12)


def test_f_tail():
    # 95% points of F
    for d1, d2, f in [(1, 10, 4.9646), (2, 20, 3.4928), (5, 5, 5.0503), (3, 60, 2.7581)]:
        assert tails.f_upper_np([f], [d1], [d2])[0] == pytest.approx(0.05, abs=1e-5)
    t, df = 1.7, 12
    assert tails.f_upper_np([t * t], [1], [df])[0] == pytest.approx(tails.t_two_sided_np([t], [df])[0])


def test_published_model_p_values():
    # p of a linear fit with R2 0.02056522625 and of a quadratic term, n = 19
    r2 = 0.02056522625094298
    t = math.sqrt(r2 / (1 - r2) * 17)
    assert tails.t_two_sided_np([t], [17])[0] == pytest.approx(0.5580802607955235, abs=1e-10)


def test_tails_as_columns(spark):
    df = spark.createDataFrame([(2.0, 2.0), (None, 2.0), (1.0, 0.0)], "t double, d double")
    rows = df.select(tails.t_two_sided(F.col("t"), F.col("d")).alias("p")).collect()
    assert rows[0].p == pytest.approx(1 - 2 / math.sqrt(6))
    assert rows[1].p is None and rows[2].p is None


@pytest.mark.parametrize(
    "value, digits, expected",
    [(0.0455, 1, 0.05), (123.4, 2, 120.0), (0.00012345, 2, 0.00012), (-987654.0, 3, -988000.0), (0.0, 2, 0.0)],
)
def test_signif(spark, value, digits, expected):
    assert one(spark, scalar.signif(F.lit(value), digits)) == pytest.approx(expected, rel=1e-12)


def test_text_functions(spark):
    assert one(spark, scalar.unite([F.lit("a"), F.lit(None).cast("string")], ",")) == "a,NA"
    assert one(spark, scalar.unite([F.lit("a"), F.lit(None).cast("string")], ",", True)) == "a"
    assert one(spark, scalar.short_name(F.lit("Porites rus"))) == "P.rus"
    assert one(spark, scalar.short_name(F.lit("Turf"))) == "Turf"
    assert one(spark, scalar.short_name(F.lit("Verongida sp."), {"V.sp.": "Verongida sp."})) == "Verongida sp."
    assert one(spark, scalar.decorate(F.lit("Turf"), "i(", ")", ["Turf"])) == "Turf"
    assert one(spark, scalar.replace_matching(F.lit("x Acuna 1995 y"), "Acuna", "Acuña")) == "Acuña"
    parts = spark.createDataFrame([("a b",)], "s string").select(*scalar.separate("s", " +", ["x", None, "z"])).first()
    assert (parts.x, parts.z) == ("a", None)


def test_recode(spark):
    codes = {"Br": "Branching"}
    df = spark.createDataFrame([("Br",), ("Cushion",), (None,)], "m string")
    kept = [r.v for r in df.select(scalar.recode("m", codes).alias("v")).collect()]
    strict = [r.v for r in df.select(scalar.recode("m", codes, False).alias("v")).collect()]
    assert kept == ["Branching", "Cushion", None]
    assert strict == ["Branching", None, None]


def test_division_and_rounding(spark):
    assert one(spark, scalar.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, scalar.round_even(F.lit(0.125), 2)) == 0.12
    assert one(spark, scalar.round_r2(F.lit(0.2049))) == 0.2
    assert one(spark, scalar.round_r2(F.lit(0.0205))) in (0.02, 0.021)


def test_aggregates_skip_or_refuse_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", 2.0), ("c", None)], "k string, v double")
    rows = df.groupBy("k").agg(
        scalar.strict_sum("v").alias("strict"), scalar.standard_error("v").alias("se"),
        scalar.coefficient_of_variation("v").alias("cv"),
    ).collect()
    out = {r.k: r for r in rows}
    assert out["a"].strict is None and out["b"].strict == 2.0
    assert out["a"].se == pytest.approx(math.sqrt(2) / math.sqrt(2))
    assert out["b"].se is None and out["b"].cv is None and out["c"].cv is None


def test_row_mean_needs_every_value(spark):
    df = spark.createDataFrame([(1.42, 1.32, 1.31), (1.0, None, 2.0)], "a double, b double, c double")
    rows = [r.m for r in df.select(scalar.row_mean(["a", "b", "c"]).alias("m")).collect()]
    # complexity of a site with chains 1.42, 1.32 and 1.31 on 2.03 metres
    assert 1 - rows[0] / 2.03 == pytest.approx(0.3349753695, abs=1e-10)
    assert rows[1] is None


def test_haversine(spark):
    d = one(spark, scalar.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)))
    assert d == pytest.approx(np.pi / 2 * scalar.EARTH_RADIUS_M)
