import pytest
from pyspark.sql import functions as F

from ecocline.operators import ordering, relations, reshape, summaries
from ecocline.sources import schemas, storage, tables

KML = """<?xml version="1.0" encoding="UTF-8"?>
<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>doc</name>
<Placemark><name>square</name><Polygon><outerBoundaryIs><LinearRing><coordinates>
  0,0,0 2,0,0
  2,2,0 0,2,0 0,0,0
</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>
<Placemark><name>triangle</name><Polygon><outerBoundaryIs><LinearRing><coordinates>
  5,5 6,5 5,6 5,5</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>
</Document></kml>"""


def test_csv_conventions(spark, tmp_path):
    path = tmp_path / "survey.csv"
    path.write_bytes(
        b"\xef\xbb\xbfLocation,Site,Date,LiveCoral,DeadCoral,Rubble,Sand\n"
        b'North, N1 ,6/14/2022,84,88,0,39\n"East, upper",E1,6/1/2022,NA,,1,2\n'
    )
    rows = tables.read_csv(spark, str(path), schemas.SUBSTRATE).orderBy("site").collect()
    assert [r.site for r in rows] == ["E1", "N1"]
    assert rows[0].location == "East, upper" and rows[0].live_coral is None and rows[0].dead_coral is None
    assert str(rows[1].date) == "2022-06-14" and rows[1].live_coral == 84


def test_csv_with_row_names(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 0.5, None), ("c", -0.25, 1.0)], "fe string, pc1 double, pc2 double")
    path = str(tmp_path / "coords")
    tables.write_csv(df, path, row_key="fe")
    text = "".join(p.read_text() for p in (tmp_path / "coords").glob("*.csv"))
    assert text.splitlines()[0].split(",")[0] in ("", '""')
    back = tables.read_csv(spark, path, df.schema)
    assert sorted(back.collect()) == sorted(df.collect())


def test_scrub_nan(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, None)], "a double, b int")
    assert tables.scrub_nan(df).agg(F.max("a").alias("m")).first().m == 2.0


def test_kml_polygons(spark, tmp_path):
    path = tmp_path / "area.kml"
    path.write_text(KML)
    rows = tables.read_polygons(spark, str(path)).orderBy("poly_id", "seq").collect()
    assert [(r.lon, r.lat) for r in rows if r.poly_id == "square"] == [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]
    assert sum(r.poly_id == "triangle" for r in rows) == 4


def test_data_dictionary(spark):
    df = spark.createDataFrame([], schemas.SITE_META)
    rows = {r.attribute: r for r in schemas.data_dictionary(df).collect()}
    assert len(rows) == 11
    assert rows["live_coral"].units == "%" and rows["site"].units is None
    assert rows["complexity"].n_values == 0


def test_stored_results_survive(spark):
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    assert storage.cut_lineage(df).count() == 5
    assert storage.materialise(df).agg(F.sum("x")).first()[0] == 20


def test_natural_join_matches_missing_keys(spark):
    a = spark.createDataFrame([(1, "x", 10), (2, None, 20), (3, "z", 30)], "k int, g string, a int")
    b = spark.createDataFrame([(2, None, 200), (3, "y", 300), (1, "x", 100)], "k int, g string, b int")
    left = {r.k: r.b for r in relations.natural_join(a, b).collect()}
    assert left == {1: 100, 2: 200, 3: None}
    full = relations.natural_join(a, b, "full").collect()
    assert {(r.k, r.g, r.a, r.b) for r in full} == {
        (1, "x", 10, 100), (2, None, 20, 200), (3, "z", 30, None), (3, "y", None, 300)
    }
    assert [r.k for r in relations.natural_join(a, b, "left_anti").collect()] == [3]
    assert sorted(r.k for r in relations.natural_join(a, b, "left_semi").collect()) == [1, 2]


def test_exclusion_rules_keep_unknown_rows(spark):
    df = spark.createDataFrame([(1, 20.0), (2, None), (3, 5.0)], "id int, v double")
    assert sorted(r.id for r in relations.exclude(df, F.col("v") >= 16, F.col("id") == 9).collect()) == [2, 3]
    hits = {r.rule: r.n_rows for r in relations.rule_hits(df, {"high": F.col("v") >= 16, "none": F.col("id") == 9}).collect()}
    assert hits == {"high": 1, "none": 0}


def test_columns_and_reshape(spark):
    df = spark.createDataFrame([("s1", 1.0, None), ("s2", 3.0, 4.0)], ["site", "Porites sp.", "N+N"])
    assert relations.cols_between(df, "Porites sp.", "N+N") == ["Porites sp.", "N+N"]
    assert relations.relocate(df, "N+N", after="site").columns == ["site", "N+N", "Porites sp."]
    long = reshape.wide_to_long(df, ["Porites sp.", "N+N"])
    assert long.count() == 4
    wide = reshape.long_to_wide(long, ["site"], "parameter", "value", ["Porites sp.", "N+N"], fill=0.0)
    assert {r.site: r["N+N"] for r in wide.collect()} == {"s1": 0.0, "s2": 4.0}
    dense = reshape.dense_long(long.dropna(), ["site"], "parameter", "value", ["Porites sp.", "N+N", "new"])
    assert dense.count() == 6 and dense.agg(F.sum("value")).first()[0] == 8.0


def test_scenarios_share_one_scan(spark):
    df = spark.createDataFrame([("a",), ("seep",)], "site string")
    out = relations.scenarios(df, {"all": None, "reef": F.col("site") != "seep"})
    assert sorted((r.site, r.scenario) for r in out.collect()) == [("a", "all"), ("a", "reef"), ("seep", "all")]


def test_variability_of_published_readings(spark):
    # four salinity readings of one site
    df = spark.createDataFrame([("v1", x) for x in (36.45, 36.41, 36.22, 36.52)] + [("v2", 1.0)], "site string, salinity double")
    out = {r.site: r.salinity for r in summaries.variability(df, ["site"], ["salinity"]).collect()}
    assert out["v1"] == pytest.approx(0.3525343691, abs=1e-9)
    assert out["v2"] is None


def test_rolled_up_equals_direct(spark):
    df = spark.range(1000).select(
        (F.col("id") % 7).alias("site"), F.when(F.col("id") % 5 != 0, F.rand(3) * 10 + 100).alias("v")
    )
    dims = spark.createDataFrame([(i, i % 2) for i in range(7)], "site long, zone long")
    two = {r.zone: r for r in summaries.rolled_up(df, "site", ["v"], dims, ["zone"]).collect()}
    direct = df.join(dims, "site").groupBy("zone").agg(
        F.count("v").alias("n"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s")
    )
    for r in direct.collect():
        assert two[r.zone].v_n == r.n
        assert two[r.zone].v_mean == pytest.approx(r.m, rel=1e-12)
        assert two[r.zone].v_sd == pytest.approx(r.s, rel=1e-9)


def test_shares_sum_to_hundred(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 0.0)], "s string, t string, v double")
    rows = {(r.s, r.t): r.share for r in summaries.share_of_total(df, ["s"], "v").collect()}
    assert rows[("a", "x")] == 25.0 and rows[("a", "y")] == 75.0 and rows[("b", "x")] is None
    pooled = summaries.pooled_shares(spark.createDataFrame([("v1", 84, 88, 0, 39)], ["site", *schemas.SUBSTRATES]), ["site"], schemas.SUBSTRATES).first()
    assert pooled.live_coral == pytest.approx(39.8104265403, abs=1e-9)


@pytest.mark.parametrize("levels", [1, 3, 8])
def test_order_index_is_a_dense_rank(spark, levels):
    df = spark.range(200).select("id", F.when(F.col("id") % 9 != 0, (F.col("id") * 37) % 41).cast("double").alias("m"))
    rows = ordering.order_index(df, "m", levels=levels).collect()
    rank = {v: i + 1 for i, v in enumerate(sorted({r.m for r in rows if r.m is not None}))}
    assert len(rows) == 200
    assert all(r.ord == rank.get(r.m) for r in rows)


@pytest.mark.parametrize("bins, accuracy", [(1, 10), (4, 100), (1024, 10000)])
def test_exact_median_whatever_the_bracket(spark, bins, accuracy):
    import numpy as np

    rng = np.random.default_rng(5)
    groups = {"hot": rng.lognormal(0, 3, 3000), "even": np.arange(10.0), "same": np.full(50, 7.0), "one": np.array([3.0])}
    rows = [(g, float(v), None if i % 4 else float(v)) for g, vs in groups.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows + [("hot", None, 1e9)], "g string, v double, w double")
    out = {r.g: r for r in ordering.exact_median(df, ["g"], {"v": "v", "w": "w"}, bins, accuracy).collect()}
    for g, vs in groups.items():
        w = vs[::4] if g != "hot" else np.append(vs[::4], 1e9)
        assert out[g].v == pytest.approx(np.median(vs), rel=1e-12)
        assert out[g].w == pytest.approx(np.median(w), rel=1e-12)
