"""Dissimilarity of sites with more taxa than a task should hold."""

import itertools
from functools import partial

import numpy as np
import pyarrow.parquet as pq
import pytest
from oracle_check import compare, views
from pyspark.sql import functions as F

from ecocline.operators import ordination
from ecocline.plans import space
from ecocline.plans.registry import ORACLES, QUERIES


def table(spark, kind):
    """Counts of 7 sites by 300 taxa as a matrix and as rows, some in two parts; the last site shares nothing."""
    rng = np.random.default_rng(5)
    m = np.where(rng.random((7, 300)) < 0.6, rng.integers(1, 9, (7, 300)), 0).astype(float)
    m[5], m[6] = m[4], 0.0
    m[:6, 299], m[6, 299] = 0.0, 4.0
    rows = [(f"s{i}", j, float(m[i, j])) for i in range(7) for j in range(300)] + [("s0", 3, 1.0), ("s0", 3, None)]
    m[0, 3] += 1
    df = spark.createDataFrame(rows, "site string, taxon long, v double")
    if kind == "string":
        return m, df.withColumn("taxon", F.format_string("t%d", "taxon"))
    return m, df.withColumn("site", F.substring("site", 2, 9).cast("int"))


def plain(m, name):
    return {
        (name(i), name(j)): 1 - 2 * np.minimum(m[i], m[j]).sum() / (m[i].sum() + m[j].sum())
        for i, j in itertools.combinations(range(len(m)), 2)
    }


def found(df, **how):
    rows = ordination.bray_curtis(df, "site", "taxon", "v", **how).collect()
    out = {(r.site_a, r.site_b): r.dissimilarity for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("block, cells", [(256, 40), (3, 40), (2, 7), (256, 10_000)])
@pytest.mark.parametrize("kind", ["int", "string"])
def test_dissimilarity_whatever_the_parts(spark, kind, block, cells):
    m, df = table(spark, kind)
    want = plain(m, lambda i: f"s{i}" if kind == "string" else i)
    got = found(df, block=block, cells=cells)
    assert got == pytest.approx(want) and len(got) == 21
    assert [d for (_, b), d in got.items() if b in ("s6", 6)] == [1.0] * 6


def test_a_task_holds_a_part_of_the_taxa(spark, monkeypatch):
    _, df = table(spark, "int")
    seen = []
    real = ordination.block_reduce
    monkeypatch.setattr(ordination, "block_reduce", lambda rows, keys, *a, **b: seen.append((rows, keys)) or real(rows, keys, *a, **b))
    assert len(found(df, cells=50)) == 21
    rows, keys = seen[0]
    held = [r["count"] for r in rows.groupBy(*keys).count().collect()]
    assert max(held) <= 100 and sum(held) > 1000


def test_missing_taxa_are_shared_with_nobody(spark):
    rows = [("a", "t", 1.0), ("a", None, 1.0), ("b", "t", 1.0), ("b", None, 3.0), (None, "t", 2.0), ("c", None, 5.0)]
    df = spark.createDataFrame(rows, "site string, taxon string, v double")
    for cells in (1, 250_000):
        assert found(df, cells=cells) == pytest.approx({("a", "b"): 1 - 2 / 6, ("a", "c"): 1.0, ("b", "c"): 1.0})


def test_no_sites(spark):
    assert found(spark.createDataFrame([], "site string, taxon string, v double")) == {}


def test_totals_are_not_dealt_by_site(spark):
    """A few sites in many partitions: adaptive execution would leave a sort-merge join, a site's rows in one task."""
    m, df = table(spark, "string")
    out = ordination.standardise(df.filter("v > 0").groupBy("site", "taxon").agg(F.sum("v").alias("v")), "site", "taxon", "v")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(site" not in plan and "SortMergeJoin" not in plan
    scaled = np.sqrt(m) / np.sqrt(m).max(axis=0, initial=1e-300)
    scaled /= scaled.sum(axis=1)[:, None]
    got = {(r.site, r.taxon): r.v for r in out.collect()}
    assert got == pytest.approx({(f"s{i}", f"t{j}"): scaled[i, j] for i, j in zip(*np.nonzero(m))})


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Six nations, 18 suppliers and 90 parts, counts of some parts in several nations."""
    rng = np.random.default_rng(11)
    at = str(tmp_path_factory.mktemp("survey"))
    suppliers = [(i, f"s{i}", i % 6, float(i)) for i in range(18)]
    kinds, words = ["LARGE TIN", "SMALL", "PROMO STEEL", "ECONOMY COPPER"], ["red", "blue", "green"]
    parts = [(i, f"{words[i % 3]} fish {i}", "b", kinds[i % 4], i % 50, 900.0 + i) for i in range(90)]
    items = [
        (i, int(rng.integers(0, 90)), int(rng.integers(0, 18)), float(rng.integers(1, 51)), float(rng.integers(900, 5000)),
         float(rng.integers(0, 11)) / 100, float(rng.integers(0, 9)) / 100, "AN"[i % 2], "OF"[i % 2], None)
        for i in range(700)
    ]
    customers = [(i, f"c{i}", i % 6, float(rng.integers(-900, 9000)), "m") for i in range(60)]
    for name, rows, schema in (
        ("supplier", suppliers, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        ("part", parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        ("lineitem", items, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, "
         "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
        ("customer", customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
    ):
        pq.write_table(spark.createDataFrame(rows, schema).toArrow(), f"{at}/{name}.parquet")
    return at


@pytest.mark.parametrize(
    "name", ["standardised_cover", "bray_curtis", "site_ordination", "ordination_stress", "taxon_score_table"]
)
def test_query_equals_its_sql_in_many_parts(spark, monkeypatch, folder, name):
    covers = []
    monkeypatch.setattr(ordination, "bray_curtis", partial(ordination.bray_curtis, block=4, cells=20))
    monkeypatch.setattr(space, "_region_cover", lambda *a, f=space._region_cover: covers.append(a) or f(*a))
    assert compare(spark, views(folder), folder, name, QUERIES[name], ORACLES[name]) is None
    assert len(covers) == 1


def test_stress_does_not_depend_on_the_parts(spark, monkeypatch, folder):
    whole = QUERIES["ordination_stress"](spark, folder).first().stress
    monkeypatch.setattr(ordination, "bray_curtis", partial(ordination.bray_curtis, block=2, cells=5))
    assert QUERIES["ordination_stress"](spark, folder).first().stress == whole > 0
