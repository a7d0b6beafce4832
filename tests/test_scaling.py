"""Block ordination and the chunked monotone fit against dense and plain versions."""

import itertools
import math

import numpy as np
import pytest

from ecocline.operators import monotone, ordination, scaling


def dense_axes(d, k):
    sq = d * d
    b = -0.5 * (sq - sq.mean(axis=0) - sq.mean(axis=1)[:, None] + sq.mean())
    roots, vectors = np.linalg.eigh(b)
    order = np.argsort(-roots)[:k]
    return vectors[:, order] * np.sqrt(np.maximum(roots[order], 0.0))


def same_axes(found, want):
    for got, axis in zip(found.T, want.T):
        turned = axis * (1 if axis[np.argmax(np.abs(np.round(axis, 9)))] >= 0 else -1)
        assert got == pytest.approx(turned, abs=1e-6)


def axes_of(spark, d, block, k=2):
    n = len(d)
    sites = spark.createDataFrame([(f"s{i:04}",) for i in range(n)], "site string")
    pairs = [(f"s{i:04}", f"s{j:04}", float(d[i, j])) for i, j in itertools.combinations(range(n), 2) if d[i, j] != 1]
    pairs = spark.createDataFrame(pairs, "site_a string, site_b string, d double")
    out = scaling.principal_axes(sites, "site", pairs, "d", k, block).orderBy("site").collect()
    assert [r.site for r in out] == [f"s{i:04}" for i in range(n)]
    return np.array([tuple(r)[1:] for r in out])


@pytest.mark.parametrize("n, block", [(60, 16), (23, 4)])
def test_axes_equal_the_dense_solve(spark, n, block):
    rng = np.random.default_rng(n)
    m = np.where(rng.random((n, 9)) < 0.5, rng.integers(1, 9, (n, 9)), 0) + rng.normal(size=(n, 1)) ** 2 * np.eye(9)[0]
    total = m.sum(axis=1)
    d = 1 - 2 * np.minimum(m[:, None], m[None]).sum(axis=2) / (total[:, None] + total[None])
    np.fill_diagonal(d, 0.0)
    same_axes(axes_of(spark, d, block), dense_axes(d, 2))


def test_few_sites_and_no_sites(spark):
    d = np.array([[0.0, 0.5], [0.5, 0.0]])
    assert axes_of(spark, d, 8) == pytest.approx(np.array([[0.25, 0.0], [-0.25, 0.0]]))
    assert axes_of(spark, np.zeros((1, 1)), 8) == pytest.approx(np.zeros((1, 2)))
    assert axes_of(spark, np.zeros((3, 3)), 8) == pytest.approx(np.zeros((3, 2)))


@pytest.mark.parametrize("block", [3, 7, 256])
def test_all_pairs_whatever_the_block(spark, block):
    sites = spark.createDataFrame([(f"s{i}",) for i in range(11)] * 2, "site string")
    out = sorted(tuple(r) for r in ordination.all_pairs(sites, "site", block).collect())
    assert out == sorted(tuple(sorted(p)) for p in itertools.combinations({f"s{i}" for i in range(11)}, 2))


def plain_fit(xs, ys):
    """Largest of smallest running means, ties of x taken together."""
    keys = sorted(set(xs))
    n = [sum(x == k for x in xs) for k in keys]
    s = [sum(y for x, y in zip(xs, ys) if x == k) for k in keys]
    mean = lambda a, b: sum(s[a : b + 1]) / sum(n[a : b + 1])
    return {
        k: max(min(mean(a, b) for b in range(i, len(keys))) for a in range(i + 1)) for i, k in enumerate(keys)
    }


@pytest.mark.parametrize("chunk", [3, 8, 50_000])
@pytest.mark.parametrize("kind", ["noise", "falling", "rising", "ties"])
def test_monotone_fit_equals_running_means(spark, chunk, kind):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 5, 60).astype(float) if kind == "ties" else rng.random(60)
    y = {"falling": -x, "rising": x * x}.get(kind, x + rng.normal(0, 0.5, 60))
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [(90, None, 1.0), (91, 0.5, None)]
    df = spark.createDataFrame(rows, "id int, x double, y double").repartition(3)
    out = {r.id: r for r in monotone.monotone_fit(df, "x", "y", chunk=chunk).collect()}
    want = plain_fit(list(map(float, x)), list(map(float, y)))
    assert len(out) == 62 and out[90].fitted is None and out[91].fitted is None
    assert [out[i].fitted for i in range(60)] == pytest.approx([want[float(v)] for v in x])


def test_a_third_of_the_pairs_at_one_value(spark):
    rng = np.random.default_rng(1)
    x = np.where(rng.random(30_000) < 0.33, 1.0, rng.random(30_000))
    y = x + rng.normal(0, 0.2, 30_000)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    pools = monotone.monotone_pools(df, "x", "y", chunk=1000).orderBy("low").collect()
    assert all(a.fitted < b.fitted and a.high < b.low for a, b in itertools.pairwise(pools))
    one = monotone.monotone_pools(df, "x", "y").orderBy("low").collect()
    assert [tuple(p) for p in pools] == [pytest.approx(tuple(p)) for p in one]
    fit = ordination.shepard_fit(df.withColumnsRenamed({"x": "d", "y": "distance"}), "d", "distance")
    assert fit.count() == 30_000 and math.isfinite(ordination.stress(fit, "distance").first().stress)
