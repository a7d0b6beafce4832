"""Kriging of groups of any size by systems of the samples nearest to a tile."""

import numpy as np
import pandas as pd
import pytest

from ecocline.operators import spatial

MODEL = (0.05, 0.3, 1.0)


def gamma(d, nugget, reach, sill):
    h = np.minimum(d / reach, 1)
    return np.where(d == 0, 0, nugget + (sill - nugget) * (1.5 * h - 0.5 * h**3))


def dense(p, z, at, model):
    """Ordinary kriging by one dense system."""
    n = len(p)
    k = np.ones((n + 1, n + 1))
    k[:n, :n], k[n, n] = gamma(np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1)), *model), 0
    w = np.linalg.solve(k, np.append(z, 0.0))
    return gamma(np.hypot(*(np.asarray(at)[:, None] - p[None]).transpose(2, 0, 1)), *model) @ w[:n] + w[n]


def expected(p, z, at, model, neighbours):
    """Each tile by the dense system of the samples nearest to its centre."""
    low, side = p.min(axis=0), np.ptp(p, axis=0).max()
    n = len(p)
    tiles = 1 if n <= neighbours else 2 ** (1 + int(np.ceil(np.log2(n / neighbours) / 2)))
    cell = np.clip(np.floor((np.asarray(at) - low) * tiles / side), 0, tiles - 1)
    out = np.empty(len(at))
    for c in np.unique(cell, axis=0):
        centre = low + (c + 0.5) * side / tiles
        near = np.lexsort((p[:, 1], p[:, 0], ((p - centre) ** 2).sum(axis=1)))[:neighbours]
        mine = (cell == c).all(axis=1)
        out[mine] = dense(p[near], z[near], np.asarray(at)[mine], model)
    return out


def kriged(spark, groups, at, neighbours):
    rows = pd.concat([pd.DataFrame({"g": g, "x": p[:, 0], "y": p[:, 1], "z": z}) for g, (p, z) in groups.items()])
    model = spark.createDataFrame([(g, *MODEL) for g in groups], "g string, nugget double, range double, sill double")
    grid = spark.createDataFrame([(g, *map(float, a)) for g in groups for a in at], "g string, x double, y double")
    weights = spatial.krige_weights(spark.createDataFrame(rows), ["g"], "x", "y", "z", model, neighbours)
    out = spatial.krige(grid, weights, model, ["g"]).toPandas()
    return {g: out[out["g"] == g].set_index(["x", "y"])["pred"] for g in groups}


def surface(rng, n, clusters=False):
    p = rng.random((n, 2))
    if clusters:
        p[: n // 2] = 0.1 + p[: n // 2] * 0.01
    return p, np.sin(5 * p[:, 0]) + p[:, 1] ** 2 + rng.normal(0, 0.02, n)


@pytest.mark.parametrize("clusters", [False, True])
def test_tiles_equal_dense_systems_of_their_nearest_samples(spark, clusters):
    rng = np.random.default_rng(4)
    groups = {"a": surface(rng, 700, clusters), "b": surface(rng, 40), "c": surface(rng, 33, clusters)}
    at = np.vstack([rng.random((60, 2)), [[0.1, 0.1], [0.105, 0.106], [-0.5, 2.0]]])
    found = kriged(spark, groups, at, 32)
    for g, (p, z) in groups.items():
        want = expected(p, z, at, MODEL, 32)
        assert [found[g][tuple(a)] for a in at] == pytest.approx(want, abs=1e-8)


def test_a_group_of_20000_samples(spark):
    rng = np.random.default_rng(5)
    p, z = surface(rng, 20_000)
    at = rng.random((300, 2))
    found = kriged(spark, {"hot": (p, z), "small": (p[:30], z[:30])}, at, 64)
    got = np.array([found["hot"][tuple(a)] for a in at])
    assert got == pytest.approx(expected(p, z, at, MODEL, 64), abs=1e-8)
    truth = np.sin(5 * at[:, 0]) + at[:, 1] ** 2
    assert np.abs(got - truth).max() < 0.1 and len(found["small"]) == 300


def test_small_groups_are_one_system_whatever_the_limit(spark):
    rng = np.random.default_rng(6)
    p, z = surface(rng, 25)
    at = rng.random((20, 2))
    one, two = (kriged(spark, {"g": (p, z)}, at, n)["g"].sort_index() for n in (25, 4000))
    assert one.to_numpy() == pytest.approx(two.to_numpy())
    assert [one[tuple(a)] for a in at] == pytest.approx(dense(p, z, at, MODEL))


def test_samples_at_one_place_and_missing_keys(spark):
    rows = [(None, 1.0, 1.0, 2.0), (None, 1.0, 1.0, 4.0), (None, 2.0, 1.0, 5.0), ("n", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double")
    model = spark.createDataFrame([(None, 0.1, 2.0, 1.0)], "g string, nugget double, range double, sill double")
    weights = spatial.krige_weights(df, ["g"], "x", "y", "z", model)
    assert {r.g: r.status for r in weights.collect()} == {None: "ok", "n": "no samples"}
    grid = spark.createDataFrame([(None, 1.0, 1.0)], "g string, x double, y double")
    assert spatial.krige(grid, weights, model, ["g"]).first().pred == pytest.approx(3.0)
