"""Near pairs by blocks of cells: the variogram against all pairs, whatever the size of a block."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ecocline.operators import blocks, spatial


def samples(spark, groups):
    rows = [
        (k, int(i), None if x is None else float(x), float(y), float(z))
        for k, places in groups.items() for i, (x, y, z) in enumerate(places)
    ]
    return spark.createDataFrame(rows, "k string, id long, x double, y double, z double")


def plain(places, reach=None, lags=3):
    p = np.array([q for q in places if q[0] is not None], dtype=float)
    limit = np.hypot(np.ptp(p[:, 0]), np.ptp(p[:, 1])) / 3 if reach is None else reach
    i, j = np.triu_indices(len(p), 1)
    d, g = np.hypot(p[i, 0] - p[j, 0], p[i, 1] - p[j, 1]), (p[i, 2] - p[j, 2]) ** 2 / 2
    lag = np.minimum((d / (limit / lags)).astype(int), lags - 1)
    held = (d <= limit) & (d > 0)
    return {n: (int(m.sum()), d[m].mean(), g[m].mean()) for n in range(lags) if (m := held & (lag == n)).any()}


@pytest.mark.parametrize("block, reach", [(1000, None), (7, None), (7, 0.4), (3, 2.5), (20, 100.0)])
def test_variogram_of_uneven_groups(spark, block, reach):
    rng = np.random.default_rng(4)
    groups = {
        "even": rng.uniform(0, 6, (90, 3)).tolist(),
        "line": [(t, 2.0, t * t) for t in rng.uniform(0, 5, 40)],
        "heap": [(1.0, 1.0, v) for v in rng.normal(size=30)] + rng.uniform(0, 3, (10, 3)).tolist(),
        "pair": [(0.0, 0.0, 1.0), (0.1, 0.0, 2.0), (None, 1.0, 5.0)],
    }
    df = samples(spark, groups)
    got = {}
    for r in spatial.variogram(df, ["k"], "id", "x", "y", "z", 3, block, reach).collect():
        got.setdefault(r.k, {})[r.lag] = (r.n_pairs, r.distance, r.gamma)
    for k, places in groups.items():
        want = plain(places, reach)
        assert got.get(k, {}).keys() == want.keys(), k
        for lag, row in want.items():
            assert got[k][lag] == pytest.approx(row, rel=1e-9), (k, lag)


def test_places_apart_never_meet_and_rows_grow_with_the_samples(spark):
    rng = np.random.default_rng(9)
    sent = {}
    for n in (400, 1600):  # the same density
        places = rng.uniform(0, np.sqrt(n), (n, 3)).tolist()
        df = samples(spark, {"k": places}).withColumn("reach", F.lit(1.5))

        def compare(left, right, same):
            far = max(
                left["x"].min() - right["x"].max(), right["x"].min() - left["x"].max(),
                left["y"].min() - right["y"].max(), right["y"].min() - left["y"].max(),
            )
            return pd.DataFrame({"n": [len(left) + (0 if same else len(right))], "far": [float(far)]})

        rows = blocks.near_reduce(df, ["k"], "id", "x", "y", "reach", [], compare, "n long, far double", 16)
        total = rows.agg(F.sum("n").alias("n"), F.max("far").alias("far")).first()
        assert total.far <= 1.5 + 2 * 4.0  # cells of side 4 that lie within reach
        sent[n] = total.n
    assert sent[1600] < 5 * sent[400]


def test_groups_without_places_have_no_variogram(spark):
    df = samples(spark, {"none": [(None, 1.0, 1.0)], "one": [(1.0, 1.0, 1.0)], "same": [(1.0, 1.0, 1.0)] * 3})
    assert spatial.variogram(df, ["k"], "id", "x", "y", "z").collect() == []
    assert spatial.variogram(df.filter("false"), ["k"], "id", "x", "y", "z").collect() == []
