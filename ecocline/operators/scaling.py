"""Classical scaling of a pair table by block subspace iteration.

The centred matrix of squared distances is never held whole. Sites are hashed into blocks of about
``block``; each pair of blocks keeps its squared distances as one array. A product of the matrix with a
few columns is a join of the block pairs with the columns of their two blocks, summed by site.

Axes come from a growing basis (a thick-restart block Krylov space): the Ritz vectors of the basis are
the best axes in it, and their residuals are the next columns. What reaches the driver are the small
products of the basis with itself, at most 96 by 96 numbers however many sites there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecocline.sources.storage import materialise

_START, _GROW, _MOST = 16, 16, 96
_ROUNDS = 200


def _seats(sites: DataFrame, site: str, block: int) -> tuple[DataFrame, int, int]:
    """``(own, members)``: the sites of every block, in order; and how many sites and blocks there are."""
    listed = sites.select(F.col(site).alias("s")).distinct()
    n = listed.count()
    blocks = max(1, -(-n // block))
    own = F.pmod(F.xxhash64("s"), F.lit(blocks)).cast("int")
    seats = listed.groupBy(own.alias("own")).agg(F.array_sort(F.collect_list("s")).alias("members"))
    return materialise(seats, "seats"), n, blocks


def _squares(pairs: DataFrame, distance: str, seats: DataFrame, blocks: int) -> DataFrame:
    """``(a, b, sq)``: squared distances of two blocks' members, row by row; an absent pair is at 1."""
    own = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    both = pairs.select(
        own("site_a").alias("oa"), own("site_b").alias("ob"), F.col("site_a").alias("sa"),
        F.col("site_b").alias("sb"), F.col(distance).cast("double").alias("d"),
    )
    turned = F.col("oa") > F.col("ob")
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    listed = both.groupBy(pick("oa", "ob").alias("a"), pick("ob", "oa").alias("b")).agg(
        F.collect_list(F.struct(pick("sa", "sb").alias("i"), pick("sb", "sa").alias("j"), "d")).alias("cells")
    )
    left = seats.select(
        F.col("own").alias("a"), F.col("members").alias("ma"),
        F.explode(F.sequence("own", F.lit(blocks - 1))).alias("b"),
    )
    right = seats.select(F.col("own").alias("b"), F.col("members").alias("mb"))
    held = left.join(right, "b").join(listed, ["a", "b"], "left")

    def dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                ma, mb = ({s: i for i, s in enumerate(m)} for m in (row.ma, row.mb))
                d = np.ones((len(ma), len(mb)))
                for cell in row.cells if row.cells is not None else ():
                    d[ma[cell["i"]], mb[cell["j"]]] = cell["d"]
                    if row.a == row.b:
                        d[ma[cell["j"]], mb[cell["i"]]] = cell["d"]
                if row.a == row.b:
                    np.fill_diagonal(d, 0.0)
                out.append((d * d).ravel())
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "sq": out})

    return materialise(held.mapInPandas(dense, "a int, b int, sq array<double>"), "squares")


def _mapped(table: DataFrame, columns: str, fn: Callable[..., dict[str, np.ndarray]]) -> DataFrame:
    """``fn`` on every block: from its columns' arrays as matrices of one row a site to further ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                arrays = {k: np.asarray(v).reshape(row["n"], -1) for k, v in row.items() if k not in ("own", "n")}
                rows.append({"own": row["own"], "n": row["n"]} | {k: v.ravel() for k, v in fn(**arrays).items()})
            yield pd.DataFrame(rows, columns=["own", "n", *columns.split()])

    schema = "own int, n int, " + ", ".join(f"{c} array<double>" for c in columns.split())
    return table.mapInPandas(run, schema)


def _summed(table: DataFrame, array: str) -> np.ndarray:
    """Elementwise sum of equally long short arrays."""
    cells = table.select(F.posexplode(array).alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    got = cells.collect()
    out = np.zeros(len(got))
    for r in got:
        out[r["at"]] = r["v"]
    return out


def _centred(table: DataFrame, n: int) -> DataFrame:
    """Columns ``v`` less their means over all sites."""
    sums = _mapped(table, "v", lambda v: {"v": v.sum(axis=0)})
    means = _summed(sums, "v") / n
    return _mapped(table, "v", lambda v: {"v": v - means})


def _times(squares: DataFrame, columns: DataFrame) -> DataFrame:
    """``(own, v)``: the squares times columns, over -2."""
    side = lambda key, name: columns.select(
        F.col("own").alias(key), F.col("n").alias(f"n{key}"), F.col("v").alias(name)
    )
    met = squares.join(side("a", "va"), "a").join(side("b", "vb"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own, out = [], []
            for r in pdf.itertuples():
                sq = np.asarray(r.sq).reshape(r.na, r.nb)
                own.append(r.a)
                out.append((sq @ np.asarray(r.vb).reshape(r.nb, -1)).ravel())
                if r.a != r.b:
                    own.append(r.b)
                    out.append((sq.T @ np.asarray(r.va).reshape(r.na, -1)).ravel())
            yield pd.DataFrame({"own": own, "v": out})

    parts = met.mapInPandas(run, "own int, v array<double>")
    cells = parts.select("own", F.posexplode("v").alias("at", "x")).groupBy("own", "at").agg(
        (-0.5 * F.sum("x")).alias("x")
    )
    listed = cells.groupBy("own").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("c"))
    return listed.select("own", F.col("c.x").alias("v"))


def _ritz(g: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Ritz values and vectors (as combinations of the basis), largest first, and the basis's rank."""
    size = np.sqrt(np.maximum(np.diag(g), 0.0))
    scale = np.where(size > 0, 1 / np.where(size > 0, size, 1.0), 0.0)
    s, u = np.linalg.eigh(g * scale[:, None] * scale)
    held = s > 1e-10
    white = scale[:, None] * u[:, held] / np.sqrt(s[held])
    values, q = np.linalg.eigh(white.T @ ((h + h.T) / 2) @ white)
    order = np.argsort(-values)[:k]
    return values[order], white @ q[:, order], int(held.sum())


def principal_axes(
    sites: DataFrame, site: str, pairs: DataFrame, distance: str, k: int = 2, block: int = 256,
    tolerance: float = 1e-7,
) -> DataFrame:
    """Classical scaling of a sparse pair table: ``(site, axis1..axisk)``; an absent pair is at 1.

    ``sites`` is the site list; ``pairs`` has site_a, site_b and ``distance``. An axis points to where its
    largest coordinate lies (of equal ones the first site's). Axes without a positive root are 0.
    """
    seats, n, blocks = _seats(sites, site, block)
    squares = _squares(pairs, distance, seats, blocks)
    shape = seats.select("own", F.size("members").alias("n"))

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [np.random.default_rng(o).normal(size=m * _START) for o, m in zip(pdf["own"], pdf["n"])]
            yield pd.DataFrame({"own": pdf["own"], "n": pdf["n"], "v": made})

    first = materialise(_centred(shape.mapInPandas(start, "own int, n int, v array<double>"), n), "basis")
    # Row means of the matrix (over -2). With centred columns v the product's column means are theirs
    # with v, so that they are known before the product is made, and it can be centred as it is written.
    ones = _mapped(shape.withColumn("v", F.array_repeat(F.lit(1.0 / n), F.col("n"))), "v", lambda v: {"v": v})
    means = _times(squares, ones).select("own", F.col("v").alias("r"))
    basis = materialise(
        first.join(means, "own").join(_times(squares, first).select("own", F.col("v").alias("w")), "own"), "basis"
    )
    lead = _summed(_mapped(basis, "g", lambda v, r, w: {"g": r.T @ v}), "g")
    basis = _mapped(basis, "v r w", lambda v, r, w: {"v": v, "r": r, "w": w - lead})
    fresh = 0  # columns that the last round added
    for _ in range(_ROUNDS):
        sums = _summed(
            _mapped(basis, "g", lambda v, r, w: {"g": np.concatenate([v.T @ v, v.T @ w, r.T @ v, r.T @ w])}), "g"
        )
        c = int(round(np.sqrt(len(sums) / 2 + 1) - 1 + 1e-9)) if len(sums) else 0
        sums = sums.reshape(-1, c)
        g, h, rv, rw = sums[:c], sums[c : 2 * c], sums[2 * c], sums[2 * c + 1]
        roots, axes, rank = _ritz(g, h, max(_START, k))
        # The added columns are the residuals of the last round's axes.
        left = np.sqrt(np.maximum(np.diag(g)[c - fresh :][:k], 0.0)) if fresh else np.array([np.inf])
        if rank == 0 or rank >= n - 1 or left.max() <= tolerance * max(abs(roots[0]), 1e-300):
            break
        fresh = min(max(_GROW, k), len(roots))
        some, theta = axes[:, :fresh], roots[:fresh]
        kept = np.eye(c) if c + fresh <= _MOST else axes
        lead = rw @ some - rv @ some * theta
        residual = _mapped(basis, "v", lambda v, r, w: {"v": w @ some - v @ some * theta})
        wide = basis.join(_times(squares, residual).select("own", F.col("v").alias("nw")), "own")
        basis = materialise(
            _mapped(
                wide, "v r w",
                lambda v, r, w, nw: {
                    "v": np.hstack([v @ kept, w @ some - v @ some * theta]), "r": r,
                    "w": np.hstack([w @ kept, nw - lead]),
                },
            ), "basis",
        )
    count = min(k, len(roots)) if rank else 0
    wanted = axes[:, :count] * np.sqrt(np.maximum(roots[:count], 0.0)) if count else np.zeros((c, 0))
    placed = _mapped(
        basis, "x", lambda v, r, w: {"x": np.hstack([v @ wanted, np.zeros((len(v), k - count))])}
    )
    names = [f"axis{i + 1}" for i in range(k)]
    rows = seats.join(placed.drop("n"), "own").select(F.posexplode("members").alias("at", site), "x")
    rows = rows.select(site, *[F.get("x", F.col("at") * k + i).alias(a) for i, a in enumerate(names)])
    rows = materialise(rows, "axes")
    far = {a: F.round(F.abs(F.col(a)), 9) for a in names}
    top = rows.agg(*[F.max(v).alias(a) for a, v in far.items()]).first()
    if top is None or top[0] is None:
        return rows
    sign = rows.agg(*[F.min_by(F.signum(a), F.when(v >= F.lit(top[a]), F.col(site))).alias(a) for a, v in far.items()])
    turn = sign.first()
    return rows.select(site, *[(F.col(a) * (-1.0 if (turn[a] or 0) < 0 else 1.0)).alias(a) for a in names])
