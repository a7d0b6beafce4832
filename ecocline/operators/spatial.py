"""Centroids, polygons, prediction grids, variograms and kriged surfaces."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ecocline.functions.scalar import haversine_m, quote
from ecocline.operators.blocks import near_reduce, spread
from ecocline.operators.ordering import exact_median, order_index, top_rows
from ecocline.operators.relations import keyed_join, natural_join
from ecocline.operators.summaries import attach
from ecocline.sources.storage import cut_lineage


def centroids(
    sites: DataFrame, location: str, lon: str, lat: str, lon_offset: float = 0.0
) -> DataFrame:
    """Median position of a location's sites, with an optional longitude offset."""
    moved = sites.withColumn(lon, F.col(lon) + lon_offset)
    return exact_median(moved, [location], {lon: lon, lat: lat})


def nudge(sites: DataFrame, key: str, column: str, shifts: Mapping[object, float]) -> DataFrame:
    """Shift a coordinate of the listed sites."""
    moved = F.col(column)
    for k, by in shifts.items():
        moved = F.when(F.col(key) == k, F.col(column) + by).otherwise(moved)
    return sites.withColumn(column, moved)


def seep_order(
    sites: DataFrame, site: str, lon: str, lat: str, origin: object, name: str = "ord"
) -> DataFrame:
    """Great-circle distance of every site from the origin site, and the order it gives."""
    here = sites.filter(F.col(site) == origin).agg(F.max(lat).alias("lat"), F.max(lon).alias("lon"))
    away = attach(sites, here, "__here").withColumn(
        "distance_m", haversine_m(F.col("__here.lat"), F.col("__here.lon"), F.col(lat), F.col(lon))
    )
    return order_index(away.drop("__here"), "distance_m", name)


def polygon_rings(
    vertices: DataFrame, poly: str, x: str, y: str, ring_id: str | None = None
) -> DataFrame:
    """One row per polygon with the edges of its closed rings, each in vertex order.

    A polygon has one ring, or with ``ring_id`` as many as there are ids: an outer boundary and
    its holes, or several areas. ``poly`` must tell polygons apart; equal names are one polygon. A vertex without a coordinate is left out.
    """
    own = [poly] if ring_id is None else [poly, ring_id]
    corner = F.struct("seq", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ring = F.array_sort(F.collect_list(corner))
    vertices = vertices.dropna(subset=[x, y])
    closed = F.concat(F.slice("__ring", 2, F.size("__ring")), F.slice("__ring", 1, 1))
    rings = vertices.groupBy(*own).agg(ring.alias("__ring"))
    edges = F.zip_with("__ring", closed, lambda a, b: F.struct(
        a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
    ))
    rings = rings.select(poly, edges.alias("edges"))
    if ring_id is None:
        return rings
    return rings.groupBy(poly).agg(F.flatten(F.collect_list("edges")).alias("edges"))


def inside(edges: Column, x: Column, y: Column) -> Column:
    """Ray casting: an odd number of edges crossed to the right of the point."""

    def crossed(e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        at = e["x1"] + F.try_divide((y - e["y1"]) * (e["x2"] - e["x1"]), e["y2"] - e["y1"])
        return spans & F.coalesce(x < at, F.lit(False))

    return F.size(F.filter(edges, crossed)) % 2 == 1


_EDGE = "struct<x1:double,y1:double,x2:double,y2:double,__x1:bigint,__y1:bigint,__x2:bigint,__y2:bigint>"


def _cell(at: Column, low: Column, side: Column) -> Column:
    return F.floor(F.try_divide(at - low, side)).cast("long")


def _edge_cells(edges: DataFrame, own: Sequence[str]) -> DataFrame:
    """Cells ``(own..., i, j)`` of each polygon's grid, with the edges that reach into them.

    ``edges`` has the polygon, its frame (``__x0 __y0 __w __h``) and one edge a row. An edge is listed in the
    cells of its bounding box. ``__odd`` tells whether the edges wholly to the right of a cell are crossed
    an odd number of times as far as that is the same for every point of the cell: each crosses the lines
    that lie between its ends, which holds for all cells to the left of it in the rows below its upper
    end, so that the parity is carried along a row from right to left. What is left to a point's own
    height are ends of edges in its row of cells; rings are closed, so such an end either belongs to two
    edges to the right, which cancel out, or to an edge of the cell, which counts it (``_crossings``).
    """
    c = F.col
    place = edges.withColumns({
        f"__{v}{k}": _cell(c(f"{v}{k}"), c(f"__{v}0"), c(f"__{s}")) for v, s in (("x", "w"), ("y", "h")) for k in (1, 2)
    })
    low, high = (lambda v: F.least(f"__{v}1", f"__{v}2")), (lambda v: F.greatest(f"__{v}1", f"__{v}2"))
    edge = F.struct("x1", "y1", "x2", "y2", "__x1", "__y1", "__x2", "__y2").alias("edge")
    listed = place.select(
        *own, edge, low("x").alias("l"), high("x").alias("h"),
        F.explode(F.sequence(low("y"), high("y"))).alias("j"), high("y").alias("top"),
    )
    cells = listed.withColumn("i", F.explode(F.sequence("l", "h")))
    cells = cells.groupBy(*own, "i", "j").agg(F.collect_list("edge").alias("edges"))
    flips = listed.groupBy(*own, "j", c("l").alias("i")).agg((F.count_if(c("j") < c("top")) % 2).alias("flip"))
    rows = place.groupBy(*own).agg(F.min(low("x")).alias("l"), F.max(high("x")).alias("h"),
                                   F.min(low("y")).alias("b"), F.max(high("y")).alias("t"))
    grid = rows.withColumn("j", F.explode(F.sequence("b", "t"))).withColumn("i", F.explode(F.sequence("l", "h")))
    grid = keyed_join(grid.select(*own, "i", "j"), flips, [*own, "i", "j"], "left")
    right = Window.partitionBy(*own, "j").orderBy(c("i").desc()).rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("__odd", F.coalesce(F.sum("flip").over(right) % 2, F.lit(0)) == 1).drop("flip")
    return keyed_join(grid, cells, [*own, "i", "j"], "left").filter("__odd OR edges IS NOT NULL")


def _crossings(edges: Column, i: Column, j: Column, x: Column, y: Column) -> Column:
    """Is a point of cell (i, j) inside, but for the parity that the cell carries?"""

    def odd(e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        at = e["x1"] + F.try_divide((y - e["y1"]) * (e["x2"] - e["x1"]), e["y2"] - e["y1"])
        ends = [(e[f"__y{k}"] == j) & (e[f"__x{k}"] > i) & (e[f"y{k}"] > y) for k in (1, 2)]
        return (spans & F.coalesce(x < at, F.lit(False))) != (ends[0] != ends[1])

    return F.size(F.filter(edges, odd)) % 2 == 1


def clip(points: DataFrame, rings: DataFrame, x: str, y: str, on: str | None = None) -> DataFrame:
    """Points inside their polygon: the one with the same ``on`` value, or without ``on`` any of them.

    The edges are cut into a grid, of as many cells as there are edges: with ``on`` a grid for each
    polygon, without it one for all. A point meets its own cell alone, which holds the few edges around it
    and the parity of those to its right. Long edges are listed in every cell of their bounding box.
    A point of a hole is outside, one that several polygons cover is kept once; a point on an edge
    is inside at the lower and left edges. Points without a coordinate are outside.
    """
    c = F.col
    poly = on or next(n for n in rings.columns if n != "edges")
    frame_by = [on] if on else []
    edges = rings.select(c(poly).alias(poly), F.inline("edges")).dropna(subset=["x1", "y1", "x2", "y2"])
    side = F.greatest(F.ceil(F.sqrt(F.count("*"))), F.lit(1))
    span = lambda v: F.max(F.greatest(f"{v}1", f"{v}2")) - F.min(F.least(f"{v}1", f"{v}2"))
    step = lambda v: F.when(span(v) > 0, span(v) / side).otherwise(1.0)
    frames = edges.groupBy(*frame_by).agg(
        F.min(F.least("x1", "x2")).alias("__x0"), step("x").alias("__w"),
        F.min(F.least("y1", "y2")).alias("__y0"), step("y").alias("__h"),
    )
    cells = _edge_cells(keyed_join(edges, frames, frame_by), [poly])
    part = F.struct("__odd", F.coalesce("edges", F.array().cast("array<" + _EDGE + ">")).alias("edges"))
    cells = cells.groupBy(*frame_by, c("i").alias("__i"), c("j").alias("__j")).agg(
        # a cell that some polygon covers whole needs no edges of others
        F.max(c("edges").isNull()).alias("__whole"), F.collect_list(part).alias("__parts")
    )
    placed = keyed_join(points, frames, frame_by)
    placed = placed.withColumns({"__i": _cell(c(x), c("__x0"), c("__w")), "__j": _cell(c(y), c("__y0"), c("__h"))})
    met = keyed_join(placed, cells, [*frame_by, "__i", "__j"])
    held = F.exists("__parts", lambda p: p["__odd"] != _crossings(p["edges"], c("__i"), c("__j"), c(x), c(y)))
    return met.filter(c("__whole") | held).select(*[c(quote(n)) for n in points.columns])


def prediction_grid(
    df: DataFrame, keys: Sequence[str], x: str, y: str, pixels: int
) -> DataFrame:
    """Grid over each group's bounding box; the cell is the x range over ``pixels``."""
    c = F.col
    boxes = df.groupBy(*keys).agg(
        F.min(x).alias("x_lo"), F.max(x).alias("x_hi"), F.min(y).alias("y_lo"), F.max(y).alias("y_hi")
    )
    boxes = boxes.withColumn("cell", (c("x_hi") - c("x_lo")) / float(pixels)).filter("cell > 0")
    rows = F.floor((c("y_hi") - c("y_lo")) / c("cell") + 1e-9).cast("int")
    cells = boxes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(pixels)))).withColumn(
        "j", F.explode(F.sequence(F.lit(0), rows))
    )
    return cells.select(
        *keys, (c("x_lo") + c("i") * c("cell")).alias("x"), (c("y_lo") + c("j") * c("cell")).alias("y")
    )


def variogram(
    samples: DataFrame,
    keys: Sequence[str],
    row_id: str,
    x: str,
    y: str,
    z: str,
    lags: int = 3,
    block: int = 1024,
    reach: float | None = None,
) -> DataFrame:
    """Empirical semivariogram per group: mean distance and half mean squared difference by lag.

    Pairs reach to a third of the bounding-box diagonal, or to ``reach``, cut into ``lags`` equal bins.
    Blocks of cells that lie within reach meet and return sums per bin, so the pairs of a large group
    are never rows; with a ``reach`` that does not grow with the survey, the work grows with the samples.
    """
    c = F.col
    ready = samples.dropna(subset=[x, y, z])
    boxes = ready.groupBy(*keys).agg(
        F.max(x).alias("xh"), F.min(x).alias("xl"), F.max(y).alias("yh"), F.min(y).alias("yl")
    )
    third = F.sqrt(F.pow(c("xh") - c("xl"), 2) + F.pow(c("yh") - c("yl"), 2)) / 3
    limit = third if reach is None else F.lit(float(reach))
    rows = keyed_join(ready, boxes.select(*keys, limit.alias("__reach")), keys)
    rows = rows.select(*keys, row_id, c(x).cast("double").alias("__x"), c(y).cast("double").alias("__y"),
                       c(z).cast("double").alias("__z"), "__reach")

    def compare(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        limit = float(left["__reach"].iloc[0])
        gap = lambda n: left[n].to_numpy()[:, None] - right[n].to_numpy()[None, :]
        d, dz = np.hypot(gap("__x"), gap("__y")), gap("__z")
        use = (d <= limit) & (d > 0)
        if same:
            use = np.triu(use, 1)
        d, g = d[use], dz[use] ** 2 / 2
        bin_ = np.minimum((d / (limit / lags)).astype(int), lags - 1)
        table = pd.DataFrame({"lag": bin_, "__n": 1, "__d": d, "__g": g})
        return table.groupby("lag", as_index=False).sum()

    parts = near_reduce(rows, keys, row_id, "__x", "__y", "__reach", ["__z"], compare,
                        "lag int, __n long, __d double, __g double", block)
    return parts.groupBy(*keys, "lag").agg(
        F.sum("__n").alias("n_pairs"),
        (F.sum("__d") / F.sum("__n")).alias("distance"),
        (F.sum("__g") / F.sum("__n")).alias("gamma"),
    )


def variogram_model(empirical: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spherical model per group from a line through the lags: nugget, range and sill."""
    c = F.col
    line = empirical.groupBy(*keys).agg(
        F.regr_intercept("gamma", "distance").alias("nugget"),
        F.regr_slope("gamma", "distance").alias("slope"),
        F.max("distance").alias("range"),
    )
    return line.select(*keys, "nugget", "range", (c("nugget") + c("slope") * c("range")).alias("sill"))


def spherical(d: Column, nugget: Column, range_: Column, sill: Column) -> Column:
    h = F.try_divide(d, range_)
    rising = nugget + (sill - nugget) * (1.5 * h - 0.5 * h * h * h)
    return F.when(d == 0, F.lit(0.0)).when(d >= range_, sill).otherwise(rising)


def _tiled(table: DataFrame, x: str, y: str, level: Column) -> list[Column]:
    """Column and row of the tile of side ``__side / 2 ** level`` that a place lies in or nearest to."""
    tiles = F.pow(F.lit(2.0), level)
    at = lambda v, low: F.least(
        F.greatest(F.floor((F.col(v) - F.col(low)) * tiles / F.col("__side")), F.lit(0)), tiles - 1
    ).cast("long")
    return [at(x, "__x0"), at(y, "__y0")]


def _frames(places: DataFrame, keys: Sequence[str], neighbours: int) -> DataFrame:
    """Square around each group's places, and the level at which its tiles have their own systems.

    A group of at most ``neighbours`` places is one tile; beyond, a tile holds a quarter of them at most, if
    the places lie evenly.
    """
    c = F.col
    boxes = places.groupBy(*keys).agg(
        F.min("__px").alias("__x0"), F.min("__py").alias("__y0"),
        F.greatest(F.max("__px") - F.min("__px"), F.max("__py") - F.min("__py")).alias("__span"),
        F.count("*").alias("__n"),
    )
    level = F.when(c("__n") <= neighbours, 0).otherwise(
        1 + F.ceil(F.log2(c("__n") / float(neighbours)) / 2)
    )
    side = F.when(c("__span") > 0, c("__span")).otherwise(1.0)
    return boxes.select(*keys, "__x0", "__y0", side.alias("__side"), level.cast("int").alias("__level"))


_FINER, _RING = 4, 3


def _nearest(places: DataFrame, frames: DataFrame, keys: Sequence[str], neighbours: int) -> DataFrame:
    """The ``neighbours`` places nearest to the centre of every tile, ties by position.

    Places are counted in cells of every level, down to a few levels below the tiles. The finest level at which the
    three by three cells around a tile's centre hold enough places bounds how far the nearest can be: twice the
    diagonal of such a cell, so that they lie within three cells. A tile meets those cells alone.
    """
    c, keys = F.col, list(keys)
    framed = keyed_join(places, frames, keys)
    levels = F.sequence(F.lit(0), c("__level") + _FINER)
    deep = framed.select("*", F.explode(levels).alias("__l"))
    cx, cy = _tiled(deep, "__px", "__py", c("__l"))
    counts = deep.groupBy(*keys, "__l", cx.alias("__cx"), cy.alias("__cy")).agg(F.count("*").alias("__in"))
    span = F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2.0), c("__level")).cast("long") - 1)
    tiles = frames.withColumn("__tx", F.explode(span)).withColumn("__ty", F.explode(span))
    width = c("__side") / F.pow(F.lit(2.0), c("__level"))
    tiles = tiles.withColumns({
        "__mx": c("__x0") + (c("__tx") + 0.5) * width, "__my": c("__y0") + (c("__ty") + 0.5) * width
    })
    tile = [*keys, "__tx", "__ty"]
    mx, my = _tiled(tiles, "__mx", "__my", c("__l"))
    around = lambda r: F.sequence(F.lit(-r), F.lit(r))

    def cells(table: DataFrame, ring: int) -> DataFrame:
        held = table.select("*", mx.alias("__ax"), my.alias("__ay"))
        held = held.withColumn("__i", F.explode(around(ring))).withColumn("__j", F.explode(around(ring)))
        held = held.withColumns({"__cx": c("__ax") + c("__i"), "__cy": c("__ay") + c("__j")})
        return held.drop("__ax", "__ay", "__i", "__j")

    tried = cells(tiles.select("*", F.explode(levels).alias("__l")), 1)
    near = keyed_join(tried.select(*tile, "__l", "__cx", "__cy"), counts, [*keys, "__l", "__cx", "__cy"])
    enough = near.groupBy(*tile, "__l").agg(F.sum("__in").alias("__in"))
    enough = enough.filter(c("__in") >= neighbours).groupBy(*tile).agg(F.max("__l").alias("__l"))
    # too few places anywhere around: all of the group's, in the one cell of level 0
    found = keyed_join(tiles, enough, tile, "left").withColumn("__l", F.coalesce("__l", F.lit(0)))
    used = found.groupBy(*keys).agg(F.collect_set("__l").alias("__used"))
    laid = keyed_join(framed, used, keys).select("*", F.explode("__used").alias("__l")).drop("__used")
    px, py = _tiled(laid, "__px", "__py", c("__l"))
    laid = laid.select(*keys, "__l", px.alias("__cx"), py.alias("__cy"), "__px", "__py", "__pz")
    met = keyed_join(
        cells(found, _RING).select(*tile, "__l", "__cx", "__cy", "__mx", "__my"), laid,
        [*keys, "__l", "__cx", "__cy"],
    )
    far = F.pow(c("__px") - c("__mx"), 2) + F.pow(c("__py") - c("__my"), 2)
    nearest = top_rows(met.withColumn("__far", far), tile, ["__far", "__px", "__py"], neighbours)
    return nearest.select(*tile, "__px", "__py", "__pz")


def krige_weights(
    samples: DataFrame,
    keys: Sequence[str],
    x: str,
    y: str,
    z: str,
    model: DataFrame,
    neighbours: int = 256,
) -> DataFrame:
    """Dual kriging weights per group and tile: ``(status, mean, nodes)`` and where the tile lies.

    The system of a tile takes the ``neighbours`` samples nearest to its centre (samples at one
    place count as their mean), so a group of at most so many is one dense system, and a larger
    one has as many small systems as it has tiles. No system grows with its group, and the systems of a group
    are spread over tasks by tile. A group or tile that cannot be solved comes back with
    the reason in ``status`` and no nodes, so one bad group never stops the others.
    """
    keys = list(keys)
    c = F.col
    places = samples.dropna(subset=[x, y, z]).groupBy(
        *keys, c(x).cast("double").alias("__px"), c(y).cast("double").alias("__py")
    ).agg(F.avg(z).alias("__pz"))
    places = cut_lineage(places)
    frames = cut_lineage(_frames(places, keys, neighbours))
    near = keyed_join(_nearest(places, frames, keys, neighbours), model, keys)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in samples.select(*keys).schema]
    node = "array<struct<x: double, y: double, w: double>>"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        head, pdf = pdf.iloc[0], pdf.sort_values(["__px", "__py"])
        out = {k: [head[k]] for k in [*keys, "__tx", "__ty"]}
        out |= {"status": ["ok"], "mean": [None], "nodes": [None]}
        try:
            nugget, reach, sill = (float(head[p]) for p in ("nugget", "range", "sill"))
            px, py, pz = (pdf[v].to_numpy(dtype=float) for v in ("__px", "__py", "__pz"))
            if not np.all(np.isfinite([nugget, reach, sill])) or reach <= 0:
                raise ValueError("no variogram model")
            d = np.hypot(px[:, None] - px[None, :], py[:, None] - py[None, :])
            h = np.minimum(d / reach, 1.0)
            gamma = np.where(d == 0, 0.0, nugget + (sill - nugget) * (1.5 * h - 0.5 * h**3))
            system = np.ones((len(px) + 1, len(px) + 1))
            system[:-1, :-1], system[-1, -1] = gamma, 0.0
            w = np.linalg.solve(system, np.append(pz, 0.0))
            out["mean"] = [float(w[-1])]
            out["nodes"] = [[{"x": a, "y": b, "w": v} for a, b, v in zip(px, py, w[:-1])]]
        except (ValueError, np.linalg.LinAlgError) as problem:
            out["status"] = [str(problem)]
        return pd.DataFrame(out)

    tile = [*keys, "__tx", "__ty"]
    schema = ", ".join([*kinds, "__tx long, __ty long, status string, mean double", f"nodes {node}"])
    solved = spread(near, tile).groupBy(*tile).applyInPandas(solve, schema)
    solved = cut_lineage(keyed_join(solved, frames, keys))
    every = keyed_join(
        samples.select(*keys).distinct(), frames.withColumn("__some", F.lit(True)), keys, "left"
    )
    reason = F.when(c("__some"), "no variogram model").otherwise("no samples")
    rest = natural_join(every, solved.select(*keys).distinct(), "left_anti").select(
        *keys, F.lit(0).cast("long").alias("__tx"), F.lit(0).cast("long").alias("__ty"),
        reason.alias("status"), F.lit(None).cast("double").alias("mean"),
        F.lit(None).cast(node).alias("nodes"), "__x0", "__y0", "__side", "__level",
    )
    return solved.unionByName(rest)


def krige(grid: DataFrame, weights: DataFrame, model: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Prediction at every grid point: its tile's weights times the variogram to the tile's samples.

    The samples of a tile travel as one array beside the point, so the grid is neither shuffled
    by sample nor multiplied by the number of samples. A point outside all tiles takes the nearest one.
    """
    c, keys = F.col, list(keys)
    solved = weights.filter("status = 'ok'")
    frames = solved.select(*keys, "__x0", "__y0", "__side", "__level").distinct()
    ready = keyed_join(solved.select(*keys, "__tx", "__ty", "mean", "nodes"), model, keys)
    framed = keyed_join(grid, frames, keys)
    tx, ty = _tiled(framed, "x", "y", c("__level"))
    cells = keyed_join(
        framed.select(*keys, "x", "y", tx.alias("__tx"), ty.alias("__ty")), ready, [*keys, "__tx", "__ty"]
    )

    def term(acc: Column, node: Column) -> Column:
        dx, dy = node["x"] - c("x"), node["y"] - c("y")
        g = spherical(F.sqrt(dx * dx + dy * dy), c("nugget"), c("range"), c("sill"))
        return acc + node["w"] * g

    return cells.select(*keys, "x", "y", F.aggregate("nodes", c("mean"), term).alias("pred"))
