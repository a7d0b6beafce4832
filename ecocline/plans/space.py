"""Trait space, hulls, ordination and spatial queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ecocline.functions.scalar import short_name
from ecocline.operators import diversity, hulls, ordering, ordination, regression, reshape, spatial, traits
from ecocline.plans.community import _BROAD, _broad
from ecocline.plans.registry import (
    ABIOTIC, COVER, PARAMETERS, REGIONS, SITE_TABLE, TAXA, TRAITS, cover_counts, query, regions,
    rounded, site_table, taxa,
)
from ecocline.sources import storage
from ecocline.sources.tables import parquet, read_polygons, write_polygons

_FE = "taxon_group || ',' || morph || ',' || energy"
AXES = ["pc1", "pc2", "pc3", "pc4"]

_ENTITIES = f"""{TAXA},
entities AS (SELECT DISTINCT taxon_group, morph, energy, {_FE} AS fe FROM taxa
  WHERE taxon_group <> '{ABIOTIC}')"""


def _taxa_entities(spark, sf):
    living = taxa(spark, sf).filter(F.col("taxon_group") != ABIOTIC)
    return diversity.functional_entities(living, "taxon", TRAITS)


def _entities(spark, sf):
    """Distinct trait combinations: bounded by the trait vocabulary."""
    return _taxa_entities(spark, sf).drop("taxon").distinct()


def _entity_points(spark, sf):
    """Four coordinates per entity from the averages of its taxa."""
    c = F.col
    living = taxa(spark, sf).filter(c("taxon_group") != ABIOTIC)
    fe = F.concat_ws(",", *TRAITS).alias("fe")
    return living.groupBy(*TRAITS, fe).agg(
        (F.avg("size") / 50).alias("pc1"), (F.avg("price") / 1000).alias("pc2"),
        (F.min("size") / 50).alias("pc3"), (F.max("price") / 1000).alias("pc4"),
    )


_POINTS = f"""{TAXA},
points AS (SELECT taxon_group, morph, energy, {_FE} AS fe, avg(size) / 50 AS pc1,
  avg(price) / 1000 AS pc2, min(size) / 50 AS pc3, max(price) / 1000 AS pc4
  FROM taxa WHERE taxon_group <> '{ABIOTIC}' GROUP BY ALL)"""

_D4 = "sqrt(pow(a.pc1 - b.pc1, 2) + pow(a.pc2 - b.pc2, 2) + pow(a.pc3 - b.pc3, 2) + pow(a.pc4 - b.pc4, 2))"


@query(
    "gower_profile",
    f"""WITH {_ENTITIES},
d AS (SELECT a.fe, 1 - ((a.taxon_group = b.taxon_group)::INT + (a.morph = b.morph)::INT
  + (a.energy = b.energy)::INT) / 3.0 AS d FROM entities a JOIN entities b ON a.fe <> b.fe),
m AS (SELECT fe, avg(d) AS mean_distance FROM d GROUP BY fe),
g AS (SELECT *, unnest([0, 1, 2, 3]) / 3.0 AS distance FROM m)
SELECT g.fe, round(mean_distance, 6) AS mean_distance, round(g.distance, 6) AS distance,
  count(d.d) AS n_others
FROM g LEFT JOIN d ON d.fe = g.fe AND abs(d.d - g.distance) < 1e-9 GROUP BY ALL""",
)
def gower_profile(spark, sf):
    """Every entity's Gower distances to all others, as counts per distance and their mean."""
    return rounded(traits.gower_profile(_entities(spark, sf), "fe", TRAITS))


@query(
    "gower_along_gradient",
    f"""WITH {COVER},
top AS (
  SELECT site, {_FE} AS fe, taxon_group, morph, energy, row_number() OVER (
    PARTITION BY site ORDER BY cnt DESC, taxon) AS rank,
    avg(cnt) OVER (PARTITION BY site) AS size FROM cover)
SELECT a.site, a.fe AS fe_a, b.fe AS fe_b, round(((a.taxon_group <> b.taxon_group)::INT
  + (a.morph <> b.morph)::INT + (a.energy <> b.energy)::INT) / 3, 6) AS distance
FROM top a JOIN top b ON a.site = b.site AND a.rank = 1 AND b.rank = 2""",
)
def gower_along_gradient(spark, sf):
    """Gower distance of given entity pairs: the two most counted taxa of every site."""
    entities = _taxa_entities(spark, sf)
    top = ordering.top_rows(cover_counts(spark, sf), ["site"], [F.desc("count"), F.asc("taxon")], 2)
    top = top.select("site", "rank", "taxon").join(entities.select("taxon", "fe"), "taxon")
    at = lambda r, name: top.filter(F.col("rank") == r).select("site", F.col("fe").alias(name))
    pairs = at(1, "fe_a").join(at(2, "fe_b"), "site")
    out = traits.gower_between(pairs, _entities(spark, sf), "fe_a", "fe_b", "fe", TRAITS)
    return rounded(out.select("site", "fe_a", "fe_b", "distance"))


@query(
    "trait_axes_spectrum",
    f"""WITH {_ENTITIES},
d AS (SELECT a.fe AS i, b.fe AS j, pow(1 - ((a.taxon_group = b.taxon_group)::INT
  + (a.morph = b.morph)::INT + (a.energy = b.energy)::INT) / 3.0, 2) AS q FROM entities a, entities b),
r AS (SELECT i, avg(q) AS r FROM d GROUP BY i),
b AS (SELECT d.i, d.j, -0.5 * (q - ri.r - rj.r + (SELECT avg(q) FROM d)) AS b
  FROM d JOIN r ri ON ri.i = d.i JOIN r rj ON rj.i = d.j),
b2 AS (SELECT x.i, y.j, sum(x.b * y.b) AS b FROM b x JOIN b y ON x.j = y.i GROUP BY ALL)
SELECT round((SELECT sum(b) FROM b WHERE i = j), 6) AS trace,
  round((SELECT sum(b * b) FROM b), 6) AS second,
  round((SELECT sum(b.b * b2.b) FROM b JOIN b2 ON b.i = b2.j AND b.j = b2.i), 6) AS third,
  round((SELECT sum(b * b) FROM b2), 6) AS fourth""",
)
def trait_axes_spectrum(spark, sf):
    """Power sums of all eigenvalues of the trait space, found without the distance matrix."""
    roots = traits.variance_explained(traits.trait_axes(_entities(spark, sf), "fe", TRAITS))
    power = lambda k: F.sum(F.pow("eigenvalue", F.lit(k)))
    return rounded(
        roots.agg(*[power(k).alias(n) for k, n in enumerate(["trace", "second", "third", "fourth"], 1)])
    )


@query("trait_coordinates")
def trait_coordinates(spark, sf):
    """Principal coordinates of every functional entity on four axes."""
    entities = _entities(spark, sf)
    axes = traits.trait_axes(entities, "fe", TRAITS)
    return rounded(traits.entity_coordinates(entities, "fe", TRAITS, axes), 9)


@query("variance_explained")
def variance_explained(spark, sf):
    """Eigenvalues of the trait space and the running share of the positive ones."""
    return rounded(traits.variance_explained(traits.trait_axes(_entities(spark, sf), "fe", TRAITS)))


@query(
    "space_quality",
    f"""WITH {_POINTS},
d AS (SELECT 1 - ((a.taxon_group = b.taxon_group)::INT + (a.morph = b.morph)::INT
  + (a.energy = b.energy)::INT) / 3.0 AS g, pow(a.pc1 - b.pc1, 2) AS d1, pow(a.pc2 - b.pc2, 2) AS d2,
  pow(a.pc3 - b.pc3, 2) AS d3, pow(a.pc4 - b.pc4, 2) AS d4
  FROM points a JOIN points b ON a.fe < b.fe),
k AS (SELECT 2 AS k, g, sqrt(d1 + d2) AS d FROM d UNION ALL SELECT 3, g, sqrt(d1 + d2 + d3) FROM d
  UNION ALL SELECT 4, g, sqrt(d1 + d2 + d3 + d4) FROM d),
m AS (SELECT k, max(g) / max(d) AS s FROM k GROUP BY k)
SELECT k, round(avg(pow(g - s * d, 2)), 8) AS msd FROM k JOIN m USING (k) GROUP BY k""",
)
def space_quality(spark, sf):
    """Mean squared deviation between Gower and k-axis distances, k = 2 to 4."""
    points = _entity_points(spark, sf)
    return rounded(traits.space_quality(points, "fe", TRAITS, AXES, [2, 3, 4], block=64), 8)


@query(
    "entity_distance_sums",
    f"""WITH {_POINTS}
SELECT a.fe, count(*) AS n, round(sum({_D4}), 6) AS d, round(sum(pow({_D4}, 2)), 6) AS d2
FROM points a, points b GROUP BY a.fe""",
)
def entity_distance_sums(spark, sf):
    """Sum and sum of squares of an entity's distances to all entities, from block pairs."""
    return rounded(traits.distance_sums(_entity_points(spark, sf), "fe", AXES, block=64))


def _dispersion(spark, sf, without=None):
    present = cover_counts(spark, sf).select("site", "taxon").join(
        _taxa_entities(spark, sf).select("taxon", "fe"), "taxon"
    )
    sums = traits.distance_sums(_entity_points(spark, sf), "fe", AXES)
    return traits.dispersion(present, sums, "site", "fe", without)


_DISPERSION = f"""{_POINTS.replace('WITH ', '')},
present AS (SELECT DISTINCT l_suppkey AS site, {_FE} AS fe FROM lineitem
  JOIN taxa ON taxon = l_partkey WHERE taxon_group <> '{ABIOTIC}'),
disp AS (SELECT site, avg({_D4}) AS avg_dist, stddev_samp({_D4}) AS sd_dist,
  stddev_samp({_D4}) / sqrt(count(*)) AS se_dist
  FROM present p JOIN points a ON a.fe = p.fe, points b GROUP BY site),
dev AS (SELECT *, avg(avg_dist) OVER () AS comm_mean,
  avg_dist - avg(avg_dist) OVER () AS dev_from_mean FROM disp)"""


@query(
    "dispersion",
    f"""WITH {_DISPERSION}
SELECT site, round(avg_dist, 6) AS avg_dist, round(sd_dist, 6) AS sd_dist,
  round(se_dist, 6) AS se_dist, round(comm_mean, 6) AS comm_mean,
  round(dev_from_mean, 6) + 0.0 AS dev_from_mean FROM dev""",
)
def dispersion(spark, sf):
    """Spread of a site's entities in trait space and its deviation from the community mean."""
    return rounded(_dispersion(spark, sf))


@query(
    "dispersion_without_site",
    f"""WITH {_DISPERSION}
SELECT site, round(avg_dist, 6) AS avg_dist, round(sd_dist, 6) AS sd_dist,
  round(avg(avg_dist) OVER (), 6) AS comm_mean,
  round(avg_dist - avg(avg_dist) OVER (), 6) + 0.0 AS dev_from_mean FROM dev WHERE site <> 7""",
)
def dispersion_without_site(spark, sf):
    """Dispersion with one site left out, also of the community mean."""
    out = _dispersion(spark, sf, F.col("site") == 7)
    return rounded(out.select("site", "avg_dist", "sd_dist", "comm_mean", "dev_from_mean"))


@query(
    "dispersion_gradient",
    f"""WITH {_DISPERSION}, {SITE_TABLE}
SELECT count(*)::DOUBLE AS n, round(regr_slope(dev_from_mean * 1000, cv_tax), 6) + 0.0 AS slope,
  round(regr_r2(dev_from_mean, cv_tax), 6) AS r2 FROM dev JOIN site_table USING (site)""",
)
def dispersion_gradient(spark, sf):
    """Deviation in dispersion regressed on the gradient."""
    table = _dispersion(spark, sf).select("site", (F.col("dev_from_mean") * 1000).alias("dev"))
    table = storage.cut_lineage(table.join(site_table(spark, sf).select("site", "cv_tax"), "site"))
    fits = regression.linear_fits(regression.fit_sums(table, ["dev"], ["cv_tax"]))
    return rounded(fits.select("n", "slope", "r2"))


@query(
    "centroid_distances",
    """WITH c AS (SELECT label, avg(embedding[1]::DOUBLE) AS x, avg(embedding[2]::DOUBLE) AS y,
  avg(embedding[3]::DOUBLE) AS z FROM embeddings GROUP BY label)
SELECT a.label AS site_a, b.label AS site_b,
  round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)), 8) AS distance
FROM c a JOIN c b ON a.label < b.label""",
)
def centroid_distances(spark, sf):
    """Euclidean distance of all pairs of group centroids."""
    c = F.col
    at = lambda i: F.avg(c("embedding")[i].cast("double"))
    centres = parquet(spark, sf, "embeddings").groupBy("label").agg(
        at(0).alias("x"), at(1).alias("y"), at(2).alias("z")
    )
    pairs = ordination.all_pairs(centres, "label")
    return rounded(ordination.pair_distances(pairs, centres, "label", ["x", "y", "z"]), 8)


def _vectors(spark, sf, size):
    c = F.col
    return parquet(spark, sf, "embeddings").select(
        "label", "vec_id", *[c("embedding")[i].cast("double").alias(f"pc{i + 1}") for i in range(size)]
    )


_PLANE = """p AS (SELECT DISTINCT label, round(embedding[1]::DOUBLE, 12) AS x,
  round(embedding[2]::DOUBLE, 12) AS y FROM embeddings),
edges AS (
  SELECT a.label, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM p a JOIN p b
  ON a.label = b.label AND (a.x, a.y) <> (b.x, b.y)
  WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.label = a.label
    AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < -1e-15))"""


@query(
    "hull_rings",
    f"""WITH {_PLANE}
SELECT DISTINCT label, round(x1, 9) AS pc1, round(y1, 9) AS pc2 FROM edges""",
)
def hull_rings(spark, sf):
    """Vertices of every group's 2-D hull."""
    rings = hulls.hull_rings(_vectors(spark, sf, 2), "label", "pc1", "pc2")
    return rounded(rings.drop("seq"), 9)


@query(
    "hull_areas",
    f"""WITH {_PLANE}
SELECT label, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 9) AS area FROM edges GROUP BY label""",
)
def hull_areas(spark, sf):
    """Area of every group's 2-D hull, from its ring."""
    rings = hulls.hull_rings(_vectors(spark, sf, 2), "label", "pc1", "pc2")
    return rounded(hulls.ring_areas(rings, "label", "pc1", "pc2"), 9)


@query(
    "hull_share_plane",
    f"""WITH {_PLANE},
q AS (SELECT DISTINCT x, y FROM p),
all_edges AS (
  SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
  FROM (SELECT DISTINCT x1 AS x, y1 AS y FROM edges) a
  JOIN (SELECT DISTINCT x1 AS x, y1 AS y FROM edges) b ON (a.x, a.y) <> (b.x, b.y)
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT x1 AS x, y1 AS y FROM edges) c
    WHERE (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < -1e-15)),
t AS (SELECT abs(sum(x1 * y2 - x2 * y1)) / 2 AS total FROM all_edges)
SELECT label, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 9) AS volume,
  round(abs(sum(x1 * y2 - x2 * y1)) / 2 / any_value(total) * 100, 6) AS percent
FROM edges, t GROUP BY label""",
)
def hull_share_plane(spark, sf):
    """Hull volume in two dimensions and its share of the hull of all groups."""
    out = hulls.hull_volumes(_vectors(spark, sf, 2), "label", ["pc1", "pc2"])
    return out.select("label", F.round("volume", 9).alias("volume"), F.round("percent", 6).alias("percent"))


@query("hull_volumes")
def hull_volumes(spark, sf):
    """Functional volume of every group in four dimensions, as a share of the pool's."""
    return rounded(hulls.hull_volumes(_vectors(spark, sf, 4), "label", AXES), 9)


@query(
    "entity_points",
    f"""WITH {_POINTS}, {COVER.split('taxa AS')[0].rstrip().rstrip(',')},
s AS (SELECT site, {_FE} AS fe, sum(cnt) AS n FROM counts JOIN taxa USING (taxon)
  WHERE taxon_group <> '{ABIOTIC}' GROUP BY ALL)
SELECT site, fe, n AS count, round(pc1, 6) AS pc1, round(pc2, 6) AS pc2 FROM s JOIN points USING (fe)""",
)
def entity_points(spark, sf):
    """Entities in trait space beside their count at every site."""
    sums = diversity.entity_cover(
        cover_counts(spark, sf).select("site", "taxon", "count"), _taxa_entities(spark, sf),
        "site", "taxon", "count",
    )
    points = _entity_points(spark, sf).select("fe", "pc1", "pc2")
    return rounded(sums.join(points, "fe").select("site", "fe", "count", "pc1", "pc2"))


@query(
    "entities_by_trait",
    f"""WITH {_POINTS},
g AS (SELECT unnest(['Phyla', 'Morphology', 'Trophic Group']) AS trait_group)
SELECT fe, round(pc1, 6) AS pc1, round(pc2, 6) AS pc2, trait_group, CASE trait_group
  WHEN 'Phyla' THEN taxon_group WHEN 'Morphology' THEN morph ELSE energy END AS trait
FROM points, g""",
)
def entities_by_trait(spark, sf):
    """Entities in trait space, one row per trait group with the trait named."""
    points = _entity_points(spark, sf).select("fe", "pc1", "pc2")
    return rounded(reshape.split_key(points, "fe", ",", ["Phyla", "Morphology", "Trophic Group"]))


# c lies to the right of a -> b, or on it between the two: then a -> b is no edge of the ring
_CROSS = "((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x))"
_ALONG = "((b.x - a.x) * (c.x - a.x) + (b.y - a.y) * (c.y - a.y))"
_NOT_AN_EDGE = f"""({_CROSS} < -1e-15 OR (abs({_CROSS}) <= 1e-15 AND {_ALONG} > 1e-15
  AND {_ALONG} < pow(b.x - a.x, 2) + pow(b.y - a.y, 2) - 1e-15))"""


@query(
    "diversity_table",
    f"""WITH {_POINTS},
seen AS (SELECT DISTINCT l_suppkey AS site, l_partkey AS taxon, {_FE} AS fe
  FROM lineitem JOIN taxa ON taxon = l_partkey
  WHERE taxon_group <> '{ABIOTIC}'),
p AS (SELECT DISTINCT site, round(pc1, 12) AS x, round(pc2, 12) AS y FROM seen JOIN points USING (fe)),
edges AS (
  SELECT a.site, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM p a JOIN p b
  ON a.site = b.site AND (a.x, a.y) <> (b.x, b.y)
  WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.site = a.site AND {_NOT_AN_EDGE})),
areas AS (SELECT site, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area FROM edges GROUP BY site),
q AS (SELECT DISTINCT x1 AS x, y1 AS y FROM edges),
pool_edges AS (
  SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM q a JOIN q b ON (a.x, a.y) <> (b.x, b.y)
  WHERE NOT EXISTS (SELECT 1 FROM q c WHERE {_NOT_AN_EDGE})),
pool AS (SELECT abs(sum(x1 * y2 - x2 * y1)) / 2 AS area FROM pool_edges),
d AS (
  SELECT site, count(DISTINCT taxon) AS nb_sp,
    count(DISTINCT taxon) / (SELECT count(DISTINCT taxon) FROM seen) * 100 AS nb_sp_p,
    count(DISTINCT fe) AS nb_fes,
    count(DISTINCT fe) / (SELECT count(DISTINCT fe) FROM seen) * 100 AS nb_fes_p
  FROM seen GROUP BY site),
t AS (SELECT d.*, areas.area / pool.area * 100 AS vol, s_acctbal AS c
  FROM d JOIN areas USING (site) JOIN supplier ON site = s_suppkey, pool)
SELECT site, nb_sp, round(nb_sp_p, 6) AS nb_sp_p, nb_fes, round(nb_fes_p, 6) AS nb_fes_p,
  round(vol, 6) AS vol, """
    + ", ".join(
        f"round({y} - regr_intercept({y}, c) OVER () - regr_slope({y}, c) OVER () * c, 6) + 0.0 AS {r}"
        for y, r in (("nb_sp", "res_sp"), ("nb_sp_p", "res_spp"), ("nb_fes", "res_fe"),
                     ("nb_fes_p", "res_fep"), ("vol", "res_vol"))
    )
    + " FROM t",
)
def diversity_table(spark, sf):
    """The whole diversity table: richness, entities, hull share, and residuals on complexity."""
    c = F.col
    found = parquet(spark, sf, "lineitem").select(
        c("l_suppkey").alias("site"), c("l_partkey").alias("taxon")
    )
    present = found.distinct().join(_taxa_entities(spark, sf).select("taxon", "fe"), "taxon")
    present = storage.cut_lineage(present)
    by_taxon = diversity.richness(present, "site", "taxon", "nb_sp", "nb_sp_p")
    by_entity = diversity.richness(present, "site", "fe", "nb_fes", "nb_fes_p")
    points = present.select("site", "fe").distinct().join(_entity_points(spark, sf), "fe")
    share = hulls.hull_volumes(points, "site", ["pc1", "pc2"]).select("site", c("percent").alias("vol"))
    sites = parquet(spark, sf, "supplier").select(c("s_suppkey").alias("site"), "s_acctbal")
    table = by_taxon.join(by_entity, "site").join(share, "site").join(sites, "site")
    names = {"nb_sp": "res_sp", "nb_sp_p": "res_spp", "nb_fes": "res_fe", "nb_fes_p": "res_fep",
             "vol": "res_vol"}
    out = regression.with_residuals(storage.cut_lineage(table), names, "s_acctbal")
    return rounded(out.drop("s_acctbal"))


def _region_cover(spark, sf):
    """Counts by nation and taxon: sites rolled up before any pair of nations is compared.

    Stored, because standardisation and pair sums read it several times.
    """
    nations = parquet(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("site"), F.col("s_nationkey").alias("nation")
    )
    counts = cover_counts(spark, sf).select("site", "taxon", "count").join(nations, "site")
    return storage.cut_lineage(counts.groupBy("nation", "taxon").agg(F.sum("count").alias("count")))


_REGION_COVER = f"""{COVER},
rc AS (SELECT s_nationkey AS nation, taxon, sum(cnt) AS v FROM cover_counts
  JOIN supplier ON site = s_suppkey GROUP BY ALL)"""


@query(
    "standardised_cover",
    f"""WITH {_REGION_COVER},
a AS (SELECT nation, taxon, sqrt(v) / max(sqrt(v)) OVER (PARTITION BY taxon) AS v FROM rc WHERE v > 0)
SELECT nation, taxon, round(v / sum(v) OVER (PARTITION BY nation), 9) AS count FROM a""",
)
def standardised_cover(spark, sf):
    """Square root, taxon maximum and site total standardisation."""
    return rounded(ordination.standardise(_region_cover(spark, sf), "nation", "taxon", "count"), 9)


@query(
    "bray_curtis",
    f"""WITH {_REGION_COVER},
t AS (SELECT nation, sum(v) AS total FROM rc GROUP BY nation),
s AS (SELECT a.nation AS site_a, b.nation AS site_b, sum(least(a.v, b.v)) AS shared
  FROM rc a JOIN rc b ON a.taxon = b.taxon AND a.nation < b.nation GROUP BY ALL)
SELECT ta.nation AS site_a, tb.nation AS site_b,
  round(1 - 2 * coalesce(shared, 0) / (ta.total + tb.total), 9) AS dissimilarity
FROM t ta JOIN t tb ON ta.nation < tb.nation
  LEFT JOIN s ON site_a = ta.nation AND site_b = tb.nation""",
)
def bray_curtis(spark, sf):
    """Bray-Curtis dissimilarity of the survey's nations from their shared taxa."""
    return rounded(ordination.bray_curtis(_region_cover(spark, sf), "nation", "taxon", "count"), 9)


def _ordination(cover):
    scaled = ordination.standardise(cover, "nation", "taxon", "count")
    pairs = storage.cut_lineage(ordination.bray_curtis(scaled, "nation", "taxon", "count"))
    sites = cover.select("nation").distinct()
    return pairs, ordination.principal_axes(sites, "nation", pairs, "dissimilarity")


def _squared(name: str, times: int = 15) -> str:
    """CTEs that square the matrix (i, j, b) ``name`` again and again; ``name_top`` is its first axis.

    A high power of a matrix is its dominant root's projection; the column with the largest diagonal
    is that root's axis. Values are scaled to norm 1 at every step.
    """
    steps = [f"{name}_0 AS MATERIALIZED (SELECT i, j, b / (SELECT sqrt(sum(b * b)) FROM {name}) AS b FROM {name})"]
    for t in range(times):
        steps.append(
            f"{name}_p{t} AS MATERIALIZED (SELECT x.i, y.j, sum(x.b * y.b) AS b FROM {name}_{t} x "
            f"JOIN {name}_{t} y ON x.j = y.i GROUP BY ALL)"
        )
        steps.append(
            f"{name}_{t + 1} AS MATERIALIZED (SELECT i, j, b / (SELECT sqrt(sum(b * b)) FROM {name}_p{t}) AS b "
            f"FROM {name}_p{t})"
        )
    last = f"{name}_{times}"
    steps.append(
        f"{name}_v AS MATERIALIZED (SELECT i, b / sqrt(sum(b * b) OVER ()) AS v FROM {last} "
        f"WHERE j = (SELECT arg_max(i, b) FROM {last} WHERE i = j))"
    )
    steps.append(
        f"{name}_root AS MATERIALIZED (SELECT sum(x.v * b * y.v) AS root FROM {name} JOIN {name}_v x USING (i) "
        f"JOIN {name}_v y ON y.i = j)"
    )
    steps.append(
        f"{name}_top AS MATERIALIZED (SELECT i, v * sqrt(greatest(root, 0)) * (SELECT sign(arg_min(v, i)) "
        f"FROM {name}_v WHERE round(abs(v), 9) = (SELECT max(round(abs(v), 9)) FROM {name}_v)) AS axis "
        f"FROM {name}_v, {name}_root)"
    )
    return ",\n".join(steps)


_ORDINATION = f"""{_REGION_COVER},
oa AS (SELECT nation, taxon, sqrt(v) / max(sqrt(v)) OVER (PARTITION BY taxon) AS v FROM rc WHERE v > 0),
ob AS MATERIALIZED (SELECT nation, taxon, v / sum(v) OVER (PARTITION BY nation) AS v FROM oa),
ot AS (SELECT nation, sum(v) AS total FROM ob GROUP BY nation),
os AS (SELECT a.nation AS i, b.nation AS j, sum(least(a.v, b.v)) AS shared
  FROM ob a JOIN ob b ON a.taxon = b.taxon GROUP BY ALL),
od AS MATERIALIZED (SELECT a.nation AS i, b.nation AS j, CASE WHEN a.nation = b.nation THEN 0.0::DOUBLE
  ELSE 1 - 2 * coalesce(shared, 0) / (a.total + b.total) END AS d
  FROM ot a CROSS JOIN ot b LEFT JOIN os ON i = a.nation AND j = b.nation),
om AS (SELECT i, avg(d * d) AS m FROM od GROUP BY i),
one AS MATERIALIZED (SELECT od.i, od.j, -0.5 * (d * d - x.m - y.m + (SELECT avg(d * d) FROM od)) AS b
  FROM od JOIN om x ON x.i = od.i JOIN om y ON y.i = od.j),
{_squared("one")},
two AS MATERIALIZED (SELECT one.i, one.j, one.b - root * x.v * y.v AS b
  FROM one JOIN one_v x ON x.i = one.i JOIN one_v y ON y.i = one.j, one_root),
{_squared("two")},
axes AS MATERIALIZED (SELECT i AS nation, a.axis AS axis1, b.axis AS axis2
  FROM one_top a JOIN two_top b USING (i))"""


@query(
    "site_ordination",
    f"""WITH {_ORDINATION}, {REGIONS}
SELECT nation, round(axis1, 6) + 0.0 AS axis1, round(axis2, 6) + 0.0 AS axis2,
  round(price_cv, 6) AS price_cv, round(tax_cv, 6) AS tax_cv
FROM axes LEFT JOIN regions USING (nation)""",
)
def site_ordination(spark, sf):
    """Nations on two ordination axes, with their environment."""
    _, scores = _ordination(_region_cover(spark, sf))
    table = ordination.scores_with(
        scores, regions(spark, sf), "nation", {"price_cv": "price_cv", "tax_cv": "tax_cv"}
    )
    return rounded(table)


@query(
    "ordination_stress",
    f"""WITH {_ORDINATION},
pp AS (SELECT d AS x, sqrt(pow(a.axis1 - b.axis1, 2) + pow(a.axis2 - b.axis2, 2)) AS y
  FROM od JOIN axes a ON a.nation = i JOIN axes b ON b.nation = j WHERE i < j),
pk AS MATERIALIZED (SELECT row_number() OVER (ORDER BY x) AS k, x, n, sum(s) OVER (ORDER BY x) AS cs,
  sum(n) OVER (ORDER BY x) AS cn, s FROM (SELECT x, count(*) AS n, sum(y) AS s FROM pp GROUP BY x)),
pm AS MATERIALIZED (SELECT a.k AS a, b.k AS b, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS m
  FROM pk a JOIN pk b ON a.k <= b.k),
pl AS MATERIALIZED (SELECT i.k, m.a, min(m.m) AS low FROM pk i JOIN pm m ON m.a <= i.k AND m.b >= i.k
  GROUP BY ALL),
pf AS (SELECT k, max(low) AS fitted FROM pl GROUP BY k)
SELECT round(sqrt(sum(pow(y - fitted, 2)) / sum(y * y)), 6) AS stress
FROM pp JOIN pk USING (x) JOIN pf USING (k)""",
)
def ordination_stress(spark, sf):
    """Stress of the two-axis ordination against a monotone fit."""
    pairs, scores = _ordination(_region_cover(spark, sf))
    both = ordination.pair_distances(pairs, scores, "nation", ["axis1", "axis2"])
    return rounded(ordination.stress(ordination.shepard_fit(both, "dissimilarity", "distance"), "distance"))


@query(
    "taxon_scores",
    f"""WITH {_REGION_COVER}, {REGIONS}
SELECT taxon, round(sum(v * lon) / sum(v), 6) + 0.0 AS lon, round(sum(v * lat) / sum(v), 6) AS lat
FROM rc JOIN regions USING (nation) GROUP BY taxon""",
)
def taxon_scores(spark, sf):
    """Abundance-weighted mean of site scores per taxon."""
    cover = _region_cover(spark, sf)
    scores = regions(spark, sf).select("nation", "lon", "lat")
    return rounded(ordination.taxon_scores(cover, scores, "nation", "taxon", "count", ["lon", "lat"]))


@query(
    "taxon_score_table",
    f"""WITH {_ORDINATION},
sc AS (SELECT taxon, sum(v * axis1) / sum(v) AS axis1, sum(v * axis2) / sum(v) AS axis2
  FROM rc JOIN axes USING (nation) GROUP BY taxon)
SELECT taxon, round(axis1, 6) + 0.0 AS axis1, round(axis2, 6) + 0.0 AS axis2,
  substr(taxon_name, 1, 1) || '.' || split_part(taxon_name, ' ', 2) AS name, taxon_group, morph,
  {_BROAD} AS broad FROM sc JOIN taxa USING (taxon)""",
)
def taxon_score_table(spark, sf):
    """Taxa on the ordination's axes, with their short name, traits and broad group."""
    cover = _region_cover(spark, sf)
    _, scores = _ordination(cover)
    axes = ["axis1", "axis2"]
    placed = ordination.taxon_scores(cover, scores, "nation", "taxon", "count", axes)
    details = taxa(spark, sf).withColumns({"short": short_name("taxon_name"), "broad": _broad()})
    shown = {"short": "name", "taxon_group": "taxon_group", "morph": "morph", "broad": "broad"}
    return rounded(ordination.scores_with(placed, details, "taxon", shown))


_FITTED = ["quantity_cv", "price_cv", "tax_cv"]


@query(
    "vector_fit",
    f"""WITH RECURSIVE {REGIONS},
long AS (
  SELECT nation AS site, lon - avg(lon) OVER () AS a1, lat - avg(lat) OVER () AS a2,
    unnest(['quantity_cv', 'price_cv', 'tax_cv']) AS parameter,
    unnest([quantity_cv, price_cv, tax_cv]) AS z FROM regions),
c AS (SELECT site, parameter, z,
  a1 - avg(a1) OVER (PARTITION BY parameter) AS a1, a2 - avg(a2) OVER (PARTITION BY parameter) AS a2,
  row_number() OVER (PARTITION BY parameter ORDER BY site) - 1 AS k, count(*) OVER (PARTITION BY parameter) AS n
  FROM long WHERE z IS NOT NULL),
keys AS (SELECT perm, r, ('0x' || h[1:14])::BIGINT AS kk, ('0x' || h[15:20])::BIGINT AS ka,
  ('0x' || h[21:26])::BIGINT AS kb, ('0x' || h[27:32])::BIGINT AS kc
  FROM (SELECT perm, r, md5('1:' || perm || ':' || r) AS h FROM range(1, 1000) p(perm), range(1, 41) q(r))),
walk AS (SELECT DISTINCT n, perm, k::BIGINT AS k, k::BIGINT AS x, 0 AS r FROM c, range(1, 1000) p(perm)
  UNION ALL SELECT n, perm, k, CASE WHEN (((line * line + kc) % 2147483647) >> 16) % 2 = 1 THEN y ELSE x END, r + 1
  FROM (SELECT n, perm, k, x, y, r, kc, (greatest(x, y) * (ka + 1) + kb) % 2147483647 AS line
    FROM (SELECT w.*, ka, kb, kc, (((kk - x) % n) + n) % n AS y
      FROM walk w JOIN keys ON keys.perm = w.perm AND keys.r = w.r + 1 WHERE w.r < 40))),
d AS (SELECT c.parameter, walk.perm, c.z, walk.k FROM c
  JOIN walk ON walk.n = c.n AND walk.x = c.k AND walk.r = 40),
e AS (SELECT parameter, 0 AS perm, a1, a2, z FROM c
  UNION ALL SELECT d.parameter, d.perm, c.a1, c.a2, d.z FROM d JOIN c ON c.parameter = d.parameter AND c.k = d.k),
s AS (SELECT parameter, perm, sum(a1 * a1) AS u11, sum(a1 * a2) AS u12, sum(a2 * a2) AS u22,
  sum(a1 * z) AS s1, sum(a2 * z) AS s2, var_pop(z) * count(*) AS szz FROM e GROUP BY ALL),
f AS (SELECT *, (s1 * u22 - s2 * u12) / (u11 * u22 - u12 * u12) AS b1,
  (s2 * u11 - s1 * u12) / (u11 * u22 - u12 * u12) AS b2 FROM s),
r AS (SELECT *, (b1 * s1 + b2 * s2) / szz AS r2 FROM f),
h AS (SELECT a.parameter, a.b1, a.b2, a.r2, (1 + count(*) FILTER (t.r2 >= a.r2 - 1e-12)) / 1000 AS p
  FROM r a JOIN r t ON t.parameter = a.parameter AND t.perm > 0 WHERE a.perm = 0 GROUP BY ALL)
SELECT parameter, round(b1 / sqrt(b1 * b1 + b2 * b2), 6) + 0.0 AS axis1,
  round(b2 / sqrt(b1 * b1 + b2 * b2), 6) + 0.0 AS axis2, round(r2, 6) AS r2, round(p, 6) AS p,
  round(b1 / sqrt(b1 * b1 + b2 * b2) * sqrt(r2), 6) + 0.0 AS arrow1,
  round(b2 / sqrt(b1 * b1 + b2 * b2) * sqrt(r2), 6) + 0.0 AS arrow2
FROM h""",
)
def vector_fit(spark, sf):
    """Environmental vectors on two axes, with permutation p-values and arrow coordinates."""
    return rounded(ordination.vector_fit(regions(spark, sf), "nation", ("lon", "lat"), _FITTED))


@query("trend_surface")
def trend_surface(spark, sf):
    """Quadratic surface of each parameter over the plane of the sites, on a grid."""
    surfaces = ordination.trend_surface(regions(spark, sf), "lon", "lat", _FITTED)
    return rounded(ordination.surface_grid(surfaces, 31))


@query(
    "nudged_sites",
    f"""WITH {REGIONS}
SELECT nation, round(lon, 6) AS lon, round(lat + CASE nation WHEN 3 THEN -0.00003
  WHEN 8 THEN -0.00002 ELSE 0 END, 6) AS lat FROM regions""",
)
def nudged_sites(spark, sf):
    """Coordinates of listed sites shifted."""
    sites = regions(spark, sf).select("nation", "lon", "lat")
    return rounded(spatial.nudge(sites, "nation", "lat", {3: -0.00003, 8: -0.00002}))


@query(
    "distance_order",
    f"""WITH {REGIONS},
h AS (SELECT lon AS lon0, lat AS lat0 FROM regions WHERE nation = (SELECT min(nation) FROM regions)),
d AS (SELECT nation, 2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(lat - lat0) / 2), 2)
  + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2)))) AS d
  FROM regions, h)
SELECT nation, round(d, 3) AS distance_m, dense_rank() OVER (ORDER BY d) AS ord FROM d""",
)
def distance_order(spark, sf):
    """Great-circle distance from one site, and the order of sites it gives."""
    sites = regions(spark, sf).select("nation", "lon", "lat")
    origin = sites.agg(F.min("nation")).scalar()
    out = spatial.seep_order(sites, "nation", "lon", "lat", origin)
    return rounded(out.select("nation", "distance_m", "ord"), 3)


@query(
    "points_in_polygon",
    """WITH ring AS (SELECT unnest([0.0, 0.25, 0.1, 0.0, -0.1, -0.25]) AS x1,
  unnest([0.3, 0.1, -0.2, -0.05, -0.2, 0.1]) AS y1,
  unnest([0.25, 0.1, 0.0, -0.1, -0.25, 0.0]) AS x2, unnest([0.1, -0.2, -0.05, -0.2, 0.1, 0.3]) AS y2),
v AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
SELECT vec_id, label FROM v WHERE (SELECT count(*) FROM ring
  WHERE (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)) % 2 = 1""",
)
def points_in_polygon(spark, sf):
    """All points clipped to one polygon."""
    corners = [(0.0, 0.3), (0.25, 0.1), (0.1, -0.2), (0.0, -0.05), (-0.1, -0.2), (-0.25, 0.1)]
    rows = [("study area", i, x, y) for i, (x, y) in enumerate(corners)]
    vertices = spark.createDataFrame(rows, "poly_id string, seq int, lon double, lat double")
    rings = spatial.polygon_rings(vertices, "poly_id", "lon", "lat")
    return spatial.clip(_vectors(spark, sf, 2), rings, "pc1", "pc2").select("vec_id", "label")


@query(
    "points_in_group_hull",
    """WITH v AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
b AS (SELECT label, min(x) AS x_lo, max(x) AS x_hi, min(y) AS y_lo, max(y) AS y_hi FROM v GROUP BY label)
SELECT v.label, count(*) AS n FROM v JOIN b ON v.label = b.label
WHERE x >= (x_lo + x_hi) / 2 AND x < x_hi AND y >= (y_lo + y_hi) / 2 AND y < y_hi GROUP BY v.label""",
)
def points_in_group_hull(spark, sf):
    """Points clipped to their own group's polygon: the upper right quarter of its extent."""
    c = F.col
    points = _vectors(spark, sf, 2)
    box = points.groupBy("label").agg(
        F.min("pc1").alias("xl"), F.max("pc1").alias("xh"), F.min("pc2").alias("yl"), F.max("pc2").alias("yh")
    )
    mx, my = (c("xl") + c("xh")) / 2, (c("yl") + c("yh")) / 2
    corner = lambda i, x, y: F.struct(F.lit(i).alias("seq"), x.alias("lon"), y.alias("lat"))
    corners = [corner(0, mx, my), corner(1, c("xh"), my), corner(2, c("xh"), c("yh")), corner(3, mx, c("yh"))]
    rings = spatial.polygon_rings(box.select("label", F.inline(F.array(*corners))), "label", "lon", "lat")
    inside = spatial.clip(points, rings, "pc1", "pc2", on="label")
    return inside.groupBy("label").agg(F.count("*").alias("n"))


@query(
    "kml_polygons",
    f"""WITH {_PLANE},
v AS (SELECT DISTINCT label, x1, y1 FROM edges)
SELECT 'area ' || label AS poly_id, count(*) AS n_vertices, round(min(x1), 9) AS west,
  round(max(y1), 9) AS north FROM v GROUP BY label""",
)
def kml_polygons(spark, sf):
    """Hull rings written as KML placemarks to the shared folder and read back as vertices."""
    rings = hulls.hull_rings(_vectors(spark, sf, 2), "label", "pc1", "pc2")
    corner = F.struct("seq", F.concat_ws(",", "pc1", "pc2", F.lit("0")).alias("at"))
    packed = rings.groupBy("label").agg(F.array_sort(F.collect_list(corner)).alias("ring"))
    path = storage.new_path(spark, "areas-kml")
    names = F.concat(F.lit("area "), F.col("label").cast("string"))
    write_polygons(packed.select(names.alias("name"), F.array_join("ring.at", " ").alias("corners")), path)
    vertices = read_polygons(spark, path)
    return rounded(vertices.groupBy("poly_id").agg(
        F.count("*").alias("n_vertices"), F.min("lon").alias("west"), F.max("lat").alias("north")
    ), 9)


def _grid_box(spark, sf):
    places = parquet(spark, sf, "customer").groupBy(
        F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")
    ).agg(F.avg("c_acctbal").alias("lon"), F.stddev_samp("c_acctbal").alias("lat"))
    return places


@query(
    "prediction_grid",
    """WITH p AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, avg(c_acctbal) AS lon,
  stddev_samp(c_acctbal) AS lat FROM customer GROUP BY ALL),
b AS (SELECT nation, min(lon) AS xl, min(lat) AS yl, max(lat) AS yh, (max(lon) - min(lon)) / 20 AS cell
  FROM p GROUP BY nation),
i AS (SELECT *, unnest(range(0, 21)) AS i FROM b),
j AS (SELECT *, unnest(range(0, floor((yh - yl) / cell + 1e-9)::BIGINT + 1)) AS j FROM i)
SELECT nation, round(xl + i * cell, 7) AS x, round(yl + j * cell, 7) AS y FROM j""",
)
def prediction_grid(spark, sf):
    """Even grid over the bounding box of every location's sites."""
    return rounded(spatial.prediction_grid(_grid_box(spark, sf), ["nation"], "lon", "lat", 20), 7)


def _long_regions(spark, sf):
    rows = [
        F.struct(F.lit(p).alias("parameter"), F.col(f"{p}_cv").alias("z")) for p in PARAMETERS
    ]
    return regions(spark, sf).select("nation", "lon", "lat", F.inline(F.array(*rows)))


@query(
    "variogram",
    f"""WITH {REGIONS},
long AS (FROM (SELECT nation, lon, lat, quantity_cv AS quantity, price_cv AS price,
  discount_cv AS discount, tax_cv AS tax FROM regions)
  UNPIVOT (z FOR parameter IN (quantity, price, discount, tax))),
b AS (SELECT parameter, sqrt(pow(max(lon) - min(lon), 2) + pow(max(lat) - min(lat), 2)) / 3 AS reach
  FROM long GROUP BY parameter),
d AS (SELECT a.parameter, sqrt(pow(a.lon - c.lon, 2) + pow(a.lat - c.lat, 2)) AS d,
  pow(a.z - c.z, 2) / 2 AS g, reach
  FROM long a JOIN long c ON a.parameter = c.parameter AND a.nation < c.nation
  JOIN b ON b.parameter = a.parameter)
SELECT parameter, least(floor(d / (reach / 3)), 2)::INTEGER AS lag, count(*) AS n_pairs,
  round(avg(d), 6) AS distance, round(avg(g), 6) AS gamma
FROM d WHERE d <= reach AND d > 0 GROUP BY ALL""",
)
def variogram(spark, sf):
    """Empirical semivariogram of every parameter over the survey's sites, three lags."""
    return rounded(
        spatial.variogram(_long_regions(spark, sf), ["parameter"], "nation", "lon", "lat", "z")
    )


def _krige(spark, sf, grid):
    samples = _long_regions(spark, sf)
    keys = ["parameter"]
    empirical = spatial.variogram(samples, keys, "nation", "lon", "lat", "z")
    model = spatial.variogram_model(empirical, keys)
    weights = spatial.krige_weights(samples, keys, "lon", "lat", "z", model)
    return spatial.krige(grid(samples), weights, model, keys)


@query(
    "krige_at_samples",
    f"""WITH {REGIONS}
FROM (SELECT round(lon, 6) AS x, round(lat, 6) AS y, round(quantity_cv, 6) AS quantity,
  round(price_cv, 6) AS price, round(discount_cv, 6) AS discount, round(tax_cv, 6) AS tax FROM regions)
UNPIVOT (pred FOR parameter IN (quantity, price, discount, tax))""",
)
def krige_at_samples(spark, sf):
    """Kriged at the sample positions, where it must return the samples."""
    at = lambda s: s.select("parameter", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return rounded(_krige(spark, sf, at))


@query("krige_surface")
def krige_surface(spark, sf):
    """Kriged surface of every parameter on a grid over the sites."""
    grid = lambda s: spatial.prediction_grid(s, ["parameter"], "lon", "lat", 40)
    return rounded(_krige(spark, sf, grid))


@query("krige_status")
def krige_status(spark, sf):
    """Outcome of the solve per region and parameter: a group that cannot be solved says why."""
    nation = parquet(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), "n_regionkey")
    samples = _long_regions(spark, sf).join(nation, "nation")
    keys = ["n_regionkey", "parameter"]
    empirical = spatial.variogram(samples, keys, "nation", "lon", "lat", "z")
    model = spatial.variogram_model(empirical, keys)
    weights = spatial.krige_weights(samples, keys, "lon", "lat", "z", model)
    return weights.select(*keys, "status", F.size(F.coalesce("nodes", F.array())).alias("n_nodes"))
