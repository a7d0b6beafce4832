"""Cover, richness, functional entities, composition and site descriptors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ecocline.operators import diversity, relations, reports, reshape, summaries
from ecocline.plans.registry import (
    ABIOTIC, COUNTS, COVER, SAMPLES, SITE_TABLE, TAXA, TRAITS, counts, cover_counts, query, rounded,
    samples, site_table, taxa,
)
from ecocline.functions.scalar import ratio
from ecocline.sources.tables import parquet

# the site's two groups: stony coral and fleshy macroalgae, with exclusions by name
BROAD = {"PROMO": "Coral", "ECONOMY": "Coral", "STANDARD": "Macroalgae", "MEDIUM": "Macroalgae",
         "LARGE": "Turf"}
OVERRIDES = {"red plate": "Other cnidaria", "hot ring": "CCA"}

_BROAD = """CASE taxon_name WHEN 'red plate' THEN 'Other cnidaria' WHEN 'hot ring' THEN 'CCA' ELSE
  CASE taxon_group WHEN 'PROMO' THEN 'Coral' WHEN 'ECONOMY' THEN 'Coral'
    WHEN 'STANDARD' THEN 'Macroalgae' WHEN 'MEDIUM' THEN 'Macroalgae' WHEN 'LARGE' THEN 'Turf' END
  END"""
_FE = "taxon_group || ',' || morph || ',' || energy"


def _cover(spark, sf):
    return diversity.relative_cover(cover_counts(spark, sf), "site", "taxon", "count", summed=True)


def _entities(spark, sf):
    living = taxa(spark, sf).filter(F.col("taxon_group") != ABIOTIC)
    return diversity.functional_entities(living, "taxon", TRAITS)


def _broad():
    return diversity.classify("taxon_group", "taxon_name", BROAD, OVERRIDES)


@query("relative_cover", f"WITH {COVER} SELECT site, taxon, round(cover, 6) AS cover FROM cover")
def relative_cover(spark, sf):
    """Percent cover of every taxon at every site, abiotic groups left out."""
    return rounded(_cover(spark, sf))


@query(
    "community_wide",
    f"""WITH {COVER}, g AS (SELECT site, taxon_group, sum(cover) AS c FROM cover GROUP BY ALL)
SELECT site, """
    + ", ".join(
        f"round(coalesce(max(c) FILTER (taxon_group = '{t}'), 0), 6) AS \"{t}\""
        for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "STANDARD")
    )
    + " FROM g GROUP BY site",
)
def community_wide(spark, sf):
    """Site by group cover matrix for export, absent groups as zero."""
    groups = taxa(spark, sf).select("taxon", "taxon_group")
    cover = _cover(spark, sf).join(groups, "taxon").groupBy("site", "taxon_group")
    cover = cover.agg(F.sum("cover").alias("cover"))
    kinds = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "STANDARD"]
    return rounded(reshape.long_to_wide(cover, ["site"], "taxon_group", "cover", kinds, fill=0.0))


@query(
    "taxon_richness",
    f"""WITH {COVER}
SELECT site, count(DISTINCT taxon) AS nb_sp,
  round(count(DISTINCT taxon) / (SELECT count(DISTINCT taxon) FROM cover) * 100, 6) AS nb_sp_p
FROM cover WHERE cover > 0 GROUP BY site""",
)
def taxon_richness(spark, sf):
    """Taxa per site, and as a share of the species pool."""
    present = cover_counts(spark, sf).filter("count > 0")
    return rounded(diversity.richness(present, "site", "taxon", "nb_sp", "nb_sp_p"))


@query(
    "entity_catalogue",
    f"""WITH {COVER} SELECT DISTINCT taxon, taxon_group, morph, energy, {_FE} AS fe FROM cover""",
)
def entity_catalogue(spark, sf):
    """Counted taxa with their traits and composite functional-entity key."""
    seen = counts(spark, sf).select("taxon").distinct()
    return _entities(spark, sf).join(seen, "taxon", "left_semi")


@query(
    "entity_richness",
    f"""WITH {COVER}, f AS (SELECT DISTINCT site, {_FE} AS fe FROM cover)
SELECT site, count(*) AS nb_fes,
  round(count(*) / (SELECT count(DISTINCT fe) FROM f) * 100, 6) AS nb_fes_p FROM f GROUP BY site""",
)
def entity_richness(spark, sf):
    """Functional entities per site, and as a share of the entity pool."""
    present = cover_counts(spark, sf).select("site", "taxon").join(
        _entities(spark, sf).select("taxon", "fe"), "taxon"
    )
    return rounded(diversity.richness(present, "site", "fe", "nb_fes", "nb_fes_p"))


@query(
    "subgroup_richness",
    f"""WITH {COVER},
g AS (SELECT *, {_BROAD} AS broad, {_FE} AS fe FROM cover),
k AS (SELECT * FROM g WHERE broad IN ('Coral', 'Macroalgae')),
p AS (SELECT broad, count(DISTINCT taxon) AS np, count(DISTINCT fe) AS nf FROM k GROUP BY broad)
SELECT k.broad, site, count(DISTINCT taxon) AS nb_sp,
  round(count(DISTINCT taxon) / any_value(np) * 100, 6) AS nb_sp_p,
  count(DISTINCT fe) AS nb_fes, round(count(DISTINCT fe) / any_value(nf) * 100, 6) AS nb_fes_p
FROM k JOIN p ON k.broad = p.broad GROUP BY k.broad, site""",
)
def subgroup_richness(spark, sf):
    """Taxon and entity richness within two subgroups, one denominator per subgroup."""
    groups = cover_counts(spark, sf).withColumn("broad", _broad())
    kept = groups.filter(F.col("broad").isin("Coral", "Macroalgae"))
    kept = kept.select("broad", "site", "taxon").join(_entities(spark, sf).select("taxon", "fe"), "taxon")
    by_taxon = diversity.richness(kept, "site", "taxon", "nb_sp", "nb_sp_p", ["broad"])
    by_entity = diversity.richness(kept, "site", "fe", "nb_fes", "nb_fes_p", ["broad"])
    return rounded(by_taxon.join(by_entity, ["broad", "site"]))


@query(
    "broad_groups",
    f"""WITH {TAXA} SELECT {_BROAD} AS broad, count(*) AS n_taxa, min(taxon) AS first_taxon
FROM taxa GROUP BY 1""",
)
def broad_groups(spark, sf):
    """Taxa by broad group; listed names override their group, unlisted groups are NULL."""
    return taxa(spark, sf).groupBy(_broad().alias("broad")).agg(
        F.count("*").alias("n_taxa"), F.min("taxon").alias("first_taxon")
    )


@query(
    "entity_taxon_ratio",
    f"""WITH {COVER}
SELECT site, count(DISTINCT {_FE}) AS nb_fes, count(DISTINCT taxon) AS nb_sp,
  round(count(DISTINCT {_FE}) / count(DISTINCT taxon), 6) AS fe_sp FROM cover GROUP BY site""",
)
def entity_taxon_ratio(spark, sf):
    """Entity richness over taxon richness."""
    present = cover_counts(spark, sf).select("site", "taxon").join(
        _entities(spark, sf).select("taxon", "fe"), "taxon"
    )
    out = present.groupBy("site").agg(
        F.count_distinct("fe").alias("nb_fes"), F.count_distinct("taxon").alias("nb_sp")
    )
    return rounded(out.withColumn("fe_sp", ratio("nb_fes", "nb_sp")))


@query(
    "entity_cover",
    f"""WITH {COVER} SELECT site, {_FE} AS fe, round(sum(cover), 6) AS cover FROM cover GROUP BY ALL""",
)
def entity_cover(spark, sf):
    """Cover by site and functional entity."""
    out = diversity.entity_cover(_cover(spark, sf), _entities(spark, sf), "site", "taxon", "cover")
    return rounded(out)


@query(
    "trait_composition",
    f"""WITH {COVER},
long AS (
  SELECT site, 'taxon_group' AS trait_group, taxon_group AS trait, cover FROM cover
  UNION ALL SELECT site, 'morph', morph, cover FROM cover
  UNION ALL SELECT site, 'energy', CASE energy WHEN 'Auto' THEN 'Autotroph' WHEN 'Het'
    THEN 'Heterotroph' WHEN 'Mix' THEN 'Mixotroph' END, cover FROM cover)
SELECT site, trait_group, trait, round(sum(cover), 6) AS cover FROM long GROUP BY ALL""",
)
def trait_composition(spark, sf):
    """Cover by trait within every trait group, with full trait names."""
    named = taxa(spark, sf).withColumn("energy", reports.recode("energy", reports.ENERGY))
    out = diversity.trait_composition(_cover(spark, sf), named, "site", "taxon", "cover", TRAITS)
    return rounded(out)


@query(
    "present_taxa",
    f"""WITH {COVER}, big AS (SELECT DISTINCT taxon FROM cover WHERE cover > 1)
SELECT site, count(*) AS n FROM cover WHERE cover > 0.2 AND taxon IN (SELECT taxon FROM big)
GROUP BY site""",
)
def present_taxa(spark, sf):
    """Taxa present at a site that dominate somewhere: long-form presence and a semi join."""
    cover = _cover(spark, sf)
    big = cover.filter("cover > 1").select("taxon")
    kept = cover.filter("cover > 0.2").join(big, "taxon", "left_semi")
    return kept.groupBy("site").agg(F.count("*").alias("n"))


@query(
    "substrate_share",
    """WITH w AS (
  SELECT o_custkey AS site, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS f,
    sum(o_totalprice) FILTER (o_orderstatus = 'O') AS o,
    sum(o_totalprice) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1),
t AS (SELECT *, coalesce(f, 0) + coalesce(o, 0) + coalesce(p, 0) AS total FROM w)
SELECT site, round(f / total * 100, 6) AS f, round(o / total * 100, 6) AS o,
  round(p / total * 100, 6) AS p FROM t""",
)
def substrate_share(spark, sf):
    """Each of several columns as a percentage of their pooled total per site."""
    c = F.col
    wide = parquet(spark, sf, "orders").select(
        c("o_custkey").alias("site"),
        *[F.when(c("o_orderstatus") == s.upper(), c("o_totalprice")).alias(s) for s in "fop"],
    )
    return rounded(summaries.pooled_shares(wide, ["site"], ["f", "o", "p"]))


@query(
    "structural_complexity",
    f"""WITH {SAMPLES},
m AS (
  SELECT site, avg(quantity) FILTER (tide = 'A') AS a, avg(quantity) FILTER (tide = 'N') AS n,
    avg(quantity) FILTER (tide = 'R' AND taken < TIMESTAMP '1995-12-01') AS r
  FROM samples GROUP BY site),
r AS (SELECT site, CASE WHEN site = 7 THEN 0.97 ELSE (a + n + r) / 3 / 2.03 END AS rug FROM m)
SELECT site, round(rug, 6) AS mean_rugosity, round(1 - rug, 6) AS complexity FROM r""",
)
def structural_complexity(spark, sf):
    """Row mean of three chains over their length, one site overridden, and its complement."""
    c = F.col
    early = (c("tide") == "R") & (c("taken") < F.lit("1995-12-01").cast("timestamp_ntz"))
    chains = samples(spark, sf).groupBy("site").agg(
        F.avg(F.when(c("tide") == "A", c("quantity"))).alias("chain1"),
        F.avg(F.when(c("tide") == "N", c("quantity"))).alias("chain2"),
        F.avg(F.when(early, c("quantity"))).alias("chain3"),
    )
    names = ["chain1", "chain2", "chain3"]
    out = diversity.structural_complexity(chains, names, 2.03, "site", {7: 0.97})
    return rounded(out.select("site", "mean_rugosity", "complexity"))


@query(
    "regional_share",
    f"""WITH {COVER}, t AS (SELECT taxon, sum(cover) AS c FROM cover GROUP BY taxon)
SELECT taxon, round(c / (SELECT sum(c) FROM t) * 100, 8) AS share FROM t
WHERE taxon IN (SELECT taxon FROM taxa WHERE taxon_group = 'PROMO')""",
)
def regional_share(spark, sf):
    """Share of the whole region's cover, for the taxa of one subgroup."""
    share = diversity.regional_share(_cover(spark, sf), "taxon", "cover")
    group = taxa(spark, sf).filter("taxon_group = 'PROMO'").select("taxon")
    return rounded(share.join(group, "taxon", "left_semi"), 8)


@query(
    "analysis_table",
    f"""WITH {SITE_TABLE}, {COVER},
f AS (SELECT site, count(DISTINCT {_FE}) AS nb_fes FROM cover GROUP BY site)
SELECT site, n_name, r_name, nb_sp, nb_fes, round(cv_price, 6) AS cv_price,
  round(cv_tax, 6) AS cv_tax, complexity
FROM site_table LEFT JOIN f USING (site) JOIN nation ON nation = n_nationkey
JOIN region ON n_regionkey = r_regionkey""",
)
def analysis_table(spark, sf):
    """Star join: diversity, chemistry and metadata of every site."""
    present = cover_counts(spark, sf).select("site", "taxon").join(
        _entities(spark, sf).select("taxon", "fe"), "taxon"
    )
    entities = present.select("site", "fe").distinct().groupBy("site").agg(F.count("*").alias("nb_fes"))
    nation = parquet(spark, sf, "nation").withColumnRenamed("n_nationkey", "nation")
    region = parquet(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    out = site_table(spark, sf).join(entities, "site", "left").join(nation, "nation")
    out = out.join(region, "n_regionkey").select(
        "site", "n_name", "r_name", "nb_sp", "nb_fes", "cv_price", "cv_tax", "complexity"
    )
    return rounded(out)


@query(
    "split_entity_key",
    f"""WITH {COVER}, f AS (SELECT {_FE} AS fe, sum(cnt) AS n FROM cover GROUP BY 1)
SELECT fe, trait_group, CASE trait_group WHEN 'Phyla' THEN split_part(fe, ',', 1)
  WHEN 'Morphology' THEN split_part(fe, ',', 2) WHEN 'Trophic Group' THEN split_part(fe, ',', 3) END
  AS trait, n
FROM f, (SELECT unnest(['Phyla', 'Morphology', 'Trophic Group', 'Calcification']) AS trait_group)""",
)
def split_entity_key(spark, sf):
    """Composite keys unpacked to one row per trait group; a missing part is NULL."""
    fe = cover_counts(spark, sf).select("taxon", "count").join(
        _entities(spark, sf).select("taxon", "fe"), "taxon"
    )
    sums = fe.groupBy("fe").agg(F.sum("count").alias("n"))
    return reshape.split_key(sums, "fe", ",", ["Phyla", "Morphology", "Trophic Group", "Calcification"])


@query(
    "taxon_catalogue",
    f"""WITH {COVER},
lit AS (
  SELECT p_partkey AS taxon, split_part(p_name, ' ', 1) AS morphology,
    nullif(p_brand, 'Brand#1') AS lit_a,
    CASE WHEN p_name LIKE '%ring%' THEN 'Ringer 1995' ELSE p_name END AS lit_b,
    CASE WHEN p_size <= 17 THEN 'Autotroph' WHEN p_size <= 34 THEN 'Mixotroph' ELSE 'Heterotroph' END
    AS energetic_resource
  FROM part)
SELECT c.taxon, morphology, energetic_resource,
  coalesce(nullif(concat_ws(', ', lit_a, lit_b), ''), ' ') AS source
FROM lit RIGHT JOIN (SELECT DISTINCT taxon FROM cover) c ON lit.taxon = c.taxon""",
)
def taxon_catalogue(spark, sf):
    """Surveyed taxa with traits in full and all sources in one field, one spelling repaired."""
    c = F.col
    literature = parquet(spark, sf, "part").select(
        c("p_partkey").alias("taxon"),
        F.get(F.split("p_name", " "), F.lit(0)).alias("morphology"),
        F.nullif(c("p_brand"), F.lit("Brand#1")).alias("lit_a"),
        c("p_name").alias("lit_b"),
        F.when(c("p_size") <= 17, "Auto").when(c("p_size") <= 34, "Mix").otherwise("Het")
        .alias("energetic_resource"),
    )
    return reports.taxon_catalogue(
        literature, cover_counts(spark, sf), "taxon", ["lit_a", "lit_b"], {}, {"ring": "Ringer 1995"}
    )


@query(
    "trait_catalogue",
    f"""WITH {TAXA}
SELECT morph AS morphology, coalesce(nullif(max(taxon_group), 'STANDARD'), ' ') AS phyla,
  CASE min(energy) WHEN 'Auto' THEN 'Autotrophy (Auto)' WHEN 'Het' THEN 'Heterotrophy (Het)'
  ELSE 'Mixotrophy (Mix)' END AS trophic_group FROM taxa GROUP BY morph""",
)
def trait_catalogue(spark, sf):
    """Functional-group catalogue with blanks for missing cells and coded trophic groups."""
    names = {"Auto": "Autotrophy", "Het": "Heterotrophy", "Mix": "Mixotrophy"}
    groups = taxa(spark, sf).groupBy(F.col("morph").alias("morphology")).agg(
        F.nullif(F.max("taxon_group"), F.lit("STANDARD")).alias("phyla"),
        reports.recode(F.min("energy"), names).alias("trophic_group"),
    )
    return reports.trait_catalogue(groups)


@query(
    "scenario_copies",
    f"""WITH {COUNTS}
SELECT 'all' AS scenario, count(DISTINCT site) AS sites, sum(cnt) AS total FROM counts
UNION ALL SELECT 'without_7', count(DISTINCT site), sum(cnt) FROM counts WHERE site <> 7""",
)
def scenario_copies(spark, sf):
    """The same summary with and without one site, from one scan."""
    per_site = counts(spark, sf).groupBy("site").agg(F.sum("count").alias("count"))
    tagged = relations.scenarios(per_site, {"all": None, "without_7": F.col("site") != 7})
    return tagged.groupBy("scenario").agg(F.count("*").alias("sites"), F.sum("count").alias("total"))
