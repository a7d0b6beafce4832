"""Cover, richness, functional entities and site descriptors from long count tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecocline.functions.scalar import ratio, recode, row_mean, unite
from ecocline.operators.relations import keyed_join, scenarios
from ecocline.operators.reshape import wide_to_long
from ecocline.operators.summaries import share_of_total


def relative_cover(
    counts: DataFrame, site: str, taxon: str, count: str, name: str = "cover", summed: bool = False
) -> DataFrame:
    """Percent cover ``(site, taxon, cover)``: a taxon's count over the site's total count.

    ``summed`` tells that there is one row per site and taxon already, which saves a shuffle.
    """
    if summed:
        summed = counts.select(site, taxon, F.col(count).cast("double").alias(count))
    else:
        summed = counts.groupBy(site, taxon).agg(F.sum(count).cast("double").alias(count))
    return share_of_total(summed, [site], count, name).drop(count)


def richness(
    present: DataFrame, site: str, item: str, n: str, percent: str, by: Sequence[str] = ()
) -> DataFrame:
    """Distinct items per site, and as a share (%) of all distinct items (per ``by`` group).

    The pool size is aggregated from the same distinct (site, item) rows.
    """
    pairs = present.select(*by, site, item).filter(F.col(item).isNotNull()).distinct()
    per_site = pairs.groupBy(*by, site).agg(F.count("*").alias(n))
    if by:
        pool = pairs.select(*by, item).distinct().groupBy(*by).agg(F.count("*").alias("__pool"))
        out = keyed_join(per_site, pool, by).withColumn(percent, ratio(n, "__pool") * 100)
        return out.drop("__pool")
    pool = pairs.select(item).distinct().agg(F.count("*")).scalar()
    return per_site.withColumn(percent, ratio(F.col(n), pool) * 100)


def scoped_richness(
    present: DataFrame,
    sites: DataFrame,
    scopes: Mapping[str, Column | None],
    site: str,
    taxon: str,
    entity: str,
    name: str = "scope",
) -> DataFrame:
    """Taxon and entity richness of every site within every named scope, counts and shares (%).

    A scope is a condition on the rows of ``present`` (None: all rows) with denominators of its own.
    Each row of ``sites`` has a row in each scope: a site without organisms of a scope has richness 0
    there, not a missing one. A scope that holds no taxon at all has shares that are NULL.
    """
    held = scenarios(present, scopes, name)
    held = held.select(name, site, taxon, entity).distinct()
    by_taxon = richness(held, site, taxon, "nb_sp", "__sp", [name])
    by_entity = richness(held, site, entity, "nb_fes", "__fes", [name])
    found = keyed_join(by_taxon.drop("__sp"), by_entity.drop("__fes"), [name, site], "full")
    pools = held.groupBy(name).agg(
        F.count_distinct(taxon).alias("__taxa"), F.count_distinct(entity).alias("__entities")
    )
    every = sites.withColumn(name, F.explode(F.array(*[F.lit(s) for s in scopes])))
    out = keyed_join(keyed_join(every, found, [name, site], "left"), pools, [name], "left")
    out = out.fillna(0, subset=["nb_sp", "nb_fes"])
    return out.withColumns({
        "nb_sp_p": ratio("nb_sp", "__taxa") * 100, "nb_fes_p": ratio("nb_fes", "__entities") * 100
    }).drop("__taxa", "__entities")


def functional_entities(
    traits: DataFrame, taxon: str, trait_columns: Sequence[str], name: str = "fe"
) -> DataFrame:
    """Taxa with their traits and the composite entity key ``t1,t2,...``."""
    key = unite(trait_columns, ",").alias(name)
    return traits.select(taxon, *trait_columns, key).distinct()


def classify(
    group: Column | str,
    taxon: Column | str,
    base: Mapping[str, str],
    overrides: Mapping[str, str] | None = None,
) -> Column:
    """Broad group of a taxon: by its group, unless the taxon itself is listed."""
    broad = recode(group, base, keep_other=False)
    if not overrides:
        return broad
    return F.coalesce(recode(taxon, overrides, keep_other=False), broad)


def entity_cover(cover: DataFrame, entities: DataFrame, site: str, taxon: str, value: str):
    """Cover summed by site and functional entity."""
    joined = cover.join(entities.select(taxon, "fe"), taxon, "left")
    return joined.groupBy(site, "fe").agg(F.sum(value).alias(value))


def trait_composition(
    cover: DataFrame,
    traits: DataFrame,
    site: str,
    taxon: str,
    value: str,
    trait_columns: Sequence[str],
) -> DataFrame:
    """Cover by site and trait, for all trait groups in one job.

    Cover is first summed over the trait combination, and only those sums are unpacked by trait
    group, so the rows unpacked are bounded by sites times combinations.
    """
    combos = cover.join(traits.select(taxon, *trait_columns), taxon)
    combos = combos.groupBy(site, *trait_columns).agg(F.sum(value).alias(value))
    long = wide_to_long(combos, trait_columns, "trait_group", "trait", keep=[site, value])
    return long.groupBy(site, "trait_group", "trait").agg(F.sum(value).alias(value))


def regional_share(cover: DataFrame, taxon: str, value: str, name: str = "share") -> DataFrame:
    """Each taxon's share (%) of the cover of the whole region."""
    per_taxon = cover.groupBy(taxon).agg(F.sum(value).alias(value))
    total = per_taxon.agg(F.sum(value)).scalar()
    return per_taxon.select(taxon, (F.try_divide(F.col(value), total) * 100).alias(name))


def structural_complexity(
    sites: DataFrame,
    chains: Sequence[str],
    length: float,
    site: str,
    rugosity_overrides: Mapping[object, float] | None = None,
) -> DataFrame:
    """Mean chain length over the straight length, replaced where listed, and one minus it."""
    measured = row_mean(chains) / length
    rugosity = measured
    for key, value in (rugosity_overrides or {}).items():
        rugosity = F.when(F.col(site) == key, F.lit(float(value))).otherwise(rugosity)
    return sites.withColumn("mean_rugosity", rugosity).withColumn(
        "complexity", 1 - F.col("mean_rugosity")
    )
