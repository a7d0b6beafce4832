"""Query registry and the mapping of sites, samples, taxa and traits onto the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ecocline.functions.scalar import coefficient_of_variation
from ecocline.operators.summaries import rolled_up
from ecocline.sources.storage import cut_lineage
from ecocline.sources.tables import parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with the SQL that gives the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the double columns, so that summation order does not show; no negative zero."""
    return df.select(
        *[
            (F.round(F.col(f.name), digits) + 0.0).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# A supplier is a survey site, its line items are the samples and the counted organisms, a part is
# a taxon. A zero discount stands for a reading below detection (missing).

PARAMETERS = ["quantity", "price", "discount", "tax"]


def samples(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return parquet(spark, sf, "lineitem").select(
        c("l_suppkey").alias("site"),
        c("l_returnflag").alias("tide"),
        c("l_linestatus").alias("day_night"),
        c("l_shipdate").alias("taken"),
        c("l_quantity").alias("quantity"),
        c("l_extendedprice").alias("price"),
        F.nullif(c("l_discount"), F.lit(0.0)).alias("discount"),
        c("l_tax").alias("tax"),
    )


SAMPLES = """samples AS (
  SELECT l_suppkey AS site, l_returnflag AS tide, l_linestatus AS day_night, l_shipdate AS taken,
    l_quantity AS quantity, l_extendedprice AS price, nullif(l_discount, 0) AS discount,
    l_tax AS tax
  FROM lineitem)"""


def counts(spark: SparkSession, sf: str) -> DataFrame:
    return parquet(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("site"),
        F.col("l_partkey").alias("taxon"),
        F.col("l_quantity").alias("count"),
    )


COUNTS = "counts AS (SELECT l_suppkey AS site, l_partkey AS taxon, l_quantity AS cnt FROM lineitem)"

TRAITS = ["taxon_group", "morph", "energy"]


def taxa(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as taxa with three nominal traits: type, first word of the name, and size band."""
    size = F.col("p_size")
    band = F.when(size <= 17, "Auto").when(size <= 34, "Mix").otherwise("Het")
    return parquet(spark, sf, "part").select(
        F.col("p_partkey").alias("taxon"),
        F.col("p_type").alias("taxon_group"),
        F.get(F.split("p_name", " "), F.lit(0)).alias("morph"),
        band.alias("energy"),
        F.col("p_name").alias("taxon_name"),
        size.alias("size"),
        F.col("p_retailprice").alias("price"),
    )


TAXA = """taxa AS (
  SELECT p_partkey AS taxon, p_type AS taxon_group, split_part(p_name, ' ', 1) AS morph,
    CASE WHEN p_size <= 17 THEN 'Auto' WHEN p_size <= 34 THEN 'Mix' ELSE 'Het' END AS energy,
    p_name AS taxon_name, p_size AS size, p_retailprice AS price
  FROM part)"""

ABIOTIC = "SMALL"


def cover_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts summed by site and taxon, without the abiotic group.

    Summed before the taxa are looked up: the lookup meets one row per site and taxon.
    """
    summed = counts(spark, sf).groupBy("site", "taxon").agg(F.sum("count").alias("count"))
    living = taxa(spark, sf).filter(F.col("taxon_group") != ABIOTIC)
    return summed.join(living, "taxon")


COVER = f"""{COUNTS}, {TAXA},
cover_counts AS (
  SELECT site, taxon, taxon_group, morph, energy, taxon_name, sum(cnt) AS cnt
  FROM counts JOIN taxa USING (taxon) WHERE taxon_group <> '{ABIOTIC}'
  GROUP BY ALL),
cover AS (
  SELECT *, cnt / sum(cnt) OVER (PARTITION BY site) * 100 AS cover FROM cover_counts)"""


def site_table(spark: SparkSession, sf: str) -> DataFrame:
    """One row per site: two richness-like responses and gradient parameters, from one scan."""
    stats = samples_with_taxon(spark, sf).groupBy("site").agg(
        F.count_distinct("taxon").cast("double").alias("nb_sp"),
        F.avg("quantity").alias("mean_quantity"),
        *[coefficient_of_variation(p).alias(f"cv_{p}") for p in ("price", "discount", "tax")],
    )
    dims = parquet(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("site"),
        F.col("s_nationkey").alias("nation"),
        F.col("s_acctbal").alias("complexity"),
    )
    return stats.join(dims, "site")


def stored_sites(spark: SparkSession, sf: str) -> DataFrame:
    """The site table, stored once: a fit reads its input for the means and for the sums."""
    return cut_lineage(site_table(spark, sf))


def samples_with_taxon(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return parquet(spark, sf, "lineitem").select(
        c("l_suppkey").alias("site"), c("l_partkey").alias("taxon"),
        c("l_quantity").alias("quantity"), c("l_extendedprice").alias("price"),
        F.nullif(c("l_discount"), F.lit(0.0)).alias("discount"), c("l_tax").alias("tax"),
    )


SITE_TABLE = """site_table AS (
  SELECT l_suppkey AS site, any_value(s_nationkey) AS nation, any_value(s_acctbal) AS complexity,
    count(DISTINCT l_partkey)::DOUBLE AS nb_sp, avg(l_quantity) AS mean_quantity,
    stddev_samp(l_extendedprice) / avg(l_extendedprice) * 100 AS cv_price,
    stddev_samp(nullif(l_discount, 0)) / avg(nullif(l_discount, 0)) * 100 AS cv_discount,
    stddev_samp(l_tax) / avg(l_tax) * 100 AS cv_tax
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_suppkey)"""

RESPONSES = ["nb_sp", "mean_quantity"]
PREDICTORS = ["cv_price", "cv_discount", "cv_tax", "complexity"]

SITE_PAIRS = f"""{SITE_TABLE},
xs AS (FROM site_table UNPIVOT (x FOR predictor IN (cv_price, cv_discount, cv_tax, complexity))),
pairs AS (
  SELECT site, nation, predictor, x, 'nb_sp' AS response, nb_sp AS y FROM xs
  UNION ALL SELECT site, nation, predictor, x, 'mean_quantity', mean_quantity FROM xs)"""


def regions(spark: SparkSession, sf: str) -> DataFrame:
    """The survey's fixed list of regions as sites: one row per nation.

    Means and CVs of the sample parameters come from its suppliers, the position from its
    customers. The nation list does not grow with the data, and the few rows are stored once for
    the several passes that ordination and kriging make over them.
    """
    suppliers = parquet(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("site"), F.col("s_nationkey").alias("nation")
    )
    stats = rolled_up(samples(spark, sf), "site", PARAMETERS, suppliers, ["nation"])
    place = parquet(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(
        (F.avg("c_acctbal") / 1000).alias("lon"), (F.stddev_samp("c_acctbal") / 1000).alias("lat")
    )
    return cut_lineage(stats.join(place, "nation"))


REGIONS = """regions AS (
  SELECT * FROM (
    SELECT s_nationkey AS nation,
      avg(l_quantity) AS quantity_mean, avg(l_extendedprice) AS price_mean,
      avg(nullif(l_discount, 0)) AS discount_mean, avg(l_tax) AS tax_mean,
      stddev_samp(l_quantity) / avg(l_quantity) * 100 AS quantity_cv,
      stddev_samp(l_extendedprice) / avg(l_extendedprice) * 100 AS price_cv,
      stddev_samp(nullif(l_discount, 0)) / avg(nullif(l_discount, 0)) * 100 AS discount_cv,
      stddev_samp(l_tax) / avg(l_tax) * 100 AS tax_cv
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
  JOIN (
    SELECT c_nationkey AS nation, avg(c_acctbal) / 1000 AS lon, stddev_samp(c_acctbal) / 1000 AS lat
    FROM customer GROUP BY 1) USING (nation))"""
