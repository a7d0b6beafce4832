"""Model selection over raw and residual responses within subgroups, its report, fits per taxon."""

from __future__ import annotations

from pyspark.sql import functions as F

from ecocline.operators import diversity, regression, reports
from ecocline.plans.community import _BROAD, _FE, _broad, _cover, _entities
from ecocline.plans.models import aicc_sql, quadratic_sql, t_p_sql
from ecocline.plans.registry import COVER, PREDICTORS, SITE_TABLE, cover_counts, query, rounded, site_table
from ecocline.sources.storage import cut_lineage

RESIDUALS = {"nb_sp": "res_sp", "nb_sp_p": "res_spp", "nb_fes": "res_fe", "nb_fes_p": "res_fep"}
SCOPES = ["All", "Coral", "Macroalgae", "Other cnidaria"]
# the scopes that have model tables, the others are for the diversity table alone
MODELLED = SCOPES[:3]
CHOSEN = ["nb_sp_p", "nb_fes_p", "res_spp", "res_fep"]

_DIVERSITY = f"""{COVER}, {SITE_TABLE},
g AS (SELECT site, taxon, {_BROAD} AS broad, {_FE} AS fe FROM cover),
held AS (SELECT 'All' AS scope, site, taxon, fe FROM g
  UNION ALL SELECT broad, site, taxon, fe FROM g WHERE broad IN ('Coral', 'Macroalgae', 'Other cnidaria')),
pool AS (SELECT scope, count(DISTINCT taxon) AS np, count(DISTINCT fe) AS nf FROM held GROUP BY scope),
found AS (SELECT scope, site, count(DISTINCT taxon) AS sp, count(DISTINCT fe) AS fe FROM held GROUP BY ALL),
every AS (SELECT site, complexity, unnest(['All', 'Coral', 'Macroalgae', 'Other cnidaria']) AS scope
  FROM site_table),
wide AS (SELECT scope, site, complexity, coalesce(sp, 0) AS nb_sp, coalesce(sp, 0) / np * 100 AS nb_sp_p,
  coalesce(fe, 0) AS nb_fes, coalesce(fe, 0) / nf * 100 AS nb_fes_p
  FROM every LEFT JOIN found USING (scope, site) LEFT JOIN pool USING (scope)),
long AS (SELECT scope, site, complexity AS x, nb_sp::DOUBLE AS y, 'nb_sp' AS response FROM wide
  UNION ALL SELECT scope, site, complexity, nb_sp_p, 'nb_sp_p' FROM wide
  UNION ALL SELECT scope, site, complexity, nb_fes::DOUBLE, 'nb_fes' FROM wide
  UNION ALL SELECT scope, site, complexity, nb_fes_p, 'nb_fes_p' FROM wide),
shape AS (WITH {quadratic_sql("long", "scope, response")} SELECT * FROM quad),
off AS (SELECT scope, site, response, y - my - c1 / sqrt(s2) * (x - mx)
  - CASE WHEN scope = 'Macroalgae' AND response IN ('nb_sp', 'nb_sp_p') THEN
    c2 / sqrt(q2) * ((x - mx) * (x - mx) - s3 / s2 * (x - mx) - s2 / n) ELSE 0 END AS r
  FROM long JOIN shape USING (scope, response)),
diversity AS (SELECT wide.*, res_sp, res_spp, res_fe, res_fep FROM wide JOIN (
  SELECT scope, site, max(r) FILTER (response = 'nb_sp') AS res_sp,
    max(r) FILTER (response = 'nb_sp_p') AS res_spp, max(r) FILTER (response = 'nb_fes') AS res_fe,
    max(r) FILTER (response = 'nb_fes_p') AS res_fep FROM off GROUP BY scope, site) USING (scope, site))"""

_RANKED = f"""{_DIVERSITY},
ys AS (FROM (SELECT scope, site, {", ".join(CHOSEN)} FROM diversity WHERE scope <> 'Other cnidaria')
  UNPIVOT (y FOR response IN ({", ".join(CHOSEN)}))),
xs AS (FROM (SELECT site, {", ".join(PREDICTORS)} FROM site_table)
  UNPIVOT (x FOR predictor IN ({", ".join(PREDICTORS)}))),
met AS (SELECT scope, response, predictor, x, y FROM ys JOIN xs USING (site)),
fits AS (WITH {quadratic_sql("met", "scope, response, predictor")} SELECT * FROM quad),
line AS (SELECT *, syy - a1 * a1 / s2 AS rss1 FROM fits),
forms AS (
  SELECT scope, response, predictor, 'Linear' AS reg_type, {aicc_sql("n", "rss1", 3)} AS aicc,
    1 - rss1 / syy AS r2, n - 2 AS df, a1 / s2 / sqrt(rss1 / (n - 2) / s2) AS t FROM line
  UNION ALL SELECT scope, response, predictor, 'Polynomial', {aicc_sql("n", "rss", 4)}, ssr / syy, n - 3,
    c2 / sqrt(rss / (n - 3)) FROM line),
ranked AS (SELECT *, {t_p_sql("t", "df")} AS p,
  aicc - min(aicc) OVER (PARTITION BY scope, response) AS del_aicc FROM forms)"""


def _scopes():
    return {s: None if s == "All" else F.col("broad") == s for s in SCOPES}


def _diversity(spark, sf):
    """Stored: the fits of the residuals and those of the models read it again."""
    sites = site_table(spark, sf).drop("nb_sp")
    present = cover_counts(spark, sf).withColumn("broad", _broad()).select("site", "taxon", "broad")
    present = present.join(_entities(spark, sf).select("taxon", "fe"), "taxon")
    table = cut_lineage(diversity.scoped_richness(present, sites, _scopes(), "site", "taxon", "fe"))
    curved = F.col("scope") == "Macroalgae"
    return regression.chosen_residuals(
        table, RESIDUALS, "complexity", {"nb_sp": curved, "nb_sp_p": curved}, ["scope"]
    )


def _models(spark, sf):
    table = cut_lineage(_diversity(spark, sf).filter(F.col("scope").isin(MODELLED)))
    return regression.model_table(table, CHOSEN, PREDICTORS, ["scope"])


@query(
    "subgroup_diversity",
    f"""WITH {_DIVERSITY}
SELECT scope, site, nb_sp, round(nb_sp_p, 6) AS nb_sp_p, nb_fes, round(nb_fes_p, 6) AS nb_fes_p,
  round(res_sp, 6) + 0.0 AS res_sp, round(res_spp, 6) + 0.0 AS res_spp, round(res_fe, 6) + 0.0 AS res_fe,
  round(res_fep, 6) + 0.0 AS res_fep FROM diversity""",
)
def subgroup_diversity(spark, sf):
    """Richness of all and of three subgroups at every site, 0 where a subgroup is absent, with residuals.

    Residuals come from lines on the complexity, those of the macroalgae's taxa from a curve.
    """
    out = _diversity(spark, sf)
    return rounded(out.select("scope", "site", "nb_sp", "nb_sp_p", "nb_fes", "nb_fes_p", *RESIDUALS.values()))


@query(
    "model_grid_residuals",
    f"""WITH {_RANKED}
SELECT scope, response, predictor, reg_type, round(aicc, 6) AS aicc, round(r2, 8) + 0.0 AS r2,
  round(p, 6) AS p, round(del_aicc, 6) AS del_aicc FROM ranked""",
)
def model_grid_residuals(spark, sf):
    """Raw and residual responses of the community and its subgroups by every predictor, in both forms."""
    r = lambda c, d: (F.round(c, d) + 0.0).alias(c)
    return _models(spark, sf).select(
        "scope", "response", "predictor", "reg_type", r("aicc", 6), r("r2", 8), r("p", 6), r("del_aicc", 6)
    )


TABLES = {
    "raw": {"nb_sp_p": "% Taxon richness", "nb_fes_p": "% FE richness"},
    "residuals": {"res_spp": "% Taxon richness (residuals)", "res_fep": "% FE richness (residuals)"},
}
NAMES = {"complexity": "Complexity", "cv_price": "Phosphate", "cv_discount": "Silicate", "cv_tax": "Salinity"}


@query(
    "model_report_sections",
    f"""WITH {_RANKED},
named AS (SELECT scope, CASE WHEN response LIKE 'nb%' THEN 'raw' ELSE 'residuals' END AS report,
  CASE response WHEN 'nb_sp_p' THEN '% Taxon richness' WHEN 'nb_fes_p' THEN '% FE richness'
    WHEN 'res_spp' THEN '% Taxon richness (residuals)' ELSE '% FE richness (residuals)' END AS section,
  response LIKE '%fe%' AS later,
  CASE predictor WHEN 'complexity' THEN 0 WHEN 'cv_price' THEN 1 WHEN 'cv_discount' THEN 2 ELSE 3 END AS ord,
  CASE predictor WHEN 'complexity' THEN 'Complexity' WHEN 'cv_price' THEN 'Phosphate'
    WHEN 'cv_discount' THEN 'Silicate' ELSE 'Salinity' END AS parameter,
  reg_type AS regression, round_even(aicc, 1) AS aicc,
  CASE WHEN r2 > 0.1 THEN round_even(r2, 2) ELSE round_even(r2, 3) END + 0.0 AS r2,
  round_even(p * pow(10, 1 - floor(log10(p))), 0) / pow(10, 1 - floor(log10(p))) AS p,
  round_even(del_aicc, 1) AS delta_aicc FROM ranked)
SELECT * EXCLUDE (later, ord), row_number() OVER (PARTITION BY scope, report
  ORDER BY later, delta_aicc, ord, regression)::INTEGER AS row FROM named""",
)
def model_report_sections(spark, sf):
    """Published model tables: raw and residual, for the community and each subgroup, with their sections."""
    out = reports.report_tables(_models(spark, sf), TABLES, NAMES, ["scope"])
    return out.withColumn("r2", F.col("r2") + 0.0)


@query(
    "taxon_regressions",
    f"""WITH {COVER}, {SITE_TABLE},
met AS (SELECT taxon, cv_tax AS x, cover AS y FROM cover JOIN site_table USING (site)),
{quadratic_sql("met", "taxon")},
e AS (SELECT *, syy - a1 * a1 / s2 AS rss1 FROM quad),
f AS (SELECT taxon, n, a1 / s2 AS slope, {aicc_sql("n", "rss1", 3)} AS e1, {aicc_sql("n", "rss", 4)} AS e2,
  1 - rss1 / syy AS r2_line, ssr / syy AS r2_curve,
  {t_p_sql("(a1 / s2 / sqrt(rss1 / (n - 2) / s2))", "(n - 2)")} AS p_line,
  {t_p_sql("(c1 / sqrt(rss / (n - 3)))", "(n - 3)")} AS p_curve_linear,
  {t_p_sql("(c2 / sqrt(rss / (n - 3)))", "(n - 3)")} AS p_curve_quadratic FROM e),
h AS (SELECT *, CASE WHEN e2 < e1 THEN 'Polynomial' ELSE 'Linear' END AS form,
  CASE WHEN e2 < e1 THEN p_curve_quadratic ELSE p_line END AS pvalue,
  CASE WHEN e2 < e1 THEN r2_curve ELSE r2_line END AS r_squared FROM f)
SELECT taxon, 'cv_tax' AS parameter, n, round(slope, 6) + 0.0 AS slope, round(p_line, 6) AS p_line,
  round(p_curve_linear, 6) AS p_curve_linear, round(p_curve_quadratic, 6) AS p_curve_quadratic,
  round(r2_line, 6) + 0.0 AS r2_line, round(r2_curve, 6) AS r2_curve, form, round(pvalue, 6) AS pvalue,
  round(r_squared, 6) + 0.0 AS r_squared, pvalue < 0.07 AS shows FROM h""",
)
def taxon_regressions(spark, sf):
    """Cover of every taxon on the gradient: line and curve, the better form, and whether it shows."""
    gradient = site_table(spark, sf).select("site", "cv_tax")
    table = cut_lineage(_cover(spark, sf).select("site", "taxon", "cover").join(gradient, "site"))
    fits = regression.entity_regressions(table, "taxon", "cover", "cv_tax")
    return rounded(fits.withColumn("shows", F.col("pvalue") < 0.07))
