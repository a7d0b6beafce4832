"""Regression, model selection and their report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ecocline.operators import diversity, ordering, regression, relations, reports
from ecocline.plans.registry import (
    COVER, PREDICTORS, RESPONSES, SITE_PAIRS, SITE_TABLE, cover_counts, query, rounded, site_table, stored_sites,
    taxa,
)
from ecocline.sources.storage import cut_lineage


def quadratic_sql(pairs: str, keys: str) -> str:
    """Closed-form quadratic fits of a CTE ``pairs`` by ``keys``, as CTE ``quad``."""
    return f"""
m AS (SELECT {keys}, avg(x) AS mx, avg(y) AS my FROM {pairs} WHERE x IS NOT NULL AND y IS NOT NULL
  GROUP BY {keys}),
u AS (SELECT {keys}, x - mx AS u, y - my AS v, mx, my FROM {pairs} JOIN m USING ({keys})
  WHERE x IS NOT NULL AND y IS NOT NULL),
s AS (SELECT {keys}, count(*)::DOUBLE AS n, any_value(mx) AS mx, any_value(my) AS my,
  sum(u * u) AS s2, sum(u * u * u) AS s3, sum(u * u * u * u) AS s4, sum(u * v) AS a1,
  sum(u * u * v) AS a2, sum(v * v) AS syy FROM u GROUP BY {keys}),
c AS (SELECT *, s4 - s2 * s2 / n - s3 * s3 / s2 AS q2, a1 / sqrt(s2) AS c1 FROM s),
d AS (SELECT *, (a2 - s3 / s2 * a1) / sqrt(q2) AS c2 FROM c),
quad AS (SELECT *, syy - c1 * c1 - c2 * c2 AS rss, c1 * c1 + c2 * c2 AS ssr FROM d)"""


def aicc_sql(n: str, rss: str, k: int) -> str:
    return (f"({n} * ln({rss} / {n}) + {n} * (1 + ln(2 * pi())) + 2 * {k} "
            f"+ 2.0 * {k} * ({k} + 1) / ({n} - {k} - 1))")  # fmt: skip


def t_p_sql(t: str, df: str) -> str:
    """Two-sided p of a t statistic by Simpson's rule over its density."""
    density = f"pow(1 + pow(abs({t}) * i / 4000.0, 2) / {df}, -({df} + 1) / 2.0)"
    weight = "(CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    area = f"list_sum(list_transform(range(0, 4001), lambda i: {weight} * {density}))"
    scale = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi())"
    return f"greatest(0, 1 - 2 * {scale} * abs({t}) / 12000.0 * {area})"


_BOTH = f"""{SITE_PAIRS},
{quadratic_sql("pairs", "response, predictor")},
lin AS (
  SELECT response, predictor, n, syy - a1 * a1 / s2 AS rss, a1, s2, syy FROM quad),
models AS (
  SELECT response, predictor, 'Linear' AS reg_type, {aicc_sql("n", "rss", 3)} AS aicc,
    1 - rss / syy AS r2, n - 2 AS df, a1 / s2 / sqrt(rss / (n - 2) / s2) AS t FROM lin
  UNION ALL SELECT response, predictor, 'Polynomial', {aicc_sql("n", "rss", 4)}, ssr / syy, n - 3,
    c2 / sqrt(rss / (n - 3)) FROM quad),
ranked AS (SELECT *, aicc - min(aicc) OVER (PARTITION BY response) AS del_aicc FROM models)"""


@query(
    "linear_fits",
    f"""WITH {SITE_PAIRS}, f AS (
  SELECT response, predictor, count(*)::DOUBLE AS n, regr_intercept(y, x) AS a,
    regr_slope(y, x) AS b, regr_r2(y, x) AS r2, regr_sxx(y, x) AS sxx,
    regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x) AS rss, avg(x) AS mx
  FROM pairs GROUP BY ALL)
SELECT response, predictor, n, round(a, 6) AS intercept, round(b, 8) + 0.0 AS slope,
  round(sqrt(rss / (n - 2) / sxx), 8) AS se_slope,
  round(sqrt(rss / (n - 2) * (1 / n + mx * mx / sxx)), 6) AS se_intercept,
  round(b / sqrt(rss / (n - 2) / sxx), 6) + 0.0 AS t_slope, round(r2, 8) AS r2,
  round(1 - (1 - r2) * (n - 1) / (n - 2), 8) + 0.0 AS adj_r2
FROM f""",
)
def linear_fits(spark, sf):
    """Simple least squares of every response on every predictor: coefficients, errors, t, R2."""
    fits = regression.linear_fits(regression.fit_sums(stored_sites(spark, sf), RESPONSES, PREDICTORS))
    r = lambda c, d: (F.round(c, d) + 0.0).alias(c)
    return fits.select(
        "response", "predictor", "n", r("intercept", 6), r("slope", 8), r("se_slope", 8),
        r("se_intercept", 6), r("t_slope", 6), r("r2", 8), r("adj_r2", 8),
    )


@query(
    "quadratic_fits",
    f"""WITH {SITE_PAIRS}, {quadratic_sql("pairs", "response, predictor")}
SELECT response, predictor, n, round(c1, 6) + 0.0 AS c1, round(c2, 6) + 0.0 AS c2,
  round(c1 / sqrt(rss / (n - 3)), 6) + 0.0 AS t_linear,
  round(c2 / sqrt(rss / (n - 3)), 6) + 0.0 AS t_quadratic, round(ssr / syy, 8) AS r2
FROM quad""",
)
def quadratic_fits(spark, sf):
    """Quadratic least squares in the orthogonal basis."""
    sums = regression.fit_sums(stored_sites(spark, sf), RESPONSES, PREDICTORS)
    r = lambda c, d: (F.round(c, d) + 0.0).alias(c)
    return regression.quadratic_fits(sums).select(
        "response", "predictor", "n", r("c1", 6), r("c2", 6), r("t_linear", 6), r("t_quadratic", 6),
        r("r2", 8),
    )


@query(
    "log_fits",
    f"""WITH {SITE_TABLE},
x AS (SELECT nb_sp, 'log_complexity' AS predictor, CASE WHEN complexity > 0 THEN ln(complexity) END AS x
  FROM site_table UNION ALL SELECT nb_sp, 'log_cv_tax', ln(cv_tax) FROM site_table)
SELECT predictor, count(*)::DOUBLE AS n, round(regr_slope(nb_sp, x), 6) + 0.0 AS slope,
  round(regr_r2(nb_sp, x), 6) AS r2
FROM x WHERE x IS NOT NULL GROUP BY predictor""",
)
def log_fits(spark, sf):
    """Least squares on the logarithm of a predictor; where it has none the row is left out."""
    logs = {"log_complexity": F.ln("complexity"), "log_cv_tax": F.ln("cv_tax")}
    table = stored_sites(spark, sf).withColumns(logs)
    fits = regression.linear_fits(regression.fit_sums(table, ["nb_sp"], list(logs)))
    return rounded(fits.select("predictor", "n", "slope", "r2"))


@query(
    "model_grid",
    f"""WITH {_BOTH}
SELECT response, predictor, reg_type, round(aicc, 6) AS aicc, round(r2, 8) AS r2,
  round({t_p_sql("t", "df")}, 6) AS p, round(del_aicc, 6) AS del_aicc FROM ranked""",
)
def model_grid(spark, sf):
    """Every response by every predictor in both forms: AICc, R2, p and AICc difference."""
    models = regression.model_table(stored_sites(spark, sf), RESPONSES, PREDICTORS)
    r = lambda c, d: F.round(c, d).alias(c)
    return models.select(
        "response", "predictor", "reg_type", r("aicc", 6), r("r2", 8), r("p", 6), r("del_aicc", 6)
    )


@query(
    "best_models",
    f"""WITH {_BOTH}
SELECT response, predictor, reg_type, round(del_aicc, 6) AS del_aicc FROM ranked WHERE del_aicc <= 2""",
)
def best_models(spark, sf):
    """Models within two AICc units of the best of their response, best first."""
    models = regression.model_table(stored_sites(spark, sf), RESPONSES, PREDICTORS)
    best = regression.best_models(models).select("response", "predictor", "reg_type", "del_aicc")
    return rounded(best).orderBy("response", "del_aicc")


@query(
    "model_report",
    f"""WITH {_BOTH},
p AS (SELECT *, {t_p_sql("t", "df")} AS p FROM ranked)
SELECT '% Taxon richness' AS section, 0 AS section_ord,
  CASE predictor WHEN 'cv_price' THEN 'Phosphate' WHEN 'complexity' THEN 'Complexity'
    ELSE predictor END AS parameter,
  reg_type AS regression, round_even(aicc, 1) AS aicc,
  CASE WHEN r2 > 0.1 THEN round_even(r2, 2) ELSE round_even(r2, 3) END AS r2,
  round_even(p * pow(10, 1 - floor(log10(p))), 0) / pow(10, 1 - floor(log10(p))) AS p,
  round_even(del_aicc, 1) AS delta_aicc
FROM p WHERE response = 'nb_sp'""",
)
def model_report(spark, sf):
    """Publication table of one response's models: renamed, rounded and ordered."""
    models = regression.model_table(stored_sites(spark, sf), RESPONSES, PREDICTORS)
    names = {"cv_price": "Phosphate", "complexity": "Complexity"}
    return reports.model_report(models, {"nb_sp": "% Taxon richness"}, names)


@query(
    "residuals_linear",
    f"""WITH {SITE_TABLE}
SELECT site, round(nb_sp - regr_intercept(nb_sp, complexity) OVER ()
    - regr_slope(nb_sp, complexity) OVER () * complexity, 6) + 0.0 AS res_sp,
  round(mean_quantity - regr_intercept(mean_quantity, complexity) OVER ()
    - regr_slope(mean_quantity, complexity) OVER () * complexity, 6) + 0.0 AS res_quantity
FROM site_table""",
)
def residuals_linear(spark, sf):
    """Residuals of two responses from their lines on one predictor."""
    names = {"nb_sp": "res_sp", "mean_quantity": "res_quantity"}
    out = regression.with_residuals(stored_sites(spark, sf), names, "complexity")
    return rounded(out.select("site", "res_sp", "res_quantity"))


@query(
    "residuals_quadratic",
    f"""WITH {SITE_TABLE},
pairs AS (SELECT 1 AS k, site, complexity AS x, nb_sp AS y FROM site_table),
{quadratic_sql("pairs", "k")}
SELECT site, round(y - my - c1 / sqrt(s2) * (x - pairs_mx)
  - c2 / sqrt(q2) * ((x - pairs_mx) * (x - pairs_mx) - s3 / s2 * (x - pairs_mx) - s2 / n), 6) + 0.0
  AS res_sp
FROM (SELECT pairs.*, quad.mx AS pairs_mx, quad.* EXCLUDE (k, mx) FROM pairs JOIN quad ON pairs.k = quad.k)""",
)
def residuals_quadratic(spark, sf):
    """Residuals from a quadratic fit."""
    out = regression.with_residuals(stored_sites(spark, sf), {"nb_sp": "res_sp"}, "complexity", degree=2)
    return rounded(out.select("site", "res_sp"))


@query(
    "residuals_by_group",
    f"""WITH {SITE_TABLE}
SELECT site, nation, CASE WHEN regr_sxx(nb_sp, complexity) OVER w > 0 THEN
  round(nb_sp - regr_intercept(nb_sp, complexity) OVER w
    - regr_slope(nb_sp, complexity) OVER w * complexity, 6) + 0.0 END AS res_sp
FROM site_table WINDOW w AS (PARTITION BY nation)""",
)
def residuals_by_group(spark, sf):
    """Residuals from each group's own line."""
    out = regression.with_residuals(stored_sites(spark, sf), {"nb_sp": "res_sp"}, "complexity", by=["nation"])
    return rounded(out.select("site", "nation", "res_sp"))


@query(
    "sequential_anova",
    f"""WITH {SITE_TABLE}, {COVER},
fr AS (SELECT site, count(DISTINCT taxon_group || morph || energy) / count(DISTINCT taxon) AS fe_sp
  FROM cover GROUP BY site),
pairs AS (
  SELECT 'all' AS scenario, cv_price AS x, fe_sp AS y FROM site_table JOIN fr USING (site)
  UNION ALL SELECT 'without_7', cv_price, fe_sp FROM site_table JOIN fr USING (site) WHERE site <> 7),
{quadratic_sql("pairs", "scenario")},
terms AS (
  SELECT scenario, 'linear' AS term, c1 * c1 AS ss, rss / (n - 3) AS ms, n - 3 AS df FROM quad
  UNION ALL SELECT scenario, 'quadratic', c2 * c2, rss / (n - 3), n - 3 FROM quad)
SELECT scenario, term, 1.0::DOUBLE AS df_term, df AS df_residual, round(ss * 1000, 8) AS ss,
  round(ss / ms, 6) AS f, round({t_p_sql("sqrt(ss / ms)", "df")}, 6) AS p FROM terms""",
)
def sequential_anova(spark, sf):
    """Type I table of a ratio on a gradient, with and without one site."""
    living = taxa(spark, sf)
    present = cover_counts(spark, sf).select("site", "taxon")
    entities = diversity.functional_entities(living, "taxon", ["taxon_group", "morph", "energy"])
    ratio = present.join(entities.select("taxon", "fe"), "taxon").groupBy("site").agg(
        (F.count_distinct("fe") / F.count_distinct("taxon")).alias("fe_sp")
    )
    table = cut_lineage(site_table(spark, sf).join(ratio, "site"))
    tagged = relations.scenarios(table, {"all": None, "without_7": F.col("site") != 7})
    out = regression.sequential_anova(tagged, "fe_sp", "cv_price", ["scenario"])
    r = lambda c, d: F.round(c, d).alias(c)
    return out.select(
        "scenario", "term", "df_term", "df_residual", F.round(F.col("ss") * 1000, 8).alias("ss"),
        r("f", 6), r("p", 6),
    )


@query(
    "sensitivity",
    f"""WITH {SITE_TABLE},
s AS (SELECT 'all' AS scenario, * FROM site_table
  UNION ALL SELECT 'positive_balance', * FROM site_table WHERE complexity >= 0)
SELECT scenario, count(*)::DOUBLE AS n, round(regr_slope(nb_sp, cv_tax), 6) + 0.0 AS slope,
  round(regr_r2(nb_sp, cv_tax), 8) AS r2 FROM s GROUP BY scenario""",
)
def sensitivity(spark, sf):
    """One fit with and without some sites, from one table."""
    rules = {"all": None, "positive_balance": F.col("complexity") >= 0}
    tagged = relations.scenarios(stored_sites(spark, sf), rules)
    fits = regression.linear_fits(regression.fit_sums(tagged, ["nb_sp"], ["cv_tax"], ["scenario"]))
    r = lambda c, d: (F.round(c, d) + 0.0).alias(c)
    return fits.select("scenario", "n", r("slope", 6), r("r2", 8))


def _trait_cover(spark, sf):
    """Cover by site and trait group beside the site's gradient."""
    cover = diversity.relative_cover(cover_counts(spark, sf), "site", "taxon", "count", summed=True)
    groups = taxa(spark, sf).select("taxon", "taxon_group")
    sums = cover.join(groups, "taxon").groupBy("site", "taxon_group").agg(F.sum("cover").alias("cover"))
    sites = site_table(spark, sf).select("site", "cv_price", "complexity")
    return cut_lineage(sums.join(sites, "site"))


_TRAIT_COVER = f"""{SITE_TABLE}, {COVER},
tc AS (SELECT site, taxon_group, sum(cover) AS y FROM cover GROUP BY ALL),
pairs AS (SELECT taxon_group, site, cv_price AS x, y FROM tc JOIN site_table USING (site))"""


@query(
    "trait_regressions_quadratic",
    f"""WITH {_TRAIT_COVER}, {quadratic_sql("pairs", "taxon_group")}
SELECT taxon_group, 'cv_price' AS parameter,
  round({t_p_sql("(c1 / sqrt(rss / (n - 3)))", "(n - 3)")}, 6) AS pvalue1,
  round({t_p_sql("(c2 / sqrt(rss / (n - 3)))", "(n - 3)")}, 6) AS pvalue2,
  round(ssr / syy, 8) AS r_squared,
  round(1 - (1 - ssr / syy) * (n - 1) / (n - 3), 8) + 0.0 AS adj_r_squared
FROM quad""",
)
def trait_regressions_quadratic(spark, sf):
    """Quadratic fit of every trait's cover on the gradient: both p-values and R2."""
    out = regression.trait_regressions(_trait_cover(spark, sf), "taxon_group", "cover", "cv_price", 2)
    r = lambda c, d: (F.round(c, d) + 0.0).alias(c)
    return out.select("taxon_group", "parameter", r("pvalue1", 6), r("pvalue2", 6),
                      r("r_squared", 8), r("adj_r_squared", 8))


@query(
    "significant_taxa",
    f"""WITH {SITE_TABLE}, {COVER},
pairs AS (SELECT morph, cv_tax AS x, c AS y FROM
  (SELECT site, morph || ' ' || energy AS morph, sum(cover) AS c FROM cover GROUP BY ALL)
  JOIN site_table USING (site)),
f AS (SELECT morph, count(*)::DOUBLE AS n, regr_r2(y, x) AS r2, regr_slope(y, x)
  / sqrt((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / (count(*) - 2)
  / regr_sxx(y, x)) AS t FROM pairs GROUP BY morph),
p AS (SELECT *, {t_p_sql("t", "(n - 2)")} AS p FROM f)
SELECT morph, 'cv_tax' AS parameter, round(p, 6) AS pvalue1, NULL::DOUBLE AS pvalue2,
  round(r2, 8) AS r_squared, round(1 - (1 - r2) * (n - 1) / (n - 2), 8) + 0.0 AS adj_r_squared
FROM p WHERE p < 0.5""",
)
def significant_taxa(spark, sf):
    """Linear fit per kind of taxon, kept where the gradient shows."""
    cover = diversity.relative_cover(cover_counts(spark, sf), "site", "taxon", "count", summed=True)
    kind = F.concat_ws(" ", "morph", "energy").alias("morph")
    sums = cover.join(taxa(spark, sf).select("taxon", kind), "taxon").groupBy("site", "morph")
    sums = sums.agg(F.sum("cover").alias("cover"))
    table = cut_lineage(sums.join(site_table(spark, sf).select("site", "cv_tax"), "site"))
    fits = regression.trait_regressions(table, "morph", "cover", "cv_tax", 1)
    r = lambda c, d: (F.round(c, d) + 0.0).alias(c)
    return regression.significant(fits, 0.5).select(
        "morph", "parameter", r("pvalue1", 6), r("pvalue2", 6), r("r_squared", 8), r("adj_r_squared", 8)
    )


_LEVELS = f"""{_TRAIT_COVER},
l AS (SELECT taxon_group, count(*)::DOUBLE AS n, regr_intercept(y, x) AS a, regr_slope(y, x) AS b,
  regr_sxx(y, x) AS sxx, avg(x) AS mx,
  regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x) AS rss
  FROM pairs GROUP BY taxon_group),
t AS (SELECT sum(rss) AS rss, sum(n) - 2 * count(*) AS df FROM l),
b AS (SELECT * FROM l WHERE taxon_group = 'ECONOMY'),
j AS (SELECT l.taxon_group, l.n, l.a, l.b, t.df,
  CASE WHEN l.taxon_group = 'ECONOMY' THEN l.a ELSE l.a - b.a END AS da,
  CASE WHEN l.taxon_group = 'ECONOMY' THEN l.b ELSE l.b - b.b END AS db,
  sqrt(t.rss / t.df * (1 / l.n + l.mx * l.mx / l.sxx + CASE WHEN l.taxon_group = 'ECONOMY' THEN 0
    ELSE 1 / b.n + b.mx * b.mx / b.sxx END)) AS sa,
  sqrt(t.rss / t.df * (1 / l.sxx + CASE WHEN l.taxon_group = 'ECONOMY' THEN 0 ELSE 1 / b.sxx END)) AS sb
  FROM l, t, b)"""


@query(
    "interaction_slopes",
    f"""WITH {_LEVELS}
SELECT taxon_group, n, df, round(a, 6) + 0.0 AS intercept, round(b, 6) + 0.0 AS slope,
  round(da, 6) + 0.0 AS contrast_intercept, round(db, 6) + 0.0 AS contrast_slope,
  round(sa, 6) AS se_intercept, round(sb, 6) AS se_slope, round(da / sa, 6) + 0.0 AS t_intercept,
  round(db / sb, 6) + 0.0 AS t_slope, round({t_p_sql("(da / sa)", "df")}, 6) AS p_intercept,
  round({t_p_sql("(db / sb)", "df")}, 6) AS p_slope
FROM j""",
)
def interaction_slopes(spark, sf):
    """Line of every level and its contrast with a reference level, one residual variance."""
    out = regression.level_slopes(_trait_cover(spark, sf), "cover", "cv_price", "taxon_group", "ECONOMY")
    return rounded(out)


@query(
    "interaction_anova",
    f"""WITH {_TRAIT_COVER},
l AS (SELECT taxon_group, count(*)::DOUBLE AS n, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy,
  regr_syy(y, x) AS syy FROM pairs GROUP BY taxon_group),
w AS (SELECT sum(syy) - sum(sxy) * sum(sxy) / sum(sxx) AS rss_xg,
  sum(syy - sxy * sxy / sxx) AS rss_full, count(*) AS g, sum(n) AS n FROM l),
o AS (SELECT regr_syy(y, x) AS tss,
  regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x) AS rss_x FROM pairs),
t AS (SELECT 'x' AS term, 1.0::DOUBLE AS df_term, tss - rss_x AS ss, * FROM w, o
  UNION ALL SELECT 'group', g - 1, rss_x - rss_xg, * FROM w, o
  UNION ALL SELECT 'x:group', g - 1, rss_xg - rss_full, * FROM w, o)
SELECT term, df_term, n - 2 * g AS df_residual, round(ss, 6) + 0.0 AS ss,
  round(ss / df_term / (rss_full / (n - 2 * g)), 4) + 0.0 AS f FROM t""",
)
def interaction_anova(spark, sf):
    """Type I table of gradient, group and their interaction."""
    out = regression.interaction_anova(_trait_cover(spark, sf), "cover", "cv_price", "taxon_group")
    r = lambda c, d: (F.round(c, d) + 0.0).alias(c)
    return out.select("term", "df_term", "df_residual", r("ss", 6), r("f", 4))


@query(
    "interaction_anova_quadratic",
    f"""WITH {_TRAIT_COVER}, {quadratic_sql("pairs", "taxon_group")},
z AS (SELECT taxon_group, x - avg(x) OVER w AS u, x * x - avg(x * x) OVER w AS z,
  y - avg(y) OVER w AS v FROM pairs WINDOW w AS (PARTITION BY taxon_group)),
p AS (SELECT sum(u * u) AS a, sum(u * z) AS b, sum(z * z) AS c, sum(u * v) AS d, sum(z * v) AS e,
  sum(v * v) AS ssw FROM z),
all_pairs AS (SELECT 1 AS k, x, y FROM pairs),
om AS (SELECT avg(x) AS mx, avg(y) AS my FROM pairs),
os AS (SELECT count(*)::DOUBLE AS n, sum(pow(x - mx, 2)) AS s2, sum(pow(x - mx, 3)) AS s3,
  sum(pow(x - mx, 4)) AS s4, sum((x - mx) * (y - my)) AS a1, sum(pow(x - mx, 2) * (y - my)) AS a2,
  sum(pow(y - my, 2)) AS tss FROM pairs, om),
o AS (SELECT tss, a1 * a1 / s2 + pow(a2 - s3 / s2 * a1, 2) / (s4 - s2 * s2 / n - s3 * s3 / s2)
  AS ss_x FROM os),
f AS (SELECT sum(rss) AS rss_full, count(*) AS g, sum(n) AS n FROM quad),
r AS (SELECT tss, ss_x, ssw - (d * d * c - 2 * d * e * b + e * e * a) / (a * c - b * b) AS rss_xg,
  rss_full, g, n FROM p, o, f),
t AS (SELECT 'x' AS term, 2.0::DOUBLE AS df_term, ss_x AS ss, * FROM r
  UNION ALL SELECT 'group', g - 1, tss - ss_x - rss_xg, * FROM r
  UNION ALL SELECT 'x:group', 2 * (g - 1), rss_xg - rss_full, * FROM r)
SELECT term, df_term, n - 3 * g AS df_residual, round(ss, 4) + 0.0 AS ss,
  round(ss / df_term / (rss_full / (n - 3 * g)), 4) + 0.0 AS f FROM t""",
)
def interaction_anova_quadratic(spark, sf):
    """Type I table with a quadratic gradient."""
    out = regression.interaction_anova(_trait_cover(spark, sf), "cover", "cv_price", "taxon_group", 2)
    r = lambda c, d: (F.round(c, d) + 0.0).alias(c)
    return out.select("term", "df_term", "df_residual", r("ss", 4), r("f", 4))


@query(
    "fitted_curve",
    f"""WITH {_TRAIT_COVER}, {quadratic_sql("pairs", "taxon_group")},
e AS (SELECT taxon_group, min(x) AS lo, max(x) AS hi FROM pairs GROUP BY taxon_group),
g AS (SELECT quad.*, lo, hi, unnest(range(0, 20)) AS step FROM quad JOIN e USING (taxon_group)),
h AS (SELECT *, lo + (hi - lo) * step / 19.0 AS x, lo + (hi - lo) * step / 19.0 - mx AS u FROM g),
k AS (SELECT *, (u * u - s3 / s2 * u - s2 / n) / sqrt(q2) AS p2 FROM h)
SELECT taxon_group, step::INTEGER AS step, round(x, 6) AS x,
  round(my + c1 * u / sqrt(s2) + c2 * p2, 6) AS fit,
  round(sqrt(rss / (n - 3) * (1 / n + u * u / s2 + p2 * p2)), 6) AS se
FROM k""",
)
def fitted_curve(spark, sf):
    """Quadratic curve per group on an even grid, with its standard error."""
    out = regression.fitted_curve(
        _trait_cover(spark, sf), "cover", "cv_price", 2, ["taxon_group"], points=20
    )
    return rounded(out.drop("lo", "hi"))


@query(
    "confidence_band",
    f"""WITH RECURSIVE {SITE_TABLE},
f AS (SELECT count(*)::DOUBLE AS n, regr_intercept(nb_sp, complexity) AS a,
  regr_slope(nb_sp, complexity) AS b, regr_sxx(nb_sp, complexity) AS sxx, avg(complexity) AS mx,
  (regr_syy(nb_sp, complexity) - regr_sxy(nb_sp, complexity) * regr_sxy(nb_sp, complexity)
   / regr_sxx(nb_sp, complexity)) / (count(*) - 2) AS s2,
  min(complexity) AS lo_x, max(complexity) AS hi_x FROM site_table),
q(i, df, low, high) AS (
  SELECT 0, n - 2, 0.0::DOUBLE, 20.0::DOUBLE FROM f
  UNION ALL SELECT i + 1, df, CASE WHEN p > 0.05 THEN (low + high) / 2 ELSE low END,
    CASE WHEN p > 0.05 THEN high ELSE (low + high) / 2 END
  FROM (SELECT *, {t_p_sql("((low + high) / 2)", "df")} AS p FROM q WHERE i < 60)),
g AS (SELECT *, unnest(range(0, 80)) AS step FROM f),
h AS (SELECT *, lo_x + (hi_x - lo_x) * step / 79.0 AS x FROM g),
k AS (SELECT *, a + b * x AS fit, sqrt(s2 * (1 / n + (x - mx) * (x - mx) / sxx)) AS se FROM h)
SELECT step::INTEGER AS step, round(x, 5) AS x, round(fit, 5) AS fit, round(se, 5) AS se,
  round(fit - low * se, 5) AS lo, round(fit + low * se, 5) AS hi
FROM k, q WHERE i = 60""",
)
def confidence_band(spark, sf):
    """Line with its 95% band over the whole range of a predictor."""
    return rounded(regression.fitted_curve(stored_sites(spark, sf), "nb_sp", "complexity", points=80), 5)


@query(
    "order_by_level",
    f"""WITH {_BOTH}
SELECT response, predictor, reg_type, CASE predictor WHEN 'complexity' THEN 0 WHEN 'cv_price' THEN 1
  WHEN 'cv_tax' THEN 2 WHEN 'cv_discount' THEN 3 END AS ord, round(del_aicc, 6) AS del_aicc
FROM ranked""",
)
def order_by_level(spark, sf):
    """Model rows in published predictor order, then by AICc difference."""
    models = regression.model_table(stored_sites(spark, sf), RESPONSES, PREDICTORS)
    levels = ["complexity", "cv_price", "cv_tax", "cv_discount"]
    out = models.withColumn("ord", ordering.level_order(F.col("predictor"), levels))
    out = rounded(out.select("response", "predictor", "reg_type", "ord", "del_aicc"))
    return out.orderBy("response", "ord", "del_aicc")
