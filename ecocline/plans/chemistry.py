"""Sample quality control, site variability and gradient tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ecocline.operators import ordering, relations, reports, reshape, summaries
from ecocline.plans.registry import PARAMETERS, SAMPLES, query, rounded, samples
from ecocline.sources.tables import parquet

BAD_DAY = datetime(1999, 8, 19)


def _bad_day():
    """Typed like the column: a zoned literal would be cast on every row and never pushed down."""
    return F.lit(BAD_DAY.isoformat(" ")).cast("timestamp_ntz")


def _location(spark, sf):
    """Site to region name; joined to one row per site, after the samples are reduced."""
    c = F.col
    supplier = parquet(spark, sf, "supplier").select(
        c("s_suppkey").alias("site"), c("s_nationkey").alias("n_nationkey"), "s_acctbal"
    )
    nation = parquet(spark, sf, "nation").select("n_nationkey", c("n_regionkey").alias("r_regionkey"))
    region = parquet(spark, sf, "region").select("r_regionkey", c("r_name").alias("location"))
    return supplier.join(nation, "n_nationkey").join(region, "r_regionkey").select(
        "site", "location", "s_acctbal"
    )


def _qc(df):
    """Redundant low-tide samples of one day and impossible readings go; unknown stays."""
    c = F.col
    redundant = (c("tide") == "R") & (c("day_night") == "F") & (c("taken") == _bad_day())
    return relations.exclude(df, redundant, c("quantity") >= 50)


_KEPT = f"""{SAMPLES},
kept AS (
  SELECT * FROM samples
  WHERE NOT coalesce(tide = 'R' AND day_night = 'F' AND taken = TIMESTAMP '1999-08-19', FALSE)
    AND NOT coalesce(quantity >= 50, FALSE)),
location AS (
  SELECT s_suppkey AS site, r_name AS location, s_acctbal FROM supplier
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(
    "site_cv",
    f"""WITH {_KEPT}
SELECT location, site,
  round(stddev_samp(quantity) / avg(quantity) * 100, 6) AS quantity,
  round(stddev_samp(price) / avg(price) * 100, 6) AS price,
  round(stddev_samp(discount) / avg(discount) * 100, 6) AS discount,
  round(stddev_samp(tax) / avg(tax) * 100, 6) AS tax
FROM kept JOIN location USING (site) WHERE s_acctbal >= 0 GROUP BY location, site""",
)
def site_cv(spark, sf):
    """QC, then the CV of every parameter per site; listed-out sites and samples are excluded."""
    cv = summaries.variability(_qc(samples(spark, sf)), ["site"], PARAMETERS)
    sites = _location(spark, sf).filter("s_acctbal >= 0").drop("s_acctbal")
    return rounded(cv.join(sites, "site").select("location", "site", *PARAMETERS))


@query(
    "site_range_long",
    f"""WITH {SAMPLES},
long AS (
  SELECT site, 'quantity' AS parameter, quantity AS v FROM samples
  UNION ALL SELECT site, 'price', price FROM samples
  UNION ALL SELECT site, 'discount', discount FROM samples
  UNION ALL SELECT site, 'tax', tax FROM samples)
SELECT site, parameter, max(v) AS max, min(v) AS min, round(max(v) - min(v), 6) AS range
FROM long GROUP BY site, parameter""",
)
def site_range_long(spark, sf):
    """Maximum, minimum and range per site and parameter, long."""
    return rounded(
        summaries.summarise_long(samples(spark, sf), ["site"], PARAMETERS, ["max", "min", "range"])
    )


@query(
    "site_summary_wide",
    f"""WITH {SAMPLES}
SELECT site, """
    + ", ".join(
        f"max({p}) AS {p}_max, min({p}) AS {p}_min, round(avg({p}), 4) AS {p}_mean, "
        f"round(stddev_samp({p}), 4) AS {p}_sd"
        for p in PARAMETERS
    )
    + " FROM samples GROUP BY site",
)
def site_summary_wide(spark, sf):
    """Maximum, minimum, mean and sd of every parameter per site, wide."""
    stats = ["max", "min", "mean", "sd"]
    return rounded(summaries.summarise(samples(spark, sf), ["site"], PARAMETERS, stats), 4)


@query(
    "site_mean_se",
    f"""WITH {SAMPLES},
long AS (
  SELECT tide, day_night, 'discount' AS parameter, discount AS v FROM samples
  UNION ALL SELECT tide, day_night, 'tax', tax FROM samples)
SELECT tide, day_night, parameter, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd,
  round(stddev_samp(v) / sqrt(count(v)), 8) AS se, count(v) AS n
FROM long GROUP BY ALL""",
)
def site_mean_se(spark, sf):
    """Mean, sd and standard error per tide and time of day."""
    out = summaries.summarise_long(
        samples(spark, sf), ["tide", "day_night"], ["discount", "tax"], ["mean", "sd", "se", "n"]
    )
    c = F.col
    return out.select(
        "tide", "day_night", "parameter", F.round(c("mean"), 6).alias("mean"),
        F.round(c("sd"), 6).alias("sd"), F.round(c("se"), 8).alias("se"), "n",
    )


@query(
    "qc_rule_hits",
    f"""WITH {SAMPLES}
SELECT 'redundant' AS rule, count(*) FILTER (tide = 'R' AND day_night = 'F'
  AND taken = TIMESTAMP '1999-08-19') AS n_rows FROM samples
UNION ALL SELECT 'untrimmed', count(*) FILTER (tide = ' R') FROM samples
UNION ALL SELECT 'impossible', count(*) FILTER (quantity >= 50) FROM samples
UNION ALL SELECT 'undetected', count(*) FILTER (discount IS NULL) FROM samples""",
)
def qc_rule_hits(spark, sf):
    """Rows matched by each exclusion rule; a rule that matches nothing shows as zero."""
    c = F.col
    return relations.rule_hits(samples(spark, sf), {
        "redundant": (c("tide") == "R") & (c("day_night") == "F") & (c("taken") == _bad_day()),
        "untrimmed": c("tide") == " R",
        "impossible": c("quantity") >= 50,
        "undetected": c("discount").isNull(),
    })


@query(
    "qc_rule_table",
    f"""WITH {SAMPLES},
bad AS (SELECT DISTINCT site, taken, discount FROM samples WHERE quantity >= 49)
SELECT site, count(*) AS n_left, round(avg(price), 6) AS mean_price FROM samples s
WHERE NOT EXISTS (
  SELECT 1 FROM bad b WHERE b.site = s.site AND b.taken = s.taken
    AND b.discount IS NOT DISTINCT FROM s.discount)
GROUP BY site""",
)
def qc_rule_table(spark, sf):
    """Exclusion by a table of rule rows, where a missing key value matches a missing one."""
    all_ = samples(spark, sf)
    bad = all_.filter("quantity >= 49").select("site", "taken", "discount").distinct()
    left = relations.natural_join(all_, bad, "left_anti")
    return rounded(
        left.groupBy("site").agg(F.count("*").alias("n_left"), F.avg("price").alias("mean_price"))
    )


@query(
    "date_literal",
    f"""WITH {SAMPLES}
SELECT tide, day_night, count(*) AS n, round(sum(quantity), 3) AS quantity
FROM samples WHERE taken = TIMESTAMP '1999-08-19' GROUP BY ALL""",
)
def date_literal(spark, sf):
    """Samples of one day: the date reaches the Parquet scan as a pushed filter."""
    day = samples(spark, sf).filter(F.col("taken") == _bad_day())
    out = day.groupBy("tide", "day_night").agg(
        F.count("*").alias("n"), F.sum("quantity").alias("quantity")
    )
    return rounded(out, 3)


@query(
    "sample_spread",
    f"""WITH {SAMPLES},
long AS (
  SELECT site, 'price' AS parameter, price AS v FROM samples
  UNION ALL SELECT site, 'discount', discount FROM samples)
SELECT site, parameter, count(v) AS n, quantile_disc(v, 0.05) AS q05, quantile_disc(v, 0.25) AS q25,
  quantile_disc(v, 0.5) AS q50, quantile_disc(v, 0.75) AS q75, quantile_disc(v, 0.95) AS q95
FROM long GROUP BY site, parameter""",
)
def sample_spread(spark, sf):
    """Exact quantiles of the samples per site and parameter."""
    probs = [0.05, 0.25, 0.5, 0.75, 0.95]
    return summaries.spread_profile(samples(spark, sf), ["site"], ["price", "discount"], probs)


@query(
    "sample_histogram",
    f"""WITH {SAMPLES}
SELECT tide, day_night, floor(price / 5000) * 5000 AS bin, count(*) AS n FROM samples
WHERE price IS NOT NULL GROUP BY ALL""",
)
def sample_histogram(spark, sf):
    """Sample counts in price bins of fixed width per tide and time of day."""
    out = summaries.histogram(samples(spark, sf), ["tide", "day_night"], "price", 5000.0)
    return out.withColumn("bin", F.col("bin").cast("double"))


@query(
    "gradient_table",
    f"""WITH {SAMPLES},
cv AS (
  SELECT site, stddev_samp(quantity) / avg(quantity) * 100 AS quantity,
    stddev_samp(discount) / avg(discount) * 100 AS discount,
    stddev_samp(tax) / avg(tax) * 100 AS tax
  FROM samples GROUP BY site),
long AS (
  SELECT s.s_suppkey AS site, CASE WHEN s_acctbal < 0 THEN 'Seep' ELSE 'Reef' END AS "group",
    parameter, cv
  FROM (FROM cv UNPIVOT INCLUDE NULLS (cv FOR parameter IN (quantity, discount, tax))) u
  RIGHT JOIN supplier s ON s.s_suppkey = u.site)
SELECT site, "group", CASE parameter WHEN 'quantity' THEN 'Nitrate+Nitrite'
  ELSE parameter END AS parameter, round(cv, 6) AS cv,
  round(avg(cv) OVER w, 6) AS cv_mean,
  round(stddev_samp(cv) OVER w / sqrt(nullif(count(cv) OVER w, 0)), 6) AS se
FROM long WHERE parameter IS NOT NULL WINDOW w AS (PARTITION BY "group", parameter)""",
)
def gradient_table(spark, sf):
    """CV of every surveyed site and parameter beside the mean and se of its kind of site."""
    names = ["quantity", "discount", "tax"]
    cv = summaries.variability(samples(spark, sf), ["site"], names)
    long = reshape.wide_to_long(cv, names, "parameter", "cv", keep=["site"])
    survey = parquet(spark, sf, "supplier").select(F.col("s_suppkey").alias("site"), "s_acctbal")
    long = long.join(survey, "site", "right").filter("parameter IS NOT NULL")
    kind = F.when(F.col("s_acctbal") < 0, "Seep").otherwise("Reef")
    out = reports.gradient_table(long, kind, "parameter", "cv", {"quantity": "Nitrate+Nitrite"})
    return rounded(out.select("site", "group", "parameter", "cv", "cv_mean", "se"))


@query(
    "parameter_beside",
    f"""WITH {SAMPLES},
cv AS (
  SELECT site, stddev_samp(price) / avg(price) * 100 AS price,
    stddev_samp(discount) / avg(discount) * 100 AS discount,
    stddev_samp(tax) / avg(tax) * 100 AS tax
  FROM samples GROUP BY site),
long AS (FROM cv UNPIVOT INCLUDE NULLS (cv FOR parameter IN (price, discount, tax)))
SELECT a.site, a.parameter, round(a.cv, 6) AS cv, round(b.cv, 6) AS tax
FROM long a LEFT JOIN (SELECT site, cv FROM long WHERE parameter = 'tax') b USING (site)""",
)
def parameter_beside(spark, sf):
    """One parameter's CV as a column beside all parameters of the same site."""
    names = ["price", "discount", "tax"]
    cv = summaries.variability(samples(spark, sf), ["site"], names)
    long = reshape.wide_to_long(cv, names, "parameter", "cv", keep=["site"])
    return rounded(reshape.parameter_beside(long, ["site"], "parameter", "cv", "tax"))


@query(
    "site_order",
    f"""WITH {SAMPLES},
cv AS (SELECT site, round(stddev_samp(price) / avg(price) * 100, 2) AS cv FROM samples GROUP BY site)
SELECT site, cv, dense_rank() OVER (ORDER BY cv) AS ord FROM cv""",
)
def site_order(spark, sf):
    """Sites in order of a metric, as a dense rank over all sites."""
    cv = summaries.variability(samples(spark, sf), ["site"], ["price"])
    cv = cv.select("site", F.round("price", 2).alias("cv"))
    return ordering.order_index(cv, "cv").select("site", "cv", "ord")


@query(
    "region_rollup",
    f"""WITH {SAMPLES},
m AS (
  SELECT s_nationkey AS nation, 'price' AS parameter, price AS v
  FROM samples JOIN supplier ON site = s_suppkey
  UNION ALL SELECT s_nationkey, 'discount', discount FROM samples JOIN supplier ON site = s_suppkey)
SELECT nation, parameter, count(v)::DOUBLE AS n, round(avg(v), 4) AS mean,
  round(stddev_samp(v), 4) AS sd, round(stddev_samp(v) / avg(v) * 100, 6) AS cv
FROM m GROUP BY ALL""",
)
def region_rollup(spark, sf):
    """Count, mean, sd and CV per nation, merged from the moments of its sites."""
    c = F.col
    dims = parquet(spark, sf, "supplier").select(
        c("s_suppkey").alias("site"), c("s_nationkey").alias("nation")
    )
    out = summaries.rolled_up(samples(spark, sf), "site", ["price", "discount"], dims, ["nation"])
    rows = [
        F.struct(
            F.lit(p).alias("parameter"), c(f"{p}_n").cast("double").alias("n"),
            F.round(c(f"{p}_mean"), 4).alias("mean"), F.round(c(f"{p}_sd"), 4).alias("sd"),
            F.round(c(f"{p}_cv"), 6).alias("cv"),
        )
        for p in ("price", "discount")
    ]
    return out.select("nation", F.inline(F.array(*rows)))
