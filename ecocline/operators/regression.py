"""Grouped linear and quadratic least squares from additive power sums.

Every fit is one row of a grouped aggregation: counts and sums of powers of x and y, taken about
the means of the fit's own group, so that groups far from each other lose no digits. Sums moved to
a common origin are additive, so subsets, levels and pooled models are sums of rows, and any number
of models is fitted in one job. Nothing but the fit rows reaches Python.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ecocline.functions import tails
from ecocline.operators.relations import keyed_join
from ecocline.operators.summaries import attach

SUMS = ["n", "sx", "sx2", "sx3", "sx4", "sy", "sy2", "sxy", "sx2y"]
_FLAT = 1e-12


def paired(
    df: DataFrame, responses: Sequence[str], predictors: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Complete (x, y) pairs of every response and predictor, centred about their group's means.

    ``x0`` and ``y0`` are those means. Rows with a missing group are a group.
    """
    names = list(dict.fromkeys([*responses, *predictors]))
    means = [F.avg(F.col(c).cast("double")).alias(c) for c in names]
    if by:
        df = keyed_join(df, df.groupBy(*by).agg(*means).select(*by, F.struct(*names).alias("__mean")), by)
    else:
        df = attach(df, df.agg(*means), "__mean")
    mean = F.col("__mean")

    def entries(columns, label, value, origin):
        return F.array(*[
            F.struct(
                F.lit(c).alias(label),
                (F.col(c).cast("double") - mean[c]).alias(value),
                mean[c].alias(origin),
            )
            for c in columns
        ])

    wide = df.select(
        *by,
        entries(responses, "response", "y", "y0").alias("ys"),
        entries(predictors, "predictor", "x", "x0").alias("xs"),
    )
    long = wide.select(*by, "xs", F.inline("ys")).filter("y IS NOT NULL")
    return long.select(*by, "response", "y", "y0", F.inline("xs")).filter("x IS NOT NULL")


def power_sums(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    terms = {"sx": x, "sx2": x * x, "sx3": x * x * x, "sx4": x * x * x * x}
    terms |= {"sy": y, "sy2": y * y, "sxy": x * y, "sx2y": x * x * y}
    return pairs.groupBy(*keys).agg(
        F.count("*").cast("double").alias("n"),
        *[F.sum(c).alias(n) for n, c in terms.items()],
        F.max("x0").alias("x0"),
        F.max("y0").alias("y0"),
    )


def pool(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge power sums of several groups, moved to their common mean first."""
    c, n = F.col, F.col("n")
    at = lambda s, o: (F.sum(n * c(o) + c(s)) / F.sum("n")).alias(f"__{o}")
    sums = keyed_join(sums, sums.groupBy(*keys).agg(at("sx", "x0"), at("sy", "y0")), keys)
    a, b = c("x0") - c("__x0"), c("y0") - c("__y0")
    sums = sums.withColumns({
        "sx": c("sx") + n * a,
        "sx2": c("sx2") + 2 * a * c("sx") + n * a * a,
        "sx3": c("sx3") + 3 * a * c("sx2") + 3 * a * a * c("sx") + n * a * a * a,
        "sx4": c("sx4") + 4 * a * c("sx3") + 6 * a * a * c("sx2") + 4 * a * a * a * c("sx")
        + n * a * a * a * a,
        "sy": c("sy") + n * b,
        "sy2": c("sy2") + 2 * b * c("sy") + n * b * b,
        "sxy": c("sxy") + a * c("sy") + b * c("sx") + n * a * b,
        "sx2y": c("sx2y") + 2 * a * c("sxy") + a * a * c("sy")
        + b * (c("sx2") + 2 * a * c("sx") + n * a * a),
        "x0": c("__x0"), "y0": c("__y0"),
    })
    return sums.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in SUMS], F.max("x0").alias("x0"), F.max("y0").alias("y0")
    )


def fit_sums(
    df: DataFrame, responses: Sequence[str], predictors: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    return power_sums(paired(df, responses, predictors, by), [*by, "response", "predictor"])


def centred(sums: DataFrame) -> DataFrame:
    """Central sums u = x - mean(x), v = y - mean(y); NULL where x has no spread."""
    c = F.col
    mx, my = c("sx") / c("n"), c("sy") / c("n")
    out = sums.withColumns({"mx": mx, "my": my})
    mx, my = c("mx"), c("my")
    out = out.withColumns({
        "uu": c("sx2") - c("n") * mx * mx,
        "u3": c("sx3") - 3 * mx * c("sx2") + 2 * c("n") * mx * mx * mx,
        "u4": c("sx4") - 4 * mx * c("sx3") + 6 * mx * mx * c("sx2") - 3 * c("n") * F.pow(mx, 4),
        "uv": c("sxy") - mx * c("sy"),
        "vv": F.greatest(c("sy2") - my * c("sy"), F.lit(0.0)),
    })
    # what rounding leaves of a constant x is no spread
    noise = F.greatest(_FLAT * c("sx2"), c("n") * F.pow(_FLAT * c("x0"), F.lit(2)))
    out = out.withColumn("uu", F.when(c("uu") > noise, c("uu")))
    u2v = c("sx2y") - 2 * mx * c("sxy") + mx * mx * c("sy") - my * c("uu")
    q2 = c("u4") - c("uu") * c("uu") / c("n") - c("u3") * c("u3") / c("uu")
    return out.withColumns({"u2v": u2v, "q2": F.when(q2 > 1e-10 * c("u4"), q2)})


def aicc(n: Column, rss: Column, coefficients: int) -> Column:
    """Small-sample Akaike criterion of a Gaussian fit; the variance counts as a parameter."""
    k = coefficients + 1
    base = n * F.ln(F.try_divide(rss, n)) + n * (1 + math.log(2 * math.pi)) + 2 * k
    return base + F.try_divide(F.lit(2.0 * k * (k + 1)), n - k - 1)


def _fit_quality(fits: DataFrame, coefficients: int) -> DataFrame:
    c = F.col
    df = c("n") - coefficients
    usable = c("rss").isNotNull() & (df > 0)
    out = fits.withColumn("rss", F.when(usable, F.greatest(c("rss"), F.lit(0.0))))
    r2 = 1 - F.try_divide(c("rss"), c("vv"))
    return out.withColumns({
        "df": df,
        "sigma2": F.when(usable, F.try_divide(c("rss"), df)),
        "r2": r2,
        "adj_r2": 1 - (1 - r2) * F.try_divide(c("n") - 1, df),
        "aicc": aicc(c("n"), c("rss"), coefficients),
    })


def linear_fits(sums: DataFrame) -> DataFrame:
    """``y ~ x`` per row of power sums: coefficients in original units, errors, t, R2, AICc."""
    c = F.col
    fits = centred(sums).withColumn("slope", F.try_divide(c("uv"), c("uu")))
    fits = _fit_quality(fits.withColumn("rss", c("vv") - c("slope") * c("uv")), 2)
    xbar, ybar = c("mx") + c("x0"), c("my") + c("y0")
    fits = fits.withColumns({
        "intercept": ybar - c("slope") * xbar,
        "se_slope": F.sqrt(c("sigma2") / c("uu")),
        "se_intercept": F.sqrt(c("sigma2") * (1 / c("n") + xbar * xbar / c("uu"))),
    })
    return fits.withColumns({
        "t_slope": F.try_divide(c("slope"), c("se_slope")),
        "t_intercept": F.try_divide(c("intercept"), c("se_intercept")),
    })


def quadratic_fits(sums: DataFrame) -> DataFrame:
    """``y ~ poly(x, 2)`` per row of power sums.

    ``c1`` and ``c2`` belong to the orthonormal linear and quadratic terms, with one residual
    standard error for both. The same curve is ``b0 + b1*u + b2*u*u`` with ``u = x - xbar``.
    """
    c = F.col
    fits = centred(sums).withColumns({
        "c1": c("uv") / F.sqrt("uu"),
        "c2": (c("u2v") - c("u3") / c("uu") * c("uv")) / F.sqrt("q2"),
    })
    fits = _fit_quality(
        fits.withColumn("rss", c("vv") - c("c1") * c("c1") - c("c2") * c("c2")), 3
    )
    return fits.withColumns({
        "t_linear": F.try_divide(c("c1"), F.sqrt("sigma2")),
        "t_quadratic": F.try_divide(c("c2"), F.sqrt("sigma2")),
        "b2": c("c2") / F.sqrt("q2"),
        "xbar": c("mx") + c("x0"),
    }).withColumns({
        "b1": c("uv") / c("uu") - c("b2") * c("u3") / c("uu"),
        "b0": c("my") + c("y0") - c("b2") * c("uu") / c("n"),
    })


def model_table(
    df: DataFrame, responses: Sequence[str], predictors: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Both model forms for every response and predictor, ranked by AICc within the response.

    ``t`` and ``p`` are those of the highest-order term. The ranking group holds two rows per
    predictor.
    """
    keys = [*by, "response", "predictor"]
    c = F.col
    fits = quadratic_fits(fit_sums(df, responses, predictors, by))
    fits = fits.withColumns({"df_line": c("n") - 2, "rss_line": c("vv") - c("c1") * c("c1")})
    usable = c("uu").isNotNull() & (c("df_line") > 0)
    fits = fits.withColumn("rss_line", F.when(usable, F.greatest(c("rss_line"), F.lit(0.0))))
    line = F.struct(
        F.lit("Linear").alias("reg_type"),
        aicc(c("n"), c("rss_line"), 2).alias("aicc"),
        (1 - F.try_divide(c("rss_line"), c("vv"))).alias("r2"),
        c("df_line").alias("df"),
        F.try_divide(c("c1"), F.sqrt(F.try_divide(c("rss_line"), c("df_line")))).alias("t"),
    )
    bend = F.struct(
        F.lit("Polynomial").alias("reg_type"), "aicc", "r2", "df", c("t_quadratic").alias("t")
    )
    both = fits.select(*keys, F.inline(F.array(line, bend)))
    return delta_aicc(both, [*by, "response"]).withColumn(
        "p", tails.t_two_sided(F.col("t"), F.col("df"))
    )


def delta_aicc(models: DataFrame, keys: Sequence[str], name: str = "del_aicc") -> DataFrame:
    """Distance of each model's AICc from the best one of its group."""
    best = F.min("aicc").over(Window.partitionBy(*keys))
    return models.withColumn(name, F.col("aicc") - best)


def best_models(models: DataFrame, within: float = 2.0, name: str = "del_aicc") -> DataFrame:
    return models.filter(F.col(name) <= within)


def with_residuals(
    df: DataFrame,
    responses: Mapping[str, str],
    predictor: str,
    degree: int = 1,
    by: Sequence[str] = (),
) -> DataFrame:
    """Residuals of several responses from their fits on one predictor, in one pass of fits.

    ``responses`` maps a response to the name of its residual; a residual is NULL where x or y is
    missing. All fits of a group travel as one struct.
    """
    x = F.col(predictor).cast("double")
    if degree == 1:
        line = lambda y: F.struct(
            F.regr_intercept(y, x).alias("b0"), F.regr_slope(y, x).alias("b1")
        )
        fits = df.groupBy(*by).agg(
            *[line(F.col(y).cast("double")).alias(name) for y, name in responses.items()]
        )
        curve = lambda f: f["b0"] + f["b1"] * x
    else:
        rows = quadratic_fits(fit_sums(df, list(responses), [predictor], by))
        fit = F.struct("b0", "b1", "b2", "xbar")
        fits = rows.groupBy(*by).agg(
            *[F.max(F.when(F.col("response") == y, fit)).alias(name) for y, name in responses.items()]
        )
        curve = lambda f: (
            f["b0"] + f["b1"] * (x - f["xbar"]) + f["b2"] * F.pow(x - f["xbar"], 2)
        )
    if by:
        packed = fits.select(*by, F.struct(*responses.values()).alias("__fit"))
        joined = keyed_join(df, packed, by, "left")
    else:
        joined = attach(df, fits, "__fit")
    return joined.withColumns({
        name: F.col(y).cast("double") - curve(F.col("__fit")[name])
        for y, name in responses.items()
    }).drop("__fit")


def chosen_residuals(
    df: DataFrame,
    responses: Mapping[str, str],
    predictor: str,
    bent: Mapping[str, Column],
    by: Sequence[str] = (),
) -> DataFrame:
    """Residuals as ``with_residuals``, from lines and quadratic curves side by side.

    ``bent`` maps a response to the condition on a row (a subgroup, say) under which its residual is
    the one from the curve; it is the one from the line elsewhere and where the condition is unknown.
    """
    out = with_residuals(df, responses, predictor, 1, by)
    curves = {y: f"__bent_{responses[y]}" for y in bent}
    if not curves:
        return out
    out = with_residuals(out, curves, predictor, 2, by)
    return out.withColumns({
        responses[y]: F.when(rule, F.col(curves[y])).otherwise(F.col(responses[y])) for y, rule in bent.items()
    }).drop(*curves.values())


def sequential_anova(df: DataFrame, response: str, predictor: str, by: Sequence[str] = ()):
    """Type I table of the orthogonal linear and quadratic terms: SS, F and p of each."""
    keys = [*by, "response", "predictor"]
    fits = quadratic_fits(fit_sums(df, [response], [predictor], by))
    term = lambda label, ss: F.struct(
        F.lit(label).alias("term"), F.lit(1.0).alias("df_term"), ss.alias("ss")
    )
    rows = F.array(
        term("linear", F.pow("c1", F.lit(2))), term("quadratic", F.pow("c2", F.lit(2)))
    )
    out = fits.select(*keys, F.col("df").alias("df_residual"), "sigma2", F.inline(rows))
    return _with_f(out)


def _with_f(terms: DataFrame) -> DataFrame:
    c = F.col
    out = terms.withColumn("f", F.try_divide(c("ss") / c("df_term"), c("sigma2"))).drop("sigma2")
    return out.withColumn("p", tails.f_upper(c("f"), c("df_term"), c("df_residual")))


def level_slopes(
    df: DataFrame, response: str, predictor: str, group: str, reference: object
) -> DataFrame:
    """Interaction model ``y ~ x * group``: per-level lines and contrasts with a reference level.

    All levels share one residual variance; each contrast is a difference from the reference,
    with its standard error, t and p.
    """
    c = F.col
    levels = linear_fits(fit_sums(df, [response], [predictor], [group]))
    # a level without spread has a mean but no slope: it takes one degree of freedom, not two
    explained = F.coalesce(c("slope") * c("uv"), F.lit(0.0))
    rank = 1 + c("slope").isNotNull().cast("int")
    pooled = levels.agg(
        F.sum(F.greatest(c("vv") - explained, F.lit(0.0))).alias("rss"),
        (F.sum("n") - F.sum(rank)).alias("df"),
    )
    xbar = c("mx") + c("x0")
    levels = levels.select(
        group, "n", "intercept", "slope",
        (1 / c("n") + xbar * xbar / c("uu")).alias("v_intercept"),
        (1 / c("uu")).alias("v_slope"),
    )
    parts = ["intercept", "slope", "v_intercept", "v_slope"]
    first = levels.filter(c(group) == reference).agg(*[F.max(p).alias(p) for p in parts])
    out = attach(attach(levels, pooled, "__pooled"), first, "__base")
    base, is_base = c("__base"), c(group) == reference
    sigma2 = c("__pooled.rss") / c("__pooled.df")
    out = out.select(
        group, "n", "intercept", "slope", c("__pooled.df").alias("df"),
        F.when(is_base, c("intercept")).otherwise(c("intercept") - base["intercept"])
        .alias("contrast_intercept"),
        F.when(is_base, c("slope")).otherwise(c("slope") - base["slope"]).alias("contrast_slope"),
        F.sqrt(sigma2 * (c("v_intercept") + F.when(is_base, 0.0).otherwise(base["v_intercept"])))
        .alias("se_intercept"),
        F.sqrt(sigma2 * (c("v_slope") + F.when(is_base, 0.0).otherwise(base["v_slope"])))
        .alias("se_slope"),
    )
    out = out.withColumns({
        "t_intercept": F.try_divide(c("contrast_intercept"), c("se_intercept")),
        "t_slope": F.try_divide(c("contrast_slope"), c("se_slope")),
    })
    return out.withColumns({
        "p_intercept": tails.t_two_sided(c("t_intercept"), c("df")),
        "p_slope": tails.t_two_sided(c("t_slope"), c("df")),
    })


def interaction_anova(
    df: DataFrame, response: str, predictor: str, group: str, degree: int = 1
) -> DataFrame:
    """Type I table of ``y ~ x * group`` (or ``poly(x, 2) * group``): x, group, x:group.

    Residual sums of squares of the nested models all come from the per-level power sums: pooled
    over levels for x, within levels for x + group, per level for the full model.
    """
    c, keys = F.col, ["response", "predictor"]
    levels = fit_sums(df, [response], [predictor], [group])
    merged = pool(levels, keys)
    fit = linear_fits if degree == 1 else quadratic_fits
    p = degree + 1
    own = fit(levels)
    # a level that cannot carry its own curve contributes only the terms it can
    line = F.when(c("uu").isNotNull(), c("uv") * c("uv") / c("uu")).otherwise(0.0)
    bend = F.when(c("q2").isNotNull(), F.pow(c("u2v") - c("u3") / c("uu") * c("uv"), F.lit(2)) / c("q2")).otherwise(0.0)
    rank = 1 + c("uu").isNotNull().cast("int")
    explained = line
    if degree == 2:
        explained, rank = line + bend, rank + c("q2").isNotNull().cast("int")
    square = c("u4") - c("uu") * c("uu") / c("n")
    # common-slope terms need x and x squared about one origin: x^2 - mean = u^2 + 2 m u - uu/n
    own = keyed_join(own, merged.select(*keys, c("x0").alias("__origin")), keys)
    own = own.withColumn("mx", c("mx") + c("x0") - c("__origin"))
    own = own.withColumns({
        "w11": F.coalesce(c("uu"), F.lit(0.0)),
        "w12": F.coalesce(c("u3") + 2 * c("mx") * c("uu"), F.lit(0.0)),
        "w22": F.coalesce(square + 4 * c("mx") * c("u3") + 4 * c("mx") * c("mx") * c("uu"), F.lit(0.0)),
        "w1y": F.coalesce(c("uv"), F.lit(0.0)),
        "w2y": F.coalesce(c("u2v") + 2 * c("mx") * c("uv"), F.lit(0.0)),
        "rss_own": c("vv") - explained,
        "rank_own": rank,
    })
    within = own.groupBy(*keys).agg(
        F.count("*").alias("levels"), F.sum("vv").alias("ssw"), F.sum("rank_own").alias("rank"),
        F.sum("rss_own").alias("rss_full"), F.sum("n").alias("total"),
        *[F.sum(w).alias(w) for w in ("w11", "w12", "w22", "w1y", "w2y")],
    )
    if degree == 1:
        common = F.try_divide(c("w1y") * c("w1y"), c("w11"))
    else:
        det = c("w11") * c("w22") - c("w12") * c("w12")
        quad = c("w1y") * c("w1y") * c("w22") - 2 * c("w1y") * c("w2y") * c("w12") + c("w2y") * c("w2y") * c("w11")
        common = F.try_divide(quad, det)
    overall = fit(merged).select(*keys, c("vv").alias("tss"), c("rss").alias("rss_x"))
    all_ = within.join(overall, keys).withColumns({
        "rss_xg": c("ssw") - common,
        "sigma2": F.try_divide(c("rss_full"), c("total") - c("rank")),
        "df_residual": c("total") - c("rank"),
    })
    term = lambda label, dof, ss: F.struct(
        F.lit(label).alias("term"), dof.cast("double").alias("df_term"), ss.alias("ss")
    )
    rows = F.array(
        term("x", F.lit(degree), c("tss") - c("rss_x")),
        term("group", c("levels") - 1, c("rss_x") - c("rss_xg")),
        term("x:group", c("rank") - c("levels") - degree, c("rss_xg") - c("rss_full")),
    )
    return _with_f(all_.select("df_residual", "sigma2", F.inline(rows)))


def trait_regressions(
    df: DataFrame, entity: str, response: str, predictor: str, degree: int
) -> DataFrame:
    """One fit per entity: p of the linear and quadratic terms, R2 and adjusted R2."""
    sums = fit_sums(df, [response], [predictor], [entity])
    if degree == 1:
        fits = linear_fits(sums).withColumns({"t1": F.col("t_slope"), "t2": F.lit(None).cast("double")})
    else:
        fits = quadratic_fits(sums).withColumns({"t1": F.col("t_linear"), "t2": F.col("t_quadratic")})
    return fits.select(
        entity, F.col("predictor").alias("parameter"),
        tails.t_two_sided(F.col("t1"), F.col("df")).alias("pvalue1"),
        tails.t_two_sided(F.col("t2"), F.col("df")).alias("pvalue2"),
        F.col("r2").alias("r_squared"), F.col("adj_r2").alias("adj_r_squared"),
    )


def entity_regressions(df: DataFrame, entity: str, response: str, predictor: str) -> DataFrame:
    """Line and quadratic curve of every entity from the same sums, side by side.

    ``form`` is the one with the smaller AICc (the line, if they tie or there is no curve), NULL where
    there is no fit: too few places, or no spread in the predictor. ``pvalue`` is the p of its highest
    term, ``r_squared`` its share of the variance.
    """
    c = F.col
    sums = fit_sums(df, [response], [predictor], [entity])
    line = linear_fits(sums).select(
        entity, "n", "slope", c("aicc").alias("__a1"), c("r2").alias("r2_line"),
        tails.t_two_sided(c("t_slope"), c("df")).alias("p_line"),
    )
    curve = quadratic_fits(sums).select(
        entity, c("aicc").alias("__a2"), c("r2").alias("r2_curve"),
        tails.t_two_sided(c("t_linear"), c("df")).alias("p_curve_linear"),
        tails.t_two_sided(c("t_quadratic"), c("df")).alias("p_curve_quadratic"),
    )
    both = keyed_join(line, curve, [entity])
    bends = c("__a2").isNotNull() & F.coalesce(c("__a2") < c("__a1"), F.lit(False))
    form = F.when(bends, F.lit("Polynomial")).when(c("__a1").isNotNull(), F.lit("Linear"))
    pick = lambda a, b: F.when(bends, c(a)).when(c("__a1").isNotNull(), c(b))
    return both.withColumns({
        "parameter": F.lit(predictor), "form": form,
        "pvalue": pick("p_curve_quadratic", "p_line"), "r_squared": pick("r2_curve", "r2_line"),
    }).drop("__a1", "__a2")


def significant(tables: DataFrame, below: float = 0.07) -> DataFrame:
    return tables.filter((F.col("pvalue1") < below) | (F.col("pvalue2") < below))


def fitted_curve(
    df: DataFrame,
    response: str,
    predictor: str,
    degree: int = 1,
    by: Sequence[str] = (),
    points: int = 80,
    level: float = 0.95,
) -> DataFrame:
    """Fitted line and its confidence band on an even grid over each group's range of x.

    A fixed number of grid points is unpacked per fit row; one batch of t quantiles per batch of
    fits gives the band.
    """
    c = F.col
    pairs = paired(df, [response], [predictor], by)
    keys = [*by, "response", "predictor"]
    ends = pairs.groupBy(*keys).agg(F.min("x").alias("lo_x"), F.max("x").alias("hi_x"))
    sums = power_sums(pairs, keys)
    fits = linear_fits(sums) if degree == 1 else quadratic_fits(sums)
    fits = fits.withColumn("t_crit", tails.t_quantile(level, c("df")))
    fits = keyed_join(fits, ends, keys).withColumn(
        "step", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    )
    x = c("lo_x") + (c("hi_x") - c("lo_x")) * c("step") / float(points - 1)
    fits = fits.withColumn("u", x - c("mx"))
    lever = 1 / c("n") + c("u") * c("u") / c("uu")
    if degree == 1:
        fit = c("my") + c("y0") + c("slope") * c("u")
    else:
        fit = c("b0") + c("b1") * c("u") + c("b2") * c("u") * c("u")
        bend = c("u") * c("u") - c("uu") / c("n") - c("u3") / c("uu") * c("u")
        lever = lever + bend * bend / c("q2")
    out = fits.select(
        *by, "step", (c("u") + c("mx") + c("x0")).alias("x"), fit.alias("fit"),
        F.sqrt(c("sigma2") * lever).alias("se"), "t_crit",
    )
    return out.withColumns({
        "lo": c("fit") - c("t_crit") * c("se"), "hi": c("fit") + c("t_crit") * c("se")
    }).drop("t_crit")
