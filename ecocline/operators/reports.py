"""Publication tables: rounded model tables, gradient tables, taxon and trait catalogues."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ecocline.functions.scalar import (
    recode, replace_matching, round_r2, separate, signif, standard_error, unite,
)
from ecocline.operators.ordering import level_order
from ecocline.operators.summaries import with_group_stats

# Full names of the trait codes and the published predictor order.
MORPHOLOGY = {
    "Br": "Branching", "Dig": "Digitate", "Fol": "Foliose", "Stol": "Stolonial",
    "Mush": "Mushroom", "Poly": "Polypoid", "Mas": "Massive", "Enc": "Encrusting",
    "Sph": "Spherical", "Fil": "Filamentous",
}
CALCIFICATION = {
    "NC": "Non-calcifying", "AC": "Articulated", "Non-AC": "Non-articulated", "Herm": "Hermatypic"
}
ENERGY = {"Auto": "Autotroph", "Het": "Heterotroph", "Mix": "Mixotroph"}
TROPHIC_GROUPS = {
    "Autotrophy": "Autotrophy (Auto)", "Heterotrophy": "Heterotrophy (Het)",
    "Mixotrophy": "Mixotrophy (Mix)",
}


def model_report(
    models: DataFrame,
    sections: Mapping[str, str],
    parameter_names: Mapping[str, str],
    response: str = "response",
    predictor: str = "predictor",
) -> DataFrame:
    """Rounded model table of the responses in ``sections``, in section order and by AICc."""
    c = F.col
    rounded = models.filter(c(response).isin(*sections)).select(
        recode(response, sections).alias("section"),
        level_order(c(response), list(sections)).alias("section_ord"),
        *separate(recode(predictor, parameter_names), " +", ["parameter"]),
        c("reg_type").alias("regression"),
        F.bround("aicc", 1).alias("aicc"),
        round_r2("r2").alias("r2"),
        signif("p", 2).alias("p"),
        F.bround("del_aicc", 1).alias("delta_aicc"),
    )
    return rounded.orderBy(
        F.asc_nulls_last("section_ord"), F.asc_nulls_last("delta_aicc"), "parameter", "regression"
    )


def report_tables(
    models: DataFrame,
    tables: Mapping[str, Mapping[str, str]],
    parameter_names: Mapping[str, str],
    by: Sequence[str] = (),
    response: str = "response",
    predictor: str = "predictor",
) -> DataFrame:
    """Model tables as they are published: one per group of ``by`` and title, packed into sections.

    ``tables`` maps a title (raw, residuals) to its sections, and those map a response to its heading.
    ``row`` counts the rows of a published table from 1, so that a section is its smallest to largest
    row; a table holds two rows per response and predictor. Within a section rows go by rounded AICc
    difference, then by published parameter order (the order of ``parameter_names``), then by form.
    """
    c = F.col
    sections = {y: heading for held in tables.values() for y, heading in held.items()}
    titles = {y: title for title, held in tables.items() for y in held}
    rounded = models.filter(c(response).isin(*sections)).select(
        *by,
        recode(response, titles).alias("report"),
        recode(response, sections).alias("section"),
        level_order(c(response), list(sections)).alias("__section"),
        level_order(c(predictor), list(parameter_names)).alias("__parameter"),
        *separate(recode(predictor, parameter_names), " +", ["parameter"]),
        c("reg_type").alias("regression"),
        F.bround("aicc", 1).alias("aicc"),
        round_r2("r2").alias("r2"),
        signif("p", 2).alias("p"),
        F.bround("del_aicc", 1).alias("delta_aicc"),
    )
    inside = Window.partitionBy(*by, "report").orderBy(
        "__section", F.asc_nulls_last("delta_aicc"), F.asc_nulls_last("__parameter"), "parameter", "regression"
    )
    return rounded.withColumn("row", F.row_number().over(inside)).drop("__section", "__parameter")


def gradient_table(
    variability: DataFrame, group: Column, parameter: str, value: str, names: Mapping[str, str]
) -> DataFrame:
    """Long variability table with the mean and standard error of its group and parameter."""
    tagged = variability.withColumn("group", group)
    stats = {"cv_mean": F.avg(value), "se": standard_error(value)}
    out = with_group_stats(tagged, ["group", parameter], stats)
    return out.withColumn(parameter, recode(parameter, names))


def taxon_catalogue(
    literature: DataFrame,
    taxa: DataFrame,
    taxon: str,
    sources: Sequence[str],
    renames: Mapping[str, str],
    spellings: Mapping[str, str] | None = None,
) -> DataFrame:
    """Surveyed taxa with their traits in full words and all sources joined into one field."""
    for pattern, value in (spellings or {}).items():
        literature = literature.withColumns(
            {s: replace_matching(s, pattern, value) for s in sources}
        )
    out = literature.join(taxa.select(taxon).distinct(), taxon, "right")
    source = unite(sources, ", ", drop_null=True)
    out = out.withColumn("source", F.when(source == "", " ").otherwise(source)).drop(*sources)
    codes = {"morphology": MORPHOLOGY, "calcification": CALCIFICATION, "energetic_resource": ENERGY}
    out = out.withColumns({k: recode(k, v) for k, v in codes.items() if k in out.columns})
    return out.withColumn(taxon, recode(taxon, renames))


def trait_catalogue(groups: DataFrame) -> DataFrame:
    """Functional-group catalogue: blanks for missing cells, trophic groups with their code."""
    filled = groups.fillna(" ", subset=[c for c in groups.columns if c != "morphology"])
    return filled.withColumn("trophic_group", recode("trophic_group", TROPHIC_GROUPS))
