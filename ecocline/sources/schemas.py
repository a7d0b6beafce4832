"""Entity schemas, with units and descriptions carried as column metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, D, L, DATE = T.StringType(), T.DoubleType(), T.LongType(), T.DateType()


def field(name: str, kind: T.DataType, unit: str | None = None, about: str | None = None):
    metadata = {k: v for k, v in (("unit", unit), ("description", about)) if v is not None}
    return T.StructField(name, kind, True, metadata)


PARAMETERS = [
    "salinity", "temperature", "ta", "ph", "phosphate", "silicate", "nitrate_nitrite", "ammonia",
    "m_c", "hix", "visible_humidic", "tryptophan", "tyrosine",
]

SUBSTRATES = ["live_coral", "dead_coral", "rubble", "sand"]
CHAINS = ["chain1", "chain2", "chain3"]

CHEM_SAMPLES = T.StructType(
    [field("location", S), field("lat", D), field("lon", D), field("site", S)]
    + [field("tide", S), field("day_night", S)]
    + [field(p, D) for p in PARAMETERS]
)

CHEM_CV = T.StructType(
    [field("location", S), field("site", S)] + [field(p, D, "%") for p in PARAMETERS]
)

SUBSTRATE = T.StructType(
    [field("location", S), field("site", S), field("date", DATE)]
    + [field(c, L, "points") for c in SUBSTRATES]
)

SURVEY_META = T.StructType(
    [field("location", S), field("site", S), field("alpha_tag", S), field("date", DATE)]
    + [field("time_start", S), field("time_end", S), field("photo_id", S)]
    + [field(c, D, "m") for c in CHAINS]
    + [field("lat", D), field("lon", D), field("other_notes", S), field("conditions", S)]
)

SITE_META = T.StructType(
    [
        field("location", S, None, "Survey location"),
        field("site", S, None, "Survey site identifier"),
        field("alpha_tag", S, None, "Site letter in order of distance from the point source"),
        field("live_coral", D, "%", "Share of substrate points on live coral"),
        field("dead_coral", D, "%", "Share of substrate points on dead coral"),
        field("rubble", D, "%", "Share of substrate points on rubble"),
        field("sand", D, "%", "Share of substrate points on sand"),
        field("lat", D, "degree", "Latitude of the site"),
        field("lon", D, "degree", "Longitude of the site"),
        field("mean_rugosity", D, "unitless", "Mean chain length over straight length, 1 is flat"),
        field("complexity", D, "unitless", "One minus mean rugosity"),
    ]
)

TAXA = T.StructType(
    [
        field(c, S)
        for c in (
            "taxa genus family taxon_group identified morphology morph2 calcification calc "
            "energetic_resource er identification_notes observation_notes"
        ).split()
    ]
)

TAXA_FE = T.StructType([field(c, S) for c in "taxa taxon_group morph2 calc er fe".split()])

COUNTS = T.StructType(
    [field("location", S), field("site", S), field("taxa", S), field("species_counts", L)]
)

FE_COORD = T.StructType([field("fe", S)] + [field(f"pc{i}", D) for i in range(1, 5)])

DIVERSITY = T.StructType(
    [field("site", S), field("nb_sp", L), field("nb_sp_p", D, "%"), field("nb_fes", L)]
    + [field("nb_fes_p", D, "%"), field("vol", D, "%")]
    + [field(c, D) for c in ("res_sp", "res_spp", "res_fe", "res_fep", "res_vol")]
)

MODEL_TABLE = T.StructType(
    [field("y", S), field("parameter", S), field("reg_type", S)]
    + [field(c, D) for c in ("aicc", "r2", "p", "del_aicc")]
)

TAXA_LITERATURE = T.StructType(
    [
        field(c, S)
        for c in (
            "taxa fe phyla morphology calcification energetic_resource lit_identification "
            "lit_phyla lit_morphology lit_calcification lit_energetic_resource source "
            "identification_notes"
        ).split()
    ]
)

FUNCTIONAL_GROUPS = T.StructType(
    [field(c, S) for c in "morphology phyla calcification trophic_group".split()]
)


def describe_columns(df: DataFrame, units: dict[str, str], about: dict[str, str]) -> DataFrame:
    """Attach units and descriptions to columns as schema metadata."""
    for name in df.columns:
        metadata = {}
        if name in units:
            metadata["unit"] = units[name]
        if name in about:
            metadata["description"] = about[name]
        if metadata:
            df = df.withMetadata(name, metadata)
    return df


def data_dictionary(df: DataFrame) -> DataFrame:
    """``(attribute, units, description, n_values)`` of a table, generated from its schema.

    One pass counts the non-null values of every column; the dictionary rows come out of that
    single aggregate row, so nothing but the schema is read on the driver.
    """
    entry = lambda f: F.struct(
        F.lit(f.name).alias("attribute"),
        F.lit(f.metadata.get("unit")).cast("string").alias("units"),
        F.lit(f.metadata.get("description")).cast("string").alias("description"),
        F.count(f.name).alias("n_values"),
    )
    return df.agg(F.array(*[entry(f) for f in df.schema.fields]).alias("d")).select(F.inline("d"))
