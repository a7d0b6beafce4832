"""Table readers and writers: Parquet, CSV (with and without a row-name column) and KML polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CSV_OPTIONS = {
    "header": True,
    "nullValue": "NA",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": True,
    "ignoreTrailingWhiteSpace": True,
}

_RING = "struct<LinearRing: struct<coordinates: string>>"
_KML_SCHEMA = (
    f"name string, Polygon struct<outerBoundaryIs: {_RING}, innerBoundaryIs: array<{_RING}>>"
)


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, date_format: str = "M/d/yyyy"
) -> DataFrame:
    """CSV scan with an explicit schema; blank and ``NA`` are NULL, NaN is scrubbed to NULL.

    Columns are taken by position, so the unnamed first column of a file written with row names
    is simply the first field of ``schema``.
    """
    df = spark.read.options(**CSV_OPTIONS, dateFormat=date_format).schema(schema).csv(path)
    return scrub_nan(df)


def write_csv(df: DataFrame, path: str, row_key: str | None = None) -> None:
    """CSV sink; ``row_key`` becomes the leading column with an empty header (row names)."""
    if row_key is not None:
        df = df.select(F.col(row_key).alias(""), *[c for c in df.columns if c != row_key])
    df.write.mode("errorifexists").options(header=True, nullValue="NA", escape='"').csv(path)


def scrub_nan(df: DataFrame) -> DataFrame:
    """NaN would win ``max`` and poison ``avg``; missing values are NULL everywhere."""
    nan = F.lit(float("nan"))
    return df.select(
        *[
            F.nullif(F.col(f.name), nan).alias(f.name, metadata=f.metadata)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """KML placemarks as vertices ``(poly_id, ring, seq, lon, lat)``; altitude is dropped.

    Ring 0 is the outer boundary, the others are holes.
    """
    placemarks = (
        spark.read.format("xml").option("rowTag", "Placemark").schema(_KML_SCHEMA).load(path)
    )
    outer = F.array("Polygon.outerBoundaryIs.LinearRing.coordinates")
    inner = F.col("Polygon.innerBoundaryIs.LinearRing.coordinates")
    every = F.concat(outer, F.coalesce(inner, F.array().cast("array<string>")))
    rings = placemarks.select(F.col("name").alias("poly_id"), F.posexplode(every).alias("ring", "text"))
    vertices = rings.select("poly_id", "ring", F.posexplode(F.split(F.trim("text"), r"\s+")))
    part = F.split("col", ",")
    return vertices.select(
        "poly_id",
        "ring",
        F.col("pos").alias("seq"),
        F.get(part, F.lit(0)).try_cast("double").alias("lon"),
        F.get(part, F.lit(1)).try_cast("double").alias("lat"),
    )


def write_polygons(rings: DataFrame, path: str) -> None:
    """KML placemarks from ``(name, corners)``, corners as ``lon,lat,alt`` triples in order."""
    ring = F.struct(F.struct(F.struct(F.col("corners").alias("coordinates")).alias("LinearRing"))
                    .alias("outerBoundaryIs"))
    writer = rings.select("name", ring.alias("Polygon")).write.format("xml")
    writer.options(rootTag="Document", rowTag="Placemark").save(path)
