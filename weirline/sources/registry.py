"""Registry readers: attribute tables -> the typed ``dams`` rows.

The registry ships as two layers with the same attributes: barriers (points)
and reservoirs (polygons, stored by their area centroid).  Both go through the
one mapping below; only the geometry expression differs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirline.functions import clean, geo
from weirline.schemas import DAMS_DECIMALS, METADATA_SOURCE_FIELDS


# Registry measure columns of ``dams`` and their source attribute.
REGISTRY_MEASURES = {
    "height_meters": "DAM_HGT_M",
    "length_meters": "DAM_LEN_M",
    "elevation_masl": "ELEV_MASL",
    "normal_capacity_mcm": "CAP_MCM",
    "catchment_area_km2": "CATCH_SKM",
    "reservoir_surface_area_km2": "AREA_SKM",
    "installed_capacity_mw": "POWER_MW",
}


def map_registry(raw: DataFrame, geometry: Column, *, id_prefix: str, source: str,
                 loaded_at: str) -> DataFrame:
    """Map one registry layer to the ``dams`` columns.

    Two projections: the first parses every numeric text once, the second
    applies the rules to the parsed values (a rule such as "NULL unless >= 0"
    reads its input twice, and an unparsed input would be parsed twice).
    ``loaded_at`` is the load timestamp (``created_at``/``updated_at``/
    ``last_verified``); it is a parameter so that reruns give identical rows.
    """
    parsed = raw.select(
        "GDW_ID", "DAM_NAME", "RES_NAME", "ALT_NAME", "NEAR_CITY", "COUNTRY", "ADMIN_UNIT", "MAIN_USE",
        geometry.alias("_geom"),
        *[clean.parse_number(src).alias(f"_n_{dst}") for dst, src in REGISTRY_MEASURES.items()],
        clean.parse_integer("YEAR_DAM").alias("_year"),
        clean.parse_integer("QUALITY").alias("_quality"),
    )
    ts = F.lit(loaded_at).cast("timestamp_ntz")
    measure = {dst: clean.nonneg(f"_n_{dst}").cast(DAMS_DECIMALS[dst]).alias(dst) for dst in REGISTRY_MEASURES}
    return parsed.select(
        F.concat(F.lit(id_prefix), F.col("GDW_ID").cast("string")).alias("dam_id"),
        F.col("GDW_ID").cast("bigint").alias("gdw_id"),
        F.lit(source).alias("source"),
        clean.display_name("DAM_NAME", "RES_NAME", "ALT_NAME", "NEAR_CITY").alias("dam_name"),
        F.lit(None).cast(T.ArrayType(T.StringType())).alias("alternative_names"),
        clean.country_code("COUNTRY").alias("country_code"),
        F.col("ADMIN_UNIT").alias("province_state"),
        F.col("NEAR_CITY").alias("nearest_city"),
        F.col("_geom").alias("coordinates"),
        clean.year_between("_year", clean.REGISTRY_YEAR_MIN, clean.REGISTRY_YEAR_MAX).alias("construction_year"),
        measure["height_meters"], measure["length_meters"], measure["elevation_masl"],
        F.col("RES_NAME").alias("reservoir_name"),
        measure["normal_capacity_mcm"], measure["catchment_area_km2"], measure["reservoir_surface_area_km2"],
        F.col("MAIN_USE").alias("primary_purpose"),
        measure["installed_capacity_mw"],
        clean.score_from_code("_quality").alias("data_quality_score"),
        ts.alias("last_verified"),
        ts.alias("created_at"),
        ts.alias("updated_at"),
    )


def load_barriers(raw: DataFrame, loaded_at: str) -> DataFrame:
    """Barrier layer: the geometry column holds a WKT point."""
    return map_registry(raw, geo.point_from_wkt(F.col("geometry")), id_prefix="B",
                        source="barrier", loaded_at=loaded_at)


def load_reservoirs(raw: DataFrame, loaded_at: str) -> DataFrame:
    """Reservoir layer: the WKT polygon is replaced by its area centroid."""
    staged = geo.with_polygon_centroid(raw, "geometry", "_centroid")
    return map_registry(staged, F.col("_centroid"), id_prefix="R", source="reservoir", loaded_at=loaded_at)


def registry_append(*layers: DataFrame) -> DataFrame:
    """Bag union of the mapped layers (duplicates kept, as two appends do)."""
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer)
    return out


def read_metadata_csv(spark: SparkSession, path: str, null_tokens=None, embedded_newlines: bool = False) -> DataFrame:
    """Read the registry metadata CSV: header, UTF-8, every column as text.

    The names come from the first line alone, and no types are inferred.  A file is
    split among tasks unless ``embedded_newlines`` says that quoted fields hold line
    ends; one task then reads a whole file.  Reader-level missing tokens are turned
    into NULL explicitly, which is what the original pandas reader does implicitly.
    """
    options = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8", "multiLine": embedded_newlines}
    names = spark.read.options(**options).option("inferSchema", False).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in names])
    df = spark.read.schema(schema).options(**options).option("nullValue", None).option("emptyValue", "").csv(path)
    df = df.select(*[clean.reader_nulls(F.col(c), null_tokens).alias(c) for c in df.columns])
    if "GDW_ID" in df.columns:
        df = df.withColumn("GDW_ID", clean.parse_integer("GDW_ID"))
    return df
