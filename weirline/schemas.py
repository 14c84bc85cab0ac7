"""Table shapes: the metadata field map and the stored column types."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Metadata source field -> enrichment column (selection order).
# ---------------------------------------------------------------------------
METADATA_SOURCE_FIELDS = {
    "GDW_ID": "gdw_id",
    "DAM_NAME": "dam_name_gdw",
    "ALT_NAME": "alternative_name",
    "RES_NAME": "reservoir_name",
    "DAM_TYPE": "dam_type",
    "DAM_HGT_M": "height_meters_gdw",
    "DAM_LEN_M": "dam_length_meters",
    "CAP_MCM": "capacity_mcm_gdw",
    "AREA_SKM": "reservoir_area_sqkm",
    "DEPTH_M": "max_depth_meters",
    "YEAR_DAM": "construction_year_gdw",
    "PRE_YEAR": "pre_construction_year",
    "YEAR_TXT": "construction_year_text",
    "RIVER": "river_name",
    "MAIN_BASIN": "main_basin",
    "SUB_BASIN": "sub_basin",
    "LONG_DAM": "longitude_precise",
    "LAT_DAM": "latitude_precise",
    "ELEV_MASL": "elevation_meters",
    "CATCH_SKM": "catchment_area_sqkm",
    "MAIN_USE": "primary_purpose",
    "USE_IRRI": "use_irrigation",
    "USE_ELEC": "use_hydropower",
    "USE_SUPP": "use_water_supply",
    "USE_FCON": "use_flood_control",
    "USE_RECR": "use_recreation",
    "USE_NAVI": "use_navigation",
    "POWER_MW": "power_capacity_mw",
    "DIS_AVG_LS": "average_discharge_ls",
    "QUALITY": "data_quality_gdw",
    "COMMENTS": "gdw_comments",
    "ORIG_SRC": "original_source",
    "EDITOR": "data_editor",
}

# Enrichment column groups of the cleaning step.
ENRICHMENT_MEASURES = [
    "height_meters_gdw", "dam_length_meters", "capacity_mcm_gdw",
    "reservoir_area_sqkm", "max_depth_meters", "elevation_meters",
    "catchment_area_sqkm", "power_capacity_mw", "average_discharge_ls",
]
ENRICHMENT_COORDINATES = ["longitude_precise", "latitude_precise"]
ENRICHMENT_TEXT = [
    "dam_name_gdw", "alternative_name", "reservoir_name", "dam_type",
    "river_name", "main_basin", "sub_basin", "primary_purpose",
    "gdw_comments", "original_source", "data_editor",
]
ENRICHMENT_FLAGS = [
    "use_irrigation", "use_hydropower", "use_water_supply",
    "use_flood_control", "use_recreation", "use_navigation",
]

# Stored types of the enrichment table (column -> Spark SQL type).
ENRICHMENT_TYPES = {
    "gdw_id": "bigint",
    "dam_name_gdw": "string",
    "alternative_name": "string",
    "reservoir_name": "string",
    "dam_type": "string",
    "height_meters_gdw": "decimal(10,2)",
    "dam_length_meters": "decimal(10,2)",
    "capacity_mcm_gdw": "decimal(15,3)",
    "reservoir_area_sqkm": "decimal(12,3)",
    "max_depth_meters": "decimal(8,2)",
    "construction_year_gdw": "int",
    "pre_construction_year": "int",
    "construction_year_text": "string",
    "river_name": "string",
    "main_basin": "string",
    "sub_basin": "string",
    "longitude_precise": "decimal(12,8)",
    "latitude_precise": "decimal(12,8)",
    "elevation_meters": "decimal(10,2)",
    "catchment_area_sqkm": "decimal(15,3)",
    "primary_purpose": "string",
    "use_irrigation": "boolean",
    "use_hydropower": "boolean",
    "use_water_supply": "boolean",
    "use_flood_control": "boolean",
    "use_recreation": "boolean",
    "use_navigation": "boolean",
    "power_capacity_mw": "decimal(10,2)",
    "average_discharge_ls": "decimal(15,3)",
    "data_quality_gdw": "string",
    "gdw_comments": "string",
    "original_source": "string",
    "data_editor": "string",
}

# Decimal types of the measures the registry load fills in ``dams``.
DAMS_DECIMALS = {
    "height_meters": "decimal(10,2)",
    "length_meters": "decimal(10,2)",
    "elevation_masl": "decimal(10,2)",
    "normal_capacity_mcm": "decimal(15,2)",
    "catchment_area_km2": "decimal(12,2)",
    "reservoir_surface_area_km2": "decimal(10,2)",
    "installed_capacity_mw": "decimal(10,2)",
}

# Text length limits of the dams table (VARCHAR(n)).
DAMS_LENGTH_LIMITS = {
    "dam_name": 255,
    "country_code": 10,
    "province_state": 100,
    "nearest_city": 100,
    "reservoir_name": 255,
    "primary_purpose": 100,
}

# Columns of the enriched view: dam side (with renames) and enrichment side.
VIEW_DAM_COLUMNS = [
    ("dam_id", "dam_id"), ("dam_name", "dam_name"), ("country_code", "country_code"),
    ("province_state", "province_state"), ("coordinates", "coordinates"),
    ("height_meters", "height_meters"), ("normal_capacity_mcm", "normal_capacity_mcm"),
    ("construction_year", "construction_year"), ("data_quality_score", "data_quality_score"),
    ("created_at", "dam_record_created"),
]
VIEW_ENRICHMENT_COLUMNS = [
    "gdw_id", "dam_name_gdw", "alternative_name", "reservoir_name", "dam_type",
    "height_meters_gdw", "dam_length_meters", "capacity_mcm_gdw", "reservoir_area_sqkm",
    "max_depth_meters", "construction_year_gdw", "construction_year_text", "river_name",
    "main_basin", "sub_basin", "longitude_precise", "latitude_precise", "elevation_meters",
    "catchment_area_sqkm", "primary_purpose", "use_irrigation", "use_hydropower",
    "use_water_supply", "use_flood_control", "use_recreation", "use_navigation",
    "power_capacity_mw", "average_discharge_ls", "data_quality_gdw", "gdw_comments",
    "original_source", "data_editor",
]
