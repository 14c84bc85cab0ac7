"""Named queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``.

Each query builds the tables it needs from the driver tables under
``sf_dir`` (whole tables, no sampling) and returns the operator's output in
a comparison-friendly shape (see :func:`flat`).
"""

from __future__ import annotations

import uuid
from functools import reduce
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirline.functions import clean, geo
from weirline.operators import analysis, audit, enrich, hierarchy, monitoring, purge, spatial
from weirline.plans import jobs
from weirline.plans.workspace import BARRIERS_LOADED_AT, RESERVOIRS_LOADED_AT, RUN_TS, Workspace
from weirline.session import scratch_path
from weirline.sources import sinks, table_log
from weirline.sources.registry import read_metadata_csv
from weirline.schemas import DAMS_LENGTH_LIMITS

TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
COORD_DIGITS = 9


def ntz_text(c) -> "F.Column":
    """Wall-clock text ``yyyy-MM-dd HH:mm:ss.ffffff`` of a TIMESTAMP_NTZ.

    A plain cast never consults the session time zone (``date_format`` would
    convert through it and shift wall-clock times inside a daylight-saving
    gap); the fraction is padded to six digits.
    """
    s = c.cast("string")
    return F.when(F.instr(s, ".") == 0, F.concat(s, F.lit(".000000"))).otherwise(F.rpad(s, 26, "0"))


def flat(df: DataFrame) -> DataFrame:
    """Comparison shape: decimals -> double, timestamps -> text, points ->
    ``<name>_x``/``<name>_y`` (rounded to 9 digits), arrays -> comma-joined text."""
    cols = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, T.DecimalType):
            cols.append(c.cast("double").alias(f.name))
        elif isinstance(t, T.TimestampNTZType):
            cols.append(ntz_text(c).alias(f.name))
        elif isinstance(t, T.TimestampType):
            cols.append(F.date_format(c, TS_FORMAT).alias(f.name))
        elif isinstance(t, T.StructType) and {s.name for s in t.fields} == {"x", "y"}:
            cols.append(F.round(c["x"], COORD_DIGITS).alias(f"{f.name}_x"))
            cols.append(F.round(c["y"], COORD_DIGITS).alias(f"{f.name}_y"))
        elif isinstance(t, T.ArrayType):
            cols.append(F.array_join(c, ",").alias(f.name))
        elif f.name in ("longitude", "latitude") and isinstance(t, T.DoubleType):
            cols.append(F.round(c, COORD_DIGITS).alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


_REGISTRY_OUT = ["dam_id", "gdw_id", "source", "dam_name", "country_code", "province_state", "nearest_city",
                 "coordinates", "construction_year", "height_meters", "length_meters", "elevation_masl",
                 "reservoir_name", "normal_capacity_mcm", "catchment_area_km2", "reservoir_surface_area_km2",
                 "primary_purpose", "installed_capacity_mw", "data_quality_score", "last_verified",
                 "created_at", "updated_at"]


def _reg(df: DataFrame) -> DataFrame:
    return flat(df.select(*_REGISTRY_OUT))


def _w(spark, sf_dir) -> Workspace:
    return Workspace(spark, sf_dir)


def _raw_numeric(w: Workspace, cols) -> DataFrame:
    return w.raw_metadata.select(F.col("GDW_ID").cast("bigint").alias("gdw_id"),
                                 *[clean.parse_number(c).alias(c.lower()) for c in cols])


def _upsert(w: Workspace) -> DataFrame:
    # incoming batch: registry barriers whose height is re-stated by the metadata
    incoming = (w.barriers.select("dam_id", "gdw_id")
                .join(w.enrichment.where(F.col("height_meters_gdw").isNotNull())
                      .select("gdw_id", F.col("height_meters_gdw").cast("decimal(10,2)").alias("height_meters")),
                      "gdw_id", "inner")
                .select("dam_id", "height_meters"))
    return spatial.upsert_touch(w.registry, incoming, "dam_id", ["height_meters"], RUN_TS)


def _scratch(w: Workspace, name: str) -> str:
    """A folder of its own for each call: no two data sets, sessions or calls share one."""
    return scratch_path(w.spark, f"weirline/{uuid.uuid4().hex}/{name}")


def _metadata_csv(w: Workspace) -> DataFrame:
    """Metadata written as CSV by Spark, read back with the CSV reader
    (all text, reader null tokens), then selected and cleaned."""
    path = sinks.write_csv(w.raw_metadata.drop("nationkey"), _scratch(w, "metadata_csv"))
    return flat(enrich.enrichment_table(read_metadata_csv(w.spark, path)))


def _refresh(w: Workspace) -> DataFrame:
    path = _scratch(w, "dam_enrichment")
    sinks.refresh_table(w.spark, w.enrichment, path)
    return flat(w.spark.read.parquet(sinks.current(w.spark, path)))


def _snapshot(w: Workspace) -> DataFrame:
    path, _ = purge.snapshot(w.spark, w.registry, _scratch(w, "backups"))
    return _reg(w.spark.read.parquet(path))


def _run(w: Workspace) -> str:
    """Import, enrichment and analysis into a fresh folder; the exports are read from there."""
    out = _scratch(w, "run")
    imp = jobs.run_import(w.spark, w.raw_barriers, w.raw_reservoirs, out, BARRIERS_LOADED_AT, RESERVOIRS_LOADED_AT)
    enr = jobs.run_enrichment(w.spark, w.raw_metadata, imp["dams_path"], out, RUN_TS)
    jobs.run_analysis(w.spark, imp["dams_path"], enr["enrichment_path"], enr["view_path"], out, RUN_TS)
    return out


def _append(w: Workspace) -> DataFrame:
    """Both layers appended by key through the table log; a third append, of one layer again,
    is refused and leaves the table as it is."""
    path = _scratch(w, "dams")
    for rows in (w.barriers, w.reservoirs):
        table_log.append(rows, path, key="dam_id")
    try:
        table_log.append(w.barriers, path, key="dam_id")
    except table_log.KeyViolation:
        pass
    return _reg(table_log.read(w.spark, path))


def _overview(w: Workspace) -> DataFrame:
    d, e = w.staged_inputs(["dam_id", "dam_name", "country_code", "height_meters", "construction_year"],
                           ["gdw_id", "dam_name_gdw", "height_meters_gdw", "construction_year_gdw", "gdw_comments"])
    return analysis.overview(d, e, enrich.view_parts(d, e))




def _export_csv(w: Workspace) -> DataFrame:
    """Every filled cell of the exported tables, read back from the CSV files: its table, the
    first column of its row, its column and its value (all columns but the first are numbers)."""
    out = _run(w)
    parts = []
    for t in sinks.ANALYSIS_TABLES:
        read = w.spark.read.option("header", True).option("escape", '"').csv(f"{out}/tables/{t}")
        first, *others = read.columns
        cells = read.select(F.coalesce(first, F.lit("")).alias("row_key"), *others).unpivot("row_key", others, "column_name", "cell")
        parts.append(cells.filter(F.col("cell").isNotNull()).select(
            F.lit(t).alias("table_name"), "row_key", "column_name", F.round(F.col("cell").try_cast("double"), 6).alias("value")))
    return reduce(DataFrame.unionByName, parts)


def _export_statistics(w: Workspace) -> DataFrame:
    """The single values of the statistics document, parsed from the file."""
    doc = w.spark.read.option("multiLine", True).json(f"{_run(w)}/exports/analysis_statistics.json")
    return doc.select(
        "infrastructure_summary.total_types", "infrastructure_summary.dominant_type", "usage_summary.total_purposes",
        "usage_summary.primary_purpose", "geographic_summary.countries_analyzed", "geographic_summary.leading_country",
        F.round("quality_metrics.average_completeness", 6).alias("average_completeness"))


def _export_manifest(w: Workspace) -> DataFrame:
    doc = w.spark.read.option("multiLine", True).json(f"{_run(w)}/analysis_manifest.json")
    return doc.select("analysis_date", "database_records", "enrichment_records", F.size("generated_tables").alias("tables"))


def _reports(w: Workspace) -> DataFrame:
    """Lines of each section of the three reports (the cleaning report too)."""
    out = _run(w)
    jobs.run_cleaning(w.spark, f"{out}/dams", w.stations, w.readings, w.shm, out, RUN_TS)
    lines = w.spark.read.text(f"{out}/reports/*.md").withColumn("report", F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1))
    return lines.groupBy("report").agg(F.count_if(F.col("value").startswith("## ")).alias("sections"))


def _queries() -> dict[str, Callable[[Workspace], DataFrame]]:
    m = monitoring
    return {
        # ------------------------------------------------------------ sources
        "load_barriers": lambda w: _reg(w.barriers),
        "load_reservoirs": lambda w: _reg(w.reservoirs),
        "append_by_key": _append,
        "registry_append": lambda w: _reg(w.registry),
        "polygon_centroid": lambda w: flat(geo.with_polygon_centroid(w.raw_reservoirs, "geometry", "centroid")
                                           .select(F.col("GDW_ID").cast("bigint").alias("gdw_id"), "centroid")),
        # ---------------------------------------------- projections / cleaning
        "select_fields": lambda w: enrich.select_fields(w.raw_metadata)[0],
        "dam_name_fallback": lambda w: w.raw_barriers.select(
            F.col("GDW_ID").cast("bigint").alias("gdw_id"),
            clean.display_name("DAM_NAME", "RES_NAME", "ALT_NAME", "NEAR_CITY").alias("dam_name")),
        "sentinel_float": lambda w: w.raw_barriers.select(
            F.col("GDW_ID").cast("bigint").alias("gdw_id"),
            *[clean.sentinel_float(c).alias(c.lower()) for c in
              ["DAM_HGT_M", "DAM_LEN_M", "ELEV_MASL", "CAP_MCM", "CATCH_SKM", "AREA_SKM", "POWER_MW"]]),
        "year_registry": lambda w: w.raw_barriers.select(
            F.col("GDW_ID").cast("bigint").alias("gdw_id"), F.col("YEAR_DAM").alias("year_text"),
            clean.registry_year("YEAR_DAM").alias("construction_year")),
        "quality_score": lambda w: flat(w.raw_barriers.select(
            F.col("GDW_ID").cast("bigint").alias("gdw_id"), F.col("QUALITY").alias("quality"),
            clean.quality_score("QUALITY").alias("data_quality_score"))),
        "coerce_numeric": lambda w: _raw_numeric(w, ["DAM_HGT_M", "DAM_LEN_M", "CAP_MCM", "AREA_SKM", "DEPTH_M",
                                                     "YEAR_DAM", "PRE_YEAR", "LONG_DAM", "LAT_DAM", "ELEV_MASL",
                                                     "CATCH_SKM", "POWER_MW", "DIS_AVG_LS"]),
        "sentinel_numeric": lambda w: flat(w.enrichment.select(
            "gdw_id", "height_meters_gdw", "dam_length_meters", "capacity_mcm_gdw", "reservoir_area_sqkm",
            "max_depth_meters", "elevation_meters", "catchment_area_sqkm", "power_capacity_mw",
            "average_discharge_ls")),
        "clean_coords": lambda w: flat(w.enrichment.select("gdw_id", "longitude_precise", "latitude_precise")),
        "year_enrichment": lambda w: w.enrichment.select("gdw_id", "construction_year_gdw", "pre_construction_year",
                                                         "construction_year_text"),
        "clean_text": lambda w: w.enrichment.select(
            "gdw_id", "dam_name_gdw", "alternative_name", "reservoir_name", "dam_type", "river_name", "main_basin",
            "sub_basin", "primary_purpose", "gdw_comments", "original_source", "data_editor",
            "construction_year_text", "data_quality_gdw"),
        "usage_flags": lambda w: w.enrichment.select("gdw_id", "use_irrigation", "use_hydropower",
                                                     "use_water_supply", "use_flood_control", "use_recreation",
                                                     "use_navigation"),
        "typed_enrichment": lambda w: flat(w.enrichment),
        "authentic_rows": lambda w: _reg(purge.authentic_rows(w.registry)),
        "synthetic_rows": lambda w: _reg(purge.synthetic_rows(w.registry)),
        "classify_rows": lambda w: flat(purge.classify_rows(w.registry)),
        # -------------------------------------------------------------- joins
        "enriched_view": lambda w: enrich.enriched_view(w.registry, w.enrichment, shape=flat),
        "dam_summary": lambda w: flat(w.summary),
        "priority_regions": lambda w: flat(m.priority_regions(w.summary, w.regions)),
        "dam_inventory": lambda w: flat(m.dam_inventory(w.summary)),
        "monitoring_coverage": lambda w: flat(m.monitoring_coverage(w.registry, w.stations)),
        "dams_with_stations": lambda w: flat(m.dams_with_stations(w.registry, w.stations)),
        "recent_readings": lambda w: flat(m.recent_readings(w.readings, w.stations)),
        "region_hierarchy": lambda w: hierarchy.hierarchy_rollup(w.regions, w.dams, w.stations, w.readings),
        "region_rollup": lambda w: m.region_rollup(w.summary, w.stations, w.readings),
        "pair_distance": lambda w: spatial.pair_distance(w.registry, spatial.layer_pairs(w.registry))
        .withColumn("distance_km", F.round("distance_km", 6)),
        "dependents_count": lambda w: purge.dependents_count(w.cascade),
        "cascade_removed": lambda w: purge.cascade_rows(w.cascade.removed),
        "cascade_kept": lambda w: purge.cascade_rows(w.cascade.kept),
        "deletion_results": lambda w: purge.deletion_results(w.registry, w.cascade),
        # ------------------------------------------------------- aggregations
        "overview": _overview,
        "infrastructure_types": lambda w: analysis.infrastructure_types(w.enrichment),
        "height_classes": lambda w: analysis.height_classes(w.enrichment),
        "capacity_classes": lambda w: analysis.capacity_classes(w.enrichment),
        "purposes": lambda w: analysis.purposes(w.enrichment),
        "usage_patterns": lambda w: analysis.usage_patterns(w.enrichment),
        "country_analysis": lambda w: analysis.country_analysis(w.registry, w.enrichment),
        "basin_analysis": lambda w: analysis.basin_analysis(w.enrichment),
        "timeline": lambda w: analysis.timeline(w.enrichment),
        "completeness": lambda w: analysis.completeness(w.enrichment),
        "completeness_all": lambda w: enrich.completeness_all(w.enrichment),
        "composition_total": lambda w: flat(purge.composition_total(w.registry)),
        "composition_scores": lambda w: flat(purge.composition_scores(w.registry)),
        "composition_classes": lambda w: purge.composition_classes(w.registry),
        "removal_summary": lambda w: purge.removal_summary(w.registry),
        "dry_run_count": lambda w: purge.dry_run_count(w.registry),
        "report_means": lambda w: analysis.report_means(
            analysis.country_analysis(w.registry, w.enrichment), analysis.completeness(w.enrichment)),
        # --------------------------------------------------------- validation
        "import_countries": lambda w: audit.country_distribution(w.registry),
        "import_scores": lambda w: flat(audit.score_distribution(w.registry)),
        "bounding_box": lambda w: audit.bounding_box(w.registry),
        "sample_names": lambda w: audit.sample_names(w.registry),
        "clean_countries": lambda w: audit.country_distribution(purge.authentic_rows(w.registry)),
        "clean_years": lambda w: audit.year_summary(purge.authentic_rows(w.registry)),
        "enrichment_checks": lambda w: audit.enrichment_checks(purge.authentic_rows(w.registry), w.enrichment,
                                                               w.view_parts),
        "constraint_audit": lambda w: audit.constraint_audit(w.dams),
        "length_audit": lambda w: audit.length_audit(w.dams, DAMS_LENGTH_LIMITS),
        "orphan_audit": lambda w: audit.orphan_audit({
            **audit.reference_orphans(w.dams, w.regions, w.dam_types),
            **audit.source_orphans(w.dam_sources, w.station_sources, w.data_sources),
            "monitoring_stations.dam_id -> dams": (w.stations, "dam_id", w.dams, "dam_id"),
            "sensor_readings.station_id -> monitoring_stations": (w.readings, "station_id", w.stations,
                                                                   "station_id"),
            "shm_sensors.station_id -> monitoring_stations": (w.shm, "station_id", w.stations, "station_id"),
        }),
        "key_audit": lambda w: audit.key_audit({
            "dams": (w.dams, "dam_id", ["dam_name", "coordinates"]),
            "dam_enrichment": (w.enrichment, "gdw_id", []),
        }),
        "geometry_audit": lambda w: audit.geometry_audit(w.dams),
        # ----------------------------------------------------- sorts / limits
        "samples_authentic": lambda w: flat(purge.newest_samples(w.registry, authentic=True)),
        "samples_synthetic": lambda w: flat(purge.newest_samples(w.registry, authentic=False)),
        "random_sample": lambda w: flat(purge.random_sample(w.registry)),
        # ------------------------------------------------------------- upsert
        "upsert_touch": lambda w: flat(_upsert(w).select(*_REGISTRY_OUT, "touched")),
        # ---------------------------------------------------------- sinks
        "load_metadata_csv": _metadata_csv,
        "enrichment_refresh": _refresh,
        "snapshot": _snapshot,
        # ------------------------------------------------- rows-only checks
        "wkt_points": lambda w: w.registry.select("dam_id", geo.point_to_wkt("coordinates").alias("wkt")),
        "export_csv": _export_csv,
        "export_statistics_json": _export_statistics,
        "export_manifest": _export_manifest,
        "reports_md": _reports,
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {}
    for name, fn in _queries().items():
        out[name] = (lambda f: (lambda spark, sf_dir: f(_w(spark, sf_dir))))(fn)
    return out


__all__ = ["queries", "flat"]
