"""Composite jobs: import, enrichment, cleaning, analysis.

Each job reads and writes tables under ``out_dir`` (a folder on the shared
storage of the cluster).  Reused intermediate tables (typed enrichment,
dams, the enriched view) are written once and read back, which also cuts
the lineage: a lost executor recomputes from the written table, not from the
raw inputs.
"""

from __future__ import annotations

import logging
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weirline.functions import geo
from weirline.operators import analysis, audit, enrich, purge
from weirline.sources import sinks, table_log
from weirline.sources.registry import load_barriers, load_reservoirs

log = logging.getLogger(__name__)


# Analysis tables with a row per value of a free-text column, and their order (descending?).
OPEN_ENDED = {
    "infrastructure_types": [("dam_count", True), ("infrastructure_type", False)],
    "primary_purposes": [("dam_count", True), ("primary_purpose", False), ("avg_height_m", False)],
}


def _p(out_dir: str, name: str) -> str:
    return f"{out_dir.rstrip('/')}/{name}"


# ------------------------------------------------------------------- C1
def run_import(spark: SparkSession, raw_barriers: DataFrame, raw_reservoirs: DataFrame, out_dir: str,
               barriers_loaded_at: str, reservoirs_loaded_at: str, key: str | None = None) -> dict:
    """Both registry layers appended to ``dams`` (read it with ``table_log.read``), then the import checks.

    Each layer is appended whole or not at all; one that fails is reported with all of its
    rows as skipped.  With ``key`` (dam_id) an append that breaks it fails."""
    dams_path = _p(out_dir, "dams")
    appended = {}
    for layer, rows in (("barrier", load_barriers(raw_barriers, barriers_loaded_at)), ("reservoir", load_reservoirs(raw_reservoirs, reservoirs_loaded_at))):
        try:
            appended[layer] = table_log.append(rows, dams_path, key), 0
        except Exception as exc:  # noqa: BLE001 - reported in the result
            log.error("append of layer %s failed: %s", layer, exc)
            appended[layer] = 0, rows.select(F.lit(1)).count()
    dams = table_log.read(spark, dams_path)
    checks = audit.run_checks({
        "total": dams.agg(F.count(F.lit(1)).alias("total_records")),
        "bounding_box": audit.bounding_box(dams),
    })
    return {
        "dams_path": dams_path,
        "inserted": {layer: n for layer, (n, _) in appended.items()},
        "skipped": {layer: n for layer, (_, n) in appended.items()},
        "unreadable_geometry": raw_reservoirs.filter(geo.unreadable_area("geometry")).count(),
        "validation": checks,
        "countries": sinks.rows(audit.country_distribution(dams)),
        "scores": sinks.rows(audit.score_distribution(dams)),
        "sample_names": sinks.rows(audit.sample_names(dams)),
    }


# ------------------------------------------------------------------- C3
def run_enrichment(spark: SparkSession, raw_metadata: DataFrame, dams_path: str, out_dir: str,
                   run_ts: str, extra_checks: dict | None = None) -> dict:
    """Select + clean metadata, refresh the typed table, materialise the
    enriched view (its parts: read it with ``enrich.read_view``), run the checks (each check on its own: one that fails is
    recorded and the others stand), write the report."""
    selected, present, missing = enrich.select_fields(raw_metadata)
    ts = F.lit(run_ts).cast("timestamp_ntz")
    typed = enrich.clean_enrichment(selected).withColumn("created_at", ts).withColumn("updated_at", ts)
    e_path = _p(out_dir, "dam_enrichment")
    e_version, records = sinks.refresh_table(spark, typed, e_path)
    e = spark.read.parquet(e_version)
    dams = table_log.read(spark, dams_path)
    view_path = _p(out_dir, "dams_enriched")
    view_version = sinks.refresh_parts(spark, vars(enrich.view_parts(dams, e)), view_path)
    view = enrich.read_view(spark, view_version)
    view_rows = view.totals().first()["rows"]
    checks = audit.run_checks({**audit.enrichment_check_frames(purge.authentic_rows(dams), e, view), **(extra_checks or {})})
    fields = [{"source_field": s, "column": t} for s, t in present.items()] + [{"source_field": s, "column": None} for s in missing]
    summary = [{"records": records, "enriched_view_rows": view_rows, "fields": len(present), "missing_fields": len(missing)}]
    sinks.write_text(spark, _p(out_dir, "reports/enrichment_report.md"),
                     sinks.report("Enrichment run", run_ts, {"result": summary, "fields": fields}))
    return {"enrichment_path": e_version, "view_path": view_version, "records": records,
            "view_records": view_rows, "present": present, "missing": missing, "validation": checks}


# ------------------------------------------------------------------- C2
def run_cleaning(spark: SparkSession, dams_path: str, stations: DataFrame, readings: DataFrame,
                 shm: DataFrame, out_dir: str, run_ts: str, dry_run: bool = False,
                 expected_count: int | None = None) -> dict:
    """Composition, snapshot, removal plan; then (unless a dry run) the
    cascading removal written as new table versions, and the checks."""
    dams = table_log.read(spark, dams_path)
    result = {
        "composition": sinks.rows(purge.composition_total(dams)),
        "scores": sinks.rows(purge.composition_scores(dams)),
        "classes": sinks.rows(purge.composition_classes(dams)),
        "samples_authentic": sinks.rows(purge.newest_samples(dams, True)),
        "samples_synthetic": sinks.rows(purge.newest_samples(dams, False)),
    }
    result["snapshot"] = purge.snapshot(spark, dams, _p(out_dir, "backups"), datetime.fromisoformat(run_ts))
    result["removal_summary"] = sinks.rows(purge.removal_summary(dams))
    result["sample_removals"] = sinks.rows(purge.classify_rows(dams), 10)
    if dry_run:
        result["would_be_deleted"] = sinks.rows(purge.dry_run_count(dams))[0]["would_be_deleted"]
        return result
    c = purge.cascade(dams, stations, readings, shm)
    # the four tables are one version: they appear together when it is published, or not at all
    version = f"v-{uuid.uuid4().hex}"
    clean_dir = _p(out_dir, f"clean/{version}")
    # the keys of the removed stations are used three times: computed once
    key_path = _p(out_dir, f"clean/{version}-removed-stations")
    c.removed_station_ids.write.parquet(key_path)
    keys = spark.read.parquet(key_path)
    # readings (the largest table) are read once: each row is flagged against
    # the removed-station keys, the kept rows are written and the
    # removed ones counted by an observation on the same pass
    obs = Observation("removed_readings")
    flagged = (purge.flag_removed(readings, keys)
               .observe(obs, F.count_if(F.col("_removed").isNotNull()).alias("removed")))
    (flagged.where(F.col("_removed").isNull()).drop("_removed")
     .withColumn("reading_date", F.to_date("measurement_timestamp"))  # one folder per day: time filters prune
     .hint("rebalance", "reading_date")  # files by day, large days split, not one file per task and day
     .write.partitionBy("reading_date").parquet(_p(clean_dir, "sensor_readings")))
    c.removed["shm_sensors"] = shm.join(keys, "station_id", "left_semi")
    c.kept["shm_sensors"] = shm.join(keys, "station_id", "left_anti")
    for table in ("shm_sensors", "monitoring_stations", "dams"):
        c.kept[table].write.parquet(_p(clean_dir, table))
    deletion = sinks.rows(purge.deletion_results(dams, c, count_readings=False))[0]
    sinks.publish(spark, _p(out_dir, "clean"), version)
    deletion["sensor_readings_removed"] = int(obs.get["removed"])
    kept = spark.read.parquet(_p(clean_dir, "dams"))
    years = sinks.rows(audit.year_summary(kept))[0]
    result.update({
        "deletion_results": deletion,
        "validation": {"years": years, "countries": sinks.rows(audit.country_distribution(kept)),
                       "scores": sinks.rows(audit.score_distribution(kept)),
                       "sample_records": sinks.rows(purge.random_sample(kept))},
        "clean_dir": clean_dir,
    })
    if expected_count is not None and years["total"] != expected_count:
        log.warning("expected %d rows after cleaning, got %d", expected_count, years["total"])
    sinks.write_text(spark, _p(out_dir, "reports/cleaning_report.md"), sinks.report("Cleaning run", run_ts, {
        "composition_before": result["composition"], "removal_plan": result["removal_summary"], "removed": [deletion],
        "years_after": [years], "countries_after": result["validation"]["countries"],
        "snapshot": [{"path": result["snapshot"][0], "rows": result["snapshot"][1]}]}))
    return result


# ------------------------------------------------------------------- C4
def analysis_tables(dams: DataFrame, e: DataFrame, view: enrich.ViewParts) -> dict[str, DataFrame]:
    """The ten published analysis tables, keyed by their export name."""
    names = sinks.ANALYSIS_TABLES
    frames = [
        analysis.overview(dams, e, view), analysis.infrastructure_types(e), analysis.height_classes(e),
        analysis.purposes(e), analysis.usage_patterns(e), analysis.country_analysis(dams, e),
        analysis.basin_analysis(e), analysis.capacity_classes(e), analysis.timeline(e), analysis.completeness(e),
    ]
    return dict(zip(names, frames))


def run_analysis(spark: SparkSession, dams_path: str, enrichment_path: str, view_path: str, out_dir: str,
                 run_ts: str) -> dict:
    """Export the ten tables as CSV, the statistics JSON, the executive
    summary and the manifest.  Reads the materialised enrichment and view."""
    dams = table_log.read(spark, dams_path)
    e, view = spark.read.parquet(enrichment_path), enrich.read_view(spark, view_path)
    tables = analysis_tables(dams, e, view)
    collected, totals = {}, {}
    for name, df in tables.items():
        path = _p(out_dir, f"tables/{name}")
        if name in OPEN_ENDED:  # as many rows as the data has values: written by all tasks, the top read back
            done = _p(out_dir, f"tables-{uuid.uuid4().hex}/{name}")
            df.write.parquet(done)
            df = spark.read.parquet(done)
            sinks.write_csv(df, path)
            totals[name] = df.count()
            collected[name] = sinks.rows(df.orderBy(*[F.col(c).desc() if d else F.col(c) for c, d in OPEN_ENDED[name]]), 10)
        else:
            df = df.cache()  # a few dozen rows by definition: exported and reported from one computation
            sinks.write_csv(df, path, single_file=True)
            collected[name] = sinks.rows(df)
            df.unpersist()
    top = [collected[n] for n in ("database_overview", "infrastructure_types", "primary_purposes", "country_analysis", "data_completeness")]
    doc = sinks.statistics_document(run_ts, *top, totals=totals)
    sinks.write_json(spark, _p(out_dir, "exports/analysis_statistics.json"), doc)
    summary = sinks.report("Registry analysis", run_ts, collected)
    sinks.write_text(spark, _p(out_dir, "reports/executive_summary.md"), summary)
    ov = collected["database_overview"]
    manifest = sinks.manifest_document(run_ts, ov[0]["record_count"] if ov else 0,
                                       ov[1]["record_count"] if len(ov) > 1 else 0)
    sinks.write_json(spark, _p(out_dir, "analysis_manifest.json"), manifest)
    return {"tables": collected, "statistics": doc, "manifest": manifest, "summary": summary}
