"""Composite jobs end to end on the smallest data set (written under the
session's checkpoint folder)."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from weirline.operators import audit
from weirline.plans import jobs
from weirline.plans.workspace import BARRIERS_LOADED_AT, RESERVOIRS_LOADED_AT, RUN_TS, Workspace
from weirline.session import scratch_path
from weirline.sources import sinks, table_log
from conftest import SF_SMALL


def test_import_enrich_clean_analyse(spark):
    w = Workspace(spark, SF_SMALL)
    out = scratch_path(spark, f"tests/jobs-{uuid.uuid4().hex[:8]}")

    imp = jobs.run_import(spark, w.raw_barriers, w.raw_reservoirs, out, BARRIERS_LOADED_AT, RESERVOIRS_LOADED_AT)
    assert imp["validation"]["total"]["total_records"] == 2 * w.raw_barriers.count()
    assert imp["inserted"] == {"barrier": w.raw_barriers.count(), "reservoir": w.raw_reservoirs.count()}
    assert sum(r["count"] for r in imp["scores"]) == imp["validation"]["total"]["total_records"]

    enr = jobs.run_enrichment(spark, w.raw_metadata, imp["dams_path"], out, RUN_TS)
    assert enr["records"] == w.raw_metadata.count() and not enr["missing"]
    checks = enr["validation"]
    assert all("error" not in c for c in checks.values()) and checks["view"]["enriched_view_count"] == enr["view_records"]

    dry = jobs.run_cleaning(spark, imp["dams_path"], w.stations, w.readings, w.shm, out, RUN_TS, dry_run=True)
    total = dry["composition"][0]["total_records"]
    assert dry["snapshot"][1] == total
    assert sum(r["count"] for r in dry["classes"]) == total

    res = jobs.run_cleaning(spark, imp["dams_path"], w.stations, w.readings, w.shm, out, RUN_TS)
    d = res["deletion_results"]
    assert d["deleted_count"] == dry["would_be_deleted"]
    assert d["after_count"] == res["validation"]["years"]["total"]
    assert res["snapshot"][0] != dry["snapshot"][0]  # second snapshot gets its own name
    kept_readings = spark.read.parquet(f"{res['clean_dir']}/sensor_readings")
    assert kept_readings.count() + d["sensor_readings_removed"] == w.readings.count()
    # the count observed during the single write pass equals the semi-join count
    from weirline.operators import purge
    c = purge.cascade(table_log.read(spark, imp["dams_path"]), w.stations, w.readings, w.shm)
    assert d["sensor_readings_removed"] == c.removed["sensor_readings"].count()

    ana = jobs.run_analysis(spark, imp["dams_path"], enr["enrichment_path"], enr["view_path"], out, RUN_TS)
    assert len(ana["tables"]) == 10
    assert ana["manifest"]["database_records"] == ana["tables"]["database_overview"][0]["record_count"]
    doc = json.loads("\n".join(r.value for r in spark.read.text(f"{out}/exports/analysis_statistics.json")
                               .collect()))
    assert doc["infrastructure_summary"]["total_types"] == len(ana["tables"]["infrastructure_types"])
    csv = spark.read.option("header", True).csv(f"{out}/tables/usage_patterns")
    assert csv.count() == 6


def test_second_import_counts_its_own_rows(spark):
    w = Workspace(spark, SF_SMALL)
    out = scratch_path(spark, f"tests/jobs-{uuid.uuid4().hex[:8]}")
    n = w.raw_barriers.count()
    for run in (1, 2):
        imp = jobs.run_import(spark, w.raw_barriers, w.raw_reservoirs, out, BARRIERS_LOADED_AT, RESERVOIRS_LOADED_AT)
        assert imp["inserted"] == {"barrier": n, "reservoir": n} and imp["skipped"] == {"barrier": 0, "reservoir": 0}
        assert imp["validation"]["total"]["total_records"] == run * 2 * n and imp["unreadable_geometry"] == 0
    broken = w.raw_barriers.withColumn("x", F.raise_error(F.lit("no")))
    assert jobs.run_import(spark, broken, w.raw_reservoirs, out, BARRIERS_LOADED_AT, RESERVOIRS_LOADED_AT)["skipped"]["barrier"] in (0, n)


def test_failed_refresh_keeps_the_old_rows(spark):
    path = scratch_path(spark, f"tests/refresh-{uuid.uuid4().hex[:8]}")
    sinks.refresh_table(spark, spark.range(100), path)
    with pytest.raises(Exception, match="no"):
        sinks.refresh_table(spark, spark.range(100).withColumn("id", F.when(F.col("id") == 99, F.raise_error(F.lit("no"))).otherwise(F.col("id"))), path)
    assert spark.read.parquet(sinks.current(spark, path)).count() == 100
    sinks.refresh_table(spark, spark.range(7), path)
    assert spark.read.parquet(sinks.current(spark, path)).count() == 7


def test_one_failing_check_is_recorded(spark):
    ok = spark.range(1).selectExpr("count(*) AS n")
    got = audit.run_checks({"a": ok, "bad": spark.range(1).select(F.raise_error(F.lit("no"))), "b": ok})
    assert got["a"] == got["b"] == {"n": 1} and "error" in got["bad"]


def test_upsert_keeps_columns_and_takes_one_row_per_key(spark):
    from weirline.operators import spatial
    now = spark.createDataFrame([(1, 5, "x"), (2, 6, "y")], "k int, v int, other string").withColumn("updated_at", F.lit("2020-01-01").cast("timestamp_ntz"))
    new = spark.createDataFrame([(1, 7), (1, 9), (2, 6), (3, 1)], "k int, v int")
    got = {r["k"]: (r["v"], r["other"], r["touched"]) for r in spatial.upsert_touch(now, new, "k", ["v"], "2021-01-01").collect()}
    assert got == {1: (9, "x", True), 2: (6, "y", False), 3: (1, None, True)}
