"""Authentic vs synthetic registry rows, and the cascading removal of the
synthetic ones through the monitoring tables.

The original does this with DELETE ... WHERE key IN (subquery) in dependency
order.  Here a removal is a pair of frames per table: ``removed`` (left semi
join against the removed parent keys) and ``kept`` (left anti join), written
as new table versions rather than deleted in place.  A left anti join keeps
rows whose parent key is NULL, exactly as the DELETE does.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from weirline.operators.spread import spread_join
from weirline.functions.stats import pct
from weirline.session import compiled_projections

log = logging.getLogger(__name__)

# The score that marks an authentic registry row, and the labels.
AUTHENTIC_SCORE = "0.5"
LABEL_KEEP, LABEL_REMOVE = "GDW_KEEP", "ARTIFICIAL_REMOVE"
TYPE_AUTHENTIC, TYPE_ARTIFICIAL, TYPE_UNKNOWN = "GDW_Records", "Artificial_Records", "Unknown"
SUMMARY_KEEP, SUMMARY_REMOVE = "GDW_Records_KEEP", "Artificial_Records_REMOVE"
SAMPLE_COLUMNS = ["dam_name", "country_code", "data_quality_score", "construction_year", "created_at"]


def is_authentic(score_col: str = "data_quality_score", score: str = AUTHENTIC_SCORE) -> Column:
    """``score = 0.5`` (NULL is not authentic)."""
    return F.col(score_col) == F.lit(score).cast("decimal(3,2)")


def is_synthetic(score_col: str = "data_quality_score", score: str = AUTHENTIC_SCORE) -> Column:
    """``score != 0.5 OR score IS NULL``."""
    return ~F.col(score_col).eqNullSafe(F.lit(score).cast("decimal(3,2)"))


def authentic_rows(dams: DataFrame, predicate: Column | None = None) -> DataFrame:
    return dams.where(predicate if predicate is not None else is_authentic())


def synthetic_rows(dams: DataFrame, predicate: Column | None = None) -> DataFrame:
    return dams.where(~predicate if predicate is not None else is_synthetic())


def classify_rows(dams: DataFrame) -> DataFrame:
    """Rows planned for removal, each labelled KEEP/REMOVE (NULL score -> REMOVE)."""
    label = F.when(is_authentic(), F.lit(LABEL_KEEP)).otherwise(F.lit(LABEL_REMOVE))
    return (synthetic_rows(dams)
            .select("dam_id", "dam_name", "country_code", "data_quality_score",
                    "construction_year", "created_at", label.alias("record_classification"))
            .orderBy("created_at", "dam_id"))


def composition_total(dams: DataFrame) -> DataFrame:
    return dams.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_distinct("data_quality_score").alias("unique_quality_scores"),
        F.min("created_at").alias("earliest_record"),
        F.max("created_at").alias("latest_record"),
    )


def composition_scores(dams: DataFrame) -> DataFrame:
    """Per score: count, share of all rows, first/last creation time; largest first.

    A score is a DECIMAL(3,2), so the groups are few: their total is a window
    sum over the aggregate, and the table is read once.
    """
    per = dams.groupBy("data_quality_score").agg(
        F.count(F.lit(1)).alias("record_count"),
        F.min("created_at").alias("earliest_created"),
        F.max("created_at").alias("latest_created"),
    )
    return (per.withColumn("_total", F.sum("record_count").over(Window.partitionBy()))
            .select("data_quality_score", "record_count", pct("record_count", "_total").alias("percentage"),
                    "earliest_created", "latest_created")
            .orderBy(F.desc("record_count"), F.col("data_quality_score").asc_nulls_last()))


def composition_classes(dams: DataFrame) -> DataFrame:
    record_type = (F.when(is_authentic(), F.lit(TYPE_AUTHENTIC))
                   .when(is_synthetic(), F.lit(TYPE_ARTIFICIAL))
                   .otherwise(F.lit(TYPE_UNKNOWN)))
    return (dams.groupBy(record_type.alias("record_type")).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "record_type"))


def removal_summary(dams: DataFrame) -> DataFrame:
    classification = F.when(is_authentic(), F.lit(SUMMARY_KEEP)).otherwise(F.lit(SUMMARY_REMOVE))
    per = dams.groupBy(classification.alias("classification")).agg(F.count(F.lit(1)).alias("count"))
    return (per.withColumn("_total", F.sum("count").over(Window.partitionBy()))
            .select("classification", "count", pct("count", "_total").alias("percentage"))
            .orderBy(F.desc("count"), "classification"))


def dry_run_count(dams: DataFrame) -> DataFrame:
    return synthetic_rows(dams).agg(F.count(F.lit(1)).alias("would_be_deleted"))


def newest_samples(dams: DataFrame, authentic: bool, n: int = 5) -> DataFrame:
    """Newest ``n`` rows of one class; the key breaks ties so the result is fixed."""
    rows = authentic_rows(dams) if authentic else synthetic_rows(dams)
    return (rows.orderBy(F.col("created_at").desc(), F.col("dam_id").asc())
            .limit(n).select(*SAMPLE_COLUMNS))


def random_sample(dams: DataFrame, n: int = 10, seed: int = 42) -> DataFrame:
    """A repeatable ``n``-row sample of the authentic rows: order by a seeded digest of
    the key (top-k, so each task keeps only ``n`` candidates)."""
    return (authentic_rows(dams).orderBy(F.md5(F.concat("dam_id", F.lit(str(seed)))), F.col("dam_id"))
            .limit(n).select("dam_name", "country_code", "data_quality_score", "construction_year"))


@dataclass
class Cascade:
    """Removed and kept rows of each table for one cascading removal, and the
    key set of removed stations (to flag child rows in one pass)."""
    removed: dict
    kept: dict
    removed_station_ids: DataFrame | None = None


def flag_removed(child: DataFrame, removed_station_ids: DataFrame, flag: str = "_removed") -> DataFrame:
    """``child`` with a boolean ``flag`` set where its station is removed (NULL
    otherwise).  One pass splits the table: kept = flag IS NULL (this keeps
    NULL station ids, as the DELETE does).  The key set is distinct (station ids
    are keys of their table), so the left join cannot duplicate child rows; a
    station that holds a large share of them is dealt to several tasks."""
    keys = removed_station_ids.select("station_id").withColumn(flag, F.lit(True))
    return spread_join(child, keys, "station_id", "station_id", "left")


def cascade(dams: DataFrame, stations: DataFrame, readings: DataFrame, shm: DataFrame,
            predicate: Column | None = None) -> Cascade:
    """Removal of synthetic dams and of everything that hangs off them.

    Order as in the original: readings and SHM sensors of stations of removed
    dams, then those stations, then the dams.  Each step is a semi/anti join on
    the parent key; the keys are one column of the parent table.  Catalyst and
    AQE pick the strategy from sizes: a small key set is broadcast, a large one
    is shuffled, and a hot station (a large share of the readings, on the left
    side) is split.
    """
    bad_dam_ids = synthetic_rows(dams, predicate).select("dam_id")
    bad_station_ids = stations.join(bad_dam_ids, "dam_id", "left_semi").select("station_id")
    removed = {
        "sensor_readings": readings.join(bad_station_ids, "station_id", "left_semi"),
        "shm_sensors": shm.join(bad_station_ids, "station_id", "left_semi"),
        "monitoring_stations": stations.join(bad_dam_ids, "dam_id", "left_semi"),
        "dams": synthetic_rows(dams, predicate),
    }
    kept = {
        "sensor_readings": readings.join(bad_station_ids, "station_id", "left_anti"),
        "shm_sensors": shm.join(bad_station_ids, "station_id", "left_anti"),
        "monitoring_stations": stations.join(bad_dam_ids, "dam_id", "left_anti"),
        "dams": authentic_rows(dams, predicate),
    }
    return Cascade(removed, kept, bad_station_ids)


# key column of each table in the cascade
CASCADE_KEYS = {
    "sensor_readings": "reading_id",
    "shm_sensors": "sensor_id",
    "monitoring_stations": "station_id",
    "dams": "dam_id",
}


def cascade_rows(frames: dict) -> DataFrame:
    """One long frame ``(table_name, row_id)`` over the per-table frames."""
    out = None
    for name, key in CASCADE_KEYS.items():
        part = frames[name].select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("row_id"))
        out = part if out is None else out.unionByName(part)
    return out


def dependents_count(c: Cascade) -> DataFrame:
    """Rows of each dependent table that reference a removed dam (one row)."""
    parts = [c.removed[t].agg(F.count(F.lit(1)).alias(alias)) for t, alias in (
        ("sensor_readings", "sensor_count"),
        ("shm_sensors", "shm_sensor_count"),
        ("monitoring_stations", "monitoring_count"),
    )]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])


def deletion_results(dams: DataFrame, c: Cascade, count_readings: bool = True) -> DataFrame:
    """Before / after / removed counts (one row, single-row aggregates only).

    ``count_readings=False`` leaves the readings count NULL, for callers that
    count removed readings during the pass that writes the kept ones.
    """
    def cnt(df, alias):
        return df.agg(F.count(F.lit(1)).alias(alias))

    readings = (cnt(c.removed["sensor_readings"], "sensor_readings_removed") if count_readings
                else dams.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("sensor_readings_removed")))
    out = (cnt(dams, "before_count")
           .crossJoin(cnt(c.kept["dams"], "after_count"))
           .crossJoin(readings)
           .crossJoin(cnt(c.removed["shm_sensors"], "shm_sensors_removed"))
           .crossJoin(cnt(c.removed["monitoring_stations"], "monitoring_stations_removed")))
    return out.select("before_count", "after_count",
                      (F.col("before_count") - F.col("after_count")).alias("deleted_count"),
                      "sensor_readings_removed", "shm_sensors_removed", "monitoring_stations_removed")


def snapshot(spark: SparkSession, dams: DataFrame, base_dir: str, when: datetime | None = None,
             max_attempts: int = 10) -> tuple[str, int]:
    """Write a snapshot ``dams_backup_<ts>``; on a name clash try ``_1``..``_9``.

    Returns ``(path, row count)`` and raises if the rows read back are not as many as
    were written.  ``when`` is the run's timestamp, so that a rerun names the same
    snapshot.  Two runs that pick one name at the same moment are not kept apart by the
    file system: give each run its own ``base_dir``.
    """
    stamp = (when or datetime.now()).strftime("%Y%m%d_%H%M%S")
    base = f"{base_dir.rstrip('/')}/dams_backup_{stamp}"
    path = base
    for attempt in range(1, max_attempts + 1):
        written = Observation()
        try:
            with compiled_projections(spark):   # some thirty columns are derived from every row
                dams.observe(written, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").parquet(path)
            break
        except Exception as exc:  # AnalysisException: path already exists
            if "already exists" not in str(exc) or attempt == max_attempts:
                raise
            path = f"{base}_{attempt}"
    count = spark.read.parquet(path).count()
    if count != written.get["n"]:
        raise RuntimeError(f"snapshot {path} holds {count} rows of {written.get['n']}")
    log.info("snapshot %s holds %d rows", path, count)
    return path, count
