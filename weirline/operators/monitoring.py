"""Monitoring views: dam summary, station coverage, recent readings, rollups.

Readings are by far the largest table.  Every operator here reduces them
(per-station counts, per-dam top-k) before they meet another table, so a
shuffle carries partial aggregates rather than raw readings where possible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# How many readings per dam the recent-readings view keeps, and the
# priority cut of the region list.
RECENT_READINGS = 100
PRIORITY_TOP = 3


def attach_links(dams: DataFrame, links: DataFrame) -> DataFrame:
    """Fill region, dam type, status and hazard of registry rows from a link
    table keyed by ``dam_id`` (one row per dam, so the join cannot fan out)."""
    return dams.join(links.drop("GDW_ID"), "dam_id", "left")


def dam_summary(dams: DataFrame, regions: DataFrame, dam_types: DataFrame) -> DataFrame:
    """Dams with a region (inner join) and their primary type (left join).

    Plain joins: Catalyst broadcasts the reference tables by their size.
    """
    r = regions.select("region_id", "region_name")
    t = dam_types.select(F.col("type_id").alias("primary_dam_type_id"), F.col("type_name").alias("primary_dam_type"))
    return (dams.join(r, "region_id", "inner")
            .join(t, "primary_dam_type_id", "left")
            .select("dam_id", "dam_name", "region_name", "country_code", "primary_dam_type",
                    "construction_year", "height_meters", "normal_capacity_mcm", "construction_status",
                    "hazard_potential", F.col("coordinates.x").alias("longitude"),
                    F.col("coordinates.y").alias("latitude")))


def station_coverage(stations: DataFrame) -> DataFrame:
    """Per dam: number of stations and the sorted distinct station types and
    monitored parameters (NULLs dropped).

    Aggregated on the stations side first: ``collect_set`` keeps a partial set
    per task, bounded by the number of distinct types/parameters, so a dam with
    a large share of all stations does not overload one task.
    """
    s = stations.where(F.col("dam_id").isNotNull())
    exploded = s.select("dam_id", "station_id", "station_type",
                        F.explode_outer("parameters_monitored").alias("parameter"))
    return exploded.groupBy("dam_id").agg(
        F.count_distinct("station_id").alias("station_count"),
        F.sort_array(F.collect_set("station_type")).alias("station_types"),
        F.sort_array(F.collect_set("parameter")).alias("all_parameters"),
    )


def monitoring_coverage(dams: DataFrame, stations: DataFrame) -> DataFrame:
    """Every dam with its station coverage; a dam without stations has 0 and
    empty lists.  The per-dam aggregate has one row per dam, so the join with
    dams is one-to-one."""
    cov = station_coverage(stations)
    empty = F.array().cast("array<string>")
    return (dams.select("dam_id", "dam_name").join(cov, "dam_id", "left")
            .select("dam_id", "dam_name",
                    F.coalesce("station_count", F.lit(0)).cast("bigint").alias("station_count"),
                    F.coalesce("station_types", empty).alias("station_types"),
                    F.coalesce("all_parameters", empty).alias("all_parameters")))


def dams_with_stations(dams: DataFrame, stations: DataFrame) -> DataFrame:
    """Dams that have at least one station, with count and parameters."""
    cov = station_coverage(stations)
    return (dams.select("dam_id", "dam_name").join(cov, "dam_id", "inner")
            .where(F.col("station_count") > 0)
            .select("dam_name", "station_count", "all_parameters"))


def recent_readings(readings: DataFrame, stations: DataFrame, n: int = RECENT_READINGS) -> DataFrame:
    """The ``n`` latest readings of every dam (ties broken by reading id).

    ``row_number() <= n`` is planned with a partial WindowGroupLimit before the
    shuffle, so each task forwards at most ``n`` rows per dam: a dam holding a
    large share of all readings costs a top-k per task, not one huge sort.
    """
    st = stations.where(F.col("dam_id").isNotNull()).select("station_id", "dam_id")
    r = readings.join(st, "station_id", "inner")
    w = Window.partitionBy("dam_id").orderBy(F.col("measurement_timestamp").desc(), F.col("reading_id").desc())
    return (r.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
            .select("dam_id", "reading_id", "parameter_type", "measurement_value", "measurement_timestamp"))


def priority_regions(summary: DataFrame, regions: DataFrame, names=None,
                     max_priority: int = PRIORITY_TOP) -> DataFrame:
    """Dam summary rows of the priority regions.

    ``names`` lists region names explicitly; by default the priority regions
    are those with ``priority_order <= max_priority`` in the regions table.
    """
    if names is not None:
        return summary.where(F.col("region_name").isin(list(names)))
    top = regions.where(F.col("priority_order") <= max_priority).select("region_name")
    return summary.join(top, "region_name", "left_semi")


def dam_activity(stations: DataFrame, readings: DataFrame) -> DataFrame:
    """(dam_id, _stations, _readings): readings counted per station, stations per dam."""
    per_station = (readings.where(F.col("station_id").isNotNull())
                   .groupBy("station_id").agg(F.count(F.lit(1)).alias("_n")))
    return (stations.where(F.col("dam_id").isNotNull()).select("station_id", "dam_id")
            .join(per_station, "station_id", "left")
            .groupBy("dam_id").agg(F.count("station_id").alias("_stations"), F.sum("_n").alias("_readings")))


def region_rollup(summary: DataFrame, stations: DataFrame, readings: DataFrame) -> DataFrame:
    """Per region: dams, stations and readings of those stations.

    Reduced level by level: readings to one count per station, stations to one row per
    dam, and the dams, joined one-to-one, to their region.  Every level is a partial
    aggregation in each task, so neither a station nor a dam nor a region that holds
    most of the rows ends in one task.  Station and dam ids are keys of their tables.
    """
    per_dam = dam_activity(stations, readings)
    count = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)
    return (summary.select("dam_id", "region_name").join(per_dam, "dam_id", "left")
            .groupBy("region_name").agg(F.count("dam_id").alias("dam_count"), count("_stations", "station_count"),
                                        count("_readings", "sensor_reading_count")))


def dam_inventory(summary: DataFrame) -> DataFrame:
    """Inventory listing ordered by region and name (every row, duplicates kept).  The key
    ends the order, so that the rows of one repeated name spread over the sort's ranges."""
    return (summary.orderBy("region_name", "dam_name", "dam_id")
            .select("dam_name", "region_name", "height_meters", "normal_capacity_mcm",
                    "construction_year", "primary_dam_type"))
