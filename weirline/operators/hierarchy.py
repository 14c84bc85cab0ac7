"""Rollups along a hierarchy (regions and the regions they lie in)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirline.operators.monitoring import dam_activity
from weirline.sources.sinks import staged


def closure(nodes: DataFrame, id_col: str, parent_col: str) -> tuple[DataFrame, DataFrame]:
    """(node, ancestor, depth) for every node and every ancestor, itself at depth 0; and the
    nodes that lie on a cycle (column node).

    One join per level, each written before the next.  A pair is followed once, at its least
    depth, so a cycle ends the walk: its nodes are each other's ancestors.  A parent that is
    no node ends the path.
    """
    ids = nodes.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("node")).distinct()
    up = nodes.where(F.col(id_col).isNotNull() & F.col(parent_col).isNotNull()).select(F.col(id_col).alias("node"), F.col(parent_col).alias("parent")).distinct()
    edges = staged(up.join(ids.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", "parent"), "edges")
    known = staged(ids.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")), "closure")
    front = edges.select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    while True:
        front = staged(front.join(known, ["node", "ancestor"], "left_anti"), "level")
        if front.isEmpty():
            break
        known = staged(known.unionByName(front), "closure")
        e = edges.select(F.col("node").alias("at"), "parent")
        front = front.join(e, F.col("ancestor") == F.col("at")).select("node", F.col("parent").alias("ancestor"), (F.col("depth") + 1).alias("depth")).distinct()
    back = edges.select(F.col("node").alias("ancestor"), F.col("parent").alias("node"))
    return known, known.join(back, ["node", "ancestor"], "left_semi").select("node").distinct()


def hierarchy_rollup(regions: DataFrame, dams: DataFrame, stations: DataFrame, readings: DataFrame) -> DataFrame:
    """Every region with the dams, stations and readings of its whole subtree.

    Everything is reduced to one row per region before it meets the closure, so what is
    joined grows with the regions and their depth.  Members of a cycle share their totals.
    """
    own = dams.where(F.col("region_id").isNotNull()).select("dam_id", "region_id").join(dam_activity(stations, readings), "dam_id", "left") \
        .groupBy("region_id").agg(F.count("dam_id").alias("dams"), F.sum("_stations").alias("stations"), F.sum("_readings").alias("readings"))
    reach, cyclic = closure(regions, "region_id", "parent_region_id")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)
    below = reach.join(own, F.col("node") == F.col("region_id"), "left").groupBy(F.col("ancestor").alias("region_id")).agg(
        (F.count("node") - 1).alias("descendants"), total("dams", "dam_count"), total("stations", "station_count"), total("readings", "sensor_reading_count"))
    level = reach.groupBy(F.col("node").alias("region_id")).agg(F.max("depth").alias("level"))
    ring = cyclic.select(F.col("node").alias("region_id"), F.lit(True).alias("on_cycle"))
    return regions.select("region_id", "region_name", "region_type").join(level, "region_id").join(below, "region_id").join(ring, "region_id", "left") \
        .select("region_id", "region_name", "region_type", "level", "descendants", "dam_count", "station_count", "sensor_reading_count",
                F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))
