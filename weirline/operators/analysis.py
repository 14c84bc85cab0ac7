"""Analyses over the typed enrichment table, the dams table and the enriched view.

Conventions shared with the SQL oracle (see ``weirline.functions.stats``):
percentages and averages are computed in double from exact sums and rounded
once; ``COALESCE(x, 'Unspecified')`` is applied after grouping on the raw
column, so a NULL group and a literal 'Unspecified' stay two rows.

Shares of a total: where the classes are few by definition (size classes), the total is
a window sum over the aggregated classes, so the table is read once.  Where the groups
are free text and may be many, no task sees them all: the total is a separate count,
joined back as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirline.functions.stats import count_true, exact_avg, pct, round_dbl
from weirline.operators.enrich import ViewParts
from weirline.operators.purge import authentic_rows
from weirline.operators.spread import spread_join
from weirline.sources.sinks import staged

# ---------------------------------------------------------------------------
# Labels and class bounds of the published tables.
# ---------------------------------------------------------------------------
UNSPECIFIED = "Unspecified"
HEIGHT_CLASSES = [(15, "Small (<15m)"), (30, "Medium (15-30m)"), (60, "Large (30-60m)"),
                  (150, "Major (60-150m)")]
HEIGHT_TOP = "Mega (>150m)"
CAPACITY_CLASSES = [(1, "Micro (<1 MCM)"), (10, "Small (1-10 MCM)"), (100, "Medium (10-100 MCM)"),
                    (1000, "Large (100-1000 MCM)")]
CAPACITY_TOP = "Major (>1000 MCM)"
PERIODS = [(1900, "1800-1899"), (1920, "1900-1919"), (1940, "1920-1939"), (1960, "1940-1959"),
           (1980, "1960-1979"), (2000, "1980-1999")]
PERIOD_TOP = "2000-2024"
TIMELINE_MIN_YEAR, TIMELINE_MAX_YEAR = 1800, 2024
USE_TYPES = [("Hydropower", "use_hydropower"), ("Irrigation", "use_irrigation"),
             ("Water Supply", "use_water_supply"), ("Flood Control", "use_flood_control"),
             ("Recreation", "use_recreation"), ("Navigation", "use_navigation")]
DATASET_DAMS, DATASET_ENRICHMENT, DATASET_VIEW = (
    "Original Dams Table", "Enrichment Metadata", "Combined Enriched View")
ENRICHMENT_COUNTRY_PREFIX = 3
COUNTRY_MIN_DAMS, COUNTRY_TOP = 100, 25
BASIN_MIN_DAMS, BASIN_TOP = 50, 20


def bucket(c: Column, bounds, top: str) -> Column:
    """First bound ``c < b`` wins; anything else (also 150 exactly) is ``top``."""
    expr = None
    for b, label in bounds:
        expr = F.when(c < b, F.lit(label)) if expr is None else expr.when(c < b, F.lit(label))
    return expr.otherwise(F.lit(top))


def _share_of_classes(per: DataFrame, count_col: str) -> DataFrame:
    """Attach the total of ``count_col`` over a handful of classes."""
    return per.withColumn("_total", F.sum(count_col).over(Window.partitionBy()))


def _share_of_total(per: DataFrame, source: DataFrame) -> DataFrame:
    """Attach the number of rows of ``source`` (one row, columns pruned away)."""
    return per.crossJoin(F.broadcast(source.agg(F.count(F.lit(1)).alias("_total"))))


# --------------------------------------------------------------------- A2
def infrastructure_types(e: DataFrame) -> DataFrame:
    """Per dam type: count, share of all rows, mean height/capacity, two use counts."""
    per = e.groupBy("dam_type").agg(
        F.count(F.lit(1)).alias("dam_count"),
        exact_avg("height_meters_gdw").alias("avg_height_m"),
        exact_avg("capacity_mcm_gdw").alias("avg_capacity_mcm"),
        count_true("use_hydropower").alias("hydropower_count"),
        count_true("use_irrigation").alias("irrigation_count"),
    )
    return (_share_of_total(per.where(F.col("dam_type").isNotNull()), e)
            .select(F.coalesce("dam_type", F.lit(UNSPECIFIED)).alias("infrastructure_type"),
                    "dam_count", pct("dam_count", "_total").alias("percentage"),
                    "avg_height_m", "avg_capacity_mcm", "hydropower_count", "irrigation_count")
            .orderBy(F.col("dam_count").desc(), F.col("infrastructure_type")))


def _size_classes(e: DataFrame, col: str, bounds, top: str, label: str, digits: int,
                  suffix: str) -> DataFrame:
    """Size classes of a positive measure; the share's denominator counts every
    non-NULL value, zeros included (they dilute it, as in the original)."""
    x = F.col(col)
    known = e.where(x.isNotNull())
    cls = F.when(x > 0, bucket(x, bounds, top))
    per = known.groupBy(cls.alias(label)).agg(
        F.count(F.lit(1)).alias("dam_count"),
        F.min(x).alias("_min"),
        F.max(x).alias("_max"),
        exact_avg(x, digits).alias(f"avg_{suffix}"),
    )
    return (_share_of_classes(per, "dam_count").where(F.col(label).isNotNull())
            .select(label, "dam_count", pct("dam_count", "_total").alias("percentage"),
                    round_dbl(F.col("_min"), digits).alias(f"min_{suffix}"),
                    round_dbl(F.col("_max"), digits).alias(f"max_{suffix}"),
                    f"avg_{suffix}", "_min")
            .orderBy("_min").drop("_min"))


# --------------------------------------------------------------------- A3
def height_classes(e: DataFrame) -> DataFrame:
    return _size_classes(e, "height_meters_gdw", HEIGHT_CLASSES, HEIGHT_TOP, "height_category", 1, "height_m")


# --------------------------------------------------------------------- A8
def capacity_classes(e: DataFrame) -> DataFrame:
    return _size_classes(e, "capacity_mcm_gdw", CAPACITY_CLASSES, CAPACITY_TOP, "capacity_category", 2, "capacity_mcm")


# --------------------------------------------------------------------- A4
def purposes(e: DataFrame) -> DataFrame:
    per = e.groupBy("primary_purpose").agg(
        F.count(F.lit(1)).alias("dam_count"),
        exact_avg("height_meters_gdw").alias("avg_height_m"),
        exact_avg("capacity_mcm_gdw").alias("avg_capacity_mcm"),
    )
    return (_share_of_total(per, e)
            .select(F.coalesce("primary_purpose", F.lit(UNSPECIFIED)).alias("primary_purpose"),
                    "dam_count", pct("dam_count", "_total").alias("percentage"),
                    "avg_height_m", "avg_capacity_mcm")
            .orderBy(F.col("dam_count").desc(), F.col("primary_purpose"), F.col("avg_height_m")))


def _unpivot_counts(wide: DataFrame, items, name_col: str, count_col: str) -> DataFrame:
    """One wide row of counts -> one row per item (no extra scan)."""
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(label).alias(name_col), F.col(f"_c{i}").alias(count_col), F.col("_n").alias("_n"))
        for i, (label, _) in enumerate(items)
    ])).alias("s")).select("s.*")


# --------------------------------------------------------------------- A5
def usage_patterns(e: DataFrame) -> DataFrame:
    """Six use flags in one pass (the original scans the table six times)."""
    wide = e.agg(F.count(F.lit(1)).alias("_n"),
                 *[count_true(c).alias(f"_c{i}") for i, (_, c) in enumerate(USE_TYPES)])
    long = _unpivot_counts(wide, USE_TYPES, "use_type", "count")
    return (long.select("use_type", "count", pct("count", "_n").alias("percentage"))
            .orderBy(F.col("count").desc(), F.col("use_type")))


# --------------------------------------------------------------------- A10
def completeness(e: DataFrame) -> DataFrame:
    """Seven field-completeness rows in one pass."""
    h, cap = F.col("height_meters_gdw"), F.col("capacity_mcm_gdw")
    fields = [
        ("Dam Names", F.col("dam_name_gdw").isNotNull()),
        ("Infrastructure Type", F.col("dam_type").isNotNull()),
        ("Height Data", h.isNotNull() & (h > 0)),
        ("Capacity Data", cap.isNotNull() & (cap > 0)),
        ("Construction Year", F.col("construction_year_gdw").isNotNull()),
        ("Primary Purpose", F.col("primary_purpose").isNotNull()),
        ("River Information", F.col("river_name").isNotNull()),
    ]
    wide = e.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(p).alias(f"_c{i}") for i, (_, p) in enumerate(fields)])
    long = _unpivot_counts(wide, fields, "field_name", "complete_count")
    return (long.select("field_name", "complete_count", F.col("_n").alias("total_count"),
                        pct("complete_count", "_n").alias("completeness_percentage"))
            .orderBy(F.col("completeness_percentage").desc(), F.col("field_name")))


# --------------------------------------------------------------------- A7
def basin_analysis(e: DataFrame) -> DataFrame:
    return (e.where(F.col("main_basin").isNotNull())
            .groupBy("main_basin").agg(
                F.count(F.lit(1)).alias("dam_count"),
                F.count_distinct("river_name").alias("unique_rivers"),
                exact_avg("height_meters_gdw").alias("avg_height_m"),
                count_true("use_hydropower").alias("hydropower_count"))
            .where(F.col("dam_count") >= BASIN_MIN_DAMS)
            .orderBy(F.col("dam_count").desc(), F.col("main_basin"))
            .limit(BASIN_TOP)
            .select(F.col("main_basin").alias("river_basin"), "dam_count", "unique_rivers",
                    "avg_height_m", "hydropower_count"))


# --------------------------------------------------------------------- A9
def timeline(e: DataFrame) -> DataFrame:
    y = F.col("construction_year_gdw")
    return (e.where(y.isNotNull() & (y >= TIMELINE_MIN_YEAR) & (y <= TIMELINE_MAX_YEAR))
            .groupBy(bucket(y, PERIODS, PERIOD_TOP).alias("construction_period"))
            .agg(F.count(F.lit(1)).alias("dams_built"),
                 exact_avg("height_meters_gdw").alias("avg_height_m"),
                 exact_avg("capacity_mcm_gdw").alias("avg_capacity_mcm"),
                 count_true("use_hydropower").alias("hydropower_dams"),
                 F.min(y).alias("_first"))
            .orderBy("_first").drop("_first"))


# --------------------------------------------------------------------- A6
def country_analysis(dams: DataFrame, e: DataFrame, min_dams: int = COUNTRY_MIN_DAMS,
                     top: int = COUNTRY_TOP) -> DataFrame:
    """Per country over ``authentic dams LEFT JOIN enrichment ON name``.

    The original counts joined rows, so a name shared by k metadata rows
    counts a dam k times.  The same numbers come out without materialising
    that fan-out: the metadata side is first reduced to one row per name
    (count, exact height sum/count/max, NULL-height count, use counts), the
    dams join it many-to-one, and each dam contributes its k rows
    arithmetically.  Dams that agree in country, name and height are counted
    first and written; a name that many of these rows have is dealt to several
    tasks, and rows without a name pass by the join.
    """
    per_name = (e.where(F.col("dam_name_gdw").isNotNull())
                .groupBy("dam_name_gdw").agg(
                    F.count(F.lit(1)).alias("_k"),
                    F.count_if(F.col("height_meters_gdw").isNull()).alias("_k_hnull"),
                    F.sum("height_meters_gdw").alias("_h_sum"),
                    F.count("height_meters_gdw").alias("_h_cnt"),
                    F.max("height_meters_gdw").alias("_h_max"),
                    count_true("use_hydropower").alias("_hydro"),
                    count_true("use_irrigation").alias("_irr")))
    d = staged(authentic_rows(dams).groupBy("country_code", "dam_name", "height_meters").agg(F.count(F.lit(1)).alias("_dams")), "dams-counted")
    j = spread_join(d, per_name, "dam_name", "dam_name_gdw", "left")

    hd = F.col("height_meters")
    matched = F.col("_k").isNotNull()
    # COALESCE(h_gdw, h_dam) summed over the dam's joined rows
    h_sum = F.when(matched, F.coalesce(F.col("_h_sum"), F.lit(0)) + F.when(hd.isNotNull(), F.col("_k_hnull") * hd)
                   .otherwise(0)).otherwise(hd)
    h_cnt = F.when(matched, F.col("_h_cnt") + F.when(hd.isNotNull(), F.col("_k_hnull")).otherwise(0)) \
        .otherwise(F.when(hd.isNotNull(), 1).otherwise(0))
    h_max = F.when(matched, F.greatest(F.col("_h_max"), F.when(F.col("_k_hnull") > 0, hd))).otherwise(hd)

    m = F.col("_dams")
    per_dam = j.select(
        "country_code",
        (F.coalesce(F.col("_k"), F.lit(1)) * m).alias("rows"),
        (F.coalesce(F.col("_k"), F.lit(0)) * m).alias("enriched"),
        (h_sum * m).alias("h_sum"), (h_cnt * m).alias("h_cnt"), h_max.alias("h_max"),
        (F.coalesce(F.col("_hydro"), F.lit(0)) * m).alias("hydro"),
        (F.coalesce(F.col("_irr"), F.lit(0)) * m).alias("irr"),
    )
    per_country = per_dam.groupBy("country_code").agg(
        F.sum("rows").alias("total_dams"),
        F.sum("enriched").alias("enriched_dams"),
        F.sum("h_sum").alias("_h_sum"),
        F.sum("h_cnt").alias("_h_cnt"),
        F.max("h_max").alias("_h_max"),
        F.sum("hydro").alias("hydropower_dams"),
        F.sum("irr").alias("irrigation_dams"),
    )
    return (per_country.where(F.col("total_dams") >= min_dams)
            .orderBy(F.col("total_dams").desc(), F.col("country_code").asc_nulls_last())
            .limit(top)
            .select("country_code", "total_dams", "enriched_dams",
                    pct("enriched_dams", "total_dams", 1).alias("enrichment_coverage"),
                    F.round(F.try_divide(F.col("_h_sum").cast("double"), F.col("_h_cnt").cast("double")), 2)
                    .alias("avg_height"),
                    round_dbl(F.col("_h_max"), 2).alias("max_height"),
                    "hydropower_dams", "irrigation_dams"))


# --------------------------------------------------------------------- A1
def overview(dams: DataFrame, e: DataFrame, view: ViewParts | DataFrame) -> DataFrame:
    """Three one-row summaries (dams, metadata, enriched view), stacked."""
    d = authentic_rows(dams)
    a = d.agg(F.lit(DATASET_DAMS).alias("dataset"), F.count(F.lit(1)).alias("record_count"),
              F.count_distinct("country_code").alias("countries"),
              F.min("construction_year").alias("earliest_year"), F.max("construction_year").alias("latest_year"),
              exact_avg("height_meters").alias("avg_height_m"),
              round_dbl(F.max("height_meters"), 2).alias("max_height_m"))
    b = (e.where(F.col("height_meters_gdw").isNotNull())
         .agg(F.lit(DATASET_ENRICHMENT).alias("dataset"), F.count(F.lit(1)).alias("record_count"),
              F.count_distinct(F.substring("gdw_comments", 1, ENRICHMENT_COUNTRY_PREFIX)).alias("countries"),
              F.min("construction_year_gdw").alias("earliest_year"),
              F.max("construction_year_gdw").alias("latest_year"),
              exact_avg("height_meters_gdw").alias("avg_height_m"),
              round_dbl(F.max("height_meters_gdw"), 2).alias("max_height_m")))
    c = ViewParts.of(view).totals(summary=True).select(
        F.lit(DATASET_VIEW).alias("dataset"), F.col("rows").alias("record_count"), "countries",
        F.col("first_year").alias("earliest_year"), F.col("last_year").alias("latest_year"),
        F.round(F.try_divide(F.col("h_sum").cast("double"), F.col("h_cnt").cast("double")), 2).alias("avg_height_m"),
        round_dbl(F.col("h_max"), 2).alias("max_height_m"))
    return a.unionByName(b).unionByName(c)


# --------------------------------------------------------------------- A17
def report_means(countries: DataFrame, fields: DataFrame) -> DataFrame:
    """Mean enrichment coverage over the country table and mean completeness."""
    a = countries.agg(F.round(F.avg("enrichment_coverage"), 4).alias("mean_enrichment_coverage"))
    b = fields.agg(F.round(F.avg("completeness_percentage"), 4).alias("mean_completeness"))
    return a.crossJoin(b)
