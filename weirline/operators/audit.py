"""Load validation and data-quality audits.

The original relies on database constraints (CHECK, PRIMARY KEY, NOT NULL,
VARCHAR(n), REFERENCES).  Spark enforces none of them, so each becomes an
audit that counts violations in one pass per table.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from weirline.operators.enrich import ViewParts
from weirline.schemas import DAMS_LENGTH_LIMITS

log = logging.getLogger(__name__)

TOP_COUNTRIES = 10
SAMPLE_NAMES = 5
# CHECK constraints of the dams table.
YEAR_CHECK_MIN, YEAR_CHECK_MAX = 1800, 2050


def _stack(wide: DataFrame, items, name_col: str, value_col: str, extra=None) -> DataFrame:
    """One wide row -> one row per item."""
    structs = []
    for i, item in enumerate(items):
        fields = [F.lit(item[0]).alias(name_col)]
        if extra:
            fields += [F.lit(v).alias(k) for k, v in extra(item).items()]
        fields.append(F.col(f"_v{i}").alias(value_col))
        structs.append(F.struct(*fields))
    return wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def country_distribution(dams: DataFrame, top: int = TOP_COUNTRIES) -> DataFrame:
    return (dams.groupBy("country_code").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("country_code").asc_nulls_last()).limit(top))


def score_distribution(dams: DataFrame) -> DataFrame:
    return (dams.groupBy("data_quality_score").agg(F.count(F.lit(1)).alias("count"))
            .orderBy("data_quality_score"))


def bounding_box(dams: DataFrame) -> DataFrame:
    p = F.col("coordinates")
    return dams.where(p.isNotNull()).agg(
        F.min(p["x"]).alias("min_longitude"), F.max(p["x"]).alias("max_longitude"),
        F.min(p["y"]).alias("min_latitude"), F.max(p["y"]).alias("max_latitude"))


def sample_names(dams: DataFrame, n: int = SAMPLE_NAMES) -> DataFrame:
    """A few names; ordered by key so the sample is the same on every run."""
    return (dams.where(F.col("dam_name").isNotNull()).orderBy("dam_id").limit(n)
            .select("dam_id", "dam_name"))


def year_summary(dams: DataFrame) -> DataFrame:
    y = F.col("construction_year")
    return dams.agg(F.count(F.lit(1)).alias("total"), F.min(y).alias("min_year"),
                    F.max(y).alias("max_year"), F.count(y).alias("with_year"))


# Fields and uses of the view that the checks count.
VIEW_FIELDS = ["height_meters", "height_meters_gdw", "primary_purpose", "river_name", "main_basin", "longitude_precise"]
VIEW_USES = ["use_irrigation", "use_hydropower"]


def enrichment_checks(dams_authentic: DataFrame, enrichment: DataFrame, view: ViewParts | DataFrame) -> DataFrame:
    """All post-enrichment counts in one row: one aggregate per table."""
    a = dams_authentic.agg(F.count(F.lit(1)).alias("main_dams_count"))
    b = enrichment.agg(F.count(F.lit(1)).alias("enrichment_records"))
    c = ViewParts.of(view).totals(VIEW_FIELDS, VIEW_USES).select(
        F.col("rows").alias("enriched_view_count"),
        F.col("height_meters").alias("original_height_count"),
        F.col("height_meters_gdw").alias("enriched_height_count"),
        F.col("primary_purpose").alias("purpose_count"),
        F.col("use_irrigation").alias("irrigation_count"),
        F.col("use_hydropower").alias("hydropower_count"),
        F.col("river_name").alias("rivers_identified"),
        F.col("main_basin").alias("basins_identified"),
        F.col("longitude_precise").alias("precise_coordinates"),
    )
    return a.crossJoin(b).crossJoin(c)


def enrichment_check_frames(dams_authentic: DataFrame, enrichment: DataFrame, view: ViewParts | DataFrame) -> dict[str, DataFrame]:
    """The post-enrichment counts as checks of their own, one per table."""
    n = F.count(F.lit(1))
    return {
        "main_dams": dams_authentic.agg(n.alias("main_dams_count")),
        "enrichment": enrichment.agg(n.alias("enrichment_records")),
        "view": ViewParts.of(view).totals().select(F.col("rows").alias("enriched_view_count")),
        "fields": ViewParts.of(view).totals(VIEW_FIELDS).drop("rows"),
        "uses": ViewParts.of(view).totals(true=VIEW_USES).drop("rows"),
    }


def run_checks(checks: dict) -> dict:  # name -> one-row frame, or a function that builds it
    """Collect each named one-row check; a failing check records its error and
    the others still run."""
    out = {}
    for name, df in checks.items():
        try:
            rows = (df() if callable(df) else df).collect()
            out[name] = rows[0].asDict() if rows else {}
        except Exception as exc:  # noqa: BLE001 - reported, not raised
            log.error("check %s failed: %s", name, exc)
            out[name] = {"error": str(exc)}
    return out


def constraint_audit(dams: DataFrame) -> DataFrame:
    """CHECK constraints (NULL passes): violations per rule, one pass."""
    h, cap, y = F.col("height_meters"), F.col("normal_capacity_mcm"), F.col("construction_year")
    rules = [
        ("check_height_positive", h <= 0),
        ("check_capacity_positive", cap <= 0),
        ("check_construction_year_reasonable", (y < YEAR_CHECK_MIN) | (y > YEAR_CHECK_MAX)),
    ]
    wide = dams.agg(*[F.count_if(p).alias(f"_v{i}") for i, (_, p) in enumerate(rules)])
    return _stack(wide, rules, "rule", "violations")


def key_audit(tables: dict) -> DataFrame:
    """Primary keys (duplicates, NULLs) and NOT NULL columns.

    ``tables`` maps a name to ``(frame, key column, [not-null columns])``.
    Duplicate detection is a count per key with partial aggregation, so a hot
    key is pre-counted in every task before the shuffle.
    """
    parts = []
    for name, (df, key, not_null) in tables.items():
        dups = (df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
                .where(F.col("_n") > 1).agg(F.count(F.lit(1)).alias("_v")))
        parts.append(dups.select(F.lit(name).alias("table_name"), F.lit(f"duplicate {key}").alias("check_name"),
                                 F.col("_v").alias("violations")))
        cols = [key] + list(not_null)
        wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"_v{i}") for i, c in enumerate(cols)])
        parts.append(_stack(wide, [(f"null {c}",) for c in cols], "check_name", "violations")
                     .select(F.lit(name).alias("table_name"), "check_name", "violations"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def length_audit(dams: DataFrame, limits: dict | None = None) -> DataFrame:
    """VARCHAR(n) limits: values longer than n characters, per column."""
    limits = limits or DAMS_LENGTH_LIMITS
    items = [(c, n) for c, n in limits.items() if c in dams.columns]
    wide = dams.agg(*[F.count_if(F.length(c) > n).alias(f"_v{i}") for i, (c, n) in enumerate(items)])
    return _stack(wide, items, "column_name", "violations", extra=lambda it: {"max_length": it[1]})


def orphan_audit(relations: dict) -> DataFrame:
    """Foreign-key orphans: child rows whose non-NULL key has no parent.

    ``relations`` maps a name to ``(child, child key, parent, parent key)``.  A child key may
    be an array of keys: each of its elements is a key, and NULL elements are none.
    The child is first reduced to one count per key value (partial aggregation
    in each task), so the anti join moves distinct keys, not child rows.
    """
    parts = []
    for name, (child, ck, parent, pk) in relations.items():
        if isinstance(child.schema[ck].dataType, ArrayType):
            child = child.select(F.explode(ck).alias(ck))
        per_key = (child.where(F.col(ck).isNotNull()).groupBy(F.col(ck).alias("_k"))
                   .agg(F.count(F.lit(1)).alias("_n")))
        parents = parent.select(F.col(pk).alias("_k")).where(F.col("_k").isNotNull()).distinct()
        orphans = per_key.join(parents, "_k", "left_anti").agg(F.sum("_n").alias("_o"))
        parts.append(orphans.select(F.lit(name).alias("relation"),
                                    F.coalesce(F.col("_o"), F.lit(0)).cast("bigint").alias("orphans")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def geometry_audit(dams: DataFrame) -> DataFrame:
    """Points must have finite coordinates; values outside +-180 / +-90 are
    reported separately (they are valid planar points but not lon/lat)."""
    p = F.col("coordinates")
    x, y = p["x"], p["y"]

    def finite(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))

    valid = p.isNotNull() & finite(x) & finite(y)
    return dams.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~valid).alias("invalid_points"),
        F.count_if(valid & ((F.abs(x) > 180) | (F.abs(y) > 90))).alias("out_of_range"),
    )


def source_orphans(dam_sources: DataFrame, station_sources: DataFrame, data_sources: DataFrame) -> dict:
    """Relations of dams and stations to the sources of their data."""
    return {
        "dams.primary_data_source_id -> data_sources": (dam_sources, "primary_data_source_id", data_sources, "source_id"),
        "dams.secondary_data_sources[] -> data_sources": (dam_sources, "secondary_data_sources", data_sources, "source_id"),
        "monitoring_stations.data_source_id -> data_sources": (station_sources, "data_source_id", data_sources, "source_id"),
    }


def reference_orphans(dams: DataFrame, regions: DataFrame, dam_types: DataFrame) -> dict:
    """Relations of the dams table to its small reference tables, and of regions to each other."""
    return {
        "regions.parent_region_id -> regions": (regions, "parent_region_id", regions, "region_id"),
        "dams.region_id -> regions": (dams, "region_id", regions, "region_id"),
        "dams.primary_dam_type_id -> dam_types": (dams, "primary_dam_type_id", dam_types, "type_id"),
    }
