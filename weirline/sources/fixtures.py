"""Registry-shaped inputs derived from the driver's TPC-H-style tables.

The workload's real inputs (a registry attribute table, a metadata CSV, the
monitoring tables) are not shipped, so each is derived by one SELECT over the
driver tables (see FIXTURES.md).  Every SELECT runs unchanged in Spark SQL and
in DuckDB: table names are ``{placeholders}`` that Spark fills with DataFrames
(``spark.sql(text, orders=df, ...)``) and the oracle fills with view names.

Each derivation reads whole tables, so its size grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Registry attribute columns (all text except the id), in source order.
RAW_ATTRIBUTES = """cast(o.o_orderkey AS bigint) AS GDW_ID,
 CASE o.o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '   ' WHEN 2 THEN '-99' ELSE 'Dam ' || cast(o.o_orderkey - o.o_orderkey % 4 AS string) END AS DAM_NAME,
 CASE WHEN o.o_orderkey % 8 = 0 THEN NULL ELSE ' Alt ' || cast(o.o_orderkey AS string) END AS ALT_NAME,
 CASE WHEN o.o_orderkey % 4 = 0 THEN NULL ELSE 'Res ' || cast(o.o_orderkey AS string) END AS RES_NAME,
 CASE WHEN o.o_orderkey % 50 = 0 THEN NULL WHEN o.o_orderkey % 10 = 1 THEN 'Lock' WHEN o.o_orderkey % 20 = 3 THEN 'Lake Control Dam' ELSE 'Dam' END AS DAM_TYPE,
 CASE WHEN o.o_orderkey % 97 = 0 THEN '0' WHEN o.o_orderkey % 5 = 0 THEN '-99' WHEN o.o_orderkey % 5 = 1 THEN 'n/a' WHEN o.o_orderkey % 3 = 0 THEN cast(o.o_orderkey % 331 AS string) ELSE cast(o.o_orderkey % 331 AS string) || '.5' END AS DAM_HGT_M,
 CASE o.o_orderkey % 6 WHEN 0 THEN '-99' ELSE cast(o.o_orderkey % 2003 AS string) || '.25' END AS DAM_LEN_M,
 CASE o.o_orderkey % 7 WHEN 0 THEN '-99' ELSE cast(o.o_orderkey % 3001 AS string) || '.25' END AS CAP_MCM,
 CASE o.o_orderkey % 8 WHEN 0 THEN NULL ELSE cast(o.o_orderkey % 701 AS string) || '.125' END AS AREA_SKM,
 CASE o.o_orderkey % 9 WHEN 0 THEN '-99' ELSE cast(o.o_orderkey % 120 AS string) || '.5' END AS DEPTH_M,
 CASE o.o_orderkey % 9 WHEN 0 THEN '-99' WHEN 1 THEN '284' WHEN 2 THEN '2037' ELSE cast(1800 + o.o_orderkey % 230 AS string) END AS YEAR_DAM,
 CASE o.o_orderkey % 10 WHEN 0 THEN '1875' ELSE '-99' END AS PRE_YEAR,
 CASE o.o_orderkey % 10 WHEN 0 THEN 'c. 1875' ELSE '-99' END AS YEAR_TXT,
 CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE 'River ' || cast(o.o_orderkey % 300 AS string) END AS RIVER,
 CASE WHEN o.o_orderkey % 5 = 0 THEN '' ELSE 'Basin ' || cast(o.o_orderkey % 61 AS string) END AS MAIN_BASIN,
 CASE WHEN o.o_orderkey % 5 = 0 THEN 'nan' ELSE 'Sub ' || cast(o.o_orderkey % 173 AS string) END AS SUB_BASIN,
 cast(o.o_custkey % 358 - 179 AS string) || '.125' AS LONG_DAM,
 cast(o.o_custkey % 178 - 89 AS string) || '.125' AS LAT_DAM,
 CASE o.o_orderkey % 11 WHEN 0 THEN '-3' ELSE cast(o.o_orderkey % 1500 AS string) END AS ELEV_MASL,
 CASE o.o_orderkey % 12 WHEN 0 THEN '-99' ELSE cast(o.o_orderkey % 90001 AS string) || '.5' END AS CATCH_SKM,
 CASE o.o_orderkey % 11 WHEN 0 THEN 'Hydroelectricity' WHEN 1 THEN 'Irrigation' WHEN 2 THEN 'Water supply' WHEN 3 THEN 'Flood control' WHEN 4 THEN 'Unspecified' ELSE NULL END AS MAIN_USE,
 CASE o.o_orderkey % 5 WHEN 0 THEN 'Main' WHEN 1 THEN 'Sec' WHEN 2 THEN NULL ELSE 'Other' END AS USE_IRRI,
 CASE o.o_orderkey % 4 WHEN 0 THEN 'Main' WHEN 1 THEN NULL ELSE '' END AS USE_ELEC,
 CASE o.o_orderkey % 6 WHEN 0 THEN 'Sec' ELSE NULL END AS USE_SUPP,
 CASE o.o_orderkey % 7 WHEN 0 THEN 'Main' WHEN 1 THEN 'main' ELSE NULL END AS USE_FCON,
 CASE o.o_orderkey % 13 WHEN 0 THEN 'Sec' ELSE NULL END AS USE_RECR,
 CASE o.o_orderkey % 17 WHEN 0 THEN 'Main' ELSE NULL END AS USE_NAVI,
 CASE o.o_orderkey % 10 WHEN 0 THEN cast(o.o_orderkey % 900 AS string) || '.5' ELSE '-99' END AS POWER_MW,
 CASE o.o_orderkey % 14 WHEN 0 THEN '-99' ELSE cast(o.o_orderkey % 50021 AS string) END AS DIS_AVG_LS,
 CASE WHEN o.o_orderkey % 7 = 0 THEN '2: verified' ELSE cast(o.o_orderkey % 7 AS string) END AS QUALITY,
 CASE WHEN o.o_orderkey % 5000 = 0 THEN n.n_name || ' Republic' WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE 'note ' || cast(o.o_orderkey % 17 AS string) END AS COMMENTS,
 CASE WHEN o.o_orderkey % 2 = 0 THEN 'None' ELSE 'src' || cast(o.o_orderkey % 4 AS string) END AS ORIG_SRC,
 'ed' || cast(o.o_orderkey % 3 AS string) AS EDITOR,
 n.n_name || ' Republic' AS COUNTRY,
 'Unit ' || cast(c.c_custkey % 40 AS string) AS ADMIN_UNIT,
 CASE WHEN c.c_custkey % 3 = 0 THEN NULL ELSE c.c_mktsegment END AS NEAR_CITY,
 n.n_nationkey AS nationkey"""

_REGISTRY_FROM = (
    "FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey "
    "JOIN {nation} n ON c.c_nationkey = n.n_nationkey"
)

# Barrier geometry: the point at (LONG_DAM, LAT_DAM), as WKT.
_POINT_WKT = (
    "'POINT (' || cast(o.o_custkey % 358 - 179 AS string) || '.125 ' "
    "|| cast(o.o_custkey % 178 - 89 AS string) || '.125)' AS geometry"
)

# Reservoir geometry: a right triangle per order, as WKT.  Its area centroid is
# (x0 + 1, y0 + 1); the mean of the closed ring's vertices is not.
_POLYGON_WKT = """'POLYGON ((' || cast(o.o_custkey % 300 - 150 AS string) || ' ' || cast(o.o_custkey % 150 - 75 AS string) || ', '
  || cast(o.o_custkey % 300 - 147 AS string) || ' ' || cast(o.o_custkey % 150 - 75 AS string) || ', '
  || cast(o.o_custkey % 300 - 150 AS string) || ' ' || cast(o.o_custkey % 150 - 72 AS string) || ', '
  || cast(o.o_custkey % 300 - 150 AS string) || ' ' || cast(o.o_custkey % 150 - 75 AS string) || '))' AS geometry"""

FIXTURES: dict[str, str] = {
    # registry of barriers: attributes + point geometry (every order is a barrier)
    "raw_barriers": f"SELECT {RAW_ATTRIBUTES},\n {_POINT_WKT}\n{_REGISTRY_FROM}",
    # registry of reservoirs: the same attributes + polygon geometry
    "raw_reservoirs": f"SELECT {RAW_ATTRIBUTES},\n {_POLYGON_WKT}\n{_REGISTRY_FROM}",
    # metadata table (the CSV the enrichment reads): attributes only
    "raw_metadata": f"SELECT {RAW_ATTRIBUTES}\n{_REGISTRY_FROM}",
    "regions": """SELECT cast(n_nationkey AS bigint) AS region_id, n_name AS region_name, 'country' AS region_type,
 cast(100 + n_regionkey AS bigint) AS parent_region_id, n_nationkey + 1 AS priority_order FROM {nation}
UNION ALL
SELECT cast(100 + r_regionkey AS bigint), r_name, 'continent', NULL, 999 FROM {region}""",
    # ids of sources are even numbers, so that some references have no source
    "data_sources": "SELECT cast(s_suppkey * 2 AS string) AS source_id, 'Source ' || cast(s_suppkey AS string) AS source_name FROM {supplier}",
    "dam_sources": """SELECT 'B' || cast(o_orderkey AS string) AS dam_id,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE cast(o_custkey % 21 AS string) END AS primary_data_source_id,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE split(cast(o_custkey % 16 AS string) || ',' || cast(o_orderkey % 10 AS string), ',') END AS secondary_data_sources
FROM {orders}""",
    "station_sources": """SELECT c_custkey AS station_id, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE cast(c_custkey % 25 AS string) END AS data_source_id
FROM {customer}""",
    "dam_links": """SELECT cast(o.o_orderkey AS bigint) AS GDW_ID, 'B' || cast(o.o_orderkey AS string) AS dam_id,
 CASE WHEN o.o_orderkey % 9 = 0 THEN NULL ELSE cast(c.c_nationkey AS bigint) END AS region_id,
 CASE WHEN o.o_orderkey % 4 = 0 THEN NULL ELSE cast(o.o_orderkey % 10 AS int) END AS primary_dam_type_id,
 CASE o.o_orderkey % 4 WHEN 0 THEN 'planned' ELSE 'operational' END AS construction_status,
 CASE o.o_orderkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE NULL END AS hazard_potential
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey""",
    "monitoring_stations": """SELECT c_custkey AS station_id,
 CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 'B' || cast(c_custkey - c_custkey % 3 AS string) END AS dam_id,
 c_name AS station_name, c_mktsegment AS station_type,
 CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN split('water_level,flow_rate', ',') WHEN 2 THEN split('temperature', ',') ELSE split('flow_rate,temperature', ',') END AS parameters_monitored,
 CASE WHEN c_custkey % 5 = 0 THEN 'maintenance' ELSE 'active' END AS status
FROM {customer}""",
    "sensor_readings": """SELECT event_id AS reading_id, user_id AS station_id, event_type AS parameter_type,
 cast(value AS decimal(15,4)) AS measurement_value, 'u' AS unit, ts AS measurement_timestamp,
 CASE event_id % 4 WHEN 0 THEN 'excellent' WHEN 1 THEN 'good' WHEN 2 THEN 'fair' ELSE 'poor' END AS quality_code
FROM {events}""",
    "shm_sensors": """SELECT s_suppkey AS sensor_id, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE s_suppkey END AS station_id,
 CASE s_suppkey % 3 WHEN 0 THEN 'strain_gauge' WHEN 1 THEN 'fiber_optic' ELSE 'accelerometer' END AS sensor_type
FROM {supplier}""",
}

# Driver tables each fixture reads, and the columns it needs from them (so the
# parquet scan reads only those columns).
_SOURCES = {
    "raw_barriers": ("orders", "customer", "nation"),
    "raw_reservoirs": ("orders", "customer", "nation"),
    "raw_metadata": ("orders", "customer", "nation"),
    "regions": ("nation", "region"),
    "dam_links": ("orders", "customer"),
    "monitoring_stations": ("customer",),
    "sensor_readings": ("events",),
    "shm_sensors": ("supplier",),
    "data_sources": ("supplier",),
    "dam_sources": ("orders",),
    "station_sources": ("customer",),
}
_COLUMNS = {
    "orders": ["o_orderkey", "o_custkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "region": ["r_regionkey", "r_name"],
    "events": ["event_id", "ts", "user_id", "event_type", "value"],
    "supplier": ["s_suppkey"],
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, pruned to the columns the fixtures use.

    Some thirty text columns are derived from every order.  Where the orders come in fewer
    files than the session has cores, their keys are dealt out first, so that all cores derive.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*_COLUMNS[name])
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, "o_orderkey") if name == "orders" and len(df.inputFiles()) < cores else df


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build fixture ``name`` in Spark from the parquet tables under ``sf_dir``."""
    tables = {t: read_table(spark, sf_dir, t) for t in _SOURCES[name]}
    return spark.sql(FIXTURES[name], **tables)


def fixture_sql(name: str) -> str:
    """The same derivation as SQL over plain table names (for the oracle)."""
    return FIXTURES[name].format(**{t: t for t in _SOURCES[name]})
