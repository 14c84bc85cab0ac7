"""Independent SQL (DuckDB dialect) for every checked query.

Each statement is written from the meaning of the operator, in a form of its own: the
enriched view as matching pairs plus the dams for which no match exists, summaries as
filtered counts over one narrow relation, cascades as set membership.  Patterns, bounds
and labels are stated here again, so that a wrong one in the package shows; only the
fixture derivations and the column lists are shared with the Spark code.

Output conventions (same as ``weirline.plans.catalog.flat``): decimals as
DOUBLE, timestamps as text ``YYYY-MM-DD HH:MM:SS.ffffff``, points as
``<name>_x`` / ``<name>_y``, lists as comma-joined text.
"""

from __future__ import annotations

from weirline.plans.workspace import BARRIERS_LOADED_AT, RESERVOIRS_LOADED_AT, RUN_TS
from weirline.schemas import DAMS_LENGTH_LIMITS, METADATA_SOURCE_FIELDS
from weirline.sources.fixtures import fixture_sql

# Fixed values, stated independently of the package.
# White space: tab to carriage return, the four separators, space, next line, no-break space, and the
# Unicode spaces.
WS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
DECIMAL_TEXT = "[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?"
WHOLE_TEXT = "[+-]?\\d+"
HEIGHT_BOUNDS = [(15, "Small (<15m)"), (30, "Medium (15-30m)"), (60, "Large (30-60m)"), (150, "Major (60-150m)")]
CAPACITY_BOUNDS = [(1, "Micro (<1 MCM)"), (10, "Small (1-10 MCM)"), (100, "Medium (10-100 MCM)"), (1000, "Large (100-1000 MCM)")]
PERIOD_BOUNDS = [(1900, "1800-1899"), (1920, "1900-1919"), (1940, "1920-1939"), (1960, "1940-1959"), (1980, "1960-1979"), (2000, "1980-1999")]
USE_LABELS = [("Hydropower", "use_hydropower"), ("Irrigation", "use_irrigation"), ("Water Supply", "use_water_supply"),
              ("Flood Control", "use_flood_control"), ("Recreation", "use_recreation"), ("Navigation", "use_navigation")]


def _strip(x: str) -> str:
    return f"trim({x}, '{WS}')"


def _num(x: str) -> str:
    s = _strip(x)
    return f"(CASE WHEN regexp_full_match({s}, '{DECIMAL_TEXT}') THEN TRY_CAST({s} AS DOUBLE) END)"


def _int(x: str) -> str:
    s = _strip(x)
    return f"(CASE WHEN regexp_full_match({s}, '{WHOLE_TEXT}') THEN TRY_CAST({s} AS BIGINT) END)"


def _nonneg(x: str) -> str:
    n = _num(x)
    return f"(CASE WHEN {n} >= 0 THEN {n} END)"


def _nonblank(x: str) -> str:
    s = _strip(x)
    return f"(CASE WHEN {s} <> '' THEN {s} END)"


def _ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def _pct(num: str, den: str, digits: int = 2) -> str:
    return f"round(CAST({num} AS DOUBLE) * 100.0 / NULLIF(CAST({den} AS DOUBLE), 0), {digits})"


def _avg(x: str, digits: int = 2) -> str:
    return f"round(CAST(sum({x}) AS DOUBLE) / NULLIF(CAST(count({x}) AS DOUBLE), 0), {digits})"


def _rdbl(x: str, digits: int = 2) -> str:
    return f"CAST(round({x}, {digits}) AS DOUBLE)"


def _case(col: str, bounds, top: str) -> str:
    whens = " ".join(f"WHEN {col} < {b} THEN '{label}'" for b, label in bounds)
    return f"CASE {whens} ELSE '{top}' END"


# Quality codes, missing-text tokens, use flags that mean yes.
_QUALITY = "CASE {i} WHEN 1 THEN 1.0 WHEN 2 THEN 0.9 WHEN 3 THEN 0.7 WHEN 4 THEN 0.5 WHEN 5 THEN 0.2 ELSE 0.5 END"
_TOKENS = "'', '-99', 'nan', 'None'"
_USE_TRUE = "'Main', 'Sec'"


def _text(src: str, dst: str) -> str:
    return f"CASE WHEN {src} IN ({_TOKENS}) THEN NULL ELSE {src} END AS {dst}"


def _flag(src: str, dst: str) -> str:
    return f"coalesce({src} IN ({_USE_TRUE}), false) AS {dst}"


_POINT_RE = r"^\s*POINT\s*\(\s*([-+0-9.eE]+)\s+([-+0-9.eE]+)\s*\)\s*$"


def _registry_select(prefix: str, source: str, loaded_at: str, x: str, y: str, frm: str) -> str:
    q = _QUALITY.format(i=_int("QUALITY"))
    return f"""SELECT '{prefix}' || CAST(GDW_ID AS VARCHAR) AS dam_id, CAST(GDW_ID AS BIGINT) AS gdw_id,
 '{source}' AS source,
 coalesce({_nonblank('DAM_NAME')}, {_nonblank('RES_NAME')}, {_nonblank('ALT_NAME')},
          'Dam near ' || coalesce(NEAR_CITY, 'Unknown')) AS dam_name,
 substring(COUNTRY, 1, 10) AS country_code, ADMIN_UNIT AS province_state,
 NEAR_CITY AS nearest_city, {x} AS coordinates_x, {y} AS coordinates_y,
 CAST(CASE WHEN {_int('YEAR_DAM')} BETWEEN 1800 AND 2050
      THEN {_int('YEAR_DAM')} END AS INTEGER) AS construction_year,
 CAST({_nonneg('DAM_HGT_M')} AS DECIMAL(10,2)) AS height_meters,
 CAST({_nonneg('DAM_LEN_M')} AS DECIMAL(10,2)) AS length_meters,
 CAST({_nonneg('ELEV_MASL')} AS DECIMAL(10,2)) AS elevation_masl,
 RES_NAME AS reservoir_name,
 CAST({_nonneg('CAP_MCM')} AS DECIMAL(15,2)) AS normal_capacity_mcm,
 CAST({_nonneg('CATCH_SKM')} AS DECIMAL(12,2)) AS catchment_area_km2,
 CAST({_nonneg('AREA_SKM')} AS DECIMAL(10,2)) AS reservoir_surface_area_km2,
 MAIN_USE AS primary_purpose,
 CAST({_nonneg('POWER_MW')} AS DECIMAL(10,2)) AS installed_capacity_mw,
 CAST({q} AS DECIMAL(3,2)) AS data_quality_score,
 TIMESTAMP '{loaded_at}' AS last_verified, TIMESTAMP '{loaded_at}' AS created_at,
 TIMESTAMP '{loaded_at}' AS updated_at
FROM {frm}"""


def _enrichment_select() -> str:
    yr = _nonneg("YEAR_DAM")
    pre = _nonneg("PRE_YEAR")
    lon, lat = _num("LONG_DAM"), _num("LAT_DAM")
    return f"""SELECT CAST(GDW_ID AS BIGINT) AS gdw_id,
 {_text('DAM_NAME', 'dam_name_gdw')}, {_text('ALT_NAME', 'alternative_name')},
 {_text('RES_NAME', 'reservoir_name')}, {_text('DAM_TYPE', 'dam_type')},
 CAST({_nonneg('DAM_HGT_M')} AS DECIMAL(10,2)) AS height_meters_gdw,
 CAST({_nonneg('DAM_LEN_M')} AS DECIMAL(10,2)) AS dam_length_meters,
 CAST({_nonneg('CAP_MCM')} AS DECIMAL(15,3)) AS capacity_mcm_gdw,
 CAST({_nonneg('AREA_SKM')} AS DECIMAL(12,3)) AS reservoir_area_sqkm,
 CAST({_nonneg('DEPTH_M')} AS DECIMAL(8,2)) AS max_depth_meters,
 CAST(CASE WHEN {yr} BETWEEN 1800 AND 2024 THEN round({yr}) END
      AS INTEGER) AS construction_year_gdw,
 CAST(round({pre}) AS INTEGER) AS pre_construction_year,
 YEAR_TXT AS construction_year_text,
 {_text('RIVER', 'river_name')}, {_text('MAIN_BASIN', 'main_basin')}, {_text('SUB_BASIN', 'sub_basin')},
 CAST(CASE WHEN {lon} <> -99 THEN {lon} END AS DECIMAL(12,8)) AS longitude_precise,
 CAST(CASE WHEN {lat} <> -99 THEN {lat} END AS DECIMAL(12,8)) AS latitude_precise,
 CAST({_nonneg('ELEV_MASL')} AS DECIMAL(10,2)) AS elevation_meters,
 CAST({_nonneg('CATCH_SKM')} AS DECIMAL(15,3)) AS catchment_area_sqkm,
 {_text('MAIN_USE', 'primary_purpose')},
 {_flag('USE_IRRI', 'use_irrigation')}, {_flag('USE_ELEC', 'use_hydropower')},
 {_flag('USE_SUPP', 'use_water_supply')}, {_flag('USE_FCON', 'use_flood_control')},
 {_flag('USE_RECR', 'use_recreation')}, {_flag('USE_NAVI', 'use_navigation')},
 CAST({_nonneg('POWER_MW')} AS DECIMAL(10,2)) AS power_capacity_mw,
 CAST({_nonneg('DIS_AVG_LS')} AS DECIMAL(15,3)) AS average_discharge_ls,
 coalesce(QUALITY, 'nan') AS data_quality_gdw,
 {_text('COMMENTS', 'gdw_comments')}, {_text('ORIG_SRC', 'original_source')},
 {_text('EDITOR', 'data_editor')}
FROM raw_metadata"""


_VIEW_E_COLS = ", ".join(f"e.{c}" for c in [
    "gdw_id", "dam_name_gdw", "alternative_name", "reservoir_name", "dam_type",
    "height_meters_gdw", "dam_length_meters", "capacity_mcm_gdw", "reservoir_area_sqkm",
    "max_depth_meters", "construction_year_gdw", "construction_year_text", "river_name",
    "main_basin", "sub_basin", "longitude_precise", "latitude_precise", "elevation_meters",
    "catchment_area_sqkm", "primary_purpose", "use_irrigation", "use_hydropower",
    "use_water_supply", "use_flood_control", "use_recreation", "use_navigation",
    "power_capacity_mw", "average_discharge_ls", "data_quality_gdw", "gdw_comments",
    "original_source", "data_editor"])

_VIEW_D_COLS = ("d.dam_id, d.dam_name, d.country_code, d.province_state, d.coordinates_x, d.coordinates_y, d.height_meters, "
                "d.normal_capacity_mcm, d.construction_year, d.data_quality_score, d.created_at AS dam_record_created")

AUTH = "data_quality_score = 0.5"
SYNTH = "(data_quality_score <> 0.5 OR data_quality_score IS NULL)"

# name -> (sql, dependencies)
CTES: dict[str, tuple[str, list[str]]] = {
    "raw_barriers": (fixture_sql("raw_barriers"), []),
    "raw_reservoirs": (fixture_sql("raw_reservoirs"), []),
    "raw_metadata": (fixture_sql("raw_metadata"), []),
    "regions": (fixture_sql("regions"), []),
    "dam_links": (fixture_sql("dam_links"), []),
    "data_sources": (fixture_sql("data_sources"), []),
    "dam_sources": (fixture_sql("dam_sources"), []),
    "station_sources": (fixture_sql("station_sources"), []),
    "monitoring_stations": (fixture_sql("monitoring_stations"), []),
    "sensor_readings": (fixture_sql("sensor_readings"), []),
    "shm_sensors": (fixture_sql("shm_sensors"), []),
    "dam_types": ("SELECT * FROM (VALUES (1, 'Arch Dam', 'structural'), (2, 'Gravity Dam', 'structural'), "
                  "(3, 'Embankment Dam', 'structural'), (4, 'Buttress Dam', 'structural'), "
                  "(5, 'Hydropower Dam', 'functional'), (6, 'Flood Control Dam', 'functional'), "
                  "(7, 'Water Supply Dam', 'functional'), (8, 'Multi-Purpose Dam', 'functional')) "
                  "t(type_id, type_name, type_category)", []),
    "enrichment": (_enrichment_select(), ["raw_metadata"]),
    "barriers": (_registry_select(
        "B", "barrier", BARRIERS_LOADED_AT,
        f"TRY_CAST(regexp_extract(geometry, '{_POINT_RE}', 1) AS DOUBLE)",
        f"TRY_CAST(regexp_extract(geometry, '{_POINT_RE}', 2) AS DOUBLE)",
        "raw_barriers"), ["raw_barriers"]),
    # polygon vertices in ring order (shell only: the inputs have no holes)
    "res_vertices": ("""SELECT GDW_ID, i,
  CAST(split_part(trim(pt), ' ', 1) AS DOUBLE) AS px, CAST(split_part(trim(pt), ' ', 2) AS DOUBLE) AS py
FROM (SELECT GDW_ID, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS pt
      FROM (SELECT GDW_ID, string_split(regexp_extract(geometry, '\\(\\((.*)\\)\\)', 1), ',') AS l
            FROM raw_reservoirs))""", ["raw_reservoirs"]),
    # shoelace centroid from consecutive vertex pairs
    "res_centroid": ("""SELECT GDW_ID, sum((px + nx) * cr) / (3 * sum(cr)) AS cx, sum((py + ny) * cr) / (3 * sum(cr)) AS cy
FROM (SELECT GDW_ID, px, py, nx, ny, px * ny - nx * py AS cr
      FROM (SELECT GDW_ID, px, py, lead(px) OVER (PARTITION BY GDW_ID ORDER BY i) AS nx,
                   lead(py) OVER (PARTITION BY GDW_ID ORDER BY i) AS ny FROM res_vertices)
      WHERE nx IS NOT NULL)
GROUP BY GDW_ID""", ["res_vertices"]),
    "reservoirs": (_registry_select(
        "R", "reservoir", RESERVOIRS_LOADED_AT, "c.cx", "c.cy",
        "raw_reservoirs r LEFT JOIN res_centroid c USING (GDW_ID)"), ["raw_reservoirs", "res_centroid"]),
    "registry": ("SELECT * FROM barriers UNION ALL SELECT * FROM reservoirs", ["barriers", "reservoirs"]),
    "dams": ("SELECT r.*, l.region_id, l.primary_dam_type_id, l.construction_status, l.hazard_potential "
             "FROM registry r LEFT JOIN dam_links l USING (dam_id)", ["registry", "dam_links"]),
    "genuine": (f"SELECT * FROM registry WHERE {AUTH}", ["registry"]),
    # all pairs that satisfy either match, then the dams for which no match exists
    "view": (f"""SELECT {_VIEW_D_COLS}, {_VIEW_E_COLS}
FROM genuine d, enrichment e
WHERE coalesce(e.dam_name_gdw = d.dam_name, false) OR coalesce(left(e.gdw_comments, 10) = d.country_code, false)
UNION ALL BY NAME
SELECT {_VIEW_D_COLS}
FROM genuine d
WHERE NOT EXISTS (FROM enrichment e WHERE e.dam_name_gdw = d.dam_name)
  AND NOT EXISTS (FROM enrichment e WHERE left(e.gdw_comments, 10) = d.country_code)""", ["genuine", "enrichment"]),
    "summary": ("""SELECT d.dam_id, d.dam_name, r.region_name, d.country_code, dt.type_name AS primary_dam_type,
 d.construction_year, d.height_meters, d.normal_capacity_mcm, d.construction_status, d.hazard_potential,
 d.coordinates_x AS longitude, d.coordinates_y AS latitude
FROM dams d JOIN regions r ON d.region_id = r.region_id
LEFT JOIN dam_types dt ON d.primary_dam_type_id = dt.type_id""", ["dams", "regions", "dam_types"]),
    "bad_stations": (f"""SELECT ms.station_id FROM monitoring_stations ms
WHERE ms.dam_id IN (SELECT dam_id FROM registry WHERE {SYNTH})""", ["monitoring_stations", "registry"]),
    # one narrow row per (dam, metadata row of its name), then filtered counts
    "country_stats": (f"""SELECT cc AS country_code, n AS total_dams, found AS enriched_dams, {_pct('found', 'n', 1)} AS enrichment_coverage,
 avg_height, max_height, hydropower_dams, irrigation_dams
FROM (SELECT cc, count(*) AS n, count(*) FILTER (WHERE hit IS NOT NULL) AS found, {_avg('h')} AS avg_height, {_rdbl('max(h)')} AS max_height,
        count(*) FILTER (WHERE water_power) AS hydropower_dams, count(*) FILTER (WHERE fields) AS irrigation_dams
      FROM (SELECT g.country_code AS cc, e.gdw_id AS hit, ifnull(e.height_meters_gdw, g.height_meters) AS h,
              e.use_hydropower AS water_power, e.use_irrigation AS fields
            FROM genuine g LEFT JOIN enrichment e ON e.dam_name_gdw = g.dam_name)
      GROUP BY ALL HAVING n >= 100)
QUALIFY row_number() OVER (ORDER BY total_dams DESC, country_code NULLS LAST) <= 25""", ["genuine", "enrichment"]),
    # one pass of counts, turned into rows
    "completeness": (f"""SELECT field_name, complete_count, total_count, {_pct('complete_count', 'total_count')} AS completeness_percentage
FROM (UNPIVOT (
  SELECT count(*) AS total_count, count(dam_name_gdw) AS "Dam Names", count(dam_type) AS "Infrastructure Type",
    count(*) FILTER (WHERE height_meters_gdw > 0) AS "Height Data", count(*) FILTER (WHERE capacity_mcm_gdw > 0) AS "Capacity Data",
    count(construction_year_gdw) AS "Construction Year", count(primary_purpose) AS "Primary Purpose", count(river_name) AS "River Information"
  FROM enrichment) ON COLUMNS(* EXCLUDE total_count) INTO NAME field_name VALUE complete_count)""", ["enrichment"]),
}


def with_ctes(final: str, deps: list[str]) -> str:
    """``WITH`` the needed CTEs (dependencies first), then ``final``."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for d in deps:
        visit(d)
    body = ",\n".join(f"{n} AS (\n{CTES[n][0]}\n)" for n in order)
    if final.startswith("WITH "):  # the statement has relations of its own
        return f"WITH {body},\n{final.removeprefix('WITH ')}"
    return f"WITH {body}\n{final}"


# ------------------------------------------------------------------ outputs
_REG_COLS = ("dam_id, gdw_id, source, dam_name, country_code, province_state, nearest_city, "
             "round(coordinates_x, 9) AS coordinates_x, round(coordinates_y, 9) AS coordinates_y, "
             "construction_year, CAST(height_meters AS DOUBLE) AS height_meters, "
             "CAST(length_meters AS DOUBLE) AS length_meters, CAST(elevation_masl AS DOUBLE) AS elevation_masl, "
             "reservoir_name, CAST(normal_capacity_mcm AS DOUBLE) AS normal_capacity_mcm, "
             "CAST(catchment_area_km2 AS DOUBLE) AS catchment_area_km2, "
             "CAST(reservoir_surface_area_km2 AS DOUBLE) AS reservoir_surface_area_km2, primary_purpose, "
             "CAST(installed_capacity_mw AS DOUBLE) AS installed_capacity_mw, "
             "CAST(data_quality_score AS DOUBLE) AS data_quality_score, "
             f"{_ts('last_verified')} AS last_verified, {_ts('created_at')} AS created_at, "
             f"{_ts('updated_at')} AS updated_at")

_E_DECIMALS = ["height_meters_gdw", "dam_length_meters", "capacity_mcm_gdw", "reservoir_area_sqkm",
               "max_depth_meters", "longitude_precise", "latitude_precise", "elevation_meters",
               "catchment_area_sqkm", "power_capacity_mw", "average_discharge_ls"]


def _dbl_cols(cols: list[str], decimals: list[str]) -> str:
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in decimals else c for c in cols)


_E_COLS = ["gdw_id", "dam_name_gdw", "alternative_name", "reservoir_name", "dam_type", "height_meters_gdw",
           "dam_length_meters", "capacity_mcm_gdw", "reservoir_area_sqkm", "max_depth_meters",
           "construction_year_gdw", "pre_construction_year", "construction_year_text", "river_name",
           "main_basin", "sub_basin", "longitude_precise", "latitude_precise", "elevation_meters",
           "catchment_area_sqkm", "primary_purpose", "use_irrigation", "use_hydropower", "use_water_supply",
           "use_flood_control", "use_recreation", "use_navigation", "power_capacity_mw",
           "average_discharge_ls", "data_quality_gdw", "gdw_comments", "original_source", "data_editor"]

_VIEW_OUT = ("dam_id, dam_name, country_code, province_state, round(coordinates_x, 9) AS coordinates_x, "
             "round(coordinates_y, 9) AS coordinates_y, CAST(height_meters AS DOUBLE) AS height_meters, "
             "CAST(normal_capacity_mcm AS DOUBLE) AS normal_capacity_mcm, construction_year, "
             "CAST(data_quality_score AS DOUBLE) AS data_quality_score, "
             f"{_ts('dam_record_created')} AS dam_record_created, "
             + _dbl_cols([c.split('.')[1] for c in _VIEW_E_COLS.split(', ')], _E_DECIMALS))

_SUMMARY_OUT = ("dam_id, dam_name, region_name, country_code, primary_dam_type, construction_year, "
                "CAST(height_meters AS DOUBLE) AS height_meters, "
                "CAST(normal_capacity_mcm AS DOUBLE) AS normal_capacity_mcm, construction_status, "
                "hazard_potential, round(longitude, 9) AS longitude, round(latitude, 9) AS latitude")

_SAMPLE = (f"dam_name, country_code, CAST(data_quality_score AS DOUBLE) AS data_quality_score, "
           f"construction_year, {_ts('created_at')} AS created_at")


def _q(final: str, *deps: str) -> str:
    return with_ctes(final, list(deps))


def _size_classes(col: str, bounds, top: str, label: str, digits: int, suffix: str) -> str:
    return _q(f"""WITH known AS (SELECT {col} AS x, {_case(col, bounds, top)} AS cls, count(*) OVER () AS everything FROM enrichment WHERE {col} IS NOT NULL)
SELECT cls AS {label}, count(*) AS dam_count, {_pct('count(*)', 'any_value(everything)')} AS percentage,
 {_rdbl('min(x)', digits)} AS min_{suffix}, {_rdbl('max(x)', digits)} AS max_{suffix}, {_avg('x', digits)} AS avg_{suffix}
FROM known WHERE x > 0 GROUP BY cls""", "enrichment")


def _mono(stations_where: str = "") -> str:
    return f"""SELECT dam_id, COUNT(DISTINCT station_id) AS station_count,
 array_to_string(list_sort(list_distinct(list(station_type))), ',') AS station_types,
 array_to_string(list_sort(list_distinct(list(p))), ',') AS all_parameters
FROM (SELECT ms.dam_id, ms.station_id, ms.station_type, unnest(CASE WHEN len(ms.parameters_monitored) > 0
        THEN ms.parameters_monitored ELSE [NULL] END) AS p
      FROM monitoring_stations ms WHERE ms.dam_id IS NOT NULL {stations_where})
GROUP BY dam_id"""


def oracle_sql() -> dict[str, str]:
    e_out = _dbl_cols(_E_COLS, _E_DECIMALS)
    uses = f"""SELECT use_type, hits AS count, {_pct('hits', 'n')} AS percentage
FROM (UNPIVOT (SELECT count(*) AS n, {', '.join(f'count(*) FILTER (WHERE {c}) AS "{label}"' for label, c in USE_LABELS)} FROM enrichment)
      ON COLUMNS(* EXCLUDE n) INTO NAME use_type VALUE hits)"""
    cascade_tables = {
        "sensor_readings": ("reading_id", "station_id IN (SELECT station_id FROM bad_stations)"),
        "shm_sensors": ("sensor_id", "station_id IN (SELECT station_id FROM bad_stations)"),
        "monitoring_stations": ("station_id", f"dam_id IN (SELECT dam_id FROM registry WHERE {SYNTH})"),
        "registry": ("dam_id", SYNTH),
    }

    def cascade(removed: bool) -> str:
        parts = []
        for t, (k, pred) in cascade_tables.items():
            name = "dams" if t == "registry" else t
            cond = pred if removed else f"NOT coalesce({pred}, false)"
            parts.append(f"SELECT '{name}' AS table_name, CAST({k} AS VARCHAR) AS row_id FROM {t} WHERE {cond}")
        return _q("\nUNION ALL\n".join(parts), "sensor_readings", "shm_sensors", "monitoring_stations",
                  "registry", "bad_stations")

    q = {
        # ---------------------------------------------------------- sources
        "load_barriers": _q(f"SELECT {_REG_COLS} FROM barriers", "barriers"),
        "load_reservoirs": _q(f"SELECT {_REG_COLS} FROM reservoirs", "reservoirs"),
        "registry_append": _q(f"SELECT {_REG_COLS} FROM registry", "registry"),
        "polygon_centroid": _q("SELECT GDW_ID AS gdw_id, round(cx, 9) AS centroid_x, round(cy, 9) AS centroid_y "
                               "FROM res_centroid", "res_centroid"),
        # ---------------------------------------------- projections / cleaning
        "select_fields": _q("SELECT " + ", ".join(
            f"{s} AS {t}" for s, t in METADATA_SOURCE_FIELDS.items())
            + " FROM raw_metadata", "raw_metadata"),
        "dam_name_fallback": _q(f"SELECT CAST(GDW_ID AS BIGINT) AS gdw_id, coalesce({_nonblank('DAM_NAME')}, "
                                f"{_nonblank('RES_NAME')}, {_nonblank('ALT_NAME')}, "
                                f"'Dam near ' || coalesce(NEAR_CITY, "
                                f"'Unknown')) AS dam_name FROM raw_barriers", "raw_barriers"),
        "sentinel_float": _q("SELECT CAST(GDW_ID AS BIGINT) AS gdw_id, " + ", ".join(
            f"{_nonneg(c)} AS {c.lower()}" for c in ["DAM_HGT_M", "DAM_LEN_M", "ELEV_MASL", "CAP_MCM", "CATCH_SKM",
                                                    "AREA_SKM", "POWER_MW"]) + " FROM raw_barriers",
            "raw_barriers"),
        "year_registry": _q(f"SELECT CAST(GDW_ID AS BIGINT) AS gdw_id, YEAR_DAM AS year_text, "
                            f"CAST(CASE WHEN {_int('YEAR_DAM')} BETWEEN 1800 AND 2050 THEN {_int('YEAR_DAM')} END "
                            f"AS INTEGER) AS construction_year FROM raw_barriers", "raw_barriers"),
        "quality_score": _q(f"SELECT CAST(GDW_ID AS BIGINT) AS gdw_id, QUALITY AS quality, "
                            f"CAST(CAST({_QUALITY.format(i=_int('QUALITY'))} AS DECIMAL(3,2)) AS DOUBLE) "
                            f"AS data_quality_score FROM raw_barriers", "raw_barriers"),
        "coerce_numeric": _q("SELECT CAST(GDW_ID AS BIGINT) AS gdw_id, " + ", ".join(
            f"{_num(c)} AS {c.lower()}" for c in ["DAM_HGT_M", "DAM_LEN_M", "CAP_MCM", "AREA_SKM", "DEPTH_M",
                                                 "YEAR_DAM", "PRE_YEAR", "LONG_DAM", "LAT_DAM", "ELEV_MASL",
                                                 "CATCH_SKM", "POWER_MW", "DIS_AVG_LS"])
            + " FROM raw_metadata", "raw_metadata"),
        "sentinel_numeric": _q("SELECT gdw_id, " + ", ".join(
            f"CAST({c} AS DOUBLE) AS {c}" for c in ["height_meters_gdw", "dam_length_meters", "capacity_mcm_gdw",
                                                    "reservoir_area_sqkm", "max_depth_meters", "elevation_meters",
                                                    "catchment_area_sqkm", "power_capacity_mw",
                                                    "average_discharge_ls"]) + " FROM enrichment", "enrichment"),
        "clean_coords": _q("SELECT gdw_id, CAST(longitude_precise AS DOUBLE) AS longitude_precise, "
                           "CAST(latitude_precise AS DOUBLE) AS latitude_precise FROM enrichment", "enrichment"),
        "year_enrichment": _q("SELECT gdw_id, construction_year_gdw, pre_construction_year, construction_year_text "
                              "FROM enrichment", "enrichment"),
        "clean_text": _q("SELECT gdw_id, dam_name_gdw, alternative_name, reservoir_name, dam_type, river_name, "
                         "main_basin, sub_basin, primary_purpose, gdw_comments, original_source, data_editor, "
                         "construction_year_text, data_quality_gdw FROM enrichment", "enrichment"),
        "usage_flags": _q("SELECT gdw_id, use_irrigation, use_hydropower, use_water_supply, use_flood_control, "
                          "use_recreation, use_navigation FROM enrichment", "enrichment"),
        "typed_enrichment": _q(f"SELECT {e_out} FROM enrichment", "enrichment"),
        "authentic_rows": _q(f"SELECT {_REG_COLS} FROM registry WHERE {AUTH}", "registry"),
        "synthetic_rows": _q(f"SELECT {_REG_COLS} FROM registry WHERE {SYNTH}", "registry"),
        "classify_rows": _q(f"""SELECT dam_id, dam_name, country_code, CAST(data_quality_score AS DOUBLE) AS data_quality_score,
 construction_year, {_ts('created_at')} AS created_at, 'ARTIFICIAL_REMOVE' AS record_classification
FROM registry WHERE {SYNTH}""", "registry"),
        # ------------------------------------------------------------ joins
        "enriched_view": _q(f"SELECT {_VIEW_OUT} FROM view", "view"),
        "dam_summary": _q(f"SELECT {_SUMMARY_OUT} FROM summary", "summary"),
        "priority_regions": _q(f"SELECT {_SUMMARY_OUT} FROM summary WHERE region_name IN "
                               f"(SELECT region_name FROM regions WHERE priority_order <= 3)", "summary", "regions"),
        "dam_inventory": _q("SELECT dam_name, region_name, CAST(height_meters AS DOUBLE) AS height_meters, "
                            "CAST(normal_capacity_mcm AS DOUBLE) AS normal_capacity_mcm, construction_year, "
                            "primary_dam_type FROM summary", "summary"),
        "monitoring_coverage": _q(f"""SELECT d.dam_id, d.dam_name, coalesce(m.station_count, 0) AS station_count,
 coalesce(m.station_types, '') AS station_types, coalesce(m.all_parameters, '') AS all_parameters
FROM registry d LEFT JOIN ({_mono()}) m ON d.dam_id = m.dam_id""", "registry", "monitoring_stations"),
        "dams_with_stations": _q(f"""SELECT d.dam_name, m.station_count, m.all_parameters
FROM registry d JOIN ({_mono()}) m ON d.dam_id = m.dam_id WHERE m.station_count > 0""",
                                 "registry", "monitoring_stations"),
        "recent_readings": _q(f"""SELECT dam_id, reading_id, parameter_type, CAST(measurement_value AS DOUBLE) AS measurement_value,
 {_ts('measurement_timestamp')} AS measurement_timestamp
FROM (SELECT ms.dam_id, sr.*, row_number() OVER (PARTITION BY ms.dam_id
        ORDER BY sr.measurement_timestamp DESC, sr.reading_id DESC) AS rn
      FROM sensor_readings sr JOIN monitoring_stations ms ON sr.station_id = ms.station_id
      WHERE ms.dam_id IS NOT NULL)
WHERE rn <= 100""", "sensor_readings", "monitoring_stations"),
        "region_hierarchy": _q("""WITH reach AS (
  SELECT region_id AS node, region_id AS ancestor, 0 AS depth FROM regions
  UNION ALL
  SELECT node, r.parent_region_id, depth + 1 FROM reach JOIN regions r ON r.region_id = ancestor WHERE r.parent_region_id IS NOT NULL),
own AS (
  SELECT d.region_id, count(DISTINCT d.dam_id) AS dams, count(DISTINCT s.station_id) AS stations, count(sr.reading_id) AS readings
  FROM dams d LEFT JOIN monitoring_stations s ON s.dam_id = d.dam_id LEFT JOIN sensor_readings sr ON sr.station_id = s.station_id
  WHERE d.region_id IS NOT NULL GROUP BY d.region_id)
SELECT r.region_id, r.region_name, r.region_type, (SELECT max(depth) FROM reach WHERE node = r.region_id) AS level,
 count(*) - 1 AS descendants, CAST(coalesce(sum(dams), 0) AS BIGINT) AS dam_count, CAST(coalesce(sum(stations), 0) AS BIGINT) AS station_count,
 CAST(coalesce(sum(readings), 0) AS BIGINT) AS sensor_reading_count, false AS on_cycle
FROM regions r JOIN reach ON ancestor = r.region_id LEFT JOIN own ON own.region_id = node
GROUP BY r.region_id, r.region_name, r.region_type""", "regions", "dams", "monitoring_stations", "sensor_readings").replace("WITH ", "WITH RECURSIVE ", 1),
        "region_rollup": _q("""SELECT s.region_name, COUNT(DISTINCT s.dam_id) AS dam_count,
 COUNT(DISTINCT ms.station_id) AS station_count,
 CAST(coalesce((SELECT COUNT(*) FROM sensor_readings sr JOIN monitoring_stations m2 ON sr.station_id = m2.station_id
          JOIN summary s2 ON m2.dam_id = s2.dam_id WHERE s2.region_name = s.region_name), 0) AS BIGINT)
   AS sensor_reading_count
FROM summary s LEFT JOIN monitoring_stations ms ON ms.dam_id = s.dam_id
GROUP BY s.region_name""", "summary", "monitoring_stations", "sensor_readings"),
        "pair_distance": _q("""SELECT b.dam_id AS dam1_id, r.dam_id AS dam2_id,
 round(sqrt(pow(6378137.0 * radians(b.coordinates_x) - 6378137.0 * radians(r.coordinates_x), 2)
      + pow(6378137.0 * ln(tan(pi() / 4 + radians(b.coordinates_y) / 2))
            - 6378137.0 * ln(tan(pi() / 4 + radians(r.coordinates_y) / 2)), 2)) / 1000.0, 6) AS distance_km
FROM barriers b JOIN reservoirs r ON b.gdw_id = r.gdw_id""", "barriers", "reservoirs"),
        "dependents_count": _q("""SELECT count(*) FILTER (WHERE kind = 'reading') AS sensor_count, count(*) FILTER (WHERE kind = 'shm') AS shm_sensor_count,
 count(*) FILTER (WHERE kind = 'station') AS monitoring_count
FROM (SELECT 'reading' AS kind FROM sensor_readings SEMI JOIN bad_stations USING (station_id)
      UNION ALL SELECT 'shm' FROM shm_sensors SEMI JOIN bad_stations USING (station_id)
      UNION ALL SELECT 'station' FROM bad_stations)""", "sensor_readings", "shm_sensors", "bad_stations"),
        "cascade_removed": cascade(True),
        "cascade_kept": cascade(False),
        "deletion_results": _q(f"""SELECT (SELECT COUNT(*) FROM registry) AS before_count,
 (SELECT COUNT(*) FROM registry WHERE NOT {SYNTH}) AS after_count,
 (SELECT COUNT(*) FROM registry WHERE {SYNTH}) AS deleted_count,
 (SELECT COUNT(*) FROM sensor_readings WHERE station_id IN (SELECT station_id FROM bad_stations)) AS sensor_readings_removed,
 (SELECT COUNT(*) FROM shm_sensors WHERE station_id IN (SELECT station_id FROM bad_stations)) AS shm_sensors_removed,
 (SELECT COUNT(*) FROM monitoring_stations WHERE dam_id IN (SELECT dam_id FROM registry WHERE {SYNTH})) AS monitoring_stations_removed""",
                               "registry", "sensor_readings", "shm_sensors", "monitoring_stations", "bad_stations"),
        # ----------------------------------------------------- aggregations
        # the three data sets as one relation of (name, place, first year, last year, height)
        "overview": _q(f"""WITH facts(dataset, place, y0, y1, h) AS (
  SELECT 'Original Dams Table', country_code, construction_year, construction_year, height_meters FROM genuine
  UNION ALL SELECT 'Enrichment Metadata', left(gdw_comments, 3), construction_year_gdw, construction_year_gdw, height_meters_gdw
    FROM enrichment WHERE height_meters_gdw IS NOT NULL
  UNION ALL SELECT 'Combined Enriched View', country_code, least(construction_year, construction_year_gdw),
    greatest(construction_year, construction_year_gdw), ifnull(height_meters_gdw, height_meters) FROM view),
names(dataset) AS (VALUES ('Original Dams Table'), ('Enrichment Metadata'), ('Combined Enriched View'))
SELECT dataset, count(f.dataset) AS record_count, count(DISTINCT place) AS countries, min(y0) AS earliest_year, max(y1) AS latest_year,
 {_avg('h')} AS avg_height_m, {_rdbl('max(h)')} AS max_height_m
FROM names LEFT JOIN facts f USING (dataset) GROUP BY dataset""", "genuine", "enrichment", "view"),
        "infrastructure_types": _q(f"""WITH typed AS (SELECT *, count(*) OVER () AS everything FROM enrichment)
SELECT dam_type AS infrastructure_type, count(*) AS dam_count, {_pct('count(*)', 'any_value(everything)')} AS percentage,
 {_avg('height_meters_gdw')} AS avg_height_m, {_avg('capacity_mcm_gdw')} AS avg_capacity_mcm,
 count(*) FILTER (WHERE use_hydropower) AS hydropower_count, count(*) FILTER (WHERE use_irrigation) AS irrigation_count
FROM typed WHERE dam_type IS NOT NULL GROUP BY dam_type""", "enrichment"),
        "height_classes": _size_classes("height_meters_gdw", HEIGHT_BOUNDS, "Mega (>150m)", "height_category",
                                        1, "height_m"),
        "capacity_classes": _size_classes("capacity_mcm_gdw", CAPACITY_BOUNDS, "Major (>1000 MCM)",
                                          "capacity_category", 2, "capacity_mcm"),
        "purposes": _q(f"""WITH sizes AS (SELECT primary_purpose AS p, count(*) AS n, {_avg('height_meters_gdw')} AS avg_height_m,
                {_avg('capacity_mcm_gdw')} AS avg_capacity_mcm FROM enrichment GROUP BY p)
SELECT ifnull(p, 'Unspecified') AS primary_purpose, n AS dam_count, {_pct('n', '(sum(n) OVER ())')} AS percentage, avg_height_m, avg_capacity_mcm
FROM sizes""", "enrichment"),
        "usage_patterns": _q(uses, "enrichment"),
        "country_analysis": _q("SELECT * FROM country_stats", "country_stats"),
        "basin_analysis": _q(f"""SELECT main_basin AS river_basin, count(*) AS dam_count, count(DISTINCT river_name) AS unique_rivers,
 {_avg('height_meters_gdw')} AS avg_height_m, count(*) FILTER (WHERE use_hydropower) AS hydropower_count
FROM enrichment WHERE main_basin IS NOT NULL GROUP BY main_basin HAVING dam_count >= 50
QUALIFY row_number() OVER (ORDER BY count(*) DESC, main_basin) <= 20""", "enrichment"),
        "timeline": _q(f"""WITH built AS (SELECT *, {_case('construction_year_gdw', PERIOD_BOUNDS, '2000-2024')} AS construction_period
               FROM enrichment WHERE construction_year_gdw BETWEEN 1800 AND 2024)
SELECT construction_period, count(*) AS dams_built, {_avg('height_meters_gdw')} AS avg_height_m, {_avg('capacity_mcm_gdw')} AS avg_capacity_mcm,
 count(*) FILTER (WHERE use_hydropower) AS hydropower_dams
FROM built GROUP BY construction_period""", "enrichment"),
        "completeness": _q("SELECT * FROM completeness", "completeness"),
        "completeness_all": _q("SELECT * FROM (" + "\nUNION ALL\n".join(
            f"SELECT '{c}' AS column_name, COUNT({c}) AS non_null_count, COUNT(*) AS total_count, "
            f"{_pct(f'COUNT({c})', 'COUNT(*)')} AS completeness_pct FROM enrichment" for c in _E_COLS) + ")",
            "enrichment"),
        "composition_total": _q(f"""SELECT COUNT(*) AS total_records, COUNT(DISTINCT data_quality_score) AS unique_quality_scores,
 {_ts('MIN(created_at)')} AS earliest_record, {_ts('MAX(created_at)')} AS latest_record FROM registry""", "registry"),
        "composition_scores": _q(f"""WITH per AS (SELECT data_quality_score AS q, count(*) AS n, min(created_at) AS t0, max(created_at) AS t1 FROM registry GROUP BY q)
SELECT CAST(q AS DOUBLE) AS data_quality_score, n AS record_count, {_pct('n', '(sum(n) OVER ())')} AS percentage,
 {_ts('t0')} AS earliest_created, {_ts('t1')} AS latest_created
FROM per""", "registry"),
        "composition_classes": _q(f"""SELECT if(data_quality_score IS DISTINCT FROM 0.5, 'Artificial_Records', 'GDW_Records') AS record_type, count(*) AS count
FROM registry GROUP BY ALL""", "registry"),
        "removal_summary": _q(f"""WITH halves AS (SELECT data_quality_score IS DISTINCT FROM 0.5 AS goes, count(*) AS n FROM registry GROUP BY goes)
SELECT if(goes, 'Artificial_Records_REMOVE', 'GDW_Records_KEEP') AS classification, n AS count, {_pct('n', '(sum(n) OVER ())')} AS percentage
FROM halves""", "registry"),
        "dry_run_count": _q(f"SELECT COUNT(*) AS would_be_deleted FROM registry WHERE {SYNTH}", "registry"),
        "report_means": _q("""SELECT round(avg(enrichment_coverage), 4) AS mean_enrichment_coverage,
 (SELECT round(avg(completeness_percentage), 4) FROM completeness) AS mean_completeness FROM country_stats""",
                           "country_stats", "completeness"),
        # ------------------------------------------------------- validation
        "import_countries": _q("SELECT country_code, COUNT(*) AS count FROM registry GROUP BY country_code "
                               "ORDER BY count DESC, country_code NULLS LAST LIMIT 10", "registry"),
        "import_scores": _q("SELECT CAST(data_quality_score AS DOUBLE) AS data_quality_score, COUNT(*) AS count "
                            "FROM registry GROUP BY data_quality_score", "registry"),
        "bounding_box": _q("SELECT MIN(coordinates_x) AS min_longitude, MAX(coordinates_x) AS max_longitude, "
                           "MIN(coordinates_y) AS min_latitude, MAX(coordinates_y) AS max_latitude FROM registry "
                           "WHERE coordinates_x IS NOT NULL OR coordinates_y IS NOT NULL", "registry"),
        "sample_names": _q("SELECT dam_id, dam_name FROM registry WHERE dam_name IS NOT NULL ORDER BY dam_id LIMIT 5",
                           "registry"),
        "clean_countries": _q(f"SELECT country_code, COUNT(*) AS count FROM registry WHERE {AUTH} "
                              "GROUP BY country_code ORDER BY count DESC, country_code NULLS LAST LIMIT 10",
                              "registry"),
        "clean_years": _q(f"SELECT COUNT(*) AS total, MIN(construction_year) AS min_year, MAX(construction_year) "
                          f"AS max_year, COUNT(CASE WHEN construction_year IS NOT NULL THEN 1 END) AS with_year "
                          f"FROM registry WHERE {AUTH}", "registry"),
        "enrichment_checks": _q("""SELECT (SELECT count(*) FROM genuine) AS main_dams_count, (SELECT count(*) FROM enrichment) AS enrichment_records,
 count(*) AS enriched_view_count, count(height_meters) AS original_height_count, count(height_meters_gdw) AS enriched_height_count,
 count(primary_purpose) AS purpose_count, count(*) FILTER (WHERE use_irrigation) AS irrigation_count,
 count(*) FILTER (WHERE use_hydropower) AS hydropower_count, count(river_name) AS rivers_identified, count(main_basin) AS basins_identified,
 count(longitude_precise) AS precise_coordinates
FROM view""", "genuine", "enrichment", "view"),
        "constraint_audit": _q("""UNPIVOT (SELECT count(*) FILTER (WHERE height_meters <= 0) AS check_height_positive,
  count(*) FILTER (WHERE normal_capacity_mcm <= 0) AS check_capacity_positive,
  count(*) FILTER (WHERE construction_year NOT BETWEEN 1800 AND 2050) AS check_construction_year_reasonable FROM dams)
ON COLUMNS(*) INTO NAME rule VALUE violations""", "dams"),
        "length_audit": _q("SELECT * FROM (" + "\nUNION ALL\n".join(
            f"SELECT '{c}' AS column_name, {n} AS max_length, COUNT(CASE WHEN length({c}) > {n} THEN 1 END) "
            f"AS violations FROM dams" for c, n in
            DAMS_LENGTH_LIMITS.items()) + ")", "dams"),
        "orphan_audit": _q("""SELECT 'regions.parent_region_id -> regions' AS relation,
 COUNT(*) AS orphans FROM regions r WHERE parent_region_id IS NOT NULL AND NOT EXISTS (FROM regions p WHERE p.region_id = r.parent_region_id)
UNION ALL SELECT 'dams.primary_data_source_id -> data_sources', COUNT(*)
FROM dam_sources d WHERE primary_data_source_id IS NOT NULL AND NOT EXISTS (FROM data_sources s WHERE s.source_id = d.primary_data_source_id)
UNION ALL SELECT 'dams.secondary_data_sources[] -> data_sources', COUNT(*)
FROM (SELECT unnest(secondary_data_sources) AS one FROM dam_sources) WHERE one NOT IN (SELECT source_id FROM data_sources)
UNION ALL SELECT 'monitoring_stations.data_source_id -> data_sources', COUNT(*)
FROM station_sources t WHERE data_source_id IS NOT NULL AND NOT EXISTS (FROM data_sources s WHERE s.source_id = t.data_source_id)
UNION ALL SELECT 'dams.region_id -> regions',
 COUNT(CASE WHEN region_id IS NOT NULL AND region_id NOT IN (SELECT region_id FROM regions) THEN 1 END) AS orphans FROM dams
UNION ALL SELECT 'dams.primary_dam_type_id -> dam_types',
 COUNT(CASE WHEN primary_dam_type_id IS NOT NULL AND primary_dam_type_id NOT IN (SELECT type_id FROM dam_types) THEN 1 END) FROM dams
UNION ALL SELECT 'monitoring_stations.dam_id -> dams',
 COUNT(CASE WHEN dam_id IS NOT NULL AND dam_id NOT IN (SELECT dam_id FROM dams) THEN 1 END) FROM monitoring_stations
UNION ALL SELECT 'sensor_readings.station_id -> monitoring_stations',
 COUNT(CASE WHEN station_id IS NOT NULL AND station_id NOT IN (SELECT station_id FROM monitoring_stations) THEN 1 END) FROM sensor_readings
UNION ALL SELECT 'shm_sensors.station_id -> monitoring_stations',
 COUNT(CASE WHEN station_id IS NOT NULL AND station_id NOT IN (SELECT station_id FROM monitoring_stations) THEN 1 END) FROM shm_sensors""",
                           "dams", "regions", "dam_types", "monitoring_stations", "sensor_readings", "shm_sensors",
                           "data_sources", "dam_sources", "station_sources"),
        "key_audit": _q("""SELECT 'dams' AS table_name, 'duplicate dam_id' AS check_name,
 (SELECT COUNT(*) FROM (SELECT dam_id FROM dams WHERE dam_id IS NOT NULL GROUP BY dam_id HAVING COUNT(*) > 1)) AS violations
UNION ALL SELECT 'dams', 'null dam_id', COUNT(CASE WHEN dam_id IS NULL THEN 1 END) FROM dams
UNION ALL SELECT 'dams', 'null dam_name', COUNT(CASE WHEN dam_name IS NULL THEN 1 END) FROM dams
UNION ALL SELECT 'dams', 'null coordinates', COUNT(CASE WHEN coordinates_x IS NULL AND coordinates_y IS NULL THEN 1 END) FROM dams
UNION ALL SELECT 'dam_enrichment', 'duplicate gdw_id',
 (SELECT COUNT(*) FROM (SELECT gdw_id FROM enrichment WHERE gdw_id IS NOT NULL GROUP BY gdw_id HAVING COUNT(*) > 1))
UNION ALL SELECT 'dam_enrichment', 'null gdw_id', COUNT(CASE WHEN gdw_id IS NULL THEN 1 END) FROM enrichment""",
                        "dams", "enrichment"),
        "geometry_audit": _q("""SELECT COUNT(*) AS total,
 COUNT(CASE WHEN NOT (coordinates_x IS NOT NULL AND coordinates_y IS NOT NULL AND isfinite(coordinates_x)
   AND isfinite(coordinates_y)) THEN 1 END) AS invalid_points,
 COUNT(CASE WHEN coordinates_x IS NOT NULL AND coordinates_y IS NOT NULL AND isfinite(coordinates_x)
   AND isfinite(coordinates_y) AND (abs(coordinates_x) > 180 OR abs(coordinates_y) > 90) THEN 1 END) AS out_of_range
FROM dams""", "dams"),
        # --------------------------------------------------- sorts / limits
        "samples_authentic": _q(f"SELECT {_SAMPLE} FROM registry WHERE {AUTH} ORDER BY created_at DESC, dam_id "
                                "LIMIT 5", "registry"),
        "samples_synthetic": _q(f"SELECT {_SAMPLE} FROM registry WHERE {SYNTH} ORDER BY created_at DESC, dam_id "
                                "LIMIT 5", "registry"),
        "random_sample": _q(f"""SELECT dam_name, country_code, CAST(data_quality_score AS DOUBLE) AS data_quality_score, construction_year
FROM genuine ORDER BY md5(dam_id || '42'), dam_id LIMIT 10""", "genuine"),
        # ------------------------------------------------------ upsert
        "upsert_touch": _q(f"""WITH said AS (
  SELECT 'B' || CAST(gdw_id AS VARCHAR) AS dam_id, max(CAST(height_meters_gdw AS DECIMAL(10,2))) AS h
  FROM enrichment WHERE height_meters_gdw IS NOT NULL AND 'B' || CAST(gdw_id AS VARCHAR) IN (SELECT dam_id FROM barriers) GROUP BY ALL),
flagged AS (SELECT r.*, s.h, s.h IS NOT NULL AND s.h IS DISTINCT FROM r.height_meters AS touched FROM registry r LEFT JOIN said s USING (dam_id))
SELECT {_REG_COLS}, touched
FROM (SELECT * REPLACE (coalesce(h, height_meters) AS height_meters, if(touched, TIMESTAMP '{RUN_TS}', updated_at) AS updated_at) FROM flagged)""",
                           "registry", "barriers", "enrichment"),
    }
    q["wkt_points"] = _q("SELECT dam_id, CASE WHEN coordinates_x IS NOT NULL OR coordinates_y IS NOT NULL THEN "
                         "'POINT (' || CAST(coordinates_x AS VARCHAR) || ' ' || CAST(coordinates_y AS VARCHAR) "
                         "|| ')' END AS wkt FROM registry", "registry")
    # sinks whose read-back must equal an operator's output
    q["load_metadata_csv"] = q["typed_enrichment"]
    q["enrichment_refresh"] = q["typed_enrichment"]
    q["snapshot"] = q["append_by_key"] = q["registry_append"]
    tables = {"database_overview": "overview", "infrastructure_types": "infrastructure_types", "height_categories": "height_classes",
              "primary_purposes": "purposes", "usage_patterns": "usage_patterns", "country_analysis": "country_analysis",
              "river_basin_analysis": "basin_analysis", "capacity_analysis": "capacity_classes", "construction_timeline": "timeline",
              "data_completeness": "completeness"}
    first = {"database_overview": "dataset", "infrastructure_types": "infrastructure_type", "height_categories": "height_category", "primary_purposes": "primary_purpose",
             "usage_patterns": "use_type", "country_analysis": "country_code", "river_basin_analysis": "river_basin", "capacity_analysis": "capacity_category",
             "construction_timeline": "construction_period", "data_completeness": "field_name"}
    q["export_csv"] = "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, row_key, column_name, round(value, 6) AS value FROM (UNPIVOT (SELECT ifnull({first[t]}, '') AS row_key, "
        f"CAST(COLUMNS(* EXCLUDE {first[t]}) AS DOUBLE) FROM ({q[k]})) ON COLUMNS(* EXCLUDE row_key) INTO NAME column_name VALUE value)" for t, k in tables.items())
    q["export_statistics_json"] = f"""SELECT (SELECT count(*) FROM ({q['infrastructure_types']})) AS total_types,
 (SELECT infrastructure_type FROM ({q['infrastructure_types']}) ORDER BY dam_count DESC, infrastructure_type LIMIT 1) AS dominant_type,
 (SELECT count(*) FROM ({q['purposes']})) AS total_purposes,
 (SELECT primary_purpose FROM ({q['purposes']}) ORDER BY dam_count DESC, primary_purpose LIMIT 1) AS primary_purpose,
 (SELECT count(*) FROM ({q['country_analysis']})) AS countries_analyzed,
 (SELECT country_code FROM ({q['country_analysis']}) ORDER BY total_dams DESC, country_code LIMIT 1) AS leading_country,
 (SELECT round(avg(completeness_percentage), 6) FROM ({q['completeness']})) AS average_completeness"""
    q["export_manifest"] = f"""SELECT '{RUN_TS}' AS analysis_date, max(record_count) FILTER (WHERE dataset = 'Original Dams Table') AS database_records,
 max(record_count) FILTER (WHERE dataset = 'Enrichment Metadata') AS enrichment_records, 10 AS tables FROM ({q['overview']})"""
    q["reports_md"] = "SELECT * FROM (VALUES ('enrichment_report', 2), ('cleaning_report', 6), ('executive_summary', 10)) AS t(report, sections)"
    return q
