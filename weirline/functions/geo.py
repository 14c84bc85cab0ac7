"""Geometry as plain columns.

A point is ``struct<x:double, y:double>``; an area is an array of rings
``struct<shell:boolean, points:array<struct<x,y>>>`` (the shell of each part, then its
holes).  Spark has no planar geometry functions, so the centroid is written with
higher-order functions, which are interpreted, and the distance with plain ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Web-mercator sphere radius (EPSG:3857) in metres.
MERCATOR_RADIUS_M = 6378137.0

_NUM = r"[-+0-9.eE]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def point(x, y) -> Column:
    return F.struct(_col(x).cast("double").alias("x"), _col(y).cast("double").alias("y"))


def point_from_wkt(wkt) -> Column:
    """``'POINT (x y)'`` -> struct(x, y); anything else -> NULL."""
    pat = rf"^\s*POINT\s*\(\s*({_NUM})\s+({_NUM})\s*\)\s*$"
    w = _col(wkt)
    return F.when(
        w.rlike(pat),
        point(F.regexp_extract(w, pat, 1).try_cast("double"), F.regexp_extract(w, pat, 2).try_cast("double")),
    )


def point_to_wkt(p) -> Column:
    """struct(x, y) -> ``'POINT (x y)'`` (NULL stays NULL)."""
    p = _col(p)
    return F.when(p.isNotNull(), F.format_string("POINT (%s %s)", p["x"].cast("string"), p["y"].cast("string")))


_AREA = r"(?is)^\s*(MULTI)?POLYGON\s*(?:ZM|Z|M)?\s*\((.*)\)\s*$"


def polygon_from_wkt(wkt) -> Column:
    """``POLYGON`` and ``MULTIPOLYGON`` text, with or without Z and M -> its rings.

    NULL for EMPTY and for anything else (``unreadable_area`` tells the two apart);
    ordinates beyond x and y are passed over.
    """
    w = _col(wkt)
    body = F.trim(F.regexp_extract(w, _AREA, 2))
    # One pair of brackets around each part, as a MULTIPOLYGON has it.
    multi = F.when(F.regexp_extract(w, _AREA, 1) != "", body).otherwise(F.concat(F.lit("("), body, F.lit(")")))
    inner = F.regexp_replace(F.regexp_replace(multi, r"^\(\s*\(", ""), r"\)\s*\)$", "")

    def vertex(text: Column) -> Column:
        xy = F.split(F.trim(text), r"\s+")
        return F.struct(xy[0].try_cast("double").alias("x"), F.get(xy, 1).try_cast("double").alias("y"))

    def part(text: Column) -> Column:
        return F.transform(F.split(text, r"\)\s*,\s*\("), lambda ring, i: F.struct(
            (i == 0).alias("shell"), F.transform(F.split(ring, ","), vertex).alias("points")))

    rings = F.flatten(F.transform(F.split(inner, r"\)\s*\)\s*,\s*\(\s*\("), part))
    broken = lambda found: F.exists(found, lambda r: F.exists(r["points"], lambda q: q["x"].isNull() | q["y"].isNull()))
    # As the one element of an array, the rings are derived once for the test and the result.
    return F.get(F.filter(F.when(body != "", F.array(rings)), lambda found: ~broken(found)), 0)


def unreadable_area(wkt) -> Column:
    """Text that is neither an area nor EMPTY nor NULL."""
    w = _col(wkt)
    return w.isNotNull() & ~F.upper(w).rlike(r"\bEMPTY\s*$") & polygon_from_wkt(w).isNull()


def _oriented_terms(item: Column) -> Column:
    """One pass over a closed ring: twice its signed area ``a``, the centroid
    numerators ``cx, cy``, its length ``l`` and the length-weighted midpoint
    sums ``mx, my``.  The finish step normalises the winding: a shell counts
    positive and holes negative, whatever their orientation."""
    ring = item["points"]
    idx = F.sequence(F.lit(0), F.size(ring) - 2)
    zero = F.struct(
        F.lit(0.0).alias("a"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"),
        F.lit(0.0).alias("l"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"),
    )

    def edge(k):
        p, q = ring[k], ring[k + 1]
        return F.struct((p["x"] * q["y"] - q["x"] * p["y"]).alias("cross"), (p["x"] + q["x"]).alias("x"), (p["y"] + q["y"]).alias("y"),
                        F.sqrt((q["x"] - p["x"]) ** 2 + (q["y"] - p["y"]) ** 2).alias("seg"))

    def step(acc, e):
        return F.struct(
            (acc["a"] + e["cross"]).alias("a"),
            (acc["cx"] + e["x"] * e["cross"]).alias("cx"),
            (acc["cy"] + e["y"] * e["cross"]).alias("cy"),
            (acc["l"] + e["seg"]).alias("l"),
            (acc["mx"] + e["seg"] * e["x"] / 2).alias("mx"),
            (acc["my"] + e["seg"] * e["y"] / 2).alias("my"),
        )

    def finish(t):
        s = F.when(item["shell"], F.signum(t["a"])).otherwise(-F.signum(t["a"]))
        return F.struct((t["a"] * s).alias("a"), (t["cx"] * s).alias("cx"), (t["cy"] * s).alias("cy"),
                        t["l"].alias("l"), t["mx"].alias("mx"), t["my"].alias("my"))

    return F.when(F.size(ring) >= 2, F.aggregate(F.transform(idx, edge), zero, step, finish)).otherwise(zero)


def polygon_totals(rings) -> Column:
    """Sums over all rings: twice the signed area, the centroid numerators and
    the length-weighted midpoint sums (one pass over the vertices)."""
    rings = _col(rings)
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"),
                    F.lit(0.0).alias("l"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    return F.aggregate(
        F.transform(rings, _oriented_terms), zero,
        lambda acc, t: F.struct(
            (acc["a"] + t["a"]).alias("a"), (acc["cx"] + t["cx"]).alias("cx"), (acc["cy"] + t["cy"]).alias("cy"),
            (acc["l"] + t["l"]).alias("l"), (acc["mx"] + t["mx"]).alias("mx"), (acc["my"] + t["my"]).alias("my"),
        ),
    )


def centroid_from_totals(tot, rings) -> Column:
    """Area centroid; a polygon of zero area falls back to the length-weighted
    centroid of its rings and one of zero length to its first vertex (as GEOS)."""
    tot, rings = _col(tot), _col(rings)
    area2, first = tot["a"], rings[0]["points"][0]
    return F.when(rings.isNull() | (F.size(rings) == 0), F.lit(None)).otherwise(
        F.when(area2 != 0, point(tot["cx"] / (3 * area2), tot["cy"] / (3 * area2)))
        .when(tot["l"] > 0, point(tot["mx"] / tot["l"], tot["my"] / tot["l"]))
        .otherwise(point(first["x"], first["y"]))
    )


def with_polygon_centroid(df, wkt_col: str, out_col: str):
    """Add ``out_col`` = area centroid of the WKT polygon in ``wkt_col``.

    Built in stages (rings, then totals, then the point) so each stage is
    evaluated once per row: the optimizer does not inline a costly expression
    that a later projection references several times.
    """
    return (df.withColumn("_poly_rings", polygon_from_wkt(F.col(wkt_col)))
            .withColumn("_poly_tot", polygon_totals(F.col("_poly_rings")))
            .withColumn(out_col, centroid_from_totals(F.col("_poly_tot"), F.col("_poly_rings")))
            .drop("_poly_rings", "_poly_tot"))


def mercator_xy(lon, lat) -> Column:
    """EPSG:4326 -> EPSG:3857 (metres); NULL at the poles."""
    lon, lat = _col(lon).cast("double"), _col(lat).cast("double")
    y = F.lit(MERCATOR_RADIUS_M) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))
    return F.when(F.abs(lat) < 90, point(F.lit(MERCATOR_RADIUS_M) * F.radians(lon), y))


def mercator_km(lon1, lat1, lon2, lat2) -> Column:
    """Planar distance in km between two points after projecting to web mercator.

    This is a projected distance (stretched by 1/cos(latitude)), kept as is
    because it is what the distance function of the schema returns.
    """
    a, b = mercator_xy(lon1, lat1), mercator_xy(lon2, lat2)
    return F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2) / 1000.0
