"""Geometry helpers: WKT parsing, polygon centroid, web-mercator distance."""

import math

import pytest
from pyspark.sql import functions as F

from weirline.functions import geo


def centroid(spark, wkt):
    df = spark.createDataFrame([(wkt,)], "w string")
    r = geo.with_polygon_centroid(df, "w", "c").first()["c"]
    return None if r is None else (r["x"], r["y"])


def test_triangle_is_area_centroid_not_vertex_mean(spark):
    assert centroid(spark, "POLYGON ((0 0, 3 0, 0 3, 0 0))") == pytest.approx((1.0, 1.0))


def test_square_with_hole(spark):
    # 4x4 square minus the 1x1 hole at (2..3, 2..3): area 15
    wkt = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (2 2, 2 3, 3 3, 3 2, 2 2))"
    cx = (16 * 2 - 1 * 2.5) / 15
    assert centroid(spark, wkt) == pytest.approx((cx, cx))


def test_clockwise_shell(spark):
    assert centroid(spark, "POLYGON ((0 0, 0 2, 2 2, 2 0, 0 0))") == pytest.approx((1.0, 1.0))


def test_degenerate_polygon_falls_back(spark):
    # zero area: length-weighted centroid of the ring
    assert centroid(spark, "POLYGON ((0 0, 2 0, 0 0))") == pytest.approx((1.0, 0.0))
    assert centroid(spark, "POLYGON ((5 5, 5 5))") == pytest.approx((5.0, 5.0))


def test_bad_wkt_is_null(spark):
    assert centroid(spark, "LINESTRING (0 0, 1 1)") is None


def test_point_roundtrip(spark):
    df = spark.createDataFrame([("POINT (1.5 -2.25)",), ("POINT(1 2)",), ("junk",)], "w string")
    pts = [r[0] for r in df.select(geo.point_from_wkt("w")).collect()]
    assert (pts[0]["x"], pts[0]["y"]) == (1.5, -2.25)
    assert (pts[1]["x"], pts[1]["y"]) == (1.0, 2.0)
    assert pts[2] is None
    back = df.select(geo.point_to_wkt(geo.point_from_wkt("w"))).first()[0]
    assert back == "POINT (1.5 -2.25)"


def test_mercator_distance(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0), (0.0, 90.0, 0.0, 0.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(geo.mercator_km("a", "b", "c", "d")).collect()]
    assert got[0] == pytest.approx(6378137.0 * math.radians(1) / 1000)
    assert got[1] is None


def test_kinds_of_areas(spark):
    square = "((0 0, 4 0, 4 4, 0 4, 0 0))"
    hole = "((0 0, 4 0, 4 4, 0 4, 0 0), (0 0, 2 0, 2 4, 0 4, 0 0))"
    cases = {
        f"POLYGON {square}": (2, 2), f"polygon z {square.replace(',', ' 9,').replace('0))', '0 9))')}": (2, 2), f"POLYGON {hole}": (3, 2),
        f"MULTIPOLYGON ({square})": (2, 2), "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((3 0, 4 0, 4 1, 3 1, 3 0)))": (2, 0.5),
        f"MULTIPOLYGON({hole}, ((10 0, 12 0, 12 4, 10 4, 10 0)))": (7, 2), "POLYGON EMPTY": None, "MULTIPOLYGON Z EMPTY": None, "LINE (0 0)": None, "POLYGON ((a b))": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "w string")
    rows = geo.with_polygon_centroid(df, "w", "c").withColumn("bad", geo.unreadable_area("w")).collect()
    for r in rows:
        want = cases[r["w"]]
        assert (r["c"] and (round(r["c"]["x"], 9), round(r["c"]["y"], 9))) == want, r["w"]
        assert r["bad"] == (want is None and "EMPTY" not in r["w"])
