"""Cleaning rules on one literal row per dirty-value class."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from weirline.functions import clean


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize("text,expected", [
    ("12.5", 12.5), ("0", 0.0), ("-99", None), ("-3", None), ("n/a", None), (None, None),
    ("  7 ", 7.0), ("　7　", 7.0), ("1e2", 100.0), ("1.5d", None), ("nan", None),
    ("inf", None), (".125", 0.125), ("1_000", None),
])
def test_sentinel_float(spark, text, expected):
    assert one(spark, clean.sentinel_float, text) == expected


@pytest.mark.parametrize("text,expected", [
    ("1950", 1950), ("1950.7", None), ("284", None), ("2037", 2037), ("2051", None), ("-99", None),
    ("1800", 1800), ("2050", 2050), (" 1900 ", 1900), (None, None), ("abc", None),
])
def test_registry_year(spark, text, expected):
    assert one(spark, clean.registry_year, text) == expected


@pytest.mark.parametrize("text,expected", [
    ("1", "1.00"), ("2", "0.90"), ("3", "0.70"), ("4", "0.50"), ("5", "0.20"), ("6", "0.50"),
    ("0", "0.50"), ("2: verified", "0.50"), (None, "0.50"), (" 3", "0.70"),
])
def test_quality_score(spark, text, expected):
    assert one(spark, clean.quality_score, text) == Decimal(expected)


def test_display_name(spark):
    rows = [("  Big Dam ", None, None, "City"), ("   ", " Res ", "Alt", None), (None, "", "\tAlt\n", None),
            (None, None, None, None), (None, "  ", None, "  Town"), ("-99", "R", "A", "C")]
    df = spark.createDataFrame(rows, "d string, r string, a string, c string")
    got = [r[0] for r in df.select(clean.display_name("d", "r", "a", "c")).collect()]
    assert got == ["Big Dam", "Res", "Alt", "Dam near Unknown", "Dam near   Town", "-99"]


@pytest.mark.parametrize("text,expected", [("", None), ("-99", None), ("nan", None), ("None", None),
                                           ("  ", "  "), ("x", "x"), (None, None), ("NA", "NA")])
def test_clean_text(spark, text, expected):
    assert one(spark, clean.clean_text, text) == expected


@pytest.mark.parametrize("text,expected", [("Main", True), ("Sec", True), ("main", False), ("", False),
                                           ("Other", False), (None, False)])
def test_usage_flag(spark, text, expected):
    assert one(spark, clean.usage_flag, text) is expected


def test_enrichment_year_and_coordinates(spark):
    df = spark.createDataFrame([("2024", "-12.5"), ("2025", "-99"), ("1799", "13"), ("1950.5", None)],
                               "y string, c string")
    got = df.select(clean.enrichment_year("y").alias("y"), clean.enrichment_coordinate("c").alias("c"),
                    clean.enrichment_coordinate("c", as_written=True).alias("w")).collect()
    assert [tuple(r) for r in got] == [(2024, -12.5, None), (None, None, None), (None, 13.0, 13.0),
                                       (1951, None, None)]


def test_quality_text_and_country(spark):
    df = spark.createDataFrame([(None, "NATION_10 Republic"), ("3", None)], "q string, c string")
    got = df.select(clean.quality_text("q"), clean.country_code("c")).collect()
    assert [tuple(r) for r in got] == [("nan", "NATION_10 "), ("3", None)]


def test_py_strip_matches_python(spark):
    samples = [" a ", " b ", "\x1cc\x1f", "d", "", "​e"]
    df = spark.createDataFrame([(s,) for s in samples], "v string")
    got = [r[0] for r in df.select(clean.py_strip("v")).collect()]
    assert got == [s.strip() for s in samples]
