"""The snapshot derives every row by compiled methods, and its parsers keep their results."""

from weirline.functions import clean, geo
from weirline.operators import purge
from weirline.session import compiled_projections

LIMIT = "spark.sql.codegen.hugeMethodLimit"


def test_limit_holds_while_open_and_goes_back(spark):
    before = spark.conf.get(LIMIT)
    with compiled_projections(spark):
        assert spark.conf.get(LIMIT) == "8000"
    assert spark.conf.get(LIMIT) == before


def test_snapshot_leaves_the_session_as_it_was(spark, tmp_path):
    before = spark.conf.get(LIMIT)
    path, n = purge.snapshot(spark, spark.range(7), str(tmp_path))
    assert n == 7 and spark.read.parquet(path).count() == 7 and spark.conf.get(LIMIT) == before


def test_texts_that_need_no_strip_and_those_that_do(spark):
    texts = [None, "", " ", "7", "-99", "1.5", " 1.5", "1.5\n", "1.5\x85", " 7 ", "1e3", ".5", "5.", "n/a", "1,5", "7\n\n", "7x", "+7", "9" * 30]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r for r in rows.select("i", clean.parse_number("t").alias("n"), clean.parse_integer("t").alias("k")).collect()}
    for i, t in enumerate(texts):
        s = (t or "").strip()
        number = float(s) if s and s.replace("+", "").replace("-", "")[0] in "0123456789." and "," not in s and "x" not in s else None
        integer = int(s) if s.lstrip("+-").isdigit() and len(s) < 19 else None
        assert (got[i]["n"], got[i]["k"]) == (number, integer), t


def test_rings_are_derived_once_and_broken_ones_are_null(spark):
    texts = ["POLYGON ((0 0, 3 0, 0 3, 0 0))", "POLYGON ((0 0, x 0, 0 3, 0 0))", "POLYGON EMPTY", "POINT (1 2)", None,
             "MULTIPOLYGON (((0 0, 3 0, 0 3, 0 0)), ((10 10, 13 10, 10 13, 10 10)))"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    plan = rows.select(geo.polygon_from_wkt("t").alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("flatten(") == 1
    out = {r["i"]: r["c"] for r in geo.with_polygon_centroid(rows, "t", "c").select("i", "c").collect()}
    assert tuple(out[0]) == (1.0, 1.0) and tuple(out[5]) == (6.0, 6.0) and [out[i] for i in (1, 2, 3, 4)] == [None] * 4
