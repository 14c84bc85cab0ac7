"""The enriched view's joins: same rows as the OR-join, and little work for each pair."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from weirline.operators import enrich
from weirline.operators.spread import may_share, shared_keys
from weirline.plans import catalog


@pytest.fixture()
def tables(spark):
    """Hot, missing and repeated names, countries and ids; keys that only one side has."""
    names = ["hot"] * 6 + ["lone hot"] * 4 + [None, "a", "b", "only here"]
    lands = ["LAND_ONE R", "LAND_ONE R", "LAND_TWO R", "elsewhere", None]
    dams = [(f"B{i % 180}" if i % 31 else None, names[i % 14], lands[i % 5], 1.25 * i if i % 3 else None) for i in range(200)]
    notes = ["LAND_ONE Republic", "LAND_TWO R", "a note", "a note", None, "LAND_SIX Republic"]
    rows = [(i % 55 if i % 29 else None, ["hot", "hot", "a", "b", None, "only there"][i % 6], notes[i * 7 % 13 % 6]) for i in range(60)]
    d = spark.createDataFrame(dams, "dam_id string, dam_name string, country_code string, height_meters double") \
        .withColumn("data_quality_score", F.lit(0.5).cast("decimal(3,2)")).withColumn("height_meters", F.col("height_meters").cast("decimal(10,2)"))
    return d, spark.createDataFrame(rows, "gdw_id bigint, dam_name_gdw string, gdw_comments string")


def test_view_equals_or_join(tables):
    d, e = tables
    on = (d["dam_name"] == e["dam_name_gdw"]) | (d["country_code"] == F.substring(e["gdw_comments"], 1, 10))
    brute = d.join(e, on, "left")
    rows = lambda df: Counter(map(tuple, df.collect()))
    assert rows(enrich.enriched_view(d, e).select(*brute.columns)) == rows(brute)
    shown = enrich.enriched_view(d, e, shape=catalog.flat)
    assert dict(shown.dtypes)["height_meters"] == "double"
    assert rows(shown) == rows(catalog.flat(brute).select(*shown.columns))


def _top(plan):
    """The plan's nodes above its joins, and the joins."""
    if plan.nodeName() == "Join":
        return [], [plan]
    below = [_top(plan.children().apply(i)) for i in range(plan.children().size())]
    return [plan, *[n for nodes, _ in below for n in nodes]], [j for _, joins in below for j in joins]


def test_nothing_is_derived_for_a_pair(spark):
    view = catalog.queries()["enriched_view"](spark, SF_SMALL)
    above, joins = _top(view._jdf.queryExecution().optimizedPlan())
    for n in above:
        if n.nodeName() == "Project":       # columns only: no call, no cast
            assert n.expressions().mkString(" ").count("(") == 0, n.expressions().mkString(" ")
    inner = [j for j in joins if j.joinType().sql() == "INNER"]
    names = lambda p: p.output().mkString(" ")
    # the wide side comes first: its columns are read once a row, the dams' once a pair
    assert len(inner) == 1 and "gdw_id" in names(inner[0].left()) and "dam_id" in names(inner[0].right())


def test_dams_of_a_country_are_kept_in_small_pieces(spark):
    d = spark.range(12000).select(F.when(F.col("id") < 10000, F.lit("big")).when(F.col("id") < 11000, F.lit("mid")).otherwise(F.concat(F.lit("k"), F.col("id") % 250)).alias("c"))
    e = spark.createDataFrame([("big",), ("mid",), ("k7",), ("none",)], "k string")
    often, others = shared_keys(d, "c", e, "k", pieces=2, left_rows=500)
    pl = {r["k"]: r["pl"] for r in often.where("both").collect()}
    assert pl == {"big": 20, "mid": 2} and [r["k"] for r in others.collect()] == ["k7"]
    found = {r["c"]: r["n"] for r in d.where(may_share("c", often, others)).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert (found["big"], found["mid"], found["k7"]) == (10000, 1000, 4) and len(found) < 50
