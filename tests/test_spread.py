"""Joins on frequent and NULL keys: whole results, and rows that really lie in several tasks."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from weirline.operators import analysis, enrich, purge
from weirline.operators.spread import frequent, shared_keys, spread_join, with_matches
from weirline.plans.workspace import Workspace

PLAIN = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}


@pytest.fixture()
def plain(spark):
    """No adaptive splitting and no broadcast: what is spread here is spread by the join itself."""
    old = {k: spark.conf.get(k, None) for k in PLAIN}
    for k, v in PLAIN.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def largest_share(df) -> float:
    """The part of the rows that the fullest task of the last stage holds."""
    per_task = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()]
    return max(per_task) / sum(per_task)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_equals_a_plain_join(plain, how):
    r = random.Random(how)
    key = lambda: r.choice(["hot", "hot", None, "warm", *map(str, range(30))])
    a = plain.createDataFrame([(i, key(), i % 3) for i in range(900)], "id int, k string, v int")
    right = [(k, n) for n, k in enumerate({key() for _ in range(40)})] if how == "left" else [(key(), i) for i in range(150)]
    b = plain.createDataFrame(right, "j string, w int")
    got = spread_join(a, b, "k", "j", how, left_spread=["id"], right_spread=["w"])
    want = a.join(b, F.col("k") == F.col("j"), how)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    same = spread_join(a, b.withColumnRenamed("j", "k"), "k", "k", how, left_spread=["id"])
    assert same.count() == want.count() and same.columns == [c for c in want.columns if c != "j"]


def test_empty_sides(plain):
    a, none = plain.createDataFrame([(1, "x"), (2, None)], "id int, k string"), plain.createDataFrame([], "k string, w int")
    assert spread_join(a, none, "k", "k").count() == 0
    assert sorted(r["id"] for r in spread_join(a, none, "k", "k", "left_anti").collect()) == [1, 2]
    assert spread_join(none, a, "k", "k", "left").count() == 0


def test_frequent_keys_are_few(plain):
    a = plain.createDataFrame([(i, "hot" if i % 3 == 0 else str(i)) for i in range(3000)], "id int, k string")
    assert frequent(a, "k") == {"hot": 3} and len(frequent(a, "k", pieces=16)) <= 16


def _registry(spark):
    """Authentic dams of which a third has one name, a third no name; one country for half of them."""
    w = Workspace(spark, SF_SMALL)
    hot = w.enrichment.where("dam_name_gdw IS NOT NULL").agg(F.min("dam_name_gdw")).first()[0]
    i = F.col("gdw_id") % 6
    return hot, w.registry.withColumn("data_quality_score", F.lit(0.5).cast("decimal(3,2)")) \
        .withColumn("dam_name", F.when(i < 2, F.lit(hot)).when(i < 4, F.lit(None)).otherwise(F.concat(F.lit("own "), F.col("dam_id")))) \
        .withColumn("country_code", F.when(i % 2 == 0, F.lit("NATION_0 R")).otherwise(F.col("country_code"))), w


def test_each_join_of_the_view_spreads_its_hot_key(plain):
    hot, reg, w = _registry(plain)
    d = purge.authentic_rows(reg).select("dam_id", "dam_name", "country_code")
    e = w.enrichment.select("gdw_id", "dam_name_gdw", F.lit("NATION_0 R").alias("ck"))
    one = e.where(F.col("dam_name_gdw") == hot).limit(1)
    joins = {
        "by name": spread_join(d, one, "dam_name", "dam_name_gdw", "inner", left_spread=["dam_id"]),
        "by country": spread_join(d, e.limit(3), "country_code", "ck", "inner", left_spread=["dam_id"]),
        "without a name": spread_join(d, e.where(F.col("dam_name_gdw") != hot), "dam_name", "dam_name_gdw", "left_anti", left_spread=["dam_id"]),
    }
    for name, j in joins.items():
        assert j.count() >= d.count() // 3 - 1 and largest_share(j) < 0.5, name
    bare = d.where("dam_name IS NOT NULL").join(one, F.col("dam_name") == F.col("dam_name_gdw"))
    assert largest_share(bare) == 1.0          # what the plain join does


def test_hot_station(plain):
    child = plain.createDataFrame([(i, 7 if i % 2 else (None if i % 4 else i)) for i in range(4000)], "reading_id int, station_id int")
    got = purge.flag_removed(child, plain.createDataFrame([(7,), (8,)], "station_id int"))
    assert got.where("_removed").count() == 2001 and got.count() == 4000 and largest_share(got) < 0.5


def test_country_table_with_hot_and_missing_names(plain):
    _, reg, w = _registry(plain)
    d, e = purge.authentic_rows(reg).drop("gdw_id"), w.enrichment
    want = d.join(e, d["dam_name"] == e["dam_name_gdw"], "left").groupBy("country_code").agg(
        F.count(F.lit(1)).alias("n"), F.count("gdw_id").alias("m"), F.max(F.coalesce("height_meters_gdw", "height_meters")).cast("double").alias("h")).collect()
    got = analysis.country_analysis(reg, e, min_dams=0, top=10000).collect()
    assert {(r["country_code"], r["total_dams"], r["enriched_dams"], r["max_height"]) for r in got} == {tuple(r) for r in want}


def test_view_with_hot_and_missing_names(plain):
    _, reg, w = _registry(plain)
    e = w.enrichment.withColumn("gdw_comments", F.when(F.col("gdw_id") % 50 == 1, F.lit("NATION_0 Republic")).otherwise(F.col("gdw_comments")))
    got = enrich.enriched_view(reg, e).groupBy("dam_id").agg(F.count(F.lit(1)).alias("n"), F.count("gdw_id").alias("m"))
    d = reg.select("dam_id", "dam_name", "country_code")
    on = (d["dam_name"] == e["dam_name_gdw"]) | (d["country_code"] == F.substring(e["gdw_comments"], 1, 10))
    want = d.join(e, on, "left").groupBy("dam_id").agg(F.count(F.lit(1)).alias("n"), F.count("gdw_id").alias("m"))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_keys_are_counted_in_the_plan(plain):
    a = plain.createDataFrame([(i, "hot" if i % 3 == 0 else None if i % 3 == 1 else str(i)) for i in range(3000)], "id int, k string")
    b = plain.createDataFrame([("hot",), ("5",), ("5",), ("none",), (None,)], "j string")
    plain.sparkContext.setJobGroup("keys", "keys")
    often, others = shared_keys(a, "k", b, "j")
    found = with_matches(a, "k", often, others, "m", ["id"])
    assert list(plain.sparkContext.statusTracker().getJobIdsForGroup("keys")) == []
    assert {r["k"]: (r["pl"], r["pr"], r["both"]) for r in often.collect()} == {"hot": (3, 2, True), "5": (1, 4, True), "none": (1, 2, False)}
    assert found.where("m.both").groupBy("k").count().collect() != [] and found.count() == 3000
    assert {r["k"]: r["n"] for r in found.where("m.both").groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()} == {"hot": 1000, "5": 1}
    assert largest_share(found) < 0.5      # rows with a frequent key or none are dealt evenly
    assert all(df.count() == 0 for df in shared_keys(a.limit(0), "k", b.limit(0), "j"))
    assert {r["pl"] for r in shared_keys(a.limit(0), "k", b, "j")[0].collect()} == {1}


def test_planned_view_spreads_hot_and_missing_names(plain):
    hot, reg, w = _registry(plain)
    view = enrich.enriched_view(reg, w.enrichment.where(F.col("dam_name_gdw") == hot).limit(1))
    assert view.count() >= reg.count() and largest_share(view) < 0.5
