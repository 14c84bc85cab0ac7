"""Hot keys: a third of the registry shares one name and one country.

Results must stay whole and exact when AQE splits the skewed join partitions
(thresholds lowered so the split path runs on test-sized data)."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from weirline.operators import analysis, enrich
from weirline.operators.purge import authentic_rows
from weirline.plans.workspace import Workspace
from weirline.schemas import VIEW_DAM_COLUMNS, VIEW_ENRICHMENT_COLUMNS

SKEW_CONF = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
}


def _skewed(w: Workspace):
    """Registry where every third dam is renamed to one hot name and moved to
    one hot country; the metadata keeps its rows (the hot name and the hot
    country's comment key both have matches there)."""
    hot_name = w.enrichment.where(F.col("dam_name_gdw").isNotNull()).agg(F.min("dam_name_gdw")).first()[0]
    hot = (F.col("gdw_id") % 3) == 0
    reg = (w.registry
           .withColumn("dam_name", F.when(hot, F.lit(hot_name)).otherwise(F.col("dam_name")))
           .withColumn("country_code", F.when(hot, F.lit("NATION_0 R")).otherwise(F.col("country_code"))))
    e = w.enrichment.withColumn(
        "gdw_comments",
        F.when(F.col("gdw_id") % 50 == 1, F.lit("NATION_0 Republic")).otherwise(F.col("gdw_comments")))
    return reg, e


def _with_conf(spark, fn):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    try:
        return fn()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_enriched_view_with_hot_keys(spark):
    w = Workspace(spark, SF_SMALL)
    reg, e = _skewed(w)
    d = authentic_rows(reg).select(*[F.col(s).alias(t) for s, t in VIEW_DAM_COLUMNS])
    ev = e.select(*VIEW_ENRICHMENT_COLUMNS)
    cond = (d["dam_name"] == ev["dam_name_gdw"]) | (d["country_code"] == F.substring(ev["gdw_comments"], 1, 10))
    brute = sorted(d.join(ev, cond, "left").select("dam_id", "gdw_id").collect())
    def run():
        df = enrich.enriched_view(reg, e).select("dam_id", "gdw_id")
        rows = sorted(df.collect())
        return rows, df._jdf.queryExecution().executedPlan().toString()

    got, plan = _with_conf(spark, run)
    assert len(brute) > reg.count() // 3  # the hot keys really fan out
    assert got == brute
    assert "SortMergeJoin(skew=true)" in plan  # AQE split the hot join partitions


def test_country_analysis_with_hot_keys(spark):
    w = Workspace(spark, SF_SMALL)
    reg, e = _skewed(w)
    d = authentic_rows(reg).select("country_code", "dam_name", "height_meters")
    j = d.join(e, d["dam_name"] == e["dam_name_gdw"], "left")
    brute = sorted(j.groupBy("country_code").agg(F.count(F.lit(1)).alias("total_dams"),
                                                 F.count("gdw_id").alias("enriched_dams")).collect())
    got = _with_conf(spark, lambda: sorted(
        analysis.country_analysis(reg, e, min_dams=0, top=100000)
        .select("country_code", "total_dams", "enriched_dams").collect()))
    assert got == brute
