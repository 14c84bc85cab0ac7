"""The view kept as parts: all its rows, and its totals without the pairs by key written out."""

from collections import Counter
from decimal import Decimal

from pyspark.sql import functions as F

from conftest import SF_SMALL
from weirline.operators import audit, enrich
from weirline.plans.workspace import Workspace


def _skewed(spark):
    """Many countries as comment keys, NULL heights, dams that match by name and key at once."""
    w = Workspace(spark, SF_SMALL)
    e = w.enrichment.withColumn("gdw_comments", F.when(F.col("gdw_id") % 4 == 1, F.concat(F.lit("NATION_"), (F.col("gdw_id") % 12).cast("string"), F.lit(" Republic"))).otherwise(F.col("gdw_comments"))) \
        .withColumn("height_meters_gdw", F.when(F.col("gdw_id") % 3 > 0, F.col("height_meters_gdw")))
    return w.registry, e


def test_parts_hold_every_row_once(spark):
    d, e = _skewed(spark)
    parts = enrich.view_parts(d, e)
    rows = lambda df: Counter(map(tuple, df.select("dam_id", "gdw_id").collect()))
    a, m = d.where("data_quality_score = 0.5").select("dam_id", "dam_name", "country_code"), e.select("gdw_id", "dam_name_gdw", "gdw_comments")
    want = rows(a.join(m, (F.col("dam_name") == F.col("dam_name_gdw")) | (F.col("country_code") == F.substring("gdw_comments", 1, 10)), "left"))
    assert rows(parts.view()) == want == rows(enrich.enriched_view(d, e))
    # what is kept grows with the tables, not with their product
    kept = sum(df.count() for df in vars(parts).values())
    assert kept < 4 * (a.count() + m.count()) < sum(want.values())


def test_totals_equal_those_of_the_rows(spark):
    d, e = _skewed(spark)
    parts, view = enrich.view_parts(d, e), enrich.enriched_view(d, e).cache()
    h, y = F.coalesce("height_meters_gdw", "height_meters"), ("construction_year", "construction_year_gdw")
    for few in (parts, enrich.view_parts(d, e.where("gdw_comments IS NULL")), enrich.view_parts(d.limit(0), e)):
        v = view if few is parts else few.view()
        want = v.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in audit.VIEW_FIELDS], *[F.count_if(c).alias(c) for c in audit.VIEW_USES],
                     F.sum(h).alias("h_sum"), F.count(h).alias("h_cnt"), F.max(h).alias("h_max"), F.min(F.least(*y)).alias("first_year"),
                     F.max(F.greatest(*y)).alias("last_year"), F.count_distinct("country_code").alias("countries")).first().asDict()
        want["h_sum"] = want["h_sum"] or Decimal(0)
        assert few.totals(audit.VIEW_FIELDS, audit.VIEW_USES, summary=True).first().asDict() == want
    view.unpersist()
