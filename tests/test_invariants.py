"""Invariants between analysis tables (the published results' own arithmetic)."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK
from weirline.operators import analysis
from weirline.operators.purge import authentic_rows
from weirline.plans.workspace import Workspace


@pytest.fixture(scope="module")
def w(spark):
    return Workspace(spark, SF_CHECK)


def test_type_counts_cover_all_typed_rows(w):
    e = w.enrichment
    types = analysis.infrastructure_types(e).collect()
    assert sum(r["dam_count"] for r in types) == e.where(F.col("dam_type").isNotNull()).count()
    null_share = e.where(F.col("dam_type").isNull()).count() * 100.0 / e.count()
    assert sum(r["percentage"] for r in types) == pytest.approx(100.0 - null_share, abs=0.05)


def test_size_classes_partition_positive_values(w):
    e = w.enrichment
    for fn, col in ((analysis.height_classes, "height_meters_gdw"), (analysis.capacity_classes, "capacity_mcm_gdw")):
        rows = fn(e).collect()
        assert sum(r["dam_count"] for r in rows) == e.where(F.col(col) > 0).count()


def test_purposes_cover_every_row(w):
    rows = analysis.purposes(w.enrichment).collect()
    assert sum(r["dam_count"] for r in rows) == w.enrichment.count()
    assert sum(r["percentage"] for r in rows) == pytest.approx(100.0, abs=0.05)


def test_timeline_counts_rows_with_year(w):
    rows = analysis.timeline(w.enrichment).collect()
    assert sum(r["dams_built"] for r in rows) == w.enrichment.where(F.col("construction_year_gdw").isNotNull()).count()


def test_view_keeps_every_authentic_dam(w):
    view_ids = w.view.select("dam_id").distinct().count()
    assert view_ids == authentic_rows(w.registry).count()
    assert w.view.count() >= view_ids  # fan-out only adds rows


def test_overview_rows_agree_with_tables(w):
    ov = {r["dataset"]: r for r in analysis.overview(w.registry, w.enrichment, w.view).collect()}
    assert ov[analysis.DATASET_DAMS]["record_count"] == authentic_rows(w.registry).count()
    assert ov[analysis.DATASET_VIEW]["record_count"] == w.view.count()
    assert ov[analysis.DATASET_ENRICHMENT]["record_count"] == (
        w.enrichment.where(F.col("height_meters_gdw").isNotNull()).count())
