"""Prefix sums over a table too large for one task, as DataFrame functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirline.llm.common import stored


def same(left: str, right: str, columns: Sequence[str]) -> Column:
    """Equality of ``columns`` between two aliases, nulls equal to nulls."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def prefix_sums(rows: DataFrame, group: Sequence[str], order: Sequence[Column], values: Sequence[str], beside: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``<value>_before`` for each of ``values``: its sum over the earlier rows of the group.

    The rows are range-partitioned by group and order, so a group that holds a third of
    them lies in many parts.  Sums per part and group, of which there are about as many as
    parts and groups, give what lies before each part; inside a part a window adds up.
    ``order`` must tell all rows apart that are to have a fixed place.  ``beside`` has one
    row per group, whose other columns come along: it meets the sums of parts, not the
    rows, so that a hot group is no hot join key.  Without rows the result is empty.
    """
    placed = stored(rows.repartitionByRange(*[F.col(c) for c in group], *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = placed.groupBy(*group, "_part").agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.select(*group, "_part", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_{v}") for v in values])
    more = []
    if beside is not None:
        more = [c for c in beside.columns if c not in group]
        parts = parts.alias("p").join(beside.alias("b"), same("p", "b", group)).select("p.*", *[F.col(f"b.{c}") for c in more])
    parts = stored(parts, "range-sums")
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = placed.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"{v}_before") for v in values])
    kept = [c for c in rows.columns if c not in more]
    return within.alias("r").join(parts.alias("p"), same("r", "p", [*group, "_part"])).select(
        *[F.col(f"r.{c}") for c in kept], *[(F.col(f"r.{v}_before") + F.col(f"p._{v}")).alias(f"{v}_before") for v in values],
        *[F.col(f"p.{c}") for c in more])
