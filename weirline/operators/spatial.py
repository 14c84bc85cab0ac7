"""Distances between registry points, and batch upserts that stamp changed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirline.functions.geo import mercator_km


def pair_distance(dams: DataFrame, pairs: DataFrame) -> DataFrame:
    """Web-mercator distance (km) for each ``(dam1_id, dam2_id)`` pair.

    A batch operator: the pair list is joined to the dams twice by key (two
    equi-joins), never a cross product.  Unknown ids give NULL like the
    original function.
    """
    p1 = dams.select(F.col("dam_id").alias("dam1_id"), F.col("coordinates").alias("_p1"))
    p2 = dams.select(F.col("dam_id").alias("dam2_id"), F.col("coordinates").alias("_p2"))
    return (pairs.join(p1, "dam1_id", "left").join(p2, "dam2_id", "left")
            .select("dam1_id", "dam2_id",
                    mercator_km(F.col("_p1.x"), F.col("_p1.y"), F.col("_p2.x"), F.col("_p2.y"))
                    .alias("distance_km")))


def layer_pairs(dams: DataFrame) -> DataFrame:
    """Pairs of a barrier and the reservoir of the same registry id."""
    b = dams.where(F.col("source") == "barrier").select("gdw_id", F.col("dam_id").alias("dam1_id"))
    r = dams.where(F.col("source") == "reservoir").select("gdw_id", F.col("dam_id").alias("dam2_id"))
    return b.join(r, "gdw_id", "inner").select("dam1_id", "dam2_id")


def upsert_touch(current: DataFrame, incoming: DataFrame, key: str, compare: list[str],
                 run_ts: str, ts_col: str = "updated_at", latest_by: str | None = None) -> DataFrame:
    """Batch upsert by ``key``: incoming values of ``compare`` win, all other columns of
    ``current`` stay; ``ts_col`` is set to ``run_ts`` on rows that are new or whose
    compared columns changed (NULL-safe), and kept on all others.  ``touched`` marks them.

    ``incoming`` is one row per key.  Of several, the one with the greatest
    (``latest_by``, compared columns) is taken, so that none multiplies a current row.
    A new row has NULL in the columns that ``incoming`` does not give.

    This is the batch form of a BEFORE UPDATE trigger: one full outer join on
    the key instead of one trigger call per row.
    """
    order = F.struct(*([latest_by] if latest_by else []), *compare)
    new = (incoming.groupBy(key).agg(F.max(order).alias("_in"))
           .select(key, F.lit(True).alias("_new"), *[F.col(f"_in.{c}").alias(f"_new_{c}") for c in compare]))
    j = current.withColumn("_old", F.lit(True)).join(new, key, "full_outer")
    differs = F.lit(False)
    for c in compare:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_new_{c}"))
    touched = F.col("_new").isNotNull() & (F.col("_old").isNull() | differs)
    taken = {c: F.when(F.col("_new").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in compare}
    stamp = F.when(touched, F.lit(run_ts).cast("timestamp_ntz")).otherwise(F.col(ts_col)).alias(ts_col)
    return j.select(*[taken.get(c, stamp if c == ts_col else F.col(c)) for c in current.columns], touched.alias("touched"))
