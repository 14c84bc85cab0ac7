"""Connected components of a large edge table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirline.llm.common import drop_stored, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from every node of ``edges`` (a, b).

    Alternates two star operations until nothing changes.  *Large star*: every node
    links its larger neighbours to its smallest neighbour.  *Small star*: every node
    links its smaller neighbours and itself to the smallest of them.  The number of
    edges never grows, so a hub costs one aggregated row and one join row per edge.
    Every round is a table in the shared folder.
    """
    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else \
            edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = both.join(least, "a")
        if large:
            out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    now = stored(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    digest = None
    while True:
        before, now = now, stored(star(star(now, True), False), "edges")
        drop_stored(before)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == digest:
            break
        digest = state
    found = stored(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "roots")
    drop_stored(now)
    return found
