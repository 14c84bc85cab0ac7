"""Region hierarchy, references held in arrays, and appends that commit whole or not at all."""

import uuid

import pytest
from pyspark.sql import functions as F

from weirline.operators import audit
from weirline.operators.hierarchy import closure, hierarchy_rollup
from weirline.session import scratch_path
from weirline.sources import table_log


def nodes(spark, pairs):
    return spark.createDataFrame(pairs, "region_id long, parent_region_id long")


def test_closure_of_a_deep_tree(spark):
    pairs = [(0, None)] + [(i, (i - 1) // 2) for i in range(1, 31)]
    reach, ring = closure(nodes(spark, pairs), "region_id", "parent_region_id")
    up = dict(pairs)
    want = set()
    for n in up:
        a, depth = n, 0
        while a is not None:
            want.add((n, a, depth))
            a, depth = up[a], depth + 1
    assert {tuple(r) for r in reach.collect()} == want and ring.count() == 0


def test_cycles_end_and_are_named(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (6, 99), (7, None), (None, 1), (7, None)]
    reach, ring = closure(nodes(spark, pairs), "region_id", "parent_region_id")
    got = {(r["node"], r["ancestor"]) for r in reach.collect()}
    assert {a for n, a in got if n == 4} == {4, 1, 2, 3} and {a for n, a in got if n == 1} == {1, 2, 3}
    assert {a for n, a in got if n in (5, 6, 7)} == {5, 6, 7}
    assert {r["node"] for r in ring.collect()} == {1, 2, 3, 5}


def test_rollup_adds_up_subtrees(spark):
    regions = spark.createDataFrame([(1, "world", "w", None), (2, "north", "c", 1), (3, "land", "n", 2), (4, "isle", "n", 1)],
                                    "region_id long, region_name string, region_type string, parent_region_id long")
    dams = spark.createDataFrame([("a", 3), ("b", 3), ("c", 2), ("d", 4), ("e", None)], "dam_id string, region_id long")
    stations = spark.createDataFrame([(1, "a"), (2, "a"), (3, "d"), (4, None)], "station_id long, dam_id string")
    readings = spark.createDataFrame([(1,)] * 5 + [(3,)] * 2 + [(None,), (4,)], "station_id long")
    got = {r["region_name"]: tuple(r)[3:] for r in hierarchy_rollup(regions, dams, stations, readings).collect()}
    assert got == {"world": (0, 3, 4, 3, 7, False), "north": (1, 1, 3, 2, 5, False), "land": (2, 0, 2, 2, 5, False), "isle": (1, 0, 1, 1, 2, False)}


def test_orphans_of_array_references(spark):
    child = spark.createDataFrame([(["a", "x", None, "x"],), ([],), (None,), (["b"],)], "refs array<string>")
    parent = spark.createDataFrame([("a",), ("b",), (None,)], "id string")
    got = audit.orphan_audit({"refs": (child, "refs", parent, "id")}).collect()
    assert [tuple(r) for r in got] == [("refs", 2)]


@pytest.fixture()
def path(spark):
    return scratch_path(spark, f"tests/log-{uuid.uuid4().hex}")


def ids(spark, path):
    return sorted(r["id"] for r in table_log.read(spark, path).collect())


def test_append_commits_whole_or_not_at_all(spark, path):
    assert table_log.append(spark.range(0, 50), path, "id") == 50
    fails_late = spark.range(50, 150, 1, 4).withColumn("id", F.when(F.col("id") == 149, F.raise_error(F.lit("no"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="no"):
        table_log.append(fails_late, path, "id")
    assert ids(spark, path) == list(range(50)) and len(table_log.entries(spark, path)) == 1
    assert table_log.append(spark.range(50, 60), path, "id") == 10
    assert ids(spark, path) == list(range(60))
    assert [e["rows"] for e in table_log.entries(spark, path)] == [50, 10]


def test_keys_are_kept(spark, path):
    table_log.append(spark.range(5), path, "id")
    for rows in ([(4,), (9,)], [(9,), (9,)], [(None,), (9,)]):
        with pytest.raises(table_log.KeyViolation):
            table_log.append(spark.createDataFrame(rows, "id long"), path, "id")
    assert ids(spark, path) == [0, 1, 2, 3, 4]
    assert table_log.append(spark.createDataFrame([(4,)], "id long"), path) == 1     # without a key nothing is refused
    assert table_log.append(spark.createDataFrame([], "id long"), path, "id") == 0
    assert ids(spark, path) == [0, 1, 2, 3, 4, 4]


def test_readers_do_not_see_a_part_before_its_entry(spark, path):
    table_log.append(spark.range(3), path)
    spark.range(100, 200).write.parquet(f"{path}/part-unfinished")
    assert ids(spark, path) == [0, 1, 2]


def test_a_taken_number_is_not_taken_twice(spark, path, monkeypatch):
    table_log.append(spark.range(3), path, "id")
    first, real = [], table_log._commit

    def other_wins(spark_, base, number, entry):
        if not first:
            first.append(number)
            table_log.append(spark.range(3, 6), path, "id")     # another writer commits under the same number
        return real(spark_, base, number, entry)

    monkeypatch.setattr(table_log, "_commit", other_wins)
    with pytest.raises(table_log.KeyViolation):                 # checked again against what the other has added
        table_log.append(spark.range(5, 9), path, "id")
    assert ids(spark, path) == [0, 1, 2, 3, 4, 5]
    assert [e["number"] for e in table_log.entries(spark, path)] == [1, 2]


def test_a_refused_append_derives_its_keys_only(spark):
    """Known keys are refused before the other columns are computed and written."""
    path = scratch_path(spark, f"tests/log-{uuid.uuid4().hex[:8]}")
    table_log.append(spark.createDataFrame([(1, "a")], "k int, v string"), path, key="k")
    again = spark.range(1, 3).select(F.col("id").cast("int").alias("k"), F.raise_error(F.lit("computed")).cast("string").alias("v"))
    with pytest.raises(table_log.KeyViolation):
        table_log.append(again, path, key="k")
    assert table_log.read(spark, path).count() == 1
