"""Exact phrase hits against a scan of every window."""

import re

from pyspark.sql import functions as F

from weirline.llm import decontam
from shapes import docs, prose  # noqa: F401


def word_list(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    wins = set()
    for item, t in items:
        w = word_list(t)
        wins |= {(str(item), tuple(w[i:i + 13])) for i in range(max(1, len(w) - 12)) if w}
    out = []
    for i, t in docs:
        w, hit, found = word_list(t), set(), set()
        for item, p in wins:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k:k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    found.add(item)
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def test_equals_scan(spark, docs, prose):
    a, b, short = prose(40, 1), prose(13, 2), "Tiny Item"
    items = [(10, a), (9, b), (11, short), (12, None), (13, " .. "), (9, b), (14, "the the the the the the the the the the the the the the")]
    texts = [a, prose(20, 3) + " " + a[:len(a) // 2] + " " + prose(30, 4), prose(5, 5) + " " + b.upper() + ". " + prose(300, 6), "a TINY, item!", "tiny x item",
             None, "", "the " * 40, b[:-1] + "zz", prose(200, 7), a, "Ünïcode " + b]
    rows = [*enumerate(texts), (0, a), (None, b)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit(1))
    got = decontam.contamination(docs(rows).withColumn("items", F.lit("clash")), bench).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in got), key=str) == brute(rows, items)
    assert all(r["score"] == "x" and sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in got)


def test_empty_tables(spark, docs, prose):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontam.contamination(docs([(1, prose(20, 1)), (2, None)]), none).orderBy("doc_id").collect()
    assert [(r["n_words"] > 0, r["n_hit"], r["items"]) for r in got] == [(True, 0, []), (False, 0, [])]
    some = spark.createDataFrame([(1, prose(20, 1))], "item_id long, text string")
    assert decontam.contamination(docs([]), some).count() == 0


def test_proximity(spark, docs):
    keyed = docs([(1, "alpha x x beta alpha"), (2, "alpha x x x x x beta")]).select(F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("h"), "text")
    terms = spark.createDataFrame([("alpha",), ("beta",)], "term string")
    pairs = spark.createDataFrame([("alpha", "beta")], "a string, b string")
    got = decontam.proximity(decontam.positional_index(keyed, terms), pairs, 3).collect()
    assert sorted((r["doc"], r["pos"], r["other"]) for r in got) == [(1, 0, 3), (1, 4, 3)]


def test_no_python_in_the_plan(spark, docs, prose):
    bench = spark.createDataFrame([(1, prose(20, 1))], "item_id long, text string")
    plan = decontam.contamination(docs([(1, prose(20, 1))]), bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
