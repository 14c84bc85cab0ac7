"""Targets by repeated sharing, budgets to the word, order the same in every run."""

import hashlib
import random
from collections import defaultdict

import pytest

from weirline.llm import mixing
from weirline.llm.prefix import prefix_sums
from pyspark.sql import functions as F

SEP = " \t\n\x0b\f\r"


def count(text):
    for c in SEP[1:]:
        text = (text or "").replace(c, " ")
    return len([w for w in text.split(" ") if w])


def shared(sizes, weights=(3, 1, 2), percent=150, epochs=2):
    """Targets as the rule says it: share, cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), percent * sum(sizes.values()) / 100
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > epochs * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = epochs * sizes[s]
            left -= target[s]
        free -= over
    return target


def brute(rows, **more):
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += count(t)
    target, out, before = shared(sizes, **more), [], defaultdict(int)
    key = lambda i: hashlib.md5(("mix" if i is None else f"mix:{i}").encode()).hexdigest()
    for i, s, t in sorted(rows, key=lambda r: (key(r[0]), count(r[2]))):
        n, whole, budget = count(t), sizes[s], int(target[s] + 1e-9)
        taken = budget // whole * n + min(max(budget % whole - before[s], 0), n) if whole else 0
        before[s] += n
        out.append((str(i), str(s), n, whole, round(target[s], 6), taken))
    return sorted(out)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, size int, taken int").repartition(parts)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    r = random.Random(seed)
    names = ["b", "a", "é", "Z", None, "", "c"]
    rows = [(i, names[min(int(r.expovariate(.7)), 6)], " ".join("x" * r.randint(0, 60))) for i in range(120)]
    rows += [(7, "a", "one two\tthree\x0bfour  "), (None, "b", "x y"), (None, "b", "x y"), (500, "only empty", ""), (501, None, None), (502, "a", "a b  ")]
    rows += [(9, "b", "same row again")] * 40
    got = mixing.mix(frame(spark, rows)).collect()
    assert sorted((str(g["doc_id"]), str(g["source"]), g["size"], g["source_size"], round(g["target"], 6), g["taken"]) for g in got) == brute(rows)
    taken, target = defaultdict(int), {}
    for g in got:
        taken[g["source"]] += g["taken"]
        target[g["source"]] = g["target"]
        assert 0 <= g["taken"] <= 2 * g["size"]
    assert all(0 <= target[s] - taken[s] < 1 for s in target)
    again = mixing.mix(frame(spark, rows, 7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


@pytest.mark.parametrize("weights,percent,epochs", [((1,), 40, 1), ((5, 1), 300, 4), ((1, 9), 200, 2)])
def test_other_shares(spark, weights, percent, epochs):
    rows = [(i, "abcd"[i % 7 % 4], "w " * (i % 13)) for i in range(60)]
    got = mixing.mix(frame(spark, rows), weights=weights, percent=percent, epochs=epochs).collect()
    want = brute(rows, weights=weights, percent=percent, epochs=epochs)
    assert sorted((str(g["doc_id"]), str(g["source"]), g["size"], g["source_size"], round(g["target"], 6), g["taken"]) for g in got) == want


def test_emitted_texts_hold_the_words_taken(spark):
    rows = [(i, "ab"[i % 5 > 1], f"w{i}  x y\nz" + " q" * i) for i in range(30)] + [(99, "a", None)]
    mixed = mixing.mix(frame(spark, rows), carry=["text", "size"])
    taken = {r["doc_id"]: (r["taken"], r["size"], r["text"]) for r in mixed.collect()}
    words = defaultdict(int)
    for r in mixing.emit(mixed).collect():
        words[r["doc_id"]] += count(r["text"])
        whole = taken[r["doc_id"]][2]
        assert r["text"] == whole or whole.split()[:count(r["text"])] == r["text"].split(" ")
    assert {i: n for i, (n, _, _) in taken.items() if n} == dict(words)


def test_empty_table(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
    got = mixing.mix(frame(spark, [(1, "a", None), (2, None, " ")])).collect()
    assert sorted((g["doc_id"], g["size"], g["target"], g["taken"]) for g in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_no_python_in_the_plan(spark):
    plan = mixing.emit(mixing.mix(frame(spark, [(1, "a", "x y"), (2, "b", "z")]), carry=["text"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_prefix_sums_over_parts_of_a_hot_group(spark):
    r = random.Random(5)
    rows = [(None if i % 3 else r.choice("ab"), r.randint(0, 9), r.randint(0, 5), i) for i in range(500)]
    frame = spark.createDataFrame(rows, "g string, k int, v long, i long")
    got = prefix_sums(frame, ["g"], [F.col("k").desc(), F.col("i")], ["v"]).collect()
    before = defaultdict(int)
    want = {}
    for g, k, v, i in sorted(rows, key=lambda x: (-x[1], x[3])):
        want[i] = before[g]
        before[g] += v
    assert {x["i"]: x["v_before"] for x in got} == want
