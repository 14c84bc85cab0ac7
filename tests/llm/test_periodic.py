"""Runs against a scan of every period; the query against its rule, step by step."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from weirline.llm import periodic, queries
from shapes import docs, prose  # noqa: F401


def brute(w, least):
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                best.setdefault((i, j - i + q), q)     # periods grow: the first is the smallest
            i = max(j, i + 1)
    return sorted(((i, n, q) for (i, n), q in best.items()), key=lambda r: (r[0], r[2]))


def test_all_short_words_of_two_letters():
    for n in range(14):
        for w in itertools.product((0, 1), repeat=n):
            assert list(map(tuple, periodic.find_runs(np.array(w, np.int64), 2).tolist())) == brute(w, 2)


@pytest.mark.parametrize("seed", range(4))
def test_repeats_within_repeats(seed):
    r = random.Random(seed)
    for _ in range(300):
        w = [r.randrange(3) for _ in range(r.randint(1, 5))]
        while len(w) < 150 and r.random() < .9:
            w = (w * r.randint(1, 5))[:r.randint(1, 160)] + [r.randrange(3) for _ in range(r.randint(0, 3))]
        least = r.choice([2, 5, 12])
        assert list(map(tuple, periodic.find_runs(np.array(w, np.int64), least).tolist())) == brute(w, least)


def collapse(w, runs):
    return [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]


def test_rows_texts_and_clashing_names(docs, prose):
    line = "to be or not "
    texts = [prose(50, 1), line * 9, prose(5, 2) + " " + "ha " * 40 + prose(6, 3), line * 3, line * 2, None, "", " \n\t ", "x " * 30000,
             (prose(700, 4) + " ") * 3, line * 9, "é x " * 12, "a b a a b a b a a b a a b a b a a b a b"]
    rows = [*enumerate(texts), (None, line * 4), (1, texts[1])]
    got = periodic.periodic_runs(docs(rows).withColumnRenamed("lang", "runs").withColumnRenamed("source", "n_words")).collect()
    assert len(got) == len(rows)
    out = sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"], r["score"]) for r in got)
    want = []
    for i, t in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        runs = [(0, 30000, 1)] if len(w) == 30000 else [(0, 2100, 700)] if len(w) == 2100 else brute(w, 12)
        want.append((str(i), len(w), runs, " ".join(w[:1] if len(w) == 30000 else w[:700] if len(w) == 2100 else collapse(w, runs)), "x"))
    assert out == sorted(want)


def test_empty_table_and_odd_columns(spark, docs):
    assert periodic.periodic_runs(docs([])).count() == 0


def test_query_against_its_rule(spark, prose, tmp_path):
    r = random.Random(11)
    rows = [(i, prose(r.randint(0, 90), i) if i % 4 else (prose(r.randint(1, 7), i) + "\n") * r.randint(1, 30)) for i in range(150)] + [(None, None), (1 << 40, "a \x0b b " * 50), (-5, "q " * 13), (12, "")]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None) > 8
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        w, h = [x.decode() for x in (t or "").encode().split()], zlib.crc32(str(i).encode()) if i is not None else 1
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute(w, 12)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(runs), *top, top[1] and 1000 * top[1] // top[2], sha("".join("%d,%d,%d\n" % x for x in runs)), sha(" ".join(collapse(w, runs)))))
    got = [tuple(x) for x in queries.op13_periodic_runs(spark, str(tmp_path)).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_proposals_are_linear():
    for w in ([0] * 4000, [0, 1] * 2000, list(range(40)) * 100):
        assert len(periodic.find_runs(np.array(w, np.int64))) == 1
        assert len(periodic.proposals(np.ones(4000, np.int64), np.arange(4000), 64)[0]) <= 2 * periodic.NEAR * 4000
