"""Counts, gains, scores and ranks against a direct computation."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex

from weirline.llm import resample
from shapes import prose  # noqa: F401


def word_list(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, target, sizes=(1, 1), buckets=10000, percent=10, least=20, seed="2024"):
    def feats(t):
        w = word_list(t)
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(sizes[0], sizes[1] + 1) for i in range(len(w) - n + 1)]

    source, wanted = Counter(f for _, t in rows for f in feats(t)), Counter(f for t in target for f in feats(t))
    s, t = sum(source.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1.0) * (s + buckets) / ((source[b] + 1.0) * (t + buckets))))
    out = []
    for i, text in rows:
        f = feats(text)
        weight = math.floor(sum(map(gain, f)) / len(f)) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(word_list(text))])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[:percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, rank int, buckets string").repartition(parts)


@pytest.mark.parametrize("more", [{}, {"sizes": (1, 3), "buckets": 70000, "percent": 35}, {"sizes": (2, 2), "buckets": 7, "least_words": 3, "percent": 100}])
def test_equals_brute_force(spark, prose, more):
    rows = [(i, prose(10 + i % 40, i % 61)) for i in range(150)]
    rows += [(500, None), (501, ""), (502, " .,! "), (None, prose(30, 7)), (None, prose(30, 7)), (3, rows[3][1]), (3, rows[3][1]), (600, "ÜBER Straße, don't-stop A1 " * 9), (601, prose(20000, 9))]
    target = [prose(40, s) for s in (1, 2, 3)] + [None, ""]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(frame(spark, rows), bench, **more).collect()
    want = brute(rows, target, **({k: v for k, v in more.items() if k != "least_words"} | ({"least": more["least_words"]} if "least_words" in more else {})))
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got), key=str) == want


def test_draws_what_resembles_the_target(spark, prose):
    rows = [(i, prose(60, i, "abcd" if i % 10 else "wxyz")) for i in range(400)]
    bench = spark.createDataFrame([(prose(3000, 9999, "wxyz"),)], "text string")
    drawn = [r["doc_id"] for r in resample.resample(frame(spark, rows), bench).filter("rank is not null").collect()]
    assert len(drawn) == 40 and sum(i % 10 == 0 for i in drawn) >= 16    # 4 by chance; the Gumbel values keep it a sample


def test_empty_tables(spark, prose):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(frame(spark, []), none).count() == 0
    got = resample.resample(frame(spark, [(1, prose(30, 1)), (2, None)]), none, percent=100).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["rank"]) for r in got] == [(1, 1), (2, None)]


def test_scan_gives_every_span():
    line = resample.collapsed("  The cat--sat ON\tthe é-mat ".encode())
    assert line == "the cat sat on the é mat".encode()
    words = line.split(b" ")
    for n, pattern in zip(range(1, 10), resample.scans((1, 9))):
        assert [m.group() for m in pattern.finditer(line, overlapped=True)] == [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
    assert all((resample._SPACES[c] == 32) == bool(regex.match(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]", bytes([c]).lower())) for c in range(256))


def test_gains_fall_with_the_source_share():
    g = resample.gains(np.array([0, 10, 1000]), np.array([10, 10, 10]))
    assert g[0] > g[1] > g[2] and resample.gains(np.zeros(4, int), np.zeros(4, int)).tolist() == [0] * 4
