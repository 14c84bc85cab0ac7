"""Exact top-k against all scores."""

import numpy as np
import pytest

from weirline.llm import topk


@pytest.mark.parametrize("block", [16, 4096])
def test_equals_all_scores(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    r = np.random.default_rng(1)
    x = r.normal(0, 0.2, (120, 8)).astype(np.float32)
    x[20:40] = x[20]                       # ties
    x[50] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, []), (202, [1.0] * 7 + [float("nan")]), (203, [1.0] * 7 + [float("inf")]),
                                                         (204, [1.0] * 7 + [None]), (205, [0.5] * 3), (None, [0.1] * 8), (7, x[7].tolist())]
    frame = spark.createDataFrame([(*row, 9) for row in rows], "vec_id long, embedding array<float>, rank int").repartition(4)
    v = topk.quantised(frame)
    got = topk.top_k(v.filter("id % 10 = 0"), v, 10).collect()
    q = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    want = []
    for i in range(0, 120, 10):
        score = q @ q[i]
        best = sorted((j for j in range(120) if j != i), key=lambda j: (-score[j], j))[:10]
        want += [(i, k + 1, j, int(score[j])) for k, j in enumerate(best)]
    assert sorted(map(tuple, got)) == want


def test_few_candidates_and_empty_table(spark):
    v = topk.quantised(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 1.0])], "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, topk.top_k(v.filter("id = 0"), v, 10).collect())) == [(0, 1, 1, 1024 * 512), (0, 2, 2, 1024 * 512)]
    assert topk.top_k(v.filter("id = 0"), v.filter("id = 0"), 10).count() == 0
    assert topk.top_k(v.limit(0), v.limit(0), 10).count() == 0


@pytest.mark.parametrize("size", [1e3, 1e5, 1e6, 1e9, 1e12])
def test_large_components_are_exact(spark, size):
    """Beyond 2^53 too; scores beyond a long are the nearest long."""
    r = np.random.default_rng(2)
    x = np.floor(r.normal(0, size, (60, 8)))
    x[10:30] = x[10] + r.integers(0, 2, (20, 8))      # scores that differ by little
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    v = topk.quantised(frame)
    got = topk.top_k(v.filter("id % 10 = 0"), v, 10).collect()
    whole = [[1024 * int(c) for c in row] for row in x]
    want = []
    for i in range(0, 60, 10):
        score = [min(max(sum(a * b for a, b in zip(whole[i], w)), topk.LONG[0]), topk.LONG[1]) for w in whole]
        best = sorted((j for j in range(60) if j != i), key=lambda j: (-score[j], j))[:10]
        want += [(i, k + 1, j, score[j]) for k, j in enumerate(best)]
    assert sorted(map(tuple, got)) == want
