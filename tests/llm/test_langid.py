"""Language ID: gradients, held-out accuracy, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from weirline.llm import langid


def test_gradients_by_differences():
    net = langid.Network(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    grid, size, order = net.padded([b"abc", b"de", b"abcdef", b"x"])
    label = np.array([0, 1, 2, 0])[order]
    _, grad = net.gradients(grid, size, label)
    rng = np.random.default_rng(0)
    for k, p in net.p.items():
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in p.shape) if k[0] != "x" else (rng.choice(grid[0]), rng.integers(0, p.shape[1]))
            keep, e = p[at], 1e-4
            p[at] = keep + e
            up = net.gradients(grid, size, label)[0]
            p[at] = keep - e
            down = net.gradients(grid, size, label)[0]
            p[at] = keep
            assert abs((up - down) / (2 * e) - grad[k][at]) < 1e-3, k


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    net = langid.train(docs.filter(~held), docs_per_lang=60)
    got = langid.predict(docs.filter(held).withColumn("score", F.lit("clash")), net).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    odd = [None, "", " 12 % \n", "the " * 50_000, "é" * 3000, "the the"]
    rows = langid.predict(spark.createDataFrame([(i, t) for i, t in enumerate(odd)] + [(5, "the the")], "doc_id long, text string"), net).collect()
    assert len(rows) == 7
    by = {r["doc_id"]: r for r in rows}
    assert [by[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and [by[i]["score"] for i in range(3)] == [0.0] * 3
    assert all(r["lang_pred"] in net.languages and 0 < r["score"] <= 1 for r in rows if r["doc_id"] > 2)
    assert abs(by[3]["score"] - by[5]["score"]) < 1e-9   # a mean over positions


def test_no_labels_and_empty_table(spark):
    none = spark.createDataFrame([(1, "x", None)], "doc_id long, text string, lang string")
    assert langid.train(none) is None
    assert langid.predict(none, None).select("lang_pred", "score").collect() == [("und", 0.0)]


def test_word_table_bound_changes_nothing(monkeypatch):
    net = langid.Network(["a", "b"])
    texts = ["one two three", "four five", "one six seven eight"]
    whole = langid.Predictor(net).judge(texts)
    monkeypatch.setattr(langid, "CACHED_WORDS", 2)
    small = langid.Predictor(net)
    again = [small.judge([t]) for t in texts]
    assert [l[0] for l, _ in again] == whole[0]
    assert np.allclose([s[0] for _, s in again], whole[1], atol=1e-6)   # sums of single-precision numbers


def test_sample_is_bounded_by_rows(spark, monkeypatch):
    """Rows repeated under one id, and one language that holds nearly all rows."""
    rows = [(1, "one two three " * 30, "a")] * 600 + [(i, f"word{i} other", "a") for i in range(2, 400)] + [(500 + i, "vier funf", "b") for i in range(9)] + [(None, "x y", "b")]
    seen = {}
    monkeypatch.setattr(langid.Network, "fit", lambda self, words, label: seen.update(zip("wl", (words, label))) or self)
    net = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5), docs_per_lang=40, words_per_doc=20)
    assert net.languages == ["a", "b"] and (seen["l"] == 0).sum() <= 40 * 20 and (seen["l"] == 1).sum() == 18
