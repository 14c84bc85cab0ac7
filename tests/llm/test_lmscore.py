"""Pseudo-likelihood: gradients, a direct computation, held-out texts, odd rows."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weirline.llm import lmscore
from shapes import docs  # noqa: F401


def test_gradients_by_differences():
    net = lmscore.WindowNetwork(np.arange(lmscore.SYMBOLS))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    context, token = np.array([[0, 3, 5, 9], [0, 0, 5, 5], [70, 3, 1, 0]]), np.array([3, 200, 1])
    loss, grad = net.gradients(context, token)
    assert math.isclose(loss, -net.logp(context, token).mean(), rel_tol=1e-9)
    for k, at in (("embed", (3, 1)), ("embed", (5, 7)), ("place", (2, 5)), ("hidden", (4,)), ("cls", (2, 0)), ("cls_bias", (3,)), ("tok", (0, 2, 3)), ("tok_bias", (3, 8))):
        keep, e = net.p[k][at], 1e-5
        net.p[k][at] = keep + e
        up = net.gradients(context, token)[0]
        net.p[k][at] = keep - e
        down = net.gradients(context, token)[0]
        net.p[k][at] = keep
        assert abs((up - down) / (2 * e) - grad[k][at]) < 1e-6


def test_probabilities_sum_to_one():
    net = lmscore.WindowNetwork(np.arange(lmscore.SYMBOLS))
    context = np.repeat([[4, 900, 1, 0]], lmscore.SYMBOLS, 0)
    assert math.isclose(np.exp(net.logp(context, np.arange(lmscore.SYMBOLS)).astype(np.float64)).sum(), 1, rel_tol=1e-4)


def direct(model, corpus, text):
    """The score by loops over words, with the corpus counted anew."""
    words = lambda t: (t or "").lower().split()
    rare = [w for t in corpus for w in words(t) if w not in model.words.symbols]
    total, s = 0.0, [0, 0, *[model.words.symbols.get(w, 1) for w in words(text)], 0, 0]
    for k, w in enumerate(words(text), 2):
        total += float(model.network.logp(np.array([[s[k - 2], s[k - 1], s[k + 1], s[k + 2]]]), np.array([s[k]]))[0])
        if s[k] == 1:
            total += math.log((rare.count(w) + 1) / (len(rare) + len(set(rare)) + 1))
    return total


@pytest.mark.parametrize("at_hand", [5, 3, 100])
def test_scores_are_sums_of_conditionals(spark, docs, monkeypatch, at_hand):
    monkeypatch.setattr(lmscore, "vocabulary", few_symbols(at_hand))
    texts = ["the cat sat on the mat", "the dog sat", "The\tcat  sat\n", None, "", " \n", "x", "the " * 3_000, "zebra quark", "the dog sat", "a zebra sat on zebra quark"]
    model = lmscore.train(docs(texts))
    new = [*texts, "never seen zebra", "the never the"]
    got = {r["doc_id"]: r for r in lmscore.score(docs(new), model).collect()}
    assert len(got) == len(new)
    for i, t in enumerate(new):
        n = len((t or "").split())
        assert got[i]["n_tokens"] == n and (got[i]["mean_logprob"] is None) == (n == 0)
        assert math.isclose(got[i]["score"], direct(model, texts, t), rel_tol=1e-4, abs_tol=1e-5)
    same = {r["doc_id"]: r["score"] for r in lmscore.score_texts(model.texts, model).collect()}
    assert all(math.isclose(same[i], got[i]["score"], rel_tol=1e-6, abs_tol=1e-9) for i in range(len(texts)))


def few_symbols(at_hand):
    """Three words are symbols, ``at_hand`` words in all have their counts at hand, the others are joined."""
    def cut(counts):
        ranked = counts.orderBy(F.desc("n"), "word").collect()
        first, rest, total = ranked[:3], ranked[3:at_hand], sum(r["n"] for r in ranked)
        stand = np.zeros(lmscore.SYMBOLS)
        stand[2:5] = [r["n"] for r in first]
        stand[1] = total - stand.sum()
        size = int(stand[1]) + len(ranked) - 3 + 1
        return lmscore.Vocabulary({r["word"]: i + 2 for i, r in enumerate(first)}, stand, {r["word"]: math.log((r["n"] + 1) / size) for r in rest}, size, ranked[min(at_hand, len(ranked)) - 1]["n"])
    return cut


def test_ranked_words(spark, docs, monkeypatch):
    counts = lmscore.word_counts(docs(["b a a c", "A b\tc c c", None, "d e"]))
    got = lmscore.vocabulary(counts)
    assert got.symbols == {"c": 2, "a": 3, "b": 4, "d": 5, "e": 6} and list(got.stand[:7]) == [0, 0, 4, 3, 2, 1, 1] and got.size == 1
    monkeypatch.setattr(lmscore, "SYMBOLS", 4)
    monkeypatch.setattr(lmscore, "KNOWN", 4)
    got = lmscore.vocabulary(counts)
    assert got.symbols == {"c": 2, "a": 3} and set(got.shares) == {"b", "d"} and got.size == 4 + 3 + 1 and got.least == 1


def test_empty_corpus_and_clashing_columns(spark, docs):
    assert lmscore.score(docs([]), lmscore.train(docs([]))).count() == 0
    frame = docs(["one two", "two"]).withColumn("score", F.lit("old")).withColumn("key", F.lit(7)).withColumn("ids", F.lit("x")).withColumn("row", F.lit(None))
    out = lmscore.score(frame, lmscore.train(frame))
    assert dict(out.dtypes)["score"] == "double" and {(r["key"], r["ids"], r["row"]) for r in out.collect()} == {(7, "x", None)}


@pytest.fixture(scope="module")
def prose(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en'").select("doc_id", "text").dropDuplicates(["text"])
    return rows.withColumn("part", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)))


def mean(scored):
    return scored.agg(F.sum("score") / F.sum("n_tokens")).first()[0]


def test_held_out_prose_beats_shares_of_words_and_gains_from_more_texts(prose):
    """One vocabulary for all three, so that they divide the same words."""
    held, large = prose.filter("part = 0"), lmscore.train(prose.filter("part > 0"))
    network = shares = lmscore.WindowNetwork(large.words.stand)
    fewer = lmscore.encode(prose.filter("part = 1"), large.words)
    for number in range(lmscore.ROUNDS):
        network = lmscore.train_round(fewer, network, number)
    shares.p["cls"][:], shares.p["tok"][:] = 0, 0
    got, less, unigram = (mean(lmscore.score(held, lmscore.Model(large.words, n, large.counts, large.texts))) for n in (large.network, network, shares))
    assert got > unigram + 0.1 and got > less


def test_prose_scores_above_its_words_in_random_order(prose):
    model = lmscore.train(prose)
    mixed = prose.withColumn("text", F.array_join(F.transform(F.array_sort(F.transform(F.split("text", r"\s+"), lambda w, i: F.struct(F.md5(F.concat(w, i.cast("string"))).alias("k"), w.alias("w")))), lambda s: s["w"]), " "))
    a, b = lmscore.score(prose, model), lmscore.score(mixed, model).select("doc_id", F.col("mean_logprob").alias("m"))
    both = a.filter("n_tokens >= 20").join(b, "doc_id").agg(F.avg((F.col("mean_logprob") > F.col("m")).cast("int"))).first()[0]
    assert both > 0.9


def test_words_stay_arrow_and_hash_as_spark_does(spark):
    """No Python string is made of a word before its hash is asked for; empty ends of texts are no words."""
    owner, words, index = lmscore.split_words(pa.array([" B a ", None, "", "a  c\n", "b"]))
    assert isinstance(words, pa.Array) and words.to_pylist() == ["b", "a", "c"]
    assert owner.tolist() == [0, 0, 3, 3, 4] and index.tolist() == [0, 1, 1, 2, 0]
    same = spark.createDataFrame([(w,) for w in ("b", "a", "ü€")], "w string").select(F.xxhash64("w")).collect()
    assert lmscore.hashed(pa.array(["b", "a", "ü€"])).tolist() == [r[0] for r in same]


def test_log_probabilities_far_below_the_greatest():
    h, weights, bias = np.eye(2, 3, dtype=np.float32), np.zeros((3, lmscore.CLASS_SIZE), np.float32), np.zeros(lmscore.CLASS_SIZE, np.float32)
    weights[0], bias[5] = 200, 1
    got = lmscore.logp_of(h, weights, bias, np.array([5, 5]))
    assert np.allclose(got, 1 - math.log(math.e + lmscore.CLASS_SIZE - 1), atol=1e-4)
