"""Toxicity: restored words, held-out accuracy, odd rows."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirline.llm import toxicity
from shapes import docs  # noqa: F401


@pytest.fixture(scope="module")
def scorer(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    return toxicity.train(docs.filter(~held), labels.filter(~held)), docs.filter(held).join(labels, "doc_id")


def test_restores_disguised_words(scorer):
    model = scorer[0].model
    for seen, meant in {"1d10t": "idiot", "id!ot": "idiot", "stup1d": "stupid", "scuuum": "scum", "p@thetic": "pathetic", "l0s3r": "loser", "m.o.r.o.n": "moron", "tr@$h": "trash"}.items():
        assert model.restore(seen) == meant


def test_disguise_does_not_hide_and_plain_words_stay(scorer):
    s = scorer[0]
    base = "the andion thereat of an inst ondeed thing "
    clean = s.score([base * 3])[0]
    for word in ("idiot scum", "1d10t sc*m", "i d i o t s c u m", "IDIOOOOT scuuum", "i.d.i.o.t s-c-u-m"):
        assert s.score([base + word + " " + base])[0] > clean + 0.3, word
    assert clean < 0.5


def test_held_out_accuracy(scorer):
    rows = toxicity.score(scorer[1].withColumn("score", F.lit(1)), scorer[0]).collect()
    y, p = np.array([r["toxic"] for r in rows]), np.array([r["score"] >= 0.7 for r in rows])
    assert (p & (y == 1)).sum() / p.sum() > 0.9 and (p & (y == 1)).sum() / (y == 1).sum() > 0.8
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows_and_tables(spark, scorer, docs):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "x " * 100_000), (5, "$" * 5000), (6, "a" * 5000), (6, "a" * 5000), (None, "idiot")]
    got = toxicity.score(docs(rows), scorer[0]).collect()
    assert len(got) == len(rows)
    base = [r["score"] for r in got if r["doc_id"] in (1, 2, 3)]
    assert len(set(base)) == 1 and base[0] < 0.5
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs(rows), toxicity.train(docs(rows), none)).agg(F.max("score")).first()[0] < 1e-6
    assert toxicity.score(docs([]), scorer[0]).count() == 0


def test_best_path_equals_all_paths(scorer):
    model = scorer[0].model
    for token in ("1d10t", "sc*m", "!6*1", "l0$$$er", "a", "$|_|9!9", "--x", "2+2"):
        costs = {}
        for path in itertools.product(*model.lattice(token)):
            word = "".join(letter for letter, _ in path)
            codes = [0, 0, *[model.index[c] for c in word], 0]
            cost = sum(c for _, c in path) + sum(model.cost[x] for x in zip(codes, codes[1:], codes[2:]))
            costs[word] = min(cost, costs.get(word, np.inf))
        assert np.isclose(costs[model.restore(token)], min(costs.values())), token


def test_long_spread_and_sign_only_disguises(scorer):
    s = scorer[0]
    clean = s.score(["the andion thereat"])[0]
    for word in ("i" * 45 + "diot scum", "i  d  i  o  t   s  c  u  m", "i/d/i/o/t s/c/u/m", "i - d - i - o - t s | c | u | m", "!d!0+ s\tc\tu\tm"):
        assert s.score(["the andion thereat " + word])[0] > clean + 0.3, word
    assert toxicity.is_odd("$7|_|9!9") and toxicity.is_odd("i" * 45 + "diot")
    for plain in ("2019", "$5,000", "12:30", "(100%)", "3.14", "---", "word", "http"):
        assert not toxicity.is_odd(plain), plain
    assert max(s.score(["the andion thereat " + x for x in ("1/2/3", "$5,000 (100%) 12:30", "2019 3.14", "a / b / c", "x y z")])) < clean + 0.1


def test_hostile_tokens_take_time_in_proportion(scorer):
    start = time.monotonic()
    scorer[0].score(["a1" * 20_000, "x " * 200_000, "." * 200_000, "x." * 100_000 + "!", "a - " * 100_000])
    assert time.monotonic() - start < 20


def test_learns_from_every_labelled_row(spark):
    """A word that only documents late in the order of hashed ids hold is learnt like any other."""
    ids = spark.range(6000).orderBy(F.xxhash64("id")).select("id").collect()
    rows = [(r["id"], "an ordinary text about " + ("pfrundling things" if i >= 4400 and i % 2 else "fgrawful things" if i % 2 else "weather and things"), i % 2) for i, r in enumerate(ids)]
    given = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    s = toxicity.train(given.select("doc_id", "text"), given.select("doc_id", "toxic"))
    clean, early, late = s.score(["an ordinary text", "an ordinary text fgrawful", "an ordinary text pfrundling"])
    assert clean < 0.5 < 0.7 < min(early, late)


def test_only_tokens_that_may_hold_a_feature_are_restored(monkeypatch):
    model = toxicity.CharModel({"idiot": 5, "letter": 5, "ab": 5, "trash": 5})
    weights = dict.fromkeys(["idi", "idiot$", "trash$", "tras", "ab$", "xyz123"], 1.0)
    tokens = ["1d!0t", "idiiiot,", "letter,", "ab", "aab.", "4b!", "tr@$h!", "trr@sh", "xyz123", "trash$", "l3tt3r", "$$$", "a", "!!@", "ididi,", "i.d.i.o.t"]
    calls, whole = [], model.restore
    monkeypatch.setattr(model, "restore", lambda token: calls.append(token) or whole(token))
    scorer = toxicity.Scorer(model, weights, 0.0)
    for token in tokens:
        shapes = {token.rstrip(".,;:"), toxicity.plain_word(token)} if toxicity.is_odd(token) else set()
        words = [toxicity.plain_word(token), *(whole(s) for s in shapes if s)]
        assert scorer.token_features(token) == {f for w in words for f in toxicity.word_features(w) if f in weights}, token
    calls.clear()
    assert not scorer.token_features("letter,") and not scorer.token_features("boook.") and not calls
