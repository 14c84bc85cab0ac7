"""Toxicity scores behind a noisy-channel deobfuscation.

A writer's word may reach the text with letters swapped for look-alikes, drawn out,
broken up by signs or spaces.  Each odd token becomes a lattice: for every character
the letters it may stand for, or nothing, with the channel's cost.  The Viterbi path
under a character trigram model of ordinary and offending words is the restored
word.  Tokens of plain letters stay as they are.

The restored text is scored by a logistic regression on the beginnings (3 to 6
characters) of its words and on whole words that are more frequent under label 1; a
text counts a feature once, so that a long text is no less toxic for its other words.  Both
models are fitted on all labelled documents that may be learnt from, both labels weighing
the same: features and trigrams are counted by Spark, and the weights are fitted by Spark
ML over the distinct sets of features and how often each occurs.

Each distinct token is judged once per task and remembered; the whole text of every
document is scored.  Null and empty texts and texts of white space have no feature
and get the model's base score.  Without any labelled row, or with only one label,
every score is the share of label 1 (0 without rows).  Repeated rows are scored each, an empty
table gives an empty result; extra columns stay.  Very long texts and tokens are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirline.llm.common import byte_slices, drop_stored, extended, stored

FEATURES = 1500          # features kept
BEGINNINGS = (3, 4, 5, 6)
COUNTED = 300_000        # features a task counts before it hands its counts on: a memory bound, too
RIDGE, STEPS = 3e-5, 100
CACHED = 300_000         # tokens remembered in a Python worker: a memory bound, not a limit of the result

# What a sign may stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
EDGE = ".,;:!?\"'()[]{}|*#%&~^<>=/\\`-_…“”„«»"   # signs that may stand before or after a word
SPACED = re.compile(r"(?<!\S)(?:\S[ \t.*_-]){2,}\S(?!\S)")
# The same with any number of signs between: letters and signs have none in common, so a scan never goes back.
APART = re.compile(r"(?<!\S)[^\W\d_](?:[ \t.*_/|~-]++[^\W_]){2,}+(?!\S)")
# What every match of the two begins with; most texts have none.
SPELT = re.compile(r"(?<!\S)\S[ \t.*_/|~-]+\S[ \t.*_/|~-]")
NOT_SIGNS = re.compile(r"[\W_]+")
DRAWN_OUT = re.compile(r"(.)\1\1")
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
# Letters without a double one: the lattice has one path, the word itself.
ONE_PATH = re.compile(rf"(?:([{LETTERS}])(?!\1))*+")


def is_odd(token: str) -> bool:
    """Could the token be a word in disguise: letters mixed with signs, drawn out, or nothing but signs
    that stand for letters (two kinds or more besides digits: amounts and numbers are none)?"""
    if token.isalpha():
        return bool(DRAWN_OUT.search(token))
    if any(map(str.isalpha, token)):
        return True
    signs = [c for c in plain_word(token) if c in LOOKS_LIKE]
    return len(signs) > 2 and len({c for c in signs if not c.isdigit()}) > 1


class CharModel:
    """Letter trigrams with add-one smoothing; words begin and end with a border."""

    def __init__(self, words: dict[str, int]):
        count = np.zeros((len(LETTERS) + 1,) * 3, np.int64)
        self.add(count, words.items())
        self.fit(count)

    index = {c: i + 1 for i, c in enumerate(LETTERS)}   # 0: the border

    @classmethod
    def add(cls, count: np.ndarray, words: Iterable[tuple[str, int]]) -> None:
        for w, weight in words:
            codes = [0, 0, *[cls.index[c] for c in w if c in cls.index], 0]
            for a, b, c in zip(codes, codes[1:], codes[2:]):
                count[a, b, c] += weight

    def fit(self, count: np.ndarray) -> None:
        smooth = count + 0.05
        self.cost = -np.log(smooth / smooth.sum(2, keepdims=True))
        self.rows = [[row.tolist() for row in rows] for rows in self.cost]   # plain numbers, as paths read them one by one

    def lattice(self, token: str) -> Iterator[list[tuple[str, float]]]:
        """For every character: (letter or nothing, cost in the channel)."""
        run = 0
        for i, c in enumerate(token):
            run = run + 1 if i and token[i - 1] == c else 0
            if c in self.index:
                yield [(c, 0.0)] if not run else [(c, 1.0), ("", 1.0)] if run == 1 else [("", 0.0)]
            else:
                likes = [(x, 1.5 + 0.5 * (len(LOOKS_LIKE[c]) > 2)) for x in LOOKS_LIKE.get(c, "")]
                yield [*likes, ("", 2.5 if c in LOOKS_LIKE else 0.5)] if not run or c.isdigit() else [*likes, ("", 0.5)]

    def restore(self, token: str) -> str:
        """The cheapest path through the lattice under channel and language costs."""
        if ONE_PATH.fullmatch(token):
            return token
        # A path is (its last letter, the path before it): paths share what they have in common.
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in self.lattice(token):
            step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for key, (cost, path) in states.items():
                a, b = key
                for letter, channel in options:
                    if letter:
                        k = self.index[letter]
                        to, total = (b, k), cost + channel + self.rows[a][b][k]
                    else:
                        to, total = key, cost + channel
                    if to not in step or total < step[to][0]:
                        step[to] = total, (letter, path) if letter else path
            states = step
        path = min(((cost + self.rows[a][b][0], path) for (a, b), (cost, path) in states.items()), key=lambda x: x[0])[1]
        letters = []
        while path:
            letter, path = path
            letters.append(letter)
        return "".join(reversed(letters))


def word_features(word: str) -> list[str]:
    return [word[:k] for k in BEGINNINGS if len(word) >= k] + ([word + "$"] if word else [])


def plain_word(token: str) -> str:
    return token.strip(EDGE)


def text_tokens(text: str) -> set[str]:
    return set(text.lower().split())


class Scorer:
    """A fitted model: trigram costs, feature weights, bias."""

    def __init__(self, model: CharModel, weights: dict[str, float], bias: float):
        self.model, self.weights, self.bias = model, weights, bias
        self.longest = max(map(len, weights), default=0) + max(BEGINNINGS)
        self.begun = {f[:k] for f in weights for k in range(len(f) + 1)}
        self.seen: set[str] = set()
        self.telling: dict[str, frozenset[str]] = {}   # tokens with a feature

    def known(self, word: str) -> set[str]:
        """The features of a word that have a weight."""
        found = set()
        for k in BEGINNINGS:
            if len(word) < k:
                break
            if word[:k] not in self.begun:
                return found
            if word[:k] in self.weights:
                found.add(word[:k])
        if word and word + "$" in self.weights:
            found.add(word + "$")
        return found

    def may_tell(self, shape: str) -> bool:
        """Does any path through the lattice spell a word with a known feature?  Most leave the
        features' beginnings after a few letters."""
        open_ = {""}
        for options in self.model.lattice(shape):
            open_ = {head + letter for head in open_ for letter, _ in options} & self.begun
            if not open_:
                return False
            if any(head in self.weights for head in open_):
                return True
        return any(head + "$" in self.weights for head in open_)

    def token_features(self, token: str) -> frozenset[str]:
        word = plain_word(token)
        found = self.known(word)
        if is_odd(token):
            for shape in {token.rstrip(".,;:"), word}:
                if ONE_PATH.fullmatch(shape):
                    found |= self.known(shape) if shape != word else set()
                elif self.may_tell(shape):
                    found |= self.known(self.model.restore(shape))
        return frozenset(found)

    def _spaced(self, text: str) -> set[str]:
        """Features of words spelt out with a space or sign after each character."""
        found: set[str] = set()
        for run in {run[::2] for run in SPACED.findall(text)} | {NOT_SIGNS.sub("", run) for run in APART.findall(text)}:
            joined = run if run.isalpha() else self.model.restore(run)
            for i in range(len(joined)):
                for f in word_features(joined[i:i + self.longest]) if i + self.longest > len(joined) else (joined[i:i + k] for k in BEGINNINGS):
                    if len(f) >= 4 and f in self.weights:
                        found.add(f)
        return found

    def features(self, texts: list[str | None]) -> list[set[str]]:
        lowered = [(t or "").lower() for t in texts]
        cut = [set(t.split()) for t in lowered]
        for tokens in cut:
            new = tokens - self.seen
            if new:
                if len(self.seen) > CACHED:
                    self.seen, self.telling, new = set(), {}, tokens
                for token in new:
                    if found := self.token_features(token):
                        self.telling[token] = found
                self.seen |= new
        out = []
        for text, tokens in zip(lowered, cut):
            found: set[str] = set()
            for token in tokens & self.telling.keys():
                found |= self.telling[token]
            if SPELT.search(text):
                found |= self._spaced(text)
            out.append(found)
        return out

    def score(self, texts: list[str | None]) -> list[float]:
        return [1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.bias + sum(map(self.weights.get, sorted(f))))))) for f in self.features(texts)]


def _weights(rows: DataFrame, features: list[str], n1: int, n0: int) -> tuple[np.ndarray, float]:
    """Weights and bias over rows of a set of features (``hit``), a label (``y``) and a number of
    texts (``n``); both labels weigh the same."""
    fair = rows.select("hit", F.col("y").cast("double").alias("y"), (F.col("n") * F.when(F.col("y") == 1, 0.5 / n1).otherwise(0.5 / n0) * (n1 + n0)).alias("n"))
    vectors = CountVectorizerModel.from_vocabulary(features, inputCol="hit", outputCol="x", binary=True)
    fit = LogisticRegression(featuresCol="x", labelCol="y", weightCol="n", regParam=RIDGE, standardization=False, maxIter=STEPS, family="binomial")
    model = fit.fit(vectors.transform(fair))
    return model.coefficients.toArray(), float(model.intercept)


def train(labelled: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer:
    """Fit on all rows of ``labelled`` (documents that may be learnt from) that have a label in ``labels``."""
    chosen = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")) \
        .groupBy("id").agg(F.max("y").alias("y"))
    # Of rows repeated under an id one is taken.  Read twice, so written.
    texts = stored(labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
                   .groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("y", "text"), "toxicity-labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def counts() -> Iterator[pa.RecordBatch]:
            for y, of in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(of), pa.string()), pa.array(np.full(len(of), y, np.int32)),
                                                  pa.array(list(of.values()), pa.int64())], names=["f", "y", "n"])
                of.clear()

        for batch in batches:
            for part in byte_slices(batch, "text"):
                for text, y in zip(part.column("text").to_pylist(), part.column("y").to_pylist()):
                    words = {plain_word(t) for t in text_tokens(text or "")}
                    found = {f"{w}$" for w in words if w}
                    for k in BEGINNINGS:
                        words = [w for w in words if len(w) >= k]
                        found.update([w[:k] for w in words])
                    seen[y].update(found)
                    seen[y][""] += 1
                if sum(map(len, seen.values())) > COUNTED:
                    yield from counts()
        yield from counts()

    one, zero = (F.sum(F.when(F.col("y") == v, F.col("n")).otherwise(0)).alias(f"n{v}") for v in (1, 0))
    counted = stored(texts.mapInArrow(count, "f string, y int, n long").groupBy("f").agg(one, zero).filter("f = '' OR n1 + n0 >= 3"), "toxicity-counts")
    total = counted.filter("f = ''").first()
    n1, n0 = (total["n1"], total["n0"]) if total else (0, 0)
    if not n1 or not n0:
        drop_stored(texts, counted)
        share = min(1 - 1e-9, max(1e-9, n1 / (n1 + n0) if n1 + n0 else 0.0))
        return Scorer(CharModel({}), {}, math.log(share / (1 - share)))
    odds = F.expr(f"(ln((n1 + 0.5) / ({n1} - n1 + 0.5)) - ln((n0 + 0.5) / ({n0} - n0 + 0.5))) / sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))")
    told = counted.filter("f <> '' AND n1 + n0 >= 3").withColumn("z", odds)
    best = [r["f"] for r in told.filter("z > 2").orderBy(F.desc("z"), "f").limit(FEATURES).collect()]
    model = _char_model(told.filter("endswith(f, '$')"), n1, n0)
    wanted = frozenset(best)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, dict.fromkeys(wanted, 0.0), 0.0)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                hit = [sorted(found) for found in scorer.features(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(hit, pa.list_(pa.string()))], names=["y", "hit"])

    hits = stored(texts.mapInArrow(present, "y int, hit array<string>").groupBy("y", "hit").agg(F.count(F.lit(1)).alias("n")), "toxicity-hits")
    w, b = _weights(hits, best, n1, n0) if best else ((), 0.0)
    drop_stored(texts, counted, hits)
    return Scorer(model, {f: float(v) for f, v in zip(best, w) if abs(v) > 1e-3}, b)


def _char_model(words: DataFrame, n1: int, n0: int) -> CharModel:
    """Trigrams of all whole words (``f``, with ``$`` at its end), the offending ones with more weight.
    A count per label is taken as if the labels had equally many texts."""
    one, zero = f"n1 * {(n1 + n0) / (2 * n1)}D", f"n0 * {(n1 + n0) / (2 * n0)}D"
    weighed = words.select("f", F.expr(f"bigint(round({one} + {zero} + 20 * greatest(0D, {one} - {zero})))").alias("w"))

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((len(LETTERS) + 1,) * 3, np.int64)
        for batch in batches:
            CharModel.add(count, zip((f[:-1] for f in batch.column("f").to_pylist()), batch.column("w").to_pylist()))
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(count.ravel()[at], pa.int64())], names=["at", "n"])

    model, count = CharModel({}), np.zeros((len(LETTERS) + 1) ** 3, np.int64)
    for r in weighed.mapInArrow(trigrams, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():   # at most one row per trigram
        count[r["at"]] = r["n"]
    model.fit(count.reshape((len(LETTERS) + 1,) * 3))
    return model


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text", out: str = "score") -> DataFrame:
    """Add the score (0 to 1) of every row's whole text (a column of that name is replaced)."""
    base = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, text_col):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scorer.score(part.column(text_col).to_pylist()), pa.float64())],
                                                 names=[*part.schema.names, out])

    return base.mapInArrow(run, extended(base, f"`{out}` double"))
