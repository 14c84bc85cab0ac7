"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every token is predicted from the two tokens on each of its sides; the sum of the
conditional log-probabilities (natural logarithms) is the document's score.

* Words are counted over all documents.  The ``SYMBOLS - 2`` most frequent are symbols of
  their own; symbol 0 is the border of a text, symbol 1 stands for every rarer word.
* The network embeds the neighbours, scales each by its place, adds them in a hidden layer,
  and gives a distribution over classes of symbols and one over the symbols of a class.
  It is trained in numpy on every text of the corpus: in each of ``ROUNDS`` rounds every task
  masks one token in ``MASK`` of its texts (others in each round), descends on them in
  minibatches, and the tasks' networks are averaged by the number of tokens.
* A rarer word has the probability of symbol 1 times its share among the rarer words, from
  the counts.  The counts are a Spark table that grows with the corpus and is joined at
  scoring; only the shares of the ``KNOWN`` most frequent words are at hand in the tasks, which
  gives the same numbers and spares their rows the join.  The words' probabilities sum to
  one, a small share left for words never seen.

Null and empty texts and texts of white space have no token: n_tokens 0, score 0, mean
null.  Very long texts are read whole, in chunks of windows.  Repeated rows count and are
scored each.  An empty corpus gives an empty result.
Other columns stay; those named n_tokens, score or mean_logprob are replaced.  The same rows in the
same files give the same scores; another layout trains in another order and shifts them slightly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirline.llm.common import byte_slices, stored

CLASSES, CLASS_SIZE = 64, 64
SYMBOLS = CLASSES * CLASS_SIZE   # 0: border, 1: rarer words, then the frequent words
SIDE, HIDDEN = 2, 24             # neighbours on each side; width of the network
ROUNDS, MASK = 4, 8              # rounds of training, and which share of the tokens each masks
BATCH, RATE = 4096, 0.08
CHUNK = 1 << 13                  # windows that are scored at once
KNOWN = 1 << 16                  # words whose counts tasks have at hand
MERGERS = 16                     # tasks that average networks


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(text number of every word, distinct words, index of every word in them), in text order."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    coded = pc.list_flatten(lists).dictionary_encode()
    index, empty = coded.indices.to_numpy(), pc.index(coded.dictionary, "").as_py()
    if empty < 0:
        return owner, coded.dictionary, index
    filled = index != empty
    words = pa.concat_arrays([coded.dictionary[:empty], coded.dictionary[empty + 1:]])
    return owner[filled], words, (index - (index > empty))[filled]


def hashed(words: pa.Array) -> np.ndarray:
    """What Spark's xxhash64 gives."""
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words.to_numpy(zero_copy_only=False)), np.uint64, len(words)).view(np.int64)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all documents; a task sums each slice of texts before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, text_col, 8 << 20):
                _, words, index = split_words(part.column(text_col))
                yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(index, minlength=len(words)).astype(np.int64))],
                                                 names=["word", "n"])

    return docs.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    symbols: dict[str, int]     # the symbol of each frequent word
    stand: np.ndarray           # how often each symbol stands in the corpus
    shares: dict[str, float]    # log share among the rarer words, of those at hand
    size: int                   # rarer words, and the distinct ones once more, and one for the unseen
    least: int                  # words that are not at hand are at most as frequent


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Words are ranked only from the power of two on at which enough of them are as frequent,
    so that tasks send few others to the driver."""
    tiers = sorted(((r["tier"], r["words"], r["total"]) for r in counts.groupBy(F.floor(F.log2("n")).alias("tier"))
                    .agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("total")).collect()), reverse=True)
    reached, low = 0, 0
    for tier, words, _ in tiers:
        reached, low = reached + words, tier
        if reached >= KNOWN:
            break
    top = counts.filter(F.floor(F.log2("n")) >= low).orderBy(F.desc("n"), "word").limit(KNOWN).collect()
    first, rest = top[:SYMBOLS - 2], top[SYMBOLS - 2:]
    stand = np.zeros(SYMBOLS)
    stand[2:2 + len(first)] = [r["n"] for r in first]
    stand[1] = sum(t for _, _, t in tiers) - stand.sum()
    size = int(stand[1]) + sum(w for _, w, _ in tiers) - len(first) + 1
    return Vocabulary({r["word"]: i + 2 for i, r in enumerate(first)}, stand, {r["word"]: float(np.log((r["n"] + 1) / size)) for r in rest}, size,
                      top[-1]["n"] if top else 0)


def encode(docs: DataFrame, words: Vocabulary, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A stored table: ``row`` (the columns ``keep``, all if not given), ``ids`` (the text's symbols, two bytes
    each), ``share`` (summed log shares of its rarer words that are at hand), ``rare`` (the others'
    hashes and how often) and ``key`` (the row's number)."""
    base = docs.select(F.struct(*(keep or docs.columns)).alias("row"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, symbols = pa.array(list(words.symbols), pa.string()), np.array([*words.symbols.values()], np.uint16)
        known, shares = pa.array(list(words.shares), pa.string()), np.array([*words.shares.values()])
        for batch in batches:
            for part in byte_slices(batch, "text", 4 << 20):
                owner, distinct, index = split_words(part.column("text"))
                symbol, share, name = np.ones(len(distinct), np.uint16), np.zeros(len(distinct)), np.zeros(len(distinct), np.int64)
                away = np.ones(len(distinct), bool)
                for places, values, out in ((frequent, symbols, symbol), (known, shares, share)):
                    at = pc.fill_null(pc.index_in(distinct, places), -1).to_numpy()
                    out[at >= 0] = values[at[at >= 0]]
                    away[at >= 0] = False
                name[away] = hashed(distinct.filter(pa.array(away)))
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=part.num_rows))])
                at = np.flatnonzero(away[index])
                pairs, times = np.unique(owner[at] * (len(distinct) + 1) + index[at], return_counts=True)
                who, which = np.divmod(pairs, len(distinct) + 1)
                bounds = np.searchsorted(who, np.arange(part.num_rows + 1)).astype(np.int32)
                rare = pa.StructArray.from_arrays([pa.array(name[which]), pa.array(times.astype(np.int32))], names=["w", "n"])
                ids = symbol[index].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array([ids[2 * a:2 * b] for a, b in zip(ends[:-1], ends[1:])], pa.binary()), pa.array(np.bincount(owner, share[index], part.num_rows)),
                     pa.ListArray.from_arrays(pa.array(bounds), rare), part.column("key")], names=["row", "ids", "share", "rare", "key"])

    row = base.schema["row"].dataType.simpleString()
    return stored(base.mapInArrow(run, f"row {row}, ids binary, share double, rare array<struct<w:long,n:int>>, key long"), "lm-texts")


def padded(ids: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts with ``SIDE`` borders before, between and after them, and each one's place."""
    place = np.arange(len(ids)) + SIDE * (owner + 1)
    flat = np.zeros(len(ids) + SIDE * (texts + 1), np.int32)
    flat[place] = ids
    return flat, place


def windows(flat: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours, token) at the given places."""
    return np.stack([flat.take(place + d) for d in (*range(-SIDE, 0), *range(1, SIDE + 1))], 1), flat[place]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(padded symbols, places, text number) of a slice of the column ``ids``."""
    ids = np.frombuffer(b"".join(column.to_pylist()), np.uint16)
    owner = np.repeat(np.arange(len(column)), pc.binary_length(column).to_numpy(zero_copy_only=False) // 2)
    return *padded(ids, owner, len(column)), owner


ONES = np.ones(CLASS_SIZE, np.float32)


def logp_of(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log-probability that the softmax of h @ weights + bias gives each row's target."""
    z = h @ weights
    z += bias
    own, top = z[np.arange(len(target)), target], z.max()
    z -= top
    total = np.exp(z, out=z) @ ONES.astype(z.dtype, copy=False)
    if total.min() < 1e-25:   # a row far below the greatest value
        z = h @ weights
        z += bias
        return own - exponents(z)[2]
    np.log(total, out=total)
    total += top
    own -= total
    return own


def exponents(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """e, its row sums and the logarithms that rows of z need to become log-probabilities (e / sum is the softmax)."""
    top = z.max()
    e = np.exp(z - top)
    total = e @ np.ones(z.shape[1], z.dtype)
    if total.size and total.min() < 1e-25:   # a row far below the greatest value
        top = z.max(1)
        e = np.exp(z - top[:, None])
        total = e.sum(1)
    return e, total, np.log(total) + top


class WindowNetwork:
    """p(token | neighbours) = p(class | neighbours) p(token | class, neighbours)."""

    def __init__(self, stand: np.ndarray, seed: int = 5):
        r = np.random.default_rng(seed)
        share = (np.asarray(stand, np.float64) + 1e-3).reshape(CLASSES, CLASS_SIZE)
        self.p = {"embed": r.normal(0, 0.3, (SYMBOLS, HIDDEN)), "place": r.normal(0.5, 0.3, (2 * SIDE, HIDDEN)), "hidden": np.zeros(HIDDEN),
                  "cls": r.normal(0, 0.05, (HIDDEN, CLASSES)), "cls_bias": np.log(share.sum(1)),
                  "tok": r.normal(0, 0.05, (CLASSES, HIDDEN, CLASS_SIZE)), "tok_bias": np.log(share)}   # starts as the shares of words
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def placed(self) -> list[np.ndarray]:
        """The symbols' embeddings as each place scales them."""
        return [self.p["embed"] * self.p["place"][j] for j in range(2 * SIDE)]

    def states(self, context: np.ndarray, placed: list[np.ndarray] | None = None) -> np.ndarray:
        tables = placed or self.placed()
        x = tables[0].take(context[:, 0], 0)
        for j in range(1, 2 * SIDE):
            x += tables[j].take(context[:, j], 0)
        x += self.p["hidden"]
        return np.tanh(x, out=x)

    @staticmethod
    def groups(cls: np.ndarray) -> Iterator[tuple[int, slice]]:
        """(class, its rows) for the classes present, in rows ordered by class."""
        ends = np.searchsorted(cls, np.arange(CLASSES + 1))
        for c in np.flatnonzero(ends[1:] > ends[:-1]):
            yield c, slice(ends[c], ends[c + 1])

    def logp(self, context: np.ndarray, token: np.ndarray, placed: list[np.ndarray] | None = None) -> np.ndarray:
        """ln p(token | neighbours) of every row."""
        order = np.argsort(token.astype(np.uint16), kind="stable")
        h, (cls, within) = self.states(context.take(order, 0), placed), np.divmod(token.take(order), CLASS_SIZE)
        if not len(token):
            return np.empty(0, h.dtype)
        got = logp_of(h, self.p["cls"], self.p["cls_bias"], cls)
        for c, rows in self.groups(cls):
            got[rows] += logp_of(h[rows], self.p["tok"][c], self.p["tok_bias"][c], within[rows])
        out = np.empty_like(got)
        out[order] = got
        return out

    def gradients(self, context: np.ndarray, token: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of the tokens and its gradients."""
        order = np.argsort(token.astype(np.uint16), kind="stable")
        p, n, context = self.p, len(token), context.take(order, 0)
        h, (cls, within) = self.states(context), np.divmod(token.take(order), CLASS_SIZE)
        out = {k: np.zeros_like(p[k]) for k in ("tok", "tok_bias")}

        def output(h, weights, bias, target):
            """(summed loss, gradient at the outputs of the mean loss)"""
            z, at = h @ weights, (np.arange(len(target)), target)
            z += bias
            dz, total, less = exponents(z)
            dz *= (1 / (n * total))[:, None]
            dz[at] -= 1 / n
            return float((less - z[at]).sum()), dz

        loss, dz = output(h, p["cls"], p["cls_bias"], cls)
        out["cls"], out["cls_bias"], dh = h.T @ dz, dz.sum(0), dz @ p["cls"].T
        for c, rows in self.groups(cls):
            more, dz = output(h[rows], p["tok"][c], p["tok_bias"][c], within[rows])
            loss += more
            out["tok"][c], out["tok_bias"][c] = h[rows].T @ dz, dz.sum(0)
            dh[rows] += dz @ p["tok"][c].T
        dx = dh * (1 - h * h)
        out["hidden"] = dx.sum(0)
        out["place"] = np.stack([(dx * p["embed"].take(context[:, j], 0)).sum(0) for j in range(2 * SIDE)])
        at, down = context.T.ravel(), dx.T
        out["embed"] = np.stack([np.bincount(at, (p["place"][:, d, None] * down[d]).ravel(), SYMBOLS) for d in range(HIDDEN)], 1).astype(dx.dtype)
        return loss / n, out

    def vector(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def with_vector(self, flat: np.ndarray) -> "WindowNetwork":
        new, at = object.__new__(WindowNetwork), 0
        new.p = {}
        for k, v in self.p.items():
            new.p[k], at = flat[at:at + v.size].reshape(v.shape).astype(np.float32), at + v.size
        return new


class Adam:
    """Descends on minibatches; the moments belong to one task and one round."""

    def __init__(self, network: WindowNetwork, rate: float):
        self.network, self.rate, self.t = network, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in network.p.items()}
        self.s = {k: np.zeros_like(v) for k, v in network.p.items()}

    def step(self, context: np.ndarray, token: np.ndarray) -> None:
        self.t += 1
        _, grad = self.network.gradients(context, token)
        scale = self.rate * np.sqrt(1 - 0.99 ** self.t) / (1 - 0.9 ** self.t)
        for k, g in grad.items():
            m, s = self.m[k], self.s[k]
            m *= 0.9
            m += 0.1 * g
            s *= 0.99
            s += 0.01 * g * g
            self.network.p[k] -= np.float32(scale) * m / (np.sqrt(s) + np.float32(1e-7))


def train_round(texts: DataFrame, network: WindowNetwork, number: int) -> WindowNetwork:
    """Every task descends from ``network`` on the tokens that this round masks; the results are averaged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = network.with_vector(network.vector()), 0
        adam, mix = Adam(own, RATE * (1 - number / (ROUNDS + 1))), np.random.default_rng(number)
        for batch in batches:
            for part in byte_slices(batch, "ids"):
                flat, place, _ = texts_of(part.column("ids"))
                masked = mix.permutation(place[number::MASK])
                for lo in range(0, len(masked), BATCH):
                    adam.step(*windows(flat, masked[lo:lo + BATCH]))
                seen += len(masked)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([own.vector().tobytes()], pa.binary())], names=["seen", "net"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0.0, 0
        for batch in batches:
            for n, net in zip(batch.column("seen").to_pylist(), batch.column("net")):
                total, seen = total + n * np.frombuffer(net.as_py(), np.float32).astype(np.float64), seen + n
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([(total / seen).astype(np.float32).tobytes()], pa.binary())], names=["seen", "net"])

    schema = "seen long, net binary"
    parts = texts.select("ids").mapInArrow(run, schema).repartition(MERGERS).mapInArrow(average, schema).collect()   # MERGERS networks at most
    if not parts:
        return network
    weights = [r["seen"] for r in parts]
    return network.with_vector(np.average([np.frombuffer(r["net"], np.float32) for r in parts], 0, weights))


@dataclass
class Model:
    words: Vocabulary
    network: WindowNetwork
    counts: DataFrame           # (word, n): all words of the corpus
    texts: DataFrame            # the encoded corpus


def train(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> Model:
    """Count the whole corpus and train the network on it; ``keep`` names the columns that scores need."""
    counts = stored(word_counts(docs, text_col), "word-counts")
    words = vocabulary(counts)
    texts = encode(docs, words, text_col, keep)
    network = WindowNetwork(words.stand)
    for number in range(ROUNDS):
        network = train_round(texts, network, number)
    return Model(words, network, counts, texts)


def rare_scores(texts: DataFrame, model: Model) -> DataFrame:
    """(key, rare): summed log shares of a text's words that are not at hand."""
    seen = model.counts.filter(F.col("n") <= model.words.least).select(F.xxhash64("word").alias("w"), F.col("n").alias("seen"))
    found = texts.select("key", F.inline("rare")).join(seen, "w", "left")
    share = F.log((F.coalesce("seen", F.lit(0)) + 1) / F.lit(float(model.words.size)))
    return found.groupBy("key").agg(F.sum(F.col("n") * share).alias("rare"))


def score_texts(texts: DataFrame, model: Model) -> DataFrame:
    """Rows of an encoded table with n_tokens, score and mean_logprob."""
    network = model.network

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placed = network.placed()
        for batch in batches:
            for part in byte_slices(batch, "ids"):
                flat, place, owner = texts_of(part.column("ids"))
                total = np.zeros(part.num_rows)
                for lo in range(0, len(place), CHUNK):
                    at = slice(lo, lo + CHUNK)
                    total += np.bincount(owner[at], network.logp(*windows(flat, place[at]), placed), part.num_rows)
                n = np.bincount(owner, minlength=part.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("key"), pa.array(n), pc.add(part.column("share"), pa.array(total))], names=["row", "key", "n_tokens", "net"])

    row = texts.schema["row"].dataType
    by_text = texts.select("row", "key", "ids", "share").mapInArrow(run, f"row {row.simpleString()}, key long, n_tokens long, net double")
    joined = by_text.join(stored(rare_scores(texts, model), "lm-rare-scores"), "key", "left")
    score = F.col("net") + F.coalesce("rare", F.lit(0.0))
    kept = [F.col("row").getField(c).alias(c) for c in row.names if c not in ("n_tokens", "score", "mean_logprob")]
    return joined.select(*kept, "n_tokens", score.alias("score"), F.when(F.col("n_tokens") > 0, score / F.col("n_tokens")).alias("mean_logprob"))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add n_tokens, score (summed log-probability) and mean_logprob."""
    return score_texts(encode(docs, model.words, text_col), model)
