"""Language identification by a bidirectional gated recurrent network over bytes.

A text is cut at white space into words (long ones into pieces of bounded length);
the network reads the bytes of a word from both ends, gives every byte position a
distribution over the languages, and the document's distribution is the mean over
all its positions.  Equal words get equal distributions, so a task runs the network
once per distinct word it meets and weighs the rest by lookup: every position of
every whole text counts.

The network (two gated recurrent layers of ``HIDDEN`` units and a softmax) is
written and trained in numpy: backpropagation through time, Adam, on words of a
bounded sample of labelled documents.

Words without a letter carry no language and are left out.  A null text, or one
without any letter, is ``und`` with score 0.  Repeated rows are judged each;
columns other than the text are no input of a prediction.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirline.llm.common import byte_slices, extended, smallest

HIDDEN = 12
PIECE = 24                 # characters of a word read as one sequence
TRAIN_DOCS = 400           # labelled documents per language in the training sample
TRAIN_WORDS = 96           # words drawn from each of them
STEPS, BATCH, RATE = 250, 384, 0.02
CACHED_WORDS = 200_000     # words remembered in a Python worker: a memory bound, not a limit of the result

LETTER = regex.compile(r"\p{L}")


def pieces(text: str) -> list[str]:
    """The words of a text in lower case, long ones cut."""
    out = text.lower().split()
    if len(text) > PIECE and max(map(len, out), default=0) > PIECE:
        out = [w[i:i + PIECE] for w in out for i in range(0, len(w), PIECE)]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


class Network:
    """Parameters of both directions and the output layer, with forward and backward passes.

    A batch is a padded byte matrix of words sorted by falling length: at step t the
    words that still have a byte are the first ``live[t]`` rows.
    """

    def __init__(self, languages: list[str], seed: int = 7):
        rng, h = np.random.default_rng(seed), HIDDEN
        self.languages = languages
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * h))          # input weights: a row per byte
            self.p[f"u{d}"] = rng.normal(0, 0.3, (h, 3 * h))
            self.p[f"c{d}"] = np.zeros(3 * h)
        self.p["v"] = rng.normal(0, 0.3, (2 * h, len(languages)))
        self.p["o"] = np.zeros(len(languages))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    @staticmethod
    def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte matrix of words sorted by falling length, their lengths, and the order taken."""
        size = np.array([len(w) for w in words])
        order = np.argsort(-size, kind="stable")
        size = size[order]
        grid = np.zeros((len(words), int(size[0])), np.uint8)
        flat = np.frombuffer(b"".join(words[i] for i in order), np.uint8)
        grid[np.arange(grid.shape[1]) < size[:, None]] = flat
        return grid, size, order

    def _run(self, grid: np.ndarray, size: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States after each byte, (words, bytes, HIDDEN); ``grid`` is read left to right."""
        x, u, c, h = self.p[f"x{d}"], self.p[f"u{d}"], self.p[f"c{d}"], HIDDEN
        state = np.zeros((len(grid), h), np.float32)
        states = np.zeros((*grid.shape, h), np.float32)
        for t in range(grid.shape[1]):
            n = int(np.searchsorted(-size, -t, "left"))  # words longer than t
            before = state[:n]
            a, b = x[grid[:n, t]] + c, before @ u
            gates = _sigmoid(a[:, :2 * h] + b[:, :2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(a[:, 2 * h:] + r * b[:, 2 * h:])
            after = (1 - z) * new + z * before
            if keep is not None:
                keep.append((n, before.copy(), z, r, new, b[:, 2 * h:]))
            state[:n] = after
            states[:n, t] = after
        return states

    @staticmethod
    def _turned(grid: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Index of the mirrored position within each word."""
        t = np.arange(grid.shape[1])
        return np.where(t < size[:, None], size[:, None] - 1 - t, t)

    def positions(self, grid: np.ndarray, size: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The distribution over languages at every position, (words, bytes, languages)."""
        kf, kb = ([], []) if keep is not None else (None, None)
        turn = self._turned(grid, size)
        forth = self._run(grid, size, "f", kf)
        back = self._run(np.take_along_axis(grid, turn, 1), size, "b", kb)
        both = np.concatenate([forth, np.take_along_axis(back, turn[:, :, None], 1)], 2)
        logits = both @ self.p["v"] + self.p["o"]
        e = np.exp(logits - logits.max(2, keepdims=True))
        if keep is not None:
            keep.update(f=kf, b=kb, both=both, turn=turn)
        return e / e.sum(2, keepdims=True)

    def _back(self, grid: np.ndarray, d: str, keep: list, grad: np.ndarray, out: dict[str, np.ndarray]) -> None:
        """Backpropagation through time of one direction; ``grad`` is by state."""
        h, u = HIDDEN, self.p[f"u{d}"]
        out[f"x{d}"], out[f"u{d}"] = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(u)
        later = np.zeros((len(grid), h), np.float32)
        for t in range(grid.shape[1] - 1, -1, -1):
            n, before, z, r, new, un = keep[t]
            g = grad[:n, t] + later[:n]
            dnew = g * (1 - z) * (1 - new * new)
            dz = g * (before - new) * z * (1 - z)
            dr = dnew * un * r * (1 - r)
            da = np.concatenate([dz, dr, dnew], 1)
            db = np.concatenate([dz, dr, dnew * r], 1)
            np.add.at(out[f"x{d}"], grid[:n, t], da)
            out[f"u{d}"] += before.T @ db
            later[:n] = g * z + db @ u.T
        out[f"c{d}"] = out[f"x{d}"].sum(0)

    def gradients(self, grid: np.ndarray, size: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions and its gradient."""
        keep: dict = {}
        prob = self.positions(grid, size, keep)
        mask = (np.arange(grid.shape[1]) < size[:, None])
        total = mask.sum()
        loss = -np.log(np.maximum(prob[np.arange(len(grid)), :, label], 1e-9))[mask].sum() / total
        delta = prob.copy()
        delta[np.arange(len(grid)), :, label] -= 1
        delta *= mask[:, :, None] / np.float32(total)
        out = {"v": np.einsum("wth,wtl->hl", keep["both"], delta), "o": delta.sum((0, 1))}
        dboth = delta @ self.p["v"].T
        self._back(grid, "f", keep["f"], dboth[:, :, :HIDDEN], out)
        turned = np.take_along_axis(dboth[:, :, HIDDEN:], keep["turn"][:, :, None], 1)
        self._back(np.take_along_axis(grid, keep["turn"], 1), "b", keep["b"], turned, out)
        return float(loss), out

    def fit(self, words: list[bytes], label: np.ndarray, steps: int = STEPS, seed: int = 11) -> "Network":
        """Adam over batches in which every language has the same share."""
        rng = np.random.default_rng(seed)
        rows = [np.flatnonzero(label == i) for i in range(len(self.languages))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        share = max(1, BATCH // len(rows))
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(r, share) for r in rows])
            grid, size, order = self.padded([words[i] for i in pick])
            _, grad = self.gradients(grid, size, label[pick][order])
            rate = RATE * (1 - 0.9 * step / steps)
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                self.p[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        return self

    def word_sums(self, words: list[bytes]) -> np.ndarray:
        """For each word, the sum of its positions' distributions."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        for lo in range(0, len(words), 8192):
            grid, size, order = self.padded(words[lo:lo + 8192])
            prob = self.positions(grid, size)
            prob *= (np.arange(grid.shape[1]) < size[:, None])[:, :, None]
            out[lo + order] = prob.sum(1)
        return out


class Predictor:
    """Document distributions, with the sums of the words met so far."""

    def __init__(self, network: Network):
        self.network, self.index, self.sums = network, {}, np.zeros((1, len(network.languages)))

    def _learn(self, met: set[str]) -> None:
        """Add the words not yet known; begin the table anew when it is full (a
        text slice of bounded size then refills it)."""
        new = [w for w in met if w not in self.index]
        if len(self.index) + len(new) > CACHED_WORDS:
            self.index, self.sums, new = {}, self.sums[:1], list(met)
        lettered = [w for w in new if LETTER.search(w)]
        self.index.update(dict.fromkeys(new, 0))  # row 0: no language
        if lettered:
            at = len(self.sums)
            self.sums = np.concatenate([self.sums, self.network.word_sums([w.encode("utf-8") for w in lettered])])
            self.index.update(zip(lettered, range(at, at + len(lettered))))

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        cut = [pieces(t) if t else [] for t in texts]
        self._learn(set().union(*cut))
        langs, scores = [], []
        for words in cut:
            total = self.sums[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))].sum(0)
            whole = float(total.sum())
            if whole <= 0:
                langs.append("und")
                scores.append(0.0)
            else:
                best = int(total.argmax())
                langs.append(self.network.languages[best])
                scores.append(min(1.0, float(total[best]) / whole))
        return langs, scores


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          docs_per_lang: int = TRAIN_DOCS, words_per_doc: int = TRAIN_WORDS) -> Network | None:
    """Fit a network on a bounded sample: ``docs_per_lang`` documents of each language,
    by the order of a hash of the id (one text of each id, null ids left out), and ``words_per_doc`` words of each by the order
    of a hash of the word and its place.  None if nothing is labelled."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    ids = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).filter("id IS NOT NULL").distinct()
    chosen = smallest(ids, "lang", [F.xxhash64("id"), F.col("id")], docs_per_lang)
    # A bounded broadcast: docs_per_lang ids of each language.  Of rows repeated under an id one is taken.
    picked = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")) \
        .join(F.broadcast(chosen), ["id", "lang"]).groupBy("id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, words = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                own = [w for w in pieces(text) if LETTER.search(w)]
                if len(own) > words_per_doc:
                    keys = [zlib.crc32(b"%d %s" % (i, w.encode())) for i, w in enumerate(own)]
                    own = [own[i] for i in np.argsort(keys, kind="stable")[:words_per_doc]]
                langs += [lang] * len(own)
                words += own
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string())], names=["lang", "word"])

    drawn = sorted(tuple(r) for r in picked.mapInArrow(draw, "lang string, word string").collect())
    if not drawn:
        return None
    languages = sorted({lang for lang, _ in drawn})
    label = np.array([languages.index(lang) for lang, _ in drawn])
    return Network(languages).fit([w.encode("utf-8") for _, w in drawn], label)


def predict(docs: DataFrame, network: Network | None, text_col: str = "text") -> DataFrame:
    """Add lang_pred and score to ``docs`` (columns of these names are replaced)."""
    base = docs.drop("lang_pred", "score")
    if network is None:
        return base.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(network)
        for batch in batches:
            for part in byte_slices(batch, text_col):
                langs, scores = predictor.judge(part.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                                 names=[*part.schema.names, "lang_pred", "score"])

    return base.mapInArrow(run, extended(base, "lang_pred string", "score double"))
