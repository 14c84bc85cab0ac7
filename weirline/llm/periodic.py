"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch of words with smallest period q, at least 2q and ``min_length`` words
long, that no neighbouring word extends with that period.

* For every power of two F the factors of F words are named: a name stands for a pair of
  names of half the length.  A factor that occurs once in its document leaves, so that the
  work of a level is in proportion to what still repeats.
* Successor occurrences of a name at most F/2 apart form arithmetic progressions (the
  factor has their difference as its period).  A run whose period lies from F to 2F shows
  as the distance from the end of one progression to that of a later one, or, where a
  whole period has a smaller period itself, from an occurrence to the beginning of a later
  progression.  Both lie within 2F of each other, and at most three progressions do: the
  proposals of a level are linear in its words.
* Proposals with one period whose factors meet belong to one stretch; one of them is
  extended to both sides by the names, from the longest factors to the shortest.
* A stretch that is proposed with several periods has the smallest; the others are its
  multiples.

Collapsing keeps the first period of every run: a word goes if any run holds it after
that run's first q words.

Null and empty texts have no words, no run and an empty collapsed text.  Rows are judged
one by one: repeated rows give equal results, an empty table an empty one.  Many short
texts are handled in one set of arrays, a long one alone, whole: about ten numbers of 8
bytes a word and level.  Extra columns stay; ``n_words``, ``runs`` and ``collapsed`` replace columns
of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirline.llm.common import byte_slices, extended

MIN_LENGTH = 12
SLICE = 1 << 19    # bytes of text whose words share arrays
NEAR = 3           # progressions of one factor that can begin or end within two lengths of it
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the keys that occur twice or more, by key and place, and the ranks of their keys."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    equal = k[1:] == k[:-1]
    twice = np.r_[False, equal][:len(k)] | np.r_[equal, False][:len(k)]
    return order[twice], np.cumsum(np.r_[True, ~equal][:len(k)])[twice]


def proposals(name: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) proposed by the occurrences ``at`` (by name and place) of factors of ``size`` words."""
    linked = (name[1:] == name[:-1]) & (2 * (at[1:] - at[:-1]) <= size)
    first, last = np.r_[True, ~linked], np.r_[~linked, True]
    out = []

    def meet(a: np.ndarray, b: np.ndarray) -> None:
        q = at[b] - at[a]
        fits = (name[a] == name[b]) & (q >= size) & (q < 2 * size)
        out.append((at[a[fits]], q[fits]))

    ends, heads, every = np.flatnonzero(last), np.flatnonzero(first), np.arange(len(at))
    after = np.searchsorted(heads, every, "right")
    for m in range(1, NEAR + 1):
        meet(ends[:-m], ends[m:])
        there = every[after + m - 1 < len(heads)]
        meet(there, heads[after[there] + m - 1])
    return tuple(np.concatenate(c) for c in zip(*out))


def find_runs(words: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """(start, length, period) of every run in an array of word keys, by start and period."""
    n = len(words)
    levels: list[np.ndarray] = []
    at, rank = _repeated(words)
    size, found = 1, []
    while len(at):
        names = np.arange(n, 2 * n, dtype=np.int64)    # a factor that occurs once equals no other
        names[at] = rank
        levels.append(names)
        t, q = proposals(rank, at, size)
        by = np.lexsort((t, q))
        t, q = t[by], q[by]
        new = np.r_[True, (q[1:] != q[:-1]) | (t[1:] - t[:-1] > size)][:len(t)]
        found.append((t[new], q[new]))
        more = np.sort(at[at + size < n])
        more = more[names[more + size] < n]
        places, rank = _repeated(names[more] * (2 * n) + names[more + size])
        at, size = more[places], 2 * size
    if not found:
        return np.empty((0, 3), np.int64)
    t, q = (np.concatenate(c) for c in zip(*found))
    right, left = t.copy(), t.copy()
    for k in range(len(levels) - 1, -1, -1):
        names, step = levels[k], 1 << k
        ahead = np.minimum(right + q, n - 1)
        right += step * ((right + q < n) & (names[np.minimum(right, n - 1)] == names[ahead]))
        back = np.maximum(left - step, 0)
        left -= step * ((left >= step) & (names[back] == names[back + q]))
    length = right + q - left
    good = length >= np.maximum(min_length, 2 * q)
    rows = np.stack([left[good], length[good], q[good]], 1)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    smallest = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)][:len(rows)]
    rows = rows[smallest]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def periodic_runs(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """Every row of ``docs`` with n_words, runs (array of start, length, period, by start and period)
    and collapsed (the kept words joined by one space)."""
    base = docs.drop("n_words", "runs", "collapsed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, text_col, SLICE):
                texts = [(t or b"").split() for t in part.column(text_col).cast(pa.binary()).to_pylist()]
                counts = np.array([len(t) for t in texts], np.int64)
                ends = np.cumsum(counts)
                ids: dict[bytes, int] = {}
                keys = np.fromiter((ids.setdefault(w, len(ids)) for t in texts for w in t), np.int64, int(counts.sum()))
                keys += np.repeat(np.arange(len(texts)), counts) * (len(ids) + 1)    # words of different texts differ
                rows = find_runs(keys, min_length)
                gone = np.zeros(len(keys) + 1, np.int64)
                np.add.at(gone, rows[:, 0] + rows[:, 2], 1)
                np.add.at(gone, rows[:, 0] + rows[:, 1], -1)
                stay = np.cumsum(gone[:-1]) == 0
                of = np.searchsorted(ends, rows[:, 0], "right")
                lists: list[list[dict]] = [[] for _ in texts]
                for d, (start, length, period) in zip(of.tolist(), rows.tolist()):
                    lists[d].append({"start": start - int(ends[d] - counts[d]), "length": length, "period": period})
                kept = []
                for d, t in enumerate(texts):
                    mine = stay[ends[d] - counts[d]:ends[d]]
                    kept.append(b" ".join(t) if not lists[d] else b" ".join(w for w, s in zip(t, mine.tolist()) if s))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(counts), pa.array(lists, RUNS), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=[*part.schema.names, "n_words", "runs", "collapsed"])

    return base.mapInArrow(run, extended(base, "n_words long", "runs array<struct<start:long,length:long,period:long>>", "collapsed string"))


def longest(runs: str = "runs"):
    """The longest run of a list (ties: smallest start, then period); null without one."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))
