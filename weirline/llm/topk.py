"""Exact top-k inner-product search by no-random-access aggregation.

Every dimension of a block of candidates is one list, sorted by value.  A query
reads list d from its high end if the query's component is positive and from its
low end if it is negative, all lists in step.  After each round every candidate
still in play has

* a lower bound: what was read of it, and for its unread dimensions the least
  that any entry of the list can add;
* an upper bound: what was read of it, and for its unread dimensions what the
  last entry read of the list adds (nothing further on adds more).

The k-th best lower bound is a floor: a candidate whose upper bound lies below it
cannot qualify and goes.  Once no unseen candidate can qualify and the candidates
in play are few, or the lists are read to the end, their final scores are
resolved.  Bounds and scores are exact: integers are held as doubles where no sum of a block can
reach 2^53, which is checked, and as unbounded integers elsewhere.

Queries and candidates are cut into blocks of bounded size; each pair of a query
block and a candidate block is one group, and every block returns at most k rows
a query, which a window merges.  No row is left out and nothing is approximate.

Results: vectors that are null, empty or hold a null or non-finite component take
no part.  Vectors of another length than the query's are no candidates of it.
Equal scores rank by the smaller id; scores beyond a long are given as the nearest long and rank
as that.  An empty table gives an empty result, extra columns play no part.  Rows repeated in both id and vector count
once.  A query's own id is never its candidate; a query with no candidate returns
no row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATE_BLOCK = 4096   # rows of a block: the bound of a group's memory
QUERY_BLOCK = 512
RESOLVE_SHARE = 32       # final scores are resolved once one candidate in so many is in play
LONG = (-(1 << 63), (1 << 63) - 1)
DEPTHS = (0.5, 0.75, 0.875, 1.0)   # shares of the lists read after each round


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(id, v array<bigint>) of the usable vectors: floor(scale * x), x as double; repeated rows once."""
    v = F.transform(vec_col, lambda x: x.cast("double"))
    fine = (F.size(vec_col) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("v"),
    ).dropDuplicates(["id", "v"])


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min())))


class SortedLists:
    """One block of candidates as sorted lists.

    ``reach`` is the largest component, by amount, that a query may have.  Products and sums below 2^53
    are exact in doubles; where a score could reach that, Python's integers are held instead.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, reach: int):
        # Two sums of len(x) products meet in a bound.
        self.kind = np.float64 if 2 * x.shape[1] * max(1, reach) * max(1, _largest(x)) < 1 << 53 else object
        self.ids, self.x = ids, x.astype(self.kind)
        order = np.argsort(x, axis=0, kind="stable")                  # list d, from its low end
        self.sorted = np.take_along_axis(self.x, order, axis=0)
        self.place = np.empty_like(order)
        np.put_along_axis(self.place, order, np.arange(len(ids))[:, None], axis=0)

    def _sums(self, up: np.ndarray, down: np.ndarray, high: np.ndarray, low: np.ndarray,
              if_unread_high: np.ndarray, if_unread_low: np.ndarray) -> np.ndarray:
        """What every candidate adds up to for every query: entries read count as they are,
        unread ones as the value given for their list."""
        return self._held(up @ np.where(high, self.x, if_unread_high).T + down @ np.where(low, self.x, if_unread_low).T)

    def _held(self, sums: np.ndarray) -> np.ndarray:
        """No sum lies beyond a long: bounds and scores are cut alike, so that bounds stay bounds."""
        return np.clip(sums, *LONG) if self.kind is object else sums

    def top(self, own: np.ndarray, q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (id, vector), the ids and scores of its k best candidates.

        The queries read the lists in step; a query whose candidates in play are few
        leaves the next round and has their final scores resolved."""
        n = len(self.ids)
        out: list[tuple[np.ndarray, np.ndarray]] = [(self.ids[:0], np.empty(0, np.int64))] * len(own)
        q = q.astype(self.kind)
        going = np.arange(len(own))
        alive = self.ids[None, :] != own[:, None]
        for depth in DEPTHS:
            depth = max(1, int(n * depth))
            high, low = self.place >= n - depth, self.place < depth          # read from the high, from the low end
            up, down = np.maximum(q[going], 0), np.minimum(q[going], 0)
            lower = self._sums(up, down, high, low, self.sorted[0], self.sorted[-1])
            upper = self._sums(up, down, high, low, self.sorted[n - depth], self.sorted[depth - 1])
            lower[~alive[going]] = -np.inf
            floor = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(going), -np.inf)
            alive[going] &= upper >= floor[:, None]
            few = alive[going].sum(1) <= max(k, n // RESOLVE_SHARE)
            last = depth == n
            for j in going[few | last]:
                rows = np.flatnonzero(alive[j])
                score = self._held(self.x[rows] @ q[j]).astype(np.int64)
                best = np.lexsort((self.ids[rows], ~score))[:k]    # ~score falls as score rises, the least long too
                out[j] = self.ids[rows][best], score[best]
            going = going[~few]
            if last or not len(going):
                break
        return out


def _search(k: int):
    def search(key: tuple, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, int, int]] = []
        if len(queries) and len(block):
            sizes = block["v"].map(len)
            wide = queries["v"].map(len)
            for size in sorted(set(sizes) & set(wide)):
                same = block[sizes == size]
                asked = queries[wide == size]
                own, q = asked["id"].to_numpy(np.int64), np.stack(asked["v"].to_numpy()).astype(np.int64)
                lists = SortedLists(same["id"].to_numpy(np.int64), np.stack(same["v"].to_numpy()).astype(np.int64), _largest(q))
                found = lists.top(own, q, k)
                for one, (ids, scores) in zip(own.tolist(), found):
                    rows += zip([one] * len(ids), ids.tolist(), scores.tolist())
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    return search


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """The k best candidates of every query: query_id, rank (from 1), vec_id, score.

    Both frames are (id, v) as ``quantised`` gives them.
    """
    blocks = max(1, math.ceil(candidates.count() / CANDIDATE_BLOCK))
    groups = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    place = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("id", "v", place(groups).alias("qb")).select("id", "v", "qb", every(blocks).alias("cb"))
    right = candidates.select("id", "v", place(blocks).alias("cb")).select("id", "v", "cb", every(groups).alias("qb"))
    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(
        _search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
