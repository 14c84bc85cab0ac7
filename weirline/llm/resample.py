"""Importance resampling of documents towards a target distribution.

* A text is lower-cased (A-Z), its separators are collapsed to single spaces, and an
  overlapped regular expression scan with look-arounds at the spaces gives the spans of
  all runs of so many words directly; the CRC of a span's bytes is its bucket.
* Bucket counts of all documents and of all target texts give each bucket a gain: the log
  ratio of its smoothed shares, in thousandths.
* A document's weight is the mean gain of its features; a Gumbel value of a hash of its id
  is added, and the highest scores are drawn: sampling without replacement in proportion
  to the importance weights, the same in every run.

Buckets of a document are stored as two or four bytes each, so that a text is scanned
once.  Only one count per bucket comes to the driver: as many numbers as there are
buckets, whatever the corpus.  Ranks are distributed prefix sums over range-sorted scores.

Null and empty texts and texts without a word have no feature and weight 0.  A null id is
hashed as an empty one and ranks after others of its score; rows repeated in id and score
take adjacent ranks.  Empty tables of documents give an empty result, of targets a
constant target count.  Very long texts are scanned whole, one at a time.  Extra columns
play no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirline.llm.common import byte_slices, stored
from weirline.llm.prefix import prefix_sums

BUCKETS, SIZES, SEED = 10_000, (1, 1), "2024"
CACHE = 1 << 17    # features whose bucket a task remembers; only saves time
_SPACES = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


class _Buckets(dict):
    """Bucket of a feature by its bytes, remembered."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        b = self[feature] = zlib.crc32(feature) % self.buckets
        return b


def scans(sizes: tuple[int, int]) -> list[regex.Pattern]:
    """A pattern for each run length; scanned with overlaps it matches at every word."""
    return [regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (n - 1)) for n in range(sizes[0], sizes[1] + 1)]


def collapsed(text: bytes) -> bytes:
    """Lower-cased words joined by single spaces."""
    return b" ".join(text.lower().translate(_SPACES).split())


def features(docs: DataFrame, id_col: str, text_col: str, sizes: tuple[int, int] = SIZES, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, row, n_words, buckets): the bucket of every feature, in order of size and place."""
    width = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, patterns = _Buckets(buckets), scans(sizes)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                n_words, found = [], []
                for text in part.column("text").to_pylist():
                    line = collapsed(text or b"")
                    n_words.append(line.count(b" ") + 1 if line else 0)
                    found.append(np.array([known[m.group()] for p in patterns for m in p.finditer(line, overlapped=True)], width).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(n_words, pa.int64()), pa.array(found, pa.binary())],
                                                 names=["doc_id", "row", "n_words", "buckets"])

    keyed = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("binary").alias("text"))
    return keyed.mapInArrow(run, f"doc_id {keyed.schema['doc_id'].dataType.simpleString()}, row long, n_words long, buckets binary")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs: summed per task, then over tasks."""
    width = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for b in batch.column("buckets"):
                total += np.bincount(np.frombuffer(b.as_buffer(), width), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, row, n_words, n_features, weight): the mean gain of a document's features, rounded down."""
    width = np.uint16 if len(gain) <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, weight = [], []
            for b in batch.column("buckets"):
                own = gain[np.frombuffer(b.as_buffer(), width)]
                count.append(len(own))
                weight.append(int(own.sum()) // len(own) if len(own) else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "n_words")), pa.array(count, pa.int64()), pa.array(weight, pa.int64())],
                                             names=["doc_id", "row", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, row long, n_words long, n_features long, weight long")


def gumbel(id_: Column, seed: str = SEED) -> Column:
    """Thousandths of a Gumbel value of a hash of the id, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
             sizes: tuple[int, int] = SIZES, buckets: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``; rank counts the drawn
    from 1, in the order of score, and is null for the others."""
    found = stored(features(docs, id_col, text_col, sizes, buckets), "buckets")
    wanted = features(target.select(target_text).withColumn("_id", F.lit(0)), "_id", target_text, sizes, buckets)
    gain = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets))
    scored = stored(weights(found, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scores")
    fit = scored.filter(F.col("n_words") >= least_words).withColumn("place", F.lit(1).cast("long"))
    drawn = percent * fit.count() // 100
    placed = prefix_sums(fit, [], [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")], ["place"])
    rank = F.when(F.col("place_before") < drawn, F.col("place_before") + 1)
    out = ["doc_id", "n_words", "n_features", "weight", "score"]
    return placed.select(*out, rank.cast("long").alias("rank")).unionByName(
        scored.filter(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank")))
