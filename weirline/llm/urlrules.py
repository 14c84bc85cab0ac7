"""URL filter rules as a sort-merge range join.

A host is turned round into a canonical key (``a.example.org`` becomes
``org.example.a.``), so that a host and all its subdomains are one interval of
keys: those that begin with the rule's key.  Intervals are nested or disjoint.

Urls and rules are dealt to key ranges, each range is sorted, and one sweep over
it keeps a stack of the rules whose interval is open.  A url is compared only
with that stack (at most one entry per host label); within an entry the path
prefixes of the host's rules are looked up by length.

The ranges are cut by splitters from a bounded sample of the urls' (key, salt);
the salt is a hash of the url id, so that a host with a third of all urls spreads
over many ranges.  A rule is sent to every range its interval touches.

Results: of the rules that fit, the longest text (host and path) wins, the deeper
host on a tie, and of equal rules the blocking one.  Without a fitting rule the
verdict is ``default``.  Null urls and urls without ``://`` have an empty host and
path and fit no rule.  An empty rule table gives the default everywhere; a rule
with an empty or null host fits nothing.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirline.llm.common import extended

SPLITTER_SAMPLE = 8192   # keys sampled for the splitters: the bound of what reaches the driver
URLS_PER_RANGE = 1 << 20
FEWEST_RANGES = 64


def lower_ascii(col: F.Column) -> F.Column:
    """A-Z only; other letters keep their case."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: F.Column) -> F.Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def url_path(url: F.Column) -> F.Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: F.Column) -> F.Column:
    """Labels in reverse order, each closed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class _Sweep:
    """The stack of open rules over a sorted run of keys."""

    def __init__(self, default: str):
        self.default = default
        self.open: list[tuple[str, int, dict[str, tuple[str, str]], list[int]]] = []

    def _close(self, key: str) -> None:
        while self.open and not key.startswith(self.open[-1][0]):
            self.open.pop()

    def rule(self, key: str, host: str, path: str, verdict: str) -> None:
        self._close(key)
        if not self.open or self.open[-1][0] != key:
            self.open.append((key, len(host), {}, []))
        _, _, paths, lengths = self.open[-1]
        if path not in paths:
            if len(path) not in lengths:
                bisect.insort(lengths, len(path))
            paths[path] = (host + path, verdict)
        elif verdict == "block":
            paths[path] = (host + path, verdict)

    def url(self, key: str, path: str) -> tuple[str | None, str]:
        self._close(key)
        best: tuple[int, str | None, str] = (-1, None, self.default)
        for _, host_len, paths, lengths in self.open:  # deeper hosts come later and win ties
            for n in reversed(lengths):
                if n <= len(path) and (hit := paths.get(path[:n])):
                    if host_len + n >= best[0]:
                        best = (host_len + n, *hit)
                    break
        return best[1], best[2]


def apply_rules(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                default: str = "allow") -> DataFrame:
    """Judge every row of ``urls`` (``id_col``, ``url_col``) by ``rules`` (host, path, verdict).

    Returns id_col, host, path, rule (null if none), verdict; one row per row of
    ``urls``, repeated and null ids included.  Other columns of ``urls`` play no part.
    """
    keyed = urls.select(
        F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"),
    ).withColumn("key", F.when(F.col("host") == "", "").otherwise(host_key(F.col("host")))) \
     .withColumn("salt", F.xxhash64("id", "path"))

    total = urls.count()
    ranges = max(FEWEST_RANGES, total // URLS_PER_RANGE)
    order = F.xxhash64("salt", "key")
    sample = sorted((r.key, r.salt) for r in keyed.select("key", "salt").orderBy(order).limit(min(SPLITTER_SAMPLE, 16 * ranges)).collect())
    step = max(1, len(sample) // ranges)
    cuts = sorted(set(sample[step::step]))  # a range's number is how many cuts lie at or below its rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [bisect.bisect_right(cuts, ks) for ks in zip(b.column("key").to_pylist(), b.column("salt").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], names=[*b.schema.names, "range"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A rule goes to every range between the first and the last key of its interval."""
        for b in batches:
            keys = b.column("key").to_pylist()
            lo = [bisect.bisect_left(cuts, (k, -(1 << 63))) for k in keys]
            hi = [bisect.bisect_right(cuts, (k + "\U0010ffff", 1 << 63)) for k in keys]
            rows = [i for i, (a, z) in enumerate(zip(lo, hi)) for _ in range(a, z + 1)]
            at = [r for a, z in zip(lo, hi) for r in range(a, z + 1)]
            taken = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(at, pa.int32())], names=[*b.schema.names, "range"])

    ruled = rules.select(
        lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("verdict"),
    ).filter(F.coalesce("host", F.lit("")) != "").withColumn("key", host_key(F.col("host")))
    placed_rules = ruled.mapInArrow(spread, extended(ruled, "range int"))
    placed_urls = keyed.mapInArrow(place, extended(keyed, "range int"))
    id_type = urls.schema[id_col].dataType
    events = placed_urls.select("range", "key", F.lit(1).alias("kind"), "id", "host", "path", F.lit(None).cast("string").alias("verdict")) \
        .unionByName(placed_rules.select("range", "key", F.lit(0).alias("kind"), F.lit(None).cast(id_type).alias("id"), "host", "path", "verdict"))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, _Sweep(default)
        for b in batches:
            rows, rule, verdict = [], [], []
            for i, (r, key, kind, host, path, v) in enumerate(zip(*(b.column(c).to_pylist() for c in ("range", "key", "kind", "host", "path", "verdict")))):
                if r != at:
                    at, state = r, _Sweep(default)
                if kind:
                    hit = state.url(key, path)
                    rows.append(i)
                    rule.append(hit[0])
                    verdict.append(hit[1])
                else:
                    state.rule(key, host, path, v)
            kept = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [kept.column("id"), kept.column("host"), kept.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=["id", "host", "path", "rule", "verdict"])

    out = events.repartition(len(cuts) + 1, "range").sortWithinPartitions("range", "key", "kind")
    schema = out.select(F.col("id"), F.col("host"), F.col("path"), F.lit("").alias("rule"), F.lit("").alias("verdict")).schema
    for f in schema.fields:
        f.nullable = True
    return out.mapInArrow(sweep, schema).withColumnRenamed("id", id_col)
