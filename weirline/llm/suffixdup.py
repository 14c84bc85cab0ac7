"""Exact removal of repeated passages by longest-previous-factor arrays.

A byte position is *repeated* when the ``size`` bytes that start there also start
at an earlier place of the corpus (its longest previous factor is at least
``size``) or, seen from the other side, at a later one.  Removing the earlier kind
keeps the first copy of every passage; removing both kinds keeps none.

The suffixes of a corpus do not fit one machine, so the suffix array is built in
blocks that never separate two suffixes with ``size`` bytes in common:

* every window of ``size`` bytes is named by its anchor, the k-byte string in it
  with the least hash.  Windows in a row with one anchor form a *strip*; equal
  windows have equal anchors at equal offsets;
* strips whose anchor occurs once hold nothing repeated and go;
* equal strips are one class, counted before anything is shuffled to its block;
* the classes of one anchor form a block.  A block's suffix array sorts the window
  starts of its classes by the bytes that follow; the LCP array and the previous
  and next smaller positions in suffix order give the longest previous factor of
  every start, and its mirror image the longest later one;
* an anchor with very many classes (the edge of a passage that a third of the
  documents share) is no block of its own.  Its strips are cut into shorter ones,
  64, 8 and at last 1 window long, and named anew by the bytes all windows of the
  shorter strip share, until each name has few classes.  Nothing is capped: a strip
  of one window is settled by its name.

Matches never cross documents.  Null and empty texts, and texts shorter than
``size``, lose nothing.  Rows repeated in id and text are copies of each other; when
the first copy stays, all such equal rows hold it.  "First" is the order of
(id, hash of the text, position), null ids first.

A text may also be read as words: then the symbols of strips, anchors and suffix arrays
are 64-bit hashes of words in place of bytes, sizes count words, and passages are equal
when their words are, whatever white space lies between.

A long text is hashed piece by piece, so a task holds its bytes and the arrays of one
piece.  An empty table has no span.  Tables written on the way are dropped as soon as the
spans stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirline.llm.common import byte_slices, drop_stored, extended, maybe_among, stored

SLICE = 1 << 19           # bytes hashed at a time
BLOCK_WINDOWS = 1 << 15   # window starts of one anchor that one suffix array takes
BATCH_WINDOWS = 1 << 14   # small blocks are joined into arrays of about this size
PYTHON_ROWS = 256         # rows of a batch that are Python objects at a time
STRIPS = (64, 8, 1)       # window counts of the shorter strips of a crowded anchor

_WORD = re.compile(rb"\S+")

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Unit:
    """What a text is a row of: bytes, or words (as 64-bit hashes)."""

    item: int      # bytes of a symbol
    anchor: int    # symbols of an anchor

    def symbols(self, text: bytes) -> np.ndarray:
        if self.item == 1:
            return np.frombuffer(text, np.uint8)
        return np.fromiter(map(xxhash.xxh3_64_intdigest, text.split()), np.uint64)

    def hashed(self, symbols: np.ndarray) -> np.ndarray:
        return _BYTES[symbols] if self.item == 1 else symbols | np.uint64(1)

    def sortable(self, raw: bytes) -> np.ndarray:
        """Symbols as fixed-size unsigned numbers whose bytes, first to last, sort and compare them."""
        if self.item == 1:
            return np.frombuffer(raw, np.uint8)
        return np.unique(np.frombuffer(raw, np.uint64), return_inverse=True)[1].astype(">u4")


BYTES, WORDS = Unit(1, 48), Unit(8, 8)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            out = []
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                p = np.full(n, base & _MASK, np.uint64)
                p[0] = 1
                out.append(np.cumprod(p, out=p))
            self.up, self.down = out
        return self.up, self.down


_POWERS = _Powers()


def strips(texts: list[np.ndarray], size: int, unit: Unit = BYTES) -> tuple[np.ndarray, ...]:
    """(text number, start, windows, anchor place in the strip, anchor, content) of every strip
    of texts given as symbols."""
    lens = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lens)
    n, width = int(lens.sum()), size - unit.anchor + 1
    if n < size:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    up, down = _POWERS.of(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(unit.hashed(np.concatenate(texts)) * up[:n], out=sums[1:])
    grams = (sums[unit.anchor:] - sums[:-unit.anchor]) * down[:n - unit.anchor + 1]

    # Sliding minimum of (mixed hash, place): the place in the low bits breaks ties to the left.
    low = np.uint64((1 << max(1, n.bit_length())) - 1)
    mixed = grams ^ (grams >> np.uint64(31))
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    mixed = (mixed & ~low) | np.arange(len(mixed), dtype=np.uint64)
    grid = np.concatenate([mixed, np.full(-len(mixed) % width, _MASK, np.uint64)]).reshape(-1, width)
    head = np.minimum.accumulate(grid, 1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    count = n - size + 1
    place = (np.minimum(tail[:count], head[width - 1:width - 1 + count]) & low).astype(np.int64)

    doc = np.repeat(np.arange(len(texts)), lens)[:count]
    whole = np.arange(count) + size <= ends[doc]          # the window ends inside its text
    edge = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])])
    last = np.r_[edge[1:], count] - 1
    fine = whole[edge]
    start, last = edge[fine], last[fine]
    at = place[start]
    content = (sums[last + size] - sums[start]) * down[start]
    content = (content ^ ((at - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xBF58476D1CE4E5B9) \
        + (last - start).astype(np.uint64)
    which = doc[start]
    return which, start - (ends - lens)[which], last - start + 1, at - start, grams[at], content


def suffix_order(text: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts in the order of their next ``size`` symbols (ties by position), and the
    LCP, at most ``size``, of each with the one before it (0 for the first)."""
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, size)[starts])
    order = np.argsort(rows.view(f"S{size * text.itemsize}").ravel(), kind="stable")
    rows = rows[order]
    differ = rows[1:] != rows[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), size)
    return order, np.r_[0, lcp]


def longest_previous(position: list[int], lcp: list[int]) -> list[int]:
    """The longest previous factor of each suffix, given in suffix order by its position
    in the text: the larger LCP with the previous or the next smaller position."""
    n = len(position)
    out = [0] * n
    stack: list[tuple[int, int]] = []     # (rank, LCP with the entry below)
    for r in range(n + 1):
        common = lcp[r] if r < n else 0
        here = position[r] if r < n else -1
        while stack and position[stack[-1][0]] > here:
            rank, below = stack.pop()     # the next smaller position of ``rank`` is r
            out[rank] = max(below, common)
            common = min(common, below)
        if r < n:
            stack.append((r, common))
    return out


def repeated_starts(text: np.ndarray, starts: np.ndarray, rank: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start: does it also start earlier, does it also start later?  ``rank``
    orders the starts in the corpus."""
    order, lcp = suffix_order(text, starts, size)
    near = lcp >= size
    shared = near | np.r_[near[1:], False]       # the rest has no factor of that length
    kept = order[shared]
    earlier, later = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    common = lcp[shared].tolist()
    earlier[kept] = np.array(longest_previous(rank[kept].tolist(), common), np.int64) >= size
    top = int(rank.max()) if len(rank) else 0
    later[kept] = np.array(longest_previous((top - rank[kept]).tolist(), common), np.int64) >= size
    return earlier, later


def _runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, length) of every run of true flags."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist())


ITEM = "name long, kind long, id0 long, id1 long, off int, doc long, h long, lo int, n int, at int, text binary"
MARK = "id0 long, id1 long, off int, n int, earlier boolean"


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch as Python objects, a few at a time: their texts are not held twice."""
    for at in range(0, batch.num_rows, PYTHON_ROWS):
        yield from batch.slice(at, PYTHON_ROWS).to_pylist()


def _arrays(size: int, unit: Unit):
    """Suffix arrays over whole blocks of a partition sorted by name."""

    def solve(rows: list[tuple]) -> Iterator[tuple]:
        parts, starts, rank, base = [], [], [], 0
        order = sorted(range(len(rows)), key=lambda i: (rows[i]["doc"] is not None, rows[i]["doc"] or 0, rows[i]["h"], rows[i]["lo"]))
        for place, i in enumerate(order):
            rows[i]["place"] = place
        for r in rows:
            parts.append(r["text"])
            starts.append(base + np.arange(r["n"]))
            rank.append(r["place"] * (1 << 20) + np.arange(r["n"]))
            base += len(r["text"]) // unit.item
        text = unit.sortable(b"".join(parts))
        earlier, later = repeated_starts(text, np.concatenate(starts), np.concatenate(rank), size)
        at = 0
        for r in rows:
            for flags, first in ((earlier, True), (later, False)):
                for lo, n in _runs(flags[at:at + r["n"]]):
                    yield r["id0"], r["id1"], r["off"] + lo, n, first
            at += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        load, name = 0, None

        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                list(zip(*solve(rows))) or [[]] * 5, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()))], names=["id0", "id1", "off", "n", "earlier"])

        for batch in batches:
            for row in _rows(batch):
                if load >= BATCH_WINDOWS and row["name"] != name:
                    yield out(held)
                    held, load = [], 0
                held.append(row)
                load, name = load + row["n"], row["name"]
        if held:
            yield out(held)

    return run


def _shorter(size: int, windows: int, unit: Unit):
    """Cut strips into strips of at most ``windows`` windows at fixed distances from the
    anchor, named by the symbols that all windows of a full strip there share."""
    item = unit.item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in _rows(batch):
                # A window that begins d bytes before the anchor is number at - d of the strip.
                far, near = r["at"], r["at"] - r["n"] + 1
                for cell in range(near // windows, far // windows + 1):
                    d0, d1 = max(near, cell * windows), min(far, cell * windows + windows - 1)
                    first = r["at"] - d1
                    text = r["text"][first * item:(r["at"] - d0 + size) * item]
                    shared = r["text"][(r["at"] - cell * windows) * item:(r["at"] - (cell * windows + windows - 1) + size) * item]
                    name = xxhash.xxh3_64_intdigest(b"%d %d %d " % (r["name"], windows, cell) + shared)
                    kind = xxhash.xxh3_64_intdigest(b"%d " % d1 + text)
                    out.append((name, kind, r["id0"], r["id1"], r["off"] + first, r["doc"], r["h"], r["lo"] + first, d1 - d0 + 1, d1, text))
            cols = list(zip(*out)) or [[]] * 11
            signed = lambda c: np.array(c, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(cols[0])), pa.array(signed(cols[1])), *[pa.array(c, pa.int64()) for c in cols[2:4]], pa.array(cols[4], pa.int32()),
                 *[pa.array(c, pa.int64()) for c in cols[5:7]], *[pa.array(c, pa.int32()) for c in cols[7:10]], pa.array(cols[10], pa.binary())],
                names=["name", "kind", "id0", "id1", "off", "doc", "h", "lo", "n", "at", "text"])

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("binary").alias("text"))


def _strip_rows(keyed: DataFrame, size: int, unit: Unit) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE):
                texts = [unit.symbols(t or b"") for t in part.column("text").to_pylist()]
                pieces = [(i, at) for i, t in enumerate(texts) for at in range(0, max(1, len(t) - size + 1), SLICE)]
                # A piece ends size - 1 symbols into the next one: every window lies in one of them.
                for own in (pieces,) if len(pieces) == len(texts) else ([x] for x in pieces):
                    which, lo, n, at, anchor, content = strips([texts[i][a:a + SLICE + size - 1] for i, a in own], size, unit)
                    row, first = np.array(own, np.int64)[which].T
                    rows = part.select(["doc", "h"]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), *rows.columns,
                         *[pa.array(x.astype(np.int32)) for x in (lo + first, n, at)]], names=["name", "kind", "doc", "h", "lo", "n", "at"])

    return keyed.mapInArrow(run, "name long, kind long, doc long, h long, lo int, n int, at int")


def _cut(size: int, unit: Unit):
    """The symbols of a document's wanted strips, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE):
                for i, (text, want) in enumerate(zip(part.column("text").to_pylist(), part.column("want").to_pylist())):
                    raw = unit.symbols(text).tobytes() if unit.item > 1 else text
                    for k in range(0, len(want), 1 << 10):
                        some = want[k:k + (1 << 10)]
                        ids = part.select(["doc", "h"]).take(pa.array([i] * len(some), pa.int64()))
                        column = lambda c, t: pa.array([w[c] for w in some], t)  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays(
                            [column("name", pa.int64()), column("kind", pa.int64()), *ids.columns, *[column(c, pa.int32()) for c in ("lo", "n", "at")], column("load", pa.int64()),
                             pa.array([raw[w["lo"] * unit.item:(w["lo"] + w["n"] + size - 1) * unit.item] for w in some], pa.binary())],
                            names=["name", "kind", "doc", "h", "lo", "n", "at", "load", "text"])

    return run


def _texts(keyed: DataFrame, wanted: DataFrame, size: int, unit: Unit) -> tuple[DataFrame, DataFrame]:
    """Fetch the symbols of strips: one list of strips per document, joined to the documents."""
    lists = wanted.groupBy("doc", "h").agg(F.collect_list(F.struct("name", "kind", "lo", "n", "at", "load")).alias("want"))
    lists = stored(lists, "wanted")
    k, w = maybe_among(keyed, lists, "doc", "h").alias("k"), lists.alias("w")
    both = k.join(w, F.col("k.doc").eqNullSafe(F.col("w.doc")) & (F.col("k.h") == F.col("w.h"))).select("k.doc", "k.h", "k.text", "w.want")
    cut = both.mapInArrow(_cut(size, unit), "name long, kind long, doc long, h long, lo int, n int, at int, load long, text binary") \
        .dropDuplicates(["name", "kind"])   # equal rows of documents give equal strips
    return lists, cut.select("name", "kind", F.col("name").alias("id0"), F.col("kind").alias("id1"), F.lit(0).alias("off"), "doc", "h", "lo", "n", "at", "text", "load")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 400, keep: str = "first", unit: Unit = BYTES) -> DataFrame:
    """(doc, h, spans): the spans (start, end) of symbols to remove from every text that has any.

    ``keep`` = "first" leaves the first copy of a passage, "none" removes every copy.
    """
    if size < 2 * unit.anchor:
        raise ValueError(f"size must be at least {2 * unit.anchor}")
    keyed = _keyed(docs, id_col, text_col)
    every = stored(_strip_rows(keyed, size, unit), "strips")
    # The keys are written before they are joined: only then can a join deal out a name that very many strips have.
    twice = stored(every.groupBy("name").count().filter("count > 1").select("name"), "names-twice")
    rows = stored(every.join(twice, "name"), "strips-twice")
    drop_stored(every, twice)
    first = F.min(F.struct("doc", "h", "lo")).alias("first")
    kinds = stored(rows.groupBy("name", "kind").agg(F.count("*").alias("copies"), first, F.first("n").alias("n"), F.first("at").alias("at")), "kinds")
    names = stored(kinds.groupBy("name").agg(F.count("*").alias("kinds"), F.sum("n").alias("load")), "names")
    classes = stored(kinds.join(names, "name"), "classes")
    drop_stored(kinds, names)

    wanted = classes.filter("kinds > 1").select("name", "kind", "first.doc", "first.h", "first.lo", "n", "at", "load")
    lists, cut = _texts(keyed, wanted, size, unit)
    items = stored(cut, "blocks")
    drop_stored(lists)
    scratch = [rows, classes, items]
    marks = [_solved(items.filter(F.col("load") <= BLOCK_WINDOWS), size, unit)]
    crowded = items.filter(F.col("load") > BLOCK_WINDOWS)
    for windows in STRIPS:
        cut = stored(crowded.drop("load").mapInArrow(_shorter(size, windows, unit), ITEM), "shorter")
        scratch.append(cut)
        if cut.isEmpty():
            break
        place = F.struct("doc", "h", "lo")
        kinds = stored(cut.groupBy("name", "kind").agg(F.count("*").alias("copies"), F.min(place).alias("first"), F.first("n").alias("windows")), "shorter-kinds")
        per_name = stored(kinds.groupBy("name").agg(F.count("*").alias("kinds"), F.sum("windows").alias("load")), "shorter-names")
        known = stored(cut.join(kinds, ["name", "kind"]).join(per_name, "name"), "shorter-known")
        drop_stored(kinds, per_name)
        scratch.append(known)
        is_first = (F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("h") == F.col("first.h")) & (F.col("lo") == F.col("first.lo")))
        copied = known.filter("copies > 1")
        marks.append(copied.filter(~is_first).select("id0", "id1", "off", "n", F.lit(True).alias("earlier")))
        marks.append(copied.filter(is_first).select("id0", "id1", "off", "n", F.lit(False).alias("earlier")))
        open_ = known.filter(is_first & (F.col("kinds") > 1)).drop("copies", "first", "windows", "kinds")
        marks.append(_solved(open_.filter(F.col("load") <= BLOCK_WINDOWS), size, unit))
        crowded = open_.filter(F.col("load") > BLOCK_WINDOWS)
    found = marks[0]
    for m in marks[1:]:
        found = found.unionByName(m)
    if keep == "first":
        found = found.filter("earlier")
    found = stored(found.groupBy(F.col("id0").alias("name"), F.col("id1").alias("kind")).agg(F.collect_set(F.struct("off", "n")).alias("marks")), "marks")

    joined = rows.join(classes.select("name", "kind", "copies", "first"), ["name", "kind"]).join(found, ["name", "kind"], "left")
    is_first = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("h") == F.col("first.h")) & (F.col("lo") == F.col("first.lo"))
    whole = (F.col("copies") > 1) if keep == "none" else ~is_first
    span = F.array(F.struct(F.col("lo").alias("start"), (F.col("lo") + F.col("n") + size - 1).alias("end")))
    some = F.transform(F.col("marks"), lambda m: F.struct((F.col("lo") + m["off"]).alias("start"), (F.col("lo") + m["off"] + m["n"] + size - 1).alias("end")))
    # Rows repeated in id and text have equal spans: each is kept once, so that a list grows with its text only.
    spans = stored(joined.withColumn("s", F.explode(F.when(whole, span).otherwise(some)))
                   .groupBy("doc", "h").agg(F.collect_set("s").alias("spans")), "spans")
    drop_stored(found, *scratch)
    return spans


def _solved(items: DataFrame, size: int, unit: Unit) -> DataFrame:
    dealt = items.select("name", "id0", "id1", "off", "doc", "h", "lo", "n", "text")
    return dealt.repartition("name").sortWithinPartitions("name").mapInArrow(_arrays(size, unit), MARK)


def _merged(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    """The maximal spans of a union."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _widened(text: bytes, start: int, end: int) -> tuple[int, int]:
    """The span with the rest of the characters at its ends (bytes 10xxxxxx continue one)."""
    while start and text[start] & 0xC0 == 0x80:
        start -= 1
    while end < len(text) and text[end] & 0xC0 == 0x80:
        end += 1
    return start, end


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 400, keep: str = "first",
                   whole_characters: bool = False, unit: Unit = BYTES) -> DataFrame:
    """Every row of ``docs`` with its text less the repeated passages of ``size`` symbols.

    Adds ``kept`` (binary: the remaining bytes), ``n_removed`` (bytes) and ``removed`` (the
    maximal removed byte spans); all columns of ``docs`` stay (clashing names are replaced).
    ``whole_characters`` widens the spans so that no character is cut in two; words never
    are, and the white space around removed words stays.
    """
    base = docs.drop("kept", "removed", "n_removed")
    spans = repeated_spans(base, id_col, text_col, size, keep, unit)
    d, s = base.alias("d"), spans.alias("s")
    joined = d.join(s, F.col(f"d.{id_col}").cast("long").eqNullSafe(F.col("s.doc")) & (F.xxhash64(F.col(f"d.{text_col}")) == F.col("s.h")), "left") \
        .select(F.struct("d.*").alias("row"), F.col(f"d.{text_col}").cast("binary").alias("text"), "s.spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                kept, removed, cut = [], [], []
                for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                    text = text or b""
                    found = [(x["start"], x["end"]) for x in spans or ()]
                    if found and unit.item > 1:
                        words = [m.span() for m in _WORD.finditer(text)]
                        found = [(words[a][0], words[b - 1][1]) for a, b in _merged(found)]
                    merged = _merged(_widened(text, *x) for x in found) if whole_characters else _merged(found)
                    edges = [0, *(e for m in merged for e in m), len(text)]
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                    removed.append([{"start": a, "end": b} for a, b in merged])
                    cut.append(sum(b - a for a, b in merged))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(kept, pa.binary()), pa.array(cut, pa.int64()),
                     pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["row", "kept", "n_removed", "removed"])

    out = joined.mapInArrow(run, extended(joined.select("row"), "kept binary", "n_removed long", "removed array<struct<start:int,end:int>>"))
    return out.select("row.*", "kept", "n_removed", "removed")
