"""Exact Jaccard self-join on word n-grams by vertical partitioning.

All n-grams are put in one global order (rare before common) and the order is cut
into fragments.  A document's set is cut the same way, so a pair's overlap is the
sum of its overlaps in the fragments, each counted on its own:

* the order is by a count sketch of fixed size (how often the n-gram's bucket occurs
  in the corpus), then by the n-gram itself;
* documents with equal sets are one class; only classes are compared;
* two sets above the threshold share an n-gram in the leading fragment of both: so
  many of its first n-grams that the rest cannot hold the needed overlap alone.  A
  place i of n leaves at most n - i for the overlap, which prunes further;
* every set has a bitmap in which each of its n-grams flips one bit.  Where the bitmaps of
  a candidate pair differ in more places than the sets may differ, the pair is none;
* the others get their partial overlap per fragment, and the sum per pair is compared
  with the needed overlap.  Nothing is estimated.

A group of near copies is not expanded into its pairs.  In the posting list of an
n-gram every class is first compared with the list's most central class (the one
where the n-gram comes earliest), and linked classes are joined into components.
Then only pairs whose classes lie in different components are still open; they are
compared in full.  A link inside a component changes no component, so none that
matters is lost.

Sets of fewer words than n: the whole sequence is the one n-gram.  Texts without
words, empty and null texts have an empty set and link with nothing.  Repeated rows
have equal sets and are in one component.  n-grams, sets and classes are told apart
by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirline.llm.common import byte_slices, drop_stored, extended, maybe_among, stored
from weirline.llm.components import connected_components

SKETCH_BITS = 17          # buckets of the count sketch: 2^17 numbers, whatever the corpus
SKETCH_ROWS = 64          # rows the sketch is split into when it is summed
FRAGMENTS = 8             # equal shares of the n-gram order by corpus mass
SET_BITS = 1024           # bits of a set's bitmap
SETS_MET = 1 << 20        # sets a task remembers: a memory bound, not a limit of the result

_A, _B, _C = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _C
    return h ^ (h >> np.uint64(29))


def gram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document number, n-gram): the distinct n-grams of each text, sorted by both."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    lists = pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
    words = pc.list_flatten(split)
    filled = pc.greater(pc.binary_length(words), 0)
    lists, words = lists[filled.to_numpy(zero_copy_only=False)], words.filter(filled).dictionary_encode()
    code = np.array([xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()], np.uint64)
    h = code[words.indices.to_numpy()] if len(words) else np.empty(0, np.uint64)
    per_doc = np.bincount(lists, minlength=len(texts))
    begin = np.cumsum(per_doc) - per_doc
    grams, m = h.copy(), len(h)
    for k in range(1, min(n, m)):              # grams[i] covers words i .. i + k of one text
        grams[:m - k] = _mix(grams[:m - k] * _A + h[k:] * _B + np.uint64(k))
    place = np.arange(m) - begin[lists]
    full = place + n <= per_doc[lists]
    docs, out = lists[full], grams[full]
    short = np.flatnonzero((per_doc > 0) & (per_doc < n))
    if len(short):
        whole = []
        for d in short:
            g = h[begin[d]:begin[d] + 1].copy()
            for k in range(1, per_doc[d]):
                g = _mix(g * _A + h[begin[d] + k:begin[d] + k + 1] * _B + np.uint64(k))
            whole.append(_mix(g + np.uint64(per_doc[d]))[0])
        docs, out = np.r_[docs, short], np.r_[out, np.array(whole, np.uint64)]
    order = np.lexsort((out, docs))
    docs, out = docs[order], out[order]
    new = np.r_[True, (docs[1:] != docs[:-1]) | (out[1:] != out[:-1])][:len(out)]
    return docs[new], out[new]


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def read_sets(docs: DataFrame, text_col: str, n: int) -> tuple[DataFrame, np.ndarray]:
    """One pass over the texts: a table of ``docs`` without its text, plus set_id (null for an empty
    set), n_shingles and bits (the set's bitmap); and how many (document, n-gram) pairs fall into each bucket.
    (Rows of the table whose ``part`` is not null are parts of sketches.)

    A task sums the counts of its own documents and hands on one sketch; the sketches
    are added by row.  The sum has a fixed size."""
    width = (1 << SKETCH_BITS) // SKETCH_ROWS
    base = docs.drop("set_id", "n_shingles", "bits", "part", "counts")
    kept = [c for c in base.columns if c != text_col]
    schema = extended(base.select(*kept), "set_id long", "n_shingles long", "bits array<long>", "part int", "counts array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        types = None
        for batch in batches:
            for part in byte_slices(batch, text_col):
                d, g = gram_sets(part.column(text_col), n)
                total += np.bincount(_bucket(g), minlength=len(total))
                rows = part.num_rows
                at = _bounds(d, rows)
                size = np.diff(at)
                types = [part.column(c).type for c in kept]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], pa.array(_signatures(g, at), mask=size == 0), pa.array(size.astype(np.int64)), _bitmaps(d, g, rows),
                     pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.list_(pa.int64()))], names=[*kept, "set_id", "n_shingles", "bits", "part", "counts"])
        if total.any():
            rows = SKETCH_ROWS
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(rows, t) for t in types], pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64()),
                 pa.nulls(rows, pa.list_(pa.int64())), pa.array(range(rows), pa.int32()), pa.array(list(total.reshape(rows, width)), pa.list_(pa.int64()))],
                names=[*kept, "set_id", "n_shingles", "bits", "part", "counts"])

    both = stored(base.mapInArrow(run, schema), "sets")
    summed = both.filter("part IS NOT NULL").select("part", F.posexplode("counts").alias("at", "count")) \
        .groupBy("part", "at").agg(F.sum("count").alias("count"))
    out = np.zeros((SKETCH_ROWS, width), np.int64)
    for r in summed.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("at", "count"))).alias("row")).collect():
        for x in r["row"]:
            out[r["part"], x["at"]] = x["count"]
    return both, out.ravel()


class Order:
    """The global order of n-grams and its fragments."""

    def __init__(self, sketch: np.ndarray):
        self.level = np.minimum(sketch, (1 << 40) - 1)
        by_count = np.sort(sketch)
        mass = np.cumsum(by_count)
        at = np.searchsorted(mass, mass[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS) if mass[-1] else np.zeros(FRAGMENTS - 1, int)
        self.cuts = by_count[at]

    def rank(self, grams: np.ndarray) -> np.ndarray:
        return self.level[_bucket(grams)]

    def fragment(self, grams: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, self.rank(grams), "left")


def _signatures(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name for every set; ``at`` are its bounds in ``grams``."""
    return np.array([xxhash.xxh3_64_intdigest(grams[a:z].tobytes(), seed=int(z - a)) for a, z in zip(at[:-1], at[1:])], np.uint64).view(np.int64)


def _bitmaps(docs: np.ndarray, grams: np.ndarray, rows: int) -> pa.Array:
    """For each of ``rows`` sets, the parity of its n-grams in each of SET_BITS places."""
    flips = np.bincount(docs * SET_BITS + (grams % np.uint64(SET_BITS)).astype(np.int64), minlength=rows * SET_BITS)
    words = np.packbits((flips & 1).astype(np.uint8)).view(np.int64)
    width = SET_BITS // 64
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows * width + 1, width, dtype=np.int32)), pa.array(words))


def _bounds(docs: np.ndarray, count: int) -> np.ndarray:
    return np.searchsorted(docs, np.arange(count + 1))


def leading_postings(docs: DataFrame, text_col: str, n: int, order: Order, percent: int) -> DataFrame:
    """Postings (gram, set_id, n, place) of the leading fragment of every set.

    A task gives a set it has met before only once (as far as its bounded memory goes),
    so that a group of copies sends no more than about one row per task and n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for part in byte_slices(batch, text_col):
                d, g = gram_sets(part.column(text_col), n)
                at = _bounds(d, part.num_rows)
                size = np.diff(at)
                ids = _signatures(g, at)
                fresh = np.zeros(len(ids), bool)
                for i, own in enumerate(ids.tolist()):
                    if size[i] and own not in met:
                        fresh[i] = True
                        met.add(own)
                if len(met) > SETS_MET:
                    met.clear()
                by = np.lexsort((g, order.rank(g), d))
                place = np.arange(len(g)) - at[d]
                lead = size - -(-percent * size // 100) + 1
                take = (place < lead[d]) & fresh[d]
                own = d[take]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[by][take].view(np.int64)), pa.array(ids[own]), pa.array(size[own].astype(np.int32)), pa.array(place[take].astype(np.int32))],
                    names=["gram", "set_id", "n", "place"])

    return docs.select(text_col).mapInArrow(run, "gram long, set_id long, n int, place int")


def shared_lists(postings: DataFrame) -> DataFrame:
    """The postings of n-grams that more than one set leads with, each once, with the list's
    centre: the first by (place, n, set_id).  One sorted sweep; a list is never held."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = last = None          # the first and the latest posting of the list that is open
        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in ("gram", "place", "n", "set_id")])
            if last is not None:
                rows = np.concatenate([last[None], rows])
            new = np.r_[last is None, (rows[1:] != rows[:-1]).any(1)] if len(rows) else np.empty(0, bool)
            if last is not None:
                new[0] = False         # given with the batch before, or the centre itself
            begins = np.r_[last is None, rows[1:, 0] != rows[:-1, 0]]
            first = np.maximum.accumulate(np.where(begins, np.arange(len(rows)), 0))
            centres = rows[first]
            if last is not None:
                centres[np.cumsum(begins) == 0] = centre
            member = new & ~begins     # every posting of a list but its centre
            out, mid = rows[member], centres[member]
            centre, last = centres[-1], rows[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[:, 0]), pa.array(out[:, 3]), pa.array(out[:, 2].astype(np.int32)), pa.array(out[:, 1].astype(np.int32)),
                 pa.array(mid[:, 3]), pa.array(mid[:, 2].astype(np.int32)), pa.array(mid[:, 1].astype(np.int32))],
                names=["gram", "set_id", "n", "place", "cs", "cn", "cp"])

    return postings.repartition("gram").sortWithinPartitions("gram", "place", "n", "set_id") \
        .mapInArrow(sweep, "gram long, set_id long, n int, place int, cs long, cn int, cp int")


def fragments(docs: DataFrame, text_col: str, n: int, order: Order) -> DataFrame:
    """(set_id, fragment, grams): the sets of ``docs`` (set_id, text), cut at the fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, text_col):
                d, g = gram_sets(part.column(text_col), n)
                f = order.fragment(g)
                by = np.lexsort((g, f, d))
                d, f, g = d[by], f[by], g[by]
                edge = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (f[1:] != f[:-1])][:len(d)])
                ids = part.column("set_id").to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[edge, len(g)].astype(np.int32)), pa.array(g.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[d[edge]]), pa.array(f[edge].astype(np.int32)), lists], names=["set_id", "fragment", "grams"])

    return docs.mapInArrow(run, "set_id long, fragment int, grams array<long>")


def needed(a: str, b: str, percent: int) -> F.Column:
    """The least overlap of sets of these sizes at the threshold."""
    return F.ceil(F.expr(f"({percent} * (cast({a} as long) + {b})) / {100 + percent}D - 1e-9"))


def links(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) at or above the threshold: partial overlaps by fragment, summed."""
    left = parts.select(F.col("set_id").alias("a"), "fragment", F.col("grams").alias("ga"))
    right = parts.select(F.col("set_id").alias("b"), "fragment", F.col("grams").alias("gb"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]) \
        .select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("part"))
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("overlap")) \
        .filter(F.expr(f"100 * overlap >= {percent} * (na + nb - overlap)")).select("a", "b")


def _pairs(rows: DataFrame, a: str, na: str, ia: str, b: str, nb: str, ib: str, percent: int) -> DataFrame:
    """Ordered distinct pairs whose places leave room for the needed overlap."""
    need = needed(na, nb, percent)
    room = (F.col(na) - F.col(ia) >= need) & (F.col(nb) - F.col(ib) >= need) & (F.least(na, nb) >= need)
    swap = F.col(a) > F.col(b)
    return rows.filter((F.col(a) != F.col(b)) & room).select(
        F.when(swap, F.col(b)).otherwise(F.col(a)).alias("a"), F.when(swap, F.col(a)).otherwise(F.col(b)).alias("b"),
        F.when(swap, F.col(nb)).otherwise(F.col(na)).cast("long").alias("na"), F.when(swap, F.col(na)).otherwise(F.col(nb)).cast("long").alias("nb")).distinct()


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of ``docs``: id_col, h (hash of the text), n_shingles, component_id (the
    smallest id reachable by links), first (is it the component's first row by id and hash?).
    """
    keyed = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    sets, sketch = read_sets(keyed, "text", n)
    classes = sets.filter("part IS NULL").drop("part", "counts")
    order = Order(sketch)
    reps = stored(representatives(classes), "classes")
    members = stored(shared_lists(leading_postings(keyed, "text", n, order, percent)), "postings")
    to_centre = stored(_pairs(members, "set_id", "n", "place", "cs", "cn", "cp", percent), "pairs")
    some = _linked(to_centre, reps, keyed, n, order, percent)
    roots = connected_components(some)

    # What is still open: classes of one list that lie in different components.  Components meet
    # before their members do, so that a list whose members lie in one component costs nothing.
    # (The centre has been compared with its whole list.)
    own = stored(members.select("gram", "set_id", "n", "place").join(roots, members["set_id"] == roots["node"], "left")
                 .select("gram", "set_id", "n", "place", F.coalesce("root", "set_id").alias("root")), "rooted")
    # Two members can only link if the place of each leaves room for the other's size; so the best place and
    # the least size of a component in a list say which components to meet.
    room = F.expr(f"{100 + percent}L * (n - place) - {percent}L * n")
    groups = stored(own.groupBy("gram", "root").agg(F.max(room).alias("room"), (F.min("n").cast("long") * percent).alias("least")), "groups")
    face = lambda s: groups.select("gram", *[F.col(c).alias(f"{c}_{s}") for c in ("root", "room", "least")]).alias(s)
    facing = stored(face("x").join(face("y"), (F.col("x.gram") == F.col("y.gram")) & (F.col("root_x") < F.col("root_y"))
                            & (F.col("room_x") >= F.col("least_y")) & (F.col("room_y") >= F.col("least_x"))).select("x.gram", "root_x", "root_y"), "facing")
    # Only their members are dealt out again.
    faces = facing.select("gram", F.col("root_x").alias("root")).unionByName(facing.select("gram", F.col("root_y").alias("root")))
    met = maybe_among(own, faces, "gram", "root")
    side = lambda s: met.select("gram", *[F.col(c).alias(f"{c}_{s}") for c in ("set_id", "n", "place", "root")])
    need = needed("n_x", "n_y", percent)
    meet = facing.join(side("x"), ["gram", "root_x"]).join(side("y"), ["gram", "root_y"]) \
        .filter((F.col("n_x") - F.col("place_x") >= need) & (F.col("n_y") - F.col("place_y") >= need))
    rest = stored(_pairs(meet, "set_id_x", "n_x", "place_x", "set_id_y", "n_y", "place_y", percent).join(to_centre, ["a", "b"], "left_anti"), "pairs")
    drop_stored(members, own, groups, facing, to_centre, roots)
    more = _linked(rest, reps, keyed, n, order, percent)
    roots = connected_components(some.unionByName(more))

    rooted = classes.join(roots, classes["set_id"] == roots["node"], "left").select("doc", "h", "n_shingles", F.coalesce("root", "set_id").alias("root"))
    least = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc").alias("component_id"), F.min(F.struct("doc", "h")).alias("least"))
    out = stored(rooted.join(least, "root", "left").select(
        F.col("doc").alias(id_col), "h", "n_shingles", F.when(F.col("root").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"),
        (F.col("root").isNull() | (F.col("doc").eqNullSafe(F.col("least.doc")) & (F.col("h") == F.col("least.h")))).alias("first")), "components")
    drop_stored(sets, reps, some, rest, more, roots)
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of every component: the first by id and hash of the text.

    All columns stay.  Rows with an empty set stay; of rows repeated in id and text one stays."""
    judged = similar_documents(docs, id_col, text_col, n, percent)
    chosen = judged.filter("first").groupBy(F.col(id_col).alias("_id"), F.col("h").alias("_hk")).agg(F.count("*").alias("_copies"))
    keyed = docs.withColumn("_h", F.xxhash64(text_col))
    joined = keyed.join(chosen, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hk")))
    once = joined.filter("_copies = 1").unionByName(joined.filter("_copies > 1").dropDuplicates([id_col, "_h"]))
    return once.select(*docs.columns)


def representatives(classes: DataFrame) -> DataFrame:
    """(set_id, doc, h, bits): one document of every class and the class's bitmap."""
    return classes.filter("set_id IS NOT NULL").groupBy("set_id") \
        .agg(F.min(F.struct("doc", "h")).alias("r"), F.first("bits").alias("bits")).select("set_id", "r.doc", "r.h", "bits")


def near_enough(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps differ in no more places than linked sets may differ."""
    a, b = reps.select(F.col("set_id").alias("a"), F.col("bits").alias("x")), reps.select(F.col("set_id").alias("b"), F.col("bits").alias("y"))
    differ = F.aggregate(F.zip_with("x", "y", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda n, v: n + v)
    return pairs.join(a, "a").join(b, "b").filter(differ <= F.col("na") + F.col("nb") - 2 * needed("na", "nb", percent)) \
        .select("a", "b", "na", "nb")


def _linked(pairs: DataFrame, reps: DataFrame, keyed: DataFrame, n: int, order: Order, percent: int) -> DataFrame:
    """The true links among ``pairs``: the sets are rebuilt from one document of each class."""
    pairs = stored(near_enough(pairs, reps, percent), "near")
    named = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    one = stored(reps.select("set_id", "doc", "h").join(named, "set_id", "left_semi"), "chosen")
    near = maybe_among(keyed, one, "doc", "h").alias("k")
    texts = near.join(one.alias("o"), F.col("k.doc").eqNullSafe(F.col("o.doc")) & (F.col("k.h") == F.col("o.h"))).select("o.set_id", "k.text")
    parts = stored(fragments(texts.dropDuplicates(["set_id"]), "text", n, order), "fragments")
    found = stored(links(pairs, parts, percent), "links")
    drop_stored(pairs, one, parts)
    return found
