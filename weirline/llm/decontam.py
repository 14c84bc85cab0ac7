"""Benchmark decontamination with a positional inverted index.

All of it is DataFrame and SQL functions.

* The benchmark texts are cut into windows of consecutive words (13 by default; a
  shorter item is one window).
* The training words that occur in a window are counted, which gives each
  window's terms from the rarest to the most common.
* The index stores the postings (term, document, position) of the terms that some
  window ranks among its rarest: the only lists that are ever read.
* A phrase is found by intersecting offset-adjusted lists: a posting of the term at
  offset o of a window, at position p of a document, says that the window may start
  at p - o.  Starts that appear in the lists of the rarest terms are candidates; the
  remaining words are compared in the document itself.
* Proximity asks the same lists for two terms at a bounded distance.

The joins are plain equi-joins on the term or the document: Catalyst broadcasts a
small benchmark and shuffles a large one.

A word is a maximal run of digits, letters a-z (A-Z are lower-cased) and characters
beyond ASCII.  Null and empty texts have no words; items without words have no
window; repeated rows count once per distinct (id, text) and each row is returned;
an empty benchmark hits nothing.  Extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirline.llm.common import stored
from weirline.llm.urlrules import lower_ascii

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW_WORDS = 13
LISTS = 3   # rarest terms of a window whose lists are intersected


def words(text: F.Column) -> F.Column:
    """The words of a text, in order."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, h, text): the id and a hash of the text tell rows with one id apart."""
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW_WORDS) -> DataFrame:
    """(terms, items): every distinct window with the items it is from."""
    w = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(size - 1), F.lit(1)))
    return w.select("item", "w", F.explode(starts).alias("at")) \
        .select("item", F.expr(f"slice(w, at, {size})").alias("terms")) \
        .groupBy("terms").agg(F.array_sort(F.collect_set("item")).alias("items"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences in ``docs`` (column text) of the words in ``terms`` (0 where none)."""
    seen = docs.select(F.explode(words(F.col("text"))).alias("term")).join(terms, "term", "left_semi").groupBy("term").count()
    return terms.join(seen, "term", "left").select("term", F.coalesce("count", F.lit(0)).alias("n"))


def positional_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, doc, h, pos) of ``terms`` in keyed documents; positions from 0."""
    return docs.select("doc", "h", F.posexplode(words(F.col("text"))).alias("pos", "term")) \
        .join(terms, "term", "left_semi").select("term", "doc", "h", "pos")


def rarest_offsets(wins: DataFrame, counts: DataFrame, lists: int = LISTS) -> DataFrame:
    """(win, len, offset, term, rank): the ``lists`` rarest places of every window."""
    places = wins.select("win", F.size("terms").alias("len"), F.posexplode("terms").alias("offset", "term"))
    order = Window.partitionBy("win").orderBy("n", "term", "offset")
    return places.join(counts, "term").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= lists).drop("n")


def phrase_starts(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """(win, doc, h, start): where the lists of a window's rarest terms agree on a start."""
    need = F.least(F.col("len"), F.lit(LISTS))
    return postings.join(anchors, "term") \
        .withColumn("start", F.col("pos") - F.col("offset")).filter("start >= 0") \
        .groupBy("win", "doc", "h", "start", "len").agg(F.count_distinct("rank").alias("lists")) \
        .filter(F.col("lists") == need).select("win", "doc", "h", "start")


def proximity(postings: DataFrame, pairs: DataFrame, distance: int) -> DataFrame:
    """(a, b, doc, h, pos, other): places of ``a`` with a ``b`` at most ``distance`` words away.

    ``pairs`` has columns a and b.  Positions are joined by bins of ``distance``
    words and their neighbours, so that only near positions meet.
    """
    d = max(1, distance)
    left = postings.join(pairs, postings["term"] == pairs["a"]).select("a", "b", "doc", "h", "pos") \
        .withColumn("bin", F.explode(F.array(*[F.floor(F.col("pos") / d) + i for i in (-1, 0, 1)])))
    right = postings.select(F.col("term").alias("b"), "doc", "h", F.col("pos").alias("other"), F.floor(F.col("pos") / d).alias("bin"))
    return left.join(right, ["b", "doc", "h", "bin"]).filter((F.col("pos") != F.col("other")) & (F.abs(F.col("pos") - F.col("other")) <= distance)) \
        .select("a", "b", "doc", "h", "pos", "other")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", size: int = WINDOW_WORDS) -> DataFrame:
    """Every row of ``docs`` with n_words, n_hit, items (sorted ids as strings) and spans
    (columns of these names are replaced).

    ``spans`` are the (start, end) word intervals of the exact occurrences, merged;
    ``n_hit`` is the number of words inside them.
    """
    wins = stored(windows(benchmark, item_col, item_text, size).withColumn("win", F.xxhash64("terms")), "windows")
    vocabulary = stored(wins.select(F.explode("terms").alias("term")).distinct(), "vocabulary")
    keyed = _keyed(docs, id_col, text_col)
    counts = stored(term_counts(keyed, vocabulary), "counts")
    anchors = stored(rarest_offsets(wins, counts), "anchors")
    postings = stored(positional_index(keyed, anchors.select("term").distinct()), "postings")

    found = phrase_starts(postings, anchors).join(wins, "win") \
        .groupBy("doc", "h").agg(F.collect_list(F.struct("start", "terms", "items")).alias("found"))
    base = docs.drop("n_words", "n_hit", "items", "spans", "_h")
    d, f = base.withColumn("_h", F.xxhash64(text_col)).alias("d"), found.alias("f")
    joined = d.join(f, F.col(f"d.{id_col}").eqNullSafe(F.col("f.doc")) & (F.col("d._h") == F.col("f.h")), "left") \
        .select("d.*", words(F.col(f"d.{text_col}")).alias("_w"), F.col("f.found").alias("_found")).drop("_h")
    exact = F.filter("_found", lambda c: F.slice("_w", c["start"] + 1, F.size(c["terms"])) == c["terms"])
    hit = joined.withColumn("n_words", F.size("_w").cast("long")).withColumn("_hit", F.when(F.col("_found").isNotNull(), exact)).drop("_w", "_found")
    intervals = F.array_sort(F.transform(F.col("_hit"), lambda c: F.struct(c["start"].alias("start"), (c["start"] + F.size(c["terms"])).alias("end"))))
    empty = "CAST(array() AS array<struct<start:int,end:int>>)"
    merged = F.expr(f"""aggregate(_intervals, {empty}, (acc, x) ->
        CASE WHEN size(acc) > 0 AND x.start <= acc[size(acc) - 1].end
             THEN concat(slice(acc, 1, size(acc) - 1),
                         array(struct(acc[size(acc) - 1].start AS start, greatest(acc[size(acc) - 1].end, x.end) AS end)))
             ELSE concat(acc, array(x)) END)""")
    return hit.withColumn("_intervals", intervals).select(
        *base.columns, "n_words",
        F.coalesce(merged, F.expr(empty)).alias("spans"),
        F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform("_hit", lambda c: c["items"])))), F.expr("CAST(array() AS array<string>)")).alias("items"),
    ).withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, x) -> n + (x.end - x.start))"))


def is_contaminated(n_hit: F.Column, n_words: F.Column, share: int = 20) -> F.Column:
    """At least one word in ``share`` is hit."""
    return (n_hit > 0) & (F.lit(share) * n_hit >= n_words)
