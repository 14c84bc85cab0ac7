"""Mixing sources to target weights, exactly to the word.

All of it is DataFrame and SQL functions.

* Every document gets a hash-random key.  Documents are range-sorted by it within their
  source, so the order is random and the same in every run.
* Distributed prefix sums of the words give each document the words of its source that
  come before it.
* A source's budget is its target in whole words.  It is as many whole epochs as fit, and
  of the next one the documents before the cut; the document at the cut gives its first
  words, so each source's words are its target rounded down.

Targets share ``percent`` of all words by weight; no target exceeds ``epochs`` times its
source, and what lies above is shared again by weight until none does.  The level at which
that ends is found by sorting sources by size over weight, with the same prefix sums: any
number of sources will do.

Null and empty texts have size 0 and take 0 words.  A null source is a source, the last
one.  Documents with one key (equal ids, null ids) are ordered by size; rows repeated in id
and size are interchangeable.  A source without words has the target 0, an empty table
gives an empty result.  Very long texts are counted as they are.  Extra columns are left
out unless named in ``carry``; carried columns whose names clash with the result's are
replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirline.llm.common import stored
from weirline.llm.prefix import prefix_sums

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
PERCENT, EPOCHS, SEED = 150, 2, "mix"


def size_of(text: Column) -> Column:
    """The number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = PERCENT, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from rows with source and size.  The weights repeat over
    the sources in code point order, null last."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = prefix_sums(per.withColumn("rank", F.lit(1).cast("long")), [], [F.col("source").asc_nulls_last()], ["rank"])
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rank_before") % len(weights) + 1).cast("int"))
    caps = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * epochs).alias("cap")) \
        .withColumn("fills_at", F.col("cap") / F.col("weight"))
    filled = stored(prefix_sums(caps, [], [F.col("fills_at"), F.col("source").asc_nulls_last()], ["cap", "weight"]), "filled")
    whole = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()

    # With the level at which this source is full, what all sources take is within the budget: it stays full.
    exact = lambda c: c.cast("decimal(20,0)")
    below = F.col("weight") * exact(F.col("cap_before") + F.col("cap"))
    above = F.col("cap") * exact(F.lit(whole["weight"]) - F.col("weight_before") - F.col("weight"))
    full = (below + above) * 100 <= F.lit(percent) * F.col("weight") * exact(F.lit(whole["words"]))
    marked = filled.withColumn("full", full)
    taken = marked.filter("full").agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("cap"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    rest = whole["weight"] - taken["weight"]
    level = float(percent * whole["words"] - 100 * taken["cap"]) / float(100 * rest) if rest else 0.0
    return marked.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS,
        percent: int = PERCENT, epochs: int = EPOCHS, seed: str = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target and taken (words that
    the mix takes of it, repeats counted), with the columns named in ``carry``."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")).cast("binary"))
    sized = stored(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), key.alias("key"),
        F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")]).alias("carried")), "sized")
    targets = source_targets(sized, weights, percent, epochs)
    rows = prefix_sums(sized, ["source"], [F.col("key"), F.col("size"), F.col("row")], ["size"], beside=targets)
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    cut = F.least(F.greatest(budget - F.col("epochs") * F.col("source_size") - F.col("size_before"), F.lit(0)), F.col("size"))
    out = ["doc_id", "source", "size", "source_size", "target", "taken"]
    return rows.withColumn("epochs", whole.cast("long")).withColumn("taken", (F.col("epochs") * F.col("size") + cut).cast("long")) \
        .select(*out, *[F.col(f"carried.{c}").alias(c) for c in carry if c not in out])


def emit(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself, from rows of ``mix`` that carry their text: a row for every time a document
    is taken (column ``epoch`` from 1).  The document at the cut has its first words, joined by one space."""
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    rows = mixed.filter("taken > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), times)))
    words = F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size"))
    first = F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0)), 1, words.cast("int")), " ")
    return rows.withColumn(text_col, F.when(words == F.col("size"), F.col(text_col)).otherwise(first))
