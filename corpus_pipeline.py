"""A training-corpus pipeline over the documents table.

Five stages, each one operator of ``weirline.llm``; every stage works on all rows its
predecessor kept, and its decisions take effect:

1. toxicity: documents scored 0.7 or more go;
2. n-gram Jaccard join: of every group of near copies (five-word shingles, similarity
   0.8) the first document stays;
3. suffix-array dedup: of every passage of over 50 words that repeats across what is left,
   the first copy stays; the others are cut out of their texts;
4. benchmark decontamination: documents with a twentieth of their words in benchmark
   windows go;
5. BPE encoding and decoding: token ids of the final texts, and the texts decoded.

Each stage's result is written as Parquet in the shared folder and read by the next.

Null and empty texts pass all stages.  Rows repeated in id and text are near copies: one
stays.  An empty table of documents gives an empty result.  Very long texts are read
whole in every stage.  Columns beside doc_id and text travel in one struct, so that extra columns
may have any name; the last stage leaves them out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirline.llm import bpe, decontam, ngramjoin, suffixdup, toxicity
from weirline.llm.common import drop_stored, read_table, stored
from weirline.llm.queries import vocabulary_path

TOXIC = 0.7
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
PASSAGE_WORDS = 51   # a passage is over 50 words


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns as one: no name of theirs meets one of an operator's."""
    return docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]).alias("row"))


def _unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them ``changed``."""
    own = lambda c: F.col(c) if c in ("doc_id", "text") else F.col("row").getField(c)
    return rows.select(*[changed.get(c, own(c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold; null and empty texts are judged by the model's base score."""
    scorer = toxicity.train(docs, read_table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return _unpacked(toxicity.score(_packed(docs), scorer).filter(F.col("score") < TOXIC), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near copies."""
    return _unpacked(ngramjoin.keep_first(_packed(docs), n=SHINGLE_WORDS, percent=SIMILAR_PERCENT), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of repeated passages.  A text that loses nothing stays as
    it is (null too)."""
    less = suffixdup.remove_repeats(_packed(docs), size=PASSAGE_WORDS, keep="first", unit=suffixdup.WORDS)
    whole = F.col("n_removed") == 0
    text = F.when(whole, F.col("text")).otherwise(F.col("kept").cast("string"))
    n_chars = F.when(whole, F.col("row").getField("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return _unpacked(less, docs, text=text, n_chars=n_chars)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    judged = decontam.contamination(_packed(docs), read_table(spark, sf_dir, "benchmark", "item_id", "text"))
    return _unpacked(judged.filter(~decontam.is_contaminated(F.col("n_hit"), F.col("n_words"))), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (binary, little-endian uint32), text (decoded)."""
    return bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), vocabulary_path(), decoded="text").select("doc_id", "lang", "source", "n_tokens", "ids", "text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", tokenize),
]

# A fitted classifier, exact set joins over all documents and BPE are beyond SQL: tests/llm holds the
# stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_stored(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
