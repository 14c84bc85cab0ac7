"""The registered queries of the subpackage: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirline.llm import bpe, decontam, langid, lmscore, mixing, ngramjoin, periodic, resample, suffixdup, topk, toxicity, urlrules, wrapper
from weirline.llm.common import read_table


def vocabulary_path() -> str:
    """Where the public byte-level vocabulary lies (a parameter of the operator)."""
    named = os.environ.get("WEIRLINE_BPE_VOCABULARY")
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove every copy of the 400-byte strings that occur more than once.  ``text`` is what is left
    (a character that was cut shows as U+FFFD)."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return suffixdup.remove_repeats(docs, size=400, keep="none").select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_removed",
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


# The rules of op2: (host, path, verdict).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page url by the rules; without a fitting rule it is allowed."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.apply_rules(read_table(spark, sf_dir, "pages", "page_id", "url"), rules, default="allow")


OP2_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                             ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit AS (
  SELECT page_id, host, path, rh || rp AS rule, rv AS verdict
  FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
best AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM fit GROUP BY page_id, host, path)
SELECT u.page_id, u.host, u.path, best.rule, coalesce(best.verdict, 'allow') AS verdict
FROM u LEFT JOIN best USING (page_id, host, path)
"""


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return wrapper.extract(read_table(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    found = decontam.contamination(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontam.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


_WORDS_SQL = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
spots AS (
  SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT r, i, spots.size AS size, item FROM spots JOIN win USING (phrase) WHERE spots.size = win.size),
words_hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT r, i, size FROM hit)) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words_hit USING (r) LEFT JOIN items USING (r)
"""


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of the ids and of the decoded text."""
    path = vocabulary_path()
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.round_trip(docs, path).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def _remainder(modulus: int) -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the documents not held out."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("held_out", F.coalesce(_remainder(5) == 0, F.lit(False)))
    network = langid.train(docs.filter(~F.col("held_out")))
    return langid.predict(docs.drop("lang"), network).select("doc_id", "held_out", "lang_pred", "score")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of every document under a network trained on all of them."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    model = lmscore.train(docs, keep=["doc_id"])
    return lmscore.score_texts(model.texts, model)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return ngramjoin.similar_documents(docs, n=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best partners of every vector whose id is divisible by 100."""
    vectors = topk.quantised(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return topk.top_k(vectors.filter(F.col("id") % 100 == 0), vectors, 10)


OP9_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled documents not held out."""
    held = F.coalesce(_remainder(3) == 1, F.lit(False))
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    labels = read_table(spark, sf_dir, "labels", "doc_id", "toxic")
    scorer = toxicity.train(docs.filter(~held), labels.filter(~held))
    return toxicity.score(docs.withColumn("held_out", held), scorer).select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that a mix of 150 % of all words takes of it, sources weighted 3, 1, 2."""
    return mixing.mix(read_table(spark, sf_dir, "documents", "doc_id", "source", "text")).drop("source")


_SIZE_SQL = r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))"
OP11_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST({_SIZE_SQL} AS BIGINT) AS size, md5(concat_ws(':', 'mix', CAST(doc_id AS VARCHAR))) AS key FROM documents),
per AS (SELECT source, CAST(sum(size) AS HUGEINT) AS words FROM d GROUP BY source),
weighed AS (SELECT source, words, 2 * words AS cap, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM per),
filled AS (
  SELECT *, sum(cap) OVER o AS caps, sum(weight) OVER o AS weights, sum(weight) OVER () AS all_weights, sum(words) OVER () AS all_words
  FROM weighed WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
marked AS (SELECT *, 100 * (weight * caps + cap * (all_weights - weights)) <= 150 * weight * all_words AS is_full FROM filled),
shared AS (
  SELECT CAST(150 * max(all_words) - 100 * coalesce(sum(cap) FILTER (WHERE is_full), 0) AS DOUBLE)
         / CAST(100 * (max(all_weights) - coalesce(sum(weight) FILTER (WHERE is_full), 0)) AS DOUBLE) AS level FROM marked),
targets AS (SELECT source, words, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE weight * level END AS target FROM marked, shared),
placed AS (
  SELECT doc_id, size, words, target, CAST(floor(target) AS HUGEINT) AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN targets ON d.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, CAST(words AS BIGINT) AS source_size, target,
       CAST(CASE WHEN words = 0 THEN 0 ELSE (budget // words) * size + least(greatest(budget % words - before, 0), size) END AS BIGINT) AS taken
FROM placed
"""


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of 20 words or more, drawn towards the words of the benchmark."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return resample.resample(docs, read_table(spark, sf_dir, "benchmark", "text")).select("doc_id", "n_features", "weight", "score", "rank")


# The CRC of every distinct word, four bits at a time, low ones first; the list holds the fixed values of that table.
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
pairs AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY r, word),
wanted AS (SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS_SQL}) AS word FROM benchmark) GROUP BY word),
vocabulary AS (SELECT DISTINCT word, hex(word) AS h FROM (SELECT word FROM pairs UNION ALL SELECT word FROM wanted)),
digits AS (SELECT word, list_transform(range(0, length(h)), lambda j: CAST(instr('0123456789ABCDEF', h[CASE WHEN j % 2 = 0 THEN j + 2 ELSE j END]) - 1 AS BIGINT)) AS x FROM vocabulary),
buckets AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, x), lambda c, v: xor(c >> 4,
         [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
          3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(c, v) & 15) + 1]::BIGINT)), 4294967295::BIGINT) % 10000 AS bucket
  FROM digits),
s AS (SELECT bucket, sum(n) AS n FROM pairs JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM wanted JOIN buckets USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * (coalesce((SELECT sum(n) FROM s), 0) + 10000.0::DOUBLE)
                                 / ((coalesce(s.n, 0) + 1.0::DOUBLE) * (coalesce((SELECT sum(n) FROM t), 0) + 10000.0::DOUBLE)))) AS gain
  FROM s FULL JOIN t USING (bucket)),
mean AS (SELECT r, floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS weight FROM pairs JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN mean USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS fit FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * fit // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (r)
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text, a tenth of which is first made periodic from a word on, as a hash of its id says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text").withColumn("_w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0)))) \
        .withColumn("_g", F.floor(h / 10)).withColumn("_n", F.size("_w")) \
        .withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n"))) \
        .withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    tiled = F.array_join(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.element_at("_w", F.when(
        i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int") + 1)), " ")
    found = periodic.periodic_runs(docs.select("doc_id", F.when(F.col("_n") > 0, tiled).otherwise(F.col("text")).alias("text")))
    top = periodic.longest()
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.floor(F.lit(1000) * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_suffix_dedup": op1_suffix_dedup, "op2_url_filter": op2_url_filter, "op3_html_extraction": op3_html_extraction, "op4_decontam": op4_decontam, "op5_bpe": op5_bpe, "op6_langid": op6_langid, "op7_lm_scoring": op7_lm_scoring, "op8_ngram_join": op8_ngram_join, "op9_topk": op9_topk,
            "op10_toxicity": op10_toxicity, "op11_mixing": op11_mixing, "op12_resampling": op12_resampling, "op13_periodic_runs": op13_periodic_runs}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL, "op4_decontam": OP4_SQL, "op9_topk": OP9_SQL, "op11_mixing": OP11_SQL, "op12_resampling": OP12_SQL}
