"""The stages: their decisions take effect, clean documents stay."""

import pytest
from shapes import prose  # noqa: F401

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_in_order():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["drop_toxic", "drop_near_copies", "cut_repeats", "drop_contaminated", "tokenize"]


def test_planted_cases(spark, prose, tmp_path):
    passage, item = prose(70, 900), prose(30, 901)
    clean = {i: prose(80, i) for i in range(1, 7)}
    insult = " ".join(["zzidiot", "zzscum", "zzclown"])
    rows = {**clean,
            20: clean[1], 21: clean[2] + " one",                                # an exact and a near copy
            30: prose(60, 30) + " " + passage + " " + prose(60, 31), 31: prose(60, 32) + " " + passage + " " + prose(60, 33),
            40: prose(30, 40) + " " + item, 41: prose(900, 41) + " " + " ".join(item.split()[:13]),
            50: prose(60, 50) + " " + insult, 60: None, 61: ""}
    train = {100 + i: prose(30, 1000 + i) + (" " + insult if i % 2 else "") for i in range(60)}
    table = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1) for i, t in {**rows, **train}.items()],
                                  "doc_id long, text string, lang string, source string, n_chars long, score int")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in train], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, seen = table, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == table.columns
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    toxic, near, cut, decontaminated = seen
    assert 50 not in toxic and not any(i in toxic for i in train if i % 2) and all(i in toxic for i in rows if i != 50)
    assert 20 not in near and 21 not in near and set(toxic) - set(near) == {20, 21}
    assert all(cut[i] == near[i] for i in (*clean, 40, 41, 60, 61))
    assert cut[30] == near[30] and passage not in cut[31] and cut[31].startswith(prose(60, 32)) and cut[31].endswith(prose(60, 33))
    assert set(cut) - set(decontaminated) == {40}
    last = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: r["text"] for i, r in last.items()} == {i: t or "" for i, t in decontaminated.items()}
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in last.values())


def test_passages_are_told_by_words(spark):
    """51 words of 152 bytes go, 50 words of 499 bytes stay; so do stretches joined from shorter ones."""
    word = lambda seed, i, n: "".join(chr(97 + (seed * 7919 + i * 104729 + k * 1299709) // 13 % 26) for k in range(n))
    text = lambda seed, count, n: " ".join(word(seed, i, n) for i in range(count))
    short, wide, left, right = text(1, 51, 2), text(2, 50, 9), text(3, 30, 6), text(4, 30, 7)
    assert len(short) == 152 and len(wide) == 499
    own = lambda i: text(50 + i, 5, 8 + i)
    rows = {i: f"{own(2 * i)} {t} {own(2 * i + 1)}" for i, t in enumerate([short, short, wide, wide, left, right, left + " " + right])}
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.cut_repeats(spark, frame, "").collect()}
    want = {**rows, 1: f"{own(2)}  {own(3)}"}
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


CLASHES = ["kept", "removed", "n_removed", "n_words", "n_hit", "items", "spans", "_h", "_id", "_copies", "row", "h", "doc", "set_id", "score", "ids"]


def tables(spark, rows, folder, extra=()):
    schema = ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"`{c}` int" for c in extra)])
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *range(len(extra))) for i, t in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_empty_tables(spark, tmp_path):
    tables(spark, [], tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "text"] and got.count() == 0


def test_repeated_rows_and_clashing_names(spark, prose, tmp_path):
    rows = [(1, prose(60, 1))] * 3 + [(None, prose(50, 2))] * 2 + [(2, None), (3, ""), (4, prose(9000, 3))]
    tables(spark, rows, tmp_path, CLASHES)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
    got = docs.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(set(rows), key=str)
    assert all([r[c] for c in CLASHES] == list(range(len(CLASHES))) for r in got)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(got)
