"""BPE against the tokenizer library: ids, round trip, odd rows."""

import random

import numpy as np
from tokenizers import Tokenizer

from weirline.llm import bpe
from shapes import docs, vocabulary  # noqa: F401

ODD = [None, "", " ", "\n\n  x  ", "<|endoftext|>", "a<|endoftext|>b <|endoftext|> ", "aaaaaaaaa" * 500, "日本語テキスト 😀😀", "it's we'll I'D", "\x00\x01 nul", "naïve café"]


def test_ids_and_text_equal_the_library(spark, docs, vocabulary):
    r = random.Random(5)
    texts = ODD + ["".join(r.choice("abcdethin reou'st\n 0123é日") for _ in range(r.randint(1, 300))) for _ in range(300)]
    texts += ["".join(r.choice("ab") for _ in range(r.randint(1, 80))) for _ in range(200)]
    library = Tokenizer.from_file(vocabulary)
    got = bpe.decode(bpe.encode(docs(texts).withColumnRenamed("score", "ids"), vocabulary), vocabulary).collect()
    assert len(got) == len(texts)
    for row in got:
        ids = library.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(row["ids"], "<u4").tolist() == ids
        assert row["n_tokens"] == len(ids)
        assert row["decoded"] == library.decode(ids, skip_special_tokens=False) == (texts[row["doc_id"]] or "")


def test_every_token_is_the_merge_of_its_bytes(vocabulary):
    """What the whole-piece shortcut rests on."""
    b, library = bpe.vocabulary(vocabulary), Tokenizer.from_file(vocabulary)
    r = random.Random(1)
    for i in r.sample(range(256, b.size - 1), 3000):
        text = bytes(b.blob[b.offsets[i]:b.offsets[i + 1]]).decode("utf-8", "replace")
        if "�" not in text and len(bpe.regex.findall(bpe.PIECES, text)) == 1:
            assert library.encode(text).ids == [i]


def test_empty_table_and_repeated_rows(spark, docs, vocabulary):
    assert bpe.encode(docs([]), vocabulary).count() == 0
    assert bpe.encode(docs([(1, "a b"), (1, "a b"), (None, "a b")]), vocabulary).select("n_tokens").collect() == [(2,)] * 3


def test_cache_bound_changes_nothing(vocabulary, monkeypatch):
    small = bpe.Bpe(vocabulary)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 2)
    text = "one two three four one two five " * 5
    assert small.encode(text) == bpe.vocabulary(vocabulary).encode(text)


def test_round_trip_is_both_in_one_pass(docs, vocabulary):
    frame = docs(ODD)
    two = bpe.decode(bpe.encode(frame, vocabulary), vocabulary).select("doc_id", "ids", "n_tokens", "decoded").orderBy("doc_id").collect()
    assert bpe.round_trip(frame, vocabulary).select("doc_id", "ids", "n_tokens", "decoded").orderBy("doc_id").collect() == two
    assert "text" in bpe.round_trip(frame, vocabulary, decoded="text").columns
