import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture()
def prose():
    """Random words; a new sequence for each seed."""
    def make(n, seed, letters="abcdefgh"):
        r = random.Random(seed)
        return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(n))
    return make


@pytest.fixture()
def docs(spark):
    """A documents frame from texts or (id, text) pairs, with the table's columns and one more."""
    def make(rows, parts=3):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        data = [(i, t, "en", "s", None if t is None else len(t), "x") for i, t in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(parts)
    return make
