"""Components and set sizes against an all-pairs computation."""

import random
import re

import pytest

from weirline.llm import ngramjoin
from weirline.llm.components import connected_components
from shapes import docs, prose  # noqa: F401


def sets(rows, n):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        out[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


def components(rows, n, percent):
    s = sets(rows, n)
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(s)
    for x in ids:
        for y in ids:
            k = len(s[x] & s[y])
            if x < y and k and 100 * k >= percent * (len(s[x]) + len(s[y]) - k):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: (len(s[i]), find(i)) for i in ids}


def edited(text, count, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(count):
        w[r.randrange(len(w))] = f"zz{r.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture()
def corpus(prose):
    base, other = prose(150, 1), prose(60, 2)
    texts = [edited(base, i % 6, i) for i in range(40)] + [edited(other, i % 3, 90 + i) for i in range(12)] + [prose(40, 50 + i) for i in range(10)]
    texts += [base, base, base.upper(), None, "", "  \t\n", "one", "ONE", "one two", "one  two", "one two three", " one two three\n", " x y z w", prose(4, 3)]
    return list(enumerate(texts))


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_equals_all_pairs(docs, corpus, n, percent):
    got = ngramjoin.similar_documents(docs(corpus), n=n, percent=percent).collect()
    assert len(got) == len(corpus)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(corpus, n, percent)
    assert sum(r["first"] for r in got) == len({r["component_id"] for r in got})


def test_keep_first_with_repeated_rows(docs, prose):
    a, b = prose(30, 1), prose(30, 2)
    rows = [(1, a), (1, a), (2, a), (3, b), (None, b), (4, None), (5, "")]
    kept = ngramjoin.keep_first(docs(rows)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 1), (False, 4), (False, 5), (True, 0)]
    assert kept[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "score"}
    assert ngramjoin.keep_first(docs([])).count() == 0


@pytest.mark.parametrize("text", ["one two", "one two three"])
def test_short_text_alone_in_a_partition(docs, text):
    """Fewer words in the whole slice than in an n-gram."""
    kept = ngramjoin.keep_first(docs([text], parts=1), n=5, percent=80).collect()
    assert [(r["doc_id"], r["text"]) for r in kept] == [(0, text)]


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(60)] + [(400, 400)]
    root = {n: n for e in edges for n in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(n, n) == find(n) for n in root)
