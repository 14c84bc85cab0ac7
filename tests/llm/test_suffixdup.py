"""Repeated bytes against brute force over all windows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from weirline.llm import suffixdup
from shapes import docs, prose  # noqa: F401

SIZE = 120


def brute(rows, size, keep):
    """Removed byte flags per row: rows in the order (id, text hash) are not needed for "none"."""
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(b[i:i + size] for b in texts for i in range(len(b) - size + 1))
    out = []
    seen = set()
    for b in texts:
        flags = bytearray(len(b))
        for i in range(len(b) - size + 1):
            w = b[i:i + size]
            if count[w] > 1 and (keep == "none" or w in seen):
                flags[i:i + size] = b"\1" * size
            seen.add(w)
        out.append(bytes(x for x, f in zip(b, flags) if not f))
    return out


@pytest.fixture()
def corpus(prose):
    shared, line = prose(60, 100), prose(30, 101)
    texts = [prose(80, i) for i in range(6)]
    texts += [prose(20, 20 + i) + " " + shared + " " + prose(15, 40 + i) for i in range(8)]
    texts += [texts[0], texts[0], line + "\n" + prose(5, 9) + "\n" + line, line * 3, None, "", "short", "é" * 400, "ab" * 300, prose(3, 5)]
    return list(enumerate(texts))


@pytest.mark.parametrize("keep", ["none", "first"])
def test_equals_brute_force(docs, corpus, keep):
    got = {r["doc_id"]: r for r in suffixdup.remove_repeats(docs(corpus), size=SIZE, keep=keep).collect()}
    want = brute(corpus, SIZE, keep)
    assert len(got) == len(corpus)
    for (i, text), kept in zip(corpus, want):
        assert bytes(got[i]["kept"]) == kept
        assert got[i]["n_removed"] == len((text or "").encode()) - len(kept)
        assert got[i]["score"] == "x"


def test_crowded_anchor_is_cut_into_shorter_strips(docs, prose, monkeypatch):
    monkeypatch.setattr(suffixdup, "BLOCK_WINDOWS", 100)
    shared = prose(60, 7)
    rows = list(enumerate([prose(12, 200 + i) + " " + shared[:len(shared) - 3 * (i % 4)] + " " + prose(9, 300 + i) for i in range(25)]))
    for keep in ("none", "first"):
        got = {r["doc_id"]: bytes(r["kept"]) for r in suffixdup.remove_repeats(docs(rows), size=SIZE, keep=keep).collect()}
        assert [got[i] for i, _ in rows] == brute(rows, SIZE, keep)


def test_repeated_rows_empty_table_and_ties(docs, prose):
    text = prose(60, 1)
    rows = [(3, text), (3, text), (None, text + "x"), (5, None)]
    none = suffixdup.remove_repeats(docs(rows), size=SIZE, keep="none").collect()
    assert len(none) == 4 and all(len(r["kept"]) <= 1 for r in none)
    first = suffixdup.remove_repeats(docs(rows), size=SIZE, keep="first").collect()
    assert {(r["doc_id"], len(r["kept"])) for r in first} == {(None, len(text) + 1), (3, 0), (5, 0)}
    assert suffixdup.remove_repeats(docs([]), size=SIZE).count() == 0


def test_spans_of_repeated_rows_are_listed_once(docs, prose):
    text = prose(60, 1)
    rows = [(3, text)] * 30 + [(None, text + "x")]
    for keep in ("none", "first"):
        for r in suffixdup.repeated_spans(docs(rows), size=SIZE, keep=keep).collect():
            spans = [(s["start"], s["end"]) for s in r["spans"]]
            assert len(spans) == len(set(spans)) <= len(text)


def test_characters_stay_whole(docs):
    r = random.Random(8)
    body = "".join(chr(r.randrange(0x4E00, 0x9F00)) for _ in range(200))
    rows = [(1, "é" + body), (2, "©" + body)]   # the letters share their last byte
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in suffixdup.remove_repeats(docs(rows), size=SIZE, keep="first", whole_characters=True).collect()}
    cut = {r["doc_id"]: bytes(r["kept"]) for r in suffixdup.remove_repeats(docs(rows), size=SIZE, keep="first").collect()}
    kept, less = (1, 2) if got[1] else (2, 1)
    assert got[kept] == dict(rows)[kept]
    assert cut[less] == "é©"[less - 1].encode()[:1 if "é".encode()[1] == "©".encode()[1] else 2]
    assert got[less] == ("" if "é".encode()[1] == "©".encode()[1] else "é©"[less - 1])


def test_longest_previous_factor():
    r = random.Random(3)
    text = np.frombuffer(bytes(r.choice(b"ab") for _ in range(300)), np.uint8)
    size = 12
    starts = np.arange(len(text) - size + 1)
    order, lcp = suffixdup.suffix_order(text, starts, size)
    lpf = dict(zip(order.tolist(), suffixdup.longest_previous(order.tolist(), lcp.tolist())))
    raw = text.tobytes()
    for i in range(len(starts)):
        best = 0
        for j in range(i):
            k = 0
            while k < size and raw[i + k] == raw[j + k]:
                k += 1
            best = max(best, k)
        assert lpf[i] == best


def test_strips_cover_every_window_once():
    r = random.Random(4)
    texts = [bytes(r.choice(b"abc") for _ in range(n)) for n in (0, 10, SIZE, SIZE + 1, 900, 2000)]
    which, lo, n, at, _, _ = suffixdup.strips([suffixdup.BYTES.symbols(t) for t in texts], SIZE)
    seen = defaultdict(list)
    for w, a, k in zip(which, lo, n):
        seen[w] += range(a, a + k)
    for w, t in enumerate(texts):
        assert sorted(seen[w]) == list(range(max(0, len(t) - SIZE + 1)))
    assert (at >= 0).all()


def brute_words(rows, size, keep):
    """Kept texts: words of runs of ``size`` words that occur twice (or earlier) go."""
    import re
    spans = [[m.span() for m in re.finditer(r"[^ \t-\r]+", t or "")] for _, t in rows]
    lists = [[(t or "")[a:b] for a, b in s] for (_, t), s in zip(rows, spans)]
    count = Counter(tuple(w[i:i + size]) for w in lists for i in range(len(w) - size + 1))
    seen, out = set(), []
    for (_, t), s, w in zip(rows, spans, lists):
        gone = set()
        for i in range(len(w) - size + 1):
            k = tuple(w[i:i + size])
            if count[k] > 1 and (keep == "none" or k in seen):
                gone |= set(range(i, i + size))
            seen.add(k)
        text, at = "", 0
        for i in sorted(gone):
            if i - 1 not in gone:
                text += (t or "")[at:s[i][0]]
            at = s[i][1]
        out.append(text + (t or "")[at:])
    return out


@pytest.mark.parametrize("crowded", [False, True])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_words_equal_brute_force(docs, prose, monkeypatch, keep, crowded):
    if crowded:
        monkeypatch.setattr(suffixdup, "BLOCK_WINDOWS", 20)
    shared, line = prose(60, 100), prose(20, 101)
    texts = [prose(80, i) for i in range(6)] + [prose(20, 20 + i) + " " + shared[:len(shared) - 7 * (i % 3)] + "\n" + prose(15, 40 + i) for i in range(12)]
    texts += [texts[0], shared.replace(" ", "  \t"), line + "\n" + prose(5, 9) + "\n" + line, (line + " ") * 3, None, "", "one two", "é " * 60, "ab " * 90, " ".join(texts[3].split()[5:40])]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in suffixdup.remove_repeats(docs(rows), size=17, keep=keep, unit=suffixdup.WORDS).collect()}
    assert [got[i] for i, _ in rows] == brute_words(rows, 17, keep)


def test_long_texts_are_hashed_in_pieces(docs, prose, monkeypatch):
    whole = prose(400, 1)
    rows = [(1, whole), (2, prose(10, 2) + whole[300:900] + prose(20, 3)), (3, prose(90, 4))]
    monkeypatch.setattr(suffixdup, "SLICE", 150)
    for keep in ("none", "first"):
        got = {r["doc_id"]: bytes(r["kept"]) for r in suffixdup.remove_repeats(docs(rows), size=SIZE, keep=keep).collect()}
        assert [got[i] for i, _ in rows] == brute(rows, SIZE, keep)


def test_clashing_names_stay(spark, prose):
    frame = spark.createDataFrame([(1, prose(60, 1), 1, 2, 3, 4), (2, prose(60, 1), 5, 6, 7, 8)], "doc_id long, text string, _h int, spans int, h int, row int")
    got = suffixdup.remove_repeats(frame, size=SIZE, keep="first").collect()
    assert sorted((r["doc_id"], r["_h"], r["spans"], r["h"], r["row"]) for r in got) == [(1, 1, 2, 3, 4), (2, 5, 6, 7, 8)]


def test_rows_of_a_batch_become_python_objects_a_few_at_a_time():
    batch = pa.RecordBatch.from_pydict({"name": list(range(1000)), "text": [b"x"] * 1000})
    rows = suffixdup._rows(batch)
    assert [r["name"] for r in rows] == list(range(1000))
    asked = []

    class Watched:
        num_rows = 1000

        def slice(self, at, n):
            asked.append((at, n))
            return batch.slice(at, n)

    next(iter(suffixdup._rows(Watched())))
    assert asked == [(0, suffixdup.PYTHON_ROWS)]
