"""BPE encoding and decoding of whole texts.

Encoding gives exactly the token ids of greedy rank-ordered merging, in time
linear in the text, without running the merges:

* the pre-tokenizer pattern cuts a text into pieces that never share a token;
* an Aho-Corasick automaton over the vocabulary finds, for each byte position
  of a piece, the longest token that starts there;
* the encoder walks the piece left to right with the longest token, and keeps
  a token only if it is *compatible* with the token before it: the pair, taken
  alone, would be merged back into exactly these two tokens.  When no shorter
  token fits either, it steps back over the last token.  Positions proved
  unreachable are marked, so each is tried once.

Decoding is one gather: ``offsets[id]`` and ``offsets[id + 1]`` bound the bytes
of a token in one array that holds the whole vocabulary.

The vocabulary file is a parameter and is read where the tasks run; nothing is
trained here.  Results: a null text is encoded as the empty text; the empty
text has no tokens; special tokens written out in a text become their ids, as
the tokenizer library does by default.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from weirline.llm.common import byte_slices, extended

# The byte-level pre-tokenizer pattern and the printable byte ranges
# of the public byte-level vocabulary format.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [(0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)]

CACHE_PIECES = 200_000   # pieces remembered in a Python worker; the memory bound, not a limit of the result
CACHE_PAIRS = 200_000    # token pairs remembered, likewise
LONGEST_CACHED = 64      # characters


def _byte_of_char() -> dict[str, int]:
    """The vocabulary file writes byte b as one printable character."""
    plain = [b for lo, hi in PRINTABLE for b in range(lo, hi + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Tables of one vocabulary and the two directions."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, to_byte = spec["model"], _byte_of_char()
        raw = {bytes(to_byte[c] for c in word): i for word, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*raw.values(), *self.special.values()])

        # Merge rank of a token, and the two tokens it is merged from (bytes have none).
        self.rank = {i: -1 for i in raw.values()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = (bytes(to_byte[c] for c in half) for half in (pair if isinstance(pair, list) else pair.split(" ")))
            whole = raw[left + right]
            if whole not in self.halves:
                self.rank[whole] = rank
                self.halves[whole] = (raw[left], raw[right])
            self.merged.setdefault((raw[left], raw[right]), whole)

        self.length = {i: len(w) for w, i in raw.items()}
        self.machine = ahocorasick.Automaton()
        for word, i in raw.items():
            self.machine.add_word(word.decode("latin-1"), (len(word), i))
        self.machine.make_automaton()
        # The next shorter token that begins a token: what the walk falls back to.
        self.shorter: dict[int, int] = {}
        for word, i in raw.items():
            for n in range(len(word) - 1, 0, -1):
                if word[:n] in raw:
                    self.shorter[i] = raw[word[:n]]
                    break

        by_id = {i: w for w, i in raw.items()} | {i: s.encode() for s, i in self.special.items()}
        words = [by_id.get(i, b"") for i in range(self.size)]
        self.blob = np.frombuffer(b"".join(words), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)

        self.pieces = regex.compile(PIECES)
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self._fits: dict[int, bool] = {}
        self._known: dict[str, bytes] = {}

    # -- encoding -----------------------------------------------------------------

    def fits(self, a: int, b: int) -> bool:
        """The pair-compatibility table, filled on demand: does merging the bytes of
        a and b end in exactly (a, b)?

        Merging works inside a and inside b until a merge across the border ranks
        before what is still to be done on either side.  Undo the last merges of the
        two sides in falling rank: at each border pair met, a merge that would have
        ranked before the one just undone breaks the pair."""
        pair = a * self.size + b
        known = self._fits.get(pair)
        if known is None:
            known = self._compatible(a, b)
            if len(self._fits) >= CACHE_PAIRS:
                self._fits.clear()
            self._fits[pair] = known
        return known

    def _compatible(self, a: int, b: int) -> bool:
        rank, halves, merged = self.rank, self.halves, self.merged
        undone = None  # (rank, side) of the last merge undone: the border pair existed before it
        while True:
            across = merged.get((a, b))
            if across is not None:
                r = rank[across]
                # Equal ranks are one rule, applied left to right: on the left side it has run already.
                if undone is None or r < undone[0] or (r == undone[0] and undone[1] == "right"):
                    return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                undone = (ra, "left")
                a = halves[a][1]
            else:
                # On equal ranks the right side's merge is the later one.
                undone = (rb, "right")
                b = halves[b][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        if not n:
            return []
        longest = [(0, -1)] * n
        for end, (size, token) in self.machine.iter(piece.decode("latin-1")):
            if size > longest[end + 1 - size][0]:
                longest[end + 1 - size] = (size, token)
        if longest[0][0] == n:  # every token is the merge of its own bytes
            return [longest[0][1]]
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0][1]
        length, shorter = self.length, self.shorter
        while at < n:
            end = at + length[token]
            if not dead[end] and (not out or self.fits(out[-1], token)):
                out.append(token)
                at = end
                if at < n:
                    token = longest[at][1]
            elif token in shorter:
                token = shorter[token]
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                # the token popped ends at a dead position: the next turn takes a shorter one
        return out

    def _piece_ids(self, piece: str) -> bytes:
        ids = np.array(self.encode_piece(piece.encode("utf-8")), "<u4").tobytes()
        if len(piece) <= LONGEST_CACHED:
            if len(self._known) >= CACHE_PIECES:
                self._known.clear()
            self._known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        parts = self.split_special.split(text) if self.split_special and any(s in text for s in self.special) else [text]
        out: list[bytes] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            pieces = self.pieces.findall(part)
            known = self._known.get
            out += [known(p) or self._piece_ids(p) for p in pieces]
        return b"".join(out)

    # -- decoding -----------------------------------------------------------------

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of ids: each token's span of the vocabulary array, end to end."""
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start
        ends = np.cumsum(size)
        if not len(ends) or not ends[-1]:
            return np.empty(0, np.uint8)
        step = np.ones(int(ends[-1]), np.int64)
        full = size > 0
        start, size = start[full], size[full]
        first = np.cumsum(size) - size
        step[first] = start
        step[first[1:]] -= start[:-1] + size[:-1] - 1
        return self.blob[np.cumsum(step)]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).tobytes().decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    """The tables of one vocabulary file, once per Python worker."""
    return Bpe(path)


def encode(docs: DataFrame, vocab_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids`` (binary: little-endian uint32 token ids) and ``n_tokens`` to ``docs``.

    All columns of ``docs`` stay; columns already named ``ids`` or ``n_tokens`` are
    replaced.  Null text: no tokens.
    """
    base = docs.drop(ids, "n_tokens")
    schema = extended(base, f"`{ids}` binary", "n_tokens long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(vocab_path)
        for batch in batches:
            for part in byte_slices(batch, text):
                coded = [bpe.encode(t) if t else b"" for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(coded, pa.binary()), pa.array([len(c) // 4 for c in coded], pa.int64())],
                    names=[*part.schema.names, ids, "n_tokens"])

    return base.mapInArrow(run, schema)


def decode(coded: DataFrame, vocab_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of ``ids`` as column ``text`` (replaced where it exists).  Null ids: empty text."""
    base = coded.drop(text)
    schema = extended(base, f"`{text}` string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(vocab_path)
        for batch in batches:
            for part in byte_slices(batch, ids):
                texts = [bpe.decode(np.frombuffer(b, "<u4").astype(np.int64)) if b else "" for b in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, text])

    return base.mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocab_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``decode(encode(docs))`` in one pass of one Python worker per task: ids, n_tokens and
    ``decoded`` are added, the text itself is dropped.  Null text: no tokens, empty text."""
    base = docs.drop(ids, "n_tokens", decoded) if decoded != text else docs.drop(ids, "n_tokens")
    kept = [c for c in base.columns if c != text]
    schema = extended(base.select(*kept), f"`{ids}` binary", "n_tokens long", f"`{decoded}` string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(vocab_path)
        for batch in batches:
            for part in byte_slices(batch, text):
                coded = [bpe.encode(t) if t else b"" for t in part.column(text).to_pylist()]
                texts = [bpe.decode(np.frombuffer(b, "<u4").astype(np.int64)) for b in coded]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], pa.array(coded, pa.binary()), pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array(texts, pa.string())],
                    names=[*kept, ids, "n_tokens", decoded])

    return base.mapInArrow(run, schema)
