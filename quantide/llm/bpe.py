"""Byte-level BPE by ranks, in time linear in the text, and its decoding.

Bytes are mapped to the Latin-1 letters of the same number, so that pyahocorasick finds, in one pass, the tokens that
begin at each byte. The encoder starts with the longest, and goes on while each token may stand after the one before
it; else it takes the next shorter token that begins like it, and if none is left, the token before is replaced by its
next shorter. Places from which a piece's rest was found to have no encoding are marked and never entered again, so each
place is left once. A sequence of tokens is what the merges make of its bytes if and only if every two neighbours are
what the merges make of theirs; that is remembered by pair.

Many pieces are searched together, with a letter between them that no byte has. Units of text between single spaces are
split by the pattern once while they are held: a space after a character that is no white space always begins a match.

Defined results: a null text is an empty one and has no ids; the strings of special tokens are ordinary text; a piece
that is a token itself is that token, as in the library, whether or not merges lead to it; other columns stay as they are,
whatever their names; repeated rows get equal results; an empty table gives an empty result. Bytes that have no token
(of a vocabulary without all 256) are an error, and so is a vocabulary with a token that merges of older ones don't make.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

RANKS = "byte_bpe_50k.tiktoken"
#: Units, and pieces, whose ids a Python worker keeps, and pairs of tokens that it remembers; about 80 MB each.
CACHE_UNITS = 500_000
CACHE_PAIRS = 1_000_000
#: Longer ones are not kept beyond the slice of texts that has them.
CACHE_CHARS = 64
#: Bytes of new pieces that are searched together.
SEARCHED_AT_ONCE = 1 << 18
#: Ids whose bytes are put together at a time.
GATHERED_AT_ONCE = 1 << 18
#: Marks that are a piece of their own after letters, at the end of a unit.
MARKS = frozenset(".,;:!?")
#: Between pieces that are searched together; not a Latin-1 letter.
_BETWEEN = "Ā"

#: Where a space doesn't begin a match of its own.
_RUN = re.compile(r"\s ")
_loaded: dict[tuple[str, str], "Ranks"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens by their bytes, of a file with a base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Ranks:
    """A vocabulary: its tokens, how merges build them, and which may stand side by side."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.pieces_of = regex.compile(pattern).findall
        self.rank = ranks
        self.table = [np.zeros(0, np.uint8)] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = np.frombuffer(token, np.uint8)
        self.size_of = np.array([len(t) for t in self.table], np.int64)
        self.bytes_of = Gathered([t.tobytes() for t in self.table])
        self.decimals = Gathered([b"%d " % r for r in range(len(self.table))])
        #: The token that two neighbours merge to.
        self.merged: dict[tuple[int, int], int] = {}
        #: The two tokens that a token's last merge joins; single bytes have none.
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self._pairs: dict[int, bool] = {}  # by the first token shifted by 32, and the second
        self._units: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}
        self._build()

    def _build(self) -> None:
        """A token's last merge joins two older tokens that the older merges leave apart. Which is the next shorter token that
        a token begins with does not depend on the text, and neither does the one of a single byte: those are not searched for.
        """
        self.search = ahocorasick.Automaton()
        for token, rank in sorted(self.rank.items(), key=lambda x: x[1]):
            if len(token) == 1:
                continue
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut], rank), self.rank.get(token[cut:], rank)
                if a < rank and b < rank and self._apart(a, b):
                    self.left[rank], self.right[rank] = a, b
                    self.merged[a, b] = rank
                    break
            else:
                raise ValueError(f"merges of older tokens don't make the token {token!r}")
            self.search.add_word(token.decode("latin-1"), rank)
        self.search.make_automaton()
        self.shorter = [-1] * len(self.table)
        for token, rank in self.rank.items():
            self.shorter[rank] = next((self.rank[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in self.rank), -1)
        self.sizes = self.size_of.tolist()
        self.byte_token = np.array([self.rank.get(bytes([b]), -1) for b in range(256)])

    def _apart(self, a: int, b: int) -> bool:
        """Whether no merge ever crosses the border of a and b.

        Follow time backwards: at first the last token of the one side and the first of the other are a and b. The
        younger of the two was made last (of two equal ones the right one, for merges of a rank go from left to right);
        before that, its inner part was at the border. Two tokens at the border merge if the rank of their merge comes
        before either is taken by its own next merge.
        """
        left, right, merged = self.left, self.right, self.merged
        until = None  # merges of the border from this rank on come too late
        while True:
            rank = merged.get((a, b))
            if rank is not None and (until is None or rank < until):
                return False
            if a > b and a in left or b not in left:
                if a not in left:
                    return True
                until, a = a, right[a]
            else:
                until, b = b + 1, left[b]

    def compatible(self, a: int, b: int) -> bool:
        if len(self._pairs) >= CACHE_PAIRS:
            self._pairs.clear()
        known = self._pairs[a << 32 | b] = self._apart(a, b)
        return known

    def _after_space(self, unit: str) -> list[str]:
        """The pieces of a space and the unit. Letters are one piece, and a mark after them is another; the pattern tells of the rest."""
        if unit.isalpha():
            return [" " + unit]
        if unit[-1:] in MARKS and unit[:-1].isalpha():
            return [" " + unit[:-1], unit[-1]]
        return self.pieces_of(" " + unit)

    def _split(self, longest: list[int]) -> bytes:
        """The ids of a piece, as bytes. longest: the longest token that begins at each of its bytes."""
        sizes, shorter, pairs = self.sizes, self.shorter, self._pairs
        size = len(longest)
        closed = None
        out: list[int] = []
        at, last, token = 0, -1, longest[0]
        while True:  # the token at a place, and the one before it; -1 for none
            while token >= 0:
                upto = at + sizes[token]
                if closed is None or not closed[upto]:
                    if last < 0 or (fits := pairs.get(last << 32 | token)):
                        break
                    if fits is None and self.compatible(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                if upto == size:
                    return array("I", out).tobytes()
                at, last, token = upto, token, longest[upto]
                continue
            if last < 0:
                raise ValueError("a byte of the text has no token")
            closed = closed or bytearray(size + 1)
            closed[at] = 1
            at -= sizes[last]
            token = shorter[out.pop()]
            last = out[-1] if out else -1

    def _learn(self, pieces: list[str]) -> None:
        """Ids of new pieces, searched together."""
        left, shown = [], []
        for p in pieces:
            raw = p.encode()
            token = self.rank.get(raw)
            if token is not None:
                self._pieces[p] = array("I", [token]).tobytes()
            else:
                left.append(p)
                shown.append(raw.decode("latin-1"))
        text = _BETWEEN.join(shown)
        # By rising end, so of the tokens that begin at a place the longest is the last.
        found = np.fromiter(chain.from_iterable(self.search.iter(text)), np.int64).reshape(-1, 2)
        longest = self.byte_token[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
        longest[found[:, 0] - self.size_of[found[:, 1]] + 1] = found[:, 1]
        longest = longest.tolist()
        at = 0
        for p, s in zip(left, shown):
            self._pieces[p] = self._split(longest[at : at + len(s)])
            at += len(s) + 1

    def _known(self, pieces: set[str]) -> None:
        """Ids of all the pieces; new ones are searched so many at a time."""
        new, size = [], 0
        for p in pieces.difference(self._pieces):
            new.append(p)
            size += len(p)
            if size >= SEARCHED_AT_ONCE:
                self._learn(new)
                new, size = [], 0
        if new:
            self._learn(new)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text its ids (unsigned 32-bit)."""
        for held in (self._units, self._pieces):
            if len(held) > CACHE_UNITS:
                held.clear()
        heads, rests = [], []
        for t in texts:
            t = t or ""
            # Where white space runs into a space, the whole text is matched at once.
            head, *rest = [t] if _RUN.search(t) else t.split(" ")
            heads.append(self.pieces_of(head))
            rests.append(rest)
        units = set().union(*rests).difference(self._units)
        split = [(u, self._after_space(u)) for u in units]
        self._known(set(chain(chain.from_iterable(heads), chain.from_iterable(p for _, p in split))))
        ids_of, unit_of = self._pieces.__getitem__, self._units.__getitem__
        for u, pieces in split:
            self._units[u] = b"".join(map(ids_of, pieces))
        out = [np.frombuffer(b"".join([*map(ids_of, head), *map(unit_of, rest)]), np.uint32) for head, rest in zip(heads, rests)]
        for u in units:
            if len(u) > CACHE_CHARS:
                del self._units[u]
        for p in {p for pieces in (*heads, *(x for _, x in split)) for p in pieces if len(p) > CACHE_CHARS}:
            del self._pieces[p]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        return self.bytes_of(ids)


class Gathered:
    """Byte strings by number; called with numbers it gives their strings one after another."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.array([len(s) for s in strings], np.int64)
        self.first = np.cumsum(self.size) - self.size

    def __call__(self, numbers: np.ndarray) -> bytes:
        parts = []
        for lo in range(0, len(numbers), GATHERED_AT_ONCE):
            own = numbers[lo : lo + GATHERED_AT_ONCE]
            size = self.size[own]
            ends = np.cumsum(size)
            parts.append(self.flat[np.repeat(self.first[own] - ends + size, size) + np.arange(ends[-1])].tobytes())
        return b"".join(parts)


def ranks(path: str, pattern: str) -> Ranks:
    """One vocabulary for each Python worker, kept between tasks."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Ranks(read_ranks(path), pattern)
    return _loaded[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """df with the ids of its text in column `to`, an array of int."""

    def own(column: pa.Array) -> pa.Array:
        found = ranks(path, pattern).encode(column.to_pylist())
        ends = np.cumsum([0, *map(len, found)])
        flat = np.concatenate(found) if found else np.zeros(0, np.uint32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))

    return df.withColumn(to, F.arrow_udf(own, "array<int>")(text))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the bytes of its ids in column `to`; null ids have null bytes."""

    def own(column: pa.Array) -> pa.Array:
        r = ranks(path, pattern)
        return pa.array([None if x is None else r.decode(np.array(x)) for x in column.to_pylist()], pa.binary())

    return df.withColumn(to, F.arrow_udf(own, "binary")(ids))


DIGEST_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, number of ids, and the digests of the ids and of the bytes decoded from them, for each row of docs (doc_id, text).

    Texts are encoded in slices of bounded size; the ids are decoded and then dropped, so none leaves the task.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(path, pattern)
        for batch in batches:
            for part in tokens.slices(batch, 1):
                encoded = r.encode(part.column(1).to_pylist())
                coded = [hashlib.sha256(r.decimals(ids)[:-1]).hexdigest() for ids in encoded]
                back = [hashlib.sha256(r.decode(ids)).hexdigest() for ids in encoded]
                sizes = pa.array([len(ids) for ids in encoded], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(coded, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(own, DIGEST_DDL)


def op13_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    return digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
