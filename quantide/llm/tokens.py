"""Token ids of whole texts by a public byte-level BPE, fast enough for a corpus.

The tokenizers library's BPE model encodes each distinct piece once; texts are put together from cached units, and
units from cached pieces. A unit is a single space or line feed with the characters up to the next one; a piece is
what the byte-level pre-tokenizer's published pattern makes of it (only for Latin letters and ASCII; units with other
characters go to the library whole). The tokenizer splits its input before such a character
unless it lies inside a run of white space, so texts with a space or line feed between (or after) other white space
at such a place go to the library whole. The result is always the library's own.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Units that a Python worker keeps, about 50 bytes each, and pieces of a generation, of which it keeps two, about 200 bytes each.
CACHE_UNITS, CACHE_PIECES = 500_000, 100_000
#: Longer units (in bytes) and pieces aren't kept.
CACHE_CHARS = 64
#: Texts that are encoded together share the look-up of their units; together they are this large at most, or one text.
ROWS_AT_ONCE = 4096
BYTES_AT_ONCE = 6 << 20
#: Units whose ids are put together at a time.
UNITS_AT_ONCE = 1 << 18

_PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa1-\u024f]+")
_INSIDE = re.compile(r"\s[ \n](?:\s|\Z)")
_GAP = re.compile(r"[ \n]")
_loaded: dict[str, "Encoder"] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """For each byte the letter that stands for it in the byte-level vocabulary: printable ones for themselves, the
    others for the letters from U+0100 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class _Held(dict):
    """Ids by piece; make(key) fills in what is missing. Those used since the last turn are kept over the next one."""

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= CACHE_CHARS:
            self[key] = found
        return found

    def turn(self) -> None:
        """The entries become the old ones where there are too many."""
        if len(self) > CACHE_PIECES:
            self.old = dict(self)
            self.clear()


def _gathered(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of ids, one after another."""
    start = np.cumsum(size) - size
    return ids[np.repeat(first - start, size) + np.arange(int(size.sum()))]


def _joined(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(found), "<u4"), np.fromiter((len(x) >> 2 for x in found), np.int64, len(found))


class _Units:
    """Ids of units, kept as arrays: Arrow finds all units of a slice in them at once, and make(units) gives the others'.
    Where there are too many, only those of the last slice stay."""

    def __init__(self, make):
        self.make = make
        self.text, self.ids, self.size = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def ids_of(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An array of ids, and for each of some different units where its ids begin there and how many they are."""
        at = pc.index_in(units, value_set=self.text)
        unknown = np.asarray(at.is_null())
        new = units.filter(pa.array(unknown))
        ids, size = map(np.concatenate, zip((self.ids, self.size), self.make(new)))
        first = np.cumsum(size) - size
        place = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        place[unknown] = len(self.text) + np.arange(len(new))
        if len(size) > CACHE_UNITS:
            kept, self.text = place, units
        else:
            kept, self.text = np.arange(len(size)), pa.concat_arrays([self.text, new])
        short = np.asarray(pc.binary_length(self.text)) <= CACHE_CHARS
        self.text, kept = self.text if short.all() else self.text.filter(pa.array(short)), kept[short]
        self.ids, self.size = _gathered(ids, first[kept], size[kept]), size[kept]
        return ids, first[place], size[place]


class Encoder:
    """encode(texts) gives for each text its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # The strings of special tokens are ordinary text in a document.
        self.library.encode_special_tokens = True
        self.model = self.library.model
        self.letters = dict(enumerate(_byte_letters()))
        self.id_bytes = [int(k).to_bytes(4, "little") for k in range(self.library.get_vocab_size())]
        self.pieces_of = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        ).findall
        self.marks = {m: self._model_ids(m) for m in ".,"}
        self.units, self.pieces = _Units(self._new), _Held(self._piece)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        return self._model_ids(piece.encode().decode("latin-1").translate(self.letters))

    def _model_ids(self, shown: str) -> bytes:
        ids = self.id_bytes
        return b"".join([ids[t.id] for t in self.model.tokenize(shown)])

    def _unit(self, unit: str) -> bytes:
        if unit and not _PLAIN.fullmatch(unit):
            return self.whole([unit])[0]
        return b"".join(map(self.pieces.__getitem__, self.pieces_of(unit)))

    def _after_space(self, u: str) -> bytes:
        """Ids of a space and u, or of u alone where it begins with a line feed. A mark after letters is a piece."""
        if u[-1:] in self.marks and u[:-1].isalpha():
            return self._after_space(u[:-1]) + self.marks[u[-1]]
        return self._unit(u if u[:1] == "\n" else " " + u)

    def _new(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units after a space, one after another, and how many each has. Each different word of letters, with a
        mark after it or not, goes to the library once."""
        marks = [*self.marks]
        mark = [np.asarray(pc.ends_with(units, m)) for m in marks]
        bare = pc.if_else(pa.array(np.any(mark, axis=0)), pc.utf8_slice_codeunits(units, 0, -1), units)
        plain = np.asarray(pc.ascii_is_alpha(bare)).copy()
        latin = np.flatnonzero(~np.asarray(pc.string_is_ascii(bare)))
        plain[latin] = [w.isalpha() and _PLAIN.fullmatch(w) is not None for w in bare.take(pa.array(latin)).to_numpy(zero_copy_only=False).tolist()]
        words = bare.filter(pa.array(plain)).dictionary_encode()
        others = [*map(self._after_space, units.filter(pa.array(~plain)).to_numpy(zero_copy_only=False).tolist())]
        tokenize, letters, ids, size = self.model.tokenize, self.letters, array("I"), []
        for w in words.dictionary.to_numpy(zero_copy_only=False).tolist():
            found = tokenize("\u0120" + (w if w.isascii() else w.encode().decode("latin-1").translate(letters)))
            ids.extend([t.id for t in found])
            size.append(len(found))
        # What a unit is made of: a word or all of another unit, then a mark or nothing.
        of_others, of_marks = _joined(others), _joined([*self.marks.values(), b""])
        size = np.concatenate([np.array(size, np.int64), of_others[1], of_marks[1]])
        first, n_words = np.cumsum(size) - size, len(words.dictionary)
        part = np.full((len(units), 2), len(size) - 1)
        part[plain, 0] = words.indices.to_numpy()
        part[~plain, 0] = n_words + np.arange(len(others))
        for k, has in enumerate(mark):
            part[plain & has, 1] = n_words + len(others) + k
        ids = np.concatenate([np.array(ids, "<u4"), of_others[0], of_marks[0]])
        return _gathered(ids, first[part.ravel()], size[part.ravel()]), size[part].sum(1)

    def flat(self, texts: list[str], end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, `end` after each text, and the place where each text's ids end.

        Arrow splits the texts and numbers their distinct units; only those that aren't kept are made one by one.
        """
        self.pieces.turn()
        heads, rests = [], []
        for k, t in enumerate(texts):
            before = end if k else b""  # the end of the text before
            if not t or _INSIDE.search(t):
                heads.append(before + (self.whole([t])[0] if t else b""))
                rests.append("")
                continue
            gap = _GAP.search(t)
            at = gap.start() if gap else len(t)
            heads.append(before + (self._unit(t[:at]) if at else b""))
            rests.append(t[at:])
        # A line feed gets a space before it, so that one split gives all units; a unit's own first character is the
        # line feed that it begins with, or else the space that the split took. What is before the first one is empty,
        # and the text's head takes its place.
        split = pc.split_pattern(pc.replace_substring(pa.array(rests, pa.large_string()), "\n", " \n"), " ")
        units = split.values.dictionary_encode()
        bounds = split.offsets.to_numpy()
        index = units.indices.to_numpy().copy()
        index[bounds[:-1]] = len(units.dictionary) + np.arange(len(texts))
        ids, first, size = self.units.ids_of(units.dictionary)
        of_heads = _joined(heads)
        first = np.concatenate([first, len(ids) + np.cumsum(of_heads[1]) - of_heads[1]])
        ids, size = np.concatenate([ids, of_heads[0]]), np.concatenate([size, of_heads[1]])
        upto = np.concatenate([[0], np.cumsum(size[index])])
        tail = len(end) >> 2
        out = np.empty(int(upto[-1]) + (tail if texts else 0), "<u4")
        for lo in range(0, len(index), UNITS_AT_ONCE):
            own = index[lo : lo + UNITS_AT_ONCE]
            start, stop = int(upto[lo]), int(upto[lo + len(own)])
            shift = first[own] - upto[lo : lo + len(own)]
            out[start:stop] = ids[np.repeat(shift, size[own]) + np.arange(start, stop)]
        if texts and tail:
            out[-tail:] = np.frombuffer(end, "<u4")
        return out, upto[bounds[1:]] + tail

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.flat(texts)
        return [x.tobytes() for x in np.split(ids, ends[:-1])][: len(texts)]


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, kept between tasks."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def encode_documents(texts: list[str | None], path: str, end_id: int = END_ID):
    """For each text (null: empty) its ids with the end id appended, as an array."""
    ids, ends = encoder(path).flat([t or "" for t in texts], np.array([end_id], "<u4").tobytes())
    start = 0
    for stop in ends.tolist():
        yield ids[start:stop]
        start = stop


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ROWS_AT_ONCE rows and, where that is more than one row, BYTES_AT_ONCE of the column's text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        fits = int(np.searchsorted(size, (size[at - 1] if at else 0) + BYTES_AT_ONCE, side="right"))
        stop = max(at + 1, min(fits, at + ROWS_AT_ONCE))
        yield batch.slice(at, stop - at)
        at = stop
