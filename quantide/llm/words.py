"""Words of whole texts as Arrow and NumPy columns: bytes are told apart by a table of 256 entries, so nothing is done a word."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def byte_set(values: bytes) -> np.ndarray:
    """For each of the 256 bytes whether it is one of the values."""
    return np.isin(np.arange(256), list(values))


#: What words are not made of: space and U+0009 to U+000D.
BLANK = byte_set(b"\x20\x09\x0a\x0b\x0c\x0d")
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


class Words(NamedTuple):
    """The words of all texts one after another.

    values: their bytes; bounds: text k has the words bounds[k] to bounds[k + 1]; begins: for each word its first byte's
    place in data; edges: text k has the bytes edges[k] to edges[k + 1] of data.
    """

    values: pa.LargeBinaryArray
    bounds: np.ndarray
    begins: np.ndarray
    data: np.ndarray
    edges: np.ndarray

    def ids(self) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, and the distinct words by number."""
        coded = self.values.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary

    def rows(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def cut(texts: pa.Array, gap: np.ndarray = BLANK, lower: bool = False) -> Words:
    """Words are the longest runs of bytes that gap doesn't hold; a null text has none. lower: A-Z become a-z first."""
    held = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    edges = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    body = held.buffers()[2]
    data = np.frombuffer(body, np.uint8)[edges[0] : edges[-1]] if body is not None and len(held) else np.zeros(0, np.uint8)
    edges = edges - edges[0] if len(held) else np.zeros(1, np.int64)
    if lower:
        data = _LOWER[data]
    inside = ~gap[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[edges[:-1][edges[:-1] < len(data)]] = False
    begins = np.flatnonzero(inside & ~before)
    compact = np.ascontiguousarray(data[inside])
    offsets = np.append(np.cumsum(inside, dtype=np.int64)[begins] - 1, len(compact))
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(compact)])
    return Words(values, np.searchsorted(begins, edges), begins, data, edges)


def joined(words: pa.Array, index: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Texts of the words words[index], a space between; text k has the entries bounds[k] to bounds[k + 1] of index."""
    lists = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), words.take(pa.array(index)))
    return pc.binary_join(lists, pa.scalar(b" ", pa.large_binary()))
