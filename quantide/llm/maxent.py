"""Hashed maximum-entropy language model with a class-factored softmax and a memory of word pairs.

P(word | history) = P(class | history) P(word | class), mixed with what followed the previous word in the training texts.
The class distribution is a log-linear model of the history: the hashed previous word, the hashed previous bigram, and a
skip bag of the classes two to nine words back. Its weights come from gradient steps in rounds: in each, chains of steps
run over disjoint shares of a third of the training texts, from the round's weights, and their changes are averaged by
tokens. Documents are dealt to chains by their hash, and the number of chains follows from the corpus, so scores don't
depend on partitions or cores. Within a class the maximum-entropy model with word features alone is the smoothed
relative frequency, (c + 0.5) / (sum of c + 0.5 (words + 1)), which keeps one place for an unseen word. Classes: the
end, each of the most frequent words for itself, and clusters of word endings, so that any word, seen or not, has a
class by its form. The clusters come from counts of endings near each other.

The memory is a hashed table of all pairs of neighbours, one key of about 32 bits and the shard's for each different pair,
which grows with the corpus: shards hold it, and each unit (about two million tokens) asks the shards for the pairs and
the rare words that it needs, once each. A pair's share in the mixture is, by the frequency of its first word, how many
of the training pairs occur again, at most MOST_MEMORY.

What is broadcast is bounded by parameters: weights, ending clusters, and the HEAD most frequent words with counts.

A word of over 64 bytes has its class by its form, never one of its own. Where more than EQUAL_ROWS equal rows reach one
task, those beyond go on to other chains, so that no chain gets them all; how many each gets then depends on how rows are
dealt over tasks, and so, a little, do all scores.

Defined results: a null or empty text has the end token alone; a null id is not held out; repeated rows are learned from
and come out as often as they come; without training texts every class is equally likely; other columns are not read.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

HEAD, HEAD_BYTES = 1 << 17, 64
OWN = 31
CLUSTERS = 32
CLASSES = 1 + OWN + CLUSTERS
ENDINGS = 512
WORD_ROWS, PAIR_ROWS = 1 << 12, 1 << 13
#: The skip bag: classes of the words from two to nine words back.
SKIPS = 8
#: Places before each document, so that no feature reaches into the document before.
PAD = SKIPS + 1
ROUNDS = 3
BATCH = 4096
RATE = 0.3
#: Rows of a table that more tokens of a batch share are summed one by one.
FREQUENT = 8
#: Scores of classes are cut here, far beyond any trained one.
LIMIT = 60.0
ROWS_AT_ONCE = 128
#: Tokens of a unit, and of a shard of the memory.
UNIT_TOKENS, SHARD_TOKENS = 1 << 21, 1 << 21
#: The largest share that the memory of word pairs has in a probability.
MOST_MEMORY = 0.5
#: Tokens that one chain of gradient steps sees in a round; the number of chains follows from the corpus alone.
CHAIN_TOKENS = 1 << 22
#: Equal rows of a task that go to one chain together.
EQUAL_ROWS = 1024
#: Blocks in which weights are summed, and chains that are summed at a time.
BLOCKS, FAN_IN = 16, 64
#: The end token; no word is empty.
END = b""


_MARKS = b".,;:!?\"')"
_IS_MARK = np.isin(np.arange(256), list(_MARKS))
#: The table of CRC-32, as zlib.crc32 computes it.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ 0xEDB88320, _CRC >> 1).astype(np.uint32)


def words(text: str | None) -> list[bytes]:
    """A-Z in lower case, split at ASCII white space, and the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def ending(word: bytes) -> int:
    return zlib.crc32(word.rstrip(_MARKS)[-3:]) & (ENDINGS - 1)


def endings(found: pa.Array) -> np.ndarray:
    """ending() of all words of a binary array, side by side."""
    at = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1].astype(np.int64)
    data = np.frombuffer(found.buffers()[2] or b"", np.uint8)
    lo, hi = at[:-1], at[1:].copy()
    left = np.flatnonzero(hi > lo)
    while len(left := left[_IS_MARK[data[hi[left] - 1]]]):
        hi[left] -= 1
        left = left[hi[left] > lo[left]]
    crc = np.full(len(found), 0xFFFFFFFF, np.uint32)
    for back in (3, 2, 1):
        some = np.flatnonzero(hi - lo >= back)
        c = crc[some]
        crc[some] = _CRC[(c ^ data[hi[some] - back]) & 0xFF] ^ c >> 8
    return (~crc & (ENDINGS - 1)).astype(np.uint16)


def hashed(found: Iterable[bytes]) -> np.ndarray:
    """64-bit hashes of words; what must be exact tells words apart by them only within the HEAD words and against them."""
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, found), np.uint64)


class Classes:
    """Codes of words: class (6 bits), hash (32 bits) and rank from 1 among the head, or 0. head: words in order."""

    def __init__(self, own: list[bytes], cluster_of: np.ndarray, head: list[bytes]):
        of = hashed(head)
        order = np.argsort(of)
        self.head, self.rank = np.append(of[order], ~np.uint64(0)), np.append(order + 1, 0)
        of = hashed([END, *own])
        order = np.argsort(of)
        self.own, self.own_class = of[order], order
        self.cluster_of = np.asarray(cluster_of, np.int64)

    def codes(self, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.head[:-1], hashes)
        rank = np.where(self.head[at] == hashes, self.rank[at], 0)
        at = np.minimum(np.searchsorted(self.own, hashes), len(self.own) - 1)
        of = np.where(self.own[at] == hashes, self.own_class[at], 1 + OWN + self.cluster_of[ends])
        return of | (hashes & np.uint64(0xFFFFFFFF)).astype(np.int64) << 6 | rank << 38

    def coded(self, found: list[bytes] | pa.Array) -> np.ndarray:
        found = found if isinstance(found, pa.Array) else pa.array(found, pa.binary())
        return self.codes(hashed(found.to_numpy(zero_copy_only=False).tolist()), endings(found))


#: The classes that a worker used last.
_made: dict[str, Classes] = {}


class History:
    """Features of each token of some documents: rows of the two hashed tables and the classes before it.

    Documents stand one after the other with PAD places before each; such a place has the class CLASSES and hash 0.
    """

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        self.at = np.arange(len(codes)) + PAD * np.repeat(np.arange(1, len(sizes) + 1), sizes)
        n = len(codes) + PAD * len(sizes)
        self.target = np.full(n, CLASSES, np.uint8)
        self.target[self.at] = codes & 63
        hashes = np.zeros(n + 2, np.int64)
        hashes[self.at + 2] = codes >> 6 & 0xFFFFFFFF
        one, two = hashes[1:-1], hashes[:-2]
        self.word = (one * 0x9E3779B1 >> 13 & (WORD_ROWS - 1)).astype(np.uint16)
        self.pair = ((one * 0x85EBCA6B ^ two * 0xC2B2AE35) >> 11 & (PAIR_ROWS - 1)).astype(np.uint16)

    def parts(self) -> Iterator[tuple[int, int]]:
        for lo in range(PAD, len(self.target), BATCH):
            yield lo, min(lo + BATCH, len(self.target))


def _sum_of_eight(rows: np.ndarray) -> np.ndarray:
    """The sums of each eight rows in a row."""
    two = rows[:-1] + rows[1:]
    four = two[:-2] + two[2:]
    return four[:-4] + four[4:]


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, sum of its values) for each different row: the few frequent ones one by one, the others side by side."""
    order = np.argsort(rows, kind="stable")
    values, rows = np.take(values, order, axis=0), rows[order]
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    many = np.diff(np.append(first, len(rows)))
    out = np.take(values, first, axis=0)
    for k in range(1, FREQUENT):
        has = np.flatnonzero((many > k) & (many <= FREQUENT))
        if not len(has):
            break
        out[has] += np.take(values, first[has] + k, axis=0)
    for j in np.flatnonzero(many > FREQUENT).tolist():
        values[first[j] : first[j] + many[j]].sum(0, out=out[j])
    return rows[first], out


class Weights:
    #: Of the skip table the last row, of places before a document, stays zero.
    SHAPES = {"bias": (1, CLASSES), "word": (WORD_ROWS, CLASSES), "pair": (PAIR_ROWS, CLASSES), "skip": (CLASSES + 1, CLASSES)}

    def __init__(self, flat: np.ndarray | None = None):
        size = sum(r * c for r, c in self.SHAPES.values())
        flat = np.zeros(size, np.float32) if flat is None else flat.astype(np.float32)
        at = 0
        for name, (r, c) in self.SHAPES.items():
            setattr(self, name, flat[at : at + r * c].reshape(r, c))
            at += r * c
        self.flat = flat

    def scores(self, h: History, lo: int, hi: int) -> np.ndarray:
        """Unnormalised logs of the classes at the places lo to hi."""
        z = np.take(self.word, h.word[lo:hi], axis=0)
        z += np.take(self.pair, h.pair[lo:hi], axis=0)
        z += _sum_of_eight(np.take(self.skip, h.target[lo - PAD : hi - 2], axis=0))
        z += self.bias
        return np.clip(z, -LIMIT, LIMIT, out=z)

    def classes(self, h: History, lo: int, hi: int) -> np.ndarray:
        z = self.scores(h, lo, hi)
        np.exp(z, out=z)
        z *= (1.0 / (z @ _ONES))[:, None]
        return z

    def log_target(self, h: History) -> np.ndarray:
        """The log probability of each token's class."""
        out = np.empty(len(h.target))
        for lo, hi in h.parts():
            z = self.scores(h, lo, hi)
            own = z[np.arange(hi - lo), np.minimum(h.target[lo:hi], CLASSES - 1)].astype(np.float64)
            out[lo:hi] = own - np.log((np.exp(z, out=z) @ _ONES).astype(np.float64))
        return out[h.at]


_ONES = np.ones(CLASSES, np.float32)


def _step(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, change: np.ndarray, scale: float, rate: float = RATE) -> None:
    """An adaptive step on some rows of a table, each once."""
    change *= np.float32(scale)
    squares[rows] += np.einsum("ij,ij->i", change, change) / np.float32(CLASSES)
    change *= (-rate / np.sqrt(squares[rows] + 1e-6)).astype(np.float32)[:, None]
    table[rows] += change


def train(start: np.ndarray, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, int]:
    """The change of the weights over (codes, sizes) of some documents, step by step, and their tokens."""
    w = Weights(start.copy())
    squares = {name: np.full(r, 1e-3, np.float32) for name, (r, _) in Weights.SHAPES.items()}
    tokens = 0
    for codes, sizes in found:
        h = History(codes, sizes)
        tokens += len(codes)
        for lo, hi in h.parts():
            target = h.target[lo:hi]
            real = np.flatnonzero(target < CLASSES)
            error = np.zeros((hi - lo + 2 * (SKIPS - 1), CLASSES), np.float32)
            own = error[SKIPS - 1 : hi - lo + SKIPS - 1]
            own[:] = w.classes(h, lo, hi)
            own[target == CLASSES] = 0
            own[real, target[real]] -= 1
            scale = 1.0 / math.sqrt(max(len(real), 1))
            _step(w.word, squares["word"], *_by_row(h.word[lo:hi], own), scale)
            _step(w.pair, squares["pair"], *_by_row(h.pair[lo:hi], own), scale)
            # A class in the bag has an eighth as its value.
            rows, change = _by_row(h.target[lo - PAD : hi - 2], _sum_of_eight(error))
            before = rows < CLASSES
            _step(w.skip, squares["skip"], rows[before], change[before], scale / SKIPS, RATE / SKIPS)
            _step(w.bias, squares["bias"], np.zeros(1, np.int64), own.sum(0, keepdims=True), scale)
    return w.flat - start, tokens


# --- jobs ---------------------------------------------------------------------------------------------------------


def _packed(x: np.ndarray) -> bytes:
    """Compressed by planes of bytes, as most of them are nearly constant."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, "zstd"), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


# Units: the documents of a stretch of a task's input as numbers of words, with a dictionary of their own.

_UNIT = "unit bigint, doc_id array<bigint>, held_out array<boolean>, mark binary, sizes binary, ids binary, hashes binary, ends binary, words array<binary>"
_NAMES = [c.split()[0] for c in _UNIT.split(", ")]


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """words() of some texts without their ends, one text after the other, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))  # null: no words
    found, at = lists.flatten().cast(pa.binary()), np.asarray(lists.offsets)
    # A text without words has an empty one.
    full = np.asarray(pc.binary_length(found)) > 0
    n = np.diff(np.append(0, np.cumsum(full))[at])
    return (found if full.all() else found.filter(pa.array(full))), n


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
        yield batch.slice(at, ROWS_AT_ONCE)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unit, found, held, docs, tokens = TaskContext.get().partitionId() << 32, [], [], [], 0

    def flush():
        # The end has number 0, the words follow in the order in which they come.
        coded = pa.chunked_array(found, pa.binary()).dictionary_encode().chunks  # of one dictionary; none without words
        distinct = pa.concat_arrays([pa.array([END], pa.binary()), *(c.dictionary for c in coded[:1])])
        sizes = np.concatenate(held)
        ids = np.zeros(int(sizes.sum()), np.uint32)
        word = np.ones(len(ids), bool)
        word[np.cumsum(sizes) - 1] = False
        ids[word] = np.concatenate([np.zeros(0, np.int32), *(np.asarray(c.indices) for c in coded)]) + 1
        of = [pa.concat_arrays(c) for c in zip(*docs)]
        lists = [pa.ListArray.from_arrays([0, len(c)], c) for c in (of[0].cast(pa.int64()), of[1], distinct)]
        of_words = hashed(distinct.to_numpy(zero_copy_only=False).tolist())
        blobs = [pa.array([x], pa.binary()) for x in (np.asarray(of[2]).tobytes(), sizes.astype(np.uint32).tobytes(), _packed(ids), of_words.tobytes(), _packed(endings(distinct)))]
        return pa.record_batch([pa.array([unit]), lists[0], lists[1], *blobs, lists[2]], _NAMES)

    for part in (p for batch in batches for p in _slices(batch)):
        words_, n = _split(part.column(3))
        found.append(words_)
        held.append(n + 1)
        tokens += len(words_) + len(n)
        docs.append(part.columns[:3])
        if tokens >= UNIT_TOKENS:
            yield flush()
            found, held, docs, tokens, unit = [], [], [], 0, unit + 1
            pa.default_memory_pool().release_unused()
    if docs:
        yield flush()


class Unit:
    def __init__(self, row: dict, classes: Classes | None = None):
        self.unit, self.doc_id = row["unit"], row.get("doc_id")
        self.held_out = np.asarray(row["held_out"].values, bool) if len(row["held_out"]) else np.zeros(0, bool)
        self.mark, self.sizes = np.frombuffer(row["mark"], np.int64), np.frombuffer(row["sizes"], np.uint32).astype(np.int64)
        self.ends = np.cumsum(self.sizes)
        self.ids = _unpacked(row["ids"], int(self.ends[-1]), np.uint32)
        self.hashes, self.words = np.frombuffer(row["hashes"], np.uint64), row["words"].values if "words" in row else None
        self.endings = _unpacked(row["ends"], len(self.hashes), np.uint16)
        self.learned = np.repeat(~self.held_out, self.sizes)
        if classes:
            self.codes = classes.codes(self.hashes, self.endings)
            #: The words of the dictionary that aren't of the head.
            self.rare = np.flatnonzero(self.codes >> 38 == 0)

    def before(self) -> np.ndarray:
        """The dictionary's number of the word before each token, or one past its end at a document's begin."""
        out = np.empty(len(self.ids), np.uint32)
        out[1:] = self.ids[:-1]
        out[self.ends - self.sizes] = len(self.hashes)
        return out

    def pairs(self, shards: int) -> np.ndarray:
        """A key for each token and the word before it: shard, group of the word before, and 32 bits."""
        before = self.before()
        mixed = np.append(self.hashes * _MIX[0], np.uint64(0))[before]
        mixed ^= self.hashes[self.ids]
        mixed *= _MIX[1]
        mixed ^= mixed >> np.uint64(29)
        mixed *= _MIX[2]
        high = mixed >> np.uint64(32)
        mixed ^= high
        mixed &= np.uint64(0xFFFFFFFF)
        high &= np.uint64(shards - 1)
        high <<= np.uint64(5)
        high |= self.group().astype(np.uint64)[before]
        high <<= np.uint64(32)
        mixed |= high
        return mixed

    def group(self) -> np.ndarray:
        """For each word of the dictionary, and a document's begin, a group by frequency: words share a memory's weight."""
        rank = self.codes >> 38
        out = np.where(rank > 0, 2 + np.log2(np.maximum(rank, 1)).astype(np.int64), 1)
        return np.append(out, 0)

    def by_shard(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """The rare words in order of their shard, and where each shard's begin."""
        shard = (self.hashes[self.rare] >> np.uint64(32) & np.uint64(shards - 1)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _different(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and how often each comes; sorts keys. Sorting is several times as fast as hashing here."""
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.diff(np.append(first, len(keys)))


_MIX = tuple(np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
GROUPS = 32


def _unit_rows(batches: Iterator[pa.RecordBatch], classes: Classes | None = None) -> Iterator[Unit]:
    for batch in batches:
        for k in range(batch.num_rows):
            cells = {n: c[k] for n, c in zip(batch.schema.names, batch.columns)}
            yield Unit({n: c if isinstance(c, pa.ListScalar) else c.as_py() for n, c in cells.items()}, classes)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over units: (word, n) in training texts, and how often endings stand one to four words apart as a word that no text
    can have, a space and the pair's code."""
    near = np.zeros(ENDINGS * ENDINGS, np.int64)
    for u in _unit_rows(batches):
        n = np.bincount(u.ids[u.learned], minlength=len(u.hashes))
        some = np.flatnonzero(n)
        yield pa.record_batch([u.words.take(pa.array(some)), pa.array(n[some])], ["word", "n"])
        e = u.endings.astype(np.int64)[u.ids]
        of = np.repeat(np.arange(len(u.sizes)), u.sizes)
        inner = u.learned.copy()
        inner[u.ends - 1] = False  # the end has no ending
        for k in (1, 2, 3, 4):
            both = inner[:-k] & inner[k:] & (of[:-k] == of[k:])
            near += np.bincount((e[:-k] * ENDINGS + e[k:])[both], minlength=len(near))
    some = np.flatnonzero(near)
    yield pa.record_batch([pa.array([_PAIR + int(k).to_bytes(4, "big") for k in some], pa.binary()), pa.array(near[some])], ["word", "n"])


_PAIR = b" "


def cluster(near: np.ndarray, n: int = CLUSTERS) -> np.ndarray:
    """A cluster for each ending: k-means on the leading directions of their positive pointwise mutual information."""
    m = near.reshape(ENDINGS, ENDINGS)
    m = m + m.T
    mass = m.sum(1)
    total = max(mass.sum(), 1.0)
    expected = np.outer(mass, mass) / total
    info = np.maximum(np.log((m + 0.5) / (expected + 0.5)), 0.0)
    u, s, _ = np.linalg.svd(info)
    x = u[:, :24] * np.sqrt(s[:24])
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    centre = x[np.argsort(-mass, kind="stable")[:n]].copy()
    for _ in range(25):
        best = np.argmax(x @ centre.T, axis=1)
        for k in range(n):
            if (mine := best == k).any():
                c = (x[mine] * np.log1p(mass[mine])[:, None]).sum(0)
                centre[k] = c / (np.linalg.norm(c) + 1e-9)
    return np.argmax(x @ centre.T, axis=1)


def _class_totals(make: Callable[[], Classes]):
    def run(batches):
        classes, out = make(), np.zeros((2, CLASSES), np.int64)
        for batch in batches:
            k = classes.coded(batch.column(0)) & 63
            np.add.at(out[0], k, np.asarray(batch.column(1)))
            out[1] += np.bincount(k, minlength=CLASSES)
        yield pa.record_batch([pa.array(np.arange(CLASSES)), pa.array(out[0]), pa.array(out[1])], ["class", "n", "words"])

    return run


# Training: chains of gradient steps over documents dealt by their hash, so that neither the partitions nor the cluster matter.


_DEALT = "chain bigint, mark binary, sizes binary, codes binary"


def _dealt(round_: int, chains: int, make: Callable[[], Classes]):
    """Over units: the documents of a round by chain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for u in _unit_rows(batches, make()):
            codes = (u.codes & 0xFFFFFFFF).astype(np.uint32)[u.ids]  # class and 26 bits of the hash
            mine = np.flatnonzero(~u.held_out & (u.mark % ROUNDS == round_))
            chain = u.mark[mine] // ROUNDS % chains
            for k, m in enumerate(u.mark[mine].tolist()):  # many equal rows go on to other chains
                chain[k] = (chain[k] + seen[m] // EQUAL_ROWS) % chains
                seen[m] += 1
            order = np.argsort(chain, kind="stable")
            mine, chain = mine[order], chain[order]
            first = np.flatnonzero(np.append(True, chain[1:] != chain[:-1])[: len(chain)])
            rows = []
            for of in np.split(mine, first[1:]) if len(mine) else ():
                parts = np.concatenate([codes[u.ends[k] - u.sizes[k] : u.ends[k]] for k in of])
                rows.append((u.mark[of].tobytes(), u.sizes[of].tobytes(), _packed(parts)))
            if rows:
                yield pa.record_batch([pa.array(chain[first]), *(pa.array(c, pa.binary()) for c in zip(*rows))], ["chain", "mark", "sizes", "codes"])

    return run


_CHANGE = "block bigint, chain bigint, tokens double, data binary"


def _chain(start):
    """A chain's steps over its documents, in the order of their hashes."""

    def run(dealt: pa.Table) -> pa.Table:
        marks = np.concatenate([np.frombuffer(b, np.int64) for b in dealt["mark"].to_pylist()])
        each = [np.frombuffer(b, np.int64) for b in dealt["sizes"].to_pylist()]
        codes = np.concatenate([_unpacked(b, int(s.sum()), np.uint32) for b, s in zip(dealt["codes"].to_pylist(), each)])
        sizes = np.concatenate(each)
        first = np.cumsum(sizes) - sizes
        order = np.lexsort((sizes, marks))

        def found():
            for at in range(0, len(order), ROWS_AT_ONCE):
                part = order[at : at + ROWS_AT_ONCE].tolist()
                yield np.concatenate([codes[first[k] : first[k] + sizes[k]] for k in part]).astype(np.int64), sizes[part]

        change, tokens = train(start.value, found())
        width = -(-len(change) // BLOCKS)
        parts = [(change[k * width : (k + 1) * width] * np.float32(tokens / 1e6)).tobytes() for k in range(BLOCKS)]
        chain = dealt["chain"][0].as_py()
        columns = [pa.array(np.arange(BLOCKS)), pa.array([chain] * BLOCKS), pa.array([tokens / 1e6] * BLOCKS), pa.array(parts, pa.binary())]
        return pa.table(columns, names=["block", "chain", "tokens", "data"])

    return run


def _add(found: pa.Table) -> pa.Table:
    """Sums of a block over at most FAN_IN chains, in the chains' order."""
    found = found.sort_by("chain")
    total = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in found.column("data"))
    tokens = float(np.sum(found["tokens"].to_numpy()))
    return pa.table({"block": found["block"][:1], "chain": found["chain"][:1], "tokens": [tokens], "data": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _trained(units: DataFrame, round_: int, weights: np.ndarray, chains: int, make: Callable[[], Classes]) -> np.ndarray:
    """The weights after a round: the mean of the chains' changes by their tokens, summed as a tree."""
    start = units.sparkSession.sparkContext.broadcast(weights)
    dealt = units.drop("doc_id", "words").mapInArrow(_dealt(round_, chains, make), _DEALT)
    found, left = dealt.groupBy("chain").applyInArrow(_chain(start), _CHANGE), chains
    while True:
        found = found.withColumn("chain", F.floor(F.col("chain") / FAN_IN)).groupBy("block", "chain").applyInArrow(_add, _CHANGE)
        if (left := -(-left // FAN_IN)) <= 1:
            break
    parts = sorted(found.collect(), key=lambda r: r["block"])  # BLOCKS rows
    if not parts:
        return weights
    return weights + np.concatenate([np.frombuffer(r["data"], np.float32) for r in parts])[: len(weights)] / np.float32(parts[0]["tokens"])


# The memory: counts of word pairs and of rare words, kept by shards; units ask for what they need.


def _asked(shards: int, make: Callable[[], Classes]):
    names = ["shard", "unit", "keys", "counts", "groups", "words", "word_counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u in _unit_rows(batches, make()):
            keys = u.pairs(shards)
            own, n = _different(keys[u.learned])
            each, _ = _different(keys)
            counts = np.zeros(len(each), np.uint32)
            counts[np.searchsorted(each, own)] = n
            del keys, own, n
            cut = np.searchsorted(each >> np.uint64(37), np.arange(shards + 1, dtype=np.uint64))
            order, at = u.by_shard(shards)
            learned = np.bincount(u.ids[u.learned], minlength=len(u.hashes))[u.rare][order].astype(np.uint32)
            words_ = u.words.take(pa.array(u.rare[order]))
            low, group = each.astype(np.uint32), (each >> np.uint64(32)).astype(np.int64) & (GROUPS - 1)
            rows = []
            for s in range(shards):
                a, b, c, d = cut[s], cut[s + 1], at[s], at[s + 1]
                if a < b or c < d:
                    sizes = np.bincount(group[a:b], minlength=GROUPS).astype(np.uint32)
                    rows.append((s, u.unit, low[a:b].tobytes(), _packed(counts[a:b]), sizes.tobytes(), words_.slice(c, d - c), learned[c:d].tobytes()))
            if rows:
                of = list(zip(*rows))
                offsets = np.cumsum([0, *map(len, of[5])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(of[5]))
                blobs = [pa.array(c, pa.binary()) for c in (*of[2:5], of[6])]
                asked = pa.record_batch([pa.array(of[0], pa.int64()), pa.array(of[1], pa.int64()), *blobs[:3], lists, blobs[3]], names)
                del u, each, counts, low, group, words_, rows, of, lists, blobs
                yield asked
                del asked
            pa.default_memory_pool().release_unused()

    return run


_ASKED = "shard bigint, unit bigint, keys binary, counts binary, groups binary, words array<binary>, word_counts binary"
_TOLD = "unit bigint, shard bigint, counts binary, word_counts binary, tokens array<bigint>, again array<bigint>"


def _joined(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All of some arrays, and where to cut it."""
    found = [np.frombuffer(b, np.uint32) for b in blobs]
    return np.concatenate(found), np.cumsum([len(f) for f in found])[:-1]


def _told(asked: pa.Table) -> pa.Table:
    """A shard's sums for each unit that asks, and for the first one how many tokens of each group it has learned, and
    how many of them it has met more than once."""
    keys, cut = _joined(asked["keys"].to_pylist())
    counts = np.concatenate([_unpacked(b, n, np.uint32) for b, n in zip(asked["counts"].to_pylist(), np.diff(np.concatenate([[0], cut, [len(keys)]])).tolist())])
    each = np.concatenate([np.repeat(np.arange(GROUPS), np.frombuffer(b, np.uint32)) for b in asked["groups"].to_pylist()])
    different, place = np.unique(keys.astype(np.uint64) | each.astype(np.uint64) << np.uint64(32), return_inverse=True)
    total = np.bincount(place, counts, len(different)).astype(np.int64)
    group = (different >> np.uint64(32)).astype(np.int64)
    tokens, again = np.bincount(group, total, GROUPS), np.bincount(group, np.where(total > 1, total, 0), GROUPS)
    n = asked.num_rows
    empty = np.zeros(GROUPS, np.int64)
    stats = [[x.astype(np.int64).tolist()] + [empty[:0].tolist()] * (n - 1) for x in (tokens, again)]
    lists = asked["words"].combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.array([len(x) for x in lists])
    coded = lists.flatten().dictionary_encode()
    word_counts, _ = _joined(asked["word_counts"].to_pylist())
    number = np.asarray(coded.indices)
    of_word = np.bincount(number, word_counts, len(coded.dictionary)).astype(np.uint32)[number]
    blobs = [pa.array([make(p) for p in np.split(x, c)], pa.binary()) for x, c, make in ((total[place].astype(np.uint32), cut, _packed), (of_word, np.cumsum(sizes)[:-1], np.ndarray.tobytes))]
    kind = pa.list_(pa.int64())
    return pa.table([asked["unit"], asked["shard"], *blobs, pa.array(stats[0], kind), pa.array(stats[1], kind)], names=[c.split()[0] for c in _TOLD.split(", ")])


_SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, score double"


def _met(keys: np.ndarray, told: pa.Table) -> np.ndarray:
    """The counts of a unit's pairs, of which the shards told each once, in order. One sort finds all their places, where a
    search for each would miss the caches."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    of = keys[new] >> np.uint64(37)
    sizes = np.diff(np.append(0, np.searchsorted(of, np.array(told["shard"].to_pylist(), np.uint64), "right"))).tolist()
    counts = np.concatenate([_unpacked(b, n, np.uint32) for b, n in zip(told["counts"].to_pylist(), sizes)])
    del keys, of
    out = np.empty(len(order), np.uint32)
    out[order] = np.repeat(counts, np.diff(np.append(np.flatnonzero(new), len(new))))
    return out


def _scored(shards: int, model, make: Callable[[], Classes]):
    """Over a unit and what the shards told it: a row for each document."""

    def run(unit: pa.Table, told: pa.Table) -> pa.Table:
        head, flat, log_mass, begins, share = model.value
        u, told = next(_unit_rows(unit.to_batches(), make())), told.sort_by("shard")
        met = _met(u.pairs(shards), told)
        rare, _ = _joined(told["word_counts"].to_pylist())
        rank = u.codes >> 38
        c = np.zeros(len(u.codes) + 1, np.int64)
        c[:-1][rank > 0] = head[rank[rank > 0] - 1]
        c[u.rare[u.by_shard(shards)[0]]] = rare
        c[-1] = begins
        log_c, shares, before, weights = np.log10(c[:-1] + 0.5), np.where(c > 0, share[u.group()], 0.0), u.before(), Weights(flat)
        sums = np.empty((3, len(u.sizes)))
        for i, j, a, b in _stretches(u.sizes):
            ids, last = u.ids[a:b], before[a:b]
            codes, own = u.codes[ids], log_c[ids]
            p = np.log10(np.e) * weights.log_target(History(codes, u.sizes[i:j]))
            p += own - log_mass[codes & 63]
            # Where the word before was learned, what followed it has its share.
            part = shares[last]
            p = np.log10((1 - part) * 10.0**p + part * met[a:b] / np.maximum(c[last], 1))
            doc = np.repeat(np.arange(j - i), u.sizes[i:j])
            sums[:, i:j] = [np.bincount(doc, x, j - i) for x in (c[ids] > 0, own, p)]
        columns = [u.doc_id.values, pa.array(u.held_out), pa.array(u.sizes), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])]
        return pa.table(columns, names=[x.split()[0] for x in _SCORED.split(", ")])

    return run


def _stretches(sizes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first document, end, first token, end) of stretches of documents."""
    ends = np.append(0, np.cumsum(sizes))
    for i in range(0, len(sizes), ROWS_AT_ONCE):
        j = min(i + ROWS_AT_ONCE, len(sizes))
        yield i, j, int(ends[i]), int(ends[j])


def score(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Learns from the rows
    whose crc32 of the id's text leaves another remainder than 1 by 5."""
    spark = df.sparkSession
    out = F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))
    docs = df.select(F.col(doc_id).alias("doc_id"), out.alias("held_out"), F.xxhash64(doc_id, text).bitwiseAND((1 << 62) - 1).alias("mark"), F.col(text).alias("text"))
    units, _ = common.stored(docs.mapInArrow(_units, _UNIT), "units")
    counted, counted_path = common.stored(units.mapInArrow(_counts, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    is_pair = F.substring("word", 1, 1) == F.lit(_PAIR)
    vocabulary = counted.filter(~is_pair)
    total, distinct, begins = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.length("word") == 0, F.col("n"))), F.lit(0))).first()
    # The most frequent words, by steps of a sixteenth of a power of two in their counts: the lowest step that still
    # leaves HEAD words at most. A row for each step, then HEAD rows at most, come to the driver. Words of over HEAD_BYTES
    # are asked for like rare ones, once a unit, however frequent they are.
    words_ = vocabulary.filter(F.length("word") <= HEAD_BYTES).withColumn("step", F.floor(F.log2("n") * 16))
    least, size = None, 0
    for r in sorted(words_.groupBy("step").agg(F.count("*").alias("k")).collect(), key=lambda r: -r["step"]):
        size += r["k"]
        if size > HEAD:
            break
        least = r["step"]
    most = words_.filter(F.col("step") >= (least if least is not None else 1 << 30)).select("word", "n").toArrow()
    n = np.asarray(most["n"].combine_chunks())
    most = most["word"].to_pylist()
    order = sorted(range(len(most)), key=lambda k: (-n[k], most[k]))
    head, head_counts = [most[k] for k in order], n[order].astype(np.int64)
    own = [w for w in head[: OWN + 1] if w != END][:OWN]
    pairs = counted.filter(is_pair).toArrow()  # at most ENDINGS squared rows
    near = np.zeros(ENDINGS * ENDINGS)
    near[[int.from_bytes(w[1:], "big") for w in pairs["word"].to_pylist()]] = np.asarray(pairs["n"].combine_chunks())
    sent = spark.sparkContext.broadcast((own, cluster(near), head))
    key = uuid.uuid4().hex

    def make() -> Classes:
        if key not in _made:  # kept between a worker's tasks
            _made.clear()
            _made[key] = Classes(*sent.value)
        return _made[key]

    counts, sizes = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in vocabulary.mapInArrow(_class_totals(make), "class bigint, n bigint, words bigint").groupBy("class").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect():
        counts[r["class"]], sizes[r["class"]] = r["n"], r["words"]
    log_mass = np.log10(counts + 0.5 * (sizes + 1))
    common.discard(spark, counted_path)
    weights = np.zeros(Weights().flat.size, np.float32)
    chains = max(1, -(-total // (ROUNDS * CHAIN_TOKENS)))
    for k in range(ROUNDS):
        weights = _trained(units, k, weights, chains, make)
    shards = 1 << max(0, math.ceil(math.log2(max(total, 1) / SHARD_TOKENS)))
    told, _ = common.stored(units.mapInArrow(_asked(shards, make), _ASKED).groupBy("shard").applyInArrow(_told, _TOLD), "told")
    group = F.posexplode(F.arrays_zip("tokens", "again")).alias("group", "x")
    share = np.zeros(GROUPS)
    for r in told.filter(F.size("tokens") > 0).select(group).groupBy("group").agg(F.sum("x.tokens").alias("n"), F.sum("x.again").alias("again")).collect():
        share[r["group"]] = min(r["again"] / r["n"], MOST_MEMORY) if r["n"] else 0.0
    model = spark.sparkContext.broadcast((head_counts, weights, log_mass, begins, share))
    rows = units.drop("words").groupBy("unit").cogroup(told.select("unit", "shard", "counts", "word_counts").groupBy("unit")).applyInArrow(_scored(shards, model, make), _SCORED)
    base = F.col("logs") - F.col("n_tokens") * F.lit(math.log10(total + 0.5 * (distinct + 1)))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))
