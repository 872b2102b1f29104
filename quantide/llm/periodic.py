"""Periodic runs of words: maximal stretches that repeat with a smallest period at least twice.

Common extensions to the right and to the left come from the suffix trees (Ukkonen) of the words and of their
reversal: the tree is walked once, the least depth met between neighbouring leaves of the walk is kept, and the depth of
two leaves' lowest common ancestor is the least of these between them, from a table of minima over powers of two, in
constant time. Every run has a Lyndon root for one of the two orders of the words, and the longest Lyndon word at a
place ends where the next smaller suffix begins; so each place has two candidates of a root, and those are extended both
ways as far as words repeat.

Trees are built of the stretches in which a run can lie. In a run of at least 12 words every word belongs to a sequence
of six words that the same run has again; words that no sequence of six, found twice in their stretch, covers are
therefore in no run and divide it, until nothing changes. That loses nothing, and most documents have no such stretch.

Defined results: a null text is an empty one; texts without a run have nulls for the longest run, the digest of nothing
for runs, and all their words in `collapsed`; a null id leaves planted repeats out; repeated rows get equal results;
other columns don't matter; an empty table gives an empty result. A document is one task's work however long it is,
with memory linear in it (about 1.5 kB a word of its longest stretch), as its trees can't be divided.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens, words

#: Shortest run, in words; and how long a repeated sequence all its words must belong to: length - period is half of it at least.
LEAST = 12
SEQUENCE = LEAST // 2


class Runs(NamedTuple):
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


class SuffixTree:
    """The suffix tree of whole numbers from 0 to kinds - 1, with an end that is smaller than all and occurs once."""

    def __init__(self, symbols: list[int], kinds: int):
        self.symbols = [s + 1 for s in symbols] + [0]
        self.base = kinds + 1
        self.size = len(symbols)
        self._grow()
        self._arrange()
        self.order, gaps = self._walk(rising=True)
        self.rank = self._places(self.order)
        self._minima(gaps)

    def _grow(self) -> None:
        """Ukkonen: symbol by symbol; leaves are open to the right, and the place of the next suffix is reached by suffix links."""
        text, base = self.symbols, self.base
        n = len(text)
        child: dict[int, int] = {}  # by node * base + first symbol of the edge
        begin, stop, link, suffix = [0], [0], [0], [-1]
        node, edge, along = 0, 0, 0  # the place: a node, and `along` symbols down the edge that begins with text[edge]
        nxt = 0  # the longest suffix that has no leaf yet
        for i, symbol in enumerate(text):
            waiting = 0  # the inner node whose link is still to be set
            while nxt <= i:
                if not along:
                    edge = i
                key = node * base + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(begin)
                else:
                    start = begin[below]
                    span = stop[below] - start
                    if along >= span:
                        edge += span
                        along -= span
                        node = below
                        continue
                    if text[start + along] == symbol:
                        along += 1
                        if waiting:
                            link[waiting] = node
                        break
                    middle = child[key] = len(begin)
                    begin.append(start)
                    stop.append(start + along)
                    link.append(0)
                    suffix.append(-1)
                    begin[below] = start + along
                    child[middle * base + text[start + along]] = below
                    child[middle * base + symbol] = len(begin)
                    if waiting:
                        link[waiting] = middle
                    waiting = middle
                begin.append(i)
                stop.append(n)
                link.append(0)
                suffix.append(nxt)
                if below is None and waiting:
                    link[waiting] = node
                    waiting = 0
                nxt += 1
                if node:
                    node = link[node]
                elif along:
                    along -= 1
                    edge = nxt
        self.child, self.span, self.suffix = child, [b - a for a, b in zip(begin, stop)], suffix

    def _arrange(self) -> None:
        """Each node's children by rising symbol."""
        count = len(self.child)
        keys = np.fromiter(self.child.keys(), np.int64, count)
        nodes = np.fromiter(self.child.values(), np.int64, count)
        self.child = {}
        order = np.argsort(keys)
        self.below = nodes[order].tolist()
        self.first = np.searchsorted(keys[order] // self.base, np.arange(len(self.span) + 1)).tolist()
        self.ended = (keys[order] % self.base == 0).tolist()

    def _walk(self, rising: bool) -> tuple[list[int], list[int]]:
        """Suffixes in the order of the walk, and before each the least depth that the walk met since the last.

        Falling: symbols in falling order, but the end before all of them.
        """
        below, first, span, suffix, ended = self.below, self.first, self.span, self.suffix, self.ended
        order, gaps = [], []
        todo = [(0, 0, 0)]  # a node, its depth, and the least depth since the last leaf before it
        while todo:
            node, depth, gap = todo.pop()
            if suffix[node] >= 0:
                order.append(suffix[node])
                gaps.append(gap)
                continue
            lo, hi = first[node], first[node + 1]
            if rising:
                for k in range(hi - 1, lo, -1):
                    todo.append((below[k], depth + span[below[k]], depth))
                todo.append((below[lo], depth + span[below[lo]], gap))
            else:
                least = lo + (1 if ended[lo] else 0)
                for k in range(least, hi):
                    todo.append((below[k], depth + span[below[k]], depth))
                if least > lo:
                    todo.append((below[lo], depth + span[below[lo]], depth))
        return order, gaps

    def _places(self, order: list[int]) -> np.ndarray:
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return place

    def _minima(self, gaps: list[int]) -> None:
        """minima[k][i]: the least of the 2^k gaps from i on."""
        self.minima = [np.array(gaps, np.int32)]
        while 2 << (len(self.minima) - 1) <= len(gaps):
            half = 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(self.minima[-1][:-half], self.minima[-1][half:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes i and j (different ones) have in common."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.zeros(len(lo), np.int64)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(self.minima[k][lo[m]], self.minima[k][hi[m] - (1 << k)])
        return out

    def lyndon(self) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the longest Lyndon word at each place, for rising and for falling order of the symbols."""
        falling, _ = self._walk(rising=False)
        return self._to_smaller(self.rank.tolist()), self._to_smaller(self._places(falling).tolist())

    def _to_smaller(self, rank: list[int]) -> np.ndarray:
        """From each place to the next one of smaller rank; the end has the smallest."""
        out = [0] * self.size
        open_ = []
        for place, own in enumerate(rank):
            while open_ and rank[open_[-1]] > own:
                k = open_.pop()
                out[k] = place - k
            open_.append(place)
        return np.array(out, np.int64)


def runs(symbols: np.ndarray, least: int = LEAST) -> Runs:
    """All runs of at least `least` symbols and two periods, by start, then period."""
    kinds, dense = np.unique(symbols, return_inverse=True)
    text = dense.tolist()
    n = len(text)
    tree, back = SuffixTree(text, len(kinds)), SuffixTree(text[::-1], len(kinds))
    found = []
    for period in tree.lyndon():
        i = np.flatnonzero(np.arange(n) + period < n)
        p = period[i]
        i, p = i[same := dense[i] == dense[i + p]], p[same]
        right = tree.common(i, i + p)
        left = np.zeros(len(i), np.int64)
        inner = i > 0
        left[inner] = back.common(n - i[inner], n - i[inner] - p[inner])
        length = left + p + right
        fit = length >= np.maximum(least, 2 * p)
        found.append(np.stack([(i - left)[fit], p[fit], length[fit]], 1))
    every = np.unique(np.concatenate(found), axis=0)
    return Runs(every[:, 0], every[:, 2], every[:, 1])


def _in_repeats(ids: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """Which places belong to a sequence of SEQUENCE ids that occurs again in the same stretch. Equal hashes only keep more."""
    last = len(ids) - SEQUENCE + 1
    covered = np.zeros(len(ids), bool)
    if last <= 1:
        return covered
    code = stretch[:last].astype(np.uint64)
    for k in range(SEQUENCE):
        code = (code ^ (code >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[k : last + k].astype(np.uint64)
    code[stretch[:last] != stretch[SEQUENCE - 1 :]] = 0
    order = np.argsort(code, kind="stable")
    equal = code[order[1:]] == code[order[:-1]]
    again = np.zeros(last, bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    again &= stretch[:last] == stretch[SEQUENCE - 1 :]
    change = np.zeros(len(ids) + 1, np.int32)
    change[:last] += again
    change[SEQUENCE:] -= again
    return np.cumsum(change[:-1]) > 0


def stretches(ids: np.ndarray, document: np.ndarray) -> list[tuple[int, int]]:
    """The places (from, to) that may hold a run: words outside all of them are in none. document: a number for each place, by document."""
    place = np.arange(len(ids))
    stretch = document
    while len(place):
        covered = _in_repeats(ids[place], stretch)
        parted = np.concatenate([[True], stretch[1:] != stretch[:-1]]) | ~covered
        stretch = np.cumsum(parted)[covered]
        if covered.all():
            break
        place = place[covered]
    cut = np.flatnonzero(np.diff(stretch)) + 1
    bounds = np.concatenate([[0], cut, [len(place)]])
    return [(int(place[a]), int(place[b - 1]) + 1) for a, b in zip(bounds, bounds[1:]) if b - a >= LEAST]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The word that stands at each of a document's n places where its id asks for repeats, else None."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def _of_slice(doc_ids: list[int | None], texts: pa.Array) -> tuple[words.Words, np.ndarray, list[Runs], np.ndarray]:
    """The words, which of them stands at each place, each document's runs, and the places that stay."""
    cut = words.cut(texts)
    index = np.arange(len(cut.values))
    for k, doc_id in enumerate(doc_ids):
        lo, hi = int(cut.bounds[k]), int(cut.bounds[k + 1])
        if (moved := planted(doc_id, hi - lo)) is not None:
            index[lo:hi] = lo + moved
    ids = cut.ids()[0][index]
    stay = np.ones(len(ids), bool)
    found: list[list[Runs]] = [[] for _ in doc_ids]
    for lo, hi in stretches(ids, cut.rows()):
        own = runs(ids[lo:hi])
        if len(own.start):
            k = int(np.searchsorted(cut.bounds, lo, side="right")) - 1
            found[k].append(Runs(own.start + lo - cut.bounds[k], own.length, own.period))
            change = np.zeros(hi - lo + 1, np.int64)
            np.add.at(change, own.start + own.period, 1)
            np.add.at(change, own.start + own.length, -1)
            stay[lo:hi] = np.cumsum(change[:-1]) == 0
    return cut, index, [Runs(*map(np.concatenate, zip(*x))) if x else Runs(*[np.zeros(0, np.int64)] * 3) for x in found], stay


DDL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _described(own: Runs) -> tuple:
    """n_runs, the longest run (of equals the first, then the one of least period), its exponent, and the digest of all."""
    listed = sorted(zip(own.start.tolist(), own.length.tolist(), own.period.tolist()), key=lambda r: (r[0], r[2]))
    digest = hashlib.sha256("".join("%d,%d,%d\n" % r for r in listed).encode()).hexdigest()
    if not listed:
        return 0, None, None, None, None, digest
    start, length, period = min(listed, key=lambda r: (-r[1], r[0], r[2]))
    return len(listed), start, length, period, 1000 * length // period, digest


def find(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text), with planted repeats: its runs in numbers and digests, and the digest of the words that stay."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, 1):
                cut, index, found, stay = _of_slice(part.column(0).to_pylist(), part.column(1))
                upto = np.concatenate([[0], np.cumsum(stay)])
                collapsed = words.joined(cut.values, index[stay], upto[cut.bounds]).to_pylist()
                rows = [(*_described(r), hashlib.sha256(c).hexdigest()) for r, c in zip(found, collapsed)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 5 + [pa.string()] * 2))], [d.split()[0] for d in DDL.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(own, DDL)


RUNS_DDL = "array<struct<start:bigint,length:bigint,period:bigint>>"


def with_runs(df: DataFrame, text: str = "text", to: str = "runs") -> DataFrame:
    """df with the runs of its text as it is (nothing planted), as an array of (start, length, period) by start, then period."""

    def own(column: pa.Array) -> pa.Array:
        found = []
        for part in tokens.slices(pa.RecordBatch.from_arrays([column], ["text"]), 0):
            found += _of_slice([None] * len(part), part.column(0))[2]
        listed = [sorted(({"start": s, "length": n, "period": p} for s, n, p in zip(*map(np.ndarray.tolist, r))), key=lambda x: (x["start"], x["period"])) for r in found]
        return pa.array(listed, pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])))

    return df.withColumn(to, F.arrow_udf(own, RUNS_DDL)(text))


def collapse(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the repeats of each run dropped from its text, words joined by one space; texts without a run, and nulls, stay as they are."""

    def own(column: pa.Array) -> pa.Array:
        out = []
        for part in tokens.slices(pa.RecordBatch.from_arrays([column], ["text"]), 0):
            cut, index, found, stay = _of_slice([None] * len(part), part.column(0))
            upto = np.concatenate([[0], np.cumsum(stay)])
            collapsed = words.joined(cut.values, index[stay], upto[cut.bounds]).to_pylist()
            out += [c.decode() if len(r.start) else t for t, c, r in zip(part.column(0).to_pylist(), collapsed, found)]
        return pa.array(out, pa.string())

    return df.withColumn(text, F.arrow_udf(own, "string")(text))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents"))
