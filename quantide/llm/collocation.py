"""Collocations: phrases of a language that occur far more often than their parts would together by chance.

Prefix-free parsing: a sequence of WINDOW words is a trigger if its hash is divisible by CHUNK_WORDS. Each piece of text
is cut into chunks, from one trigger (or the piece's beginning) to the end of the next trigger (or the piece's end), so
neighbouring chunks overlap by a trigger and, as triggers follow from the words alone, equal passages have equal chunks
wherever they stand. The distinct chunks and their frequencies are the dictionary. Phrases of up to WINDOW + 1 words are
counted inside the distinct chunks, weighted by frequency; a phrase belongs to the chunk in whose own part, the words
before its last trigger, it begins, so what lies in an overlap counts once.

A phrase that occurs often enough has only parts that do. So words are counted first, then pairs of words, then longer
phrases all of whose pairs may be frequent. Which pairs may be is told by counts of their hashes: a task sends three bytes
for a hash that it met once, which a shard of hashes adds up. What may be frequent is kept in bitmaps of fixed size, made
by Spark's bitmap aggregate: they can say yes to other phrases, which then only get counted in vain, never no to a frequent
one. Counts that matter are by the phrases themselves, never by hashes.

Defined results: a null text is an empty one; a null lang is `und`; a text without words adds nothing; repeated rows
count each; other columns don't matter; a language without any frequent phrase has no rows, an empty table gives none.
Texts are cut whole; a piece's words are one row at most, however long the piece is, and so is a chunk without a trigger.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, tokens, words

#: A candidate occurs so often at least, has so many words at most, and so many are listed for a language.
LEAST = 100
LONGEST = 5
KEPT = 2000
#: Words of a trigger: one less than the longest phrase, so that every phrase lies in a chunk whole.
WINDOW = LONGEST - 1
#: Mean words of a chunk's own part.
CHUNK_WORDS = 16
#: Bits that tell which phrases may be frequent (8 MB); 2 to this power, whatever the input.
BITS = 26
#: Text of the dictionary that a task looks at together.
BYTES_AT_ONCE = 4 << 20
#: Hashes of pairs are counted in 2^9 shards, a task each at most, of 2^23 cells (16 MB while a shard is added up). More shards
#: serve corpora of many terabytes; a cell has 24 bits at most.
SHARD_BITS, CELL_BITS = 9, 23
UNKNOWN = "und"

_BREAK = words.byte_set(b".,;:!?\x0a\x0b\x0c\x0d")
_GAP = _BREAK | words.byte_set(b"\x20\x09")
_SPACE = words.byte_set(b"\x20")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashes(distinct: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(w) for w in distinct.to_pylist()], np.uint64)


def _mixed(code: np.ndarray, own: np.ndarray) -> np.ndarray:
    code = (code ^ own) * _MIX
    return code ^ (code >> np.uint64(31))


CHUNK_DDL = "lang string, chunk string, own int"


def _chunks(mean: int):
    """Rows (lang, text) to rows (lang, chunk, own): a chunk's words, and how many of them are its own."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, 1):
                cut = words.cut(part.column(1), _GAP, lower=True)
                n = len(cut.values)
                if not n:
                    continue
                ids, distinct = cut.ids()
                row = cut.rows()
                breaks = np.cumsum(_BREAK[cut.data])[cut.begins]
                first = np.ones(n, bool)
                first[1:] = (row[1:] != row[:-1]) | (breaks[1:] != breaks[:-1])
                piece = np.cumsum(first)
                starts = first.copy()
                if n >= WINDOW:
                    word = _hashes(distinct)[ids]
                    code = np.zeros(n - WINDOW + 1, np.uint64)
                    for k in range(WINDOW):
                        code = _mixed(code, word[k : n - WINDOW + 1 + k])
                    starts[: n - WINDOW + 1] |= (piece[WINDOW - 1 :] == piece[: n - WINDOW + 1]) & ((code >> np.uint64(33)) % np.uint64(mean) == 0)
                begin = np.flatnonzero(starts)
                upto = np.append(begin[1:], n)
                # Beside a chunk's own words stands the trigger that the next one of its piece begins with.
                more = np.append(piece[begin[1:]] == piece[begin[:-1]], False)
                end = upto + np.where(more, WINDOW, 0)
                size = end - begin
                bounds = np.concatenate([[0], np.cumsum(size)])
                index = ids[np.repeat(begin - bounds[:-1], size) + np.arange(bounds[-1])]
                text = words.joined(distinct, index, bounds).cast(pa.large_string()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[begin])).cast(pa.string()), text, pa.array((upto - begin).astype(np.int32))], ["lang", "chunk", "own"])

    return own


def dictionary(docs: DataFrame, mean: int = CHUNK_WORDS) -> DataFrame:
    """lang, chunk, own (words that begin phrases of the chunk), f: the distinct chunks of docs (lang, text) and their frequencies."""
    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    return rows.mapInArrow(_chunks(mean), CHUNK_DDL).groupBy("lang", "chunk", "own").agg(F.count("*").alias("f"))


def _lang_codes(langs: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """For each row the number of its language, the languages, and for each row a hash of it."""
    coded = langs.dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = coded.dictionary.to_pylist()
    return number, names, np.array([zlib.crc32(x.encode()) for x in names], np.uint64)[number]


def _numbered(columns: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    """One number for each row, equal for equal rows only. columns: whole numbers below their size."""
    key, size = columns[0], sizes[0]
    for own, most in zip(columns[1:], sizes[1:]):
        if size * most >= 1 << 62:
            distinct, key = np.unique(key, return_inverse=True)
            size = len(distinct)
        key, size = key * most + own, size * most
    return key


def _may_be(bits: np.ndarray, code: np.ndarray) -> np.ndarray:
    at = _bit_of(code, 8 * len(bits)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _bit_of(code: np.ndarray, bits: int) -> np.ndarray:
    """The bit of a hash follows from its cell, the upper bits."""
    return (code >> np.uint64(64 - SHARD_BITS - CELL_BITS)) % np.uint64(bits)


class _Part:
    """A slice of the dictionary: ids of all words, and which places begin phrases of the chunks' own parts."""

    def __init__(self, part: pa.RecordBatch):
        cut = words.cut(part.column(1), _SPACE)
        self.n = len(cut.values)
        self.ids, self.distinct = cut.ids()
        self.row = cut.rows()
        self.lang = part.column(0)
        self.number, self.langs, self.lang_hash = _lang_codes(self.lang)
        self.own = np.arange(self.n) - cut.bounds[self.row] < part.column(2).to_numpy(zero_copy_only=False)[self.row]
        self.f = part.column(3).to_numpy(zero_copy_only=False)

    def fits(self, length: int) -> np.ndarray:
        """For each place that `length` words follow whether they are of one chunk and begin in its own part."""
        last = max(self.n - length + 1, 0)
        return self.own[:last] & (self.row[:last] == self.row[length - 1 :]) if last else np.zeros(0, bool)

    def pair_codes(self) -> np.ndarray:
        """Hashes of each word and the next, whether or not they are of one chunk."""
        word = _hashes(self.distinct)[self.ids]
        return _mixed(_mixed(self.lang_hash[self.row[:-1]], word[:-1]), word[1:])

    def counted(self, at: np.ndarray, length: int) -> pa.RecordBatch:
        """The phrases at the places `at`, added up."""
        ids, row = self.ids, self.row
        key = _numbered([self.number[row[at]], *(ids[at + k] for k in range(length))], [len(self.langs), *[len(self.distinct)] * length])
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        f = np.zeros(len(first), np.int64)
        np.add.at(f, inverse, self.f[row[at]])
        one = at[first]
        phrase = words.joined(self.distinct, ids[one[:, None] + np.arange(length)].ravel(), np.arange(len(one) + 1) * length)
        return pa.RecordBatch.from_arrays([self.lang.take(pa.array(row[one])), phrase.cast(pa.large_string()).cast(pa.string()), pa.array(f)], ["lang", "phrase", "f"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The dictionary's rows again, in fewer and larger batches, so that more of a batch's words and phrases are equal."""
    held, size = [], 0
    for batch in batches:
        for rows in tokens.slices(batch, 1):
            held.append(rows)
            size += rows.column(1).nbytes
            if size >= BYTES_AT_ONCE:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


COUNT_DDL = "lang string, phrase string, f long"


def _counted(lengths: range, bits):
    """Rows (lang, chunk, own, f) to the phrases of these lengths that begin in the chunks' own parts, added up by slice.

    bits: a broadcast bitmap of the pairs that may be frequent; None for single words.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = None if bits is None else np.frombuffer(bits.value, np.uint8)
        for rows in _gathered(batches):
            part = _Part(rows)
            if part.n < lengths[0]:
                continue
            known = _may_be(frequent, part.pair_codes()) if frequent is not None else None
            for length in lengths:
                fits = part.fits(length)
                for k in range(length - 1):
                    fits = fits & known[k : k + len(fits)]
                if fits.any():
                    yield part.counted(np.flatnonzero(fits), length)

    return own


SHARD_DDL = "shard int, once binary, often binary, counts binary"


def _pieces(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of flat, cut at the ends."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, chunk, own, f) to counts of the cells of their pairs: for each shard the cells met once, three bytes each,
    the others, three bytes each, and the counts of those."""
    for rows in _gathered(batches):
        part = _Part(rows)
        at = np.flatnonzero(part.fits(2))
        if not len(at):
            continue
        cell = (part.pair_codes()[at] >> np.uint64(64 - SHARD_BITS - CELL_BITS)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        f = np.add.reduceat(part.f[part.row[at[order]]], first)
        cell = cell[first]
        one = f == 1
        three = (cell & ((1 << CELL_BITS) - 1)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
        shards = np.unique(cell >> CELL_BITS)
        ends = np.searchsorted(cell >> CELL_BITS, shards, side="right")
        ones = np.cumsum(one)[ends - 1]
        more = ends - ones
        counts = f[~one].astype("<i8").view(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int32)), _pieces(three[one].ravel(), 3 * ones), _pieces(three[~one].ravel(), 3 * more), _pieces(counts, 8 * more)], ["shard", "once", "often", "counts"])


def _offsets(three: bytes) -> np.ndarray:
    out = np.zeros((len(three) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(three, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel()


def _full_cells(least: int, power: int):
    """Rows of _cells(), by shard, to the bits (from 1 on) of the cells that reach `least`, where counting stops. One shard's
    counters are held at a time; a row has each cell once."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, total = -1, np.zeros(1 << CELL_BITS, np.uint16 if least < 1 << 16 else np.int64)

        def full() -> pa.RecordBatch:
            code = ((shard << CELL_BITS) + np.flatnonzero(total == least)).astype(np.uint64) << np.uint64(64 - SHARD_BITS - CELL_BITS)
            return pa.RecordBatch.from_arrays([pa.array(np.unique(_bit_of(code, 1 << power)).astype(np.int64) + 1)], ["bit"])

        for batch in batches:
            for k, once, often, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if k != shard:
                    if shard >= 0:
                        yield full()
                    shard = k
                    total[:] = 0
                for at, n in ((_offsets(once), 1), (_offsets(often), np.frombuffer(counts, "<i8"))):
                    total[at] = np.minimum(total[at].astype(np.int64) + n, least)
        if shard >= 0:
            yield full()

    return own


def _bitmap(bit: DataFrame, power: int) -> bytes:
    """The bits (from 1 on) of a column `bit`; the driver gets them in parts of 4 kB, and never more than the whole bitmap."""
    parts = bit.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    out = bytearray(1 << (power - 3))
    for r in parts:
        at = (r.part - 1) * 4096
        out[at : at + 4096] = r.bits[: len(out) - at]
    return bytes(out)


def _pair_bits(pairs: DataFrame, power: int) -> DataFrame:
    def own(lang: pa.Array, phrase: pa.Array) -> pa.Array:
        each = [[zlib.crc32(x.encode()) for x in (a, *p.split(" "))] for a, p in zip(lang.to_pylist(), phrase.to_pylist())]
        a, first, second = np.array(each, np.uint64).reshape(-1, 3).T
        return pa.array(_bit_of(_mixed(_mixed(a, first), second), 1 << power).astype(np.int64) + 1)

    return pairs.select(F.arrow_udf(own, "long")("lang", "phrase").alias("bit"))


def frequent_phrases(chunks: DataFrame, least: int = LEAST, longest: int = LONGEST, power: int = BITS) -> list[DataFrame]:
    """Words, pairs, and longer phrases (lang, phrase, f) that occur `least` times or more, each stored."""
    spark = chunks.sparkSession
    rows = chunks.select("lang", "chunk", "own", "f")

    def counts(lengths: range, bits) -> DataFrame:
        counted = rows.mapInArrow(_counted(lengths, bits), COUNT_DDL)
        return common.stored(counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least), f"phrases-{lengths[0]}")[0]

    out = [counts(range(1, 2), None)]
    cells = rows.mapInArrow(_cells, SHARD_DDL).repartition("shard").sortWithinPartitions("shard")
    bits = spark.sparkContext.broadcast(_bitmap(cells.mapInArrow(_full_cells(least, power), "bit long"), power))
    out.append(counts(range(2, 3), bits))
    bits.destroy()
    if longest > 2:
        bits = spark.sparkContext.broadcast(_bitmap(_pair_bits(out[1], power), power))
        out.append(counts(range(3, longest + 1), bits))
        bits.destroy()
    return out


def _part(phrase: str, start, size):
    return F.array_join(F.slice(F.split(phrase, " "), start, size), " ")


def scored(counts: list[DataFrame], totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of each candidate, at its lowest-scoring cut. counts: words first, then longer; totals: lang, n.

    Products pass 64 bits, so they are exact decimals of 38 digits.
    """
    known = reduce(DataFrame.unionByName, counts)
    longer = reduce(DataFrame.unionByName, counts[1:]).select("lang", "phrase", F.col("f").alias("a"), F.size(F.split("phrase", " ")).alias("m"))
    cut = longer.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1))).withColumn("head", _part("phrase", F.lit(1), F.col("k"))).withColumn("rest", _part("phrase", F.col("k") + 1, F.col("m") - F.col("k")))
    of = lambda part, to: known.select("lang", F.col("phrase").alias(part), F.col("f").alias(to))
    both = cut.join(of("head", "l"), ["lang", "head"]).join(of("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    exact = F.expr("(1000 * cast(a as decimal(38, 0)) * cast(n as decimal(38, 0))) div (cast(l as decimal(38, 0)) * cast(r as decimal(38, 0)))")
    least = both.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def whole(candidates: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Candidates (lang, phrase, a) that no longer candidate holds as often."""
    size = F.size(F.split("phrase", " "))
    places = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.struct(i.alias("i"), m.alias("m")))))
    inner = candidates.filter(size > 2).select("lang", "phrase", "a", F.explode(places).alias("at"))
    held = inner.select("lang", _part("phrase", F.col("at.i"), F.col("at.m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    return candidates.join(held, ["lang", "phrase"], "left").filter(F.col("held").isNull() | (100 * F.col("held") < 100 * F.col("a"))).drop("held")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, kept: int = KEPT, mean: int = CHUNK_WORDS, power: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `kept` phrases of each language of docs (lang, text). longest: up to WINDOW + 1.

    mean: words of a chunk's own part; power: of the bits that tell which phrases may be frequent. Neither changes the result.
    """
    if not 2 <= longest <= WINDOW + 1:
        raise ValueError(f"phrases have 2 to {WINDOW + 1} words")
    chunks, _ = common.stored(dictionary(docs, mean), "chunks")
    totals = chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("f")).alias("n"))
    candidates, _ = common.stored(scored(frequent_phrases(chunks, least, longest, power), totals), "candidates")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = whole(candidates, longest).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= kept)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents").select("lang", "text"))


#: Of DuckDB, over the same table.
ORACLE = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k AS m, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM worded, unnest(generate_series(1, len(w))) AS t(i), unnest(generate_series(1, {LONGEST})) AS s(k)
  WHERE i + k - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM grams WHERE m = 1 GROUP BY lang),
known AS (SELECT * FROM grams WHERE f >= {LEAST}),
candidates AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM known WHERE m > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, t.n, x.f AS l, y.f AS r, k, (1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM candidates) c
  JOIN known x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN known y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:c.m], ' ')
  JOIN totals t ON t.lang = c.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM cuts),
inner_parts AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS held
  FROM candidates, unnest(generate_series(1, m)) AS t(i), unnest(generate_series(2, m - 1)) AS s(k)
  WHERE i + k - 1 <= m GROUP BY ALL),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN inner_parts h ON h.lang = b.lang AND h.phrase = b.phrase
  WHERE b.nth = 1 AND (h.held IS NULL OR 100 * h.held < 100 * b.a))
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= {KEPT}
"""
