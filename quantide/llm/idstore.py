"""A store of token ids: canonical, length-limited Huffman coding by global counts, decoded by table in independent blocks.

Documents are range-partitioned and sorted by id, tokenized once and stored; counts of all ids then give one code for
the whole store. A segment holds the documents of a stretch of that order: document ids, their numbers of tokens, a
checkpoint of the bit offset for each block of ids, and the bit string. A reader can start at any checkpoint; here all
blocks of a segment are decoded side by side, one table look-up a step. Segments are rows of a Parquet table, so any
file system that Spark writes to holds them.

Defined results: a null text is an empty one, stored as the end id alone; null document ids come first; repeated rows
are stored as often as they come; an empty table gives an empty store; columns besides the two named are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

BLOCK_IDS = 256
SEGMENT_IDS = 1 << 20
#: Documents whose ids are counted together.
COUNTED_AT_ONCE = 256
#: Ids that are coded at a time.
CODED_IDS = 1 << 16
MAGIC = b"HIDS"
_HEAD = struct.Struct("<4sIQQI")  # magic, documents, ids before, ids, ids a block


# --- the code -----------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits (package-merge); 0 where the count is 0."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    n, level, packages = len(leaves), [], np.empty(0)
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        level.append(rank >= n)  # which of the merged list are packages
        merged = both[rank]
        even = len(merged) // 2 * 2
        packages = merged[:even:2] + merged[1:even:2]
    take, out = 2 * n - 2, np.zeros(n, np.int64)
    for is_package in reversed(level):
        packed = int(is_package[:take].sum())
        out[: take - packed] += 1
        take = 2 * packed
    lengths[order] = out
    return lengths


def limit_for(n: int) -> int:
    """Bits that suffice for n different ids with one to spare; decoding tables have two to this power entries."""
    return max(16, (max(n, 2) - 1).bit_length() + 1)


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        sizes = lengths[order].astype(np.int64)
        top = int(sizes[-1])
        # The code of rank k, as a fraction in units of the longest code, is the sum of the shares before it.
        shares = np.left_shift(np.int64(1), top - sizes)
        codes[order] = (np.concatenate([[0], np.cumsum(shares)[:-1]]) >> (top - sizes)).astype(np.uint64)
    return codes


def _bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Words of 64 bits that hold the codes from bit `at` of the first on, the offset of each id's first bit, and the end."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size) + at
    start = end - size
    word, shift = start >> 6, 64 - (start & 63) - size
    code = codes[ids]
    over = np.flatnonzero(shift < 0)
    high = code << np.maximum(shift, 0).astype(np.uint64)
    high[over] = code[over] >> (-shift[over]).astype(np.uint64)
    out = np.zeros((int(end[-1]) + 63) // 64, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.bitwise_or.reduceat(high, first)
    out[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
    return out, start, int(end[-1])


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit string, first bit highest, and the offset of each id's first bit; as many ids at a time as caches hold."""
    out, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for lo in range(0, len(ids), CODED_IDS):
        words, start, end = _bits(ids[lo : lo + CODED_IDS], codes, lengths, at & 63)
        base = at - (at & 63)
        if at & 63:
            out[-1][-1] |= words[0]
            words = words[1:]
        if len(words):
            out.append(words)
        starts.append(start + base)
        at = end + base
    return np.concatenate(out).astype(">u8").tobytes(), np.concatenate(starts)


class Table:
    """For every bit pattern of the longest code's length, the id that it begins with and that code's length."""

    def __init__(self, lengths: np.ndarray):
        self.bits = int(lengths.max(initial=1))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        shares = np.left_shift(1, self.bits - lengths[order].astype(np.int64))
        self.ids = np.zeros(1 << self.bits, np.uint32)
        self.sizes = np.ones(1 << self.bits, np.uint8)
        self.ids[: shares.sum()] = np.repeat(order, shares)
        self.sizes[: shares.sum()] = np.repeat(lengths[order], shares)

    def decode(self, stream: bytes, checkpoints: np.ndarray, n: int, block: int) -> np.ndarray:
        """n ids; each block from its checkpoint, all blocks side by side."""
        data = np.frombuffer(stream + b"\0" * 8, np.uint8).astype(np.uint32)
        window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        at, mask = checkpoints.astype(np.int64), np.uint32((1 << self.bits) - 1)
        out = np.zeros((len(at), block), np.uint32)
        for k in range(block):
            lanes = len(out) - (k >= n - (len(out) - 1) * block)  # the last block may be shorter
            at = at[:lanes]
            if not lanes:
                break
            found = window[at >> 3] >> (32 - self.bits - (at & 7)).astype(np.uint32) & mask
            out[:lanes, k] = self.ids[found]
            at = at + self.sizes[found]
        return out.ravel()[:n]


# --- segments -----------------------------------------------------------------------------------------------------


def segment(docs: list[int | None], sizes: list[int], ids: np.ndarray, before: int, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    stream, start = encode_bits(ids, codes, lengths)
    return b"".join([
        _HEAD.pack(MAGIC, len(docs), before, len(ids), BLOCK_IDS),
        np.array([d is None for d in docs], np.uint8).tobytes(),
        np.array([d or 0 for d in docs], "<i8").tobytes(),
        np.array(sizes, "<u4").tobytes(),
        start[::BLOCK_IDS].astype("<u8").tobytes(),
        stream,
    ])


def read_segment(data: bytes, table: Table):
    """(document id, ids before it in the store, its ids) for each document."""
    magic, n_docs, before, n_ids, block = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    at = _HEAD.size
    null = np.frombuffer(data, np.uint8, n_docs, at)
    docs = np.frombuffer(data, "<i8", n_docs, at := at + n_docs)
    sizes = np.frombuffer(data, "<u4", n_docs, at := at + 8 * n_docs)
    n_blocks = -(-n_ids // block)
    points = np.frombuffer(data, "<u8", n_blocks, at := at + 4 * n_docs)
    ids = table.decode(data[at + 8 * n_blocks :], points, n_ids, block)
    end = np.cumsum(sizes, dtype=np.int64)
    for k in range(n_docs):
        start = int(end[k] - sizes[k])
        yield None if null[k] else int(docs[k]), before + start, ids[start : int(end[k])]


# --- jobs ---------------------------------------------------------------------------------------------------------

_RAW = "part bigint, doc_id bigint, before_in_part bigint, n bigint, ids binary"


def _tokenize(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in tokens.slices(batch, 1):
                ids = list(tokens.encode_documents(rows.column(1).to_pylist(), path, end_id))
                n = np.array([len(x) for x in ids], np.int64)
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                # Two bytes an id where they suffice, told apart by the length.
                data = [(x.astype("<u2") if x.max() < 65536 else x).tobytes() for x in ids]
                yield pa.record_batch([pa.array(np.full(len(n), part)), rows.column(0).cast(pa.int64()), pa.array(starts), pa.array(n), pa.array(data, pa.binary())], ["part", "doc_id", "before_in_part", "n", "ids"])

    return run


def _ids(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, COUNTED_AT_ONCE):
            rows = batch.slice(at, COUNTED_AT_ONCE)
            c = np.bincount(np.concatenate([*map(_ids, rows.column(1).to_pylist(), rows.column(0).to_pylist())]))
            if len(c) > len(total):
                total = np.pad(total, (0, len(c) - len(total)))
            total[: len(c)] += c
    used = np.flatnonzero(total)
    yield pa.record_batch([pa.array(used), pa.array(total[used])], ["id", "n"])


def _encode(lengths: np.ndarray, offsets: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical(lengths)
        docs, sizes, held, total, first, follows = [], [], [], 0, None, None

        def flush():
            part, before = first
            data = segment(docs, sizes, np.concatenate(held), offsets[part] + before, codes, lengths)
            return pa.record_batch([pa.array([offsets[part] + before]), pa.array([data], pa.binary())], ["first_id", "data"])

        for batch in batches:
            for part, doc, before, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                if docs and (follows != (part, before) or total + n > SEGMENT_IDS):
                    yield flush()
                    docs, sizes, held, total = [], [], [], 0
                if not docs:
                    first = part, before
                docs.append(doc)
                sizes.append(n)
                total += n
                held.append(_ids(data, n).astype(np.int64))
                follows = part, before + n
        if docs:
            yield flush()

    return run


def write(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = tokens.END_ID) -> None:
    """Write a store of the ids of df's texts, in ascending order of doc_id, to path/codebook and path/segments."""
    spark = df.sparkSession
    tie = F.xxhash64("text")  # rows of equal id in an order of their own; equal rows may change places
    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("tie", tie).withColumn("row", F.monotonically_increasing_id())
    # The last column lets even an id that very many rows share be split between tasks.
    dealt = source.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")
    raw, raw_path = common.stored(dealt.mapInArrow(_tokenize(tokenizer or tokens.tokenizer_path(), end_id), _RAW), "ids")
    # As many rows as the vocabulary has ids, and as many as there are partitions.
    counted = raw.select("n", "ids").mapInArrow(_count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    offsets, total = {}, 0
    for r in sorted(raw.groupBy("part").agg(F.sum("n").alias("n")).collect(), key=lambda r: r["part"]):
        offsets[r["part"]] = total
        total += r["n"]
    counts = np.zeros(max((r["id"] for r in counted), default=0) + 1, np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, limit_for(len(counted)))
    book = pa.table({"id": pa.array(np.arange(len(lengths))), "bits": pa.array(lengths.astype(np.int32))})
    spark.createDataFrame(book).coalesce(1).write.parquet(f"{path}/codebook")
    coded = raw.select("part", "doc_id", "before_in_part", "n", "ids").mapInArrow(_encode(lengths, offsets), "first_id bigint, data binary")
    coded.write.option("compression", "none").parquet(f"{path}/segments")
    common.discard(spark, raw_path)


def read(spark: SparkSession, path: str, fold=None, schema: str = "doc_id bigint, start bigint, ids array<bigint>") -> DataFrame:
    """A row for each document of a store. fold(doc_id, start, ids) makes the row, by default with all ids."""
    lengths = np.zeros(0, np.uint8)
    if rows := spark.read.parquet(f"{path}/codebook").collect():  # as many rows as the vocabulary
        lengths = np.zeros(max(r["id"] for r in rows) + 1, np.uint8)
        for r in rows:
            lengths[r["id"]] = r["bits"]
    make = fold or (lambda doc, start, ids: (doc, start, ids.tolist()))
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.list_(pa.int64()) if "array" in c else pa.int64() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(lengths)
        for batch in batches:
            for data in batch.column(0):
                rows = [make(*x) for x in read_segment(data.as_py(), table)]
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names)

    return spark.read.schema("first_id bigint, data binary").parquet(f"{path}/segments").select("data").mapInArrow(run, schema)


def _digest(doc, start, ids):
    return doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())


def op3_token_ids(spark, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark)}/idstore-{uuid.uuid4().hex}"
    write(common.table(spark, sf_dir, "documents"), path)
    return read(spark, path, _digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
