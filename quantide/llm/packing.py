"""Best-fit packing of token sequences into fixed-length rows, planned on a histogram of lengths.

Every document's ids become one piece or, if it is longer than a row, several: full rows after a first piece that may
be shorter. Best fit runs on the counts of each length (at most as many as a row has places), not on documents; its
plan is a list of runs "these ranks of this length go to these rows at this offset". A piece takes its slot by its rank
within its length: its rank within its task and length, plus the counts of the tasks before. Nothing grows in the driver
or in one task with the number of documents, and a length that a third of all pieces share is ranked in all tasks.

Defined results: a null text is an empty one, with the end id alone; an empty table packs to no rows; repeated rows and
null ids are pieces like any others; columns besides the two named are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokens

CAPACITY = 1024


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, after a first one that may be shorter."""
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit over a histogram, longest first: (length, first rank, ranks, first row, offset) for runs of ranks that go
    to as many consecutive rows. Runs multiply with the number of different lengths only, not with the counts."""
    runs: list[tuple[int, int, int, int, int]] = []
    rows = 0
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free places: (first row, rows)
    free: list[int] = []  # the keys of room that hold rows, sorted

    def give(places: int, first: int, n: int) -> None:
        if places and n:
            if not room[places]:
                bisect.insort(free, places)
            room[places].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            if (at := bisect.bisect_left(free, length)) < len(free):
                places = free[at]
                first, n = room[places].pop()
                if not room[places]:
                    del free[at]
                k = min(n, left)
                runs.append((length, rank, k, first, capacity - places))
                give(places, first + k, n - k)
                give(places - length, first, k)
                rank, left = rank + k, left - k
                continue
            each = capacity // length
            n, per = (left // each, each) if left >= each else (1, left)
            for j in range(per):
                runs.append((length, rank + j * n, n, rows, j * length))
            give(capacity - per * length, rows, n)
            rows, rank, left = rows + n, rank + per * n, left - per * n
    return runs


_PIECES = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType())]
    + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "part", "rank_in_part")]
)


def _pieces(path: str, end_id: int, capacity: int):
    names = _PIECES.fieldNames()
    kinds = [pa.int64(), pa.int32()] + [pa.int64()] * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for piece in tokens.slices(batch, 1):
                out: list[tuple] = []
                texts = piece.column(1).to_pylist()
                for doc, ids in zip(piece.column(0).to_pylist(), tokens.encode_documents(texts, path, end_id)):
                    for k, (start, n) in enumerate(cut(len(ids), capacity)):
                        out.append((doc, k, start, n, zlib.crc32(ids[start : start + n].tobytes()), part, seen[n]))
                        seen[n] += 1
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names)

    return run


def pack(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = tokens.END_ID
) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    path = tokenizer or tokens.tokenizer_path()
    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # Ranks hold for the tasks of one run, so the pieces are written once and everything below reads that table.
    pieces, _ = common.stored(source.mapInArrow(_pieces(path, end_id, capacity), _PIECES), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # At most `capacity` rows.
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots: dict[int, list[np.ndarray]] = {}
    runs = defaultdict(list)
    for length, *rest in plan(counts, capacity):
        runs[length].append(rest)
    for length, of in runs.items():
        slots[length] = list(np.array(sorted(of), np.int64).T)

    def take(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        size, rank = np.asarray(lengths), np.asarray(ranks)
        row, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        for length in np.unique(size):
            mine = size == length
            first_rank, _, first_row, at = slots[int(length)]
            run = np.searchsorted(first_rank, rank[mine], "right") - 1
            row[mine] = first_row[run] + rank[mine] - first_rank[run]
            offset[mine] = at[run]
        return pa.StructArray.from_arrays([pa.array(row), pa.array(offset)], ["sequence_id", "offset"])

    slot = F.arrow_udf(take, "struct<sequence_id:bigint,offset:bigint>")
    ranked = pieces.join(base, ["length", "part"]).withColumn("slot", slot("length", F.col("base") + F.col("rank_in_part")))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "slot.sequence_id", "slot.offset")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
