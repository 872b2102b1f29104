"""SimHash near-duplicates: fingerprints of word shingles, linked at a small Hamming distance, joined into components.

Candidates: with radius 3 and five bands of 12 or 13 bits, two fingerprints within the radius agree on two bands at
least, so each different fingerprint goes to ten buckets, one for each pair of bands. Within a bucket the comparison is
bit-sliced: 64 fingerprints form a block whose bit planes are stored vertically, one word a plane; a fingerprint's
distances to a whole block are counted in two carry-save bit counters and an overflow word, plane by plane, and blocks
in which every lane has passed the radius are abandoned. A bucket yields a spanning forest of its links, not the links.
Buckets of more than TILE fingerprints are dealt anew by four parts of the bits that they don't share; what is larger than
TILE even so is cut into tiles, and each pair of tiles is a bucket of its own in any task, so no bucket has to be held or
compared whole. Only there, where thousands agree on all but some 28 bits, do copies grow with a bucket. Components then come from alternating star contractions as joins.

Defined results: null and empty texts, and those of white space only, have fingerprint zero, linked like any other;
repeated rows come out as often as they came, with equal values; a null id counts for a component's smallest id only
where the component has no other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Bands as (first bit, bits); one more than the radius, plus one.
BANDS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
TILE = 4096
#: Bits of a part of the 38 or 39 that a bucket's fingerprints don't share; RADIUS + 1 parts.
PART_BITS = 10
#: Pairs of a fingerprint and a block that are compared at a time.
WORK = 1 << 15
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    from xxhash import xxh64_intdigest as digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return digest(b" ".join(words), seed)
    n = len(words) - shingle + 1
    hashes = np.fromiter((digest(b" ".join(s), seed) for s in zip(*(words[k:] for k in range(shingle)))), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        bits = np.unpackbits(hashes[at : at + HASHES_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64))


def with_fingerprint(df: DataFrame, text: str, to: str) -> DataFrame:
    return df.withColumn(to, F.arrow_udf(_fingerprints, "bigint")(text))


# --- links within buckets -------------------------------------------------------------------------------------------


def _planes(prints: np.ndarray) -> np.ndarray:
    """(blocks, 64) words from (blocks, 64) fingerprints: bit l of word b is bit b of the block's fingerprint l."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), 64, 8), axis=2, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.transpose(0, 2, 1)), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8").reshape(len(prints), 64)


def near_lanes(query: np.ndarray, block: np.ndarray, planes: np.ndarray, valid: np.ndarray, radius: int = RADIUS):
    """For work items (fingerprint, block) those with lanes within the radius (3 or less): (item, word of lanes)."""
    item = np.arange(len(query))
    ones, twos, over = (np.zeros(len(query), np.uint64) for _ in range(3))
    over |= ~valid[block]
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for b in range(64):
        differ = planes[block, b] ^ (np.uint64(0) - ((query >> np.uint64(b)) & np.uint64(1)))
        carry = ones & differ
        ones ^= differ
        over |= twos & carry
        twos ^= carry
        if b % 8 == 7:
            live = over != full
            if not live.all():
                item, query, block, ones, twos, over = (x[live] for x in (item, query, block, ones, twos, over))
            if not len(item):
                break
    within = ~over
    if radius < 3:
        within &= ~twos if radius < 2 else ~(twos & ones)
        within &= ~ones if radius < 1 else full
    return item, within


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the labels (smallest member) of linked positions."""
    while len(a):
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        open_ = low != high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(label, high, low)
        while not np.array_equal(label, label[label]):
            label[:] = label[label]


def forest(bucket: np.ndarray, prints: np.ndarray, side: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Rows sorted by bucket: for each position the smallest position that it is linked with, over any number of steps,
    within its bucket. side: 0 for both; buckets that hold two tiles compare tile 1 with tile 2 only."""
    label = np.arange(len(prints))
    start = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - 1)) if len(bucket) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(bucket)))
    start, size = start[size > 1], size[size > 1]
    if not len(start):
        return label
    # Blocks of up to 64 positions of one bucket.
    of_bucket = -(-size // 64)
    first = np.repeat(start - 64 * (np.cumsum(of_bucket) - of_bucket), of_bucket) + 64 * np.arange(of_bucket.sum())
    end = np.repeat(start + size, of_bucket)
    place = first[:, None] + np.arange(64)
    inside = place < end[:, None]
    planes = _planes(prints[np.where(inside, place, first[:, None])])
    valid = np.packbits(inside, axis=1, bitorder="little").view("<u8").ravel()
    # Each position of a bucket meets the blocks from its own on.
    block0 = np.cumsum(of_bucket) - of_bucket
    own = np.repeat(block0, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)) // 64
    position = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    meets = np.repeat(block0 + of_bucket, size) - own
    ends = np.cumsum(meets)
    for lo in range(0, int(ends[-1]), WORK):
        hi = min(lo + WORK, int(ends[-1]))
        w = np.arange(lo, hi)
        k = np.searchsorted(ends, w, "right")
        block = own[k] + w - (ends[k] - meets[k])
        item, lanes = near_lanes(prints[position[k]], block, planes, valid, radius)
        hit, lane = np.nonzero(np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        a, b = position[k[item[hit]]], place[block[item[hit]], lane]
        linked = (a < b) & ((side[a] != side[b]) | (side[a] == 0))
        _merge(label, a[linked], b[linked])
    return label


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by bucket: (fingerprint, smallest position's fingerprint) of a forest of each bucket."""
    held: list[np.ndarray] = []

    def done(rows: np.ndarray):
        prints = rows[1].view(np.uint64)
        label = forest(rows[0], prints, rows[2])
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.record_batch([pa.array(rows[1][moved]), pa.array(rows[1][label[moved]])], ["a", "b"])

    for batch in batches:
        rows = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns])
        if not rows.shape[1]:
            continue
        held.append(rows)
        cut = np.flatnonzero(rows[0] != rows[0][-1])
        if len(cut):  # the last bucket may go on in the next batch
            whole = np.concatenate(held, axis=1)
            at = whole.shape[1] - (rows.shape[1] - cut[-1] - 1)
            yield done(whole[:, :at])
            held = [whole[:, at:]]
    if held:
        yield done(np.concatenate(held, axis=1))


def links(prints: DataFrame, tile: int = TILE) -> DataFrame:
    """(a, b): links between different fingerprints (column `print`, each once) that keep every component of them."""
    band = [F.shiftrightunsigned("print", p).bitwiseAND((1 << m) - 1) for p, m in BANDS]
    keys = []
    for t, pair in enumerate(combinations(range(len(BANDS)), 2)):
        key, rest = F.lit(t), F.lit(0).cast("long")
        for k, (_, m) in enumerate(BANDS):
            if k in pair:
                key = key * (1 << m) + band[k]
            else:
                rest = rest * (1 << m) + band[k]
        keys.append(F.struct(key.alias("key"), rest.alias("rest")))
    dealt = prints.select("print", F.explode(F.array(*keys)).alias("k")).select("print", "k.*")
    # At most one row for each `tile` rows, and mostly none: the joins are broadcasts where Spark finds them small. The
    # other bits of a large bucket's fingerprints are cut into one part more than the radius, so that two within the
    # radius agree on a part: such a fingerprint goes to a bucket for each part instead.
    large = dealt.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > tile).select("key", F.lit(True).alias("large"))
    parts = F.array(*(F.xxhash64("key", F.lit(k), F.shiftrightunsigned("rest", PART_BITS * k).bitwiseAND((1 << PART_BITS) - 1)) for k in range(RADIUS + 1)))
    dealt = dealt.join(large, "key", "left").select("print", "large", F.explode(F.when(F.col("large"), parts).otherwise(F.array("key"))).alias("key"))
    # What is large even so is cut into tiles.
    large = dealt.filter("large").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > tile).select("key", F.ceil(F.col("n") / tile).alias("tiles"))
    sized = dealt.join(large, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("print"), F.col("tiles"))
    others = F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)
    split = sized.withColumn("own", own).withColumn("other", F.explode(others))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    bucket = F.when(F.col("tiles") == 1, F.col("key")).otherwise(F.xxhash64("key", low, high))
    side = F.when(low == high, 0).when(F.col("own") == low, 1).otherwise(2)
    rows = split.select(bucket.alias("bucket"), "print", side.alias("side"))
    return rows.repartition("bucket").sortWithinPartitions("bucket", "print").mapInArrow(_links, "a bigint, b bigint")


# --- components -----------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component, for every node of the edges (a, b) but the roots.

    Alternating large and small stars, each a min by node and a join back; every round is written to the shared folder,
    which cuts the lineage. Ends when a round changes nothing.
    """
    spark = edges.sparkSession

    def canonical(e: DataFrame) -> DataFrame:
        return e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now, path = common.stored(canonical(edges), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = canonical(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after, new_path = common.stored(canonical(small), "edges")
        # Sums of hashes tell whether two rounds have the same edges.
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        common.discard(spark, path)
        now, path = after, new_path
        if mark == before or mark[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark


def classes(prints: DataFrame) -> DataFrame:
    """From (print, doc_id) rows: for each different print the root print of its component, which tells components apart
    where ids are null or repeat, and the component's smallest doc_id."""
    each = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    joined = components(links(each.select("print")))
    rooted = each.join(joined.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("print", "root", "component_id")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row: doc_id, print (64 bits, signed), component_id."""
    source = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints, _ = common.stored(with_fingerprint(source, "text", "print").select("doc_id", "print"), "prints")
    return prints.join(classes(prints), "print").select("doc_id", "print", "component_id")


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that of the smallest id (null ids last), of repeated rows any one.

    The rows are written once with their fingerprint and a number, so that each text is read by Python once and shuffled
    once, in the join with the numbers that stay.
    """
    mark, number = common.free_name(df, "_print"), common.free_name(df, "_number")
    marked, _ = common.stored(with_fingerprint(df, text, mark).withColumn(number, F.monotonically_increasing_id()), "marked")
    prints = marked.select(F.col(doc_id).alias("doc_id"), F.col(mark).alias("print"), F.col(number).alias("number"))
    # Copies meet as minima, which are combined before they move.
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "number")
    first = prints.groupBy("print").agg(F.min(key).alias("k")).join(classes(prints.select("print", "doc_id")), "print")
    kept = first.groupBy("root").agg(F.min("k").alias("k")).select(F.col("k.number").alias(number))
    return marked.join(kept, number, "left_semi").select(*df.columns)


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
