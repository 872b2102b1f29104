"""Near copies by exact Jaccard similarity: texts whose sets of five-word shingles share THRESHOLD or more of their union.

Candidates come from SimHash and min-hashes. The fingerprints of `simhash`, by op5's rule, are linked at three differing
bits, and each of their components is a key of its texts. Texts at the threshold differ in some ten bits, so there are
BANDS keys of ROWS min-hashes each as well; of two sets at the threshold itself all these differ with a chance of
(1 - 0.8 ** 6) ** 40, 5e-6, of closer sets with less. Texts of equal sets are one node. Nodes that share a key are
joined into groups, so that each text moves once, to its group, whatever the number of keys that it shares. Within a
group all pairs are compared by their sets, from counts of shared shingles in an inverted index, and only links that hold
go on into components. Groups of more than TILE nodes are cut into tiles, and each pair of tiles is compared in any task.

Shingles are 64-bit hashes of five words in a row (A-Z in lower case, split at ASCII white space); a shorter text has one
shingle, all its words; null, empty and blank texts have none and equal each other. Of repeated rows and of each group
of near copies one row stays; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

SHINGLE = 5
#: The threshold as a fraction, for whole numbers only.
SHARED, OF = 4, 5
BANDS, ROWS = 40, 6
SEED = 42
TILE = 512
#: Shingles that are hashed, and postings that are counted, at a time.
HASHED, COUNTED = 1 << 16, 1 << 22

_MIX = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = np.random.default_rng(SEED).integers(0, 1 << 32, (2, BANDS * ROWS), np.uint32)
_XOR, _TIMES = _RANDOM[0], _RANDOM[1] | np.uint32(1)


def shingles(text: str | None) -> np.ndarray:
    """The hashes of a text's shingles, each once, sorted."""
    from xxhash import xxh64_intdigest as digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    own = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    out = own[:n].copy()
    for k in range(1, SHINGLE):
        out ^= out >> np.uint64(32)
        out *= _MIX
        out += own[k : k + n]
    out ^= out >> np.uint64(32)
    out *= _MIX
    return np.unique(out)


def keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each set; none may be empty."""
    least = np.empty((BANDS * ROWS, len(sets)), np.uint32)
    size = np.array([len(s) for s in sets])
    part = np.cumsum(size) // HASHED
    for p in np.unique(part):
        mine = np.flatnonzero(part == p)
        h = (np.concatenate([sets[k] for k in mine]) >> np.uint64(32)).astype(np.uint32)
        start = np.cumsum(size[mine]) - size[mine]
        for k in range(BANDS * ROWS):
            v = h ^ _XOR[k]
            v *= _TIMES[k]
            least[k, mine] = np.minimum.reduceat(v, start)
    rows = least.reshape(BANDS, ROWS, len(sets)).astype(np.uint64)
    out = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(sets), axis=1) * _MIX
    for k in range(ROWS):
        out ^= rows[:, k]
        out *= _MIX
        out ^= out >> np.uint64(32)
    return out.T


_SKETCH = pa.struct([("print", pa.int64()), ("keys", pa.list_(pa.int64()))])


def _sketches(texts: pa.Array) -> pa.Array:
    """The hash of each text's set, which stands for the set, and its keys."""
    from xxhash import xxh64_intdigest as digest

    sets = [shingles(t) for t in texts.to_pylist()]
    prints = np.array([digest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
    some = [s for s in sets if len(s)]
    flat = keys(some).reshape(-1).view(np.int64) if some else np.zeros(0, np.int64)
    ends = np.cumsum([0, *(BANDS * (len(s) > 0) for s in sets)], dtype=np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
    return pa.StructArray.from_arrays([pa.array(prints), lists], fields=list(_SKETCH))


_MARK = pa.struct([*_SKETCH, ("fingerprint", pa.int64())])


def _marks(texts: pa.Array) -> pa.Array:
    """Sketches with SimHash fingerprints."""
    return pa.StructArray.from_arrays([*_sketches(texts).flatten(), simhash._fingerprints(texts)], fields=list(_MARK))


def linked(sets: list[np.ndarray], side: np.ndarray) -> np.ndarray:
    """For each set the first one that it is linked with over any number of steps. side: 0 for all pairs; sets of tiles
    1 and 2 are compared across only."""
    n = len(sets)
    label, size = np.arange(n), np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)[np.argsort(code, kind="stable")]
    many = np.bincount(code)
    first = np.cumsum(many) - many
    at = np.cumsum(size) - size
    for k in range(n - 1):
        own = code[at[k] : at[k] + size[k]]
        own = own[many[own] > 1]
        shared = np.zeros(n, np.int64)
        step = max(1, COUNTED // n)
        for lo in range(0, len(own), step):
            c = own[lo : lo + step]
            m = many[c]
            place = np.repeat(first[c] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            shared += np.bincount(owner[place], minlength=n)
        # shared / (a + b - shared) >= SHARED / OF
        near = (OF + SHARED) * shared >= SHARED * (size[k] + size)
        near &= (side != side[k]) | (side[k] == 0)
        b = np.flatnonzero(near[k + 1 :]) + k + 1
        b = b[label[b] != label[k]]
        simhash._merge(label, np.full(len(b), k), b)
    return label


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (bucket, print, side, text) sorted by bucket: (print, print of the first linked) within each bucket."""
    bucket, prints, sides, sets = None, [], [], []

    def done():
        if len(sets) < 2:
            return []
        label = linked(sets, np.array(sides)).tolist()
        return [(p, prints[k]) for p, k in zip(prints, label) if p != prints[k]]

    for batch in batches:
        out = []
        for key, p, s, text in zip(*(c.to_pylist() for c in batch.columns)):
            if key != bucket:
                out += done()
                bucket, prints, sides, sets = key, [], [], []
            prints.append(p)
            sides.append(s)
            sets.append(shingles(text))
        yield pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
    out = done()
    yield pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])


def simhash_keys(prints: DataFrame) -> DataFrame:
    """(print, key) from (print, fingerprint): a key for each component of the fingerprints that SimHash links."""
    prints, _ = common.stored(prints.distinct(), "fingerprints")
    roots = simhash.components(simhash.links(prints.select(F.col("fingerprint").alias("print")).distinct()))
    rooted = prints.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    return rooted.select("print", F.xxhash64(F.lit("simhash"), F.coalesce("root", "fingerprint")).alias("key"))


def links(nodes: DataFrame, texts: DataFrame, tile: int = TILE, more: DataFrame | None = None) -> DataFrame:
    """(a, b): links between different sets that keep every component of them. nodes: (print, number, keys), each print
    once; texts: (number, text); more: further keys of nodes, (print, key)."""
    dealt = nodes.select("print", F.explode("keys").alias("key"))
    if more is not None:
        dealt = dealt.unionByName(more)
    met = dealt.groupBy("key").agg(F.min("print").alias("b"), F.max("print").alias("most")).filter("b <> most")
    star = dealt.join(met, "key").select(F.col("print").alias("a"), "b")
    groups, _ = common.stored(simhash.components(star), "groups")
    members = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    tiles = groups.groupBy("root").agg(F.ceil((F.count("*") + 1) / tile).alias("tiles"))
    sized = members.join(tiles, "root").join(nodes.select(F.col("print").alias("node"), "number"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("tiles"))
    whole = sized.withColumn("own", own).join(texts, "number")
    split = whole.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    bucket = F.when(F.col("tiles") == 1, F.col("root")).otherwise(F.xxhash64("root", low, high))
    side = F.when(low == high, 0).when(F.col("own") == low, 1).otherwise(2)
    rows = split.select(bucket.alias("bucket"), F.col("node").alias("print"), side.alias("side"), "text")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "print").mapInArrow(_verified, "a bigint, b bigint")


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies: that of the smallest id (null ids last), of repeated rows any one."""
    mark, number = common.free_name(df, "_sketch"), common.free_name(df, "_number")
    sketch = F.arrow_udf(_marks, "struct<print:bigint,keys:array<bigint>,fingerprint:bigint>")(text)
    marked, _ = common.stored(df.withColumn(mark, sketch).withColumn(number, F.monotonically_increasing_id()), "marked")
    rows = marked.select(F.col(doc_id).alias("doc_id"), f"{mark}.print", f"{mark}.keys", F.col(number).alias("number"))
    # Copies meet as minima, which are combined before they move.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "number")).alias("k")
    each, _ = common.stored(rows.groupBy("print").agg(first, F.first("keys").alias("keys")), "sets")
    more = simhash_keys(marked.filter(F.size(f"{mark}.keys") > 0).select(f"{mark}.print", f"{mark}.fingerprint"))
    found = links(each.select("print", "k.number", "keys"), marked.select(F.col(number).alias("number"), F.col(text).alias("text")), more=more)
    roots = simhash.components(found).withColumnRenamed("node", "print")
    rooted = each.select("print", "k").join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    kept = rooted.groupBy("root").agg(F.min("k").alias("k")).select(F.col("k.number").alias(number))
    return marked.join(kept, number, "left_semi").select(*df.columns)
