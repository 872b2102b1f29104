"""Benchmark decontamination: items whose word shingles a document contains to the threshold or more, by SQL functions only.

Both sides become distinct shingles of five words (letters and digits, lower case); an item of fewer words is one shingle,
all its words, and looked for among as many words in a row. Items are partitioned by size, classes of a power of two
shingles each with its own depth: the sketch of an item is the min-hashes of as many of its shingles as the largest item
of the class may miss at the threshold, and one more. A document that contains an item holds one of them at least, so the
search loses nothing, for documents of any length: a MinHash signature of a long document itself would hardly ever share
a value with a short item. Min-hashes are taken in order of how many items have the shingle, then by hash, so that
phrases which many items share lead to few candidates.

Documents meet the sketches in a hash join; a candidate pair is verified by the shingles' own words, counted exactly, and
only the item's own shingles meet the document's: nothing grows with documents times items. Candidates are stored; where
their number is below BROADCAST_ROWS they are broadcast to find their documents, so that no text moves, otherwise the
texts are shuffled once. The sketches are broadcast only where Spark finds them small.

Defined results: a null text has no words and matches nothing, an item without words likewise; of repeated rows of one id
each counts for itself and the largest count holds; an empty table on either side gives an empty result; rows with a null
id are documents too (one id, null); other columns are not read.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
THRESHOLD = 0.8
#: Candidate pairs up to which their ids (some 30 bytes a pair) are broadcast; beyond, texts are shuffled.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(found, lambda w: w != "")


def shingles(of: Column, n: int, join) -> Column:
    """join(word, word, ...) for each n words in a row."""
    last = F.size(of) - (n - 1)
    at = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: join(*(F.get(of, i + (k - 1)) for k in range(n))))


def _in_words(*w: Column) -> Column:
    return F.concat_ws(" ", *w)


def _of_lengths(of: Column, lengths: list[int], join) -> Column:
    return F.concat(*(shingles(of, n, join) for n in lengths))


def _needed(n: Column, threshold: float) -> Column:
    """The least whole number that is threshold of n or more (with room for the product's rounding)."""
    return F.ceil(n * F.lit(threshold) - 1e-9).cast("long")


def _sketched(items: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """From (item_id, shingle), each once: (item_id, n_shingles) and the sketches, (item_id, h)."""
    spread = items.groupBy("shingle").agg(F.count("*").alias("spread"))
    ranked = F.sort_array(F.collect_list(F.struct("spread", F.xxhash64("shingle").alias("h"))))
    own = items.join(spread, "shingle").groupBy("item_id").agg(F.count("*").alias("n_shingles"), ranked.alias("ranked"))
    # The largest item of a class of sizes, 2 ** k up to 2 ** (k + 1) - 1, sets the depth of all of them.
    most = F.pow(F.lit(2.0), F.floor(F.log2("n_shingles")) + 1) - 1
    depth = (most - _needed(most, threshold) + 1).cast("int")
    sketch = own.select("item_id", F.explode(F.slice("ranked", F.lit(1), F.least(depth, F.size("ranked")))).alias("s")).select("item_id", "s.h")
    return own.select("item_id", "n_shingles"), sketch


def contained(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    threshold: float = THRESHOLD, shingle: int = SHINGLE, keys: tuple[str, ...] = (), broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(doc_id, *keys, item_id, n_shared, n_shingles, containment) for items contained to the threshold. keys: further
    columns that tell documents of one id apart."""
    worded = items.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("w")).filter(F.size("w") > 0)
    short = [F.when(F.size("w") == n, shingles(F.col("w"), n, _in_words)) for n in range(1, shingle)]
    each = F.coalesce(*short, shingles(F.col("w"), shingle, _in_words))
    # Items come once for each id, with all shingles of its rows.
    own_items, _ = common.stored(worded.select("item_id", F.explode(F.array_distinct(each)).alias("shingle")).distinct(), "items")
    # The lengths that items have: five words, and mostly no other.
    lengths = sorted(r["n"] for r in worded.select(F.least(F.size("w"), F.lit(shingle)).alias("n")).distinct().collect()) or [shingle]
    sizes, sketch = _sketched(own_items, threshold)
    hashed = lambda *w: F.xxhash64(F.concat_ws(" ", *w))
    ids = ("doc_id", *keys)
    source = docs.select(F.col(doc_id).alias("doc_id"), *keys, F.col(text).alias("text"))
    met = source.withColumn("w", words(F.col("text"))).select(*ids, F.explode(_of_lengths(F.col("w"), lengths, hashed)).alias("h"))
    candidates, _ = common.stored(met.join(sketch, "h").select(*ids, "item_id").distinct(), "candidates")
    few = candidates.limit(broadcast_rows + 1).count() <= broadcast_rows
    other = {c: common.free_name(source, f"_met_{c}") for c in ids}
    named = candidates.withColumnsRenamed(other)
    found = named.select(*other.values()).distinct()
    same = functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.col(o)) for c, o in other.items()))
    texts = source.join(F.broadcast(found) if few else found, same, "left_semi")
    theirs = texts.withColumn("w", words(F.col("text"))).select(*ids, F.explode(F.array_distinct(_of_lengths(F.col("w"), lengths, _in_words))).alias("shingle"))
    wanted = named.join(own_items.withColumnRenamed("shingle", "_wanted"), "item_id")
    pairs = theirs.join(wanted, same & (F.col("shingle") == F.col("_wanted"))).groupBy(*ids, "item_id")
    shared = pairs.agg(F.count("*").alias("n_shared")).join(sizes, "item_id").filter(F.col("n_shared") >= _needed(F.col("n_shingles"), threshold))
    return shared.select(*ids, "item_id", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that contain an item; each row by its own text, whatever its id."""
    mark = common.free_name(docs, "_text_hash")
    marked = docs.withColumn(mark, F.xxhash64(text))
    hit = contained(marked, items, doc_id, text, keys=(mark,)).select(F.col("doc_id").alias("_hit"), F.col(mark).alias("_hit_text")).distinct()
    gone = marked[doc_id].eqNullSafe(hit["_hit"]) & (marked[mark] == hit["_hit_text"])
    return marked.join(hit, gone, "left_anti").select(*docs.columns)


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contained(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_shingles", "containment")


#: The same by exact shingles alone; ids are not repeated in the tables.
ORACLE = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
k AS (SELECT DISTINCT least(len(w), 5) AS k FROM iw WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS s FROM dw, k),
its AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i+least(len(w), 5)-1], ' '))) AS s FROM iw WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_shingles FROM its GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, n_shingles, count(*) / n_shingles::DOUBLE AS containment
FROM ds JOIN its USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= ceil(n_shingles * 0.8 - 1e-9)
"""
