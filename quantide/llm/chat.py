"""Preference data from conversations: one prompt, and a chosen and a rejected completion with masks; SQL functions only.

Two conversations with the same beginning are compared turn by turn (role and text). Their longest common prefix of
turns is rendered once, as the prompt; what follows in each is its completion, with the spans of code points that a
model is trained on: the texts of assistant turns with their end mark, not the headers, nor other roles.

Turns are placed by a window over each conversation, which gives every rendered turn its start, so the masks take time
in proportion to the turns. A conversation is one row of the result, and so is what a task holds of it.

Defined results: a null role is "unknown", a null text empty; turns are ordered by number (null first), ties by role and
text, and repeated rows are turns of their own; rows with a null conversation id belong to no conversation and are left
out; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

END = "<|end|>\n"


def _header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _render(turn: Column) -> Column:
    return F.concat(_header(turn["role"]), turn["text"], F.lit(END))


def conversations(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turns: array of (place, role, text, start), start being where the rendered turn begins."""
    own = df.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("unknown")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    size = F.length("role") + F.length("text") + len("<||>\n") + len(END)
    placed = own.withColumn("place", F.row_number().over(order)).withColumn("start", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size)
    return placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text", "start"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many leading turns of two arrays are equal in role and text."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def preference(pairs: DataFrame) -> DataFrame:
    """From (conv_id, chosen, rejected), arrays as conversations() makes them: conv_id, n_common, prompt, chosen,
    chosen_mask, rejected, rejected_mask; masks are arrays of (start, end) within the completion."""
    own = pairs.withColumn("n_common", common_turns(F.col("chosen"), F.col("rejected")))
    head = F.slice("chosen", F.lit(1), F.col("n_common"))
    own = own.withColumn("prompt", F.array_join(F.transform(head, _render), ""))

    def after(side: str) -> Column:
        return F.slice(side, F.col("n_common") + 1, F.size(side))

    def mask(side: str) -> Column:
        trained = F.filter(after(side), lambda x: x["role"] == "assistant")
        at = lambda x: x["start"] - F.length("prompt") + F.length(_header(x["role"]))
        return F.transform(trained, lambda x: F.struct(at(x).alias("start"), (at(x) + F.length(x["text"]) + len(END)).alias("end")))

    sides = [c for s in ("chosen", "rejected") for c in (F.array_join(F.transform(after(s), _render), "").alias(s), mask(s).alias(f"{s}_mask"))]
    return own.select("conv_id", "n_common", "prompt", *sides)


def with_alternative(found: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected): each conversation up to its last answer, and the same with its neighbour's last answer
    instead (ids 2k and 2k+1 are neighbours), or with none where there is no neighbour or no answer."""
    last = F.array_max(F.transform(F.filter("turns", lambda x: x["role"] == "assistant"), lambda x: x["place"]))
    own = found.withColumn("last", F.coalesce(last, F.size("turns") + 1)).withColumn("answer", F.get("turns", F.col("last") - 1)["text"])
    other = own.filter(F.col("answer").isNotNull()).select(F.expr("conv_id ^ 1").alias("conv_id"), F.col("answer").alias("instead"))
    met = own.join(other, "conv_id", "left")
    before = F.slice("turns", F.lit(1), F.col("last") - 1)
    ours = F.get("turns", F.col("last") - 1)
    theirs = F.struct(ours["place"].alias("place"), ours["role"].alias("role"), F.col("instead").alias("text"), ours["start"].alias("start"))
    swapped = F.when(F.col("instead").isNotNull() & F.col("answer").isNotNull(), F.concat(before, F.array(theirs))).otherwise(before)
    return met.select("conv_id", F.slice("turns", F.lit(1), F.col("last")).alias("chosen"), swapped.alias("rejected"))


def op6_preference(spark, sf_dir: str) -> DataFrame:
    made = preference(with_alternative(conversations(common.table(spark, sf_dir, "conversations"))))

    def listed(mask: str) -> Column:
        return F.array_join(F.transform(mask, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias(mask)

    return made.select("conv_id", "n_common", "prompt", "chosen", listed("chosen_mask"), "rejected", listed("rejected_mask"))


ORACLE = """
WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max(place) FILTER (role = 'assistant') AS last, max(place) AS n FROM t GROUP BY conv_id),
a AS (SELECT t.conv_id, t.text FROM t JOIN l ON t.conv_id = l.conv_id AND t.place = l.last),
c AS (SELECT t.conv_id, t.place, t.role, t.text FROM t JOIN l USING (conv_id) WHERE t.place <= coalesce(l.last, l.n)),
r AS (SELECT t.conv_id, t.place, t.role, CASE WHEN t.place = l.last THEN b.text ELSE t.text END AS text
  FROM t JOIN l USING (conv_id) LEFT JOIN a b ON b.conv_id = xor(t.conv_id, 1)
  WHERE t.place < coalesce(l.last, l.n + 1) OR (t.place = l.last AND b.text IS NOT NULL)),
m AS (SELECT c.conv_id, min(c.place) FILTER (r.text IS NULL OR c.role <> r.role OR c.text <> r.text) - 1 AS k, count(*) AS n
  FROM c LEFT JOIN r USING (conv_id, place) GROUP BY c.conv_id),
k AS (SELECT conv_id, coalesce(k, n)::INT AS n_common FROM m),
s AS (SELECT 'c' AS side, * FROM c UNION ALL SELECT 'r', * FROM r),
x AS (SELECT side, conv_id, place, role, text, n_common, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS seg,
    place > n_common AS after FROM s JOIN k USING (conv_id)),
y AS (SELECT *, coalesce(sum(length(seg)) FILTER (after) OVER (PARTITION BY side, conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    + length(role) + 5 AS opens FROM x)
SELECT conv_id, any_value(n_common) AS n_common,
  coalesce(string_agg(seg, '' ORDER BY place) FILTER (side = 'c' AND NOT after), '') AS prompt,
  coalesce(string_agg(seg, '' ORDER BY place) FILTER (side = 'c' AND after), '') AS chosen,
  coalesce(string_agg(opens::BIGINT || ':' || (opens + length(text) + 8)::BIGINT, ',' ORDER BY place) FILTER (side = 'c' AND after AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(seg, '' ORDER BY place) FILTER (side = 'r' AND after), '') AS rejected,
  coalesce(string_agg(opens::BIGINT || ':' || (opens + length(text) + 8)::BIGINT, ',' ORDER BY place) FILTER (side = 'r' AND after AND role = 'assistant'), '') AS rejected_mask
FROM y GROUP BY conv_id
"""
