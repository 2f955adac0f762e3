"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions.

Both sides come as rows (pair_id, turn, role, text). Rows with one turn number in one conversation follow each other by role and text;
a null turn comes first. The prompt is the longest common prefix of turns: all turns before the first place where role or text differ
or one side has ended. Text and role are compared by MD5 digest, null as such. The prompt is rendered once for a pair, from the
chosen side; what follows is the chosen and the rejected completion.

The output has one row for each turn, as a conversation may be of any length: ``pair_id``, ``part`` (prompt, chosen, rejected),
``turn``, ``place`` among rows of that turn, ``role``, ``segment`` (the rendered turn), and ``train``, the mask: true for assistant turns of
the completions only. Segments in order of (turn, place) make up the prompt and the completions. A pair whose sides are equal has a prompt
and no completions; one that exists on one side only has no prompt. Rows without a pair id belong to no conversation and are left out.

Common turns are found by one aggregation over (pair, turn, place), and the first difference of a pair by a minimum, both combined
before the shuffle; no conversation is collected into a row or a task. Repeated rows count as further rows of their turn. Other
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girthline.llm.store import Store


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n<|end|>\n"))


def _placed(side: DataFrame) -> DataFrame:
    rows = side.where("pair_id IS NOT NULL").select("pair_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("pair_id", "turn").orderBy("role", "text")))


def preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of prompts and masked completions."""
    a, b = _placed(chosen), _placed(rejected)
    digest = F.md5(F.concat_ws("|", F.coalesce(F.md5("role"), F.lit("-")), F.coalesce(F.md5("text"), F.lit("-"))))
    both = a.select("pair_id", "turn", "place", digest.alias("d")).union(b.select("pair_id", "turn", "place", digest))
    unlike = both.groupBy("pair_id", "turn", "place").agg(F.count("*").alias("n"), F.min("d").alias("x"), F.max("d").alias("y")).where("n < 2 OR x <> y")
    # Turn numbers from -2^63 up, null before them.
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "place")
    first = unlike.groupBy("pair_id").agg(F.min(at).alias("first"))
    later = F.col("first").isNotNull() & (F.struct(F.col("turn").isNotNull().alias("known"), "turn", "place") >= F.col("first"))
    left = a.join(first, "pair_id", "left").withColumn("part", F.when(later, "chosen").otherwise("prompt"))
    right = b.join(first, "pair_id", "left").where(later).withColumn("part", F.lit("rejected"))
    return left.unionByName(right).select(
        "pair_id", "part", "turn", "place", "role", rendered(F.col("role"), F.col("text")).alias("segment"),
        ((F.col("part") != "prompt") & F.coalesce(F.col("role") == "assistant", F.lit(False))).alias("train"),
    )


def _following(ids: DataFrame, store: Store) -> DataFrame:
    """``conv_id, following``: the next larger id, and the smallest one after the largest. Ids may have gaps; no task sees all of them."""
    placed = store.keep(ids.orderBy("conv_id").withColumn("at", F.monotonically_increasing_id()))
    # One row for each partition of the sorted ids.
    part = F.shiftrightunsigned("at", 33)
    ends = placed.groupBy(part.alias("part")).agg(F.max("at").alias("at"), F.min("conv_id").alias("first"))
    by_part = Window.orderBy("part")
    after = ends.select("at", F.coalesce(F.lead("first").over(by_part), F.min("first").over(by_part)).alias("first"))
    inside = placed.select((F.col("at") - 1).alias("at"), F.col("conv_id").alias("following"))
    found = placed.join(inside, "at", "left").join(after, "at", "left")
    return found.select("conv_id", F.coalesce("following", "first").alias("following")).where("conv_id <> following")


def swapped_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides out of plain conversations. A conversation is chosen; the rejected side is made from it with the last assistant turn
    of the next conversation that has one (the first follows the last). By the id's remainder by three that text stands in place of its own last
    assistant turn (0, and without a whole number as id), or of its first one (1), or the rejected side ends before its last assistant turn (2).
    Conversations without an assistant turn make no pair, nor does a single one."""
    store = Store(conversations.sparkSession)
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text")
    reply = rows.where("role = 'assistant' AND turn IS NOT NULL").groupBy("conv_id")
    ends = store.keep(reply.agg(F.max(F.struct("turn", "text")).alias("m"), F.min("turn").alias("first")).select("conv_id", "m.turn", "m.text", "first"))
    pairs = ends.select(F.col("conv_id").alias("pair_id"), F.col("turn").alias("last"), F.col("first").alias("early")).join(
        _following(ends.select("conv_id"), store).withColumnRenamed("conv_id", "pair_id"), "pair_id")
    pairs = pairs.join(ends.select(F.col("conv_id").alias("following"), F.col("text").alias("other")), "following").drop("following")
    sides = rows.withColumnRenamed("conv_id", "pair_id").join(pairs, "pair_id")
    kind = F.coalesce(F.pmod(F.col("pair_id").try_cast("bigint"), F.lit(3)), F.lit(0))
    at = F.when(kind == 1, F.col("early")).otherwise(F.col("last"))
    swap = F.when((kind != 2) & (F.col("turn") == at) & (F.col("role") == "assistant"), F.col("other")).otherwise(F.col("text"))
    names = ("pair_id", "turn", "role")
    left = sides.where((kind != 2) | F.col("turn").isNull() | (F.col("turn") < F.col("last")))
    return sides.select(*names, "text"), left.select(*names, swap.alias("text"))
