"""Benchmark decontamination: short test items found inside long documents.

A set holds the distinct five-word shingles of a text (words are runs of letters, digits and characters beyond ASCII, A-Z
lowered; fewer than five words make one shingle, which only a document of the same words has; no words or a null text make an
empty set, which nothing contains). An item is found in a document if the document holds at least ``percent`` / 100 of its set.

Signatures of equal length fail here, as a document of twenty thousand words and an item of thirty have a Jaccard similarity
near zero. So items are partitioned by set size into classes of powers of two. Each class keeps the bottom-k MinHash sketch of
its items, k being one more than the shingles that the largest item of the class may lack; a document that contains an item
holds at least one value of its sketch (pigeonhole), so no item is lost. A document looks its shingles up in the sketches of
those classes whose least item it could contain, and the candidates are verified on the whole set of the item.

The items' sets go to the tasks if their count shows at most ``BROADCAST_SHINGLES`` values; a document is then judged in its
row, without a shuffle. A larger benchmark takes the same two steps as joins of exploded shingles.

Repeated documents and repeated items each give their rows. Ids may be null. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from girthline.llm import bytewords as B
from girthline.session import cut

#: 16 MB of hashes.
BROADCAST_SHINGLES = 2_000_000

FOUND = T.ArrayType(T.StructType([T.StructField("item", T.LongType()), T.StructField("n_shared", T.LongType())]))


@F.arrow_udf(T.ArrayType(T.LongType()))
def shingles(text: pa.Array) -> pa.Array:
    return B.lists([x.view(np.int64) for x in B.shingle_sets(text, B.ALPHANUMERIC)], pa.int64())


def least(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` must find again."""
    return -(-n * percent // 100)


def sketch_length(n: int, percent: int) -> int:
    """Values kept of an item of ``n`` shingles: enough for the largest set of its size class."""
    top = (1 << n.bit_length()) - 1
    return top - least(top, percent) + 1


class Index:
    """Sketches of the items by size class, with their sets for the verification."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.sets, self.percent, self.classes = sets, percent, []
        by_class: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            if len(s):
                by_class.setdefault(len(s).bit_length(), []).append(i)
        for k, members in sorted(by_class.items()):
            kept = [sets[i][:sketch_length(len(sets[i]), percent)] for i in members]
            values = np.concatenate(kept)
            order = np.argsort(values, kind="stable")
            owners = np.repeat(members, [len(x) for x in kept])
            self.classes.append((min(least(len(sets[i]), percent) for i in members), values[order], owners[order]))

    def find(self, document: np.ndarray) -> list[tuple[int, int]]:
        found = []
        for smallest, values, owners in self.classes:
            if len(document) < smallest:
                continue
            at, past = np.searchsorted(values, document, "left"), np.searchsorted(values, document, "right")
            hit = np.flatnonzero(past > at)
            for i in sorted({int(o) for a, b in zip(at[hit], past[hit]) for o in owners[a:b]}):
                item = self.sets[i]
                spot = np.minimum(np.searchsorted(document, item), len(document) - 1)
                shared = int((document[spot] == item).sum())
                if shared * 100 >= len(item) * self.percent:
                    found.append((i, shared))
        return found


def _finder(index: Index):
    @F.arrow_udf(FOUND)
    def find(text: pa.Array) -> pa.Array:
        return pa.array(
            [[{"item": i, "n_shared": s} for i, s in index.find(x)] for x in B.shingle_sets(text, B.ALPHANUMERIC)],
            pa.list_(pa.struct([("item", pa.int64()), ("n_shared", pa.int64())])),
        )

    return find


def _items(items: DataFrame, item_id: str, text: str) -> tuple[DataFrame, int]:
    """Items with their sets and a running number, and the count of all their shingles."""
    made = cut(items.select(F.col(item_id).alias("item_id"), shingles(text).alias("s")).withColumn("item", F.monotonically_increasing_id()))
    return made, int(made.agg(F.sum(F.size("s"))).first()[0] or 0)


def _row_local(made: DataFrame, percent: int) -> tuple[DataFrame, "Column"]:
    rows = made.select("item", "s").orderBy("item").collect()  # at most BROADCAST_SHINGLES values
    sets = [np.sort(np.array(r.s, np.int64).view(np.uint64)) for r in rows]
    numbers = [(i, r.item, len(r.s)) for i, r in enumerate(rows)]
    names = made.sparkSession.createDataFrame(numbers, "number long, item long, n_item long").join(made.select("item", "item_id"), "item")
    return names, _finder(Index(sets, percent))


def _by_join(texts: DataFrame, made: DataFrame, percent: int) -> DataFrame:
    size = made.select("item", "item_id", F.size("s").cast("long").alias("n_item"), "s")
    top = F.expr("CAST(pow(2, floor(log2(n_item)) + 1) AS BIGINT) - 1")
    k = (top - F.ceil(top * percent / 100) + 1).cast("int")
    # Hashes count as unsigned for "smallest"; any fixed order serves, here the signed one.
    kept = size.where("n_item > 0").select("item", "n_item", F.explode(F.slice(F.sort_array("s"), F.lit(1), F.least(k, F.size("s")))).alias("v"))
    exploded = cut(texts.select("row_id", "text_key", F.explode(shingles("text")).alias("v")).distinct())
    candidates = exploded.join(kept, "v").select("row_id", "text_key", "item").distinct()
    whole = size.select("item", F.explode("s").alias("v"))
    held = candidates.join(whole, "item").alias("c").join(
        exploded.alias("d"), F.expr("c.v = d.v AND c.text_key = d.text_key AND c.row_id <=> d.row_id"))
    count = held.groupBy("c.row_id", "c.text_key", "c.item").agg(F.count("*").alias("n_shared"))
    return count.join(size.drop("s"), "item").where(F.col("n_shared") * 100 >= F.col("n_item") * percent)


def contained_items(docs: DataFrame, items: DataFrame, percent: int = 80, row_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item found in it: ``row_id``, ``item_id``, ``n_item``, ``n_shared``, ``containment``."""
    made, total = _items(items, item_id, item_text)
    texts = docs.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"))
    if total <= BROADCAST_SHINGLES:
        names, find = _row_local(made, percent)
        hits = texts.select("row_id", F.explode(find("text")).alias("h")).select("row_id", F.col("h.item").alias("number"), "h.n_shared")
        found = hits.join(names, "number")
    else:
        keyed = texts.withColumn("text_key", F.xxhash64("text"))
        copies = keyed.groupBy("row_id", "text_key").agg(F.count("*").alias("copies"))
        found = _by_join(keyed, made, percent).alias("f").join(copies.alias("k"), F.expr("f.text_key = k.text_key AND f.row_id <=> k.row_id"))
        found = found.select("f.*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return found.select(F.col("row_id").alias(row_id), F.col("item_id").alias(item_id), "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    made, total = _items(items, "item_id", "text")
    names = docs.columns
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))
    text, row_id = F.col(f"c{names.index('text')}"), F.col(f"c{names.index('doc_id')}")
    if total <= BROADCAST_SHINGLES:
        _, find = _row_local(made, percent)
        return inner.where(F.size(find(text)) == 0).toDF(*names)
    keyed = inner.select(row_id.alias("row_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    bad = _by_join(keyed, made, percent).select("row_id", "text_key").distinct()
    return inner.join(bad, row_id.eqNullSafe(F.col("row_id")) & (F.xxhash64(text) == F.col("text_key")), "left_anti").toDF(*names)
