"""Sharding into shards of near equal bytes by sampled splitters.

Records are ordered by a key: hash of the text, hash of the id, hash of the whole row, so equal texts stand together. A
size-weighted sample of the keys (a row of size s is drawn with a chance in proportion to s, by its hash) is cut at its quantiles
into ``n_shards * ranges_per_shard`` ranges. Records are range-partitioned, the exact bytes of each range are summed, and ranges with
over twice the mean are subdivided with splitters sampled inside them, again and again, until only ranges of a single key are
left above it: a text with very many copies is cut by ids like any other run of keys. The ranges are dealt to the shards largest
first, each to the shard with the fewest bytes so far. ``slot`` numbers a shard's records by range and key from 0 without gaps.

Rows that are equal in all columns share those hashes. Where such rows together exceed the mean of a range, they are counted, and the row is written out
so many times with a running number at the end of its key; so they are cut like other keys, and no task numbers or writes more than ``COPIES`` of them.

The driver holds the sample, one number for each range and the repeated rows' keys, all bounded by ``n_shards * ranges_per_shard``.

A null text has 0 bytes (size 16) and stands with the others of its kind. Null ids are an id of their own. Existing columns named like
the added ones are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girthline.session import cut

OVERHEAD, RANGES_PER_SHARD, DRAWS_PER_RANGE, COPIES = 16, 32, 12, 10_000
ADDED = ("size", "text_crc32", "shard", "slot")


def _hex(value: Column) -> Column:
    return F.lpad(F.hex(value), 16, "0")


def _uniform(key: str, turn: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(turn)), 11) / F.lit(float(1 << 53))


def range_number(key: str, splitters: list[str]) -> Column:
    """How many of the sorted splitters are at or below the key, by two short look-ups."""
    if not splitters:
        return F.lit(0)
    step = max(1, math.isqrt(len(splitters)))
    heads, every = (F.split(F.lit(",".join(x)), ",") for x in (splitters[::step], splitters))  # folded into constants
    run = F.size(F.filter(heads, lambda b: b <= F.col(key)))
    inside = F.slice(every, F.greatest(run - 1, F.lit(0)) * step + 1, F.lit(step))
    return F.when(run == 0, 0).otherwise((run - 1) * step + F.size(F.filter(inside, lambda b: b <= F.col(key))))


def _quantiles(sample: list[tuple[str, float]], parts: int) -> list[str]:
    """Keys that cut a weighted sorted sample into about ``parts`` equal parts."""
    whole, run, out = sum(w for _, w in sample), 0.0, []
    for (key, weight), (following, _) in zip(sample, sample[1:]):
        before, run = run, run + weight
        if int(run * parts / whole) > int(before * parts / whole) and key < following:
            out.append(following)
    return out


def splitters(records: DataFrame, n_ranges: int) -> tuple[list[str], dict[int, tuple[int, int]]]:
    """Sorted splitters over (key, size) records, and bytes and rows of each range."""
    totals = records.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    if not totals["n"]:
        return [], {}
    mean = totals["b"] / n_ranges

    def draw(rows: DataFrame, each: float, turn: int) -> list[tuple[str, float]]:
        chance = F.col("size") / F.lit(each)
        drawn = rows.where(_uniform("key", turn) < chance).select("key", F.greatest(F.col("size").cast("double"), F.lit(each)).alias("w"))
        return sorted((r["key"], r["w"]) for r in drawn.collect())

    found, turn, stuck = _quantiles(draw(records, mean / DRAWS_PER_RANGE, 0), n_ranges), 0, set()
    while True:
        numbered = records.withColumn("range", range_number("key", found))
        sums = {r["range"]: r for r in numbered.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
        over = {k: r for k, r in sums.items() if r["b"] > 2 * mean and r["lo"] < r["hi"] and (r["lo"], r["hi"]) not in stuck}
        if not over:
            return found, {k: (r["b"], r["n"]) for k, r in sums.items()}
        turn += 1
        more = []
        sample = draw(numbered.where(F.col("range").isin(list(over))).select("key", "size"), mean / DRAWS_PER_RANGE, turn)
        keys = [k for k, _ in sample]
        for r in over.values():
            own = sample[bisect.bisect_left(keys, r["lo"]):bisect.bisect_right(keys, r["hi"])]
            cuts = [k for k in _quantiles(own, math.ceil(r["b"] / mean)) if k > r["lo"]] if len(own) > 1 else []
            # Few heavy records: cut before its last key, which at least parts it in two.
            more += cuts or [r["hi"]]
        grown = sorted({*found, *more})
        stuck |= {(r["lo"], r["hi"]) for r in over.values()} if len(grown) == len(found) else set()
        found = grown


def _numbered_copies(keyed: DataFrame, columns: list[str], n_ranges: int) -> DataFrame:
    """``keyed`` with longer keys that tell equal rows apart where they are many."""
    sums = keyed.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    whole = keyed.agg(F.sum("size")).first()[0] or 0
    # Fewer than ``n_ranges`` keys can have more than the mean of a range.
    hot = [r["key"] for r in sums.where((F.col("n") > 1) & (F.col("bytes") * n_ranges > whole)).select("key").collect()]
    number = lambda n: F.lpad(F.hex(n), 16, "0")
    if not hot:
        return keyed.withColumn("key", F.concat("key", number(F.lit(0))))
    many = F.broadcast(keyed.sparkSession.createDataFrame([(k,) for k in hot], "key string"))
    single = keyed.join(many, "key", "left_anti").withColumn("key", F.concat("key", number(F.lit(0))))
    counted = keyed.join(many, "key").groupBy("key", *columns, "size", "text_crc32").agg(F.count("*").alias("_n"))
    runs = counted.withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(COPIES)))).repartition("key", "_from")
    copies = F.explode(F.sequence("_from", F.least(F.col("_from") + COPIES, F.col("_n")) - 1))
    return single.unionByName(runs.withColumn("_copy", copies).withColumn("key", F.concat("key", number(F.col("_copy")))).select(*single.columns))


def sharded(docs: DataFrame, n_shards: int = 40, ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """The documents with ``size``, ``text_crc32``, ``shard`` and ``slot``."""
    names = [c for c in docs.columns if c not in ADDED]
    inner = docs.select(*names).toDF(*(f"c{i}" for i in range(len(names))))
    text, row_id = (F.col(f"c{names.index(n)}") for n in ("text", "doc_id"))
    key = F.concat(_hex(F.xxhash64(text)), _hex(F.xxhash64(row_id)), _hex(F.xxhash64(*inner.columns)))
    keyed = inner.withColumn("key", key).withColumn("size", F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD)
    keyed = keyed.withColumn("text_crc32", F.crc32(F.coalesce(text, F.lit("")).cast("binary")))
    keyed = _numbered_copies(keyed, inner.columns, n_shards * ranges_per_shard)
    found, sums = splitters(cut(keyed.select("key", "size")), n_shards * ranges_per_shard)

    shard_of, heap = {}, [(0, s) for s in range(n_shards)]
    for k, (size, _) in sorted(sums.items(), key=lambda x: (-x[1][0], x[0])):
        filled, s = heapq.heappop(heap)
        shard_of[k] = s
        heapq.heappush(heap, (filled + size, s))
    base, rows = {}, [0] * n_shards
    for k in sorted(sums):
        base[k], rows[shard_of[k]] = rows[shard_of[k]], rows[shard_of[k]] + sums[k][1]
    places = docs.sparkSession.createDataFrame([(k, shard_of[k], base[k]) for k in sorted(sums)], "range int, shard int, base long")

    place = F.row_number().over(Window.partitionBy("range").orderBy("key"))
    numbered = keyed.withColumn("range", range_number("key", found)).withColumn("place", place).join(places, "range")
    return numbered.select(*inner.columns, "size", "text_crc32", "shard", (F.col("base") + F.col("place") - 1).alias("slot")).toDF(*names, *ADDED)
