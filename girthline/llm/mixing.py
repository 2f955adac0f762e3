"""Mixing of sources to target weights by Poisson replication.

A source's rate is its target share of the output bytes over its bytes: weight / sum of weights * ``epochs`` * all bytes / own
bytes (UTF-8 bytes of the texts, over all documents). Each document draws its number of copies from the Poisson distribution of its
source's rate by inversion: a uniform number made of a hash of the seed and the document's id is looked up in the cumulative
distribution. So the draw needs no state, gives the same copies on every run and for every partitioning, and expected shares
meet the targets. A rate above ``PART`` is split into equal parts that draw independently (sums of Poisson numbers are Poisson
numbers), which keeps the table of each source short and exp() away from zero.

The copies are then shuffled globally: each has a random key (hash of seed, id and copy number), is dealt out by it and sorted within
its partition. Neither a large source nor a much repeated document lands in one place.

Without weights, targets are proportional to bytes ** ``TEMPERATURE``. A source without a weight, and one without any text
bytes, gets rate 0 under given weights; a null source is a source of its own. A null text weighs nothing but is drawn like any
document of its source. Documents without an id draw by their text. Repeated rows draw the same number of copies each. The copies
keep all columns; columns named ``copy``, ``n_copies``, ``rate`` or ``mix_key`` are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girthline.session import shared_folder

PART, TEMPERATURE, SEED = 64.0, 0.7, "mix-1"
ADDED = ("copy", "n_copies", "rate", "mix_key")


def written(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read again: its size is then known to the planner, which decides on broadcasts."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def hashed(text: Column, digits: int) -> Column:
    """The first hex digits of the MD5 digest as a whole number."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """One row for each source: ``of_source``, ``bytes``, ``rate``, ``parts``, and ``cdf`` of rate / parts."""
    sums = docs.groupBy(F.col(source).alias("of_source")).agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0))).cast("double").alias("bytes"))
    if weights is None:
        sums = sums.withColumn("weight", F.pow("bytes", F.lit(TEMPERATURE)))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()), "name string, weight double")
        sums = sums.join(given, F.col("of_source") == F.col("name"), "left").drop("name").fillna({"weight": 0.0})
    sums = written(sums.withColumn("weight", F.when(F.col("bytes") > 0, F.col("weight")).otherwise(0.0)))
    total = sums.agg(F.sum("weight").alias("w"), F.sum("bytes").alias("b")).first()
    rate = F.col("weight") / F.lit(total["w"] or 1.0) * F.lit(epochs * (total["b"] or 0.0)) / F.col("bytes")
    sums = sums.withColumn("rate", F.when(F.col("weight") > 0, rate).otherwise(0.0))
    sums = sums.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int"))
    sums = sums.withColumn("mu", F.col("rate") / F.col("parts"))
    last = F.ceil(F.col("mu") + 12 * F.sqrt("mu") + 30).cast("int")
    # Running sum of mu^k / k! * exp(-mu).
    cdf = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(F.exp(-F.col("mu")).alias("p"), F.array(F.exp(-F.col("mu"))).alias("c")),
        lambda s, k: F.struct((s["p"] * F.col("mu") / k).alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * F.col("mu") / k)).alias("c")),
        lambda s: s["c"],
    )
    return written(sums.select("of_source", "bytes", "rate", "parts", cdf.alias("cdf")))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: str = SEED) -> DataFrame:
    """The drawn copies in random order: all columns of the documents, ``copy`` (from 1), ``n_copies``, ``rate``, ``mix_key``."""
    names = [c for c in docs.columns if c not in ADDED]
    inner = docs.select(*names).toDF(*(f"c{i}" for i in range(len(names))))
    source, text, row_id = (F.col(f"c{names.index(n)}") for n in ("source", "text", "doc_id"))
    table = rates(docs, weights, epochs)
    ids = inner.withColumn("id", F.coalesce(row_id.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit(""))))))
    known = ids.join(table, source.eqNullSafe(F.col("of_source")))
    draws = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda i: hashed(F.concat_ws("|", F.lit(seed), i.cast("string"), F.col("id")), 13) / F.lit(float(1 << 52)))
    count = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter("cdf", lambda c: c < u)))
    drawn = known.withColumn("n_copies", count)
    # explode drops what is drawn 0 times.
    each = drawn.withColumn("copy", F.explode(F.when(F.col("n_copies") > 0, F.sequence(F.lit(1), F.col("n_copies")))))
    each = each.withColumn("mix_key", hashed(F.concat_ws("|", F.lit(seed), F.lit("order"), F.col("id"), F.col("copy").cast("string")), 15))
    dealt = each.select(*inner.columns, *ADDED).repartition("mix_key").sortWithinPartitions("mix_key")
    return dealt.toDF(*names, *ADDED)
