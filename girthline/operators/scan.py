"""Ordered operations along a line that stay parallel inside one line.

A window over a whole line would put the line into one task. Here each line is cut into chunks of its ordering
column; a window works inside the chunks, one small row per chunk carries the state across them, and the two
are combined. No task ever holds more than one chunk, and no chunk is larger than its key range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from girthline.session import by_rows

CHUNK = "_chunk"


def chunk_of(order: Column, width: float) -> Column:
    return F.floor(order / F.lit(float(width))).cast("long")


_AGGREGATES = {"max": F.max, "min": F.min, "sum": F.sum}


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, values: dict[str, tuple[str, Column]],
    include_current: bool = True,
) -> DataFrame:
    """Running value of each output column along ``order`` within ``keys``.

    ``values`` maps an output name to (kind, input). Kinds ``last`` (last non-null), ``max``, ``min`` and
    ``sum`` look at the rows up to the current one, ``last_before`` leaves the current one out; ``min_after``
    and ``max_after`` look at the rows after. ``chunk`` must not decrease along ``order``. ``df`` is read twice, so a caller that stacks several of these cuts the lineage
    in between.
    """
    last_row = 0 if include_current else -1

    def window(kind: str, partition: Sequence[str], columns: Sequence[str], until: int):
        after = kind.endswith("_after")
        ordering = [F.col(c).desc() if after else F.col(c).asc() for c in columns]
        return Window.partitionBy(*partition).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, until)

    def reach(kind: str, c: Column, w) -> Column:
        if kind.startswith("last"):
            return F.last(c, ignorenulls=True).over(w)
        return _AGGREGATES[kind.removesuffix("_after")](c).over(w)

    def tail(kind: str, c: Column) -> Column:
        if kind.startswith("last"):
            return F.max_by(c, F.when(c.isNotNull(), place))
        return _AGGREGATES[kind.removesuffix("_after")](c)

    # One whole number needs no struct, which Spark could only aggregate by sorting; windows take a null first.
    whole = len(order) == 1 and df.schema[order[0]].dataType.typeName() in ("integer", "long")
    place = F.coalesce(F.col(order[0]).cast("long"), F.lit(-(2**63))) if whole else F.struct(*order)
    staged = df.withColumns({CHUNK: chunk, **{f"_in_{n}": c for n, (_, c) in values.items()}})
    tails = staged.groupBy(*keys, CHUNK).agg(*[tail(k, F.col(f"_in_{n}")).alias(f"_t_{n}") for n, (k, _) in values.items()])
    carried = tails.select(
        *keys, CHUNK,
        *[reach(k, F.col(f"_t_{n}"), window(k, keys, [CHUNK], -1)).alias(f"_c_{n}") for n, (k, _) in values.items()],
    )
    within = staged.withColumns({
        f"_w_{n}": reach(k, F.col(f"_in_{n}"), window(k, [*keys, CHUNK], order, -1 if k == "last_before" else last_row)) for n, (k, _) in values.items()
    })
    # Rows are dealt and sorted by chunk for the windows, so only the chunks are moved.
    joined = within.join(by_rows(carried), [*keys, CHUNK], "left")

    def combined(kind: str, name: str) -> Column:
        w, c = F.col(f"_w_{name}"), F.col(f"_c_{name}")
        if kind.startswith("last"):
            return F.coalesce(w, c)
        if kind == "sum":
            return F.coalesce(w, F.lit(0)) + F.coalesce(c, F.lit(0))
        return F.greatest(w, c) if kind.startswith("max") else F.least(w, c)

    outputs = [combined(k, n).alias(n) for n, (k, _) in values.items()]
    return joined.select(*[c for c in df.columns if c not in values], *outputs)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, name: str) -> DataFrame:
    """Row number along ``order`` within ``keys``, from 1."""
    return running(df, keys, order, chunk, {name: ("sum", F.lit(1).cast("long"))})


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float], accuracy: int = 10000,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, with the group's row count as ``n``.

    A mergeable sketch brackets each rank within ``1/accuracy`` of the rows; only values inside the bracket
    are then counted one by one. The exact step holds a few ten-thousandths of a group, so a group with most
    of the rows does not land in one task the way it would with a plain percentile aggregate.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    # Three sketch errors: one for the sketch, the rest for rounding of ranks in groups above ``accuracy`` rows.
    margin = 3.0 / accuracy
    bounds = [b for q in quantiles for b in (max(q - margin, 0.0), min(q + margin, 1.0))]
    sketch = rows.groupBy(*keys).agg(
        F.count("_v").alias("n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", bounds, accuracy).alias("_b"),
    )
    brackets = []
    for i, q in enumerate(quantiles):
        small = F.col("n") <= accuracy
        low = F.when(small | F.lit(q - margin <= 0), F.col("_min")).otherwise(F.col("_b")[2 * i])
        high = F.when(small | F.lit(q + margin >= 1), F.col("_max")).otherwise(F.col("_b")[2 * i + 1])
        brackets.append(F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q"), low.alias("low"), high.alias("high")))
    wanted = sketch.select(*keys, "n", F.explode(F.array(*brackets)).alias("_w")).select(*keys, "n", "_w.*")
    # Below the bracket only a count is needed, above it nothing.
    near = rows.join(wanted, list(keys))
    counted = (
        near.where(F.col("_v") <= F.col("high"))
        .withColumn("_v", F.when(F.col("_v") >= F.col("low"), F.col("_v")))
        .groupBy(*keys, "i", "q", "n", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    upto = Window.partitionBy(*keys, "i").orderBy(F.col("_v").asc_nulls_first())
    ranked = counted.withColumn("_last", F.sum("_c").over(upto) - 1).where(F.col("_v").isNotNull())
    rank = F.col("q") * (F.col("n") - 1)
    picked = ranked.groupBy(*keys, "i", "q", "n").agg(
        F.min(F.when(F.col("_last") >= F.floor(rank), F.col("_v"))).alias("_lo"),
        F.min(F.when(F.col("_last") >= F.ceil(rank), F.col("_v"))).alias("_hi"),
    )
    share = rank - F.floor(rank)
    # The form of the interpolation matters in the last bits.
    exact = F.when(share < 0.5, F.col("_lo") + (F.col("_hi") - F.col("_lo")) * share).otherwise(
        F.col("_hi") - (F.col("_hi") - F.col("_lo")) * (1.0 - share)
    )
    return picked.groupBy(*keys, "n").agg(
        *[F.max(F.when(F.col("i") == i, exact)).alias(f"q{i}") for i in range(len(quantiles))]
    )
