"""Joins of many rows with one row for each key, where a few keys may hold most of the rows."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows is split; so fewer than that many keys are, and the plan can name them.
PARTS = 200


def spread_join(rows: DataFrame, keyed: DataFrame, keys: list[str], by: str, keep: bool = False) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row for each key and, as ``n_rows``, how many of ``rows`` have that key.

    A key with k of PARTS equal parts of the rows is dealt to k places by a hash of the column ``by``, and its row in ``keyed`` is
    repeated k times; so no place gets more than one part of a single key, and at most 2 * PARTS rows are added. Both sides work the
    places out from the key itself, so each row goes through one join and no other. ``keyed`` is read three times and should be a
    stored table. No key column may be null. ``keep`` keeps ``n_rows`` in the result.
    """
    total = keyed.agg(F.sum("n_rows")).first()[0] or 1
    digest = F.xxhash64(*(F.col(k).cast(keyed.schema[k].dataType) for k in keys))
    hot = keyed.where(F.col("n_rows") * PARTS > total).select(digest, F.ceil(F.col("n_rows") * PARTS / total).cast("int")).collect()
    keyed = keyed if keep else keyed.drop("n_rows")
    if not hot:
        return rows.join(keyed, keys)
    places = _places(digest, dict(sorted(map(tuple, hot))))
    dealt = rows.withColumn("_place", F.pmod(F.xxhash64(by), places).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), places - 1))
    return dealt.join(keyed.withColumn("_place", copies), [*keys, "_place"]).drop("_place")


def _places(digest: Column, hot: dict[int, int]) -> Column:
    """To how many places a key is dealt, by its digest: one, unless it is among the ``hot`` ones. Keys of one digest are dealt alike."""
    alike = defaultdict(list)
    for key, n in hot.items():
        alike[n].append(key)
    out = F.when(~digest.isin(*hot), 1)
    for n, found in alike.items():
        out = out.when(digest.isin(*found), n)
    return out
