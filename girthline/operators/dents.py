"""Strain of dents, whose reported depth is a percentage of the outer diameter."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from girthline.functions.strength import with_dent_strain
from girthline.operators.inventory import dents


def dent_strains(features: DataFrame, lines: DataFrame) -> DataFrame:
    """Every dent with its strain components, resultant in percent and flags."""
    dims = lines.select("line_id", F.col("diameter_mm").alias("od_mm"))
    depth = F.when(
        F.col("depth_pct_wt").isNotNull() & (F.col("od_mm") > 0), F.col("depth_pct_wt") * F.col("od_mm") / 100.0
    ).otherwise(0.0)
    return with_dent_strain(dents(features).join(dims, "line_id", "left").withColumn("depth_mm", depth))
