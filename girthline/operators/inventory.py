"""Which features an assessment uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from girthline import vocab


def is_assessable() -> Column:
    """Metal loss that no cluster parent already covers."""
    return F.col("cluster_parent_id").isNull() & ~F.col("feature_identification").isin(*vocab.NON_METAL_LOSS)


def assessable(features: DataFrame) -> DataFrame:
    return features.where(is_assessable())


def dents(features: DataFrame) -> DataFrame:
    return features.where(F.col("feature_identification").isin(*vocab.DENT_CODES))


def in_joint(features: DataFrame, joint_number: int) -> DataFrame:
    return features.where(F.col("joint_number") == joint_number)


def is_circumferential() -> Column:
    """Eligible for the circumferential method: known class decides, then the label, then the shape."""
    known = F.coalesce(F.col("dimension_class"), F.lit("UNDEFINED"))
    label = F.lower(F.coalesce(F.col("raw_description"), F.lit("")))
    wide = (F.col("width_mm") > 0) & (F.col("length_mm") > 0) & (F.col("width_mm") > F.col("length_mm"))
    return (
        F.when(known.isin("CISL", "CIGR"), True)
        .when(known != "UNDEFINED", False)
        .when(label.contains("circumferential"), True)
        .otherwise(F.coalesce(wide, F.lit(False)))
    )
