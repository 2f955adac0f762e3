"""Fitness-for-purpose assessment of features against their pressure zone. Row-local: no shuffle of its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from girthline import vocab
from girthline.functions import strength
from girthline.operators.inventory import is_circumferential
from girthline.operators.zones import with_zone

KEY = ("line_id", "source_row", "anomaly_id")


def screen(
    features: DataFrame, lines: DataFrame, primary: str = "B31G_Original", cross_checks: Sequence[str] = (),
    kastner_for_circumferential: bool = True, strict: bool = False,
) -> DataFrame:
    """Features with their zone and line properties, ``reject_reason`` and ``kastner_reject``.

    A circumferential feature without a width keeps its primary result and only loses the circumferential one,
    named in ``kastner_reject``; ``strict`` rejects the whole feature instead.
    """
    methods = _methods(primary, cross_checks)
    dims = lines.select("line_id", "diameter_mm", "smys_mpa", *[c for c in ("uts_mpa",) if c in lines.columns])
    if "uts_mpa" not in lines.columns:
        dims = dims.withColumn("uts_mpa", F.lit(None).cast("double"))
    rows = with_zone(features, lines).join(dims, "line_id", "left").withColumn("is_circumferential", is_circumferential())
    no_width = F.col("width_mm").isNull()
    auto = kastner_for_circumferential and "Kastner" not in methods
    misses_width = F.col("is_circumferential") & no_width if auto else F.lit(False)
    reason = (
        F.when(F.col("feature_identification").isin(*vocab.NON_METAL_LOSS), "not_metal_loss")
        .when(F.col("wt_mm").isNull() | (F.col("wt_mm") <= 0), "wall_thickness_missing")
        .when(F.col("depth_pct_wt").isNull(), "depth_missing")
        .when(F.col("diameter_mm").isNull() | (F.col("diameter_mm") <= 0), "diameter_missing")
        .when(F.col("zone").isNull(), "no_zone")
        .when(F.lit(any(m != "Kastner" for m in methods)) & F.col("length_mm").isNull(), "length_missing")
        .when(F.lit("Kastner" in methods) & no_width, "width_missing")
        .when(F.lit(strict) & misses_width, "width_missing")
    )
    return rows.withColumns({
        "reject_reason": reason,
        "kastner_reject": F.when(misses_width, "width_missing"),
    })


def _methods(primary: str, cross_checks: Sequence[str]) -> list[str]:
    methods = list(dict.fromkeys([primary, *cross_checks]))
    for method in methods:
        if method not in strength.METHODS:
            raise ValueError(f"unknown method {method!r}; expected one of {strength.METHODS}")
    return methods


def assess(
    features: DataFrame, lines: DataFrame, primary: str = "B31G_Original", cross_checks: Sequence[str] = (),
    kastner_for_circumferential: bool = True, strict: bool = False,
) -> DataFrame:
    """One row per feature that can be assessed, with ``results`` (array of assessments) and ``controlling``.

    The primary method comes first, then the cross checks without repeats, then the circumferential method for
    eligible features. Of the primary and the circumferential result the one with the lower safe pressure
    controls; cross checks never do.
    """
    methods = _methods(primary, cross_checks)
    rows = screen(features, lines, primary, cross_checks, kastner_for_circumferential, strict)
    # Dropped before the formulas, so that no later filter carries them along.
    rows = rows.where(F.col("reject_reason").isNull()).drop("reject_reason", "kastner_reject")
    rows = rows.withColumns({"design_factor": F.col("zone.design_factor"), "maop_kgcm2": F.col("zone.maop_kgcm2")})
    add_kastner = kastner_for_circumferential and "Kastner" not in methods
    columns = {f"_r{i}": m for i, m in enumerate([*methods, "Kastner"] if add_kastner else methods)}
    rival = next((c for c, m in columns.items() if m == "Kastner" and c != "_r0"), None)
    competes = F.col("is_circumferential") & F.col("width_mm").isNotNull()
    rows = strength.with_strength(rows, columns, rival, competes)
    entries = [F.when(competes, F.col(c)) if add_kastner and c == rival else F.col(c) for c in columns]
    deciding = F.col("_r0") if rival is None else F.when(F.col("_beats"), F.col(rival)).otherwise(F.col("_r0"))
    return rows.withColumns({
        "results": F.array_compact(F.array(*entries)),
        "controlling": deciding,
    }).drop(*columns, "_beats")


def long_results(assessed: DataFrame) -> DataFrame:
    """One row per feature and method."""
    # The outer form adds no rows, every feature has a result; it keeps a filter on the array out of the plan.
    return assessed.select(*KEY, "zone_idx", "zone_fallback", F.explode_outer("results").alias("r")).select(
        *KEY, "zone_idx", "zone_fallback", "r.*"
    )


def controlling(assessed: DataFrame) -> DataFrame:
    """The assessment that decides each feature."""
    return assessed.select(*KEY, "zone_idx", "zone_fallback", "controlling.*")


def rejects(screened: DataFrame) -> DataFrame:
    """Features or methods left out, with the reason, from ``screen``."""
    reason = F.coalesce(F.col("reject_reason"), F.concat(F.lit("kastner_"), F.col("kastner_reject")))
    return screened.select(*KEY, reason.alias("reason")).where(F.col("reason").isNotNull())


def assessment_flags(long: DataFrame) -> DataFrame:
    """One row per finding of an assessment."""
    return long.select(*KEY, "method", F.explode("flags").alias("code"))
