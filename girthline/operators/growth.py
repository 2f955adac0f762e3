"""Corrosion growth between two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from girthline.functions.units import depth_mm
from girthline.operators.scan import exact_quantiles
from girthline.session import by_rows

MODES = ("hybrid", "population_only", "feature_specific")


def feature_rates(
    new_features: DataFrame, matches: DataFrame, lines: DataFrame, floor_negative_at_zero: bool = True,
    unmatched_depth_pct: float = 10.0,
) -> DataFrame:
    """Every assessable new feature with its own rate: matched rows from the old depth, others from an assumed one.

    ``lines`` has ``line_id`` and ``years_between``; it may carry ``unmatched_depth_pct`` per line, which is
    zero for a line whose first run is its commissioning. Lines without a positive interval give no rate and
    are marked in ``error``.
    """
    if "unmatched_depth_pct" in lines.columns:
        assumed = F.coalesce(F.col("_assumed"), F.lit(unmatched_depth_pct))
        dims = lines.select("line_id", "years_between", F.col("unmatched_depth_pct").alias("_assumed"))
    else:
        assumed = F.lit(float(unmatched_depth_pct))
        dims = lines.select("line_id", "years_between")
    pairs = matches.select(
        "line_id", F.col("new_source_row").alias("source_row"), "old_source_row", "match_score", "confidence",
        "relaxation_level", "old",
    )
    rows = new_features.join(by_rows(pairs), ["line_id", "source_row"], "left").join(dims, "line_id", "left")
    matched = F.col("old_source_row").isNotNull()
    wall = F.col("wt_mm")
    old_mm = F.when(matched, F.coalesce(F.col("old.depth_mm"), F.lit(0.0))).otherwise(
        F.when(wall > 0, assumed / 100.0 * wall).otherwise(0.0)
    )
    new_mm = F.coalesce(depth_mm(F.col("depth_pct_wt"), wall), F.lit(0.0))
    valid = F.col("years_between") > 0
    rows = rows.withColumns({
        "is_matched": matched,
        "depth_old_used_mm": old_mm,
        "depth_new_mm": new_mm,
        "error": F.when(~F.coalesce(valid, F.lit(False)), "years_between_not_positive"),
    }).withColumn("delta_mm", F.col("depth_new_mm") - F.col("depth_old_used_mm"))
    raw = F.when(valid, F.col("delta_mm") / F.nullif("years_between", F.lit(0.0)))
    rate = F.greatest(F.lit(0.0), raw) if floor_negative_at_zero else raw
    return rows.withColumns({"raw_cgr_mm_yr": raw, "feature_cgr_mm_yr": F.when(raw.isNotNull(), rate)}).drop("_assumed")


def population_p95(rates: DataFrame, split_by_surface: bool = True, quantile: float = 0.95) -> DataFrame:
    """(line_id, surface, n, population_p95_mm_yr); groups of a single feature have none."""
    rows = rates if split_by_surface else rates.withColumn("surface", F.lit("all"))
    found = exact_quantiles(rows, ["line_id", "surface"], "feature_cgr_mm_yr", [quantile])
    return found.where(F.col("n") >= 2).withColumnRenamed("q0", "population_p95_mm_yr")


def apply_population(rates: DataFrame, p95: DataFrame, mode: str = "hybrid", split_by_surface: bool = True) -> DataFrame:
    """The rate used downstream: own, raised to the population rate, or replaced by it."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; expected one of {MODES}")
    own = F.col("feature_cgr_mm_yr")
    if mode == "feature_specific":
        return rates.withColumns({
            "population_p95_mm_yr": F.lit(None).cast("double"),
            "cgr_mm_yr": own,
            "mode_used": F.lit("feature_specific"),
        })
    if split_by_surface:
        rows = rates.join(p95.select("line_id", "surface", "population_p95_mm_yr"), ["line_id", "surface"], "left")
    else:
        rows = rates.join(p95.select("line_id", "population_p95_mm_yr"), "line_id", "left")
    population = F.col("population_p95_mm_yr")
    usable = population > 0
    applies = usable if mode == "population_only" else usable & (own < population)
    label = "population_only" if mode == "population_only" else "population_floor"
    return rows.withColumns({
        "cgr_mm_yr": F.when(applies, population).otherwise(own),
        "mode_used": F.when(applies, label).otherwise("feature_specific"),
    })


def growth_codes(
    floor_negative_at_zero: bool = True, tolerance_pct: float = 10.0, extreme_mm_yr: float = 1.0,
    flag_below_tolerance: bool = True,
) -> Column:
    """Finding codes of a growth row, in the order a report lists them."""
    tolerance = tolerance_pct / 100.0 * F.col("wt_mm")
    below = F.col("is_matched") & (F.col("wt_mm") > 0) & (F.abs("delta_mm") < tolerance)
    return F.array_compact(F.array(
        F.when(~F.col("is_matched"), "UNMATCHED_RUN2"),
        F.when(F.lit(floor_negative_at_zero) & (F.col("delta_mm") < 0), "NEGATIVE_GROWTH"),
        F.when(F.lit(flag_below_tolerance) & below, "DEPTH_BELOW_TOL"),
        F.when(F.col("feature_cgr_mm_yr") > extreme_mm_yr, "EXTREME_CGR"),
        F.when(F.col("mode_used") == "population_floor", "POPULATION_FLOOR_APPLIED"),
    ))


def growth_flags(growth: DataFrame, **settings) -> DataFrame:
    return growth.select("line_id", "source_row", "anomaly_id", F.explode(growth_codes(**settings)).alias("code"))


def interval_findings(lines: DataFrame) -> DataFrame:
    """Lines without a positive interval between their runs: none of their features gets a rate or a repair year."""
    bad = ~F.coalesce(F.col("years_between") > 0, F.lit(False))
    return lines.where(bad).select("line_id", F.lit("INTERVAL_NOT_POSITIVE").alias("code")).distinct()


def growth(
    new_features: DataFrame, matches: DataFrame, lines: DataFrame, mode: str = "hybrid",
    split_by_surface: bool = True, quantile: float = 0.95, floor_negative_at_zero: bool = True,
    unmatched_depth_pct: float = 10.0, keep=None,
) -> DataFrame:
    """Rates of all assessable new features. ``keep`` may materialise the rates, which are read three times, and the few population rates."""
    rates = feature_rates(new_features, matches, lines, floor_negative_at_zero, unmatched_depth_pct)
    if keep is not None:
        rates = keep(rates)
    p95 = None if mode == "feature_specific" else population_p95(rates, split_by_surface, quantile)
    if keep is not None and p95 is not None:
        p95 = keep(p95)
    return apply_population(rates, p95, mode, split_by_surface)
