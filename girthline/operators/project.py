"""Year-by-year projection of every feature to its repair year.

All five methods share one shape in depth: ``A * (1 - k x) / (1 - k x / M)`` with ``x = d / t``. The constants
are computed once per feature, then each year costs a few operations. The years are entries of arrays, not rows: no explode and no
shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from girthline.functions.dates import DAYS_PER_YEAR
from girthline.functions.strength import FLOW_FACTOR, FLOW_OFFSET_MPA, UTS_OFFSET_MPA
from girthline.functions.units import MPA_TO_KGCM2
from girthline.session import by_rows

DEPTH_TRIGGER = "DEPTH_80"
ERF_TRIGGER = "ERF_1.0"
NO_TRIGGER = "NONE_WITHIN_HORIZON"


# A (MPa), k and 1/M of the controlling method; 1/M is zero where there is no denominator.
_CONSTANTS = (
    f"""CASE method WHEN 'B31G_Original' THEN 2D * ({FLOW_FACTOR}D * smys_mpa) * wt_mm / diameter_mm
        WHEN 'Kastner' THEN 4D * ({FLOW_FACTOR}D * smys_mpa) * wt_mm / diameter_mm
        WHEN 'DNV_RP_F101' THEN 2D * coalesce(uts_mpa, smys_mpa + {UTS_OFFSET_MPA}D) * wt_mm / (diameter_mm - wt_mm)
        ELSE 2D * (smys_mpa + {FLOW_OFFSET_MPA}D) * wt_mm / diameter_mm END AS _a""",
    """CASE method WHEN 'B31G_Original' THEN if(z_value <= 20D, 2D / 3D, 1D) WHEN 'Kastner' THEN width_mm / (pi() * diameter_mm)
        WHEN 'DNV_RP_F101' THEN 1D ELSE 0.85D END AS _k""",
    "coalesce(1D / folias_factor_m, 0D) AS _m",
    "coalesce(design_factor, 0.72D) AS _fd",
    "depth_mm AS _d0", "sop_kgcm2 AS _s0", "erf AS _e0",
)


#: So many years are written out as columns at a time: more code than that in one method, and the JVM doesn't compile it.
BLOCK = 4


def _year(n: int) -> list[str]:
    """Depth, loss ratio, failure pressure, safe pressure and repair factor after ``n`` years."""
    return [
        # Added year by year, not multiplied, to keep the same last bits.
        f"_d{n - 1} + cgr_mm_yr AS _d{n}",
        f"_k * (least(_d{n}, wt_mm * 0.999D) / wt_mm) AS _x{n}",
        f"if(method = 'Kastner', greatest(0D, least(1D, _x{n})), _x{n}) AS _q{n}",
        f"1D - _q{n} * _m AS _n{n}",
        f"if(_n{n} <= 0D, 0D, _a * ((1D - _q{n}) / nullif(_n{n}, 0D))) AS _f{n}",
        f"if(method = 'DNV_RP_F101', _f{n}, greatest(0D, _f{n})) * _fd * {MPA_TO_KGCM2!r}D AS _s{n}",
        f"CASE WHEN _s{n} > 0D THEN maop_kgcm2 / nullif(_s{n}, 0D) WHEN _s{n} IS NOT NULL THEN double('Infinity') END AS _e{n}",
    ]


def project(
    growth: DataFrame, current: DataFrame, horizon_years: int = 10, depth_trigger_pct: float = 80.0,
    erf_trigger: float = 1.0,
) -> DataFrame:
    """Repair prediction of every feature that has both a rate and an assessment.

    ``growth`` carries the feature and ``cgr_mm_yr``; ``current`` is the controlling assessment with
    ``design_factor``, ``diameter_mm``, ``smys_mpa``, ``uts_mpa`` and ``run2_date``. Depth is tested before the
    repair factor, and a depth trigger reports the pressures of the year before. Adds ``years``, an array with
    one entry per assessed year. A ``current`` made from the growth rows carries their rate and needs no join.
    """
    key = ["line_id", "source_row"]
    if "cgr_mm_yr" in current.columns:
        rows = current.where(" AND ".join(f"{c} IS NOT NULL" for c in key))
    else:
        rows = growth.select(*key, "cgr_mm_yr").join(by_rows(current), key)
    return project_rows(rows.where(F.col("cgr_mm_yr").isNotNull()), horizon_years, depth_trigger_pct, erf_trigger)


def project_rows(
    rows: DataFrame, horizon_years: int = 10, depth_trigger_pct: float = 80.0, erf_trigger: float = 1.0,
) -> DataFrame:
    """``project`` for rows that already carry rate and assessment."""
    kept = rows.columns
    rows = rows.selectExpr("*", *_CONSTANTS).selectExpr(
        "*", "array(_d0) AS _ds", "array(_s0) AS _ss", "array(_e0) AS _es", "transform(array(_d0), d -> 100D * d / wt_mm) AS _ps",
    )
    for start in range(1, horizon_years + 1, BLOCK):
        years = range(start, min(start + BLOCK, horizon_years + 1))
        listed = {x: "array(" + ", ".join(f"_{x}{n}" for n in years) + ")" for x in "dse"}
        rows = rows.selectExpr("*", *[step for n in years for step in _year(n)]).withColumns({
            **{f"_{x}s": F.expr(f"concat(_{x}s, {found})") for x, found in listed.items()},
            "_ps": F.expr(f"concat(_ps, transform({listed['d']}, d -> 100D * d / wt_mm))"),
        })
    # The first year that fires, and how: twice the year, plus one for the repair factor.
    fires = f"CASE WHEN p >= {depth_trigger_pct}D THEN 2 * n WHEN _es[n] >= {erf_trigger}D THEN 2 * n + 1 END"
    # An assessed depth is capped just below the wall; the reported depth is not.
    entry = (
        "named_struct('year', n, 'depth_pct_wt', 100D * (if(n = 0, d, least(d, wt_mm * 0.999D)) / wt_mm),"
        " 'sop_kgcm2', _ss[n], 'erf', _es[n])"
    )
    rows = rows.selectExpr("*", f"array_min(transform(_ps, (p, n) -> {fires})) AS _first").selectExpr(
        "*",
        "_first div 2 AS _year", "_first % 2 = 0 AS _by_depth",
        f"coalesce(_year, {horizon_years}) AS _final",
        "if(coalesce(_by_depth, false) AND _year > 0, _year - 1, _final) AS _last",
    )
    return rows.selectExpr(
        *kept,
        "CAST(_year AS INT) AS repair_year_offset",
        f"CASE WHEN _first IS NULL THEN '{NO_TRIGGER}' WHEN _by_depth THEN '{DEPTH_TRIGGER}' ELSE '{ERF_TRIGGER}' END AS repair_trigger",
        "CAST(_last AS INT) AS last_assessed_year",
        f"date_add(run2_date, CAST(floor(_year * {DAYS_PER_YEAR}D) AS INT)) AS predicted_repair_date",
        "_ds[_final] AS final_depth_mm",
        "_ps[_final] AS final_depth_pct_wt",
        "_es[_last] AS final_erf",
        "_ss[_last] AS final_psafe_kgcm2",
        f"slice(transform(_ds, (d, n) -> {entry}), 1, CAST(_last AS INT) + 1) AS years",
        f"{horizon_years} AS horizon_years",
    )


def repair_years(predictions: DataFrame) -> DataFrame:
    """One row per feature and assessed year."""
    # Every prediction has a year 0, so the outer form adds nothing and keeps a filter on the array out of the plan.
    return predictions.select(
        "line_id", "source_row", "anomaly_id", "method", F.explode_outer("years").alias("y")
    ).select("line_id", "source_row", "anomaly_id", "method", "y.*")


def current_state(assessed: DataFrame, lines: DataFrame) -> DataFrame:
    """The controlling assessment with what a projection needs, from ``assess``; with the rate if the rows carry it."""
    dims = lines.select("line_id", "run2_date")
    rate = ["cgr_mm_yr"] if "cgr_mm_yr" in assessed.columns else []
    kept = assessed.select(
        *rate, "line_id", "source_row", "anomaly_id", "diameter_mm", "smys_mpa", "uts_mpa", "zone_fallback",
        "design_factor", "controlling.*",
    )
    return kept.join(dims, "line_id", "left")
