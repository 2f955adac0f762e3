"""The two-run assessment of all lines, stage by stage."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from girthline.functions import dates
from girthline.operators import alignment, assess, flags, growth, matching, project
from girthline.operators.inventory import assessable
from girthline.session import kept


@dataclass(frozen=True)
class Settings:
    """What a run may choose; the defaults are those of the engine."""

    primary_method: str = "B31G_Original"
    growth_mode: str = "hybrid"
    split_by_surface: bool = True
    population_quantile: float = 0.95
    floor_negative_at_zero: bool = True
    unmatched_depth_pct: float = 10.0
    horizon_years: int = 10
    depth_trigger_pct: float = 80.0
    erf_trigger: float = 1.0
    passes: tuple = field(default_factory=lambda: matching.PASSES)


@dataclass(frozen=True)
class Assessment:
    """Results of a run, one table per stage."""

    joint_pairs: DataFrame
    alignment: DataFrame
    matches: DataFrame
    match_summary: DataFrame
    growth: DataFrame
    current: DataFrame
    predictions: DataFrame
    findings: DataFrame
    report: DataFrame


def with_interval(lines: DataFrame) -> DataFrame:
    return lines.withColumn("years_between", dates.years_between(F.col("run1_date"), F.col("run2_date")))


def assess_lines(
    old: DataFrame, new: DataFrame, old_joints: DataFrame, new_joints: DataFrame, lines: DataFrame,
    settings: Settings = Settings(), reader_codes: DataFrame | None = None,
) -> Assessment:
    """Align, match, grow, assess, project and collect findings for every line of the fleet.

    Stages read several times are kept: line properties, joint pairs, matched rates, and predictions.
    """
    lines = kept(with_interval(lines))
    pairs = kept(alignment.align(old_joints, new_joints))
    aligned = alignment.alignment_summary(old_joints, new_joints, pairs)
    matches = kept(matching.match(old, new, pairs, settings.passes))
    summary = matching.match_summary(old, new, matches, settings.passes)
    pool = assessable(new)
    grown = growth.growth(
        pool, matches, lines, settings.growth_mode, settings.split_by_surface, settings.population_quantile,
        settings.floor_negative_at_zero, settings.unmatched_depth_pct, keep=kept,
    )
    # The assessment is row-local, so it runs on the growth rows and the projection needs no join. Findings come from it and not
    # from the predictions, which a feature without a rate doesn't reach.
    assessed = assess.assess(grown, lines, settings.primary_method)
    current = kept(project.current_state(assessed, lines))
    rated = current.where(F.col("cgr_mm_yr").isNotNull())
    predictions = kept(project.project_rows(rated, settings.horizon_years, settings.depth_trigger_pct, settings.erf_trigger))
    stages = [
        flags.staged(alignment.alignment_codes(aligned), 2),
        flags.staged(matching.match_codes(summary), 3),
        flags.staged(growth.growth_flags(grown, floor_negative_at_zero=settings.floor_negative_at_zero), 4),
        flags.staged(growth.interval_findings(lines), 4),
        flags.staged(current.select("line_id", "source_row", "anomaly_id", F.explode("flags").alias("code")), 5),
        flags.staged(flags.line_findings(grown, predictions), 7),
    ]
    if reader_codes is not None:
        stages.insert(0, flags.staged(reader_codes, 1))
    found = flags.collect_findings(stages)
    return Assessment(
        pairs, aligned, matches, summary, grown, current, predictions, found,
        flags.with_clean_lines(flags.finding_report(found), lines),
    )


def verdicts(result: Assessment) -> DataFrame:
    """Exit verdict per line: 1 where a critical finding asks for review."""
    return result.report.select("line_id", F.col("has_critical").cast("int").alias("exit_code"), "summary")
