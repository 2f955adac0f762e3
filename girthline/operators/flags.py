"""Findings of all stages: severity, one per code and feature, line verdict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from girthline import vocab
from girthline.functions.text import lookup
from girthline.operators.scan import exact_quantiles

COLUMNS = ("line_id", "stage", "code", "feature_id", "source_row")


def severity() -> Column:
    return F.coalesce(lookup(vocab.SEVERITY, F.col("code")), F.lit("info"))


def staged(flags: DataFrame, stage: int) -> DataFrame:
    """Findings of one stage in the common layout; line-level ones have no feature."""
    feature = F.col("anomaly_id") if "anomaly_id" in flags.columns else F.lit(None).cast("string")
    row = F.col("source_row") if "source_row" in flags.columns else F.lit(None).cast("long")
    return flags.select("line_id", F.lit(stage).alias("stage"), "code", feature.alias("feature_id"), row.alias("source_row"))


def line_findings(growth: DataFrame, predictions: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Repairs due within the horizon, and a high median growth rate, per line."""
    # Counted and not filtered: a filter moves below the projection and repeats its formulas, each within the next, as one condition.
    fires = F.coalesce(F.bool_or(F.col("repair_trigger") != "NONE_WITHIN_HORIZON"), F.lit(False))
    due = predictions.groupBy("line_id").agg(fires.alias("_due")).where("_due").select("line_id")
    median = exact_quantiles(growth, ["line_id"], "cgr_mm_yr", [0.5]).where(F.col("q0") > threshold)
    return due.withColumn("code", F.lit("REPAIR_PREDICTED_WITHIN_HORIZON")).unionByName(
        median.select("line_id", F.lit("HIGH_CGR_POPULATION").alias("code"))
    )


def collect_findings(stages: Sequence[DataFrame]) -> DataFrame:
    """The first finding per line, code and feature in stage order, with its severity.

    A feature is its row, because reported identifiers repeat. The choice is an aggregate, not a window, so
    repeats are removed before the shuffle.
    """
    rows = stages[0]
    for other in stages[1:]:
        rows = rows.unionByName(other)
    kept = rows.groupBy("line_id", "code", "feature_id", "source_row").agg(F.min("stage").alias("stage"))
    return kept.withColumn("severity", severity()).select(*COLUMNS, "severity")


def finding_report(findings: DataFrame) -> DataFrame:
    """Per line: counts by severity, whether a critical code occurs, and the summary text."""
    def count(s: str) -> Column:
        return F.count_if(F.col("severity") == s).alias(f"n_{s}")

    rows = findings.groupBy("line_id").agg(
        count("error"), count("warn"), count("info"),
        F.coalesce(F.bool_or(F.col("code").isin(*vocab.CRITICAL_CODES)), F.lit(False)).alias("has_critical"),
    )
    total = F.col("n_error") + F.col("n_warn") + F.col("n_info")
    verdict = F.when(F.col("has_critical"), "REVIEW REQUIRED").otherwise("review recommended")
    text = F.format_string(
        "QA: %d finding(s) — %d error, %d warn, %d info. (%s)", total, F.col("n_error"), F.col("n_warn"), F.col("n_info"), verdict
    )
    return rows.withColumn("summary", F.when(total == 0, "QA: clean — no findings raised.").otherwise(text))


def finding_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("line_id", "code", "severity").agg(F.count(F.lit(1)).alias("n"))


def findings_by_feature(findings: DataFrame) -> DataFrame:
    """Features with the number of findings per severity."""
    return findings.where(F.col("feature_id").isNotNull()).groupBy("line_id", "source_row", "feature_id").pivot(
        "severity", ["error", "warn", "info"]
    ).count().na.fill(0)


def with_clean_lines(report: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds the lines on which nothing was found."""
    full = lines.select("line_id").join(report, "line_id", "left")
    return full.na.fill(0).na.fill(False).withColumn(
        "summary", F.coalesce("summary", F.lit("QA: clean — no findings raised."))
    )
