"""Inspection intervals, horizons and repair labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAYS_PER_YEAR = 365.25


def years_between(d1: Column, d2: Column) -> Column:
    """Signed interval in years of 365.25 days."""
    return F.datediff(d2, d1) / DAYS_PER_YEAR


def add_years(d: Column, years: Column) -> Column:
    """Date plus whole days of that many years."""
    return F.date_add(d, F.floor(years * DAYS_PER_YEAR).cast("int"))


def interval_status(years: Column, low: float = 0.5, high: float = 15.0) -> Column:
    """ok, unusual (outside the typical range), or invalid (second run not after the first)."""
    return (
        F.when(years.isNull(), "unknown")
        .when(years <= 0, "invalid")
        .when((years < low) | (years > high), "unusual")
        .otherwise("ok")
    )


def repair_label(trigger: Column, repair_date: Column, horizon_end: Column) -> Column:
    """Day of repair, or the month after which nothing was projected; empty without a projection."""
    fires = trigger.isin("DEPTH_80", "ERF_1.0") & repair_date.isNotNull()
    return (
        F.when(trigger.isNull(), "")
        .when(fires, F.date_format(repair_date, "dd-MM-yyyy"))
        .when(horizon_end.isNotNull(), F.concat(F.lit("After "), F.date_format(horizon_end, "MMMM yyyy")))
        .otherwise("After horizon")
    )
