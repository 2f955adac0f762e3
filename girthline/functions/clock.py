"""Clock positions: parsing, distance round the pipe, rendering.

Parsing is written as DataFrame steps over flat helper columns: one nested expression would repeat the text
matching many times and outgrow the generated code of a stage.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from girthline.functions.text import lenient_number, strip

_HH_MM = r"^\s*(\d{1,2})[:.](\d{1,2})(?::(\d{1,2}))?\s*$"
_BARE = r"(?i)^\s*(?:(\d{1,2}(?:\.\d+)?)\s*(?:o['`]?clock|h)|([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?))\s*$"
_HH_MM_LOOSE = r"^\s*(\d{1,2})\s*[:.]\s*(\d{1,2})(?::\d{1,2})?\s*$"
_EMPTY = ("", "n/a", "na", "none", "null", "-")


def wrap(hours: Column) -> Column:
    """Into [0, 12)."""
    return F.pmod(hours, F.lit(12.0))


def number_to_hours(v: Column) -> Column:
    """Decimal hours up to 12, degrees up to 360, otherwise null."""
    return F.when(v.between(0, 360), wrap(F.when(v > 12, v / 30.0).otherwise(v)))


def _part(c: Column, pattern: str, group: int) -> Column:
    # An empty text, where the pattern doesn't fit, is not cast: that would raise and catch an error for each row.
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit("")).try_cast("int")


def with_clock(df: DataFrame, source: str, hours: str, bad: str) -> DataFrame:
    """Adds decimal hours and whether the text was unreadable.

    ``6.14`` as text is 6 h 14 min, ``6 o'clock`` and ``6h`` are hours, ``180`` is degrees.
    """
    c, hh, mm, ss, bare = F.col(source), F.col("_hh"), F.col("_mm"), F.col("_ss"), F.col("_bare")
    timed = c.contains(":") | c.contains(".")
    number = F.coalesce(F.nullif(F.regexp_extract(c, _BARE, 2), F.lit("")), F.nullif(F.regexp_extract(c, _BARE, 1), F.lit("")))
    steps = df.withColumns({
        "_hh": F.when(timed, _part(c, _HH_MM, 1)),
        "_empty": c.isNull() | F.lower(strip(c)).isin(*_EMPTY),
    })
    # Only a time has minutes, and a number is only looked for where there is no time. Casting an empty text would raise and catch an error for each row.
    steps = steps.withColumns({
        "_mm": F.when(hh.isNotNull(), _part(c, _HH_MM, 2)),
        "_ss": F.when(hh.isNotNull(), F.coalesce(_part(c, _HH_MM, 3), F.lit(0))),
        "_bare": F.when(hh.isNull(), number.try_cast("double")),
    })
    clock = F.when((hh <= 12) & (mm < 60) & (ss < 60), wrap(hh + mm / 60.0 + ss / 3600.0))
    value = F.when(hh.isNotNull(), clock).otherwise(number_to_hours(bare))
    steps = steps.withColumn(hours, F.when(~F.col("_empty"), value))
    return steps.withColumn(bad, ~F.col("_empty") & F.col(hours).isNull()).drop("_hh", "_mm", "_ss", "_bare", "_empty")


def distance(a: Column, b: Column) -> Column:
    """Shorter way round between two positions, hours."""
    gap = F.abs(a - b)
    return F.when(gap > 6.0, 12.0 - gap).otherwise(gap)


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def with_hh_mm(df: DataFrame, source: str, target: str, unit: str = "hh:mm") -> DataFrame:
    """Adds the source clock text as ``hh:mm``; null where it cannot be read."""
    unit = (unit or "hh:mm").strip().lower()
    c = F.col(source)
    as_text = unit in ("hh:mm", "h:mm", "hh_mm", "hhmm", "h_min", "h:min")
    if not as_text and unit not in (
        "decimal_hr", "decimal_hours", "hours", "hr", "decimal", "degrees", "deg", "°", "radians", "rad",
    ):
        raise ValueError(f"unknown clock unit {unit!r}")
    number = lenient_number(c)
    if unit in ("degrees", "deg", "°"):
        number = number / 30.0
    elif unit in ("radians", "rad"):
        number = number * 6.0 / math.pi
    steps = df.withColumns({
        "_hh": _part(c, _HH_MM_LOOSE, 1) if as_text else F.lit(None).cast("int"),
        "_mm": _part(c, _HH_MM_LOOSE, 2) if as_text else F.lit(None).cast("int"),
        "_h": wrap(number),
    })
    hh, mm, h = F.col("_hh"), F.col("_mm"), F.col("_h")
    hour = F.when((hh == 12) & (mm == 0), 0).otherwise(hh)
    steps = steps.withColumns({
        "_total": F.floor(h).cast("int") * 60 + F.bround((h - F.floor(h)) * 60.0, 0).cast("int"),
        "_clock": F.when((mm < 60) & (hour <= 12), hour * 60 + mm),
    })
    total = F.col("_total")
    shown = F.concat(_two(F.floor(total / 60).cast("int") % 12), F.lit(":"), _two(total % 60))
    read = F.concat(_two(F.floor(F.col("_clock") / 60).cast("int")), F.lit(":"), _two(F.col("_clock") % 60))
    return steps.withColumn(target, F.when(hh.isNotNull(), read).otherwise(shown)).drop(
        "_hh", "_mm", "_h", "_total", "_clock"
    )


def render(hours: Column) -> Column:
    """``hh:mm:ss`` for report tables, seconds rounded half to even with carry; empty when unknown."""
    rest = (hours - F.floor(hours)) * 60.0
    seconds = (
        F.floor(hours).cast("int") * 3600
        + F.floor(rest).cast("int") * 60
        + F.bround((rest - F.floor(rest)) * 60.0, 0).cast("int")
    )
    s = F.pmod(seconds, F.lit(43200))
    shown = F.format_string(
        "%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(s / 60).cast("int") % 60, s % 60
    )
    return F.when(hours.isNotNull(), shown).otherwise("")
