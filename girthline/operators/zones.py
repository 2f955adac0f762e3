"""Operating-pressure zones: validation, lookup, construction and design checks.

The zones of a line are a handful of parameters. They travel as one array per line, so a lookup is row-local
after an equality join on ``line_id`` and no feature is compared through a non-equi join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from girthline import vocab
from girthline.functions.strength import design_pressure_kgcm2

ZONE_COLUMNS = (
    "zone_idx", "wt_mm_min", "wt_mm_max", "chainage_m_min", "chainage_m_max", "design_factor", "maop_kgcm2",
)


def zones_by_line(zones: DataFrame) -> DataFrame:
    """One row per line with its zones in list order."""
    ordered = F.sort_array(F.collect_list(F.struct(*ZONE_COLUMNS)))
    return zones.groupBy("line_id").agg(ordered.alias("zones"))


def _bounds(z: Column, mode: Column) -> tuple[Column, Column]:
    chainage = mode == "chainage"
    return (
        F.when(chainage, z["chainage_m_min"]).otherwise(z["wt_mm_min"]),
        F.when(chainage, z["chainage_m_max"]).otherwise(z["wt_mm_max"]),
    )


def with_zone(features: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds ``zone`` (struct), ``zone_idx`` and ``zone_fallback`` by the line's zoning mode.

    First zone in list order that contains the key, both edges inclusive; else the zone whose nearer edge is
    closest, first in list order on ties. ``lines`` has ``line_id``, ``maop_zoning_mode`` and ``zones``.
    """
    dims = lines.select("line_id", "maop_zoning_mode", "zones")
    joined = features.join(dims, "line_id", "left")
    mode = F.col("maop_zoning_mode")
    keyed = joined.withColumn(
        "_key",
        F.when(mode == "chainage", F.col("abs_distance_m")).otherwise(F.coalesce(F.col("wt_mm"), F.lit(0.0))),
    )
    key = F.col("_key")

    def candidate(z: Column) -> Column:
        low, high = _bounds(z, mode)
        inside = key.between(low, high)
        distance = F.when(inside, F.lit(-1.0)).otherwise(F.least(F.abs(low - key), F.abs(high - key)))
        # A zone without bounds of this mode is taken only when no other exists.
        return F.struct(
            F.coalesce(distance, F.lit(float("inf"))).alias("distance"), z["zone_idx"].alias("idx"), z.alias("zone")
        )

    best = F.array_min(F.transform(F.col("zones"), candidate))
    picked = keyed.withColumn("_best", best)
    unknown_wall = (F.coalesce(mode, F.lit("wt")) != "chainage") & F.col("wt_mm").isNull()
    fallback = (F.col("_best.distance") >= 0) | unknown_wall
    unbounded = F.col("_best.distance") == F.lit(float("inf"))
    return picked.withColumns({
        "zone": F.col("_best.zone"),
        "zone_idx": F.col("_best.idx"),
        "zone_fallback": F.coalesce(
            fallback & ~(unbounded & (F.coalesce(mode, F.lit("wt")) == "chainage")), F.lit(False)
        ),
    }).drop("_key", "_best", "zones")


def in_zone(features: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds ``naturally_in_zone``: inside the zone assigned to the feature, not placed by the fallback."""
    placed = with_zone(features, lines)
    low, high = _bounds(F.col("zone"), F.col("maop_zoning_mode"))
    key = F.when(F.col("maop_zoning_mode") == "chainage", F.col("abs_distance_m")).otherwise(
        F.coalesce(F.col("wt_mm"), F.lit(0.0))
    )
    return placed.withColumn("naturally_in_zone", F.coalesce(key.between(low, high), F.lit(False)))


def zone_violations(zones: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per broken rule of a zone list (line_id, zone_idx, violation)."""
    mode = F.coalesce(F.nullif(F.lower(F.trim("maop_zoning_mode")), F.lit("")), F.lit("wt"))
    rows = zones.join(lines.select("line_id", "maop_zoning_mode"), "line_id", "left").withColumn("_mode", mode)
    has_wt = F.col("wt_mm_min").isNotNull() | F.col("wt_mm_max").isNotNull()
    has_ch = F.col("chainage_m_min").isNotNull() | F.col("chainage_m_max").isNotNull()
    full_wt = F.col("wt_mm_min").isNotNull() & F.col("wt_mm_max").isNotNull()
    full_ch = F.col("chainage_m_min").isNotNull() & F.col("chainage_m_max").isNotNull()
    by_wt, by_ch = F.col("_mode") == "wt", F.col("_mode") == "chainage"
    neighbours = Window.partitionBy("line_id").orderBy("chainage_m_min", "zone_idx")
    rows = rows.withColumn("_previous", F.lag("chainage_m_max").over(neighbours))
    rules = F.array_compact(F.array(
        F.when(~F.col("_mode").isin("wt", "chainage"), "unknown_mode"),
        F.when(by_wt & has_ch, "chainage_bounds_in_wt_mode"),
        F.when(by_wt & ~has_ch & ~full_wt, "missing_wt_bounds"),
        F.when(by_ch & has_wt, "wt_bounds_in_chainage_mode"),
        F.when(by_ch & ~has_wt & ~full_ch, "missing_chainage_bounds"),
        F.when(by_ch & (F.col("chainage_m_min") < 0), "negative_chainage"),
        F.when(by_ch & (F.col("chainage_m_max") < F.col("chainage_m_min")), "max_below_min"),
        F.when(by_ch & (F.col("chainage_m_min") < F.col("_previous")), "overlap"),
    ))
    return rows.select("line_id", "zone_idx", F.explode(rules).alias("violation"))


def build_zones(walls: DataFrame) -> DataFrame:
    """Zones from (line_id, wt_mm, maop_kgcm2, design_factor).

    Runs of equal pressure along sorted wall thickness become one zone; cuts lie midway between neighbours of
    different pressure, the ends half a millimetre outside. A single pressure therefore gives a single zone.
    """
    along = Window.partitionBy("line_id").orderBy("wt_mm", "maop_kgcm2")
    steps = walls.where(F.col("wt_mm").isNotNull() & F.col("maop_kgcm2").isNotNull()).dropDuplicates(
        ["line_id", "wt_mm", "maop_kgcm2"]
    )
    steps = steps.withColumns({
        "_prev_wt": F.lag("wt_mm").over(along),
        "_starts": (F.lag("maop_kgcm2").over(along).isNull() | (F.lag("maop_kgcm2").over(along) != F.col("maop_kgcm2"))).cast("int"),
    }).withColumn("zone_idx", F.sum("_starts").over(along).cast("int") - 1)
    runs = steps.groupBy("line_id", "zone_idx").agg(
        F.min("wt_mm").alias("_first"),
        F.max("wt_mm").alias("_last"),
        F.min(F.when(F.col("_starts") == 1, F.col("_prev_wt"))).alias("_before"),
        F.min("maop_kgcm2").alias("maop_kgcm2"),
        F.max(F.coalesce(F.nullif("design_factor", F.lit(0.0)), F.lit(0.72))).alias("design_factor"),
    )
    by_zone = Window.partitionBy("line_id").orderBy("zone_idx")
    low_cut = F.bround((F.col("_before") + F.col("_first")) / 2.0, 3)
    low = F.coalesce(low_cut, F.bround(F.greatest(F.lit(0.1), F.col("_first") - 0.5), 3))
    cut = runs.withColumn("wt_mm_min", low)
    high = F.coalesce(F.lead("wt_mm_min").over(by_zone), F.bround(F.col("_last") + 0.5, 3))
    return cut.withColumn("wt_mm_max", high).select(
        "line_id", "zone_idx", "wt_mm_min", "wt_mm_max", "design_factor", "maop_kgcm2"
    )


def thinnest_per_zone(placed: DataFrame, zones: DataFrame) -> DataFrame:
    """Every zone with the thinnest assessable wall placed in it, null where none is."""
    walls = placed.where(F.col("wt_mm") > 0).groupBy("line_id", "zone_idx").agg(F.min("wt_mm").alias("wt_min_mm"))
    return zones.join(walls, ["line_id", "zone_idx"], "left")


def design_check(thinnest: DataFrame, lines: DataFrame, tolerance: float = 1.05) -> DataFrame:
    """Design pressure of each zone at its thinnest wall, and whether the operating pressure exceeds it."""
    dims = lines.select("line_id", "diameter_mm", "smys_mpa")
    limit = design_pressure_kgcm2(F.col("smys_mpa"), F.col("wt_min_mm"), F.col("diameter_mm"), F.col("design_factor"))
    return thinnest.join(dims, "line_id").withColumn("design_maop_kgcm2", limit).withColumn(
        "exceeds_design", F.coalesce(F.col("maop_kgcm2") > F.col("design_maop_kgcm2") * tolerance, F.lit(False))
    )


def with_smys(lines: DataFrame) -> DataFrame:
    """Fills a missing or zero yield strength from the material grade."""
    from girthline.functions.text import lookup

    grade = lookup({k: str(v) for k, v in vocab.SMYS_BY_GRADE.items()}, F.col("material_grade")).cast("double")
    return lines.withColumn("smys_mpa", F.coalesce(F.nullif("smys_mpa", F.lit(0.0)), grade, F.lit(0.0)))


def zone_display(zones: DataFrame, lines: DataFrame) -> DataFrame:
    """Operating pressures and design factors of a line as report text."""
    by_line = zones_by_line(zones).join(lines.select("line_id", "maop_zoning_mode"), "line_id", "right")
    count = F.coalesce(F.size("zones"), F.lit(0))
    maops = F.array_join(F.transform("zones", lambda z: F.format_string("%.1f", z["maop_kgcm2"])), " / ")
    factors = F.transform("zones", lambda z: F.format_string("%.2f", z["design_factor"]))
    word = F.when(F.col("maop_zoning_mode") == "chainage", "chainage").otherwise("WT")
    many = F.concat(maops, F.lit(" kg/cm² (by "), word, F.lit(" zone)"))
    return by_line.select(
        "line_id",
        F.when(count == 0, "—").when(count == 1, F.concat(maops, F.lit(" kg/cm²"))).otherwise(many).alias("maop_display"),
        F.when(count == 0, "—")
        .when(F.size(F.array_distinct(factors)) == 1, F.try_element_at(factors, F.lit(1)))
        .otherwise(F.array_join(factors, " / "))
        .alias("design_factor_display"),
    )
