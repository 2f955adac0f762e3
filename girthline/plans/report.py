"""Report tables and chart series, as data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from girthline import vocab
from girthline.functions import clock, dates
from girthline.functions.strength import with_strength
from girthline.functions.units import render_surface
from girthline.operators.inventory import is_circumferential
from girthline.operators.scan import chunk_of, exact_quantiles, numbered
from girthline.operators.zones import with_zone
from girthline.session import by_rows, kept

ROW = ["line_id", "source_row"]
METRES_PER_CHUNK = 1_000.0


def with_serial(df: DataFrame, distance: str = "abs_distance_m") -> DataFrame:
    """Adds ``sn``, the row's place along its line by chainage and identifier."""
    return numbered(
        df, ["line_id"], [distance, "anomaly_id", "source_row"], chunk_of(F.col(distance), METRES_PER_CHUNK), "sn"
    )


def comparison(growth: DataFrame) -> DataFrame:
    """Run-to-run comparison: both measurements of a feature, its own rate and the rate used."""
    old, matched = F.col("old"), F.col("is_matched")
    back = F.col("depth_old_used_mm") * 100.0 / F.coalesce(F.nullif("wt_mm", F.lit(0.0)), F.lit(1.0))
    return with_serial(growth).select(
        *ROW, "sn", "anomaly_id", "wt_mm", "joint_number",
        F.col("abs_distance_m").alias("abs_distance_new_m"),
        old["abs_distance_m"].alias("abs_distance_old_m"),
        F.col("depth_pct_wt").alias("depth_new_pct"),
        F.when(matched, old["depth_pct_wt"]).otherwise(back).alias("depth_old_pct"),
        clock.render(F.col("clock_decimal_hours")).alias("orientation_new"),
        clock.render(old["clock_decimal_hours"]).alias("orientation_old"),
        render_surface(F.col("surface")).alias("surface_new"),
        F.when(matched, render_surface(old["surface"])).otherwise("").alias("surface_old"),
        F.col("feature_cgr_mm_yr").alias("cgr_raw_mm_yr"),
        F.col("cgr_mm_yr"),
    )


def matched_comparison(growth: DataFrame) -> DataFrame:
    """The comparison for matched features only, numbered among themselves."""
    return with_serial(growth.where("is_matched")).select(
        *ROW, "sn", "anomaly_id", "joint_number", "abs_distance_m", "wt_mm",
        F.col("depth_pct_wt").alias("depth_new_pct"), F.col("old.depth_pct_wt").alias("depth_old_pct"),
        render_surface(F.col("surface")).alias("surface_new"), render_surface(F.col("old.surface")).alias("surface_old"),
        "cgr_mm_yr",
    )


def _labels(predictions: DataFrame) -> DataFrame:
    end = dates.add_years(F.col("run2_date"), F.col("horizon_years"))
    label = dates.repair_label(F.col("repair_trigger"), F.col("predicted_repair_date"), end)
    return predictions.select(*ROW, label.alias("repair_label"), F.element_at("years", -1).alias("_end"))


def anomalies(growth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Metal-loss anomalies with their repair label; the joint length is not known here and stays empty."""
    rows = growth.join(by_rows(_labels(predictions).drop("_end")), ROW, "left")
    # Numbering reads its rows twice, so the projection behind them is kept.
    rows = kept(rows.select(
        *ROW, "anomaly_id", "abs_distance_m", "latitude", "longitude", "joint_number", "upstream_weld_dist_m", "raw_description", "surface",
        "wt_mm", "clock_decimal_hours", "depth_pct_wt", "length_mm", "width_mm", "repair_label",
    ))
    return with_serial(rows).select(
        *ROW, "sn", "anomaly_id", "abs_distance_m", "latitude", "longitude", "joint_number",
        F.lit(None).cast("double").alias("joint_length_m"), "upstream_weld_dist_m",
        F.coalesce("raw_description", F.lit("")).alias("event"), render_surface(F.col("surface")).alias("surface"),
        "wt_mm", clock.render(F.col("clock_decimal_hours")).alias("orientation"), "depth_pct_wt", "length_mm", "width_mm",
        F.coalesce("repair_label", F.lit("")).alias("repair_label"),
    )


def assessment_now_and_end(growth: DataFrame, current: DataFrame, predictions: DataFrame) -> DataFrame:
    """Depth, safe pressure and repair factor now and in the last projected year."""
    now = current.select(*ROW, "method", F.col("sop_kgcm2").alias("_sop"), F.col("erf").alias("_erf"))
    rows = growth.join(by_rows(now), ROW, "left").join(by_rows(_labels(predictions)), ROW, "left")
    rows = kept(rows.select(
        *ROW, "anomaly_id", "joint_number", "abs_distance_m", "surface", "method", "depth_pct_wt", "_sop", "_erf", "_end", "cgr_mm_yr", "repair_label",
    ))
    zero = F.lit(0.0)
    depth, sop, ratio = F.coalesce("depth_pct_wt", zero), F.coalesce("_sop", zero), F.coalesce("_erf", zero)
    return with_serial(rows).select(
        *ROW, "sn", "anomaly_id", "joint_number", "abs_distance_m", render_surface(F.col("surface")).alias("surface"), "method",
        depth.alias("depth_now_pct"), F.coalesce("_end.depth_pct_wt", depth).alias("depth_end_pct"),
        sop.alias("sop_now_kgcm2"), F.coalesce("_end.sop_kgcm2", sop).alias("sop_end_kgcm2"),
        ratio.alias("erf_now"), F.coalesce("_end.erf", ratio).alias("erf_end"),
        "cgr_mm_yr", F.coalesce("repair_label", F.lit("")).alias("repair_label"),
    )


def circumferential_controlling(growth: DataFrame, current: DataFrame, predictions: DataFrame) -> DataFrame:
    """The table above for features the circumferential method controls."""
    kept = current.where(F.col("method") == "Kastner").select(*ROW)
    return assessment_now_and_end(growth.join(by_rows(kept), ROW, "left_semi"), current, predictions)


def circumferential_all(growth: DataFrame, lines: DataFrame, predictions: DataFrame) -> DataFrame:
    """The table above for every eligible feature, assessed by the circumferential method.

    Values now come from that method; values at the end come from the projection of the controlling one.
    """
    usable = is_circumferential() & F.col("width_mm").isNotNull() & (F.col("wt_mm") > 0) & F.col("depth_pct_wt").isNotNull()
    dims = lines.select("line_id", "diameter_mm", "smys_mpa").withColumn("uts_mpa", F.lit(None).cast("double"))
    rows = with_zone(growth.where(usable), lines).join(dims, "line_id").where(F.col("zone").isNotNull())
    rows = rows.withColumns({"design_factor": F.col("zone.design_factor"), "maop_kgcm2": F.col("zone.maop_kgcm2")})
    now = with_strength(rows, {"_k": "Kastner"}, None, F.lit(False)).select(*ROW, "_k.*")
    return assessment_now_and_end(growth.join(by_rows(now.select(*ROW)), ROW, "left_semi"), now, predictions)


def dent_table(strains: DataFrame) -> DataFrame:
    """Dents by chainage with strain components."""
    return with_serial(strains).select(
        *ROW, "sn", "anomaly_id", "abs_distance_m", "joint_number", render_surface(F.col("surface")).alias("surface"),
        clock.render(F.col("clock_decimal_hours")).alias("orientation"), "length_mm", "width_mm", "depth_mm", "od_mm",
        "wt_mm", "pipe_radius_mm", "e1", "e2", "e3", "ei", "eo", "resultant_strain_pct",
        F.array_join("flags", " · ").alias("flags"),
    )


def issues(findings: DataFrame) -> DataFrame:
    """Findings with the rank they are listed in: errors, warnings, information, then by code."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    return findings.select(
        "line_id", rank.alias("severity_rank"), F.upper("severity").alias("severity"), "code",
        F.coalesce("feature_id", F.lit("")).alias("feature_id"), "source_row",
    )


def ordered_issues(findings: DataFrame) -> DataFrame:
    """The listing itself; the sort is distributed by range."""
    return issues(findings).orderBy("line_id", "severity_rank", "code", "source_row")


def parameters(lines: DataFrame, zones: DataFrame, settings) -> DataFrame:
    """Per line, every parameter of the assessment as (section, item, value)."""
    def text(c: Column) -> Column:
        return c.cast("string")

    fixed = [
        ("FFP Method", "primary_method", F.lit(settings.primary_method)),
        ("CGR Computation", "mode", F.lit(settings.growth_mode)),
        ("CGR Computation", "split_by_surface", text(F.lit(settings.split_by_surface))),
        ("CGR Computation", "floor_negative_at_zero", text(F.lit(settings.floor_negative_at_zero))),
        ("CGR Computation", "unmatched_depth_assumption_pct_wt", text(F.lit(settings.unmatched_depth_pct))),
        ("Repair Prediction", "horizon_years", text(F.lit(settings.horizon_years))),
        ("Repair Prediction", "depth_trigger_pct_wt", text(F.lit(settings.depth_trigger_pct))),
        ("Repair Prediction", "erf_trigger", text(F.lit(settings.erf_trigger))),
        ("Pipeline", "diameter_mm", text(F.col("diameter_mm"))),
        ("Pipeline", "smys_mpa", text(F.col("smys_mpa"))),
        ("Pipeline", "material_grade", F.col("material_grade")),
        ("ILI Runs", "run1_date", text(F.col("run1_date"))),
        ("ILI Runs", "run2_date", text(F.col("run2_date"))),
        ("ILI Runs", "years_between", F.format_string("%.6f", dates.years_between(F.col("run1_date"), F.col("run2_date")))),
    ]
    entries = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(i).alias("item"), v.alias("value")) for s, i, v in fixed])
    rows = lines.select("line_id", F.explode(entries).alias("e")).select("line_id", "e.*")
    low, high = F.coalesce("chainage_m_min", "wt_mm_min"), F.coalesce("chainage_m_max", "wt_mm_max")
    zoned = zones.select(
        "line_id", F.lit("MAOP Zones").alias("section"), F.concat(F.lit("Z"), (F.col("zone_idx") + 1).cast("string")).alias("item"),
        F.format_string("%.1f – %.1f | %.2f | %.1f", low, high, F.col("design_factor"), F.col("maop_kgcm2")).alias("value"),
    )
    return rows.unionByName(zoned)


def erf_band(ratio: Column, places: int | None = None) -> Column:
    """Acceptance band of a repair factor, of the raw value or of the value as displayed."""
    value = ratio if places is None else F.bround(ratio, places)
    band = F.lit(vocab.ERF_BANDS[-1][0])
    for label, _, high in reversed(vocab.ERF_BANDS[:-1]):
        band = F.when(value <= high, label).otherwise(band)
    return band


def erf_bands(current: DataFrame, lines: DataFrame, places: int | None = None) -> DataFrame:
    """Features per line and acceptance band, empty bands included; infinite factors belong to none."""
    finite = F.col("erf").isNotNull() & (F.col("erf") < float("inf")) & ~F.isnan("erf")
    counted = current.where(finite).groupBy("line_id", erf_band(F.col("erf"), places).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    labels = F.array(*[F.lit(b[0]) for b in vocab.ERF_BANDS])
    return lines.select("line_id", F.explode(labels).alias("band")).join(counted, ["line_id", "band"], "left").na.fill(0)


def shape_table(growth: DataFrame) -> DataFrame:
    """Features per dimension class and side, with the share of all sided features of the line."""
    sided = growth.where(F.col("surface").isin("internal", "external"))
    rows = sided.groupBy("line_id", "dimension_class").pivot("surface", ["internal", "external"]).count().na.fill(0)
    rows = rows.withColumn("total", F.col("internal") + F.col("external"))
    whole = F.sum("total").over(Window.partitionBy("line_id"))
    return rows.withColumn("share_pct", 100.0 * F.col("total") / whole)


def top_features(growth: DataFrame, current: DataFrame, by: str, n: int = 20) -> DataFrame:
    """The ``n`` features of each line with the highest ``erf`` or ``depth_pct_wt``, with their attributes."""
    # The rank limit is applied before the shuffle, so a line with most rows sends only its best.
    order = Window.partitionBy("line_id").orderBy(F.coalesce(F.col(by), F.lit(0.0)).desc(), "source_row")
    best = current.select(*ROW, "anomaly_id", "wt_mm", "depth_pct_wt", "length_mm", "sop_kgcm2", "erf").withColumn(
        "rank", F.row_number().over(order)
    ).where(F.col("rank") <= n)
    attributes = growth.select(*ROW, "joint_number", "abs_distance_m", "surface")
    return best.join(by_rows(attributes), ROW, "left")


def summary_metrics(growth: DataFrame, current: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per line with the numbers of a report's summary."""
    side = lambda s: F.count_if(F.col("surface") == s)
    grown = growth.groupBy("line_id").agg(
        F.count(F.lit(1)).alias("n_features"),
        side("internal").alias("n_internal"), side("external").alias("n_external"),
        F.max("depth_pct_wt").alias("max_depth_pct"),
        F.max_by(F.struct("anomaly_id", "abs_distance_m"), F.struct("depth_pct_wt", -F.col("source_row"))).alias("_deep"),
        F.count_if(F.col("depth_pct_wt") >= 50).alias("_n50"), F.count("depth_pct_wt").alias("_nd"),
    )
    p95 = exact_quantiles(growth.where(F.col("surface").isin("internal", "external")), ["line_id", "surface"], "feature_cgr_mm_yr", [0.95])
    p95 = p95.where("n >= 2").groupBy("line_id").agg(
        F.max(F.when(F.col("surface") == "internal", F.col("q0"))).alias("p95_internal"),
        F.max(F.when(F.col("surface") == "external", F.col("q0"))).alias("p95_external"),
    )
    strength = current.groupBy("line_id").agg(
        F.count_if(F.col("erf") >= 1.0).alias("n_erf_ge_1"), F.count_if(F.col("depth_pct_wt") >= 80.0).alias("n_depth_ge_80"),
        F.max("erf").alias("max_erf"), F.max_by("source_row", F.struct("erf", -F.col("source_row"))).alias("max_erf_row"),
    )
    fires = F.col("repair_trigger") != "NONE_WITHIN_HORIZON"
    repairs = predictions.groupBy("line_id").agg(
        F.count_if(fires).alias("n_within_horizon"),
        F.count_if(F.col("repair_year_offset") == 0).alias("n_immediate"),
        F.count_if(F.col("repair_year_offset").between(1, 5)).alias("n_scheduled"),
        F.count_if(~fires).alias("n_monitor"),
    )
    where = growth.select("line_id", F.col("source_row").alias("max_erf_row"), F.col("joint_number").alias("max_erf_joint"),
                          F.col("abs_distance_m").alias("max_erf_chainage_m"))
    rows = grown.join(p95, "line_id", "left").join(strength, "line_id", "left").join(repairs, "line_id", "left")
    rows = rows.join(by_rows(where), ["line_id", "max_erf_row"], "left")
    counts = ["n_erf_ge_1", "n_depth_ge_80", "n_within_horizon", "n_immediate", "n_scheduled", "n_monitor"]
    return rows.na.fill(0, counts).withColumns({
        "internal_pct": 100.0 * F.col("n_internal") / F.greatest("n_features", F.lit(1)),
        "external_pct": 100.0 * F.col("n_external") / F.greatest("n_features", F.lit(1)),
        "deep_pct": 100.0 * F.col("_n50") / F.greatest("_nd", F.lit(1)),
        "max_depth_feature_id": F.col("_deep.anomaly_id"),
        "max_depth_chainage_m": F.col("_deep.abs_distance_m"),
    }).drop("_deep", "_n50", "_nd")


def _filled(counted: DataFrame, spine: DataFrame, keys: Sequence[str]) -> DataFrame:
    return spine.join(counted, list(keys), "left").na.fill(0, ["n"])


def depth_histogram(growth: DataFrame, lines: DataFrame) -> DataFrame:
    """Features per side and 10 % depth bin; the last bin includes 100 %."""
    sided = growth.where(F.col("surface").isin("internal", "external") & F.col("depth_pct_wt").isNotNull())
    bin_ = F.least(F.floor(F.col("depth_pct_wt") / 10.0), F.lit(9)).cast("int")
    counted = sided.groupBy("line_id", "surface", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = lines.select("line_id", F.explode(F.array(F.lit("internal"), F.lit("external"))).alias("surface")).select(
        "line_id", "surface", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("bin")
    )
    return _filled(counted, spine, ["line_id", "surface", "bin"])


def equal_width_histogram(rows: DataFrame, value: str, bins: int = 20, low: float | None = None, high_at_least: float | None = None) -> DataFrame:
    """Features per bin of equal width between the extremes of each line; the last bin is closed."""
    bounds = rows.where(F.col(value).isNotNull()).groupBy("line_id").agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    lo = F.col("_min") if low is None else F.lit(float(low))
    hi = F.col("_max") if high_at_least is None else F.greatest(F.col("_max"), F.lit(float(high_at_least)))
    bounds = bounds.select("line_id", lo.alias("_lo"), hi.alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    bounds = bounds.select(
        "line_id", F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("low"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("high"),
    )
    place = F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * bins)
    counted = (
        rows.where(F.col(value).isNotNull()).join(bounds, "line_id")
        .groupBy("line_id", F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    )
    spine = bounds.select("line_id", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return _filled(counted, spine, ["line_id", "bin"])


def length_histogram(growth: DataFrame) -> DataFrame:
    return equal_width_histogram(growth, "length_mm", low=0.0, high_at_least=200.0)


def orientation_rose(growth: DataFrame, lines: DataFrame) -> DataFrame:
    """Features per twelfth of the circumference, counted anticlockwise from three o'clock."""
    turn = F.pmod(3.0 - F.col("clock_decimal_hours"), F.lit(12.0))
    sector = F.least(F.floor(turn), F.lit(11)).cast("int")
    counted = growth.where(F.col("clock_decimal_hours").isNotNull()).groupBy("line_id", sector.alias("sector")).agg(
        F.count(F.lit(1)).alias("n")
    )
    spine = lines.select("line_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("sector"))
    return _filled(counted, spine, ["line_id", "sector"])


def erf_scatter(current: DataFrame, walls: int | None = None) -> DataFrame:
    """Length, depth and repair factor of the features by wall thickness; ``walls`` keeps each line's first ones, for a drawing."""
    rounded = F.bround("wt_mm", 1)
    rows = current.withColumn("wall_mm", rounded).where((F.col("wt_mm") > 0) & (F.abs(F.col("wt_mm") - F.col("wall_mm")) < 0.05))
    kept = (*ROW, "wall_mm", "length_mm", "depth_pct_wt", "erf")
    if walls is None:
        return rows.select(*kept)
    first = current.where(F.col("wt_mm") > 0).select("line_id", rounded.alias("wall_mm")).distinct()
    first = first.withColumn("_k", F.row_number().over(Window.partitionBy("line_id").orderBy("wall_mm"))).where(F.col("_k") <= walls)
    return rows.join(first.drop("_k"), ["line_id", "wall_mm"], "left_semi").select(*kept)


def repair_timeline(predictions: DataFrame) -> DataFrame:
    """Cumulative repairs per trigger for every year up to the last repair of the line."""
    due = predictions.where(F.col("repair_year_offset").isNotNull())
    per_year = due.groupBy("line_id", F.col("repair_year_offset").alias("year")).agg(
        F.count_if(F.col("repair_trigger") == "DEPTH_80").alias("_d"), F.count_if(F.col("repair_trigger") == "ERF_1.0").alias("_e")
    )
    spine = per_year.groupBy("line_id").agg(F.max("year").alias("_m")).select(
        "line_id", F.explode(F.sequence(F.lit(0), F.col("_m"))).alias("year")
    )
    so_far = Window.partitionBy("line_id").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    rows = spine.join(per_year, ["line_id", "year"], "left").na.fill(0)
    return rows.select("line_id", "year", F.sum("_d").over(so_far).alias("by_depth"), F.sum("_e").over(so_far).alias("by_erf"))


def repairs_per_year(predictions: DataFrame, horizon_years: int = 10) -> DataFrame:
    """Repairs per year offset 0 to the horizon for every projected line."""
    counted = predictions.where(F.col("repair_year_offset").isNotNull()).groupBy(
        "line_id", F.col("repair_year_offset").alias("year")
    ).agg(F.count(F.lit(1)).alias("n"))
    spine = predictions.select("line_id").distinct().select(
        "line_id", F.explode(F.sequence(F.lit(0), F.lit(horizon_years))).alias("year")
    )
    return _filled(counted, spine, ["line_id", "year"])


def dashboard(aligned: DataFrame, matches: DataFrame, current: DataFrame, predictions: DataFrame, report: DataFrame) -> DataFrame:
    """Headline numbers per line."""
    strength = current.groupBy("line_id").agg(
        F.count(F.lit(1)).alias("n_assessed"), F.count_if(F.col("erf") >= 1.0).alias("n_erf_ge_1"),
        F.count_if(F.col("depth_pct_wt") >= 80.0).alias("n_depth_ge_80"),
    )
    repairs = predictions.groupBy("line_id").agg(
        F.count(F.lit(1)).alias("n_tracked"), F.count_if(F.col("repair_year_offset").isNotNull()).alias("n_repairs")
    )
    rows = aligned.select("line_id", F.col("matched").alias("joint_pairs"), F.col("match_rate").alias("joint_match_rate"), "n_reversals")
    rows = rows.join(matches.select("line_id", F.col("matched").alias("feature_matches"), F.col("n_new").alias("n_run2")), "line_id", "left")
    rows = rows.join(strength, "line_id", "left").join(repairs, "line_id", "left").join(report.drop("summary"), "line_id", "left").na.fill(0)
    verdict = F.when(F.coalesce("has_critical", F.lit(False)), "REVIEW REQUIRED").when(F.col("n_error") > 0, "REVIEW").otherwise("OK")
    return rows.withColumn("verdict", verdict).drop("has_critical")
