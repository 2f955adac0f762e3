"""Remaining-strength pressures of a corroded pipe wall.

Each method is split into its steps - length factor, flow stress, area ratio, failure pressure - as column
expressions over plain columns. Callers add one step at a time, so a value used by several later steps is
computed once and generated code stays small. Depth, wall and diameter are in mm, stresses in MPa.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from girthline.functions.units import mpa_to_kgcm2

METHODS = ("B31G_Original", "B31G_Modified", "RSTRENG", "DNV_RP_F101", "Kastner")
FLOW_FACTOR = 1.1
FLOW_OFFSET_MPA = 69.0
UTS_OFFSET_MPA = 110.0


def _null(kind: str = "double") -> Column:
    return F.lit(None).cast(kind)


def _safe(c: Column) -> Column:
    """A divisor: zero becomes null, because division by zero raises."""
    return F.nullif(c, F.lit(0.0))


def slenderness(length_mm: Column, t: Column, D: Column) -> Column:
    return (length_mm * length_mm) / _safe(D * t)


def length_factor(method: str, z: Column) -> Column:
    """Bulging factor; null where the method has none at this slenderness."""
    if method == "B31G_Original":
        return F.when(z <= 20.0, F.sqrt(1.0 + 0.8 * z))
    if method in ("B31G_Modified", "RSTRENG"):
        return F.when(z <= 50.0, F.sqrt(F.greatest(F.lit(0.0), 1.0 + 0.6275 * z - 0.003375 * z * z))).otherwise(
            0.032 * z + 3.3
        )
    if method == "DNV_RP_F101":
        return F.sqrt(1.0 + 0.31 * z)
    return _null()


def flow_stress(method: str, smys: Column, uts: Column) -> Column:
    if method in ("B31G_Modified", "RSTRENG"):
        return smys + FLOW_OFFSET_MPA
    if method == "DNV_RP_F101":
        return F.coalesce(uts, smys + UTS_OFFSET_MPA)
    return FLOW_FACTOR * smys


def area_ratio(method: str, x: Column, z: Column, width_mm: Column, D: Column) -> Column:
    """Share of the section that is lost, from relative depth ``x``."""
    if method == "B31G_Original":
        return F.when(z <= 20.0, (2.0 / 3.0) * x).otherwise(x)
    if method in ("B31G_Modified", "RSTRENG"):
        return 0.85 * x
    if method == "DNV_RP_F101":
        return x
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (width_mm / _safe(math.pi * D)) * x))


def failure_pressure(method: str, area: Column, factor: Column, flow: Column, t: Column, D: Column) -> Column:
    """MPa. The allowable-stress form is not floored at zero, the others are."""
    if method == "Kastner":
        return F.greatest(F.lit(0.0), (4.0 * flow * t / _safe(D)) * (1.0 - area))
    denom = 1.0 - area / _safe(factor)
    if method == "B31G_Original":
        reduction = F.when(factor.isNull(), 1.0 - area).when(denom <= 0, 0.0).otherwise((1.0 - area) / _safe(denom))
        return F.greatest(F.lit(0.0), 2.0 * flow * t / _safe(D) * reduction)
    if method == "DNV_RP_F101":
        return F.when(denom <= 0, 0.0).otherwise(2.0 * flow * t / _safe(D - t) * ((1.0 - area) / _safe(denom)))
    stress = F.when(denom <= 0, 0.0).otherwise(flow * (1.0 - area) / _safe(denom))
    return F.greatest(F.lit(0.0), 2.0 * stress * t / _safe(D))


def branch(method: str, z: Column) -> Column:
    limit = {"B31G_Original": 20.0, "B31G_Modified": 50.0, "RSTRENG": 50.0}.get(method)
    return F.lit("") if limit is None else F.when(z <= limit, "low_z").otherwise("high_z")


def erf(maop_kgcm2: Column, sop_kgcm2: Column) -> Column:
    """Operating over safe pressure; infinite where nothing is safe."""
    return F.when(sop_kgcm2 > 0, maop_kgcm2 / _safe(sop_kgcm2)).when(sop_kgcm2.isNotNull(), F.lit(float("inf")))


def design_pressure_kgcm2(smys: Column, t: Column, D: Column, fd: Column) -> Column:
    """Barlow design pressure; null for any input that is not positive."""
    valid = (smys > 0) & (t > 0) & (D > 0) & (fd > 0)
    return F.when(valid, 2.0 * smys * t / _safe(D) * fd * (1.0 / 0.0980665))


def _notes(method: str) -> Column:
    empty = F.array().cast("array<string>")
    if method == "RSTRENG":
        return F.array(F.lit("RSTRENG: no river-bottom profile; 0.85 dL approximation as in B31G Modified."))
    if method == "Kastner":
        return F.array(F.lit("Kastner: net-section approximation."))
    if method == "DNV_RP_F101":
        text = F.format_string(
            "UTS estimated as SMYS + %.0f MPa = %.1f MPa.", F.lit(UTS_OFFSET_MPA), F.col("smys_mpa") + UTS_OFFSET_MPA
        )
        return F.when(F.col("uts_mpa").isNull(), F.array(text)).otherwise(empty)
    return empty


def with_strength(df: DataFrame, methods: dict[str, str], rival: str | None, rival_runs: Column) -> DataFrame:
    """Adds one assessment struct per entry of ``methods`` (output column -> method), flags included.

    The first entry controls, unless the ``rival`` entry runs and has the lower safe pressure; ``_beats`` says
    which.

    Needs ``depth_pct_wt, wt_mm, length_mm, width_mm, diameter_mm, smys_mpa, uts_mpa, design_factor,
    maop_kgcm2``. RSTRENG without a measured depth profile is the modified form under its own name.
    """
    t, D, smys, uts = F.col("wt_mm"), F.col("diameter_mm"), F.col("smys_mpa"), F.col("uts_mpa")
    x, z = F.col("_x"), F.col("_z")
    df = df.withColumns({
        "_depth": F.col("depth_pct_wt") / 100.0 * t,
        "_z": slenderness(F.col("length_mm"), t, D),
    }).withColumns({"_x": F.col("_depth") / _safe(t)}).withColumns({"_pct": 100.0 * x})
    df = df.withColumns({
        **{f"_m_{c}": length_factor(m, z) for c, m in methods.items()},
        **{f"_f_{c}": flow_stress(m, smys, uts) for c, m in methods.items()},
        **{f"_a_{c}": area_ratio(m, x, z, F.col("width_mm"), D) for c, m in methods.items()},
    })
    df = df.withColumns({
        f"_pf_{c}": failure_pressure(m, F.col(f"_a_{c}"), F.col(f"_m_{c}"), F.col(f"_f_{c}"), t, D)
        for c, m in methods.items()
    })
    df = df.withColumns({f"_sop_{c}": mpa_to_kgcm2(F.col(f"_pf_{c}") * F.col("design_factor")) for c in methods})
    df = df.withColumns({f"_erf_{c}": erf(F.col("maop_kgcm2"), F.col(f"_sop_{c}")) for c in methods})

    first = next(iter(methods))
    lower = F.lit(False) if rival is None else F.col(f"_sop_{rival}") < F.col(f"_sop_{first}")
    df = df.withColumn("_beats", F.coalesce(rival_runs & lower, F.lit(False)))

    def flags(c: str, method: str) -> Column:
        found = [F.when(F.col(f"_erf_{c}") >= 1.0, "ERF_EXCEEDS_1"), F.when(F.col("_pct") >= 80.0, "DEPTH_EXCEEDS_80")]
        if method == "B31G_Original":
            found.insert(0, F.when(z > 50.0, "LONG_DEFECT_OUTSIDE_B31G"))
        if method != "Kastner":
            found.append(F.when(F.col("length_mm") < t, "VERY_SHORT_DEFECT"))
        found.append(F.when(F.col("zone_fallback"), "MAOP_ZONE_NOT_FOUND"))
        return F.array_compact(F.array(*found))

    def result(order: int, c: str, method: str) -> Column:
        circumferential = method == "Kastner"
        return F.struct(
            F.lit(method).alias("method"),
            F.lit(order).alias("method_ord"),
            F.col("_pct").alias("depth_pct_wt"),
            F.col("_depth").alias("depth_mm"),
            (_null() if circumferential else F.col("length_mm")).alias("length_mm"),
            (F.col("width_mm") if circumferential else _null()).alias("width_mm"),
            t.alias("wt_mm"),
            mpa_to_kgcm2(F.col(f"_pf_{c}")).alias("pf_kgcm2"),
            F.col(f"_sop_{c}").alias("sop_kgcm2"),
            F.col("maop_kgcm2").alias("maop_kgcm2"),
            F.col(f"_erf_{c}").alias("erf"),
            F.col(f"_m_{c}").alias("folias_factor_m"),
            (_null() if circumferential else z).alias("z_value"),
            F.col(f"_f_{c}").alias("flow_stress_mpa"),
            F.col(f"_a_{c}").alias("area_metal_loss_ratio"),
            branch(method, z).alias("branch_used"),
            F.lit(method == "RSTRENG").alias("using_approximate_profile"),
            _notes(method).alias("notes"),
            flags(c, method).alias("flags"),
            (~F.col("_beats") if c == first else F.col("_beats") if c == rival else F.lit(False)).alias("is_controlling"),
        )

    df = df.withColumns({c: result(i, c, m) for i, (c, m) in enumerate(methods.items())})
    helpers = [f"_{k}_{c}" for k in ("m", "f", "a", "pf", "sop", "erf") for c in methods]
    return df.drop("_depth", "_x", "_z", "_pct", *helpers)


def with_dent_strain(df: DataFrame) -> DataFrame:
    """Adds bending and membrane strain of a dent; zero with a flag where the geometry is unusable.

    Needs ``length_mm, width_mm, depth_mm, wt_mm, od_mm``.
    """
    length, width, depth, wall, od = (F.col(c) for c in ("length_mm", "width_mm", "depth_mm", "wt_mm", "od_mm"))

    def radius(chord: Column) -> Column:
        return (chord * chord + 4.0 * depth * depth) / _safe(8.0 * depth)

    df = df.withColumns({
        "_pipe": F.coalesce((wall > 0) & (od > 0), F.lit(False)),
        "_deep": F.coalesce(depth > 0, F.lit(False)),
        "_sized": F.coalesce((length > 0) & (width > 0), F.lit(False)),
        "_along": depth / _safe(length),
        "_across": depth / _safe(width),
        "pipe_radius_mm": F.coalesce(od, F.lit(0.0)) / 2.0,
    })
    usable = F.col("_pipe") & F.col("_deep") & F.col("_sized")

    def or_zero(c: Column) -> Column:
        return F.when(usable, c).otherwise(0.0)

    df = df.withColumns({
        "e1": or_zero((wall / 2.0) * (1.0 / _safe(F.col("pipe_radius_mm")) + 1.0 / _safe(radius(width)))),
        "e2": or_zero((wall / 2.0) * (1.0 / _safe(radius(length)))),
        "e3": or_zero(0.5 * (F.col("_along") * F.col("_along"))),
        "_e3w": or_zero(0.5 * (F.col("_across") * F.col("_across"))),
    })

    def combined(hoop: Column, axial: Column) -> Column:
        return F.sqrt(hoop * hoop + hoop * axial + axial * axial)

    e1, e2, e3, e3w = (F.col(c) for c in ("e1", "e2", "e3", "_e3w"))
    df = df.withColumns({"eo": combined(e1 + e3w, e2 + e3), "ei": combined(-e1 - e3w, -e2 + e3)})
    df = df.withColumn("resultant_strain_pct", F.greatest("ei", "eo") * 100.0)
    geometry = (
        F.when(~F.col("_pipe"), "INVALID_DIMENSIONS")
        .when(~F.col("_deep"), "ZERO_OR_NEGATIVE_DEPTH")
        .when(~F.col("_sized"), "INVALID_DIMENSIONS")
    )
    strain = F.when(F.col("resultant_strain_pct") >= 6.0, "HIGH_STRAIN_REJECT_CRITERIA")
    return df.withColumn("flags", F.array_compact(F.array(geometry, strain))).drop(
        "_pipe", "_deep", "_sized", "_along", "_across", "_e3w"
    )
