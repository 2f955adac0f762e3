"""Inspection tables derived from the star-schema test tables.

``lineitem`` rows play the features, ``orders`` the pipe joints, ``supplier`` the inspection reports. The
derivation is deterministic, so an oracle can repeat it in SQL on the same files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

JOINTS_PER_LINE = 750


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def base(spark: SparkSession, folder: str) -> DataFrame:
    """One row per distinct (order, line number)."""
    # The least flag by its place among the two that are told apart: a least text would be found by sorting all rows.
    flag = F.col("l_returnflag")
    place = F.when(flag < "A", 0).when(flag == "A", 1).when(flag < "R", 2).when(flag == "R", 3).when(flag.isNotNull(), 4)
    rows = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"))
        .agg(
            F.min("l_partkey").alias("pk"),
            F.min("l_suppkey").alias("sk"),
            F.min("l_quantity").alias("q"),
            F.min("l_extendedprice").alias("ep"),
            F.min(place).alias("_rf"),
        )
    )
    return rows.withColumn("rf", F.when(F.col("_rf") == 1, "A").when(F.col("_rf") == 3, "R")).drop("_rf")


def _place(ok: Column) -> Column:
    return ok % JOINTS_PER_LINE


def _wall(ok: Column) -> Column:
    return F.when(ok % 3 == 0, 6.4).when(ok % 3 == 1, 7.1).otherwise(8.7)


def _features_run2(b: DataFrame) -> DataFrame:
    ok, ln, pk, sk = (F.col(c) for c in ("ok", "ln", "pk", "sk"))
    surface = F.when(F.col("rf") == "A", "internal").when(F.col("rf") == "R", "external").otherwise("unknown")
    kind = sk % 20
    fid = F.when(kind == 0, "DENT").when(kind == 1, "CRAC").when(kind == 2, "COCL").when(kind == 3, "UNDEFINED").otherwise("CORR")
    dim = F.element_at(
        F.array(*[F.lit(c) for c in ("CIGR", "CISL", "AXGR", "AXSL", "PITT", "PINH", "GENE", "UNDEFINED")]),
        (pk % 8 + 1).cast("int"),
    )
    return b.select(
        "ok", "ln", "pk",
        F.floor(ok / JOINTS_PER_LINE).cast("int").alias("line_id"),
        F.lit("run_2").alias("run_id"),
        (ok * 10 + ln).alias("source_row"),
        F.concat(F.lit("F"), ok.cast("string"), F.lit("-"), ln.cast("string")).alias("anomaly_id"),
        (_place(ok) * 10 + 40).cast("int").alias("joint_number"),
        (_place(ok) * 12.0 + ln * 1.5).alias("abs_distance_m"),
        (ln * 1.5).alias("upstream_weld_dist_m"),
        ((pk % 720) / 60.0).alias("clock_decimal_hours"),
        _wall(ok).alias("wt_mm"),
        (F.col("q") * 1.6).alias("depth_pct_wt"),
        (F.col("ep") / 180.0).alias("length_mm"),
        (5.0 + (sk * 13) % 300).alias("width_mm"),
        surface.alias("surface"),
        fid.alias("feature_identification"),
        dim.alias("dimension_class"),
        (fid == "COCL").alias("is_cluster_parent"),
        F.lit(None).cast("string").alias("cluster_parent_id"),
        F.when(pk % 50 == 0, "circumferential groove").otherwise("metal loss").alias("raw_description"),
        F.lit(None).cast("double").alias("latitude"),
        F.lit(None).cast("double").alias("longitude"),
    )


def features(spark: SparkSession, folder: str, run: int = 2, rows: DataFrame | None = None) -> DataFrame:
    """Features of the newer (2) or older (1) run; ``rows`` may give ``base`` where a caller has kept it."""
    rows = _features_run2(base(spark, folder) if rows is None else rows)
    if run == 1:
        ok, ln = F.col("ok"), F.col("ln")
        rows = rows.where(((ok + ln) % 4 != 0) & (ok % 37 != 0)).withColumns({
            "run_id": F.lit("run_1"),
            "anomaly_id": F.concat(F.lit("R"), ok.cast("string"), F.lit("-"), ln.cast("string")),
            "joint_number": F.col("joint_number") - 30,
            "upstream_weld_dist_m": F.col("upstream_weld_dist_m") + 0.01 * (ok % 40),
            "clock_decimal_hours": (F.col("clock_decimal_hours") + 0.04 * (ok % 30)) % 12.0,
            "depth_pct_wt": F.col("depth_pct_wt") * 0.5 + 0.1 * (ok % 50),
            "surface": F.when(ok % 11 == 0, "unknown").otherwise(F.col("surface")),
        })
    return rows.drop("ok", "ln", "pk")


def joints(spark: SparkSession, folder: str, run: int = 2) -> DataFrame:
    """Pipe joints of a run; the older run lacks every 37th and numbers them 30 lower."""
    ok = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(
        F.floor(ok / JOINTS_PER_LINE).cast("int").alias("line_id"),
        F.lit(f"run_{run}").alias("run_id"),
        (_place(ok) * 10 + (40 if run == 2 else 10)).cast("int").alias("joint_number"),
        (_place(ok) * 12.0).alias("abs_distance_start_m"),
        (11.5 + ((ok * 7919) % 1000) / 1000.0).alias("length_m"),
        _wall(ok).alias("wt_mm"),
        ok.alias("ok"),
    )
    return (rows.where(ok % 37 != 0) if run == 1 else rows).drop("ok")


def true_joint_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs the derivation implies, as an alignment would return them."""
    old = joints(spark, folder, 1).select("line_id", F.col("joint_number").alias("old_joint"))
    return old.withColumn("new_joint", F.col("old_joint") + 30)


def lines(spark: SparkSession, folder: str, mode: str = "wt") -> DataFrame:
    """Line properties with their pressure zones."""
    from girthline.operators.zones import zones_by_line

    ids = line_ids(spark, folder)
    dims = ids.select(
        "line_id",
        F.lit(711.0).alias("diameter_mm"),
        F.lit(482.0).alias("smys_mpa"),
        F.lit("API 5L X70").alias("material_grade"),
        F.lit(mode).alias("maop_zoning_mode"),
        F.lit("2018-12-15").cast("date").alias("run1_date"),
        F.lit("2023-03-15").cast("date").alias("run2_date"),
        F.lit(10).alias("horizon_years"),
    )
    return dims.join(zones_by_line(zones(spark, folder, mode)), "line_id", "left")


def line_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.floor(F.col("o_orderkey") / JOINTS_PER_LINE).cast("int").alias("line_id")
    ).distinct()


def zones(spark: SparkSession, folder: str, mode: str = "wt") -> DataFrame:
    """Two zones per line, bounded by wall thickness or by chainage."""
    if mode == "chainage":
        bounds = ((0, None, None, 0.0, 3000.0, 40.0), (1, None, None, 3000.0, 6000.0, 48.0))
    else:
        bounds = ((0, 6.0, 6.8, None, None, 40.0), (1, 6.8, 7.5, None, None, 48.0))

    def number(x: float | None, name: str) -> Column:
        return F.lit(x).cast("double").alias(name)

    entries = F.array(*[
        F.struct(
            F.lit(i).alias("zone_idx"), number(w0, "wt_mm_min"), number(w1, "wt_mm_max"), number(c0, "chainage_m_min"),
            number(c1, "chainage_m_max"), number(0.72, "design_factor"), number(maop, "maop_kgcm2"),
        )
        for i, w0, w1, c0, c1, maop in bounds
    ])
    return line_ids(spark, folder).select("line_id", F.explode(entries).alias("z")).select("line_id", "z.*")
