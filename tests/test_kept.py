"""Stages that later ones read are kept as Parquet, and numbering doesn't repeat the projection behind its rows."""

from pyspark.sql import functions as F

from girthline.plans import report as R
from girthline.session import kept


def test_kept_rows_are_the_same_and_read_by_column(spark):
    rows = spark.range(5).select(
        F.col("id").alias("source_row"), F.when(F.col("id") % 2 == 0, F.lit("a")).alias("t"), F.lit(float("nan")).alias("x"),
        F.struct(F.lit(1).alias("n"), F.array(F.lit(2.5)).alias("l")).alias("s"),
    )
    found = kept(rows)
    assert found.inputFiles() and found.dtypes == rows.dtypes
    assert sorted(map(str, found.collect())) == sorted(map(str, rows.collect()))
    assert kept(rows.where("false")).count() == 0


def test_anomaly_numbers_read_kept_rows(spark):
    growth = spark.createDataFrame(
        [(1, 10, "b", 5.0), (1, 11, "a", 5.0), (1, 12, None, 2.0), (2, 13, "c", 9.0)], "line_id int, source_row long, anomaly_id string, abs_distance_m double",
    ).withColumns({c: F.lit(1.0) for c in (
        "latitude", "longitude", "upstream_weld_dist_m", "wt_mm", "clock_decimal_hours", "depth_pct_wt", "length_mm", "width_mm")}).withColumns(
        {"joint_number": F.lit(1), "raw_description": F.lit("metal loss"), "surface": F.lit("internal")})
    predictions = spark.createDataFrame([(1, 11)], "line_id int, source_row long").withColumns({
        "repair_trigger": F.lit("DEPTH_80"), "predicted_repair_date": F.lit("2025-01-02").cast("date"), "run2_date": F.lit("2023-03-15").cast("date"),
        "horizon_years": F.lit(10), "years": F.array(F.struct(F.lit(1.0).alias("erf"))),
    })
    rows = R.anomalies(growth, predictions)
    assert rows.inputFiles(), "numbered from kept rows"
    assert {(r.source_row, r.sn, r.repair_label) for r in rows.collect()} == {(12, 1, ""), (11, 2, "02-01-2025"), (10, 3, ""), (13, 1, "")}
