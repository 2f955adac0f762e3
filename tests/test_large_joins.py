"""Tables that grow with the rows are not broadcast, however small their files are."""

from pyspark.sql import functions as F

from girthline.operators import alignment, growth, matching, project
from girthline.plans import report
from girthline.session import kept


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _features(spark):
    return kept(spark.range(400).select(
        (F.col("id") % 4).cast("int").alias("line_id"), F.col("id").alias("source_row"), F.concat(F.lit("F"), "id").alias("anomaly_id"),
        (F.col("id") % 40).cast("int").alias("joint_number"), (F.col("id") * 1.5).alias("abs_distance_m"), (F.col("id") % 5 * 1.7).alias("upstream_weld_dist_m"),
        F.lit(3.0).alias("clock_decimal_hours"), F.lit(7.1).alias("wt_mm"), F.lit(20.0).alias("depth_pct_wt"), F.lit("internal").alias("surface"),
        F.lit("CORR").alias("feature_identification"), F.lit(False).alias("is_cluster_parent"), F.lit(None).cast("string").alias("cluster_parent_id"),
    ))


def test_joint_pairs_and_matches_of_kept_tables_are_shuffled(spark):
    rows = _features(spark)
    pairs = kept(rows.select("line_id", F.col("joint_number").alias("old_joint"), F.col("joint_number").alias("new_joint")).distinct())
    assert "BroadcastHashJoin" in _plan(rows.join(pairs, "line_id"))
    assert "Broadcast" not in _plan(matching.sided(rows, rows, pairs))
    matches = kept(matching.match(rows, rows, pairs))
    lines = rows.groupBy("line_id").agg(F.lit(4.0).alias("years_between"))
    assert "Broadcast" not in _plan(growth.feature_rates(rows, matches, lines).select("source_row", "old_source_row"))
    assert "Broadcast" not in _plan(alignment.unmatched_joints(rows, pairs, "old"))


def test_kept_joints_are_aligned_without_a_broadcast_of_anchors_or_segments(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(alignment, "kept", lambda df: plans.append(_plan(df)) or kept(df))
    joints = kept(spark.range(600).select(
        (F.col("id") % 2).cast("int").alias("line_id"), (F.col("id") / 2).cast("int").alias("joint_number"), (F.col("id") * 6.0).alias("abs_distance_start_m"),
        (11.0 + (F.col("id") * 7919 % 997) / 1000).alias("length_m"), F.lit(7.1).alias("wt_mm"),
    ))
    old = joints.where("joint_number % 37 <> 0")
    assert alignment.align(old, joints).count() == old.count()
    by_position = [p for p in plans if "_seg" in p]
    assert by_position and not any("BroadcastHashJoin [line_id" in p and "pos#" in p.split("BroadcastHashJoin", 1)[1].split("\n", 1)[0] for p in by_position)


def test_numbers_within_kept_rows_are_joined_by_chunk_without_a_broadcast(spark):
    assert "Broadcast" not in _plan(report.with_serial(_features(spark)))
