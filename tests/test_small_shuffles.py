"""Kept stages leave no shuffle files behind, and formulas are neither repeated in conditions nor shuffled without need."""

import time

from pyspark.sql import functions as F
from test_golden import feature, features, lines, wt_zone

from girthline.operators import assess as A, flags as Q, matching as M, project as P
from girthline.session import CLEANUP, kept


def _shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toString()
    return {f.rpartition("/")[2] for f in files.replace("(", ",").replace(")", ",").split(",") if "/shuffle_" in f}


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_shuffle_files_of_a_kept_stage_go_when_it_is_written(spark):
    before = _shuffle_files(spark)
    rows = spark.range(1000).repartition(7)
    table = kept(rows)
    until = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert spark.conf.get(CLEANUP, "false") == "false"
    assert table.count() == rows.count() == 1000


def _state(spark, **over):
    """Rated features, their line, and the current state made from them."""
    dims = lines(spark, [wt_zone(0.0, 100.0, 70.0)])
    rows = features(spark, [feature(1, depth_pct_wt=50.0, **over), feature(2, depth_pct_wt=10.0, **over), feature(3, depth_pct_wt=85.0, **over), feature(4, depth_pct_wt=30.0, **over)])
    rated = kept(rows.withColumn("cgr_mm_yr", F.when(F.col("source_row") < 4, 0.45)))
    return rated, dims, P.current_state(A.assess(rated, dims), dims)


def test_due_lines_are_found_without_the_projection_in_a_condition(spark):
    rated, dims, current = _state(spark)
    found = Q.line_findings(rated, P.project(rated, kept(current)))
    conditions = [x for x in _optimized(found).splitlines() if x.lstrip(" :+-").startswith(("Filter", "Join"))]
    assert conditions and not any("transform(" in x for x in conditions)
    assert {tuple(r) for r in found.collect()} == {(1, "REPAIR_PREDICTED_WITHIN_HORIZON"), (1, "HIGH_CGR_POPULATION")}
    quiet = P.project(rated, kept(current)).where("source_row = 2")
    never = quiet.withColumn("repair_trigger", F.when(F.col("source_row") < 0, "DEPTH_80").otherwise("NONE_WITHIN_HORIZON"))
    unknown = quiet.withColumn("repair_trigger", F.lit(None).cast("string"))
    assert {r.code for r in Q.line_findings(rated, never.unionByName(unknown)).collect()} == {"HIGH_CGR_POPULATION"}


def test_a_state_made_from_rated_rows_is_projected_without_a_join(spark):
    rated, dims, current = _state(spark)
    alone = P.project(rated, kept(current))
    joined = P.project(rated, kept(current.drop("cgr_mm_yr")))
    assert "Join" not in _optimized(alone) and "Join" in _optimized(joined)
    columns = sorted(alone.columns)
    assert columns == sorted(joined.columns)
    rows = sorted(map(str, alone.select(columns).collect()))
    assert len(rows) == 3 and rows == sorted(map(str, joined.select(columns).collect()))
    keyless = kept(current).withColumn("source_row", F.when(F.col("source_row") != 2, F.col("source_row")))
    assert P.project(rated, keyless).count() == 2


def test_islands_carry_nothing_of_an_old_feature_twice(spark):
    rows = features(spark, [feature(1, surface="external", depth_pct_wt=41.0), feature(2, upstream_weld_dist_m=9.0)])
    pairs = spark.createDataFrame([(1, r.joint_number, r.joint_number) for r in rows.select("joint_number").distinct().collect()], "line_id int, old_joint int, new_joint int")
    sides = M.sided(rows, rows, pairs)
    carried = set(sides.schema["old"].dataType.names)
    assert not carried & set(sides.columns) and "depth_mm" not in carried
    got = {r.old_source_row: r.old.asDict() for r in M.match(rows, rows, pairs).collect()}
    for r in rows.collect():
        assert got[r.source_row] == {
            "abs_distance_m": r.abs_distance_m, "depth_pct_wt": r.depth_pct_wt, "depth_mm": r.depth_pct_wt / 100.0 * r.wt_mm,
            "clock_decimal_hours": r.clock_decimal_hours, "surface": r.surface, "wt_mm": r.wt_mm, "anomaly_id": r.anomaly_id}


def test_features_are_dealt_to_cells_once(spark):
    table = kept(spark.range(200).select(
        F.lit(1).alias("line_id"), (F.col("id") % 5).cast("int").alias("old_joint"), (F.col("id") % 2 + 1).cast("int").alias("side"), F.col("id").alias("source_row"),
        (F.col("id") * 0.37).alias("pos"), F.lit(3.0).alias("clock_decimal_hours"),
    ))
    plan = M._stretches(table, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(line_id" in x and "old_joint" in x for x in plan.splitlines() if "_cell" in x and "REPARTITION" not in x) <= 1
    assert M._stretches(table, 1.0).count() == 200
