"""Queries that show all of an operator's work: findings of every stage, costs of every candidate."""

import os

import pytest
from pyspark.sql import functions as F

from checks import engine, reports
from girthline.sources import tables as T

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def test_findings_of_joints_matches_and_intervals(spark, monkeypatch):
    joints, lines, features = T.joints, T.lines, T.features
    monkeypatch.setattr(T, "joints", lambda s, f, run=2: joints(s, f, run).where((F.lit(run) == 2) | (F.col("joint_number") % 20 == 10)))
    monkeypatch.setattr(T, "lines", lambda *a: lines(*a).withColumn("run1_date", F.col("run2_date")))
    monkeypatch.setattr(T, "features", lambda *a: features(*a).withColumn("is_cluster_parent", F.lit(False)))
    found = {(r.stage, r.code) for r in reports.QUERIES["findings_collected"](spark, FOLDER).select("stage", "code").distinct().collect()}
    assert {(2, "LOW_JOINT_MATCH_RATE"), (3, "NO_CLUSTERS_IN_EITHER_RUN"), (4, "INTERVAL_NOT_POSITIVE"), (5, "ERF_EXCEEDS_1")} <= found


def test_costs_of_all_candidates(spark, monkeypatch):
    """New features repeated 0.4 m and 1.3 m further on: an island holds several of a run."""
    features = T.features

    def dense(s, f, run=2):
        rows = features(s, f, run)
        if run == 1:
            return rows
        shift = F.explode(F.array(F.lit(0.0), F.lit(0.4), F.lit(1.3)))
        moved = rows.withColumn("_by", shift).withColumn("upstream_weld_dist_m", F.col("upstream_weld_dist_m") + F.col("_by"))
        return moved.withColumn("source_row", F.col("source_row") * 10 + (F.col("_by") * 10).cast("int") % 10).drop("_by")

    monkeypatch.setattr(T, "features", dense)
    got = engine.QUERIES["match_costs"](spark, FOLDER).collect()
    at = {}
    for r in engine.M.sided(T.features(spark, FOLDER, 1), T.features(spark, FOLDER, 2), T.true_joint_pairs(spark, FOLDER)).collect():
        at.setdefault((r.line_id, r.old_joint), ([], []))[r.side - 1].append((r.source_row, r.pos))
    want = [(o, n) for old, new in at.values() for o, x in old for n, y in new if abs(x - y) <= 1.0]
    assert len(want) > 1.5 * len({o for o, _ in want})
    assert sorted((r.old_source_row, r.new_source_row) for r in got) == sorted(want)
