"""Islands never part two features that could be paired, and are cut where nothing can."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from girthline.operators import matching as M

SCHEMA = "line_id string, old_joint int, side int, source_row long, pos double, clock_decimal_hours double"


@pytest.mark.parametrize("unknown", [0.0, 0.05])
def test_islands_hold_all_candidates(spark, unknown):
    rng = np.random.default_rng(3)
    rows = []
    for joint in range(12):
        for k in range(40):
            clock = None if rng.random() < unknown else float(np.round(rng.uniform(0, 12), 2))
            rows.append((f"l{joint % 2}", joint, int(rng.integers(1, 3)), joint * 100 + k, float(np.round(rng.uniform(0, 25), 2)), clock))
    found = M.with_islands(spark.createDataFrame(rows, SCHEMA), 1.0, 1.5).collect()
    assert len(found) == len(rows)
    at = {r.source_row: (r.old_joint, r.island) for r in found}
    for a in rows:
        for b in rows:
            if a[1] == b[1] and a[2] < b[2] and abs(a[4] - b[4]) <= 1.0:
                turn = 0.0 if None in (a[5], b[5]) else min(abs(a[5] - b[5]), 12 - abs(a[5] - b[5]))
                assert turn > 1.5 or at[a[3]] == at[b[3]]
    for r in found:
        mine = [x for x in found if at[x.source_row] == at[r.source_row]]
        assert (r.n_old, r.n_new) == (sum(x.side == 1 for x in mine), sum(x.side == 2 for x in mine))
    assert len(set(at.values())) > len({(j, np.floor(p)) for _, j, _, _, p, _ in rows}) * (0.3 if not unknown else 0.1)


def test_islands_go_round_the_girth(spark):
    rows = [("a", 1, 1, 1, 5.0, 11.8), ("a", 1, 2, 2, 5.2, 0.4), ("a", 1, 2, 3, 5.1, 5.0), ("a", 1, 1, 4, 5.1, 6.2), ("a", 1, 1, 5, 9.0, 5.0), ("a", 2, 1, 6, 5.0, 12.0)]
    at = {r.source_row: r.island for r in M.with_islands(spark.createDataFrame(rows, SCHEMA), 1.0, 1.5).collect()}
    assert at[1] == at[2] != at[3] == at[4] and at[5] not in (at[1], at[3])
    joined = M.with_islands(spark.createDataFrame([*rows, ("a", 1, 1, 7, 5.0, None)], SCHEMA), 1.0, 1.5).where(F.col("old_joint") == 1)
    assert len({r.island for r in joined.collect() if r.pos < 8}) == 1


def test_long_islands_stream_through_batches(spark):
    """An island goes on over several Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [("a", j, s, j * 1000 + s * 100 + k, 0.3 * k + 0.01 * s, 6.0, "internal", 20.0, False, None) for j in (1, 2, 3) for s in (1, 2) for k in range(15)]
        table = spark.createDataFrame(rows, SCHEMA + ", surface string, depth_pct_wt double, is_cluster_parent boolean, old " + M.OLD_TYPE)
        got = M.match_ambiguous(M.with_islands(table, 1.0, 1.5)).collect()
        assert {(r.old_source_row, r.new_source_row) for r in got} == {(j * 1000 + 100 + k, j * 1000 + 200 + k) for j in (1, 2, 3) for k in range(15)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
