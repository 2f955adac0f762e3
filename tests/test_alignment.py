"""Alignment of lines without unlike lengths and without any, against one sweep over the whole line."""

import numpy as np
import pytest

from girthline.operators import alignment as J

SCHEMA = "line_id string, joint_number long, abs_distance_start_m double, length_m double, wt_mm double"


def runs(spark, line, lengths, keep, seed=0):
    rng = np.random.default_rng(seed)
    start = np.concatenate(([0.0], np.cumsum(np.nan_to_num(lengths, nan=12.0))))[:-1]
    wall = rng.choice([6.4, 7.1], len(lengths))
    row = lambda i, k: (line, k + 10 * i, float(start[i]), None if np.isnan(lengths[i]) else float(lengths[i]), float(wall[i]))
    return [row(i, 0) for i in keep], [row(i, 30) for i in range(len(lengths))]


def one_sweep(old, new):
    side = lambda rows: {
        "exact": np.array([r[3] or 0.0 for r in rows]), "length": np.array([r[3] or 0.0 for r in rows], np.float32),
        "wall": np.array([r[4] for r in rows], np.float32), "start": np.array([r[2] for r in rows], np.float32),
    }
    band = max(20, int(max(len(old), len(new)) * 0.05), abs(len(old) - len(new)))
    return {(old[x][0], old[x][1], new[y][1]) for x, y in J.align_segment(side(old), side(new), band, 0)}


def frames(spark, *pairs):
    return [spark.createDataFrame([r for p in pairs for r in p[k]], SCHEMA) for k in (0, 1)]


def found(pairs):
    return {(r.line_id, r.old_joint, r.new_joint) for r in pairs.collect()}


def test_line_of_few_lengths_is_cut_by_longer_stretches(spark):
    rng = np.random.default_rng(4)
    lengths = rng.choice([10.0, 11.0, 11.5, 12.0, 12.2, 12.4], 3000)
    keep = [i for i in range(3000) if i % 61 != 7]
    both = frames(spark, runs(spark, "north", lengths, keep))
    modes, joints = J.line_modes(*both), J._both(*both)
    rows = J.anchored(joints, modes)
    sizes = rows.where("NOT is_anchor").groupBy("seg").count()
    assert sizes.agg({"count": "max"}).first()[0] < 0.05 * 6000
    got = found(J.align_by_length(joints, modes))
    want = one_sweep(*runs(spark, "north", lengths, keep))
    # Equal neighbours may stand for each other beside a missing joint.
    assert len(got) == len(want) and len(got & want) > 0.98 * len(want)


@pytest.mark.parametrize("tile", [64, 500])
def test_lines_without_anchors_are_aligned_in_tiles(spark, tile):
    rng = np.random.default_rng(5)
    same, two = np.full(350, 12.0), rng.choice([12.0, 9.0], 420)
    two[rng.integers(0, 420, 12)] = np.nan
    pairs = runs(spark, "same", same, [i for i in range(350) if i % 50 != 3]), runs(spark, "two", two, [i for i in range(420) if i % 29 != 4], 1)
    both = frames(spark, *pairs)
    modes, joints = J.line_modes(*both), J._both(*both)
    got = found(J.align_by_length(joints, modes, anchor_joints=(400,), long_segment=100, tile=tile))
    assert got == one_sweep(*pairs[0]) | one_sweep(*pairs[1])


def two_pointer(old, new):
    old, new = (sorted((r[2], r[1]) for r in rows if r[2] is not None) for rows in (old, new))
    i = j = 0
    pairs = set()
    while i < len(old) and j < len(new):
        d = new[j][0] - old[i][0]
        if abs(d) <= J.DISTANCE_TOLERANCE_M:
            pairs.add(("far", old[i][1], new[j][1]))
            i, j = i + 1, j + 1
        elif d > 0:
            i += 1
        else:
            j += 1
    return pairs


def test_chainage_pairs_of_many_chunks(spark):
    rng = np.random.default_rng(6)
    old, new = ([("far", k, float(x), 0.0, 7.1) for k, x in enumerate(np.sort(rng.uniform(0, 40_000, n)))] for n in (900, 1500))
    old += [("far", 5000, None, 0.0, 7.1)]
    both = frames(spark, (old, new))
    modes, joints = J.line_modes(*both), J._both(*both)
    assert modes.first().method == "nearest_distance"
    for chunk_m in (600.0, 20_000.0):
        assert found(J.align_by_distance(joints, modes, chunk_m)) == two_pointer(old, new)
    with pytest.raises(ValueError):
        J.align_by_distance(joints, modes, 100.0)
