"""Alignment and assignment kernels against direct computations. No Spark needed."""

import itertools

import numpy as np
import pandas as pd
import pytest

from girthline.operators import alignment as J, matching as M


def joints(rng, n):
    length = np.round(rng.uniform(11.5, 12.5, n), 3)
    return {
        "exact": length, "length": length.astype(np.float32), "wall": rng.choice([6.4, 7.1, 8.7], n).astype(np.float32),
        "start": np.cumsum(length).astype(np.float32),
    }


def take(a, index):
    return {k: v[index] for k, v in a.items()}


def plain_alignment(a, b, band, shift):
    """Cell by cell, with the same tie order."""
    n, m = len(a["length"]), len(b["length"])
    score = J._scores(a, b, slice(0, n), slice(0, m))
    best = np.full((n + 1, m + 1), -np.inf)
    move = np.zeros((n + 1, m + 1), dtype=int)
    best[0, 0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            if (i, j) == (0, 0) or abs(i + shift - j) > band:
                continue
            diag = best[i - 1, j - 1] + score[i - 1, j - 1] if i and j else -np.inf
            up = best[i - 1, j] + J.GAP if i else -np.inf
            left = best[i, j - 1] + J.GAP if j else -np.inf
            top = max(diag, up, left)
            best[i, j] = top
            move[i, j] = 0 if diag == top else 1 if up == top else 2
    pairs, i, j = [], n, m
    while i and j:
        if move[i, j] == 0:
            la, lb = a["exact"][i - 1], b["exact"][j - 1]
            if 1.0 - abs(la - lb) / max(la, lb) >= J.MIN_SIMILARITY:
                pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif move[i, j] == 1:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("small", [0, 200_000])
def test_banded_alignment_equals_cell_by_cell(seed, small, monkeypatch):
    monkeypatch.setattr(J, "SMALL_SEGMENT", small)
    rng = np.random.default_rng(seed)
    new = joints(rng, 150)
    keep = np.flatnonzero(rng.random(150) > 0.08)
    old = take(new, keep)
    for band in (20, 40):
        got = J.align_segment(old, new, max(band, 150 - len(keep)), 0)
        assert got == plain_alignment(old, new, max(band, 150 - len(keep)), 0)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def test_identical_sequences_align_in_full():
    a = joints(np.random.default_rng(1), 80)
    assert J.align_segment(a, a, 20, 0) == [(i, i) for i in range(80)]


def test_insertions_are_left_unmatched():
    b = joints(np.random.default_rng(2), 60)
    keep = np.array([i for i in range(60) if i not in (10, 30, 31)])
    pairs = J.align_segment(take(b, keep), b, 20, 0)
    assert [p[1] for p in pairs] == keep.tolist()


def test_unlike_pair_is_dropped():
    a = {"exact": np.array([12.0]), "length": np.array([12.0], np.float32), "wall": np.array([6.4], np.float32), "start": np.zeros(1, np.float32)}
    b = {**a, "exact": np.array([6.0]), "length": np.array([6.0], np.float32)}
    assert J.align_segment(a, b, 20, 0) == []


@pytest.mark.parametrize("seed", range(60))
def test_assignment_is_cheapest(seed):
    rng = np.random.default_rng(seed)
    n, m = (int(x) for x in rng.integers(1, 6, 2))
    cost = np.where(rng.random((n, m)) < (1.0, 0.6, 0.3)[seed % 3], np.round(rng.random((n, m)) * 10, seed % 2 * 3), np.inf)
    rows, cols = np.nonzero(np.isfinite(cost))
    found = M.assign(n, m, rows, cols, cost[rows, cols])
    got = [(int(rows[k]), int(cols[k])) for k in found]
    assert len({r for r, _ in got}) == len({c for _, c in got}) == len(got)
    best = (0, 0.0)
    for size in range(1, min(n, m) + 1):
        for left in itertools.combinations(range(n), size):
            for right in itertools.permutations(range(m), size):
                total = sum(cost[x, y] for x, y in zip(left, right))
                if np.isfinite(total):
                    best = max(best, (size, -total))
    assert (len(got), round(sum(cost[x, y] for x, y in got), 9)) == (best[0], round(-best[1], 9))


def test_ten_thousand_features_of_one_island_take_seconds():
    import time

    rng = np.random.default_rng(1)
    pos = np.sort(rng.uniform(0, 400.0, 5000))
    rows = [feature(1, k, float(x), float(c)) for k, (x, c) in enumerate(zip(pos, rng.uniform(0, 12, 5000)))]
    rows += [feature(2, k, r["pos"] + float(d), (r["clock_decimal_hours"] + float(t)) % 12) for k, (r, d, t) in enumerate(zip(rows, rng.normal(0, 0.05, 5000), rng.normal(0, 0.3, 5000)))]
    begun = time.time()
    assert len(solve(rows)) > 4500 and time.time() - begun < 10


def feature(side, row, pos, clock=6.0, surface="internal", depth=20.0, parent=False):
    return {"side": side, "source_row": row, "pos": pos, "clock_decimal_hours": clock, "surface": surface, "depth_pct_wt": depth, "is_cluster_parent": parent}


def solve(rows):
    frame = pd.DataFrame(rows).sort_values(["side", "source_row"], kind="stable", ignore_index=True)
    return {(int(frame.source_row[o]), int(frame.source_row[n])): (round(c, 6), p) for o, n, c, p in M.solve_islands(frame)}


def brute_pass(old, new, limits):
    """Most pairs at least cost, by trying all of them."""
    def cost(a, b):
        axial = abs(a["pos"] - b["pos"])
        turn = abs(a["clock_decimal_hours"] - b["clock_decimal_hours"])
        turn = min(turn, 12 - turn)
        if axial > limits[0] or turn > limits[1]:
            return None
        c = axial + 0.3 * turn
        c += 10.0 if "unknown" not in (a["surface"], b["surface"]) and a["surface"] != b["surface"] else 0.0
        return c + (1.0 if b["depth_pct_wt"] < 0.5 * a["depth_pct_wt"] else 0.0)

    best = (0, 0.0, [])
    for size in range(1, min(len(old), len(new)) + 1):
        for left in itertools.combinations(old, size):
            for right in itertools.permutations(new, size):
                costs = [cost(a, b) for a, b in zip(left, right)]
                if None in costs:
                    continue
                if (size, -sum(costs)) > (best[0], -best[1]):
                    best = (size, sum(costs), [(a, b, c) for a, b, c in zip(left, right, costs)])
    return best[2]


@pytest.mark.parametrize("seed", range(15))
def test_passes_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    make = lambda side, k: [feature(side, i, float(rng.uniform(0, 1.2)), float(rng.uniform(0, 12)), rng.choice(["internal", "external", "unknown"]), float(rng.uniform(5, 60))) for i in range(k)]
    old, new = make(1, int(rng.integers(1, 5))), make(2, int(rng.integers(1, 5)))
    got = solve(old + new)
    want, left, right = {}, list(old), list(new)
    for level, limits in enumerate(M.PASSES, start=1):
        for a, b, c in brute_pass(left, right, limits):
            if c <= limits[2]:
                want[(a["source_row"], b["source_row"])] = (round(c, 6), level)
        left = [a for a in left if a["source_row"] not in {k[0] for k in want}]
        right = [b for b in right if b["source_row"] not in {k[1] for k in want}]
    assert got == want


def test_surface_mismatch_blocks_until_the_next_pass():
    """A mismatched pair is feasible, so it may be assigned for count and then put back."""
    rows = [feature(1, 0, 5.00), feature(1, 1, 5.05, surface="external"), feature(2, 0, 5.02)]
    assert solve(rows) == {(0, 0): (0.02, 1)}


def test_shrunk_depth_moves_to_a_later_pass():
    rows = [feature(1, 0, 5.0, depth=40.0), feature(2, 0, 5.0, depth=10.0)]
    assert solve(rows) == {(0, 0): (1.0, 2)}


def test_unknown_clock_is_no_obstacle():
    rows = [feature(1, 0, 5.0, clock=np.nan), feature(2, 0, 5.05, clock=1.0)]
    assert solve(rows) == {(0, 0): (0.05, 1)}


def merge(old, new, width):
    """Chunk by chunk, the joints waiting before each found by composition."""
    def frame(chunk):
        rows = [(side, i, x, x < chunk * width) for side, run in ((1, old), (2, new)) for i, x in enumerate(run)
                if chunk * width - J.DISTANCE_TOLERANCE_M * 1.01 <= x < (chunk + 1) * width]
        table = pd.DataFrame(rows, columns=["side", "joint_number", "abs_distance_start_m", "halo"]).assign(length_m=0.0)
        return table.astype({"side": int, "joint_number": int, "abs_distance_start_m": float, "halo": bool})

    chunks = {int(x // width): None for x in sorted(old + new)}
    maps = pd.DataFrame([(1, c, *J._Arrivals(frame(c)).after()) for c in chunks], columns=["line_id", "_chunk", "low", "after"])
    out = []
    for c, entry in J._composed(maps)[["_chunk", "entry"]].itertuples(index=False) if len(maps) else []:
        chunk = J._Arrivals(frame(c))
        out += [(int(chunk.joint[o]), int(chunk.joint[n])) for o, n in zip(*chunk.pairs(entry))]
    return sorted(out)


def two_pointer(old, new, tol=J.DISTANCE_TOLERANCE_M):
    i = j = 0
    pairs = []
    while i < len(old) and j < len(new):
        d = new[j] - old[i]
        if abs(d) <= tol:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif d > 0:
            i += 1
        else:
            j += 1
    return pairs


@pytest.mark.parametrize("seed", range(40))
def test_chunks_by_chainage_equal_two_pointers(seed):
    rng = np.random.default_rng(seed)
    step = (12.0, 100.0, 400.0, 900.0)[seed % 4]
    old, new = (np.sort(np.round(rng.uniform(0, 40 * step, rng.integers(0, 60)), int(rng.integers(-1, 2)))).tolist() for _ in range(2))
    for width in (500.0, 700.0, 5000.0):
        assert merge(old, new, width) == two_pointer(old, new)


def test_joints_at_one_chainage_wait_in_order():
    old, new = [100.0] * 30 + [900.0], [100.0] * 5 + [600.0] * 40
    assert merge(old, new, 500.0) == two_pointer(old, new)


@pytest.mark.parametrize("seed", range(5))
def test_chain_is_the_longest(seed):
    rng = np.random.default_rng(seed)
    p2 = rng.permutation(9)
    got = J._chain(pd.DataFrame({"line_id": 1, "p1": np.arange(9), "p2": p2}))
    assert got["p1"].is_monotonic_increasing and got["p2"].is_monotonic_increasing
    best = max(len(c) for k in range(10) for c in itertools.combinations(range(9), k) if all(p2[a] < p2[b] for a, b in zip(c, c[1:])))
    assert len(got) == best


def tiled(a, b, band, shift, tile):
    """All tiles in order, in this process."""
    from girthline.operators import tiles as X

    n, m = len(a["length"]), len(b["length"])
    below, beside, swept = {}, {}, {}
    for r in range(-(-n // tile)):
        for c in range(-(-m // tile)):
            r0, c0 = r * tile, c * tile
            rows, columns = min(tile, n - r0), min(tile, m - c0)
            top, left = below.get((r - 1, c), np.full(columns + 1, -np.inf)), beside.get((r, c - 1), np.full(rows + 1, -np.inf))
            at = np.arange(columns + 1) + c0
            top = np.where(np.abs(shift - at) <= band, J.GAP * at, -np.inf) if r == 0 else top.copy()
            at = np.arange(rows + 1) + r0
            left = np.where(np.abs(at + shift) <= band, J.GAP * at, -np.inf) if c == 0 else left.copy()
            top[0] = left[0] = max(top[0], left[0])
            score = lambda i, r0=r0, c0=c0, columns=columns: J._scores(a, b, slice(r0 + i, r0 + i + 1), slice(c0, c0 + columns))[0]
            swept[r, c] = X.sweep_tile(score, top, left, r0, c0, shift, band, J.GAP, True)
            below[r, c], beside[r, c] = swept[r, c][:2]
    pairs, (i, j) = [], (n, m)
    while i > 0 and j > 0:
        r, c = (i - 1) // tile, (j - 1) // tile
        r0, c0 = r * tile, c * tile
        _, _, down, right, choices = swept[r, c]
        pairs += [(r0 + x, c0 + y) for x, y in X.trace_tile(choices, i - r0, j - c0)]
        width = min(tile, m - c0)
        k = down[j - c0] if i == min(r0 + tile, n) else right[i - r0]
        i, j = (r0, c0 + int(k)) if k <= width else (r0 + int(k) - width, c0)
    like = lambda x, y: 1.0 - abs(a["exact"][x] - b["exact"][y]) / max(a["exact"][x], b["exact"][y]) >= J.MIN_SIMILARITY
    return sorted(p for p in pairs if like(*p))


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("tile", [7, 16, 200])
def test_tiles_equal_one_sweep(seed, tile):
    """Few lengths, so that many paths are equally good and ties matter."""
    rng = np.random.default_rng(seed)
    new = joints(rng, 90)
    few = rng.choice([11.5, 12.0, 12.5, 8.0], 90)
    new = {**new, "exact": few, "length": few.astype(np.float32)}
    keep = np.flatnonzero(rng.random(90) > 0.15)
    old = take(new, keep)
    for band, shift in ((max(20, 90 - len(keep)), 0), (60, 3), (60, -4)):
        assert tiled(old, new, band, shift, tile) == J.align_segment(old, new, band, shift)
