"""One-to-one matching of features between runs, within aligned joints.

Features that can interact at all lie in one island: a stretch of a joint without an axial gap above the widest
tolerance, and of its girth without a gap above the widest clock tolerance. Islands with one feature per run are decided with column
expressions. Only islands with a real choice reach the assignment kernel, so no pairs are emitted to find that out, and no group is larger
than an island. The kernel keeps only feasible pairs, as lists by row, so its memory grows with those and not with rows times columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from girthline.functions import clock
from girthline.functions.units import depth_mm
from girthline.operators.inventory import assessable
from girthline.session import by_rows, kept

# (axial tolerance m, clock tolerance h, highest accepted cost) per relaxation pass.
PASSES = ((0.10, 0.5, 0.5), (0.25, 1.0, 1.0), (1.00, 1.5, 1.5))
AXIAL_WEIGHT = 1.0
CLOCK_WEIGHT = 0.3
SURFACE_PENALTY = 10.0
SHRINK_PENALTY = 1.0
SHRINK_RATIO = 0.5
CLUSTER_PENALTY = 0.2

ISLAND = ("line_id", "old_joint", "island")
#: A hair: an island may be joined needlessly, never split between two candidates.
SLACK = 1.000001
OLD_FIELDS = ("abs_distance_m", "depth_pct_wt", "depth_mm", "clock_decimal_hours", "surface", "wt_mm", "anomaly_id")
OLD_TYPE = (
    "struct<abs_distance_m: double, depth_pct_wt: double, depth_mm: double, clock_decimal_hours: double,"
    " surface: string, wt_mm: double, anomaly_id: string>"
)
#: What of an old feature islands don't carry anyway.
REST_TYPE = "struct<abs_distance_m: double, wt_mm: double, anomaly_id: string>"
_SIDE = ("source_row", "pos", "clock_decimal_hours", "surface", "depth_pct_wt", "is_cluster_parent")


def _old_values(row: Column, rest: Column) -> Column:
    """The old feature's values, from its row of an island."""
    depth = depth_mm(row["depth_pct_wt"], rest["wt_mm"]).alias("depth_mm")
    return F.struct(
        rest["abs_distance_m"], row["depth_pct_wt"], depth, row["clock_decimal_hours"], row["surface"], rest["wt_mm"], rest["anomaly_id"],
    ).cast(OLD_TYPE)


def _choice() -> Column:
    """Islands that leave a choice."""
    return (F.col("n_old") > 0) & (F.col("n_new") > 0) & ((F.col("n_old") > 1) | (F.col("n_new") > 1))


def pair_cost(old: Column, new: Column) -> tuple[Column, Column, Column]:
    """(axial distance, clock distance or null when unknown, cost) of two feature structs."""
    axial = F.abs(old["pos"] - new["pos"])
    turn = clock.distance(old["clock_decimal_hours"], new["clock_decimal_hours"])
    known = (old["surface"] != "unknown") & (new["surface"] != "unknown")
    shrunk = (old["depth_pct_wt"] > 0) & (new["depth_pct_wt"] < SHRINK_RATIO * old["depth_pct_wt"])
    cost = (
        axial * AXIAL_WEIGHT
        + F.coalesce(turn, F.lit(0.0)) * CLOCK_WEIGHT
        + F.when(known & (old["surface"] != new["surface"]), SURFACE_PENALTY).otherwise(0.0)
        + F.when(F.coalesce(shrunk, F.lit(False)), SHRINK_PENALTY).otherwise(0.0)
        + F.when(old["is_cluster_parent"] != new["is_cluster_parent"], CLUSTER_PENALTY).otherwise(0.0)
    )
    return axial, turn, cost


def _feasible(axial: Column, turn: Column, limits: Sequence[float]) -> Column:
    return (axial <= limits[0]) & (turn.isNull() | (turn <= limits[1]))


def sided(old: DataFrame, new: DataFrame, joint_pairs: DataFrame) -> DataFrame:
    """Assessable features of both runs on the numbering of the old joints, with known weld distance."""
    def side(df: DataFrame, number: int, joint: str) -> DataFrame:
        pairs = joint_pairs.select("line_id", F.col(joint).alias("joint_number"), F.col("old_joint").alias("_old"))
        rows = assessable(df).where(F.col("joint_number").isNotNull() & F.col("upstream_weld_dist_m").isNotNull())
        payload = F.struct("abs_distance_m", "wt_mm", "anomaly_id")
        # Only the old side is carried along; the new side is joined by its row later.
        return rows.join(by_rows(pairs), ["line_id", "joint_number"]).select(
            "line_id", F.col("_old").alias("old_joint"), F.lit(number).alias("side"), "source_row",
            F.col("upstream_weld_dist_m").alias("pos"), "clock_decimal_hours", "surface", "depth_pct_wt",
            "is_cluster_parent", (payload if number == 1 else F.lit(None)).cast(REST_TYPE).alias("old"),
        )

    return side(old, 1, "old_joint").unionByName(side(new, 2, "new_joint"))


def _stretches(features: DataFrame, tolerance: float) -> DataFrame:
    """Adds ``island``, a stretch without an axial gap above the tolerance, and its ``n_old`` and ``n_new``.

    Features are first counted into cells one tolerance wide. A cell cannot hold a gap, so cells with their
    lowest and highest position are enough to find every gap, and the windows see cells instead of features.
    """
    key = ["line_id", "old_joint"]
    # Dealt once for the count and the join.
    celled = features.withColumn("_cell", F.floor(F.col("pos") / tolerance).cast("long")).repartition(*key, "_cell")
    cells = celled.groupBy(*key, "_cell").agg(
        F.count_if(F.col("side") == 1).alias("_old"), F.count_if(F.col("side") == 2).alias("_new"),
        F.min("pos").alias("_low"), F.max("pos").alias("_high"),
    )
    along = Window.partitionBy(*key).orderBy("_cell")
    starts = F.coalesce((F.col("_low") - F.lag("_high").over(along) > tolerance * SLACK).cast("long"), F.lit(0))
    cells = cells.withColumn("_starts", starts).withColumn("island", F.sum("_starts").over(along))
    whole = Window.partitionBy(*key, "island")
    cells = cells.withColumns({"n_old": F.sum("_old").over(whole), "n_new": F.sum("_new").over(whole)})
    return celled.join(by_rows(cells.select(*key, "_cell", "island", "n_old", "n_new")), [*key, "_cell"]).drop("_cell")


def _cut_round(stretches: DataFrame, turn: float) -> DataFrame:
    """Islands cut at gaps above ``turn`` hours round the girth, unless a feature without a clock position could meet any other.

    Features are counted into half hours, at most 25 of an island, and gaps are found between those.
    """
    hour = F.col("clock_decimal_hours")
    rows = stretches.withColumn("_wedge", F.coalesce(F.floor(hour * 2), F.lit(-1)).cast("int")).drop("n_old", "n_new")
    wedges = rows.groupBy(*ISLAND, "_wedge").agg(
        F.count_if(F.col("side") == 1).alias("_old"), F.count_if(F.col("side") == 2).alias("_new"), F.min(hour).alias("_from"), F.max(hour).alias("_to"),
    )
    around, upto = Window.partitionBy(*ISLAND), Window.partitionBy(*ISLAND).orderBy("_wedge")
    gap = F.coalesce((F.col("_from") - F.lag("_to").over(upto) > turn * SLACK).cast("long"), F.lit(0))
    wedges = wedges.withColumn("_gap", gap).withColumn("_part", F.sum("_gap").over(upto))
    meets = F.min("_from").over(around) + 12.0 - F.max("_to").over(around) <= turn * SLACK
    whole = (F.min("_wedge").over(around) < 0) | meets & (F.col("_part") == F.max("_part").over(around))
    wedges = wedges.withColumn("_part", F.when(whole, 0).otherwise(F.col("_part")))
    part = Window.partitionBy(*ISLAND, "_part")
    wedges = wedges.withColumns({"n_old": F.sum("_old").over(part), "n_new": F.sum("_new").over(part)})
    found = rows.join(by_rows(wedges.select(*ISLAND, "_wedge", "_part", "n_old", "n_new")), [*ISLAND, "_wedge"])
    return found.withColumn("island", F.col("island") + F.col("_part")).drop("_wedge", "_part")


def with_islands(features: DataFrame, tolerance: float, turn: float | None = None) -> DataFrame:
    """Adds ``island`` and the island's ``n_old`` and ``n_new``. Only stretches that leave a choice are cut round the girth as well."""
    turn = max(p[1] for p in PASSES) if turn is None else turn
    stretches = kept(_stretches(features, tolerance).withColumn("island", F.col("island") * 32))
    return stretches.where(~_choice()).unionByName(_cut_round(stretches.where(_choice()), turn))


def candidates(features: DataFrame, tolerance: float) -> DataFrame:
    """Structs ``o`` and ``n`` of all pairs of an old and a new feature on one joint that are no farther apart than the tolerance.

    Old features meet the new ones of their own and the two neighbouring cells, two tolerances wide so that rounding can't part a pair.
    """
    def side(number: int, name: str, cell: Column) -> DataFrame:
        return features.where(F.col("side") == number).select("line_id", "old_joint", F.struct(*_SIDE).alias(name), cell.alias("_cell"))

    cell = F.floor(F.col("pos") / (2 * tolerance)).cast("long")
    near = F.explode(F.array(cell - 1, cell, cell + 1))
    pairs = side(1, "o", cell).join(by_rows(side(2, "n", near)), ["line_id", "old_joint", "_cell"])
    return pairs.where(F.abs(F.col("o.pos") - F.col("n.pos")) <= tolerance).drop("_cell")


def match_single(islands: DataFrame, passes: Sequence[Sequence[float]] = PASSES) -> DataFrame:
    """Islands with one feature per run: the first pass whose tolerances and ceiling the pair meets."""
    alone = islands.where((F.col("n_old") == 1) & (F.col("n_new") == 1))

    def one(side: int, name: str, *columns: str) -> DataFrame:
        return alone.where(F.col("side") == side).select(*ISLAND, F.struct(*columns).alias(name))

    # One row on each side, so a join pairs them; an aggregate of structs would sort all rows twice.
    pairs = one(1, "o", *_SIDE, "old").join(by_rows(one(2, "n", *_SIDE)), list(ISLAND))
    axial, turn, cost = pair_cost(F.col("o"), F.col("n"))
    pairs = pairs.withColumns({"_axial": axial, "_turn": turn, "match_score": cost})
    # The passes are looked through as an array: written out, the code of a pair outgrows what the JVM compiles.
    levels = F.array(*[F.struct(*[F.lit(x).alias(name) for name, x in zip(("level", "axial", "turn", "ceiling"), (i, *map(float, limits)))])
                       for i, limits in enumerate(passes, start=1)])
    accepts = lambda p: _feasible(F.col("_axial"), F.col("_turn"), (p["axial"], p["turn"])) & (F.col("match_score") <= p["ceiling"])
    pairs = pairs.withColumn("_pass", F.get(F.filter(levels, accepts), F.lit(0))).where(F.col("_pass").isNotNull())
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("match_score") / F.greatest("_pass.ceiling", F.lit(1e-9))))
    return pairs.select(
        "line_id", "old_joint", F.col("o.source_row").alias("old_source_row"),
        F.col("n.source_row").alias("new_source_row"), "match_score", confidence.alias("confidence"),
        F.col("_pass.level").alias("relaxation_level"), _old_values(F.col("o"), F.col("o.old")).alias("old"),
    )


def assign(n: int, m: int, rows: np.ndarray, columns: np.ndarray, cost: np.ndarray) -> list[int]:
    """Indices of the pairs of a least-cost assignment among those with the most pairs, from the feasible pairs only.

    Costs count in whole billionths, so sums are exact; of equal sums the one with the least sum of squares (of ten-thousandths) wins, that is the more
    even one. What is still equal goes to the lower rows.
    Rows enter in order, each by a shortest augmenting path over reduced costs that ends in a free column, or leaves some row on the path without
    one, at a cost above that of any assignment. A search stops at the nearest end, so it stays among a row's neighbours.
    """
    order = np.lexsort((columns, rows))
    first = np.searchsorted(rows[order], np.arange(n + 1)).tolist()
    to, pair = columns[order].tolist(), order.tolist()
    price = [(round(c * 1e9) << 64) + round(c * 1e4) ** 2 for c in cost[order].tolist()]
    alone = (max(price, default=0) + 1) * (min(n, m) + 1)
    u = [min(price[first[r]:first[r + 1]], default=0) for r in range(n)]
    v = [0] * m
    owner, edge_of = [-1] * m, [-1] * n
    for r in range(n):
        heap: list[tuple[int, int]] = []
        reached: dict[int, tuple[int, int]] = {}  # column -> distance, edge by which it was reached
        settled: list[tuple[int, int]] = []
        visited = [(r, 0)]
        closed = set()
        row, at = r, 0
        last_row, last = r, alone - u[r]
        while True:
            for e in range(first[row], first[row + 1]):
                c = to[e]
                if c in closed:
                    continue
                d = at + price[e] - u[row] - v[c]
                if c not in reached or d < reached[c][0]:
                    reached[c] = d, e
                    heappush(heap, (d, c))
            while heap and (heap[0][1] in closed or heap[0][0] > reached[heap[0][1]][0]):
                heappop(heap)
            if not heap or heap[0][0] >= last:
                end, far = None, last
                break
            at, column = heappop(heap)
            if owner[column] < 0:
                end, far = column, at
                break
            closed.add(column)
            settled.append((column, at))
            row = owner[column]
            visited.append((row, at))
            if at + alone - u[row] < last:
                last_row, last = row, at + alone - u[row]
        for x, d in visited:
            u[x] += far - d
        for c, d in settled:
            v[c] -= far - d
        if end is None:
            if last_row == r:
                continue
            # This row stays without a column; its own goes to the rows before it on the path.
            end, edge_of[last_row] = to[edge_of[last_row]], -1
        while True:
            e = reached[end][1]
            # The row of an edge is where its list lies.
            giver = int(np.searchsorted(first, e, "right")) - 1
            following = edge_of[giver]
            owner[end], edge_of[giver] = giver, e
            if giver == r:
                break
            end = to[following]
    return [pair[e] for e in edge_of if e >= 0]


def _components(n_old: int, rows: np.ndarray, cols: np.ndarray, n_new: int) -> Iterator[np.ndarray]:
    """Index sets of candidate pairs that share no feature with each other."""
    label = np.arange(n_old + n_new)
    a, b = rows, cols + n_old
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    roots = label[a]
    order = np.argsort(roots, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(roots[order])) + 1)


def _candidates(o: dict, n: dict, limits: Sequence[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse feasible pairs by sorted position: (old index, new index, cost)."""
    order = np.argsort(n["pos"], kind="stable")
    sorted_pos = n["pos"][order]
    slack = limits[0] * 1e-6 + 1e-9
    lo = np.searchsorted(sorted_pos, o["pos"] - limits[0] - slack, "left")
    hi = np.searchsorted(sorted_pos, o["pos"] + limits[0] + slack, "right")
    counts = hi - lo
    i = np.repeat(np.arange(len(o["pos"])), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    j = order[np.repeat(lo, counts) + offset]
    axial = np.abs(o["pos"][i] - n["pos"][j])
    turn = np.abs(o["clock"][i] - n["clock"][j])
    turn = np.where(turn > 6.0, 12.0 - turn, turn)
    keep = (axial <= limits[0]) & ~(turn > limits[1])
    i, j, axial, turn = i[keep], j[keep], axial[keep], turn[keep]
    cost = axial * AXIAL_WEIGHT + np.where(np.isnan(turn), 0.0, turn) * CLOCK_WEIGHT
    so, sn = o["surface"][i], n["surface"][j]
    cost = np.where((so != "unknown") & (sn != "unknown") & (so != sn), cost + SURFACE_PENALTY, cost)
    do, dn = o["depth"][i], n["depth"][j]
    with np.errstate(invalid="ignore"):
        cost = np.where((do > 0) & (dn < SHRINK_RATIO * do), cost + SHRINK_PENALTY, cost)
    return i, j, np.where(o["parent"][i] != n["parent"][j], cost + CLUSTER_PENALTY, cost)


_ARRAYS = {"pos": "pos", "clock": "clock_decimal_hours", "surface": "surface", "depth": "depth_pct_wt", "parent": "is_cluster_parent"}
_KINDS = {"surface": object, "parent": bool}


def solve(old: dict, new: dict, passes: Sequence[Sequence[float]] = PASSES) -> list[tuple[int, int, float, int]]:
    """(old index, new index, cost, pass) over the arrays of one island, each side ordered by source row.

    In each pass as many pairs as possible are assigned at least total cost; a pair above the pass's ceiling
    is then put back.
    """
    left, right = np.arange(len(old["pos"])), np.arange(len(new["pos"]))
    found: list[tuple[int, int, float, int]] = []
    for level, limits in enumerate(passes, start=1):
        if not len(left) or not len(right):
            break
        i, j, cost = _candidates({k: v[left] for k, v in old.items()}, {k: v[right] for k, v in new.items()}, limits)
        if not len(i):
            continue
        used_l, used_r = np.zeros(len(left), bool), np.zeros(len(right), bool)
        for part in _components(len(left), i, j, len(right)):
            rows, ri = np.unique(i[part], return_inverse=True)
            cols, ci = np.unique(j[part], return_inverse=True)
            flip = len(rows) > len(cols)
            sides = (len(cols), len(rows), ci, ri) if flip else (len(rows), len(cols), ri, ci)
            for k in assign(*sides, cost[part]):
                e = part[k]
                if cost[e] <= limits[2]:
                    found.append((int(left[i[e]]), int(right[j[e]]), float(cost[e]), level))
                    used_l[i[e]] = used_r[j[e]] = True
        left, right = left[~used_l], right[~used_r]
    return found


def solve_islands(pdf, passes: Sequence[Sequence[float]] = PASSES) -> list[tuple[int, int, float, int]]:
    """(old row number, new row number, cost, pass) over the rows of whole islands, a pandas frame ordered by island, side and source row."""
    side = pdf["side"].to_numpy()
    arrays = {name: pdf[c].to_numpy(_KINDS.get(name, float)) for name, c in _ARRAYS.items()}
    new_island = np.ones(len(pdf), bool)
    new_island[1:] = False
    for c in ISLAND:
        if c in pdf:
            values = pdf[c].to_numpy()
            new_island[1:] |= values[1:] != values[:-1]
    edges = np.append(np.flatnonzero(new_island), len(pdf))
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        middle = a + int((side[a:b] == 1).sum())
        found = solve({k: v[a:middle] for k, v in arrays.items()}, {k: v[middle:b] for k, v in arrays.items()}, passes)
        out += [(a + o, middle + n, cost, level) for o, n, cost, level in found]
    return out


def match_ambiguous(islands: DataFrame, passes: Sequence[Sequence[float]] = PASSES) -> DataFrame:
    """Islands with a choice: exact assignment. A task goes through its islands one after the other and holds one Arrow batch and one island."""
    limits = tuple(tuple(float(x) for x in p) for p in passes)
    columns = [*ISLAND, "side", *_SIDE]

    def kernel(frames: Iterator) -> Iterator:
        import pandas as pd

        def solved(pdf):
            rows = solve_islands(pdf, limits)
            o, n = [r[0] for r in rows], [r[1] for r in rows]
            return pd.DataFrame({
                "line_id": pdf["line_id"].iloc[o].to_numpy(),
                "old_joint": pdf["old_joint"].iloc[o].to_numpy(),
                "old_source_row": pdf["source_row"].iloc[o].to_numpy(),
                "new_source_row": pdf["source_row"].iloc[n].to_numpy(),
                "match_score": [r[2] for r in rows],
                "confidence": [max(0.0, min(1.0, 1.0 - r[2] / max(limits[r[3] - 1][2], 1e-9))) for r in rows],
                "relaxation_level": [r[3] for r in rows],
            })

        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if not len(frame):
                continue
            last = np.ones(len(frame), bool)
            for c in ISLAND:
                last &= (frame[c] == frame[c].iloc[-1]).to_numpy()
            # The last island may go on in the next batch.
            yield solved(frame[~last].reset_index(drop=True))
            rest = frame[last].reset_index(drop=True)
        if rest is not None:
            yield solved(rest)

    choice = islands.where(_choice())
    key_types = {f.name: f.dataType.simpleString() for f in islands.schema.fields}
    schema = (
        f"line_id {key_types['line_id']}, old_joint {key_types['old_joint']}, old_source_row long, new_source_row long,"
        " match_score double, confidence double, relaxation_level int"
    )
    dealt = choice.select(*columns).repartition(*ISLAND).sortWithinPartitions(*ISLAND, "side", "source_row")
    solved = dealt.mapInPandas(kernel, schema)
    values = _old_values(F.struct(*_SIDE), F.col("old")).alias("old")
    carried = choice.where(F.col("side") == 1).select("line_id", F.col("source_row").alias("old_source_row"), values)
    return solved.join(by_rows(carried), ["line_id", "old_source_row"])


def match(old: DataFrame, new: DataFrame, joint_pairs: DataFrame, passes: Sequence[Sequence[float]] = PASSES) -> DataFrame:
    """Matched rows: keys of both sides, score, confidence, pass, and the old feature's values.

    ``joint_pairs`` has (line_id, old_joint, new_joint), one-to-one within a line.
    """
    # Kept, so that the shuffles of joints and those of cells don't lie on disk together.
    islands = with_islands(kept(sided(old, new, joint_pairs)), max(p[0] for p in passes), max(p[1] for p in passes))
    columns = [
        "line_id", "old_joint", "old_source_row", "new_source_row", "match_score", "confidence", "relaxation_level", "old",
    ]
    return match_single(islands, passes).select(*columns).unionByName(match_ambiguous(islands, passes).select(*columns))


def unmatched(features: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    """Assessable features of a run ('old' or 'new') without a partner."""
    rows = matches.select("line_id", F.col(f"{side}_source_row").alias("source_row"))
    return assessable(features).join(by_rows(rows), ["line_id", "source_row"], "left_anti")


def match_summary(old: DataFrame, new: DataFrame, matches: DataFrame, passes: Sequence[Sequence[float]] = PASSES) -> DataFrame:
    """Per line: pool sizes, matches per pass, rate over the smaller pool, last tolerances."""
    def pool(df: DataFrame, n: str, clusters: str) -> DataFrame:
        return assessable(df).groupBy("line_id").agg(
            F.count(F.lit(1)).alias(n), F.count_if(F.col("is_cluster_parent")).alias(clusters)
        )

    per_pass = [
        F.count_if(F.col("relaxation_level") == i).alias(f"matched_pass_{i}") for i in range(1, len(passes) + 1)
    ]
    found = matches.groupBy("line_id").agg(F.count(F.lit(1)).alias("matched"), *per_pass)
    rows = (
        pool(old, "n_old", "clusters_old")
        .join(pool(new, "n_new", "clusters_new"), "line_id", "full")
        .join(found, "line_id", "left")
        .na.fill(0)
    )
    denominator = F.greatest(F.least("n_old", "n_new"), F.lit(1))
    return rows.withColumns({
        "unmatched_old": F.col("n_old") - F.col("matched"),
        "unmatched_new": F.col("n_new") - F.col("matched"),
        "match_rate": F.col("matched") / denominator,
        "final_axial_m": F.lit(float(passes[-1][0])),
        "final_clock_h": F.lit(float(passes[-1][1])),
        "final_max_cost": F.lit(float(passes[-1][2])),
    })


def match_codes(summary: DataFrame, target: float = 0.90) -> DataFrame:
    """Line-level findings of the matching."""
    codes = F.array_compact(F.array(
        F.when((F.col("clusters_old") == 0) & (F.col("clusters_new") == 0), "NO_CLUSTERS_IN_EITHER_RUN"),
        F.when((F.col("n_old") > 0) & (F.col("n_new") > 0) & (F.col("match_rate") < target), "LOW_DEFECT_MATCH_RATE"),
    ))
    return summary.select("line_id", F.explode(codes).alias("code"))


def depth_changes(matches: DataFrame, new: DataFrame) -> DataFrame:
    """Depth difference of each matched pair in percent of wall and in millimetres."""
    rows = new.select(
        "line_id", F.col("source_row").alias("new_source_row"), "depth_pct_wt", "wt_mm"
    )
    return matches.join(by_rows(rows), ["line_id", "new_source_row"]).select(
        "line_id", "old_source_row", "new_source_row",
        (F.col("depth_pct_wt") - F.col("old.depth_pct_wt")).alias("depth_delta_pct_wt"),
        (depth_mm(F.col("depth_pct_wt"), F.col("wt_mm")) - F.col("old.depth_mm")).alias("depth_delta_mm"),
    )
