"""Exact banded alignment of long segments, spread over tasks in tiles.

The best score of every cell depends on its neighbours above and to the left, so a segment is cut into square tiles, and all tiles on one
anti-diagonal, of all segments, are one Spark job that needs only the edges of the tiles before. A tile hands on its last row and
column, and for each of their cells the cell on its first row or column from which the best path enters. These short lists
give the tiles that the best path of a segment crosses without looking into any; only those are worked out again, in parallel, to
read off their pairs. No task holds more than a tile, and the result is that of one sweep over the whole segment, ties included: scores are sums
of single-precision numbers and halves, which double precision adds without rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from girthline.session import by_rows, kept

TILE = 2048
NOTHING = -np.inf


def sweep_tile(score: Callable, top: np.ndarray, left: np.ndarray, r0: int, c0: int, shift: int, band: int, gap: float, keep: bool):
    """Last row, last column, entry of each of their cells, and the choices if ``keep``.

    ``top`` are the scores of row r0 at columns c0.., ``left`` those of column c0 at rows r0..; both begin with the corner. ``score(i)``
    gives the scores of pairing row r0 + i + 1 with every column. Entries count along ``top``, then, less one, along ``left``: entry k is
    column c0 + k if k < len(top), else row r0 + k - len(top) + 1. Choices: 0 pair, 1 row unmatched, 2 column unmatched.
    """
    n, m = len(left) - 1, len(top) - 1
    columns = np.arange(m + 1)
    climb = gap * columns
    row, origin = top, columns.copy()
    right, right_from = [top[-1]], [m]
    choices = np.empty((n, m), np.int8) if keep else None
    for i in range(1, n + 1):
        up, diagonal = row[1:] + gap, row[:-1] + score(i - 1)
        outside = np.abs(r0 + i + shift - (c0 + columns[1:])) > band
        best = np.maximum(up, diagonal)
        best[outside] = NOTHING
        now = np.empty(m + 1)
        now[0], now[1:] = left[i], best
        now = np.maximum.accumulate(now - climb) + climb
        now[1:][outside] = NOTHING
        beside = now[:-1] + gap
        choice = np.where((diagonal >= up) & (diagonal >= beside), 0, np.where(up >= beside, 1, 2)).astype(np.int8)
        came = np.empty(m + 1, np.int64)
        came[0] = m + i
        came[1:] = np.where(choice == 0, origin[:-1], origin[1:])
        # A run of unmatched columns comes from the cell before it.
        last = np.maximum.accumulate(np.where(np.append(True, choice != 2), columns, 0))
        row, origin = now, came[last]
        right.append(row[-1])
        right_from.append(origin[-1])
        if keep:
            choices[i - 1] = choice
    return row, np.array(right), origin, np.array(right_from), choices


def trace_tile(choices: np.ndarray, i: int, j: int) -> list[tuple[int, int]]:
    """Cells (row, column, from 0) paired on the way back from the cell after row i and column j to the tile's first row or column."""
    pairs = []
    while i > 0 and j > 0:
        step = choices[i - 1, j - 1]
        if step == 0:
            pairs.append((i - 1, j - 1))
        i, j = i - (step != 2), j - (step != 1)
    return pairs[::-1]


def _blocks(joints: DataFrame, sizes: DataFrame, columns: list[str], tile: int) -> DataFrame:
    """One row for each run of ``tile`` joints of a side of a segment, with its columns as arrays in order."""
    placed = joints.join(sizes, ["line_id", "seg"])
    first = F.when(F.col("side") == 1, F.col("first_1")).otherwise(F.col("first_2"))
    rows = placed.withColumn("_at", F.col("pos") - first).withColumn("block", F.floor(F.col("_at") / tile).cast("int"))
    packed = rows.groupBy("line_id", "seg", "side", "block").agg(F.sort_array(F.collect_list(F.struct("_at", *columns))).alias("_rows"))
    return packed.select("line_id", "seg", "side", "block", *(F.col(f"_rows.{c}").alias(c) for c in columns))


def align_long(joints: DataFrame, sizes: DataFrame, columns: list[str], scores: Callable, gap: float, tile: int = TILE) -> DataFrame:
    """``line_id, seg, row, column`` (from 0 within the segment) of the cells paired by the best path of each segment.

    ``joints`` has line_id, seg, side, pos and ``columns``; ``sizes`` one row for each segment: line_id, seg, n_1, n_2, first_1, first_2 (the first
    positions), band. ``scores(a, b)`` gives the matrix of scores of two dicts of arrays.
    """
    key = ["line_id", "seg"]
    sizes = kept(sizes)
    longest = sizes.agg(F.max(F.ceil(F.col("n_1") / tile) + F.ceil(F.col("n_2") / tile))).first()[0]
    if longest is None:
        return sizes.select(*key, F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("column")).limit(0)
    blocks = kept(_blocks(joints, sizes, columns, tile))
    shift = F.col("first_1") - F.col("first_2")
    grid = sizes.select(*key, "n_1", "n_2", "band", shift.alias("shift"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_1") / tile).cast("int") - 1)).alias("r"))
    low = F.greatest(F.lit(0), F.floor((F.col("r") * tile + F.col("shift") - F.col("band") - 1) / tile)).cast("int")
    high = F.least(F.ceil(F.col("n_2") / tile) - 1, F.floor(((F.col("r") + 1) * tile + F.col("shift") + F.col("band")) / tile)).cast("int")
    grid = kept(grid.withColumns({"_low": low, "_high": high}).where("_low <= _high").withColumn("c", F.explode(F.sequence("_low", "_high"))).drop("_low", "_high"))
    sides = [blocks.where(F.col("side") == s).select(*key, F.col("block").alias(at), *(F.col(x).alias(f"{x}_{s}") for x in columns)) for s, at in ((1, "r"), (2, "c"))]

    def joined(tiles: DataFrame) -> DataFrame:
        return tiles.join(by_rows(sides[0]), [*key, "r"]).join(by_rows(sides[1]), [*key, "c"])

    def pair_scores(t) -> Callable:
        a, b = ({x: np.asarray([np.nan if v is None else v for v in t[f"{x}_{s}"]], float) for x in columns} for s in (1, 2))
        step, held = 64, {}

        def score(i: int) -> np.ndarray:
            block = i // step
            if block not in held:
                held.clear()
                held[block] = scores({x: v[block * step:(block + 1) * step] for x, v in a.items()}, b)
            return held[block][i - block * step]

        return score

    def edges(t, tile_r: int, tile_c: int) -> tuple[np.ndarray, np.ndarray]:
        r0, c0 = tile_r * tile, tile_c * tile
        n, m = min(tile, t["n_1"] - r0), min(tile, t["n_2"] - c0)
        top, left = (np.full(k + 1, NOTHING) if v is None else np.array(v, float) for v, k in ((t["above"], m), (t["before"], n)))
        if r0 == 0:
            at = c0 + np.arange(m + 1)
            top = np.where(np.abs(t["shift"] - at) <= t["band"], gap * at, NOTHING) if abs(t["shift"]) <= t["band"] else np.full(m + 1, NOTHING)
        if c0 == 0:
            at = r0 + np.arange(n + 1)
            left = np.where(np.abs(at + t["shift"]) <= t["band"], gap * at, NOTHING) if abs(t["shift"]) <= t["band"] else np.full(n + 1, NOTHING)
        top[0] = left[0] = max(top[0], left[0])
        return top, left

    fields = {f.name: f.dataType.simpleString() for f in sizes.schema.fields}
    lists = "top array<double>, left array<double>, bottom array<double>, right array<double>, bottom_from array<int>, right_from array<int>"
    wave_schema = f"line_id {fields['line_id']}, seg {fields['seg']}, r int, c int, {lists}"

    def sweep(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for t in frame.to_dict("records"):
                top, left = edges(t, t["r"], t["c"])
                bottom, right, a, b, _ = sweep_tile(pair_scores(t), top, left, t["r"] * tile, t["c"] * tile, t["shift"], t["band"], gap, False)
                yield pd.DataFrame([(t["line_id"], t["seg"], t["r"], t["c"], top, left, bottom, right, a, b)],
                                   columns=["line_id", "seg", "r", "c", "top", "left", "bottom", "right", "bottom_from", "right_from"])

    empty = joints.sparkSession.createDataFrame([], wave_schema)
    done, before = [], empty
    for wave in range(int(longest)):
        here = grid.where(F.col("r") + F.col("c") == wave)
        above = before.select(*key, (F.col("r") + 1).alias("r"), "c", F.col("bottom").alias("above"))
        beside = before.select(*key, "r", (F.col("c") + 1).alias("c"), F.col("right").alias("before"))
        tiles = joined(here).join(by_rows(above), [*key, "r", "c"], "left").join(by_rows(beside), [*key, "r", "c"], "left")
        before = kept(tiles.repartition(*key, "r", "c").mapInPandas(sweep, wave_schema))
        done.append(before)
    swept = done[0]
    for other in done[1:]:
        swept = swept.union(other)

    crossed_schema = f"line_id {fields['line_id']}, seg {fields['seg']}, r int, c int, i long, j long"

    def follow(frames: Iterator) -> Iterator:
        """Goes back from the last cell, tile by tile; the tiles of a segment come from the last anti-diagonal on."""
        import pandas as pd

        at, cell = None, None
        for frame in frames:
            out = []
            for t in frame.to_dict("records"):
                if (t["line_id"], t["seg"]) != at:
                    at, cell = (t["line_id"], t["seg"]), (t["n_1"], t["n_2"])
                i, j = cell
                r0, c0 = t["r"] * tile, t["c"] * tile
                if i <= 0 or j <= 0 or (t["r"], t["c"]) != ((i - 1) // tile, (j - 1) // tile):
                    continue
                out.append((*at, t["r"], t["c"], i, j))
                m = min(tile, t["n_2"] - c0)
                k = t["bottom_from"][j - c0] if i == min(r0 + tile, t["n_1"]) else t["right_from"][i - r0]
                cell = (r0, c0 + int(k)) if k <= m else (r0 + int(k) - m, c0)
            yield pd.DataFrame(out, columns=["line_id", "seg", "r", "c", "i", "j"])

    links = swept.select(*key, "r", "c", "bottom_from", "right_from").join(sizes.select(*key, "n_1", "n_2"), key)
    ordered = links.withColumn("_w", -F.col("r") - F.col("c")).repartition(*key).sortWithinPartitions(*key, "_w")
    crossed = ordered.mapInPandas(follow, crossed_schema)

    def read_off(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for t in frame.to_dict("records"):
                r0, c0 = t["r"] * tile, t["c"] * tile
                top, left = np.asarray(t["top"], float), np.asarray(t["left"], float)
                choices = sweep_tile(pair_scores(t), top, left, r0, c0, t["shift"], t["band"], gap, True)[4]
                cells = np.array(trace_tile(choices, t["i"] - r0, t["j"] - c0), np.int64).reshape(-1, 2)
                yield pd.DataFrame({"line_id": [t["line_id"]] * len(cells), "seg": [t["seg"]] * len(cells), "row": r0 + cells[:, 0], "column": c0 + cells[:, 1]})

    again = joined(crossed.join(by_rows(swept.select(*key, "r", "c", "top", "left")), [*key, "r", "c"]).join(grid.select(*key, "r", "c", "shift", "band"), [*key, "r", "c"]))
    return again.repartition(*key, "r", "c").mapInPandas(read_off, f"line_id {fields['line_id']}, seg {fields['seg']}, row long, column long")
