"""Alignment of the joint sequences of two runs.

Sequence alignment is a chain of dependent steps, so a whole line would be one task. Stretches of joints, of several counts, whose
lengths occur once in each run are certain anchors. They are found with joins and windows over chunks, settle
most joints by themselves, and cut a line into short segments that are aligned independently. A segment that stays long, for
want of unlike lengths, is aligned exactly in tiles (``tiles``). Lines without lengths are paired by chainage: a chunk of joints acts on
the joints still waiting before it as a function of their number alone, and functions can be composed.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from girthline.operators.scan import chunk_of, numbered, running
from girthline.operators.tiles import TILE, align_long
from girthline.session import by_rows, kept

MIN_SIMILARITY = 0.85
GAP = -0.5
MISMATCH = -1.0
WT_BONUS = 0.2
WT_TOLERANCE_MM = 0.5
DISTANCE_BONUS = 0.3
DISTANCE_TOLERANCE_M = 500.0
MIN_COVERAGE = 0.5
LENGTH_TOLERANCE = 0.01
TARGET_RATE = 0.90
#: Counts of joints in a stretch. Short ones survive edits best, long ones occur once even where few lengths are in use.
ANCHOR_JOINTS = (5, 10, 20, 40)
CHUNK_JOINTS = 50_000
BATCH_JOINTS = 2_000
#: Segments with more joints of both runs together are aligned in tiles.
LONG_SEGMENT = 4_000
SMALL_SEGMENT = 200_000
#: Chunks of chainage for lines without lengths; above the tolerance, so that only neighbours matter to each other.
CHUNK_M = 20_000.0

_PAIR = ("old_length_m", "new_length_m", "old_start_m", "new_start_m", "confidence")


def _types(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def pair_schema(joints: DataFrame) -> str:
    """Schema of pairs; lines and joints keep their types."""
    types = _types(joints)
    ends = ", ".join(f"{s}_joint {types['joint_number']}" for s in ("old", "new"))
    return f"line_id {types['line_id']}, {ends}, " + ", ".join(f"{c} double" for c in _PAIR)


def length_similarity(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), 1.0 - F.abs(a - b) / F.greatest(a, b)).otherwise(0.0)


def pair_score(a: Column, b: Column) -> Column:
    """Score of pairing two joint structs, in single precision like the alignment itself."""
    la, lb = (F.coalesce(j["length_m"], F.lit(0.0)).cast("float") for j in (a, b))
    wa, wb = (F.coalesce(j["wt_mm"], F.lit(0.0)).cast("float") for j in (a, b))
    da, db = (j["abs_distance_start_m"].cast("float") for j in (a, b))
    longest = F.greatest(la, lb)
    one = F.lit(1.0).cast("float")
    sim = F.when(longest > 0, one - F.abs(la - lb) / F.nullif(longest, F.lit(0.0).cast("float"))).otherwise(F.lit(0.0).cast("float"))
    alike = sim.cast("double") >= MIN_SIMILARITY
    walls = (wa > 0) & (wb > 0) & (F.abs(wa - wb).cast("double") <= WT_TOLERANCE_MM)
    near = F.abs(da - db).cast("double") <= DISTANCE_TOLERANCE_M
    zero = F.lit(0.0).cast("float")
    return F.when(
        alike,
        sim + F.when(walls, F.lit(WT_BONUS).cast("float")).otherwise(zero)
        + F.when(near, F.lit(DISTANCE_BONUS).cast("float")).otherwise(zero),
    ).otherwise(F.lit(MISMATCH).cast("float"))


def best_first(score: Column, joint: Column) -> Column:
    """One whole number that sorts pairs by score, best first, then by joint, rows without a number first.

    Scores are single precision and -1 or at least 0.85, so they are whole multiples of 2 ** -24. A number keeps an aggregate of all cells in a hash
    table, where a struct would sort every cell first.
    """
    steps = F.when(F.isnan(score), F.lit(2 ** 26)).otherwise((-score * 2.0 ** 24).cast("long"))
    return steps * F.lit(2 ** 33) + F.coalesce(joint.cast("long"), F.lit(-(2 ** 31) - 1))


def line_modes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per line: joint counts, total lengths, length coverage, alignment mode and band."""
    def side(df: DataFrame, s: str) -> DataFrame:
        return df.groupBy("line_id").agg(
            F.count(F.lit(1)).alias(f"n_{s}"),
            F.sum(F.coalesce("length_m", F.lit(0.0))).alias(f"length_{s}_m"),
            F.avg(F.when(F.col("length_m") > 0, 1.0).otherwise(0.0)).alias(f"coverage_{s}"),
        )

    rows = side(old, "old").join(side(new, "new"), "line_id", "full").na.fill(0)
    covered = F.least("coverage_old", "coverage_new") >= MIN_COVERAGE
    largest = F.greatest("n_old", "n_new")
    band = F.greatest(F.lit(20), F.floor(largest * 0.05))
    return rows.withColumns({
        "method": F.when((F.col("n_old") == 0) | (F.col("n_new") == 0), "none")
        .when(covered, "needleman_wunsch")
        .otherwise("nearest_distance"),
        # The end of the longer run must stay inside the band.
        "band": F.greatest(band, F.abs(F.col("n_old") - F.col("n_new"))).cast("int"),
    })


def band_pairs(old: DataFrame, new: DataFrame, chunk: int = CHUNK_JOINTS) -> DataFrame:
    """Every pair of an old and a new joint inside the alignment's band: ``line_id`` and the structs ``o`` and ``n`` with ``pos``.

    Positions lie in buckets as wide as the band reaches, so an old joint looks into two of them and meets each new one once. The result has a
    row for each cell of the band; it serves to look at scores, the alignment itself never makes it.
    """
    placed = numbered(_both(old, new), ["line_id", "side"], ["joint_number"], chunk_of(F.col("joint_number"), chunk), "pos")
    rows = placed.join(line_modes(old, new).select("line_id", "band"), "line_id")
    width = 2 * F.col("band") + 1
    fields = F.struct("pos", "joint_number", "length_m", "wt_mm", "abs_distance_start_m")
    first, last = F.floor((F.col("pos") - F.col("band")) / width), F.floor((F.col("pos") + F.col("band")) / width)
    o = rows.where("side = 1").select("line_id", "band", fields.alias("o"), F.explode(F.array_distinct(F.array(first, last))).alias("_bucket"))
    n = rows.where("side = 2").select("line_id", fields.alias("n"), F.floor(F.col("pos") / width).alias("_bucket"))
    return o.join(n, ["line_id", "_bucket"]).where(F.abs(F.col("o.pos") - F.col("n.pos")) <= F.col("band")).select("line_id", "o", "n")


def _both(old: DataFrame, new: DataFrame) -> DataFrame:
    columns = ["line_id", "joint_number", "abs_distance_start_m", "length_m", "wt_mm"]
    return old.select(F.lit(1).alias("side"), *columns).unionByName(new.select(F.lit(2).alias("side"), *columns))


def _plain(values):
    """A pandas column of Python objects; Spark takes no chunked Arrow strings from grouped functions."""
    import pandas as pd

    return pd.Series(list(values), dtype=object)


def _chain(frame):
    """The most anchors of a chunk that are in order in both runs (a longest increasing chain); a pandas frame."""
    frame = frame.sort_values(["p1", "p2"])
    tails: list[int] = []
    at: list[int] = []
    before = np.full(len(frame), -1)
    for k, p in enumerate(frame["p2"].tolist()):
        place = bisect_left(tails, p)
        before[k] = at[place - 1] if place else -1
        tails[place:place + 1], at[place:place + 1] = [p], [k]
    kept, k = [], at[-1] if at else -1
    while k >= 0:
        kept.append(k)
        k = before[k]
    return type(frame)({c: _plain(frame[c].iloc[kept[::-1]]) for c in ("line_id", "p1", "p2")})


def anchored(joints: DataFrame, modes: DataFrame, anchor_joints: Sequence[int] = ANCHOR_JOINTS, chunk: int = CHUNK_JOINTS) -> DataFrame:
    """Joints of both runs with position ``pos``, segment ``seg`` and ``is_anchor``.

    An anchor is the first joint of a stretch of lengths, to the centimetre, found exactly once in each run, inside the band. Of the anchors of a
    chunk the longest chain in order stays, and of those the ones in order with every other chunk's. Anchors with the same ``seg`` on both sides
    are a pair; a segment is the joints after an anchor up to the next one.
    """
    keys, most = ["line_id", "side"], max(anchor_joints)
    placed = kept(numbered(joints, keys, ["joint_number"], chunk_of(F.col("joint_number"), chunk), "pos"))
    # The first joints of a chunk are repeated at the end of the chunk before, so stretches may cross.
    home = chunk_of(F.col("pos"), chunk)
    overlap = (F.col("pos") % chunk < most - 1) & (home > 0)
    sets = F.when(overlap, F.array(home, home - 1)).otherwise(F.array(home))
    cm = F.when(F.col("length_m") > 0, F.bround(F.col("length_m") * 100, 0).cast("long"))
    laid = placed.select(*keys, "pos", F.coalesce(cm, F.lit(-1)).alias("_cm"), home.alias("_home"), F.explode(sets).alias("_set"))
    along = Window.partitionBy(*keys, "_set").orderBy("pos").rowsBetween(0, most - 1)
    steps = laid.withColumn("_ahead", F.collect_list("_cm").over(along)).where(F.col("_home") == F.col("_set"))

    def stretch(k: int) -> Column:
        part = F.slice("_ahead", 1, k)
        usable = (F.size("_ahead") >= k) & (F.array_position(part, -1) == 0)
        return F.when(usable, F.struct(F.lit(k).alias("k"), F.xxhash64(part).alias("h1"), F.xxhash64(F.lit("second"), part).alias("h2")))

    keyed = steps.select(*keys, "pos", F.explode(F.array_compact(F.array(*map(stretch, anchor_joints)))).alias("_key"))

    def only(side: int, f) -> Column:
        return f(F.when(F.col("side") == side, F.col("pos")))

    pairs = keyed.groupBy("line_id", "_key").agg(
        only(1, F.count).alias("_n1"), only(2, F.count).alias("_n2"),
        only(1, F.min).alias("p1"), only(2, F.min).alias("p2"),
    ).where((F.col("_n1") == 1) & (F.col("_n2") == 1))
    pairs = pairs.join(modes.where(F.col("method") == "needleman_wunsch").select("line_id", "band"), "line_id")
    pairs = pairs.where(F.abs(F.col("p1") - F.col("p2")) <= F.col("band")).select("line_id", "p1", "p2").distinct()
    types = _types(pairs)
    chained = pairs.groupBy("line_id", chunk_of(F.col("p1"), chunk).alias("_chunk")).applyInPandas(
        lambda frame: _chain(frame), f"line_id {types['line_id']}, p1 {types['p1']}, p2 {types['p2']}"
    )
    at = chunk_of(F.col("p1"), chunk)
    pairs = running(
        kept(chained), ["line_id"], ["p1"], at,
        {"_before": ("max", F.col("p2")), "_after": ("min_after", F.col("p2"))}, include_current=False,
    )
    in_order = (F.coalesce("_before", F.lit(0)) < F.col("p2")) & (F.coalesce("_after", F.lit(2**62)) > F.col("p2"))
    pairs = pairs.where(in_order)
    marks = pairs.select("line_id", F.col("p1").alias("_seg"), F.explode(F.array(
        F.struct(F.lit(1).alias("side"), F.col("p1").alias("pos")), F.struct(F.lit(2).alias("side"), F.col("p2").alias("pos"))
    )).alias("_m")).select("line_id", "_seg", "_m.*")
    marked = kept(placed.join(by_rows(marks), ["line_id", "side", "pos"], "left"))
    rows = running(
        marked.withColumn("is_anchor", F.col("_seg").isNotNull()), keys, ["pos"], chunk_of(F.col("pos"), chunk),
        {"seg": ("last", F.col("_seg"))},
    )
    return rows.withColumn("seg", F.coalesce("seg", F.lit(0).cast("long"))).drop("_seg")


def _scores(a: dict, b: dict, rows: slice, columns: slice) -> np.ndarray:
    """Scores of old joints against new joints, single precision."""
    la, lb = a["length"][rows, None], b["length"][None, columns]
    wa, wb = a["wall"][rows, None], b["wall"][None, columns]
    longest = np.maximum(la, lb)
    sim = np.float32(1.0) - np.abs(la - lb) / np.where(longest > 0, longest, np.float32(1.0))
    alike = (sim >= MIN_SIMILARITY) & (longest > 0)
    walls = (wa > 0) & (wb > 0) & (np.abs(wa - wb) <= WT_TOLERANCE_MM)
    near = np.abs(a["start"][rows, None] - b["start"][None, columns]) <= DISTANCE_TOLERANCE_M
    score = sim + np.float32(WT_BONUS) * walls + np.float32(DISTANCE_BONUS) * near
    return np.where(alike, score, np.float32(MISMATCH)).astype(np.float64)


def align_segment(a: dict, b: dict, band: int, shift: int) -> list[tuple[int, int]]:
    """Best global alignment of two joint sequences inside a band; index pairs that are alike enough.

    ``shift`` is the old position minus the new one at the start. The rows are swept with vector operations:
    a run of gaps is a running maximum. Rows are kept only at intervals; the choices of a block are recomputed
    when the trace reaches it, so memory grows with the square root of the length. On equal scores a pair comes
    before an unmatched old joint, and that before an unmatched new one.
    """
    n, m = len(a["length"]), len(b["length"])
    columns = np.arange(m + 1)
    stride = max(64, math.isqrt(n) + 1)

    whole = _scores(a, b, slice(0, n), slice(0, m)) if n * m <= SMALL_SEGMENT else None

    def limits(i: int) -> tuple[int, int]:
        return max(0, i + shift - band), min(m, i + shift + band)

    def sweep(i: int, before: np.ndarray, trace: bool):
        row = np.full(m + 1, -np.inf)
        lo, hi = limits(i)
        if lo > hi:
            return row, None
        up = before[lo:hi + 1] + GAP
        diag = np.full(hi - lo + 1, -np.inf)
        start = max(lo, 1)
        if start <= hi:
            scores = whole[i - 1, start - 1:hi] if whole is not None else _scores(a, b, slice(i - 1, i), slice(start - 1, hi))[0]
            diag[start - lo:] = before[start - 1:hi] + scores
        best = np.maximum(diag, up)
        climb = GAP * columns[lo:hi + 1]
        row[lo:hi + 1] = np.maximum.accumulate(best - climb) + climb
        if not trace:
            return row, None
        left = np.full(hi - lo + 1, -np.inf)
        left[1:] = row[lo:hi] + GAP
        choice = np.where((diag >= up) & (diag >= left), 0, np.where(up >= left, 1, 2)).astype(np.int8)
        return row, (lo, choice)

    first = np.full(m + 1, -np.inf)
    lo, hi = limits(0)
    first[max(lo, 0):hi + 1] = GAP * columns[max(lo, 0):hi + 1] if lo <= 0 else -np.inf
    kept = {0: first}
    row, choices = first, {}
    for i in range(1, n + 1):
        # A segment of a single block keeps its choices on the way.
        row, choices[i] = sweep(i, row, n <= stride)
        if i % stride == 0:
            kept[i] = row
    pairs: list[tuple[int, int]] = []
    i, j = n, m
    while i > 0 and j > 0:
        block = (i - 1) // stride * stride
        if n > stride:
            row, choices = kept[block], {}
            for k in range(block + 1, i + 1):
                row, choices[k] = sweep(k, row, True)
        while i > block and j > 0:
            lo, choice = choices[i]
            step = choice[j - lo] if 0 <= j - lo < len(choice) else 0
            if step == 0:
                la, lb = a["exact"][i - 1], b["exact"][j - 1]
                if la > 0 and lb > 0 and 1.0 - abs(la - lb) / max(la, lb) >= MIN_SIMILARITY:
                    pairs.append((i - 1, j - 1))
                i, j = i - 1, j - 1
            elif step == 1:
                i -= 1
            else:
                j -= 1
    return pairs[::-1]


def _batch_kernel(pdf):
    """Aligns every segment of a batch, a pandas frame; the rows are put in order once and sliced as arrays."""
    import pandas as pd

    seg, side, pos = (pdf[c].to_numpy() for c in ("seg", "side", "pos"))
    order = np.lexsort((pos, side, seg))
    seg, side, pos = seg[order], side[order], pos[order]
    exact = pdf["length_m"].fillna(0.0).to_numpy(float)[order]
    arrays = {
        "exact": exact,
        "length": exact.astype(np.float32),
        "wall": pdf["wt_mm"].fillna(0.0).to_numpy(np.float32)[order],
        "start": pdf["abs_distance_start_m"].to_numpy(np.float32)[order],
    }
    band = int(pdf["band"].iloc[0])
    cuts = np.flatnonzero((np.diff(seg) != 0) | (np.diff(side) != 0)) + 1
    edges = np.concatenate(([0], cuts, [len(seg)]))
    old_at: list[int] = []
    new_at: list[int] = []
    # Runs alternate between the old and the new joints of a segment; both sides are present.
    for k in range(0, len(edges) - 2, 2):
        i, j, end = int(edges[k]), int(edges[k + 1]), int(edges[k + 2])
        a = {name: v[i:j] for name, v in arrays.items()}
        b = {name: v[j:end] for name, v in arrays.items()}
        # Positions are line-wide, so the band means the same as in an unsegmented alignment.
        for x, y in align_segment(a, b, band, int(pos[i] - pos[j])):
            old_at.append(i + x)
            new_at.append(j + y)
    joint, start = pdf["joint_number"].to_numpy()[order], pdf["abs_distance_start_m"].to_numpy(float)[order]
    la, lb = exact[old_at], exact[new_at]
    length = pdf["length_m"].to_numpy(float)[order]
    return pd.DataFrame({
        "line_id": _plain([pdf["line_id"].iloc[0]] * len(old_at)),
        "old_joint": joint[old_at],
        "new_joint": joint[new_at],
        "old_length_m": length[old_at],
        "new_length_m": length[new_at],
        "old_start_m": start[old_at],
        "new_start_m": start[new_at],
        "confidence": 1.0 - np.abs(la - lb) / np.maximum(la, lb),
    })


def _long_pairs(rows: DataFrame, sizes: DataFrame, tile: int) -> DataFrame:
    """Pairs of the joints of long segments, aligned in tiles."""
    def scores(a: dict, b: dict) -> np.ndarray:
        a, b = ({
            "length": np.nan_to_num(x["length_m"]).astype(np.float32), "wall": np.nan_to_num(x["wt_mm"]).astype(np.float32),
            "start": x["abs_distance_start_m"].astype(np.float32),
        } for x in (a, b))
        return _scores(a, b, slice(None), slice(None))

    cells = align_long(rows, sizes, ["length_m", "wt_mm", "abs_distance_start_m"], scores, GAP, tile)
    at = by_rows(cells).join(sizes.select("line_id", "seg", "first_1", "first_2"), ["line_id", "seg"])
    at = at.select("line_id", (F.col("row") + F.col("first_1")).alias("p1"), (F.col("column") + F.col("first_2")).alias("p2"))

    def side(number: int, name: str) -> DataFrame:
        joint = F.struct("joint_number", "length_m", "abs_distance_start_m").alias(name)
        return rows.where(F.col("side") == number).select("line_id", F.col("pos").alias(f"p{number}"), joint)

    pairs = at.join(by_rows(side(1, "o")), ["line_id", "p1"]).join(by_rows(side(2, "n")), ["line_id", "p2"])
    return _paired(pairs).where(F.col("confidence") >= MIN_SIMILARITY)


def _paired(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "line_id", F.col("o.joint_number").alias("old_joint"), F.col("n.joint_number").alias("new_joint"),
        F.col("o.length_m").alias("old_length_m"), F.col("n.length_m").alias("new_length_m"),
        F.col("o.abs_distance_start_m").alias("old_start_m"), F.col("n.abs_distance_start_m").alias("new_start_m"),
        length_similarity(F.col("o.length_m"), F.col("n.length_m")).alias("confidence"),
    )


def align_by_length(
    joints: DataFrame, modes: DataFrame, anchor_joints: Sequence[int] = ANCHOR_JOINTS, chunk: int = CHUNK_JOINTS,
    long_segment: int = LONG_SEGMENT, tile: int = TILE,
) -> DataFrame:
    """Pairs of lines aligned by joint length."""
    by_length = modes.where(F.col("method") == "needleman_wunsch").select("line_id", "band")
    rows = kept(anchored(joints.join(by_length.select("line_id"), "line_id", "left_semi"), modes, anchor_joints, chunk))

    def of(side: int) -> Column:
        fields = F.struct("joint_number", "length_m", "abs_distance_start_m")
        return F.max(F.when((F.col("side") == side) & F.col("is_anchor"), fields))

    sure = _paired(rows.where(F.col("is_anchor")).groupBy("line_id", "seg").agg(of(1).alias("o"), of(2).alias("n")))
    one, two = F.col("side") == 1, F.col("side") == 2
    rest = rows.where(~F.col("is_anchor"))
    sizes = rest.groupBy("line_id", "seg").agg(
        F.count_if(one).alias("n_1"), F.count_if(two).alias("n_2"),
        F.min(F.when(one, F.col("pos"))).alias("first_1"), F.min(F.when(two, F.col("pos"))).alias("first_2"),
    ).where((F.col("n_1") > 0) & (F.col("n_2") > 0))
    sizes = kept(sizes.join(by_length, "line_id"))
    short = F.col("n_1") + F.col("n_2") <= long_segment
    inner = rest.drop("is_anchor").join(by_rows(sizes.where(short).select("line_id", "seg", "band")), ["line_id", "seg"])
    # Neighbouring segments share a call; a batch is a bounded stretch of positions.
    batched = inner.withColumn("_batch", chunk_of(F.col("seg"), BATCH_JOINTS))
    solved = batched.groupBy("line_id", "_batch").applyInPandas(_batch_kernel, pair_schema(joints))
    tiled = _long_pairs(rest, sizes.where(~short), tile)
    columns = solved.columns
    return sure.select(*columns).unionByName(solved).unionByName(tiled.select(*columns)).withColumn("matched_via", F.lit("needleman_wunsch"))


class _Arrivals:
    """Joints of a chunk in chainage order, after those near the end of the chunk before (``halo``).

    Pairing takes the joints of both runs as they come: one pairs with the first joint still waiting on the other side that it reaches,
    or waits. Waiting joints are the last ones of one side, so their number, positive for the old run and negative for the new one, is
    all that earlier joints mean to later ones.
    """

    def __init__(self, pdf) -> None:
        start = pdf["abs_distance_start_m"].to_numpy(float)
        order = np.lexsort((pdf["joint_number"].to_numpy(), pdf["side"].to_numpy(), start))
        self.joint, self.length = pdf["joint_number"].to_numpy()[order], pdf["length_m"].to_numpy(float)[order]
        side, start, halo = pdf["side"].to_numpy()[order], start[order], pdf["halo"].to_numpy()[order]
        self.start = start
        self.of = {s: np.flatnonzero(side == s) for s in (1, 2)}
        own = ~halo
        self.side, at = side[own], np.flatnonzero(own)
        self.waiting_before = {s: int((side[halo] == s).sum()) for s in (1, 2)}
        reach = {}
        for s in (1, 2):
            pos = start[self.of[s]]
            come = np.searchsorted(self.of[s], at, "right")
            first = np.maximum(np.searchsorted(pos, start[at] - DISTANCE_TOLERANCE_M, "left") - 1, 0)
            padded = np.append(pos, np.inf)
            while (far := start[at] - padded[first] > DISTANCE_TOLERANCE_M).any():
                first += far
            reach[s] = np.maximum(come - first, 0), come
        old = self.side == 1
        #: In reach when a joint comes: of its own side with itself, and of the other side; and how many of that side have come.
        self.mine = np.where(old, reach[1][0], reach[2][0])
        self.others = np.where(old, reach[2][0], reach[1][0])
        self.come = np.where(old, reach[2][1], reach[1][1])
        self.rank = np.where(old, reach[1][1], reach[2][1]) - 1

    def after(self) -> tuple[int, list[int]]:
        """The least number of waiting joints before the chunk, and what that and each larger one become by its end."""
        low = -self.waiting_before[2]
        states = np.arange(low, self.waiting_before[1] + 1)
        inverse = np.arange(len(states))
        for k in range(0, len(self.side), 64):
            part = slice(k, k + 64)
            for s, mine, others in zip(self.side[part].tolist(), self.mine[part].tolist(), self.others[part].tolist()):
                sign = 1 if s == 1 else -1
                waiting = np.minimum(-sign * states, others)
                states = sign * np.where(waiting > 0, 1 - waiting, np.minimum(np.maximum(sign * states, 0) + 1, mine))
            states, place = np.unique(states, return_inverse=True)
            inverse = place[inverse]
        return low, states[inverse].tolist()

    def pairs(self, state: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the old and the new joints that pair, with so many waiting before."""
        state = max(-self.waiting_before[2], min(self.waiting_before[1], state))
        found: tuple[list[int], list[int]] = ([], [])
        for s, mine, others, come, rank in zip(*(x.tolist() for x in (self.side, self.mine, self.others, self.come, self.rank))):
            sign = 1 if s == 1 else -1
            waiting = min(-sign * state, others)
            if waiting > 0:
                for side, k in ((s, rank), (3 - s, come - waiting)):
                    found[side - 1].append(k)
                state = sign * (1 - waiting)
            else:
                state = sign * min(max(sign * state, 0) + 1, mine)
        return self.of[1][found[0]], self.of[2][found[1]]


def _composed(maps):
    """Waiting joints before each chunk of a line, from what the chunks make of any number; a pandas frame."""
    maps = maps.sort_values("_chunk", ignore_index=True)
    entry, state = [], 0
    for low, after in zip(maps["low"].tolist(), maps["after"].tolist()):
        entry.append(state)
        state = int(after[max(0, min(len(after) - 1, state - low))])
    return maps.assign(line_id=_plain(maps["line_id"].tolist()), entry=entry)[["line_id", "_chunk", "entry"]]


def align_by_distance(joints: DataFrame, modes: DataFrame, chunk_m: float = CHUNK_M) -> DataFrame:
    """Pairs of lines without usable joint lengths: nearest joints in chainage order. Joints without a chainage have no partner."""
    if chunk_m < DISTANCE_TOLERANCE_M:
        raise ValueError("a chunk must be at least as long as the tolerance")
    by_distance = modes.where(F.col("method") == "nearest_distance").select("line_id")
    rows = joints.join(by_distance, "line_id", "left_semi").where(F.col("abs_distance_start_m").isNotNull())
    home = chunk_of(F.col("abs_distance_start_m"), chunk_m)
    # A little more than the tolerance: what is too far is found out exactly later.
    near_end = (home + 1) * chunk_m - F.col("abs_distance_start_m") <= DISTANCE_TOLERANCE_M * 1.000001 + 1e-6
    chunks = F.explode(F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home)))
    placed = rows.select("line_id", "side", "joint_number", "abs_distance_start_m", "length_m", home.alias("_home"), chunks.alias("_chunk"))
    placed = placed.withColumn("halo", F.col("_home") != F.col("_chunk")).drop("_home")
    types = _types(placed)
    keys = f"line_id {types['line_id']}, _chunk {types['_chunk']}"

    def mapped(pdf):
        import pandas as pd

        low, after = _Arrivals(pdf).after()
        return pd.DataFrame({"line_id": _plain(pdf["line_id"].iloc[:1]), "_chunk": [pdf["_chunk"].iloc[0]], "low": [low], "after": [after]})

    def emitted(pdf):
        import pandas as pd

        chunk = _Arrivals(pdf)
        old, new = chunk.pairs(int(pdf["entry"].iloc[0]))
        apart = np.abs(chunk.start[new] - chunk.start[old])
        return pd.DataFrame({
            "line_id": _plain([pdf["line_id"].iloc[0]] * len(old)), "old_joint": chunk.joint[old], "new_joint": chunk.joint[new],
            "old_length_m": chunk.length[old], "new_length_m": chunk.length[new], "old_start_m": chunk.start[old],
            "new_start_m": chunk.start[new], "confidence": 1.0 - apart / DISTANCE_TOLERANCE_M,
        })

    maps = placed.groupBy("line_id", "_chunk").applyInPandas(mapped, f"{keys}, low int, after array<int>")
    entries = maps.groupBy("line_id").applyInPandas(lambda pdf: _composed(pdf), f"{keys}, entry int")
    solved = placed.join(entries, ["line_id", "_chunk"]).groupBy("line_id", "_chunk").applyInPandas(emitted, pair_schema(joints))
    return solved.withColumn("matched_via", F.lit("nearest_distance"))


def align(old: DataFrame, new: DataFrame, anchor_joints: Sequence[int] = ANCHOR_JOINTS, chunk: int = CHUNK_JOINTS) -> DataFrame:
    """Joint pairs of every line, by length where both runs report lengths and by chainage otherwise."""
    modes, joints = line_modes(old, new), _both(old, new)
    pairs = align_by_length(joints, modes, anchor_joints, chunk).unionByName(align_by_distance(joints, modes))
    length = F.coalesce("new_length_m", F.lit(0.0)) - F.coalesce("old_length_m", F.lit(0.0))
    return pairs.withColumn("length_diff_m", length)


def unmatched_joints(joints: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """Joints of a run ('old' or 'new') without a partner."""
    taken = pairs.select("line_id", F.col(f"{side}_joint").alias("joint_number"))
    return joints.join(by_rows(taken), ["line_id", "joint_number"], "left_anti")


def reversals(pairs: DataFrame, chunk: int = CHUNK_JOINTS) -> DataFrame:
    """Pairs whose chainage is lower than that of the pair before, in either run."""
    at = chunk_of(F.col("old_joint"), chunk)
    rows = running(
        pairs, ["line_id"], ["old_joint"], at,
        {"_prev": ("last", F.struct(F.col("old_start_m").alias("o"), F.col("new_start_m").alias("n")))},
        include_current=False,
    )
    backwards = (F.col("old_start_m") < F.col("_prev.o")) | (F.col("new_start_m") < F.col("_prev.n"))
    return rows.where(backwards).select("line_id", "old_joint", "new_joint")


def alignment_summary(old: DataFrame, new: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per line: totals, match rate over the larger run, reversals and length parity of the matched joints."""
    found = pairs.groupBy("line_id").agg(
        F.count(F.lit(1)).alias("matched"),
        F.sum(F.coalesce("old_length_m", F.lit(0.0))).alias("_m1"),
        F.sum(F.coalesce("new_length_m", F.lit(0.0))).alias("_m2"),
    )
    turns = reversals(pairs).groupBy("line_id").agg(F.count(F.lit(1)).alias("n_reversals"))
    rows = line_modes(old, new).join(found, "line_id", "left").join(turns, "line_id", "left").na.fill(0)
    parity = F.when(
        (F.col("_m1") > 0) & (F.col("_m2") > 0), F.abs(F.col("_m1") - F.col("_m2")) / F.greatest("_m1", "_m2")
    )
    return rows.withColumns({
        "match_rate": F.col("matched") / F.greatest("n_old", "n_new"),
        "length_disagreement": parity,
        "unmatched_old": F.col("n_old") - F.col("matched"),
        "unmatched_new": F.col("n_new") - F.col("matched"),
    }).drop("_m1", "_m2")


def alignment_codes(summary: DataFrame) -> DataFrame:
    """Line-level findings of the alignment."""
    codes = F.array_compact(F.array(
        F.when((F.col("method") != "none") & (F.col("match_rate") < TARGET_RATE), "LOW_JOINT_MATCH_RATE"),
        F.when(F.col("n_reversals") > 0, "REVERSAL_DETECTED"),
        F.when(F.col("length_disagreement") > LENGTH_TOLERANCE, "LENGTH_MISMATCH_RUN"),
    ))
    return summary.select("line_id", F.explode(codes).alias("code"))
