"""Vendor rows to features, joints and rejects.

Input is one table of raw text rows for the whole fleet: ``line_id, run_id, sheet_ord, source_row`` and one
text column per canonical field. ``sheet_ord`` is 0 for the defect sheet and 1 for a joint registry sheet;
``source_row`` is the row order of a run. Nothing raises on bad data: every dropped row ends with a reason.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from girthline import vocab
from girthline.functions import clock, text, units
from girthline.operators.scan import chunk_of, exact_quantiles, running
from girthline.session import by_rows, kept

RUN = ["line_id", "run_id"]
KEY = [*RUN, "source_row"]
ROWS_PER_CHUNK = 65_536
METRES_PER_CHUNK = 1_000.0
JUMP_M = 500.0
LAT_BOUNDS = (6.0, 38.0)
LON_BOUNDS = (68.0, 98.0)
FLOATS = {
    "wid_mm": "width_mm", "lat": "latitude", "lon": "longitude", "alt_m": "altitude_m", "v_erf": "erf",
    "v_psafe": "psafe", "jlen_m": "joint_length_m",
}
ALONE = {"abs_m": "abs_distance_m", "uw_m": "upstream_weld_dist_m", "wall_mm": "wt_mm", "len_mm": "length_mm"}
TEXTS = {"ftype": "feature_type", "fid_text": "feature_identification", "name": "anomaly_id", "label": "description"}


def is_blank() -> Column:
    return reduce(and_, [F.coalesce(F.col(c), F.lit("")) == "" for c in vocab.ALL_FIELDS])


def read_cells(raw: DataFrame) -> DataFrame:
    """Adds the parsed numbers, codes and row class; no row is dropped."""
    # Columns read alike go through one expression each, and the clock is read before them: written out in one piece, the code of a row
    # outgrows what the JVM compiles. Stages that need few numbers need those of ALONE.
    rows = clock.with_clock(raw, "clock_position", "clock_h", "clock_bad").withColumns({
        "_n": F.transform(F.array(*FLOATS.values()), text.to_float),
        "_s": F.transform(F.array(*TEXTS.values()), text.to_str),
        "_k": F.transform(F.array("feature_type", "feature_identification", "dimension_class"), text.norm),
        **{name: text.to_float(F.col(c)) for name, c in ALONE.items()},
        "jno": text.to_int(F.col("joint_number")),
        "has_depth": ~text.is_na(F.col("depth_pct_wt")),
        "side": units.parse_surface(F.col("surface")),
        "blank": is_blank(),
    })
    rows = rows.withColumns({
        **{name: F.get("_n", F.lit(i)) for i, name in enumerate(FLOATS)}, **{name: F.get("_s", F.lit(i)) for i, name in enumerate(TEXTS)},
        "fid": units.feature_code_of(F.get("_k", F.lit(1))), "dim": units.dimension_code_of(F.get("_k", F.lit(2))),
    })
    rows = rows.withColumns({
        "name": F.coalesce("name", F.concat(F.lit("row"), F.col("source_row").cast("string"))),
        # The key of a text is that of its cell.
        "_t": F.when(F.col("ftype").isNotNull(), F.get("_k", F.lit(0))), "_f": F.when(F.col("fid_text").isNotNull(), F.get("_k", F.lit(1))),
    }).drop("_n", "_s", "_k")
    rows = units.with_depth(rows, "depth_pct_wt", F.col("fid").isin(*vocab.DENT_CODES), "depth_pct", "depth_bad")
    return rows.withColumn("drop_reason", _drop_reason()).drop("_t", "_f")


def _drop_reason(skip: tuple[str, ...] = vocab.SKIP_TYPES) -> Column:
    t, f = F.col("_t"), F.col("_f")
    known = [x for texts in vocab.FEATURE_CODES.values() for x in texts]
    return (
        F.when(F.col("blank"), "blank_row")
        .when(t.isin(*skip), F.concat(F.lit("skip_list:"), F.col("ftype")))
        .when(f.isin(*skip), F.concat(F.lit("skip_list:"), F.col("fid_text")))
        .when(t.isin(*vocab.KEEP_TYPES) | f.isin(*vocab.KEEP_TYPES) | f.isin(*known), None)
        .when(t.isNull() & f.isNull(), F.when(~F.col("has_depth"), "no_type_no_depth"))
        .otherwise(F.concat(F.lit("unrecognised_type:"), F.coalesce("ftype", "fid_text")))
    )


def reclassify_for_dents(cells: DataFrame) -> DataFrame:
    """The same rows without the dent entries of the skip list, so that dents reach the inventory."""
    skip = tuple(s for s in vocab.SKIP_TYPES if "den" not in s)
    rows = cells.withColumns({"_t": text.norm(F.col("ftype")), "_f": text.norm(F.col("fid_text"))})
    return rows.withColumn("drop_reason", _drop_reason(skip)).drop("_t", "_f")


def _by_row(df: DataFrame, values: dict, include_current: bool = True, chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    return running(df, RUN, ["source_row"], chunk_of(F.col("source_row"), chunk), values, include_current)


def fill_joint(cells: DataFrame, chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Adds ``ctx_joint``: the last joint number at or before the row."""
    return _by_row(cells, {"ctx_joint": ("last", F.col("jno"))}, chunk=chunk)


def with_context(cells: DataFrame, chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Rows of the defect sheet with ``ctx_joint`` and ``abs_before_m``, the chainage last seen above."""
    return _by_row(
        cells.where(F.col("sheet_ord") == 0),
        {"ctx_joint": ("last", F.col("jno")), "abs_before_m": ("last_before", F.col("abs_m"))}, chunk=chunk,
    )


def chainage_order(rows: DataFrame) -> DataFrame:
    """Per run: whether chainage ever drops by more than 500 m from row to row, and its number of anchors."""
    return rows.groupBy(*RUN).agg(
        (~F.coalesce(F.bool_or(F.col("abs_m") < F.col("abs_before_m") - JUMP_M), F.lit(False))).alias("is_monotonic"),
        F.count_if(F.col("abs_m").isNotNull() & F.col("jno").isNotNull()).alias("n_anchors"),
    ).withColumn("uses_lookup", ~F.col("is_monotonic") & (F.col("n_anchors") > 0))


def lookup_joint(cells: DataFrame, width_m: float = METRES_PER_CHUNK) -> DataFrame:
    """Adds ``asof_joint`` and ``asof_uw_m``: the nearest anchor at or before the row's chainage.

    An anchor is a row with both a joint number and a chainage; of anchors at one chainage the highest joint
    counts. Rows before the first anchor get null.
    """
    anchor = F.when(
        F.col("jno").isNotNull() & F.col("abs_m").isNotNull(), F.struct(F.col("abs_m").alias("x"), F.col("jno").alias("j"))
    )
    placed = cells.where(F.col("abs_m").isNotNull()).withColumns({
        "_anchor": anchor, "_kind": F.when(anchor.isNull(), 1).otherwise(0), "_j": F.coalesce("jno", F.lit(0)),
    })
    rows = running(
        placed, RUN, ["abs_m", "_kind", "_j", "source_row"], chunk_of(F.col("abs_m"), width_m), {"_at": ("last", F.col("_anchor"))}
    )
    found = rows.withColumns({
        "asof_joint": F.col("_at.j"), "asof_uw_m": F.col("abs_m") - F.col("_at.x"),
    }).drop("_at", "_anchor", "_kind", "_j")
    nothing = cells.where(F.col("abs_m").isNull()).withColumns({
        "asof_joint": F.lit(None).cast("int"), "asof_uw_m": F.lit(None).cast("double"),
    })
    return found.unionByName(nothing)


def attribute_joints(cells: DataFrame) -> DataFrame:
    """Adds ``joint`` and ``uw_override`` to the rows of the defect sheet.

    A row keeps its own joint number; else it takes the last one above it, or, in runs whose rows are out of
    chainage order, the joint found by chainage.
    """
    # Parsed once here; the runs' order, both kinds of attribution and all later stages read the result.
    # The texts they were parsed from are not looked at again.
    context = kept(with_context(cells.drop(*vocab.ALL_FIELDS)))
    rows = context.join(chainage_order(context).select(*RUN, "uses_lookup"), RUN, "left")
    ordered = rows.where(~F.coalesce("uses_lookup", F.lit(False))).withColumns({
        "joint": F.coalesce("jno", "ctx_joint"), "uw_override": F.lit(None).cast("double"),
    })
    shuffled = lookup_joint(rows.where(F.coalesce("uses_lookup", F.lit(False)))).withColumns({
        "joint": F.coalesce("jno", "asof_joint"),
        "uw_override": F.when(F.col("jno").isNull(), F.col("asof_uw_m")),
    }).drop("asof_joint", "asof_uw_m")
    return ordered.unionByName(shuffled)


def resolve_rows(attributed: DataFrame) -> DataFrame:
    """Adds ``reason`` (null for kept rows) in the order the checks apply."""
    invalid = (
        F.col("depth_bad") | F.col("clock_bad")
        | (F.abs("lat") > 90) | (F.abs("lon") > 180)
        | (F.col("len_mm") < 0) | (F.col("wid_mm") < 0) | (F.col("wall_mm") <= 0)
    )
    reason = (
        F.when(F.col("drop_reason").isNotNull(), F.col("drop_reason"))
        .when(F.col("joint").isNull(), "missing_joint_number")
        .when(F.coalesce(invalid, F.lit(False)), "invalid_values")
        .when(F.col("depth_pct").isNull(), "no_depth")
    )
    return attributed.withColumn("reason", reason)


def rejects(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("reason").isNotNull()).select(*KEY, "reason")


def audit(resolved: DataFrame) -> DataFrame:
    """Rows by reason. Rows outside metal loss are counted although they are kept."""
    reached = F.col("reason").isNull() | (F.col("reason") == "no_depth")
    noted = F.when(
        reached & F.col("fid").isin(*vocab.NON_METAL_LOSS), F.concat(F.lit("non_metal_loss_fid:"), F.col("fid"))
    )
    return (
        resolved.select(*RUN, F.explode(F.array_compact(F.array("reason", noted))).alias("reason"))
        .groupBy(*RUN, "reason").agg(F.count(F.lit(1)).alias("n"))
    )


def unmapped_texts(cells: DataFrame) -> DataFrame:
    """Texts that look like dents, welds, cracks or mill anomalies but have no code."""
    rejected = F.when(
        F.col("drop_reason").startswith("unrecognised_type:"), F.coalesce("ftype", "fid_text")
    )
    uncoded = F.when(F.col("drop_reason").isNull() & (F.col("fid") == "UNDEFINED"), F.col("feature_identification"))
    looks = F.lower(F.col("label_text")).rlike("|".join(vocab.UNMAPPED_TOKENS))
    return (
        cells.where(F.col("sheet_ord") == 0)
        .select(*RUN, text.strip(F.coalesce(rejected, uncoded)).alias("label_text"))
        .where(looks).distinct()
    )


def to_features(resolved: DataFrame) -> DataFrame:
    """Kept rows in the feature layout, cluster parents not yet assigned."""
    return resolved.where(F.col("reason").isNull()).select(
        *KEY,
        F.col("name").alias("anomaly_id"),
        F.coalesce("abs_m", F.lit(0.0)).alias("abs_distance_m"),
        F.col("joint").alias("joint_number"),
        F.coalesce("uw_override", "uw_m").alias("upstream_weld_dist_m"),
        F.col("clock_h").alias("clock_decimal_hours"),
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("alt_m").alias("altitude_m"),
        F.col("wall_mm").alias("wt_mm"), F.col("depth_pct").alias("depth_pct_wt"),
        F.col("len_mm").alias("length_mm"), F.col("wid_mm").alias("width_mm"),
        F.col("side").alias("surface"),
        F.col("fid").alias("feature_identification"), F.col("dim").alias("dimension_class"),
        F.coalesce("label", "ftype", F.lit("")).alias("raw_description"),
        F.col("v_erf").alias("vendor_erf"), F.col("v_psafe").alias("vendor_psafe_kgcm2"),
        (F.col("fid") == "COCL").alias("is_cluster_parent"),
    )


def assign_clusters(features: DataFrame, chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Adds ``cluster_parent_id``: a marked row belongs to the last parent above it in the same joint."""
    marked = F.lit(False)
    for marker in vocab.CHILD_MARKERS:
        marked = marked | text.norm(F.col("raw_description")).contains(marker)
    # Each running value reads its rows twice, so both steps are kept; else the reading behind them would be done again each time.
    narrow = kept(features.select(*KEY, "joint_number", "anomaly_id", "is_cluster_parent", marked.alias("_marked")))
    rows = kept(_by_row(narrow, {"_previous": ("last", F.col("joint_number"))}, include_current=False, chunk=chunk))
    enters = F.col("_previous").isNull() | (F.col("_previous") != F.col("joint_number"))
    event = F.when(F.col("is_cluster_parent"), F.struct(F.col("anomaly_id").alias("id"))).when(
        enters, F.struct(F.lit(None).cast("string").alias("id"))
    )
    rows = _by_row(rows, {"_open": ("last", event)}, chunk=chunk)
    child = F.col("_marked") & ~F.col("is_cluster_parent") & F.col("_open.id").isNotNull()
    children = rows.where(child).select(*KEY, F.col("_open.id").alias("cluster_parent_id"))
    return features.join(by_rows(children), KEY, "left")


def coordinate_verdicts(features: DataFrame, lat=LAT_BOUNDS, lon=LON_BOUNDS) -> DataFrame:
    """Per run: ok, swapped or out of bounds by the exact medians of its coordinates."""
    # Both medians read the rows twice.
    features = kept(features.select(*RUN, "latitude", "longitude"))
    lats = exact_quantiles(features, RUN, "latitude", [0.5]).select(*RUN, F.col("q0").alias("lat_median"))
    lons = exact_quantiles(features, RUN, "longitude", [0.5]).select(*RUN, F.col("q0").alias("lon_median"))
    a, b = F.col("lat_median"), F.col("lon_median")
    code = (
        F.when(a.between(*lat) & b.between(*lon), None)
        .when(b.between(*lat) & a.between(*lon), "COORDINATES_SWAPPED")
        .otherwise("LAT_LON_OUT_OF_BOUNDS")
    )
    return lats.join(lons, RUN).withColumn("code", code)


def fix_coordinates(features: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Swaps latitude and longitude of runs that have them the wrong way round."""
    rows = features.join(verdicts.select(*RUN, "code"), RUN, "left")
    swap = F.coalesce(F.col("code") == "COORDINATES_SWAPPED", F.lit(False))
    return rows.withColumns({
        "latitude": F.when(swap, F.col("longitude")).otherwise(F.col("latitude")),
        "longitude": F.when(swap, F.col("latitude")).otherwise(F.col("longitude")),
    }).drop("code")


def reader_codes(order: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Line-level findings of reading."""
    rebuilt = order.where(F.col("uses_lookup")).select("line_id", F.lit("RECONSTRUCTED_JOINT_CONTEXT_FROM_CHAINAGE").alias("code"))
    return rebuilt.unionByName(verdicts.where(F.col("code").isNotNull()).select("line_id", "code"))


def joint_registry(cells: DataFrame) -> DataFrame:
    """Joints of every run from all rows, skipped ones included.

    Start is the lowest chainage less weld distance; length the first reported, the defect sheet before the
    registry sheet; wall thickness the most frequent, the first seen on ties. The defect sheet contributes
    chainage and wall only on rows with their own joint number, the registry sheet on all rows.
    """
    filled = fill_joint(cells.where((F.col("sheet_ord") == 0) & ~F.col("blank"))).unionByName(
        fill_joint(cells.where(F.col("sheet_ord") == 1))
    ).where(F.col("ctx_joint").isNotNull())
    counts = F.col("jno").isNotNull() | (F.col("sheet_ord") == 1)
    at = F.struct("sheet_ord", "source_row")
    rows = filled.select(
        *RUN, F.col("ctx_joint").alias("joint_number"), at.alias("_at"),
        F.when(counts, F.col("abs_m") - F.coalesce("uw_m", F.lit(0.0))).alias("_start"),
        F.when(counts, F.col("wall_mm")).alias("_wall"), "jlen_m",
    )
    by_joint = [*RUN, "joint_number"]
    # One row per joint and wall value first, so that a crowded joint is small before it is ranked.
    walls = rows.groupBy(*by_joint, "_wall").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"), F.min("_start").alias("_start"),
        F.min(F.when(F.col("jlen_m").isNotNull(), F.struct("_at", "jlen_m"))).alias("_length"),
    )
    ranked = F.when(F.col("_wall").isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col("_first").alias("at")))
    return walls.groupBy(*by_joint).agg(
        F.coalesce(F.min("_start"), F.lit(0.0)).alias("abs_distance_start_m"),
        F.coalesce(F.min("_length")["jlen_m"], F.lit(0.0)).alias("length_m"),
        F.min_by("_wall", ranked).alias("wt_mm"),
    )


def features_from_cells(cells: DataFrame) -> DataFrame:
    """The whole reading: joints attributed, bad rows out, clusters and coordinates settled."""
    features = kept(to_features(resolve_rows(attribute_joints(cells))))
    clustered = assign_clusters(features)
    return fix_coordinates(clustered, coordinate_verdicts(features))


def dent_inventory(cells: DataFrame) -> DataFrame:
    """Dents, read again without the dent entries of the skip list."""
    rows = to_features(resolve_rows(attribute_joints(reclassify_for_dents(cells))))
    return rows.where(F.col("feature_identification").isin(*vocab.DENT_CODES))
