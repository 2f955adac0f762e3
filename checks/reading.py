"""Queries of reading: cells, row classes, joint context, clusters, coordinates, registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.ctes import cte, r, sql
from checks.engine import rd
from girthline.operators import ingest as N
from girthline.sources.raw import raw_rows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn
    return add


def _list(texts) -> str:
    return "(" + ", ".join(f"'{t}'" for t in texts) + ")"


_T = "CAST({n} // 10 AS VARCHAR) || '.' || CAST({n} % 10 AS VARCHAR)"


def tenths(n: str) -> str:
    return _T.format(n=f"({n})")


_WALL = "CASE ok % 3 WHEN 0 THEN '6.4' WHEN 1 THEN '7.1' ELSE '8.7' END"
_JOINT = f"""ok // 750 AS line, {tenths('(ok % 750) * 120')} AS abs_distance_m, CAST((ok % 750) * 10 + 40 AS VARCHAR) AS joint_number,
  {_WALL} AS wt_mm, CAST((11500 + (ok * 7919) % 1000) // 1000 AS VARCHAR) || '.' || lpad(CAST((11500 + (ok * 7919) % 1000) % 1000 AS VARCHAR), 3, '0')
  AS joint_length_m"""

cte("raw", "base", f"""
WITH b AS (SELECT *, ok // 750 AS line, CAST(q * 16 AS BIGINT) AS n16, CAST(floor(ep * 100 / 180) AS BIGINT) AS mm100,
  CAST(20 + (ok // 750) % 10 AS VARCHAR) || '.' || lpad(CAST(ok % 1000 AS VARCHAR), 3, '0') AS north,
  CAST(CASE WHEN (ok // 750) % 5 = 4 THEN 120 ELSE 70 END + (ok // 750) % 10 AS VARCHAR) || '.' || lpad(CAST((ok * 7) % 1000 AS VARCHAR), 3, '0') AS east
  FROM base)
SELECT line, 0 AS sheet_ord, ok * 10 + ln + CASE WHEN line % 4 = 3 THEN 10000000 ELSE 0 END AS source_row,
  {tenths('(ok % 750) * 120 + ln * 15')} AS abs_distance_m,
  CASE WHEN ok % 10 = 3 THEN CAST((ok % 750) * 10 + 40 AS VARCHAR) END AS joint_number,
  CASE WHEN pk % 107 = 0 THEN '' WHEN pk % 103 = 0 THEN '120' WHEN ok % 3 = 0 THEN {tenths('n16')} || '%'
    WHEN ok % 5 = 1 THEN '0.' || lpad(CAST(n16 AS VARCHAR), 3, '0') ELSE {tenths('n16')} END AS depth,
  CAST(mm100 // 100 AS VARCHAR) || CASE WHEN ok % 5 = 0 THEN ',' ELSE '.' END || lpad(CAST(mm100 % 100 AS VARCHAR), 2, '0') AS length_mm,
  CAST(5 + (sk * 13) % 300 AS VARCHAR) AS width_mm, CASE rf WHEN 'A' THEN 'I' WHEN 'R' THEN 'Ext.' ELSE '' END AS surface,
  CASE WHEN pk % 109 = 0 THEN '-1' ELSE {_WALL} END AS wt_mm,
  CASE WHEN pk % 101 = 0 THEN '13:75' WHEN ok % 2 = 0 THEN lpad(CAST((pk % 720) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((pk % 720) % 60 AS VARCHAR), 2, '0')
    ELSE {tenths('(pk % 720) * 5')} END AS clock_position,
  CASE WHEN pk % 89 = 0 THEN NULL WHEN pk % 97 = 0 THEN '' WHEN sk % 19 = 0 THEN 'Metal Loss' ELSE 'Anomaly' END AS feature_type,
  CASE WHEN pk % 89 = 0 THEN NULL WHEN pk % 97 = 0 THEN 'weld blister' WHEN sk % 20 = 0 THEN CASE WHEN ln % 2 = 0 THEN 'DENP' ELSE 'Dent' END
    WHEN sk % 20 = 1 THEN 'Crack' WHEN sk % 20 = 2 THEN 'Corrosion Cluster' WHEN sk % 20 = 3 THEN 'strange mark' ELSE 'Corrosion' END AS fid_text,
  CASE pk % 8 WHEN 0 THEN 'CIGR' WHEN 1 THEN 'CISL' WHEN 2 THEN 'AXGR' WHEN 3 THEN 'AXSL' WHEN 4 THEN 'PITT' WHEN 5 THEN 'PINH'
    WHEN 6 THEN 'GENE' ELSE 'UNDEFINED' END AS dim,
  CASE WHEN ln >= 5 THEN 'metal loss (grouped)' WHEN pk % 50 = 0 THEN 'circumferential groove' ELSE 'metal loss' END AS description,
  CASE WHEN pk % 83 <> 0 THEN 'F' || ok || '-' || ln END AS anomaly_id,
  CASE WHEN line % 5 = 2 THEN east ELSE north END AS latitude, CASE WHEN line % 5 = 2 THEN north ELSE east END AS longitude,
  {tenths('ln * 15')} AS upstream_weld_dist_m, NULL AS joint_length_m FROM b
UNION ALL BY NAME SELECT 0 AS sheet_ord, ok * 10 AS source_row, 'Girth Weld' AS feature_type, {_JOINT} FROM (SELECT o_orderkey AS ok FROM orders)
UNION ALL BY NAME SELECT 0 AS sheet_ord, ok * 10 + 9 AS source_row, ok // 750 AS line FROM (SELECT o_orderkey AS ok FROM orders) WHERE ok % 750 = 749
UNION ALL BY NAME SELECT 1 AS sheet_ord, ok AS source_row, {_JOINT} FROM (SELECT o_orderkey AS ok FROM orders) WHERE ok % 2 = 0""")

# Numbers and codes. The generated texts only use the forms listed here.
cte("cells", "raw", """
SELECT *, TRY_CAST(abs_distance_m AS DOUBLE) AS abs_m, TRY_CAST(joint_number AS INTEGER) AS jno, TRY_CAST(wt_mm AS DOUBLE) AS wall_mm,
  TRY_CAST(replace(length_mm, ',', '.') AS DOUBLE) AS len_mm, TRY_CAST(width_mm AS DOUBLE) AS wid_mm,
  TRY_CAST(upstream_weld_dist_m AS DOUBLE) AS uw_m, TRY_CAST(joint_length_m AS DOUBLE) AS jlen_m,
  TRY_CAST(latitude AS DOUBLE) AS lat, TRY_CAST(longitude AS DOUBLE) AS lon,
  CASE fid_text WHEN 'DENP' THEN 'DENT' WHEN 'Dent' THEN 'DENT' WHEN 'Crack' THEN 'CRAC' WHEN 'Corrosion Cluster' THEN 'COCL'
    WHEN 'Corrosion' THEN 'CORR' ELSE 'UNDEFINED' END AS fid,
  CASE surface WHEN 'I' THEN 'internal' WHEN 'Ext.' THEN 'external' ELSE 'unknown' END AS side,
  abs_distance_m IS NULL AS blank,
  CASE WHEN depth = '' OR depth IS NULL THEN NULL WHEN depth = '120' THEN -1.0 WHEN ends_with(depth, '%') THEN CAST(replace(depth, '%', '') AS DOUBLE)
    WHEN starts_with(depth, '0.') AND fid_text NOT IN ('DENP', 'Dent') THEN CAST(depth AS DOUBLE) * 100.0
    WHEN starts_with(depth, '0.') AND fid_text IS NULL THEN CAST(depth AS DOUBLE) * 100.0 ELSE CAST(depth AS DOUBLE) END AS dp,
  CASE WHEN clock_position = '13:75' THEN -1.0 WHEN contains(clock_position, ':') THEN
      fmod(CAST(split_part(clock_position, ':', 1) AS DOUBLE) + CAST(split_part(clock_position, ':', 2) AS DOUBLE) / 60.0, 12.0)
    -- a number with one or two digits before the point and one or two after reads as hours and minutes
    WHEN regexp_full_match(clock_position, '\\d{1,2}\\.\\d{1,2}') THEN
      CASE WHEN CAST(split_part(clock_position, '.', 1) AS INTEGER) <= 12 THEN
        fmod(CAST(split_part(clock_position, '.', 1) AS DOUBLE) + CAST(split_part(clock_position, '.', 2) AS DOUBLE) / 60.0, 12.0) ELSE -1.0 END
    WHEN CAST(clock_position AS DOUBLE) <= 12 THEN fmod(CAST(clock_position AS DOUBLE), 12.0)
    ELSE fmod(CAST(clock_position AS DOUBLE) / 30.0, 12.0) END AS ch
FROM raw""")

cte("classed", "cells", """
SELECT *, CASE WHEN blank THEN 'blank_row' WHEN feature_type = 'Girth Weld' THEN 'skip_list:Girth Weld'
  WHEN fid_text = 'Dent' THEN 'skip_list:Dent' WHEN feature_type IN ('Anomaly', 'Metal Loss') THEN NULL
  WHEN fid_text IN ('Corrosion', 'Corrosion Cluster', 'Crack', 'DENP') THEN NULL
  WHEN fid_text IS NULL AND coalesce(feature_type, '') = '' THEN CASE WHEN coalesce(depth, '') = '' THEN 'no_type_no_depth' END
  ELSE 'unrecognised_type:' || fid_text END AS drop_reason FROM cells WHERE sheet_ord = 0""")

cte("filled", "classed", """
SELECT *, last_value(jno IGNORE NULLS) OVER (PARTITION BY line ORDER BY source_row ROWS UNBOUNDED PRECEDING) AS ctx_joint FROM classed""")

cte("monotone", "classed", """
SELECT line, NOT coalesce(bool_or(abs_m < prev - 500.0), FALSE) AS is_monotonic, count(*) FILTER (jno IS NOT NULL) AS n_anchors FROM (
  SELECT *, lag(abs_m) OVER (PARTITION BY line ORDER BY source_row) AS prev FROM classed WHERE abs_m IS NOT NULL) GROUP BY 1""")

cte("anchors", "classed", "SELECT line, abs_m AS x, max(jno) AS j FROM classed WHERE jno IS NOT NULL AND abs_m IS NOT NULL GROUP BY 1, 2")

cte("placed_rows", "filled monotone anchors", """
SELECT f.*, m.is_monotonic, CASE WHEN jno IS NOT NULL THEN jno WHEN m.is_monotonic THEN ctx_joint ELSE a.j END AS joint,
  CASE WHEN jno IS NULL AND NOT m.is_monotonic THEN abs_m - a.x ELSE uw_m END AS uw
FROM filled f JOIN monotone m USING (line) ASOF LEFT JOIN anchors a ON f.line = a.line AND f.abs_m >= a.x""")

cte("reasoned", "placed_rows", """
SELECT *, CASE WHEN drop_reason IS NOT NULL THEN drop_reason WHEN joint IS NULL THEN 'missing_joint_number'
  WHEN dp < 0 OR ch < 0 OR wall_mm <= 0 OR abs(lat) > 90 THEN 'invalid_values' WHEN dp IS NULL THEN 'no_depth' END AS reason
FROM placed_rows""")

cte("kept", "reasoned", """
SELECT *, coalesce(anomaly_id, 'row' || source_row) AS name, fid = 'COCL' AS parent FROM reasoned WHERE reason IS NULL""")

cte("clustered", "kept", """
WITH s AS (SELECT *, CASE WHEN joint IS DISTINCT FROM lag(joint) OVER (PARTITION BY line ORDER BY source_row) THEN 1 ELSE 0 END AS st FROM kept),
g AS (SELECT *, sum(st) OVER (PARTITION BY line ORDER BY source_row) AS seg FROM s),
p AS (SELECT *, last_value(CASE WHEN parent THEN name END IGNORE NULLS) OVER (PARTITION BY line, seg ORDER BY source_row ROWS UNBOUNDED PRECEDING) AS lp FROM g)
SELECT *, CASE WHEN NOT parent AND contains(description, 'grouped') THEN lp END AS cluster_parent_id FROM p""")


def cells(spark, sf):
    return N.read_cells(raw_rows(spark, sf))


@query("read_numbers", sql("cells", f"""
SELECT CAST(line AS INTEGER) AS line_id, sheet_ord, source_row, {r('abs_m')} AS abs_m, jno, {r('wall_mm')} AS wall_mm, {r('len_mm')} AS len_mm,
  {r('wid_mm')} AS wid_mm, {r('uw_m')} AS uw_m, {r('jlen_m')} AS jlen_m, {r('lat')} AS lat, {r('lon')} AS lon FROM cells"""))
def _(spark, sf):
    return cells(spark, sf).select(
        "line_id", "sheet_ord", "source_row", rd("abs_m"), "jno", rd("wall_mm"), rd("len_mm"), rd("wid_mm"), rd("uw_m"),
        rd("jlen_m"), rd("lat"), rd("lon"),
    )


@query("read_depths_and_clocks", sql("cells", f"""
SELECT source_row, {r('CASE WHEN dp >= 0 THEN dp END')} AS depth_pct, coalesce(dp < 0, FALSE) AS depth_bad,
  {r('CASE WHEN ch >= 0 THEN ch END')} AS clock_h, coalesce(ch < 0, FALSE) AS clock_bad FROM cells WHERE sheet_ord = 0"""))
def _(spark, sf):
    return cells(spark, sf).where("sheet_ord = 0").select("source_row", rd("depth_pct"), "depth_bad", rd("clock_h"), "clock_bad")


@query("read_codes", sql("cells", """
SELECT source_row, fid, coalesce(dim, 'UNDEFINED') AS dim, side, coalesce(anomaly_id, 'row' || source_row) AS name FROM cells WHERE sheet_ord = 0"""))
def _(spark, sf):
    return cells(spark, sf).where("sheet_ord = 0").select("source_row", "fid", "dim", "side", "name")


@query("blank_rows", sql("cells", "SELECT CAST(line AS INTEGER) AS line_id, source_row FROM cells WHERE blank"))
def _(spark, sf):
    return cells(spark, sf).where("blank").select("line_id", "source_row")


@query("row_classes", sql("classed", "SELECT source_row, drop_reason FROM classed"))
def _(spark, sf):
    return cells(spark, sf).where("sheet_ord = 0").select("source_row", "drop_reason")


@query("joint_forward_fill", sql("filled", "SELECT source_row, ctx_joint FROM filled"))
def _(spark, sf):
    return N.fill_joint(cells(spark, sf).where("sheet_ord = 0")).select("source_row", "ctx_joint")


@query("chainage_order", sql("monotone", "SELECT CAST(line AS INTEGER) AS line_id, is_monotonic, n_anchors FROM monotone"))
def _(spark, sf):
    return N.chainage_order(N.with_context(cells(spark, sf))).select("line_id", "is_monotonic", "n_anchors")


@query("joint_by_chainage", sql("classed anchors", f"""
SELECT c.source_row, a.j AS asof_joint, {r('c.abs_m - a.x')} AS asof_uw_m FROM classed c
ASOF LEFT JOIN anchors a ON c.line = a.line AND c.abs_m >= a.x"""))
def _(spark, sf):
    return N.lookup_joint(cells(spark, sf).where("sheet_ord = 0")).select("source_row", "asof_joint", rd("asof_uw_m"))


@query("joint_attribution", sql("placed_rows", f"""
SELECT source_row, joint, {r('uw')} AS uw FROM placed_rows WHERE NOT blank"""))
def _(spark, sf):
    rows = N.attribute_joints(cells(spark, sf)).where("NOT blank")
    return rows.select("source_row", "joint", (F.round(F.coalesce("uw_override", "uw_m"), 6) + 0.0).alias("uw"))


@query("row_rejects", sql("reasoned", "SELECT source_row, reason FROM reasoned WHERE reason IS NOT NULL"))
def _(spark, sf):
    return N.rejects(N.resolve_rows(N.attribute_joints(cells(spark, sf)))).select("source_row", "reason")


@query("row_audit", sql("reasoned", """
SELECT line_id, reason, count(*) AS n FROM (
  SELECT CAST(line AS INTEGER) AS line_id, unnest([reason, CASE WHEN coalesce(reason, 'no_depth') = 'no_depth' AND fid IN ('DENT', 'CRAC')
    THEN 'non_metal_loss_fid:' || fid END]) AS reason FROM reasoned) WHERE reason IS NOT NULL GROUP BY 1, 2"""))
def _(spark, sf):
    return N.audit(N.resolve_rows(N.attribute_joints(cells(spark, sf)))).select("line_id", "reason", "n")


@query("unmapped_vendor_texts", sql("classed", """
SELECT DISTINCT CAST(line AS INTEGER) AS line_id, fid_text AS label_text FROM classed WHERE fid_text = 'weld blister'"""))
def _(spark, sf):
    return N.unmapped_texts(cells(spark, sf)).select("line_id", "label_text")


@query("features_read", sql("clustered", f"""
SELECT source_row, name AS anomaly_id, joint AS joint_number, {r('abs_m')} AS abs_distance_m, {r('uw')} AS upstream_weld_dist_m,
  {r('dp')} AS depth_pct_wt, {r('ch')} AS clock_decimal_hours, {r('len_mm')} AS length_mm, fid AS feature_identification,
  description AS raw_description, cluster_parent_id,
  {r('CASE WHEN line % 5 = 2 THEN lon ELSE lat END')} AS latitude, {r('CASE WHEN line % 5 = 2 THEN lat ELSE lon END')} AS longitude
FROM clustered"""))
def _(spark, sf):
    return N.features_from_cells(cells(spark, sf)).select(
        "source_row", "anomaly_id", "joint_number", rd("abs_distance_m"), rd("upstream_weld_dist_m"), rd("depth_pct_wt"),
        rd("clock_decimal_hours"), rd("length_mm"), "feature_identification", "raw_description", "cluster_parent_id",
        rd("latitude"), rd("longitude"),
    )


@query("cluster_children", sql("clustered", "SELECT source_row, cluster_parent_id FROM clustered WHERE cluster_parent_id IS NOT NULL"))
def _(spark, sf):
    features = N.to_features(N.resolve_rows(N.attribute_joints(cells(spark, sf))))
    return N.assign_clusters(features).where("cluster_parent_id IS NOT NULL").select("source_row", "cluster_parent_id")


@query("metal_loss_inventory", sql("clustered", """
SELECT source_row, name AS anomaly_id FROM clustered WHERE cluster_parent_id IS NULL AND fid NOT IN ('DENT', 'CRAC')"""))
def _(spark, sf):
    from girthline.operators.inventory import assessable

    features = N.to_features(N.resolve_rows(N.attribute_joints(cells(spark, sf))))
    return assessable(N.assign_clusters(features)).select("source_row", "anomaly_id")


@query("dent_inventory", sql("placed_rows", f"""
SELECT source_row, {r('dp')} AS depth_pct_wt FROM placed_rows
WHERE fid = 'DENT' AND joint IS NOT NULL AND dp >= 0 AND ch >= 0 AND wall_mm > 0"""))
def _(spark, sf):
    return N.dent_inventory(cells(spark, sf)).select("source_row", rd("depth_pct_wt"))


@query("coordinate_verdicts", sql("kept", f"""
SELECT CAST(line AS INTEGER) AS line_id, {r('median(lat)')} AS lat_median, {r('median(lon)')} AS lon_median,
  CASE WHEN line % 5 = 2 THEN 'COORDINATES_SWAPPED' WHEN line % 5 = 4 THEN 'LAT_LON_OUT_OF_BOUNDS' END AS code FROM kept GROUP BY line"""))
def _(spark, sf):
    features = N.to_features(N.resolve_rows(N.attribute_joints(cells(spark, sf))))
    return N.coordinate_verdicts(features).select("line_id", rd("lat_median"), rd("lon_median"), "code")


@query("joint_registry", sql("filled cells", f"""
, c AS (SELECT line, 0 AS s, source_row, ctx_joint AS joint, CASE WHEN jno IS NOT NULL THEN abs_m - coalesce(uw_m, 0) END AS st,
    CASE WHEN jno IS NOT NULL THEN wall_mm END AS w, jlen_m FROM filled WHERE NOT blank AND ctx_joint IS NOT NULL
  UNION ALL SELECT line, 1, source_row, jno, abs_m, wall_mm, jlen_m FROM cells WHERE sheet_ord = 1),
w AS (SELECT line, joint, w, row_number() OVER (PARTITION BY line, joint ORDER BY count(*) DESC, min(s * 1000000000 + source_row)) AS k
  FROM c WHERE w IS NOT NULL GROUP BY 1, 2, 3)
SELECT CAST(c.line AS INTEGER) AS line_id, c.joint AS joint_number, {r('coalesce(min(st), 0.0)')} AS abs_distance_start_m,
  {r('coalesce(arg_min(jlen_m, s * 1000000000 + source_row) FILTER (jlen_m IS NOT NULL), 0.0)')} AS length_m, {r('any_value(w.w)')} AS wt_mm
FROM c LEFT JOIN w ON c.line = w.line AND c.joint = w.joint AND w.k = 1 GROUP BY 1, 2""").replace(")\n\n, c AS", "),\nc AS"))
def _(spark, sf):
    return N.joint_registry(cells(spark, sf)).select(
        "line_id", "joint_number", rd("abs_distance_start_m"), rd("length_m"), rd("wt_mm")
    )


@query("reader_findings", sql("monotone", """
SELECT CAST(line AS INTEGER) AS line_id, 'RECONSTRUCTED_JOINT_CONTEXT_FROM_CHAINAGE' AS code FROM monotone WHERE NOT is_monotonic
UNION ALL SELECT CAST(line AS INTEGER), CASE WHEN line % 5 = 2 THEN 'COORDINATES_SWAPPED' ELSE 'LAT_LON_OUT_OF_BOUNDS' END FROM monotone
WHERE line % 5 IN (2, 4)"""))
def _(spark, sf):
    rows = cells(spark, sf)
    features = N.to_features(N.resolve_rows(N.attribute_joints(rows)))
    return N.reader_codes(N.chainage_order(N.with_context(rows)), N.coordinate_verdicts(features))
