"""Queries of file layouts, vendor profiles, unit conversions and report texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.ctes import cte, r, sql
from checks.engine import rd
from girthline import vocab
from girthline.functions import text
from girthline.operators import documents as D, layout as L
from girthline.session import shared_folder
from girthline.sources import delimited as S, profiles as V
from girthline.sources.tables import base, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn
    return add


# Headers of three vendors with the field, profile unit key and unit, and hint each column should get.
# (vendor, column, header, field or None, unit key or None, unit or None, hint)
HEADERS = (
    (0, 0, "Anomaly ID", "anomaly_id", None, None, ""),
    (0, 1, "Absolute Distance, m", "abs_distance_m", "chainage", "m", "metres"),
    (0, 2, "Joint Number", "joint_number", None, None, ""),
    (0, 3, "Distance to U/S GW, m", "upstream_weld_dist_m", "upstream_weld_dist", "m", "metres"),
    (0, 4, "WT, mm", "wt_mm", "wall_thickness", "mm", "mm"),
    (0, 5, "Depth, %WT", "depth_pct_wt", "depth", "%", "% WT"),
    (0, 6, "Length, mm", "length_mm", "length", "mm", "mm"),
    (0, 7, "Width, mm", "width_mm", "width", "mm", "mm"),
    (0, 8, "Surface", "surface", None, None, ""),
    (0, 9, "POF Acronym", "feature_identification", None, None, ""),
    (0, 10, "Orientation, h:min", "clock_position", "clock", "hh:mm", "hh:mm"),
    (0, 11, "Remark", None, None, None, ""),
    (0, 12, "", None, None, None, ""),
    (1, 0, "Feature ID", "feature_identification", None, None, ""),
    (1, 1, "Log Dist. [m]", "abs_distance_m", "chainage", "m", "metres"),
    (1, 2, "J.No.", "joint_number", None, None, ""),
    (1, 3, "Wall Thickness [mm]", "wt_mm", "wall_thickness", "mm", "mm"),
    (1, 4, "Depth [mm]", None, None, None, "mm"),
    (1, 5, "Length [mm]", "length_mm", "length", "mm", "mm"),
    (1, 6, "Width [mm]", "width_mm", "width", "mm", "mm"),
    (1, 7, "Surf. Loc.", "surface", None, None, ""),
    (1, 8, "Type", "feature_type", None, None, ""),
    (1, 9, "O'clock", "clock_position", "clock", "hh:mm", "hh:mm"),
    (1, 10, "Remark", None, None, None, ""),
    (1, 11, "Remark", None, None, None, ""),
    (2, 0, "ID", "anomaly_id", None, None, ""),
    (2, 1, "Chainage [km]", None, None, None, "chainage in km"),
    (2, 2, "Pipe No", "joint_number", None, None, ""),
    (2, 3, "t, mm", "wt_mm", "wall_thickness", "mm", "mm"),
    (2, 4, "Depth %", "depth_pct_wt", "depth", "%", ""),
    (2, 5, "Axial length, mm", "length_mm", "length", "mm", "mm"),
    (2, 6, "Width (in)", None, None, None, ""),
    (2, 7, "Side", "surface", None, None, ""),
    (2, 8, "Comments", "feature_identification", None, None, ""),
    (2, 9, "Clock [deg]", None, None, None, "degrees"),
    (2, 10, "Location", "surface", None, None, ""),
    (2, 11, "Length", "length_mm", None, None, ""),
    (9, 0, "Joint Number", "joint_number", None, None, ""),
    (9, 1, "Distance", None, None, None, "?"),
    (9, 2, "Pipe Length, m", "joint_length_m", None, None, "metres"),
    (9, 3, "WT, mm", "wt_mm", None, None, "mm"),
    (9, 4, "Depth", "depth_pct_wt", None, None, ""),
)
SHEETS = ("Defects", "Metal Loss List", "Anomaly tally")
HEADER_ROWS = (2, 1, 3)


def _q(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


cte("hd", "", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_q(v) for v in row) + ")" for row in HEADERS)
    + ") AS t(vendor, col_idx, header, field, unit_key, unit, hint)")
cte("files", "", """
SELECT s_suppkey AS k, 'line_' || s_suppkey AS file, s_suppkey % 3 AS vendor,
  CASE s_suppkey % 3 WHEN 0 THEN 'Defects' WHEN 1 THEN 'Metal Loss List' ELSE 'Anomaly tally' END AS sheet,
  CASE s_suppkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 3 END AS header_row FROM supplier""")
cte("heads", "files hd", "SELECT f.file, f.sheet, f.header_row, f.k, h.* FROM files f JOIN hd h ON h.vendor = f.vendor")
cte("rowsof", "base files", "SELECT f.file, f.k, 10 + b.ok * 10 + b.ln AS row_idx, b.ok FROM base b JOIN files f ON f.k = b.sk")


def cells(spark, sf):
    """Cells of one workbook per supplier; its rows are the supplier's line items."""
    heads = spark.createDataFrame([(v, c, h) for v, c, h, *_ in HEADERS], "vendor int, col_idx int, value string")
    k = F.col("k")
    files = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("line_"), F.col("s_suppkey").cast("string")).alias("file"))
    vendor = (k % 3).cast("int")
    sheet = F.get(F.array(*[F.lit(s) for s in SHEETS]), vendor)
    main = files.select("file", sheet.alias("sheet"), vendor.alias("vendor"), F.get(F.array(*[F.lit(x) for x in HEADER_ROWS]), vendor).alias("row_idx"))
    registry = files.select("file", F.lit("Pipe Tally").alias("sheet"), F.lit(9).alias("vendor"), F.lit(0).alias("row_idx"))
    headers = main.unionByName(registry).join(F.broadcast(heads), "vendor").drop("vendor")  # a few dozen header texts
    titles = files.select("file", F.explode(F.array(sheet, F.lit("Summary"))).alias("sheet"), F.lit(0).alias("row_idx"), F.lit(0).alias("col_idx"), F.lit("Inspection report").alias("value"))
    data = base(spark, sf).join(files, F.col("sk") == k)
    row = (10 + F.col("ok") * 10 + F.col("ln")).cast("int").alias("row_idx")
    number = (F.when(k % 2 == 0, 0).otherwise(600) + F.col("ok") % 150).cast("string")
    body = data.select("file", sheet.alias("sheet"), row, F.lit(1).alias("col_idx"), F.col("ok").cast("string").alias("value"))
    pipes = data.select("file", F.lit("Pipe Tally").alias("sheet"), row, F.lit(1).alias("col_idx"), number.alias("value"))
    return headers.unionByName(titles).unionByName(body).unionByName(pipes)


def picked(spark, sf):
    found = cells(spark, sf)
    index = L.synonym_index(L.synonym_rows(spark))
    return found, index, L.pick_defect_sheet(L.header_rows(found, index))


@query("header_rows", sql("files hd", """
SELECT file, sheet, CAST(header_row AS INTEGER) AS header_row, (SELECT count(DISTINCT field) FROM hd WHERE hd.vendor = files.vendor) AS hits FROM files
UNION ALL SELECT file, 'Pipe Tally', 0, 4 FROM files UNION ALL SELECT file, 'Summary', 0, 0 FROM files"""))
def _(spark, sf):
    rows = L.header_rows(cells(spark, sf), L.synonym_index(L.synonym_rows(spark)))
    return rows.select("file", "sheet", "header_row", "hits")


@query("defect_sheet_for_reader", sql("files", "SELECT file, sheet, CAST(header_row AS INTEGER) AS header_row FROM files"))
def _(spark, sf):
    return picked(spark, sf)[2].select("file", "sheet", "header_row")


@query("defect_sheet_for_profile", sql("files", """
SELECT file, sheet, CAST(header_row AS INTEGER) AS header_row, CASE vendor WHEN 0 THEN 11 WHEN 1 THEN 9 ELSE 7 END AS hits FROM files"""))
def _(spark, sf):
    synonyms = L.synonym_rows(spark, vocab.PROFILE_FIELDS)
    return L.pick_profile_sheet(L.header_rows(cells(spark, sf), synonyms, text.norm_plain(F.col("value")))).select("file", "sheet", "header_row", "hits")


@query("defect_sheet_by_name", sql("files", "SELECT file, sheet FROM files"))
def _(spark, sf):
    return L.pick_by_name(L.header_rows(cells(spark, sf), L.synonym_index(L.synonym_rows(spark))))


@query("registry_sheet_by_name", sql("files", "SELECT file, 'Pipe Tally' AS sheet FROM files"))
def _(spark, sf):
    found, _, chosen = picked(spark, sf)
    sheets = found.select("file", "sheet").distinct().withColumn("sheet_ord", F.length("sheet"))
    return L.pick_registry_sheet(sheets, chosen)


@query("header_index", "SELECT key, canonical FROM (VALUES " + ", ".join(
    f"({_q(key)}, {_q(next(f for f in vocab.ALL_FIELDS if key in vocab.HEADER_SYNONYMS.get(f, ())))})"
    for key in sorted({k for keys in vocab.HEADER_SYNONYMS.values() for k in keys})
) + ") AS t(key, canonical) WHERE EXISTS (SELECT 1 FROM supplier)")
def _(spark, sf):
    # The vocabulary as used on the headers of the files: every key is looked up among their cells' keys.
    used = cells(spark, sf).select(text.norm(F.col("value")).alias("key")).distinct()
    index = L.synonym_index(L.synonym_rows(spark))
    return index.join(used, "key", "left").select("key", "canonical")


@query("column_map", sql("heads", """
SELECT file, field AS canonical, CAST(min(col_idx) AS INTEGER) AS col_idx FROM heads WHERE field IS NOT NULL GROUP BY 1, 2"""))
def _(spark, sf):
    found, index, chosen = picked(spark, sf)
    return L.column_map(found, chosen, index).select("file", "canonical", "col_idx")


@query("missing_required_columns", sql("files", """
SELECT file, unnest(CASE vendor WHEN 1 THEN ['depth_pct_wt'] WHEN 2 THEN ['abs_distance_m', 'width_mm'] ELSE [] END) AS canonical FROM files"""))
def _(spark, sf):
    found, index, chosen = picked(spark, sf)
    return L.missing_required(L.column_map(found, chosen, index), chosen)


def proposed(spark, sf):
    synonyms = L.synonym_rows(spark, vocab.PROFILE_FIELDS)
    found = cells(spark, sf)
    chosen = L.pick_profile_sheet(L.header_rows(found, synonyms, text.norm_plain(F.col("value"))))
    return found, chosen, L.propose_mapping(found, chosen, synonyms)


@query("proposed_mapping", sql("heads", """
SELECT file, field AS canonical, arg_min(header, col_idx) AS header, 1.0 AS confidence FROM (
  SELECT * FROM heads WHERE field IS NOT NULL AND field <> 'feature_type'
  UNION ALL SELECT * REPLACE ('anomaly_id' AS field) FROM heads WHERE header = 'Feature ID') GROUP BY 1, 2"""))
def _(spark, sf):
    return proposed(spark, sf)[2].select("file", "canonical", "header", "confidence")


@query("unmapped_headers", sql("heads", """
SELECT file, header FROM heads WHERE header <> '' AND (field IS NULL OR header IN ('Type', 'Location', 'Length'))"""))
def _(spark, sf):
    return L.unmapped_headers(*proposed(spark, sf)).select("file", "header")


@query("unit_guesses", sql("heads", "SELECT file, unit_key, unit FROM heads WHERE unit_key IS NOT NULL"))
def _(spark, sf):
    return L.unit_guesses(proposed(spark, sf)[2]).select("file", "unit_key", "unit")


@query("unit_hints", sql("heads files hd rowsof", """
, firsts AS (SELECT file, ok, row_number() OVER (PARTITION BY file ORDER BY row_idx) AS rn, k FROM rowsof),
rng AS (SELECT file, count(*) AS n, max(CASE WHEN k % 2 = 0 THEN 0 ELSE 600 END + ok % 150) AS mx FROM firsts GROUP BY 1)
SELECT file, sheet, CAST(col_idx AS INTEGER) AS col_idx, hint FROM heads
UNION ALL SELECT f.file, 'Pipe Tally', CAST(h.col_idx AS INTEGER), CASE WHEN h.hint <> '?' THEN h.hint WHEN g.n >= 3 AND g.mx < 200 THEN 'likely km'
  WHEN g.n >= 3 AND g.mx > 500 THEN 'likely m' ELSE '' END FROM files f JOIN hd h ON h.vendor = 9 LEFT JOIN rng g ON g.file = f.file""").replace("f.k = b.sk)\n\n, firsts", "f.k = b.sk),\nfirsts"))
def _(spark, sf):
    found = cells(spark, sf)
    chosen = L.header_rows(found, L.synonym_index(L.synonym_rows(spark))).where("hits >= 4")
    columns = L._header_cells(found, chosen).select("file", "sheet", "col_idx", F.col("value").alias("header"))
    below = found.join(chosen.select("file", "sheet", "header_row"), ["file", "sheet"]).where("row_idx > header_row")
    return L.unit_hints(columns, below.drop("header_row")).drop("header")


@query("unique_column_names", sql("heads", """
SELECT file, CAST(col_idx AS INTEGER) AS col_idx, CASE WHEN header = '' THEN 'col_' || col_idx
  WHEN vendor = 1 AND col_idx = 11 THEN 'Remark__2' ELSE header END AS name FROM heads"""))
def _(spark, sf):
    found, _, chosen = picked(spark, sf)
    headers = L._header_cells(found, chosen).select("file", "sheet", "col_idx", F.col("value").alias("header"))
    return L.unique_names(headers).select("file", "col_idx", "name")


_SIDES = ("Int", "E", "external wall", "mid", "exterior", "X", "Internal", "in")
_SUGGESTED = ("internal", "external", "external", "midwall", "external", None, "internal", "internal")


@query("suggested_values", "SELECT DISTINCT CASE l_suppkey % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SIDES)) + " END AS source, CASE l_suppkey % 8 "
       + " ".join(f"WHEN {i} THEN {_q(s)}" for i, s in enumerate(_SUGGESTED)) + " END AS suggestion FROM lineitem")
def _(spark, sf):
    source = F.array(*[F.lit(s) for s in _SIDES])[(F.col("l_suppkey") % 8).cast("int")]
    rows = table(spark, sf, "lineitem").select(source.alias("source")).distinct()
    return rows.withColumn("suggestion", L.suggest_value(F.col("source"), ("internal", "external", "midwall", "unknown")))


# --- files -----------------------------------------------------------------------------------------------------

def vendor_table(spark, sf):
    """A vendor's table as text: distances with thousands separators, inches, millimetre depths, degrees."""
    ok, ln, pk, sk = (F.col(c) for c in ("ok", "ln", "pk", "sk"))
    metres = (ok % 750 * 12 + ln).cast("string")
    return base(spark, sf).select(
        F.lit("file").alias("file"), (ok * 10 + ln).alias("source_row"), ok.alias("ok"),
        F.when(ok % 750 * 12 + ln >= 1000, F.concat(F.floor((ok % 750 * 12 + ln) / 1000).cast("string"), F.lit(","),
               F.lpad(((ok % 750 * 12 + ln) % 1000).cast("string"), 3, "0"), F.lit(".5"))).otherwise(F.concat(metres, F.lit(".5"))).alias("Dist (ft)"),
        (ok % 750).cast("string").alias("Joint"),
        F.concat(F.lit("0,"), F.lpad((pk % 90 + 250).cast("string"), 3, "0")).alias("Wall (in)"),
        F.when(pk % 31 == 0, "?").otherwise(F.concat((ln % 3).cast("string"), F.lit("."), (sk % 10).cast("string"))).alias("Depth (mm)"),
        F.concat((pk % 40).cast("string"), F.lit("%")).alias("Length (cm)"),
        F.lit(" 12 ").alias("Width (mm)"), (pk % 360).cast("string").alias("Angle"),
        F.when(F.col("rf") == "A", "I/S").when(F.col("rf") == "R", "O.S.").otherwise("none").alias("Side"),
    )


PROFILE = {
    "abs_distance_m": "Dist (ft)", "joint_number": "Joint", "wt_mm": "Wall (in)", "depth_mm": "Depth (mm)", "length_mm": "Length (cm)",
    "width_mm": "Width (mm)", "clock_orientation": "Angle", "surface": "Side",
}
UNITS = {"chainage": "ft", "wall_thickness": "in", "length": "cm", "clock": "degrees"}
VALUES = {"surface": {"i-s": "internal", "o s": "external"}}
_TABLE = f"""
SELECT ok * 10 + ln AS source_row, 'A-' || lpad(CAST(row_number() OVER (ORDER BY ok * 10 + ln) AS VARCHAR), 6, '0') AS "Anomaly ID",
  {r('((ok % 750) * 12 + ln + 0.5) * 0.3048')} AS "Absolute Distance, m", CAST(ok % 750 AS VARCHAR) AS "Joint Number",
  {r('(pk % 90 + 250) / 1000.0 * 25.4')} AS "WT, mm",
  {r("CASE WHEN pk % 31 <> 0 THEN CAST(CAST(ln % 3 AS VARCHAR) || '.' || CAST(sk % 10 AS VARCHAR) AS DOUBLE) / ((pk % 90 + 250) / 1000.0 * 25.4) * 100.0 END")} AS "Depth, %WT",
  {r('(pk % 40) * 10.0')} AS "Length, mm", 12.0 AS "Width, mm",
  lpad(CAST((pk % 360 * 2 // 60) % 12 AS VARCHAR), 2, '0') || ':' || lpad(CAST(pk % 360 * 2 % 60 AS VARCHAR), 2, '0') AS "Clock Position",
  CASE rf WHEN 'A' THEN 'internal' WHEN 'R' THEN 'external' ELSE 'none' END AS "Surface" FROM base"""


@query("converted_defects", sql("base", _TABLE))
def _(spark, sf):
    rows = V.apply_profile(vendor_table(spark, sf), PROFILE, UNITS, VALUES)
    return rows.select("source_row", "Anomaly ID", rd("Absolute Distance, m"), "Joint Number", rd("WT, mm"), rd("Depth, %WT"),
                       rd("Length, mm"), rd("Width, mm"), "Clock Position", "Surface")


@query("converted_registry", sql("base", f"""
SELECT ok * 10 + ln AS source_row, {r('((ok % 750) * 12 + ln + 0.5) * 0.3048')} AS "Absolute Distance, m", CAST(ok % 750 AS VARCHAR) AS "Joint Number",
  12.0 * 0.001 AS "Joint Length, m", CASE WHEN ln = 1 THEN 'Weld' ELSE 'Pipe' END AS "Feature Type" FROM base"""))
def _(spark, sf):
    rows = vendor_table(spark, sf).withColumn("Feature_Type", F.when(F.col("source_row") % 10 == 1, "Weld").otherwise("Pipe"))
    out = V.apply_registry_profile(
        rows, {"abs_distance_m": "Dist (ft)", "joint_number": "Joint", "joint_length_m": "Width (mm)"}, {"chainage": "ft", "joint_length": "mm"}
    )
    return out.select("source_row", rd("Absolute Distance, m"), "Joint Number", "Joint Length, m", "Feature Type")


@query("converted_units", sql("base", f"""
SELECT ok * 10 + ln AS source_row, {r('(ok % 750) * 1000.0')} AS km, {r('(ok % 750) * 0.3048')} AS ft, {r('(ok % 750) / 100.0 * 100.0')} AS fraction,
  {r('ln * 1000.0')} AS wall_m, {r('ln * 25.4')} AS wall_in, {r('ln * 10.0')} AS size_cm, {r('ln * 0.3048')} AS alt_ft, {r('ln * 1000.0')} AS alt_km
FROM base"""))
def _(spark, sf):
    from girthline.functions import units as U

    rows = base(spark, sf).withColumns({"a": (F.col("ok") % 750).cast("string"), "b": F.col("ln").cast("string")})
    a, b = F.col("a"), F.col("b")
    hundredth = F.concat(F.floor(F.col("ok") % 750 / 100).cast("string"), F.lit("."), F.lpad((F.col("ok") % 750 % 100).cast("string"), 2, "0"))
    out = rows.select(
        (F.col("ok") * 10 + F.col("ln")).alias("source_row"), U.chainage_to_m(a, "km").alias("km"), U.chainage_to_m(a, "feet").alias("ft"),
        U.depth_to_pct(hundredth, "fraction", F.lit(None).cast("double")).alias("fraction"), U.scaled(b, "m", vocab.WALL_FACTORS).alias("wall_m"),
        U.scaled(b, "in", vocab.WALL_FACTORS).alias("wall_in"), U.scaled(b, "cm", vocab.SIZE_FACTORS).alias("size_cm"),
        U.scaled(b, "ft", vocab.ALTITUDE_FACTORS).alias("alt_ft"), U.scaled(b, "km", vocab.ALTITUDE_FACTORS).alias("alt_km"),
    )
    return out.select("source_row", *[rd(c) for c in out.columns if c != "source_row"])


@query("delimited_files_read", sql("base", """
SELECT 'naïve' AS word, ok * 10 + ln AS source_row, ok % 750 AS joint FROM base WHERE ok % 2 = 0
UNION ALL SELECT 'naïve', ok * 10 + ln, ok % 750 FROM base WHERE ok % 2 = 1"""))
def _(spark, sf):
    folder = shared_folder(spark)
    rows = base(spark, sf).select(F.lit("naïve").alias("word"), (F.col("ok") * 10 + F.col("ln")).alias("source_row"), (F.col("ok") % 750).alias("joint"), "ok")
    rows.where("ok % 2 = 0").drop("ok").write.option("encoding", "UTF-8").csv(f"{folder}/utf8")
    rows.where("ok % 2 = 1").drop("ok").write.option("encoding", "ISO-8859-1").csv(f"{folder}/latin")
    read = S.read_rows(spark, [f"{folder}/utf8/*.csv", f"{folder}/latin/*.csv"], 4)
    flat = S.drop_empty(read.select("file", "row_idx", *[F.col("values")[i].alias(f"c{i}") for i in range(4)]), [f"c{i}" for i in range(4)])
    return flat.select(F.col("c0").alias("word"), F.col("c1").cast("long").alias("source_row"), F.col("c2").cast("long").alias("joint"))


@query("file_encodings", "SELECT 'ISO-8859-1' AS encoding UNION ALL SELECT 'UTF-16LE' UNION ALL SELECT 'UTF-8' WHERE EXISTS (SELECT 1 FROM supplier)")
def _(spark, sf):
    folder = shared_folder(spark)
    rows = table(spark, sf, "supplier").select(F.concat(F.lit("é"), F.col("s_name")).alias("value"))
    rows.write.text(f"{folder}/a")
    rows.write.option("encoding", "ISO-8859-1").csv(f"{folder}/b")
    rows.withColumn("value", F.concat(F.lit("﻿"), "value")).write.option("encoding", "UTF-16LE").csv(f"{folder}/c")
    return S.file_encodings(spark, [f"{folder}/a/*.txt", f"{folder}/b/*.csv", f"{folder}/c/*.csv"]).select("encoding").distinct()


@query("canonical_tables_written", sql("f2", "SELECT line_id, count(*) AS n, sum(source_row) AS rows FROM f2 GROUP BY 1"))
def _(spark, sf):
    from girthline.sources.tables import features

    path = shared_folder(spark)
    S.write_canonical(features(spark, sf), path)
    back = spark.read.parquet(path).where(F.col("run_id") == "run_2")
    return back.groupBy("line_id").agg(F.count(F.lit(1)).alias("n"), F.sum("source_row").alias("rows"))


@query("profile_problems", """
WITH p AS (SELECT s_suppkey AS k FROM supplier)
SELECT k AS profile_id, 'unknown_field' AS problem, 'colour' AS detail FROM p WHERE k % 7 = 0
UNION ALL SELECT k, 'missing_field', unnest(['abs_distance_m', 'joint_number', 'wt_mm', 'length_mm', 'width_mm', 'surface', 'depth_pct_wt | depth_mm']) FROM p WHERE k % 7 = 0
UNION ALL SELECT k, 'missing_field', 'wt_mm' FROM p WHERE k % 7 <> 0 AND k % 5 = 0
UNION ALL SELECT k, 'missing_field', 'depth_pct_wt | depth_mm' FROM p WHERE k % 7 <> 0 AND k % 3 = 1
UNION ALL SELECT k, 'depth_needs_wall', 'wt_mm' FROM p WHERE k % 7 <> 0 AND k % 5 = 0 AND k % 3 = 0
UNION ALL SELECT k, 'vendor_name_empty', '' FROM p WHERE k % 4 = 0
UNION ALL SELECT k, 'header_row_negative', '-1' FROM p WHERE k % 11 = 0
UNION ALL SELECT k, 'unknown_unit_key', 'colour' FROM p WHERE k % 6 = 0""")
def _(spark, sf):
    k = F.col("s_suppkey")

    def pair(field: str, when=None):
        entry = F.struct(F.lit(field).alias("key"), F.lit("x").alias("value"))
        return entry if when is None else F.when(when, entry)

    fields = [pair(f) for f in ("feature_id", "abs_distance_m", "joint_number", "length_mm", "width_mm", "surface")]
    fields += [pair("wt_mm", k % 5 != 0), pair("depth_mm", k % 3 == 0), pair("depth_pct_wt", k % 3 == 2), pair("colour", k % 7 == 0)]
    units = F.map_from_entries(F.array_compact(F.array(pair("chainage"), pair("colour", k % 6 == 0))))
    profiles = table(spark, sf, "supplier").select(
        k.alias("profile_id"), F.map_from_entries(F.array_compact(F.array(*fields))).alias("column_mappings"), units.alias("unit_conventions"),
        F.when(k % 4 == 0, " ").otherwise("vendor").alias("vendor_name"), F.when(k % 11 == 0, -1).otherwise(0).alias("header_row"),
    )
    return V.profile_problems(profiles)


# --- report texts ----------------------------------------------------------------------------------------------

def pages(spark, sf):
    k = F.col("s_suppkey")
    s = k.cast("string")
    front = F.concat(F.lit("CUSTOMER: Northern Lines Ltd.\n"), F.concat(s, F.lit('" IPS, NORTH ROAD- IP-2 (HILL), OD 406 mm, L 10 km\nEGP+MFL-A+ MFL-C +XYZ\n')),
                     F.when(k % 3 == 0, "Conducted on 18th August, 2023").when(k % 3 == 1, "Inspection Date: 15-03-2023").otherwise("Current inspection 2022"))
    data = F.concat(
        F.lit("Pipe  OD : "), (200 + k).cast("string"), F.lit(" mm\r\nPipeline Length (km) : "), (k % 90 + 10).cast("string"),
        F.lit(".4\nYear of construction of the pipeline 2001\n"), F.when(k % 2 == 0, "Wall thickness: 6.4, 7.1, 8.7 mm").otherwise("Pipe wall thickness 7.1 mm/8.7 mm/7.1 mm"),
        F.lit("\nPipeline medium during inspection  LPG\nPrevious inspections "), F.when(k % 3 == 0, "15th May 2019").when(k % 3 == 1, "May 2019").otherwise("2017"),
    )
    strength = F.concat(F.lit("API 5L X 65 steel with SMYS = "), (440 + k % 20).cast("string"), F.lit(" MPa\nMAOP = "), (k % 50 + 50).cast("string"),
                        F.lit(" kg/cm²\nDesign Factor 0.72\nPipeline Section code 22100104"))
    rows = F.array(*[F.struct(F.lit(n).alias("page_no"), t.alias("text")) for n, t in ((1, front), (6, data), (20, strength))])
    return table(spark, sf, "supplier").select(k.alias("doc_id"), F.explode(rows).alias("p")).select("doc_id", "p.*")


@query("report_metadata", """
SELECT k AS doc_id, e.field AS field, e.value AS value, e.confidence AS confidence FROM (SELECT s_suppkey AS k, unnest([
  {'field': 'client', 'value': 'Northern Lines Ltd.', 'confidence': 1.0::DOUBLE},
  {'field': 'pipeline_name', 'value': s_suppkey || '" IPS, NORTH ROAD- IP-2 (HILL)', 'confidence': 1.0},
  {'field': 'inspection_technology', 'value': 'EGP+MFL-A+MFL-C+XYZ', 'confidence': 1.0},
  {'field': 'pipeline_section_code', 'value': '22100104', 'confidence': 1.0},
  {'field': 'outer_diameter_mm', 'value': CAST(200 + s_suppkey AS VARCHAR) || '.0', 'confidence': 1.0},
  {'field': 'length_km', 'value': CAST(s_suppkey % 90 + 10 AS VARCHAR) || '.4', 'confidence': 1.0},
  {'field': 'installation_year', 'value': '2001.0', 'confidence': 1.0},
  {'field': 'wall_thicknesses_mm', 'value': CASE WHEN s_suppkey % 2 = 0 THEN '6.4, 7.1, 8.7' ELSE '7.1, 8.7' END, 'confidence': 1.0},
  {'field': 'product', 'value': 'LPG', 'confidence': 1.0}, {'field': 'service_class', 'value': 'liquid', 'confidence': 1.0},
  {'field': 'material_grade', 'value': 'API 5L X65', 'confidence': 1.0},
  {'field': 'smys_mpa', 'value': CAST(440 + s_suppkey % 20 AS VARCHAR) || '.0', 'confidence': 1.0},
  {'field': 'maop_kgcm2', 'value': CAST(s_suppkey % 50 + 50 AS VARCHAR) || '.0', 'confidence': 1.0},
  {'field': 'design_factor', 'value': '0.72', 'confidence': 1.0},
  {'field': 'run2_inspection_date', 'value': CASE s_suppkey % 3 WHEN 0 THEN '2023-08-18' WHEN 1 THEN '2023-03-15' ELSE '2022-01-01' END,
   'confidence': CASE s_suppkey % 3 WHEN 2 THEN 0.5 ELSE 1.0 END},
  {'field': 'run2_inspection_year', 'value': CASE s_suppkey % 3 WHEN 2 THEN '2022' ELSE '2023' END, 'confidence': 0.5},
  {'field': 'run1_inspection_date', 'value': CASE s_suppkey % 3 WHEN 2 THEN '2017-07-01' ELSE '2019-05-15' END,
   'confidence': CASE s_suppkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.5 END},
  {'field': 'run1_inspection_year', 'value': CASE s_suppkey % 3 WHEN 2 THEN '2017' ELSE '2019' END, 'confidence': 0.5},
  {'field': 'project_name', 'value': 'FFP_North_Road_IP-2_' || CAST(round_even((200 + s_suppkey) / 25.4::DOUBLE, 0) AS INTEGER) || 'in', 'confidence': 0.3}
]) AS e FROM supplier)""")
def _(spark, sf):
    return D.report_metadata(pages(spark, sf))


@query("report_notes", """
SELECT s_suppkey AS doc_id, 'outer_diameter_mm' AS field, 'conflicting_values' AS note, CAST(200 + s_suppkey AS VARCHAR) || '.0' AS kept, '406.0' AS others
FROM supplier WHERE s_suppkey <> 206""")
def _(spark, sf):
    return D.report_notes(pages(spark, sf))


@query("report_dates", sql("", """
SELECT event_id, d AS date FROM (SELECT event_id, DATE '2015-01-01' + CAST(event_id % 3000 AS INTEGER) AS d FROM events)"""))
def _(spark, sf):
    d = F.date_add(F.lit("2015-01-01").cast("date"), (F.col("event_id") % 3000).cast("int"))
    formats = ("d MMMM, yyyy", "d MMM yyyy", "MMMM d yyyy", "MMM d, yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "d/M/yyyy", "dd-MMM-yyyy", "d-MMMM-yyyy", "dd.MM.yyyy", "yyyy.M.d")
    shown = F.element_at(F.array(*[F.date_format(d, f) for f in formats]), (F.col("event_id") % 11 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", text.parse_date(shown).alias("date"))


@query("project_tags", """
SELECT c_custkey, 'FFP_' || CASE c_custkey % 3 WHEN 0 THEN 'North_Road_IP-2' WHEN 1 THEN 'East_' || c_custkey || '_Line' ELSE 'X65_Abu' END
  || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '_' || CAST(round_even((c_custkey % 900 + 50) / 25.4::DOUBLE, 0) AS INTEGER) || 'in' END AS tag FROM customer""")
def _(spark, sf):
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, '16" IPS, NORTH ROAD- IP-2 (HILL)').when(k % 3 == 1, F.concat(F.lit("EAST "), k.cast("string"), F.lit(" Line, OD 400"))).otherwise("X65 Abu Pipeline")
    od = F.when(k % 5 == 0, 0.0).otherwise(k % 900 + 50.0)
    return table(spark, sf, "customer").select("c_custkey", text.project_slug(name, od).alias("tag"))


@query("normalised_texts", """
SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' - ' || p_type || ', ' || p_size || ' m2'), '[\\s_\\-/.,()\\[\\]{}]+', ' ', 'g')) AS key FROM part""")
def _(spark, sf):
    raw = F.concat("p_brand", F.lit(" - "), "p_type", F.lit(", "), F.col("p_size").cast("string"), F.lit(" m²"))
    return table(spark, sf, "part").select("p_partkey", text.norm(raw).alias("key"))
