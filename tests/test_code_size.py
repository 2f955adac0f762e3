"""Steps of one row stay below the size of a method that the JVM compiles, and the rewritten ones give what the plain forms give."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from girthline import vocab
from girthline.functions import clock
from girthline.operators import ingest as N, matching as M, project as P
from girthline.session import kept
from girthline.sources import tables as T

#: HotSpot leaves larger methods to its interpreter.
COMPILED = 8000


def largest(df) -> int:
    # An adaptive plan shows its code only once it has run.
    conf, text = df.sparkSession.conf, io.StringIO()
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with contextlib.redirect_stdout(text):
            df.select("*").explain("codegen")
    finally:
        conf.set("spark.sql.adaptive.enabled", "true")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue())))


def test_reading_is_compiled(spark):
    columns = ", ".join(f"{c} string" for c in vocab.ALL_FIELDS)
    raw = kept(spark.createDataFrame([], f"line_id int, run_id string, sheet_ord int, source_row long, {columns}"))
    cells = N.read_cells(raw)
    assert largest(cells) < COMPILED
    assert largest(N.with_context(cells.drop(*vocab.ALL_FIELDS))) < COMPILED


SIDE = ("line_id int, old_joint int, island long, n_old long, n_new long, side int, source_row long, pos double, clock_decimal_hours double,"
        f" surface string, depth_pct_wt double, is_cluster_parent boolean, old {M.OLD_TYPE}")


def test_single_matches_are_compiled_and_take_the_first_pass(spark):
    def row(island, side, source_row, pos, clock_h, surface="internal"):
        old = (1.0, 20.0, 2.0, clock_h, surface, 10.0, "a") if side == 1 else None
        return (1, 7, island, 1, 1, side, source_row, pos, clock_h, surface, 20.0, False, old)

    rows = kept(spark.createDataFrame([
        row(0, 1, 10, 1.0, 3.0), row(0, 2, 20, 1.05, 3.1), row(1, 1, 11, 4.0, 3.0), row(1, 2, 21, 4.2, 3.0), row(2, 1, 12, 8.0, None),
        row(2, 2, 22, 8.9, 5.0), row(3, 1, 13, 9.0, 3.0), row(3, 2, 23, 9.0, 3.0, "external"), row(4, 1, 14, 15.0, 3.0), row(4, 2, 24, 15.0, 6.0),
    ], SIDE))
    found = M.match_single(rows)
    assert largest(found) < COMPILED
    assert {(r.old_source_row, r.new_source_row, r.relaxation_level, round(r.match_score, 6), round(r.confidence, 6)) for r in found.collect()} == {
        (10, 20, 1, 0.08, 0.84), (11, 21, 2, 0.2, 0.8), (12, 22, 3, 0.9, 0.4)}


NOW = ("line_id int, source_row long, anomaly_id string, diameter_mm double, smys_mpa double, uts_mpa double, zone_fallback boolean, design_factor double,"
       " method string, depth_pct_wt double, depth_mm double, width_mm double, wt_mm double, sop_kgcm2 double, maop_kgcm2 double, erf double,"
       " folias_factor_m double, z_value double, run2_date date, cgr_mm_yr double")


def test_projection_is_compiled_and_follows_every_year(spark):
    import datetime

    day = datetime.date(2023, 3, 15)
    pipe = ("a", 711.0, 482.0, None, False, 0.72)
    rows = kept(spark.createDataFrame([
        (1, 1, *pipe, "B31G_Original", 20.0, 2.0, None, 10.0, 90.0, 40.0, 40.0 / 90.0, 1.2, 5.0, day, 0.7),
        (1, 2, *pipe, "Kastner", 20.0, 2.0, 100.0, 10.0, 90.0, 40.0, 40.0 / 90.0, None, None, day, 0.0),
        (1, 3, *pipe, "B31G_Original", 85.0, 8.5, None, 10.0, None, None, None, 1.2, 5.0, day, 0.1),
    ], NOW))
    found = P.project_rows(rows)
    assert largest(found) < COMPILED
    assert largest(P.project_rows(rows, horizon_years=25)) < COMPILED
    a, b, c = sorted(found.collect(), key=lambda r: r.source_row)
    depth = 2.0
    for _ in range(9):
        depth += 0.7
    assert (a.repair_trigger, a.repair_year_offset, a.last_assessed_year, a.final_depth_mm) == ("DEPTH_80", 9, 8, depth)
    assert [y.year for y in a.years] == list(range(9)) and a.years[8].erf == a.final_erf and a.years[0].sop_kgcm2 == 90.0
    assert (b.repair_trigger, b.repair_year_offset, b.last_assessed_year, len(b.years), b.final_depth_mm) == ("NONE_WITHIN_HORIZON", None, 10, 11, 2.0)
    assert (c.repair_trigger, c.repair_year_offset, c.final_erf, len(c.years)) == ("DEPTH_80", 0, None, 1)
    assert [len(r.years) for r in P.project_rows(rows.where("source_row = 2"), horizon_years=0).collect()] == [1]


def test_flags_and_clocks(spark, tmp_path):
    rows = [(1, 1, 5, 3, 1.0, 2.0, "R"), (1, 1, 5, 3, 1.0, 2.0, "A"), (1, 2, 5, 3, 1.0, 2.0, "N"), (1, 2, 5, 3, 1.0, 2.0, "R"), (1, 3, 5, 3, 1.0, 2.0, "R"),
            (1, 4, 5, 3, 1.0, 2.0, None), (1, 5, 5, 3, 1.0, 2.0, "AA"), (1, 5, 5, 3, 1.0, 2.0, None), (1, 6, 5, 3, 1.0, 2.0, ""), (1, 6, 5, 3, 1.0, 2.0, "A")]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double,"
                          " l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = T.base(spark, str(tmp_path))
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.source_row: r.surface for r in T.features(spark, str(tmp_path)).collect()} == {
        11: "internal", 12: "unknown", 13: "external", 14: "unknown", 15: "unknown", 16: "unknown"}
    texts = spark.createDataFrame([("6:30",), ("359.5",), ("",), (None,), ("99:99",), ("6h",)], "t string")
    read = clock.with_clock(texts, "t", "h", "bad").select("h", "bad").collect()
    assert [(None if r.h is None else round(r.h, 4), r.bad) for r in read] == [
        (6.5, False), (11.9833, False), (None, False), (None, False), (None, True), (6.0, False)]


def test_medians_and_clusters_read_their_rows_once(spark):
    rows = spark.createDataFrame(
        [(1, "r", 10, 4, "p", True, "metal loss", 20.0, 75.0), (1, "r", 11, 4, "a", False, "metal loss (grouped)", 22.0, 77.0),
         (1, "r", 12, 5, "b", False, "metal loss (grouped)", None, None)],
        "line_id int, run_id string, source_row long, joint_number int, anomaly_id string, is_cluster_parent boolean, raw_description string,"
        " latitude double, longitude double")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x):
        seen.add(1)
        return x

    verdicts = N.coordinate_verdicts(rows.withColumn("line_id", counted.asNondeterministic()("line_id"))).collect()
    assert [(r.line_id, r.lat_median, r.lon_median, r.code) for r in verdicts] == [(1, 21.0, 76.0, None)] and seen.value == 3
    seen.value = 0
    found = N.assign_clusters(rows.withColumn("anomaly_id", F.concat("anomaly_id", F.lit(""))).withColumn("joint_number", counted.asNondeterministic()("joint_number")))
    assert {(r.source_row, r.cluster_parent_id) for r in found.collect()} == {(10, None), (11, "p"), (12, None)} and seen.value <= 6
