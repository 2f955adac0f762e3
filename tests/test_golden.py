"""Published numbers and hand-made edge rows."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from girthline.functions import clock, dates, strength, text, units
from girthline.operators import alignment as J, assess as A, flags as Q, growth as G, ingest as N, inventory as I, matching as M, project as P, scan, zones as Z

ZONE = "struct<zone_idx:int,wt_mm_min:double,wt_mm_max:double,chainage_m_min:double,chainage_m_max:double,design_factor:double,maop_kgcm2:double>"
FEATURE = (
    "line_id int, run_id string, source_row long, anomaly_id string, joint_number int, abs_distance_m double, upstream_weld_dist_m double,"
    " clock_decimal_hours double, wt_mm double, depth_pct_wt double, length_mm double, width_mm double, surface string,"
    " feature_identification string, dimension_class string, is_cluster_parent boolean, cluster_parent_id string, raw_description string"
)


def feature(row, **over):
    base = dict(
        line_id=1, run_id="run_2", source_row=row, anomaly_id=f"F{row}", joint_number=10, abs_distance_m=100.0, upstream_weld_dist_m=5.0,
        clock_decimal_hours=6.0, wt_mm=10.0, depth_pct_wt=20.0, length_mm=30.0, width_mm=30.0, surface="internal",
        feature_identification="CORR", dimension_class="PITT", is_cluster_parent=False, cluster_parent_id=None, raw_description="metal loss",
    )
    return {**base, **over}


def features(spark, rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in FEATURE.split(", ")) for r in rows], FEATURE)


def lines(spark, zones, D=400.0, smys=358.0, mode="wt", ids=(1,)):
    rows = [(i, D, smys, mode, dt.date(2018, 12, 15), dt.date(2023, 3, 15), 4.0, zones) for i in ids]
    return spark.createDataFrame(
        rows, f"line_id int, diameter_mm double, smys_mpa double, maop_zoning_mode string, run1_date date, run2_date date, years_between double, zones array<{ZONE}>"
    )


def wt_zone(low, high, maop, idx=0):
    return (idx, low, high, None, None, 0.72, maop)


def assess_one(spark, D, smys, maop, **over):
    rows = A.assess(features(spark, [feature(1, **over)]), lines(spark, [wt_zone(0.0, 100.0, maop)], D, smys), over.pop("primary", "B31G_Original"))
    return A.controlling(rows).first()


def test_original_worked_example(spark):
    r = assess_one(spark, 273.0, 358.0, 70.0, wt_mm=6.4, depth_pct_wt=28.75, length_mm=9.0)
    assert r.z_value == pytest.approx(0.04636, abs=1e-5)
    assert r.folias_factor_m == pytest.approx(1.018375, abs=1e-6)
    assert r.pf_kgcm2 == pytest.approx(187.4771, abs=1e-4)
    assert r.sop_kgcm2 == pytest.approx(134.9835, abs=1e-4)
    assert r.erf == pytest.approx(0.518582, abs=1e-6)


def test_modified_worked_example(spark):
    rows = A.assess(
        features(spark, [feature(1, wt_mm=8.7, depth_pct_wt=25.8, length_mm=1235.0)]), lines(spark, [wt_zone(0.0, 100.0, 80.6)], 711.0, 482.0),
        "B31G_Modified",
    )
    r = A.controlling(rows).first()
    assert r.sop_kgcm2 == pytest.approx(78.83, abs=0.01)
    assert r.erf == pytest.approx(1.022, abs=1e-3)


def test_all_methods_agree_on_band_and_order(spark):
    rows = A.assess(
        features(spark, [feature(1, dimension_class="CIGR")]), lines(spark, [wt_zone(0.0, 100.0, 70.0)]), "B31G_Original",
        ["B31G_Modified", "RSTRENG", "B31G_Original", "DNV_RP_F101"],
    )
    long = A.long_results(rows).orderBy("method_ord").collect()
    assert [r.method for r in long] == ["B31G_Original", "B31G_Modified", "RSTRENG", "DNV_RP_F101", "Kastner"]
    assert long[1].sop_kgcm2 == long[2].sop_kgcm2 and long[2].using_approximate_profile and not long[1].using_approximate_profile
    assert [r.is_controlling for r in long].count(True) == 1


def test_zero_and_full_depth(spark):
    rows = A.assess(
        features(spark, [feature(1, depth_pct_wt=0.0), feature(2, depth_pct_wt=100.0, length_mm=2000.0)]), lines(spark, [wt_zone(0.0, 100.0, 70.0)]),
    )
    by = {r.source_row: r for r in A.controlling(rows).collect()}
    assert by[1].pf_kgcm2 == pytest.approx(2 * 1.1 * 358 * 10 / 400 * units.MPA_TO_KGCM2)
    assert by[2].sop_kgcm2 == 0 and math.isinf(by[2].erf) and "ERF_EXCEEDS_1" in by[2].flags and "DEPTH_EXCEEDS_80" in by[2].flags


def test_rejects_name_their_reason(spark):
    rows = [
        feature(1, feature_identification="DENT"), feature(2, wt_mm=None), feature(3, depth_pct_wt=None), feature(4, length_mm=None),
        feature(5, dimension_class="CIGR", width_mm=None), feature(6, line_id=2),
    ]
    dims = lines(spark, [wt_zone(0.0, 100.0, 70.0)])
    got = {r.source_row: r.reason for r in A.rejects(A.screen(features(spark, rows), dims)).collect()}
    assert got == {1: "not_metal_loss", 2: "wall_thickness_missing", 3: "depth_missing", 4: "length_missing", 5: "kastner_width_missing", 6: "diameter_missing"}
    kept = A.assess(features(spark, rows), dims).select("source_row").collect()
    assert [r.source_row for r in kept] == [5]
    assert A.assess(features(spark, rows), dims, strict=True).count() == 0


def test_zone_edges_and_nearest(spark):
    zones = [wt_zone(6.0, 6.8, 40.0, 0), wt_zone(6.8, 7.5, 48.0, 1)]
    rows = [feature(i, wt_mm=w) for i, w in enumerate([6.8, 7.5, 8.7, 5.0, None])]
    got = {r.source_row: (r.zone_idx, r.zone_fallback) for r in Z.with_zone(features(spark, rows), lines(spark, zones)).collect()}
    assert got == {0: (0, False), 1: (1, False), 2: (1, True), 3: (0, True), 4: (0, True)}


def test_zones_from_walls(spark):
    walls = spark.createDataFrame(
        [(1, 8.7, 80.6, 0.72), (1, 9.5, 84.1, 0.72), (1, 11.1, 96.7, 0.72), (2, 7.1, 98.0, 0.0), (2, 9.5, 98.0, 0.0)],
        "line_id int, wt_mm double, maop_kgcm2 double, design_factor double",
    )
    got = [tuple(r)[:4] for r in Z.build_zones(walls).orderBy("line_id", "zone_idx").collect()]
    assert got == [(1, 0, 8.2, 9.1), (1, 1, 9.1, 10.3), (1, 2, 10.3, 11.6), (2, 0, 6.6, 10.0)]


def test_design_pressure_example(spark):
    p = spark.range(1).select(strength.design_pressure_kgcm2(F.lit(482.0), F.lit(7.9), F.lit(711.0), F.lit(0.72)).alias("p")).first().p
    assert p == pytest.approx(78.6, abs=0.05)


def test_dent_worked_example(spark):
    from girthline.operators.dents import dent_strains

    rows = [
        feature(1, feature_identification="DENT", depth_pct_wt=0.59, length_mm=150.0, width_mm=115.0, wt_mm=6.4),
        feature(2, feature_identification="DEML", depth_pct_wt=0.0), feature(3, feature_identification="DENT", width_mm=0.0),
    ]
    got = {r.source_row: r for r in dent_strains(features(spark, rows), lines(spark, [], 407.0)).collect()}
    r = got[1]
    for value, want in zip((r.e1, r.e2, r.e3, r.ei, r.eo), (0.020365, 0.002729, 0.000128, 0.021999, 0.022150)):
        assert value == pytest.approx(want, abs=1e-6)
    assert got[2].flags == ["ZERO_OR_NEGATIVE_DEPTH"] and got[3].flags == ["INVALID_DIMENSIONS"] and got[3].resultant_strain_pct == 0.0


def pair(spark):
    return spark.createDataFrame([(1, 10, 10)], "line_id int, old_joint int, new_joint int")


def test_growth_worked_example_and_unmatched(spark):
    dims = lines(spark, []).withColumn("years_between", F.lit(4.246407))
    old = features(spark, [feature(1, wt_mm=6.4, depth_pct_wt=12.0)])
    new = features(spark, [feature(1, wt_mm=6.4, depth_pct_wt=28.75), feature(2, wt_mm=6.4, depth_pct_wt=5.0, upstream_weld_dist_m=9.0)])
    grown = G.growth(new, M.match(old, new, pair(spark)), dims, mode="feature_specific")
    got = {r.source_row: r for r in grown.collect()}
    assert got[1].cgr_mm_yr == pytest.approx(0.252449, abs=1e-6) and got[1].is_matched
    assert got[2].cgr_mm_yr == 0.0 and not got[2].is_matched and got[2].depth_old_used_mm == pytest.approx(0.64)
    codes = {(r.source_row, r.code) for r in G.growth_flags(grown).collect()}
    assert codes == {(2, "UNMATCHED_RUN2"), (2, "NEGATIVE_GROWTH")}


def test_single_sample_has_no_population_rate(spark):
    dims = lines(spark, [])
    new = features(spark, [feature(1), feature(2, surface="external", depth_pct_wt=30.0), feature(3, surface="external", depth_pct_wt=60.0)])
    none = M.match(new.where("false"), new, pair(spark))
    grown = {r.source_row: r for r in G.growth(new, none, dims).collect()}
    assert grown[1].population_p95_mm_yr is None and grown[1].mode_used == "feature_specific"
    assert grown[2].mode_used == "population_floor"
    assert grown[2].cgr_mm_yr == pytest.approx(float(np.percentile([0.5, 1.25], 95)))


def test_unusable_interval_gives_no_rate(spark):
    new = features(spark, [feature(1)])
    dims = lines(spark, []).withColumn("years_between", F.lit(-1.0))
    row = G.growth(new, M.match(new.where("false"), new, pair(spark)), dims, mode="feature_specific").first()
    assert row.error == "years_between_not_positive" and row.cgr_mm_yr is None


def test_five_identical_features_match_in_the_first_pass(spark):
    rows = [feature(i, upstream_weld_dist_m=0.3 * i, clock_decimal_hours=(2.0 * i) % 12) for i in range(5)]
    extra = [feature(9, upstream_weld_dist_m=11.0)]
    got = M.match(features(spark, rows), features(spark, rows + extra), pair(spark)).collect()
    assert sorted((r.old_source_row, r.new_source_row, r.relaxation_level) for r in got) == [(i, i, 1) for i in range(5)]
    assert all(r.old.anomaly_id == f"F{r.old_source_row}" for r in got)


def predict(spark, depth, rate, erf_limit=1.0, maop=70.0, **over):
    dims = lines(spark, [wt_zone(0.0, 100.0, maop)])
    one = features(spark, [feature(1, depth_pct_wt=depth, **over)])
    current = P.current_state(A.assess(one, dims), dims)
    return P.project(one.withColumn("cgr_mm_yr", F.lit(float(rate))), current, erf_trigger=erf_limit).first()


def test_projection_triggers(spark):
    deep = predict(spark, 85.0, 0.1)
    assert (deep.repair_trigger, deep.repair_year_offset, deep.predicted_repair_date) == ("DEPTH_80", 0, dt.date(2023, 3, 15))
    later = predict(spark, 50.0, 0.45)
    assert (later.repair_trigger, later.repair_year_offset) == ("DEPTH_80", 7)
    assert later.predicted_repair_date == dt.date(2023, 3, 15) + dt.timedelta(days=int(7 * 365.25))
    # The pressures of a depth trigger are those of the year before.
    assert len(later.years) == 7 and later.final_erf == later.years[-1].erf and later.final_depth_mm == pytest.approx(8.15)
    never = predict(spark, 10.0, 0.01)
    assert (never.repair_trigger, never.repair_year_offset, len(never.years)) == ("NONE_WITHIN_HORIZON", None, 11)
    pressure = predict(spark, 20.0, 0.4, maop=100.0, length_mm=300.0)
    assert pressure.repair_trigger == "ERF_1.0" and pressure.final_erf >= 1.0 and pressure.years[-2].erf < 1.0


@pytest.mark.parametrize("method", strength.METHODS)
def test_projection_equals_a_fresh_assessment(spark, method):
    """The projection's short form gives what the method itself gives at the later depth."""
    dims = lines(spark, [wt_zone(0.0, 100.0, 20.0)])
    for length in (30.0, 900.0, 3000.0):
        one = features(spark, [feature(1, depth_pct_wt=20.0, length_mm=length)])
        now = P.current_state(A.assess(one, dims, method, kastner_for_circumferential=False), dims)
        years = P.project(one.withColumn("cgr_mm_yr", F.lit(0.3)), now, erf_trigger=1e9).first().years
        later = A.controlling(A.assess(features(spark, [feature(1, depth_pct_wt=years[5].depth_pct_wt, length_mm=length)]), dims, method, kastner_for_circumferential=False)).first()
        assert years[5].erf == pytest.approx(later.erf, rel=1e-12)


def test_running_values_do_not_depend_on_chunks(spark):
    rows = [(k, i, (i * 7 + k) % 5 if (i * 3 + k) % 4 else None) for k in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, i long, v long")
    values = {
        "l": ("last", F.col("v")), "b": ("last_before", F.col("v")), "m": ("max", F.col("v")), "a": ("min_after", F.col("v")), "s": ("sum", F.col("v")),
    }
    results = [
        sorted(tuple(r) for r in scan.running(df, ["k"], ["i"], scan.chunk_of(F.col("i"), width), values).select("k", "i", *values).collect())
        for width in (1000, 7, 1)
    ]
    assert results[0] == results[1] == results[2]
    expected = {}
    for k in range(3):
        last = None
        for _, i, v in [r for r in rows if r[0] == k]:
            expected[(k, i)] = last if v is None else v
            last = expected[(k, i)]
    assert {(r[0], r[1]): r[2] for r in results[0]} == expected


@pytest.mark.parametrize("accuracy", [10000, 100])
def test_exact_quantiles(spark, accuracy):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=3000), "b": np.repeat([0.0, 1.0], [900, 100]), "c": np.array([4.0]), "d": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double").repartition(5)
    got = {r.g: r for r in scan.exact_quantiles(df, ["g"], "v", [0.05, 0.5, 0.95], accuracy).collect()}
    for g, vs in groups.items():
        assert [got[g].q0, got[g].q1, got[g].q2] == [float(np.percentile(vs, q)) for q in (5, 50, 95)]
        assert got[g].n == len(vs)


def test_segmented_alignment_recovers_edits(spark):
    rng = np.random.default_rng(11)
    rows_old, rows_new = [], []
    for line in range(3):
        length = np.round(rng.uniform(11.0, 12.6, 300), 3)
        start = np.concatenate(([0.0], np.cumsum(length)))[:-1]
        for i in range(300):
            rows_new.append((line, 40 + 10 * i, float(start[i]), float(length[i]), 7.1))
            if i % 41 != 5:
                rows_old.append((line, 10 + 10 * i, float(start[i]), float(length[i]), 7.1))
    schema = "line_id int, joint_number int, abs_distance_start_m double, length_m double, wt_mm double"
    old, new = spark.createDataFrame(rows_old, schema), spark.createDataFrame(rows_new, schema)
    whole = {(r.line_id, r.old_joint, r.new_joint) for r in J.align(old, new, anchor_joints=(1000,)).collect()}
    parts = {(r.line_id, r.old_joint, r.new_joint) for r in J.align(old, new, chunk=500).collect()}
    truth = {(line, joint, joint + 30) for line, joint, *_ in rows_old}
    assert parts == truth and whole == truth


def test_empty_run_aligns_to_nothing(spark):
    schema = "line_id int, joint_number int, abs_distance_start_m double, length_m double, wt_mm double"
    new = spark.createDataFrame([(1, 10, 0.0, 12.0, 7.1)], schema)
    pairs = J.align(new.where("false"), new)
    assert pairs.count() == 0
    summary = J.alignment_summary(new.where("false"), new, pairs).first()
    assert summary.method == "none" and summary.unmatched_new == 1


def raw(spark, rows):
    from girthline import vocab

    columns = ["line_id", "run_id", "sheet_ord", "source_row", *vocab.ALL_FIELDS]
    full = [tuple({"line_id": 1, "run_id": "r", "sheet_ord": 0, **r}.get(c) for c in columns) for r in rows]
    return spark.createDataFrame(full, "line_id int, run_id string, sheet_ord int, source_row long, " + ", ".join(f"{c} string" for c in vocab.ALL_FIELDS))


def anomaly(row, **over):
    return {"source_row": row, "feature_type": "Anomaly", "feature_identification": "CORR", "depth_pct_wt": "20", "wt_mm": "7,1", "length_mm": "30",
            "width_mm": "20", "clock_position": "06:00", "abs_distance_m": str(100 + row), **over}


def test_cluster_context_ends_with_the_joint(spark):
    rows = [
        anomaly(1, joint_number="10", feature_identification="COCL", anomaly_id="P"), anomaly(2, description="metal loss (grouped)"),
        anomaly(3, joint_number="20", description="metal loss (grouped)"), anomaly(4, description="plain"),
    ]
    got = {r.source_row: (r.joint_number, r.cluster_parent_id) for r in N.features_from_cells(N.read_cells(raw(spark, rows))).collect()}
    assert got == {1: (10, None), 2: (10, "P"), 3: (20, None), 4: (20, None)}


def test_out_of_order_rows_find_their_joint_by_chainage(spark):
    welds = [{"source_row": i, "feature_type": "Girth Weld", "joint_number": str(10 * (i + 1)), "abs_distance_m": str(1000 * i)} for i in range(3)]
    welds.append({"source_row": 3, "feature_type": "Girth Weld", "joint_number": "35", "abs_distance_m": "2000"})
    rows = welds + [anomaly(10, abs_distance_m="1500"), anomaly(11, abs_distance_m="2000"), anomaly(12, abs_distance_m="-5")]
    resolved = N.resolve_rows(N.attribute_joints(N.read_cells(raw(spark, rows))))
    kept = {r.source_row: (r.joint_number, r.upstream_weld_dist_m) for r in N.to_features(resolved).collect()}
    assert kept == {10: (20, 500.0), 11: (35, 0.0)}
    assert {r.source_row: r.reason for r in N.rejects(resolved).collect()}[12] == "missing_joint_number"


def test_registry_mode_breaks_ties_by_first_seen(spark):
    rows = [anomaly(1, joint_number="10", wt_mm="8.7"), anomaly(2, joint_number="10", wt_mm="7.1"), anomaly(3, wt_mm="9", joint_length_m="11.9")]
    r = N.joint_registry(N.read_cells(raw(spark, rows))).first()
    assert (r.wt_mm, r.length_m, r.abs_distance_start_m) == (8.7, 11.9, 101.0)


def test_cell_texts(spark):
    t = spark.createDataFrame(
        [("6.14", "28.5%"), ("6.75", "0.285"), ("180", "1.0"), ("6 o'clock", "n/a"), ("12:00", "101"), (None, "28,5"), ("06:14:30", "")], "c string, d string"
    )
    rows = units.with_depth(clock.with_clock(t, "c", "h", "bad"), "d", F.lit(False), "pct", "pct_bad").collect()
    got = [(None if r.h is None else round(r.h, 4), r.bad, r.pct, r.pct_bad) for r in rows]
    assert got == [
        (6.2333, False, 28.5, False), (None, True, pytest.approx(28.5), False), (6.0, False, 1.0, False), (6.0, False, None, False),
        (0.0, False, None, True), (None, False, None, True), (6.2417, False, None, False),
    ]
    n = spark.createDataFrame([("50,5",), ("1,234.5",), ("−3",), ("na",), ("n/a",), ("1.5e2",), ("5f",)], "c string")
    assert [r.v for r in n.select(text.to_float(F.col("c")).alias("v")).collect()] == [50.5, None, -3.0, None, None, 150.0, None]
    assert [r.v for r in n.select(text.lenient_number(F.col("c")).alias("v")).collect()] == [50.5, 1234.5, None, None, None, 150.0, None]
    assert [r.v for r in n.select(text.is_na(F.col("c")).alias("v")).collect()] == [False, False, False, True, False, False, False]


def test_labels_and_clock_faces(spark):
    row = spark.range(1).select(
        clock.render(F.lit(11.9999999)).alias("a"), clock.render(F.lit(6.2417)).alias("b"), clock.render(F.lit(None).cast("double")).alias("c"),
        dates.repair_label(F.lit("NONE_WITHIN_HORIZON"), F.lit(None).cast("date"), F.lit("2033-03-14").cast("date")).alias("d"),
        dates.repair_label(F.lit("ERF_1.0"), F.lit("2025-03-14").cast("date"), F.lit(None).cast("date")).alias("e"),
        dates.repair_label(F.lit(None).cast("string"), F.lit(None).cast("date"), F.lit(None).cast("date")).alias("f"),
    ).first()
    assert tuple(row) == ("00:00:00", "06:14:30", "", "After March 2033", "14-03-2025", "")


def test_findings_keep_the_first_stage_and_clean_lines(spark):
    one = spark.createDataFrame([(1, 5, "F5", "ERF_EXCEEDS_1")], "line_id int, source_row long, anomaly_id string, code string")
    found = Q.collect_findings([Q.staged(one, 5), Q.staged(one, 6)])
    assert [(r.stage, r.severity) for r in found.collect()] == [(5, "error")]
    report = {r.line_id: r for r in Q.with_clean_lines(Q.finding_report(found), lines(spark, [], ids=(1, 2))).collect()}
    assert report[1].has_critical and report[1].summary == "QA: 1 finding(s) — 1 error, 0 warn, 0 info. (REVIEW REQUIRED)"
    assert not report[2].has_critical and report[2].summary == "QA: clean — no findings raised."


def test_assessable_excludes_children_and_other_kinds(spark):
    rows = [feature(1), feature(2, cluster_parent_id="P"), feature(3, feature_identification="GWAN"), feature(4, feature_identification="MIAN")]
    assert sorted(r.source_row for r in I.assessable(features(spark, rows)).collect()) == [1, 4]


def test_circumferential_rules(spark):
    rows = [
        feature(1, dimension_class="CISL"), feature(2, dimension_class="PITT", width_mm=90.0), feature(3, dimension_class="UNDEFINED", raw_description="Circumferential groove"),
        feature(4, dimension_class="UNDEFINED", width_mm=90.0), feature(5, dimension_class="UNDEFINED", width_mm=None),
    ]
    got = {r.source_row: r.e for r in features(spark, rows).select("source_row", I.is_circumferential().alias("e")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False}
