"""Queries of alignment, findings, report tables, chart series and the whole chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.ctes import cte, r, sql
from checks.engine import grown, lines, matches, predicted, rd, runs, rx
from girthline.functions import dates
from girthline.operators import alignment as J, assess as A, flags as Q, inventory as I, matching as M, project as P
from girthline.operators.dents import dent_strains
from girthline.operators.growth import growth_flags
from girthline.plans import chain as C, report as R
from girthline.session import kept
from girthline.sources import tables as T

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn
    return add


def current(spark, sf, new=None, dims=None):
    dims = lines(spark, sf) if dims is None else dims
    return P.current_state(A.assess(I.assessable(T.features(spark, sf) if new is None else new), dims), dims)


def narrow(now):
    """Without the columns that no projection or summary reads, for a caller that keeps the rows."""
    return now.drop("flags", "notes", "branch_used", "pf_kgcm2", "flow_stress_mpa", "area_metal_loss_ratio", "using_approximate_profile",
                    "method_ord", "is_controlling", "zone_fallback", "length_mm")


# --- alignment -------------------------------------------------------------------------------------------------

cte("jn", "", """
SELECT CAST(o_orderkey // 750 AS INTEGER) AS line_id, CAST((o_orderkey % 750) * 10 + 40 AS INTEGER) AS joint_number,
  (o_orderkey % 750) * 12.0 AS start_m, 11.5 + ((o_orderkey * 7919) % 1000) / 1000.0 AS length_m,
  CASE o_orderkey % 3 WHEN 0 THEN 6.4 WHEN 1 THEN 7.1 ELSE 8.7 END AS wt_mm, o_orderkey AS ok FROM orders""")
cte("jo", "jn", "SELECT * REPLACE (CAST(joint_number - 30 AS INTEGER) AS joint_number) FROM jn WHERE ok % 37 <> 0")


def both(spark, sf):
    return T.joints(spark, sf, 1), T.joints(spark, sf, 2)


@query("joint_pairs", sql("jn jo", """
SELECT o.line_id, o.joint_number AS old_joint, n.joint_number AS new_joint, 0.0 AS length_diff_m, 1.0 AS confidence, 'needleman_wunsch' AS matched_via
FROM jo o JOIN jn n ON o.line_id = n.line_id AND n.joint_number = o.joint_number + 30"""))
def _(spark, sf):
    return J.align(*both(spark, sf)).select("line_id", "old_joint", "new_joint", rd("length_diff_m"), rd("confidence"), "matched_via")


# Two pointers along both runs; the recursion moves those of all lines at once.
@query("joint_pairs_by_distance", sql("jn jo", f""",
o AS (SELECT line_id, joint_number, start_m AS s, row_number() OVER (PARTITION BY line_id ORDER BY start_m, joint_number) AS i FROM jo),
n AS (SELECT line_id, joint_number, start_m AS s, row_number() OVER (PARTITION BY line_id ORDER BY start_m, joint_number) AS j FROM jn),
m AS (SELECT DISTINCT line_id, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS j FROM o UNION ALL
  SELECT m.line_id, m.i + CASE WHEN n.s - o.s >= -500.0 THEN 1 ELSE 0 END, m.j + CASE WHEN n.s - o.s <= 500.0 THEN 1 ELSE 0 END
  FROM m JOIN o ON m.line_id = o.line_id AND m.i = o.i JOIN n ON m.line_id = n.line_id AND m.j = n.j)
SELECT m.line_id, o.joint_number AS old_joint, n.joint_number AS new_joint, {r('1.0 - abs(n.s - o.s) / 500.0')} AS confidence, 'nearest_distance' AS matched_via
FROM m JOIN o ON m.line_id = o.line_id AND m.i = o.i JOIN n ON m.line_id = n.line_id AND m.j = n.j WHERE abs(n.s - o.s) <= 500.0"""
).replace("\n,\no AS", ",\no AS").replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, sf):
    old, new = (d.withColumn("length_m", F.lit(0.0)) for d in both(spark, sf))
    return J.align(old, new).select("line_id", "old_joint", "new_joint", rd("confidence"), "matched_via")


@query("joint_run_totals", sql("jn jo", f"""
SELECT line_id, n_old, n_new, {r('l1')} AS length_old_m, {r('l2')} AS length_new_m, 'needleman_wunsch' AS method,
  CAST(greatest(20, floor(greatest(n_old, n_new) * 0.05), abs(n_old - n_new)) AS INTEGER) AS band
FROM (SELECT line_id, count(*) AS n_new, sum(length_m) AS l2 FROM jn GROUP BY 1)
JOIN (SELECT line_id, count(*) AS n_old, sum(length_m) AS l1 FROM jo GROUP BY 1) USING (line_id)"""))
def _(spark, sf):
    return J.line_modes(*both(spark, sf)).select("line_id", "n_old", "n_new", rd("length_old_m"), rd("length_new_m"), "method", "band")


@query("joint_pair_scores", sql("jn jo", f"""
SELECT o.line_id, o.joint_number AS old_joint, n.joint_number AS new_joint,
  {r('1.0 - abs(o.length_m - n.length_m) / greatest(o.length_m, n.length_m)')} AS similarity,
  {r('CAST(1.0 - abs(o.length_m - n.length_m) / greatest(o.length_m, n.length_m) + CASE WHEN abs(o.wt_mm - n.wt_mm) <= 0.5 THEN 0.2 ELSE 0.0 END + 0.3 AS DOUBLE)', 3)} AS score
FROM jo o JOIN jn n ON o.line_id = n.line_id AND n.joint_number - o.joint_number - 30 IN (-20, -10, 0, 10, 20)"""))
def _(spark, sf):
    old, new = both(spark, sf)
    fields = ("joint_number", "length_m", "wt_mm", "abs_distance_start_m")
    near = F.explode(F.array(*[F.lit(d) for d in (10, 20, 30, 40, 50)]))
    o = old.select("line_id", F.struct(*fields).alias("o"), near.alias("_d")).withColumn("_n", F.col("o.joint_number") + F.col("_d"))
    n = new.select("line_id", F.struct(*fields).alias("n"), F.col("joint_number").alias("_n"))
    rows = o.join(n, ["line_id", "_n"])
    score = F.round(J.pair_score(F.col("o"), F.col("n")).cast("double"), 3) + 0.0
    sim = F.round(J.length_similarity(F.col("o.length_m"), F.col("n.length_m")), 6) + 0.0
    return rows.select(
        "line_id", F.col("o.joint_number").alias("old_joint"), F.col("n.joint_number").alias("new_joint"),
        sim.alias("similarity"), score.alias("score"),
    )


# Every cell of the band.
@query("joint_band_scores", sql("jn jo", """,
o AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY joint_number) AS i FROM jo),
n AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY joint_number) AS j FROM jn),
b AS (SELECT line_id, greatest(20, floor(greatest(n_o, n_n) * 0.05), abs(n_o - n_n)) AS band
  FROM (SELECT line_id, count(*) AS n_o FROM o GROUP BY 1) JOIN (SELECT line_id, count(*) AS n_n FROM n GROUP BY 1) USING (line_id)),
s AS (SELECT line_id, o.joint_number AS old_joint, n.joint_number AS new_joint, abs(o.start_m - n.start_m) <= 500.0 AS near, abs(CAST(o.wt_mm AS FLOAT) - CAST(n.wt_mm AS FLOAT)) <= 0.5 AS walls,
  1.0 - CAST(abs(CAST(o.length_m AS FLOAT) - CAST(n.length_m AS FLOAT)) AS DOUBLE) / CAST(greatest(CAST(o.length_m AS FLOAT), CAST(n.length_m AS FLOAT)) AS DOUBLE) AS sim
  FROM o JOIN n USING (line_id) JOIN b USING (line_id) WHERE abs(i - j) <= band),
c AS (SELECT *, CASE WHEN sim < 0.85 THEN -1.0 ELSE sim + CASE WHEN walls THEN CAST(CAST(0.2 AS FLOAT) AS DOUBLE) ELSE 0.0 END + CASE WHEN near THEN CAST(CAST(0.3 AS FLOAT) AS DOUBLE) ELSE 0.0 END END AS score FROM s)
SELECT line_id, old_joint, count(*) AS n_scored, round(sum(score), 6) + 0.0 AS total_score, round(max(score), 6) + 0.0 AS best_score, arg_min(new_joint, {'s': -score, 'j': new_joint}) AS best_new_joint
FROM c GROUP BY line_id, old_joint""").replace("\n,\no AS", ",\no AS"))
def _(spark, sf):
    cells = J.band_pairs(*both(spark, sf))
    rows = cells.select("line_id", F.col("o.joint_number").alias("old_joint"), F.col("n.joint_number").alias("new_joint"), J.pair_score(F.col("o"), F.col("n")).cast("double").alias("score"))
    return rows.groupBy("line_id", "old_joint").agg(
        F.count("*").alias("n_scored"), rx(F.sum("score"), "total_score"), rx(F.max("score"), "best_score"),
        F.min_by("new_joint", J.best_first(F.col("score"), F.col("new_joint"))).alias("best_new_joint"),
    )


def true_pairs(spark, sf):
    """Pairs as the derivation implies them, shifted in places so that some run backwards."""
    old, new = both(spark, sf)
    o = old.select("line_id", F.col("joint_number").alias("old_joint"), F.col("length_m").alias("old_length_m"),
                   F.col("abs_distance_start_m").alias("old_start_m"))
    n = new.select("line_id", (F.col("joint_number") - 30).alias("old_joint"), F.col("joint_number").alias("new_joint"),
                   (F.col("length_m") * F.when(F.col("line_id") % 3 == 0, 1.02).otherwise(1.0)).alias("new_length_m"),
                   (F.col("abs_distance_start_m") - F.when(F.col("joint_number") % 130 == 0, 30.0).otherwise(0.0)).alias("new_start_m"))
    return o.join(n, ["line_id", "old_joint"])


_TRUE = """tp AS (SELECT o.line_id, o.joint_number AS old_joint, n.joint_number AS new_joint, o.length_m AS l1,
  n.length_m * CASE WHEN o.line_id % 3 = 0 THEN 1.02 ELSE 1.0 END AS l2, o.start_m AS s1,
  n.start_m - CASE WHEN n.joint_number % 130 = 0 THEN 30.0 ELSE 0.0 END AS s2
  FROM jo o JOIN jn n ON o.line_id = n.line_id AND n.joint_number = o.joint_number + 30),
rv AS (SELECT * FROM (SELECT *, lag(s1) OVER w AS p1, lag(s2) OVER w AS p2 FROM tp WINDOW w AS (PARTITION BY line_id ORDER BY old_joint))
  WHERE s1 < p1 OR s2 < p2)"""


@query("joint_reversals", sql("jn jo", f", {_TRUE} SELECT line_id, old_joint, new_joint FROM rv").replace("\n, tp AS", ",\ntp AS"))
def _(spark, sf):
    return J.reversals(true_pairs(spark, sf), chunk=1000)


@query("joints_unmatched", sql("jn jo", """
SELECT line_id, joint_number FROM jn WHERE (line_id, joint_number - 30) NOT IN (SELECT line_id, joint_number FROM jo)"""))
def _(spark, sf):
    return J.unmatched_joints(T.joints(spark, sf), true_pairs(spark, sf), "new").select("line_id", "joint_number")


_ASUM = f"""
SELECT line_id, m.matched, m.matched / greatest(o.c, n.c) AS rate, abs(m1 - m2) / greatest(m1, m2) AS dis, coalesce(v.c, 0) AS nrev
FROM (SELECT line_id, count(*) AS matched, sum(l1) AS m1, sum(l2) AS m2 FROM tp GROUP BY 1) m
JOIN (SELECT line_id, count(*) AS c FROM jo GROUP BY 1) o USING (line_id) JOIN (SELECT line_id, count(*) AS c FROM jn GROUP BY 1) n USING (line_id)
LEFT JOIN (SELECT line_id, count(*) AS c FROM rv GROUP BY 1) v USING (line_id)"""


@query("alignment_summary", sql("jn jo", f", {_TRUE} SELECT line_id, matched, {r('rate', 9)} AS match_rate, {r('dis', 9)} AS length_disagreement, nrev AS n_reversals FROM ({_ASUM})").replace("\n, tp AS", ",\ntp AS"))
def _(spark, sf):
    rows = J.alignment_summary(*both(spark, sf), true_pairs(spark, sf))
    return rows.select("line_id", "matched", rd("match_rate", 9), rd("length_disagreement", 9), "n_reversals")


@query("alignment_findings", sql("jn jo", f""", {_TRUE} SELECT line_id, code FROM (SELECT line_id, unnest([
  CASE WHEN rate < 0.9 THEN 'LOW_JOINT_MATCH_RATE' END, CASE WHEN nrev > 0 THEN 'REVERSAL_DETECTED' END,
  CASE WHEN dis > 0.01 THEN 'LENGTH_MISMATCH_RUN' END]) AS code FROM ({_ASUM})) WHERE code IS NOT NULL""").replace("\n, tp AS", ",\ntp AS"))
def _(spark, sf):
    return J.alignment_codes(J.alignment_summary(*both(spark, sf), true_pairs(spark, sf)))


# --- findings --------------------------------------------------------------------------------------------------

cte("flags", "grown ctl repairs", """
SELECT line_id, source_row, code, min(stage) AS stage FROM (
SELECT line_id, source_row, unnest([CASE WHEN NOT is_matched THEN 'UNMATCHED_RUN2' END, CASE WHEN delta < 0 THEN 'NEGATIVE_GROWTH' END,
  CASE WHEN is_matched AND abs(delta) < 10.0 / 100.0 * wt_mm THEN 'DEPTH_BELOW_TOL' END, CASE WHEN own > 1.0 THEN 'EXTREME_CGR' END,
  CASE WHEN mode_used = 'population_floor' THEN 'POPULATION_FLOOR_APPLIED' END]) AS code, 4 AS stage FROM grown
UNION ALL SELECT line_id, source_row, unnest([CASE WHEN cerf >= 1.0 THEN 'ERF_EXCEEDS_1' END, CASE WHEN pct >= 80.0 THEN 'DEPTH_EXCEEDS_80' END,
  CASE WHEN cmethod <> 'Kastner' AND length_mm < wt_mm THEN 'VERY_SHORT_DEFECT' END,
  CASE WHEN cmethod <> 'Kastner' AND z > 50.0 THEN 'LONG_DEFECT_OUTSIDE_B31G' END,
  CASE WHEN zone_fallback THEN 'MAOP_ZONE_NOT_FOUND' END]) AS code, 5 AS stage FROM ctl
UNION ALL SELECT DISTINCT line_id, CAST(NULL AS BIGINT), 'REPAIR_PREDICTED_WITHIN_HORIZON', 7 FROM repairs WHERE repair_trigger <> 'NONE_WITHIN_HORIZON'
UNION ALL SELECT line_id, CAST(NULL AS BIGINT), 'HIGH_CGR_POPULATION', 7 FROM grown GROUP BY line_id HAVING median(cgr) > 0.2)
WHERE code IS NOT NULL GROUP BY 1, 2, 3""")

cte("severed", "flags", """
SELECT *, CASE WHEN code IN ('ERF_EXCEEDS_1', 'DEPTH_EXCEEDS_80') THEN 'error' WHEN code IN ('UNMATCHED_RUN2', 'NEGATIVE_GROWTH', 'DEPTH_BELOW_TOL',
  'POPULATION_FLOOR_APPLIED') THEN 'info' ELSE 'warn' END AS severity FROM flags""")


def assessed_lines(spark, sf):
    return C.assess_lines(*runs(spark, sf), T.joints(spark, sf, 1), T.joints(spark, sf, 2), T.lines(spark, sf))


def findings(spark, sf):
    """Findings of all stages of the chain. The features are derived from tables and not read, so stage 1 has none."""
    return assessed_lines(spark, sf).findings


@query("findings_collected", sql("severed", "SELECT line_id, source_row, code, CAST(stage AS INTEGER) AS stage, severity FROM severed"))
def _(spark, sf):
    return findings(spark, sf).select("line_id", "source_row", "code", "stage", "severity")


@query("finding_counts", sql("severed", "SELECT line_id, code, severity, count(*) AS n FROM severed GROUP BY ALL"))
def _(spark, sf):
    return Q.finding_counts(findings(spark, sf))


@query("finding_report", sql("severed", """
SELECT line_id, e AS n_error, w AS n_warn, i AS n_info, crit AS has_critical, 'QA: ' || (e + w + i) || ' finding(s) — ' || e || ' error, ' || w || ' warn, ' || i
  || ' info. (' || CASE WHEN crit THEN 'REVIEW REQUIRED' ELSE 'review recommended' END || ')' AS summary
FROM (SELECT line_id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warn') AS w, count(*) FILTER (severity = 'info') AS i,
  bool_or(code IN ('ERF_EXCEEDS_1', 'DEPTH_EXCEEDS_80')) AS crit FROM severed GROUP BY 1)"""))
def _(spark, sf):
    return Q.finding_report(findings(spark, sf))


@query("findings_by_feature", sql("severed", """
SELECT line_id, source_row, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warn') AS warn,
  count(*) FILTER (severity = 'info') AS info FROM severed WHERE source_row IS NOT NULL GROUP BY 1, 2"""))
def _(spark, sf):
    return Q.findings_by_feature(findings(spark, sf)).drop("feature_id")


@query("line_findings", sql("flags", "SELECT line_id, code FROM flags WHERE source_row IS NULL"))
def _(spark, sf):
    dims = lines(spark, sf)
    rows = grown(spark, sf, dims=dims)
    return Q.line_findings(rows, P.project(rows, current(spark, sf, rows, dims)))


@query("issue_listing", sql("severed", """
SELECT line_id, CAST(CASE severity WHEN 'error' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END AS INTEGER) AS severity_rank, upper(severity) AS severity, code,
  source_row FROM severed"""))
def _(spark, sf):
    return R.ordered_issues(findings(spark, sf)).drop("feature_id")


# --- tables ----------------------------------------------------------------------------------------------------

def hms(h: str) -> str:
    s = f"CAST(floor({h}) * 3600 + floor(({h} - floor({h})) * 60.0) * 60 + round_even((({h} - floor({h})) * 60.0 - floor(({h} - floor({h})) * 60.0)) * 60.0, 0) AS INTEGER) % 43200"
    return f"printf('%02d:%02d:%02d', ({s}) // 3600, ({s}) // 60 % 60, ({s}) % 60)"


def side(c: str) -> str:
    return f"CASE {c} WHEN 'internal' THEN 'int.' WHEN 'external' THEN 'ext.' ELSE '' END"


_SN = "row_number() OVER (PARTITION BY line_id ORDER BY abs_distance_m, anomaly_id, source_row) AS sn"
_LABEL = "CASE WHEN repair_trigger <> 'NONE_WITHIN_HORIZON' THEN strftime(repair_date, '%d-%m-%Y') ELSE 'After March 2033' END"


@query("run_comparison", sql("grown", f"""
SELECT line_id, source_row, {_SN}, anomaly_id, joint_number, {r('abs_distance_m')} AS abs_distance_new_m, {r('oabs')} AS abs_distance_old_m,
  {r('depth_pct_wt')} AS depth_new_pct, {r('CASE WHEN is_matched THEN od ELSE old_mm * 100.0 / wt_mm END')} AS depth_old_pct,
  {hms('clock_decimal_hours')} AS orientation_new, CASE WHEN is_matched THEN {hms('oclock')} ELSE '' END AS orientation_old,
  {side('surface')} AS surface_new, CASE WHEN is_matched THEN {side('so')} ELSE '' END AS surface_old, {r('own')} AS cgr_raw_mm_yr, {r('cgr')} AS cgr_mm_yr
FROM grown"""))
def _(spark, sf):
    return R.comparison(grown(spark, sf)).select(
        "line_id", "source_row", "sn", "anomaly_id", "joint_number", rd("abs_distance_new_m"), rd("abs_distance_old_m"),
        rd("depth_new_pct"), rd("depth_old_pct"), "orientation_new", "orientation_old", "surface_new", "surface_old",
        rd("cgr_raw_mm_yr"), rd("cgr_mm_yr"),
    )


@query("matched_comparison", sql("grown", f"""
SELECT line_id, source_row, {_SN}, anomaly_id, {r('depth_pct_wt')} AS depth_new_pct, {r('od')} AS depth_old_pct, {side('surface')} AS surface_new,
  {side('so')} AS surface_old, {r('cgr')} AS cgr_mm_yr FROM grown WHERE is_matched"""))
def _(spark, sf):
    return R.matched_comparison(grown(spark, sf)).select(
        "line_id", "source_row", "sn", "anomaly_id", rd("depth_new_pct"), rd("depth_old_pct"), "surface_new", "surface_old", rd("cgr_mm_yr")
    )


@query("anomaly_table", sql("grown predicted", f"""
SELECT g.line_id, g.source_row, row_number() OVER (PARTITION BY g.line_id ORDER BY abs_distance_m, g.anomaly_id, g.source_row) AS sn,
  {r('upstream_weld_dist_m')} AS upstream_weld_dist_m, raw_description AS event, {side('surface')} AS surface, {hms('clock_decimal_hours')} AS orientation,
  {r('length_mm')} AS length_mm, {_LABEL} AS repair_label FROM grown g JOIN predicted p USING (source_row)"""))
def _(spark, sf):
    dims = lines(spark, sf)
    rows = grown(spark, sf, dims=dims)
    return R.anomalies(rows, P.project(rows, current(spark, sf, rows, dims))).select(
        "line_id", "source_row", "sn", rd("upstream_weld_dist_m"), "event", "surface", "orientation", rd("length_mm"), "repair_label"
    )


_NOW_END = f"""
SELECT g.line_id, g.source_row, row_number() OVER (PARTITION BY g.line_id ORDER BY g.abs_distance_m, g.anomaly_id, g.source_row) AS sn,
  {r('g.depth_pct_wt')} AS depth_now_pct, {r('p.last_pct')} AS depth_end_pct, {r('SOP')} AS sop_now_kgcm2, {r('p.final_sop')} AS sop_end_kgcm2,
  {r('ERF')} AS erf_now, {r('p.final_erf')} AS erf_end, {_LABEL} AS repair_label FROM grown g JOIN predicted p USING (source_row)"""


def _now_end(rows):
    return rows.select(
        "line_id", "source_row", "sn", rd("depth_now_pct"), rd("depth_end_pct"), rd("sop_now_kgcm2"), rd("sop_end_kgcm2"),
        rd("erf_now"), rd("erf_end"), "repair_label",
    )


@query("assessment_now_and_end", sql("grown predicted ctl", _NOW_END.replace("SOP", "c.csop").replace("ERF", "c.cerf") + " JOIN ctl c USING (source_row)"))
def _(spark, sf):
    dims, both = lines(spark, sf), runs(spark, sf)
    rows = grown(spark, sf, both, dims)
    # The state now has a row for each feature, the rated one a row for each growth row.
    return _now_end(R.assessment_now_and_end(rows, current(spark, sf, both[1], dims), P.project(rows, current(spark, sf, rows, dims))))


@query("circumferential_controlling", sql("grown predicted ctl", _NOW_END.replace("SOP", "c.csop").replace("ERF", "c.cerf")
       + " JOIN ctl c USING (source_row) WHERE c.cmethod = 'Kastner'").replace("711.0", "114.3"))
def _(spark, sf):
    # Narrow pipe, on which wide defects are weaker along the circumference than along the axis.
    dims = lines(spark, sf).withColumn("diameter_mm", F.lit(114.3))
    both = runs(spark, sf)
    rows = grown(spark, sf, both)
    now = kept(narrow(current(spark, sf, both[1], dims)))
    return _now_end(R.circumferential_controlling(rows, now, P.project(rows, current(spark, sf, rows, dims))))


@query("circumferential_all", sql("grown predicted ffp", _NOW_END.replace("SOP", "c.sop_kgcm2").replace("ERF", "c.erf") + " JOIN ffp c USING (source_row) WHERE c.method = 'Kastner'"))
def _(spark, sf):
    dims = lines(spark, sf)
    rows = grown(spark, sf, dims=dims)
    return _now_end(R.circumferential_all(rows, dims, P.project(rows, current(spark, sf, rows, dims))))


@query("dent_table", sql("f2", f"""
SELECT line_id, source_row, {_SN}, {r('depth_pct_wt * 711.0 / 100.0')} AS depth_mm, {hms('clock_decimal_hours')} AS orientation, 355.5 AS pipe_radius_mm
FROM f2 WHERE feature_identification = 'DENT'"""))
def _(spark, sf):
    return R.dent_table(dent_strains(T.features(spark, sf), T.lines(spark, sf))).select(
        "line_id", "source_row", "sn", rd("depth_mm"), "orientation", "pipe_radius_mm"
    )


@query("parameter_table", sql("lines", """
SELECT line_id, section, item, value FROM lines, (VALUES ('FFP Method', 'primary_method', 'B31G_Original'), ('CGR Computation', 'mode', 'hybrid'),
  ('CGR Computation', 'split_by_surface', 'true'), ('CGR Computation', 'floor_negative_at_zero', 'true'),
  ('CGR Computation', 'unmatched_depth_assumption_pct_wt', '10.0'), ('Repair Prediction', 'horizon_years', '10'),
  ('Repair Prediction', 'depth_trigger_pct_wt', '80.0'), ('Repair Prediction', 'erf_trigger', '1.0'), ('Pipeline', 'diameter_mm', '711.0'),
  ('Pipeline', 'smys_mpa', '482.0'), ('Pipeline', 'material_grade', 'API 5L X70'), ('ILI Runs', 'run1_date', '2018-12-15'),
  ('ILI Runs', 'run2_date', '2023-03-15'), ('ILI Runs', 'years_between', '4.246407'), ('MAOP Zones', 'Z1', '6.0 – 6.8 | 0.72 | 40.0'),
  ('MAOP Zones', 'Z2', '6.8 – 7.5 | 0.72 | 48.0')) AS t(section, item, value)"""))
def _(spark, sf):
    return R.parameters(T.lines(spark, sf), T.zones(spark, sf), C.Settings())


_BANDS = """
SELECT l.line_id, b.band, coalesce(c.n, 0) AS n FROM lines l, (VALUES ('≤ 0.85'), ('0.85 < ERF ≤ 0.90'), ('0.90 < ERF ≤ 1.00'), ('> 1.00')) AS b(band)
LEFT JOIN (SELECT line_id, CASE WHEN E <= 0.85 THEN '≤ 0.85' WHEN E <= 0.90 THEN '0.85 < ERF ≤ 0.90' WHEN E <= 1.00 THEN '0.90 < ERF ≤ 1.00'
  ELSE '> 1.00' END AS band, count(*) AS n FROM ctl GROUP BY 1, 2) c ON l.line_id = c.line_id AND b.band = c.band"""


@query("erf_bands", sql("lines ctl", _BANDS.replace(" E ", " cerf ")))
def _(spark, sf):
    return R.erf_bands(A.controlling(A.assess(T.features(spark, sf), T.lines(spark, sf))), T.lines(spark, sf))


@query("erf_bands_as_displayed", sql("lines ctl", _BANDS.replace(" E ", " round_even(cerf, 3) ")))
def _(spark, sf):
    return R.erf_bands(A.controlling(A.assess(T.features(spark, sf), T.lines(spark, sf))), T.lines(spark, sf), places=3)


@query("shape_table", sql("a2", f"""
SELECT line_id, dimension_class, internal, external, internal + external AS total,
  {r('100.0 * (internal + external) / sum(internal + external) OVER (PARTITION BY line_id)')} AS share_pct
FROM (SELECT line_id, dimension_class, count(*) FILTER (surface = 'internal') AS internal, count(*) FILTER (surface = 'external') AS external
  FROM a2 WHERE surface <> 'unknown' GROUP BY 1, 2)"""))
def _(spark, sf):
    return R.shape_table(I.assessable(T.features(spark, sf))).select("line_id", "dimension_class", "internal", "external", "total", rd("share_pct"))


_TOP = """SELECT line_id, source_row, CAST(rank AS INTEGER) AS rank, joint_number, {v} AS {n} FROM (
  SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY {o} DESC, source_row) AS rank FROM ctl) WHERE rank <= 20"""


@query("top_features_by_erf", sql("ctl", _TOP.format(o="cerf", v=r("cerf"), n="erf")))
def _(spark, sf):
    rows = R.top_features(I.assessable(T.features(spark, sf)), current(spark, sf), "erf")
    return rows.select("line_id", "source_row", "rank", "joint_number", rd("erf"))


@query("top_features_by_depth", sql("ctl", _TOP.format(o="pct", v=r("pct"), n="depth_pct_wt")))
def _(spark, sf):
    rows = R.top_features(I.assessable(T.features(spark, sf)), current(spark, sf), "depth_pct_wt")
    return rows.select("line_id", "source_row", "rank", "joint_number", rd("depth_pct_wt"))


@query("summary_metrics", sql("grown ctl predicted", f"""
SELECT line_id, g.n_features, n_internal, n_external, {r('max_depth')} AS max_depth_pct, max_depth_feature_id, {r('p95i')} AS p95_internal,
  {r('p95e')} AS p95_external, n_erf_ge_1, {r('max_erf')} AS max_erf, max_erf_joint, n_within_horizon, n_immediate, n_scheduled, n_monitor,
  {r('100.0 * n_internal / n_features')} AS internal_pct, {r('100.0 * n50 / n_features')} AS deep_pct
FROM (SELECT line_id, count(*) AS n_features, count(*) FILTER (surface = 'internal') AS n_internal, count(*) FILTER (surface = 'external') AS n_external,
    max(depth_pct_wt) AS max_depth, first(anomaly_id ORDER BY depth_pct_wt DESC, source_row) AS max_depth_feature_id,
    quantile_cont(own, 0.95) FILTER (surface = 'internal') AS p95i, quantile_cont(own, 0.95) FILTER (surface = 'external') AS p95e,
    count(*) FILTER (depth_pct_wt >= 50) AS n50 FROM grown GROUP BY 1) g
JOIN (SELECT line_id, count(*) FILTER (cerf >= 1.0) AS n_erf_ge_1, max(cerf) AS max_erf, first(joint_number ORDER BY cerf DESC, source_row) AS max_erf_joint
  FROM ctl GROUP BY 1) USING (line_id)
JOIN (SELECT line_id, count(*) FILTER (repair_trigger <> 'NONE_WITHIN_HORIZON') AS n_within_horizon, count(*) FILTER (repair_year_offset = 0) AS n_immediate,
  count(*) FILTER (repair_year_offset BETWEEN 1 AND 5) AS n_scheduled, count(*) FILTER (repair_trigger = 'NONE_WITHIN_HORIZON') AS n_monitor
  FROM predicted GROUP BY 1) USING (line_id)"""))
def _(spark, sf):
    dims, both = lines(spark, sf), runs(spark, sf)
    rows = grown(spark, sf, both, dims)
    return R.summary_metrics(rows, current(spark, sf, both[1], dims), P.project(rows, current(spark, sf, rows, dims))).select(
        "line_id", "n_features", "n_internal", "n_external", rd("max_depth_pct"), "max_depth_feature_id", rd("p95_internal"),
        rd("p95_external"), "n_erf_ge_1", rd("max_erf"), "max_erf_joint", "n_within_horizon", "n_immediate", "n_scheduled",
        "n_monitor", rd("internal_pct"), rd("deep_pct"),
    )


# --- series ----------------------------------------------------------------------------------------------------

@query("depth_histogram", sql("a2 lines", """
SELECT l.line_id, s.surface, CAST(b.bin AS INTEGER) AS bin, count(a.source_row) AS n FROM lines l, (VALUES ('internal'), ('external')) AS s(surface),
  (SELECT unnest(range(10)) AS bin) b LEFT JOIN a2 a ON a.line_id = l.line_id AND a.surface = s.surface AND least(floor(a.depth_pct_wt / 10.0), 9) = b.bin
GROUP BY 1, 2, 3"""))
def _(spark, sf):
    return R.depth_histogram(I.assessable(T.features(spark, sf)), T.lines(spark, sf))


def _histogram(value: str, low: str, high: str, table: str) -> str:
    return f"""
SELECT m.line_id, CAST(b.bin AS INTEGER) AS bin, {r('m.lo')} AS low, {r('m.hi')} AS high, count(a.source_row) AS n
FROM (SELECT line_id, {low} AS lo, {high} AS hi FROM {table} GROUP BY 1) m, (SELECT unnest(range(20)) AS bin) b
LEFT JOIN {table} a ON a.line_id = m.line_id AND least(floor((a.{value} - m.lo) / (m.hi - m.lo) * 20), 19) = b.bin GROUP BY 1, 2, 3, 4"""


@query("length_histogram", sql("a2", _histogram("length_mm", "0.0", "greatest(200.0, max(length_mm))", "a2")))
def _(spark, sf):
    return R.length_histogram(I.assessable(T.features(spark, sf))).select("line_id", "bin", rd("low"), rd("high"), "n")


@query("growth_histogram", sql("grown", _histogram("cgr", "min(cgr)", "max(cgr)", "grown")))
def _(spark, sf):
    return R.equal_width_histogram(grown(spark, sf), "cgr_mm_yr").select("line_id", "bin", rd("low"), rd("high"), "n")


@query("orientation_rose", sql("a2 lines", """
SELECT l.line_id, CAST(s.sector AS INTEGER) AS sector, count(a.source_row) AS n FROM lines l, (SELECT unnest(range(12)) AS sector) s
LEFT JOIN a2 a ON a.line_id = l.line_id AND least(floor(fmod(fmod(3.0 - a.clock_decimal_hours, 12.0) + 12.0, 12.0)), 11) = s.sector GROUP BY 1, 2"""))
def _(spark, sf):
    return R.orientation_rose(I.assessable(T.features(spark, sf)), T.lines(spark, sf))


@query("erf_scatter", sql("ctl", f"""
SELECT source_row, {r('wt_mm')} AS wall_mm, {r('pct')} AS depth_pct_wt, {r('cerf')} AS erf FROM ctl"""))
def _(spark, sf):
    return R.erf_scatter(current(spark, sf)).select("source_row", rd("wall_mm"), rd("depth_pct_wt"), rd("erf"))


@query("repair_timeline", sql("predicted", """
SELECT y.line_id, CAST(y.year AS INTEGER) AS year, count(*) FILTER (p.repair_trigger = 'DEPTH_80') AS by_depth,
  count(*) FILTER (p.repair_trigger = 'ERF_1.0') AS by_erf
FROM (SELECT line_id, unnest(range(max(repair_year_offset) + 1)) AS year FROM predicted GROUP BY 1) y
JOIN predicted p ON p.line_id = y.line_id AND p.repair_year_offset <= y.year GROUP BY 1, 2
UNION ALL SELECT y.line_id, CAST(y.year AS INTEGER), 0, 0
FROM (SELECT line_id, unnest(range(min(repair_year_offset))) AS year FROM predicted GROUP BY 1) y"""))
def _(spark, sf):
    return R.repair_timeline(kept(predicted(spark, sf).select("line_id", "repair_trigger", "repair_year_offset")))


@query("repairs_per_year", sql("predicted", """
SELECT y.line_id, CAST(y.year AS INTEGER) AS year, count(p.source_row) AS n FROM (SELECT line_id, unnest(range(11)) AS year FROM predicted GROUP BY 1) y
LEFT JOIN predicted p ON p.line_id = y.line_id AND p.repair_year_offset = y.year GROUP BY 1, 2"""))
def _(spark, sf):
    return R.repairs_per_year(kept(predicted(spark, sf).select("line_id", "repair_trigger", "repair_year_offset")))


# --- dates -----------------------------------------------------------------------------------------------------

@query("inspection_intervals", """
SELECT event_id, round((d2 - d1) / 365.25::DOUBLE, 6) + 0.0 AS years, d2 + CAST(floor(h * 365.25::DOUBLE) AS INTEGER) AS horizon_end,
  CASE WHEN d2 <= d1 THEN 'invalid' WHEN (d2 - d1) / 365.25::DOUBLE < 0.5::DOUBLE OR (d2 - d1) / 365.25::DOUBLE > 15.0::DOUBLE THEN 'unusual' ELSE 'ok' END AS status
FROM (SELECT event_id, DATE '2015-06-30' AS d1, DATE '2015-01-01' + CAST(event_id % 7000 AS INTEGER) AS d2, event_id % 15 AS h FROM events)""")
def _(spark, sf):
    rows = T.table(spark, sf, "events").select(
        "event_id", F.lit("2015-06-30").cast("date").alias("d1"),
        F.date_add(F.lit("2015-01-01").cast("date"), (F.col("event_id") % 7000).cast("int")).alias("d2"), (F.col("event_id") % 15).alias("h"),
    )
    years = dates.years_between(F.col("d1"), F.col("d2"))
    return rows.select(
        "event_id", (F.round(years, 6) + 0.0).alias("years"), dates.add_years(F.col("d2"), F.col("h")).alias("horizon_end"),
        dates.interval_status(years).alias("status"),
    )


# --- chain -----------------------------------------------------------------------------------------------------

@query("line_verdicts")
def _(spark, sf):
    return C.verdicts(assessed_lines(spark, sf))


@query("line_dashboard")
def _(spark, sf):
    done = assessed_lines(spark, sf)
    return R.dashboard(done.alignment, done.match_summary, done.current, done.predictions, done.report)
