"""Queries of the assessment engine: strength, zones, matching, growth, projection, dents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.ctes import CTES, cte, r, sql
from girthline.functions import clock, dates, strength, units
from girthline.operators import assess as A, growth as G, inventory as I, matching as M, project as P, zones as Z
from girthline.session import kept
from girthline.sources import tables as T

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def rd(name: str, places: int = 6):
    return (F.round(F.col(name), places) + 0.0).alias(name)


def rx(expr, name: str, places: int = 6):
    return (F.round(expr, places) + 0.0).alias(name)


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn
    return add


def lines(spark, sf, mode="wt") -> DataFrame:
    """Properties of the lines, kept: Spark then knows how few they are, and moves no features to join them."""
    return kept(T.lines(spark, sf, mode).withColumn("years_between", dates.years_between(F.col("run1_date"), F.col("run2_date"))))


# --- inventory -------------------------------------------------------------------------------------------------

@query("assessable_features", sql("a2", "SELECT line_id, source_row, anomaly_id, feature_identification FROM a2"))
def _(spark, sf):
    return I.assessable(T.features(spark, sf)).select("line_id", "source_row", "anomaly_id", "feature_identification")


@query("features_in_one_joint", sql("f2", "SELECT line_id, source_row, joint_number FROM f2 WHERE joint_number = 400"))
def _(spark, sf):
    return I.in_joint(T.features(spark, sf), 400).select("line_id", "source_row", "joint_number")


@query("circumferential_eligibility", sql("f2", """
SELECT source_row, CASE WHEN dimension_class IN ('CIGR', 'CISL') THEN TRUE WHEN dimension_class <> 'UNDEFINED' THEN FALSE
  WHEN contains(lower(raw_description), 'circumferential') THEN TRUE ELSE width_mm > length_mm END AS eligible FROM f2"""))
def _(spark, sf):
    return T.features(spark, sf).select("source_row", I.is_circumferential().alias("eligible"))


# --- strength --------------------------------------------------------------------------------------------------

_FFP = """SELECT source_row, {pf} AS pf_kgcm2, {sop} AS sop_kgcm2, {erf} AS erf, {fol} AS folias_factor_m, {zz} AS z_value,
  {flow} AS flow_stress_mpa, {area} AS area_metal_loss_ratio, branch AS branch_used FROM ffp WHERE method = '{m}'"""


def _method_sql(method: str) -> str:
    return sql("ffp", _FFP.format(
        m=method, pf=r("pf_kgcm2"), sop=r("sop_kgcm2"), erf=r("erf"), fol=r("folias"),
        zz="NULL::DOUBLE" if method == "Kastner" else r("z"), flow=r("flow"), area=r("area", 9),
    ))


def _method(method: str):
    def run(spark, sf):
        rows = A.assess(T.features(spark, sf), T.lines(spark, sf), primary="B31G_Original" if method == "Kastner" else method)
        return A.long_results(rows).where(F.col("method") == method).select(
            "source_row", rd("pf_kgcm2"), rd("sop_kgcm2"), rd("erf"), rd("folias_factor_m"), rd("z_value"),
            rd("flow_stress_mpa"), rd("area_metal_loss_ratio", 9), "branch_used",
        )
    return run


for _name, _m in (
    ("strength_b31g_original", "B31G_Original"), ("strength_b31g_modified", "B31G_Modified"),
    ("strength_rstreng", "RSTRENG"), ("strength_dnv_rp_f101", "DNV_RP_F101"), ("strength_kastner", "Kastner"),
):
    query(_name, _method_sql(_m))(_method(_m))


@query("assessment_all_methods", sql("ffp ctl", f"""
SELECT f.source_row, f.method, {r('f.sop_kgcm2')} AS sop_kgcm2, {r('f.erf')} AS erf, f.zone_idx, f.zone_fallback,
  f.method = 'RSTRENG' AS using_approximate_profile,
  CASE f.method WHEN 'B31G_Original' THEN NOT c.kwins WHEN 'Kastner' THEN c.kwins ELSE FALSE END AS is_controlling,
  CASE WHEN f.method IN ('RSTRENG', 'DNV_RP_F101', 'Kastner') THEN 1 ELSE 0 END AS n_notes
FROM ffp f JOIN ctl c USING (source_row)"""))
def _(spark, sf):
    rows = A.assess(
        T.features(spark, sf), T.lines(spark, sf), "B31G_Original",
        ["B31G_Modified", "RSTRENG", "B31G_Original", "DNV_RP_F101"],
    )
    return A.long_results(rows).select(
        "source_row", "method", rd("sop_kgcm2"), rd("erf"), "zone_idx", "zone_fallback", "using_approximate_profile",
        "is_controlling", F.size("notes").alias("n_notes"),
    )


@query("controlling_assessment", sql("ctl", f"""
SELECT line_id, source_row, cmethod AS method, {r('csop')} AS sop_kgcm2, {r('cerf')} AS erf FROM ctl"""))
def _(spark, sf):
    rows = A.controlling(A.assess(T.features(spark, sf), T.lines(spark, sf)))
    return rows.select("line_id", "source_row", "method", rd("sop_kgcm2"), rd("erf"))


@query("assessment_rejects", sql("f2", """
SELECT source_row, 'not_metal_loss' AS reason FROM f2 WHERE feature_identification IN ('DENT', 'CRAC')"""))
def _(spark, sf):
    return A.rejects(A.screen(T.features(spark, sf), T.lines(spark, sf))).select("source_row", "reason")


@query("assessment_findings", sql("ffp", """
SELECT method, code, count(*) AS n FROM (
  SELECT method, unnest(list_filter([
    CASE WHEN erf >= 1.0 THEN 'ERF_EXCEEDS_1' END, CASE WHEN pct >= 80.0 THEN 'DEPTH_EXCEEDS_80' END,
    CASE WHEN method <> 'Kastner' AND length_mm < wt_mm THEN 'VERY_SHORT_DEFECT' END,
    CASE WHEN method = 'B31G_Original' AND z > 50.0 THEN 'LONG_DEFECT_OUTSIDE_B31G' END,
    CASE WHEN zone_fallback THEN 'MAOP_ZONE_NOT_FOUND' END], lambda c : c IS NOT NULL)) AS code
  FROM ffp WHERE method IN ('B31G_Original', 'Kastner', 'DNV_RP_F101')) GROUP BY 1, 2"""))
def _(spark, sf):
    rows = A.assess(T.features(spark, sf), T.lines(spark, sf), "B31G_Original", ["DNV_RP_F101"])
    return A.assessment_flags(A.long_results(rows)).groupBy("method", "code").agg(F.count(F.lit(1)).alias("n"))


@query("safe_pressure_units", sql("ctl", f"""
SELECT source_row, {r('csop')} AS kgcm2, {r('csop / (100000.0 / 98066.5)')} AS bar,
  {r('csop / (6894.757293168361 / 98066.5)')} AS psi, {r('csop / (1000000.0 / 98066.5)')} AS mpa,
  {r('csop / (100000.0 / 98066.5) * (100000.0 / 98066.5)')} AS from_bar,
  {r('csop / (6894.757293168361 / 98066.5) * (6894.757293168361 / 98066.5)')} AS from_psi FROM ctl"""))
def _(spark, sf):
    rows = A.controlling(A.assess(T.features(spark, sf), T.lines(spark, sf)))
    p = F.col("sop_kgcm2")
    return rows.select(
        "source_row", rx(p, "kgcm2"), rx(units.kgcm2_to_bar(p), "bar"), rx(units.kgcm2_to_psi(p), "psi"),
        rx(units.kgcm2_to_mpa(p), "mpa"), rx(units.bar_to_kgcm2(units.kgcm2_to_bar(p)), "from_bar"),
        rx(units.psi_to_kgcm2(units.kgcm2_to_psi(p)), "from_psi"),
    )


# --- zones -----------------------------------------------------------------------------------------------------

@query("zone_by_wall_thickness", sql("placed", "SELECT source_row, zone_idx, maop_kgcm2, zone_fallback FROM placed"))
def _(spark, sf):
    rows = Z.with_zone(T.features(spark, sf), T.lines(spark, sf))
    return rows.select("source_row", "zone_idx", F.col("zone.maop_kgcm2").alias("maop_kgcm2"), "zone_fallback")


@query("zone_by_chainage", sql("cplaced", "SELECT source_row, zone_idx, maop_kgcm2, zone_fallback FROM cplaced"))
def _(spark, sf):
    rows = Z.with_zone(T.features(spark, sf), T.lines(spark, sf, "chainage"))
    return rows.select("source_row", "zone_idx", F.col("zone.maop_kgcm2").alias("maop_kgcm2"), "zone_fallback")


@query("zone_containment", sql("cplaced", "SELECT source_row, NOT zone_fallback AS naturally_in_zone FROM cplaced"))
def _(spark, sf):
    return Z.in_zone(T.features(spark, sf), T.lines(spark, sf, "chainage")).select("source_row", "naturally_in_zone")


@query("zone_rule_violations", sql("", """
WITH z AS (SELECT s_suppkey AS line_id, i AS zone_idx, CASE WHEN s_suppkey % 3 = 0 THEN 'wt' ELSE 'chainage' END AS mode,
    CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 3 = 0 THEN 6.0 + i END AS wlo,
    CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 7 <> 0 THEN 7.0 + i END AS whi,
    CASE WHEN s_suppkey % 3 <> 0 OR s_suppkey % 11 = 0 THEN i * 100.0 - CASE WHEN s_suppkey % 4 = 0 THEN 10.0 ELSE 0.0 END END AS clo,
    CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 13 <> 0 THEN i * 100.0 + s_suppkey % 9 * 30.0 - 20.0 END AS chi
  FROM supplier, (SELECT unnest(range(3)) AS i)),
w AS (SELECT *, lag(chi) OVER (PARTITION BY line_id ORDER BY clo, zone_idx) AS prev FROM z)
SELECT line_id, CAST(zone_idx AS INTEGER) AS zone_idx, violation FROM (
  SELECT line_id, zone_idx, unnest([
    CASE WHEN mode = 'wt' AND (clo IS NOT NULL OR chi IS NOT NULL) THEN 'chainage_bounds_in_wt_mode' END,
    CASE WHEN mode = 'wt' AND clo IS NULL AND chi IS NULL AND (wlo IS NULL OR whi IS NULL) THEN 'missing_wt_bounds' END,
    CASE WHEN mode = 'chainage' AND (wlo IS NOT NULL OR whi IS NOT NULL) THEN 'wt_bounds_in_chainage_mode' END,
    CASE WHEN mode = 'chainage' AND wlo IS NULL AND whi IS NULL AND (clo IS NULL OR chi IS NULL) THEN 'missing_chainage_bounds' END,
    CASE WHEN mode = 'chainage' AND clo < 0 THEN 'negative_chainage' END,
    CASE WHEN mode = 'chainage' AND chi < clo THEN 'max_below_min' END,
    CASE WHEN mode = 'chainage' AND clo < prev THEN 'overlap' END]) AS violation FROM w) WHERE violation IS NOT NULL"""))
def _(spark, sf):
    k, i = F.col("line_id"), F.col("zone_idx")
    ids = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("line_id"))
    zones = ids.withColumn("zone_idx", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumns({
        "wt_mm_min": F.when((k % 5 == 0) | (k % 3 == 0), 6.0 + i),
        "wt_mm_max": F.when((k % 3 == 0) & (k % 7 != 0), 7.0 + i),
        "chainage_m_min": F.when((k % 3 != 0) | (k % 11 == 0), i * 100.0 - F.when(k % 4 == 0, 10.0).otherwise(0.0)),
        "chainage_m_max": F.when((k % 3 != 0) & (k % 13 != 0), i * 100.0 + k % 9 * 30.0 - 20.0),
        "design_factor": F.lit(0.72), "maop_kgcm2": F.lit(40.0),
    })
    modes = ids.withColumn("maop_zoning_mode", F.when(k % 3 == 0, "wt").otherwise("Chainage "))
    return Z.zone_violations(zones, modes)


_WALLS = """walls AS (SELECT line_id, wt_mm, 40.0 + 8.0 * (CASE wt_mm WHEN 6.4 THEN 0 ELSE line_id % 3 END)
  + 5.0 * (CASE wt_mm WHEN 8.7 THEN line_id % 2 ELSE 0 END) AS maop FROM (SELECT DISTINCT line_id, wt_mm FROM f2))"""


@query("zones_from_wall_list", sql("f2", f"""
, {_WALLS}, w AS (SELECT *, lag(wt_mm) OVER (PARTITION BY line_id ORDER BY wt_mm) AS pw,
    lag(maop) OVER (PARTITION BY line_id ORDER BY wt_mm) AS pm FROM walls),
s AS (SELECT *, sum(CASE WHEN pm IS NULL OR pm <> maop THEN 1 ELSE 0 END) OVER (PARTITION BY line_id ORDER BY wt_mm) - 1 AS idx FROM w),
g AS (SELECT line_id, idx, min(wt_mm) AS a, max(wt_mm) AS b, min(maop) AS maop,
    min(CASE WHEN pm IS NULL OR pm <> maop THEN pw END) AS before FROM s GROUP BY 1, 2),
h AS (SELECT *, coalesce(round((before + a) / 2.0, 3), round(greatest(0.1, a - 0.5), 3)) AS lo FROM g)
SELECT line_id, CAST(idx AS INTEGER) AS zone_idx, lo AS wt_mm_min,
  coalesce(lead(lo) OVER (PARTITION BY line_id ORDER BY idx), round(b + 0.5, 3)) AS wt_mm_max, 0.72 AS design_factor,
  maop AS maop_kgcm2 FROM h""").replace(")\n\n, walls", "),\nwalls"))
def _(spark, sf):
    w, k = F.col("wt_mm"), F.col("line_id")
    walls = T.features(spark, sf).select("line_id", "wt_mm").distinct().withColumns({
        "maop_kgcm2": 40.0 + 8.0 * F.when(w == 6.4, 0).otherwise(k % 3) + 5.0 * F.when(w == 8.7, k % 2).otherwise(0),
        "design_factor": F.lit(0.0),
    })
    return Z.build_zones(walls)


@query("thinnest_wall_per_zone", sql("zones placed", """
SELECT z.line_id, z.zone_idx, min(p.wt_mm) AS wt_min_mm FROM zones z LEFT JOIN
  (SELECT * FROM placed WHERE feature_identification NOT IN ('DENT', 'CRAC')) p
  ON z.line_id = p.line_id AND z.zone_idx = p.zone_idx GROUP BY 1, 2"""))
def _(spark, sf):
    placed = Z.with_zone(I.assessable(T.features(spark, sf)), T.lines(spark, sf))
    return Z.thinnest_per_zone(placed, T.zones(spark, sf)).select("line_id", "zone_idx", "wt_min_mm")


@query("design_pressure_check", sql("zones placed", f"""
SELECT line_id, zone_idx, {r('lim')} AS design_maop_kgcm2, maop > lim * 1.05 AS exceeds_design FROM (
  SELECT z.line_id, z.zone_idx, any_value(z.maop_kgcm2) * 2.0 AS maop,
    2.0 * 482.0 * min(p.wt_mm) / 711.0 * 0.72 * (1.0 / 0.0980665) AS lim
  FROM zones z JOIN (SELECT * FROM placed WHERE feature_identification NOT IN ('DENT', 'CRAC')) p
    ON z.line_id = p.line_id AND z.zone_idx = p.zone_idx GROUP BY 1, 2)"""))
def _(spark, sf):
    placed = Z.with_zone(I.assessable(T.features(spark, sf)), T.lines(spark, sf))
    zones = T.zones(spark, sf).withColumn("maop_kgcm2", F.col("maop_kgcm2") * 2.0)
    checked = Z.design_check(Z.thinnest_per_zone(placed, zones), T.lines(spark, sf))
    return checked.select("line_id", "zone_idx", rd("design_maop_kgcm2"), "exceeds_design")


@query("yield_strength_from_grade", """
SELECT s_suppkey AS line_id, CASE WHEN s_suppkey % 2 = 0 THEN 450.0::DOUBLE ELSE CASE s_suppkey % 9
  WHEN 0 THEN 290.0 WHEN 1 THEN 317.0 WHEN 2 THEN 358.0 WHEN 3 THEN 386.0 WHEN 4 THEN 414.0 WHEN 5 THEN 448.0 WHEN 6 THEN 482.0
  WHEN 7 THEN 552.0 ELSE 0.0 END::DOUBLE END AS smys_mpa FROM supplier""")
def _(spark, sf):
    k = F.col("s_suppkey")
    grades = F.array(*[F.lit(f"API 5L {g}") for g in ("X42", "X46", "X52", "X56", "X60", "X65", "X70", "X80", "Z1")])
    dims = T.table(spark, sf, "supplier").select(
        k.alias("line_id"), F.when(k % 2 == 0, 450.0).otherwise(0.0).alias("smys_mpa"),
        grades[(k % 9).cast("int")].alias("material_grade"),
    )
    return Z.with_smys(dims).select("line_id", "smys_mpa")


@query("zone_display_text", sql("lines", """
SELECT line_id, '40.0 / 48.0 kg/cm² (by WT zone)' AS maop_display, '0.72' AS design_factor_display FROM lines"""))
def _(spark, sf):
    return Z.zone_display(T.zones(spark, sf), T.lines(spark, sf))


# --- matching --------------------------------------------------------------------------------------------------

def matches(spark, sf):
    return M.match(T.features(spark, sf, 1), T.features(spark, sf, 2), T.true_joint_pairs(spark, sf))


@query("match_costs", sql("costed", f"""
SELECT old_source_row, new_source_row, {r('axial')} AS axial_m, {r('turn')} AS clock_h, {r('match_score')} AS match_score FROM costed"""))
def _(spark, sf):
    pair = M.candidates(M.sided(T.features(spark, sf, 1), T.features(spark, sf, 2), T.true_joint_pairs(spark, sf)), 1.0)
    axial, turn, cost = M.pair_cost(F.col("o"), F.col("n"))
    return pair.select(
        F.col("o.source_row").alias("old_source_row"), F.col("n.source_row").alias("new_source_row"),
        rx(axial, "axial_m"), rx(turn, "clock_h"), rx(cost, "match_score"),
    )


@query("match_features", sql("matched", f"""
SELECT line_id, old_joint, old_source_row, new_source_row, {r('match_score')} AS match_score, relaxation_level,
  {r('1.0 - match_score / (CASE relaxation_level WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 ELSE 1.5 END)')} AS confidence FROM matched"""))
def _(spark, sf):
    return matches(spark, sf).select(
        "line_id", "old_joint", "old_source_row", "new_source_row", rd("match_score"), "relaxation_level", rd("confidence")
    )


_TWIN = """SELECT f.* REPLACE (source_row * 2 + k AS source_row, upstream_weld_dist_m + k * ({} + {} * (source_row % {})) AS upstream_weld_dist_m,
  fmod(clock_decimal_hours + k * {}, 12.0) AS clock_decimal_hours) FROM {} f, (VALUES (0), (1)) AS x(k)"""
cte("dense_1", "a1", _TWIN.format(0.3, 0.0013, 89, 0.21, "a1"))
cte("dense_2", "a2", _TWIN.format(0.22, 0.0017, 83, 0.13, "a2"))
cte("dense_cand", "dense_1 dense_2", CTES["cand"][1].replace("a1 o", "dense_1 o").replace("a2 n", "dense_2 n"))
cte("dense_costed", "dense_cand", CTES["costed"][1].replace("FROM cand", "FROM dense_cand"))


def _dense_sql() -> str:
    """Every feature has a twin a little further on. Candidates fall into components; each pass tries all matchings of every component, takes one with the
    most pairs at the least cost, and puts back what is above the ceiling."""
    head = """, feas AS MATERIALIZED (SELECT line_id, old_joint, old_source_row AS o, new_source_row AS n, axial, turn, match_score AS c FROM dense_costed WHERE axial <= 1.0 AND turn <= 1.5),
    reach AS (SELECT DISTINCT o, o AS r FROM feas UNION SELECT b.o, reach.r FROM reach JOIN feas a ON a.o = reach.o JOIN feas b ON b.n = a.n),
    comp AS (SELECT o, min(r) AS comp FROM reach GROUP BY o),"""
    steps, used = [], "SELECT NULL::BIGINT AS o, NULL::BIGINT AS n WHERE false"
    for k, (axial, turn, ceiling) in enumerate(M.PASSES, start=1):
        steps.append(f"""
    p{k} AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY o, n) AS e FROM feas JOIN comp USING (o)
      WHERE axial <= {axial} AND turn <= {turn} AND o NOT IN (SELECT o FROM ({used})) AND n NOT IN (SELECT n FROM ({used}))),
    m{k} AS (SELECT DISTINCT comp, CAST(-1 AS BIGINT) AS last, CAST([] AS BIGINT[]) AS ns, CAST([] AS BIGINT[]) AS es, 0 AS size, CAST(0 AS HUGEINT) AS cost, CAST(0 AS HUGEINT) AS square FROM p{k}
      UNION ALL SELECT m.comp, p.o, list_append(ns, p.n), list_append(es, p.e), size + 1, cost + CAST(round(p.c * 1e9) AS BIGINT), square + CAST(round(p.c * 1e4) ** 2 AS BIGINT) FROM m{k} m JOIN p{k} p ON p.comp = m.comp AND p.o > m.last AND NOT list_contains(ns, p.n)),
    b{k} AS (SELECT unnest(es) AS e FROM (SELECT * FROM m{k} QUALIFY row_number() OVER (PARTITION BY comp ORDER BY size DESC, cost, square) = 1)),
    x{k} AS MATERIALIZED (SELECT line_id, old_joint, o, n, c, {k} AS relaxation_level FROM p{k} JOIN b{k} USING (e) WHERE c <= {ceiling})""")
        used = " UNION ALL ".join(f"SELECT o, n FROM x{i}" for i in range(1, k + 1))
    every = " UNION ALL ".join(f"SELECT * FROM x{k}" for k in range(1, len(M.PASSES) + 1))
    body = f"SELECT line_id, old_joint, o AS old_source_row, n AS new_source_row, {r('c')} AS match_score, relaxation_level FROM ({every})"
    return sql("dense_costed", head + ",".join(steps) + body).replace("\n,", ",", 1).replace("WITH ", "WITH RECURSIVE ", 1)


def dense_features(spark, sf, run: int):
    """Features with a twin each, so that most islands leave a choice."""
    a, b, c, d = ((0.3, 0.0013, 89, 0.21), (0.22, 0.0017, 83, 0.13))[run - 1]
    rows = T.features(spark, sf, run).withColumn("_k", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.withColumns({
        "upstream_weld_dist_m": F.col("upstream_weld_dist_m") + F.col("_k") * (F.lit(a) + F.lit(b) * (F.col("source_row") % c)),
        "clock_decimal_hours": (F.col("clock_decimal_hours") + F.col("_k") * F.lit(d)) % 12.0,
        "source_row": F.col("source_row") * 2 + F.col("_k"),
    }).drop("_k")


@query("match_dense_features", _dense_sql())
def _(spark, sf):
    found = M.match(dense_features(spark, sf, 1), dense_features(spark, sf, 2), T.true_joint_pairs(spark, sf))
    return found.select("line_id", "old_joint", "old_source_row", "new_source_row", rd("match_score"), "relaxation_level")


@query("unmatched_old_features", sql("a1 matched", """
SELECT source_row FROM a1 WHERE source_row NOT IN (SELECT old_source_row FROM matched)"""))
def _(spark, sf):
    return M.unmatched(T.features(spark, sf, 1), matches(spark, sf), "old").select("source_row")


@query("unmatched_new_features", sql("a2 matched", """
SELECT source_row FROM a2 WHERE source_row NOT IN (SELECT new_source_row FROM matched)"""))
def _(spark, sf):
    return M.unmatched(T.features(spark, sf, 2), matches(spark, sf), "new").select("source_row")


_SUMMARY = """
SELECT line_id, n_old, n_new, coalesce(matched, 0) AS matched, coalesce(m1, 0) AS matched_pass_1, coalesce(m2, 0) AS matched_pass_2,
  coalesce(m3, 0) AS matched_pass_3, c_old, c_new, coalesce(matched, 0) / greatest(least(n_old, n_new), 1) AS rate
FROM (SELECT line_id, count(*) AS n_new, count(*) FILTER (is_cluster_parent) AS c_new FROM a2 GROUP BY 1)
LEFT JOIN (SELECT line_id, count(*) AS n_old, count(*) FILTER (is_cluster_parent) AS c_old FROM a1 GROUP BY 1) USING (line_id)
LEFT JOIN (SELECT line_id, count(*) AS matched, count(*) FILTER (relaxation_level = 1) AS m1,
  count(*) FILTER (relaxation_level = 2) AS m2, count(*) FILTER (relaxation_level = 3) AS m3 FROM matched GROUP BY 1) USING (line_id)"""


@query("match_summary", sql("a1 a2 matched", f"""
SELECT line_id, n_old, n_new, matched, matched_pass_1, matched_pass_2, matched_pass_3, {r('rate', 9)} AS match_rate,
  n_old - matched AS unmatched_old, n_new - matched AS unmatched_new, 1.0 AS final_axial_m, 1.5 AS final_max_cost FROM ({_SUMMARY})"""))
def _(spark, sf):
    summary = M.match_summary(T.features(spark, sf, 1), T.features(spark, sf, 2), matches(spark, sf))
    return summary.select(
        "line_id", "n_old", "n_new", "matched", "matched_pass_1", "matched_pass_2", "matched_pass_3",
        rd("match_rate", 9), "unmatched_old", "unmatched_new", "final_axial_m", "final_max_cost",
    )


@query("match_findings", sql("a1 a2 matched", f"""
SELECT line_id, code FROM (SELECT line_id, unnest([
  CASE WHEN c_old = 0 AND c_new = 0 THEN 'NO_CLUSTERS_IN_EITHER_RUN' END,
  CASE WHEN n_old > 0 AND n_new > 0 AND rate < 0.9 THEN 'LOW_DEFECT_MATCH_RATE' END]) AS code FROM ({_SUMMARY}))
WHERE code IS NOT NULL
UNION ALL SELECT line_id + 100000, 'NO_CLUSTERS_IN_EITHER_RUN' FROM (SELECT DISTINCT line_id FROM a2 WHERE NOT is_cluster_parent)
UNION ALL SELECT line_id + 100000, 'LOW_DEFECT_MATCH_RATE' FROM (SELECT DISTINCT line_id FROM a1 WHERE NOT is_cluster_parent)"""))
def _(spark, sf):
    old, new, found = T.features(spark, sf, 1), T.features(spark, sf, 2), matches(spark, sf)
    shift = (F.col("line_id") + 100000).alias("line_id")
    whole = M.match_codes(M.match_summary(old, new, found))
    # The same lines without cluster parents and without any match raise both findings.
    bare = M.match_codes(M.match_summary(
        old.where(~F.col("is_cluster_parent")), new.where(~F.col("is_cluster_parent")), found.where(F.lit(False))
    ))
    return whole.unionByName(bare.select(shift, "code"))


@query("depth_changes", sql("matched", f"""
SELECT old_source_row, new_source_row, {r('nd - od')} AS depth_delta_pct_wt,
  {r('nd / 100.0 * nwt - od / 100.0 * owt')} AS depth_delta_mm FROM matched"""))
def _(spark, sf):
    return M.depth_changes(matches(spark, sf), T.features(spark, sf)).select(
        "old_source_row", "new_source_row", rd("depth_delta_pct_wt"), rd("depth_delta_mm")
    )


@query("clock_distance", sql("cand", f"SELECT old_source_row, new_source_row, {r('turn')} AS clock_h FROM cand"))
def _(spark, sf):
    old = I.assessable(T.features(spark, sf, 1)).select(
        "line_id", (F.col("joint_number") + 30).alias("joint_number"), F.col("source_row").alias("old_source_row"),
        F.col("clock_decimal_hours").alias("_oc"), F.col("upstream_weld_dist_m").alias("_ow"),
    )
    new = I.assessable(T.features(spark, sf, 2)).withColumnRenamed("source_row", "new_source_row")
    near = F.abs(F.col("_ow") - F.col("upstream_weld_dist_m")) <= 1.0
    return new.join(old, ["line_id", "joint_number"]).where(near).select(
        "old_source_row", "new_source_row", rx(clock.distance(F.col("_oc"), F.col("clock_decimal_hours")), "clock_h")
    )


# --- growth ----------------------------------------------------------------------------------------------------

def runs(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Features of the older and the newer run, from one reading of the table."""
    rows = kept(T.base(spark, sf))
    return T.features(spark, sf, 1, rows), T.features(spark, sf, 2, rows)


def grown(spark, sf, features: tuple[DataFrame, DataFrame] | None = None, dims: DataFrame | None = None, **settings):
    old, new = features or runs(spark, sf)
    matched = kept(M.match(old, new, T.true_joint_pairs(spark, sf)))
    return G.growth(I.assessable(new), matched, lines(spark, sf) if dims is None else dims, keep=kept, **settings)


@query("growth_feature_rates", sql("rated", f"""
SELECT source_row, is_matched, {r('old_mm')} AS depth_old_used_mm, {r('new_mm')} AS depth_new_mm, {r('own')} AS feature_cgr_mm_yr
FROM rated"""))
def _(spark, sf):
    rates = G.feature_rates(I.assessable(T.features(spark, sf)), matches(spark, sf), lines(spark, sf))
    return rates.select("source_row", "is_matched", rd("depth_old_used_mm"), rd("depth_new_mm"), rd("feature_cgr_mm_yr"))


@query("growth_population_p95", sql("p95", f"SELECT line_id, surface, n, {r('p95', 9)} AS population_p95_mm_yr FROM p95"))
def _(spark, sf):
    rates = G.feature_rates(I.assessable(T.features(spark, sf)), matches(spark, sf), lines(spark, sf))
    return G.population_p95(rates).select("line_id", "surface", "n", rd("population_p95_mm_yr", 9))


@query("growth_hybrid", sql("grown", f"""
SELECT source_row, {r('cgr')} AS cgr_mm_yr, mode_used, {r('p95')} AS population_p95_mm_yr FROM grown"""))
def _(spark, sf):
    return grown(spark, sf).select("source_row", rd("cgr_mm_yr"), "mode_used", rd("population_p95_mm_yr"))


@query("growth_population_only", sql("rated", f"""
SELECT source_row, {r('CASE WHEN p > 0 THEN p ELSE own END')} AS cgr_mm_yr,
  CASE WHEN p > 0 THEN 'population_only' ELSE 'feature_specific' END AS mode_used
FROM rated LEFT JOIN (SELECT line_id, quantile_cont(own, 0.95) AS p FROM rated GROUP BY 1 HAVING count(*) > 1) USING (line_id)"""))
def _(spark, sf):
    return grown(spark, sf, mode="population_only", split_by_surface=False).select("source_row", rd("cgr_mm_yr"), "mode_used")


@query("growth_commissioning_baseline", sql("a2", f"""
SELECT source_row, {r("depth_pct_wt / 100.0 * wt_mm / ((DATE '2023-03-15' - DATE '2018-12-15') / 365.25)")} AS cgr_mm_yr FROM a2"""))
def _(spark, sf):
    empty = T.features(spark, sf, 1).where(F.lit(False))
    new = T.features(spark, sf, 2)
    found = M.match(empty, new, T.true_joint_pairs(spark, sf))
    rows = G.growth(
        I.assessable(new), found, lines(spark, sf).withColumn("unmatched_depth_pct", F.lit(0.0)), mode="feature_specific"
    )
    return rows.select("source_row", rd("cgr_mm_yr"))


@query("growth_findings", sql("grown", """
SELECT code, count(*) AS n FROM (SELECT unnest([
  CASE WHEN NOT is_matched THEN 'UNMATCHED_RUN2' END, CASE WHEN delta < 0 THEN 'NEGATIVE_GROWTH' END,
  CASE WHEN is_matched AND abs(delta) < 10.0 / 100.0 * wt_mm THEN 'DEPTH_BELOW_TOL' END,
  CASE WHEN own > 1.0 THEN 'EXTREME_CGR' END,
  CASE WHEN mode_used = 'population_floor' THEN 'POPULATION_FLOOR_APPLIED' END]) AS code FROM grown)
WHERE code IS NOT NULL GROUP BY 1"""))
def _(spark, sf):
    return G.growth_flags(grown(spark, sf)).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


# --- projection ------------------------------------------------------------------------------------------------

def predicted(spark, sf) -> DataFrame:
    dims = lines(spark, sf)
    rows = grown(spark, sf, dims=dims)
    # The assessment is row-local, so it runs on the growth rows and the projection needs no join.
    assessed = A.assess(I.assessable(rows), dims)
    return P.project(rows, P.current_state(assessed, dims))


@query("repair_predictions", sql("predicted", f"""
SELECT line_id, source_row, method, repair_trigger, repair_year_offset, repair_date AS predicted_repair_date,
  {r('final_depth_mm')} AS final_depth_mm, {r('final_pct')} AS final_depth_pct_wt, {r('final_erf')} AS final_erf,
  {r('final_sop')} AS final_psafe_kgcm2 FROM predicted"""))
def _(spark, sf):
    return predicted(spark, sf).select(
        "line_id", "source_row", "method", "repair_trigger", "repair_year_offset", "predicted_repair_date",
        rd("final_depth_mm"), rd("final_depth_pct_wt"), rd("final_erf"), rd("final_psafe_kgcm2"),
    )


@query("repair_years", sql("assessed_years repairs", f"""
SELECT a.source_row, CAST(a.n AS INTEGER) AS year, {r('a.sop')} AS sop_kgcm2, {r('a.erf')} AS erf
FROM assessed_years a JOIN repairs p USING (source_row) WHERE a.n <= p.last_year"""))
def _(spark, sf):
    return P.repair_years(predicted(spark, sf)).select("source_row", "year", rd("sop_kgcm2"), rd("erf"))


@query("repair_labels", sql("predicted", """
SELECT source_row, CASE WHEN repair_trigger <> 'NONE_WITHIN_HORIZON' THEN strftime(repair_date, '%d-%m-%Y')
  ELSE 'After March 2033' END AS label FROM predicted"""))
def _(spark, sf):
    rows = predicted(spark, sf).withColumn("_end", dates.add_years(F.col("run2_date"), F.col("horizon_years")))
    label = dates.repair_label(F.col("repair_trigger"), F.col("predicted_repair_date"), F.col("_end"))
    return rows.select("source_row", label.alias("label"))


# --- dents -----------------------------------------------------------------------------------------------------

@query("dent_strain", sql("f2", f"""
, g AS (SELECT *, depth_pct_wt * 711.0 / 100.0 AS d FROM f2 WHERE feature_identification = 'DENT'),
e AS (SELECT *, (wt_mm / 2.0) * (1.0 / 355.5 + 1.0 / ((width_mm * width_mm + 4.0 * d * d) / (8.0 * d))) AS e1,
  (wt_mm / 2.0) * (1.0 / ((length_mm * length_mm + 4.0 * d * d) / (8.0 * d))) AS e2,
  0.5 * (d / length_mm) * (d / length_mm) AS e3, 0.5 * (d / width_mm) * (d / width_mm) AS ew FROM g),
s AS (SELECT *, sqrt((e1 + ew) * (e1 + ew) + (e1 + ew) * (e2 + e3) + (e2 + e3) * (e2 + e3)) AS eo,
  sqrt((-e1 - ew) * (-e1 - ew) + (-e1 - ew) * (-e2 + e3) + (-e2 + e3) * (-e2 + e3)) AS ei FROM e)
SELECT source_row, {r('d')} AS depth_mm, {r('e1')} AS e1, {r('e2')} AS e2, {r('e3')} AS e3, {r('ei')} AS ei, {r('eo')} AS eo,
  {r('greatest(ei, eo) * 100.0')} AS resultant_strain_pct,
  CASE WHEN greatest(ei, eo) * 100.0 >= 6.0 THEN 'HIGH_STRAIN_REJECT_CRITERIA' ELSE '' END AS flags FROM s""").replace(
    "FROM base)\n\n, g", "FROM base),\ng"))
def _(spark, sf):
    from girthline.operators.dents import dent_strains

    rows = dent_strains(T.features(spark, sf), T.lines(spark, sf))
    return rows.select(
        "source_row", rd("depth_mm"), rd("e1"), rd("e2"), rd("e3"), rd("ei"), rd("eo"), rd("resultant_strain_pct"),
        F.array_join("flags", " ").alias("flags"),
    )
