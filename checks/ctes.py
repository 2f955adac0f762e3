"""Shared SQL of the oracles: the same derived tables as ``girthline.sources.tables``, written for DuckDB."""

from __future__ import annotations

import re

_LITERAL = re.compile(r"(?<![\w.])(\d+\.\d+(?:[eE][+-]?\d+)?)(?![\w.])")


def doubles(sql: str) -> str:
    """Decimal literals outside quotes become doubles, as in Spark expressions on double columns."""
    parts = sql.split("'")
    return "'".join(_LITERAL.sub(r"(\1::DOUBLE)", p) if i % 2 == 0 else p for i, p in enumerate(parts))


def r(expr: str, places: int = 6) -> str:
    """Rounded for comparison; adding zero drops the sign of a negative zero."""
    return f"(round({expr}, {places}) + 0.0)"


# name -> (names it needs, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: str, body: str) -> None:
    CTES[name] = (tuple(needs.split()), body)


def sql(needs: str, body: str) -> str:
    """A query over named shared tables, with exactly the ones it needs in front."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in CTES[name][0]:
            visit(other)
        ordered.append(name)

    for name in needs.split():
        visit(name)
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered)
    return doubles(f"WITH {head}\n{body}" if head else body)


cte("base", "", """
SELECT l_orderkey AS ok, l_linenumber AS ln, min(l_partkey) AS pk, min(l_suppkey) AS sk, min(l_quantity) AS q,
       min(l_extendedprice) AS ep, min(l_returnflag) AS rf
FROM lineitem GROUP BY 1, 2""")

cte("f2", "base", """
SELECT ok, ln, pk, CAST(ok // 750 AS INTEGER) AS line_id, ok * 10 + ln AS source_row, 'F' || ok || '-' || ln AS anomaly_id,
       CAST((ok % 750) * 10 + 40 AS INTEGER) AS joint_number, (ok % 750) * 12.0 + ln * 1.5 AS abs_distance_m,
       ln * 1.5 AS upstream_weld_dist_m, (pk % 720) / 60.0 AS clock_decimal_hours,
       CASE ok % 3 WHEN 0 THEN 6.4 WHEN 1 THEN 7.1 ELSE 8.7 END AS wt_mm, q * 1.6 AS depth_pct_wt, ep / 180.0 AS length_mm,
       5.0 + (sk * 13) % 300 AS width_mm,
       CASE rf WHEN 'A' THEN 'internal' WHEN 'R' THEN 'external' ELSE 'unknown' END AS surface,
       CASE sk % 20 WHEN 0 THEN 'DENT' WHEN 1 THEN 'CRAC' WHEN 2 THEN 'COCL' WHEN 3 THEN 'UNDEFINED' ELSE 'CORR' END
         AS feature_identification,
       CASE pk % 8 WHEN 0 THEN 'CIGR' WHEN 1 THEN 'CISL' WHEN 2 THEN 'AXGR' WHEN 3 THEN 'AXSL' WHEN 4 THEN 'PITT'
         WHEN 5 THEN 'PINH' WHEN 6 THEN 'GENE' ELSE 'UNDEFINED' END AS dimension_class,
       sk % 20 = 2 AS is_cluster_parent,
       CASE WHEN pk % 50 = 0 THEN 'circumferential groove' ELSE 'metal loss' END AS raw_description
FROM base""")

cte("f1", "f2", """
SELECT ok, ln, line_id, source_row, 'R' || ok || '-' || ln AS anomaly_id, joint_number - 30 AS joint_number, abs_distance_m,
       upstream_weld_dist_m + 0.01 * (ok % 40) AS upstream_weld_dist_m,
       fmod(clock_decimal_hours + 0.04 * (ok % 30), 12.0) AS clock_decimal_hours, wt_mm,
       depth_pct_wt * 0.5 + 0.1 * (ok % 50) AS depth_pct_wt,
       CASE WHEN ok % 11 = 0 THEN 'unknown' ELSE surface END AS surface, feature_identification, is_cluster_parent
FROM f2 WHERE (ok + ln) % 4 <> 0 AND ok % 37 <> 0""")

cte("a2", "f2", "SELECT * FROM f2 WHERE feature_identification NOT IN ('DENT', 'CRAC')")
cte("a1", "f1", "SELECT * FROM f1 WHERE feature_identification NOT IN ('DENT', 'CRAC')")

cte("lines", "", """
SELECT DISTINCT CAST(o_orderkey // 750 AS INTEGER) AS line_id, 711.0 AS diameter_mm, 482.0 AS smys_mpa,
       DATE '2018-12-15' AS run1_date, DATE '2023-03-15' AS run2_date FROM orders""")

cte("zones", "lines", """
SELECT line_id, zone_idx, lo, hi, 0.72 AS design_factor, maop_kgcm2
FROM lines, (VALUES (0, 6.0, 6.8, 40.0), (1, 6.8, 7.5, 48.0)) AS z(zone_idx, lo, hi, maop_kgcm2)""")

cte("cz", "lines", """
SELECT line_id, zone_idx, lo, hi, 0.72 AS design_factor, maop_kgcm2
FROM lines, (VALUES (0, 0.0, 3000.0, 40.0), (1, 3000.0, 6000.0, 48.0)) AS z(zone_idx, lo, hi, maop_kgcm2)""")

cte("placed", "f2 zones", """
SELECT * FROM (
  SELECT f2.*, z.zone_idx, z.design_factor, z.maop_kgcm2, NOT (f2.wt_mm BETWEEN z.lo AND z.hi) AS zone_fallback,
         row_number() OVER (PARTITION BY f2.source_row ORDER BY
           CASE WHEN f2.wt_mm BETWEEN z.lo AND z.hi THEN -1.0 ELSE least(abs(z.lo - f2.wt_mm), abs(z.hi - f2.wt_mm)) END,
           z.zone_idx) AS rn
  FROM f2 JOIN zones z USING (line_id)) WHERE rn = 1""")

cte("cplaced", "f2 cz", """
SELECT * FROM (
  SELECT f2.*, z.zone_idx, z.design_factor, z.maop_kgcm2,
         NOT (f2.abs_distance_m BETWEEN z.lo AND z.hi) AS zone_fallback,
         row_number() OVER (PARTITION BY f2.source_row ORDER BY
           CASE WHEN f2.abs_distance_m BETWEEN z.lo AND z.hi THEN -1.0
                ELSE least(abs(z.lo - f2.abs_distance_m), abs(z.hi - f2.abs_distance_m)) END, z.zone_idx) AS rn
  FROM f2 JOIN cz z USING (line_id)) WHERE rn = 1""")

cte("asm", "placed", """
SELECT p.*, 711.0 AS dd, 482.0 AS sy, depth_pct_wt / 100.0 * wt_mm AS d_mm, length_mm * length_mm / (711.0 * wt_mm) AS z,
       (depth_pct_wt / 100.0 * wt_mm) / wt_mm AS x,
       CASE WHEN dimension_class IN ('CIGR', 'CISL') THEN TRUE WHEN dimension_class <> 'UNDEFINED' THEN FALSE
            WHEN contains(lower(raw_description), 'circumferential') THEN TRUE
            ELSE width_mm > length_mm END AS circ
FROM placed p WHERE feature_identification NOT IN ('DENT', 'CRAC')""")

_K = "(1000000.0 / 98066.5)"

# One row per feature and method with failure pressure in MPa and the intermediate values.
cte("methods", "asm", """
SELECT *, 'B31G_Original' AS method, 1.1 * sy AS flow, CASE WHEN z <= 20.0 THEN sqrt(1.0 + 0.8 * z) END AS folias,
       CASE WHEN z <= 20.0 THEN (2.0 / 3.0) * x ELSE x END AS area, CASE WHEN z <= 20.0 THEN 'low_z' ELSE 'high_z' END AS branch,
       greatest(0.0, 2.0 * (1.1 * sy) * wt_mm / dd * CASE
         WHEN z <= 20.0 THEN (1.0 - (2.0 / 3.0) * x) / (1.0 - (2.0 / 3.0) * x / sqrt(1.0 + 0.8 * z))
         ELSE 1.0 - x END) AS pf FROM asm
UNION ALL BY NAME
SELECT asm.*, m.method, sy + 69.0 AS flow, CASE WHEN z <= 50.0 THEN sqrt(1.0 + 0.6275 * z - 0.003375 * z * z) ELSE 0.032 * z + 3.3 END
       AS folias, 0.85 * x AS area, CASE WHEN z <= 50.0 THEN 'low_z' ELSE 'high_z' END AS branch,
       2.0 * ((sy + 69.0) * (1.0 - 0.85 * x) / (1.0 - 0.85 * x /
         (CASE WHEN z <= 50.0 THEN sqrt(1.0 + 0.6275 * z - 0.003375 * z * z) ELSE 0.032 * z + 3.3 END))) * wt_mm / dd AS pf
FROM asm, (VALUES ('B31G_Modified'), ('RSTRENG')) AS m(method)
UNION ALL BY NAME
SELECT *, 'DNV_RP_F101' AS method, sy + 110.0 AS flow, sqrt(1.0 + 0.31 * z) AS folias, x AS area, '' AS branch,
       2.0 * (sy + 110.0) * wt_mm / (dd - wt_mm) * ((1.0 - x) / (1.0 - x / sqrt(1.0 + 0.31 * z))) AS pf FROM asm
UNION ALL BY NAME
SELECT *, 'Kastner' AS method, 1.1 * sy AS flow, NULL AS folias,
       greatest(0.0, least(1.0, width_mm / (pi() * dd) * x)) AS area, '' AS branch,
       greatest(0.0, 4.0 * (1.1 * sy) * wt_mm / dd * (1.0 - greatest(0.0, least(1.0, width_mm / (pi() * dd) * x)))) AS pf
FROM asm WHERE circ""")

cte("ffp", "methods", f"""
SELECT *, pf * {_K} AS pf_kgcm2, pf * design_factor * {_K} AS sop_kgcm2, maop_kgcm2 / (pf * design_factor * {_K}) AS erf,
       100.0 * x AS pct FROM methods""")

# Controlling result of the default chain: original method, or the circumferential one where it is lower.
cte("ctl", "ffp", """
SELECT o.*, k.sop_kgcm2 AS ks, coalesce(k.sop_kgcm2 < o.sop_kgcm2, FALSE) AS kwins,
       CASE WHEN k.sop_kgcm2 < o.sop_kgcm2 THEN 'Kastner' ELSE 'B31G_Original' END AS cmethod,
       CASE WHEN k.sop_kgcm2 < o.sop_kgcm2 THEN k.sop_kgcm2 ELSE o.sop_kgcm2 END AS csop,
       CASE WHEN k.sop_kgcm2 < o.sop_kgcm2 THEN k.erf ELSE o.erf END AS cerf
FROM (SELECT * FROM ffp WHERE method = 'B31G_Original') o
LEFT JOIN (SELECT source_row, sop_kgcm2, erf FROM ffp WHERE method = 'Kastner') k USING (source_row)""")

cte("cand", "a1 a2", """
SELECT o.line_id, o.joint_number AS old_joint, o.source_row AS old_source_row, n.source_row AS new_source_row,
       abs(o.upstream_weld_dist_m - n.upstream_weld_dist_m) AS axial,
       CASE WHEN abs(o.clock_decimal_hours - n.clock_decimal_hours) > 6.0
            THEN 12.0 - abs(o.clock_decimal_hours - n.clock_decimal_hours)
            ELSE abs(o.clock_decimal_hours - n.clock_decimal_hours) END AS turn,
       o.surface AS so, n.surface AS sn, o.depth_pct_wt AS od, n.depth_pct_wt AS nd, o.wt_mm AS owt, n.wt_mm AS nwt,
       o.is_cluster_parent AS oc, n.is_cluster_parent AS nc, o.abs_distance_m AS oabs, o.clock_decimal_hours AS oclock
FROM a1 o JOIN a2 n ON o.line_id = n.line_id AND o.joint_number + 30 = n.joint_number
WHERE abs(o.upstream_weld_dist_m - n.upstream_weld_dist_m) <= 1.0""")

cte("costed", "cand", """
SELECT *, axial * 1.0 + turn * 0.3 + CASE WHEN so <> 'unknown' AND sn <> 'unknown' AND so <> sn THEN 10.0 ELSE 0.0 END
       + CASE WHEN od > 0 AND nd < 0.5 * od THEN 1.0 ELSE 0.0 END + CASE WHEN oc <> nc THEN 0.2 ELSE 0.0 END AS match_score
FROM cand""")

cte("matched", "costed", """
SELECT * FROM (
  SELECT *, CASE WHEN axial <= 0.1 AND turn <= 0.5 AND match_score <= 0.5 THEN 1
                 WHEN axial <= 0.25 AND turn <= 1.0 AND match_score <= 1.0 THEN 2
                 WHEN axial <= 1.0 AND turn <= 1.5 AND match_score <= 1.5 THEN 3 END AS relaxation_level
  FROM costed) WHERE relaxation_level IS NOT NULL""")

cte("rates", "a2 matched", """
SELECT a.*, m.old_source_row IS NOT NULL AS is_matched, m.old_source_row, m.oabs, m.od, m.oclock, m.so,
       CASE WHEN m.old_source_row IS NOT NULL THEN m.od / 100.0 * m.owt ELSE 10.0 / 100.0 * a.wt_mm END AS old_mm,
       a.depth_pct_wt / 100.0 * a.wt_mm AS new_mm, (DATE '2023-03-15' - DATE '2018-12-15') / 365.25 AS years
FROM a2 a LEFT JOIN matched m ON a.source_row = m.new_source_row""")

cte("rated", "rates", """
SELECT *, new_mm - old_mm AS delta, greatest(0.0, (new_mm - old_mm) / years) AS own FROM rates""")

cte("p95", "rated", """
SELECT line_id, surface, count(*) AS n, quantile_cont(own, 0.95) AS p95 FROM rated GROUP BY 1, 2 HAVING count(*) >= 2""")

cte("grown", "rated p95", """
SELECT g.*, p.p95, CASE WHEN p.p95 > 0 AND own < p.p95 THEN p.p95 ELSE own END AS cgr,
       CASE WHEN p.p95 > 0 AND own < p.p95 THEN 'population_floor' ELSE 'feature_specific' END AS mode_used
FROM rated g LEFT JOIN p95 p USING (line_id, surface)""")

# Depth after 0..10 years by repeated addition, then the controlling method at that depth.
cte("years", "grown ctl", f"""
SELECT g.line_id, g.source_row, g.anomaly_id, g.cgr, c.cmethod, c.wt_mm, c.maop_kgcm2, c.csop, c.cerf, c.z, c.dd, c.sy,
       c.width_mm, y.n, list_reduce(list_prepend(c.d_mm, list_transform(range(y.n), lambda i : g.cgr)), lambda a, b : a + b) AS d
FROM grown g JOIN ctl c USING (source_row), (SELECT unnest(range(11)) AS n) y""")

cte("assessed_years", "years", f"""
SELECT *, 100.0 * d / wt_mm AS pct, CASE WHEN n = 0 THEN csop ELSE pf * 0.72 * {_K} END AS sop,
       CASE WHEN n = 0 THEN cerf ELSE maop_kgcm2 / (pf * 0.72 * {_K}) END AS erf
FROM (SELECT *, CASE WHEN cmethod = 'Kastner'
        THEN greatest(0.0, 4.0 * (1.1 * sy) * wt_mm / dd * (1.0 - greatest(0.0, least(1.0, width_mm / (pi() * dd) * x))))
      WHEN z <= 20.0 THEN greatest(0.0, 2.0 * (1.1 * sy) * wt_mm / dd *
        ((1.0 - (2.0 / 3.0) * x) / (1.0 - (2.0 / 3.0) * x / sqrt(1.0 + 0.8 * z))))
      ELSE greatest(0.0, 2.0 * (1.1 * sy) * wt_mm / dd * (1.0 - x)) END AS pf
  FROM (SELECT *, least(d, wt_mm * 0.999) / wt_mm AS x FROM years))""")

cte("fires", "assessed_years", """
SELECT source_row, min(CASE WHEN pct >= 80.0 THEN 2 * n WHEN erf >= 1.0 THEN 2 * n + 1 END) AS first_fire
FROM assessed_years GROUP BY 1""")

cte("repairs", "assessed_years fires", """
SELECT a.line_id, a.source_row, a.anomaly_id, a.cmethod AS method, a.cgr,
       CAST(f.first_fire // 2 AS INTEGER) AS repair_year_offset,
       CASE WHEN f.first_fire IS NULL THEN 'NONE_WITHIN_HORIZON' WHEN f.first_fire % 2 = 0 THEN 'DEPTH_80' ELSE 'ERF_1.0' END
         AS repair_trigger,
       coalesce(f.first_fire // 2, 10) AS final_year,
       CASE WHEN f.first_fire % 2 = 0 AND f.first_fire > 0 THEN f.first_fire // 2 - 1 ELSE coalesce(f.first_fire // 2, 10) END
         AS last_year,
       DATE '2023-03-15' + CAST(floor((f.first_fire // 2) * 365.25) AS INTEGER) AS repair_date
FROM (SELECT * FROM assessed_years WHERE n = 0) a JOIN fires f USING (source_row)""")

cte("predicted", "repairs assessed_years", """
SELECT p.*, a.d AS final_depth_mm, a.pct AS final_pct, b.erf AS final_erf, b.sop AS final_sop,
       100.0 * CASE WHEN b.n = 0 THEN b.d ELSE least(b.d, b.wt_mm * 0.999) END / b.wt_mm AS last_pct
FROM repairs p JOIN assessed_years a ON p.source_row = a.source_row AND p.final_year = a.n
JOIN assessed_years b ON p.source_row = b.source_row AND p.last_year = b.n""")
