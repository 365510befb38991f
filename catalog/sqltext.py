"""SQL building blocks for the equivalents of subgroup, chart and rule queries."""

from catalog.tables import CTX_SQL, MEASUREMENTS
from gaugeline.functions.constants import COLUMNS, rows


def setting(size, method, gap=14400, chart="AUTO", source="m"):
    return f"SELECT DISTINCT k, {size} AS size, '{method}' AS method, {gap} AS gap, '{chart}' AS chart FROM {source}"


def subgroups(config, measurements=MEASUREMENTS, longest=6, before=""):
    """CTEs m, seqd, cfg, marked and sg (one row per subgroup)."""
    leads = " ".join(
        f"WHEN {d} < size AND epoch_us(lead(event_timestamp, {d}) OVER w) - epoch_us(event_timestamp) > gap::BIGINT * 1000000 THEN seq + {d}"
        for d in range(1, longest)
    )
    return f"""
WITH RECURSIVE {before} m AS ({measurements}),
seqd AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY event_timestamp, source_row_number) AS seq FROM m),
cfg AS ({config}),
r0 AS (SELECT s.*, size, method, gap FROM seqd s JOIN cfg USING (k)),
r1 AS (SELECT *, CASE WHEN seq = 1 OR epoch_us(event_timestamp) - epoch_us(lag(event_timestamp) OVER w) > gap::BIGINT * 1000000
                 THEN 1 ELSE 0 END AS cut,
              CASE {leads} ELSE seq + size END AS nxt
       FROM r0 WINDOW w AS (PARTITION BY k ORDER BY seq)),
r2 AS (SELECT *, sum(cut) OVER (PARTITION BY k ORDER BY seq) AS island FROM r1),
r3 AS (SELECT *, row_number() OVER (PARTITION BY k, island ORDER BY seq) - 1 AS inpos FROM r2),
opened(k, seq) AS (SELECT k, seq FROM r1 WHERE method = 'TIME_WINDOW' AND seq = 1
                   UNION ALL SELECT r1.k, r1.nxt FROM opened o JOIN r1 ON r1.k = o.k AND r1.seq = o.seq),
r4 AS (SELECT r3.*, max(o.seq) OVER (PARTITION BY r3.k ORDER BY r3.seq) AS win
       FROM r3 LEFT JOIN opened o ON o.k = r3.k AND o.seq = r3.seq),
marked AS (SELECT *, CASE WHEN size = 1 THEN seq WHEN method = 'FIXED_SIZE' THEN seq - (seq - 1) % size
                          WHEN method = 'CONSECUTIVE' THEN seq - inpos % size WHEN method = 'TIME_WINDOW' THEN win END AS first_of,
                  CASE WHEN size > 1 AND method = 'EXISTING_ID' THEN subgroup_id END AS named FROM r4),
sg0 AS (SELECT k, min(seq) AS first_seq, named, count(*) AS cnt, avg(value) AS mean, max(value) - min(value) AS rng,
               stddev_samp(value) AS sd, min(event_timestamp) AS st, max(event_timestamp) AS et,
               any_value(size) AS size, any_value(method) AS method
        FROM marked GROUP BY k, first_of, named),
sg AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY first_seq) AS idx,
              coalesce(named, printf('SG-%05d', row_number() OVER (PARTITION BY k ORDER BY first_seq))) AS label
       FROM sg0 WHERE method <> 'FIXED_SIZE' OR size = 1 OR cnt = size),
ids AS (SELECT DISTINCT k, {CTX_SQL} FROM m)"""


FACTORS = ", ".join("(" + ", ".join(str(v) for v in r) + ")" for r in rows())

SIZES = """,
sz AS (SELECT k, cnt, count(*) AS n, min(first_seq) AS f FROM sg GROUP BY k, cnt),
md AS (SELECT k, first(cnt ORDER BY n DESC, f) AS modal, first(cnt ORDER BY n DESC, cnt) AS detected,
              sum(n) AS formed, sum(n) - max(n) AS excluded FROM sz GROUP BY k)"""

CHARTS = (
    SIZES
    + f""",
fac AS (SELECT * FROM (VALUES {FACTORS}) AS t({', '.join(COLUMNS)})),
ch0 AS (SELECT md.*, cfg.chart AS configured,
               CASE WHEN detected <= 1 THEN 'IMR' WHEN detected <= 8 THEN 'XBAR_R' ELSE 'XBAR_S' END AS recommended
        FROM md JOIN cfg USING (k)),
ch1 AS (SELECT *, CASE WHEN configured = 'AUTO' THEN recommended
                       WHEN configured IN ('XBAR_R', 'XBAR_S') AND detected > 1 THEN configured
                       WHEN configured = 'IMR' AND detected <= 1 THEN configured END AS kind FROM ch0),
ch AS (SELECT *, CASE WHEN kind = 'IMR' THEN 1 ELSE modal END AS used FROM ch1),
p0 AS (SELECT sg.*, kind, used, row_number() OVER (PARTITION BY sg.k ORDER BY first_seq) AS pn
       FROM sg JOIN ch USING (k) WHERE cnt = used AND kind IS NOT NULL),
p AS (SELECT *, abs(mean - lag(mean) OVER (PARTITION BY k ORDER BY pn)) AS mr FROM p0),
agg AS (SELECT k, kind, used, count(*) AS pc, avg(mean) AS gm, avg(rng) AS rb, avg(sd) AS sb, avg(mr) AS mb
        FROM p GROUP BY k, kind, used),
lim AS (SELECT k, kind, used, pc, gm, rb, sb, mb,
   CASE kind WHEN 'XBAR_R' THEN gm + a2 * rb WHEN 'XBAR_S' THEN gm + a3 * sb ELSE gm + 3 * mb / 1.128 END AS ucl,
   CASE kind WHEN 'XBAR_R' THEN gm - a2 * rb WHEN 'XBAR_S' THEN gm - a3 * sb ELSE gm - 3 * mb / 1.128 END AS lcl,
   CASE kind WHEN 'XBAR_R' THEN rb WHEN 'XBAR_S' THEN sb ELSE mb END AS scl,
   CASE kind WHEN 'XBAR_R' THEN big_d4 * rb WHEN 'XBAR_S' THEN b4 * sb ELSE 3.267 * mb END AS sucl,
   CASE kind WHEN 'XBAR_R' THEN big_d3 * rb WHEN 'XBAR_S' THEN b3 * sb ELSE 0.853 * mb END AS slcl,
   CASE kind WHEN 'XBAR_R' THEN rb / d2 WHEN 'XBAR_S' THEN sb / c4 ELSE mb / 1.128 END AS ws
   FROM agg LEFT JOIN fac ON fac.n = used WHERE kind = 'IMR' OR fac.n IS NOT NULL)"""
)


def rules(limits="lim", trend_up=7, trend_down=7, run=8):
    """CTE vi: one row per hit of the standard rules against the limits of a CTE (k, gm, ucl, lcl)."""
    return f""",
j0 AS (SELECT p.k, pn, mean, l.kind AS limit_kind, l.gm AS cl, l.ucl, l.lcl, lag(mean) OVER (PARTITION BY p.k ORDER BY pn) AS pv
       FROM p JOIN {limits} l ON l.k = p.k),
j1 AS (SELECT *, pn - max(CASE WHEN pv IS NULL OR NOT mean > pv THEN pn END) OVER w AS up,
              pn - max(CASE WHEN pv IS NULL OR NOT mean < pv THEN pn END) OVER w AS down,
              pn - max(CASE WHEN pv IS NULL OR mean = cl OR sign(mean - cl) <> sign(pv - cl) THEN pn END) OVER w AS side
       FROM j0 WINDOW w AS (PARTITION BY k ORDER BY pn)),
vi AS (SELECT k, 0 AS pos, 'POINT_OUTSIDE_LIMITS' AS rule_name, pn - 1 AS s, pn - 1 AS e, mean, cl, ucl, lcl FROM j1 WHERE mean > ucl OR mean < lcl
       UNION ALL SELECT k, 1, 'TREND_INCREASING', pn - {trend_up}, pn - 1, mean, cl, ucl, lcl FROM j1 WHERE up > 0 AND up % ({trend_up} - 1) = 0
       UNION ALL SELECT k, 2, 'TREND_DECREASING', pn - {trend_down}, pn - 1, mean, cl, ucl, lcl FROM j1 WHERE down > 0 AND down % ({trend_down} - 1) = 0
       UNION ALL SELECT k, 3, 'RUN_SAME_SIDE', pn - {run}, pn - 1, mean, cl, ucl, lcl FROM j1 WHERE side > 0 AND side % ({run} - 1) = 0)"""
