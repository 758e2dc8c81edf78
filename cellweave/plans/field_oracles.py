"""DuckDB SQL for the queries of field_queries, over the same tables."""

from __future__ import annotations

from cellweave.plans.grid_oracles import BLOCK, EV, FOLDS, GLOBAL, SCORE, SHIP, gradient, parts


def gathered(band: str, value: str, where: str, shift: float) -> str:
    """CTE g_band: r, c, v of the target's cells, from the shipping grid's cells moved by so many columns."""
    return f"""
s_{band} AS MATERIALIZED (SELECT r AS sr, c AS sc, {value} AS v FROM li WHERE {where}), m_{band} AS (SELECT avg(v) AS m FROM s_{band}),
p_{band} AS (SELECT r, c, 1.5 * (r + 0.5) + 0.75 AS y, 2.25 * (c + 0.5) + 3.5 - {shift} AS x FROM target),
k_{band} AS (SELECT r, c, CAST(floor(y - 0.5) AS INT) + dy AS sr, CAST(floor(x - 0.5) AS INT) + dx AS sc, (CASE dy WHEN 1 THEN y - 0.5 - floor(y - 0.5) ELSE 1 - (y - 0.5 - floor(y - 0.5)) END) * (CASE dx WHEN 1 THEN x - 0.5 - floor(x - 0.5) ELSE 1 - (x - 0.5 - floor(x - 0.5)) END) AS w,
  floor(y - 0.5) + dy = floor(y) AND floor(x - 0.5) + dx = floor(x) AS own FROM p_{band}, shape, range(0, 2) a(dy), range(0, 2) b(dx) WHERE y >= 0 AND y < h AND x >= 0 AND x < w),
i_{band} AS (SELECT k.r, k.c, CASE WHEN NOT bool_or(own AND s.v IS NULL) THEN sum(k.w * coalesce(s.v, m)) / sum(k.w) END AS v FROM k_{band} k CROSS JOIN m_{band} CROSS JOIN shape LEFT JOIN s_{band} s USING (sr, sc) WHERE k.sr BETWEEN 0 AND h - 1 AND k.sc BETWEEN 0 AND shape.w - 1 AND (k.w > 0 OR own) GROUP BY k.r, k.c),
g_{band} AS MATERIALIZED (SELECT p.r, p.c, CASE WHEN y >= 0 AND y < h AND x >= 0 AND x < w THEN i.v ELSE 0 END AS v FROM p_{band} p CROSS JOIN shape LEFT JOIN i_{band} i USING (r, c))"""


def smoothed(table: str, sigma: float, rows: str, columns: str) -> str:
    """CTE smooth: r, c, v of a whole grid's Gaussian mean, border cells repeated beyond it."""
    n = int(4 * sigma + 0.5)
    return f"""
w0 AS (SELECT x, exp(-x * x / {2 * sigma * sigma}::DOUBLE) AS w FROM range({-n}, {n + 1}) t(x)), gw AS MATERIALIZED (SELECT x, w / (SELECT sum(w) FROM w0) AS w FROM w0),
sa AS MATERIALIZED (SELECT r, c, greatest(0, least({rows} - 1, r + x)) AS nr, w FROM {table}, target_shape, gw), sp AS MATERIALIZED (SELECT a.r, a.c, sum(w * f.v) AS v FROM sa a JOIN {table} f ON f.r = a.nr AND f.c = a.c GROUP BY a.r, a.c),
sb AS MATERIALIZED (SELECT r, c, greatest(0, least({columns} - 1, c + x)) AS nc, w FROM {table}, target_shape, gw), smooth AS (SELECT b.r, b.c, sum(w * p.v) AS v FROM sb b JOIN sp p ON p.r = b.r AND p.c = b.nc GROUP BY b.r, b.c)"""


#: Cells in which a segment (x0, y0, x1, y1, in cell units) has a point: rows it passes, and in each the columns.
TOUCHED = """
rowsof AS (SELECT *, unnest(generate_series(CAST(floor(least(y0, y1)) AS BIGINT), CAST(floor(greatest(y0, y1)) AS BIGINT))) AS r FROM seg),
ends AS (SELECT r, x0 + (x1 - x0) * (greatest(least(r::DOUBLE, greatest(y0, y1)), least(y0, y1)) - y0) / (y1 - y0) AS a, x0 + (x1 - x0) * (greatest(least(r + 1::DOUBLE, greatest(y0, y1)), least(y0, y1)) - y0) / (y1 - y0) AS b FROM rowsof),
mark AS (SELECT DISTINCT r, unnest(generate_series(CAST(floor(least(a, b)) AS BIGINT), CAST(floor(greatest(a, b)) AS BIGINT))) AS c FROM ends)"""



def windowed(size: int) -> str:
    """CTE win: r0, c0, valid, positive of all windows: rows summed by a frame along columns, then along rows."""
    return f"""
h AS (SELECT max(r) + 1 AS h FROM ev), dense AS MATERIALIZED (SELECT CAST(a.r AS INT) AS r, CAST(b.c AS INT) AS c, CASE WHEN f.r IS NULL THEN 0 ELSE 1 END AS valid, CASE WHEN t.r IS NULL THEN 0 ELSE 1 END AS positive FROM range(0, (SELECT h FROM h)) a(r) CROSS JOIN range(0, 720) b(c) LEFT JOIN foot f ON f.r = a.r AND f.c = b.c LEFT JOIN truth t ON t.r = a.r AND t.c = b.c),
across AS MATERIALIZED (SELECT r, c, sum(valid) OVER w AS valid, sum(positive) OVER w AS positive FROM dense WINDOW w AS (PARTITION BY r ORDER BY c ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING)),
win AS (SELECT r AS r0, c AS c0, sum(valid) OVER w AS valid, sum(positive) OVER w AS positive FROM across WINDOW w AS (PARTITION BY c ORDER BY r ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING)),
whole AS (SELECT w.* FROM win w CROSS JOIN h WHERE r0 <= h - {size} AND c0 <= 720 - {size})"""


#: CTE sweep: field, fi, t0, width, dti, tp, fp, px of every field's bands, from comp (by block).
BANDS = """
lev AS (SELECT * FROM (VALUES (0, 0.1::DOUBLE), (1, 0.3::DOUBLE), (2, 0.5::DOUBLE), (3, 0.7::DOUBLE)) v(fi, t0)),
mask AS (SELECT candidate AS field, fi, r, c FROM fields, lev WHERE p > t0),
emit AS (SELECT DISTINCT field || ':' || fi || ':' || w AS candidate, r + dy AS r, c + dx AS c, 1::DOUBLE AS p FROM mask, disk, (SELECT unnest([0, 1, 2]) AS w) WHERE d <= w AND r + dy >= 0 AND c + dx BETWEEN 0 AND 719)
"""
SWEPT = f"""
sweep AS MATERIALIZED (SELECT candidate, split_part(candidate, ':', 1) AS field, lev.t0, CAST(split_part(candidate, ':', 3) AS INT) AS width, round({GLOBAL}, 6) AS dti, sum(tp) AS tp, sum(fp) AS fp, CAST(sum(pred_px) AS BIGINT) AS px FROM comp JOIN lev ON fi = CAST(split_part(candidate, ':', 2) AS INT) GROUP BY candidate, lev.t0)
"""
STATUS = lambda ok: f"CASE WHEN coalesce({ok}, false) THEN 'PASS' ELSE 'FAIL' END"
EV_SIGNUP = EV.replace("kind = 'error'", "kind = 'signup'")



def split_windows(test: str, unknown: str, gone: str) -> str:
    """CTEs of windows of 24 (training ones every 12): of the test windows, the cells whose truth is unknown, and the windows that go."""
    return f"""
hh AS (SELECT CAST(ceil((max(r) + 1) / 24.0) AS INT) * 24 AS ph, max(r) + 1 AS h FROM ev),
gw AS MATERIALIZED (SELECT DISTINCT CAST(r // 24 * 24 AS INT) AS r0, CAST(c // 24 * 24 AS INT) AS c0 FROM foot WHERE c BETWEEN 0 AND 719 AND r >= 0),
test AS MATERIALIZED ({test}),
known AS MATERIALIZED (SELECT r, c FROM truth WHERE NOT ({unknown})),
wins AS MATERIALIZED (SELECT CAST(a.x * 12 AS INT) AS r0, CAST(b.x * 12 AS INT) AS c0 FROM range(0, (SELECT (ph - 24) // 12 + 1 FROM hh)) a(x), range(0, (720 - 24) // 12 + 1) b(x)),
seen AS (SELECT w.r0, w.c0, count(*) AS n FROM known k JOIN (SELECT unnest([0, 1]) AS y) y ON true JOIN (SELECT unnest([0, 1]) AS x) x ON true JOIN wins w ON w.r0 = (k.r // 12 - y.y) * 12 AND w.c0 = (k.c // 12 - x.x) * 12 GROUP BY w.r0, w.c0),
gone AS MATERIALIZED ({gone}),
judged AS MATERIALIZED (SELECT w.r0, w.c0, coalesce(s.n, 0) AS truth, CASE WHEN g.r0 IS NOT NULL THEN 'dropped' WHEN coalesce(s.n, 0) >= 3 THEN 'positive' ELSE 'negative' END AS use FROM wins w LEFT JOIN seen s USING (r0, c0) LEFT JOIN gone g ON g.r0 = w.r0 AND g.c0 = w.c0),
pn AS (SELECT CAST(round_even(0.35::DOUBLE * count(*) FILTER (use = 'positive') / 0.65::DOUBLE, 0) AS BIGINT) AS k FROM judged),
kept AS (SELECT *, row_number() OVER (PARTITION BY use ORDER BY (CAST(r0 AS BIGINT) * 7919 + CAST(c0 AS BIGINT) * 104729) % 1000003, r0, c0) AS nth FROM judged),
every AS (SELECT r0, c0, CASE WHEN use = 'negative' AND nth > k THEN 'spare' ELSE use END AS use, truth FROM kept, pn
  UNION ALL SELECT t.r0, t.c0, 'test', (SELECT count(*) FROM truth u WHERE u.r // 24 * 24 = t.r0 AND u.c // 24 * 24 = t.c0) FROM test t)
SELECT use, count(*) AS n, CAST(sum(truth) AS BIGINT) AS truth, CAST(sum(r0) AS BIGINT) AS rows, CAST(sum(c0 * (r0 % 7)) AS BIGINT) AS columns FROM every GROUP BY use"""


HELD = "fb AS MATERIALIZED (SELECT block_row, block_col FROM cf WHERE fold = 1)"
IN_HELD = "EXISTS (SELECT 1 FROM fb WHERE block_row = r // 64 AND block_col = c // 64)"

ORACLE_SQL = {
    "holdout_drawn": f"""WITH {EV}, {split_windows(
        "SELECT r0, c0 FROM (SELECT *, row_number() OVER (ORDER BY (CAST(r0 AS BIGINT) * 7919 + CAST(c0 AS BIGINT) * 104729) % 1000003, r0, c0) AS n FROM gw) WHERE n <= (SELECT round_even(0.25::DOUBLE * count(*), 0) FROM gw)",
        "EXISTS (SELECT 1 FROM test WHERE r0 = r // 24 * 24 AND c0 = c // 24 * 24)",
        "SELECT w.r0, w.c0 FROM wins w JOIN test t ON abs(w.r0 - t.r0) < 24 AND abs(w.c0 - t.c0) < 24 GROUP BY w.r0, w.c0 HAVING sum((24 - abs(w.r0 - t.r0)) * (24 - abs(w.c0 - t.c0))) > 0.25 * 576",
    )}""",
    "holdout_blocks": f"""WITH {EV}, {FOLDS}, {HELD}, {split_windows(
        "SELECT r0, c0 FROM gw, hh WHERE r0 + 24 <= h AND c0 + 24 <= 720 AND NOT EXISTS (SELECT 1 FROM range(0, 24) a(y), range(0, 24) b(x) WHERE NOT EXISTS (SELECT 1 FROM fb WHERE block_row = (r0 + y) // 64 AND block_col = (c0 + x) // 64))",
        IN_HELD,
        "SELECT DISTINCT r0, c0 FROM wins, fb, hh WHERE r0 - 3 < least((block_row + 1) * 64, h) AND r0 + 24 + 3 > block_row * 64 AND c0 - 3 < least((block_col + 1) * 64, 720) AND c0 + 24 + 3 > block_col * 64",
    )}""",
    "training_weights": f"""WITH {EV}, {FOLDS}, {HELD}, known AS (SELECT r, c FROM truth WHERE NOT {IN_HELD}), w AS (SELECT r + dy AS r, c + dx AS c, 1 - max(k) AS w FROM known, disk WHERE k > 0 GROUP BY ALL) SELECT r, c, round(w, 6) AS w FROM w WHERE NOT {IN_HELD}""",
    "readiness_gates": f"""WITH {EV}, pin AS (SELECT o_orderstatus AS name, count(*) AS n, sha256(count(*) || '|' || CAST(sum(o_orderkey) AS BIGINT)) AS h FROM orders GROUP BY 1), got AS (SELECT l_linestatus AS name, count(*) AS n, sha256(count(*) || '|' || CAST(sum(l_orderkey) AS BIGINT)) AS h FROM lineitem GROUP BY 1),
      odd AS (SELECT p.name, CASE WHEN g.name IS NULL THEN 'missing' WHEN g.h <> p.h THEN 'other content' WHEN g.n <> p.n THEN 'other length' END AS problem FROM pin p LEFT JOIN got g ON g.name = p.name)
      SELECT 'customers' AS name, 'PASS' AS status, '' AS note UNION ALL SELECT 'orders', CASE WHEN count(*) FILTER (problem <> 'missing') > 0 THEN 'FAIL' WHEN count(problem) > 0 THEN 'MISSING' ELSE 'PASS' END, coalesce(string_agg(name || ': ' || problem, '; ' ORDER BY name) FILTER (problem IS NOT NULL), '') FROM odd
      UNION ALL SELECT 'field', CASE WHEN 2 * max(p) > 1.01 THEN 'FAIL' ELSE 'PASS' END, CASE WHEN 2 * max(p) > 1.01 THEN 'range' ELSE '' END FROM main UNION ALL SELECT 'rules read', 'HUMAN', ''""",
    "raster_format": f"""WITH {EV}, z AS (SELECT (max(r) + 1) * 720 AS n FROM ev), f AS (SELECT 'whole' AS form, r, c, p FROM main UNION ALL SELECT 'doubled', r, c, p * 2 FROM main UNION ALL SELECT 'half', r, c, p FROM main WHERE p > 0.5),
      g AS (SELECT form, max(p) AS hi, count(*) AS n FROM f GROUP BY form), m AS (SELECT count(*) AS k FROM main)
      SELECT form, concat_ws(',', CASE WHEN hi > 1.01 THEN 'range' END, CASE WHEN g.n < k THEN 'inside' END, CASE WHEN z.n - g.n > 0.9 * z.n THEN 'missing' END) AS failed FROM g, m, z
      UNION ALL SELECT 'numbers', concat_ws(',', 'dtype', 'nodata', CASE WHEN z.n - k > 0.9 * z.n THEN 'missing' END) FROM m, z""",
    "raster_roundtrip": f"WITH {SHIP} SELECT r, c, CAST(v AS DOUBLE) AS v, CAST(q AS DOUBLE) AS q FROM li",
    "field_selection": f"""WITH {EV_SIGNUP}, {BANDS}, {parts('emit', BLOCK)}, {SWEPT}, sup AS (SELECT px AS s FROM sweep WHERE field = 'purchase' AND t0 = 0.3 AND width = 0),
      fit AS (SELECT w.*, tol FROM sweep w, sup, (SELECT unnest([0.15, 0.25, 0.40]) AS tol) WHERE abs(px - s) <= tol * s), rk AS (SELECT *, row_number() OVER (PARTITION BY field, tol ORDER BY dti DESC, t0, width) AS k, count(*) OVER (PARTITION BY field, tol) AS n FROM fit), bw AS MATERIALIZED (SELECT * FROM rk WHERE k = 1),
      firsts AS (SELECT field, count(*) AS firsts FROM (SELECT tol, field, row_number() OVER (PARTITION BY tol ORDER BY dti DESC, field) AS k FROM bw) WHERE k = 1 GROUP BY field),
      ship AS (SELECT max(dti) AS ship FROM bw WHERE tol = 0.25 AND field = 'purchase'),
      sl AS (SELECT part, row_number() OVER (ORDER BY part) - 1 AS slot FROM (SELECT DISTINCT part FROM comp)), nn AS (SELECT count(*) AS n FROM sl),
      dr AS (SELECT boot, (boot * 7919 + place * 104729 + 17) % n AS slot FROM nn, range(0, 100) a(boot), range(0, (SELECT n FROM nn)) p(place)),
      dw AS (SELECT boot, bw.field, {SCORE} AS dti FROM dr JOIN sl USING (slot) JOIN comp USING (part) JOIN (SELECT field, candidate FROM bw WHERE tol = 0.25) bw ON bw.candidate = comp.candidate GROUP BY ALL),
      pb AS (SELECT x.field, avg(CASE WHEN round(x.dti - y.dti, 12) > 0 THEN 1 ELSE 0 END) AS p FROM dw x JOIN dw y ON x.boot = y.boot AND y.field = 'purchase' WHERE x.field = 'click' GROUP BY x.field),
      mo AS (SELECT event_type, strftime(ts, '%Y-%m') AS run FROM events), ru AS (SELECT DISTINCT event_type AS field, run FROM mo WHERE event_type IN ('purchase', 'click', 'view')), se AS (SELECT DISTINCT run FROM mo WHERE event_type = 'error'),
      f1 AS (SELECT field, CASE WHEN count(*) = count(se.run) THEN 'PASS' ELSE 'UNVERIFIED' END AS f1 FROM ru LEFT JOIN se USING (run) GROUP BY field),
      j AS (SELECT f1.field, f1.f1, {STATUS('rf.dti IS NOT NULL AND ad.dti IS NOT NULL')} AS f2, CASE WHEN f1.field = 'purchase' THEN 'NOT_APPLICABLE' ELSE {STATUS('h.dti > ship + 0.010')} END AS r1, {STATUS('firsts = 3')} AS r2,
        CASE WHEN f1.field = 'purchase' THEN 'NOT_APPLICABLE' WHEN pb.p IS NULL THEN 'NOT_MEASURABLE_FROM_COMMITTED_BYTES' ELSE {STATUS('pb.p >= 0.95')} END AS r3, {STATUS('ad.dti - rf.dti > 0.010')} AS r4, {STATUS('h.n >= 3')} AS r5
        FROM f1 CROSS JOIN ship LEFT JOIN bw h ON h.field = f1.field AND h.tol = 0.25 LEFT JOIN firsts ON firsts.field = f1.field LEFT JOIN pb ON pb.field = f1.field
        LEFT JOIN sweep ad ON ad.field = f1.field AND ad.t0 = 0.3 AND ad.width = 0 LEFT JOIN sweep rf ON rf.field = f1.field AND rf.t0 = 0.5 AND rf.width = 1),
      k AS (SELECT *, field <> 'purchase' AND f1 = 'PASS' AND f2 = 'PASS' AND r1 = 'PASS' AND r2 = 'PASS' AND r3 = 'PASS' AND r4 = 'PASS' AND r5 = 'PASS' AS passes FROM j), v AS (SELECT count(*) FILTER (passes) AS n, min(field) FILTER (passes) AS one FROM k)
      SELECT k.*, CASE WHEN n = 1 THEN 'ADOPT ' || one WHEN n > 1 THEN 'CONFLICT' ELSE 'KEEP purchase' END AS verdict FROM k, v""",
    "width_decision": f"""WITH {EV}, {BANDS}, {parts('emit', BLOCK)}, {SWEPT}, g AS (SELECT count(*) AS n FROM truth), best AS (SELECT * FROM sweep WHERE field = 'purchase' ORDER BY dti DESC, t0, width LIMIT 1), cur AS (SELECT * FROM sweep WHERE field = 'purchase' AND t0 = 0.3 AND width = 0),
      an AS (SELECT n * m AS t, n FROM g, (SELECT unnest([0.25::DOUBLE, 1, 4]) AS m)), pr AS (SELECT t, round(b.tp / n, 6) * t AS bt, round(b.fp, 3) AS bf, round(c.tp / n, 6) * t AS ct, round(c.fp, 3) AS cf FROM an, best b, cur c),
      wi AS (SELECT count(*) AS anchors, count(*) FILTER (bt / (0.2::DOUBLE * (bt + bf) + 0.8::DOUBLE * t + 1e-12::DOUBLE) > ct / (0.2::DOUBLE * (ct + cf) + 0.8::DOUBLE * t + 1e-12::DOUBLE)) AS wins FROM pr),
      ot AS (SELECT o.dti, r.dti AS ref FROM sweep o JOIN best b ON o.t0 = b.t0 AND o.width = b.width JOIN sweep r ON r.field = o.field AND r.t0 = 0.3 AND r.width = 0 WHERE o.field <> 'purchase'), re AS (SELECT count(*) AS ensembles, count(*) FILTER (round(dti - ref, 6) > 0.010 AND dti > ref) AS reproduced FROM ot),
      x AS (SELECT b.t0, b.width, round(b.dti - c.dti, 6) AS gain, anchors, wins, ensembles, reproduced FROM best b, cur c, wi, re), y AS (SELECT *, concat_ws('/', CASE WHEN NOT gain > 0.010 THEN '1' END, CASE WHEN wins <> anchors THEN '2' END, CASE WHEN NOT (ensembles > 0 AND reproduced = ensembles) THEN '3' END) AS failed FROM x)
      SELECT *, CASE WHEN failed = '' THEN 'SHIP' WHEN ensembles = 0 THEN 'NOT REPRODUCED' ELSE 'NOT SHIPPED' END AS verdict FROM y""",
    "window_sums": f"WITH {EV}, {windowed(24)} SELECT r0, count(*) AS n, CAST(sum(valid) AS BIGINT) AS valid_sum, CAST(sum(positive) AS BIGINT) AS positive_sum, CAST(max(valid) AS BIGINT) AS valid_max, CAST(max(positive) AS BIGINT) AS positive_max FROM whole GROUP BY r0",
    "best_window_valid": f"WITH {EV}, {windowed(12)} SELECT r0, c0, 12 AS size, CAST(positive AS BIGINT) AS positives, CAST(valid AS BIGINT) AS valids, round(positive / 144, 6) AS positive_share, round(valid / 144, 6) AS valid_share FROM whole WHERE valid >= 0.02 * 144 ORDER BY positives DESC, r0, c0 LIMIT 1",
    "reconstruct_grid": f"""WITH {EV}, {SHIP}, shape AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM li), target_shape AS (SELECT CAST(trunc((h - 0.75) / 1.5) AS INT) + 1 AS th, CAST(trunc((w - 3.5) / 2.25) AS INT) + 1 AS tw FROM shape),
      target AS MATERIALIZED (SELECT CAST(a.r AS INT) AS r, CAST(b.c AS INT) AS c FROM range(0, (SELECT th FROM target_shape)) a(r), range(0, (SELECT tw FROM target_shape)) b(c)),
      {gathered('v', 'round(CAST(v AS DOUBLE) * 100)', 'true', 0)}, {gathered('q', 'CAST(q AS DOUBLE)', 'true', 0)}, {gathered('x', 'round(CAST(x AS DOUBLE) * 100)', 'x > 0', 2)},
      md AS (SELECT quantile_cont(v, 0.5) AS m FROM g_v), filled AS MATERIALIZED (SELECT r, c, coalesce(v, m) AS v FROM g_v CROSS JOIN md), {smoothed('filled', 2.0, 'th', 'tw')},
      gr AS (SELECT r, c, {gradient('v', 'r', 'c')} AS gy, {gradient('v', 'c', 'r')} AS gx FROM filled),
      seg AS (SELECT (min(c) / 8 + 0.5 - 3.5) / 2.25 AS x0, (r / 16 + 0.25 - 0.75) / 1.5 AS y0, (max(c) / 8 + 0.5 - 3.5) / 2.25 AS x1, (r / 16 + 2.0 - 0.75) / 1.5 AS y1 FROM ev WHERE kind = 'error' GROUP BY r), {TOUCHED}
      SELECT t.r, t.c, round(v.v, 3) AS v, round(q.v, 3) AS q, round(coalesce(x.v, 0), 3) AS x, round(CASE WHEN v.v IS NULL THEN 0 ELSE f.v - s.v END + 0.0, 3) AS dem_detrended, round(CASE WHEN v.v IS NULL THEN 0 ELSE degrees(atan(sqrt(gx * gx + gy * gy))) END, 3) AS dem_slope, CASE WHEN m.r IS NULL THEN 0 ELSE 1 END AS label
      FROM target t JOIN g_v v USING (r, c) JOIN g_q q USING (r, c) JOIN g_x x USING (r, c) JOIN filled f USING (r, c) JOIN smooth s USING (r, c) JOIN gr USING (r, c) LEFT JOIN mark m ON m.r = t.r AND m.c = t.c""",
}
