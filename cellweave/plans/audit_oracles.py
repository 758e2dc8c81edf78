"""DuckDB SQL for the queries of audit_queries, over the same tables."""

from __future__ import annotations

from cellweave.plans.grid_oracles import BLOCK, DTI, EMISSIONS, EV, FOLD, GLOBAL, SCORE, SHIP, SWEEP, gradient, parts

INSIDE = "r >= 0 AND c BETWEEN 0 AND 719"
LEVELS = "lev AS (SELECT * FROM (VALUES (0, 0.1::DOUBLE), (1, 0.3::DOUBLE), (2, 0.3000001::DOUBLE), (3, 0.5::DOUBLE)) v(fi, t0))"


def population(name: str, truth: str, part: str = BLOCK) -> str:
    """CTEs up to name: candidate, part, tp, fp, n_gt over the fields and a truth."""
    return f"""
{name}_near AS (SELECT r + dy AS r, c + dx AS c, max(k) AS m FROM {truth}, disk WHERE k > 0 GROUP BY ALL),
{name}_cred AS (SELECT candidate, t.r, t.c, max(k * p) AS credit FROM {truth} t CROSS JOIN disk JOIN fields f ON f.r = t.r + dy AND f.c = t.c + dx WHERE k > 0 GROUP BY ALL),
{name}_a AS (SELECT {part} AS part, count(*) AS n_gt FROM {truth} GROUP BY 1),
{name}_b AS (SELECT candidate, {part} AS part, sum(credit) AS tp FROM {name}_cred GROUP BY 1, 2),
{name}_d AS (SELECT candidate, {part.replace('(r //', '(f.r //').replace('+ c //', '+ f.c //')} AS part, sum(p * (1 - coalesce(m, 0))) AS fp, count(*) AS pred_px FROM fields f LEFT JOIN {name}_near n ON f.r = n.r AND f.c = n.c GROUP BY 1, 2),
{name} AS (SELECT n.candidate, q.part, coalesce(b.tp, 0) AS tp, coalesce(d.fp, 0) AS fp, coalesce(a.n_gt, 0) AS n_gt, CASE WHEN coalesce(a.n_gt, 0) > 0 THEN coalesce(b.tp, 0) / (coalesce(b.tp, 0) + 0.2::DOUBLE * coalesce(d.fp, 0) + 0.8::DOUBLE * (a.n_gt - coalesce(b.tp, 0)) + 1e-7::DOUBLE) END AS dti
  FROM (SELECT DISTINCT candidate FROM fields) n CROSS JOIN (SELECT part FROM {name}_a UNION SELECT part FROM {name}_d) q
  LEFT JOIN {name}_a a ON a.part = q.part LEFT JOIN {name}_b b ON b.part = q.part AND b.candidate = n.candidate LEFT JOIN {name}_d d ON d.part = q.part AND d.candidate = n.candidate)
"""


def diffs(name: str, reference: str, where: str = "true") -> str:
    return f"{name}_diff AS (SELECT a.candidate, a.part, round(a.dti - b.dti, 9) AS diff FROM {name} a JOIN {name} b ON a.part = b.part AND b.candidate = '{reference}' WHERE a.candidate <> '{reference}' AND a.dti IS NOT NULL AND b.dti IS NOT NULL AND {where})"


AGREE = """agree AS (SELECT p.candidate, count(*) AS scoreable, count(*) FILTER (p.diff > 0) AS gain, count(l.diff) AS both, count(*) FILTER (l.diff IS NOT NULL AND (p.diff > 0) = (l.diff > 0)) AS agree,
  count(*) FILTER (l.diff < 0) AS labels_lose, count(*) FILTER (l.diff < 0 AND p.diff > 0) AS conflict_lose_gain, count(*) FILTER (l.diff > 0 AND p.diff < 0) AS conflict_gain_lose, round(min(p.diff), 6) AS worst
  FROM px_diff p LEFT JOIN lb_diff l ON l.candidate = p.candidate AND l.part = p.part GROUP BY p.candidate)"""
PRUNED = f"""{LEVELS}, pol AS (SELECT CAST(fi * 2 + w AS INT) AS candidate, fi, t0, CAST(w AS INT) AS width FROM lev, range(0, 2) x(w)),
ab AS (SELECT l.t0, count(m.r) AS above FROM lev l LEFT JOIN main m ON m.p > l.t0 GROUP BY l.t0), tw AS (SELECT t0, above, min(t0) OVER (PARTITION BY above) AS twin FROM ab),
emit AS (SELECT DISTINCT pol.candidate, r + dy AS r, c + dx AS c, 1::DOUBLE AS p FROM main, pol, disk WHERE main.p > t0 AND d <= width AND r + dy >= 0 AND c + dx BETWEEN 0 AND 719)"""
RATIO = lambda tp, fp, n: f"{tp} / ({tp} + 0.2::DOUBLE * {fp} + 0.8::DOUBLE * ({n} - {tp}) + 1e-7::DOUBLE)"
FILLED = "mid AS MATERIALIZED (SELECT quantile_cont(round(v * 100), 0.5) AS m FROM li), dm AS MATERIALIZED (SELECT g.r, g.c, coalesce(round(li.v * 100), m) AS v, li.v IS NOT NULL AS valid FROM cellsg g CROSS JOIN mid LEFT JOIN li ON li.r = g.r AND li.c = g.c)"
HOSTS = "regexp_extract(href, '^[a-z]+://([^/:?#]+)', 1)"
LIKE = "[.]".join(["[0-9OolIS]{1,3}"] * 4)
RIGHT = "translate(raw, 'OolIS', '00115')"
HEX_LENGTH = "CASE WHEN length < 128 THEN printf('%02x', length) WHEN length < 16384 THEN printf('%02x%02x', length % 128 + 128, length // 128) ELSE printf('%02x%02x%02x', length % 128 + 128, length // 128 % 128 + 128, length // 16384) END"

ORACLE_SQL = {
    "candidate_grid": """SELECT CAST(row_number() OVER (ORDER BY t0, thin DESC, width, votes) - 1 AS INT) AS candidate, t0::DOUBLE AS t0, thin, CAST(width AS INT) AS width, CAST(votes AS INT) AS votes
      FROM (VALUES (0.0), (0.001), (0.01), (0.1), (1.0)) a(t0), (VALUES (true), (false)) b(thin), range(0, 2) c(width), range(1, 3) d(votes)""",
    "shape_full": f"""WITH {EV}, lev AS (SELECT * FROM (VALUES (0, 0.1::DOUBLE), (1, 0.3::DOUBLE), (2, 0.5::DOUBLE)) v(fi, t0)), pol AS (SELECT CAST(fi * 6 + w * 2 + s AS INT) AS candidate, t0, w, s FROM lev, range(0, 3) x(w), range(0, 2) y(s)),
      e AS (SELECT pol.candidate, any_value(w) AS w, any_value(s) AS s, r + dy AS r, c + dx AS c, min(d) AS d FROM main, pol, disk WHERE p > t0 AND d <= w GROUP BY pol.candidate, r + dy, c + dx)
      SELECT candidate, count(*) AS px, round(sum(CASE WHEN s = 1 THEN pow(1 - d / (w + 1), 2) ELSE 1 END), 6) AS mass FROM e WHERE {INSIDE} GROUP BY candidate""",
    "sweep_pruned": f"""WITH {EV}, {PRUNED}, {parts('emit', '0')}, sc AS (SELECT candidate, sum(tp) AS tp, sum(fp) AS fp, CAST(sum(n_gt) AS BIGINT) AS n_gt, CAST(sum(pred_px) AS BIGINT) AS px, {GLOBAL} AS dti FROM comp GROUP BY candidate),
      x AS (SELECT pol.candidate, pol.t0, pol.width, tw.above, tw.twin, tw.above > (SELECT count(*) // 8 FROM foot) AS skipped FROM pol JOIN tw ON tw.t0 = pol.t0), y AS (SELECT x.*, q.candidate AS src FROM x JOIN pol q ON q.t0 = x.twin AND q.width = x.width)
      SELECT y.candidate, t0, false AS thin, width, CASE WHEN skipped THEN above ELSE coalesce(px, 0) END AS emitted_px, CASE WHEN t0 <> twin THEN twin END AS duplicate_of, skipped,
        CASE WHEN NOT skipped THEN round(tp, 6) END AS tp, CASE WHEN NOT skipped THEN round(fp, 6) END AS fp, CASE WHEN NOT skipped THEN n_gt END AS n_gt, CASE WHEN NOT skipped THEN round(dti, 6) END AS dti FROM y LEFT JOIN sc ON sc.candidate = y.src""",
    "inclusive_floor": f"WITH {EV}, lev AS (SELECT * FROM (VALUES (0, 0.1::DOUBLE), (1, 0.3::DOUBLE), (2, 0.5::DOUBLE)) v(fi, t0)) SELECT fi, t0, count(*) AS px FROM main SEMI JOIN foot USING (r, c), lev WHERE p >= t0 GROUP BY ALL",
    "postprocess": f"""WITH RECURSIVE {EV}, s AS (SELECT unnest([-1, 0, 1]) AS s), t AS (SELECT r, c FROM main WHERE p > 0.15::DOUBLE), dl AS (SELECT DISTINCT r + a.s AS r, c + b.s AS c FROM t, s a, s b),
      cl AS (SELECT r, c FROM (SELECT r + a.s AS r, c + b.s AS c FROM dl, s a, s b) GROUP BY ALL HAVING count(*) = 9), cr AS (SELECT DISTINCT r + a.s AS r, c + b.s AS c FROM cl, s a, s b WHERE a.s * b.s = 0 AND r + a.s >= 0 AND c + b.s BETWEEN 0 AND 719),
      ids AS (SELECT r, c, CAST(r AS BIGINT) * 4294967296 + c AS id FROM cr), adj AS (SELECT a.id, b.id AS other FROM ids a JOIN s y ON true JOIN s x ON y.s * x.s = 0 JOIN ids b ON b.r = a.r + y.s AND b.c = a.c + x.s),
      reach AS (SELECT id, id AS other FROM ids UNION SELECT reach.id, adj.other FROM reach JOIN adj ON adj.id = reach.other), sz AS (SELECT id, count(*) AS px FROM reach GROUP BY id),
      kept AS (SELECT r, c FROM ids JOIN sz USING (id) WHERE px >= 5)
      SELECT coalesce(m.r, k.r) AS r, coalesce(m.c, k.c) AS c, round(CASE WHEN k.r IS NULL THEN p ELSE greatest(coalesce(p, 0), 0.15::DOUBLE) END, 6) AS p, k.r IS NOT NULL AS kept FROM main m FULL JOIN kept k ON m.r = k.r AND m.c = k.c""",
    "grid_alignment": f"""WITH {EV}, {SHIP}, s AS (SELECT 'events' AS grid, max(r) + 1 AS height, max(c) + 1 AS width FROM ev UNION ALL SELECT 'purchases', max(r) + 1, max(c) + 1 FROM main UNION ALL SELECT 'shipments', max(r) + 1, max(c) + 1 FROM li)
      SELECT grid, CAST(height AS INT) AS height, CAST(width AS INT) AS width, height = (SELECT height FROM s WHERE grid = 'events') AND width = (SELECT width FROM s WHERE grid = 'events') AS aligned FROM s""",
    "discovery_report": f"""WITH RECURSIVE {EV}, lev AS (SELECT * FROM (VALUES (0, 0.1::DOUBLE), (1, 0.5::DOUBLE), (2, 0.9::DOUBLE)) v(fi, t0)), ab AS (SELECT fi, r, c FROM main, lev WHERE p > t0), ids AS (SELECT fi, r, c, CAST(fi AS BIGINT) * 281474976710656 + CAST(r AS BIGINT) * 16777216 + c AS id FROM ab),
      st AS (SELECT unnest([-1, 0, 1]) AS s), adj AS (SELECT a.id, b.id AS other FROM ids a JOIN st y ON true JOIN st x ON true JOIN ids b ON b.fi = a.fi AND b.r = a.r + y.s AND b.c = a.c + x.s), reach AS (SELECT id, id AS other FROM ids UNION SELECT reach.id, adj.other FROM reach JOIN adj ON adj.id = reach.other),
      lab AS (SELECT ids.fi, ids.r, ids.c, min(other) AS region FROM reach JOIN ids USING (id) GROUP BY ALL), sz AS (SELECT fi, region, count(*) AS px, count(n.m) AS near FROM lab LEFT JOIN near n ON n.r = lab.r AND n.c = lab.c GROUP BY ALL),
      g AS (SELECT fi, CAST(sum(px) AS BIGINT) AS px, count(*) FILTER (px >= 2) AS regions, count(*) FILTER (px >= 2 AND near = 0) AS novel FROM sz GROUP BY fi),
      h AS (SELECT lev.fi, count(*) FILTER (EXISTS (SELECT 1 FROM ab, disk WHERE ab.fi = lev.fi AND ab.r + dy = t.r AND ab.c + dx = t.c)) / count(*) AS recall FROM lev, truth t GROUP BY lev.fi)
      SELECT t0 AS threshold, coalesce(px, 0) AS px, coalesce(regions, 0) AS regions, coalesce(novel, 0) AS novel, round(recall, 6) AS recall FROM lev LEFT JOIN g USING (fi) LEFT JOIN h USING (fi)""",
    "class_accounting": f"""WITH {EV}, bey AS (SELECT r, c FROM foot ANTI JOIN (SELECT DISTINCT r + dy AS r, c + dx AS c FROM truth, disk) n USING (r, c)), e AS (SELECT kind AS cls, r || '-' || c || '-' || CAST(trunc(value) AS INT) AS feature, r, c FROM ev WHERE kind IN ('signup', 'click')),
      f AS (SELECT cls, count(DISTINCT feature) AS features FROM e GROUP BY cls), p AS (SELECT cls, count(*) AS px FROM (SELECT DISTINCT cls, r, c FROM e SEMI JOIN bey USING (r, c)) GROUP BY cls) SELECT cls AS "class", features, coalesce(px, 0) AS px FROM f LEFT JOIN p USING (cls)""",
    "mask_boxes": f"""WITH {SHIP}, b AS (SELECT r, c, 'v' AS band FROM li UNION ALL SELECT r, c, 'q' FROM li WHERE q > 10 UNION ALL SELECT r, c, 'x' FROM li WHERE x > 0.02), k AS (SELECT r, c, count(*) AS n FROM b GROUP BY ALL), w AS (SELECT * FROM b UNION ALL SELECT r, c, 'any' FROM k UNION ALL SELECT r, c, 'all' FROM k WHERE n = 3)
      SELECT band, count(*) AS px, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM w GROUP BY band""",
    "miss_reach": f"""WITH {EV}, m AS (SELECT r, c FROM main WHERE p > 0.5), x AS (SELECT o.r, o.c, min(sqrt((o.r - t.r) * (o.r - t.r) + (o.c - t.c) * (o.c - t.c))) AS d FROM truth o LEFT JOIN m t ON true GROUP BY ALL)
      SELECT count(*) AS n, round(avg(CASE WHEN d <= 3 THEN 1 ELSE 0 END), 6) AS within, round(avg(CASE WHEN d > 3 THEN 1 ELSE 0 END), 6) AS beyond, round(avg(CASE WHEN d IS NULL THEN 1 ELSE 0 END), 6) AS unreachable FROM x""",
    "row_predicates": f"WITH {EV}, {SWEEP}, h AS (SELECT candidate, fi, width, fi % 2 = 0 AND NOT (width = 2) AS hard FROM sweep) SELECT candidate, hard, hard AND fi = 0 AND width = 0 AS adopted FROM h",
    "supervision_modes": f"""WITH {EV}, k AS (SELECT * FROM (VALUES ('union', 'error'), ('union', 'signup'), ('union', 'click'), ('proxy_only', 'signup'), ('catalogue', 'error')) v(mode, kind)), co AS (SELECT unnest([0, 2]) AS corridor),
      x AS (SELECT DISTINCT mode, corridor, r + dy AS r, c + dx AS c FROM ev JOIN k USING (kind), co, disk WHERE d <= corridor) SELECT mode, corridor, count(*) AS px FROM x GROUP BY ALL""",
    "policy_precedence": """WITH o AS (SELECT CAST(month(o_orderdate) AS INT) AS m FROM orders GROUP BY 1), x AS (SELECT m, CASE WHEN m % 3 = 0 THEN m / 100 END AS e, CASE WHEN m % 2 = 0 THEN CAST('0.' || m AS DOUBLE) END AS a, CASE WHEN m <> 1 THEN 0.3::DOUBLE END AS k FROM o)
      SELECT m, round(coalesce(e, a, k), 6) AS t0, CASE WHEN e IS NOT NULL THEN 'explicit' WHEN a IS NOT NULL THEN 'adopted' WHEN k IS NOT NULL THEN 'calibrated' END AS source FROM x""",
    "population_agreement": f"WITH {EV}, {population('lb', 'truth')}, {population('px', 'other')}, {diffs('lb', 'purchase')}, {diffs('px', 'purchase')}, {AGREE} SELECT * FROM agree",
    "majority_conflict": f"""WITH {EV}, {population('lb', 'truth')}, {population('px', 'other')}, {diffs('lb', 'click')}, {diffs('px', 'click')}, {AGREE}, w AS (SELECT candidate, round({SCORE}, 6) AS dti FROM px GROUP BY candidate)
      SELECT a.candidate, gain, scoreable, w.dti, r.dti AS reference_dti, gain > scoreable / 2 AND w.dti < r.dti AS conflict FROM agree a JOIN w USING (candidate) JOIN w r ON r.candidate = 'click'""",
    "rescore_audit": f"WITH {EV}, {parts('fields', '0')} SELECT candidate, round({GLOBAL}, 6) AS dti, true AS ok FROM comp GROUP BY candidate",
    "baselines": f"""WITH {EV}, base AS (SELECT 'copy' AS candidate, r, c, 1::DOUBLE AS p FROM truth UNION ALL SELECT 'blanket', r, c, 1 FROM foot), {parts('base', '0')}
      SELECT candidate, round(sum(tp), 6) AS tp, round(sum(fp), 6) AS fp, CAST(sum(n_gt) AS BIGINT) AS n_gt, round({GLOBAL}, 6) AS dti FROM comp GROUP BY candidate UNION ALL SELECT 'zeros', 0, 0, count(*), CASE WHEN count(*) > 0 THEN 0 ELSE 1 END FROM truth""",
    "transfer_verdict": f"""WITH {EV.replace("truth AS (SELECT DISTINCT r, c FROM ev WHERE kind = 'error')", "labels_ AS (SELECT DISTINCT r, c FROM ev WHERE kind = 'error'), disk0 AS (SELECT CAST(y AS INT) AS dy, CAST(x AS INT) AS dx FROM range(-3, 4) a(y), range(-3, 4) b(x) WHERE y * y + x * x <= 9), truth AS (SELECT DISTINCT r, c FROM ev ANTI JOIN (SELECT r + dy AS r, c + dx AS c FROM labels_, disk0) n USING (r, c) WHERE kind = 'signup')")},
      uni AS (SELECT w, r, c, max(p) AS p FROM (SELECT w, r, c, p FROM main, (SELECT unnest([1, 2]) AS w) UNION ALL SELECT w, r + dy, c + dx, 1 FROM ev, disk, (SELECT unnest([1, 2]) AS w) WHERE kind = 'click' AND d <= w) GROUP BY w, r, c),
      base AS (SELECT 0 AS candidate, r, c, 1::DOUBLE AS p FROM labels_ UNION ALL SELECT 1, r, c, 1 FROM truth UNION ALL SELECT 2, r, c, p FROM main UNION ALL SELECT 2 + w, r, c, p FROM uni), {parts('base', '0')}, s AS (SELECT candidate, {GLOBAL} AS dti FROM comp GROUP BY candidate)
      SELECT ['labels_copy', 'truth_copy', 'model', 'union', 'union'][candidate + 1] AS kind, CAST(CASE WHEN candidate > 2 THEN candidate - 2 ELSE -1 END AS INT) AS width, round(dti, 6) AS dti, CASE WHEN candidate = 0 THEN dti < 0.05 WHEN candidate = 1 THEN dti > 0.99
        WHEN candidate > 2 THEN (SELECT dti < 0.05 FROM s WHERE candidate = 0) AND (SELECT dti > 0.99 FROM s WHERE candidate = 1) AND dti - (SELECT dti FROM s WHERE candidate = 2) > 0 END AS ok FROM s""",
    "row_crosscheck": f"""WITH {EV}, {SWEEP} SELECT candidate, CASE WHEN candidate = 32 THEN 'not_available' WHEN width = 2 THEN 'MISMATCH' ELSE 'reproduced' END AS status, CASE WHEN candidate = 32 THEN NULL WHEN candidate = 22 THEN 'dti,pred_px' WHEN width = 2 THEN 'dti' ELSE '' END AS "off" FROM sweep""",
    "paired_contrast": f"""WITH {EV}, {parts('fields', FOLD)}, w AS (SELECT * FROM comp UNION ALL SELECT candidate, -1, tp, fp, n_gt, pred_px FROM comp), s AS (SELECT candidate, part, CASE WHEN sum(n_gt) > 0 THEN {SCORE} END AS dti FROM w GROUP BY candidate, part)
      SELECT CAST(a.part AS INT) AS part, round(a.dti, 6) AS dti_a, round(b.dti, 6) AS dti_b, round(b.dti - a.dti, 6) AS contrast, abs(b.dti - a.dti) <= 1e-9 AS identical FROM s a JOIN s b ON a.part = b.part AND a.candidate = 'purchase' AND b.candidate = 'click'""",
    "arms_verdict": f"""WITH {EV}, {population('lb', 'truth')}, {population('px', 'other')}, a AS (SELECT candidate, {SCORE} AS d FROM lb GROUP BY candidate), b AS (SELECT candidate, {SCORE} AS d FROM px GROUP BY candidate),
      x AS (SELECT round((SELECT d FROM a WHERE candidate = 'click') - (SELECT d FROM a WHERE candidate = 'purchase'), 6) AS labels, round((SELECT d FROM b WHERE candidate = 'click') - (SELECT d FROM b WHERE candidate = 'purchase'), 6) AS proxy)
      SELECT labels, proxy, NULL::DOUBLE AS combined, CASE WHEN proxy > 0 AND labels > 0 THEN 'GAIN_ON_BOTH' WHEN proxy <= 0 AND labels <= 0 THEN 'LOSS_ON_BOTH' WHEN proxy > 0 THEN 'PROXY_GAINS_LABELS_LOSE' ELSE 'LABELS_GAIN_PROXY_LOSES' END AS verdict FROM x""",
    "gate_degradations": """WITH p AS (SELECT CAST(p_size AS VARCHAR) AS name, count(*) AS n, sum(p_partkey) AS k FROM part GROUP BY 1), s AS (SELECT name, ['PASS', 'FAIL', 'MISSING', 'SKIPPED'][CAST(n % 4 AS INT) + 1] AS "old", ['PASS', 'FAIL', 'MISSING', 'SKIPPED'][CAST(k % 4 AS INT) + 1] AS "new" FROM p)
      SELECT * FROM s WHERE "old" = 'PASS' AND "new" IN ('MISSING', 'SKIPPED')""",
    "artifact_differences": f"WITH {EV} SELECT r, c, CASE WHEN p > 0.3 THEN 'a' ELSE 'b' END AS side FROM main WHERE (p > 0.3 AND NOT (p > 0.32 OR p < 0.01)) OR p < 0.01",
    "fold_complement": f"WITH {EV} SELECT CAST(f AS INT) AS fold FROM range(0, 8) x(f) WHERE f NOT IN (SELECT {FOLD} FROM foot)",
    "clean_members": """WITH m AS (SELECT n_name AS name, CASE WHEN n_nationkey % 5 > 0 THEN [n_nationkey % 2, n_nationkey % 3, n_nationkey % 4] ELSE [] END AS h FROM nation)
      SELECT name, list_contains(h, 0) AS clean_selection, list_contains(h, 1) AS clean_measure, list_contains(h, 0) AND list_contains(h, 1) AS clean_pool FROM m""",
    "run_bytes": f"""WITH {SHIP}, q AS (SELECT r, c, CASE WHEN NOT valid THEN 2 WHEN v > 50000 THEN 1 ELSE 0 END AS code FROM dn), m AS (SELECT *, CASE WHEN code <> lag(code) OVER (PARTITION BY r ORDER BY c) THEN 1 ELSE 0 END AS new FROM q), x AS (SELECT r, c, code, sum(new) OVER (PARTITION BY r ORDER BY c) AS run FROM m),
      y AS (SELECT r, run, count(*) AS length, any_value(code) AS code FROM x GROUP BY r, run) SELECT r, CAST(sum(length) AS BIGINT) AS cells, string_agg({HEX_LENGTH} || printf('%02x', code), '' ORDER BY run) AS blob FROM y GROUP BY r""",
    "run_bytes_back": f"WITH {SHIP} SELECT count(*) FILTER (valid AND v <= 50000) AS zeros, count(*) FILTER (valid AND v > 50000) AS ones, count(*) FILTER (NOT valid) AS nulls, CAST(0 AS BIGINT) AS others FROM dn",
    "json_fallbacks": """WITH e AS (SELECT event_type, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_type, count(k) AS found, CAST(sum(k) AS BIGINT) AS total, count(k) FILTER (event_id % 2 <> 0) AS first_only FROM e GROUP BY event_type""",
    "document_audits": f"""WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"#?]*)', 1)) AS href FROM pages), a AS (SELECT page_id, 'another host' AS problem FROM l WHERE {HOSTS} <> '' AND NOT ({' OR '.join(f"{HOSTS} = '{h}' OR ends_with({HOSTS}, '.{h}')" for h in ('example.com', 'example.org'))})
      UNION ALL SELECT page_id, 'no page' FROM l WHERE starts_with(href, '/') AND href NOT IN (SELECT regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) FROM pages)) SELECT problem, count(*) AS n, count(DISTINCT page_id) AS pages FROM a GROUP BY problem""",
    "entity_repair": f"""WITH x AS (SELECT source, unnest(regexp_extract_all(text, '{LIKE}')) AS raw FROM documents), y AS (SELECT source, raw, {RIGHT} AS fine FROM x), z AS (SELECT source, raw <> fine AS changed, list_max(list_transform(string_split(fine, '.'), lambda v: CAST(v AS INT))) <= 255 AS good FROM y)
      SELECT source, count(*) AS found, count(*) FILTER (good AND changed) AS repaired, count(*) FILTER (NOT good) AS rejected FROM z GROUP BY source""",
    "dem_stack": f"""WITH {SHIP}, {FILLED}, gr AS (SELECT *, {gradient('v', 'r', 'c')} AS gy, {gradient('v', 'c', 'r')} AS gx FROM dm), g2 AS (SELECT *, {gradient('gy', 'r', 'c')} AS gyy, {gradient('gx', 'c', 'r')} AS gxx, pi() / 2 - atan(sqrt(gx * gx + gy * gy)) AS s, atan2(-gy, gx) AS a FROM gr),
      near AS MATERIALIZED (SELECT a.r, a.c, a.v, s.y, t.x, greatest(r0, least(r1, a.r + s.y)) AS nr, greatest(c0, least(c1, a.c + t.x)) AS nc FROM dm a CROSS JOIN box CROSS JOIN range(-3, 4) s(y) CROSS JOIN range(-3, 4) t(x)),
      t AS (SELECT n.r, n.c, any_value(n.v) - sum(b.v) / 49 AS tpi, sum(abs(b.v - n.v)) FILTER (abs(n.y) <= 1 AND abs(n.x) <= 1) / 9 AS tri FROM near n JOIN dm b ON b.r = n.nr AND b.c = n.nc GROUP BY n.r, n.c)
      SELECT g2.r, g2.c, round(degrees(atan(sqrt(gx * gx + gy * gy))), 5) AS slope, round(gxx + gyy + 0.0, 5) AS curvature, round(tpi, 3) AS tpi, round(tri, 3) AS tri, round(255 * (sin(radians(45)) * sin(s) + cos(radians(45)) * cos(s) * cos(radians(45) - pi() / 2 - g2.a) + 1) / 2, 5) AS hillshade
      FROM g2 JOIN t ON t.r = g2.r AND t.c = g2.c WHERE valid""",
    "combined_losses": f"""WITH {EV}, {parts('main', '0')}, py AS (SELECT p, CASE WHEN t.r IS NULL THEN 0 ELSE 1 END AS y FROM main m LEFT JOIN truth t ON t.r = m.r AND t.c = m.c), s AS (SELECT sum(p * y) AS tp, sum(p * (1 - y)) AS fp, sum((1 - p) * y) AS fn, avg(-(y * ln(greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, p))) + (1 - y) * ln(1 - greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, p))))) AS e FROM py),
      l AS (SELECT pow(1 - (tp + 1e-6::DOUBLE) / (tp + 0.2::DOUBLE * fp + 0.8::DOUBLE * fn + 1e-6::DOUBLE), 0.75) AS f, e FROM s), w AS (SELECT 1 - {SCORE} AS w FROM comp) SELECT round(w, 6) AS weighted, round(f, 6) AS focal, round(e, 6) AS entropy, round(0.3 * e + 0.5 * w + 0.2 * f, 6) AS combined FROM l, w""",
    "ensemble_softmax": f"""WITH {EV}, {parts('fields', '0')}, s AS (SELECT candidate, round({GLOBAL}, 9) AS dti FROM comp GROUP BY candidate), x AS (SELECT candidate, exp(8 * (dti - (SELECT max(dti) FROM s))) AS x FROM s), w AS (SELECT candidate, x / (SELECT sum(x) FROM x) AS w FROM x)
      SELECT r, c, round(sum(w * p) / sum(w), 6) AS p FROM fields JOIN w USING (candidate) GROUP BY r, c""",
    "width_gains": f"WITH {EV}, {SWEEP}, g AS (SELECT fi, max_by(dti, width) - min_by(dti, width) AS gain FROM sweep GROUP BY fi) SELECT count(gain) AS n, round(min(gain), 6) AS low, round(avg(gain), 6) AS mean, round(max(gain), 6) AS high FROM g",
    "rank_of_shipped": f"WITH {EV}, {SWEEP}, k AS (SELECT candidate, CAST(row_number() OVER (ORDER BY dti DESC, width, candidate) AS INT) AS rank FROM sweep) SELECT max(rank) FILTER (candidate = 11) AS rank, count(*) AS n FROM k",
    "stable_top": f"WITH {EV}, {SWEEP}, k AS (SELECT width, fi, dti, CAST(row_number() OVER (PARTITION BY width ORDER BY dti DESC, fi) AS INT) AS rank FROM sweep) SELECT *, (SELECT count(DISTINCT fi) = 1 FROM k WHERE rank = 1) AS stable FROM k",
    "calibrated_means": f"""WITH {EV}, {EMISSIONS}, {parts('emit', FOLD)}, s AS (SELECT part AS fold, candidate, CASE WHEN n_gt > 0 THEN {DTI} END AS dti FROM comp), m AS (SELECT candidate, avg(dti) AS mean FROM s GROUP BY candidate)
      SELECT candidate, round(mean, 6) AS mean, row_number() OVER (ORDER BY round(mean, 9) DESC, candidate = 30 DESC, candidate) = 1 AS best FROM m""",
    "fold_gap_signs": f"""WITH {EV}, {parts('fields', BLOCK)}, s AS (SELECT candidate, part, CASE WHEN n_gt > 0 THEN {DTI} END AS dti FROM comp), g AS (SELECT round(a.dti - b.dti, 9) AS gap FROM s a JOIN s b ON a.part = b.part AND a.candidate = 'purchase' AND b.candidate = 'click' WHERE a.dti IS NOT NULL AND b.dti IS NOT NULL)
      SELECT count(gap) AS n, round(avg(gap), 6) AS mean, round(min(gap), 6) AS low, round(max(gap), 6) AS high, round(max(gap) - min(gap), 6) AS spread, count(*) FILTER (gap > 1e-6) AS positive, count(*) FILTER (gap < -1e-6) AS negative, count(*) FILTER (abs(gap) <= 1e-6) AS near_zero FROM g""",
    "gaussian_detrend": f"""WITH {SHIP}, g0 AS (SELECT x, exp(-x * x / 128::DOUBLE) AS w FROM range(-32, 33) t(x)), g AS MATERIALIZED (SELECT x, w / (SELECT sum(w) FROM g0) AS w FROM g0), full_ AS MATERIALIZED (SELECT * FROM dn),
      a AS MATERIALIZED (SELECT r, c, greatest(r0, least(r1, r + x)) AS nr, w FROM full_, box, g), p AS MATERIALIZED (SELECT a.r, a.c, sum(w * f.v) AS v FROM a JOIN full_ f ON f.r = a.nr AND f.c = a.c GROUP BY a.r, a.c),
      b AS MATERIALIZED (SELECT r, c, greatest(c0, least(c1, c + x)) AS nc, w FROM full_, box, g), q AS (SELECT b.r, b.c, sum(w * p.v) AS v FROM b JOIN p ON p.r = b.r AND p.c = b.nc GROUP BY b.r, b.c)
      SELECT f.r, f.c, round(f.v - q.v, 3) AS x FROM full_ f JOIN q ON q.r = f.r AND q.c = f.c WHERE valid""",
    "structure_coherence": f"""WITH {SHIP}, full_ AS MATERIALIZED (SELECT * FROM dn), s AS (SELECT unnest([-1, 0, 1]) AS s), n AS MATERIALIZED (SELECT f.r, f.c, y.s AS y, x.s AS x, f.r + y.s AS nr, f.c + x.s AS nc FROM full_ f, s y, s x),
      d AS MATERIALIZED (SELECT n.r, n.c, sum(n.y * (2 - abs(n.x)) * f.v) AS dy, sum(n.x * (2 - abs(n.y)) * f.v) AS dx FROM n JOIN full_ f ON f.r = n.nr AND f.c = n.nc GROUP BY n.r, n.c),
      g0 AS (SELECT x, exp(-x * x / 4.5::DOUBLE) AS w FROM range(-6, 7) t(x)), g AS MATERIALIZED (SELECT x, w / (SELECT sum(w) FROM g0) AS w FROM g0), a AS MATERIALIZED (SELECT r, c, r + x AS nr, w FROM full_, g), b AS MATERIALIZED (SELECT r, c, c + x AS nc, w FROM full_, g),
      p AS MATERIALIZED (SELECT a.r, a.c, sum(w * dy * dy) AS yy, sum(w * dy * dx) AS yx, sum(w * dx * dx) AS xx FROM a JOIN d ON d.r = a.nr AND d.c = a.c GROUP BY a.r, a.c),
      q AS MATERIALIZED (SELECT b.r, b.c, sum(w * yy) AS yy, sum(w * yx) AS yx, sum(w * xx) AS xx FROM b JOIN p ON p.r = b.r AND p.c = b.nc GROUP BY b.r, b.c)
      SELECT f.r, f.c, round(CASE WHEN yy + xx > 0 THEN least(1, sqrt(greatest(0, (yy + xx) * (yy + xx) - 4 * (yy * xx - yx * yx))) / (yy + xx)) ELSE 0 END, 4) AS x FROM full_ f JOIN q ON q.r = f.r AND q.c = f.c WHERE valid""",
    "field_format": f"""WITH {EV}, f AS (SELECT 'whole' AS form, 1 AS k, r, c, p FROM main UNION ALL SELECT 'doubled', 1, r, c, p * 2 FROM main UNION ALL SELECT 'half', 1, r, c, p FROM main WHERE p > 0.5 UNION ALL SELECT 'twice', 2, r, c, p FROM main),
      g AS (SELECT form, max(k) AS k, max(p) AS hi, min(p) AS lo, count(*) AS n FROM f GROUP BY form) SELECT form, concat_ws(',', CASE WHEN k > 1 THEN 'cells' END, CASE WHEN lo < -0.01 OR hi > 1.01 THEN 'range' END, CASE WHEN n < (SELECT count(*) FROM main) THEN 'mask' END,
        CASE WHEN (SELECT count(*) FROM main) - n > 0.9 * (SELECT count(*) FROM main) THEN 'missing' END) AS failed FROM g""",
    "class_ids_appended": """WITH k AS (SELECT 'view' AS cls, 3 AS id UNION ALL SELECT 'click', 5), n AS (SELECT event_type AS cls, min(event_id) AS first_at FROM events WHERE event_type NOT IN (SELECT cls FROM k) GROUP BY 1)
      SELECT cls AS "class", id FROM k UNION ALL SELECT cls, CAST(5 + row_number() OVER (ORDER BY first_at, cls) AS INT) FROM n""",
}
