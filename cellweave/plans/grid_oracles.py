"""DuckDB SQL for the queries of grid_queries, over the same tables."""

from __future__ import annotations

EV = """
ev AS (SELECT CAST(user_id AS INT) AS r, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS INT) AS c, event_type AS kind, value FROM events),
foot AS (SELECT DISTINCT r, c FROM ev),
truth AS (SELECT DISTINCT r, c FROM ev WHERE kind = 'error'),
other AS (SELECT DISTINCT r, c FROM ev WHERE kind = 'signup'),
allf AS (SELECT kind AS candidate, r, c, max(greatest(0::DOUBLE, least(1::DOUBLE, value / 500::DOUBLE))) AS p FROM ev WHERE kind IN ('purchase', 'click', 'view') GROUP BY ALL),
fields AS (SELECT * FROM allf WHERE p > 0),
main AS (SELECT * FROM fields WHERE candidate = 'purchase'),
disk AS (SELECT CAST(y AS INT) AS dy, CAST(x AS INT) AS dx, sqrt(y * y + x * x) AS d, greatest(0::DOUBLE, 1 - sqrt(y * y + x * x) / 3::DOUBLE) AS k FROM range(-3, 4) a(y), range(-3, 4) b(x) WHERE y * y + x * x <= 9),
near AS (SELECT r + dy AS r, c + dx AS c, max(k) AS m FROM truth, disk WHERE k > 0 GROUP BY ALL)
"""
BLOCKS = """
size AS (SELECT max(r) + 1 AS h FROM foot),
grid AS (SELECT CAST(y * 12 + x AS INT) AS block, CAST(y AS INT) AS block_row, CAST(x AS INT) AS block_col, h FROM size, range(0, (SELECT CAST(ceil(h / 64.0) AS BIGINT) FROM size)) a(y), range(0, 12) b(x)),
px AS (SELECT (f.r // 64) * 12 + f.c // 64 AS block, count(*) AS valid_px, count(t.r) AS fault_px FROM foot f LEFT JOIN truth t ON f.r = t.r AND f.c = t.c GROUP BY 1),
bt AS (SELECT g.block, block_row, block_col, CAST((least((block_row + 1) * 64, h) - block_row * 64) * (least((block_col + 1) * 64, 720) - block_col * 64) AS BIGINT) AS area_px, coalesce(valid_px, 0) AS valid_px, coalesce(fault_px, 0) AS fault_px FROM grid g LEFT JOIN px USING (block))
"""
FOLDS = (
    BLOCKS
    + """,
nb AS (SELECT max(block_row) + 1 AS n FROM bt),
cf AS (SELECT bt.*, CASE WHEN valid_px = 0 THEN -1 ELSE CAST((CASE WHEN block_row < (n % 2) * (n // 2 + 1) THEN block_row // (n // 2 + 1) ELSE n % 2 + (block_row - (n % 2) * (n // 2 + 1)) // greatest(n // 2, 1) END) * 2 + block_col // 6 AS INT) END AS fold FROM bt, nb)
"""
)
ZONES = (
    FOLDS
    + """,
steps AS (SELECT unnest([-3, 0, 3]) AS s),
around AS (SELECT DISTINCT f.r, f.c, (f.r + a.s + 64) // 64 - 1 AS y, (f.c + b.s + 64) // 64 - 1 AS x FROM foot f, steps a, steps b),
zones AS (SELECT fold, r, c, CASE WHEN max(CASE WHEN y = r // 64 AND x = c // 64 THEN 1 ELSE 0 END) = 1 THEN 'scored' ELSE 'collar' END AS zone
  FROM around JOIN cf ON cf.block_row = y AND cf.block_col = x AND fold >= 0 GROUP BY fold, r, c)
"""
)
DTI = "tp / (tp + 0.2::DOUBLE * fp + 0.8::DOUBLE * (n_gt - tp) + 1e-7::DOUBLE)"


def parts(field: str, part: str) -> str:
    """CTEs up to comp: candidate, part, tp, fp, n_gt, pred_px."""
    return f"""
cred AS (SELECT candidate, t.r, t.c, max(k * p) AS credit FROM truth t CROSS JOIN disk JOIN {field} f ON f.r = t.r + dy AND f.c = t.c + dx WHERE k > 0 GROUP BY ALL),
pen AS (SELECT candidate, f.r, f.c, p * (1 - coalesce(m, 0)) AS fp FROM {field} f LEFT JOIN near n ON f.r = n.r AND f.c = n.c),
a AS (SELECT {part} AS part, count(*) AS n_gt FROM truth GROUP BY 1),
b AS (SELECT candidate, {part} AS part, sum(credit) AS tp FROM cred GROUP BY 1, 2),
d AS (SELECT candidate, {part} AS part, sum(fp) AS fp, count(*) AS pred_px FROM pen GROUP BY 1, 2),
comp AS (SELECT n.candidate, q.part, coalesce(b.tp, 0) AS tp, coalesce(d.fp, 0) AS fp, coalesce(a.n_gt, 0) AS n_gt, coalesce(d.pred_px, 0) AS pred_px
  FROM (SELECT DISTINCT candidate FROM {field}) n CROSS JOIN (SELECT part FROM a UNION SELECT part FROM d) q
  LEFT JOIN a ON a.part = q.part LEFT JOIN b ON b.part = q.part AND b.candidate = n.candidate LEFT JOIN d ON d.part = q.part AND d.candidate = n.candidate)
"""


BLOCK = "CAST((r // 64) * 12 + c // 64 AS INT)"
FOLD = f"CAST(({BLOCK}) % 4 AS INT)"
NUMBERS = "CAST(sum(n_gt) AS BIGINT) AS n_gt, CAST(sum(pred_px) AS BIGINT) AS pred_px"
SUMS = "round(sum(tp), 6) AS tp, round(sum(fp), 6) AS fp, round(sum(n_gt) - sum(tp), 6) AS fn, " + NUMBERS
SCORE = "sum(tp) / (sum(tp) + 0.2::DOUBLE * sum(fp) + 0.8::DOUBLE * (sum(n_gt) - sum(tp)) + 1e-7::DOUBLE)"
GLOBAL = f"CASE WHEN sum(n_gt) > 0 THEN {SCORE} WHEN sum(fp) = 0 THEN 1 ELSE 0 END"
EMISSIONS = """
lev AS (SELECT * FROM (VALUES (0, 0.1::DOUBLE), (1, 0.3::DOUBLE), (2, 0.5::DOUBLE), (3, 0.7::DOUBLE)) v(fi, t0)),
mask AS (SELECT fi, r, c FROM main, lev WHERE p > t0),
emit AS (SELECT DISTINCT fi * 10 + w AS candidate, r + dy AS r, c + dx AS c, 1::DOUBLE AS p FROM mask, disk, (SELECT unnest([0, 1, 2]) AS w) WHERE d <= w AND r + dy >= 0 AND c + dx BETWEEN 0 AND 719)
"""
SWEEP = (
    EMISSIONS
    + ","
    + parts("emit", "0")
    + f""",
sweep AS (SELECT candidate, candidate // 10 AS fi, candidate % 10 AS width, {SUMS}, round({GLOBAL}, 6) AS dti FROM comp GROUP BY candidate),
judged AS (SELECT s.*, CASE WHEN pred_px < 20 THEN 'too few cells' WHEN pred_px > 0.5 * (SELECT count(*) FROM foot) THEN 'too many cells' END AS reason FROM sweep s)
"""
)
SHIP = """
li AS (SELECT CAST(l_suppkey AS INT) AS r, CAST(floor(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) / 7.0) AS INT) AS c, max(l_extendedprice) AS v, max(l_quantity) AS q, min(l_discount) AS x FROM lineitem GROUP BY 1, 2),
lb AS (SELECT r, c, 'v' AS band, CAST(v AS DOUBLE) AS v FROM li UNION ALL SELECT r, c, 'q', CAST(q AS DOUBLE) FROM li UNION ALL SELECT r, c, 'x', CAST(x AS DOUBLE) FROM li),
box AS (SELECT min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM li),
cellsg AS (SELECT CAST(a.r AS INT) AS r, CAST(b.c AS INT) AS c FROM range((SELECT r0 FROM box), (SELECT r1 + 1 FROM box)) a(r), range((SELECT c0 FROM box), (SELECT c1 + 1 FROM box)) b(c)),
dn AS (SELECT g.r, g.c, coalesce(CAST(li.v AS DOUBLE), 0) AS v, li.v IS NOT NULL AS valid FROM cellsg g LEFT JOIN li ON li.r = g.r AND li.c = g.c)
"""


def gradient(value: str, along: str, across: str) -> str:
    w = f"OVER (PARTITION BY {across} ORDER BY {along})"
    return f"CASE WHEN lag({value}) {w} IS NULL THEN (lead({value}) {w} - {value}) / 100 WHEN lead({value}) {w} IS NULL THEN ({value} - lag({value}) {w}) / 100 ELSE (lead({value}) {w} - lag({value}) {w}) / 200 END"


GRAD = SHIP + f", gr AS (SELECT *, {gradient('v', 'r', 'c')} AS gy, {gradient('v', 'c', 'r')} AS gx FROM dn)"


def window(half: int) -> str:
    return f"FROM dn a CROSS JOIN box CROSS JOIN range(-{half}, {half + 1}) s(y) CROSS JOIN range(-{half}, {half + 1}) t(x) JOIN dn b ON b.r = greatest(r0, least(r1, a.r + y)) AND b.c = greatest(c0, least(c1, a.c + x))"


def regions(source: str) -> str:
    return f"""
ids AS (SELECT r, c, CAST(r AS BIGINT) * 4294967296 + c AS id FROM {source}),
adj AS (SELECT a.id, b.id AS other FROM ids a JOIN (SELECT unnest([-1, 0, 1]) AS y) ON true JOIN (SELECT unnest([-1, 0, 1]) AS x) ON true JOIN ids b ON b.r = a.r + y AND b.c = a.c + x),
reach AS (SELECT id, id AS other FROM ids UNION SELECT reach.id, adj.other FROM reach JOIN adj ON adj.id = reach.other),
lab AS (SELECT ids.r, ids.c, min(other) AS region FROM reach JOIN ids USING (id) GROUP BY ALL),
sized AS (SELECT region, count(*) AS px, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1, greatest(max(r) - min(r), max(c) - min(c)) + 1 AS extent FROM lab GROUP BY region)
"""


STARTS = "(SELECT unnest(list_distinct(range(0, greatest(0, {n} - 64), 48) || [greatest(0, {n} - 64)])) AS w{of})"
WINDOWS = f"""
high AS (SELECT CAST(max(r) + 1 AS BIGINT) AS h FROM main),
inw AS (SELECT r, c, p, a.w AS win_r, b.w AS win_c FROM main JOIN {STARTS.format(n='h', of=' FROM high')} a ON r BETWEEN a.w AND a.w + 63 JOIN {STARTS.format(n='720', of='')} b ON c BETWEEN b.w AND b.w + 63)
"""
VIEWS = ", ".join(f"{{'view': {i}, 'y': {y}}}" for i, y in enumerate(["y", "x", "63 - y", "63 - x"] * 2))
ORDER_TEXT = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split())
FOLDED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[‘’]', '''', 'g'), '[“”]', '\"', 'g'), '[‐-―]', '-', 'g'), '-\\s*\\n\\s*', '', 'g')"
TIDY = "trim(regexp_replace(" + FOLDED + ", '\\s+', ' ', 'g'))"

LETTERS = "lower(regexp_replace({0}, '[^A-Za-z0-9]', '', 'g'))"

ORACLE_SQL = {
    "kernel_offsets": f"WITH {EV} SELECT dy, dx, round(d, 6) AS d, round(k, 6) AS k FROM disk",
    "dti_global": f"WITH {EV}, {parts('main', '0')} SELECT candidate, {SUMS}, round({GLOBAL}, 6) AS dti FROM comp GROUP BY candidate",
    "dti_by_block": f"WITH {EV}, {parts('main', BLOCK)} SELECT candidate, part, {SUMS}, CASE WHEN sum(n_gt) > 0 THEN round({SCORE}, 6) END AS dti FROM comp GROUP BY ALL",
    "dti_scopes": f"WITH {EV}, {parts('fields', FOLD)}, w AS (SELECT * FROM comp UNION ALL SELECT candidate, -1, tp, fp, n_gt, pred_px FROM comp) SELECT candidate, CAST(part AS INT) AS part, {SUMS}, CASE WHEN sum(n_gt) > 0 THEN round({SCORE}, 6) END AS dti FROM w GROUP BY candidate, part",
    "block_table": f"WITH {EV}, {BLOCKS} SELECT block, block_row, block_col, area_px, valid_px, fault_px, round(fault_px * 0.1::DOUBLE, 6) AS fault_km FROM bt",
    "fold_balanced": f"""WITH RECURSIVE {EV}, {BLOCKS},
      o AS (SELECT block, fault_px, valid_px, row_number() OVER (ORDER BY fault_px DESC, valid_px DESC, block) AS rn FROM bt WHERE valid_px > 0),
      want AS (SELECT greatest(1::DOUBLE, sum(fault_px) / 4::DOUBLE) AS wf, greatest(1::DOUBLE, sum(valid_px) / 4::DOUBLE) AS wv FROM o),
      deal AS (SELECT CAST(0 AS BIGINT) AS rn, -1 AS block, -1 AS fold, [0::BIGINT, 0, 0, 0] AS f, [0::BIGINT, 0, 0, 0] AS v
        UNION ALL SELECT rn, block, pick - 1, list_transform(f, lambda x, i: CASE WHEN i = pick THEN x + fault_px ELSE x END), list_transform(v, lambda x, i: CASE WHEN i = pick THEN x + valid_px ELSE x END)
        FROM (SELECT o.rn, o.block, o.fault_px, o.valid_px, deal.f, deal.v, CAST(list_position(list_transform(deal.f, lambda x, i: x / wf + deal.v[i] / wv), list_min(list_transform(deal.f, lambda x, i: x / wf + deal.v[i] / wv))) AS INT) AS pick
          FROM deal JOIN o ON o.rn = deal.rn + 1 CROSS JOIN want))
      SELECT block, fold FROM deal WHERE rn > 0 UNION ALL SELECT block, -1 FROM bt WHERE valid_px = 0""",
    "fold_contiguous": f"WITH {EV}, {FOLDS} SELECT block, fold FROM cf",
    "collar_mask": f"WITH {EV}, {ZONES} SELECT fold, zone, count(*) AS px FROM zones GROUP BY ALL",
    "partition_report": f"""WITH {EV}, {FOLDS}, g AS (SELECT fold, count(*) AS blocks, CAST(sum(fault_px) AS BIGINT) AS fault_px, CAST(sum(valid_px) AS BIGINT) AS valid_px FROM cf WHERE fold >= 0 GROUP BY fold)
      SELECT fold, blocks, fault_px, valid_px, round(fault_px / (SELECT sum(fault_px) FROM g), 6) AS fault_share, round(valid_px / (SELECT sum(valid_px) FROM g), 6) AS valid_share,
        round((SELECT (max(fault_px) - min(fault_px)) / avg(fault_px) FROM g), 6) AS spread FROM g""",
    "floor_profile": f"WITH {EV}, t AS (SELECT unnest([0, 0.1, 0.3, 0.5, 0.7])::DOUBLE AS t0) SELECT candidate, t0, count(*) FILTER (p > t0) AS px, round(coalesce(sum(p) FILTER (p > t0), 0), 6) AS mass FROM fields, t GROUP BY ALL",
    "soft_floors": f"WITH {EV} SELECT round(sum(CASE WHEN p <= 0.3 THEN 0 ELSE pow(greatest(0, least(1, (p - 0.3) / 0.7)), 2) END), 6) AS soft, round(sum(CASE WHEN p > 0.3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hard FROM main",
    "floor_grid": "SELECT CAST(i AS INT) AS i, t0::DOUBLE AS t0 FROM (VALUES (0, 0.0), (1, 0.001), (2, 0.01), (3, 0.1), (4, 1.0)) v(i, t0)",
    "sweep_floor_width": f"WITH {EV}, {SWEEP} SELECT * FROM sweep",
    "sweep_eligible": f"WITH {EV}, {SWEEP} SELECT candidate, pred_px, reason IS NULL AS eligible, reason FROM judged",
    "rank_candidates": f"WITH {EV}, {SWEEP} SELECT CAST(row_number() OVER (ORDER BY dti DESC, width, candidate) AS INT) AS rank, candidate, dti FROM judged WHERE reason IS NULL",
    "select_winner": f"WITH {EV}, {SWEEP} SELECT candidate, dti, pred_px FROM judged WHERE reason IS NULL ORDER BY dti DESC, width, candidate LIMIT 1",
    "best_per_width": f"WITH {EV}, {SWEEP} SELECT width, candidate, dti FROM sweep QUALIFY row_number() OVER (PARTITION BY width ORDER BY dti DESC, candidate) = 1",
    "matched_support": f"WITH {EV}, {SWEEP} SELECT fi % 2 AS field, tol::DOUBLE AS tol, candidate, dti, pred_px FROM sweep, (SELECT unnest([0.25, 0.5, 1.0]) AS tol), (SELECT count(*) AS s FROM truth) WHERE abs(pred_px - s) <= tol * s QUALIFY row_number() OVER (PARTITION BY fi % 2, tol ORDER BY dti DESC, candidate) = 1",
    "width_gain": f"WITH {EV}, {SWEEP} SELECT fi, round(max_by(dti, width) - min_by(dti, width), 6) AS gain FROM sweep GROUP BY fi",
    "marginal_gain": f"WITH {EV}, {SWEEP}, s AS (SELECT fi, width, lead(dti) OVER (PARTITION BY fi ORDER BY width) - dti AS step FROM sweep) SELECT fi, width, round(step, 6) AS step FROM s WHERE step IS NOT NULL",
    "projection_best": f"""WITH {EV}, {SWEEP}, s AS (SELECT size, candidate, round((tp / n_gt * size) / (tp / n_gt * size + 0.2::DOUBLE * fp + 0.8::DOUBLE * (size - tp / n_gt * size)), 6) AS value FROM sweep, (SELECT unnest([500, 5000, 50000])::DOUBLE AS size))
      SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY size ORDER BY value DESC, candidate) = 1""",
    "crossover": f"WITH {EV}, {SWEEP}, s AS (SELECT fi, width, tp / n_gt AS c, fp FROM sweep) SELECT a.fi, a.width, CASE WHEN a.c <> b.c THEN round(0.2::DOUBLE * (b.c * a.fp - a.c * b.fp) / (0.8::DOUBLE * (a.c - b.c)), 2) END AS size FROM s a JOIN s b ON a.fi = b.fi AND b.width = a.width + 1",
    "budget_table": """WITH t AS (SELECT a / 10::DOUBLE AS target, b / 2::DOUBLE AS ratio FROM range(1, 10) x(a), range(0, 5) y(b)),
      s AS (SELECT *, target * (0.2::DOUBLE * ratio + 0.8::DOUBLE) / (1 - 0.2::DOUBLE * target) AS coverage, (0.9::DOUBLE / target - 0.9::DOUBLE - 0.8::DOUBLE * (1 - 0.9::DOUBLE)) / 0.2::DOUBLE AS al FROM t)
      SELECT round(target, 6) AS target, ratio, round(coverage, 6) AS coverage, CASE WHEN al >= 0 THEN round(al, 6) END AS allowed, round(1 / (0.2::DOUBLE * (1 + ratio) + 0.8::DOUBLE), 6) AS ceiling FROM s""",
    "vote_k_of_n": f"WITH {EV}, v AS (SELECT r, c, count(DISTINCT kind) AS n FROM ev WHERE kind IN ('click', 'view', 'purchase') GROUP BY ALL) SELECT k, count(*) AS px FROM v, (SELECT unnest([1, 2, 3]) AS k) WHERE n >= k GROUP BY k",
    "union_max_field": f"WITH {EV} SELECT r, c, round(max(p), 6) AS p FROM fields GROUP BY ALL",
    "ensemble_mean": f"WITH {EV} SELECT r, c, round(sum(p * CASE candidate WHEN 'click' THEN 2 ELSE 1 END) / sum(CASE candidate WHEN 'click' THEN 2 ELSE 1 END), 6) AS p FROM fields GROUP BY ALL",
    "overlap_recall_precision": f"""WITH {EV} SELECT
      (SELECT round(avg(CASE WHEN EXISTS (SELECT 1 FROM other o, disk WHERE o.r + dy = t.r AND o.c + dx = t.c) THEN 1 ELSE 0 END), 6) FROM truth t) AS recall,
      (SELECT round(avg(CASE WHEN EXISTS (SELECT 1 FROM truth o, disk WHERE o.r + dy = t.r AND o.c + dx = t.c) THEN 1 ELSE 0 END), 6) FROM other t) AS "precision" """,
    "proxy_codes": f"WITH {EV}, n AS (SELECT DISTINCT r + dy AS r, c + dx AS c FROM truth, disk) SELECT o.r, o.c, CASE WHEN n.r IS NULL THEN 2 ELSE 1 END AS code FROM other o LEFT JOIN n ON n.r = o.r AND n.c = o.c",
    "novel_mass": f"WITH {EV}, x AS (SELECT candidate, p, p * (1 - coalesce(m, 0)) AS fp FROM fields f LEFT JOIN near n ON n.r = f.r AND n.c = f.c) SELECT candidate, round(sum(p), 6) AS mass, round(sum(fp), 6) AS novel, round(sum(fp) / sum(p), 6) AS share FROM x GROUP BY candidate",
    "components": f"WITH RECURSIVE {EV}, {regions('truth')} SELECT * FROM sized",
    "novel_components": f"WITH RECURSIVE {EV}, {regions('other')} SELECT * FROM sized WHERE px >= 2 AND region NOT IN (SELECT region FROM lab JOIN near n ON n.r = lab.r AND n.c = lab.c WHERE m > 0)",
    "drop_small": f"WITH RECURSIVE {EV}, {regions('truth')} SELECT r, c FROM lab WHERE region IN (SELECT region FROM sized WHERE px >= 2)",
    "component_stats": f"WITH RECURSIVE {EV}, {regions('truth')} SELECT count(*) AS n, CAST(sum(px) AS BIGINT) AS px, max(px) AS largest, max(extent) AS extent, round(quantile_cont(px, 0.5)::DOUBLE, 6) AS median FROM sized",
    "edt": f"WITH {EV} SELECT o.r, o.c, round(min(sqrt((o.r - t.r) * (o.r - t.r) + (o.c - t.c) * (o.c - t.c))), 6) AS d FROM other o, truth t GROUP BY ALL",
    "miss_distance": f"""WITH {EV}, m AS (SELECT r, c FROM main WHERE p > 0.5), x AS (SELECT o.r, o.c, min(sqrt((o.r - t.r) * (o.r - t.r) + (o.c - t.c) * (o.c - t.c))) AS d FROM truth o, m t GROUP BY ALL)
      SELECT count(*) AS n, {', '.join(f'round(avg(CASE WHEN d <= {k} THEN 1 ELSE 0 END), 6) AS within_{k}' for k in (3, 6, 12))}, {', '.join(f'round(quantile_cont(d, {q / 100}), 6) AS p{q}' for q in (50, 75, 90, 95))}, round(max(d), 6) AS most FROM x""",
    "dilate_band": f"WITH {EV}, e AS (SELECT DISTINCT w AS width, r + dy AS r, c + dx AS c FROM truth, disk, (SELECT unnest([1, 2, 3]) AS w) WHERE d <= w) SELECT width, count(*) AS px FROM e GROUP BY width",
    "soft_band": f"WITH {EV}, e AS (SELECT w AS width, r + dy AS r, c + dx AS c, min(d) AS d FROM truth, disk, (SELECT unnest([1, 2, 3]) AS w) WHERE d <= w GROUP BY ALL) SELECT width, count(*) AS px, round(sum(pow(1 - d / (width + 1), 2)), 6) AS mass FROM e GROUP BY width",
    "closing": f"""WITH {EV}, s AS (SELECT unnest([-1, 0, 1]) AS s), dl AS (SELECT DISTINCT r + a.s AS r, c + b.s AS c FROM foot, s a, s b)
      SELECT r, c FROM (SELECT r + a.s AS r, c + b.s AS c FROM dl, s a, s b) GROUP BY ALL HAVING count(*) = 9""",
    "shift_robustness": f"""WITH {EV}, st AS (SELECT CAST(q AS INT) AS q, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM (SELECT row_number() OVER (ORDER BY y, x) AS q, y, x FROM range(-1, 2) a(y), range(-1, 2) b(x) WHERE y <> 0 OR x <> 0)),
      sh AS (SELECT rad * 100 + q AS candidate, r + y * rad AS r, c + x * rad AS c, 1::DOUBLE AS p FROM main, st, (SELECT unnest([1, 2]) AS rad) WHERE p > 0.3 AND r + y * rad >= 0 AND c + x * rad BETWEEN 0 AND 719),
      {parts('sh', '0')}, g AS (SELECT candidate // 100 AS radius, {GLOBAL} AS dti FROM comp GROUP BY candidate) SELECT radius, round(avg(dti), 6) AS mean, round(min(dti), 6) AS worst FROM g GROUP BY radius""",
    "bootstrap_paired": f"""WITH {EV}, {parts('fields', BLOCK)}, sl AS (SELECT part, row_number() OVER (ORDER BY part) - 1 AS slot FROM (SELECT DISTINCT part FROM comp)), n AS (SELECT count(*) AS n FROM sl),
      dr AS (SELECT boot, (boot * 7919 + place * 104729 + 17) % n AS slot FROM n, range(0, 200) a(boot), range(0, (SELECT n FROM n)) b(place)),
      s AS (SELECT boot, candidate, {SCORE} AS dti FROM dr JOIN sl USING (slot) JOIN comp USING (part) GROUP BY ALL), x AS (SELECT s.candidate, s.dti, round(s.dti - t.dti, 12) AS diff FROM s JOIN s t ON t.boot = s.boot AND t.candidate = 'purchase')
      SELECT candidate, {', '.join(f'round(quantile_cont({c}, {q}), 6) AS {a}_p{m}' for c, a in (('dti', 'dti'), ('diff', 'contrast')) for q, m in ((0.025, '2_5'), (0.5, '50'), (0.975, '97_5')))}, CASE WHEN candidate <> 'purchase' THEN round(avg(CASE WHEN diff > 0 THEN 1 ELSE 0 END), 6) END AS prob_beats FROM x GROUP BY candidate""",
    "sign_agreement": f"""WITH {EV}, {parts('fields', BLOCK)}, s AS (SELECT candidate, part, CASE WHEN n_gt > 0 THEN {DTI} END AS dti FROM comp), x AS (SELECT a.candidate, round(a.dti - b.dti, 9) AS d FROM s a JOIN s b ON a.part = b.part AND b.candidate = 'purchase' WHERE a.candidate <> 'purchase' AND a.dti IS NOT NULL AND b.dti IS NOT NULL)
      SELECT candidate, count(*) FILTER (d > 0) AS better, count(*) FILTER (d < 0) AS worse, count(*) FILTER (d = 0) AS equal, count(*) AS n, CASE WHEN count(*) >= 12 THEN 'readable' ELSE 'too few blocks' END AS reading FROM x GROUP BY candidate""",
    "cross_ensemble_rank": f"""WITH {EV}, lev AS (SELECT * FROM (VALUES (0, 0.1::DOUBLE), (1, 0.3::DOUBLE), (2, 0.5::DOUBLE), (3, 0.7::DOUBLE)) v(fi, t0)), hard AS (SELECT candidate || '-' || fi AS candidate, r, c, 1::DOUBLE AS p FROM fields, lev WHERE fields.p > t0), {parts('hard', '0')},
      s AS (SELECT split_part(candidate, '-', 1) AS sweep, CAST(split_part(candidate, '-', 2) AS INT) AS candidate, {GLOBAL} AS dti FROM comp GROUP BY comp.candidate), x AS (SELECT a.sweep, a.candidate, a.dti - b.dti AS contrast FROM s a JOIN s b ON a.sweep = b.sweep AND b.candidate = 0),
      g AS (SELECT candidate, min(contrast) AS worst, avg(contrast) AS mean, count(DISTINCT sweep) AS n FROM x GROUP BY candidate), k AS (SELECT candidate, worst, mean, CAST(row_number() OVER (ORDER BY round(worst, 9) DESC, round(mean, 9) DESC, candidate) AS INT) AS rank FROM g WHERE n = (SELECT count(DISTINCT sweep) FROM x))
      SELECT candidate, round(worst, 6) AS worst, round(mean, 6) AS mean, rank FROM k WHERE rank <= 3""",
    "loo_calibration": f"""WITH {EV}, {EMISSIONS}, {parts('emit', FOLD)}, s AS (SELECT part AS fold, candidate, CASE WHEN n_gt > 0 THEN {DTI} END AS dti FROM comp),
      m AS (SELECT h.fold AS held, s.candidate, avg(dti) AS mean FROM s JOIN (SELECT DISTINCT fold FROM s) h ON h.fold <> s.fold GROUP BY ALL), k AS (SELECT held, candidate FROM m QUALIFY row_number() OVER (PARTITION BY held ORDER BY round(mean, 9) DESC, candidate) = 1)
      SELECT k.held, k.candidate, round(s.dti, 6) AS dti, round(o.oracle, 6) AS oracle, round(o.oracle - s.dti, 6) AS regret FROM k JOIN s ON s.fold = k.held AND s.candidate = k.candidate JOIN (SELECT fold, max(dti) AS oracle FROM s GROUP BY fold) o ON o.fold = k.held""",
    "fold_gap": """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT') - avg(o_totalprice) FILTER (o_orderpriority <> '1-URGENT') AS gap FROM orders GROUP BY 1)
      SELECT count(gap) AS n, round(avg(gap), 4) AS mean, round(min(gap), 4) AS low, round(max(gap), 4) AS high, round(max(gap) - min(gap), 4) AS spread, count(*) FILTER (gap > 0) AS positive, count(*) FILTER (gap < 0) AS negative FROM m""",
    "did_exposure": """WITH x AS (SELECT quality = 1 AS t, d.doc_id % 2 = 1 AS e, n_chars FROM documents d JOIN labels USING (doc_id))
      SELECT round(((avg(n_chars) FILTER (t AND e) - avg(n_chars) FILTER (NOT t AND e)) - (avg(n_chars) FILTER (t AND NOT e) - avg(n_chars) FILTER (NOT t AND NOT e))) / 2, 4) AS effect FROM x""",
    "norm_stats": f"WITH {SHIP}, e AS (SELECT band, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM lb GROUP BY band) SELECT band, round(lo, 4) AS lo, round(hi, 4) AS hi, round(avg(v), 4) AS mean, round(CASE WHEN stddev_pop(v) < 1e-8 THEN 1 ELSE stddev_pop(v) END, 4) AS std FROM lb JOIN e USING (band) WHERE v BETWEEN lo AND hi GROUP BY band, lo, hi",
    "apply_norm": f"""WITH {SHIP}, e AS (SELECT band, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM lb GROUP BY band), s AS (SELECT band, lo, hi, avg(v) AS mean, CASE WHEN stddev_pop(v) < 1e-8 THEN 1 ELSE stddev_pop(v) END AS std FROM lb JOIN e USING (band) WHERE v BETWEEN lo AND hi GROUP BY band, lo, hi),
      z AS (SELECT band, least(1, greatest(0, 0.5 + 0.25 * (least(hi, greatest(lo, v)) - mean) / std)) AS z FROM lb JOIN s USING (band)) SELECT band, count(*) AS n, round(avg(z), 4) AS mean, round(min(z), 4) AS low, round(max(z), 4) AS high FROM z GROUP BY band""",
    "band_profile": f"WITH {SHIP} SELECT band, count(v) AS n, round(min(v), 4) AS low, round(max(v), 4) AS high, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(quantile_cont(v, 0.01), 4) AS p01, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.99), 4) AS p99, count(DISTINCT v) AS n_distinct FROM lb GROUP BY band",
    "value_top20": "SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 20",
    "quantise_roundtrip": f"""WITH {SHIP}, e AS (SELECT band, min(v) AS lo, max(v) AS hi, CASE WHEN max(v) > min(v) THEN (max(v) - min(v)) / 32000 ELSE 1 END AS step FROM lb GROUP BY band), k AS (SELECT band, v, lo, step, CAST(floor((v - lo) / step + 0.5) AS INT) - 16000 AS q FROM lb JOIN e USING (band))
      SELECT band, min(q) AS q0, max(q) AS q1, CAST(sum(q) AS BIGINT) AS total, round(max(abs(v - ((q + 16000) * step + lo))), 6) AS error FROM k GROUP BY band""",
    "window_stats": f"""WITH {SHIP}, s AS (SELECT a.r, a.c, any_value(a.valid) AS valid, sum(CASE WHEN b.valid THEN 1 ELSE 0 END)::DOUBLE AS n, sum(CASE WHEN b.valid THEN round(b.v * 100) ELSE 0 END) AS s1, sum(CASE WHEN b.valid THEN round(b.v * 100) * round(b.v * 100) ELSE 0 END) AS s2 {window(2)} GROUP BY a.r, a.c)
      SELECT r, c, CASE WHEN valid THEN CASE WHEN n / 25 > 0.5 THEN round(s1 / n, 4) ELSE 0 END END AS mean, CASE WHEN valid THEN CASE WHEN n / 25 > 0.5 THEN round(sqrt(greatest(0, s2 / n - (s1 / n) * (s1 / n))), 4) ELSE 0 END END AS std FROM s""",
    "slope": f"WITH {GRAD} SELECT r, c, round(degrees(atan(sqrt(gx * gx + gy * gy))), 5) AS slope FROM gr",
    "curvature": f"WITH {GRAD}, g2 AS (SELECT r, c, {gradient('gy', 'r', 'c')} AS gyy, {gradient('gx', 'c', 'r')} AS gxx FROM gr) SELECT r, c, round(gxx + gyy + 0.0, 9) AS curvature FROM g2",
    "hillshade": f"""WITH {GRAD}, h AS (SELECT r, c, pi() / 2 - atan(sqrt(gx * gx + gy * gy)) AS s, atan2(-gy, gx) AS a FROM gr)
      SELECT r, c, round(255 * (sin(radians(45)) * sin(s) + cos(radians(45)) * cos(s) * cos(radians(45) - pi() / 2 - a) + 1) / 2, 5) AS shade FROM h""",
    "tpi": f"WITH {SHIP}, s AS (SELECT a.r, a.c, any_value(a.v) AS v, sum(b.v) AS s {window(3)} GROUP BY a.r, a.c) SELECT r, c, round(v - s / 49, 3) AS tpi FROM s",
    "tri": f"WITH {SHIP} SELECT a.r, a.c, round(sum(abs(b.v - a.v)) / 9, 3) AS tri {window(1)} GROUP BY a.r, a.c",
    "rle_encode": f"""WITH {SHIP}, m AS (SELECT r, c, CAST(valid AS INT) AS code, CASE WHEN CAST(valid AS INT) <> lag(CAST(valid AS INT)) OVER (PARTITION BY r ORDER BY c) THEN 1 ELSE 0 END AS new FROM dn), x AS (SELECT r, c, code, sum(new) OVER (PARTITION BY r ORDER BY c) AS run FROM m)
      SELECT r, CAST(run AS BIGINT) AS run, min(c) AS start, count(*) AS length, any_value(code) AS code FROM x GROUP BY r, run""",
    "rle_roundtrip": f"WITH {SHIP} SELECT r, CAST(sum(CAST(valid AS INT)) AS BIGINT) AS valid, count(*) AS n FROM dn GROUP BY r",
    "best_window": f"""WITH {EV}, m AS (SELECT f.r, f.c, CASE WHEN t.r IS NULL THEN 0 ELSE 1 END AS t FROM foot f LEFT JOIN truth t ON t.r = f.r AND t.c = f.c)
      SELECT i * 16 AS r0, j * 16 AS c0, CAST(sum(t) AS BIGINT) AS total, count(*) AS n FROM (SELECT m.*, unnest(range(greatest(0, r // 16 - 1), r // 16 + 1)) AS i FROM m) CROSS JOIN LATERAL (SELECT unnest(range(greatest(0, c // 16 - 1), c // 16 + 1)) AS j) GROUP BY 1, 2 ORDER BY total DESC, r0, c0 LIMIT 10""",
    "compact_windows": f"""WITH {EV}, {BLOCKS}, x AS (SELECT block, count(*) OVER w AS n, CAST(sum(fault_px) OVER w AS BIGINT) AS faults, (max(block_row) OVER w - min(block_row) OVER w + 1) * (max(block_col) OVER w - min(block_col) OVER w + 1) AS area FROM bt WHERE valid_px > 0 WINDOW w AS (ORDER BY block ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
      SELECT * FROM x WHERE n = 3 AND faults > 0 ORDER BY area, faults DESC, block LIMIT 1""",
    "train_windows": f"""WITH {EV}, {ZONES}, m AS (SELECT f.r, f.c, CASE WHEN t.r IS NULL THEN 0 ELSE 1 END AS t, CASE WHEN z.r IS NULL THEN 0 ELSE 1 END AS h FROM foot f LEFT JOIN truth t ON t.r = f.r AND t.c = f.c LEFT JOIN zones z ON z.fold = 0 AND z.r = f.r AND z.c = f.c),
      g AS (SELECT i * 16 AS r0, j * 16 AS c0, count(*) AS n, CAST(sum(t) AS BIGINT) AS truth, CAST(sum(h) AS BIGINT) AS held FROM (SELECT m.*, unnest(range(greatest(0, r // 16 - 1), r // 16 + 1)) AS i FROM m) CROSS JOIN LATERAL (SELECT unnest(range(greatest(0, c // 16 - 1), c // 16 + 1)) AS j) GROUP BY 1, 2)
      SELECT *, CASE WHEN held = n THEN 'test' WHEN held > 0 THEN 'dropped' WHEN truth >= 3 THEN 'positive' ELSE 'negative' END AS use FROM g""",
    "neg_sample": f"""WITH {EV}, x AS (SELECT f.r, f.c, row_number() OVER (ORDER BY md5('7-' || f.r || '-' || f.c), f.r, f.c) AS n FROM foot f ANTI JOIN truth t ON t.r = f.r AND t.c = f.c)
      SELECT r, c, 1 AS y FROM truth UNION ALL SELECT r, c, 0 FROM x WHERE n <= 3 * (SELECT count(*) FROM truth)""",
    "conform_template": f"""WITH {EV}, p AS (SELECT r, c, max(value) / 300::DOUBLE AS p FROM ev WHERE kind = 'purchase' GROUP BY ALL), t AS (SELECT DISTINCT r, c FROM ev WHERE kind <> 'purchase'),
      x AS (SELECT p.p, t.r IS NOT NULL AS i, p.r IS NOT NULL AS h FROM t FULL JOIN p ON p.r = t.r AND p.c = t.c), y AS (SELECT CASE WHEN NOT i THEN 'outside' WHEN NOT h OR p IS NULL THEN 'filled' WHEN p < 0 OR p > 1 THEN 'clipped' ELSE 'kept' END AS reason, CASE WHEN i THEN greatest(0, least(1, coalesce(p, 0))) END AS p FROM x)
      SELECT reason, count(*) AS n, round(coalesce(sum(p), 0), 6) AS mass FROM y GROUP BY reason""",
    "validate_rules": f"WITH {EV}, s AS (SELECT candidate, max(p) AS hi, min(p) AS lo, count(*) AS n, count(*) FILTER (c >= 720) AS wide FROM fields GROUP BY candidate) SELECT candidate, concat_ws(',', CASE WHEN NOT (lo >= 0 AND hi <= 1) THEN 'range' END, CASE WHEN wide <> 0 THEN 'columns' END, CASE WHEN NOT hi < 1 THEN 'saturated' END, CASE WHEN n < 100 THEN 'size' END) AS failed FROM s",
    "duplicate_candidates": f"""WITH {EV}, lev AS (SELECT * FROM (VALUES (0, 0.1::DOUBLE), (1, 0.3::DOUBLE), (2, 0.3000001::DOUBLE), (3, 0.5::DOUBLE), (4, 0.5000001::DOUBLE)) v(fi, t0)), s AS (SELECT fi, count(*) AS n, md5(string_agg(r || ',' || c, ';' ORDER BY r, c)) AS h FROM main, lev WHERE p > t0 GROUP BY fi)
      SELECT fi AS candidate, min(fi) OVER (PARTITION BY h) AS first, n FROM s""",
    "decision_rule": f"""WITH {EV}, {SWEEP}, base0 AS (SELECT dti AS base, pred_px AS px0 FROM sweep WHERE candidate = 0), x AS (SELECT candidate, CAST(dti - base >= 0.01::DOUBLE AS INT) + CAST(pred_px <= 5 * px0 AS INT) + CAST(tp / n_gt >= 0.2::DOUBLE AS INT) AS n FROM sweep, base0)
      SELECT candidate, CASE n WHEN 3 THEN 'ADOPT' WHEN 0 THEN 'KEEP' ELSE 'CONFLICT' END AS verdict FROM x""",
    "text_norm": f"SELECT doc_id, md5({TIDY.format('text')}) AS digest FROM documents",
    "quote_check": f"""WITH d AS (SELECT doc_id, {TIDY.format('lower(text)')} AS t FROM documents), q AS (SELECT item_id, {TIDY.format('lower(text)')} AS t FROM benchmark)
      SELECT DISTINCT item_id, doc_id FROM q, d WHERE q.t <> '' AND contains(' ' || d.t || ' ', ' ' || q.t || ' ')""",
    "entity_extract": "WITH x AS (SELECT source, unnest(regexp_extract_all(text, '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}')) AS e FROM documents) SELECT source, count(*) AS n, count(DISTINCT e) AS n_distinct FROM x GROUP BY source",
    "link_classify": """WITH x AS (SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, starts_with(url, 'https:') AS s, page_id % 4 * 101 + 200 AS st FROM pages)
      SELECT host, CASE WHEN st BETWEEN 200 AND 299 AND s THEN 'ok' WHEN st BETWEEN 200 AND 399 THEN 'moved' WHEN st IN (401, 403, 429) THEN 'refused' ELSE 'broken' END AS class, count(*) AS n FROM x GROUP BY ALL""",
    "page_links": """WITH x AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) SELECT href, count(*) AS n, count(DISTINCT page_id) AS pages FROM x GROUP BY href""",
    "fuzzy_match": f"""WITH n AS (SELECT DISTINCT p_name AS name, {LETTERS.format('p_name')} AS n FROM part), g AS (SELECT DISTINCT guess, {LETTERS.format('guess')} AS g FROM (SELECT lower(p_name) AS guess FROM part UNION ALL SELECT substr(p_name, 1, 6) || substr(p_name, 8, 50) FROM part)),
      x AS (SELECT guess, name, CASE WHEN guess = name THEN 'exact' WHEN lower(guess) = lower(name) THEN 'case' ELSE 'similar' END AS how, CASE WHEN guess = name THEN 3 WHEN lower(guess) = lower(name) THEN 2 ELSE 1 - levenshtein(g, n) / greatest(length(g), length(n))::DOUBLE END AS likeness FROM g, n),
      b AS (SELECT * FROM x WHERE likeness >= 0.9 - 1e-12 QUALIFY row_number() OVER (PARTITION BY guess ORDER BY likeness DESC, name) = 1) SELECT g.guess, b.name, b.how FROM g LEFT JOIN b ON b.guess = g.guess""",
    "page_furniture": """WITH c AS (SELECT conv_id AS key, turn AS page, turn || text AS t FROM conversations), l AS (SELECT key, page, array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(x, '^ *[0-9]{1,4} *$')), chr(10)) AS body FROM c), w AS (SELECT *, lag(body) OVER (PARTITION BY key ORDER BY page) AS b FROM l)
      SELECT key, page, md5(CASE WHEN b IS NOT NULL AND NOT regexp_matches(b, '[.!?:] *$') AND regexp_matches(body, '^[0-9]{1,4}[A-Za-z]') THEN regexp_replace(body, '^[0-9]{1,4}', '') ELSE body END) AS digest FROM w""",
    "class_vocabulary": 'SELECT event_type AS "class", CAST(row_number() OVER (ORDER BY event_type) AS INT) AS id FROM (SELECT DISTINCT event_type FROM events)',
    "table_fingerprint": f"SELECT o_orderstatus, count(*) AS n, CAST(sum(h) % 4611686018427387904 AS BIGINT) AS s, bit_xor(h) AS x FROM (SELECT o_orderstatus, CAST('0x' || substr(md5({ORDER_TEXT}), 1, 15) AS BIGINT) AS h FROM orders) GROUP BY o_orderstatus",
    "resample_mean": f"WITH {SHIP} SELECT r // 4 AS r, c // 4 AS c, round(avg(round(v * 100)), 4) AS v FROM li GROUP BY 1, 2",
    "window_counts": f"WITH {EV}, {WINDOWS} SELECT CAST(win_r AS INT) AS win_r, CAST(win_c AS INT) AS win_c, count(*) AS px FROM inw GROUP BY ALL",
    "window_stitch": f"WITH {EV}, {WINDOWS} SELECT r, c, round(sum(p * exp(-((r - win_r - 31.5) * (r - win_r - 31.5) + (c - win_c - 31.5) * (c - win_c - 31.5))::DOUBLE / 512)) / sum(exp(-((r - win_r - 31.5) * (r - win_r - 31.5) + (c - win_c - 31.5) * (c - win_c - 31.5))::DOUBLE / 512)), 6) AS p FROM inw GROUP BY ALL",
    "losses": f"""WITH {EV}, d AS (SELECT p, CASE WHEN t.r IS NULL THEN 0 ELSE 1 END AS y FROM main m LEFT JOIN truth t ON t.r = m.r AND t.c = m.c), s AS (SELECT sum(p * y) AS tp, sum(p * (1 - y)) AS fp, sum((1 - p) * y) AS fn, avg(-(y * ln(greatest(1e-7, least(1 - 1e-7, p))) + (1 - y) * ln(1 - greatest(1e-7, least(1 - 1e-7, p))))) AS e FROM d),
      l AS (SELECT 1 - (tp + 1e-6) / (tp + 0.2::DOUBLE * fp + 0.8::DOUBLE * fn + 1e-6) AS t, e FROM s) SELECT round(t, 6) AS tversky, round(pow(t, 0.75), 6) AS focal, round(e, 6) AS entropy FROM l""",
    "symmetry_views": f"WITH {EV}, v AS (SELECT p, unnest([{VIEWS}]) AS s FROM (SELECT r % 64 AS y, c % 64 AS x, p FROM main)) SELECT CAST(s.view AS INT) AS \"view\", count(*) AS n, round(sum(s.y * p), 4) AS moment FROM v GROUP BY 1",
    "bad_dates": "WITH d AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-') || lpad(CAST(o_orderkey % 40 AS VARCHAR), 2, '0') AS day FROM orders) SELECT * FROM d WHERE try_strptime(day, '%Y-%m-%d') IS NULL",
}
