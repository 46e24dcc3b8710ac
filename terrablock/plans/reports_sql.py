"""DuckDB SQL for the queries of reports, built on the CTEs of oracle."""

from __future__ import annotations

from terrablock.functions.quantiles import HALVINGS, TERMS
from terrablock.plans.oracle import _RUR, _SUB, _URBAN, DRAWS_OF, LOG_D, LOG_F, PARTS, PI, SQL, _cost, build, rounded

D = "::DOUBLE"
PARTS |= {
    "near": "SELECT DISTINCT cell, node_id, block_id, o_block AS near_block FROM pairs",
    "near_count": "SELECT cell, node_id, count(*) AS m FROM near GROUP BY ALL",
    "nearest_node": """SELECT p.cell, p.node_id, p.block_id, p.o_block AS near_block, arg_min(p.o_node, {'d': (a.x_km - b.x_km) * (a.x_km - b.x_km) + (a.y_km - b.y_km) * (a.y_km - b.y_km), 'o': p.o_node}) AS o_node
  FROM pairs p JOIN lattice a ON a.node_id = p.node_id JOIN lattice b ON b.node_id = p.o_node GROUP BY ALL""",
    "counts": "SELECT cell, count(*) AS n_blocks, count(*) FILTER (WHERE role = 'train') AS k_train, count(*) FILTER (WHERE role = 'test') AS k_test FROM roles WHERE seed = 1 GROUP BY cell",
    "level_draws": """SELECT cell, seed, pop, count(*) FILTER (WHERE pop = 'all' OR valid) AS n, avg(abs(rssi + 110)) FILTER (WHERE pop = 'all' OR valid) AS mae
  FROM left2, (VALUES ('valid'), ('all')) q(pop) WHERE role = 'test' GROUP BY ALL""",
    "all_draws": "SELECT * FROM level_draws WHERE pop = 'all' AND mae IS NOT NULL",
    "variances_none": """SELECT cell, seed, pred, pop, k, any_value(err) AS err, CASE WHEN k > 1 THEN k / CAST(k - 1 AS DOUBLE) * sum((s - err * m) * (s - err * m)) / (CAST(any_value(m_all) AS DOUBLE) * any_value(m_all)) END AS v
  FROM totals GROUP BY cell, seed, pred, pop, k""",
    "plan": "SELECT DISTINCT cell, seed, pred FROM roles, (VALUES ('constant'), ('fspl_a')) p(pred)",
    "status": "SELECT cell, seed, pred, CASE WHEN kind = 3 THEN 1 ELSE 0 END AS rc FROM (SELECT *, seed % 7 + CASE WHEN pred = 'constant' THEN 0 ELSE 1 END AS kind FROM plan) WHERE kind <> 5 OR cell = 'Q1'",
    "test_share": "SELECT cell, seed, count(l.node_id) / CAST(count(*) AS DOUBLE) AS share, count(l.node_id) AS x, count(*) AS y FROM held h LEFT JOIN left2 l USING (cell, seed, node_id) WHERE h.role = 'test' GROUP BY ALL",
}
_FALL = "coalesce(list_product(list_transform(range(0, m), lambda j: greatest((({top}) - j) / CAST(({base}) - j AS DOUBLE), 0))), 1)"


def _series(x: str, a: str, b: str) -> str:
    terms = f"list_sum(list_transform(range({TERMS}), lambda k: exp(lgamma({a} + {b} + k) - lgamma({a} + {b}) - lgamma({a} + 1 + k) + lgamma({a} + 1) + k * ln({x}))))"
    return f"exp({a} * ln({x}) + {b} * ln(1 - {x}) - ln({a}) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b})) * {terms}"


def _share(x: str) -> str:
    """The regularised incomplete beta function of columns a and b."""
    return f"(CASE WHEN {x} <= 0.5 THEN {_series(x, 'a', 'b')} ELSE 1 - {_series(f'(1 - {x})', 'b', 'a')} END)"


_LAYOUT = """SELECT cell, n, groups, ssb / (groups - 1) AS ms_between, ssw / (n - groups) AS ms_within, (n - k2 / n) / (groups - 1) AS n0 FROM (
  SELECT cell, CAST(sum(k) AS BIGINT) AS n, count(*) AS groups, sum(k * (m - g) * (m - g)) AS ssb, sum(k * v) AS ssw, CAST(sum(k * k) AS DOUBLE) AS k2
  FROM (SELECT *, sum(k * m) OVER (PARTITION BY cell) / sum(k) OVER (PARTITION BY cell) AS g FROM (SELECT cell, block_id, count(*) AS k, avg(rssi) AS m, var_pop(rssi) AS v FROM nodes WHERE valid GROUP BY ALL)) GROUP BY cell)"""


def falling(top: str, base: str) -> str:
    return _FALL.format(top=top, base=base)


def _reading(variant: str, source: str) -> str:
    parts = []
    for reading, err in (("A", "err"), ("B", "CASE WHEN v IS NOT NULL THEN err END")):
        parts.append(f"""SELECT cell, pred, pop, '{variant}' AS variant, '{reading}' AS reading, mean_err, var_err, count(*) AS n_err, count(v) AS n_v, count(*) FILTER (WHERE k = 1) AS n_one_block, min(k) AS k_min, max(k) AS k_max, avg(v) AS mean_v, avg(sqrt(v)) AS mean_root_v,
          CAST(sum(CASE WHEN v IS NOT NULL THEN CAST(abs(err - mean_err) <= 2 * sqrt(v) AS BIGINT) END) AS BIGINT) AS n_covered, avg(CASE WHEN v IS NOT NULL THEN CAST(abs(err - mean_err) <= 2 * sqrt(v) AS BIGINT) END) AS coverage, CASE WHEN var_err > 0 THEN avg(v) / var_err END AS q
          FROM (SELECT *, avg({err}) OVER w AS mean_err, var_samp({err}) OVER w AS var_err FROM {source} WINDOW w AS (PARTITION BY cell, pred, pop)) GROUP BY cell, pred, pop, mean_err, var_err""")
    return " UNION ALL ".join(parts)


def _decoded(x: str, scale: float, shift: float, low: float, high: float) -> str:
    return f"least(greatest(({x}) * {scale}{D} + {shift}{D}, {low}{D}), {high}{D})"


def _huber(e: str, d: int) -> str:
    return f"CASE WHEN abs({e}) <= {d} THEN 0.5{D} * ({e}) * ({e}) ELSE {d} * (abs({e}) - {d / 2}{D}) END"


_MODELS = {
    "fspl": f"20 * {LOG_D} + 20 * {LOG_F} + 32.44{D}", "hata_urban": _URBAN, "hata_suburban": f"{_URBAN} {_SUB}", "hata_rural": f"{_URBAN} {_RUR}", "cost231_urban": _cost("freq", 3), "cost231_suburban": _cost("freq", 0),
    "log_distance": f"20 * log10(0.001{D}) + 20 * {LOG_F} + 32.44{D} + 35 * log10(greatest(dist_m, 1))",
}
_LON, _LAT = f"(-49.5{D} + {{}} / 111)", f"(-22.5{D} + {{}} / 111)"


def _haversine() -> str:
    lon1, lat1, lon2, lat2 = _LON.format("x_km"), _LAT.format("y_km"), _LON.format("sx"), _LAT.format("sy")
    a = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"round(2 * 6371000{D} * asin(sqrt(least(1, {a}))), 3)"


# the lattice of blocks: 11 columns, 12 rows
_STEPS = {"l": (-1, 0), "r": (1, 0), "b": (0, -1), "t": (0, 1), "lb": (-1, -1), "rb": (1, -1), "lt": (-1, 1), "rt": (1, 1)}


def _lattice(real: bool) -> str:
    w, h = (f"CASE WHEN i = 10 THEN 3.4{D} ELSE 10 END", "CASE WHEN j = 11 THEN 1 ELSE 10 END") if real else ("10", "10")
    return f"(SELECT seed, i, j, role, CAST({w} AS DOUBLE) AS w, CAST({h} AS DOUBLE) AS h FROM dealt)"


def _left(role: str, trimming: str, real: bool, torus: bool) -> str:
    joins, flags = [], {}
    for k, (dx, dy) in _STEPS.items():
        at = (f"(p.i + {dx} + 11) % 11", f"(p.j + {dy} + 12) % 12") if torus else (f"p.i + {dx}", f"p.j + {dy}")
        joins.append(f"LEFT JOIN {trimming} t_{k} ON t_{k}.seed = p.seed AND t_{k}.i = {at[0]} AND t_{k}.j = {at[1]}")
        flags[k] = f"CASE WHEN t_{k}.seed IS NULL THEN 0 ELSE 1 END"
    f = ", ".join(f"{x} AS f_{k}" for k, x in flags.items())
    discs = " + ".join(f"f_{x}{y} * (1 - f_{x}) * (1 - f_{y})" for x in "lr" for y in "bt")
    return f"""(SELECT seed, i, j, '{role}' AS role, w * h AS whole, least(greatest(greatest(0, w - 2 * (f_l + f_r)) * greatest(0, h - 2 * (f_b + f_t)) - ({discs}) * {PI!r}{D}, 0), w * h) AS area
      FROM (SELECT p.*, {f} FROM {_lattice(real)} p {' '.join(joins)} WHERE p.role = '{role}'))"""


def _retained() -> str:
    parts = []
    for v, (real, kept_only, torus) in {"A": (False, False, False), "A2": (False, True, False), "B": (True, False, False), "C": (True, True, False), "T": (False, True, True)}.items():
        train = "(SELECT seed, i, j FROM dealt WHERE role = 'train')"
        val = _left("val", train, real, torus)
        val_trims = f"SELECT seed, i, j FROM {val} WHERE area > 1e-9" if kept_only else "SELECT seed, i, j FROM dealt WHERE role = 'val'"
        test = _left("test", f"(SELECT seed, i, j FROM dealt WHERE role = 'train' UNION ALL {val_trims})", real, torus)
        parts.append(f"""SELECT '{v}' AS variant, role, count(*) AS n_draws, avg(share) AS mean, stddev_pop(share) AS sd, quantile_cont(share, 0.05) AS p5, quantile_cont(share, 0.95) AS p95
          FROM (SELECT seed, role, sum(area) / sum(whole) AS share FROM (SELECT * FROM {val} UNION ALL SELECT * FROM {test}) GROUP BY seed, role) GROUP BY role""")
    return " UNION ALL ".join(parts)


PARTS["dealt"] = """SELECT seed, block_id // 12 AS i, block_id % 12 AS j, CASE WHEN place < 92 THEN 'train' WHEN place < 112 THEN 'val' ELSE 'test' END AS role
  FROM (SELECT seed, block_id, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || '|' || block_id), block_id) - 1 AS place FROM range(132) b(block_id), (SELECT unnest(range(1, 61)) AS seed))"""


def _cover() -> str:
    away = {"l": "x", "r": "(w - x)", "b": "y", "t": "(h - y)"}
    terms = []
    for k, (dx, dy) in _STEPS.items():
        reach = f"{away[k]} < 2" if len(k) == 1 else f"{away[k[0]]} * {away[k[0]]} + {away[k[1]]} * {away[k[1]]} < 4"
        terms.append(f"CASE WHEN i + {dx} BETWEEN 0 AND 10 AND j + {dy} BETWEEN 0 AND 11 AND {reach} THEN 1 ELSE 0 END")
    return f"""SELECT CAST(132 AS INTEGER) AS n_blocks, sum(n * pow(20 / 132{D}, k)) / sum(n) AS mean_field, sum(n * {falling('19', '131').replace('range(0, m)', 'range(0, k)')}) / sum(n) AS exact
      FROM (SELECT {' + '.join(terms)} AS k, count(*) AS n FROM (SELECT i, j, w, h, (px + 0.5{D}) * 0.2{D} AS x, (py + 0.5{D}) * 0.2{D} AS y FROM (
        SELECT i, j, CASE WHEN i = 10 THEN 3.4{D} ELSE 10 END AS w, CAST(CASE WHEN j = 11 THEN 1 ELSE 10 END AS DOUBLE) AS h FROM range(11) a(i), range(12) b(j)), range(50) c(px), range(50) d(py)
        WHERE px < round(w / 0.2{D}) AND py < round(h / 0.2{D})) GROUP BY 1)"""


_DRAWN = "SELECT cell, node_id, x_km, y_km FROM lattice JOIN roles USING (cell, block_id) WHERE seed = 1 AND role = 'train'"
_TWO = "SELECT cell, seed, pop, max(mae) FILTER (WHERE pred = 'constant') AS constant, max(mae) FILTER (WHERE pred = '{}') AS other FROM per_draw GROUP BY ALL"
_GATES = {"double_ids": ("double_ids", 0, 0), "odd_sentinels": ("odd_sentinels", 0, 0), "mean": ("mean", -1, 1), "sd": ("sd", 0.1, 2), "missing": ("missing", 0, 0), "permuted_effect": ("permuted_effect", 0.5, 2)}
_DIST = "sqrt((a.x_km - b.x_km) * (a.x_km - b.x_km) + (a.y_km - b.y_km) * (a.y_km - b.y_km))"

BODIES = {
    "test_train_distance": rounded(f"SELECT cell, count(*) AS n, min(d) AS low, median(d) AS middle, max(d) AS high FROM (SELECT a.cell, a.node_id, min({_DIST}) AS d FROM (SELECT cell, node_id, x_km, y_km FROM lattice JOIN roles USING (cell, block_id) WHERE seed = 1 AND role = 'test') a JOIN ({_DRAWN}) b ON a.cell = b.cell GROUP BY ALL) GROUP BY cell", "low middle high"),
    "distance_gate": rounded(
        f"""SELECT a.cell, b.role || '-' || a.role AS pair, CAST(count(*) FILTER (WHERE a.node_id = b.node_id) AS BIGINT) AS n_shared, min({_DIST}) AS least_km, count(*) FILTER (WHERE a.node_id = b.node_id) = 0 AND min({_DIST}) >= 2 AS ok
        FROM (SELECT cell, node_id, x_km, y_km, role FROM left2 WHERE seed = 1) a JOIN (SELECT cell, node_id, x_km, y_km, role FROM left2 WHERE seed = 1 UNION ALL SELECT *, 'train' FROM ({_DRAWN})) b ON a.cell = b.cell
        WHERE (b.role = 'train') OR (b.role = 'val' AND a.role = 'test') GROUP BY ALL""",
        "least_km",
    ),
    "neighbour_class_profile": rounded(
        f"SELECT cell, m, n, p_given, {falling('k_test - 1', 'n_blocks - 1')} AS low, {falling('n_blocks - 1 - k_train', 'n_blocks - 1')} AS high FROM (SELECT cell, coalesce(m, 0) AS m, count(*) AS n, avg(p_given) AS p_given FROM included LEFT JOIN near_count USING (cell, node_id) WHERE p_given IS NOT NULL GROUP BY ALL) JOIN counts USING (cell)",
        "p_given low high",
    ),
    "nearest_in_block": "SELECT cell, node_id, near_block, o_node FROM nearest_node",
    "node_classes": """SELECT cell, coalesce(m, 0) AS m, count(*) AS n, count(fails) AS n_fails FROM lattice LEFT JOIN near_count USING (cell, node_id) LEFT JOIN (
        SELECT DISTINCT a.cell, a.node_id, 1 AS fails FROM nearest_node a JOIN near b ON b.cell = a.cell AND b.node_id = a.o_node AND b.near_block <> a.block_id
        WHERE NOT EXISTS (SELECT 1 FROM near c WHERE c.cell = a.cell AND c.node_id = a.node_id AND c.near_block = b.near_block)) f USING (cell, node_id) GROUP BY ALL""",
    "class_counts": "SELECT cell, block_id, coalesce(m, 0) AS m, count(*) AS n FROM lattice LEFT JOIN near_count USING (cell, node_id) GROUP BY ALL",
    "kfold_joint": rounded(
        """SELECT cell, seed, n, n_scored, n_scored / CAST(n AS DOUBLE) AS fraction, err, err_whole FROM (SELECT n.cell, f.seed, count(*) AS n, count(*) FILTER (WHERE t.node_id IS NULL) AS n_scored, avg(abs(rssi + 110)) FILTER (WHERE t.node_id IS NULL) AS err, avg(abs(rssi + 110)) AS err_whole
        FROM nodes n JOIN folds f USING (cell, block_id) LEFT JOIN (SELECT DISTINCT f.cell, f.seed, p.node_id FROM near p JOIN folds f ON f.cell = p.cell AND f.block_id = p.block_id JOIN folds o ON o.cell = f.cell AND o.seed = f.seed AND o.block_id = p.near_block WHERE f.fold <> o.fold) t
          ON t.cell = n.cell AND t.seed = f.seed AND t.node_id = n.node_id GROUP BY n.cell, f.seed)""",
        "fraction err err_whole",
    ),
    "border_blocks": rounded(
        """SELECT cell, border, count(*) AS n, count(*) FILTER (WHERE share = 0) AS n_empty, count(*) FILTER (WHERE share > 0 AND share < 0.1::DOUBLE) AS n_thin, avg(share) AS share FROM (
        SELECT cell, seed, block_id, border, count(l.node_id) / CAST(count(*) AS DOUBLE) AS share FROM held h LEFT JOIN left2 l USING (cell, seed, node_id) JOIN (
          SELECT cell, block_id, gx IN (min(gx) OVER w, max(gx) OVER w) OR gy IN (min(gy) OVER w, max(gy) OVER w) AS border FROM (SELECT cell, block_id, block_id // 12 AS gx, block_id % 12 AS gy FROM blocks) WINDOW w AS (PARTITION BY cell)) e ON e.cell = h.cell AND e.block_id = h.block_id
        WHERE h.role = 'test' GROUP BY h.cell, h.seed, h.block_id, border) GROUP BY cell, border""".replace("SELECT cell, seed, block_id, border, count(l", "SELECT h.cell, h.seed, h.block_id, border, count(l"),
        "share",
    ),
    "central_window": """SELECT cell, node_id FROM (SELECT cell, node_id, greatest(abs(x_km - mx), abs(y_km - my)) AS d FROM lattice JOIN (SELECT cell, median(x_km) AS mx, median(y_km) AS my FROM lattice GROUP BY cell) USING (cell))
      LEFT JOIN (SELECT cell, d AS edge FROM (SELECT cell, d, row_number() OVER (PARTITION BY cell ORDER BY d) AS k FROM (SELECT cell, greatest(abs(x_km - mx), abs(y_km - my)) AS d FROM lattice JOIN (SELECT cell, median(x_km) AS mx, median(y_km) AS my FROM lattice GROUP BY cell) USING (cell))) WHERE k = 1001) USING (cell) WHERE edge IS NULL OR d < edge""",
    "srs_sample": rounded("SELECT cell, seed, count(*) AS n, avg(e) AS mean FROM (SELECT cell, seed, abs(rssi + 110) AS e, row_number() OVER (PARTITION BY cell, seed ORDER BY md5(seed || '|' || node_id), node_id) AS k FROM nodes, (SELECT unnest(range(1, 6)) AS seed)) WHERE k <= 50 GROUP BY ALL", "mean"),
    "inversions_by_calibration": " UNION ALL ".join(
        f"SELECT coalesce(cell, 'ALL') AS cell, pop, count(*) AS n_draws, count(*) FILTER (WHERE constant > other) AS n_inverted, '{c}' AS calibration FROM ({_TWO.format('fspl_' + c)}) WHERE constant IS NOT NULL AND other IS NOT NULL GROUP BY GROUPING SETS ((cell, pop), (pop))" for c in "ab"
    ),
    "bias_intervals": rounded(
        """SELECT *, bias - 2 * mc_se AS low, bias + 2 * mc_se AS high, bias - 2 * mc_se > 0 OR bias + 2 * mc_se < 0 AS "distinct" FROM (SELECT cell, pop, theta, count(*) AS n_draws, avg(mae - theta) AS bias, stddev_samp(mae) / sqrt(count(*)) AS mc_se, sqrt(avg((mae - theta) * (mae - theta))) AS rmse
        FROM level_draws JOIN (SELECT cell, pop, avg(abs(rssi + 110)) AS theta FROM nodes, (VALUES ('valid'), ('all')) q(pop) WHERE pop = 'all' OR valid GROUP BY ALL) USING (cell, pop) WHERE mae IS NOT NULL GROUP BY cell, pop, theta)""",
        "theta bias mc_se rmse low high",
    ),
    "estimator_effects": rounded(
        """SELECT *, v_h / v_a AS deff_h, v_h0 / v_a AS deff_h0 FROM (SELECT cell, v_h, v_h0, (1 - n / n_u) * s2 / n AS v_a FROM (SELECT cell, var_samp(mae) AS v_h, avg(n) AS n FROM all_draws GROUP BY cell)
        JOIN (SELECT cell, var_samp(mae) AS v_h0 FROM (SELECT cell, seed, avg(abs(rssi + 110)) AS mae FROM held WHERE role = 'test' GROUP BY ALL) GROUP BY cell) USING (cell) JOIN (SELECT cell, var_samp(abs(rssi + 110)) AS s2, count(*) AS n_u FROM nodes GROUP BY cell) USING (cell))""",
        "v_h v_h0 v_a deff_h deff_h0", 4,
    ),
    "variance_readings": rounded(f"{_reading('N', 'variances')} UNION ALL {_reading('none', 'variances_none')}", "mean_err var_err mean_v mean_root_v coverage q", 4),
    "weighted_estimands": rounded(
        """SELECT cell, n, n_reached, w / 60 AS mean_weight, t / 60 / n AS mean_error, t / w AS ratio FROM (SELECT cell, sum(1 / p) AS w, sum(e / p) AS t FROM (SELECT l.cell, i.p, i.e FROM left2 l JOIN included i USING (cell, node_id) WHERE l.role = 'test' AND i.p > 0) GROUP BY cell)
        JOIN (SELECT cell, count(*) FILTER (WHERE p > 0) AS n_reached, count(*) AS n FROM included GROUP BY cell) USING (cell)""",
        "mean_weight mean_error ratio", 5,
    ),
    "ratio_bound": rounded("SELECT *, abs(ratio_term) <= bound + 1e-9 AS holds FROM (SELECT cell, pop, count(*) AS n_draws, -covar_pop(mae, n) / avg(n) AS ratio_term, stddev_pop(mae) * stddev_pop(n) / avg(n) AS bound, corr(mae, n) AS r FROM level_draws WHERE mae IS NOT NULL GROUP BY ALL)", "ratio_term bound r"),
    "product_variance": rounded(
        "SELECT *, v_z - by_x - by_y AS rest FROM (SELECT cell, count(*) AS n, var_samp(mae * y) AS v_z, avg(y) * avg(y) * var_samp(mae) AS by_x, avg(mae) * avg(mae) * var_samp(y) AS by_y FROM (SELECT cell, mae, n / CAST(k AS DOUBLE) AS y FROM all_draws JOIN (SELECT cell, seed, count(*) AS k FROM roles WHERE role = 'test' GROUP BY ALL) USING (cell, seed)) GROUP BY cell)",
        "v_z by_x by_y rest", 3,
    ),
    "drift_ratio": rounded("SELECT a.cell, a.pred, a.pop, a.sd AS sd_b, a.n_draws AS n_sd_b, b.sd AS sd_0, b.n_draws AS n_sd_0, a.sd / nullif(b.sd, 0) AS ratio FROM drift a JOIN drift0 b USING (cell, pred, pop)", "sd_b sd_0 ratio"),
    "sign_changes": rounded(f"SELECT cell, pop, count(*) AS n_draws, any_value(mean) AS mean, count(*) FILTER (WHERE sign(d) = -sign(mean)) AS n_against, count(*) FILTER (WHERE d = 0) AS n_ties FROM (SELECT *, avg(d) OVER (PARTITION BY cell, pop) AS mean FROM (SELECT cell, pop, round(constant - other, 9) AS d FROM ({_TWO.format('fspl_a')}) WHERE constant IS NOT NULL AND other IS NOT NULL)) GROUP BY cell, pop", "mean"),
    "valid_share_signs": rounded(
        """SELECT cell, role, count(*) FILTER (WHERE d > 0) AS n_over, count(*) FILTER (WHERE d < 0) AS n_under, count(*) FILTER (WHERE d = 0) AS n_same, avg(d) AS mean FROM (SELECT cell, role, round(share - max(share) FILTER (WHERE role = 'train') OVER (PARTITION BY cell, seed), 6) AS d
        FROM (SELECT cell, seed, role, avg(CAST(valid AS DOUBLE)) AS share FROM nodes JOIN roles USING (cell, block_id) GROUP BY ALL)) WHERE role <> 'train' GROUP BY cell, role""",
        "mean",
    ),
    "best_draw": "SELECT cell, pred, pop, arg_min(seed, {'m': mae, 's': seed}) AS seed, min(mae) AS mae FROM (SELECT cell, pred, pop, seed, round(mae, 6) AS mae FROM per_draw WHERE mae IS NOT NULL) GROUP BY ALL",
    "falling_steps": """SELECT cell, count(*) AS n_steps, count(*) FILTER (WHERE fell) AS n_fell, count(*) FILTER (WHERE fell AND warm) AS n_fell_warm FROM (SELECT *, bool_or(NOT fell) OVER (PARTITION BY cell ORDER BY seed) AS warm FROM (
        SELECT cell, seed, v < lag(v) OVER (PARTITION BY cell ORDER BY seed) AS fell FROM (SELECT cell, seed, round(mae, 6) AS v FROM all_draws)) WHERE fell IS NOT NULL) GROUP BY cell""",
    "retention_correlation": rounded("SELECT a.cell AS a, b.cell AS b, count(*) AS n, corr(a.share, b.share) AS r FROM (SELECT cell, seed, round(share, 6) AS share FROM test_share) a JOIN (SELECT cell, seed, round(share, 6) AS share FROM test_share) b ON a.seed = b.seed AND a.cell < b.cell GROUP BY ALL", "r", 5),
    "campaign_table": rounded(
        f"""SELECT *, sd / 0.132{D} AS over_floor, sd / 0.132{D} >= 3 AS far_over, sd / 0.132{D} < 2 AS near_floor FROM (SELECT cell, pred, count(*) AS n, median(mae) AS middle, stddev_samp(mae) AS sd FROM per_draw WHERE seed <= 5 AND pop = 'valid' AND pred <> 'fspl_a' AND mae IS NOT NULL GROUP BY ALL)
        LEFT JOIN (SELECT cell, count(*) FILTER (WHERE other < constant) AS n_wins FROM ({_TWO.format('fspl_b')}) WHERE seed <= 5 AND pop = 'valid' GROUP BY cell) USING (cell)
        LEFT JOIN (SELECT cell, count(*) FILTER (WHERE abs(other - constant) <= 0.117{D}) AS n_parity FROM ({_TWO.format('fspl_b')}) WHERE seed <= 5 AND pop = 'sentinel' GROUP BY cell) USING (cell)""",
        "middle sd over_floor",
    ),
    "trained_level": rounded(
        """SELECT cell, count(*) AS n_draws, avg(mae) AS mean, stddev_samp(mae) AS sd FROM (SELECT cell, seed, avg(abs(rssi - level)) AS mae FROM nodes JOIN roles USING (cell, block_id)
        JOIN (SELECT cell, seed, median(rssi) AS level FROM nodes JOIN roles USING (cell, block_id) WHERE role = 'train' AND valid GROUP BY ALL) USING (cell, seed) WHERE role = 'test' AND valid GROUP BY ALL) GROUP BY cell""",
        "mean sd",
    ),
    "draw_seed_ratio": rounded(
        """SELECT cell, sd_draws, n_draws, sd_trainings, sd_draws / nullif(sd_trainings, 0) AS ratio FROM (SELECT cell, avg(sd) AS sd_draws FROM (SELECT cell, training, stddev_samp(mae) AS sd FROM trained GROUP BY ALL) GROUP BY cell)
        JOIN (SELECT cell, count(*) AS n_draws, avg(sd) AS sd_trainings FROM (SELECT cell, seed, stddev_samp(mae) AS sd FROM trained GROUP BY ALL) GROUP BY cell) USING (cell)""",
        "sd_draws sd_trainings ratio",
    ),
    "plan_status": """SELECT *, CASE WHEN n_done = n_plan THEN 'COMPLETE' ELSE 'PARTIAL' END AS label FROM (SELECT cell, pred, count(*) AS n_plan, count(*) FILTER (WHERE rc = 0) AS n_done, count(*) FILTER (WHERE rc <> 0) AS n_failed, count(*) FILTER (WHERE rc IS NULL) AS n_open,
        count(*) FILTER (WHERE rc = 0 AND abs(mae - again) <= 1e-9 * greatest(1, abs(again))) AS n_agree
      FROM plan LEFT JOIN status USING (cell, pred, seed) LEFT JOIN (SELECT cell, pred, seed, mae FROM per_draw WHERE pop = 'all') USING (cell, pred, seed) LEFT JOIN (SELECT cell, pred, seed, sum(s) / sum(m) AS again FROM sums WHERE pop = 'all' GROUP BY ALL) USING (cell, pred, seed) GROUP BY cell, pred)""",
    "missing_of_plan": "SELECT cell, pred, seed FROM plan ANTI JOIN (SELECT * FROM status WHERE rc = 0) USING (cell, pred, seed)",
    "key_difference": "SELECT *, 'plan' AS side FROM (SELECT cell, pred, seed FROM plan EXCEPT ALL SELECT cell, pred, CASE WHEN seed = 60 THEN 61 ELSE seed END FROM status) UNION ALL SELECT *, 'status' FROM (SELECT cell, pred, CASE WHEN seed = 60 THEN 61 ELSE seed END AS seed FROM status EXCEPT ALL SELECT cell, pred, seed FROM plan)",
    "standardised_distance": rounded("SELECT node_id, (dist_m - m) / sd AS z FROM nodes JOIN (SELECT cell, avg(dist_m) AS m, greatest(stddev_pop(dist_m), 1) AS sd FROM nodes JOIN roles USING (cell, block_id) WHERE seed = 1 AND role = 'train' GROUP BY cell) USING (cell)", "z"),
    "channel_outputs": rounded(
        f"SELECT node_id, {_decoded('elevation', 100, 100, 0, 200)} AS loss, {_decoded('slope * 4 - 1', 25, 25, 0, 50)} AS vegetation, {_decoded('ndvi * 2', 15, 15, 0, 30)} AS terrain, {_decoded('-elevation', 75, -75, -150, 0)} AS rssi, 1 / (1 + exp(-ndvi)) AS coverage FROM lattice",
        "loss vegetation terrain rssi coverage",
    ),
    "channel_ranges": rounded(
        """SELECT channel, count(*) AS n, avg(CAST(abs(v - w) > 0 AS DOUBLE)) AS share_out, avg(abs(v - truth)) AS mae_raw, avg(abs(w - truth)) AS mae_clamped, quantile_cont(abs(v - w), 0.99) AS p99 FROM (
        SELECT 'loss' AS channel, pl AS truth, 98 - pred_b AS v, least(greatest(98 - pred_b, 0), 200) AS w FROM nodes UNION ALL SELECT 'rssi', rssi, pred_b - 40, least(greatest(pred_b - 40, -150), 0) FROM nodes) GROUP BY channel""",
        "share_out mae_raw mae_clamped p99",
    ),
    "physics_penalties": rounded(
        f"SELECT cell, avg({_huber('98 - pred_b - pl', 5)}) AS huber, avg(greatest(fs - (98 - pred_b), 0)) AS hinge, avg({_huber(f'slope * 20 - 0.2{D} * pow(0.9{D}, 0.3{D}) * least(greatest(ndvi * 30, 0), 30)', 3)}) AS vegetation FROM nodes WHERE valid GROUP BY cell",
        "huber hinge vegetation", 5,
    ),
    "baseline_predictions": rounded(" UNION ALL ".join(f"SELECT '{m}' AS model, count(*) AS n, avg(55 - ({x})) AS rssi, avg(CAST(55 - ({x}) > -100 AS DOUBLE)) AS covered FROM nodes WHERE valid" for m, x in _MODELS.items()), "rssi covered", 5),
    "haversine_distance": f"SELECT node_id, arg_min(site_id, {{'d': {_haversine()}, 's': site_id}}) AS site_id, min({_haversine()}) AS dist_m FROM lattice, sites GROUP BY node_id",
    "corner_projection": rounded("SELECT node_id, (lon - min(lon) OVER w) * 111 * cos(radians(lat)) AS x, (lat - min(lat) OVER w) * 111 AS y FROM (SELECT cell, node_id, -49.5::DOUBLE + x_km / 111 AS lon, -22.5::DOUBLE + y_km / 111 AS lat FROM lattice) WINDOW w AS (PARTITION BY cell)", "x y"),
    "run_labels": """SELECT 'g1_' || CASE WHEN seed % 2 = 0 THEN 'gnn' ELSE 'mlp' END || '_' || cell || '_s' || seed AS label, 'g1' AS block, CASE WHEN seed % 2 = 0 THEN 'gnn' ELSE 'mlp' END AS model, cell AS quadrant, CAST(seed AS INTEGER) AS draw, CASE WHEN seed % 3 = 0 THEN 'bauru' ELSE 'lins' END AS city
      FROM (SELECT DISTINCT cell FROM lattice), (SELECT unnest(range(1, 61)) AS seed)""",
    "operator_ids": "SELECT n_nationkey, ['claro', ' TIM', 'Vivo', 'nextel', 'OUTROS'][n_nationkey % 5 + 1] AS name, CAST([0, 1, 2, 3, 3][n_nationkey % 5 + 1] AS INTEGER) AS id FROM nation",
    "mixture_rules": rounded(
        """SELECT cell, share, mae, share * delta + (1 - share) * e AS mixed, (a - e) / nullif(a - e + delta, 0) AS threshold, (1 - share) * a < share * delta + (1 - share) * e AS level_wins, CAST(abs(193 - 300) + abs(43 - 193 + 110) AS DOUBLE) AS floor FROM (
        SELECT cell, avg(CAST(NOT valid AS DOUBLE)) AS share, avg(abs(rssi + 100)) FILTER (WHERE valid) AS a, avg(abs(pred_b - rssi)) FILTER (WHERE valid) AS e, avg(abs(pred_b - rssi)) FILTER (WHERE NOT valid) AS delta, avg(abs(pred_b - rssi)) AS mae FROM nodes GROUP BY cell)""",
        "share mae mixed threshold floor",
    ),
    "r2_ceiling": rounded("SELECT cell, total, within, 1 - within / total AS ceiling FROM (SELECT cell, var_pop(rssi) AS total FROM nodes WHERE valid GROUP BY cell) JOIN (SELECT cell, sum(k * v) / sum(k) AS within FROM (SELECT cell, block_id, count(*) AS k, var_pop(rssi) AS v FROM nodes WHERE valid GROUP BY ALL) GROUP BY cell) USING (cell)", "total within ceiling"),
    "binomial_test": rounded(
        """SELECT cell, n, k, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5::DOUBLE))) FROM range(0, 61) r(i) WHERE i <= k) AS tail, (k / CAST(n AS DOUBLE) - 0.5::DOUBLE) / sqrt(0.25::DOUBLE / n) AS z FROM (
        SELECT cell, count(*) AS n, CAST(sum(CAST(share > 0.3::DOUBLE AS BIGINT)) AS BIGINT) AS k FROM (SELECT cell, seed, sum(n_valid) / sum(n_nodes) AS share FROM blocks JOIN roles USING (cell, block_id) WHERE role = 'test' GROUP BY ALL) GROUP BY cell)""",
        "tail z",
    ),
    "retained_area": rounded(_retained(), "mean sd p5 p95"),
    "cover_retention": rounded(_cover(), "mean_field exact", 9),
    "grid_steps": rounded(
        """SELECT step, n_step, n, n_whole, n_whole / CAST(n AS DOUBLE) AS share FROM (SELECT step, count(*) AS n_step FROM (SELECT round(x_km - lag(x_km) OVER (PARTITION BY node_id // side ORDER BY node_id), 6) AS step FROM lattice) WHERE step IS NOT NULL GROUP BY step ORDER BY n_step DESC, step DESC LIMIT 1),
        (SELECT count(*) AS n FROM lattice), (SELECT count(*) AS n_whole FROM (SELECT src FROM edges WHERE src <> dst GROUP BY src HAVING count(*) = 8))""",
        "step share",
    ),
    "induced_report": """SELECT a.*, links_kept, links_removed FROM (SELECT p.cell, count(*) FILTER (WHERE p.valid AND q.valid) AS n_kept, count(*) FILTER (WHERE p.valid <> q.valid) AS n_crossing, count(*) FILTER (WHERE NOT p.valid AND NOT q.valid) AS n_removed
        FROM edges JOIN nodes p ON p.node_id = src JOIN nodes q ON q.node_id = dst GROUP BY p.cell) a LEFT JOIN (
        SELECT cell, CAST(sum(least(k, 5)) FILTER (WHERE valid) AS BIGINT) AS links_kept, CAST(coalesce(sum(least(k, 5)) FILTER (WHERE NOT valid), 0) AS BIGINT) AS links_removed FROM nodes JOIN (SELECT node_id, count(*) AS k FROM ranged WHERE dist_m <= 30000 GROUP BY node_id) USING (node_id) GROUP BY cell) USING (cell)""",
    "relabelled_edges": "SELECT a.k AS src, b.k AS dst FROM edges JOIN (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS k FROM nodes WHERE valid) a ON a.node_id = src JOIN (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS k FROM nodes WHERE valid) b ON b.node_id = dst",
    "untrainable": "SELECT *, n_links > 0 AS trainable FROM (SELECT cell, seed, role, count(*) FILTER (WHERE dist_m <= 1500) AS n_links FROM nodes JOIN roles USING (cell, block_id) GROUP BY ALL) WHERE n_links < 40",
    "data_gates": rounded(
        "SELECT cell, gate, value, ok FROM (" + " UNION ALL ".join(f"SELECT cell, '{g}' AS gate, {c} AS value, {c} BETWEEN {low} AND {high} AS ok FROM wide JOIN effect USING (cell)" for g, (c, low, high) in _GATES.items()) + ")",
        "value", 4,
    ),
    "reconstruction": rounded("SELECT *, error <= 1e-3 AS close, error <= 1e-4 AS exact FROM (SELECT cell, seed, count(*) AS declared, count(l.node_id) AS rebuilt, abs(count(l.node_id) - count(*)) / CAST(count(*) AS DOUBLE) AS error FROM held h LEFT JOIN left2 l USING (cell, seed, node_id) WHERE h.role = 'test' GROUP BY ALL)", "error"),
    "digest_chain": """SELECT cell, seed, role, CASE WHEN n_other = 0 THEN 'missing' WHEN n_other = n THEN 'equal' ELSE 'different' END AS state FROM (
        SELECT cell, seed, role, count(*) AS n, count(*) FILTER (WHERE NOT (cell = 'Q2' AND seed = 2 AND node_id % 2 = 0) AND NOT (cell = 'Q3' AND role = 'val')) AS n_other FROM left2 WHERE seed <= 2 GROUP BY ALL)""",
    "anova_intervals": rounded(
        f"""SELECT cell, d1, d2, f, f_low, f_high, theta, theta_low, theta_high, theta_low / (1 + theta_low) AS icc_low, theta_high / (1 + theta_high) AS icc_high FROM (
        SELECT cell, d1, d2, f, f_low, f_high, greatest(0, (f - 1) / n0) AS theta, greatest(0, (f / f_high - 1) / n0) AS theta_low, greatest(0, (f / f_low - 1) / n0) AS theta_high FROM (
        WITH RECURSIVE layout AS MATERIALIZED (SELECT *, groups - 1 AS d1, n - groups AS d2, ms_between / ms_within AS f FROM ({_LAYOUT}) WHERE groups > 1 AND n > groups AND ms_within > 0),
        halved AS (SELECT cell, p, d1 / 2::DOUBLE AS a, d2 / 2::DOUBLE AS b, 0::DOUBLE AS low, 1::DOUBLE AS high, 0 AS i FROM layout, (VALUES (0.025::DOUBLE), (0.975::DOUBLE)) q(p)
          UNION ALL SELECT cell, p, a, b, CASE WHEN below THEN (low + high) / 2 ELSE low END, CASE WHEN below THEN high ELSE (low + high) / 2 END, i + 1 FROM (SELECT *, {_share("((low + high) / 2)")} < p AS below FROM halved WHERE i < {HALVINGS})),
        found AS (SELECT cell, p, (low + high) / 2 AS x FROM halved WHERE i = {HALVINGS})
        SELECT layout.*, lo.x * d2 / (d1 * (1 - lo.x)) AS f_low, hi.x * d2 / (d1 * (1 - hi.x)) AS f_high FROM layout JOIN found lo ON lo.cell = layout.cell AND lo.p < 0.5 JOIN found hi ON hi.cell = layout.cell AND hi.p > 0.5))""",
        "f f_low f_high theta theta_low theta_high icc_low icc_high", 5,
    ),
    "spearman_tied": rounded(
        """SELECT cell, count(*) AS n, corr(rx, ry) AS rho, corr(ox, oy) AS rho_broken FROM (SELECT cell,
        rank() OVER (PARTITION BY cell ORDER BY x) + (count(*) OVER (PARTITION BY cell, x) - 1) / 2::DOUBLE AS rx, rank() OVER (PARTITION BY cell ORDER BY y) + (count(*) OVER (PARTITION BY cell, y) - 1) / 2::DOUBLE AS ry,
        row_number() OVER (PARTITION BY cell ORDER BY x, node_id) AS ox, row_number() OVER (PARTITION BY cell ORDER BY y, node_id) AS oy FROM (SELECT cell, node_id, floor(rssi * 10) AS x, floor(elevation * 100) AS y FROM nodes)) GROUP BY cell""",
        "rho rho_broken",
    ),
    "record_digests": """SELECT cell, length(text) AS length, sha256(text) AS digest FROM (SELECT cell, '{"blocks":[' || string_agg('{"block_id":' || block_id || ',"n_nodes":' || n_nodes || ',"n_valid":' || n_valid || '}', ',' ORDER BY block_id) || '],"buffer":2.000000e+00,"cell":"' || cell || '","extent":{"x0":' || format('{:.6e}', x0) || ',"x1":' || format('{:.6e}', x1) || ',"y0":' || format('{:.6e}', y0) || ',"y1":' || format('{:.6e}', y1) || '},"n":' || n || ',"note":"run of /home/<user>/work"}' AS text
        FROM blocks JOIN (SELECT cell, count(*) AS n, min(x_km) AS x0, max(x_km) AS x1, min(y_km) AS y0, max(y_km) AS y1 FROM nodes GROUP BY cell) USING (cell) GROUP BY cell, n, x0, x1, y0, y1)""",
    "record_difference": """SELECT * FROM (WITH a AS (SELECT cell, unnest(['block_id', 'n_nodes', 'n_valid']) AS f, row_number() OVER (PARTITION BY cell ORDER BY block_id) - 1 AS i, unnest([block_id, n_nodes, n_valid]) AS v, n_valid FROM blocks),
        b AS (SELECT cell, unnest(['block_id', 'n_nodes', 'n_valid']) AS f, row_number() OVER (PARTITION BY cell ORDER BY block_id) - 1 AS i, unnest([block_id, n_nodes, n_valid]) AS v FROM blocks WHERE n_valid > 0)
        SELECT cell, 'blocks[' || i || '].' || f AS path, CAST(a.v AS VARCHAR) AS "left", CAST(b.v AS VARCHAR) AS "right" FROM a FULL JOIN b USING (cell, i, f) WHERE a.v IS DISTINCT FROM b.v
        UNION ALL SELECT DISTINCT cell, 'buffer', '2.000000000e+00', '0.000000000e+00' FROM blocks)""",
    "run_status": """SELECT cell, count(*) AS n, CAST(sum(CAST('0x' || substr(md5('{"block_id":' || block_id || ',"cell":"' || cell || '","n_nodes":' || n_nodes || ',"n_valid":' || n_valid || '}'), 1, 12) AS BIGINT)) AS VARCHAR) AS digest FROM blocks GROUP BY cell""",
    "merged_cells": "SELECT cell, node_id, row_number() OVER (ORDER BY cell, node_id) - 1 AS merged FROM lattice",
}
# Published quantiles of Student's t at 0.975 by degrees of freedom, from 1.
T_975 = (12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139, 2.200985, 2.178813, 2.160369, 2.144787, 2.13145)
_T = ", ".join(f"({k + 2}, {t}{D})" for k, t in enumerate(T_975))
BODIES["t_intervals"] = rounded(f"SELECT cell, seed, pred, pop, k, t, err - t * sqrt(v) AS low, err + t * sqrt(v) AS high FROM variances JOIN (VALUES {_T}) q(k, t) USING (k) WHERE v IS NOT NULL", "t low high", 5)
PARTS |= {
    "trained": "SELECT cell, seed, training, avg(abs((node_id * (7919 + training)) % 101 - 50) / CAST(5 + training % 3 AS DOUBLE)) AS mae FROM left2, (VALUES (42), (43), (44)) t(training) WHERE role = 'test' AND valid AND seed <= 5 GROUP BY ALL",
    "wide": "SELECT cell, CAST(count(*) - count(DISTINCT node_id) AS DOUBLE) AS double_ids, CAST(count(*) FILTER (WHERE NOT valid AND (pl <> 300 OR rssi <> -110)) AS DOUBLE) AS odd_sentinels, avg(elevation) AS mean, stddev_samp(elevation) AS sd, CAST(count(*) FILTER (WHERE rssi IS NULL OR isnan(rssi) OR pl IS NULL OR isnan(pl)) AS DOUBLE) AS missing FROM nodes GROUP BY cell",
    "targets": "SELECT cell, block_id, CAST('0x' || substr(md5('target|' || node_id), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS t FROM nodes",
    "effect": """SELECT cell, var_samp(mae) / avg((1 - n / n_u) * s2 / n) AS permuted_effect FROM (SELECT cell, seed, avg(t) AS mae, count(*) AS n FROM targets JOIN roles USING (cell, block_id) WHERE role = 'test' GROUP BY ALL)
  JOIN (SELECT cell, var_samp(t) AS s2, CAST(count(*) AS DOUBLE) AS n_u FROM targets GROUP BY cell) USING (cell) GROUP BY cell""",
}
SQL |= {name: build(body, DRAWS_OF.get(name, 60)) for name, body in BODIES.items()}
