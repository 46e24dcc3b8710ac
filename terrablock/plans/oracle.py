"""DuckDB SQL for the queries of catalog, over the same tables; parts that many share are CTEs of PARTS."""

from __future__ import annotations

import math
import re

PI = math.pi
#: CTEs by name, in the order in which they may stand.
PARTS = {
    "lattice": """SELECT *, 'Q' || CAST(1 + CAST(x_km >= 50 AS INT) + 2 * CAST(y_km >= 50 AS INT) AS VARCHAR) AS cell, CAST(floor(x_km / 10) * 12 + floor(y_km / 10) AS BIGINT) AS block_id FROM (
  SELECT o_orderkey AS node_id, CAST(o_orderkey % side AS DOUBLE) * CAST(103.4 AS DOUBLE) / greatest(side - 1, 1) AS x_km, CAST(o_orderkey // side AS DOUBLE) * CAST(111 AS DOUBLE) / greatest(side - 1, 1) AS y_km, side,
    (o_custkey % 200) / CAST(100 AS DOUBLE) - 1 AS ndvi, (o_custkey % 50) / CAST(100 AS DOUBLE) AS slope, (o_totalprice - 250000) / 150000 AS elevation, (o_totalprice / 500000 - CAST(0.5 AS DOUBLE)) * 20 AS shift
  FROM orders, (SELECT CAST(ceil(sqrt(greatest(count(*), 1))) AS BIGINT) AS side FROM orders))""",
    "sites": """SELECT CAST(n_nationkey AS BIGINT) AS site_id, CAST(8 + 22 * (n_nationkey % 5) AS DOUBLE) AS sx, CAST(12 + 20 * (n_nationkey // 5) AS DOUBLE) AS sy, CAST([700, 900, 1900][n_nationkey % 3 + 1] AS DOUBLE) AS freq FROM nation""",
    "ranged": "SELECT node_id, site_id, freq, 1000 * sqrt((x_km - sx) * (x_km - sx) + (y_km - sy) * (y_km - sy)) AS dist_m FROM lattice, sites",
    "nearest": "SELECT node_id, min(dist_m) AS dist_m, arg_min(site_id, {'d': dist_m, 's': site_id}) AS site_id, arg_min(freq, {'d': dist_m, 's': site_id}) AS freq FROM ranged GROUP BY node_id",
    "nodes": """SELECT *, rssi > -85 AS covered, rssi + ((node_id * 7919) % 101 - 50) / CAST(25 AS DOUBLE) AS pred_a, rssi + ((node_id * 104729) % 101 - 50) / CAST(10 AS DOUBLE) AS pred_b FROM (
  SELECT *, CASE WHEN valid THEN 55 - pl ELSE -110 END AS rssi FROM (SELECT *, CASE WHEN valid THEN fs + shift ELSE 300 END AS pl FROM (
    SELECT lattice.*, nearest.dist_m, nearest.site_id, nearest.freq, dist_m <= 6000 AS valid, 20 * log10(greatest(dist_m / 1000, CAST(0.001 AS DOUBLE))) + 20 * log10(CAST(900 AS DOUBLE)) + CAST(32.44 AS DOUBLE) AS fs
    FROM lattice JOIN nearest USING (node_id))))""",
    "blocks": "SELECT cell, block_id, count(*) AS n_nodes, count(*) FILTER (WHERE valid) AS n_valid FROM nodes GROUP BY ALL",
    "placed": "SELECT cell, seed, block_id, row_number() OVER (PARTITION BY cell, seed ORDER BY md5(seed || '|' || block_id), block_id) - 1 AS place, count(*) OVER (PARTITION BY cell, seed) AS n FROM blocks, (SELECT unnest(range(1, 61)) AS seed)",
    "roles": """SELECT cell, seed, block_id, CASE WHEN place < tr THEN 'train' WHEN place < tr + va THEN 'val' ELSE 'test' END AS role FROM (
  SELECT cell, seed, block_id, place, CASE WHEN t + v >= n THEN greatest(1, n - 2) ELSE t END AS tr, CASE WHEN t + v >= n THEN 1 ELSE v END AS va FROM (
    SELECT *, greatest(1, round_even(n * CAST(0.7 AS DOUBLE), 0)) AS t, greatest(1, round_even(n * CAST(0.15 AS DOUBLE), 0)) AS v FROM placed))""",
    "folds": "SELECT cell, seed, block_id, CAST(least(place // greatest(1, n // 6), 5) AS INTEGER) AS fold FROM placed",
    "held": "SELECT nodes.*, seed, role FROM nodes JOIN roles USING (cell, block_id) WHERE role <> 'train'",
    "pairs": """SELECT p.cell, p.node_id, p.block_id, q.node_id AS o_node, q.block_id AS o_block FROM lattice p JOIN (
  SELECT cell, node_id, block_id, x_km, y_km, floor(x_km / 2) + dx AS kx, floor(y_km / 2) + dy AS ky FROM lattice, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)) q
  ON p.cell = q.cell AND floor(p.x_km / 2) = kx AND floor(p.y_km / 2) = ky AND p.block_id <> q.block_id
  WHERE (p.x_km - q.x_km) * (p.x_km - q.x_km) + (p.y_km - q.y_km) * (p.y_km - q.y_km) < 4""",
    "trim1": "SELECT DISTINCT h.cell, h.seed, pairs.node_id FROM pairs JOIN roles h USING (cell, block_id) JOIN roles t ON t.cell = h.cell AND t.seed = h.seed AND t.block_id = o_block WHERE h.role <> 'train' AND t.role = 'train'",
    "left1": "SELECT * FROM held ANTI JOIN trim1 USING (cell, seed, node_id)",
    "trim2": "SELECT DISTINCT a.cell, a.seed, a.node_id FROM left1 a JOIN pairs p ON p.cell = a.cell AND p.node_id = a.node_id JOIN left1 v ON v.cell = a.cell AND v.seed = a.seed AND v.node_id = p.o_node WHERE a.role = 'test' AND v.role = 'val'",
    "left2": "SELECT * FROM left1 ANTI JOIN trim2 USING (cell, seed, node_id)",
    "fitted": "SELECT cell, seed, median(rssi) AS constant, median(rssi + fs) AS off_a, median(rssi + fs) FILTER (WHERE valid) AS off_b FROM nodes JOIN roles USING (cell, block_id) WHERE role = 'train' GROUP BY ALL",
    "scored": """SELECT cell, seed, block_id, pred, pop, abs(e) AS e, CASE pop WHEN 'valid' THEN valid WHEN 'sentinel' THEN NOT valid ELSE true END AS ok FROM (
  SELECT cell, seed, block_id, valid, pred, CASE pred WHEN 'constant' THEN rssi - constant WHEN 'fspl_a' THEN rssi - (off_a - fs) ELSE rssi - (off_b - fs) END AS e
  FROM left2 LEFT JOIN fitted USING (cell, seed), (VALUES ('constant'), ('fspl_a'), ('fspl_b')) p(pred) WHERE role = 'test'), (VALUES ('valid'), ('sentinel'), ('all')) q(pop)""",
    "scored0": """SELECT cell, seed, block_id, pred, pop, abs(e) AS e, CASE pop WHEN 'valid' THEN valid WHEN 'sentinel' THEN NOT valid ELSE true END AS ok FROM (
  SELECT cell, seed, block_id, valid, pred, CASE pred WHEN 'constant' THEN rssi - constant WHEN 'fspl_a' THEN rssi - (off_a - fs) ELSE rssi - (off_b - fs) END AS e
  FROM held LEFT JOIN fitted USING (cell, seed), (VALUES ('constant'), ('fspl_a'), ('fspl_b')) p(pred) WHERE role = 'test'), (VALUES ('valid'), ('sentinel'), ('all')) q(pop)""",
    "per_draw": "SELECT cell, seed, pred, pop, count(*) FILTER (WHERE ok) AS n, avg(e) FILTER (WHERE ok) AS mae FROM scored GROUP BY cell, seed, pred, pop",
    "per_draw0": "SELECT cell, seed, pred, pop, count(*) FILTER (WHERE ok) AS n, avg(e) FILTER (WHERE ok) AS mae FROM scored0 GROUP BY cell, seed, pred, pop",
}
_DRIFT = """SELECT cell, pred, pop, count(*) AS n_draws, avg(mae) AS mean, coalesce(stddev_samp(mae), 0) AS sd, min(mae) AS low, max(mae) AS high,
  CASE WHEN count(*) > 1 THEN sqrt(sum(n * (mae - m) * (mae - m)) / nullif(sum(n) - sum(CAST(n AS DOUBLE) * n) / nullif(sum(n), 0), 0)) END AS weighted_sd
  FROM (SELECT *, sum(mae * n) OVER w / nullif(sum(n) OVER w, 0) AS m FROM {} WHERE mae IS NOT NULL WINDOW w AS (PARTITION BY cell, pred, pop)) GROUP BY cell, pred, pop"""
PARTS |= {
    "drift": _DRIFT.format("per_draw"),
    "drift0": _DRIFT.format("per_draw0"),
    "sums": "SELECT cell, seed, block_id, pred, pop, sum(e) AS s, count(*) AS m FROM scored WHERE ok GROUP BY ALL",
    "totals": "SELECT *, count(*) OVER w AS k, sum(m) OVER w AS m_all, sum(s) OVER w / sum(m) OVER w AS err FROM sums WINDOW w AS (PARTITION BY cell, seed, pred, pop)",
    "variances": """SELECT cell, seed, pred, pop, k, CAST(any_value(m_all) AS BIGINT) AS m, any_value(err) AS err,
  CASE WHEN k > 1 THEN (1 - k / CAST(any_value(n_blocks) AS DOUBLE)) * k / (k - 1) * sum((s - err * m) * (s - err * m)) / (CAST(any_value(m_all) AS DOUBLE) * any_value(m_all)) END AS v
  FROM totals JOIN (SELECT cell, count(*) AS n_blocks FROM blocks GROUP BY cell) USING (cell) GROUP BY cell, seed, pred, pop, k""",
    "kept": "SELECT cell, node_id, count(*) AS n_kept FROM left2 WHERE role = 'test' GROUP BY ALL",
    "included": """SELECT nodes.*, n_block, coalesce(n_kept, 0) AS n_kept, coalesce(n_kept, 0) / CAST(60 AS DOUBLE) AS p, coalesce(n_kept, 0) / CAST(nullif(n_block, 0) AS DOUBLE) AS p_given, abs(rssi + 110) AS e
  FROM nodes JOIN (SELECT cell, block_id, count(*) FILTER (WHERE role = 'test') AS n_block FROM roles GROUP BY ALL) USING (cell, block_id) LEFT JOIN kept USING (cell, node_id)""",
    "constant_draws": "SELECT cell, seed, count(*) AS n, avg(abs(rssi + 110)) AS mae FROM left2 WHERE role = 'test' GROUP BY ALL",
    "edges": """SELECT p.node_id AS src, q.node_id AS dst FROM (SELECT node_id, node_id % side + dx AS c, node_id // side + dy AS r FROM lattice, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)) p
  JOIN (SELECT node_id, node_id % side AS c, node_id // side AS r FROM lattice) q USING (c, r)""",
    "levels": "SELECT node_id, site_id, dist_m, 55 - (20 * log10(greatest(dist_m / 1000, CAST(0.001 AS DOUBLE))) + 20 * log10(freq) + CAST(32.44 AS DOUBLE)) AS level FROM ranged WHERE dist_m <= 30000",
    "boxes": "SELECT cell, min(x_km) AS x0, max(x_km) AS x1, min(y_km) AS y0, max(y_km) AS y1 FROM lattice GROUP BY cell",
    "block_means": "SELECT cell, block_id, avg(rssi) AS m FROM nodes GROUP BY ALL",
}


def build(body: str, draws: int = 60) -> str:
    """body with the CTEs it needs, and those that they need, before it; draws: how many the roles have."""
    needed: set[str] = set()
    queue = [body]
    while queue:
        words = set(re.findall(r"\w+", queue.pop()))
        for name in PARTS.keys() & words - needed:
            needed.add(name)
            queue.append(PARTS[name])
    ctes = [f"{name} AS MATERIALIZED ({sql})" for name, sql in PARTS.items() if name in needed]
    sql = f"WITH {', '.join(ctes)}\n{body}" if ctes else body
    return sql.replace("range(1, 61)", f"range(1, {draws + 1})").replace("CAST(60 AS DOUBLE)", f"CAST({draws} AS DOUBLE)")


def rounded(body: str, columns: str, digits: int = 6) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) + 0.0 AS {c}' for c in columns.split())}) FROM ({body})"


LOG_F, LOG_D = "log10(freq)", "log10(greatest(dist_m / 1000, CAST(0.001 AS DOUBLE)))"
_SLOPE = f"(44.9::DOUBLE - 6.55::DOUBLE * log10(30::DOUBLE)) * {LOG_D}"
_URBAN = f"69.55::DOUBLE + 26.16::DOUBLE * {LOG_F} - 13.82::DOUBLE * log10(30::DOUBLE) - (3.2::DOUBLE * log10(17.625::DOUBLE) ** 2 - 4.97::DOUBLE) + {_SLOPE}"


def _small(f: str) -> str:
    return f"((1.1::DOUBLE * log10({f}) - 0.7::DOUBLE) * 1.5::DOUBLE - (1.56::DOUBLE * log10({f}) - 0.8::DOUBLE))"


def _cost(f: str, extra: int) -> str:
    return f"46.3::DOUBLE + 33.9::DOUBLE * log10({f}) - 13.82::DOUBLE * log10(30::DOUBLE) - {_small(f)} + {_SLOPE} + {extra}"


_SUB, _RUR = f"- 2 * log10(freq / 28) ** 2 - 5.4::DOUBLE", f"- 4.78::DOUBLE * {LOG_F} ** 2 + 18.33::DOUBLE * {LOG_F} - 40.94::DOUBLE"
_HATA = f"69.55::DOUBLE + 26.16::DOUBLE * {LOG_F} - 13.82::DOUBLE * log10(30::DOUBLE) - {_small('freq')} + {_SLOPE}"
_VEG = "least(greatest(0.25::DOUBLE * freq ** 0.39::DOUBLE * least(dist_m * least(greatest((ndvi + 1) / 2, 0), 1) * 0.3::DOUBLE, 400) ** 0.25::DOUBLE, 0), 40)"


def _terrain(s: str) -> str:
    return f"least(greatest({s} * 20 + CASE WHEN {s} > 0.1::DOUBLE THEN ({s} - 0.1::DOUBLE) * 30 ELSE 0 END, 0), 30)"


def _combined(hata: str, extra: int) -> str:
    return f"CASE WHEN freq <= 1500 THEN {_HATA} {hata} ELSE {_cost('least(greatest(freq, 1500::DOUBLE), 2000)', extra)} END + {_VEG} + {_terrain('slope')}"


_V = "(least(greatest(greatest(elevation * 40, 0) * 0.5::DOUBLE + slope * 0.5::DOUBLE, 0), 80) * sqrt(2 * (h + h) / (3e8 / 9e8 * h * h + 1e-9)))"
_METRIC_PARTS = {
    "all": "true", "valid": "valid", "sentinel": "NOT valid", "covered": "covered", "uncovered": "NOT covered", "vegetated": "ndvi > 0.5::DOUBLE", "bare": "ndvi < 0.2::DOUBLE",
    "near": "dist_m < 5000", "middle": "dist_m >= 5000 AND dist_m < 15000", "far": "dist_m >= 15000",
}
_SHAPES = {"mae": "avg(abs(pred_b - rssi))", "rmse": "sqrt(avg((pred_b - rssi) * (pred_b - rssi)))", "bias": "avg(pred_b - rssi)", "n": "count(*)"}


def _metric(name: str, value: str) -> str:
    return f"SELECT '{name}' AS metric, CAST({value} AS DOUBLE) AS value FROM nodes"


def _filtered(shape: str, part: str) -> str:
    f = f"FILTER (WHERE {part})"
    return f"sqrt(avg((pred_b - rssi) * (pred_b - rssi)) {f})" if shape == "rmse" else f"{_SHAPES[shape]} {f}"


_DIAGNOSTICS = " UNION ALL ".join([*(_metric(f"{s}_{p}", _filtered(s, c)) for s in _SHAPES for p, c in _METRIC_PARTS.items()), _metric("pearson", "corr(rssi, pred_b)"), _metric("coverage_accuracy", "avg(CAST(covered = (pred_b > -85) AS DOUBLE))"),
    _metric("std_pred", "stddev_samp(pred_b)"), _metric("std_truth", "stddev_samp(rssi)"), _metric("fidelity", "stddev_samp(pred_b) / nullif(stddev_samp(rssi), 0)"),
    _metric("fspl_compliance", "avg(CAST(55 - pred_b >= fs AS DOUBLE))"), _metric("range_ok", "avg(CAST(pred_b BETWEEN -140 AND -30 AS DOUBLE))"), _metric("distance_gradient", "corr(pred_b, -dist_m)"),
    *(_metric(f"coverage_at_{x}dbm", f"100 * avg(CAST(pred_b > -{x} AS DOUBLE))") for x in (85, 95, 105)), _metric("coverage_spread", "100 * avg(CAST(pred_b > -85 AS DOUBLE)) - 100 * avg(CAST(pred_b > -95 AS DOUBLE))"),
    *(_metric(f"corr_{c}_error", f"corr({c}, abs(pred_b - rssi))") for c in ("dist_m", "elevation", "slope", "ndvi")), *(_metric(f"pred_p{q}", f"quantile_cont(pred_b, {q / 100})") for q in (10, 25, 75, 90)),
    "SELECT 'p90_' || CASE WHEN dist_m < 5000 THEN 'near' WHEN dist_m < 15000 THEN 'middle' ELSE 'far' END AS metric, quantile_cont(abs(pred_b - rssi), 0.9) AS value FROM nodes GROUP BY 1",
])
_BITS = [f"((s >> {i}) & 1)" for i in range(8)]
_DISCS = " + ".join(f"{_BITS[4 + i]} * (1 - {_BITS[a]}) * (1 - {_BITS[b]})" for i, (a, b) in enumerate(((0, 2), (1, 2), (0, 3), (1, 3))))
_CHANCE = " * ".join(f"(CASE WHEN {x} = 1 THEN 1 - q ELSE q END)" for x in _BITS)
_EXTREME = """SELECT cell, {pick}(theta) AS {name} FROM (SELECT cell, {best}(
  (sum(hi * n * e) OVER u + sum(lo * n * e) OVER a - sum(lo * n * e) OVER u) / (sum(hi * n) OVER u + sum(lo * n) OVER a - sum(lo * n) OVER u), sum(lo * n * e) OVER a / sum(lo * n) OVER a) AS theta
  FROM (SELECT cell, round(abs(rssi + 110), 1) AS e, CASE WHEN border < 2 THEN 0.02::DOUBLE ELSE 0.15::DOUBLE END AS lo, CASE WHEN border < 2 THEN 0.087::DOUBLE ELSE 0.15::DOUBLE END AS hi, count(*) AS n
    FROM (SELECT *, least(x_km - floor(x_km / 10) * 10, 10 - (x_km - floor(x_km / 10) * 10), y_km - floor(y_km / 10) * 10, 10 - (y_km - floor(y_km / 10) * 10)) AS border FROM nodes) GROUP BY ALL)
  WINDOW a AS (PARTITION BY cell), u AS (PARTITION BY cell ORDER BY e {way}, lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY cell"""
_BORDER = "least(x_km - floor(x_km / 10) * 10, 10 - (x_km - floor(x_km / 10) * 10), y_km - floor(y_km / 10) * 10, 10 - (y_km - floor(y_km / 10) * 10))"
_CONTRAST = "abs(pred_a - rssi) - abs(pred_b - rssi)"

BODIES = {
    "node_table": rounded("SELECT node_id, cell, block_id, x_km, y_km, site_id, dist_m, valid, pl, rssi, covered, pred_a, pred_b FROM nodes", "x_km y_km dist_m pl rssi pred_a pred_b"),
    "synthetic_grid": rounded("SELECT i AS node_id, i // 60 AS row, i % 60 AS col, -49.6::DOUBLE + (i % 60) * (-48.6::DOUBLE - -49.6::DOUBLE) / 59 AS lon, -21.8::DOUBLE - (i // 60) * (-21.8::DOUBLE - -22.8::DOUBLE) / 59 AS lat FROM range(3600) t(i)", "lon lat", 9),
    "project_xy": rounded("SELECT node_id, (lon - -49.5::DOUBLE) * 111 * cos(radians(lat)) AS x, (lat - -22.5::DOUBLE) * 111 AS y FROM (SELECT node_id, -49.5::DOUBLE + x_km / 111 AS lon, -22.5::DOUBLE + y_km / 111 AS lat FROM lattice)", "x y"),
    "cell_extents": rounded("SELECT cell, (b - a) * 111 * cos(radians((c + d) / 2)) AS width, (d - c) * 111 AS height FROM (SELECT cell, min(-49.5::DOUBLE + x_km / 111) AS a, max(-49.5::DOUBLE + x_km / 111) AS b, min(-22.5::DOUBLE + y_km / 111) AS c, max(-22.5::DOUBLE + y_km / 111) AS d FROM lattice GROUP BY cell)", "width height"),
    "block_ids": rounded(f"SELECT node_id, block_id, block_id // 12 AS gx, block_id % 12 AS gy, {_BORDER} AS border_km FROM lattice", "border_km"),
    "block_table": "SELECT * FROM blocks",
    "block_neighbours": "SELECT a.cell, a.block_id, count(b.block_id) AS n FROM blocks a LEFT JOIN blocks b ON a.cell = b.cell AND a.block_id <> b.block_id AND abs(a.block_id // 12 - b.block_id // 12) <= 1 AND abs(a.block_id % 12 - b.block_id % 12) <= 1 GROUP BY ALL",
    "propagation_models": rounded(
        f"SELECT node_id, 20 * {LOG_D} + 20 * {LOG_F} + 32.44::DOUBLE AS fspl, {_URBAN} AS hata_urban, {_URBAN} {_SUB} AS hata_suburban, {_URBAN} {_RUR} AS hata_rural, {_cost('freq', 3)} AS cost231_urban, {_cost('freq', 0)} AS cost231_suburban, 20 * log10(0.001::DOUBLE) + 20 * {LOG_F} + 32.44::DOUBLE + 35 * log10(greatest(dist_m, 1)) AS log_distance FROM nearest",
        "fspl hata_urban hata_suburban hata_rural cost231_urban cost231_suburban log_distance", 5,
    ),
    "combined_loss": rounded(f"SELECT node_id, {_combined('', 3)} AS urban, {_combined(_SUB, 0)} AS suburban, {_combined(_RUR, 0)} AS rural FROM nodes", "urban suburban rural", 5),
    "enriched_targets": rounded(
        f"""SELECT node_id, loss, level, shadow, least(greatest(CASE WHEN v < -0.7::DOUBLE THEN 0 WHEN v <= 0 THEN -20 * log10(0.5::DOUBLE - 0.62::DOUBLE * v) WHEN v <= 1 THEN -20 * log10(0.5::DOUBLE * exp(-0.95::DOUBLE * v))
          WHEN v <= 2.4::DOUBLE THEN -20 * log10(0.4::DOUBLE - sqrt(greatest(0.1184::DOUBLE - (0.38::DOUBLE - 0.1::DOUBLE * v) ** 2, 1e-9))) ELSE -20 * log10(greatest(0.225::DOUBLE / v, 1e-9)) END, 0), 40) AS diffraction,
          CASE WHEN level >= -70 THEN 1 WHEN level >= -85 THEN 2 WHEN level >= -100 THEN 3 WHEN level >= -110 THEN 4 ELSE 5 END AS class
        FROM (SELECT node_id, CASE WHEN valid THEN pl + delta ELSE pl END AS loss, CASE WHEN valid THEN rssi - delta ELSE rssi END AS level,
          least(greatest(dist_m * least(greatest(ndvi - 0.5::DOUBLE, 0), 1) * 0.2::DOUBLE * least(greatest(ndvi, 0), 1) * 0.5::DOUBLE ** 0.4::DOUBLE, 0), 40) AS shadow, {_V} AS v
        FROM (SELECT *, {_terrain('slope')} - {_terrain('(slope / 2)')} AS delta, greatest(dist_m / 2, 1) AS h FROM nodes))""",
        "loss level shadow diffraction", 5,
    ),
    "retention_laws": rounded(
        f"""SELECT g, b, q, ((g - 2 * b) ** 2 + 4 * b * (g - 2 * b) * q + (4 - {PI!r}::DOUBLE) * b * b * q * q + {PI!r}::DOUBLE * b * b * q * q * q) / (g * g) AS law,
          sum({_CHANCE} * (greatest(0, g - b * ({_BITS[0]} + {_BITS[1]})) * greatest(0, g - b * ({_BITS[2]} + {_BITS[3]})) - ({_DISCS}) * {PI!r}::DOUBLE * b * b / 4) / (g * g)) AS enumerated
        FROM (SELECT CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b, k / 10::DOUBLE AS q, s FROM (VALUES (10, 2), (5, 2), (10, 1)) t(g, b), range(11) r(k), range(256) z(s)) GROUP BY g, b, q""",
        "q law enumerated",
    ),
    "inclusion_law": rounded(
        """SELECT cell, n_blocks, CAST(m AS INTEGER) AS m, coalesce(list_product(list_transform(range(0, m), lambda j: (k_test - 1 - j) / CAST(n_blocks - 1 - j AS DOUBLE))), 1) AS low,
          coalesce(list_product(list_transform(range(0, m), lambda j: (n_blocks - 1 - k_train - j) / CAST(n_blocks - 1 - j AS DOUBLE))), 1) AS high
        FROM (SELECT cell, count(*) AS n_blocks, count(*) FILTER (WHERE role = 'train') AS k_train, count(*) FILTER (WHERE role = 'test') AS k_test FROM roles WHERE seed = 1 GROUP BY cell), range(5) t(m)""",
        "low high", 9,
    ),
    "block_roles": "SELECT * FROM roles",
    "kfold_roles": "SELECT * FROM folds",
    "nearest_antenna": rounded("SELECT node_id, site_id, dist_m FROM nearest", "dist_m"),
    "antenna_topk": rounded("SELECT node_id, site_id, CAST(place AS INTEGER) AS place, dist_m, level FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY level DESC, site_id) AS place FROM levels WHERE level > -150) WHERE place <= 5", "dist_m level"),
    "best_antenna": rounded("SELECT node_id, arg_max(site_id, {'l': level, 's': -site_id}) AS site_id, max(level) AS level FROM levels GROUP BY node_id", "level"),
    "near_blocks": "SELECT DISTINCT cell, node_id, block_id, o_block AS near_block FROM pairs",
    "kfold_trim": "SELECT DISTINCT f.cell, f.seed, p.node_id FROM pairs p JOIN folds f ON f.cell = p.cell AND f.block_id = p.block_id JOIN folds o ON o.cell = f.cell AND o.seed = f.seed AND o.block_id = p.o_block WHERE f.fold <> o.fold",
    "buffer_trim": "SELECT cell, seed, node_id, role FROM left2",
    "retention": rounded("SELECT *, n_after / CAST(n_before AS DOUBLE) AS share FROM (SELECT cell, seed, role, count(*) AS n_before FROM held GROUP BY ALL) JOIN (SELECT h.cell, h.seed, h.role, count(l.node_id) AS n_after FROM held h LEFT JOIN left2 l USING (cell, seed, node_id) GROUP BY ALL) USING (cell, seed, role)", "share"),
    "effective_blocks": """SELECT cell, seed, count(*) AS n_blocks, count(*) FILTER (WHERE share = 0) AS n_empty, count(*) FILTER (WHERE share > 0 AND share < 0.1::DOUBLE) AS n_thin FROM (
        SELECT h.cell, h.seed, h.block_id, count(l.node_id) / CAST(count(*) AS DOUBLE) AS share FROM held h LEFT JOIN left2 l USING (cell, seed, node_id) WHERE h.role = 'test' GROUP BY ALL) GROUP BY ALL""",
    "box_overlap": rounded(
        """SELECT a, b, area, area / least(s, t) AS over_smaller, area / (s + t - area) AS over_union FROM (SELECT p.cell AS a, q.cell AS b, greatest(0, least(p.x1, q.x1) - greatest(p.x0, q.x0)) * greatest(0, least(p.y1, q.y1) - greatest(p.y0, q.y0)) AS area,
        (p.x1 - p.x0) * (p.y1 - p.y0) AS s, (q.x1 - q.x0) * (q.y1 - q.y0) AS t FROM boxes p JOIN boxes q ON p.cell < q.cell)""",
        "area over_smaller over_union",
    ),
    "coincident_nodes": "SELECT count(*) AS n_places, count(*) FILTER (WHERE c > 1) AS n_shared FROM (SELECT count(DISTINCT cell) AS c FROM lattice GROUP BY round(x_km, 0), round(y_km, 0))",
    "cross_violations": """SELECT s.seed, count(DISTINCT v.node_id) AS n_violations FROM (SELECT DISTINCT seed FROM roles) s LEFT JOIN (
        SELECT h.seed, p.node_id FROM (SELECT p.cell AS pc, p.node_id, p.block_id AS pb, q.cell AS qc, q.block_id AS qb FROM lattice p JOIN lattice q ON p.cell <> q.cell AND abs(p.x_km - q.x_km) < 2 AND abs(p.y_km - q.y_km) < 2
          WHERE (p.x_km - q.x_km) * (p.x_km - q.x_km) + (p.y_km - q.y_km) * (p.y_km - q.y_km) < 4) p
        JOIN roles h ON h.cell = pc AND h.block_id = pb AND h.role = 'test' JOIN roles t ON t.cell = qc AND t.block_id = qb AND t.seed = h.seed AND t.role = 'train') v USING (seed) GROUP BY s.seed""",
    "edge_report": rounded("SELECT count(*) AS n_edges, count(*) FILTER (WHERE src = dst) AS n_loops, count(*) - count(DISTINCT (src, dst)) AS n_double, (SELECT count(*) FROM edges a ANTI JOIN edges b ON a.src = b.dst AND a.dst = b.src) AS n_one_way, (SELECT max(d) FROM (SELECT count(*) AS d FROM edges GROUP BY src)) AS max_degree, (SELECT avg(d) FROM (SELECT count(*) AS d FROM edges GROUP BY src)) AS mean_degree FROM edges", "mean_degree"),
    "induced_subgraph": "SELECT src, dst FROM edges JOIN nodes a ON a.node_id = src AND a.valid JOIN nodes b ON b.node_id = dst AND b.valid",
    "graph_mean_agg": rounded("SELECT src AS node_id, avg(rssi) AS mean FROM edges JOIN nodes ON node_id = dst WHERE src <> dst GROUP BY src", "mean"),
    "calibration_offsets": rounded("SELECT * FROM fitted", "constant off_a off_b"),
    "draw_errors": rounded("SELECT * FROM per_draw", "mae"),
    "drift_constant": rounded("SELECT * FROM drift", "mean sd weighted_sd low high"),
    "drift_no_buffer": rounded("SELECT * FROM drift0", "mean sd weighted_sd low high"),
    "drift_vs_cells": rounded("SELECT pred, pop, count(*) AS n_cells, avg(sd) AS mean_sd, stddev_samp(mean) AS sd_of_means, avg(sd) / nullif(stddev_samp(mean), 0) AS ratio FROM drift GROUP BY pred, pop", "mean_sd sd_of_means ratio"),
    "inversion_counts": "SELECT coalesce(cell, 'ALL') AS cell, pop, count(*) AS n_draws, count(*) FILTER (WHERE a.mae > b.mae) AS n_inverted FROM (SELECT * FROM per_draw WHERE pred = 'constant' AND mae IS NOT NULL) a JOIN (SELECT * FROM per_draw WHERE pred = 'fspl_a' AND mae IS NOT NULL) b USING (cell, seed, pop) GROUP BY GROUPING SETS ((cell, pop), (pop))",
    "level_sensitivity": rounded("SELECT cell, CAST(level AS DOUBLE) AS level, count(*) AS n_draws, avg(mae) AS mean, stddev_samp(mae) AS sd FROM (SELECT cell, seed, level, avg(abs(rssi - level)) AS mae FROM held, (VALUES (-130), (-120), (-110), (-100)) t(level) WHERE role = 'test' AND valid GROUP BY ALL) GROUP BY cell, level", "mean sd"),
    "prediction_errors": rounded("SELECT cell, valid, count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS bias, quantile_cont(abs(e), 0.9) AS p90 FROM (SELECT cell, valid, pred_a - rssi AS e FROM nodes) GROUP BY ALL", "mae rmse bias p90"),
    "prediction_contrast": rounded(f"SELECT cell, count(*) AS n, avg(d) AS mean, stddev_samp(d) AS sd, count(*) FILTER (WHERE d < 0) AS n_a_wins, avg(CASE WHEN abs(d) <= 5 THEN 0.5::DOUBLE * d * d ELSE 5 * (abs(d) - 2.5::DOUBLE) END) AS huber FROM (SELECT cell, block_id, avg({_CONTRAST}) AS d FROM nodes GROUP BY ALL) GROUP BY cell", "mean sd huber"),
    "diagnostics": rounded(_DIAGNOSTICS, "value"),
    "correlations": rounded("SELECT cell, corr(rssi, elevation) AS pearson, CASE WHEN count(*) < 5 THEN 0 ELSE least(1, greatest(-1, coalesce(corr(rssi, elevation), 0) * (count(*) - 1) / count(*))) END AS short_pearson FROM nodes WHERE valid GROUP BY cell", "pearson short_pearson"),
    "spearman": rounded("SELECT cell, corr(rx, ry) AS rho FROM (SELECT cell, row_number() OVER (PARTITION BY cell ORDER BY x, block_id) AS rx, row_number() OVER (PARTITION BY cell ORDER BY y, block_id) AS ry FROM (SELECT cell, block_id, round(avg(rssi), 6) AS x, round(avg(elevation), 6) AS y FROM nodes GROUP BY ALL)) GROUP BY cell", "rho"),
    "median_band": "SELECT cell, v[CAST(floor((len(v) - 1) * 0.5) AS INT) + 1] AS low, v[CAST(ceil((len(v) - 1) * 0.5) AS INT) + 1] AS high FROM (SELECT cell, list(round(rssi, 6) ORDER BY rssi) AS v FROM nodes WHERE valid GROUP BY cell)",
    "feature_profile": rounded(" UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS n, min({c}) AS low, max({c}) AS high, avg(CAST({c} <> 0 AS DOUBLE)) AS share_nonzero, min({c}) = max({c}) AS constant FROM lattice" for c in ("ndvi", "slope", "elevation", "x_km", "y_km")), "low high share_nonzero"),
    "cell_table": rounded("SELECT cell, count(*) AS n, count(*) FILTER (WHERE valid) AS n_valid, count(*) FILTER (WHERE NOT valid) AS n_sentinel, count(DISTINCT block_id) AS n_blocks, count(DISTINCT block_id) FILTER (WHERE valid) AS n_valid_blocks, count(DISTINCT site_id) FILTER (WHERE valid) AS n_sites, avg(dist_m) AS mean_dist FROM nodes GROUP BY cell", "mean_dist"),
    "contingency": "SELECT cell, count(*) FILTER (WHERE valid AND dist_m > 30000) AS valid_far, count(*) FILTER (WHERE valid AND dist_m <= 30000) AS valid_near, count(*) FILTER (WHERE NOT valid AND dist_m > 30000) AS sentinel_far, count(*) FILTER (WHERE NOT valid AND dist_m <= 30000) AS sentinel_near FROM nodes GROUP BY cell",
    "valid_fraction": rounded("SELECT *, share - max(share) FILTER (WHERE role = 'train') OVER (PARTITION BY cell, seed) AS over_train FROM (SELECT cell, seed, role, count(*) AS n, avg(CAST(valid AS DOUBLE)) AS share FROM nodes JOIN roles USING (cell, block_id) GROUP BY ALL)", "share over_train"),
    "block_sums": rounded("SELECT * FROM sums", "s", 5),
    "cluster_variance": rounded("SELECT * FROM variances", "err v", 5),
    "variance_summary": rounded("SELECT *, CASE WHEN var_err > 0 THEN mean_v / var_err END AS q FROM (SELECT cell, pred, pop, any_value(mean_err) AS mean_err, any_value(var_err) AS var_err, count(*) AS n_draws, count(v) AS n_defined, avg(v) AS mean_v, avg(CASE WHEN v IS NOT NULL THEN CAST(abs(err - mean_err) <= 2 * sqrt(v) AS DOUBLE) END) AS coverage FROM (SELECT *, avg(err) OVER w AS mean_err, var_samp(err) OVER w AS var_err FROM variances WINDOW w AS (PARTITION BY cell, pred, pop)) GROUP BY cell, pred, pop)", "mean_err var_err mean_v coverage q", 4),
    "jackknife_variance": rounded("SELECT cell, seed, pred, pop, count(*) AS k, CASE WHEN count(*) > 1 THEN (count(*) - 1) * var_pop(o) END AS v FROM (SELECT *, (sum(s) OVER w - s) / nullif(sum(m) OVER w - m, 0) AS o FROM sums WINDOW w AS (PARTITION BY cell, seed, pred, pop)) GROUP BY cell, seed, pred, pop", "v", 4),
    "inclusion_freq": rounded("SELECT cell, node_id, n_block, n_kept, p, p_given FROM included", "p p_given"),
    "inclusion_profile": rounded(f"SELECT cell, CAST(floor({_BORDER} / 0.25::DOUBLE) AS BIGINT) AS bin, count(*) AS n, avg(p_given) AS p_given FROM included WHERE p_given IS NOT NULL GROUP BY ALL", "p_given"),
    "hajek": rounded("SELECT cell, valid, count(*) AS n, sum(e / p) / sum(1 / p) AS estimate FROM included WHERE p > 0 GROUP BY ALL", "estimate"),
    "estimands": rounded("SELECT *, b - c - ratio_term AS residual FROM (SELECT cell, avg(e) AS a, sum(p * e) / sum(p) AS c FROM included GROUP BY cell) JOIN (SELECT cell, count(*) AS n_draws, avg(mae) AS b, -covar_pop(mae, n) / avg(n) AS ratio_term FROM constant_draws GROUP BY cell) USING (cell)", "a b c ratio_term residual", 5),
    "design_effect": rounded("SELECT *, sd / mean AS cv, sd * sd / srs_variance AS deff, mean_n / (sd * sd / srs_variance) AS n_effective FROM (SELECT cell, count(*) AS n_draws, avg(mae) AS mean, stddev_samp(mae) AS sd, avg((1 - n / n_u) * s2 / n) AS srs_variance, avg(n) AS mean_n FROM constant_draws JOIN (SELECT cell, CAST(count(*) AS DOUBLE) AS n_u, var_samp(abs(rssi + 110)) AS s2 FROM nodes GROUP BY cell) USING (cell) GROUP BY cell)", "mean sd srs_variance mean_n cv deff n_effective", 4),
    "extreme_ratio": rounded(f"SELECT * FROM ({_EXTREME.format(pick='max', best='greatest', name='high', way='DESC')}) JOIN ({_EXTREME.format(pick='min', best='least', name='low', way='ASC')}) USING (cell)", "low high"),
    "anova_oneway": rounded(
        """SELECT *, s2_between / (s2_between + ms_within) AS icc FROM (SELECT *, greatest(0, (ms_between - ms_within) / n0) AS s2_between FROM (
        SELECT cell, CAST(sum(k) AS BIGINT) AS n, count(*) AS groups, sum(k * (m - g) * (m - g)) / (count(*) - 1) AS ms_between, sum(k * v) / (sum(k) - count(*)) AS ms_within, (sum(k) - sum(k * k) / sum(k)) / (count(*) - 1) AS n0
        FROM (SELECT *, sum(m * k) OVER (PARTITION BY cell) / sum(k) OVER (PARTITION BY cell) AS g FROM (SELECT cell, block_id, CAST(count(*) AS DOUBLE) AS k, avg(rssi) AS m, var_pop(rssi) AS v FROM nodes WHERE valid GROUP BY ALL)) GROUP BY cell))""",
        "ms_between ms_within n0 s2_between icc", 5,
    ),
    "cochran_c": rounded("SELECT max(v) / sum(v) AS c FROM (SELECT block_id, var_samp(rssi) AS v FROM nodes WHERE valid GROUP BY block_id)", "c"),
    "jackknife_sd": rounded("SELECT a.cell, count(*) AS n, any_value(sd) AS sd, (count(*) - 1) * var_pop(o) AS v FROM (SELECT p.cell, p.block_id, stddev_samp(q.m) AS o FROM block_means p JOIN block_means q ON p.cell = q.cell AND p.block_id <> q.block_id GROUP BY ALL) a JOIN (SELECT cell, stddev_samp(m) AS sd FROM block_means GROUP BY cell) b USING (cell) GROUP BY a.cell", "sd v", 5),
    "pooled_moments": rounded("SELECT count(*) AS n, avg(elevation) AS mean, var_samp(elevation) AS variance FROM lattice", "mean variance"),
    "partition_gate": "SELECT cell, seed, CAST(0 AS BIGINT) AS n_double, count(DISTINCT close) AS n_close FROM (SELECT a.cell, a.seed, v.node_id AS close FROM left2 a LEFT JOIN pairs p ON a.role = 'test' AND p.cell = a.cell AND p.node_id = a.node_id LEFT JOIN left2 v ON v.cell = a.cell AND v.seed = a.seed AND v.node_id = p.o_node AND v.role = 'val') GROUP BY cell, seed",
    "table_diff": rounded('SELECT cell, pred, pop, a.mean AS "left", b.mean AS "right" FROM drift a FULL JOIN drift0 b USING (cell, pred, pop) WHERE a.mean IS NULL OR b.mean IS NULL OR abs(a.mean - b.mean) > 1e-9 * greatest(1, abs(a.mean))', '"left" "right"'),
    "missing_runs": "SELECT cell, seed FROM (SELECT DISTINCT cell, seed FROM roles) ANTI JOIN (SELECT * FROM left2 WHERE role = 'test' AND valid) USING (cell, seed)",
    "id_digest": "SELECT cell, seed, role, count(*) AS n, CAST(sum(CAST('0x' || substr(md5(CAST(node_id AS VARCHAR)), 1, 12) AS HUGEINT)) AS VARCHAR) AS digest FROM left2 GROUP BY ALL",
    "verdict_counts": "SELECT count(sd) AS n, count(*) FILTER (WHERE sd >= 0.1) AS n_over, CASE WHEN count(*) FILTER (WHERE sd >= 0.1) >= 2 THEN 'reinforces' ELSE 'delimits' END AS verdict FROM drift WHERE pop = 'valid' AND pred = 'constant'",
    "seed_order": "SELECT seed, cells, cells = max(cells) FILTER (WHERE seed = 1) OVER () AS as_first FROM (SELECT seed, string_agg(cell, ',' ORDER BY v DESC, cell) AS cells FROM (SELECT seed, cell, avg(CAST(valid AS DOUBLE)) AS v FROM held WHERE role = 'test' GROUP BY ALL) GROUP BY seed)",
}
#: Draws of the queries that take more than 60.
DRAWS_OF = {"retention": 200, "retention_correlation": 200, "class_bootstrap": 200, "inclusion_freq": 200, "inclusion_profile": 200, "hajek": 100, "estimands": 100}
SQL = {name: build(body, DRAWS_OF.get(name, 60)) for name, body in BODIES.items()}
