"""DuckDB SQL for the queries by resampling: the same hashes, so the same replicates."""

from __future__ import annotations

import math

from terrablock.functions.quantiles import CDF_B, CDF_P, PPF_A, PPF_B, PPF_C, PPF_D, PPF_TAIL
from terrablock.operators.resample import REPLICATES, TIE_DIGITS, WILD_REPLICATES
from terrablock.plans.oracle import DRAWS_OF, SQL, build, rounded
from terrablock.plans.reports_sql import _T, D
from terrablock.plans.resampling import INTERVALS, POWER, SEEDS, SHARE, SPREAD, TOLERANCE


def polynomial(x: str, terms: tuple[float, ...]) -> str:
    out = f"{terms[0]!r}{D}"
    for t in terms[1:]:
        out = f"({out} * {x} + {t!r}{D})"
    return out


def normal_cdf(x: str) -> str:
    t = f"(1 / (1 + {CDF_P}{D} * abs({x})))"
    upper = f"(exp(-({x}) * ({x}) / 2) / {math.sqrt(2 * math.pi)!r}{D} * {t} * {polynomial(t, CDF_B[::-1])})"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {upper} ELSE {upper} END)"


def normal_quantile(p: str) -> str:
    tail = lambda q: f"({polynomial(f'sqrt(-2 * ln({q}))', PPF_C)} / {polynomial(f'sqrt(-2 * ln({q}))', PPF_D)})"
    c = f"({p} - 0.5{D})"
    middle = f"({polynomial(f'({c} * {c})', PPF_A)} * {c} / {polynomial(f'({c} * {c})', PPF_B)})"
    return f"(CASE WHEN {p} < {PPF_TAIL}{D} THEN {tail(p)} WHEN {p} > 1 - {PPF_TAIL}{D} THEN -{tail(f'(1 - {p})')} ELSE {middle} END)"


def word(*parts: str, at: int = 0) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), {1 + 8 * at}, 8) AS BIGINT)"


def resampled(source: str, values: dict[str, str], seed: int, key: str = "cell", order: str = "seed", n: int = REPLICATES) -> str:
    """key, replicate and sums of values over draws of source taken with replacement."""
    listed = ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in values.items())
    return f"""(WITH numbered AS MATERIALIZED (SELECT {key}, {listed}, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS m_ FROM {source})
  SELECT {key}, replicate, {', '.join(f'sum({k}) AS {k}' for k in values)} FROM (SELECT {key}, replicate, ({word(f"'{seed}'", 'replicate', key, 'i')} * m_) >> 32 AS i FROM numbered, range({n}) r(replicate)) JOIN numbered USING ({key}, i) GROUP BY {key}, replicate)"""


def spread(boots: str, value: str, key: str = "cell") -> str:
    return f"(SELECT {key}, stddev_samp(v) AS se, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM (SELECT {key}, {value} AS v FROM {boots}) WHERE v IS NOT NULL GROUP BY {key})"


_WIDE = "(SELECT cell, seed, max(mae) FILTER (WHERE pred = 'constant') AS x, max(mae) FILTER (WHERE pred = 'fspl_a') AS y FROM per_draw WHERE pop = 'all' GROUP BY cell, seed)"
_CENTRED = f"(SELECT cell, seed, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM {_WIDE} WHERE x IS NOT NULL AND y IS NOT NULL WINDOW w AS (PARTITION BY cell))"
_SQUARE = f"greatest(round({{0}}{{0}} - {{0}} * {{0}} / m, {TIE_DIGITS}), 0)"
_WEIGHTED = """(SELECT cell, seed, (weighted - theta) ** 2 AS x, (plain - theta) ** 2 AS y FROM (SELECT l.cell, l.seed, sum(abs(l.rssi + 110) / i.p) / sum(1 / i.p) AS weighted, avg(abs(l.rssi + 110)) AS plain
  FROM left2 l JOIN included i ON i.cell = l.cell AND i.node_id = l.node_id WHERE l.role = 'test' AND i.p > 0 GROUP BY ALL) JOIN (SELECT cell, avg(abs(rssi + 110)) AS theta FROM nodes GROUP BY cell) USING (cell))"""
_SHARE = "(SELECT cell, seed, count(l.node_id) AS x, count(*) AS y FROM held h LEFT JOIN left2 l USING (cell, seed, node_id) WHERE h.role = 'test' GROUP BY ALL)"
_Z = normal_quantile("least(greatest(p, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE)")


def _end(p: float) -> str:
    z = f"(z0 + {normal_quantile(f'{p}{D}')})"
    return f"CASE WHEN n > 1 THEN quantile_at(b, {normal_cdf(f'(z0 + {z} / (1 - a * {z}))')}) ELSE mean END"


def _quantile_at(sql: str) -> str:
    """quantile_at(list, p) spelt out: DuckDB has no quantile of a list at a computed place."""
    out, at = "", sql.find("quantile_at(b, ")
    while at >= 0:
        depth, k = 1, at + len("quantile_at(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        p = sql[at + len("quantile_at(b, ") : k - 1]
        h = f"((len(b) - 1) * ({p}))"
        out += sql[:at] + f"(b[CAST(floor({h}) AS BIGINT) + 1] + ({h} - floor({h})) * (b[least(CAST(floor({h}) AS BIGINT) + 2, len(b))] - b[CAST(floor({h}) AS BIGINT) + 1]))"
        sql = sql[k:]
        at = sql.find("quantile_at(b, ")
    return out + sql


_MEAN = f"""SELECT cell, n, mean, low, high, {_end(0.025)} AS bca_low, {_end(0.975)} AS bca_high FROM (SELECT *, {_Z} AS z0 FROM (
  SELECT cell, n, mean, coalesce(d3 / nullif(6 * d2 ** 1.5::DOUBLE, 0), 0) AS a, list_sort(list(x / n)) AS b, quantile_cont(x / n, 0.025) AS low, quantile_cont(x / n, 0.975) AS high,
    avg(CASE WHEN round(x / n - mean, {TIE_DIGITS}) < 0 THEN 1 WHEN round(x / n - mean, {TIE_DIGITS}) = 0 THEN 0.5::DOUBLE ELSE 0 END) AS p
  FROM {resampled("all_draws", {"x": "mae"}, 20260932)} JOIN (SELECT cell, n, mean, sum(d * d) AS d2, sum(d * d * d) AS d3 FROM (SELECT cell, count(*) OVER w AS n, avg(mae) OVER w AS mean, (mae - avg(mae) OVER w) / greatest(count(*) OVER w - 1, 1) AS d FROM all_draws WINDOW w AS (PARTITION BY cell)) GROUP BY cell, n, mean) USING (cell) GROUP BY cell, n, mean, d2, d3))"""

_CASES = " UNION ALL ".join(f"SELECT {k} AS k, {a}{D} AS d_min, {b}{D} AS d_max" for k, (a, b) in enumerate(INTERVALS))
_LOSS = "20 * log10(greatest({d}, 0.001::DOUBLE)) + 20 * log10(900::DOUBLE) + 32.44::DOUBLE"
_U = f"({word('seed', 'seed * 5 + k', 'node_id')} + 0.5{D}) / 4294967296{D}"
_V = f"{word('seed', 'seed * 5 + k', 'node_id', at=1)} / 4294967296{D}"

BODIES = {
    "wild_bootstrap": rounded(
        f"""SELECT cell, seed, pred, pop, k, err, CASE WHEN k > 1 THEN v END AS v, CASE WHEN k > 1 THEN err + low END AS low, CASE WHEN k > 1 THEN err + high END AS high, err - t * sqrt(v) AS t_low, err + t * sqrt(v) AS t_high
        FROM (SELECT cell, seed, pred, pop, k, err, var_samp(d) AS v, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM (
          SELECT cell, seed, pred, pop, k, err, replicate, sum(sign * (s - err * m) / m_all) AS d FROM totals JOIN (
            SELECT cell, seed, block_id, w * 32 + c AS replicate, CASE WHEN substr(h, c + 1, 1) >= '8' THEN 1 ELSE -1 END AS sign FROM (SELECT cell, seed, block_id, w, md5(concat_ws('|', '20260929', w, cell, seed, block_id)) AS h FROM (SELECT DISTINCT cell, seed, block_id FROM sums), range({-(-WILD_REPLICATES // 32)}) r(w)), range(32) q(c) WHERE w * 32 + c < {WILD_REPLICATES}) USING (cell, seed, block_id)
          GROUP BY cell, seed, pred, pop, k, err, replicate) GROUP BY cell, seed, pred, pop, k, err) LEFT JOIN (VALUES {_T}) q(k, t) USING (k)""",
        "err v low high t_low t_high",
    ),
    "ratio_bootstrap": rounded(
        f"""SELECT cell, n, ratio, se, low, high FROM (SELECT cell, count(*) AS n, stddev_samp(x) / nullif(stddev_samp(y), 0) AS ratio FROM {_WIDE} WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY cell)
        JOIN {spread(resampled(_CENTRED, {"m": "1", "x": "x", "xx": "x * x", "y": "y", "yy": "y * y"}, 20260930), f"sqrt({_SQUARE.format('x')} / nullif({_SQUARE.format('y')}, 0))")} USING (cell) WHERE n > 1 AND ratio IS NOT NULL""",
        "ratio se low high",
    ),
    "rmse_ratio": rounded(
        f"SELECT cell, n, ratio, se, low, high FROM (SELECT cell, count(*) AS n, sqrt(sum(x) / nullif(sum(y), 0)) AS ratio FROM {_WEIGHTED} GROUP BY cell) JOIN {spread(resampled(_WEIGHTED, {'x': 'x', 'y': 'y'}, 20260933), 'sqrt(x / nullif(y, 0))')} USING (cell)",
        "ratio se low high", 5,
    ),
    "class_bootstrap": rounded(
        f"SELECT cell, n, ratio, se FROM (SELECT cell, count(*) AS n, sum(x) / nullif(CAST(sum(y) AS DOUBLE), 0) AS ratio FROM {_SHARE} GROUP BY cell) JOIN (SELECT cell, stddev_samp(coalesce(x / nullif(y, 0), 0)) AS se FROM {resampled(_SHARE, {'x': 'x', 'y': 'y'}, 20260931)} GROUP BY cell) USING (cell)",
        "ratio se",
    ),
    "mean_interval": rounded(_quantile_at(_MEAN), "mean low high bca_low bca_high"),
    "coincidence_rate": rounded(
        f"""SELECT seed, d_min, d_max, n, median, -110 + {_LOSS.format(d=f'(d_min + (d_max - d_min) / (2 * {SHARE}{D}))')} AS edge, abs(median - own) <= {TOLERANCE}{D} AS hit FROM (
        SELECT seed, d_min, d_max, count(*) AS n, median(CASE WHEN node_id < round({SHARE}{D} * total) THEN -110 + {_LOSS.format(d='(d_min + (d_max - d_min) * u)')} ELSE {POWER}{D} + {SPREAD}{D} * sqrt(-2 * ln(u)) * cos(v * {2 * math.pi!r}{D}) END) AS median
        FROM (SELECT seed, d_min, d_max, node_id, total, {_U} AS u, {_V} AS v FROM (SELECT node_id, count(*) OVER () AS total FROM nodes), range({SEEDS}) r(seed), ({_CASES})) GROUP BY seed, d_min, d_max), (SELECT median(rssi + fs) AS own FROM nodes)""",
        "median edge",
    ),
}
SQL |= {name: build(body, DRAWS_OF.get(name, 60)) for name, body in BODIES.items()}
