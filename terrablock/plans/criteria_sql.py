"""DuckDB SQL for the criteria: the queries' SQL bodies as parts of one statement."""

from __future__ import annotations

from terrablock.plans import oracle, reports_sql, resampling_sql
from terrablock.plans.criteria import RULES, STATISTICS
from terrablock.plans.oracle import SQL, build

_LEVEL = f"SELECT cell, pred, round(max(sd) FILTER (WHERE pop = 'all') / nullif(max(sd) FILTER (WHERE pop = 'valid'), 0), 6) AS ratio FROM ({oracle.BODIES['drift_constant']}) GROUP BY cell, pred"
_BODIES = oracle.BODIES | reports_sql.BODIES | resampling_sql.BODIES | {"level_spread": _LEVEL}


def _value(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else repr(x)


def _statistic(s) -> str:
    rows = f"(SELECT * FROM t_{s.source} WHERE {s.where})"
    if s.other:
        rows = f"{rows} a_ JOIN (SELECT {{columns}} FROM t_{s.other} WHERE {s.other_where}) b_ USING ({', '.join(s.keys)})"
        rows = rows.format(columns={"bias_intervals": "cell, theta, bias", "drift_constant": "cell, sd", "variance_summary": "cell, pred, pop, mean_err"}[s.other])
    return f"SELECT '{s.name}' AS statistic, {s.unit} AS unit, round(CAST({s.value} AS DOUBLE), 6) AS value FROM {rows} GROUP BY {s.unit}" if s.unit != "'all'" else f"SELECT '{s.name}' AS statistic, 'all' AS unit, round(CAST({s.value} AS DOUBLE), 6) AS value FROM {rows}"


def _criteria() -> str:
    """One statement: the queries' rows are named once each, then clauses are folded by branch and rule."""
    names = sorted({n for s in STATISTICS for n in (s.source, s.other) if n})
    tables = ", ".join(f"t_{n} AS MATERIALIZED ({_BODIES[n]})" for n in names)
    clauses = ", ".join("(" + ", ".join(_value(x) for x in row) + ")" for rule in RULES for row in rule.rows())
    planned = ", ".join(f"('{s.name}', {s.each})" for s in STATISTICS)
    return f"""SELECT rule, CASE WHEN partial THEN 'PARTIAL' ELSE coalesce(v, otherwise) END AS verdict, coalesce(b, -1) AS branch, n_clauses, n_values, n_planned, partial FROM (
  WITH {tables}, stats AS ({' UNION ALL '.join(map(_statistic, STATISTICS))}),
  clauses(rule, branch, verdict, otherwise, statistic, low, above, high, below, quota) AS (VALUES {clauses}),
  planned AS (SELECT statistic, CASE WHEN each = 0 THEN 1 ELSE each * (SELECT count(DISTINCT cell) FROM blocks) END AS n_planned FROM (VALUES {planned}) q(statistic, each)),
  folded AS (SELECT c.rule, c.branch, c.verdict, c.otherwise, c.statistic, c.low, c.high, c.quota, count(value) AS n,
    count(*) FILTER (WHERE value IS NOT NULL AND (low IS NULL OR value > low OR (value = low AND NOT above)) AND (high IS NULL OR value < high OR (value = high AND NOT below))) AS hits FROM clauses c LEFT JOIN stats USING (statistic) GROUP BY ALL),
  held AS (SELECT *, hits >= greatest(1, ceil(CAST(quota AS DOUBLE) * n_planned)) AS holds, greatest(n_planned - n, 0) AS missing FROM folded JOIN planned USING (statistic)),
  branches AS (SELECT rule, otherwise, branch, verdict, bool_and(holds) AS holds, count(*) AS k, sum(n) AS n, sum(n_planned) AS n_planned, sum(missing) AS missing FROM held GROUP BY ALL)
  SELECT rule, otherwise, arg_min(verdict, branch) FILTER (WHERE holds) AS v, min(branch) FILTER (WHERE holds) AS b, CAST(sum(k) AS BIGINT) AS n_clauses, CAST(sum(n) AS BIGINT) AS n_values, CAST(sum(n_planned) AS BIGINT) AS n_planned, sum(missing) > 0 AS partial FROM branches GROUP BY rule, otherwise)"""


SQL |= {"level_spread": build(_LEVEL), "criteria_verdicts": build(_criteria())}
