"""Decision criteria as a table: what must hold, in how many units, for which verdict.

A clause asks that a statistic lies between two bounds in at least quota of the units planned for it. Clauses of one rule
and branch hold together; the first branch that holds gives the verdict, else the rule's own. A rule that lacks the value
of any planned unit is PARTIAL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLAUSE_SQL = "rule string, branch int, verdict string, otherwise string, statistic string, low double, above boolean, high double, below boolean, quota double"


@dataclass(frozen=True)
class Clause:
    """low, high: the bounds (None: open), above, below: whether the bound itself is left out; quota: share of the planned units (0: any one)."""

    statistic: str
    low: float | None = None
    high: float | None = None
    quota: float = 1.0
    above: bool = False
    below: bool = False


@dataclass(frozen=True)
class Rule:
    """branches: verdict and its clauses, in the order in which they are tried."""

    name: str
    otherwise: str
    branches: tuple[tuple[str, tuple[Clause, ...]], ...]

    def rows(self) -> list[tuple]:
        return [(self.name, k, verdict, self.otherwise, c.statistic, c.low, c.above, c.high, c.below, c.quota) for k, (verdict, clauses) in enumerate(self.branches) for c in clauses]


def verdicts(statistics: DataFrame, planned: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """rule, verdict, branch (-1: none held), n_clauses, n_values, n_planned, partial of each rule.

    statistics: statistic, unit, value; planned: statistic, n_planned. A null value counts as missing. The clauses are a
    bounded table, so each statistic's rows are joined with a few clauses and folded by clause, branch and rule.
    """
    clauses = statistics.sparkSession.createDataFrame([r for rule in rules for r in rule.rows()], CLAUSE_SQL)
    v = F.col("value")
    over = F.col("low").isNull() | F.when(F.col("above"), v > F.col("low")).otherwise(v >= F.col("low"))
    under = F.col("high").isNull() | F.when(F.col("below"), v < F.col("high")).otherwise(v <= F.col("high"))
    keys = ["rule", "branch", "verdict", "otherwise", "statistic", "low", "high", "quota"]
    held = clauses.join(statistics.where("value IS NOT NULL"), "statistic", "left")
    per = held.groupBy(*keys).agg(F.count("value").alias("n"), F.count_if(over & under & v.isNotNull()).alias("hits")).join(planned, "statistic", "left").withColumn("n_planned", F.coalesce("n_planned", F.lit(0)))
    need = F.greatest(F.lit(1), F.ceil(F.col("quota") * F.col("n_planned")))
    per = per.select("*", (F.col("hits") >= need).alias("holds"), F.greatest(F.col("n_planned") - F.col("n"), F.lit(0)).alias("missing"))
    branch = per.groupBy("rule", "otherwise", "branch", "verdict").agg(F.min("holds").alias("holds"), F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("n_planned").alias("n_planned"), F.sum("missing").alias("missing"))
    first = F.min(F.when(F.col("holds"), F.struct("branch", "verdict")))
    rule = branch.groupBy("rule", "otherwise").agg(first.alias("f"), F.sum("k").alias("n_clauses"), F.sum("n").alias("n_values"), F.sum("n_planned").alias("n_planned"), (F.sum("missing") > 0).alias("partial"))
    verdict = F.when(F.col("partial"), F.lit("PARTIAL")).otherwise(F.coalesce("f.verdict", "otherwise"))
    return rule.select("rule", verdict.alias("verdict"), F.coalesce("f.branch", F.lit(-1)).alias("branch"), "n_clauses", "n_values", "n_planned", "partial")
