"""The criteria of the study: which statistics of which queries they read, and the rules."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrablock.operators.criteria import Clause, Rule, verdicts
from terrablock.plans.catalog import QUERIES, query, sharing


@dataclass(frozen=True)
class Statistic:
    """value (an aggregate) by unit over one query's rows, or two queries' joined on keys; each: units planned for a cell, 0: one in all.

    Expressions are SQL that both engines read.
    """

    name: str
    source: str
    value: str
    where: str = "true"
    unit: str = "cell"
    other: str = ""
    keys: tuple[str, ...] = ("cell",)
    other_where: str = "true"
    each: int = 1


CONSTANT = "pop = 'valid' AND pred = 'constant'"
STATISTICS = (
    Statistic("p_given_mean", "neighbour_class_profile", "sum(n * p_given) / sum(n)"),
    Statistic("class_delta", "neighbour_class_profile", "max(greatest(low - p_given, p_given - high, 0.0))", "m <= 2"),
    Statistic("draw_sd", "drift_constant", "max(sd)", CONSTANT),
    Statistic("ratio_gap", "weighted_estimands", "max(abs(ratio - theta))", other="bias_intervals", other_where="pop = 'all'"),
    Statistic("half_gap", "weighted_estimands", "max(abs(mean_error - theta - bias) - abs(bias) / 2)", other="bias_intervals", other_where="pop = 'all'"),
    Statistic("inversion_a", "inversions_by_calibration", "sum(n_inverted) / (1.0 * sum(n_draws))", "cell <> 'ALL' AND pop = 'valid' AND calibration = 'a'", "'all'", each=0),
    Statistic("inversion_b", "inversions_by_calibration", "sum(n_inverted) / (1.0 * sum(n_draws))", "cell <> 'ALL' AND pop = 'valid' AND calibration = 'b'", "'all'", each=0),
    Statistic("buffer_ratio", "drift_ratio", "max(ratio)", CONSTANT),
    Statistic("deff", "design_effect", "max(deff)"),
    Statistic("bias_over_se", "bias_intervals", "max(abs(bias) / mc_se)", "pop = 'all'"),
    Statistic("q", "variance_summary", "max(q)", CONSTANT),
    Statistic("coverage", "variance_summary", "max(coverage)", CONSTANT),
    Statistic("level_ratio", "level_spread", "max(ratio)", unit="concat(cell, pred)", each=3),
    Statistic("draw_seed", "draw_seed_ratio", "max(ratio)"),
    Statistic("whole_sd", "kfold_joint", "max(err_whole) - min(err_whole)"),
    Statistic("fold_sd", "kfold_joint", "stddev_samp(err)"),
    Statistic("fold_ratio", "kfold_joint", "stddev_samp(err) / max(sd)", other="drift_constant", other_where="pop = 'all' AND pred = 'constant'"),
    Statistic("rmse_ratio", "rmse_ratio", "max(ratio)"),
    Statistic("rmse_low", "rmse_ratio", "max(low)"),
    Statistic("against", "sign_changes", "1.0 * max(n_against)", "pop = 'valid'"),
    Statistic("over_floor", "campaign_table", "max(over_floor)", unit="concat(cell, pred)", each=2),
    Statistic("parity", "campaign_table", "max(n_parity) / (1.0 * max(n))"),
    Statistic("cv_median", "design_effect", "median(cv)", unit="'all'", each=0),
    Statistic("deff_median", "design_effect", "median(deff)", unit="'all'", each=0),
    Statistic("coverage_t", "t_intervals", "avg(CASE WHEN mean_err BETWEEN low AND high THEN 1.0 ELSE 0.0 END)", CONSTANT, other="variance_summary", keys=("cell", "pred", "pop")),
    Statistic("coverage_wild", "wild_bootstrap", "avg(CASE WHEN mean_err BETWEEN low AND high THEN 1.0 ELSE 0.0 END)", f"{CONSTANT} AND low IS NOT NULL", other="variance_summary", keys=("cell", "pred", "pop")),
    Statistic("ratio_low", "ratio_bootstrap", "max(low)"),
    Statistic("ratio_high", "ratio_bootstrap", "max(high)"),
    Statistic("unlike", "plan_status", "1.0 * sum(n_done - n_agree)"),
)

#: The published bounds. Quotas of so many of 16 or of 4 cells are shares of the cells here.
RULES = (
    Rule("1.6", "DELIMITS", (("REINFORCES", (Clause("p_given_mean", 0.449 * 0.995, 0.453 * 1.005), Clause("class_delta", None, 0.02, below=True))),)),
    Rule("2.1", "DELIMITS", (("REINFORCES", (Clause("draw_sd", 0.1, None, 0.5),)),)),
    Rule("2.3", "DELIMITS", (("REINFORCES", (Clause("ratio_gap", None, 0.05, 0.75), Clause("half_gap", None, 0.0, 0.75, below=True))),)),
    Rule("3.1", "NEITHER", (("UNDER_B", (Clause("inversion_b", 0.5),)), ("UNDER_A", (Clause("inversion_a", 0.5),)))),
    Rule("R1", "MIXED", (("REINFORCES", (Clause("buffer_ratio", 0.8, None, 0.75),)), ("DELIMITS", (Clause("buffer_ratio", None, 0.5, 0.75),)))),
    Rule("R2", "DELIMITS", (("REINFORCES", (Clause("deff", 10.0, None, 0.75), Clause("bias_over_se", None, 2.0, 0.75))),)),
    Rule("R2-bias", "BIASED", (("UNBIASED", (Clause("bias_over_se", None, 2.0, 0.75),)),)),
    Rule("R4", "DELIMITS", (("REINFORCES", (Clause("class_delta", None, 0.0),)),)),
    Rule("R5", "DELIMITS", (("REINFORCES", (Clause("q", 0.5, 2.0, 0.75), Clause("coverage", 0.8, None, 0.75))), ("CONTRADICTS", (Clause("coverage", None, 0.6, 0.5, below=True),)))),
    Rule("R6", "MIXED", (("REINFORCES", (Clause("level_ratio", 2.0),)), ("DELIMITS", (Clause("level_ratio", None, 1.5, 0.0, below=True),)))),
    Rule("R7", "DELIMITS", (("REINFORCES", (Clause("draw_seed", 2.0, None, 0.75),)),)),
    Rule("E1-control", "BROKEN", (("HOLDS", (Clause("whole_sd", 0.0, 0.0),)),)),
    Rule("E1", "DELIMITS", (("REINFORCES", (Clause("whole_sd", 0.0, 0.0), Clause("fold_ratio", None, 1.0, 0.75, below=True), Clause("fold_sd", None, 2.0, 0.75, below=True))),)),
    Rule("E4", "MIXED", (("BETTER", (Clause("rmse_ratio", None, 0.9, 0.75, below=True),)), ("EQUAL", (Clause("rmse_ratio", 0.9, 1.1, 0.75),)), ("WORSE", (Clause("rmse_ratio", 1.1, None, 0.75, above=True),)))),
    Rule("E6", "STABLE", (("UNSTABLE", (Clause("against", 0.0, None, 0.0, above=True),)),)),
    Rule("G1", "MIXED", (("REINFORCES", (Clause("over_floor", 3.0, None, 0.75), Clause("draw_seed", 1.0, None, 0.75))), ("DELIMITS", (Clause("over_floor", None, 2.0, 0.75, below=True),)))),
    Rule("G2", "NEITHER", (("A", (Clause("cv_median", 0.05),)), ("B_ALONE", (Clause("deff_median", 10.0),)))),
    Rule("V1", "DELIMITS", (("REINFORCES", (Clause("coverage_t", 0.9, None, 0.75),)), ("REINFORCES", (Clause("coverage_wild", 0.9, None, 0.75),)), ("CONTRADICTS", (Clause("coverage_t", None, 0.8, 0.5, below=True), Clause("coverage_wild", None, 0.8, 0.5, below=True))))),
    Rule("V2", "OPEN", (("GREATER", (Clause("ratio_low", 1.0, None, 0.75, above=True),)), ("LESS", (Clause("ratio_high", None, 1.0, 0.75, below=True),)))),
    Rule("V2-bis", "OPEN", (("GREATER", (Clause("rmse_low", 1.0, None, 0.75, above=True),)),)),
    Rule("A2c", "DIFFERS", (("REPEATS", (Clause("unlike", None, 1e-3),)),)),
    Rule("A3", "NO_PARITY", (("PARITY", (Clause("parity", 0.5, None, 0.5),)),)),
)


@query
def level_spread(spark, sf_dir):
    """Spread over draws of the whole population's error against that of the valid nodes, by cell and predictor."""
    d = QUERIES["drift_constant"](spark, sf_dir)
    of = lambda p: F.max(F.when(F.col("pop") == p, F.col("sd")))
    return d.groupBy("cell", "pred").agg(F.round(F.try_divide(of("all"), of("valid")), 6).alias("ratio"))


def statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """statistic, unit, value of every statistic. tables: the queries' rows by name, a few hundred each."""
    found = []
    for s in STATISTICS:
        rows = tables[s.source].where(s.where)
        if s.other:
            clash = [c for c in tables[s.other].columns if c in rows.columns and c not in s.keys]
            rows = rows.join(tables[s.other].where(s.other_where).drop(*clash), list(s.keys))
        found.append(rows.groupBy(F.expr(s.unit).alias("unit")).agg(F.expr(s.value).cast("double").alias("value")).select(F.lit(s.name).alias("statistic"), "unit", F.round("value", 6).alias("value")))
    return reduce(DataFrame.unionByName, found)


@query
def criteria_verdicts(spark, sf_dir):
    """The verdict of each criterion on the tables of the study's queries."""
    names = {n for s in STATISTICS for n in (s.source, s.other) if n}
    with sharing():
        tables = {n: QUERIES[n](spark, sf_dir) for n in sorted(names)}
    cells = QUERIES["block_table"](spark, sf_dir).select("cell").distinct().count()
    planned = spark.createDataFrame([(s.name, s.each * cells or 1) for s in STATISTICS], "statistic string, n_planned long")
    return verdicts(statistics(tables), planned, RULES)
