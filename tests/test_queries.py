"""Every query with SQL against DuckDB on the smallest tables; propagation values; sources and sinks; streaming."""

import json
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrablock.functions import propagation as prop
from terrablock.functions import canonical, quantiles
from terrablock.functions.quantiles import t_quantile
from terrablock.functions.storage import saved
from terrablock.operators import design, errors, gates, graph, proximity, ranks, resample
from terrablock.plans import catalog, criteria, reports, resampling
from terrablock.plans.criteria_sql import _BODIES  # noqa: F401  (adds to SQL)
from terrablock.plans.catalog import QUERIES
from terrablock.plans.oracle import SQL
from terrablock.plans.reports_sql import T_975
from terrablock.plans.resampling_sql import BODIES as _RESAMPLING_SQL  # noqa: F401  (adds to SQL)
from terrablock.sources import readers, runner
from terrablock.streaming import block_sums

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("orders", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def shared_study():
    """The queries build their nodes, roles and retained nodes once for all tests of this module, and save what they share."""
    made = {}

    class Shared(catalog.Study):
        def once(self, name):
            if name not in self.__dict__.setdefault("kept", {}):
                self.kept[name] = saved(getattr(super(), name)())
            return self.kept[name]

    for name in ("near", "left", "fitted", "per_draw", "sums"):
        setattr(Shared, name, lambda self, name=name: self.once(name))

    def study(spark, sf_dir, b=catalog.B, draws=catalog.DRAWS):
        key = (sf_dir, b, draws if isinstance(draws, int) else tuple(draws))
        if key not in made:
            made[key] = Shared(spark, sf_dir, b, draws)
        return made[key]

    whole = catalog.Study
    catalog.Study = reports.Study = resampling.Study = study
    yield
    catalog.Study = reports.Study = resampling.Study = whole


def table(frame: pd.DataFrame) -> list[tuple]:
    def plain(x):
        return None if x is None or x != x else round(float(x), 6) + 0.0 if isinstance(x, (int, float)) else str(x)

    return sorted((tuple(plain(x.item() if hasattr(x, "item") else x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert table(QUERIES[name](spark, SF).toPandas()) == table(duck.execute(SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_repeats(spark, name):
    first, again = (table(QUERIES[name](spark, SF).toPandas()) for _ in range(2))
    assert first and first == again


def test_t_quantiles():
    assert [round(t_quantile(0.975, k + 1), 6) for k in range(len(T_975))] == list(T_975)


def test_bootstraps(spark):
    """Against what the resampled numbers must be: normal intervals of many rows, no spread of equal ones, the exact jackknife."""
    rng = np.random.default_rng(1)
    x = rng.normal(10, 2, 400)
    rows = spark.createDataFrame([("A", float(v), float(2 * v), i) for i, v in enumerate(x)] + [("B", 3.0, 1.5, i) for i in range(20)] + [("C", 5.0, 2.0, 0)], "cell string, x double, y double, i int")
    m = {r.cell: r for r in resample.mean_intervals(rows, ["cell"], ["i"], "x").collect()}
    se = x.std(ddof=1) / 20
    assert m["A"].low == pytest.approx(x.mean() - 1.96 * se, abs=0.1 * se) and m["A"].bca_high == pytest.approx(x.mean() + 1.96 * se, abs=0.15 * se)
    assert m["B"].low == m["B"].high == m["B"].mean == 3 and m["C"].bca_low == m["C"].mean == 5
    r = {r.cell: r for r in resample.ratio_of_sums(rows, ["cell"], ["i"], "x", "y").collect()}
    assert r["A"].ratio == pytest.approx(0.5) and r["A"].se == pytest.approx(0, abs=1e-9) and r["B"].ratio == 2
    sd = {r.cell: r for r in resample.ratio_bootstrap(rows, ["cell"], ["i"], "y", "x").collect()}
    assert sd["A"].ratio == pytest.approx(2) and sd["A"].low == pytest.approx(2) and "B" not in sd
    rmse = resample.rmse_ratio(rows.withColumn("mu", F.lit(10.0)).withColumn("z", (F.col("x") - 10) * 3 + 10), ["cell"], ["i"], "z", "x", "mu").where("cell = 'A'").first()
    assert rmse.ratio == pytest.approx(3) and rmse.low == pytest.approx(3) and rmse.high == pytest.approx(3)
    sums = spark.createDataFrame([("A", 1, "p", "all", k, float(s), m) for k, (s, m) in enumerate([(10.0, 5), (12.0, 4), (30.0, 9), (4.0, 3), (18.0, 7)])] + [("A", 2, "p", "all", 1, 6.0, 3)], "cell string, seed long, pred string, pop string, block_id long, s double, m long")
    t = spark.createDataFrame([(5, 2.776445)], "k long, t double")
    wild = {r.seed: r for r in resample.wild_bootstrap(sums, t).collect()}
    resid = np.array([10.0, 12, 30, 4, 18]) - 74 / 28 * np.array([5, 4, 9, 3, 7])
    assert wild[1].err == pytest.approx(74 / 28) and wild[1].v == pytest.approx((resid**2).sum() / 28**2, rel=0.1) and wild[1].low < wild[1].err < wild[1].high and wild[1].t_high == pytest.approx(wild[1].err + 2.776445 * wild[1].v ** 0.5)
    assert wild[2].err == 2 and wild[2].v is None and wild[2].low is None


def test_resampled_sums_are_multinomial(spark):
    """A replicate takes as many draws as there are, each equally often on average, and the same on every run."""
    rows = saved(spark.createDataFrame([("A", k, 1.0 if k == 3 else 0.0) for k in range(8)], "cell string, i int, x double"))
    boots = resample.resampled_sums(rows, ["cell"], ["i"], {"m": F.lit(1), "x": F.col("x")}, 5).toPandas()
    assert len(boots) == resample.REPLICATES and (boots.m == 8).all()
    assert boots.x.mean() == pytest.approx(1, abs=0.05) and boots.x.var() == pytest.approx(7 / 8, abs=0.1)
    again = resample.resampled_sums(rows, ["cell"], ["i"], {"m": F.lit(1), "x": F.col("x")}, 5).toPandas()
    assert boots.sort_values("replicate").x.tolist() == again.sort_values("replicate").x.tolist()


def test_normal_quantiles(spark):
    from statistics import NormalDist

    p = [1e-9, 0.001, 0.02, 0.025, 0.3, 0.5, 0.77, 0.975, 0.99, 1 - 1e-6]
    rows = spark.createDataFrame([(v,) for v in p], "p double").select("p", quantiles.normal_quantile(F.col("p")).alias("z")).withColumn("back", quantiles.normal_cdf(F.col("z"))).collect()
    assert all(r.z == pytest.approx(NormalDist().inv_cdf(r.p), abs=1e-7) and r.back == pytest.approx(r.p, abs=1e-7) for r in rows)
    cut = spark.createDataFrame([([1.0, 2.0, 4.0, 8.0],)], "v array<double>").select(*(quantiles.sorted_quantile(F.col("v"), F.lit(q)).alias(f"q{i}") for i, q in enumerate((0.0, 0.5, 0.9, 1.0)))).first()
    assert [round(x, 9) for x in cut] == [1.0, 3.0, 6.8, 8.0]


# Published quantiles of F at 0.975 for (d1, d2), to four decimals.
F_975 = {(1, 10): 6.9367, (2, 5): 8.4336, (5, 20): 3.2891, (10, 10): 3.7168, (20, 60): 1.9445, (3, 120): 3.2269, (30, 5): 6.2269}


def test_f_quantiles(spark):
    rows = spark.createDataFrame(list(F_975), "d1 int, d2 int").select("*", quantiles.f_quantile(0.975, F.col("d1"), F.col("d2")).alias("high"), quantiles.f_quantile(0.025, F.col("d2"), F.col("d1")).alias("low")).collect()
    for r in rows:
        assert r.high == pytest.approx(F_975[r.d1, r.d2], abs=6e-5) and r.low == pytest.approx(1 / r.high, rel=1e-9)
    big = spark.createDataFrame([(32, 3_000_000)], "d1 int, d2 int").select(quantiles.f_quantile(0.975, F.col("d1"), F.col("d2")).alias("f")).first().f
    assert big == pytest.approx(49.480438 / 32, rel=1e-4)  # chi-square of 32 over 32
    share = spark.range(1).select(quantiles.beta_share(F.lit(0.3), F.lit(2.0), F.lit(3.0)).alias("s"), quantiles.beta_share(F.lit(0.9), F.lit(2.0), F.lit(3.0)).alias("t"), quantiles.log_gamma(F.lit(0.5)).alias("g")).first()
    assert share.s == pytest.approx(0.3483) and share.t == pytest.approx(0.9963) and share.g == pytest.approx(math.lgamma(0.5), rel=1e-12)


def test_binomial_tail(spark):
    exact = lambda n, k, p: math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))
    cases = [(10, 0, 0.5), (10, 3, 0.3), (10, 9, 0.3), (10, 10, 0.3), (60, 41, 0.5), (5000, 2400, 0.5), (5000, 2600, 0.5), (4000, 1, 0.001)]
    rows = spark.createDataFrame(cases, "n long, k long, p double").select("n", "k", "p", design.binomial_tail(F.col("n"), F.col("k"), F.col("p")).alias("t")).collect()
    assert all(r.t == pytest.approx(exact(r.n, r.k, r.p), rel=1e-8) for r in rows)


def test_canonical_records(spark):
    """One digest for any order of fields and map entries; masks, dropped fields, odd numbers, quotes, nulls; differing leaves."""
    one = spark.sql("""SELECT 1 AS id, named_struct('b', 2.5D, 'a', array(named_struct('y', 1, 'x', 'q"\\\\ /home/me/z'), null)) AS s, map('k', 1.0D, 'j', double('nan')) AS m, -0.0D AS z, true AS t, cast(null AS int) AS n""")
    two = spark.sql("""SELECT true AS t, 0.0D AS z, map('j', double('nan'), 'k', 1.0D) AS m, cast(null AS int) AS n, named_struct('a', array(named_struct('x', 'q"\\\\ /home/you/z', 'y', 1), null), 'b', 2.5D) AS s, 1 AS id""")
    mask = {"masks": {r"/home/[^/ ]+": "/home/$user"}}
    a, b = (canonical.canonical_rows(x, **mask).first() for x in (one, two))
    assert a.text == b.text and a.digest == b.digest
    assert a.text == '{"id":1,"m":{"j":nan,"k":1.000000000e+00},"n":null,"s":{"a":[{"x":"q\\"\\\\\\\\ /home/$user/z","y":1},null],"b":2.500000000e+00},"t":true,"z":0.000000000e+00}'.replace("\\\\\\\\", "\\\\")
    assert canonical.canonical_rows(one).first().digest != canonical.canonical_rows(two).first().digest
    less = [canonical.canonical_rows(x, drop=frozenset({"s.a.x", "m"})).first().digest for x in (one, two)]
    assert less[0] == less[1]
    diff = {r.path: (r.left, r.right) for r in canonical.leaf_diff(one, two.withColumn("z", F.lit(1.0)).drop("t"), ["id"]).collect()}
    assert set(diff) == {"s.a[0].x", "z", "t"} and diff["z"] == ("0.000000000e+00", "1.000000000e+00") and diff["t"] == ("true", None)


def test_a_killed_batch_goes_on(spark, tmp_path):
    """Killed in the second batch: what was published stays, the cell in hand is computed again, nothing is computed twice."""
    planned = spark.createDataFrame([(c,) for c in "ABCDE"], "cell string")
    rows = spark.createDataFrame([(c, i, float(i)) for c in "ABCD" for i in range(3)], "cell string, i int, v double")
    asked, path = [], str(tmp_path / "run")

    def compute(cells, dies=()):
        names = [r.cell for r in cells.collect()]
        asked.append(names)
        if set(names) & set(dies):
            raise RuntimeError("killed")
        return rows.join(cells, "cell", "left_semi")

    with pytest.raises(RuntimeError):
        runner.run_cells(spark, planned, lambda c: compute(c, "C"), path, batch=2)
    assert {r.cell for r in runner.finished(spark, path).collect()} == {"A", "B"} and runner.completeness(planned, runner.finished(spark, path)).first().label == "PARTIAL"
    assert {r.cell: r.state for r in runner.audit(spark, planned, path, rows.schema).collect()} == {"A": "finished", "B": "finished", "C": "open", "D": "open", "E": "open"}
    readers.write_cells(rows.where("cell = 'C' AND i = 0"), f"{path}/data")  # half a cell without a status: as killed between the two tables
    status = {r.cell: r for r in runner.run_cells(spark, planned, compute, path, batch=2).collect()}
    assert asked == [["A", "B"], ["C", "D"], ["C", "D"], ["E"]] and {c: r.n for c, r in status.items()} == {"A": 3, "B": 3, "C": 3, "D": 3, "E": 0}
    assert runner.completeness(planned, runner.finished(spark, path)).first().asDict() == {"n_planned": 5, "n_finished": 5, "n_rows": 12, "label": "COMPLETE"}
    readers.write_cells(rows.where("cell = 'B'").withColumn("v", F.col("v") + 1), f"{path}/data")
    assert {r.cell for r in runner.audit(spark, planned, path, rows.schema).where("state = 'changed'").collect()} == {"B"}
    assert runner.run_cells(spark, planned, compute, path).count() == 5 and len(asked) == 4


def test_component_intervals(spark):
    rng = np.random.default_rng(6)
    rows = [("A", g, float(v)) for g in range(12) for v in rng.normal(rng.normal(0, 2), 1, 9)] + [("B", 0, 1.0), ("B", 0, 2.0), ("C", 0, 1.0), ("C", 1, 1.0), ("C", 1, 1.0)]
    layout = design.one_way(spark.createDataFrame(rows, "cell string, block int, v double"), ["cell"], "block", "v")
    out = {r.cell: r for r in design.component_intervals(layout, ["cell"]).collect()}
    assert set(out) == {"A"} and (out["A"].d1, out["A"].d2) == (11, 96)
    assert out["A"].theta_low < out["A"].theta < out["A"].theta_high and out["A"].theta_low == pytest.approx((out["A"].f / out["A"].f_high - 1) / 9) and 0 < out["A"].icc_low < out["A"].icc_high < 1


def test_tied_ranks(spark):
    """Against ranks by hand: ties, one value for most rows, nulls, negative numbers, keys of one row."""
    rng = np.random.default_rng(4)
    data = [("A", i, int(v), int(w)) for i, (v, w) in enumerate(zip(rng.integers(-3, 3, 400), np.where(rng.random(400) < 0.6, 7, rng.integers(0, 50, 400)), strict=True))] + [("B", 0, 1, 1), ("C", 1, 2, None), ("C", 2, 5, 1), ("C", 3, 5, 4)]
    rows = spark.createDataFrame(data, "k string, i int, x int, y int").repartition(5)
    got = {(r.k, r.i): r for r in ranks.ranked(rows, ["k"], "y", "i").collect()}
    assert len(got) == len(data) and (got["C", 1].o_y, got["C", 1].r_y) == (1, 1.0)
    frame = pd.DataFrame(data, columns=["k", "i", "x", "y"])
    for k, own in frame.dropna().groupby("k"):
        if k != "C":
            want = own.sort_values(["y", "i"]).assign(o=range(1, len(own) + 1))
            want["r"] = want.groupby("y").o.transform("mean")
            assert all((got[k, r.i].o_y, got[k, r.i].r_y) == (r.o, r.r) for r in want.itertuples())
    rho = {r.k: r for r in ranks.spearman_tied(rows, ["k"], "x", "y", "i").collect()}
    a = frame[frame.k == "A"]
    assert rho["A"].rho == pytest.approx(a.x.rank().corr(a.y.rank())) and rho["A"].n == 400 and rho["B"].rho is None and rho["C"].n == 2


def test_criteria(spark):
    """Bounds with and without their own value, quotas, order of branches, missing units."""
    from terrablock.operators.criteria import Clause, Rule, verdicts

    values = {"a": [1.0, 2.0, 3.0, 4.0], "b": [0.5, None], "c": [7.0]}
    rows = spark.createDataFrame([(s, f"u{k}", v) for s, vs in values.items() for k, v in enumerate(vs)], "statistic string, unit string, value double")
    planned = spark.createDataFrame([("a", 4), ("b", 2), ("c", 1), ("d", 3)], "statistic string, n_planned long")
    rules = (
        Rule("half", "NO", (("YES", (Clause("a", 3.0, None, 0.5),)),)),
        Rule("strict", "NO", (("YES", (Clause("a", 3.0, None, 0.5, above=True),)),)),
        Rule("both", "NO", (("YES", (Clause("a", 1.0, 4.0), Clause("c", None, 7.0))),)),
        Rule("below", "NO", (("YES", (Clause("a", 1.0, 4.0, below=True),)),)),
        Rule("second", "NO", (("FIRST", (Clause("c", 8.0),)), ("SECOND", (Clause("c", 7.0),)), ("THIRD", (Clause("c", 6.0),)))),
        Rule("any", "NO", (("YES", (Clause("a", 4.0, None, 0.0),)),)),
        Rule("none", "NO", (("YES", (Clause("a", 5.0, None, 0.0),)),)),
        Rule("gap", "NO", (("YES", (Clause("b", 0.0, None, 0.5),)),)),
        Rule("absent", "NO", (("YES", (Clause("d", 0.0),)),)),
    )
    got = {r.rule: (r.verdict, r.branch, r.partial) for r in verdicts(rows, planned, rules).collect()}
    assert got == {
        "half": ("YES", 0, False), "strict": ("NO", -1, False), "both": ("YES", 0, False), "below": ("NO", -1, False), "second": ("SECOND", 1, False),
        "any": ("YES", 0, False), "none": ("NO", -1, False), "gap": ("PARTIAL", 0, True), "absent": ("PARTIAL", -1, True),
    }
    assert len(criteria.RULES) == 22 and {c.statistic for r in criteria.RULES for _, b in r.branches for c in b} <= {s.name for s in criteria.STATISTICS}


def test_simulated_medians(spark):
    """Against the population drawn in NumPy from the same hashes."""
    import hashlib

    cases = spark.createDataFrame([(0, 7, 1.0, 140.0), (1, 8, 5.0, 20.0)], "case int, seed int, d_min double, d_max double")
    got = {r.case: r for r in resample.simulated_medians(spark.range(501).withColumnRenamed("id", "i"), 501, cases, 0.8, -110.0, 43.0, 10.0, lambda d: 20 * F.log10(d)).collect()}
    for case, seed, a, b in ((0, 7, 1.0, 140.0), (1, 8, 5.0, 20.0)):
        w = []
        for i in range(501):
            h = hashlib.md5(f"{seed}|{case}|{i}".encode()).hexdigest()
            u, v = (int(h[:8], 16) + 0.5) / 2**32, int(h[8:16], 16) / 2**32
            w.append(-110 + 20 * math.log10(a + (b - a) * u) if i < 401 else 43 + 10 * math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v))
        assert got[case].total == 501 and got[case].median == pytest.approx(np.median(w))


def test_quantiles_by_histogram(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(0, 3, 501), 1)
    rows = spark.createDataFrame([("A", float(v)) for v in x] + [("B", 4.0), ("C", None)], "k string, v double")
    at = 0.9 * (F.col("total") - 1)
    got = {r.k: r for r in errors.order_statistics(rows, ["k"], F.col("v"), {"low": F.floor(at), "high": F.ceil(at), "first": F.lit(0)}).collect()}
    s = np.sort(x)
    assert (got["A"].low, got["A"].high, got["A"].first, got["A"].total) == (s[450], s[450], s[0], 501) and got["B"].low == got["B"].high == 4 and "C" not in got
    assert errors.error_measures(rows, ["k"], F.col("v")).where("k = 'A'").first().p90 == pytest.approx(np.percentile(np.abs(x), 90))


def test_prediction_shape(spark):
    rng = np.random.default_rng(9)
    frame = pd.DataFrame({"rssi": rng.normal(-90, 8, 700), "dist_m": rng.uniform(0, 30000, 700), "elevation": rng.normal(size=700), "slope": rng.random(700), "ndvi": rng.random(700)})
    frame["p"] = frame.rssi + rng.normal(1, 3, 700)
    got = {r.metric: r.value for r in errors.prediction_shape(spark.createDataFrame(frame), "rssi", "p", 55 - F.col("p"), F.lit(120.0)).collect()}
    e = (frame.p - frame.rssi).abs()
    for q in (10, 25, 75, 90):
        assert got[f"pred_p{q}"] == pytest.approx(np.percentile(frame.p, q))
    for ring, low, high in (("near", 0, 5000), ("middle", 5000, 15000), ("far", 15000, 1e9)):
        assert got[f"p90_{ring}"] == pytest.approx(np.percentile(e[(frame.dist_m >= low) & (frame.dist_m < high)], 90))
    assert got["fidelity"] == pytest.approx(frame.p.std() / frame.rssi.std()) and got["corr_slope_error"] == pytest.approx(frame.slope.corr(e)) and got["distance_gradient"] == pytest.approx(frame.p.corr(-frame.dist_m))
    assert got["coverage_spread"] == pytest.approx(100 * ((frame.p > -85).mean() - (frame.p > -95).mean())) and got["fspl_compliance"] == pytest.approx((55 - frame.p >= 120).mean()) and len(got) == 21


def test_nearest_distance(spark):
    rng = np.random.default_rng(3)
    a, b = rng.uniform(0, 50, (60, 2)), np.concatenate([rng.uniform(0, 5, (200, 2)), [[49.0, 1.0]]])
    rows, others = (spark.createDataFrame([("A", i, float(x), float(y)) for i, (x, y) in enumerate(p)], "cell string, node_id long, x_km double, y_km double") for p in (a, b))
    got = {r.node_id: r.d_km for r in proximity.nearest_distance(rows, others, ["cell"]).collect()}
    want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)).min(axis=1)
    assert all(got[i] == pytest.approx(want[i]) for i in range(60))
    assert [r.d_km for r in proximity.nearest_distance(rows.limit(1), others.where("cell = 'B'"), ["cell"]).collect()] == [None]


@pytest.mark.parametrize("spread", [0.3, 25.0, 180.0])
def test_nearest_on_the_sphere(spark, spread):
    """Against all pairs: about the date line, at the poles, sites close together and on the other side, ties, equal places."""
    rng = np.random.default_rng(8)
    lon = np.append(rng.uniform(180 - spread, 180 + spread, 120) % 360 - 180, [0.0, 90.0, 179.99, -179.99, 10.0])
    lat = np.append(rng.uniform(-90, 90, 60) if spread > 100 else rng.uniform(88, 90, 60), rng.uniform(-2, 2, 60))
    lat = np.append(lat, [90.0, -90.0, 0.0, 0.0, 50.0])
    slon, slat = rng.permutation(lon)[:40] + rng.normal(0, 0.2, 40), np.clip(rng.permutation(lat)[:40] + rng.normal(0, 0.2, 40), -90, 90)
    slon, slat = np.append(slon, [slon[0], 0.0, 0.0]), np.append(slat, [slat[0], 89.9, 89.9])
    nodes = spark.createDataFrame([("A", i, float(a), float(b)) for i, (a, b) in enumerate(zip(lon, lat, strict=True))], "cell string, node_id long, lon double, lat double")
    sites = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(slon, slat, strict=True))], "site_id long, slon double, slat double")
    got = {r.node_id: r for r in proximity.nearest_on_sphere(nodes, sites, ["cell", "node_id"]).collect()}
    a, b, c, d = np.radians(lon)[:, None], np.radians(lat)[:, None], np.radians(slon), np.radians(slat)
    m = np.round(2 * 6_371_000 * np.arcsin(np.sqrt(np.minimum(1, np.sin((d - b) / 2) ** 2 + np.cos(b) * np.cos(d) * np.sin((c - a) / 2) ** 2))), 3)
    assert len(got) == len(lon) and all(got[i].dist_m == pytest.approx(m[i].min(), abs=0.002) and m[i][got[i].site_id] <= m[i].min() + 0.002 for i in range(len(lon)))
    assert {r.site_id for r in proximity.nearest_on_sphere(nodes, sites.limit(0), ["cell", "node_id"]).collect()} == {None}


def test_ids_repeat_between_cells(spark):
    """node_id is a place inside a cell: equal ids of two cells must not meet."""
    rows = spark.createDataFrame([(c, i, float(x), 0.0) for c, shift in (("A", 0), ("B", 40)) for i, x in enumerate((shift, shift + 1))], "cell string, node_id long, x_km double, y_km double")
    sites = spark.createDataFrame([(k, 10.0 * k, 0.0, 900.0) for k in range(6)], "site_id long, sx double, sy double, freq double")
    direct, binned = (proximity.nearest_site(rows, sites, most=most).select("cell", "node_id", "site_id", "dist_m").collect() for most in (100, 1))
    assert sorted(direct) == sorted(binned) and {(r.cell, r.site_id) for r in direct} == {("A", 0), ("B", 4)}
    assert {(r.cell, r.node_id, r.site_id) for r in graph.best_antenna(rows, sites, 30.0, -F.col("dist_m")).collect()} == {("A", 0, 0), ("A", 1, 0), ("B", 0, 4), ("B", 1, 4)}


def test_nested_records(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1, 2.5), ("B", 2, 3.5)], "cell string, n int, mean double")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x")
    for name, shift in (("one", 0.0), ("two", 1e-12), ("three", 1.0)):
        readers.write_record(rows.withColumn("mean", F.col("mean") + shift), str(tmp_path / name), {"command": "run"}, readers.digests(spark, str(tmp_path / "in")))
    leaves = {k: readers.record_leaves(spark, str(tmp_path / k)).select("path", "value") for k in ("one", "two", "three")}
    assert {r.path: r.value for r in leaves["one"].collect()}["rows[1].mean"] == "3.5" and leaves["one"].where("path LIKE 'inputs[0].sha256'").count() == 1
    assert gates.record_diff(leaves["one"], leaves["two"], 1e-9).count() == 0 and {r.path for r in gates.record_diff(leaves["one"], leaves["three"], 1e-9).collect()} == {"rows[0].mean", "rows[1].mean"}


def test_published_table(spark, tmp_path):
    rows = spark.createDataFrame([("A", 12345, 1234.5678)], "cell string, n int, v double")
    readers.write_table(rows, str(tmp_path / "t"))
    again = readers.read_table(spark, str(tmp_path / "t"), "cell string, n int, v double")
    assert gates.table_diff(rows, again, ["cell"], "v", 1e-3).count() == 0 and gates.table_diff(rows, again, ["cell"], "v", 1e-9).count() == 1


def test_windowed_errors(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "A", 1.0), ("2024-01-01 00:50:00", "A", 3.0), ("2024-01-01 01:10:00", "A", 5.0)], "t string, cell string, e double").withColumn("t", F.col("t").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = block_sums.windowed_errors(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "t", ["cell"], "e")
    stream.writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.n, r["mean"]) for r in spark.table("windowed").collect()) == [(1, 5.0), (2, 2.0)]


def test_propagation_values(spark):
    d, f = F.lit(1000.0), F.lit(900.0)
    row = spark.range(1).select(prop.fspl(d, f).alias("fspl"), prop.hata_urban(d, f, F.lit(30.0), F.lit(1.5)).alias("hata"), prop.knife_edge(F.lit(0.0)).alias("edge"), prop.watts_to_dbm(F.lit(1.0)).alias("w")).first()
    assert row.fspl == pytest.approx(20 * math.log10(900) + 32.44) and row.hata == pytest.approx(126.42, abs=0.05)
    assert row.edge == pytest.approx(6.0206, abs=1e-3) and row.w == 30


def test_registry_and_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("site_id,lat,lon,height_m,freq_mhz,power_w,operator\ns1,-22.1,-49.0,x,850,20,A\ns2,,,10,900,1,B\ns3,-22,-49,0,1900,,C\n")
    got = {r.site_id: r for r in readers.antenna_registry(spark, str(tmp_path / "a.csv")).collect()}
    assert set(got) == {"s1", "s3"} and got["s1"].height_m == 30 and got["s1"].environment == "suburban" and got["s3"].power_dbm == 30
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps({"grupo": g, "n": i}) for i, g in enumerate("aab")))
    assert readers.manifest(spark, str(tmp_path / "m.jsonl"), "a").count() == 2
    assert readers.digests(spark, str(tmp_path)).where("length > 0").count() == 2


def test_cells_resume(spark, tmp_path):
    path = str(tmp_path / "cells")
    readers.write_cells(spark.createDataFrame([("A", 1), ("B", 2)], "cell string, v int"), path)
    readers.write_cells(spark.createDataFrame([("B", 3)], "cell string, v int"), path)
    assert {(r.cell, r.v) for r in spark.read.parquet(path).collect()} == {("A", 1), ("B", 3)}
    assert [r.cell for r in readers.open_cells(spark, spark.createDataFrame([("A",), ("C",)], "cell string"), path).collect()] == ["C"]


def test_streamed_block_sums(spark, tmp_path):
    rows = spark.createDataFrame([("A", i % 3, float(i) - 5) for i in range(12)], "cell string, block_id long, e double")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    block_sums.start_totals(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    want = block_sums.batch_totals(rows)
    assert table(block_sums.totals(spark, str(tmp_path / "out")).toPandas()) == table(want.toPandas())
