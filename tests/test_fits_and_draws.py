"""Fits of several parameters, draws, priors, ordered fingerprints and diagnostics of stuck chains on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracerage.functions.laws import get_law
from tracerage.operators import diagnostics as dg
from tracerage.operators import fingerprint as fp
from tracerage.operators import fit as ft
from tracerage.operators import order as od
from tracerage.operators import posterior as po
from tracerage.operators import summaries as su
from tracerage.sources.io import stored


# Fits


def gamma_like(p, at):
    return p["top"] * (1 - F.exp(-F.greatest(at - p["shift"], F.lit(0.0)) / p["scale"]))


def test_planted_optima_of_three_parameters_are_recovered(spark):
    rng = np.random.default_rng(4)
    truth = {c: (rng.uniform(1, 9), rng.uniform(0.5, 3.5), rng.uniform(2, 18)) for c in range(12)}
    rows = [(c, float(t), top * (1 - math.exp(-max(t - shift, 0) / scale)), 0.1) for c, (top, shift, scale) in truth.items() for t in np.linspace(4, 60, 40)]
    data = spark.createDataFrame(rows, "case_id long, at double, observed double, error double").repartition(3)
    bounds = {"top": (0.1, 10.0), "shift": (0.0, 4.0), "scale": (1.0, 20.0)}
    fits = ft.best_fits(data, bounds, gamma_like, starts=2)
    known = spark.createDataFrame([(c, *p) for c, p in truth.items()], "case_id long, top double, shift double, scale double")
    got = ft.parameter_errors(fits, known, list(bounds)).collect()
    assert len(got) == 12
    for r in got:
        assert r.converged and r.n == 40 and r.objective < 1e-5 and r.max_relative_error < 1e-4
        assert max(abs(r[f"{n}_error"]) for n in bounds) < 1e-4 and abs(r.scale_relative_error) < 1e-4


def test_an_optimum_outside_the_ranges_ends_at_their_edge(spark):
    """A noisy line whose slope is out of range: the best offset for the slope at the edge."""
    rng = np.random.default_rng(1)
    x = np.arange(30.0)
    y = 2 + 3 * x + rng.normal(0, 0.1, 30)
    data = spark.createDataFrame([("a", float(a), float(b), 1.0) for a, b in zip(x, y, strict=True)] + [("a", None, 1.0, 1.0)], "case_id string, at double, observed double, error double")
    r = ft.best_fits(data, {"base": (-100.0, 100.0), "slope": (0.0, 2.0)}, lambda p, at: p["base"] + p["slope"] * at).collect()[0]
    assert r.slope == pytest.approx(2.0, abs=1e-9) and r.base == pytest.approx(np.mean(y - 2 * x), abs=1e-5) and r.n == 30


def test_a_round_shuffles_no_data(spark):
    """Data are dealt by case and slice once; a round moves points and sums only."""
    data = spark.range(2000).select((F.col("id") % 5).alias("case_id"), F.col("id").cast("double").alias("at"), F.lit(1.0).alias("observed"), F.lit(1.0).alias("error"))
    table, name = ft.dealt_by_case(data)
    bounds = {"k": (0.5, 2.0), "lam": (1.0, 9.0)}
    points = ft.starting_points(data.select("case_id").distinct(), bounds, 2, 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = ft.normal_sums(table, points, get_law("weibull").cdf, bounds)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"drop table {name}")
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "observed" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    above, level = [], depth(lines[scan])
    for line in reversed(lines[:scan]):
        if depth(line) < level:
            above.append(line)
            level = depth(line)
    join = next(i for i, line in enumerate(above) if "Join" in line)
    assert "Bucketed: true" in lines[scan] and not any("Exchange" in line for line in above[:join])


def test_errors_that_are_not_positive_fail_the_fit(spark):
    data = spark.createDataFrame([(1, 1.0, 1.0, 0.0)], "case_id long, at double, observed double, error double")
    with pytest.raises(Exception, match="not positive"):
        ft.best_fits(data, {"a": (0.0, 1.0)}, lambda p, at: p["a"] * at).collect()


# Draws


def test_draws_without_replacement_are_distinct_and_weighted(spark):
    weights = spark.createDataFrame([(c, g, float(1 + g % 4) if g != 7 else 0.0) for c in range(400) for g in range(8)], "case_id long, grid_id long, weight double")
    got = po.distinct_draws(weights, 3, 5).collect()
    by = {}
    for r in got:
        by.setdefault(r.case_id, []).append((r.draw, r.grid_id))
    assert all(sorted(d for d, _ in v) == [0, 1, 2] and len({g for _, g in v}) == 3 for v in by.values()) and len(by) == 400
    first = np.bincount([g for v in by.values() for d, g in v if d == 0], minlength=8) / 400
    share = np.array([1, 2, 3, 4, 1, 2, 3, 0]) / 16
    assert first[7] == 0 and np.all(np.abs(first - share) < 4 * np.sqrt(share * (1 - share) / 400) + 1e-9)
    assert {tuple(r) for r in po.distinct_draws(weights.repartition(7), 3, 5).collect()} == {tuple(r) for r in got}
    assert po.distinct_draws(weights.where("case_id = 1"), 50, 5).count() == 7


def test_ranked_places_equal_a_window(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.choice([None, "a", "a", "b"]), rng.randint(0, 50), i) for i in range(500)], "k string, x long, i long").repartition(5)
    want = df.selectExpr("k", "x", "i", "row_number() over (partition by k order by x, i) as rank", "count(*) over (partition by k) as __n")
    got = od.ranked(df, ["k"], ["x", "i"]).select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


# Priors


def test_prior_quantiles_and_moments_of_each_kind(spark):
    catalogue = spark.createDataFrame([("u", "uniform", None, None, 2.0, 6.0), ("n", "normal", 1.0, 0.5, -1.0, 3.0), ("e", "empirical", None, None, 0.0, 2.0)], "param string, prior string, mean double, std double, cal_lo double, cal_hi double")
    hist = spark.createDataFrame([("e", 0.0, 0.0), ("e", 1.0, 1.0), ("e", 2.0, 0.0)], "param string, x double, density double")
    tables = po.tabulated_priors(catalogue, hist)
    wanted = spark.createDataFrame([(p, q) for p in "une" for q in (0.0, 0.1, 0.5, 0.875, 1.0)], "param string, p double")
    got = {(r.param, r.p): r.value for r in po.prior_quantiles(tables, wanted).collect()}
    assert len(got) == 15
    assert [got["u", q] for q in (0.0, 0.1, 0.5, 0.875, 1.0)] == pytest.approx([2.0, 2.4, 4.0, 5.5, 6.0])
    assert [got["e", q] for q in (0.0, 0.5, 0.875, 1.0)] == pytest.approx([0.0, 1.0, 1.5, 2.0])
    assert got["n", 0.5] == pytest.approx(1.0, abs=1e-6) and got["n", 0.1] == pytest.approx(1 - 1.281552 * 0.5, abs=2e-4)
    moments = {r.param: (r.prior_mean, r.prior_var) for r in po.table_moments(tables).collect()}
    assert moments["u"] == pytest.approx((4.0, 16 / 12)) and moments["e"] == pytest.approx((1.0, 1 / 6))
    draws = spark.createDataFrame([("c", "u", 2 + 4 * (i + 0.5) / 1000) for i in range(1000)] + [("far", "u", 9.0)], "case_id string, param string, value double")
    check = {r.case_id: r for r in po.prior_check(draws, tables).collect()}
    assert check["c"].distance == pytest.approx(0.0005, abs=1e-9) and abs(check["c"].mean_percent) < 1e-6
    assert check["far"].distance == 1.0 and check["far"].mean_percent == pytest.approx(125.0)


def test_quantile_starts_have_one_member_in_each_stratum(spark):
    catalogue = spark.createDataFrame([("m", "n", 0.0, 10.0)], "model string, param string, cal_lo double, cal_hi double")
    prior = spark.createDataFrame([("n", "normal", 5.0, 1.0, 0.0, 10.0)], "param string, prior string, mean double, std double, cal_lo double, cal_hi double")
    rows = po.quantile_design(catalogue, po.tabulated_priors(prior), 100, 1).orderBy("stratum").collect()
    assert [r.stratum for r in rows] == list(range(100)) and sorted(r.member for r in rows) == list(range(100))
    values = [r.value for r in rows]
    assert values == sorted(values) and np.std(values) == pytest.approx(1.0, abs=0.05)


# Fingerprints


def test_ordered_fingerprints_tell_swapped_rows_but_not_partitions(spark):
    rows = [(1, i, f"v{i % 5}", i / 7) for i in range(200)]
    schema = "k long, at long, v string, x double"
    print_of = lambda df: fp.ordered_fingerprint(df, ["k"], ["at"], ["v", "x"]).collect()[0].fingerprint
    base = print_of(spark.createDataFrame(rows, schema))
    assert print_of(spark.createDataFrame(rows[::-1], schema).repartition(9)) == base
    assert print_of(spark.createDataFrame([(k, at + 1000, v, x) for k, at, v, x in rows], schema)) == base  # places count, not keys
    swapped = [list(r) for r in rows]
    swapped[3][2:], swapped[4][2:] = rows[4][2:], rows[3][2:]
    assert print_of(spark.createDataFrame([tuple(r) for r in swapped], schema)) != base
    assert print_of(spark.createDataFrame(rows, schema).withColumn("x", F.col("x").cast("float"))) != base


# Diagnostics


def test_stuck_chains_through_every_diagnostic(spark):
    """One good parameter, one stuck at a value, one stuck at another value in each chain."""
    rng = np.random.default_rng(3)
    rows = [("c", p, ch, s, {"good": float(rng.normal()), "stuck": 5.0, "apart": float(ch)}[p]) for p in ("good", "stuck", "apart") for ch in range(4) for s in range(1, 401)]
    draws = spark.createDataFrame(rows, "case_id string, param string, chain long, step long, value double")
    mcse = {r.param: r.mcse for r in dg.mcse(draws).collect()}
    assert mcse["stuck"] == 0.0 and mcse["apart"] == math.inf and 0 < mcse["good"] < 1
    tau = {(r.param, r.chain): r for r in dg.iact(draws).collect()}
    assert len(tau) == 12 and tau["stuck", 0].constant and tau["stuck", 0].tau is None and tau["stuck", 0].ess == 0.0
    crossing = {(r.param, r.chain): r for r in dg.first_crossing(draws).collect()}
    assert crossing["stuck", 1].ess == 400 and crossing["stuck", 1].acf1 is None and crossing["good", 1].ess <= 400
    diagnosed = stored(dg.diagnose(draws), "diagnosed")
    got = {r.param: r for r in diagnosed.collect()}
    assert got["stuck"].included and got["stuck"].rhat == math.inf and got["stuck"].ess == 0 and got["good"].rhat < 1.05
    _, status = dg.qualify(diagnosed, 1.05, 100.0)
    assert status.collect()[0].status == "not_qualified"
    _, status = dg.qualify(diagnosed.where("param = 'good'"), 1.05, 100.0)
    assert status.collect()[0].status == "qualified"


def test_constant_moments_do_not_count_but_constant_parameters_do(spark):
    rng = np.random.default_rng(5)
    rows = [("c", ch, s, 10.0, float(rng.uniform(0, 1))) for ch in range(3) for s in range(1, 301)]
    draws = spark.createDataFrame(rows, "case_id string, chain long, step long, scale double, shift double")
    info = {r.param: r for r in dg.diagnostic_quantities(dg.quantities(draws, "exp_shifted")).collect()}
    assert len(info) == 9 and info["scale"].included and info["scale"].constant and not info["std"].included and info["mean"].included
    some = dg.quantities(draws, "exp_shifted").where("param in ('scale', 'shift', 'std')")
    diagnosed = stored(dg.diagnose(some), "diagnosed")
    assert dg.qualify(diagnosed, 1.1, 50.0)[1].collect()[0].status == "not_qualified"
    assert dg.qualify(diagnosed.where("param <> 'scale'"), 1.1, 50.0)[1].collect()[0].status == "qualified"


def test_first_crossing_equals_a_plain_loop(spark):
    rng = np.random.default_rng(7)
    chains, rows = {}, []
    for ch, phi in enumerate((0.0, 0.5, 0.95, 0.99)):
        x = [0.0]
        for e in rng.normal(size=2999):
            x.append(phi * x[-1] + e)
        chains[ch] = np.array(x)
        rows += [("c", "p", ch, s + 1, float(v)) for s, v in enumerate(x)]
    got = {r.chain: r for r in dg.first_crossing(spark.createDataFrame(rows, "case_id string, param string, chain long, step long, value double")).collect()}
    for ch, x in chains.items():
        c, n = x - x.mean(), len(x)
        acf = [np.dot(c[:-lag], c[lag:]) / ((n - lag) * np.dot(c, c) / n) for lag in range(1, 1001)]
        stop = next((i for i, a in enumerate(acf) if a <= 0), len(acf))
        tau = max(1.0, 1 + 2 * sum(acf[:stop]))
        assert got[ch].acf1 == pytest.approx(acf[0]) and got[ch].tau == pytest.approx(tau) and got[ch].ess == pytest.approx(n / tau)
    sizes = dg.first_crossing(spark.createDataFrame(rows, "case_id string, param string, chain long, step long, value double"))
    seconds = spark.createDataFrame([("c", 2.0)], "case_id string, seconds double")
    r = dg.min_ess_per_second(sizes, seconds).collect()[0]
    assert r.min_ess == pytest.approx(sum(g.ess for g in got.values())) and r.ess_per_second == pytest.approx(r.min_ess / 2)


def test_experiments_equal_numpy(spark):
    rng = np.random.default_rng(9)
    observed, error, modeled = rng.normal(10, 1, 6), rng.uniform(0.5, 2, 6), rng.normal(10, 2, (101, 6))
    rows = [("x", d, o, float(observed[o]), float(error[o]), float(modeled[d, o])) for d in range(101) for o in range(6)]
    r = su.experiment_check(spark.createDataFrame(rows, "experiment string, draw long, obs long, concentration double, error double, modeled double"), ["experiment"], "draw", ["obs"]).collect()[0]
    objective = (((modeled - observed) / error) ** 2).sum(axis=1)
    inside = (observed >= np.quantile(modeled, 0.05, axis=0)) & (observed <= np.quantile(modeled, 0.95, axis=0))
    assert (r.n_draws, r.n_observations, r.covered_n) == (101, 6, inside.sum()) and r.coverage == pytest.approx(inside.mean())
    assert (r["mean"], r.sd, r.median, r.q05, r.q95) == pytest.approx((objective.mean(), objective.std(ddof=1), np.median(objective), np.quantile(objective, 0.05), np.quantile(objective, 0.95)))
    assert r.rms_median == pytest.approx(np.median(np.sqrt(objective / 6))) and r.log_likelihood_q05 == pytest.approx(-0.5 * np.quantile(objective, 0.95))
