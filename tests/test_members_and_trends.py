"""End-members, trends, running folds, grids with true points and summaries against plain loops."""

import math

import numpy as np
import pytest

from tracerage.operators import clean, forward as fw, order as od, posterior as po, summaries as su

PART = "member string, history string, product string, weight double, half_life double, delay double, decays boolean, before double, fixed double"


def table(rows, key):
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r for r in rows}


def test_four_bins_with_a_daughter_and_a_fixed_old_member(spark):
    dates, values = np.array([1950.0, 1963.0, 1980.0, 2010.0]), np.array([5.0, 800.0, 60.0, 8.0])
    chronicle = spark.createDataFrame([("3H", float(d), float(v)) for d, v in zip(dates, values, strict=True)], "tracer string, date double, value double")
    parts = [("3H", "3H", "parent", 1.0, 12.32, 0.0, False, 5.0, None), ("3He", "3H", "daughter", 1.0, 12.32, 0.0, False, 5.0, None), ("late", "3H", "parent", 2.0, 12.32, 3.0, True, 5.0, None), ("argon", "none", "parent", 1.0, 269.0, 0.0, False, 100.0, 40.0)]
    edges, year, old = [0.0, 20.0, 40.0, 60.0], 2011.0, 60.0
    got = table(fw.composite_endmembers(spark.createDataFrame(parts, PART), chronicle, year, edges, old).collect(), ["member", "age_bin"])
    assert len(got) == 16
    rate = math.log(2) / 12.32
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        ages = np.linspace(a, b, 120)
        entry = np.interp(year - ages, dates, values, left=5.0, right=8.0)
        late = np.interp(year - ages - 3.0, dates, values, left=5.0, right=8.0) * math.exp(-3 * rate)
        assert got["3H", i]["response"] == pytest.approx(np.mean(entry * np.exp(-rate * ages)), rel=1e-9)
        assert got["3He", i]["response"] == pytest.approx(np.mean(entry * (1 - np.exp(-rate * ages))), rel=1e-9)
        assert got["late", i]["response"] == pytest.approx(2 * np.mean(late * np.exp(-rate * ages)), rel=1e-9)
        assert (got["3H", i]["lo"], got["3H", i]["hi"]) == (a, b)
    assert got["3H", 3]["response"] == pytest.approx(5 * math.exp(-rate * old))
    assert got["3He", 3]["response"] == pytest.approx(5 * (1 - math.exp(-rate * old)))
    assert got["argon", 3]["response"] == 40.0 and got["argon", 3]["hi"] is None
    bad = spark.createDataFrame([("x", "3H", "uncle", 1.0, 12.32, 0.0, False, 5.0, None)], PART)
    with pytest.raises(Exception, match="no product of a part is called uncle"):
        fw.composite_endmembers(bad, chronicle, year, edges, old).collect()
    assert fw.composite_endmembers(spark.createDataFrame([], PART), chronicle, year, edges, old).count() == 0


def test_annual_trends(spark):
    rng = np.random.default_rng(3)
    rows = [("a", 2000 + float(x), float(v), float(m)) for x, v, m in zip(rng.uniform(0, 8, 200), rng.uniform(5, 9, 200), rng.uniform(5, 9, 200), strict=True)]
    rows += [("a", 2003.5, 0.0, 4.0), ("a", 2004.5, None, 4.0), ("b", 2001.0, 2.0, 3.0)]
    got = table(su.annual_trends(spark.createDataFrame(rows, "well string, date double, o double, m double"), ["well"], "date", "o", "m").collect(), ["well"])
    mine = [r for r in rows if r[0] == "a"]
    years = sorted({int(r[1]) for r in mine})
    o = [np.mean([r[2] for r in mine if int(r[1]) == y and r[2] is not None]) for y in years]
    m = [np.mean([r[3] for r in mine if int(r[1]) == y]) for y in years]
    assert got["a"]["n_years"] == len(years)
    assert got["a"]["observed_slope"] == pytest.approx(np.polyfit(years, o, 1)[0])
    assert got["a"]["modeled_slope"] == pytest.approx(np.polyfit(years, m, 1)[0])
    assert got["a"]["corr"] == pytest.approx(np.corrcoef(o, m)[0, 1])
    assert got["a"]["median_mismatch"] == pytest.approx(np.median([abs(r[3] - r[2]) / r[2] for r in mine if r[2]]))
    assert got["b"]["n_years"] == 1 and got["b"]["observed_slope"] is None and got["b"]["median_mismatch"] == 0.5


def test_running_folds_of_one_hot_group(spark):
    rng = np.random.default_rng(5)
    values = [None if x < 0.1 else float(v) for x, v in zip(rng.uniform(size=900), rng.integers(-50, 50, 900), strict=True)]
    rows = [(None if i % 9 == 0 else "hot", i, v) for i, v in enumerate([None, *values])]
    df = spark.createDataFrame(rows, "k string, at int, v double").repartition(7)
    got = table(od.running(df, ["k"], ["at"], {"total": ("v", "sum"), "low": ("v", "min"), "high": ("v", "max")}).collect(), ["k", "at"])
    assert len(got) == len(rows)
    for k in (None, "hot"):
        seen = []
        for _, at, v in (r for r in rows if r[0] == k):
            seen += [] if v is None else [v]
            want = (sum(seen), min(seen), max(seen)) if seen else (None, None, None)
            assert tuple(got[k, at][c] for c in ("total", "low", "high")) == want
    assert od.running(df.where("false"), ["k"], ["at"], {"t": ("v", "sum")}).count() == 0


def test_running_acceptance_leaves_out_unknown_steps(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, True), ("a", 3, False), ("a", 4, None), ("a", 5, True)], "chain string, step int, ok boolean")
    got = [r["acceptance"] for r in su.running_acceptance(df, ["chain"], ["step"], "ok").orderBy("step").collect()]
    assert got[0] is None and got[1:] == pytest.approx([1.0, 0.5, 0.5, 2 / 3])


def test_retain_keeps_chains_without_a_name(spark):
    df = spark.createDataFrame([(c, k, s) for c, k in (("a", 1), (None, 2), ("a", None)) for s in range(1, 41)], "case_id string, chain int, step int")
    got = clean.retain(df, 0.5, 10)
    assert sorted((str(r["case_id"]), str(r["chain"]), r["step"]) for r in got.collect()) == sorted((str(c), str(k), s) for c, k in (("a", 1), (None, 2), ("a", None)) for s in (30, 40))
    assert got.columns == df.columns


def test_series_are_numbered_in_ranges(spark):
    df = spark.createDataFrame([("x", str(2000 + i % 5), str(i)) for i in range(50)] + [("x", "bad", "1"), (None, "2000", "1"), ("y", "2001", "nan"), ("y", "2001", "3")], "element string, date string, concentration string")
    rows = clean.normalize_series(df).collect()
    assert [r["at"] for r in sorted((r for r in rows if r["element"] == "x"), key=lambda r: (r["date"], r["concentration"]))] == list(range(1, 51))
    assert [(r["date"], r["concentration"], r["at"]) for r in rows if r["element"] == "y"] == [(2001.0, 3.0, 1)]


def test_axes_have_the_true_point_once(spark):
    truth = spark.createDataFrame([(1, 7.0, 0.1), (2, 5.0, 0.3)], "case_id int, tau double, dp double")
    rows = po.axis_grid(truth, {"tau": (5.0, 60.0, False), "dp": (0.01, 1.0, True)}, 3).collect()
    one = sorted((r for r in rows if r["case_id"] == 1), key=lambda r: r["grid_id"])
    # 0.1 is on the axis already up to its last digit; either way the true value is there.
    taus, dps = sorted({r["tau"] for r in one}), sorted({r["dp"] for r in one})
    assert taus == pytest.approx([5.0, 7.0, 32.5, 60.0]) and dps[0] == 0.01 and 0.1 in dps and len(one) == len(taus) * len(dps)
    assert [r["grid_id"] for r in one] == list(range(len(one)))
    assert [(r["tau"], r["dp"]) for r in one if r["is_true"]] == [(7.0, 0.1)]
    two = [r for r in rows if r["case_id"] == 2]
    assert sorted({r["tau"] for r in two}) == pytest.approx([5.0, 32.5, 60.0]) and sum(r["is_true"] for r in two) == 1
    with pytest.raises(ValueError, match="equal ratios"):
        po.axis_grid(truth, {"tau": (0.0, 60.0, True)}, 3)


def test_noise_of_regimes_and_seeds(spark):
    truth = spark.createDataFrame([(i, 10.0 * (i + 1)) for i in range(2000)], "case_id int, true double")
    regimes = spark.createDataFrame([("none", 0.0, []), ("low", 0.02, [5]), ("rep", 0.1, [1, 2])], "regime string, sigma double, seeds array<int>")
    rows = po.synthetic_observations(truth, regimes, ["case_id"]).collect()
    assert len(rows) == 8000
    assert all(r["observed"] == r["true"] and r["error"] == 0 for r in rows if r["regime"] == "none")
    by = {}
    for r in rows:
        assert r["observed"] == pytest.approx(r["true"] * (1 + r["relative_error"]))
        by.setdefault((r["regime"], r["seed"]), []).append(r["relative_error"])
    for (regime, _), e in by.items():
        sigma = {"none": 0.0, "low": 0.02, "rep": 0.1}[regime]
        assert np.std(e) == pytest.approx(sigma, rel=0.06) and abs(np.mean(e)) <= 0.1 * sigma
    assert abs(np.corrcoef([r["relative_error"] for r in sorted((r for r in rows if r["seed"] == 1), key=lambda r: r["case_id"])], [r["relative_error"] for r in sorted((r for r in rows if r["seed"] == 2), key=lambda r: r["case_id"])])[0, 1]) < 0.08
    few = table(po.synthetic_observations(truth.where("case_id < 3"), regimes, ["case_id"]).collect(), ["case_id", "regime", "seed"])
    assert all(few[r["case_id"], r["regime"], r["seed"]]["observed"] == r["observed"] for r in rows if r["case_id"] < 3)


def test_envelopes_of_one_grid(spark):
    rows = [("r1", t, d) for t in "ab" for d in (1, 2)] + [("r2", "a", 1), ("r2", "a", 2)] + [("r3", t, d) for t in "ab" for d in (1, 2)] + [("r3", "a", 1)]
    got = table(su.envelope_checks(spark.createDataFrame(rows, "r string, t string, d int"), "t", "d", "r").collect(), ["r"])
    assert got["r1"]["ok"] and not got["r2"]["ok"] and not got["r3"]["ok"]
    assert (got["r2"]["tracers_missing"], got["r2"]["points_missing"], got["r3"]["duplicates"]) == (1, 2, 1)


def test_a_configuration_without_rhat_comes_last(spark):
    rows = [("a", 1, 5.0, 90.0, 1.0, 1.001), ("b", 1, 9.0, 95.0, 1.0, None), ("c", 1, 9.0, 80.0, 1.0, float("nan")), ("d", 1, 7.0, 10.0, 1.0, 1.0), ("e", 1, 99.0, 99.0, 1.0, 1.02)]
    df = spark.createDataFrame(rows, "config string, case_no int, median_ess_per_second double, min_ess double, median_between double, rhat double")
    out = su.rank_by_convergence(df, ["config"], []).orderBy("place").collect()
    assert [r["config"] for r in out] == ["d", "a", "e", "b", "c"] and [r["converged"] for r in out] == [True, True, False, False, False]


def test_runs_without_diagnostics_have_zeros(spark):
    chains = spark.createDataFrame([(r, c, s, 0.2 + 0.01 * s, 1.0) for r in ("x", "y") for c in (1, 2) for s in (1, 2)], "run string, chain int, step int, acceptance double, runtime double")
    seen = spark.createDataFrame([("x", True, True), ("x", True, False), ("x", False, False), ("x", False, True)], "run string, included boolean, qualified boolean")
    got = table(su.run_results(chains, seen, ["run"]).collect(), ["run"])
    assert [(got[r]["n_chains"], got[r]["n_diagnostics"], got[r]["failed"], got[r]["failed_informational"], got[r]["runtime"]) for r in "xy"] == [(2, 4, 1, 1, 4.0), (2, 0, 0, 0, 4.0)]


def test_shift_of_a_prior_over_its_width(spark):
    a = spark.createDataFrame([("w", "young", 0.04, 0.0, 0.08), ("w", "old", 0.6, 0.6, 0.6)], "well string, param string, median double, q10 double, q90 double")
    b = a.withColumn("median", a["median"] - 0.02)
    got = table(su.prior_shift(a, b, ["well", "param"]).collect(), ["param"])
    assert got["young"]["over_width"] == pytest.approx(0.25) and got["young"]["near_zero"] and got["young"]["change_points"] == pytest.approx(-2.0)
    assert got["old"]["over_width"] is None and not got["old"]["near_zero"] and got["old"]["absolute_points"] == pytest.approx(2.0)


def test_columns_without_nan(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (3.0, None)], "a double, b double")
    got = table(su.column_summary(df, ["a", "b"]).collect(), ["metric"])
    assert set(got) == {"a"} and (got["a"]["n"], got["a"]["median"], got["a"]["max"]) == (2, 2.0, 3.0) and got["a"]["p95"] == pytest.approx(2.9)
