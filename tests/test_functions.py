"""Special functions, age distributions and identities of the forward model against closed forms."""

import math

import pytest
from pyspark.sql import functions as F

from tracerage.functions import laws
from tracerage.functions import scalar as sc
from tracerage.functions import special as sp
from tracerage.operators import chronicle as ch
from tracerage.operators import diagnostics as dg
from tracerage.operators import distributions as ds
from tracerage.operators import forward as fw
from tracerage.operators import posterior as po
from tracerage.operators import summaries as su


def column(spark, values, expression):
    return [r[0] for r in spark.createDataFrame([(float(v),) for v in values], "x double").select(expression(F.col("x"))).collect()]


def test_normal_functions(spark):
    zs = [-9.0, -6.0, -3.2, -0.5, 0.0, 1.1, 4.0, 7.5]
    for z, p in zip(zs, column(spark, zs, sp.normal_cdf), strict=True):
        assert p == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), abs=1e-14)
    for z, p in zip(zs, column(spark, zs, sp.normal_log_cdf), strict=True):
        assert p == pytest.approx(math.log(0.5 * math.erfc(-z / math.sqrt(2))), rel=1e-8, abs=1e-12)
    ps = [1e-12, 1e-4, 0.02, 0.31, 0.5, 0.9, 0.9999]
    for p, z in zip(ps, column(spark, ps, sp.normal_inverse), strict=True):
        assert 0.5 * math.erfc(-z / math.sqrt(2)) == pytest.approx(p, rel=1e-12)


def test_gamma_functions(spark):
    xs = [0.1, 0.5, 1.0, 2.5, 7.0, 30.0]
    for x, g in zip(xs, column(spark, xs, sp.log_gamma), strict=True):
        assert g == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-13)
    for x, p in zip(xs, column(spark, xs, lambda c: sp.gamma_p(F.lit(3.0), c)), strict=True):
        assert p == pytest.approx(1 - math.exp(-x) * (1 + x + x * x / 2), abs=1e-13)


@pytest.mark.parametrize(("name", "p"), [("exp", {"scale": 7.0}), ("exp_shifted", {"scale": 7.0, "shift": 2.0}), ("uniform", {"tmin": 3.0, "delta": 9.0}), ("ig", {"mu": 8.0, "sigma": 5.0}), ("ig_shifted", {"mu": 8.0, "sigma": 5.0, "shift": 1.5}), ("gamma", {"k": 2.7, "theta": 3.0}), ("weibull", {"k": 1.7, "lam": 6.0}), ("dirac", {"mu1": 4.0}), ("dirac_double", {"mu1": 4.0, "mu2": 9.0, "rate": 0.3}), ("mix_exp_shifted", {"mu1": 2.0, "scale": 6.0, "shift": 1.0, "rate": 0.4})])
def test_laws_reach_mass_one_and_their_mean(spark, name, p):
    law = laws.get_law(name)
    cols = {k: F.lit(v) for k, v in p.items()}
    row = spark.range(1).select(law.cdf(cols, F.lit(400.0)), law.moment(cols, F.lit(400.0)), law.mean(cols), law.cdf(cols, F.lit(0.0))).first()
    assert row[0] == pytest.approx(1, abs=1e-9)
    assert row[1] == pytest.approx(row[2], rel=1e-7)
    assert row[3] == pytest.approx(0, abs=1e-12)


def test_registry_rejects_unknown_and_repeated_names():
    with pytest.raises(KeyError, match="unknown age distribution"):
        laws.get_law("nothing")
    with pytest.raises(ValueError, match="registered already"):
        laws.register_law("exp", laws.get_law("exp"))


def test_interpolation_is_zero_outside_and_inclusive_at_both_ends(spark):
    knots = spark.createDataFrame([("a", 2000.0, 1.0), ("a", 2003.5, 8.0), ("a", 2004.0, 6.0)], "tracer string, date double, value double")
    pts = spark.createDataFrame([("a", x) for x in (1999.9, 2000.0, 2001.75, 2003.5, 2004.0, 2004.1)] + [("b", 2001.0)], "tracer string, x double")
    got = {(r["tracer"], r["x"]): r["value"] for r in ch.interpolate(pts, knots).collect()}
    assert got == {("a", 1999.9): 0.0, ("a", 2000.0): 1.0, ("a", 2001.75): 4.5, ("a", 2003.5): 8.0, ("a", 2004.0): 6.0, ("a", 2004.1): 0.0, ("b", 2001.0): 0.0}
    held = {r["x"]: r["value"] for r in ch.interpolate_hold(pts.where("tracer = 'a'"), knots, 0.5).collect()}
    assert held[1999.9] == 0.5 and held[2004.1] == 6.0


def test_constant_input_gives_constant_times_window_mass(spark):
    knots = spark.createDataFrame([("a", 1950.0 + i, 3.0) for i in range(60)], "tracer string, date double, value double")
    tracers = spark.createDataFrame([("a", "u", "chronicle", None, None, None)], "name string, unit string, mode string, constant double, production_rate double, decay_rate double")
    pairs = spark.createDataFrame([("a", 2009.0), ("a", 1950.0)], "tracer string, date double")
    draws = spark.createDataFrame([(i, 2.0 + 5 * i, 1.0) for i in range(4)], "draw long, scale double, shift double")
    bins = fw.with_responses(fw.base_edges(pairs, knots, tracers), knots, tracers)
    for r in fw.convolve(draws, bins, "exp_shifted", ["draw"]).collect():
        mass = 1 - math.exp(-(59.0 - 1) / (2.0 + 5 * r["draw"]))
        assert r["window_mass"] == pytest.approx(mass, rel=1e-12)
        assert r["modeled"] == pytest.approx(3 * mass, rel=1e-12)
    obs = pairs.withColumnRenamed("tracer", "element")
    empty = fw.predict(draws, obs, knots, tracers, "exp_shifted", ["draw"]).where("date = 1950").collect()
    assert len(empty) == 4 and all(r["concentration"] == 0 for r in empty)


def test_refined_grid_meets_a_decayed_input_in_closed_form(spark):
    knots = spark.createDataFrame([("a", 1900.0, 5.0), ("a", 2010.0, 5.0)], "tracer string, date double, value double")
    rate = math.log(2) / 12
    tracers = spark.createDataFrame([("a", "u", "chronicle", None, None, rate)], "name string, unit string, mode string, constant double, production_rate double, decay_rate double")
    pairs = spark.createDataFrame([("a", 2000.0)], "tracer string, date double")
    fine = fw.refine(fw.base_edges(pairs, knots, tracers), knots, tracers)
    draws = spark.createDataFrame([(0, 10.0)], "draw long, scale double")
    got = fw.convolve(draws, fine, "exp", ["draw"]).first()["modeled"]
    want = 5 / 10 / (rate + 0.1) * (1 - math.exp(-100 * (rate + 0.1)))
    assert got == pytest.approx(want, rel=2e-3)


def test_refinement_fails_where_it_does_not_converge(spark):
    knots = spark.createDataFrame([("a", 1990.0, 0.0), ("a", 2000.0, 5.0)], "tracer string, date double, value double")
    tracers = spark.createDataFrame([("a", "u", "chronicle", None, None, None)], "name string, unit string, mode string, constant double, production_rate double, decay_rate double")
    pairs = spark.createDataFrame([("a", 2000.0)], "tracer string, date double")
    bins = fw.base_edges(pairs, knots, tracers)
    with pytest.raises(ValueError, match="a at 2000.0 aren't fine after 3 steps"):
        fw.refine(bins, knots, tracers, levels=3)
    with pytest.raises(ValueError, match="bins"):
        fw.refine(bins, knots, tracers, most=20)
    fine = fw.refine(bins, knots, tracers).orderBy("left").collect()
    assert fine[0]["left"] == 0 and fine[-1]["right"] == 10 and all(a["right"] == b["left"] for a, b in zip(fine, fine[1:], strict=False))
    assert all(abs(r["k_left"] - r["k_right"]) <= 5e-4 * 5 + 0.02 * max(r["k_left"], r["k_right"]) + 1e-12 for r in fine)
    assert fw.refine(bins.limit(0), knots, tracers).count() == 0


def test_refined_predictions_meet_the_exact_integral(spark):
    # A ramp of slope 1 from 1990 on and exponential ages: the integral has a closed form.
    knots = spark.createDataFrame([("a", 1990.0, 0.0), ("a", 2020.0, 30.0)], "tracer string, date double, value double")
    tracers = spark.createDataFrame([("a", "u", "chronicle", None, None, None)], "name string, unit string, mode string, constant double, production_rate double, decay_rate double")
    obs = spark.createDataFrame([("a", 2015.0)], "element string, date double")
    draws = spark.createDataFrame([(i, 2.0 + 6 * i) for i in range(4)], "draw long, scale double")
    for r in fw.predict(draws, obs, knots, tracers, "exp", ["draw"]).collect():
        m = 2.0 + 6 * r["draw"]
        want = 25 - m * (1 - math.exp(-25 / m))
        assert r["concentration"] == pytest.approx(want, rel=5e-4)


def test_stick_breaking_sums_to_one(spark):
    lat = spark.createDataFrame([(1, i, v) for i, v in enumerate((-2.0, 0.0, 30.0))], "k long, age_bin int, latent double")
    got = [r["fraction"] for r in ds.stick_breaking(lat, ["k"]).orderBy("age_bin").collect()]
    assert sum(got) == pytest.approx(1) and got[0] == pytest.approx(1 / (1 + math.exp(2)))


def test_dates_and_names(spark):
    row = spark.sql("select '31/12/2000' a, '01-07-49' b, '01-07-50' c, 'CFC-113' d, 'SF6' e").select(sc.decimal_year("a"), sc.decimal_year_2digit("b", 5), sc.decimal_year_2digit("c", 5), sc.normalize_tracer("d"), sc.normalize_tracer("e")).first()
    assert row[0] == pytest.approx(2000 + 365 / 366)
    assert row[1] == pytest.approx(2049 + 181 / 365, abs=1e-5) and row[2] == pytest.approx(1950 + 181 / 365, abs=1e-5)
    assert row[3] == "cfc113" and row[4] is None


def test_diagnostics_of_degenerate_chains(spark):
    rows = [("c", "x", k, i, 1.0) for k in range(2) for i in range(10)] + [("c", "y", k, i, float(k)) for k in range(2) for i in range(10)]
    d = spark.createDataFrame(rows, "case_id string, param string, chain long, step long, value double")
    rhat = {r["param"]: r["rhat"] for r in dg.basic_rhat(d).collect()}
    assert rhat["x"] is None and rhat["y"] == float("inf")
    assert {r["param"]: r["ess"] for r in dg.ess(d, 5).collect()}["x"] == 0.0


def test_ranked_quantiles_and_places_equal_numpy(spark):
    import numpy as np

    from tracerage.operators import order

    rng = np.random.default_rng(3)
    rows = [(k, float(v)) for k in "ab" for v in (*rng.normal(size=301), *[0.5] * 200)] + [("c", 2.0), ("c", None), ("c", float("nan"))]
    d = spark.createDataFrame(rows, "k string, value double").repartition(3)
    got = {r["k"]: r for r in order.quantiles(d, ["k"], "value", {"lo": 0.03, "mid": 0.5, "hi": 0.97}).collect()}
    for k in "ab":
        values = [v for g, v in rows if g == k]
        assert [got[k]["lo"], got[k]["mid"], got[k]["hi"]] == pytest.approx(np.quantile(values, [0.03, 0.5, 0.97]).tolist())
    assert got["c"]["mid"] == 2.0
    assert order.quantiles(d, [], "value", {"mid": 0.5}).first()["mid"] == pytest.approx(np.quantile([v for _, v in rows[:-2]], 0.5))
    ranks = [r["rank"] for r in order.average_rank(d.where("k = 'a'"), ["k"], "value").orderBy("value").collect()]
    assert len(ranks) == 501 and sum(ranks) == 501 * 502 / 2


def test_autocovariances_run_over_segments_and_rounds(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(dg, "SEGMENT", 16)
    monkeypatch.setattr(dg, "FIRST_LAGS", 4)
    rng = np.random.default_rng(4)
    x = np.zeros((2, 150))
    for i in range(1, 150):  # slowly mixing chains
        x[:, i] = 0.9 * x[:, i - 1] + rng.normal(size=2)
    rows = [("c", "p", c, i + 1, float(x[c, i])) for c in range(2) for i in range(150)]
    d = spark.createDataFrame(rows, "case_id string, param string, chain long, step long, value double").repartition(3)
    cov = {(r["chain"], r["lag"]): r["acov"] for r in dg.acf(d, 15).collect()}
    for c in range(2):
        z = x[c] - x[c].mean()
        for lag in range(16):
            assert cov[c, lag] == pytest.approx(float(z[: 150 - lag] @ z[lag:]) / 150)
    tau = {r["chain"]: r for r in dg.iact(d).collect()}
    for c in range(2):
        z = x[c] - x[c].mean()
        rho = [float(z[: 150 - k] @ z[k:]) / float(z @ z) for k in range(150)]
        total, low = 0.0, float("inf")
        for k in range(0, 150, 2):
            s = rho[k] + rho[k + 1]
            if s <= 0:
                break
            low = min(low, s)
            total += low
        assert tau[c]["tau"] == pytest.approx(2 * total - 1) and tau[c]["tau"] > 4 and not tau[c]["truncated"]
    assert dg.ess(d, 3).first()["truncated"]


def test_effective_size_of_independent_draws_is_near_their_number(spark):
    d = spark.range(4000).select(F.lit("c").alias("case_id"), F.lit("x").alias("param"), (F.col("id") % 4).alias("chain"), F.floor(F.col("id") / 4).alias("step"), F.randn(5).alias("value"))
    d = spark.createDataFrame(d.collect(), d.schema)
    assert 3000 < dg.ess(d, 100).first()["ess"] < 5500
    assert dg.split_rhat(d).first()["rhat"] < 1.02


def test_histogram_closes_its_last_bin_and_widens_a_point(spark):
    d = spark.createDataFrame([("a", v) for v in (0.0, 1.0, 2.0, 4.0)] + [("b", 3.0)], "k string, value double")
    got = {(r["k"], r["bin"]): (r["left"], r["count"]) for r in su.histogram(d, ["k"], 4).collect()}
    assert got["a", 4] == (3.0, 1) and got["a", 1] == (0.0, 1) and len(got) == 8
    assert got["b", 3] == (3.0, 1) and got["b", 1] == (2.5, 0)


def test_grid_posterior_is_shifted_and_normalised(spark):
    s = spark.createDataFrame([("a", 0, 2000.0, 1.0), ("a", 1, 2002.0, 2.0), ("b", 0, 4.0, 1.0)], "case_id string, grid_id long, chi2 double, x double")
    w = {(r["case_id"], r["grid_id"]): r["weight"] for r in po.grid_posterior(s).collect()}
    assert w["a", 0] == pytest.approx(1 / (1 + math.exp(-1))) and w["b", 0] == 1.0


def test_tables_reject_what_is_incomplete(spark):
    from tracerage.operators import clean

    tools = spark.createDataFrame([("m", i, 10.0, 10.0 + i, 9.0 + i) for i in range(3)], "model string, seed long, truth double, a double, b double")
    row = su.tool_table(tools, ["model"], ["a", "b"], 3, 0.11).first()
    assert row["a_bias"] == pytest.approx(1) and row["b_minus_a"] == pytest.approx(-1) and row["a_passes"] == 2
    assert su.tool_table(tools, ["model"], ["a", "b"], 4, 0.1, strict=False).first()["a_mean"] is None
    with pytest.raises(Exception, match="incomplete campaign: 3 of 4"):
        su.tool_table(tools, ["model"], ["a", "b"], 4, 0.1).collect()
    obs = spark.createDataFrame([(1, "x", "true"), (2, "y", "false")], "well long, element string, enabled string")
    assert clean.subset(obs, [1], ["x"]).count() == 1
    with pytest.raises(ValueError, match="2"):
        clean.subset(obs, [1, 2])
    times = spark.sql("select 'e' as experiment_id, timestamp'2020-01-01 00:00:00' as started, timestamp'2020-01-01 01:30:00' as finished")
    matrix = spark.createDataFrame([("e", "f")], "experiment_id string, family string")
    assert su.campaign_inventory(times, matrix).first()["runtime_hours"] == 1.5
    with pytest.raises(Exception, match="not in the matrix"):
        su.campaign_inventory(times, matrix.where("family = 'g'")).collect()


def test_units_pass_as_the_contract_has_them(spark):
    from tracerage.operators import clean

    rows = spark.createDataFrame([(u,) for u in ("Bq/L", "bq/l", "mol", "dpm/ccKr", "TU_equivalent", "%modern", "furlong", " N/A ", "0", None)], "unit string")
    got = {r["unit"]: (r["canonical"], r["status"]) for r in clean.check_units(rows).collect()}
    assert got["Bq/L"] == ("Bq/L", "ok") and got["bq/l"] == ("Bq/L", "recase") and got["%modern"] == ("pmC", "recase")
    assert all(got[u][1] == "ok" for u in ("mol", "dpm/ccKr", "TU_equivalent")) and got["furlong"] == (None, "custom")
    assert all(got[u][1] == "placeholder" for u in (" N/A ", "0", None))
    air = spark.createDataFrame([(8.0,), (-12.0,), (25.0,), (None,)], "d double").select(sc.screen_delta("d").alias("s"))
    assert [r["s"] for r in air.collect()] == ["limited_air_effects", "moderate_air_effects", "strong_air_effects", "not_available"]
