"""Aggregations and summaries (H rows)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import stored
from .order import quantiles as ranked_quantiles
from .order import running


def quantiles(value: str, probabilities: list[float]) -> Column:
    """Exact quantiles with linear interpolation, as an array; for groups of a bounded size, as draws of one observation."""
    return F.expr(f"percentile({value}, array({', '.join(map(str, probabilities))}))")


def with_quantiles(rows: DataFrame, df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``rows`` (one a key) with exact quantiles of groups of any size: no group's values are in one buffer."""
    return rows.join(ranked_quantiles(df, keys, value, shares), keys, "left")


def describe_table(draws: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Count, mean, sample deviation, least, quartiles and greatest per key."""
    rows = draws.groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return with_quantiles(rows, draws, keys, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75}).select(*keys, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def posterior_summary(draws: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    rows = draws.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return with_quantiles(rows, draws, keys, value, {"q025": 0.025, "q10": 0.1, "q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9, "q975": 0.975})


def prediction_envelope(pred: DataFrame, by: list[str], realisation: str, value: str) -> DataFrame:
    """Quantiles over realisations per tracer and date; a realisation with a date twice is an error."""
    once = pred.groupBy(*by, realisation).agg(F.when(F.count("*") == 1, F.first(value)).otherwise(F.raise_error(F.lit("a realisation has a date twice")).cast("double")).alias("v"))
    rows = once.groupBy(*by).agg(F.count("*").alias("n"), quantiles("v", [0.1, 0.25, 0.5, 0.75, 0.9]).alias("q"))
    return rows.select(*by, "n", *(F.col("q")[i].alias(n) for i, n in enumerate(("q10", "q25", "q50", "q75", "q90"))))


def envelope_checks(pred: DataFrame, tracer: str, date: str, realisation: str) -> DataFrame:
    """Whether realisations lie on one grid: ``realisation, n_tracers, n_points, tracers_missing, points_missing, duplicates, ok``.

    The grid is every tracer and every (tracer, date) that any realisation has. ``duplicates`` counts
    points that a realisation has more than once. Two aggregates and a join with their one row of totals.
    """
    points = pred.groupBy(realisation, tracer, date).agg(F.count("*").alias("__c"))
    mine = points.groupBy(realisation).agg(F.countDistinct(tracer).alias("n_tracers"), F.count("*").alias("n_points"), F.count_if(F.col("__c") > 1).alias("duplicates"))
    grid = points.select(tracer, date).distinct().agg(F.countDistinct(tracer).alias("__tracers"), F.count("*").alias("__points"))
    rows = mine.crossJoin(F.broadcast(grid)).withColumns({"tracers_missing": F.col("__tracers") - F.col("n_tracers"), "points_missing": F.col("__points") - F.col("n_points")})
    return rows.withColumn("ok", (F.col("points_missing") == 0) & (F.col("duplicates") == 0)).drop("__tracers", "__points")


def histogram(draws: DataFrame, keys: list[str], n: int = 100, value: str = "value") -> DataFrame:
    """``keys, bin, left, count, density`` of n equal bins over each group's range, empty ones too.

    The last bin holds its right end. A range of zero is widened by a half to both sides.
    """
    span = draws.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("total"))
    flat = F.col("lo") == F.col("hi")
    span = span.select(*keys, F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), "total").withColumn("w", (F.col("hi") - F.col("lo")) / n)
    at = F.least(F.floor((F.col(value) - F.col("lo")) / F.col("w")) + 1, F.lit(n))
    counts = draws.join(span, keys).withColumn("bin", at).groupBy(*keys, "bin").agg(F.count("*").alias("count"))
    bins = span.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))).alias("bin"))
    rows = bins.join(counts, [*keys, "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return rows.select(*keys, "bin", (F.col("lo") + (F.col("bin") - 1) * F.col("w")).alias("left"), "count", (F.col("count") / (F.col("total") * F.col("w"))).alias("density"))


def range_histogram(draws: DataFrame, catalogue: DataFrame, keys: list[str], n: int = 100) -> DataFrame:
    """Counts in n bins of the calibration range (``param, cal_lo, cal_hi``)."""
    rows = draws.join(catalogue, [k for k in keys if k in catalogue.columns])
    return rows.withColumn("bin", F.floor((F.col("value") - F.col("cal_lo")) / ((F.col("cal_hi") - F.col("cal_lo")) / n))).groupBy(*keys, "bin").agg(F.count("*").alias("count"))


def age_stats(draws: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Mean and population deviation of each column."""
    return draws.groupBy(*keys).agg(*(x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))))


def recovery_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Estimates against the truth: mean, sd, bias, RMSE, quantiles, range."""
    e = F.col("estimate") - F.col("truth")
    rows = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("estimate").alias("mean"), F.stddev_samp("estimate").alias("sd"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"), F.min("estimate").alias("min"), F.max("estimate").alias("max"))
    return with_quantiles(rows, df, keys, "estimate", {"q025": 0.025, "median": 0.5, "q975": 0.975})


def paired_stats(df: DataFrame, keys: list[str], a: str, b: str, expected: int | None = None) -> DataFrame:
    """Mean and RMS of b - a; groups of another size than expected are marked incomplete."""
    d = F.col(b) - F.col(a)
    rows = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(d).alias("mean_diff"), F.sqrt(F.avg(d * d)).alias("rms_diff"))
    return rows if expected is None else rows.withColumn("complete", F.col("n") == expected)


def head_to_head(df: DataFrame, keys: list[str], a: str, b: str, tol: float = 1e-12) -> DataFrame:
    """How often a's absolute error is smaller, larger or as large as b's."""
    x, y = F.abs(a), F.abs(b)
    return df.groupBy(*keys).agg(F.count_if(x < y - tol).alias("wins"), F.count_if(x > y + tol).alias("losses"), F.count_if(F.abs(x - y) <= tol).alias("ties"))


def objective_diagnostic(df: DataFrame, keys: list[str], worst: bool = False) -> DataFrame:
    """Relative L1 and L2 misfit from maps ``observed`` and ``modeled`` of tracers; with ``worst`` the greatest too."""
    rows = df.select(*keys, F.explode("observed").alias("tracer", "obs"), "modeled").withColumn("mod", F.try_element_at("modeled", F.col("tracer")))
    r = (F.col("mod") - F.col("obs")) / F.greatest(F.abs("obs"), F.lit(1e-300))
    return rows.groupBy(*keys).agg(F.sum(F.abs(r)).alias("l1"), F.sqrt(F.sum(r * r)).alias("l2"), *([F.max(F.abs(r)).alias("worst")] if worst else []))


def objective_comparison(a: DataFrame, b: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """How often a fits better than b though its parameter is worse: one row for each of ``by``.

    Both have ``keys, l1, l2, worst, parameter_error`` (keys hold ``by``): counts of cases, of a's
    lower L1 and L2, of its worse parameters, and of these with a lower L2 or a lower greatest misfit.
    """
    names = ("l1", "l2", "worst", "parameter_error")
    side = lambda df, s: df.select(*keys, *(F.col(c).alias(f"{s}_{c}") for c in names))
    rows = side(a, "a").join(side(b, "b"), keys)
    lower = {c: F.col(f"a_{c}") < F.col(f"b_{c}") for c in names}
    worse = F.col("a_parameter_error") > F.col("b_parameter_error")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(lower["l1"]).alias("lower_l1"), F.count_if(lower["l2"]).alias("lower_l2"), F.count_if(worse).alias("worse_parameter"), F.count_if(worse & lower["l2"]).alias("worse_but_lower_l2"), F.count_if(worse & lower["worst"]).alias("worse_but_lower_worst"))


def information_gain(a: DataFrame, b: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Deviation, RMSE and correlation of two campaigns and the relative reductions from a to b."""
    stats = lambda df, s: df.groupBy(*keys).agg(F.stddev_samp(x).alias(f"sd_{s}"), F.sqrt(F.avg(F.pow(F.col(x) - F.col(y), F.lit(2.0)))).alias(f"rmse_{s}"), F.corr(x, y).alias(f"corr_{s}"))
    return stats(a, "a").join(stats(b, "b"), keys).withColumns({"sd_reduction": 1 - F.try_divide("sd_b", "sd_a"), "rmse_reduction": 1 - F.try_divide("rmse_b", "rmse_a")})


def variability(df: DataFrame, keys: list[str], seed: str, value: str) -> DataFrame:
    """Over seeds: how many, deviation and range of their medians, and the median count."""
    per = df.groupBy(*keys, seed).agg(F.expr(f"median({value})").alias("m"), F.count("*").alias("n"))
    return per.groupBy(*keys).agg(F.countDistinct(seed).alias("n_seeds"), F.stddev_samp("m").alias("sd"), (F.max("m") - F.min("m")).alias("range"), F.min("n").alias("min_n"), F.expr("median(n)").alias("median_n"))


def seed_variability(df: DataFrame, keys: list[str], seed: str) -> DataFrame:
    """Over seeds (``median, q10, q90, sd, ess, ess_per_second`` of each): deviations between them, range of medians, least and median ESS."""
    rows = df.groupBy(*keys).agg(
        F.countDistinct(seed).alias("n_seeds"), *(F.stddev_samp(c).alias(f"{c}_between") for c in ("median", "q10", "q90", "sd")),
        (F.max("median") - F.min("median")).alias("median_range"), F.min("ess").alias("min_ess"),
    )
    rows = with_quantiles(rows, df, keys, "ess", {"median_ess": 0.5})
    return with_quantiles(rows, df, keys, "ess_per_second", {"median_ess_per_second": 0.5})


def rank_by_convergence(df: DataFrame, config: list[str], group: list[str], limit: float = 1.01) -> DataFrame:
    """Configurations in order of (R-hat below the limit, ESS a second, least ESS), ``place`` from 1 within ``group``.

    ``df`` has rows of seed_variability() with ``rhat``; equal ones go by name. A missing or NaN
    R-hat isn't below. The window goes over configurations, not over their cases.
    """
    bad = F.col("rhat").isNull() | F.isnan("rhat")
    rows = df.groupBy(*group, *config).agg(F.max("rhat").alias("max_rhat"), F.min("min_ess").alias("min_ess"), F.max("median_between").alias("max_between"), (~F.bool_or(bad | (F.col("rhat") >= limit))).alias("converged"))
    rows = with_quantiles(rows, df, [*group, *config], "median_ess_per_second", {"ess_per_second": 0.5})
    order = [F.desc("converged"), F.desc_nulls_last("ess_per_second"), F.desc_nulls_last("min_ess"), *config]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))


def rank_configs(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def comparability(df: DataFrame, keys: list[str], case: str, passed: str, runtime: str) -> DataFrame:
    """All passed, pass rate, cases with any pass, median and deviation of runtimes."""
    any_ = df.groupBy(*keys, case).agg(F.bool_or(passed).alias("any")).groupBy(*keys).agg(F.count_if("any").alias("cases_with_pass"))
    rows = df.groupBy(*keys).agg(F.bool_and(passed).alias("all_pass"), F.avg(F.col(passed).cast("int")).alias("pass_rate"), F.countDistinct(case).alias("n_cases"), F.stddev_samp(runtime).alias("sd_runtime"))
    return with_quantiles(rows.join(any_, keys), df, keys, runtime, {"median_runtime": 0.5})


def comparability_by_length(df: DataFrame, length: str, case: str, seed: str, passed: str, runtime: str, reference: DataFrame) -> DataFrame:
    """A row for each length of runs: runs, those that pass in all parameters, pass rate, cases with any pass, runtimes.

    ``df`` has a row for each run and parameter (``passed``; ``runtime`` is the run's), ``reference`` a row
    for each case with its reference ``runtime``; a run's ratio is to its own case's.
    """
    one = df.groupBy(length, case, seed).agg(F.bool_and(passed).alias("__ok"), F.max(runtime).alias("__t"))
    one = one.join(reference.select(case, F.col(runtime).alias("__ref")), case, "left").withColumn("__ratio", F.try_divide(F.col("__t"), F.col("__ref")))
    any_ = one.where("__ok").groupBy(length).agg(F.countDistinct(case).alias("cases_with_pass"))
    rows = one.groupBy(length).agg(F.count("*").alias("runs"), F.count_if("__ok").alias("passes"), F.avg("__t").alias("mean_runtime"), F.stddev_samp("__t").alias("sd_runtime"))
    rows = rows.join(any_, length, "left").withColumn("cases_with_pass", F.coalesce("cases_with_pass", F.lit(0))).withColumn("pass_rate", F.col("passes") / F.col("runs"))
    rows = with_quantiles(rows, one, [length], "__t", {"median_runtime": 0.5})
    return with_quantiles(rows, one, [length], "__ratio", {"median_runtime_ratio": 0.5})


def target_table(draws: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """All statistics of describe_table() of each parameter beside its target: difference, ratios of mean and deviation."""
    rows = describe_table(draws, [*keys, "param"]).join(truth.select("param", "target"), "param")
    return rows.withColumns({"difference": F.col("mean") - F.col("target"), "mean_ratio": F.try_divide("mean", "target"), "std_ratio": F.try_divide("std", "target")})


def target_stats(draws: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of each parameter against its target: difference, ratio, relative deviation; distance over parameters."""
    rows = draws.groupBy(*keys, "param").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")).join(truth, "param")
    d = F.col("mean") - F.col("target")
    return rows.groupBy(*keys).agg(F.sqrt(F.sum(d * d)).alias("distance"), F.max(F.abs(d)).alias("max_difference"), F.avg(F.try_divide("mean", "target")).alias("mean_ratio"), F.avg(F.try_divide("std", "target")).alias("std_ratio"))


def trend(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares slope and correlation, values at the first and the last x, greatest step from the first."""
    rows = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.corr(x, y).alias("corr"), F.min_by(y, x).alias("first"), F.max_by(y, x).alias("last"), F.max(y).alias("__hi"), F.min(y).alias("__lo"))
    return rows.withColumn("max_abs_delta", F.greatest(F.abs(F.col("__hi") - F.col("first")), F.abs(F.col("__lo") - F.col("first")))).drop("__hi", "__lo")


def annual_trends(df: DataFrame, keys: list[str], date: str, observed: str, modeled: str) -> DataFrame:
    """Two series side by side on calendar years: ``n_years``, slopes of both annual means, their correlation, and the mismatch.

    ``median_mismatch`` is the median of |modeled - observed| / observed over rows, not years; rows
    without an observed value or with 0 don't count in it. Rows lose their dates and are stored, so
    what they come from is made once; one aggregate over years gives all but the median.
    """
    rows = stored(df.select(*keys, F.floor(date).cast("double").alias("__y"), observed, modeled), "annual")
    rows = rows.withColumn("__mismatch", F.try_divide(F.abs(F.col(modeled) - F.col(observed)), F.col(observed)))
    years = rows.groupBy(*keys, "__y").agg(F.avg(observed).alias("__o"), F.avg(modeled).alias("__m"))
    out = years.groupBy(*keys).agg(F.count("*").alias("n_years"), F.regr_slope("__o", "__y").alias("observed_slope"), F.regr_slope("__m", "__y").alias("modeled_slope"), F.corr("__o", "__m").alias("corr"))
    return with_quantiles(out, rows, keys, "__mismatch", {"median_mismatch": 0.5})


def residuals(df: DataFrame) -> DataFrame:
    """Of ``concentration, error, modeled``: residual, normalised, squared."""
    r = F.col("modeled") - F.col("concentration")
    return df.withColumn("residual", r).withColumn("normalised", r / F.col("error")).withColumn("squared", F.pow(r / F.col("error"), F.lit(2.0)))


def residual_totals(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, j, m, rms``: of residual rows the sum of squares, their number and sqrt(J / m)."""
    return df.groupBy(*keys).agg(F.sum("squared").alias("j"), F.count("squared").alias("m")).withColumn("rms", F.sqrt(F.try_divide(F.col("j"), F.col("m"))))


def fit_quality(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sqrt(F.avg("squared")).alias("rmse"), F.avg("normalised").alias("mean"), F.max(F.abs("normalised")).alias("max_abs"))


def predictive_check(pred: DataFrame, keys: list[str]) -> DataFrame:
    """Per observation over draws (``modeled``): median, 5 % and 95 %, residual, whether the interval covers it."""
    rows = pred.groupBy(*keys, "concentration", "error").agg(quantiles("modeled", [0.05, 0.5, 0.95]).alias("q"))
    rows = rows.select(*keys, "concentration", "error", F.col("q")[0].alias("q05"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q95"))
    return rows.withColumn("residual", F.col("median") - F.col("concentration")).withColumn("covered", F.col("concentration").between(F.col("q05"), F.col("q95")))


def experiment_check(pred: DataFrame, keys: list[str], draw: str, observation: list[str]) -> DataFrame:
    """Posterior predictive check of whole experiments: one row for each of ``keys``.

    ``pred`` has a row for each draw and observation (``concentration, error, modeled``). A draw's
    objective is the sum of its squared normalised residuals. Returns numbers of draws and
    observations, the objective's mean, median, sd and 5 and 95 % quantiles, the median of its root
    mean square, the same of the log-likelihood (minus half of it), and how many observations lie
    between their draws' 5 and 95 % quantiles. Two aggregates: draws keep their objective before its
    quantiles, observations their interval. Quantiles come from places of values dealt in ranges, so
    neither an experiment's draws nor an observation's are in one buffer. ``pred``, read three times,
    is stored.
    """
    pred = stored(pred.select(*keys, draw, *observation, "concentration", "error", "modeled"), "predicted")
    r = (F.col("modeled") - F.col("concentration")) / F.col("error")
    draws = stored(pred.groupBy(*keys, draw).agg(F.sum(r * r).alias("objective"), F.count("*").alias("__m")).withColumn("rms", F.sqrt(F.try_divide(F.col("objective"), F.col("__m")))), "objectives")
    limits = ranked_quantiles(pred, [*keys, *observation], "modeled", {"lo": 0.05, "hi": 0.95})
    seen = pred.groupBy(*keys, *observation).agg(F.max("concentration").alias("concentration")).join(limits, [*keys, *observation])
    covered = seen.groupBy(*keys).agg(F.count("*").alias("n_observations"), F.count_if(F.col("concentration").between(F.col("lo"), F.col("hi"))).alias("covered_n"))
    rows = draws.groupBy(*keys).agg(F.count("*").alias("n_draws"), F.avg("objective").alias("mean"), F.stddev_samp("objective").alias("sd"))
    rows = rows.join(ranked_quantiles(draws, keys, "objective", {"q05": 0.05, "median": 0.5, "q95": 0.95}), keys).join(ranked_quantiles(draws, keys, "rms", {"rms_median": 0.5}), keys).join(covered, keys)
    half = {f"log_likelihood_{a}": -0.5 * F.col(b) for a, b in (("mean", "mean"), ("median", "median"), ("q05", "q95"), ("q95", "q05"))}
    return rows.withColumns({**half, "coverage": F.col("covered_n") / F.col("n_observations")})


def share_below(df: DataFrame, keys: list[str], value: str, limit: float) -> DataFrame:
    rows = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("min"), F.avg((F.col(value) < limit).cast("int")).alias("share_below"))
    return with_quantiles(rows, df, keys, value, {"q05": 0.05, "median": 0.5})


def fraction_errors(df: DataFrame, keys: list[str], a: str, b: str, limits: list[float]) -> DataFrame:
    """Absolute errors of two columns: mean, median, RMS, greatest, and counts within limits."""
    e = F.abs(F.col(a) - F.col(b))
    rows = df.withColumn("__e", e)
    out = rows.groupBy(*keys).agg(F.avg("__e").alias("mae"), F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("rmse"), F.max("__e").alias("max_ae"), *(F.count_if(F.col("__e") <= x).alias(f"within_{i}") for i, x in enumerate(limits)))
    return with_quantiles(out, rows, keys, "__e", {"median_ae": 0.5})


def prior_sensitivity(a: DataFrame, b: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    """Per key: the label whose value changes most, by how much, and half of all absolute changes."""
    rows = a.select(*keys, label, F.col(value).alias("va")).join(b.select(*keys, label, F.col(value).alias("vb")), [*keys, label])
    d = F.col("vb") - F.col("va")
    return rows.withColumn("d", d).groupBy(*keys).agg(F.max_by(label, F.struct(F.round(F.abs("d"), 9), label)).alias("largest"), F.max(F.abs("d")).alias("largest_change"), (F.sum(F.abs("d")) / 2).alias("redistributed"))


def prior_shift(a: DataFrame, b: DataFrame, keys: list[str], near_zero: float = 0.05) -> DataFrame:
    """Per key what another prior changes (``median, q10, q90`` of both): signed, absolute, in percentage points, over the reference's width.

    ``near_zero`` marks keys whose reference median is at most the limit; a width of 0 gives no ratio.
    """
    rows = a.select(*keys, F.col("median").alias("reference"), (F.col("q90") - F.col("q10")).alias("width")).join(b.select(*keys, F.col("median").alias("other")), keys)
    rows = rows.withColumn("change", F.col("other") - F.col("reference")).withColumn("absolute", F.abs("change"))
    over = F.when(F.col("width") > 0, F.col("absolute") / F.col("width"))
    return rows.withColumns({"change_points": 100 * F.col("change"), "absolute_points": 100 * F.col("absolute"), "over_width": over, "near_zero": F.col("reference") <= near_zero})


def prior_shift_groups(shift: DataFrame, by: list[str]) -> DataFrame:
    """Rows of prior_shift() by ``near_zero`` and ``by``: how many, the greatest and mean change, quantiles of the change over the width."""
    keys = [*by, "near_zero"]
    rows = shift.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("absolute_points").alias("mean_points"), F.max("absolute_points").alias("max_points"), F.max("over_width").alias("max_over_width"))
    return with_quantiles(rows, shift, keys, "over_width", {"median_over_width": 0.5, "p90_over_width": 0.9})


def diagnostics_rollup(df: DataFrame, keys: list[str]) -> DataFrame:
    """Over included rows: greatest R-hat, least ESS, greatest MCSE, and whether all qualify and are finite."""
    inc = lambda c: F.when(F.col("included"), F.col(c))
    return df.groupBy(*keys).agg(F.max(inc("rhat")).alias("max_rhat"), F.min(inc("ess")).alias("min_ess"), F.max(inc("mcse")).alias("max_mcse"), F.bool_and(F.when(F.col("included"), F.col("qualified"))).alias("all_qualified"), F.bool_and(~F.isnan("rhat")).alias("all_finite"))


def chain_rollup(df: DataFrame, keys: list[str]) -> DataFrame:
    """Last running acceptance of each chain, then its mean, least and greatest."""
    last = df.groupBy(*keys, "chain").agg(F.max_by("acceptance", "step").alias("last"), F.sum("runtime").alias("runtime"))
    return last.groupBy(*keys).agg(F.avg("last").alias("mean_acceptance"), F.min("last").alias("min_acceptance"), F.max("last").alias("max_acceptance"), F.sum("runtime").alias("runtime"))


def run_results(chains: DataFrame, diagnostics: DataFrame, keys: list[str]) -> DataFrame:
    """chain_rollup() of each run with its chains and what its diagnostics (``included, qualified``) come to.

    ``failed`` counts those that are included and not qualified, ``failed_informational`` those that
    are neither. A run without diagnostics has zeros.
    """
    rows = chain_rollup(chains, keys).join(chains.groupBy(*keys).agg(F.countDistinct("chain").alias("n_chains")), keys)
    seen = diagnostics.groupBy(*keys).agg(F.count("*").alias("n_diagnostics"), F.count_if(F.col("included") & ~F.col("qualified")).alias("failed"), F.count_if(~F.col("included") & ~F.col("qualified")).alias("failed_informational"))
    return rows.join(seen, keys, "left").fillna(0, ["n_diagnostics", "failed", "failed_informational"])


def running_acceptance(df: DataFrame, keys: list[str], order: list[str], accepted: str, out: str = "acceptance") -> DataFrame:
    """Rows with the share of accepted steps so far; steps without a verdict (null) don't count. Chains of any length."""
    known = F.col(accepted).isNotNull()
    rows = df.withColumns({"__yes": F.when(known & F.col(accepted), 1).otherwise(0), "__known": F.when(known, 1).otherwise(0)})
    rows = running(rows, keys, order, {"__a": ("__yes", "sum"), "__b": ("__known", "sum")})
    return rows.withColumn(out, F.try_divide("__a", "__b")).drop("__yes", "__known", "__a", "__b")


def trajectory_summary(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Mean and population deviation without NaN."""
    ok = lambda c: F.when(~F.isnan(c), F.col(c))
    return df.groupBy(*keys).agg(*(x for c in columns for x in (F.avg(ok(c)).alias(f"{c}_mean"), F.stddev_pop(ok(c)).alias(f"{c}_std"))))


def pooled_covariance(wide: DataFrame, group: list[str], params: list[str], ridge: float) -> DataFrame:
    """``row, col, value``: the pooled within-group covariance with a relative ridge on the diagonal.

    Sums of products are plain aggregates of one pass; nothing is joined to itself.
    """
    means = wide.groupBy(*group).agg(F.count("*").alias("n"), *(F.covar_samp(a, b).alias(f"{a}|{b}") for a in params for b in params))
    pooled = means.agg(*(((F.sum(F.col(f"`{a}|{b}`") * (F.col("n") - 1))) / F.sum(F.col("n") - 1)).alias(f"{a}|{b}") for a in params for b in params))
    trace = sum((F.col(f"`{a}|{a}`") for a in params), F.lit(0.0))
    eps = ridge * F.greatest(trace / len(params), F.lit(1e-12))
    cells = F.array(*(F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), (F.col(f"`{a}|{b}`") + (eps if a == b else 0.0)).alias("value")) for a in params for b in params))
    return pooled.select(F.inline(cells))


def argmin_column(df: DataFrame, columns: list[str], out: str = "best") -> DataFrame:
    """The name of the column with the least value; nulls don't count."""
    pairs = F.filter(F.array(*(F.struct(F.col(c).alias("score"), F.lit(c).alias("name")) for c in columns)), lambda x: x["score"].isNotNull())
    return df.withColumn(out, F.array_min(pairs)["name"])


def representative_draw(wide: DataFrame, keys: list[str], params: list[str], order: list[str], scaled: bool = True) -> DataFrame:
    """The draw nearest to the medians of all parameters, each scaled by its deviation unless ``scaled`` is false.

    Medians, one row a key, are stored: below the session's broadcast threshold they are sent to the
    draws, so that a key's draws stay where they are.
    """
    mid = wide.groupBy(*keys).agg(*((F.stddev_samp(p) if scaled else F.lit(1.0)).alias(f"__s_{p}") for p in params))
    for p in params:
        mid = with_quantiles(mid, wide, keys, p, {f"__m_{p}": 0.5})
    rows = wide.join(stored(mid, "medians"), keys)
    d = sum((F.coalesce(F.pow(F.try_divide(F.col(p) - F.col(f"__m_{p}"), F.col(f"__s_{p}")), F.lit(2.0)), F.lit(0.0)) for p in params), F.lit(0.0))
    return rows.withColumn("distance", d).groupBy(*keys).agg(F.min_by(F.struct(*order), F.struct(F.round("distance", 9), *order)).alias("draw"), F.min("distance").alias("distance")).select(*keys, "draw.*", "distance")


def representative_residuals(draw: DataFrame, fits: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The data of each representative draw with ``residual`` (observed less modeled), ``standardised, contribution, objective_total``.

    ``draw`` is what representative_draw() gives, ``fits`` has a row for each draw and datum (``observed,
    error, modeled``). Only the chosen draws' rows are left before totals are made: these, one a key, are
    stored and, below the session's broadcast threshold, sent to the data.
    """
    rows = fits.join(stored(draw.select(*keys, *order), "chosen"), [*keys, *order])
    rows = rows.withColumn("residual", F.col("observed") - F.col("modeled")).withColumn("standardised", F.try_divide("residual", "error")).withColumn("contribution", F.col("standardised") * F.col("standardised"))
    total = rows.groupBy(*keys).agg(F.sum("contribution").alias("objective_total"))
    return rows.join(total, keys)


def change_audit(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose multiset counts differ between two tables."""
    a, b = old.groupBy(*keys).agg(F.count("*").alias("n_old")), new.groupBy(*keys).agg(F.count("*").alias("n_new"))
    rows = a.join(b, keys, "full").select(*keys, F.coalesce("n_old", F.lit(0)).alias("n_old"), F.coalesce("n_new", F.lit(0)).alias("n_new"))
    return rows.where("n_old <> n_new")


def relative_uncertainty(df: DataFrame, keys: list[str]) -> DataFrame:
    t = 2 * F.col("target")
    return df.select(*keys, F.try_divide(F.col("q90") - F.col("q10"), t).alias("u80"), F.try_divide(F.col("q975") - F.col("q025"), t).alias("u95"), F.try_divide("sd", "mean").alias("cv"))


def accuracy_summary(df: DataFrame, keys: list[str], error: str, name: str) -> DataFrame:
    rows = df.groupBy(*keys).agg(F.count("*").alias("n"), F.max(error).alias("max"), F.max_by(name, F.struct(error, name)).alias("worst"))
    return with_quantiles(rows, df, keys, error, {"median": 0.5, "p95": 0.95, "p99": 0.99})


def column_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """``metric, n, median, p95, max``: a row for each numeric column; nulls and NaN don't count."""
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns))))
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    rows = long.groupBy("metric").agg(F.count("*").alias("n"), F.max("value").alias("max"))
    return with_quantiles(rows, long, ["metric"], "value", {"median": 0.5, "p95": 0.95})


def coverage_mass(df: DataFrame, keys: list[str], mass: str) -> DataFrame:
    """The median covered mass of each group, and how many rows it has."""
    return with_quantiles(df.groupBy(*keys).agg(F.count(mass).alias("n")), df, keys, mass, {"covered": 0.5})


def rank_conventions(df: DataFrame, convention: str, a: str, b: str) -> DataFrame:
    """Errors of each convention's values, with its ``place`` by RMSE; the best one has 1."""
    rows = fraction_errors(df, [convention], a, b, [])
    return rows.withColumn("place", F.row_number().over(Window.orderBy("rmse", convention)))  # one row a convention


def error_sensitivity(df: DataFrame, by: list[str], case: str, value: str) -> DataFrame:
    """The mean of case means at each error level, so that cases count alike."""
    per = df.groupBy(*by, case).agg(F.avg(value).alias("m"))
    return per.groupBy(*by).agg(F.count("*").alias("n_cases"), F.avg("m").alias("mean"))


def study_tables(stats: DataFrame, tables: dict[str, dict]) -> DataFrame:
    """``table`` and a statistics row for each table that the row is in, in one pass.

    A table is given by ``prefixes`` of its experiments and by allowed values of other columns.
    """
    named = []
    for name, rule in tables.items():
        inside = reduce(lambda x, y: x | y, (F.col("experiment_id").startswith(p) for p in rule["prefixes"]))
        for column, allowed in rule.items():
            if column != "prefixes":
                inside = inside & F.col(column).isin(allowed)
        named.append(F.when(inside, F.lit(name)))
    return stats.select(F.explode(F.array_compact(F.array(*named))).alias("table"), "*")


def campaign_inventory(manifests: DataFrame, matrix: DataFrame) -> DataFrame:
    """Manifests with their row of the matrix and ``runtime_hours``; an experiment that the matrix lacks is an error."""
    rows = manifests.join(matrix.withColumn("__known", F.lit(True)), "experiment_id", "left")
    hours = (F.unix_micros("finished") - F.unix_micros("started")) / 3.6e9
    known = F.when(F.col("__known"), F.col("experiment_id")).otherwise(F.raise_error(F.concat(F.lit("not in the matrix: "), F.col("experiment_id").cast("string"))))
    return rows.withColumn("runtime_hours", hours).withColumn("experiment_id", known.cast(manifests.schema["experiment_id"].dataType)).drop("__known")


def publication_cases(draws: DataFrame, acceptance: DataFrame, params: list[str], least: float = 0.05) -> DataFrame:
    """A row for each case: window, best objective, statistics of each parameter, acceptance and whether it is low.

    ``draws`` has ``well, mode, start, end, lpm, obj_function`` and the parameters; of a well's full
    spans only the longest count. ``acceptance`` has a rate for each case.
    """
    case = ["well", "mode", "start", "end", "lpm"]
    span = draws.where("mode = 'span_full'").groupBy("well", "lpm").agg(F.max(F.col("end") - F.col("start")).alias("__longest"))
    kept = draws.join(span, ["well", "lpm"], "left").where("mode <> 'span_full' or `end` - start = __longest").drop("__longest")
    rows = kept.groupBy(*case).agg(F.count("*").alias("samples"), F.min("obj_function").alias("best"), *(x for p in params for x in (F.avg(p).alias(f"{p}_mean"), F.stddev_samp(p).alias(f"{p}_sd"))))
    for p in params:
        rows = with_quantiles(rows, kept, case, p, {f"{p}_q10": 0.1, f"{p}_median": 0.5, f"{p}_q90": 0.9})
    return rows.join(acceptance, case, "left").withColumn("low_acceptance", F.col("acceptance") < least)


def well_table(comparison: DataFrame, diagnostics: DataFrame, fractions: list[str], values: list[str]) -> DataFrame:
    """A row for each well: a column for each fraction and value, and the roll-up of its convergence."""
    wide = comparison.groupBy("well").agg(*(F.max(F.when(F.col("fraction") == f, F.col(v))).alias(f"{f}_{v}") for f in fractions for v in values))
    roll = diagnostics.groupBy("well").agg(F.max("rhat").alias("max_rhat"), F.min("ess").alias("min_ess"), F.bool_and("converged").alias("converged"))
    return wide.join(roll, "well", "left")


def tool_table(df: DataFrame, keys: list[str], tools: list[str], expected: int, within: float, strict: bool = True) -> DataFrame:
    """Tools side by side against the truth: statistics of each, how many pass, and paired differences.

    ``df`` has a row for each seed with ``truth`` and a column for each tool. A campaign of another
    size than ``expected`` is an error, or with ``strict`` off is marked and has no statistics.
    """
    whole = F.count("*") == expected
    checked = F.when(whole, True).otherwise(F.raise_error(F.concat(F.lit("incomplete campaign: "), F.count("*").cast("string"), F.lit(f" of {expected}"))).cast("boolean")) if strict else whole
    stats = []
    for t in tools:
        e = F.col(t) - F.col("truth")
        stats += [F.avg(t).alias(f"{t}_mean"), F.stddev_samp(t).alias(f"{t}_sd"), F.avg(e).alias(f"{t}_bias"), F.sqrt(F.avg(e * e)).alias(f"{t}_rmse"), F.count_if(F.abs(e) <= within * F.abs("truth")).alias(f"{t}_passes")]
    for t in tools[1:]:
        d = F.col(t) - F.col(tools[0])
        stats += [F.avg(d).alias(f"{t}_minus_{tools[0]}"), F.sqrt(F.avg(d * d)).alias(f"{t}_rms_to_{tools[0]}")]
    rows = df.groupBy(*keys).agg(F.count("*").alias("n"), checked.alias("complete"), *stats)
    names = [c for c in rows.columns if c not in (*keys, "n", "complete")]
    return rows.select(*keys, "n", "complete", *(F.when(F.col("complete"), F.col(c)).alias(c) for c in names))
