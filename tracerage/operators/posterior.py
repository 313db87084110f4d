"""Parameter grids, misfit, posterior weights and draws, cases and campaigns (F rows)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import uniform
from ..functions.special import normal_cdf, normal_inverse
from ..sources.io import stored
from .clean import duplicate_keys
from .order import ranked, value_places


def parameter_grid(catalogue: DataFrame, n: int, params: list[str]) -> DataFrame:
    """``model, grid_id`` and a column for each parameter: ceil(n ** (1/d)) intervals of each range, row-major."""
    steps = max(1, math.ceil(n ** (1 / len(params)) - 1e-9))
    out = None
    for name in params:
        axis = catalogue.where(F.col("name") == name).select("model", F.col("cal_lo").alias("__lo"), F.col("cal_hi").alias("__hi"), F.posexplode(F.sequence(F.lit(0), F.lit(steps))).alias("__at", "__i"))
        axis = axis.select("model", F.col("__at").alias(f"__{name}"), (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__i") / steps).alias(name))
        out = axis if out is None else out.join(axis, "model")
    grid_id = reduce(lambda acc, name: acc * (steps + 1) + F.col(f"__{name}"), params, F.lit(0).cast("long"))
    return out.select("model", grid_id.alias("grid_id"), *params)


def misfit(pred: DataFrame, obs: DataFrame, on: list[str], keys: list[str]) -> DataFrame:
    """``keys, n, chi2, rms``: squared normalised residuals of predictions (``modeled``) summed per draw.

    Predictions are the bounded side (a grid times sampling dates): stored, they are sent to the
    observations only below the session's broadcast threshold. Keys may come from either side.
    """
    more = [k for k in keys if k in obs.columns and k not in on]
    rows = obs.select(*on, *more, "concentration", "error").join(stored(pred, "predictions"), on)
    checked = F.when(F.col("error") > 0, F.col("error")).otherwise(F.raise_error(F.lit("an error is not positive")).cast("double"))
    r = (F.col("modeled") - F.col("concentration")) / checked
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(r * r).alias("chi2")).withColumn("rms", F.sqrt(F.col("chi2") / F.col("n")))


def objective_surface(df: DataFrame) -> DataFrame:
    """Misfit rows with the logarithmic objective and what follows from it: J = chi2 / 2 and the RMS."""
    return df.withColumn("objective", 0.5 * F.log(F.greatest(F.col("chi2"), F.lit(2.2250738585072014e-308)))).withColumn("j", F.col("chi2") / 2)


def reachable(pred: DataFrame, a: str, b: str, digits: int | None = None) -> DataFrame:
    """``grid_id, a, b``: what a grid predicts for two tracers side by side, a row for each point."""
    value = F.col("modeled") if digits is None else F.round("modeled", digits)
    return pred.groupBy("grid_id").agg(*(F.max(F.when(F.col("tracer") == t, value)).alias(t) for t in (a, b)))


def surface_matrix(df: DataFrame, x: str, y: str, v: str, values: list) -> DataFrame:
    return df.groupBy(y).pivot(x, values).agg(F.first(v))


def truth_surface(grid: DataFrame, truth: DataFrame, relative: float, floor: float, on: list[str]) -> DataFrame:
    """``case_id, least, best``: the grid point that fits a case's own data best.

    Data meet predictions by ``on`` (a case's id and what names a datum); residuals are scaled by
    max(relative * observed, floor * the history's top).
    """
    rows = grid.join(truth, on)
    scale = F.greatest(relative * F.abs("observed"), floor * F.col("top"))
    got = rows.groupBy("case_id", "grid_id").agg(F.sum(F.pow((F.col("modeled") - F.col("observed")) / scale, F.lit(2.0))).alias("chi2"))
    return got.groupBy("case_id").agg(F.min("chi2").alias("least"), F.min_by("grid_id", F.struct("chi2", "grid_id")).alias("best"))


def _steps(lo: float, hi: float):
    return lambda share: lo + F.lit(hi - lo) * share


def _ratios(lo: float, hi: float):
    return lambda share: lo * F.pow(F.lit(hi / lo), share)


def axis_grid(truth: DataFrame, axes: dict[str, tuple[float, float, bool]], n: int) -> DataFrame:
    """``case_id, grid_id, is_true`` and a column for each axis: every case's own grid, its true point among it.

    An axis goes from lo to hi in n - 1 steps, in equal ratios if its flag says so (log), and has the
    case's true value (a column of ``truth`` of the axis' name) besides; values that are there already come
    once. ``grid_id`` counts the points of a case row-major, in ascending values.
    """
    rows = truth.select("case_id", *(F.col(a).alias(f"__t_{a}") for a in axes))
    for a, (lo, hi, log) in axes.items():
        if log and not 0 < lo < hi:
            raise ValueError(f"axis {a} can't be in equal ratios from {lo} to {hi}")
        share = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i / (n - 1))
        steps = F.transform(share, _ratios(lo, hi) if log else _steps(lo, hi))
        values = F.array_sort(F.array_distinct(F.concat(steps, F.array(F.col(f"__t_{a}").cast("double")))))
        rows = rows.withColumn(f"__n_{a}", F.size(values)).select("*", F.posexplode(values).alias(f"__i_{a}", a))
    grid_id = reduce(lambda acc, a: acc * F.col(f"__n_{a}") + F.col(f"__i_{a}"), axes, F.lit(0).cast("long"))
    true = reduce(lambda acc, a: acc & (F.col(a) == F.col(f"__t_{a}")), axes, F.lit(True))
    return rows.select("case_id", grid_id.alias("grid_id"), true.alias("is_true"), *axes)


def case_surface(grid: DataFrame, data: DataFrame, predict, relative: float, floor: float, on: list[str]) -> DataFrame:
    """``case_id, grid_id, is_true`` and the axes with ``chi2``: each case's data against its own grid of axis_grid().

    ``predict`` gives predictions (``case_id, grid_id``, ``on``, ``modeled``) of a table of draws; residuals
    are scaled by max(relative * observed, floor * top) of the data (``case_id``, ``on``, ``observed, top``).
    """
    scale = F.greatest(relative * F.abs("observed"), floor * F.col("top"))
    rows = predict(grid).join(data, ["case_id", *on])
    chi = rows.groupBy("case_id", "grid_id").agg(F.sum(F.pow((F.col("modeled") - F.col("observed")) / scale, F.lit(2.0))).alias("chi2"))
    return grid.join(chi, ["case_id", "grid_id"])


def surface_summary(surface: DataFrame, axes: list[str], digits: int = 9) -> DataFrame:
    """``case_id, n_points, true_chi2, least`` and the axes at the least: rounded chi2 first, then grid_id."""
    at = F.struct(F.round("chi2", digits), "grid_id")
    return surface.groupBy("case_id").agg(F.count("*").alias("n_points"), F.max(F.when(F.col("is_true"), F.col("chi2"))).alias("true_chi2"), F.min("chi2").alias("least"), *(F.min_by(a, at).alias(a) for a in axes))


def log_prior(draws: DataFrame, catalogue: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, log_prior``: normal or uniform log-densities summed over parameters; minus infinity outside.

    ``catalogue`` has ``param, prior, mean, std, cal_lo, cal_hi``.
    """
    rows = draws.join(F.broadcast(catalogue), "param")
    return rows.groupBy(*keys).agg(F.sum(log_density(F.col("value"), {c: F.col(c) for c in PRIOR})).alias("log_prior"))


PRIOR = ["prior", "mean", "std", "cal_lo", "cal_hi"]


def log_density(x: Column, p: Column | dict[str, Column]) -> Column:
    """A prior's log-density at x, minus infinity outside of its range; ``p`` has a catalogue row's columns."""
    inside = x.between(p["cal_lo"], p["cal_hi"])
    normal = -0.5 * F.pow((x - p["mean"]) / p["std"], F.lit(2.0)) - F.log(p["std"]) - 0.5 * math.log(2 * math.pi)
    return F.when(~inside, F.lit(float("-inf"))).when(p["prior"] == "normal", normal).otherwise(-F.log(p["cal_hi"] - p["cal_lo"]))


def log_prior_wide(draws: DataFrame, catalogue: DataFrame, params: list[str]) -> DataFrame:
    """The same for draws with a column for each parameter: a row's densities are summed in the row, nothing is shuffled.

    The catalogue, a few rows, goes to all tasks as one array. As in log_prior(), null densities
    don't count, a draw without any has null, and one without a known parameter goes.
    """
    known = catalogue.where(F.col("param").isin(params)).groupBy().agg(F.collect_list(F.struct("param", *PRIOR)).alias("__priors")).where(F.size("__priors") > 0)
    value = F.create_map(*(c for p in params for c in (F.lit(p), F.col(p).cast("double"))))
    rows = draws.crossJoin(F.broadcast(known)).withColumn("__values", value)
    each = F.filter(F.transform("__priors", lambda p: log_density(F.try_element_at("__values", p["param"]), p)), lambda d: d.isNotNull())
    total = F.when(F.size(each) > 0, F.aggregate(each, F.lit(0.0), lambda acc, d: acc + d))
    return rows.withColumn("log_prior", total).drop("__priors", "__values")


def empirical_prior(hist: DataFrame, lo: float, hi: float, n: int, keys: list[str], rate: float) -> DataFrame:
    """``keys, x, density``: a histogram's densities (``x, density``) on n points of [lo, hi], mass 1.

    Linear between its points, exponential tails of the given rate beyond them.
    """
    w = Window.partitionBy(*keys).orderBy("x")
    seg = hist.select(*keys, F.col("x").alias("x1"), F.col("density").alias("d1"), F.lead("x").over(w).alias("x2"), F.lead("density").over(w).alias("d2"))
    ends = hist.groupBy(*keys).agg(F.min("x").alias("a"), F.min_by("density", "x").alias("da"), F.max("x").alias("b"), F.max_by("density", "x").alias("db"))
    pts = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).withColumn("x", lo + (hi - lo) * F.col("i") / (n - 1))
    # A histogram has a bounded number of points per group; the range is looked up within its group.
    segs = seg.where("x2 is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x1", "d1", "x2", "d2"))).alias("segs"))
    rows = pts.join(segs, keys)
    x = F.col("x")
    s = F.try_element_at(F.filter("segs", lambda g: (g["x1"] <= x) & (x <= g["x2"])), F.lit(1))
    inner = s["d1"] + (s["d2"] - s["d1"]) * (x - s["x1"]) / (s["x2"] - s["x1"])
    raw = F.when(x < F.col("a"), F.col("da") * F.exp(-rate * (F.col("a") - x))).when(x > F.col("b"), F.col("db") * F.exp(-rate * (x - F.col("b")))).otherwise(inner)
    rows = rows.select(*keys, "x", raw.alias("raw"))
    w = Window.partitionBy(*keys).orderBy("x")
    rows = rows.withColumn("__t", (F.col("x") - F.lag("x").over(w)) * (F.col("raw") + F.lag("raw").over(w)) / 2)
    return rows.withColumn("density", F.col("raw") / F.sum("__t").over(Window.partitionBy(*keys))).select(*keys, "x", "density")


def cumtrapz(df: DataFrame, keys: list[str], x: str, y: str, out: str = "cumulative") -> DataFrame:
    """The running trapezoid integral of y over x, 0 at the first x."""
    w = Window.partitionBy(*keys).orderBy(x)
    rows = df.withColumn("__t", F.coalesce((F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2, F.lit(0.0)))
    return rows.withColumn(out, F.sum("__t").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__t")


def density_quantile(grid: DataFrame, keys: list[str], p: float) -> DataFrame:
    """``keys, quantile`` of tabulated densities: the cell that p falls in, inverted as a parabola."""
    rows = cumtrapz(grid, keys, "x", "density")
    w = Window.partitionBy(*keys).orderBy("x")
    rows = rows.select(*keys, F.col("x").alias("x1"), F.col("density").alias("d1"), F.col("cumulative").alias("c1"), F.lead("x").over(w).alias("x2"), F.lead("density").over(w).alias("d2"), F.lead("cumulative").over(w).alias("c2"), F.max("cumulative").over(Window.partitionBy(*keys)).alias("total"))
    want = p * F.col("total")
    cell = rows.where("x2 is not null").where((F.col("c1") <= want) & (want < F.col("c2")))
    slope, need = (F.col("d2") - F.col("d1")) / (F.col("x2") - F.col("x1")), want - F.col("c1")
    step = 2 * need / (F.col("d1") + F.sqrt(F.greatest(F.col("d1") * F.col("d1") + 2 * slope * need, F.lit(0.0))))
    return cell.select(*keys, (F.col("x1") + F.coalesce(step, F.lit(0.0))).alias("quantile"))


def prior_moments(catalogue: DataFrame) -> DataFrame:
    """``prior_mean, prior_std`` of bounded uniform and of truncated normal marginals."""
    a, b = (F.col("cal_lo") - F.col("mean")) / F.col("std"), (F.col("cal_hi") - F.col("mean")) / F.col("std")
    pdf = lambda z: F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    mass = normal_cdf(b) - normal_cdf(a)
    shift = (pdf(a) - pdf(b)) / mass
    var = 1 + (a * pdf(a) - b * pdf(b)) / mass - shift * shift
    mean = F.when(F.col("prior") == "normal", F.col("mean") + F.col("std") * shift).otherwise((F.col("cal_lo") + F.col("cal_hi")) / 2)
    std = F.when(F.col("prior") == "normal", F.col("std") * F.sqrt(var)).otherwise((F.col("cal_hi") - F.col("cal_lo")) / math.sqrt(12))
    return catalogue.withColumn("prior_mean", mean).withColumn("prior_std", std)


def grid_posterior(surface: DataFrame, case: str = "case_id", log_prior: str | None = None) -> DataFrame:
    """Weights of grid points per case: exp(-chi2/2 + log prior), shifted by the case's maximum, normalised.

    Two aggregations per case are joined back, so a case may hold any number of points. ``evidence``
    is the log of the mean unnormalised weight.
    """
    logw = -0.5 * F.col("chi2") + (F.col(log_prior) if log_prior else F.lit(0.0))
    rows = surface.withColumn("logw", logw)
    top = rows.groupBy(case).agg(F.max("logw").alias("__top"))
    rows = rows.join(top, case).withColumn("__u", F.exp(F.col("logw") - F.col("__top")))
    total = rows.groupBy(case).agg(F.sum("__u").alias("__sum"), F.count("*").alias("__n"))
    rows = rows.join(total, case).withColumn("weight", F.col("__u") / F.col("__sum"))
    return rows.withColumn("evidence", F.col("__top") + F.log(F.col("__sum") / F.col("__n"))).drop("__top", "__u", "__sum", "__n")


def weighted_summary(weights: DataFrame, params: list[str], case: str = "case_id") -> DataFrame:
    """Posterior mean, deviation and covariance of one or two parameters."""
    aggs = []
    for p in params:
        aggs += [F.sum(F.col("weight") * F.col(p)).alias(f"{p}_mean"), F.sum(F.col("weight") * F.col(p) * F.col(p)).alias(f"__{p}2")]
    if len(params) == 2:
        aggs.append(F.sum(F.col("weight") * F.col(params[0]) * F.col(params[1])).alias("__xy"))
    rows = weights.groupBy(case).agg(*aggs, F.max("evidence").alias("evidence"))
    for p in params:
        rows = rows.withColumn(f"{p}_std", F.sqrt(F.greatest(F.col(f"__{p}2") - F.col(f"{p}_mean") * F.col(f"{p}_mean"), F.lit(0.0)))).drop(f"__{p}2")
    if len(params) == 2:
        rows = rows.withColumn("cov", F.col("__xy") - F.col(f"{params[0]}_mean") * F.col(f"{params[1]}_mean")).drop("__xy")
    return rows


def weighted_quantile(weights: DataFrame, param: str, p: float, case: str = "case_id") -> DataFrame:
    """The least value whose cumulative weight reaches p."""
    places = value_places(weights, [case], param, "weight")
    return places.where(F.col("before") + F.col("count") >= p - 1e-12).groupBy(case).agg(F.min("value").alias("quantile"))


def posterior_draws(weights: DataFrame, n: int, seed: int, case: str = "case_id") -> DataFrame:
    """n reproducible draws of whole grid rows per case, by where a hashed uniform falls in the cumulative weights."""
    places = value_places(weights, [case], "grid_id", "weight").select(case, F.col("value").alias("grid_id"), F.col("before").alias("lo"), (F.col("before") + F.col("count")).alias("hi"))
    cum = weights.join(places, [case, "grid_id"])
    cells = cum.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * 64).cast("int"), F.least(F.floor(F.col("hi") * 64), F.lit(63)).cast("int"))))
    us = weights.select(case).distinct().select(case, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw")).withColumn("u", uniform("draw", seed, F.col(case), F.col("draw"))).withColumn("cell", F.floor(F.col("u") * 64).cast("int"))
    hit = us.join(cells, [case, "cell"]).where("u >= lo and u < hi")
    return hit.drop("cell", "u", "lo", "hi")


def distinct_draws(weights: DataFrame, n: int, seed: int, case: str = "case_id", salts: int = 32) -> DataFrame:
    """n reproducible draws of whole grid rows per case without replacement, ``draw`` from 0 in the order drawn.

    Each row gets the exponential time -ln(u) / weight of its own hashed uniform; the n first ones
    are a successive weighted draw. The first n are kept in each of ``salts`` parts of a case, then
    of what is left: no task sees a whole case. Rows without weight are never drawn; a case with
    fewer rows gives all it has.
    """
    time = -F.log(uniform("distinct", seed, F.col(case), F.col("grid_id"))) / F.col("weight")
    rows = weights.where("weight > 0").withColumn("__time", time).withColumn("__salt", F.pmod(F.xxhash64(case, "grid_id"), F.lit(salts)))
    first = Window.partitionBy(case, "__salt").orderBy("__time", "grid_id")
    rows = rows.withColumn("draw", F.row_number().over(first)).where(F.col("draw") <= n).drop("draw", "__salt")
    last = Window.partitionBy(case).orderBy("__time", "grid_id")
    return rows.withColumn("draw", F.row_number().over(last) - 1).where(F.col("draw") < n).drop("__time")


def tabulated_priors(catalogue: DataFrame, histograms: DataFrame | None = None, cells: int = 400) -> DataFrame:
    """``param, cell, x1, x2, d1, d2, c1, c2``: priors of a catalogue as linear densities on equal cells of their ranges.

    ``uniform`` and ``normal`` (cut off at the range) from ``param, prior, mean, std, cal_lo,
    cal_hi``; ``empirical`` ones are cells between the points of ``histograms`` (``param, x,
    density``) within the range. c1 and c2 are cumulative shares, the last one 1.
    """
    x = F.col("cal_lo") + (F.col("cal_hi") - F.col("cal_lo")) * F.col("cell") / cells
    rows = catalogue.where("prior <> 'empirical'").select("*", F.explode(F.sequence(F.lit(0), F.lit(cells))).alias("cell"))
    shape = F.when(F.col("prior") == "normal", F.exp(-0.5 * F.pow((x - F.col("mean")) / F.col("std"), F.lit(2.0)))).otherwise(1.0)
    points = rows.select("param", x.alias("x"), shape.alias("d"))
    if histograms is not None:
        ranges = catalogue.where("prior = 'empirical'").select("param", "cal_lo", "cal_hi")
        points = points.unionByName(histograms.join(ranges, "param").where("x between cal_lo and cal_hi").select("param", "x", F.col("density").alias("d")))
    w = Window.partitionBy("param").orderBy("x")  # as many rows as a parameter's prior has cells
    segments = points.select("param", (F.row_number().over(w) - 1).alias("cell"), F.col("x").alias("x1"), F.col("d").alias("d1"), F.lead("x").over(w).alias("x2"), F.lead("d").over(w).alias("d2")).where("x2 is not null")
    area = (F.col("x2") - F.col("x1")) * (F.col("d1") + F.col("d2")) / 2
    total = F.sum(area).over(Window.partitionBy("param"))
    shares = segments.withColumn("__total", total).withColumn("c2", F.sum(area).over(w.orderBy("x1").rowsBetween(Window.unboundedPreceding, 0)) / F.col("__total"))
    return shares.select("param", "cell", "x1", "x2", (F.col("d1") / F.col("__total")).alias("d1"), (F.col("d2") / F.col("__total")).alias("d2"), (F.col("c2") - area / F.col("__total")).alias("c1"), "c2")


def prior_quantiles(tables: DataFrame, wanted: DataFrame, grain: int = 64) -> DataFrame:
    """``wanted`` (``param, p`` and others) with ``value``: where the cumulative prior reaches p.

    An interval join: cells of a prior are looked up by the 1/grain of probability that they touch,
    so a share meets the few cells there, not all of them; within a cell the linear density is
    inverted in closed form.
    """
    band = lambda c: F.least(F.floor(c * grain), F.lit(grain - 1)).cast("int")
    cells = tables.where("c2 > c1").withColumn("__band", F.explode(F.sequence(band(F.greatest(F.col("c1"), F.lit(0.0))), band(F.least(F.col("c2"), F.lit(1.0))))))
    hit = wanted.withColumn("__band", band(F.col("p"))).join(cells, ["param", "__band"])
    top = F.when(F.col("c2") >= 1 - 1e-12, F.col("p") <= F.col("c2") + 1e-9).otherwise(F.col("p") < F.col("c2"))
    low = (F.col("p") >= F.col("c1")) | (F.col("c1") <= 1e-12)
    need, slope = F.greatest(F.col("p") - F.col("c1"), F.lit(0.0)), (F.col("d2") - F.col("d1")) / (F.col("x2") - F.col("x1"))
    step = F.try_divide(2 * need, F.col("d1") + F.sqrt(F.greatest(F.col("d1") * F.col("d1") + 2 * slope * need, F.lit(0.0))))
    return hit.where(low & top).select(*wanted.columns, F.least(F.col("x1") + F.coalesce(step, F.lit(0.0)), F.col("x2")).alias("value"))


def quantile_design(catalogue: DataFrame, tables: DataFrame, n: int, seed: int) -> DataFrame:
    """``model, member, param, stratum, value``: starts in strata of equal prior probability, a permutation for each parameter."""
    strata = stratified_design(catalogue.withColumnRenamed("param", "name"), n, seed)
    key = uniform("jitter", seed, F.col("model"), F.col("name"), F.col("member"))
    wanted = strata.select("model", "member", F.col("name").alias("param"), "stratum", ((F.col("stratum") + key) / n).alias("p"))
    return prior_quantiles(tables, wanted).drop("p")


def table_moments(tables: DataFrame) -> DataFrame:
    """``param, prior_mean, prior_var`` of tabulated priors, exact for their linear densities."""
    a, b, da, db = F.col("x1"), F.col("x2"), F.col("d1"), F.col("d2")
    h = b - a
    mass = h * (da + db) / 2
    first = h * h * (da + 2 * db) / 6
    second = h * h * h * (da + 3 * db) / 12
    got = tables.groupBy("param").agg(F.sum(mass).alias("__m"), F.sum(a * mass + first).alias("__x"), F.sum(a * a * mass + 2 * a * first + second).alias("__xx"))
    mean = F.col("__x") / F.col("__m")
    return got.select("param", mean.alias("prior_mean"), (F.col("__xx") / F.col("__m") - mean * mean).alias("prior_var"))


def prior_check(draws: DataFrame, tables: DataFrame) -> DataFrame:
    """``case_id, param, n, mean, var, prior_mean, prior_var, mean_percent, var_percent, distance``: draws against their prior.

    Differences in percent of the prior's moments (null of a moment that is 0), and the greatest
    distance between the draws' and the prior's cumulative functions. Draws (``case_id, param,
    value``, ``weight`` if there is one) are counted by value in ranges; the prior's function is
    looked up at each distinct value in the cell that holds it, before and after the value's own step.
    """
    weight = "weight" if "weight" in draws.columns else None
    own = F.col(weight) if weight else F.lit(1.0)
    x = F.col("value")
    moments = draws.withColumn("__w", own).groupBy("case_id", "param").agg(F.count("*").alias("n"), (F.sum(F.col("__w") * x) / F.sum("__w")).alias("mean"), (F.sum(F.col("__w") * x * x) / F.sum("__w")).alias("__xx"))
    moments = moments.withColumn("var", F.greatest(F.col("__xx") - F.col("mean") * F.col("mean"), F.lit(0.0))).drop("__xx").join(table_moments(tables), "param")
    places = value_places(draws, ["case_id", "param"], "value", weight)
    # Each prior's cells are equal or bounded in number: one array for each parameter.
    cells = tables.groupBy("param").agg(F.array_sort(F.collect_list(F.struct("x1", "x2", "d1", "d2", "c1"))).alias("cells"))
    rows = places.join(cells, "param")
    cell = F.try_element_at(F.filter("cells", lambda c: c["x1"] <= F.col("value")), F.lit(-1))
    t = F.least(F.col("value"), cell["x2"]) - cell["x1"]
    prior = F.coalesce(F.least(cell["c1"] + cell["d1"] * t + (cell["d2"] - cell["d1"]) * t * t / (2 * (cell["x2"] - cell["x1"])), F.lit(1.0)), F.lit(0.0))
    rows = rows.withColumn("__f", prior)
    gap = F.greatest(F.abs(F.col("before") / F.col("total") - F.col("__f")), F.abs((F.col("before") + F.col("count")) / F.col("total") - F.col("__f")))
    far = rows.groupBy("case_id", "param").agg(F.max(gap).alias("distance"))
    percent = lambda v, p: F.try_divide(100.0 * (F.col(v) - F.col(p)), F.abs(F.col(p)))
    return moments.join(far, ["case_id", "param"]).select("case_id", "param", "n", "mean", "var", "prior_mean", "prior_var", percent("mean", "prior_mean").alias("mean_percent"), percent("var", "prior_var").alias("var_percent"), "distance")


def resample_obs(obs: DataFrame, n: int, seed: int, keys: list[str]) -> DataFrame:
    """n resamplings of each observation from its normal error, cut off at 0."""
    rows = obs.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample"))
    u = uniform("noise", seed, *(F.col(k) for k in keys), F.col("sample"))
    # Columns of their own: the inverse uses its argument many times.
    rows = rows.withColumn("__low", normal_cdf(-F.col("concentration") / F.col("error"))).withColumn("__p", F.col("__low") + (1 - F.col("__low")) * u)
    return rows.withColumn("resampled", F.greatest(F.col("concentration") + F.col("error") * normal_inverse(F.col("__p")), F.lit(0.0))).drop("__low", "__p")


def fuq(pred: DataFrame, resampled: DataFrame, on: list[str]) -> DataFrame:
    """The best grid point of each resampling: ``case_id, sample, grid_id, chi2``."""
    r = (F.col("modeled") - F.col("resampled")) / F.col("error")
    chi = resampled.join(stored(pred, "predictions"), on).groupBy("case_id", "sample", "grid_id").agg(F.sum(r * r).alias("chi2"))
    return chi.groupBy("case_id", "sample").agg(F.min_by("grid_id", F.struct(F.round("chi2", 9), "grid_id")).alias("grid_id"), F.min("chi2").alias("chi2"))


def best_fit(data: DataFrame, lo: float, hi: float, model, levels: int = 6, n: int = 16) -> DataFrame:
    """``case_id, x, objective``: nested one-parameter grids for all cases at once.

    ``data`` has ``case_id, at, observed, error``; ``model(x, at)`` is a Column. Each level lays n
    intervals over a case's range and goes on one interval to both sides of the best point. Data
    are stored by case once; each level is a stored job of one row a case.
    """
    ranges = data.select("case_id").distinct().withColumns({"lo": F.lit(lo), "hi": F.lit(hi)})
    data = stored(data.repartition("case_id"), "best-fit-data")
    for _ in range(levels):
        grid = ranges.select("*", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("i")).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / n)
        rows = grid.join(data, "case_id")
        r = (model(F.col("x"), F.col("at")) - F.col("observed")) / F.col("error")
        chi = rows.groupBy("case_id", "lo", "hi", "i", "x").agg(F.sum(r * r).alias("objective"))
        best = chi.groupBy("case_id", "lo", "hi").agg(F.min_by("x", F.struct("objective", "i")).alias("x"), F.min("objective").alias("objective"))
        step = (F.col("hi") - F.col("lo")) / n
        ranges = stored(best.select("case_id", F.greatest(F.col("x") - step, F.lit(lo)).alias("lo"), F.least(F.col("x") + step, F.lit(hi)).alias("hi"), "x", "objective"), "best-fit")
        out, ranges = ranges.select("case_id", "x", "objective"), ranges.select("case_id", "lo", "hi")
    return out


def best_row(draws: DataFrame, case: str, order: list[str]) -> DataFrame:
    """The row of least finite objective per case; the first in order if none is finite."""
    o = F.col("obj_function")
    finite = o.isNotNull() & ~F.isnan(o) & (F.abs(o) < float("inf"))
    w = Window.partitionBy(case).orderBy(F.when(finite, 0).otherwise(1), F.when(finite, o), *order)
    return draws.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def top_k(draws: DataFrame, k: int, case: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(case).orderBy("obj_function", *order)
    return draws.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cases_by_mode(obs: DataFrame, mode: str) -> DataFrame:
    """``case_id`` of each row: all rows of a well (``span``), or a case for each date (``successive``)."""
    if mode == "span":
        return obs.withColumn("case_id", F.concat(F.col("well").cast("string"), F.lit("_span")))
    return obs.withColumn("case_id", F.concat_ws("_", F.col("well").cast("string"), F.regexp_replace(F.regexp_replace(F.col("date").cast("string"), r"\.0$", ""), r"\.", "_")))


def windows(obs: DataFrame, breaks: list[int]) -> DataFrame:
    """``well, mode, start, end`` from a well's sampling years: successive pairs, cumulative, full span, splits at breaks."""
    years = obs.select("well", F.floor("date").cast("int").alias("year")).distinct()
    w = Window.partitionBy("well").orderBy("year")
    pairs = years.select("well", F.lit("successive").alias("mode"), F.col("year").alias("start"), F.lead("year").over(w).alias("end")).where("`end` is not null")
    first = F.first("year").over(w)
    cumulative = years.select("well", F.lit("cumulative").alias("mode"), first.alias("start"), F.col("year").alias("end")).where("`end` > start")
    span = years.groupBy("well").agg(F.min("year").alias("start"), F.max("year").alias("end")).select("well", F.lit("full").alias("mode"), "start", "end")
    out = pairs.unionByName(cumulative).unionByName(span)
    for b in breaks:
        parts = span.where((F.col("start") < b) & (F.col("end") >= b))
        out = out.unionByName(parts.select("well", F.lit(f"before_{b}").alias("mode"), "start", F.lit(b - 1).alias("end"))).unionByName(parts.select("well", F.lit(f"from_{b}").alias("mode"), F.lit(b).alias("start"), "end"))
    return out


def prior_window(win: DataFrame, break_year: int) -> DataFrame:
    """Successive windows with the window their prior comes from: before or from the break, or the full span."""
    mine = win.where("mode = 'successive'").withColumn("prior_mode", F.when(F.col("start") < break_year, f"before_{break_year}").otherwise(f"from_{break_year}"))
    priors = win.select("well", F.col("mode").alias("prior_mode"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    full = win.where("mode = 'full'").select("well", F.col("start").alias("f_start"), F.col("end").alias("f_end"))
    out = mine.join(priors, ["well", "prior_mode"], "left").join(full, "well")
    return out.select("well", "start", "end", F.coalesce("p_start", "f_start").alias("prior_start"), F.coalesce("p_end", "f_end").alias("prior_end"))


def job_matrix(wells: DataFrame, errors: list[float], steps: list[str], models: list[str], overrides: DataFrame) -> DataFrame:
    """``job_id, well, rel_error, step, model``: every combination; ``overrides`` (``well, models``) replace the models."""
    rows = wells.join(overrides, "well", "left").withColumn("m", F.coalesce("models", F.array(*map(F.lit, models))))
    rows = rows.select("well", F.explode(F.array(*map(F.lit, errors))).alias("rel_error"), "m").select("*", F.explode(F.array(*map(F.lit, steps))).alias("step")).select("well", "rel_error", "step", F.explode("m").alias("model"))
    out = rows.withColumn("job_id", F.concat_ws("_", F.col("well").cast("string"), F.col("rel_error").cast("string"), "step", "model"))
    twice = duplicate_keys(out, ["job_id"]).agg(F.count("*").alias("__twice"))
    checked = out.crossJoin(F.broadcast(twice))
    return checked.withColumn("job_id", F.when(F.col("__twice") == 0, F.col("job_id")).otherwise(F.raise_error(F.lit("a job id comes twice")))).drop("__twice")


def remaining(cases: DataFrame, results: DataFrame, shards: int, group: str) -> DataFrame:
    """Cases without a successful result, cut into balanced shards within each group."""
    open_ = cases.join(results.where("success").select("case_id").distinct(), "case_id", "left_anti")
    rows = ranked(open_, [group], ["case_id"], "__at")
    # Shards of a group differ by one case at most, the larger ones first.
    size, more = F.floor(F.col("__n") / shards), F.col("__n") % shards
    at = F.col("__at") - 1
    shard = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return rows.withColumn("shard", (shard + 1).cast("int")).drop("__at", "__n")


def stratified_design(catalogue: DataFrame, n: int, seed: int) -> DataFrame:
    """``model, member, name, stratum, value``: for each parameter a permutation of n strata, one for each member."""
    rows = catalogue.select("model", "name", "cal_lo", "cal_hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("member"))
    key = lambda what: uniform(what, seed, F.col("model"), F.col("name"), F.col("member"))
    stratum = F.row_number().over(Window.partitionBy("model", "name").orderBy(key("order"), "member")) - 1
    rows = rows.withColumn("stratum", stratum)
    return rows.withColumn("value", F.col("cal_lo") + (F.col("cal_hi") - F.col("cal_lo")) * (F.col("stratum") + key("jitter")) / n)


def synthetic_cases(catalogue: DataFrame, n: int, seed: int) -> DataFrame:
    """``model, case_no, name, value``: parameters uniform in their ranges, by hash."""
    rows = catalogue.select("model", "name", "cal_lo", "cal_hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("case_no"))
    u = uniform("truth", seed, F.col("model"), F.col("name"), F.col("case_no"))
    return rows.select("model", "case_no", "name", (F.col("cal_lo") + (F.col("cal_hi") - F.col("cal_lo")) * u).alias("value"))


def add_noise(df: DataFrame, regimes: DataFrame, seed: int, keys: list[str]) -> DataFrame:
    """``noisy``: value * (1 + N(0, sigma)) for each noise regime (``regime, sigma``)."""
    rows = df.crossJoin(F.broadcast(regimes))
    rows = rows.withColumn("__u", uniform("regime", seed, F.col("regime"), *(F.col(k) for k in keys)))
    return rows.withColumn("noisy", F.col("value") * (1 + F.col("sigma") * normal_inverse(F.col("__u")))).drop("__u")


def regime_grid(regimes: DataFrame) -> DataFrame:
    """``regime, sigma, seed``: a row for each seed of a regime (``seeds``); one without seeds has one exact row."""
    return regimes.select("regime", "sigma", F.explode_outer("seeds").alias("seed"))


def synthetic_observations(truth: DataFrame, regimes: DataFrame, keys: list[str]) -> DataFrame:
    """Exact predictions (``keys, true``) as ``observed`` in every (regime, seed), with ``relative_error`` and ``error``.

    ``observed`` is true * (1 + N(0, sigma)) by a hash of regime, seed and keys: it depends on no other row. A
    regime without a seed is exact. ``relative_error`` is what was drawn, ``error`` sigma * |true|. The regimes
    are a parameter's few rows, sent to all tasks.
    """
    rows = truth.crossJoin(F.broadcast(regime_grid(regimes)))
    rows = rows.withColumn("__u", uniform("synthetic", F.col("regime"), F.col("seed"), *(F.col(k) for k in keys)))
    rows = rows.withColumn("relative_error", F.when(F.col("seed").isNull(), 0.0).otherwise(F.col("sigma") * normal_inverse(F.col("__u")))).drop("__u")
    return rows.withColumns({"observed": F.col("true") * (1 + F.col("relative_error")), "error": F.col("sigma") * F.abs("true")})


def nearest_row(grid: DataFrame, ref: DataFrame, params: list[str], key: str) -> DataFrame:
    """The grid row nearest to each reference, over the parameters that both have; not finite ones skipped."""
    rows = grid.join(ref.select(key, *(F.col(p).alias(f"r_{p}") for p in params)), key)
    finite: Column = F.lit(True)
    for p in params:
        finite = finite & ~F.isnan(F.coalesce(F.col(p), F.lit(0.0)))
    d = sum((F.coalesce(F.pow(F.col(p) - F.col(f"r_{p}"), F.lit(2.0)), F.lit(0.0)) for p in params), F.lit(0.0))
    rows = rows.where(finite).withColumn("distance", d)
    return rows.groupBy(key).agg(F.min_by("grid_id", F.struct("distance", "grid_id")).alias("grid_id"), F.min("distance").alias("distance"))


def progress(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Per model: expected, present, valid, invalid and missing cases, and whether all are valid."""
    rows = cases.join(results.select("case_id", "success"), "case_id", "left")
    return rows.groupBy("model").agg(F.count("*").alias("expected"), F.count("success").alias("present"), F.count_if("success").alias("valid"), F.count_if(~F.col("success")).alias("invalid"), F.count_if(F.col("success").isNull()).alias("missing")).withColumn("complete", F.col("valid") == F.col("expected"))
