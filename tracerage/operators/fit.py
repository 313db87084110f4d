"""Best fits of several parameters for all cases at once (F rows).

Damped Gauss-Newton steps (Levenberg and Marquardt) as a relation: a row for each case and start
holds its parameters, damping and sums. A round is one pass over the data: each datum meets the
proposed parameters of its case, and its residual and derivatives are summed map-side into the few
numbers of the normal equations. Accepted or not, the next proposal follows from those sums alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import uniform
from ..sources.io import scratch, stored

Model = Callable[[dict[str, Column], Column], Column]

#: Parts that the data of a case are cut in, so a hot case is spread over as many tasks.
SLICES = 8
#: Damping: at first, the least, and the one at which a case ends because no step helps.
DAMPING, LEAST_DAMPING, LAST_DAMPING = 1e-2, 1e-10, 1e10
#: A case ends when no parameter moves by more than this share of its range.
TOLERANCE = 1e-9


def dealt_by_case(data: DataFrame) -> tuple[DataFrame, str]:
    """``data`` in a bucketed table by case and slice, and the table's name.

    The only time that data are shuffled: rounds join them where they are.
    """
    spark = data.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"best_fit_{uuid.uuid4().hex}"
    rows = data.select("case_id", F.pmod(F.xxhash64("at", "observed"), F.lit(SLICES)).cast("int").alias("slice"), "at", "observed", "error")
    rows.repartition(n, "case_id", "slice").write.bucketBy(n, "case_id", "slice").format("parquet").option("path", scratch(spark, name)).saveAsTable(name)
    return spark.table(name), name


def starting_points(cases: DataFrame, bounds: dict[str, tuple[float, float]], starts: int, seed: int) -> DataFrame:
    """``case_id, start`` and each parameter: the first start is mid-range, others lie in strata of the ranges by hash."""
    rows = cases.select("case_id", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("start"))
    for i, (name, (lo, hi)) in enumerate(bounds.items()):
        stratum = F.pmod(F.col("start") * (2 * i + 1) + i, F.lit(starts))
        u = F.when(F.col("start") == 0, 0.5).otherwise((stratum + uniform("start", seed, F.col("case_id"), F.col("start"), name)) / starts)
        rows = rows.withColumn(name, lo + (hi - lo) * u)
    return rows


def normal_sums(data: DataFrame, points: DataFrame, model: Model, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """``case_id, start, n, chi2`` and the sums ``g_i`` (J'r) and ``h_i_j`` (J'J) at each point's parameters.

    Derivatives are central differences, one-sided at an end of a range, in units of the ranges.
    """
    names = list(bounds)
    copies = points.select("case_id", "start", *names, F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    rows = data.join(copies, ["case_id", "slice"])
    checked = F.when(F.col("error") > 0, F.col("error")).otherwise(F.raise_error(F.lit("an error is not positive")).cast("double"))
    p = {n: F.col(n) for n in names}
    rows = rows.withColumn("__e", checked).withColumn("__r", (model(p, F.col("at")) - F.col("observed")) / F.col("__e"))
    for i, name in enumerate(names):
        lo, hi = bounds[name]
        h = 1e-6 * (hi - lo)
        up, down = F.least(F.col(name) + h, F.lit(hi)), F.greatest(F.col(name) - h, F.lit(lo))
        slope = (model(p | {name: up}, F.col("at")) - model(p | {name: down}, F.col("at"))) / (up - down)
        rows = rows.withColumn(f"__j{i}", slope * (hi - lo) / F.col("__e"))
    d = range(len(names))
    sums = [F.sum(F.col(f"__j{i}") * F.col("__r")).alias(f"g_{i}") for i in d] + [F.sum(F.col(f"__j{i}") * F.col(f"__j{j}")).alias(f"h_{i}_{j}") for i in d for j in d if j <= i]
    return rows.groupBy("case_id", "start").agg(F.count("*").alias("n"), F.sum(F.col("__r") * F.col("__r")).alias("chi2"), *sums)


def _solved(rows: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """``x_i``: the damped normal equations solved by a triangular factor, in units of the ranges; null if they can't be.

    A parameter at an end of its range that the data push outwards stays, and the others are solved for.
    """
    d = len(bounds)
    for i, (name, (lo, hi)) in enumerate(bounds.items()):
        rows = rows.withColumn(f"fix_{i}", ((F.col(name) <= lo) & (F.col(f"g_{i}") > 0)) | ((F.col(name) >= hi) & (F.col(f"g_{i}") < 0)))
    for i in range(d):
        for j in range(i + 1):
            held = F.when(F.col(f"fix_{i}") | F.col(f"fix_{j}"), 0.0).otherwise(F.col(f"h_{i}_{j}"))
            cell = F.when(F.col(f"fix_{i}"), 1.0).otherwise(F.col(f"h_{i}_{j}")) * (1 + F.col("damping")) + 1e-300 if i == j else held
            rest = reduce(lambda acc, k, i=i, j=j: acc - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), cell)
            rows = rows.withColumn(f"l_{i}_{j}", F.when(rest > 0, F.sqrt(rest)) if i == j else F.try_divide(rest, F.col(f"l_{j}_{j}")))
    for i in range(d):
        rows = rows.withColumn(f"y_{i}", F.try_divide(reduce(lambda acc, k, i=i: acc - F.col(f"l_{i}_{k}") * F.col(f"y_{k}"), range(i), F.when(F.col(f"fix_{i}"), 0.0).otherwise(-F.col(f"g_{i}"))), F.col(f"l_{i}_{i}")))
    for i in reversed(range(d)):
        rows = rows.withColumn(f"x_{i}", F.try_divide(reduce(lambda acc, k, i=i: acc - F.col(f"l_{k}_{i}") * F.col(f"x_{k}"), range(i + 1, d), F.col(f"y_{i}")), F.col(f"l_{i}_{i}")))
    return rows


def best_fits(data: DataFrame, bounds: dict[str, tuple[float, float]], model: Model, starts: int = 3, rounds: int = 60, seed: int = 0) -> DataFrame:
    """The least-squares parameters of every case within their ranges.

    ``data`` has ``case_id, at, observed, error``; ``model(parameters, at)`` is a Column. Returns
    ``case_id``, each parameter, ``n, objective`` (root of the mean squared normalised residual),
    ``max_relative_error`` of the fitted values, both calculated anew at the result, ``starts_at_best``
    (how many starts came to it) and ``converged``. From each of several starts the damping grows
    after a step that doesn't help and shrinks after one that does; points stay in the ranges, and a
    start leaves the rounds when it moves no more. What hasn't ended after ``rounds`` isn't converged.

    Data are shuffled once; a round shuffles one row for each start and slice. An error that isn't
    positive fails the job. Cases without data don't come up; nulls in data count for nothing.
    """
    names, d = list(bounds), range(len(bounds))
    spark = data.sparkSession
    known = data.where("at is not null and observed is not null and error is not null")
    table, name = dealt_by_case(known)
    state_columns = [*names, "chi2", *(f"g_{i}" for i in d), *(f"h_{i}_{j}" for i in d for j in range(i + 1))]
    open_ = stored(starting_points(table.select("case_id").distinct(), bounds, starts, seed), "best-fit-starts")
    ended: list[DataFrame] = []
    state = None
    for turn in range(rounds):
        found = normal_sums(table, open_, model, bounds).drop("n")
        if state is None:
            now = open_.join(found, ["case_id", "start"]).withColumn("damping", F.lit(DAMPING))
        else:
            new = open_.join(found, ["case_id", "start"])
            both = state.alias("s").join(new.alias("t"), ["case_id", "start"])
            better = F.col("t.chi2") < F.col("s.chi2")
            kept = [F.when(better, F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in state_columns]
            now = both.select("case_id", "start", *kept, F.when(better, F.greatest(F.col("damping") / 10, F.lit(LEAST_DAMPING))).otherwise(F.col("damping") * 10).alias("damping"))
        solved = _solved(now, bounds)
        moved = F.lit(0.0)
        for i, n in enumerate(names):
            lo, hi = bounds[n]
            solved = solved.withColumn(f"q_{n}", F.least(F.greatest(F.col(n) + F.coalesce(F.col(f"x_{i}"), F.lit(0.0)) * (hi - lo), F.lit(lo)), F.lit(hi)))
            moved = F.greatest(moved, F.abs(F.col(f"q_{n}") - F.col(n)) / (hi - lo))
        stuck = F.col("x_0").isNull()
        over = (~stuck & (moved <= TOLERANCE)) | (F.col("damping") >= LAST_DAMPING)
        solved = solved.withColumn("ended", over).withColumn("damping", F.when(stuck, F.col("damping") * 10).otherwise(F.col("damping")))
        step = stored(solved.select("case_id", "start", *state_columns, "damping", "ended", *(f"q_{n}" for n in names)), f"best-fit-{turn}")
        ended.append(step.where("ended").select("case_id", "start", *names, "chi2", F.lit(True).alias("converged")))
        state = step.where("not ended").drop("ended", *(f"q_{n}" for n in names))
        open_ = step.where("not ended").select("case_id", "start", *(F.col(f"q_{n}").alias(n) for n in names))
        if open_.limit(1).count() == 0:
            break
    else:
        ended.append(state.select("case_id", "start", *names, "chi2", F.lit(False).alias("converged")))
    every = reduce(DataFrame.unionByName, ended)
    order = F.struct("chi2", "start")
    best = every.groupBy("case_id").agg(*(F.min_by(n, order).alias(n) for n in names), F.min_by("converged", order).alias("converged"), F.min("chi2").alias("least"))
    near = every.join(best.select("case_id", "least"), "case_id").groupBy("case_id").agg(F.count_if(F.col("chi2") <= F.col("least") * (1 + 1e-6) + 1e-12).alias("starts_at_best"))
    best = stored(best.join(near, "case_id").drop("least"), "best-fit")
    copies = best.select("case_id", *names, F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    rows = table.join(copies, ["case_id", "slice"]).withColumn("fitted", model({n: F.col(n) for n in names}, F.col("at")))
    r = (F.col("fitted") - F.col("observed")) / F.col("error")
    checks = rows.groupBy("case_id").agg(F.count("*").alias("n"), F.sqrt(F.sum(r * r) / F.count("*")).alias("objective"), F.max(F.try_divide(F.abs(F.col("fitted") - F.col("observed")), F.abs("observed"))).alias("max_relative_error"))
    out = stored(best.join(checks, "case_id").select("case_id", *names, "n", "objective", "max_relative_error", "starts_at_best", "converged"), "best-fits")
    spark.sql(f"drop table {name}")  # the entry; its files are those of a scratch folder
    return out


def parameter_errors(fits: DataFrame, truth: DataFrame, names: list[str]) -> DataFrame:
    """Fits with ``<name>_error`` and ``<name>_relative_error`` against ``truth`` (``case_id`` and the parameters)."""
    rows = fits.join(truth.select("case_id", *(F.col(n).alias(f"__{n}") for n in names)), "case_id", "left")
    for n in names:
        rows = rows.withColumn(f"{n}_error", F.col(n) - F.col(f"__{n}")).withColumn(f"{n}_relative_error", F.try_divide(F.col(n) - F.col(f"__{n}"), F.abs(F.col(f"__{n}")))).drop(f"__{n}")
    return rows
