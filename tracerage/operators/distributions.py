"""Age distributions over tables: fractions, moments, curves, maps (D rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.laws import bisect_quantile, get_law

MOMENTS = ["mean", "std", "p10", "p25", "p50", "p75", "p90"]


def stick_breaking(latents: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, age_bin, fraction`` from latents on the real line; a last bin takes the remainder."""
    v = 1 / (1 + F.exp(-F.col("latent")))
    w = Window.partitionBy(*keys).orderBy("age_bin")
    rest = F.exp(F.sum(F.log1p(-v)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = latents.withColumn("__left", rest).withColumn("fraction", v * F.coalesce(F.lag("__left").over(w), F.lit(1.0)))
    last = rows.groupBy(*keys).agg((F.max("age_bin") + 1).alias("age_bin"), F.min("__left").alias("fraction"))
    return rows.select(*keys, "age_bin", "fraction").unionByName(last)


def piecewise_cdf(fractions: DataFrame, ages: DataFrame, edges: list[float], keys: list[str]) -> DataFrame:
    """``keys, t, cdf`` of laws that are uniform within each age bin."""
    limits = F.array(*(F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for a, b in zip(edges, edges[1:], strict=False)))
    rows = fractions.withColumn("lim", F.element_at(limits, F.col("age_bin") + 1)).crossJoin(F.broadcast(ages))
    share = F.least(F.greatest((F.col("t") - F.col("lim.lo")) / (F.col("lim.hi") - F.col("lim.lo")), F.lit(0.0)), F.lit(1.0))
    return rows.groupBy(*keys, "t").agg(F.sum(F.col("fraction") * share).alias("cdf"))


def add_moments(draws: DataFrame, model: str) -> DataFrame:
    """Draws with mean, std and five quantiles of their law (columns of these names are replaced).

    Quantiles are closed forms where there is one; otherwise found by halving between 0 and mean + 40 std.
    """
    law = get_law(model)
    p = {n: F.col(n) for n in law.parameters}
    base = draws.drop(*MOMENTS)
    quantile = law.quantile or (lambda p, q: bisect_quantile(law, p, q, law.mean(p) + 40 * law.std(p)))
    return base.withColumns({"mean": law.mean(p), "std": law.std(p)} | {f"p{int(100 * q)}": quantile(p, F.lit(q)) for q in (0.1, 0.25, 0.5, 0.75, 0.9)})


def curves(draws: DataFrame, model: str, n: int, top: float = 70.0) -> DataFrame:
    """``t, cdf, pdf`` of each draw at n + 1 ages from 0 to ``top``; the density is F's central difference."""
    law = get_law(model)
    p = {x: F.col(x) for x in law.parameters}
    rows = draws.select("*", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("__i")).withColumn("t", top * F.col("__i") / n).drop("__i")
    if model in ("exp", "exp_shifted"):
        shift = p.get("shift", F.lit(0.0))
        pdf = F.when(F.col("t") >= shift, F.exp(-(F.col("t") - shift) / p["scale"]) / p["scale"]).otherwise(0.0)
    else:
        pdf = (law.cdf(p, F.col("t") + 1e-5) - law.cdf(p, F.greatest(F.col("t") - 1e-5, F.lit(0.0)))) / (1e-5 + F.least(F.col("t"), F.lit(1e-5)))
    return rows.withColumn("cdf", law.cdf(p, F.col("t"))).withColumn("pdf", pdf)


def curves_wide(draws: DataFrame, model: str, n: int, row: str, rows: list, kind: str = "cdf", top: float = 70.0) -> DataFrame:
    """``t, p<row>``: the curves (``cdf`` or ``pdf``) of selected draws side by side, a row an age.

    ``row`` numbers the draws, ``rows`` are those that become columns: only they are evaluated. A row
    that isn't there has nulls, one that is there twice fails the job.
    """
    mine = curves(draws.where(F.col(row).isin(rows)), model, n, top)
    twice = F.raise_error(F.lit("a draw is there twice")).cast("double")
    of = lambda r: F.when(F.count_if(F.col(row) == r) <= 1, F.max(F.when(F.col(row) == r, F.col(kind)))).otherwise(twice)
    return mine.groupBy("t").agg(*(of(r).alias(f"p{r}") for r in rows))


def remap(df: DataFrame, mean: str, second: str) -> DataFrame:
    """Other parameterisations of (mean, second).

    Exponential-piston flow with ratio ``second``: scale and shift. Dispersion with parameter
    ``second``: deviation of the inverse Gaussian. With ``second`` as deviation: the inverse
    Gaussian's shape and its derivatives.
    """
    m, s = F.col(mean), F.col(second)
    return df.withColumns(
        {
            "epm_scale": m / (1 + s),
            "epm_shift": m * s / (1 + s),
            "dm_sigma": m * F.sqrt(2 * s),
            "ig_shape": m * m * m / (s * s),
            "d_shape_d_mean": 3 * m * m / (s * s),
            "d_shape_d_std": -2 * m * m * m / (s * s * s),
            "valid": (m > 0) & (s > 0),
        }
    )


def mixture_mean_age(fractions: DataFrame, ages: DataFrame, keys: list[str]) -> DataFrame:
    return fractions.join(F.broadcast(ages), "age_bin").groupBy(*keys).agg(F.sum(F.col("fraction") * F.col("age")).alias("mean_age"))


def cumulative_fractions(fractions: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("age_bin").rowsBetween(Window.unboundedPreceding, 0)
    return fractions.withColumn("cumulative", F.sum("fraction").over(w))


def fractions_from_cumulative(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, upto, fraction``: differences of a cumulative curve over ``age``; the old rest has no age."""
    w = Window.partitionBy(*keys).orderBy("age")
    rows = df.select(*keys, F.col("age").alias("upto"), (F.col("cumulative") - F.coalesce(F.lag("cumulative").over(w), F.lit(0.0))).alias("fraction"))
    rest = df.groupBy(*keys).agg(F.lit(None).cast("double").alias("upto"), (1 - F.max("cumulative")).alias("fraction"))
    return rows.unionByName(rest)


def distribution_checks(draws: DataFrame, model: str, keys: list[str], top: float, n: int) -> DataFrame:
    """``mass, mean, median`` by trapezoids of the density and by F's inverse, and their errors against the closed forms.

    The trapezoid sums are plain sums over a draw's ages less half of both ends.
    """
    law = get_law(model)
    p = {x: F.col(x) for x in law.parameters}
    weight = F.when(F.col("t").isin(0.0, float(top)), 0.5).otherwise(1.0) * F.lit(top / n)
    rows = curves(draws, model, n, top).withColumn("__w", weight * F.col("pdf"))
    got = rows.groupBy(*keys, *law.parameters).agg(F.sum("__w").alias("mass"), F.sum(F.col("__w") * F.col("t")).alias("mean"))
    quantile = law.quantile or (lambda p, q: bisect_quantile(law, p, q, law.mean(p) + 40 * law.std(p)))
    got = got.withColumn("median", quantile(p, F.lit(0.5)))
    # A jump of the density between two ages costs up to half a step of its height.
    mass_error = F.greatest(F.abs(F.col("mass") - 1) - top / n / 2 / law.std(p), F.lit(0.0))
    mean_error = F.greatest(F.abs(F.col("mean") - law.mean(p)) - top / n * law.mean(p) / law.std(p), F.lit(0.0))
    return got.select(*keys, "mass", "mean", "median", mass_error.alias("mass_error"), mean_error.alias("mean_error"), F.abs(law.cdf(p, F.col("median")) - 0.5).alias("median_error"))
