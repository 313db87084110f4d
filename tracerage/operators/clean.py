"""Projections, filters, cleaning and validation (B rows)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import c, to_num
from .order import quantiles, ranked

#: What units may not be, canonical labels, and other names of theirs.
PLACEHOLDERS = ["", "0", "-", "n/a", "na", "none", "null", "unknown"]
UNITS = ["pptv", "TU", "pmC", "fraction_modern", "mol/l", "mol", "Bq/L", "dpm/ccKr", "TU_equivalent"]
CANONICAL = {"pcm%": "pmC", "%modern": "pmC"} | {u.lower(): u for u in UNITS}


def rule_rows(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """A row ``keys, rule`` for each rule whose condition holds."""
    named = F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in rules.items())))
    return df.select(*keys, F.explode(named).alias("rule"))


def validate_observations(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(violations, clean)``: finite value, error of 0 or more, element that isn't blank."""
    number = to_num("concentration")
    error = to_num("error")
    rules = {"concentration_not_finite": number.isNull(), "error_not_finite": error.isNull(), "error_negative": error < 0, "element_blank": F.coalesce(F.trim("element"), F.lit("")) == ""}
    bad = rule_rows(df, ["well", "obs_id"], rules)
    broken = reduce(lambda x, y: x | F.coalesce(y, F.lit(False)), rules.values(), F.lit(False))
    return bad, df.where(~broken).withColumn("element", F.trim("element"))


def normalize_series(df: DataFrame) -> DataFrame:
    """Finite dated values, one element a series; ``at`` counts them by date. A series of any size is spread over tasks."""
    rows = df.select("element", to_num("date").alias("date"), to_num("concentration").alias("concentration")).where("element is not null and date is not null and concentration is not null")
    return ranked(rows, ["element"], ["date", "concentration"], "at").drop("__n")


def check_units(df: DataFrame, unit: str = "unit") -> DataFrame:
    """``canonical`` and ``status``: ok, recase (other spelling of a known unit), placeholder, or custom (any other label, compared exactly)."""
    pairs = F.create_map(*(F.lit(x) for kv in CANONICAL.items() for x in kv))
    low = F.lower(F.trim(F.coalesce(c(unit), F.lit(""))))
    out = df.withColumn("canonical", F.try_element_at(pairs, low))
    status = F.when(low.isin(PLACEHOLDERS), "placeholder").when(F.col("canonical").isNull(), "custom").when(F.col("canonical") == F.trim(c(unit)), "ok").otherwise("recase")
    return out.withColumn("status", status)


def unit_consistency(df: DataFrame) -> DataFrame:
    return df.groupBy("element").agg(F.countDistinct("unit").alias("n_units"), F.min("unit").alias("first_unit"), F.max("unit").alias("last_unit"))


def unit_mismatches(obs: DataFrame, tracers: DataFrame) -> DataFrame:
    """``element, unit, expected, n, problem``: units other than the catalogue's, elements it lacks."""
    seen = obs.groupBy("element", "unit").agg(F.count("*").alias("n"))
    rows = seen.join(tracers.select(F.col("name").alias("element"), F.col("unit").alias("expected")), "element", "left")
    return rows.withColumn("problem", F.when(F.col("expected").isNull(), "undeclared").when(F.col("expected") != F.col("unit"), "mismatch")).where("problem is not null")


def positive_only(df: DataFrame, value: str = "concentration") -> DataFrame:
    return df.where(to_num(value) > 0)


def set_relative_errors(df: DataFrame, fraction: float) -> DataFrame:
    return df.withColumn("error", fraction * F.abs("concentration")).withColumn("error_method", F.lit("relative"))


def fill_missing_errors(obs: DataFrame, means: DataFrame, fraction: float = 0.01) -> DataFrame:
    """Zero errors become a fraction of the mean tracer response at the sampling date.

    ``means`` has ``element, date, mean_response``. An error that stays 0 or less fails the job.
    """
    rows = obs.join(means, ["element", "date"], "left")
    filled = F.when(F.col("error") == 0, fraction * F.col("mean_response")).otherwise(F.col("error"))
    rows = rows.withColumn("error_method", F.when(F.col("error") == 0, "mean_response").otherwise("given")).withColumn("error", filled)
    return rows.withColumn("error", F.when(F.col("error") > 0, F.col("error")).otherwise(F.raise_error(F.lit("an error is not positive")).cast("double"))).drop("mean_response")


def error_provenance(df: DataFrame) -> DataFrame:
    """How often each method set an error, and for which rows (the least and the greatest id)."""
    return df.groupBy("well", "error_method").agg(F.count("*").alias("n"), F.min("obs_id").alias("first_id"), F.max("obs_id").alias("last_id"))


def select_window(obs: DataFrame, cases: DataFrame) -> DataFrame:
    """Observations of a case's well from ``start`` to ``end`` + 1, both included."""
    return cases.join(obs, "well").where("date >= start and date <= `end` + 1")


def subset(df: DataFrame, wells: list | None = None, elements: list | None = None, enabled: bool = True) -> DataFrame:
    """Rows of the given wells and elements, and of enabled ones if there is such a column; a well that isn't there is an error."""
    if enabled and "enabled" in df.columns:
        df = df.where(F.lower(F.col("enabled").cast("string")) == "true")
    if elements is not None:
        df = df.where(F.col("element").isin(elements))
    if wells is None:
        return df
    rows = df.where(F.col("well").isin(wells))
    found = {r["well"] for r in rows.select("well").distinct().collect()}  # at most as many as were asked for
    if gone := sorted(set(wells) - found):
        raise ValueError(f"wells without rows: {gone}")
    return rows


def parse_keys(df: DataFrame, key: str = "key") -> DataFrame:
    """``element, date, index`` of ``element@date#index`` or ``element@date`` keys."""
    part = lambda i: F.nullif(F.regexp_extract(c(key), r"^(.*)@([^@#]*)(?:#(\d+))?$", i), F.lit(""))
    return df.withColumns({"element": part(1), "date": part(2).cast("double"), "index": part(3).cast("long")})


def checked_keys(parsed: DataFrame, obs: DataFrame, keys: list[str], tol: float = 1e-8) -> DataFrame:
    """Parsed keys with ``matches``: whether the observation of their index (within ``keys``) has their element and date."""
    own = obs.select(*keys, F.col("obs_id").alias("index"), F.col("element").alias("__element"), F.col("date").alias("__date"))
    same = (F.col("element") == F.col("__element")) & (F.abs(F.col("date") - F.col("__date")) <= tol + 1e-5 * F.abs("__date"))
    return parsed.join(own, [*keys, "index"], "left").withColumn("matches", F.coalesce(same, F.lit(False))).drop("__element", "__date")


def select_rows(df: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """Rows whose ``+``-lists hold the given values."""
    for column, value in selectors.items():
        df = df.where(F.array_contains(F.split(c(column), r"\+"), value))
    return df


def convert_with_log(df: DataFrame, rules: DataFrame) -> DataFrame:
    """``rules`` has ``element, factor, to_unit, rule``; rows without one stay, with rule ``none``."""
    rows = df.join(rules, "element", "left")
    return rows.select("*", (F.col("concentration") * F.coalesce("factor", F.lit(1.0))).alias("converted"), F.coalesce("to_unit", "unit").alias("unit_out"), F.coalesce("rule", F.lit("none")).alias("applied")).drop("factor", "to_unit", "rule")


def helium_diagnostics(df: DataFrame, mean_life: float) -> DataFrame:
    """Of parent h, daughter he and their errors: initial, its error, ratio age, reported minus ratio age.

    A missing daughter error is the median of the positive ones; ``error_source`` tells.
    """
    median = quantiles(df.where("he_err > 0"), [], "he_err", {"typical": 0.5})
    rows = df.crossJoin(median).withColumn("error_source", F.when(F.col("he_err") > 0, "reported").otherwise("median"))
    rows = rows.withColumn("he_error", F.when(F.col("he_err") > 0, F.col("he_err")).otherwise(F.col("typical"))).drop("typical")
    rows = rows.withColumn("initial", F.col("h") + F.col("he")).withColumn("initial_error", F.hypot("h_err", "he_error"))
    rows = rows.withColumn("ratio_age", F.when(F.col("h") > 0, mean_life * F.log1p(F.col("he") / F.col("h"))))
    return rows.withColumn("delta", F.col("reported_age") - F.col("ratio_age"))


def dataset_rules(df: DataFrame, units: dict[str, str], years: tuple[float, float], expected: int) -> DataFrame:
    """``rule, n``: how many rows of a converted dataset break each rule (all rules, also those kept)."""
    unit = F.create_map(*(F.lit(x) for kv in units.items() for x in kv))
    known = F.col("element").isin(list(units))
    row_rules = {
        "element_unknown": ~known,
        "null_value": F.col("concentration").isNull() | F.col("error").isNull() | F.col("date").isNull(),
        "error_not_positive": F.col("error") <= 0,
        "value_negative": F.col("concentration") < 0,
        "unit_wrong": known & (F.try_element_at(unit, F.col("element")) != F.col("unit")),
        "date_outside": ~F.col("date").between(*years),
    }
    counts = df.agg(*(F.count_if(cond).alias(name) for name, cond in row_rules.items()), F.when(F.count("*") == expected, 0).otherwise(1).cast("long").alias("count_unexpected"))
    out = counts.unpivot([], [*row_rules, "count_unexpected"], "rule", "n")
    twice = duplicate_keys(df, ["well", "element", "date"]).agg(F.lit("duplicate_key").alias("rule"), F.count("*").alias("n"))
    return out.unionByName(twice)


def in_bounds(draws: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``case_id, chain, step, in_domain, in_range`` of each draw over all its parameters."""
    limits = catalogue.select(F.col("model").alias("case_id"), F.col("name").alias("param"), "lo", "hi", "inclusive", "cal_lo", "cal_hi")
    rows = draws.join(limits, ["case_id", "param"])
    inside = F.when(F.col("inclusive"), F.col("value").between(F.col("lo"), F.col("hi"))).otherwise((F.col("value") > F.col("lo")) & (F.col("value") < F.col("hi")))
    return rows.groupBy("case_id", "chain", "step").agg(F.bool_and(inside).alias("in_domain"), F.bool_and(F.col("value").between(F.col("cal_lo"), F.col("cal_hi"))).alias("in_range"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def grid_gaps(df: DataFrame, axes: list[DataFrame]) -> DataFrame:
    """Keys of the axes' product that are missing, and keys outside of it that are there."""
    grid = axes[0]
    for axis in axes[1:]:
        grid = grid.crossJoin(axis)
    keys, have = grid.columns, df.select(*grid.columns).distinct()
    return grid.join(have, keys, "left_anti").withColumn("problem", F.lit("missing")).unionByName(have.join(grid, keys, "left_anti").withColumn("problem", F.lit("extra")))


def quantile_sanity(df: DataFrame, group: str, tol: float = 0.01) -> DataFrame:
    """``ordered, in_unit`` of each row's q10, median, q90, and whether its group's medians sum to 1."""
    from pyspark.sql import Window

    total = F.sum("median").over(Window.partitionBy(group))
    ordered = (F.col("q10") <= F.col("median")) & (F.col("median") <= F.col("q90"))
    return df.withColumn("ordered", ordered).withColumn("in_unit", (F.col("q10") >= 0) & (F.col("q90") <= 1)).withColumn("sums_to_one", F.abs(total - 1) <= tol)


def retain(draws: DataFrame, burn_in: float, thinning: int, step: str = "step") -> DataFrame:
    """Draws after a share of their chain, every so many steps. Chains are counted map-side and their sizes joined back."""
    sizes = draws.groupBy("case_id", "chain").agg(F.count("*").alias("__n"))
    sizes = sizes.select(F.col("case_id").alias("__case"), F.col("chain").alias("__chain"), "__n")
    rows = draws.where(F.col(step) % thinning == 0).join(sizes, F.col("case_id").eqNullSafe(F.col("__case")) & F.col("chain").eqNullSafe(F.col("__chain")))
    return rows.where(F.col(step) > burn_in * F.col("__n")).drop("__n", "__case", "__chain")


def matrix_rules(matrix: DataFrame, configs: DataFrame) -> DataFrame:
    """``job, rule`` where a matrix row's flag or lists differ from its job configuration."""
    rows = matrix.join(configs, "job", "left")
    same = lambda a, b: F.array_sort(F.split(c(a), r"\+")).eqNullSafe(F.array_sort(c(b)))
    rules = {"enabled_not_boolean": ~F.lower("enabled").isin("true", "false"), "wells_differ": ~same("wells", "job_wells"), "errors_differ": ~same("relative_errors", "job_errors")}
    return rule_rows(rows, ["job"], rules)


def validate_draws(draws: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys that no draw has, and draws' keys that come more than once a step."""
    gone = expected.join(draws.select(*keys).distinct(), keys, "left_anti").select(*keys).withColumn("problem", F.lit("missing"))
    twice = duplicate_keys(draws, [*keys, "chain", "step"]).select(*keys).distinct().withColumn("problem", F.lit("duplicate"))
    return gone.unionByName(twice)
