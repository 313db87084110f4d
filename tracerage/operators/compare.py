"""Joins of runs, tools and references (G rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_runs(old: DataFrame, new: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Metrics of two runs side by side (``_old``, ``_new``) and their differences (``_delta``)."""
    a = old.select(*keys, *(F.col(m).alias(f"{m}_old") for m in metrics))
    b = new.select(*keys, *(F.col(m).alias(f"{m}_new") for m in metrics))
    return a.join(b, keys).withColumns({f"{m}_delta": F.col(f"{m}_new") - F.col(f"{m}_old") for m in metrics})


def enrich(df: DataFrame, side: DataFrame, keys: list[str], fills: dict[str, object]) -> DataFrame:
    """A left join with values for what the side lacks."""
    return df.join(side, keys, "left").withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in fills.items()})


def merge_models(series: DataFrame, columns: list[str]) -> DataFrame:
    """``date`` and a column ``<tracer>_<model>`` for each series; a cell with two values is an error."""
    name = F.concat_ws("_", "tracer", "model")
    once = series.groupBy("date", name.alias("name")).agg(F.when(F.count("*") == 1, F.first("value")).otherwise(F.raise_error(F.lit("a date comes twice")).cast("double")).alias("value"))
    return once.groupBy("date").pivot("name", columns).agg(F.first("value"))


def join_on_date(obs: DataFrame, pred: DataFrame, keys: list[str], digits: int = 10) -> DataFrame:
    """Observations with the prediction of their rounded date, and ``covered``."""
    a = obs.withColumn("__d", F.bround("date", digits))
    b = pred.select(*keys, F.bround("date", digits).alias("__d"), "modeled")
    return a.join(b, [*keys, "__d"], "left").drop("__d").withColumn("covered", F.col("modeled").isNotNull())


def mark_dates(obs: DataFrame, dates: DataFrame, tol: float) -> DataFrame:
    """``highlighted``: whether a date of the (short) list is within ``tol``. Cells of that width make it an equi-join."""
    cell = lambda x: F.floor(x / tol).cast("long")
    near = dates.select(F.col("date").alias("__d"), F.explode(F.array(cell(F.col("date")) - 1, cell(F.col("date")), cell(F.col("date")) + 1)).alias("__c"))
    rows = obs.withColumn("__c", cell(F.col("date")))
    hit = rows.select("date", "__c").distinct().join(near, "__c").where(F.abs(F.col("date") - F.col("__d")) <= tol).select("date").distinct().withColumn("__hit", F.lit(True))
    return rows.drop("__c").join(hit, "date", "left").withColumn("highlighted", F.coalesce("__hit", F.lit(False))).drop("__hit")


def vs_reference(df: DataFrame, case: str, run: str, reference: str, value: str, limit: float) -> DataFrame:
    """Every other run of a case against its reference run: difference, relative difference, whether within a limit."""
    ref = df.where(F.col(run) == reference).select(case, F.col(value).alias("reference"))
    rows = df.where(F.col(run) != reference).join(ref, case)
    relative = F.try_divide(F.col(value) - F.col("reference"), F.col("reference"))
    return rows.withColumn("difference", F.col(value) - F.col("reference")).withColumn("relative", relative).withColumn("within", F.abs(relative) <= limit)


def pairing_check(a: DataFrame, b: DataFrame, case: str, tracer: str, value: str, tol: float = 1e-12) -> DataFrame:
    """Per case: do both tools have the same tracers with equal values."""
    both = a.select(case, tracer, F.col(value).alias("va")).join(b.select(case, tracer, F.col(value).alias("vb")), [case, tracer], "full")
    same = F.coalesce(F.abs(F.col("va") - F.col("vb")) <= tol, F.lit(False))
    return both.groupBy(case).agg(F.bool_and(same).alias("paired"), F.count("*").alias("n"))


def diff_all_numeric(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``column, n, max_abs, max_rel, worst``: per numeric column the largest difference and the key that has it."""
    long = lambda df, v: df.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(keys, columns, "column", v)
    rows = long(old, "a").join(long(new, "b"), [*keys, "column"]).withColumn("d", F.abs(F.col("b") - F.col("a")))
    rel = F.col("d") / F.greatest(F.abs("a"), F.lit(1e-300))
    key = F.concat_ws("|", *keys)
    return rows.groupBy("column").agg(F.count("*").alias("n"), F.max("d").alias("max_abs"), F.max(rel).alias("max_rel"), F.max_by(key, F.struct("d", key)).alias("worst"))


def verify_against(df: DataFrame, canonical: DataFrame, keys: list[str], value: str, atol: float) -> DataFrame:
    """Violations of a compact table: rows the source lacks, values off, quantiles out of order or without width."""
    rows = df.join(canonical.select(*keys, F.col(value).alias("__c")), keys, "left")
    rules = F.array_compact(F.array(F.when(F.col("__c").isNull(), F.lit("not_in_source")), F.when(F.abs(F.col(value) - F.col("__c")) > atol, F.lit("value_differs")), F.when(~((F.col("q10") <= F.col("median")) & (F.col("median") <= F.col("q90"))), F.lit("quantiles_unordered")), F.when(F.col("q90") - F.col("q10") <= 0, F.lit("no_width"))))
    return rows.select(*keys, F.explode(rules).alias("rule"))
