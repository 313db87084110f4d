"""A whole campaign as one plan: predictions of a parameter grid against every well at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forward as fw
from ..operators import posterior as po
from ..sources.io import stored
from .q_forward import responded
from .q_posterior import observed


def grid(spark: SparkSession, steps: int) -> DataFrame:
    """steps * steps points of (scale, shift)."""
    return spark.range(steps * steps).select(F.col("id").alias("grid_id"), (0.5 + 0.25 * F.floor(F.col("id") / steps)).alias("scale"), (0.1 * (F.col("id") % steps)).alias("shift"))


def predictions(spark: SparkSession, sf: str, steps: int = 40) -> DataFrame:
    """``grid_id, tracer, date, modeled``: the refined bins are made once, draws are dealt over tasks and meet them."""
    got = fw.convolve(grid(spark, steps).repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), responded(spark, sf), "exp_shifted", ["grid_id"])
    return got.select("grid_id", "tracer", "date", "modeled")


def fit(spark: SparkSession, sf: str, steps: int = 40) -> DataFrame:
    """Per well: best point, posterior mean and deviation of the scale, evidence.

    Observations are the large side at scale and stay where they are: predictions (bounded by grid
    times sampling dates, stored) are sent to them below the session's broadcast threshold, and sums
    per well and point combine in each task.
    """
    ob = observed(spark, sf).withColumnRenamed("well", "case_id")
    surface = po.misfit(predictions(spark, sf, steps), ob, ["tracer", "date"], ["case_id", "grid_id"])
    weights = po.grid_posterior(stored(surface, "surface")).join(grid(spark, steps), "grid_id")
    return weights.groupBy("case_id").agg(F.min_by("grid_id", F.struct("chi2", "grid_id")).alias("best"), F.sum(F.col("weight") * F.col("scale")).alias("scale_mean"), F.max("evidence").alias("evidence"))

