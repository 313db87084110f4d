"""Input histories: interpolation, decay, grids (C rows)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(chronicle: DataFrame) -> DataFrame:
    """``tracer, d1, v1, d2, v2`` between successive knots; the last one also covers its end.

    ``year`` is each whole year that a segment touches: lookups join on it by hash instead of by range.
    """
    w = Window.partitionBy("tracer").orderBy("date")
    rows = chronicle.select("tracer", F.col("date").alias("d1"), F.col("value").alias("v1"), F.lead("date").over(w).alias("d2"), F.lead("value").over(w).alias("v2"), F.max("date").over(Window.partitionBy("tracer")).alias("last"))
    rows = rows.where("d2 is not null")
    return rows.withColumn("year", F.explode(F.sequence(F.floor("d1").cast("int"), F.floor("d2").cast("int"))))


def with_segment(points: DataFrame, chronicle: DataFrame, at: str = "x", out: str = "segment") -> DataFrame:
    """``out``: the history's segment (``d1, v1, d2, v2, last``) that holds ``at``, null outside of the history."""
    s = segments(chronicle).select("tracer", "year", F.struct("d1", "v1", "d2", "v2", "last").alias("s"))
    # A year holds a few segments: one row a tracer and year, so no point meets another's segments.
    s = s.groupBy("tracer", "year").agg(F.array_sort(F.collect_list("s")).alias("ss"))
    rows = points.withColumn("year", F.floor(at).cast("int")).join(s, ["tracer", "year"], "left")
    x = F.col(at)
    inside = lambda g: (g["d1"] <= x) & ((x < g["d2"]) | ((x == g["d2"]) & (g["d2"] == g["last"])))
    return rows.withColumn(out, F.try_element_at(F.filter("ss", inside), F.lit(1))).drop("ss", "year")


def on_segment(g: Column, x: Column) -> Column:
    """The value at x of a segment's line; 0 without a segment."""
    return F.coalesce(g["v1"] + (g["v2"] - g["v1"]) * (x - g["d1"]) / (g["d2"] - g["d1"]), F.lit(0.0))


def interpolate(points: DataFrame, chronicle: DataFrame, at: str = "x", out: str = "value") -> DataFrame:
    """``out``: the history of ``tracer`` at ``at``, linear between knots, 0 outside of them."""
    return with_segment(points, chronicle, at, "__s").withColumn(out, on_segment(F.col("__s"), F.col(at))).drop("__s")


def interpolate_hold(points: DataFrame, chronicle: DataFrame, left_fill: float, at: str = "x", out: str = "value") -> DataFrame:
    """The same with ``left_fill`` before the history and its last value after it."""
    ends = chronicle.groupBy("tracer").agg(F.min("date").alias("__first"), F.max("date").alias("__last"), F.max_by("value", "date").alias("__end"))
    rows = interpolate(points, chronicle, at, out).join(ends, "tracer", "left")
    held = F.when(F.col("__first").isNull() | (F.col(at) < F.col("__first")), F.lit(left_fill)).when(F.col(at) > F.col("__last"), F.col("__end")).otherwise(F.col(out))
    return rows.withColumn(out, held).drop("__first", "__last", "__end")


def decay(value: Column, rate: Column, age: Column) -> Column:
    """First-order decay; no rate, no decay."""
    return value * F.when(rate.isNull(), 1.0).otherwise(F.exp(-rate * age))


def produce(production: Column, rate: Column, age: Column) -> Column:
    """What constant production leaves after an age, with or without decay."""
    return F.coalesce(production * F.when(rate.isNull() | (rate == 0), age).otherwise(-F.expm1(-rate * age) / rate), F.lit(0.0))


_responses: dict[str, Callable[[Column, Column], Column]] = {}


def register_tracer(name: str, builder: Callable[[Column, Column], Column]) -> None:
    """A tracer of its own: a builder of its response from sampling date and age."""
    if name in _responses:
        raise ValueError(f"tracer {name} is registered already")
    _responses[name] = builder


def unregister_tracer(name: str) -> None:
    del _responses[name]


def response_of(tracer: Column, date: Column, age: Column, history: Column, mode: Column, const: Column, prod: Column, rate: Column) -> Column:
    """A response from the history's value and a catalogue row's columns; registered tracers take their own builder."""
    base = F.when(mode == "constant", const).otherwise(history)
    k = decay(F.coalesce(base, F.lit(0.0)), rate, age) + produce(prod, rate, age)
    for name, builder in _responses.items():
        k = F.when(tracer == name, builder(date, age)).otherwise(k)
    return k


def tracer_response(points: DataFrame, chronicle: DataFrame, tracers: DataFrame, date: str = "date", age: str = "age", out: str = "k") -> DataFrame:
    """``out``: the response at a sampling date to an age: history or constant, decayed, and production.

    ``tracers`` is a catalogue with decay rates. Registered tracers take their own builder.
    """
    rows = interpolate(points.withColumn("__x", F.col(date) - F.col(age)), chronicle, "__x", "__in")
    cat = tracers.select(F.col("name").alias("tracer"), F.col("mode").alias("__mode"), F.col("constant").alias("__const"), F.col("production_rate").alias("__prod"), F.col("decay_rate").alias("__rate"))
    rows = rows.join(cat, "tracer", "left")
    of = {n: F.col(f"__{n}") for n in ("mode", "const", "prod", "rate")}
    return rows.withColumn(out, response_of(F.col("tracer"), F.col(date), F.col(age), F.col("__in"), **of)).drop("__x", "__in", "__mode", "__const", "__prod", "__rate")


def parent_daughter(points: DataFrame, chronicle: DataFrame, half_life: float, delay: float, decay_in_delay: bool, left_fill: float = 0.0) -> DataFrame:
    """``parent, daughter`` of water recharged ``age`` before ``date``, after a delay above the water table."""
    rate = 0.6931471805599453 / half_life
    rows = interpolate_hold(points.withColumn("__x", F.col("date") - F.col("age") - delay), chronicle, left_fill, "__x", "__in")
    entry = F.col("__in") * (F.exp(F.lit(-rate * delay)) if decay_in_delay else F.lit(1.0))
    return rows.withColumn("parent", entry * F.exp(-rate * F.col("age"))).withColumn("daughter", entry * -F.expm1(-rate * F.col("age"))).drop("__x", "__in")


def mean_response(obs: DataFrame, chronicle: DataFrame, tracers: DataFrame, n: int = 1000) -> DataFrame:
    """``tracer, date, mean_response``: the mean response at n source dates from the history's start to the sampling date."""
    start = chronicle.groupBy("tracer").agg(F.min("date").alias("start"))
    pairs = obs.select("tracer", "date").distinct().join(start, "tracer", "left").withColumn("start", F.coalesce("start", F.lit(1950.0)))
    points = pairs.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).withColumn("age", (F.col("date") - F.col("start")) * (1 - F.col("i") / n))
    return tracer_response(points, chronicle, tracers).groupBy("tracer", "date").agg(F.avg("k").alias("mean_response"))


def chronicle_summary(chronicle: DataFrame) -> DataFrame:
    q = F.expr("percentile(value, array(0.05, 0.5, 0.95))")
    return chronicle.groupBy("tracer").agg(F.count("*").alias("n"), F.min("value").alias("min"), q.alias("q"), F.max("value").alias("max")).select("tracer", "n", "min", F.col("q")[0].alias("q05"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q95"), "max")


def reference_curve(chronicle: DataFrame, tracers: DataFrame, year: float) -> DataFrame:
    """The history up to a year, decayed to it."""
    rates = tracers.select(F.col("name").alias("tracer"), "decay_rate")
    rows = chronicle.where(F.col("date") <= year).join(rates, "tracer")
    return rows.select("tracer", "date", decay(F.col("value"), F.col("decay_rate"), year - F.col("date")).alias("value"))


def common_trajectory(chronicle: DataFrame, tracers: list[str]) -> DataFrame:
    """A row a whole year of the overlap of the tracers' histories, a column each."""
    mine = chronicle.where(F.col("tracer").isin(tracers))
    span = mine.groupBy("tracer").agg(F.min("date").alias("a"), F.max("date").alias("b")).agg(F.ceil(F.max("a")).cast("int").alias("a"), F.floor(F.min("b")).cast("int").alias("b"))
    years = span.where("a <= b").select(F.explode(F.sequence("a", "b")).alias("x")).select(F.col("x").cast("double").alias("x"))
    names = mine.select("tracer").distinct()
    return interpolate(years.crossJoin(names), mine).groupBy("x").pivot("tracer", tracers).agg(F.first("value"))


def subdivide(df: DataFrame, lo: str, hi: str, n: int, out: str = "x") -> DataFrame:
    """n intervals between two columns, with both ends: n + 1 rows for each."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("i")).withColumn(out, F.col(lo) + (F.col(hi) - F.col(lo)) * F.col("i") / n)


def midmonth_grid(df: DataFrame, first: str, last: str) -> DataFrame:
    """Mid-months of the years from ``first`` to ``last`` as decimal years."""
    return df.select("*", F.explode(F.sequence(F.col(first).cast("int"), F.col(last).cast("int"))).alias("year")).select("*", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")).withColumn("x", F.col("year") + (F.col("month") - 0.5) / 12)


def prediction_grid(obs: DataFrame, before: float, n: int = 180) -> DataFrame:
    """``tracer, x``: a start before the observations, n points over their span, and their dates; each once."""
    span = obs.groupBy("tracer").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    regular = subdivide(span, "a", "b", n - 1).select("tracer", "x")
    return regular.unionByName(span.select("tracer", (F.col("a") - before).alias("x"))).unionByName(obs.select("tracer", F.col("date").alias("x"))).distinct()


def synthetic_inputs(grid: DataFrame, peaks: DataFrame) -> DataFrame:
    """``shape, x, value``: constant, ramp, step, pulse and a sum of Gaussian peaks (``centre, width, height``)."""
    x = F.col("x")
    shapes = F.array(
        F.struct(F.lit("constant").alias("shape"), F.lit(1.0).alias("value")),
        F.struct(F.lit("ramp").alias("shape"), F.greatest((x - 1995) / 10, F.lit(0.0)).alias("value")),
        F.struct(F.lit("step").alias("shape"), F.when(x >= 1998, 1.0).otherwise(0.0).alias("value")),
        F.struct(F.lit("pulse").alias("shape"), F.when((x >= 1997) & (x < 1999), 1.0).otherwise(0.0).alias("value")),
    )
    simple = grid.select("x", F.inline(shapes))
    gauss = grid.crossJoin(F.broadcast(peaks)).groupBy("x").agg(F.sum(F.col("height") * F.exp(-0.5 * F.pow((x - F.col("centre")) / F.col("width"), F.lit(2.0)))).alias("value"))
    return simple.unionByName(gauss.withColumn("shape", F.lit("peaks")))


def chronicle_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per tracer: dates in common, the greatest absolute difference there, rows and first dates of both."""
    both = old.join(new.withColumnRenamed("value", "new_value"), ["tracer", "date"]).groupBy("tracer").agg(F.count("*").alias("n_common"), F.max(F.abs(F.col("new_value") - F.col("value"))).alias("max_abs_diff"))
    a = old.groupBy("tracer").agg(F.count("*").alias("n_old"), F.min("date").alias("first_old"))
    b = new.groupBy("tracer").agg(F.count("*").alias("n_new"), F.min("date").alias("first_new"))
    return a.join(b, "tracer", "full").join(both, "tracer", "left")
