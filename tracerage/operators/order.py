"""Windows, ordering and set operations (I rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import stored, tasks_for


def pair_tracers(obs: DataFrame, a: str, b: str, order: str) -> DataFrame:
    """Replicates of a day side by side: the i-th of tracer a with the i-th of tracer b, where both are."""
    w = Window.partitionBy("day", "element").orderBy(order)
    rows = obs.where(F.col("element").isin(a, b)).withColumn("replicate", F.row_number().over(w))
    wide = rows.groupBy("day", "replicate").pivot("element", [a, b]).agg(F.first("value"))
    return wide.where(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull())


def _in_ranges(df: DataFrame, keys: list[str], order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Rows dealt in ranges of (keys, order), with ``__slot``, the range, and ``__key__slot``, keys and range as a struct, in which nulls are equal.

    Rows are stored first: their number tells that of the ranges, so a range doesn't grow with the
    table. The second frame has them dealt by ``__key__slot`` to as many tasks, where windows and joins
    by it leave them.
    """
    once = stored(df, name)
    tasks = tasks_for(once)
    rows = stored(once.repartitionByRange(tasks, *keys, *order).withColumn("__slot", F.spark_partition_id()), name)
    rows = rows.withColumn("__key__slot", F.struct(*keys, "__slot"))
    return rows, rows.repartition(tasks, "__key__slot")


def _slots(rows: DataFrame, keys: list[str], *aggs) -> tuple[DataFrame, Window]:
    """A row for each ``__key__slot`` with sums over its rows, and the window of the ranges of a group."""
    return rows.groupBy("__key__slot").agg(*aggs).withColumnRenamed("__key__slot", "__range"), Window.partitionBy(*(F.col("__range")[k] for k in keys))


def value_places(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """``keys, value, count, before, total``: how often each distinct value of a group comes, and how many are less.

    Counted map-side, dealt over tasks in ranges of (keys, value), stored, and added up within a
    range and over ranges: a group of any size, of many or of few values, is spread over tasks.
    Nulls and NaN aren't counted. With ``weight`` a row stands for so many.
    """
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = known.groupBy(*keys, F.col(value).alias("value")).agg((F.count("*") if weight is None else F.sum(weight)).alias("count"))
    rows, dealt = _in_ranges(counts, keys, ["value"], "places")
    slots, w = _slots(rows, keys, F.sum("count").alias("__sum"))
    slots = slots.select("__range", F.coalesce(F.sum("__sum").over(w.orderBy("__range.__slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"), F.sum("__sum").over(w).alias("total"))
    inner = Window.partitionBy("__key__slot").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("before", F.coalesce(F.sum("count").over(inner), F.lit(0))).join(slots, F.col("__key__slot") == F.col("__range"))
    return placed.select(*keys, "value", "count", (F.col("before") + F.col("__ahead")).alias("before"), "total")


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """Rows with their place ``out`` (from 1) in order within the keys, and the group's size ``__n``.

    Rows are dealt in ranges of (keys, order), stored, and numbered within a range; sizes of the
    ranges before are added. A group of any size is spread over tasks; only rows that agree in
    everything that orders them stay together.
    """
    rows, dealt = _in_ranges(df, keys, order, "ranked")
    slots, w = _slots(rows, keys, F.count("*").alias("__c"))
    slots = slots.select("__range", F.coalesce(F.sum("__c").over(w.orderBy("__range.__slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"), F.sum("__c").over(w).alias("__n"))
    placed = dealt.withColumn(out, F.row_number().over(Window.partitionBy("__key__slot").orderBy(*order))).join(slots, F.col("__key__slot") == F.col("__range"))
    return placed.withColumn(out, F.col(out) + F.col("__ahead")).drop("__slot", "__key__slot", "__range", "__ahead")


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``keys`` and a column for each share: exact quantiles, linear between neighbouring values.

    The same numbers as a percentile() of the group, without any group's values in one buffer.
    """
    return quantiles_of(value_places(df, keys, value), keys, shares)


def quantiles_of(places: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """quantiles() from value_places()."""
    aggs = []
    for name, p in shares.items():
        at = (F.col("total") - 1) * F.lit(float(p))
        low, high = F.floor(at), F.ceil(at)
        held = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("count")), F.col("value")))
        share = F.max(at - low)
        aggs.append((held(low) + (held(high) - held(low)) * share).alias(name))
    return places.groupBy(*keys).agg(*aggs)


def average_rank(df: DataFrame, keys: list[str], value: str, out: str = "rank") -> DataFrame:
    """Ranks from 1 within the keys; equal values share the mean of theirs. Nulls and NaN have none."""
    places = value_places(df, keys, value).select(*keys, F.col("value").alias(value), (F.col("before") + (F.col("count") + 1) / 2).alias(out))
    return df.join(places, [*keys, value], "left")


def even_sample(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """k rows of each group evenly spaced in order: places rint(i * (n - 1) / (k - 1)), halves to even."""
    rows = ranked(df, keys, order, "__at").withColumn("__at", F.col("__at") - 1)
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (F.col("__n") - 1) / (k - 1)).cast("long")))
    return rows.where(F.array_contains(places, F.col("__at").cast("long"))).drop("__at", "__n")


def running(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows with a running ``sum``, ``min`` or ``max`` for each ``out: (value, fold)``, in order within the keys.

    Rows are dealt in ranges of (keys, order), stored, and folded within a range; what the ranges
    before come to is put ahead. A group of any size is spread over tasks. Nulls don't count; a
    running value is null as long as nothing has come. Rows should differ in what orders them:
    those that don't stay in one range, in any order.
    """
    folds = {"sum": F.sum, "min": F.min, "max": F.max}
    join = {"sum": lambda a, b: F.coalesce(a + b, a, b), "min": F.least, "max": F.greatest}
    rows, dealt = _in_ranges(df, keys, order, "running")
    slots, w = _slots(rows, keys, *(folds[how](value).alias(f"__v{i}") for i, (value, how) in enumerate(columns.values())))
    ahead = w.orderBy("__range.__slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("__range", *(folds[how](f"__v{i}").over(ahead).alias(f"__a{i}") for i, (_, how) in enumerate(columns.values())))
    inner = Window.partitionBy("__key__slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumns({f"__r{i}": folds[how](value).over(inner) for i, (value, how) in enumerate(columns.values())})
    placed = placed.join(slots, F.col("__key__slot") == F.col("__range"))
    placed = placed.withColumns({out: join[how](F.col(f"__r{i}"), F.col(f"__a{i}")) for i, (out, (_, how)) in enumerate(columns.items())})
    return placed.drop("__slot", "__key__slot", "__range", *(f"__{x}{i}" for x in "ra" for i in range(len(columns))))


def cummin(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """The least value so far, in order within the keys; groups of any size."""
    return running(df, keys, order, {out: (value, "min")})


def ordered(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """``place`` of a value in a given order; values that aren't in it come last."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return df.withColumn("place", F.when(at > 0, at).otherwise(len(order) + 1).cast("long"))


def append_draws(a: DataFrame, b: DataFrame, strict: bool = True) -> DataFrame:
    """Two tables one after the other; with ``strict`` of the same columns, otherwise of all."""
    if strict and set(a.columns) != set(b.columns):
        raise ValueError(f"columns differ: {sorted(set(a.columns) ^ set(b.columns))}")
    return a.unionByName(b, allowMissingColumns=not strict)


def distinct_in_order(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Distinct values with the place where each comes first."""
    return df.groupBy(*keys).agg(F.min(order).alias("first_at"))


def step_changes(draws: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """``accepted``: whether a row differs from the one before it in its chain (null for the first).

    Rows are dealt in ranges of (keys, order), stored, and compared within a range; a range's first row
    meets the last one of the range before. A chain of any length is spread over tasks.
    """
    rows, dealt = _in_ranges(draws, keys, [order], "steps")
    state = F.struct(F.col(order).alias("at"), *(F.col(c).alias(f"v{i}") for i, c in enumerate(columns)))
    slots, ranges = _slots(rows, keys, F.max_by(state, order).alias("__last"))
    slots = slots.select("__range", F.lag("__last").over(ranges.orderBy("__range.__slot")).alias("__before"))
    w = Window.partitionBy("__key__slot").orderBy(order)
    placed = dealt.withColumns({"__first": F.row_number().over(w) == 1, "__lag": F.lag(state).over(w)}).join(slots, F.col("__key__slot") == F.col("__range"))
    placed = placed.withColumn("__lag", F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__lag")))
    same = F.lit(True)
    for i, c in enumerate(columns):
        same = same & (F.col(c) == F.col("__lag")[f"v{i}"])
    return placed.withColumn("accepted", F.when(F.col("__lag")["at"].isNotNull(), ~same)).select(*draws.columns, "accepted")
