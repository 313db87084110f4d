"""The sample tables in the shapes of the data model, and the same as SQL text.

The only module that knows the sample schema. SQL texts are common table expressions for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .io import stored, tasks_for

ORDER = ["l_shipdate", "o_orderpriority", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def year_length(date) -> F.Column:
    return F.dayofyear(F.make_date(F.year(date), F.lit(12), F.lit(31)))


def decimal_date(date) -> F.Column:
    return F.year(date) + (F.dayofyear(date) - 1) / year_length(date)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


def observations(spark: SparkSession, sf_dir: str, wells: list | None = None) -> DataFrame:
    """``well, obs_id, element, concentration, error, unit, date``; obs_id counts a well's rows.

    All wells, or the given ones: their lines are stored first, so few are sent to the orders and
    those stay where they are.
    """
    w = Window.partitionBy("l_suppkey").orderBy(*ORDER)
    price = F.col("l_extendedprice")
    rows = lines(spark, sf_dir)
    if wells is not None:
        rows = stored(table(spark, sf_dir, "lineitem").where(F.col("l_suppkey").isin(wells)), "wells").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("l_suppkey").alias("well"),
        F.row_number().over(w).cast("long").alias("obs_id"),
        F.col("o_orderpriority").alias("element"),
        price.alias("concentration"),
        F.when(F.col("l_linenumber") == 1, 0.0).otherwise(0.05 * price).alias("error"),
        F.lit("pptv").alias("unit"),
        decimal_date("l_shipdate").alias("date"),
    )


OBS = """obs as (
  select l_suppkey as well, row_number() over (partition by l_suppkey order by l_shipdate, o_orderpriority, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) as obs_id,
    o_orderpriority as element, l_extendedprice as concentration, case when l_linenumber = 1 then 0.0 else 0.05::double * l_extendedprice end as error, 'pptv' as unit,
    year(l_shipdate) + (dayofyear(l_shipdate) - 1)::double / dayofyear(make_date(year(l_shipdate), 12, 31)) as date
  from lineitem join orders on l_orderkey = o_orderkey)"""


def chronicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tracer, date, value``: monthly means of order totals as input histories."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("tracer"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.round(F.avg("o_totalprice"), 4).alias("value")).select("tracer", (F.col("y") + (F.col("m") - 0.5) / 12).alias("date"), "value")


CHRON = """chron as (
  select o_orderpriority as tracer, year(o_orderdate) + (month(o_orderdate) - 0.5::double) / 12 as date, round(avg(o_totalprice), 4) as value
  from orders group by o_orderpriority, year(o_orderdate), month(o_orderdate))"""

#: name, unit, mode, constant, production_rate, half_life, mean_lifetime
TRACERS = [
    ("1-URGENT", "pptv", "chronicle", None, None, None, None),
    ("2-HIGH", "TU", "chronicle", None, None, 12.32, None),
    ("3-MEDIUM", "pmC", "chronicle", None, None, None, 8267.0),
    ("4-NOT SPECIFIED", "dpm", "constant", 1000.0, None, 268.0, None),
    ("5-LOW", "cm3/g", "chronicle", None, 2.5, 5.0, None),
]


def tracer_specs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRACERS, "name string, unit string, mode string, constant double, production_rate double, half_life double, mean_lifetime double")


TRACER = """specs(name, unit, mode, constant, production_rate, half_life, mean_lifetime) as (values
  ('1-URGENT', 'pptv', 'chronicle', null::double, null::double, null::double, null::double), ('2-HIGH', 'TU', 'chronicle', null, null, 12.32, null),
  ('3-MEDIUM', 'pmC', 'chronicle', null, null, null, 8267.0), ('4-NOT SPECIFIED', 'dpm', 'constant', 1000.0, null, 268.0, null), ('5-LOW', 'cm3/g', 'chronicle', null, 2.5, 5.0, null)),
tracers as (select *, case when half_life is not null then ln(2.0::double) / half_life when mean_lifetime is not null then 1.0::double / mean_lifetime end as decay_rate from specs)"""


def draws_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``case_id, chain, step, q, d, t, obj_function``: lines as draws of three parameters.

    A line's step is its place within its date, over the lines of the dates before: a chain of any
    length is spread over as many groups as it has dates. Dates are dealt over tasks by the number of
    lines and stay there: what a task sorts doesn't grow with the table. Dates are structs, in which
    nulls are equal, so counts meet the lines where these are.
    """
    day = F.struct("case_id", "chain", "l_shipdate").alias("__l_shipdate")
    lines = table(spark, sf_dir, "lineitem")
    tasks = tasks_for(lines)
    lines = lines.withColumns({"case_id": F.col("l_returnflag"), "chain": F.col("l_linenumber").cast("long")}).select("*", day)
    ahead = Window.partitionBy("__l_shipdate.case_id", "__l_shipdate.chain").orderBy("__l_shipdate.l_shipdate").rowsBetween(Window.unboundedPreceding, -1)
    dates = lines.groupBy("__l_shipdate").agg(F.count("*").alias("__c")).select(F.col("__l_shipdate").alias("__day"), F.coalesce(F.sum("__c").over(ahead), F.lit(0)).alias("__ahead"))
    within = Window.partitionBy("__l_shipdate").orderBy("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus")
    placed = lines.repartition(tasks, "__l_shipdate").withColumn("__at", F.row_number().over(within)).join(dates, F.col("__l_shipdate") == F.col("__day"))
    return placed.select("case_id", "chain", (F.col("__at") + F.col("__ahead")).cast("long").alias("step"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"), F.col("l_extendedprice").alias("obj_function"))


DRAWS = """wide as (
  select l_returnflag as case_id, l_linenumber::bigint as chain, row_number() over (partition by l_returnflag, l_linenumber order by l_shipdate, l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus) as step,
    l_quantity as q, l_discount as d, l_tax as t, l_extendedprice as obj_function from lineitem),
draws as (select case_id, chain, step, 'q' as param, q as value from wide union all select case_id, chain, step, 'd', d from wide union all select case_id, chain, step, 't', t from wide)"""


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``case_id, chain, step, param, value``."""
    return draws_wide(spark, sf_dir).unpivot(["case_id", "chain", "step"], ["q", "d", "t"], "param", "value")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``day, element, value``: the greatest event value of a day and type."""
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("element")).agg(F.max("value").alias("value"))


DAILY = "daily as (select ts::date as day, event_type as element, max(value) as value from events group by all)"

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run, well, element, n, mean, sd``: the observation summary of two halves of the lines."""
    rows = lines(spark, sf_dir).withColumn("run", F.when(F.col("l_linenumber") <= 3, "A").otherwise("B"))
    return rows.groupBy("run", F.col("l_suppkey").alias("well"), F.col("o_orderpriority").alias("element")).agg(F.count("*").alias("n"), F.avg("l_extendedprice").alias("mean"), F.stddev_samp("l_extendedprice").alias("sd"))


RUNS = """runs as (
  select case when l_linenumber <= 3 then 'A' else 'B' end as run, l_suppkey as well, o_orderpriority as element, count(*) as n, avg(l_extendedprice) as mean, stddev_samp(l_extendedprice) as sd
  from lineitem join orders on l_orderkey = o_orderkey group by all)"""


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model, noise, seed, part, truth, estimate``: a part's mean price as truth, each line's as estimate."""
    t = table(spark, sf_dir, "lineitem")
    mean = t.groupBy(F.col("l_partkey").alias("part")).agg(F.floor(F.avg("l_extendedprice") + 0.000777).cast("double").alias("truth"))
    return t.select(F.col("l_returnflag").alias("model"), F.col("l_linenumber").cast("long").alias("noise"), F.col("l_suppkey").alias("seed"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("estimate")).join(mean, "part").select("model", "noise", "seed", "part", "truth", "estimate")


TRUTH = """truth as (
  select l_returnflag as model, l_linenumber::bigint as noise, l_suppkey as seed, l_partkey as part, m.truth, l_extendedprice as estimate
  from lineitem join (select l_partkey as p, floor(avg(l_extendedprice) + 0.000777) as truth from lineitem group by 1) m on m.p = l_partkey)"""
