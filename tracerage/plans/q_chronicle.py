"""Queries of input histories (C rows)."""

from pyspark.sql import functions as F

from ..operators import chronicle as ch
from ..sources import fixtures as fx
from ..sources import io
from .registry import query

SEG = f"""{fx.CHRON}, seg as (select * from (select tracer, date as d1, value as v1, lead(date) over w as d2, lead(value) over w as v2, max(date) over (partition by tracer) as last from chron window w as (partition by tracer order by date)) where d2 is not null)"""


def interp(x: str, tracer: str) -> str:
    """SQL: the history of a tracer at x."""
    return f"coalesce((select max(v1 + (v2 - v1) * ({x} - d1) / (d2 - d1)) from seg where seg.tracer = {tracer} and d1 <= {x} and ({x} < d2 or ({x} = d2 and d2 = last))), 0.0)"


#: 25 points for each tracer, before, inside and after the histories.
POINTS = f"{SEG}, points as (select tracer, 1994.0::double + 0.37::double * i as x from (select distinct tracer from chron) cross join range(25) t(i))"


def points(spark, sf):
    names = fx.chronicle(spark, sf).select("tracer").distinct()
    return names.select("tracer", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("i")).select("tracer", (1994.0 + 0.37 * F.col("i")).alias("x"))


@query("c01_interpolate", f"with {POINTS} select p.tracer, round(p.x, 6) as x, round({interp('p.x', 'p.tracer')}, 4) as value from points p")
def c01(spark, sf):
    return ch.interpolate(points(spark, sf), fx.chronicle(spark, sf)).select("tracer", F.round("x", 6).alias("x"), F.round("value", 4).alias("value"))


@query("c01b_interpolate_observations", f"with {SEG}, {fx.OBS} select o.element as tracer, count(*) as n, round(avg(coalesce(v1 + (v2 - v1) * (o.date - d1) / (d2 - d1), 0.0)), 4) as value from obs o left join seg on seg.tracer = o.element and d1 <= o.date and (o.date < d2 or (o.date = d2 and d2 = last)) group by 1")
def c01b(spark, sf):
    pts = fx.observations(spark, sf).select(F.col("element").alias("tracer"), F.col("date").alias("x"))
    return ch.interpolate(pts, fx.chronicle(spark, sf)).groupBy("tracer").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("value"))


HOLD = "case when {x} < (select min(date) from chron c where c.tracer = {t}) then 10.0 when {x} > (select max(date) from chron c where c.tracer = {t}) then (select arg_max(value, date) from chron c where c.tracer = {t}) else {i} end"


def hold(x: str, t: str) -> str:
    return HOLD.format(x=x, t=t, i=interp(x, t))


@query("c02_interpolate_hold", f"with {POINTS} select p.tracer, round(p.x, 6) as x, round({hold('p.x', 'p.tracer')}, 4) as value from points p")
def c02(spark, sf):
    return ch.interpolate_hold(points(spark, sf), fx.chronicle(spark, sf), 10.0).select("tracer", F.round("x", 6).alias("x"), F.round("value", 4).alias("value"))


@query("c03_decay", f"with {fx.CHRON}, {fx.TRACER} select tracer, round(sum(value * exp(-coalesce(decay_rate, 0) * (2005 - date))), 2) as value from chron join tracers on name = tracer group by 1")
def c03(spark, sf):
    t = io.tracer_catalogue(fx.tracer_specs(spark)).select(F.col("name").alias("tracer"), "decay_rate")
    return fx.chronicle(spark, sf).join(t, "tracer").groupBy("tracer").agg(F.round(F.sum(ch.decay(F.col("value"), F.col("decay_rate"), 2005 - F.col("date"))), 2).alias("value"))


@query("c04_produce", f"with {fx.CHRON}, {fx.TRACER} select tracer, round(sum(case when decay_rate is null then 2.5::double * (2005 - date) else 2.5::double * (1 - exp(-decay_rate * (2005 - date))) / decay_rate end), 4) as value from chron join tracers on name = tracer group by 1")
def c04(spark, sf):
    t = io.tracer_catalogue(fx.tracer_specs(spark)).select(F.col("name").alias("tracer"), "decay_rate")
    return fx.chronicle(spark, sf).join(t, "tracer").groupBy("tracer").agg(F.round(F.sum(ch.produce(F.lit(2.5), F.col("decay_rate"), 2005 - F.col("date"))), 4).alias("value"))


def response(date: str, age: str, tracer: str) -> str:
    """SQL: the response of a tracer t (catalogue row) at a date to an age."""
    return f"((case when t.mode = 'constant' then t.constant else {interp(f'({date} - {age})', tracer)} end) * exp(-coalesce(t.decay_rate, 0) * ({age})) + coalesce(case when t.decay_rate is null then t.production_rate * ({age}) else t.production_rate * (1 - exp(-t.decay_rate * ({age}))) / t.decay_rate end, 0))"


@query("c05_tracer_response", f"with {POINTS}, {fx.TRACER} select p.tracer, round(p.x - 1994, 6) as age, round({response('2001.3::double', '(p.x - 1994)', 'p.tracer')}, 4) as k from points p join tracers t on t.name = p.tracer")
def c05(spark, sf):
    rows = points(spark, sf).select("tracer", (F.col("x") - 1994).alias("age"), F.lit(2001.3).alias("date"))
    return ch.tracer_response(rows, fx.chronicle(spark, sf), io.tracer_catalogue(fx.tracer_specs(spark))).select("tracer", F.round("age", 6).alias("age"), F.round("k", 4).alias("k"))


@query("c06_parent_daughter", f"with {POINTS}, r as (select p.tracer, p.x - 1994 as age, {hold('(2003.0::double - (p.x - 1994) - 1.5)', 'p.tracer')} * exp(-ln(2.0::double) / 12.32 * 1.5) as entry from points p) select tracer, round(age, 6) as age, round(entry * exp(-ln(2.0::double) / 12.32 * age), 4) as parent, round(entry * (1 - exp(-ln(2.0::double) / 12.32 * age)), 4) as daughter from r")
def c06(spark, sf):
    rows = points(spark, sf).select("tracer", (F.col("x") - 1994).alias("age"), F.lit(2003.0).alias("date"))
    return ch.parent_daughter(rows, fx.chronicle(spark, sf), 12.32, 1.5, True, 10.0).select("tracer", F.round("age", 6).alias("age"), F.round("parent", 4).alias("parent"), F.round("daughter", 4).alias("daughter"))


#: Mean responses at four sampling dates a tracer.
MEANS = f"""{SEG}, {fx.TRACER}, dates as (select tracer, 1998.0::double + i as date, min(c.date) as start from chron c cross join range(4) r(i) group by tracer, i),
pts as (select tracer, date, (date - start) * (1 - i / 1000.0::double) as age from dates cross join range(1000) r(i)),
k as (select p.tracer, p.date, (case when t.mode = 'constant' then t.constant else coalesce(v1 + (v2 - v1) * (p.date - age - d1) / (d2 - d1), 0.0) end) * exp(-coalesce(t.decay_rate, 0) * age)
  + coalesce(case when t.decay_rate is null then t.production_rate * age else t.production_rate * (1 - exp(-t.decay_rate * age)) / t.decay_rate end, 0) as k
  from pts p join tracers t on t.name = p.tracer left join seg on seg.tracer = p.tracer and d1 <= p.date - age and (p.date - age < d2 or (p.date - age = d2 and d2 = last)))"""


def sampling(spark, sf):
    names = fx.chronicle(spark, sf).select("tracer").distinct()
    return names.select("tracer", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).select("tracer", (1998.0 + F.col("i")).alias("date"))


@query("c07_mean_response", f"with {MEANS} select tracer, date, round(avg(k), 3) as mean_response from k group by all")
def c07(spark, sf):
    return ch.mean_response(sampling(spark, sf), fx.chronicle(spark, sf), io.tracer_catalogue(fx.tracer_specs(spark))).withColumn("mean_response", F.round("mean_response", 3))


@query("b11_fill_missing_errors", f"with {MEANS}, m as (select tracer, date, avg(k) as mean_response from k group by all), {fx.OBS} select well, element, case when error = 0 then 'mean_response' else 'given' end as error_method, count(*) as n, round(sum(case when error = 0 then 0.01::double * mean_response else error end), 4) as error from (select well, element, error, 1998.0::double + obs_id % 4 as date from obs) o join m on m.tracer = o.element and m.date = o.date group by all")
def b11(spark, sf):
    from ..operators import clean

    means = ch.mean_response(sampling(spark, sf), fx.chronicle(spark, sf), io.tracer_catalogue(fx.tracer_specs(spark))).withColumnRenamed("tracer", "element")
    obs = fx.observations(spark, sf).withColumn("date", 1998.0 + F.col("obs_id") % 4)
    return clean.fill_missing_errors(obs, means).groupBy("well", "element", "error_method").agg(F.count("*").alias("n"), F.round(F.sum("error"), 4).alias("error"))


@query("c08_chronicle_summary", f"with {fx.CHRON} select tracer, count(*) as n, min(value) as min, round(quantile_cont(value, 0.05), 6) as q05, round(median(value), 6) as median, round(quantile_cont(value, 0.95), 6) as q95, max(value) as max from chron group by 1")
def c08(spark, sf):
    return ch.chronicle_summary(fx.chronicle(spark, sf)).withColumns({c: F.round(c, 6) for c in ("q05", "median", "q95")})


@query("c09_reference_curve", f"with {fx.CHRON}, {fx.TRACER} select tracer, round(date, 6) as date, round(value * exp(-coalesce(decay_rate, 0) * (2000 - date)), 4) as value from chron join tracers on name = tracer where date <= 2000")
def c09(spark, sf):
    return ch.reference_curve(fx.chronicle(spark, sf), io.tracer_catalogue(fx.tracer_specs(spark)), 2000.0).select("tracer", F.round("date", 6).alias("date"), F.round("value", 4).alias("value"))


URGENT, HIGH = "'1-URGENT'", "'2-HIGH'"


@query("c10_common_trajectory", f"with {SEG}, span as (select ceil(max(a))::integer as a, floor(min(b))::integer as b from (select tracer, min(date) as a, max(date) as b from chron where tracer in ('1-URGENT', '2-HIGH') group by 1)), years as (select unnest(range(a, b + 1))::double as x from span) select x, round({interp('y.x', URGENT)}, 4) as urgent, round({interp('y.x', HIGH)}, 4) as high from years y")
def c10(spark, sf):
    return ch.common_trajectory(fx.chronicle(spark, sf), ["1-URGENT", "2-HIGH"]).select("x", F.round("1-URGENT", 4).alias("urgent"), F.round("2-HIGH", 4).alias("high"))


@query("c11_subdivide", f"with {fx.CHRON}, s as (select tracer, min(date) as a, max(date) as b from chron group by 1) select tracer, i::integer as i, round(a + (b - a) * i / 10, 6) as x from s cross join range(11) r(i)")
def c11(spark, sf):
    span = fx.chronicle(spark, sf).groupBy("tracer").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return ch.subdivide(span, "a", "b", 10).select("tracer", "i", F.round("x", 6).alias("x"))


@query("c12_prediction_grid", f"with {fx.OBS}, s as (select element as tracer, min(date) as a, max(date) as b from obs group by 1), g as (select tracer, a + (b - a) * i / 179 as x from s cross join range(180) r(i) union select tracer, a - 5 from s union select element, date from obs) select tracer, count(*) as n, round(min(x), 6) as first_x, round(max(x), 6) as last_x from g group by 1")
def c12(spark, sf):
    obs = fx.observations(spark, sf).select(F.col("element").alias("tracer"), "date")
    return ch.prediction_grid(obs, 5.0).groupBy("tracer").agg(F.count("*").alias("n"), F.round(F.min("x"), 6).alias("first_x"), F.round(F.max("x"), 6).alias("last_x"))


GRID = "span as (select min(year(o_orderdate)) as a, max(year(o_orderdate)) as b from orders), grid as (select year + (month - 0.5::double) / 12 as x from (select unnest(range(a, b + 1)) as year from span) cross join range(1, 13) r(month))"


def month_grid(spark, sf):
    span = fx.table(spark, sf, "orders").agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b"))
    return ch.midmonth_grid(span, "a", "b").select("x")


@query("c12b_midmonth_grid", f"with {GRID} select round(x, 6) as x from grid")
def c12b(spark, sf):
    return month_grid(spark, sf).select(F.round("x", 6).alias("x"))


@query("c13_synthetic_inputs", f"with {GRID}, peaks(centre, width, height) as (values (1996.5::double, 0.5::double, 10.0::double), (1999.0, 1.0, 5.0)) select 'constant' as shape, round(x, 6) as x, 1.0::double as value from grid union all select 'ramp', round(x, 6), round(greatest((x - 1995) / 10, 0), 8) from grid union all select 'step', round(x, 6), (x >= 1998)::integer::double from grid union all select 'pulse', round(x, 6), (x >= 1997 and x < 1999)::integer::double from grid union all select 'peaks', round(x, 6), round(sum(height * exp(-0.5 * pow((x - centre) / width, 2))), 8) from grid cross join peaks group by x")
def c13(spark, sf):
    peaks = spark.createDataFrame([(1996.5, 0.5, 10.0), (1999.0, 1.0, 5.0)], "centre double, width double, height double")
    return ch.synthetic_inputs(month_grid(spark, sf), peaks).select("shape", F.round("x", 6).alias("x"), F.round("value", 8).alias("value"))


@query("c14_chronicle_diff", f"with {fx.CHRON}, new as (select tracer, date, value + 3 as value from chron where date > 1996) select tracer, n_old, first_old, n_new, first_new, n_common, max_abs_diff from (select tracer, count(*) as n_old, round(min(date), 6) as first_old from chron group by 1) join (select tracer, count(*) as n_new, round(min(date), 6) as first_new from new group by 1) using (tracer) join (select o.tracer, count(*) as n_common, round(max(abs(n.value - o.value)), 6) as max_abs_diff from chron o join new n using (tracer, date) group by 1) using (tracer)")
def c14(spark, sf):
    old = fx.chronicle(spark, sf)
    new = old.where("date > 1996").withColumn("value", F.col("value") + 3)
    return ch.chronicle_diff(old, new).withColumns({c: F.round(c, 6) for c in ("first_old", "first_new", "max_abs_diff")})
