"""Queries of the readers, writers and catalogues (A rows)."""

from pyspark.sql import functions as F

from ..sources import fixtures as fx
from ..sources import io
from .registry import query

OBS_COLS = ["well", "obs_id", "element", "concentration", "error", "unit", "date"]


@query("a01_read_observations", f"with {fx.OBS} select well, obs_id, element, concentration, error, unit, round(date, 6) as date from obs")
def a01(spark, sf):
    path = io.scratch(spark, "a01")
    io.write_table(fx.observations(spark, sf).withColumn("error", F.when(F.col("error") > 0, F.col("error"))), path, "tsv")
    return io.read_observations(spark, path).withColumn("date", F.round("date", 6))


@query("a02_read_wide_raw", f"with {fx.DAILY} select day::varchar as date, element, 'pptv' as unit, value from daily where value > 0")
def a02(spark, sf):
    path = io.scratch(spark, "a02")
    wide = io.to_wide_series(fx.daily(spark, sf), fx.EVENT_TYPES, "day")
    head = spark.createDataFrame([(0, "\t".join(["element", *fx.EVENT_TYPES])), (1, "\t".join(["unit", *["pptv"] * len(fx.EVENT_TYPES)]))], "ord int, value string")
    body = wide.select(F.lit(2).alias("ord"), F.concat_ws("\t", F.col("day").cast("string"), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fx.EVENT_TYPES)).alias("value"), (F.dayofmonth("day") % 2).alias("odd"))
    for odd in (0, 1):  # two raw files, each with its header lines
        rows = head.unionByName(body.where(F.col("odd") == odd).drop("odd"))
        rows.coalesce(1).sortWithinPartitions("ord").select("value").write.text(f"{path}/raw-{odd}")
    return io.read_wide_raw(spark, f"{path}/*")


@query("a03_unpivot_measurements", f"with {fx.DAILY} select day, element, value as concentration from daily")
def a03(spark, sf):
    return io.unpivot_measurements(io.to_wide_series(fx.daily(spark, sf), fx.EVENT_TYPES, "day"), ["day"], fx.EVENT_TYPES)


@query("a04_read_chronicle", f"with {fx.CHRON} select tracer, round(date, 6) as date, value from chron")
def a04(spark, sf):
    path = io.scratch(spark, "a04")
    rows = fx.chronicle(spark, sf)
    text = rows.select("tracer", F.concat_ws(",", "date", "value").alias("value"))
    text.unionByName(rows.select("tracer", F.concat(F.lit("# input history of "), "tracer").alias("value")).distinct()).write.partitionBy("tracer").text(path)
    return io.read_chronicle(spark, path).withColumn("date", F.round("date", 6))


@query("a05_clean_chronicle", f"with {fx.CHRON} select tracer, round(date, 6) as date, round(value * 0.01::double, 7) as value from chron")
def a05(spark, sf):
    dirty = fx.chronicle(spark, sf).select("tracer", F.concat(F.lit(" "), F.col("date").cast("string")).alias("date"), F.concat(F.replace(F.col("value").cast("string"), F.lit("."), F.lit("..")), F.lit("  ")).alias("value"))
    noise = dirty.limit(1).select("tracer", F.lit("n/a").alias("date"), F.lit("-").alias("value"))
    return io.clean_chronicle(dirty.unionByName(noise), 0.01).select("tracer", F.round("date", 6).alias("date"), F.round("value", 7).alias("value"))


@query("a06_read_draws", f"with {fx.DRAWS} select case_id, count(*) as n, sum(step)::bigint as steps, round(sum(q), 2) as q from wide group by case_id")
def a06(spark, sf):
    path = io.scratch(spark, "a06")
    rows = fx.draws_wide(spark, sf)
    io.write_table(rows, path, "tsv.gz")
    return io.read_draws(spark, path, rows.schema).groupBy("case_id").agg(F.count("*").alias("n"), F.sum("step").alias("steps"), F.round(F.sum("q"), 2).alias("q"))


@query("a06b_read_histograms", f"with {fx.DRAWS} select param as parameter, floor(value * 10) / 10 as val, count(*)::double as hist from draws group by all")
def a06b(spark, sf):
    path = io.scratch(spark, "a06b")
    rows = fx.draws(spark, sf).groupBy(F.col("param").alias("parameter"), (F.floor(F.col("value") * 10) / 10).alias("val")).agg(F.count("*").cast("double").alias("hist"))
    rows.write.partitionBy("parameter").csv(path, sep="\t", header=True)
    return io.read_histograms(spark, path)


@query("a06c_read_statistics", f"with {fx.DRAWS} select param as parameter, round(avg(value), 8) as mean, round(stddev_samp(value), 8) as std from draws group by 1")
def a06c(spark, sf):
    path = io.scratch(spark, "a06c")
    rows = fx.draws(spark, sf).groupBy(F.col("param").alias("index")).agg(F.round(F.avg("value"), 8).alias("mean"), F.round(F.stddev_samp("value"), 8).alias("std"))
    io.write_table(rows, path, "tsv")
    return io.read_statistics(spark, path, ["mean", "std"])


@query("a07_read_key_values", "select (o_custkey % 50)::integer as run, count(*)::varchar as n, min(o_orderpriority) as first_priority, max(o_orderkey)::varchar as last_order from orders group by 1")
def a07(spark, sf):
    path = io.scratch(spark, "a07")
    orders = fx.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 50).alias("run")).agg(F.count("*").cast("string").alias("n"), F.min("o_orderpriority").alias("first_priority"), F.max("o_orderkey").cast("string").alias("last_order"))
    lines = orders.unpivot(["run"], ["n", "first_priority", "last_order"], "k", "v").select("run", F.concat_ws("\t", "k", "v").alias("value"))
    lines.write.partitionBy("run").text(path)
    return io.read_key_values(spark, path, "run", ["n", "first_priority", "last_order"])


@query("a08_harvest", "select l_returnflag as scenario, l_linenumber::varchar as well, count(*) as n, round(sum(l_quantity), 2) as total from lineitem group by 1, 2")
def a08(spark, sf):
    path = io.scratch(spark, "a08")
    fx.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("scenario"), F.col("l_linenumber").alias("well"), "l_quantity").write.partitionBy("scenario", "well").parquet(path)
    rows = io.harvest(spark, path, r"scenario=([^/]+)/well=([^/]+)/", ["scenario", "well"], "l_quantity double")
    return rows.groupBy("scenario", "well").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


@query("a08b_harvest_text", "select l_returnflag as scenario, 'w' || l_suppkey % 3 as well, count(*) as n, round(sum(l_quantity), 2) as total from lineitem group by 1, 2")
def a08b(spark, sf):
    path = io.scratch(spark, "a08b")
    rows = fx.table(spark, sf, "lineitem").select("l_returnflag", F.concat(F.lit("w"), (F.col("l_suppkey") % 3).cast("string")).alias("well"), "l_quantity", "l_orderkey")
    rows.write.partitionBy("l_returnflag", "well").csv(f"{path}/runs", sep="\t", header=True)
    spark.range(5).selectExpr("double(id) as l_quantity", "id as l_orderkey").write.csv(f"{path}/other", sep="\t", header=True)
    got = io.harvest(spark, path, r"l_returnflag=([^/]+)/well=([^/]+)/", ["scenario", "well"], "l_quantity double, l_orderkey long", "tsv", "*.csv")
    return got.groupBy("scenario", "well").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


@query("a09_latest_per", "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1")
def a09(spark, sf):
    return io.latest_per(fx.table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("a10_read_result_json", f"with {fx.DAILY}, agg as (select day::varchar as case_id, min(value) as lo, max(value) as hi from daily group by 1) select case_id, element as tracer, value, t.attempt, case when t.attempt = 0 then lo else hi end as objective from daily join agg on case_id = day::varchar cross join (values (0), (1)) t(attempt)")
def a10(spark, sf):
    path = io.scratch(spark, "a10")
    rows = fx.daily(spark, sf).groupBy(F.col("day").cast("string").alias("case_id")).agg(F.map_from_entries(F.collect_list(F.struct("element", "value"))).alias("values"), F.array(F.min("value"), F.max("value")).alias("attempts"))
    io.write_table(rows, path, "json")
    return io.read_result_json(spark, path, "case_id string, values map<string,double>, attempts array<double>")


@query("a10b_event_properties", "select event_type, count(*) as n, sum((props->>'$.k')::bigint)::bigint as k from events group by 1")
def a10b(spark, sf):
    return fx.table(spark, sf, "events").withColumn("p", F.from_json("props", "k long")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k"))


@query("a11_write_table", f"with {fx.OBS} select form, element, count(*) as n from obs cross join (values ('tsv.gz'), ('json'), ('parquet')) f(form) group by all")
def a11(spark, sf):
    rows, out = fx.observations(spark, sf).select("well", "element", "concentration"), None
    for form in ("tsv.gz", "json", "parquet"):
        path = io.scratch(spark, "a11")
        io.write_table(rows, path, form)
        back = spark.read.schema(rows.schema)
        back = back.csv(path, sep="\t", header=True) if form == "tsv.gz" else back.json(path) if form == "json" else back.parquet(path)
        part = back.groupBy("element").agg(F.count("*").alias("n")).withColumn("form", F.lit(form))
        out = part if out is None else out.unionByName(part)
    return out


@query("a12_to_wide_series", f"with {fx.DAILY} select day, max(value) filter (element = 'click') as click, max(value) filter (element = 'error') as error, max(value) filter (element = 'signup') as signup, max(value) filter (element = 'purchase') as purchase, max(value) filter (element = 'view') as view from daily group by day")
def a12(spark, sf):
    return io.to_wide_series(fx.daily(spark, sf), fx.EVENT_TYPES, "day")


@query("a13_write_per_well", f"with {fx.OBS} select well::integer as well, count(*) as n, round(sum(concentration), 2) as total from obs group by 1")
def a13(spark, sf):
    path = io.scratch(spark, "a13")
    io.write_per_group(fx.observations(spark, sf), path)
    return spark.read.parquet(path).groupBy("well").agg(F.count("*").alias("n"), F.round(F.sum("concentration"), 2).alias("total"))


CATALOGUE = """spec as (
  select l_returnflag as model, p.ord, p.name, 0.0::double as lo, 100000.0::double as hi, true as inclusive,
    case p.ord when 0 then min(l_quantity) when 1 then min(l_discount) else min(l_tax) end as cal_lo, case p.ord when 0 then max(l_quantity) when 1 then max(l_discount) else max(l_tax) end as cal_hi,
    case p.ord when 0 then 25.0 when 1 then 0.05 else 0.5 end::double as init, case p.ord when 0 then 1.0 when 1 then 0.01 else 0.0 end::double as step
  from lineitem cross join (values (0, 'q'), (1, 'd'), (2, 't')) p(ord, name) group by l_returnflag, p.ord, p.name)"""


def catalogue(spark, sf):
    """Parameter specifications per model, their calibration ranges from the lines."""
    lines = fx.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(*(f(c).alias(f"{n}_{k}") for c, n in (("l_quantity", "q"), ("l_discount", "d"), ("l_tax", "t")) for f, k in ((F.min, "lo"), (F.max, "hi"))))
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), F.col(f"{n}_lo").alias("cal_lo"), F.col(f"{n}_hi").alias("cal_hi"), F.lit(a).alias("init"), F.lit(b).alias("step")) for i, (n, a, b) in enumerate((("q", 25.0, 1.0), ("d", 0.05, 0.01), ("t", 0.5, 0.0)))))
    return lines.select("model", F.inline(rows)).withColumns({"lo": F.lit(0.0), "hi": F.lit(100000.0), "inclusive": F.lit(True)})


@query("a14_parameter_catalogue", f"with {CATALOGUE} select *, (cal_lo >= lo and cal_lo <= hi and cal_hi >= lo and cal_hi <= hi and cal_lo < cal_hi) as range_ok, init between cal_lo and cal_hi as init_ok, step > 0 as step_ok from spec")
def a14(spark, sf):
    return io.parameter_catalogue(catalogue(spark, sf))


@query("a15_tracer_catalogue", f"with {fx.TRACER} select name, unit, mode, constant, production_rate, half_life, mean_lifetime, round(decay_rate, 9) as decay_rate, count(*) as n from tracers join orders on name = o_orderpriority group by all")
def a15(spark, sf):
    used = fx.table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    rows = io.tracer_catalogue(fx.tracer_specs(spark)).join(used, F.col("name") == F.col("o_orderpriority"))
    return rows.drop("o_orderpriority").withColumn("decay_rate", F.round("decay_rate", 9))
