"""Queries of cleaning and validation (B rows)."""

from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..operators import clean
from ..sources import fixtures as fx
from .q_sources import CATALOGUE, catalogue
from .registry import query

#: Observations as text with flaws: every 97th value isn't a number, every 89th error is negative, every 83rd element blank.
DIRTY = f"""{fx.OBS}, dirty as (
  select well, obs_id, case when obs_id % 83 = 0 then ' ' else ' ' || element end as element, case when obs_id % 97 = 0 then 'x' when obs_id % 101 = 0 then 'NaN' else round(concentration, 2)::varchar end as concentration,
    case when obs_id % 89 = 0 then '-1.0' else '1.0' end as error from obs)"""


def dirty(spark, sf):
    i = F.col("obs_id")
    return fx.observations(spark, sf).select("well", "obs_id", F.when(i % 83 == 0, " ").otherwise(F.concat(F.lit(" "), "element")).alias("element"), F.when(i % 97 == 0, "x").when(i % 101 == 0, "NaN").otherwise(F.round("concentration", 2).cast("string")).alias("concentration"), F.when(i % 89 == 0, "-1.0").otherwise("1.0").alias("error"))


@query("b01_violations", f"with {DIRTY} select well, obs_id, 'concentration_not_finite' as rule from dirty where concentration in ('x', 'NaN') union all select well, obs_id, 'error_negative' from dirty where error = '-1.0' union all select well, obs_id, 'element_blank' from dirty where trim(element) = ''")
def b01(spark, sf):
    return clean.validate_observations(dirty(spark, sf))[0]


@query("b01b_clean_rows", f"with {DIRTY} select well, trim(element) as element, count(*) as n from dirty where concentration not in ('x', 'NaN') and error <> '-1.0' and trim(element) <> '' group by all")
def b01b(spark, sf):
    return clean.validate_observations(dirty(spark, sf))[1].groupBy("well", "element").agg(F.count("*").alias("n"))


@query("b02_normalize_series", f"with {fx.DAILY} select element, (year(day) + (dayofyear(day) - 1) / 366.0::double).round(9) as date, value as concentration, row_number() over (partition by element order by day, value) as at from daily")
def b02(spark, sf):
    rows = fx.daily(spark, sf).select("element", fx.decimal_date("day").alias("date"), F.col("value").alias("concentration"))
    return clean.normalize_series(rows).withColumn("date", F.round("date", 9))


UNIT_ROWS = "units as (select *, case (o_custkey % 7) when 0 then 'pptv' when 1 then ' PPTV ' when 2 then 'n/a' when 3 then '%modern' when 4 then 'furlong' when 5 then null else 'pmC' end as unit from orders)"


def unit_rows(spark, sf):
    k = F.col("o_custkey") % 7
    return fx.table(spark, sf, "orders").withColumn("unit", F.when(k == 0, "pptv").when(k == 1, " PPTV ").when(k == 2, "n/a").when(k == 3, "%modern").when(k == 4, "furlong").when(k == 5, F.lit(None)).otherwise("pmC"))


@query("b03_check_units", f"with {UNIT_ROWS} select coalesce(unit, '?') as unit, case lower(trim(unit)) when 'pptv' then 'pptv' when '%modern' then 'pmC' when 'pmc' then 'pmC' end as canonical, case when unit is null or unit = 'n/a' then 'placeholder' when unit = 'furlong' then 'custom' when unit in (' PPTV ') then 'ok' when unit = '%modern' then 'recase' else 'ok' end as status0, count(*) as n from units group by all".replace("when unit in (' PPTV ') then 'ok'", "when unit = ' PPTV ' then 'recase'").replace("status0", "status"))
def b03(spark, sf):
    rows = clean.check_units(unit_rows(spark, sf).select("unit"))
    return rows.groupBy(F.coalesce("unit", F.lit("?")).alias("unit"), "canonical", "status").agg(F.count("*").alias("n"))


@query("b04_unit_consistency", f"with {UNIT_ROWS} select o_orderpriority as element, count(distinct unit) as n_units, min(unit) as first_unit, max(unit) as last_unit from units group by 1")
def b04(spark, sf):
    return clean.unit_consistency(unit_rows(spark, sf).select(F.col("o_orderpriority").alias("element"), "unit"))


@query("b05_unit_mismatches", f"with {fx.OBS}, {fx.TRACER}, seen as (select case when well = 1 then 'helium' else element end as element, unit, count(*) as n from obs group by all) select element, s.unit, t.unit as expected, n, case when t.unit is null then 'undeclared' else 'mismatch' end as problem from seen s left join tracers t on name = element where t.unit is null or t.unit <> s.unit")
def b05(spark, sf):
    obs = fx.observations(spark, sf).withColumn("element", F.when(F.col("well") == 1, "helium").otherwise(F.col("element")))
    return clean.unit_mismatches(obs, fx.tracer_specs(spark))


@query("b06_normalize_tracer", "select raw, case when raw like 'CFC%' then 'cfc' || k end as tracer, n from (select case when o_custkey % 3 = 0 then ' CFC-' || (o_custkey % 114)::varchar when o_custkey % 3 = 1 then 'SF-' || (o_custkey % 114)::varchar else 'CFC' || (o_custkey % 114)::varchar end as raw0, trim(raw0) as raw, (o_custkey % 114)::varchar as k, count(*) as n from orders group by all)")
def b06(spark, sf):
    k = F.col("o_custkey") % 3
    number = (F.col("o_custkey") % 114).cast("string")
    rows = fx.table(spark, sf, "orders").select(F.when(k == 0, F.concat(F.lit(" CFC-"), number)).when(k == 1, F.concat(F.lit("SF-"), number)).otherwise(F.concat(F.lit("CFC"), number)).alias("raw"))
    return rows.groupBy(F.trim("raw").alias("raw"), sc.normalize_tracer("raw").alias("tracer")).agg(F.count("*").alias("n"))


@query("b07_decimal_year", "select strftime(o_orderdate, '%d/%m/%Y') as day, round(year(o_orderdate) + (dayofyear(o_orderdate) - 1)::double / dayofyear(make_date(year(o_orderdate), 12, 31)), 9) as date, count(*) as n from orders group by all")
def b07(spark, sf):
    rows = fx.table(spark, sf, "orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"))
    return rows.groupBy("day").agg(F.count("*").alias("n")).withColumn("date", F.round(sc.decimal_year("day"), 9))


@query("b08_decimal_year_2digit", "select strftime(o_orderdate, '%d-%m-%y') as day, round_even(year(o_orderdate) + (dayofyear(o_orderdate) - 1)::double / dayofyear(make_date(year(o_orderdate), 12, 31)), 5) as date, count(*) as n from orders group by all")
def b08(spark, sf):
    rows = fx.table(spark, sf, "orders").select(F.date_format("o_orderdate", "dd-MM-yy").alias("day"))
    return rows.groupBy("day").agg(F.count("*").alias("n")).withColumn("date", sc.decimal_year_2digit("day", 5))


@query("b09_positive_only", "select event_type, count(*) as n, round(sum(value - 20), 2) as total from events where value - 20 > 0 group by 1")
def b09(spark, sf):
    rows = fx.table(spark, sf, "events").select("event_type", (F.col("value") - 20).alias("concentration"))
    return clean.positive_only(rows).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("concentration"), 2).alias("total"))


@query("b10_date_labels", "select y, case when half = 0 then y::varchar else y::varchar || '_5' end as label, y as calendar_year, n from (select year(o_orderdate) as y, (month(o_orderdate) > 6)::integer as half, count(*) as n from orders group by all)")
def b10(spark, sf):
    date = F.year("o_orderdate") + F.when(F.month("o_orderdate") > 6, 0.5).otherwise(0.0)
    rows = fx.table(spark, sf, "orders").groupBy(date.alias("date")).agg(F.count("*").alias("n"))
    return rows.select(sc.calendar_year("date").alias("y"), sc.date_label("date").alias("label"), sc.calendar_year("date").alias("calendar_year"), "n")


@query("b12_relative_errors", f"with {fx.OBS} select well, element, round(avg(0.1::double * abs(concentration)), 6) as error, 'relative' as error_method from obs group by all")
def b12(spark, sf):
    return clean.set_relative_errors(fx.observations(spark, sf), 0.1).groupBy("well", "element", "error_method").agg(F.round(F.avg("error"), 6).alias("error"))


@query("b13_error_provenance", f"with {fx.OBS} select well, case when error = 0 then 'mean_response' else 'given' end as error_method, count(*) as n, min(obs_id) as first_id, max(obs_id) as last_id from obs group by all")
def b13(spark, sf):
    return clean.error_provenance(fx.observations(spark, sf).withColumn("error_method", F.when(F.col("error") == 0, "mean_response").otherwise("given")))


@query("b14_observation_keys", f"with {fx.OBS} select well, obs_id, case when obs_id % 10 = 0 then 'X' else element end || '@' || floor(date)::bigint::varchar || '#' || obs_id::varchar as key, case when obs_id % 10 = 0 then 'X' else element end as element, floor(date)::double as date, obs_id as index, obs_id % 10 <> 0 as matches from obs")
def b14(spark, sf):
    obs = fx.observations(spark, sf).select("well", "obs_id", "element", F.floor("date").alias("date"))
    own = F.when(F.col("obs_id") % 10 == 0, "X").otherwise(F.col("element"))  # a tenth of the keys don't match
    keyed = obs.withColumn("key", sc.observation_key(own, F.col("date"), F.col("obs_id"))).select("well", "obs_id", "key")
    return clean.checked_keys(clean.parse_keys(keyed), obs, ["well"]).select("well", "obs_id", "key", "element", "date", "index", "matches")


CASES = "cases as (select s_suppkey as well, 1995 + (s_suppkey % 4) as start, 1996 + (s_suppkey % 5) as end_ from supplier)"


def cases(spark, sf):
    k = F.col("s_suppkey")
    return fx.table(spark, sf, "supplier").select(k.alias("well"), (1995 + k % 4).alias("start"), (1996 + k % 5).alias("end"))


@query("b15_select_window", f"with {fx.OBS}, {CASES} select well, element, start, count(*) as n, min(obs_id) as first_id from obs join cases using (well) where date >= start and date <= end_ + 1 group by all")
def b15(spark, sf):
    return clean.select_window(fx.observations(spark, sf), cases(spark, sf)).groupBy("well", "element", "start").agg(F.count("*").alias("n"), F.min("obs_id").alias("first_id"))


@query("b16_select_rows", "select s_suppkey, wells from (select s_suppkey, (s_suppkey % 3)::varchar || '+' || (s_suppkey % 5)::varchar as wells from supplier) where list_contains(string_split(wells, '+'), '2')")
def b16(spark, sf):
    rows = fx.table(spark, sf, "supplier").select("s_suppkey", F.concat_ws("+", (F.col("s_suppkey") % 3).cast("string"), (F.col("s_suppkey") % 5).cast("string")).alias("wells"))
    return clean.select_rows(rows, {"wells": "2"})


@query("b16b_subset", f"with {fx.OBS} select well, element, count(*) as n, round(sum(concentration), 4) as total from obs where well in (select distinct well from obs order by well limit 3) and element in ('1-URGENT', '5-LOW') and obs_id % 2 = 0 group by all")
def b16b(spark, sf):
    # Rows are numbered within their well: those of other wells needn't be joined or numbered. A
    # well whose lines have no order isn't there, so three are looked at as often as it takes.
    wells, after = [], fx.table(spark, sf, "lineitem").select("l_suppkey").where("l_suppkey is not null").distinct()
    while len(wells) < 3 and (few := [r["l_suppkey"] for r in after.orderBy("l_suppkey").limit(3).collect()]):
        wells += sorted(r["well"] for r in fx.observations(spark, sf, few).select("well").distinct().collect())
        after = after.where(F.col("l_suppkey") > few[-1])
    wells = wells[:3]
    obs = fx.observations(spark, sf, wells).withColumn("enabled", F.when(F.col("obs_id") % 2 == 0, "True").otherwise("false"))
    rows = clean.subset(obs, wells, ["1-URGENT", "5-LOW"])
    return rows.groupBy("well", "element").agg(F.count("*").alias("n"), F.round(F.sum("concentration"), 4).alias("total"))


RULES = [("1-URGENT", 0.01, "fraction", "percent_to_fraction"), ("2-HIGH", 0.118, "Bq/l", "TU_to_Bq")]


@query("b17_convert_with_log", f"with {fx.OBS}, rules(element, factor, to_unit, rule) as (values ('1-URGENT', 0.01::double, 'fraction', 'percent_to_fraction'), ('2-HIGH', 0.118, 'Bq/l', 'TU_to_Bq')) select well, coalesce(rule, 'none') as applied, coalesce(to_unit, unit) as unit_out, count(*) as n, round(avg(concentration * coalesce(factor, 1.0)), 6) as converted from obs left join rules using (element) group by all")
def b17(spark, sf):
    rules = spark.createDataFrame(RULES, "element string, factor double, to_unit string, rule string")
    rows = clean.convert_with_log(fx.observations(spark, sf), rules)
    return rows.groupBy("well", "applied", "unit_out").agg(F.count("*").alias("n"), F.round(F.avg("converted"), 6).alias("converted"))


@query("b18_screen_delta", f"with {fx.RUNS} select a.well, a.element, case when b.mean is null then 'not_available' when abs(100.0::double * (b.mean / a.mean - 1)) <= 10 then 'limited_air_effects' when abs(100.0::double * (b.mean / a.mean - 1)) <= 20 then 'moderate_air_effects' else 'strong_air_effects' end as screen from runs a left join runs b on b.run = 'B' and a.well = b.well and a.element = b.element where a.run = 'A'")
def b18(spark, sf):
    r = fx.runs(spark, sf)
    a, b = r.where("run = 'A'").select("well", "element", F.col("mean").alias("ma")), r.where("run = 'B'").select("well", "element", F.col("mean").alias("mb"))
    return a.join(b, ["well", "element"], "left").select("well", "element", sc.screen_delta(100.0 * (F.col("mb") / F.col("ma") - 1)).alias("screen"))


@query("b19_helium_diagnostics", "with h as (select l_orderkey, l_linenumber, l_partkey, l_extendedprice / 1000 as h, l_quantity as he, 0.5::double as h_err, l_discount as he_err, l_tax * 100 as reported_age from lineitem), m as (select median(he_err) as typical from h where he_err > 0) select l_partkey, case when he_err > 0 then 'reported' else 'median' end as error_source, count(*) as n, round(sum(h + he), 5) as initial, round(avg(sqrt(h_err * h_err + pow(case when he_err > 0 then he_err else typical end, 2))), 6) as initial_error, round(avg(17.77::double * ln(1 + he / h)), 6) as ratio_age, round(avg(reported_age - 17.77::double * ln(1 + he / h)), 6) as delta from h cross join m group by all")
def b19(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select("l_partkey", (F.col("l_extendedprice") / 1000).alias("h"), F.col("l_quantity").alias("he"), F.lit(0.5).alias("h_err"), F.col("l_discount").alias("he_err"), (F.col("l_tax") * 100).alias("reported_age"))
    out = clean.helium_diagnostics(rows, 17.77).groupBy("l_partkey", "error_source")
    return out.agg(F.count("*").alias("n"), F.round(F.sum("initial"), 5).alias("initial"), *(F.round(F.avg(x), 6).alias(x) for x in ("initial_error", "ratio_age", "delta")))


@query("b20_dataset_rules", f"with {fx.OBS} select 'element_unknown' as rule, count(*) filter (element not in ('1-URGENT', '2-HIGH')) as n from obs union all select 'null_value', 0 union all select 'error_not_positive', count(*) filter (error <= 0) from obs union all select 'value_negative', 0 union all select 'unit_wrong', count(*) filter (element = '2-HIGH') from obs union all select 'date_outside', count(*) filter (not date between 1996 and 2000) from obs union all select 'count_unexpected', (count(*) <> (select count(*) from lineitem))::bigint from obs union all select 'duplicate_key', count(*) from (select 1 from obs group by well, element, date having count(*) > 1)")
def b20(spark, sf):
    return clean.dataset_rules(fx.observations(spark, sf), {"1-URGENT": "pptv", "2-HIGH": "TU"}, (1996.0, 2000.0), fx.table(spark, sf, "lineitem").count())


@query("b21_in_bounds", f"with {fx.DRAWS}, {CATALOGUE} select case_id, chain, in_domain, in_range, count(*) as n from (select case_id, chain, draws.step, bool_and(value between lo and hi) as in_domain, bool_and(value between cal_lo and cal_hi * 0.9) as in_range from draws join spec on model = case_id and name = param group by all) group by all")
def b21(spark, sf):
    narrow = catalogue(spark, sf).withColumn("cal_hi", F.col("cal_hi") * 0.9)
    return clean.in_bounds(fx.draws(spark, sf), narrow).groupBy("case_id", "chain", "in_domain", "in_range").agg(F.count("*").alias("n"))


@query("b22_near_boundary", f"with {fx.DRAWS}, {CATALOGUE} select case_id, param, count(*) filter (value - cal_lo <= greatest(1e-8, 1e-5 * (cal_hi - cal_lo)) or cal_hi - value <= greatest(1e-8, 1e-5 * (cal_hi - cal_lo))) as near, count(*) as n from draws join spec on model = case_id and name = param group by all")
def b22(spark, sf):
    rows = fx.draws(spark, sf).join(catalogue(spark, sf).select(F.col("model").alias("case_id"), F.col("name").alias("param"), "cal_lo", "cal_hi"), ["case_id", "param"])
    return rows.groupBy("case_id", "param").agg(F.count_if(sc.near_boundary("value", "cal_lo", "cal_hi")).alias("near"), F.count("*").alias("n"))


@query("b23_coercion", "select o_orderpriority, count(*) filter (o_custkey % 4 = 0) as n_true, count(*) filter (o_custkey % 4 in (0, 2)) as n_number from orders group by 1")
def b23(spark, sf):
    k = F.col("o_custkey") % 4
    rows = fx.table(spark, sf, "orders").select("o_orderpriority", F.when(k == 0, " True ").when(k == 1, "false").otherwise("yes").alias("flag"), F.when(k == 0, "1.5").when(k == 1, "abc").when(k == 2, "2e3").otherwise("NaN").alias("number"))
    return rows.groupBy("o_orderpriority").agg(F.count_if(sc.to_bool("flag")).alias("n_true"), F.count(sc.to_num("number")).alias("n_number"))


@query("b24_duplicate_keys", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def b24(spark, sf):
    return clean.duplicate_keys(fx.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("b25_grid_gaps", f"with {fx.OBS}, have as (select distinct well, element from obs where well <> 3 or element <> '2-HIGH'), grid as (select well, element from (select distinct well from obs) cross join (select distinct element from obs)) select *, 'missing' as problem from (select * from grid except select * from have) union all select *, 'extra' from (select * from have except select * from grid)")
def b25(spark, sf):
    obs = fx.observations(spark, sf)
    have = obs.where("well <> 3 or element <> '2-HIGH'")
    return clean.grid_gaps(have, [obs.select("well").distinct(), obs.select("element").distinct()])


@query("b26_quantile_sanity", f"with {fx.DRAWS}, s as (select case_id, chain, quantile_cont(d, 0.1) as q10, median(d) / 0.35 as median, quantile_cont(d, 0.9) as q90 from wide group by all) select case_id, chain, q10 <= median and median <= q90 as ordered, q10 >= 0 and q90 <= 1 as in_unit, abs(sum(median) over (partition by case_id) - 1) <= 0.01 as sums_to_one from s")
def b26(spark, sf):
    q = fx.draws_wide(spark, sf).groupBy("case_id", "chain").agg(F.expr("percentile(d, 0.1)").alias("q10"), (F.expr("median(d)") / 0.35).alias("median"), F.expr("percentile(d, 0.9)").alias("q90"))
    return clean.quantile_sanity(q, "case_id").select("case_id", "chain", "ordered", "in_unit", "sums_to_one")


@query("b27_retain", f"with {fx.DRAWS} select case_id, chain, count(*) as n, min(step) as first_step, max(step) as last_step from (select *, count(*) over (partition by case_id, chain) as total from wide) where step > 0.25::double * total and step % 10 = 0 group by all")
def b27(spark, sf):
    return clean.retain(fx.draws_wide(spark, sf), 0.25, 10).groupBy("case_id", "chain").agg(F.count("*").alias("n"), F.min("step").alias("first_step"), F.max("step").alias("last_step"))


@query("b28_matrix_rules", "with m as (select s_suppkey as job, s_suppkey % 9 as k, s_suppkey % 4 as l from supplier) select job, 'enabled_not_boolean' as rule from m where k = 0 union all select job, 'wells_differ' from m where l = 0")
def b28(spark, sf):
    k, n = F.col("s_suppkey") % 9, F.col("s_suppkey") % 4
    s = fx.table(spark, sf, "supplier")
    matrix = s.select(F.col("s_suppkey").alias("job"), F.when(k == 0, "maybe").otherwise("True").alias("enabled"), F.when(n == 0, "F1+F2").otherwise("F9+F1").alias("wells"), F.lit("0.05+0.1").alias("relative_errors"))
    configs = s.select(F.col("s_suppkey").alias("job"), F.array(F.lit("F1"), F.lit("F9")).alias("job_wells"), F.array(F.lit("0.05"), F.lit("0.1")).alias("job_errors"))
    return clean.matrix_rules(matrix, configs)


@query("b29_validate_draws", f"with {fx.DRAWS}, {CATALOGUE}, more as (select * from draws union all select * from draws where case_id = 'A' and param = 'q' and step % 100 = 0), ex as (select distinct model as case_id, name as param from spec union select distinct model, 'x' from spec) select case_id, param, 'missing' as problem from (select * from ex except select case_id, param from more) union all select distinct case_id, param, 'duplicate' from (select case_id, param from more group by case_id, param, chain, step having count(*) > 1)")
def b29(spark, sf):
    draws = fx.draws(spark, sf)
    more = draws.unionByName(draws.where("case_id = 'A' and param = 'q' and step % 100 = 0"))
    expected = catalogue(spark, sf).select(F.col("model").alias("case_id"), F.explode(F.array(F.col("name"), F.lit("x"))).alias("param")).distinct()
    return clean.validate_draws(more, expected, ["case_id", "param"])
