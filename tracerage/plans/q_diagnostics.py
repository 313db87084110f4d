"""Queries of convergence diagnostics (J rows) and fingerprints (K rows)."""

from pyspark.sql import functions as F

from ..operators import diagnostics as dg
from ..operators import fingerprint as fp
from ..sources import fixtures as fx
from ..sources import io
from . import sql as sq
from .registry import query

SPLIT = f"{fx.DRAWS}, nn as (select *, count(*) over (partition by case_id, param, chain) as n from draws), mm as (select *, min(n) over (partition by case_id) as m from nn), sp as (select case_id, param, chain::varchar || case when step > m // 2 then '.2' else '.1' end as chain, case when step > m // 2 then step - (m - m // 2) else step end as step, value from mm where step <= m and (step <= m // 2 or step > m - m // 2))"
RHAT = "(select case_id, param, sqrt(((max(n) - 1) / max(n)::double * avg(v) + var_samp(mu)) / avg(v)) as rhat from (select case_id, param, chain, avg(value) as mu, var_samp(value) as v, count(*) as n from {t} group by all) group by all)"


@query("j01_split_chains", f"with {SPLIT} select case_id, param, chain, count(*) as n, min(step) as first_step, max(step) as last_step, round(sum(value), 4) as total from sp group by all")
def j01(spark, sf):
    return dg.split_chains(fx.draws(spark, sf)).groupBy("case_id", "param", "chain").agg(F.count("*").alias("n"), F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.round(F.sum("value"), 4).alias("total"))


def scores_sql(table: str, name: str) -> str:
    """SQL: ``name``, a table's rows with the normal scores of average ranks as values."""
    return f"{name}_p as (select *, (rank() over (partition by case_id, param order by value) + (count(*) over (partition by case_id, param, value) - 1) / 2.0::double - 0.375::double) / (count(*) over (partition by case_id, param) + 0.25::double) as p from {table}), {name} as (select case_id, param, chain, step, {sq.normal_inverse('p')} as value from {name}_p)"


@query("j02_rank_normalize", f"with {SPLIT}, {scores_sql('sp', 'z')} select case_id, param, count(*) as n, round(min(value), 7) as lowest, round(max(value), 7) as highest, round(sum(value * value), 4) as squares, round(sum(value * step), 2) as trend from z group by all")
def j02(spark, sf):
    z = dg.rank_normalize(dg.split_chains(fx.draws(spark, sf)))
    x = F.col("value")
    return z.groupBy("case_id", "param").agg(F.count("*").alias("n"), F.round(F.min(x), 7).alias("lowest"), F.round(F.max(x), 7).alias("highest"), F.round(F.sum(x * x), 4).alias("squares"), F.round(F.sum(x * F.col("step")), 2).alias("trend"))


@query("j03_basic_rhat", f"with {SPLIT} select case_id, param, round(rhat, 7) as rhat from {RHAT.format(t='sp')}")
def j03(spark, sf):
    return dg.basic_rhat(dg.split_chains(fx.draws(spark, sf))).withColumn("rhat", F.round("rhat", 7))


FOLDED = "fo as (select case_id, param, chain, step, abs(value - median(value) over (partition by case_id, param)) as value from sp)"


@query("j04_split_rhat", f"with {SPLIT}, {FOLDED}, {scores_sql('sp', 'z')}, {scores_sql('fo', 'zf')} select a.case_id, a.param, round(greatest(a.rhat, b.rhat), 7) as rhat from {RHAT.format(t='z')} a join {RHAT.format(t='zf')} b using (case_id, param)")
def j04(spark, sf):
    return dg.split_rhat(fx.draws(spark, sf)).withColumn("rhat", F.round("rhat", 7))


#: Lags in the SQL: pair sums of these draws stop far before; the operators have no such limit.
LAGS = 40


def acov_sql(table: str, name: str, lags: int = LAGS) -> str:
    """SQL: ``name``, autocovariances of a table's chains."""
    return f"{name}_c as (select case_id, param, chain, avg(value) as mu, var_samp(value) as v, count(*) as n from {table} group by all), {name}_x as (select case_id, param, chain, n, list(value - mu order by step) as xs from {table} join {name}_c using (case_id, param, chain) group by all), {name} as (select case_id, param, chain, lag, n, list_dot_product(xs[1 : n - lag], xs[1 + lag : n]) / n as acov from {name}_x cross join (select unnest(range(0, {lags})) as lag) l where lag < n)"


def geyer_sql(name: str, keys: str) -> str:
    """SQL: ``name``_t, monotone positive pair sums of ``name``_r (keys, lag, rho)."""
    return f"{name}_s as (select {keys}, lag // 2 as pair, sum(rho) as s from {name}_r group by all having count(*) = 2), {name}_m as (select *, min((s > 0)::integer) over (partition by {keys} order by pair) as pos, min(s) over (partition by {keys} order by pair) as mono from {name}_s), {name}_t as (select {keys}, sum(case when pos = 1 then mono else 0 end) as t, min(pos) = 1 as truncated from {name}_m group by all)"


def ess_sql(table: str, name: str) -> str:
    """SQL: ``name``_e, effective sizes of a table's quantities."""
    return f"{acov_sql(table, name)}, {name}_k as (select case_id, param, avg(v) as w, coalesce(var_samp(mu), 0) as b, max(n) as n, count(*) as k from {name}_c group by all), {name}_r as (select case_id, param, lag, case when lag = 0 then 1.0::double else 1 - (w - avg(acov)) / ((k.n - 1.0::double) / k.n * w + b) end as rho from {name} join {name}_k k using (case_id, param) group by case_id, param, lag, w, b, k.n), {geyer_sql(name, 'case_id, param')}, {name}_e as (select case_id, param, case when w > 0 then n * k / greatest(2 * t - 1, 1 / log10(n * k)) else 0 end as ess, w > 0 and truncated as truncated from {name}_k join {name}_t using (case_id, param))"


@query("j07_acf", f"with {SPLIT}, {acov_sql('sp', 'ac', 11)} select case_id, param, chain, n, lag::integer as lag, round(acov, 8) as acov from ac")
def j07(spark, sf):
    return dg.acf(dg.split_chains(fx.draws(spark, sf)), 10).withColumn("acov", F.round("acov", 8))


@query("j05_ess", f"with {SPLIT}, {ess_sql('sp', 'ac')} select case_id, param, round(ess, 4) as ess, truncated from ac_e")
def j05(spark, sf):
    return dg.ess(dg.split_chains(fx.draws(spark, sf))).withColumn("ess", F.round("ess", 4))


TAILS = "tq as (select case_id, param, quantile_cont(value, 0.05) as lo, quantile_cont(value, 0.95) as hi from sp group by all), tl as (select case_id, param, chain, step, (value <= lo)::integer::double as value from sp join tq using (case_id, param)), th as (select case_id, param, chain, step, (value <= hi)::integer::double as value from sp join tq using (case_id, param))"


@query("j06_bulk_tail_mcse", f"with {SPLIT}, {scores_sql('sp', 'z')}, {TAILS}, {ess_sql('z', 'zb')}, {ess_sql('tl', 'zl')}, {ess_sql('th', 'zh')}, {ess_sql('sp', 'zs')}, sds as (select case_id, param, stddev_samp(value) as sd from sp group by all) select b.case_id, b.param, round(b.ess, 4) as bulk_ess, round(least(l.ess, h.ess), 4) as tail_ess, round(sd / sqrt(s.ess), 10) as mcse, b.truncated or l.truncated or h.truncated or s.truncated as truncated from zb_e b join zl_e l using (case_id, param) join zh_e h using (case_id, param) join zs_e s using (case_id, param) join sds using (case_id, param)")
def j06(spark, sf):
    rows = dg.effective_sizes(fx.draws(spark, sf))
    cut = F.col("bulk_truncated") | F.col("tail_truncated") | F.col("mcse_truncated")
    return rows.select("case_id", "param", F.round("bulk_ess", 4).alias("bulk_ess"), F.round("tail_ess", 4).alias("tail_ess"), F.round("mcse", 10).alias("mcse"), cut.alias("truncated"))


@query("j08_iact", f"with {SPLIT}, {acov_sql('sp', 'ac')}, ac_r as (select a.case_id, a.param, a.chain, a.lag, a.acov / z.acov as rho from ac a join ac z on z.case_id = a.case_id and z.param = a.param and z.chain = a.chain and z.lag = 0), {geyer_sql('ac', 'case_id, param, chain')} select case_id, param, chain, round(greatest(2 * t - 1, 1e-3), 7) as tau, truncated from ac_t")
def j08(spark, sf):
    return dg.iact(dg.split_chains(fx.draws(spark, sf))).select("case_id", "param", "chain", F.round("tau", 7).alias("tau"), "truncated")


@query("j06b_tail_at_least", f"with {SPLIT}, {TAILS.replace('value <= hi', 'value >= hi')}, {ess_sql('tl', 'zl')}, {ess_sql('th', 'zh')} select l.case_id, l.param, round(least(l.ess, h.ess), 4) as tail_ess, l.truncated or h.truncated as tail_truncated from zl_e l join zh_e h using (case_id, param)")
def j06b(spark, sf):
    return dg.tail_ess(fx.draws(spark, sf), upper="at_least").withColumn("tail_ess", F.round("tail_ess", 4))


#: The draws with one chain of t stuck.
STUCK = f"{fx.DRAWS}, st as (select case_id, chain::varchar as chain, step, param, case when param = 't' and chain = 1 then 0.05::double else value end as value from draws)"
CROSSING = f"{STUCK}, {acov_sql('st', 'ac', 200)}, zr as (select case_id, param, chain, acov as c0 from ac where lag = 0), cs as (select case_id, param, chain, count(*) as n, min(value) = max(value) as constant from st group by all), rh as (select a.case_id, a.param, a.chain, a.lag, a.acov * a.n / ((a.n - a.lag) * c0) as rho from ac a join zr using (case_id, param, chain) join cs using (case_id, param, chain) where lag > 0 and not constant), ps as (select *, min((rho > 0)::integer) over (partition by case_id, param, chain order by lag) as pos from rh), cr as (select case_id, param, chain, max(rho) filter (lag = 1) as acf1, greatest(1 + 2 * sum(case when pos = 1 then rho else 0 end), 1) as tau from ps group by all), cx as (select cs.case_id, cs.param, cs.chain, acf1, coalesce(tau, 1.0) as tau, n / coalesce(tau, 1.0) as ess, constant from cs left join cr using (case_id, param, chain))"


def stuck(spark, sf):
    return fx.draws(spark, sf).withColumn("value", F.when((F.col("param") == "t") & (F.col("chain") == 1), 0.05).otherwise(F.col("value"))).withColumn("chain", F.col("chain").cast("string"))


@query("j08b_first_crossing", f"with {CROSSING} select case_id, param, chain, round(acf1, 8) as acf1, round(tau, 7) as tau, round(ess, 3) as ess, constant from cx")
def j08b(spark, sf):
    return dg.first_crossing(stuck(spark, sf)).select("case_id", "param", "chain", F.round("acf1", 8).alias("acf1"), F.round("tau", 7).alias("tau"), F.round("ess", 3).alias("ess"), "constant")


@query("j08c_min_ess_per_second", f"with {CROSSING}, pe as (select case_id, param, sum(ess) as ess from cx group by all), sec as (select l_returnflag as case_id, sum(l_quantity) / 1000 as seconds from lineitem group by 1) select case_id, arg_min(param, ess) as param, round(min(ess), 3) as min_ess, round(min(ess) / any_value(seconds), 5) as ess_per_second from pe join sec using (case_id) group by 1")
def j08c(spark, sf):
    seconds = fx.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("case_id")).agg((F.sum("l_quantity") / 1000).alias("seconds"))
    return dg.min_ess_per_second(dg.first_crossing(stuck(spark, sf)), seconds).select("case_id", "param", F.round("min_ess", 3).alias("min_ess"), F.round("ess_per_second", 5).alias("ess_per_second"))


#: Draws as a shifted exponential law's scale and shift with its moments; case A never moves its shift, case N never its scale.
def quantity_sql(*parts: tuple[str, str, bool]) -> str:
    return " union all ".join(f"select case_id, chain, step, '{name}' as param, {value} as value, {str(native).lower()} as native from pl" for name, value, native in parts)


QUANTITIES = f"{fx.DRAWS.split('draws as')[0]} pl as (select case_id, chain, step, case when case_id = 'N' then 10.0::double else q end as scale, case when case_id = 'A' then 0.04::double else d end as shift from wide), draws as ({quantity_sql(('scale', 'scale', True), ('shift', 'shift', True), ('mean', 'shift + scale', False), ('std', 'scale', False), *((f'p{int(100 * p)}', f'shift - scale * ln(1 - {p}::double)', False) for p in (0.1, 0.25, 0.5, 0.75, 0.9)))}), dq as (select case_id, param, bool_or(native) as native, min(lo) = max(hi) as constant, bool_or(native) or min(lo) <> max(hi) as included, min(n) = max(n) as equal_counts, min(n) as min_n, count(*) as n_chains from (select case_id, param, chain, bool_or(native) as native, count(*) as n, min(value) as lo, max(value) as hi from draws group by all) group by all)"


#: The law that the draws are parameters of.
LAW = "exp_shifted", {"scale": "q", "shift": "d"}


def parameter_rows(spark, sf):
    wide = fx.draws_wide(spark, sf)
    return wide.withColumn("q", F.when(F.col("case_id") == "N", 10.0).otherwise(F.col("q"))).withColumn("d", F.when(F.col("case_id") == "A", 0.04).otherwise(F.col("d")))


@query("j09_diagnostic_quantities", f"with {QUANTITIES} select * from dq")
def j09(spark, sf):
    return dg.diagnostic_quantities(dg.quantities(parameter_rows(spark, sf), *LAW))


QSPLIT = SPLIT.replace(fx.DRAWS, QUANTITIES)
RUN = f"{QSPLIT}, {FOLDED}, {scores_sql('sp', 'z')}, {scores_sql('fo', 'zf')}, {TAILS}, {ess_sql('z', 'zb')}, {ess_sql('tl', 'zl')}, {ess_sql('th', 'zh')}, rr as (select a.case_id, a.param, greatest(a.rhat, b.rhat) as rhat from {RHAT.format(t='z')} a join {RHAT.format(t='zf')} b using (case_id, param)), dg as (select q.*, case when constant then 'infinity'::double else r.rhat end as rhat, case when constant then 0 else least(b.ess, l.ess, h.ess) end as ess from dq q left join rr r using (case_id, param) left join zb_e b using (case_id, param) left join zl_e l using (case_id, param) left join zh_e h using (case_id, param))"


@query("j10b_qualified_run", f"with {RUN} select case_id, case when bool_and(case when included then rhat < 1.5 and ess >= 100 end) then 'qualified' else 'not_qualified' end as status from dg group by 1")
def j10b(spark, sf):
    return dg.qualify(dg.diagnose_model(parameter_rows(spark, sf), *LAW), 1.5, 100.0)[1]


GATE = "dia as (select l_suppkey as case_id, l_linenumber::varchar as param, 1 + max(l_discount) / 5 as rhat, sum(l_quantity) as ess, avg(l_tax) as mcse, l_linenumber < 7 as included, case when l_suppkey % 10 = 0 then 1 else 4 end as n_chains from lineitem group by l_suppkey, l_linenumber), qd as (select *, case when included then rhat < 1.0195 and ess >= 1800 end as qualified from dia), st as (select case_id, case when max(n_chains) < 2 then 'not_applicable' when bool_and(qualified) then 'qualified' else 'not_qualified' end as status from qd group by 1)"


def gate(spark, sf):
    t = fx.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("case_id"), F.col("l_linenumber").cast("string").alias("param")).agg((1 + F.max("l_discount") / 5).alias("rhat"), F.sum("l_quantity").alias("ess"), F.avg("l_tax").alias("mcse"))
    t = t.withColumn("included", F.col("param").cast("int") < 7).withColumn("n_chains", F.when(F.col("case_id") % 10 == 0, 1).otherwise(4))
    return dg.qualify(t, 1.0195, 1800.0)


@query("j10_qualify", f"with {GATE} select case_id, status from st")
def j10(spark, sf):
    return gate(spark, sf)[1]


@query("j11_pool", f"with {GATE} select l_suppkey as case_id, count(*) as n from lineitem where l_suppkey in (select case_id from st where status in ('qualified', 'not_applicable')) group by 1")
def j11(spark, sf):
    rows = fx.table(spark, sf, "lineitem").withColumn("case_id", F.col("l_suppkey"))
    return dg.pool(rows, gate(spark, sf)[1]).groupBy("case_id").agg(F.count("*").alias("n"))


@query("j12_ess_bound", "select l_suppkey, count(*) as total, round(count(*) * log10(count(*)), 6) as bound, count(*) * log10(count(*)) >= 1650 as feasible from lineitem group by 1")
def j12(spark, sf):
    cases = fx.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("total"))
    return dg.ess_bound(cases, 1650.0).withColumn("bound", F.round("bound", 6))


def part_sql(i: int) -> str:
    return f"sum(cast('0x' || substr(h, {1 + 12 * i}, 12) as bigint))::hugeint::varchar"


FPR = f"h as (select o_custkey, sha256(o_orderkey::varchar || chr(31) || hex(o_orderstatus) || chr(31) || hex(o_orderpriority)) as h from orders), fpr as (select o_custkey, count(*) as n, sha256('o_orderkey,o_orderstatus,o_orderpriority|' || count(*) || '|' || {part_sql(0)} || '|' || {part_sql(1)} || '|' || {part_sql(2)}) as fingerprint from h group by 1)"


@query("k01_fingerprint", f"with {FPR} select * from fpr")
def k01(spark, sf):
    return fp.fingerprint(fx.table(spark, sf, "orders"), ["o_custkey"], ["o_orderkey", "o_orderstatus", "o_orderpriority"])


ORDERED = f"pl as (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderstatus, o_orderkey) as place from orders), h as (select o_custkey, sha256(place::varchar || chr(31) || hex(o_orderstatus) || chr(31) || hex(o_orderpriority)) as h from pl), fpr as (select o_custkey, count(*) as n, sha256('__place,o_orderstatus,o_orderpriority|' || count(*) || '|' || {part_sql(0)} || '|' || {part_sql(1)} || '|' || {part_sql(2)}) as f from h group by 1)"


@query("k01b_ordered_fingerprint", f"with {ORDERED} select o_custkey, n, sha256('o_orderstatus:string,o_orderpriority:string|' || f) as fingerprint from fpr")
def k01b(spark, sf):
    return fp.ordered_fingerprint(fx.table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderstatus", "o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query("k02_fingerprint_diff", "select o_custkey, case when bool_or(o_orderkey % 40 = 0) then 'values' when bool_or(o_orderkey % 7 = 0) then 'labels' end as differs from orders group by 1")
def k02(spark, sf):
    o = fx.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    changed = o.withColumn("o_totalprice", F.when(k % 40 == 0, -1.0).otherwise(F.col("o_totalprice"))).withColumn("o_orderstatus", F.when(k % 7 == 0, "?").otherwise(F.col("o_orderstatus")))

    def sides(df):
        a = fp.fingerprint(df, ["o_custkey"], ["o_orderkey", "o_totalprice"]).select("o_custkey", F.col("fingerprint").alias("values"))
        return a.join(fp.fingerprint(df, ["o_custkey"], ["o_orderkey", "o_orderstatus"]).select("o_custkey", F.col("fingerprint").alias("labels")), "o_custkey")

    return fp.fingerprint_diff(sides(o), sides(changed), ["o_custkey"], ["values", "labels"])


@query("k03_file_inventory", "select o_orderpriority as part, count(*) + 1 as length, sha256(string_agg(chr(97 + (o_orderkey % 26)::integer), '' order by o_orderkey) || chr(10)) as sha256 from orders group by 1")
def k03(spark, sf):
    # A file for each priority holds a letter for each order: its length and digest follow from the table.
    o = fx.table(spark, sf, "orders")
    letters = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: F.char((97 + k % 26).cast("long")))
    path = io.scratch(spark, "k03")
    o.groupBy("o_orderpriority").agg(F.array_join(letters, "").alias("value")).repartition(1).write.partitionBy("o_orderpriority").text(path)
    files = fp.file_inventory(spark, path).where("path like '%.txt'")
    part = F.expr("regexp_replace(regexp_extract(path, 'o_orderpriority=([^/]+)/', 1), '%20', ' ')")
    return files.select(part.alias("part"), "length", "sha256")
