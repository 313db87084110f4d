"""Queries of age distributions (D rows) and of the forward model (E rows)."""

from pyspark.sql import functions as F

from ..functions import laws
from ..functions import special as sp
from ..operators import chronicle as ch
from ..operators import distributions as ds
from ..operators import forward as fw
from ..sources import fixtures as fx
from ..sources import io
from .q_chronicle import SEG, interp, response
from .registry import query


def tracers(spark):
    return io.tracer_catalogue(fx.tracer_specs(spark))


#: Parameter rows from the lines: one for each part of the first hundred, ages from its size.
PARS = "pars as (select l_partkey as part, round(2 + avg(l_quantity) / 5, 3) as a, round(1 + avg(l_tax) * 20, 3) as b from lineitem group by 1)"
AGES = "ages as (select unnest(range(0, 40, 3))::double as t)"


def thousandths(x):
    """Three digits as SQL's round() of a double gives them: a tie is one if x times 1000 is (Spark's goes by x's decimals)."""
    return F.floor(x * 1000 + 0.5) / 1000


def pars(spark, sf):
    # Means of taxes fall on ties of the third digit: nine digits first, so that a tie doesn't depend on the order of a sum.
    a, b = 2 + F.avg("l_quantity") / 5, F.round(1 + F.avg("l_tax") * 20, 9)
    return fx.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(thousandths(a).alias("a"), thousandths(b).alias("b"))


def with_ages(df):
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(39), F.lit(3))).alias("t")).withColumn("t", F.col("t").cast("double"))


def R8(df):
    return df.withColumns({c: F.round(c, 8) for c in df.columns})


def law_rows(df, name, p, digits=8):
    law = laws.get_law(name)
    t = F.col("t")
    return df.select("part", "t", F.round(law.cdf(p, t), digits).alias("cdf"), F.round(law.moment(p, t), digits).alias("moment"))


def law_sql(cdf, moment, extra="", digits=8):
    return f"with {PARS}, {AGES}{extra} select part, t, round({cdf}, {digits}) as cdf, round({moment}, {digits}) as moment from pars cross join ages"


Z = "greatest((t - b) / a, 0)"


@query("d01_exp_shifted", law_sql(f"1 - exp(-{Z})", f"b * (1 - exp(-{Z})) + a * (1 - exp(-{Z}) * (1 + {Z}))"))
def d01(spark, sf):
    return law_rows(with_ages(pars(spark, sf)), "exp_shifted", {"scale": F.col("a"), "shift": F.col("b")})


@query("d01b_exp", law_sql("1 - exp(-t / a)", "a * (1 - exp(-t / a) * (1 + t / a))"))
def d01b(spark, sf):
    return law_rows(with_ages(pars(spark, sf)), "exp", {"scale": F.col("a")})


@query("d02_uniform", law_sql("(least(greatest(t, b), b + a) - b) / a", "(pow(least(greatest(t, b), b + a), 2) - b * b) / (2 * a)"))
def d02(spark, sf):
    return law_rows(with_ages(pars(spark, sf)), "uniform", {"tmin": F.col("b"), "delta": F.col("a")})


def phi(z: str) -> str:
    """SQL: the normal distribution by its series of odd powers over double factorials."""
    tail = f"list_sum(list_transform(range(0, 250), lambda n: exp((2 * n + 1) * ln(greatest(abs({z}), 1e-300)) - (n + 1) * ln(2.0::double) - lgamma(n + 1.5::double) + 0.5 * ln(pi()))))"
    half = f"least(exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {tail}, 0.5)"
    return f"(0.5 + sign({z}) * {half})"


IG_P = "p as (select part, t, a as mu, a as sg, a as lam from pars cross join ages where t > 0), q as (select *, sqrt(lam / t) * (t / mu - 1) as z1, -sqrt(lam / t) * (t / mu + 1) as z2 from p)"


@query("d03_inverse_gaussian", f"with {PARS}, {AGES}, {IG_P}, r as (select part, t, mu, {phi('z1')} as direct, exp(2 * lam / mu) * {phi('z2')} as reflected, z2 from q) select part, t, round(direct + reflected, 7) as cdf, round(mu * (direct - reflected), 6) as moment from r")
def d03(spark, sf):
    rows = with_ages(pars(spark, sf)).where("t > 0")
    p = {"mu": F.col("a"), "sigma": F.col("a")}
    law = laws.get_law("ig")
    return rows.select("part", "t", F.round(law.cdf(p, F.col("t")), 7).alias("cdf"), F.round(law.moment(p, F.col("t")), 6).alias("moment"))


@query("d04_gamma", law_sql("1 - exp(-t / a) * (1 + t / a)", "2 * a * (1 - exp(-t / a) * (1 + t / a + t * t / (2 * a * a)))"))
def d04(spark, sf):
    return law_rows(with_ages(pars(spark, sf)), "gamma", {"k": F.lit(2.0), "theta": F.col("a")})


@query("d04b_weibull", law_sql("1 - exp(-sqrt(t / a))", "2 * a * (1 - exp(-sqrt(t / a)) * (1 + sqrt(t / a) + t / a / 2))"))
def d04b(spark, sf):
    return law_rows(with_ages(pars(spark, sf)), "weibull", {"k": F.lit(0.5), "lam": F.col("a")})


@query("d05_dirac_double", law_sql("0.3::double * (t >= a)::integer + 0.7::double * (t >= a + b)::integer", "0.3::double * a * (t >= a)::integer + 0.7::double * (a + b) * (t >= a + b)::integer"))
def d05(spark, sf):
    return law_rows(with_ages(pars(spark, sf)), "dirac_double", {"mu1": F.col("a"), "mu2": F.col("a") + F.col("b"), "rate": F.lit(0.3)})


ZM = "greatest((t - (b + 0.5)) / a, 0)"


@query("d06_mix_exp_shifted", law_sql(f"0.25::double * (t >= b)::integer + 0.75::double * (1 - exp(-{ZM}))", f"0.25::double * b * (t >= b)::integer + 0.75::double * ((b + 0.5) * (1 - exp(-{ZM})) + a * (1 - exp(-{ZM}) * (1 + {ZM})))"))
def d06(spark, sf):
    return law_rows(with_ages(pars(spark, sf)), "mix_exp_shifted", {"mu1": F.col("b"), "scale": F.col("a"), "shift": F.lit(0.5), "rate": F.lit(0.25)})


STICK = "lat as (select part, v.i as age_bin, 1 / (1 + exp(-(case v.i when 0 then a - 6 when 1 then b - 5 when 2 then a - b end))) as v from pars cross join (values (0), (1), (2)) v(i)), fr as (select part, age_bin, v * coalesce((select exp(sum(ln(1 - w.v))) from lat w where w.part = lat.part and w.age_bin < lat.age_bin), 1) as fraction from lat), fractions as (select * from fr union all select part, 3, 1 - sum(fraction) from fr group by part)"


def latents(spark, sf):
    return pars(spark, sf).select("part", F.posexplode(F.array(F.col("a") - 6, F.col("b") - 5, F.col("a") - F.col("b"))).alias("age_bin", "latent"))


@query("d07_stick_breaking", f"with {PARS}, {STICK} select part, age_bin, round(fraction, 8) as fraction from fractions")
def d07(spark, sf):
    return ds.stick_breaking(latents(spark, sf), ["part"]).select("part", "age_bin", F.round("fraction", 8).alias("fraction"))


@query("d07b_piecewise_uniform_cdf", f"with {PARS}, {STICK}, {AGES} select part, t, round(sum(fraction * least(greatest((t - 10.0 * age_bin) / 10.0, 0), 1)), 8) as cdf from fractions cross join ages group by all")
def d07b(spark, sf):
    fr = ds.stick_breaking(latents(spark, sf), ["part"])
    ages = spark.range(0, 40, 3).select(F.col("id").cast("double").alias("t"))
    return ds.piecewise_cdf(fr, ages, [0, 10, 20, 30, 40], ["part"]).select("part", "t", F.round("cdf", 8).alias("cdf"))


def q_exp(p: str) -> str:
    return f"round(b - a * ln(1 - {p}::double), 6)"


@query("d08_moments", f"with {PARS} select part, round(a + b, 6) as mean, round(a, 6) as std, {q_exp('0.1')} as p10, {q_exp('0.25')} as p25, {q_exp('0.5')} as p50, {q_exp('0.75')} as p75, {q_exp('0.9')} as p90 from pars")
def d08(spark, sf):
    rows = pars(spark, sf).select("part", F.col("a").alias("scale"), F.col("b").alias("shift"))
    return ds.add_moments(rows, "exp_shifted").drop("scale", "shift").withColumns({c: F.round(c, 6) for c in ds.MOMENTS})


@query("d08b_gamma_quantiles", f"with {PARS} select part, round(a, 6) as mean, round(a, 6) as std, round(-a * ln(1 - 0.5::double), 5) as p50, round(-a * ln(1 - 0.9::double), 5) as p90 from pars")
def d08b(spark, sf):
    rows = pars(spark, sf).select("part", F.lit(1.0).alias("k"), F.col("a").alias("theta"))
    return ds.add_moments(rows, "gamma").select("part", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("p50", 5).alias("p50"), F.round("p90", 5).alias("p90"))


@query("d09_curves", f"with {PARS}, grid as (select 70.0::double * i / 50 as t from range(51) r(i)) select part, round(t, 6) as t, round(1 - exp(-greatest((t - b) / a, 0)), 8) as cdf, round(case when t >= b then exp(-(t - b) / a) / a else 0 end, 8) as pdf from pars cross join grid")
def d09(spark, sf):
    rows = pars(spark, sf).select("part", F.col("a").alias("scale"), F.col("b").alias("shift"))
    return ds.curves(rows, "exp_shifted", 50).select("part", F.round("t", 6).alias("t"), F.round("cdf", 8).alias("cdf"), F.round("pdf", 8).alias("pdf"))


WIDE = [1, 2, 3, 5, 8]


@query("d09b_curves_wide", f"with {PARS}, grid as (select 70.0::double * i / 50 as t from range(51) r(i)) select round(t, 6) as t, {', '.join(f'max(round(1 - exp(-greatest((t - b) / a, 0)), 8)) filter (part = {r}) as p{r}' for r in WIDE)} from grid left join pars on part in ({', '.join(map(str, WIDE))}) group by t")
def d09b(spark, sf):
    rows = pars(spark, sf).select("part", F.col("a").alias("scale"), F.col("b").alias("shift"))
    return R8(ds.curves_wide(rows, "exp_shifted", 50, "part", WIDE)).withColumn("t", F.round("t", 6))


@query("d10_remap", f"with {PARS} select part, round(a / (1 + b), 8) as epm_scale, round(a * b / (1 + b), 8) as epm_shift, round(a * sqrt(2 * b), 8) as dm_sigma, round(a * a * a / (b * b), 6) as ig_shape, round(3 * pow(a, 2) / (b * b), 6) as d_shape_d_mean, round(-2 * pow(a, 3) / pow(b, 3), 6) as d_shape_d_std, a > 0 and b > 0 as valid from pars")
def d10(spark, sf):
    out = ds.remap(pars(spark, sf), "a", "b")
    return out.select("part", *(F.round(c, 8).alias(c) for c in ("epm_scale", "epm_shift", "dm_sigma")), *(F.round(c, 6).alias(c) for c in ("ig_shape", "d_shape_d_mean", "d_shape_d_std")), "valid")


@query("d11_mixture_mean_age", f"with {PARS}, {STICK} select part, round(sum(fraction * (10.0 * age_bin + 5)), 6) as mean_age from fractions group by part")
def d11(spark, sf):
    ages = spark.createDataFrame([(i, 10.0 * i + 5) for i in range(4)], "age_bin int, age double")
    return ds.mixture_mean_age(ds.stick_breaking(latents(spark, sf), ["part"]), ages, ["part"]).withColumn("mean_age", F.round("mean_age", 6))


@query("d11b_cumulative_fractions", f"with {PARS}, {STICK} select part, age_bin, round(sum(fraction) over (partition by part order by age_bin), 8) as cumulative from fractions")
def d11b(spark, sf):
    return ds.cumulative_fractions(ds.stick_breaking(latents(spark, sf), ["part"]), ["part"]).select("part", "age_bin", F.round("cumulative", 8).alias("cumulative"))


@query("d12_fractions_from_cumulative", f"with {PARS}, cum as (select part, age, 1 - exp(-age / (4 * a)) as cumulative from pars cross join (values (20.0), (40.0), (60.0)) v(age)) select part, age::double as upto, round(cumulative - coalesce(lag(cumulative) over (partition by part order by age), 0), 8) as fraction from cum union all select part, null::double, round(1 - max(cumulative), 8) from cum group by part")
def d12(spark, sf):
    cum = pars(spark, sf).select("part", "a", F.explode(F.array(F.lit(20.0), F.lit(40.0), F.lit(60.0))).alias("age")).withColumn("cumulative", 1 - F.exp(-F.col("age") / (4 * F.col("a"))))
    return ds.fractions_from_cumulative(cum, ["part"]).withColumn("fraction", F.round("fraction", 8))


@query("d13_distribution_checks", f"with {PARS}, g as (select part, a, b, 400.0::double * i / 4000 as t, case when i in (0, 4000) then 0.05::double else 0.1 end as w from pars cross join range(4001) r(i)), s as (select part, a, b, sum(w * case when t >= b then exp(-(t - b) / a) / a else 0 end) as mass, sum(w * t * case when t >= b then exp(-(t - b) / a) / a else 0 end) as mean from g group by all) select part, round(mass, 8) as mass, round(mean, 7) as mean, round(b + a * ln(2.0::double), 8) as median, abs(mass - 1) <= 0.05 / a + 1e-4 and abs(mean - a - b) <= 0.1 * (a + b) / a + 0.02 as fits from s")
def d13(spark, sf):
    rows = pars(spark, sf).select("part", F.col("a").alias("scale"), F.col("b").alias("shift"))
    out = ds.distribution_checks(rows, "exp_shifted", ["part"], 400.0, 4000)
    fits = (F.col("mass_error") <= 1e-4) & (F.col("mean_error") <= 0.02)
    return out.select("part", F.round("mass", 8).alias("mass"), F.round("mean", 7).alias("mean"), F.round("median", 8).alias("median"), fits.alias("fits"))


@query("n01_law_registry", f"with {PARS}, {AGES} select part, t, round(1 - exp(-pow(t / a, 2)), 8) as cdf from pars cross join ages")
def n01(spark, sf):
    square = lambda p, t: F.pow(t / p["scale"], F.lit(2.0))
    laws.register_law("rayleigh", laws.Law(("scale",), lambda p, t: -F.expm1(-square(p, t)), lambda p, t: p["scale"] * sp.gamma(F.lit(1.5)) * sp.gamma_p(F.lit(1.5), square(p, t)), lambda p: p["scale"] * sp.gamma(F.lit(1.5)), lambda p: p["scale"]))
    try:
        return with_ages(pars(spark, sf)).select("part", "t", F.round(laws.get_law("rayleigh").cdf({"scale": F.col("a")}, F.col("t")), 8).alias("cdf"))
    finally:
        laws.unregister_law("rayleigh")


@query("n02_tracer_registry", f"with {PARS}, {AGES} select part, t, round(100 * exp(-t / b) + 0.5 * t, 6) as k from pars cross join ages")
def n02(spark, sf):
    ch.register_tracer("own", lambda date, age: 100 * F.exp(-age / (date - 2000)) + 0.5 * age)
    try:
        rows = with_ages(pars(spark, sf)).select("part", "t", F.lit("own").alias("tracer"), F.col("t").alias("age"), (2000 + F.col("b")).alias("date"))
        return ch.tracer_response(rows, fx.chronicle(spark, sf), tracers(spark)).select("part", "t", F.round("k", 6).alias("k"))
    finally:
        ch.unregister_tracer("own")


# Forward model: a 1-D grid of mean ages against three sampling dates of each tracer.

SAMPLES = "samples as (select distinct tracer, d as date from chron cross join (values (1997.25::double), (1999.5), (2001.4)) v(d))"
DRAW = "draw as (select i as draw, 1.0::double + 0.5 * i as scale, 0.1::double * i as shift from range(20) r(i))"
EDGES = f"""{SEG}, {fx.TRACER}, {SAMPLES}, up as (select s.tracer, s.date, s.date - min(c.date) as upper from samples s join chron c using (tracer) group by s.tracer, s.date),
edge as (select u.tracer, u.date, u.upper * i / 1.0 as age from up u join tracers on name = tracer and mode = 'constant' cross join range(2) r(i)
  union select u.tracer, u.date, a from up u join tracers on name = tracer and mode <> 'constant' cross join lateral (select unnest([0.0, u.upper]) as a)
  union select u.tracer, u.date, u.date - c.date from up u join tracers on name = tracer and mode <> 'constant' join chron c using (tracer) where c.date > u.date - u.upper and c.date < u.date),
bins as (select * from (select tracer, date, age as lft, lead(age) over (partition by tracer, date order by age) as rgt from edge) where rgt is not null)"""


def samples(spark, sf):
    return fx.chronicle(spark, sf).select("tracer").distinct().select("tracer", F.explode(F.array(F.lit(1997.25), F.lit(1999.5), F.lit(2001.4))).alias("date"))


def draw_grid(spark):
    return spark.range(20).select(F.col("id").alias("draw"), (1.0 + 0.5 * F.col("id")).alias("scale"), (0.1 * F.col("id")).alias("shift"))


def pairs(spark, sf):
    first = fx.chronicle(spark, sf).groupBy("tracer").agg(F.min("date").alias("first"))
    return samples(spark, sf).join(first, "tracer").select("tracer", "date", (F.col("date") - F.col("first")).alias("upper"))


def base(spark, sf):
    return fw.base_edges(samples(spark, sf), fx.chronicle(spark, sf), tracers(spark))


def responded(spark, sf):
    return fw.refine(base(spark, sf), fx.chronicle(spark, sf), tracers(spark))


#: SQL: the same refinement as a recursion over levels; each bin keeps the segment that it lies on.
LINE = "tracer, date, mode, constant, rate, stable, prod, d1, v1, d2, v2"
TOP = "greatest(abs(k_left), abs(k_mid), abs(k_right))"
FINE = f"greatest(k_left, k_mid, k_right) - least(k_left, k_mid, k_right) <= 0.0005::double * peak + 0.02::double * {TOP} as fine"


def line_at(age: str) -> str:
    return f"((case when mode = 'constant' then constant else coalesce(v1 + (v2 - v1) * ((date - {age}) - d1) / (d2 - d1), 0.0) end) * exp(-rate * {age}) + case when stable then prod * {age} else prod * (1 - exp(-rate * {age})) / rate end)"


KS = f"{line_at('lft')} as k_left, {line_at('((lft + rgt) / 2)')} as k_mid, {line_at('rgt')} as k_right"
LINES = f"""{EDGES}, sb as (select b.tracer, b.date, lft, rgt, mode, constant, coalesce(decay_rate, 0) as rate, decay_rate is null as stable, coalesce(production_rate, 0) as prod, d1, v1, d2, v2
  from bins b join tracers t on t.name = b.tracer left join seg s on s.tracer = b.tracer and d1 <= b.date - (lft + rgt) / 2 and b.date - (lft + rgt) / 2 < d2)"""
REFINED = f"""{LINES}, levels as (
  select *, {FINE} from (select *, max({TOP}) over (partition by tracer, date) as peak from (select 0 as level, {LINE}, lft, rgt, {KS} from sb))
  union all
  select level, {LINE}, lft, rgt, k_left, k_mid, k_right, peak, {FINE} from (select *, greatest(before, max({TOP}) over (partition by tracer, date)) as peak from (
    select level, {LINE}, lft, rgt, before, {KS} from (
      select level + 1 as level, {LINE}, case when half = 0 then lft else (lft + rgt) / 2 end as lft, case when half = 0 then (lft + rgt) / 2 else rgt end as rgt, peak as before
      from levels cross join (values (0), (1)) h(half) where not fine))))
, kk as (select tracer, date, lft, rgt, k_left, k_mid, k_right from levels where fine)"""


@query("e01_base_edges", f"with {EDGES} select tracer, date, round(lft, 8) as lft, round(rgt, 8) as rgt from bins")
def e01(spark, sf):
    return base(spark, sf).select("tracer", "date", F.round("left", 8).alias("lft"), F.round("right", 8).alias("rgt"))


@query("e02_refine", f"with recursive {REFINED} select tracer, date, count(*) as n_bins, round(min(lft), 8) as lft, round(max(rgt), 8) as rgt, round(min(rgt - lft), 8) as narrowest, round(sum(k_mid * (rgt - lft)), 3) as area from kk group by all")
def e02(spark, sf):
    fine = responded(spark, sf).withColumn("width", F.col("right") - F.col("left"))
    return fine.groupBy("tracer", "date").agg(F.count("*").alias("n_bins"), F.round(F.min("left"), 8).alias("lft"), F.round(F.max("right"), 8).alias("rgt"), F.round(F.min("width"), 8).alias("narrowest"), F.round(F.sum(F.col("k_mid") * F.col("width")), 3).alias("area"))


@query("e03_right_value", f"with {LINES} select tracer, date, round(sum({line_at('lft')}), 4) as k_left, round(sum({line_at('rgt')}), 4) as k_right, count(*) as n from sb group by all")
def e03(spark, sf):
    rows = fw.with_responses(base(spark, sf), fx.chronicle(spark, sf), tracers(spark))
    return rows.groupBy("tracer", "date").agg(F.round(F.sum("k_left"), 4).alias("k_left"), F.round(F.sum("k_right"), 4).alias("k_right"), F.count("*").alias("n"))


ZE = "greatest(({t} - shift) / scale, 0)"
CDF = f"(1 - exp(-{ZE}))"
MOM = f"(shift * (1 - exp(-{ZE})) + scale * (1 - exp(-{ZE}) * (1 + {ZE})))"
WEIGHTS = f"{EDGES}, {DRAW}, wt as (select draw, tracer, date, lft, rgt, {CDF.format(t='rgt')} - {CDF.format(t='lft')} as w, least(greatest({MOM.format(t='rgt')} - {MOM.format(t='lft')} - lft * ({CDF.format(t='rgt')} - {CDF.format(t='lft')}), 0), (rgt - lft) * ({CDF.format(t='rgt')} - {CDF.format(t='lft')})) as centred from draw cross join bins)"


@query("e04_bin_weights", f"with {WEIGHTS} select draw, tracer, date, round(sum(w), 8) as mass, round(max(w), 8) as most, 0::bigint as n_clipped from wt group by all")
def e04(spark, sf):
    return fw.bin_weights(draw_grid(spark), base(spark, sf), "exp_shifted").groupBy("draw", "tracer", "date").agg(F.round(F.sum("w"), 8).alias("mass"), F.round(F.max("w"), 8).alias("most"), F.count_if("clipped").alias("n_clipped"))


@query("e05_centred_moments", f"with {WEIGHTS} select draw, tracer, date, round(sum(centred), 7) as centred, round(sum(lft * w + centred), 7) as moment from wt group by all")
def e05(spark, sf):
    rows = fw.bin_weights(draw_grid(spark), base(spark, sf), "exp_shifted")
    return rows.groupBy("draw", "tracer", "date").agg(F.round(F.sum("centred"), 7).alias("centred"), F.round(F.sum(F.col("left") * F.col("w") + F.col("centred")), 7).alias("moment"))


#: The law's mass and centred moment in each refined bin, and the sum over bins.
MASS = f"({CDF.format(t='rgt')} - {CDF.format(t='lft')})"
BENT = f"abs(k_mid - (k_left + k_right) / 2) > 0.1::double * (0.0005::double + 0.02::double) * {TOP}"
KB = f"{REFINED}, {DRAW}, fw as (select draw, kk.*, {MASS} as w, least(greatest({MOM.format(t='rgt')} - {MOM.format(t='lft')} - lft * {MASS}, 0), (rgt - lft) * {MASS}) as centred from draw cross join kk), conv as (select draw, tracer, date, sum(case when {BENT} then k_mid * w else k_left * w + (k_right - k_left) / (rgt - lft) * centred end) as modeled, sum(w) as mass, count(*) as n_bins from fw group by all)"


@query("e06_convolve_constant", f"with recursive {KB} select draw, date, round(modeled, 6) as modeled from conv where tracer = '4-NOT SPECIFIED'")
def e06(spark, sf):
    mine = responded(spark, sf).where("tracer = '4-NOT SPECIFIED'")
    return fw.convolve(draw_grid(spark), mine, "exp_shifted", ["draw"]).select("draw", "date", F.round("modeled", 6).alias("modeled"))


@query("e06b_convolve", f"with recursive {KB} select draw, tracer, date, round(modeled, 3) as modeled, round(mass, 8) as window_mass, n_bins from conv")
def e06b(spark, sf):
    return fw.convolve(draw_grid(spark), responded(spark, sf), "exp_shifted", ["draw"]).select("draw", "tracer", "date", F.round("modeled", 3).alias("modeled"), F.round("window_mass", 8).alias("window_mass"), "n_bins")


@query("e07_window_mass", f"with {EDGES}, {DRAW} select draw, tracer, date, round({CDF.format(t='upper')}, 8) as window_mass from draw cross join up")
def e07(spark, sf):
    return fw.window_mass(draw_grid(spark), pairs(spark, sf), "exp_shifted").select("draw", "tracer", "date", F.round("window_mass", 8).alias("window_mass"))


@query("e08_convolve_dirac", f"with {EDGES}, {DRAW} select draw, u.tracer, u.date, round(0.4 * case when scale <= upper then {response('u.date', 'scale', 'u.tracer')} else 0 end + 0.6 * case when shift <= upper then {response('u.date', 'shift', 'u.tracer')} else 0 end, 3) as modeled from draw cross join up u join tracers t on t.name = u.tracer")
def e08(spark, sf):
    out = fw.convolve_dirac(draw_grid(spark), pairs(spark, sf), fx.chronicle(spark, sf), tracers(spark), ["draw"], {"scale": F.lit(0.4), "shift": F.lit(0.6)})
    return out.select("draw", "tracer", "date", F.round("modeled", 3).alias("modeled"))


@query("e09_convolve_mixed", f"with recursive {KB.replace(DRAW, 'draw as (select i as draw, 1.0::double + 0.5 * i as scale, 0.1::double * i + 0.5 as shift from range(20) r(i))')} select draw, c.tracer, c.date, round(0.25 * case when 0.5 <= upper then {response('c.date', '0.5::double', 'c.tracer')} else 0 end + 0.75 * modeled, 3) as modeled, round(0.25 * (0.5 <= upper)::integer + 0.75 * mass, 8) as window_mass from conv c join up u using (tracer, date) join tracers t on t.name = c.tracer")
def e09(spark, sf):
    d = draw_grid(spark).withColumn("mu1", F.lit(0.5)).withColumn("rate", F.lit(0.25))
    out = fw.convolve_mixed(d, responded(spark, sf), pairs(spark, sf), fx.chronicle(spark, sf), tracers(spark), ["draw"])
    return out.select("draw", "tracer", "date", F.round("modeled", 3).alias("modeled"), F.round("window_mass", 8).alias("window_mass"))


BASIS = f"{KB}, lim(age_bin, lo, hi) as (values (0, 0.0::double, 2.0::double), (1, 2.0, 4.0), (2, 4.0, 6.0), (3, 6.0, 8.0)), basis as (select tracer, date, age_bin, sum(case when {BENT} then k_mid else k_left + (k_right - k_left) / (rgt - lft) * ((greatest(lft, lo) + least(rgt, hi)) / 2 - lft) end * (least(rgt, hi) - greatest(lft, lo)) / (hi - lo)) as response from kk cross join lim where least(rgt, hi) > greatest(lft, lo) group by all)"


@query("e10_uniform_basis", f"with recursive {BASIS} select tracer, date, age_bin, round(response, 3) as response from basis")
def e10(spark, sf):
    return fw.uniform_basis(responded(spark, sf), [0, 2, 4, 6, 8]).withColumn("response", F.round("response", 3))


@query("e10b_convolve_basis", f"with recursive {BASIS}, {PARS}, {STICK} select part, tracer, date, round(sum(fraction * response), 3) as modeled from fractions join basis using (age_bin) group by all")
def e10b(spark, sf):
    fr = ds.stick_breaking(latents(spark, sf), ["part"])
    return fw.convolve_basis(fr, fw.uniform_basis(responded(spark, sf), [0, 2, 4, 6, 8]), ["part"]).withColumn("modeled", F.round("modeled", 3))


@query("e11_predict", f"with recursive {KB} select draw, s.tracer as element, s.date, round(coalesce(modeled, 0), 3) as concentration, t.unit, round(coalesce(mass, 0), 8) as window_mass from draw cross join samples s left join conv c using (draw, tracer, date) join tracers t on t.name = s.tracer")
def e11(spark, sf):
    obs = samples(spark, sf).withColumnRenamed("tracer", "element")
    out = fw.predict(draw_grid(spark), obs, fx.chronicle(spark, sf), tracers(spark), "exp_shifted", ["draw"])
    return out.withColumns({"concentration": F.round("concentration", 3), "window_mass": F.round("window_mass", 8)})


@query("e12_predict_range", f"with recursive {KB.replace(fx.CHRON, fx.CHRON).replace(SAMPLES, 'samples as (select distinct tracer, 1997.0::double + 0.5 * i as date from chron cross join range(9) r(i))')} select draw, tracer as element, date, round(modeled, 3) as concentration from conv")
def e12(spark, sf):
    out = fw.predict_range(draw_grid(spark), tracers(spark), fx.chronicle(spark, sf), 1997.0, 2001.0, "exp_shifted", ["draw"], 8)
    return out.select("draw", "element", "date", F.round("concentration", 3).alias("concentration"))


@query("e13_convolution_diagnostics", f"with {WEIGHTS} select tracer, date, round(min(w), 10) as min_weight, 0::bigint as n_clipped, count(distinct lft) as n_bins from wt group by all")
def e13(spark, sf):
    return fw.convolution_diagnostics(draw_grid(spark), base(spark, sf), "exp_shifted").withColumn("min_weight", F.round("min_weight", 10))


MEMBERS = f"{SEG}, {fx.TRACER}, lim(age_bin, lo, hi) as (values (0, 0.0::double, 2.0::double), (1, 2.0, 4.0), (2, 4.0, 8.0)), mp as (select name as tracer, decay_rate, age_bin, lo + (hi - lo) * (i + 0.5) / 120 as age from tracers cross join lim cross join range(120) r(i)), members as (select p.tracer, age_bin, avg((case when 2001 - age < mn then 50.0 when 2001 - age > mx then en else coalesce(v1 + (v2 - v1) * (2001 - age - d1) / (d2 - d1), 0) end) * exp(-coalesce(decay_rate, 0) * age)) as response from mp p left join (select tracer, min(date) mn, max(date) mx, arg_max(value, date) en from chron group by 1) e on e.tracer = p.tracer left join seg s on s.tracer = p.tracer and d1 <= 2001 - age and (2001 - age < d2 or (2001 - age = d2 and d2 = last)) group by all)"


def members(spark, sf):
    return fw.endmembers(tracers(spark), fx.chronicle(spark, sf), 2001.0, [0, 2, 4, 8], 50.0)


@query("e14_endmembers", f"with {MEMBERS} select tracer, age_bin, round(response, 3) as response from members")
def e14(spark, sf):
    return members(spark, sf).withColumn("response", F.round("response", 3))


#: Parts of members: a parent, its daughter, both together, two histories mixed with delays, one with a fixed old end.
PARTS = [
    ("tritium", "2-HIGH", "parent", 1.0, 12.32, 1.5, True, 50.0, None), ("helium", "2-HIGH", "daughter", 1.0, 12.32, 1.5, True, 50.0, None),
    ("initial", "2-HIGH", "parent", 1.0, 12.32, 0.0, False, 50.0, None), ("initial", "2-HIGH", "daughter", 1.0, 12.32, 0.0, False, 50.0, None),
    ("blend", "1-URGENT", "parent", 0.4, None, 2.0, True, 10.0, None), ("blend", "5-LOW", "parent", 0.6, 5.0, 0.5, False, 20.0, None),
    ("argon", "3-MEDIUM", "parent", 1.0, 269.0, 0.0, False, 100.0, 7.5),
]
PART_COLUMNS = "member string, history string, product string, weight double, half_life double, delay double, decays boolean, before double, fixed double"


def part_literal(v) -> str:
    return "null" if v is None else repr(v).lower() if isinstance(v, bool) else f"{v!r}::double" if isinstance(v, float) else f"'{v}'"


PART_ROWS = ", ".join(f"({', '.join(map(part_literal, r))})" for r in PARTS)
HELD = "{entry} * case when decays and half_life is not null then exp(-ln(2.0::double) / half_life * delay) else 1 end"
AFTER = f"weight * {HELD} * case when product = 'parent' then exp(-coalesce(ln(2.0::double) / half_life, 0) * {{age}}) else coalesce(1 - exp(-ln(2.0::double) / half_life * {{age}}), 0) end"
COMPOSITE = f"{SEG}, parts({', '.join(c.split()[0] for c in PART_COLUMNS.split(', '))}) as (values {PART_ROWS}), lim(age_bin, lo, hi) as (values (0, 0.0::double, 2.0::double), (1, 2.0, 4.0), (2, 4.0, 6.0)), ends as (select tracer, min(date) mn, max(date) mx, arg_max(value, date) en from chron group by 1), mp as (select *, lo + (hi - lo) * i / 119 as age, 2001.0::double - (lo + (hi - lo) * i / 119) - delay as x from parts cross join lim cross join range(120) r(i)), mv as (select mp.*, case when x < mn or mn is null then before when x > mx then en else coalesce(v1 + (v2 - v1) * (x - d1) / (d2 - d1), 0) end as entry from mp left join ends e on e.tracer = history left join seg s on s.tracer = history and d1 <= x and (x < d2 or (x = d2 and d2 = last))), cm as (select member, age_bin, lo, hi, sum({AFTER.format(entry='entry', age='age')}) / 120 as response from mv group by all union all select member, 3, 6.0::double, null, sum(coalesce(weight * fixed, {AFTER.format(entry='before', age='60.0::double')})) from parts group by 1)"


@query("e14b_composite_endmembers", f"with {COMPOSITE} select member, age_bin, lo, hi, round(response, 3) as response from cm")
def e14b(spark, sf):
    out = fw.composite_endmembers(spark.createDataFrame(PARTS, PART_COLUMNS), fx.chronicle(spark, sf), 2001.0, [0, 2, 4, 6], 60.0)
    return out.withColumn("response", F.round("response", 3))


@query("e15_mix", f"with {MEMBERS}, {PARS}, {STICK} select part, tracer, round(sum(fraction * response), 2) as modeled from fractions join members using (age_bin) group by all")
def e15(spark, sf):
    fr = ds.stick_breaking(latents(spark, sf), ["part"])
    return fw.mix(fr, members(spark, sf), ["part"]).withColumn("modeled", F.round("modeled", 2))


@query("e16_qualify_forward", f"with {fx.RUNS}, q as (select a.well, a.element, a.mean as reference, b.mean as value, 300000.0::double as scale from runs a join runs b using (well, element) where a.run = 'A' and b.run = 'B'), s as (select *, case when greatest(abs(value), abs(reference)) >= 0.2::double * scale then abs(value - reference) / ((abs(value) + abs(reference)) / 2) / 0.1::double else abs(value - reference) / (0.02::double * scale) end as scaled from q) select well, element, round(scaled, 6) as scaled, scaled <= 1 as ok from s")
def e16(spark, sf):
    r = fx.runs(spark, sf)
    a, b = r.where("run = 'A'").select("well", "element", F.col("mean").alias("reference")), r.where("run = 'B'").select("well", "element", F.col("mean").alias("value"))
    return fw.qualify_forward(a.join(b, ["well", "element"]).withColumn("scale", F.lit(300000.0)), 0.1, 0.02, 0.2).select("well", "element", F.round("scaled", 6).alias("scaled"), "ok")


@query("e17_forward_identities", f"with {EDGES}, {DRAW} select draw, tracer, date, round(5 * ({CDF.format(t='upper')}), 9) as flat, round(2 * ({CDF.format(t='upper')}) + 0.3::double * ({MOM.format(t='upper')}), 8) as ramp, true as exact from draw cross join up")
def e17(spark, sf):
    out = fw.forward_identities(draw_grid(spark), base(spark, sf), "exp_shifted", ["draw"], 5.0, 2.0, 0.3)
    return out.select("draw", "tracer", "date", F.round("flat", 9).alias("flat"), F.round("ramp", 8).alias("ramp"), ((F.col("constant_error") < 1e-12) & (F.col("affine_error") < 1e-10)).alias("exact"))
