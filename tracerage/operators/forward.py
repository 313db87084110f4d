"""The forward model: convolution of responses with age distributions, as joins and sums (E rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.laws import Law, get_law
from ..sources.io import stored
from . import chronicle as ch

#: Absolute part (of the greatest response) and relative part of the tolerance of a bin.
GLOBAL_TOL, LOCAL_TOL, MAX_LEVELS, MAX_BINS = 5e-4, 0.02, 20, 20_000


def base_edges(pairs: DataFrame, chronicle: DataFrame, tracers: DataFrame, n: int = 64) -> DataFrame:
    """``tracer, date, left, right``: age bins of a sampling date.

    Edges are 0, the oldest age and the ages of knots between; without a history n equal bins (one
    for a constant). A pair without a window has no bins.
    """
    mode = tracers.select(F.col("name").alias("tracer"), "mode")
    ends = chronicle.groupBy("tracer").agg(F.min("date").alias("first"))
    rows = pairs.select("tracer", "date").distinct().join(ends, "tracer", "left").join(mode, "tracer", "left")
    rows = rows.withColumn("upper", F.col("date") - F.coalesce("first", F.lit(1950.0))).where("upper > 0")
    flat = (F.col("mode") == "constant") | F.col("first").isNull()
    steps = F.when(F.col("mode") == "constant", 1).otherwise(n)
    equal = rows.where(flat).select("tracer", "date", F.explode(F.transform(F.sequence(F.lit(0), steps), lambda i: i * F.col("upper") / steps)).alias("age"))
    dated = rows.where(~flat)
    knots = dated.join(chronicle.select("tracer", F.col("date").alias("knot")), "tracer").where("knot > first and knot < date").select("tracer", "date", (F.col("date") - F.col("knot")).alias("age"))
    ends_ = dated.select("tracer", "date", F.explode(F.array(F.lit(0.0), F.col("upper"))).alias("age"))
    w = Window.partitionBy("tracer", "date").orderBy("age")
    edges = equal.unionByName(knots).unionByName(ends_).distinct()
    return edges.select("tracer", "date", F.col("age").alias("left"), F.lead("age").over(w).alias("right")).where("right is not null")


def _on_lines(bins: DataFrame, chronicle: DataFrame, tracers: DataFrame) -> DataFrame:
    """Bins with ``line``: the segment of the history that they lie on and the tracer's catalogue row."""
    cat = tracers.select(F.col("name").alias("tracer"), "mode", F.col("constant").alias("const"), F.col("production_rate").alias("prod"), F.col("decay_rate").alias("rate"))
    rows = ch.with_segment(bins.withColumn("__mid", F.col("date") - (F.col("left") + F.col("right")) / 2), chronicle, "__mid", "segment").drop("__mid")
    return rows.join(cat, "tracer", "left").select(*bins.columns, F.struct("segment", "mode", "const", "prod", "rate").alias("line"))


def _responses(rows: DataFrame) -> DataFrame:
    line = F.col("line")
    of = {n: line[n] for n in ("mode", "const", "prod", "rate")}
    at = lambda age: ch.response_of(F.col("tracer"), F.col("date"), age, ch.on_segment(line["segment"], F.col("date") - age), **of)
    mid = (F.col("left") + F.col("right")) / 2
    return rows.withColumns({"k_left": at(F.col("left")), "k_mid": at(mid), "k_right": at(F.col("right"))})


def with_responses(bins: DataFrame, chronicle: DataFrame, tracers: DataFrame) -> DataFrame:
    """Bins with ``k_left, k_mid, k_right``. Bins must not cross a knot, as those of base_edges() don't.

    A bin is looked up once and evaluated on its own line: where the response jumps, at the ends of
    a history, each of the two bins has the value on its own side.
    """
    return _responses(_on_lines(bins, chronicle, tracers)).drop("line")


def refine(bins: DataFrame, chronicle: DataFrame, tracers: DataFrame, global_tol: float = GLOBAL_TOL, local_tol: float = LOCAL_TOL, levels: int = MAX_LEVELS, most: int = MAX_BINS, at_once: int = 4) -> DataFrame:
    """Bins split at their middle until the responses in each vary little; with responses.

    A bin is fine when its responses range over no more than ``global_tol`` of the pair's greatest
    response so far plus ``local_tol`` of its own. The history is looked up once; halves keep their
    bin's line. Bins are dealt by pair once and stay so: ``at_once`` levels are one stored job. A
    pair with a bin that isn't fine after ``levels`` steps, or with more than ``most`` bins, fails
    the job.
    """
    here = Window.partitionBy("tracer", "date")
    mid = (F.col("left") + F.col("right")) / 2
    top = F.greatest(F.abs("k_left"), F.abs("k_mid"), F.abs("k_right"))
    spread = F.greatest("k_left", "k_mid", "k_right") - F.least("k_left", "k_mid", "k_right")

    def judged(rows: DataFrame) -> DataFrame:
        """Rows that aren't ``fine`` yet get responses and are judged by the greatest so far."""
        new = _responses(rows.withColumns({f"was_{n}": F.col(n) for n in ("k_left", "k_mid", "k_right")}))
        rows = new.withColumns({n: F.when(F.col("fine"), F.col(f"was_{n}")).otherwise(F.col(n)) for n in ("k_left", "k_mid", "k_right")}).drop("was_k_left", "was_k_mid", "was_k_right")
        rows = rows.withColumn("peak", F.greatest("peak", F.max(F.when(~F.col("fine"), top)).over(here)))
        return rows.withColumn("fine", F.col("fine") | (spread <= global_tol * F.col("peak") + local_tol * top))

    def halved(rows: DataFrame) -> DataFrame:
        halves = F.array(F.struct("left", mid.alias("right")), F.struct(mid.alias("left"), "right"))
        parts = F.when(F.col("fine"), F.array(F.struct("left", "right"))).otherwise(halves)
        return rows.select("tracer", "date", "line", "k_left", "k_mid", "k_right", "peak", "fine", F.inline(parts))

    none = F.lit(None).cast("double")
    rows = _on_lines(bins, chronicle, tracers).withColumns({"k_left": none, "k_mid": none, "k_right": none, "peak": F.lit(0.0), "fine": F.lit(False)})
    rows, done = stored(judged(rows), "bins"), 0
    while True:
        pairs = rows.groupBy("tracer", "date").agg(F.count("*").alias("bins"), F.count_if(~F.col("fine")).alias("open"), F.max(F.when(~F.col("fine"), spread)).alias("range"))
        worst = pairs.orderBy(F.col("bins") <= most, F.desc_nulls_last("range")).first()
        if worst is None or (worst["bins"] <= most and not worst["open"]):
            return rows.select("tracer", "date", "left", "right", "k_left", "k_mid", "k_right")
        if worst["bins"] > most or done == levels:
            raise ValueError(f"age bins of {worst['tracer']} at {worst['date']} aren't fine after {done} steps: {worst['bins']} bins, responses range over {worst['range']} in one")
        for _ in range(min(at_once, levels - done)):
            rows, done = judged(halved(rows)), done + 1
        rows = stored(rows, "bins")


def every_pair(draws: DataFrame, table: DataFrame) -> DataFrame:
    """Draws x rows of a table that is bounded per pair, not over all pairs.

    The table is stored first, so Spark knows its size: it is sent to all tasks only below the
    session's broadcast threshold, and partitions meet partitions beyond it.
    """
    return draws.crossJoin(stored(table, "pairs"))


def _params(law: Law) -> dict[str, Column]:
    return {n: F.col(n) for n in (*law.parameters, *(("mu2",) if "mu2" not in law.parameters and "mu1" in law.parameters and "rate" in law.parameters else ()))}


def bin_weights(draws: DataFrame, bins: DataFrame, model: str) -> DataFrame:
    """Draws x bins with the mass ``w`` of the law in each bin and its centred first moment.

    Both ends are evaluated in the row, so no window or further shuffle is needed. F is held in
    [0, 1], masses at 0 or more, moments in [0, width * mass]; what had to be held is in ``clipped``.
    """
    law = get_law(model)
    p = _params(law)
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    rows = every_pair(draws, bins)
    rows = rows.withColumn("__raw", clip(law.cdf(p, F.col("right"))) - clip(law.cdf(p, F.col("left"))))
    rows = rows.withColumn("w", F.greatest(F.col("__raw"), F.lit(0.0))).withColumn("clipped", F.col("__raw") < 0)
    centred = law.moment(p, F.col("right")) - law.moment(p, F.col("left")) - F.col("left") * F.col("w")
    return rows.withColumn("centred", F.least(F.greatest(centred, F.lit(0.0)), (F.col("right") - F.col("left")) * F.col("w"))).drop("__raw")


def bent(global_tol: float = GLOBAL_TOL, local_tol: float = LOCAL_TOL) -> Column:
    """Whether a bin's middle response is off its chord by a tenth of the tolerance: then it counts by its middle."""
    top = F.greatest(F.abs("k_left"), F.abs("k_mid"), F.abs("k_right"))
    return F.abs(F.col("k_mid") - (F.col("k_left") + F.col("k_right")) / 2) > 0.1 * (global_tol + local_tol) * top


def contribution(global_tol: float = GLOBAL_TOL, local_tol: float = LOCAL_TOL) -> Column:
    """A bin's part of the prediction: linear where its responses are, its middle response otherwise."""
    slope = (F.col("k_right") - F.col("k_left")) / (F.col("right") - F.col("left"))
    return F.when(bent(global_tol, local_tol), F.col("k_mid") * F.col("w")).otherwise(F.col("k_left") * F.col("w") + slope * F.col("centred"))


def convolve(draws: DataFrame, bins: DataFrame, model: str, keys: list[str]) -> DataFrame:
    """``keys, tracer, date, modeled, window_mass, n_bins, n_clipped`` of each draw and pair.

    Draws stay where they are and meet the bins; partial sums collapse bins in each task.
    Mass older than the history counts 0 and isn't spread over the rest.
    """
    rows = bin_weights(draws, bins, model).withColumn("part", contribution())
    return rows.groupBy(*keys, "tracer", "date").agg(F.sum("part").alias("modeled"), F.sum("w").alias("window_mass"), F.count("*").alias("n_bins"), F.count_if("clipped").alias("n_clipped"))


def window_mass(draws: DataFrame, pairs: DataFrame, model: str) -> DataFrame:
    """Draws x pairs (``tracer, date, upper``) with the share of the law that the history covers."""
    law = get_law(model)
    p = _params(law)
    rows = every_pair(draws, pairs)
    low = law.cdf(p, F.lit(0.0)) if law.continuous else F.lit(0.0)
    return rows.withColumn("window_mass", F.when(F.col("upper") <= 0, 0.0).otherwise(F.least(F.greatest(law.cdf(p, F.col("upper")) - low, F.lit(0.0)), F.lit(1.0))))


def convolve_dirac(draws: DataFrame, pairs: DataFrame, chronicle: DataFrame, tracers: DataFrame, keys: list[str], ages: dict[str, Column]) -> DataFrame:
    """Point ages: the response at each age (0 outside of the window) times its weight.

    ``ages`` has an age column's name and its weight.
    """
    points = F.array(*(F.struct(F.col(a).alias("age"), w.alias("weight")) for a, w in ages.items()))
    rows = every_pair(draws, pairs).select(*keys, "tracer", "date", "upper", F.inline(points))
    k = ch.tracer_response(rows, chronicle, tracers)
    inside = (F.col("age") >= 0) & (F.col("age") <= F.col("upper"))
    return k.groupBy(*keys, "tracer", "date").agg(F.sum(F.when(inside, F.col("k") * F.col("weight")).otherwise(0.0)).alias("modeled"), F.sum(F.when(inside, F.col("weight")).otherwise(0.0)).alias("window_mass"))


def convolve_mixed(draws: DataFrame, bins: DataFrame, pairs: DataFrame, chronicle: DataFrame, tracers: DataFrame, keys: list[str]) -> DataFrame:
    """A point age of weight ``rate`` at mu1 and an exponential from mu1 + shift with the rest."""
    point = convolve_dirac(draws, pairs, chronicle, tracers, keys, {"mu1": F.col("rate")})
    inner = draws.withColumn("shift", F.col("mu1") + F.col("shift"))
    rest = convolve(inner, bins, "exp_shifted", keys).join(draws.select(*keys, "rate"), keys)
    rest = rest.select(*keys, "tracer", "date", ((1 - F.col("rate")) * F.col("modeled")).alias("modeled"), ((1 - F.col("rate")) * F.col("window_mass")).alias("window_mass"))
    return point.unionByName(rest).groupBy(*keys, "tracer", "date").agg(F.sum("modeled").alias("modeled"), F.sum("window_mass").alias("window_mass"))


def uniform_basis(bins: DataFrame, edges: list[float]) -> DataFrame:
    """``tracer, date, age_bin, response``: the mean response of each age interval, once for all draws.

    A bin counts by the same rule as for any law: linear, or by its middle where it is bent.
    """
    limits = F.array(*(F.struct(F.lit(i).alias("age_bin"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))))
    rows = bins.select("*", F.inline(limits)).withColumn("a", F.greatest("left", "lo")).withColumn("b", F.least("right", "hi")).where("b > a")
    slope = (F.col("k_right") - F.col("k_left")) / (F.col("right") - F.col("left"))
    mean = F.when(bent(), F.col("k_mid")).otherwise(F.col("k_left") + slope * ((F.col("a") + F.col("b")) / 2 - F.col("left")))
    return rows.groupBy("tracer", "date", "age_bin").agg(F.sum(mean * (F.col("b") - F.col("a")) / (F.col("hi") - F.col("lo"))).alias("response"))


def convolve_basis(fractions: DataFrame, basis: DataFrame, keys: list[str]) -> DataFrame:
    """Fractions (``keys, age_bin, fraction``) times responses, summed."""
    return fractions.join(stored(basis, "basis"), "age_bin").groupBy(*keys, "tracer", "date").agg(F.sum(F.col("fraction") * F.col("response")).alias("modeled"))


def predict(draws: DataFrame, obs: DataFrame, chronicle: DataFrame, tracers: DataFrame, model: str, keys: list[str], fine: bool = True) -> DataFrame:
    """Predictions in the form of observations: ``keys, element, date, concentration, unit, window_mass``.

    Every pair of an observation has a row; one without a window has 0. Bins are refined unless
    ``fine`` is false.
    """
    pairs = stored(obs.select(F.col("element").alias("tracer"), "date").distinct(), "pairs")
    bins = base_edges(pairs, chronicle, tracers)
    bins = refine(bins, chronicle, tracers) if fine else stored(with_responses(bins, chronicle, tracers), "bins")
    got = convolve(draws, bins, model, keys).select(*keys, "tracer", "date", "modeled", "window_mass")
    none = pairs.join(bins.select("tracer", "date").distinct(), ["tracer", "date"], "left_anti")
    zero = every_pair(draws.select(*keys), none).withColumns({"modeled": F.lit(0.0), "window_mass": F.lit(0.0)})
    out = got.unionByName(zero).join(tracers.select(F.col("name").alias("tracer"), "unit"), "tracer", "left")
    return out.select(*keys, F.col("tracer").alias("element"), "date", F.col("modeled").alias("concentration"), "unit", "window_mass")


def predict_range(draws: DataFrame, tracers: DataFrame, chronicle: DataFrame, first: float, last: float, model: str, keys: list[str], n: int = 50) -> DataFrame:
    """Predictions at n + 1 dates from ``first`` to ``last`` for every tracer."""
    span = tracers.select(F.col("name").alias("element")).withColumn("a", F.lit(first)).withColumn("b", F.lit(last))
    dates = ch.subdivide(span, "a", "b", n, "date").select("element", "date")
    return predict(draws, dates, chronicle, tracers, model, keys)


def convolution_diagnostics(draws: DataFrame, bins: DataFrame, model: str) -> DataFrame:
    """Per pair over all draws: least and greatest window mass, bins, least mass, clipped masses."""
    rows = bin_weights(draws, bins, model)
    n = bins.groupBy("tracer", "date").agg(F.count("*").alias("n_bins"))
    mass = rows.groupBy("tracer", "date").agg(F.min("w").alias("min_weight"), F.count_if("clipped").alias("n_clipped"))
    return mass.join(n, ["tracer", "date"])


def endmembers(tracers: DataFrame, chronicle: DataFrame, date: float, edges: list[float], left_fill: float, n: int = 120) -> DataFrame:
    """``tracer, age_bin, response``: the mean of n responses in each age interval of a sampling date."""
    limits = F.array(*(F.struct(F.lit(i).alias("age_bin"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))))
    pts = tracers.select(F.col("name").alias("tracer"), "decay_rate", F.inline(limits)).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    pts = pts.withColumn("age", F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("i") + 0.5) / n).withColumn("x", date - F.col("age"))
    k = ch.interpolate_hold(pts, chronicle, left_fill)
    return k.groupBy("tracer", "age_bin").agg(F.avg(ch.decay(F.col("value"), F.col("decay_rate"), F.col("age"))).alias("response"))


def composite_endmembers(parts: DataFrame, chronicle: DataFrame, date: float, edges: list[float], old_age: float, n: int = 120) -> DataFrame:
    """``member, age_bin, lo, hi, response``: end-members made of parts of histories, and their old end.

    ``parts`` has rows ``member, history, product, weight, half_life, delay, decays, before, fixed``. A
    member is the weighted sum of its parts. A part's water enters its history's tracer ``delay``
    years before recharge (``before`` where the history hasn't begun) and decays on the way if
    ``decays``; after an age its ``product`` is the ``parent`` that is left or the ``daughter``
    that has grown (none without a half-life). Each bin between ``edges`` has the mean of n ages from
    end to end. The open bin after the last edge (``hi`` null) has ``fixed``, or ``before`` at ``old_age``.
    """
    last = len(edges) - 2
    limits = F.array(*(F.struct(F.lit(i).alias("age_bin"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))))
    rate = F.log(F.lit(2.0)) / F.col("half_life")
    wrong = F.raise_error(F.concat(F.lit("no product of a part is called "), F.col("product"))).cast("double")

    def after(age: Column, entry: Column) -> Column:
        held = entry * F.when(F.col("decays") & rate.isNotNull(), F.exp(-rate * F.col("delay"))).otherwise(1.0)
        grown = held * F.coalesce(-F.expm1(-rate * age), F.lit(0.0))
        return F.col("weight") * F.when(F.col("product") == "parent", ch.decay(held, rate, age)).when(F.col("product") == "daughter", grown).otherwise(wrong)

    pts = parts.withColumnRenamed("history", "tracer").select("*", F.inline(limits)).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    pts = pts.withColumn("age", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / max(n - 1, 1)).withColumn("x", date - F.col("age") - F.col("delay"))
    young = ch.interpolate_hold(pts, chronicle, F.col("before")).groupBy("member", "age_bin", "lo", "hi").agg((F.sum(after(F.col("age"), F.col("value"))) / n).alias("response"))
    old = parts.groupBy("member").agg(F.sum(F.coalesce(F.col("weight") * F.col("fixed"), after(F.lit(float(old_age)), F.col("before")))).alias("response"))
    open_bin = {"age_bin": F.lit(last + 1), "lo": F.lit(float(edges[-1])), "hi": F.lit(None).cast("double")}
    return young.unionByName(old.withColumns(open_bin))


def mix(fractions: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """End-member responses times fractions: ``keys, tracer, modeled``."""
    return fractions.join(members, "age_bin").groupBy(*keys, "tracer").agg(F.sum(F.col("fraction") * F.col("response")).alias("modeled"))


def qualify_forward(df: DataFrame, relative: float, absolute: float, least: float = 1e-3) -> DataFrame:
    """``scaled`` difference of ``value`` and ``reference`` against its limit, and ``ok`` (1 or less).

    Relative to the mean size when the larger one is at least ``least`` of ``scale``, otherwise absolute.
    """
    top = F.greatest(F.abs("value"), F.abs("reference"))
    diff = F.abs(F.col("value") - F.col("reference"))
    half = (F.abs("value") + F.abs("reference")) / 2
    scaled = F.when(top >= least * F.col("scale"), diff / half / relative).otherwise(diff / (absolute * F.col("scale")))
    return df.withColumn("scaled", scaled).withColumn("ok", ~F.isnan(F.col("scaled")) & (F.col("scaled") <= 1))


def forward_identities(draws: DataFrame, bins: DataFrame, model: str, keys: list[str], constant: float, a: float, b: float) -> DataFrame:
    """``flat, ramp`` and their absolute errors: two identities that hold for any law.

    A constant input gives constant * window mass; a response a + b * age gives
    a * window mass + b * the partial first moment.
    """
    law = get_law(model)
    p = _params(law)
    rows = bin_weights(draws, bins, model)
    flat = F.sum(F.lit(constant) * F.col("w"))
    ramp = F.sum((a + b * F.col("left")) * F.col("w") + b * F.col("centred"))
    got = rows.groupBy(*keys, *law.parameters, "tracer", "date").agg(flat.alias("flat"), ramp.alias("ramp"), F.max("right").alias("upper"))
    mass, moment = law.cdf(p, F.col("upper")) - law.cdf(p, F.lit(0.0)), law.moment(p, F.col("upper")) - law.moment(p, F.lit(0.0))
    return got.select(*keys, "tracer", "date", "flat", "ramp", F.abs(F.col("flat") - constant * mass).alias("constant_error"), F.abs(F.col("ramp") - (a * mass + b * moment)).alias("affine_error"))
