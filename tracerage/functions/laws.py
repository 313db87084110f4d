"""Age distributions as Column builders, by name.

A builder takes the parameters' Columns (a dict) and an age Column. ``cdf`` is F, ``moment`` the
partial first moment, the integral of a dF up to the age.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .special import gamma, gamma_p, gamma_p_inverse, normal_cdf, normal_log_cdf

Params = dict[str, Column]


@dataclass
class Law:
    """``parameters`` in order; builders of F, the partial first moment, mean, deviation and quantile."""

    parameters: tuple[str, ...]
    cdf: Callable[[Params, Column], Column]
    moment: Callable[[Params, Column], Column]
    mean: Callable[[Params], Column]
    std: Callable[[Params], Column]
    quantile: Callable[[Params, Column], Column] | None = None
    continuous: bool = True


_laws: dict[str, Law] = {}


def register_law(name: str, law: Law) -> None:
    """Make a law known; a name is used once."""
    if name in _laws:
        raise ValueError(f"age distribution {name} is registered already")
    _laws[name] = law


def unregister_law(name: str) -> None:
    del _laws[name]


def get_law(name: str) -> Law:
    try:
        return _laws[name]
    except KeyError:
        raise KeyError(f"unknown age distribution {name}; known: {', '.join(list_laws())}") from None


def list_laws() -> list[str]:
    return sorted(_laws)


def _exp_z(p: Params, t: Column) -> Column:
    return F.greatest((t - p.get("shift", F.lit(0.0))) / p["scale"], F.lit(0.0))


def _exp_cdf(p: Params, t: Column) -> Column:
    return -F.expm1(-_exp_z(p, t))


def _exp_moment(p: Params, t: Column) -> Column:
    z = _exp_z(p, t)
    return p.get("shift", F.lit(0.0)) * -F.expm1(-z) + p["scale"] * (-F.expm1(-z) - z * F.exp(-z))


def _exp_quantile(p: Params, q: Column) -> Column:
    return p.get("shift", F.lit(0.0)) - p["scale"] * F.log1p(-q)


register_law("exp", Law(("scale",), _exp_cdf, _exp_moment, lambda p: p["scale"], lambda p: p["scale"], _exp_quantile))
register_law("exp_shifted", Law(("scale", "shift"), _exp_cdf, _exp_moment, lambda p: p["shift"] + p["scale"], lambda p: p["scale"], _exp_quantile))


def _uniform_clip(p: Params, t: Column) -> Column:
    return F.least(F.greatest(t, p["tmin"]), p["tmin"] + p["delta"])


register_law(
    "uniform",
    Law(
        ("tmin", "delta"),
        lambda p, t: (_uniform_clip(p, t) - p["tmin"]) / p["delta"],
        lambda p, t: (_uniform_clip(p, t) - p["tmin"]) * (_uniform_clip(p, t) + p["tmin"]) / (2 * p["delta"]),
        lambda p: p["tmin"] + p["delta"] / 2,
        lambda p: p["delta"] / F.sqrt(F.lit(12.0)),
        lambda p, q: p["tmin"] + q * p["delta"],
    ),
)


def _ig_parts(p: Params, t: Column) -> tuple[Column, Column]:
    """Direct and reflected terms of the inverse Gaussian distribution of mean mu and deviation sigma."""
    mu, lam = p["mu"], p["mu"] * p["mu"] * p["mu"] / (p["sigma"] * p["sigma"])
    age = F.greatest(t - p.get("shift", F.lit(0.0)), F.lit(1e-12))
    root = F.sqrt(lam / age)
    return normal_cdf(root * (age / mu - 1)), F.exp(2 * lam / mu + normal_log_cdf(-root * (age / mu + 1)))


def _ig_cdf(p: Params, t: Column) -> Column:
    direct, reflected = _ig_parts(p, t)
    return F.when(t <= p.get("shift", F.lit(0.0)), 0.0).otherwise(F.least(F.greatest(direct + reflected, F.lit(0.0)), F.lit(1.0)))


def _ig_moment(p: Params, t: Column) -> Column:
    direct, reflected = _ig_parts(p, t)
    inner = p["mu"] * F.greatest(direct - reflected, F.lit(0.0)) + p.get("shift", F.lit(0.0)) * F.least(direct + reflected, F.lit(1.0))
    return F.when(t <= p.get("shift", F.lit(0.0)), 0.0).otherwise(inner)


register_law("ig", Law(("mu", "sigma"), _ig_cdf, _ig_moment, lambda p: p["mu"], lambda p: p["sigma"]))
register_law("ig_shifted", Law(("mu", "sigma", "shift"), _ig_cdf, _ig_moment, lambda p: p["mu"] + p["shift"], lambda p: p["sigma"]))
register_law("gamma", Law(("k", "theta"), lambda p, t: gamma_p(p["k"], t / p["theta"]), lambda p, t: p["k"] * p["theta"] * gamma_p(p["k"] + 1, t / p["theta"]), lambda p: p["k"] * p["theta"], lambda p: F.sqrt(p["k"]) * p["theta"], lambda p, q: p["theta"] * gamma_p_inverse(p["k"], q)))


def _weibull_z(p: Params, t: Column) -> Column:
    return F.pow(F.greatest(t, F.lit(0.0)) / p["lam"], p["k"])


register_law(
    "weibull",
    Law(
        ("k", "lam"),
        lambda p, t: -F.expm1(-_weibull_z(p, t)),
        lambda p, t: p["lam"] * gamma(1 + 1 / p["k"]) * gamma_p(1 + 1 / p["k"], _weibull_z(p, t)),
        lambda p: p["lam"] * gamma(1 + 1 / p["k"]),
        lambda p: p["lam"] * F.sqrt(gamma(1 + 2 / p["k"]) - F.pow(gamma(1 + 1 / p["k"]), F.lit(2.0))),
        lambda p, q: p["lam"] * F.pow(-F.log1p(-q), 1 / p["k"]),
    ),
)


def _step(t: Column, at: Column) -> Column:
    return F.when(t >= at, 1.0).otherwise(0.0)


def _two(p: Params, f: Callable[[Column], Column]) -> Column:
    return p["rate"] * f(p["mu1"]) + (1 - p["rate"]) * f(p["mu2"])


def _two_std(p: Params) -> Column:
    return F.sqrt(p["rate"] * (1 - p["rate"])) * F.abs(p["mu1"] - p["mu2"])


register_law("dirac", Law(("mu1",), lambda p, t: _step(t, p["mu1"]), lambda p, t: p["mu1"] * _step(t, p["mu1"]), lambda p: p["mu1"], lambda p: F.lit(0.0), lambda p, q: p["mu1"], continuous=False))
_double = (lambda p, t: _two(p, lambda m: _step(t, m)), lambda p, t: _two(p, lambda m: m * _step(t, m)), lambda p: _two(p, lambda m: m), _two_std)
register_law("dirac_double", Law(("mu1", "mu2", "rate"), *_double, continuous=False))
#: The second age is fixed outside and given as mu2 like a parameter.
register_law("dirac_double_1_set", Law(("mu1", "rate"), *_double, continuous=False))


def _mix_exp(p: Params) -> Params:
    return {"scale": p["scale"], "shift": p["mu1"] + p["shift"]}


register_law(
    "mix_exp_shifted",
    Law(
        ("mu1", "scale", "shift", "rate"),
        lambda p, t: p["rate"] * _step(t, p["mu1"]) + (1 - p["rate"]) * _exp_cdf(_mix_exp(p), t),
        lambda p, t: p["rate"] * p["mu1"] * _step(t, p["mu1"]) + (1 - p["rate"]) * _exp_moment(_mix_exp(p), t),
        lambda p: p["mu1"] + (1 - p["rate"]) * (p["shift"] + p["scale"]),
        lambda p: F.sqrt((1 - p["rate"]) * p["scale"] * p["scale"] + p["rate"] * (1 - p["rate"]) * F.pow(p["shift"] + p["scale"], F.lit(2.0))),
        continuous=False,
    ),
)


def bisect_quantile(law: Law, p: Params, q: Column, top: Column, steps: int = 60) -> Column:
    """A quantile between 0 and ``top`` by halving a fixed number of times, for laws without a quantile of their own.

    The law's distribution is a plain expression: one of Python functions, as by gamma_p(), needs a quantile beside it.
    """
    start = F.struct(F.lit(0.0).alias("lo"), top.cast("double").alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        low = law.cdf(p, mid) < q
        return F.struct(F.when(low, mid).otherwise(acc["lo"]).alias("lo"), F.when(low, acc["hi"]).otherwise(mid).alias("hi"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)
    return (end["lo"] + end["hi"]) / 2
