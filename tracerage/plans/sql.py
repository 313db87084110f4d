"""SQL of the numbers that DuckDB has no function for, from the same published coefficients."""

from __future__ import annotations

from ..functions.special import PPND_A, PPND_B, PPND_C, PPND_D, PPND_E, PPND_F


def poly(x: str, coefficients: list[float]) -> str:
    out = repr(coefficients[-1]) + "::double"
    for k in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {k!r}::double)"
    return out


def normal_inverse(p: str) -> str:
    """The standard normal quantile of a column p in (0, 1)."""
    r, t = f"(0.180625::double - ({p} - 0.5) * ({p} - 0.5))", f"sqrt(-ln(least({p}, 1 - {p})))"
    near, far = (f"{poly(f'({t} - {at}::double)', a)} / {poly(f'({t} - {at}::double)', b)}" for at, a, b in ((1.6, PPND_C, PPND_D), (5.0, PPND_E, PPND_F)))
    return f"case when abs({p} - 0.5) <= 0.425 then ({p} - 0.5) * {poly(r, PPND_A)} / {poly(r, PPND_B)} else sign({p} - 0.5) * case when {t} <= 5 then {near} else {far} end end"


def normal_cdf(z: str) -> str:
    """The standard normal distribution by its series of odd powers; 0 and 1 beyond 8 deviations."""
    terms = f"list_sum(list_transform(range(0, 160), lambda n: exp((2 * n + 1) * ln(abs({z})) - (n + 1) * ln(2.0::double) - lgamma(n + 1.5) + 0.5 * ln(pi()))))"
    return f"case when {z} < -8 then 0.0 when {z} > 8 then 1.0 when {z} = 0 then 0.5 else 0.5 + sign({z}) * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {terms} end"
