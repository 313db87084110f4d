"""Special functions as Columns: Spark SQL has no erf, gamma or incomplete gamma."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos coefficients for g = 7.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]
#: Wichura's rational approximations of the inverse normal distribution (AS 241, PPND16).
PPND_A = [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3]
PPND_B = [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3]
PPND_C = [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4]
PPND_D = [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9]
PPND_E = [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7]
PPND_F = [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15]
#: Cody's rational approximations of the normal distribution near 0 and up to sqrt(32), lowest power first.
CODY_A = [18154.981253343561249, 1067.6894854603709582, 161.02823106855587881, 2.2352520354606839287, 0.065682337918207449113]
CODY_B = [45507.789335026729956, 10260.932208618978205, 976.09855173777669322, 47.20258190468824187, 1.0]
CODY_C = [9842.7148383839780218, 11602.651437647350124, 6848.1904505362823326, 2494.5375852903726711, 597.27027639480026226, 93.506656132177855979, 8.8831497943883759412, 0.39894151208813466764, 1.0765576773720192317e-8]
CODY_D = [19685.429676859990727, 38912.003286093271411, 34900.952721145977266, 18615.571640885098091, 6485.558298266760755, 1519.377599407554805, 235.38790178262499861, 22.266688044328115691, 1.0]
#: Levels of the incomplete gamma function's continued fraction; more for a large shape.
TERMS = 200
#: Levels of Mills' ratio, enough from sqrt(32) on.
MILLS = 24


def poly(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[-1])
    for k in reversed(coefficients[:-1]):
        out = out * x + F.lit(k)
    return out


def normal_inverse(p: Column) -> Column:
    """The standard normal quantile of p in (0, 1)."""
    q = p - 0.5
    r = 0.180625 - q * q
    centre = q * poly(r, PPND_A) / poly(r, PPND_B)
    t = F.sqrt(-F.log(F.least(p, 1 - p)))
    near = poly(t - 1.6, PPND_C) / poly(t - 1.6, PPND_D)
    far = poly(t - 5.0, PPND_E) / poly(t - 5.0, PPND_F)
    tail = F.when(t <= 5.0, near).otherwise(far)
    return F.when(F.abs(q) <= 0.425, centre).when(q < 0, -tail).otherwise(tail)


def log_gamma(x: Column) -> Column:
    """ln of Gamma(x) for x > 0."""
    z = x - 1
    total = F.lit(LANCZOS[0])
    for i, k in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(k) / (z + i)
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(total)


def gamma(x: Column) -> Column:
    return F.exp(log_gamma(x))


def _gamma_p_values(a: np.ndarray, x: np.ndarray, log_gamma_a: np.ndarray) -> np.ndarray:
    """P(a, x) of arrays: the power series below a + 1 until its terms add nothing, the continued fraction from there on."""
    out = np.where(np.isnan(a) | np.isnan(x), np.nan, 0.0)
    front = np.exp(a * np.log(np.maximum(x, 1e-300)) - x - log_gamma_a)
    low, high = np.flatnonzero((x > 0) & (x < a + 1)), np.flatnonzero((x > 0) & (x >= a + 1))
    if low.size:
        al, xl = a[low], x[low]
        term = 1 / al
        total, n = term.copy(), 0
        while (term > 1e-17 * total).any():
            for _ in range(8):
                n += 1
                term = term * (xl / (al + n))
                total += term
        out[low] = np.minimum(total * front[low], 1.0)
    if high.size:
        ah, xh = a[high], x[high]
        # Evaluated from the innermost level outwards; past a the levels shrink.
        fraction = np.zeros_like(ah)
        for n in range(max(TERMS, int(4 * np.sqrt(ah.max()))), 0, -1):
            fraction = n * (n - ah) / (xh + (2 * n + 1) - ah - fraction)
        out[high] = np.maximum(1 - front[high] / (xh + 1 - ah - fraction), 0.0)
    return out


def _gamma_p_inverse_values(a: np.ndarray, q: np.ndarray, log_gamma_a: np.ndarray) -> np.ndarray:
    """x with P(a, x) = q by Newton steps, halved where they leave the bracket; equal (a, q) are found once."""
    pairs, back = np.unique(np.stack([a, q, log_gamma_a]), axis=1, return_inverse=True)
    a, q, lg = pairs
    out = np.where(np.isnan(a) | np.isnan(q), np.nan, np.where(q >= 1, np.inf, 0.0))
    todo = np.flatnonzero((q > 0) & (q < 1) & (a > 0))
    a, q, lg = a[todo], q[todo], lg[todo]
    lo, hi = np.zeros_like(a), a + 40 * np.sqrt(a)
    x = a.copy()
    for _ in range(200):
        error = _gamma_p_values(a, x, lg) - q
        lo, hi = np.where(error < 0, x, lo), np.where(error < 0, hi, x)
        with np.errstate(all="ignore"):
            step = x - error / np.exp((a - 1) * np.log(x) - x - lg)
        new = np.where((step > lo) & (step < hi), step, (lo + hi) / 2)
        moved, x = np.abs(new - x), new
        if (moved <= 4e-16 * x).all():
            break
    out[todo] = x
    return out[back.ravel()]


def _on_arrays(f):
    """An Arrow function of three numbers; a null among them gives null."""

    def run(a: pa.Array, x: pa.Array, c: pa.Array) -> pa.Array:
        absent = np.logical_or.reduce([v.is_null().to_numpy(zero_copy_only=False) for v in (a, x, c)])
        return pa.array(f(*(v.to_numpy(zero_copy_only=False).astype(float) for v in (a, x, c))), pa.float64(), mask=absent)

    return F.arrow_udf(run, "double")


def gamma_p(a: Column, x: Column) -> Column:
    """The regularised lower incomplete gamma function P(a, x), on batches of rows: not inside a lambda of Spark's."""
    a = a.cast("double")
    return _on_arrays(_gamma_p_values)(a, x.cast("double"), log_gamma(a))


def gamma_p_inverse(a: Column, q: Column) -> Column:
    """x with P(a, x) = q, on batches of rows."""
    a = a.cast("double")
    return _on_arrays(_gamma_p_inverse_values)(a, q.cast("double"), log_gamma(a))


def _let(x: Column, f) -> Column:
    """f(x) with x computed once, however often f names it."""
    return F.transform(F.array(x), f)[0]


def _upper(y: Column) -> Column:
    """(1 - normal distribution) / exp(-y * y / 2) for y >= 0; beyond sqrt(32) by Mills' ratio as a continued fraction."""
    mills = y
    for n in range(MILLS, 0, -1):
        mills = y + n / mills
    return F.when(y <= math.sqrt(32.0), poly(y, CODY_C) / poly(y, CODY_D)).otherwise(1 / (F.lit(math.sqrt(2 * math.pi)) * mills))


def _centre(z: Column) -> Column:
    return z * poly(z * z, CODY_A) / poly(z * z, CODY_B)


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution by Cody's rational approximations."""

    def value(z: Column) -> Column:
        tail = _let(F.abs(z), lambda y: F.exp(-y * y / 2) * _upper(y))
        return F.when(F.abs(z) <= 0.67448975, 0.5 + _centre(z)).when(z < 0, tail).otherwise(1 - tail)

    return _let(z, value)


def normal_log_cdf(z: Column) -> Column:
    """ln of the normal distribution, exact far in the lower tail."""

    def value(z: Column) -> Column:
        return F.when(z < -0.67448975, _let(-z, lambda y: F.log(_upper(y)) - y * y / 2)).when(z <= 0.67448975, F.log(0.5 + _centre(z))).otherwise(_let(z, lambda y: F.log1p(-F.exp(-y * y / 2) * _upper(y))))

    return _let(z, value)
