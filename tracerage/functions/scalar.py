"""Scalar functions of the data model as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def normalize_tracer(col) -> Column:
    """``CFC-11`` to ``cfc11``; null for what isn't cfc and digits then."""
    plain = F.lower(F.regexp_replace(F.trim(c(col)), "[-_ ]", ""))
    return F.when(plain.rlike("^cfc[0-9]+$"), plain)


def year_days(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))


def decimal_year(col) -> Column:
    """``dd/mm/yyyy`` to a decimal year of true length."""
    date = F.to_date(c(col), "dd/MM/yyyy")
    return F.year(date) + (F.dayofyear(date) - 1) / year_days(F.year(date))


def decimal_year_2digit(col, digits: int | None = None) -> Column:
    """``dd-mm-yy`` to a decimal year; years up to 49 are 20xx. Halves round to even."""
    part = F.split(c(col), "-")
    short = part[2].cast("int")
    date = F.make_date(F.when(short <= 49, short + 2000).otherwise(short + 1900), part[1].cast("int"), part[0].cast("int"))
    year = F.year(date) + (F.dayofyear(date) - 1) / year_days(F.year(date))
    return year if digits is None else F.bround(year, digits)


def calendar_year(col) -> Column:
    return F.floor(c(col)).cast("long")


def date_label(col) -> Column:
    """``2010.0`` to ``2010``, other points to underscores."""
    text = c(col).cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"\.0$", ""), r"\.", "_")


def to_bool(col) -> Column:
    return F.lower(F.trim(c(col))) == "true"


def to_num(col) -> Column:
    """A finite number or null."""
    x = F.expr(f"try_cast({col} as double)") if isinstance(col, str) else col.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def observation_key(element="element", date="date", index=None) -> Column:
    """``element@date`` or ``element@date#index``."""
    key = F.concat(c(element), F.lit("@"), c(date).cast("string"))
    return key if index is None else F.concat(key, F.lit("#"), c(index).cast("string"))


def screen_delta(col) -> Column:
    """Air effects by the absolute excess in percent: up to 10, up to 20, above; ``not_available`` without one."""
    x = F.abs(c(col))
    return F.when(x.isNull() | F.isnan(x), "not_available").when(x <= 10, "limited_air_effects").when(x <= 20, "moderate_air_effects").otherwise("strong_air_effects")


def uniform(*key) -> Column:
    """A reproducible uniform number in (0, 1) of a key: 52 bits of its SHA-256."""
    text = F.concat_ws("|", *(k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key))
    return (F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") + 0.5) / 4503599627370496.0


def near_boundary(value, lo, hi) -> Column:
    """Within max(1e-8, 1e-5 of the range) of an end."""
    tol = F.greatest(F.lit(1e-8), 1e-5 * (c(hi) - c(lo)))
    return (c(value) - c(lo) <= tol) | (c(hi) - c(value) <= tol)
