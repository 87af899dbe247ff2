"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Significance levels with their marks, effect-size limits with their names, the level at which a
# test is called significant, and the filler for a group without any value.
SIGNIFICANCE_MARKS = [(0.001, "***"), (0.01, "**"), (0.05, "*")]
EFFECT_BANDS = [(0.01, "negligible"), (0.06, "small"), (0.14, "medium")]
LARGEST_EFFECT = "large"
ALPHA = 0.05
UNKNOWN = "unknown"

# Features are kept on a grid of 1e-9: sums of doubles depend on the order of addition, and equal values must stay
# equal across partitionings for ranks, medians and `>=` tests to be repeatable.
GRID_DECIMALS = 9


def whole_days(start: Column, end: Column) -> Column:
    """Days from ``start`` to ``end``, rounded down, so one hour early is -1. Needs no time zone."""
    days = F.date_diff(end, start)
    return days - (end < start + F.make_dt_interval(days)).cast("int")


def most_counted(value: str | Column, rows: str) -> Column:
    """Aggregate over counted values: the one with the most ``rows``, nulls ignored, smallest value on a tie, null when there is none."""
    value = F.col(value) if isinstance(value, str) else value
    ranked = F.struct((-F.col(rows)).alias("order"), value.alias("value"))  # the value is held and sent once
    return F.min(F.when(value.isNotNull(), ranked))["value"]


def on_grid(value: Column) -> Column:
    return F.round(value, GRID_DECIMALS)


def significance_mark(p: Column) -> Column:
    level, mark = SIGNIFICANCE_MARKS[0]
    chain = F.when(p < level, mark)
    for level, mark in SIGNIFICANCE_MARKS[1:]:
        chain = chain.when(p < level, mark)
    return chain.otherwise("")


def effect_band(eta_squared: Column) -> Column:
    limit, name = EFFECT_BANDS[0]
    chain = F.when(eta_squared < limit, name)
    for limit, name in EFFECT_BANDS[1:]:
        chain = chain.when(eta_squared < limit, name)
    return chain.when(eta_squared.isNotNull(), LARGEST_EFFECT)


def horner(coefficients: Sequence[float], x: Column) -> Column:
    """Polynomial with the constant term first."""
    acc = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        acc = acc * x + F.lit(c)
    return acc


# The rational approximations of the normal quantile by Wichura (1988), algorithm AS 241, PPND16.
# Each pair is (numerator, denominator), constant term first: centre, shoulders, tails.
AS241_CENTRE = (
    [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3],
    [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3],
)
AS241_SHOULDER = (
    [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4],
    [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9],
)
AS241_TAIL = (
    [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
    [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15],
)


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function."""
    q = p - 0.5
    c = F.lit(0.180625) - q * q
    centre = q * horner(AS241_CENTRE[0], c) / horner(AS241_CENTRE[1], c)
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    shoulder = horner(AS241_SHOULDER[0], r - 1.6) / horner(AS241_SHOULDER[1], r - 1.6)
    tail = horner(AS241_TAIL[0], r - 5) / horner(AS241_TAIL[1], r - 5)
    return F.when(F.abs(q) <= 0.425, centre).otherwise(F.signum(q) * F.when(r <= 5, shoulder).otherwise(tail))
