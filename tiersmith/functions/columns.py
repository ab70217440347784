"""Expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HARTREE_TO_EV = 27.2114079527


def order_hash(key: Column, seed: Column | int | str) -> Column:
    """Seeded pseudo-random order of a key; identical in any SQL engine that has md5."""
    tail = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(key.cast("string"), F.lit("-"), tail.cast("string")))


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def round_off(c: Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def vec(c: Column) -> Column:
    return c.cast("array<double>")


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def sq_distance(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def se_kernel(x: Column, y: Column, variance: float = 1.0, lengthscale: float = 1.0) -> Column:
    """Squared-exponential covariance of two vectors."""
    return F.lit(float(variance)) * F.exp(-sq_distance(x, y) / F.lit(2.0 * lengthscale * lengthscale))


def case_label(c: Column, a: Column) -> Column:
    """Which sets feed the secondary tasks: C when c>0, then A when a>0."""
    return F.concat(F.when(c > 0, F.lit("C")).otherwise(F.lit("")),
                    F.when(a > 0, F.lit("A")).otherwise(F.lit("")))


def linear_cost(high: Column, low: Column, per_high: float, per_low: float) -> Column:
    return high * F.lit(float(per_high)) + low * F.lit(float(per_low))


# Seconds per primary and per secondary datum of the two published examples.
COST_MODELS = {"water": (24550.3, 665.0), "organic": (13288.3, 54.5)}
