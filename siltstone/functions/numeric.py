"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def clamp(c: Column, low: float | Column, high: float | Column) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def arcsinh_scale(c: Column, threshold: float = 1.0) -> Column:
    """Linear near zero, logarithmic far from it."""
    return F.asinh(c / threshold)


def to_scale(c: Column, scale: str, threshold: float = 1.0) -> Column:
    """A value in linear, log (base 10; null at 0 and below) or arcsinh space."""
    if scale == "log":
        return F.when(c > 0, F.log10(c))
    return arcsinh_scale(c, threshold) if scale == "arcsinh" else c


def from_scale(c: Column, scale: str, threshold: float = 1.0) -> Column:
    """The inverse of to_scale()."""
    return F.pow(F.lit(10.0), c) if scale == "log" else F.sinh(c) * threshold if scale == "arcsinh" else c


def variation(c: Column) -> Column:
    """Coefficient of variation as an aggregate: population deviation over |mean|; the deviation itself near mean 0; 0 up to one value."""
    mean = F.abs(F.avg(c))
    return F.when(F.count(c) <= 1, 0.0).when(mean <= 1e-10, F.stddev_pop(c)).otherwise(F.stddev_pop(c) / mean)


def wrap_fraction(c: Column) -> Column:
    """A fractional coordinate in [0, 1); values that round to 1 become 0."""
    wrapped = F.round(c - F.floor(c), 15)
    return F.when(wrapped >= 1, 0.0).otherwise(wrapped)


def min_image(delta: Column, length: Column | float) -> Column:
    """A difference brought to the nearest periodic image in an orthogonal cell."""
    length = length if isinstance(length, Column) else F.lit(length)
    return delta - length * F.floor(delta / length + 0.5)


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def angle(u: list[Column], v: list[Column]) -> Column:
    """The angle between two vectors in degrees; 0 where one has no length."""
    dot = sum((x * y for x, y in zip(u, v, strict=True)), F.lit(0.0))
    size = F.sqrt(sum((x * x for x in u), F.lit(0.0)) * sum((x * x for x in v), F.lit(0.0)))
    return F.when(size > 0, F.degrees(F.acos(clamp(dot / size, -1.0, 1.0)))).otherwise(0.0)


def volume(matrix: list[list[Column]]) -> Column:
    """The determinant of a 3 by 3 matrix of columns."""
    (a, b, c), (d, e, f), (g, h, i) = matrix
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def normalize_timestamp(c: Column) -> Column:
    """Epoch milliseconds of a number that reads as seconds or milliseconds since 1970, else null."""
    size = F.abs(c)
    return F.when((size >= 1e9) & (size < 1e12), c * 1000).when((size >= 1e12) & (size < 1e14), c)
