"""Symmetry operations as geometry: the kind of element, its axis, and its screw or glide part, as column expressions.

An operation is a whole matrix on fractional coordinates (nine columns, row by row) and a translation (three columns). Its
determinant and trace tell the kind and order; the axis is the null space of its proper part less the identity, read off as a cross
product of two of its rows and divided by the common divisor; and the part of the translation that no change of origin takes away is
the mean of its images under the powers of the matrix.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The trace of a proper rotation by its order.
TRACES = {3: 1, -1: 2, 0: 3, 1: 4, 2: 6}
Matrix = list[list[Column]]


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often `then` uses it and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _matrix(m: Column) -> Matrix:
    return [[m[3 * i + j] for j in range(3)] for i in range(3)]


def _det(m: Matrix) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def _cross(a: list[Column], b: list[Column]) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def _axis(rows: Column) -> Column:
    """The primitive null vector of a matrix of rank two, from the first product of two rows that is not zero."""
    some = lambda v: F.exists(v, lambda x: x != 0)
    products = lambda a: F.array(*(_cross(_matrix(a)[i], _matrix(a)[j]) for i, j in ((0, 1), (0, 2), (1, 2))))

    def primitive(v: Column) -> Column:
        sizes = F.sequence(F.lit(1), F.greatest(F.lit(1), F.array_max(F.transform(v, lambda x: F.abs(x)))))
        divisor = F.array_max(F.filter(sizes, lambda d: F.forall(v, lambda x: x % d == 0)))
        sign = F.signum(F.get(F.filter(v, lambda x: x != 0), F.lit(0)))
        return _let(divisor * sign, lambda by: F.transform(v, lambda x: (x / by).cast("int")))

    return _let(F.get(F.filter(products(rows), some), F.lit(0)), primitive)


def _mean(m: Column, shift: Column) -> Column:
    """The mean of a translation's images under twelve powers of the matrix, which hold each order a whole number of times."""
    image = lambda v: F.array(*(sum((m[3 * i + j] * v[j] for j in (1, 2)), m[3 * i] * v[0]) for i in range(3)))
    start = F.struct(F.array(*[F.lit(0.0)] * 3).alias("sum"), shift.alias("now"))
    step = lambda s, _: F.struct(F.zip_with(s["sum"], s["now"], lambda x, y: x + y).alias("sum"), image(s["now"]).alias("now"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, step, lambda s: F.transform(s["sum"], lambda x: x / 12))


def elements(df: DataFrame, rotation: list[str], translation: list[str], tolerance: float = 1e-4) -> DataFrame:
    """df with kind, order, axis, intrinsic and label of each row's operation; columns of these names are replaced.

    kind is identity, translation, inversion, rotation, screw, mirror, glide or rotoinversion; order that of its proper part (2 for
    mirrors, 1 for inversions). axis is a primitive whole vector with a positive first number: a rotation's axis or a mirror's normal.
    intrinsic is what no change of origin removes (null where nothing is left). Labels are such as 4, 4_1, m, g, -3, -1.
    The lattice is that of the coordinates: a centred cell's screws and glides count by its whole axes. Null for matrices
    that are no operation of a lattice, or with a missing number.
    """
    m = F.array(*(F.col(c).cast("int") for c in rotation))
    shift = F.array(*(F.col(c).cast("double") for c in translation))
    whole = F.forall(m, lambda x: x.isNotNull()) & F.forall(shift, lambda x: x.isNotNull() & ~F.isnan(x))

    def described(m: Column, det: Column, order: Column, mean: Column, axis: Column) -> Column:
        moved = F.exists(mean, lambda x: F.abs(x - F.round(x)) > tolerance)
        proper = det == 1
        kind = (
            F.when(proper & (order == 1), F.when(moved, "translation").otherwise("identity")).when(proper, F.when(moved, "screw").otherwise("rotation"))
            .when(order == 1, "inversion").when(order == 2, F.when(moved, "glide").otherwise("mirror")).otherwise("rotoinversion")
        )
        # along its axis a screw moves by a share of the axis
        shares = F.zip_with(mean, axis, lambda x, a: F.when(a != 0, x / a))
        part = F.pmod(F.round(F.get(F.filter(shares, lambda x: x.isNotNull()), F.lit(0)) * order).cast("int"), order)
        label = F.when(proper, F.when(order == 1, None).when(moved, F.concat_ws("_", order.cast("string"), part.cast("string"))).otherwise(order.cast("string")))
        label = label.when(order == 2, F.when(moved, "g").otherwise("m")).otherwise(F.concat(F.lit("-"), order.cast("string")))
        intrinsic = F.when(moved & (proper | (order == 2)), F.transform(mean, lambda x: F.when(F.abs(x) <= tolerance, 0.0).otherwise(x)))
        return F.struct(kind.alias("kind"), order.alias("order"), F.when(order > 1, axis).alias("axis"), intrinsic.alias("intrinsic"), label.alias("label"))

    def of(m: Column, det: Column, order: Column) -> Column:
        # the rows of the proper part less the identity; a rotation leaves two of them independent
        less = F.array(*(m[3 * i + j] * det - int(i == j) for i in range(3) for j in range(3)))
        axis = lambda mean: _let(_let(less, _axis), lambda a: described(m, det, order, mean, a))
        return F.when(order.isNotNull(), _let(_mean(m, shift), axis))

    def order(m: Column, det: Column) -> Column:
        trace = (m[0] + m[4] + m[8]) * det
        return F.when(F.abs(det) == 1, reduce(lambda c, t: c.when(trace == t, TRACES[t]), list(TRACES)[1:], F.when(trace == next(iter(TRACES)), TRACES[next(iter(TRACES))])))

    found = _let(m, lambda m: _let(_det(_matrix(m)), lambda det: _let(order(m, det), lambda n: of(m, det, n))))
    df = df.withColumn("_element", F.when(whole, found))
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in ("_element", "kind", "order", "axis", "intrinsic", "label")), "_element.*")
