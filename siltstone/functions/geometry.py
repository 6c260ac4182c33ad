"""Planar and simplex geometry, wavelengths and widths as column expressions."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Planck's constant, the electron's mass and charge, and the speed of light, in SI units.
PLANCK, MASS, CHARGE, LIGHT = 6.62607015e-34, 9.1093837015e-31, 1.602176634e-19, 299792458.0


def electron_wavelength(kilovolts: Column) -> Column:
    """The relativistic wavelength in Angstrom of electrons of this voltage; null at 0 and below."""
    energy = kilovolts * (1000 * CHARGE)
    momentum = F.sqrt(energy * (2 * MASS) * (1 + energy / (2 * MASS * LIGHT**2)))
    return F.when(kilovolts > 0, 1e10 * PLANCK / momentum)


def caglioti_width(two_theta: Column, u: float, v: float, w: float) -> Column:
    """The full width at half maximum at a scattering angle in degrees; 0 where its square is negative, null without an angle."""
    t = F.tan(F.radians(two_theta / 2))
    square = u * t * t + v * t + w
    return F.when(square > 0, F.sqrt(square)).when(square.isNotNull(), 0.0)


def simplex_place(shares: list[Column]) -> list[Column]:
    """Planar (three shares) or spatial (four) coordinates of a composition in a unit triangle or tetrahedron."""
    total = sum(shares[1:], shares[0])
    b, c = shares[1] / total, shares[2] / total
    if len(shares) == 3:
        return [b + c / 2, c * (sqrt(3) / 2)]
    d = shares[3] / total
    return [b + (c + d) / 2, c * (sqrt(3) / 2) + d * (sqrt(3) / 6), d * sqrt(2 / 3)]


def clip_segment(x0: Column, y0: Column, x1: Column, y1: Column, low: tuple[float, float], high: tuple[float, float]) -> Column:
    """The part of a segment within a rectangle as a struct (ax, ay, bx, by), null where none is."""
    dx, dy = x1 - x0, y1 - y0
    first, last, outside = F.lit(0.0), F.lit(1.0), F.lit(False)
    for p, q in ((-dx, x0 - low[0]), (dx, high[0] - x0), (-dy, y0 - low[1]), (dy, high[1] - y0)):
        outside = outside | ((p == 0) & (q < 0))
        first = F.greatest(first, F.when(p < 0, q / p).otherwise(0.0))
        last = F.least(last, F.when(p > 0, q / p).otherwise(1.0))
    ends = F.struct((x0 + first * dx).alias("ax"), (y0 + first * dy).alias("ay"), (x0 + last * dx).alias("bx"), (y0 + last * dy).alias("by"))
    return F.when(~outside & (first <= last), ends)
