"""Scalar grids as rows (i, j, k, value): ranges, block averages, sampling, slices, surface levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N

IJK = ("i", "j", "k")


def data_range(grid: DataFrame, key: str) -> DataFrame:
    """key, low, high, largest magnitude, mean of the finite values."""
    v = N.finite(F.col("value"))
    return grid.groupBy(key).agg(F.min(v).alias("low"), F.max(v).alias("high"), F.max(F.abs(v)).alias("abs_max"), F.avg(v).alias("mean"))


def downsample(grid: DataFrame, key: str, dims: tuple[int, int, int], out: tuple[int, int, int]) -> DataFrame:
    """Block averages: index i of n goes to block floor(i * m / n), so that no block is empty."""
    place = [F.floor(F.col(c) * m / n).cast("long").alias(c) for c, n, m in zip(IJK, dims, out, strict=True)]
    return grid.select(key, *place, "value").groupBy(key, *IJK).agg(F.avg("value").alias("value"))


def sample(grid: DataFrame, points: DataFrame, key: str, point: str, dims: tuple[int, int, int], periodic: bool = True) -> DataFrame:
    """key, point, value: trilinear interpolation at fractional u, v, w. Each point is joined to its eight corners."""
    spread = points
    for c, u, n in zip(IJK, "uvw", dims, strict=True):
        at = (F.col(u) - F.floor(F.col(u))) * n if periodic else N.clamp(F.col(u), 0.0, 1.0) * (n - 1)
        low = F.floor(at) if periodic else F.least(F.floor(at), F.lit(n - 2))
        corner = lambda k, low=low, at=at, n=n: F.struct(F.pmod(low + k, F.lit(n)).cast("long").alias("i"), (F.abs(1 - k - (at - low))).alias("w"))
        spread = spread.withColumn(f"_{c}", F.explode(F.array(corner(0), corner(1))))
    corners = spread.select(key, point, *[F.col(f"_{c}.i").alias(c) for c in IJK], (F.col("_i.w") * F.col("_j.w") * F.col("_k.w")).alias("weight"))
    return corners.join(grid, [key, *IJK]).groupBy(key, point).agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def plane(grid: DataFrame, axis: str, index: int) -> DataFrame:
    """The grid points of one plane."""
    return grid.where(F.col(axis) == index)


def surface_levels(ranges: DataFrame, key: str, layers: int = 1) -> DataFrame:
    """key, layer, level: 20 % of the largest magnitude, or several levels from 80 % down to 10 %."""
    shares: Column = F.array(*[F.lit(0.2 if layers == 1 else 0.8 - 0.7 * k / (layers - 1)) for k in range(layers)])
    return ranges.select(key, "abs_max", F.posexplode(shares).alias("layer", "share")).select(key, "layer", (F.col("abs_max") * F.col("share")).alias("level"))
