"""Ordered series: smoothing, cleaning, outliers, gaps, instability, smearing."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N


def centred(series: str, order: list[str], half: int):
    """The window of `half` rows on each side."""
    return Window.partitionBy(series).orderBy(*order).rowsBetween(-half, half)


def moving_average(df: DataFrame, series: str, order: list[str], value: str, window: int, out: str = "smoothed") -> DataFrame:
    """Mean of the finite values within window // 2 rows on each side; without any the value itself."""
    v = N.finite(F.col(value))
    return df.withColumn(out, F.coalesce(F.avg(v).over(centred(series, order, window // 2)), F.col(value)))


def local_variance(df: DataFrame, series: str, order: list[str], value: str, window: int, out: str = "variance") -> DataFrame:
    """Sample variance in the centred window; 0 for a single value."""
    return df.withColumn(out, F.coalesce(F.var_samp(N.finite(F.col(value))).over(centred(series, order, window // 2)), F.lit(0.0)))


def savgol_weights(window: int, degree: int) -> list[float]:
    """Weights of the centre value of a least-squares polynomial over an odd window."""
    if window % 2 == 0 or window < degree + 2:
        raise ValueError("the window must be odd and hold two values more than the degree")
    at = np.arange(window) - window // 2
    return np.linalg.pinv(np.vander(at, degree + 1, increasing=True))[0].tolist()


def savitzky_golay(df: DataFrame, series: str, order: list[str], value: str, window: int, degree: int = 2, out: str = "smoothed") -> DataFrame:
    """Weighted sum over the window, divided by the weights of the finite neighbours that there are."""
    w = Window.partitionBy(series).orderBy(*order)
    total, weight = F.lit(0.0), F.lit(0.0)
    for k, c in enumerate(savgol_weights(window, degree)):
        v = F.lag(N.finite(F.col(value)), window // 2 - k).over(w)
        total = total + F.coalesce(v * c, F.lit(0.0))
        weight = weight + F.when(v.isNotNull(), c).otherwise(0.0)
    return df.withColumn(out, F.when(F.abs(weight) > 1e-12, total / weight).otherwise(F.col(value)))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """What `then` makes of a value that is worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), then), 0)


def _median(values: Column) -> Column:
    """The median of an array of numbers without nulls."""

    def middle(s: Column) -> Column:
        n, at = F.size(s), F.floor(F.size(s) / 2).cast("int")
        return F.when(n % 2 == 1, F.get(s, at)).otherwise((F.get(s, at - 1) + F.get(s, at)) / 2)

    return _once(F.sort_array(values), middle)


def local_outliers(df: DataFrame, series: str, order: list[str], value: str, half: int = 7, threshold: float = 2.0) -> DataFrame:
    """Flag values more than `threshold` median deviations from the median of their 2 * half neighbours.

    The value itself is not among its neighbours; the first and last `half` rows are never flagged, nor is anything
    where the deviation is 0.
    """
    w = Window.partitionBy(series).orderBy(*order)
    near = F.concat(F.collect_list(value).over(w.rowsBetween(-half, -1)), F.collect_list(value).over(w.rowsBetween(1, half)))
    far = lambda x, m, mad: (mad > 0) & (F.abs(x - m) > threshold * mad)
    judged = _once(near, lambda n: _once(_median(n), lambda m: _once(_median(F.transform(n, lambda x: F.abs(x - m))), lambda mad: F.struct(m.alias("median"), mad.alias("mad"), ((F.size(n) == 2 * half) & far(F.col(value), m, mad)).alias("far")))))
    rows = df.withColumn("_judged", judged)
    return rows.withColumns({"median": F.col("_judged.median"), "mad": F.col("_judged.mad"), "is_outlier": F.coalesce("_judged.far", F.lit(False))}).drop("_judged")


def apply_bounds(df: DataFrame, value: str, low: float, high: float, mode: str = "clamp", out: str = "bounded") -> DataFrame:
    """Clamp, null or filter values out of bounds; null and NaN are in bounds."""
    v = F.col(value)
    bad = F.coalesce(((v < low) | (v > high)) & ~F.isnan(v), F.lit(False))
    if mode == "filter":
        return df.where(~bad).withColumn(out, v)
    return df.withColumn(out, F.when(bad, N.clamp(v, low, high) if mode == "clamp" else F.lit(None)).otherwise(v))


def interpolate_gaps(df: DataFrame, series: str, order: list[str], value: str, out: str = "filled") -> DataFrame:
    """Missing values by linear interpolation over the row index; ends hold the nearest value, an empty series is 0.

    The value ahead is the last one in reverse order: a frame that starts at the row and is open at the end is read anew for every row.
    """
    w = Window.partitionBy(series).orderBy(*order)
    back, ahead = (x.rowsBetween(Window.unboundedPreceding, 0) for x in (w, Window.partitionBy(series).orderBy(F.col("_i").desc())))
    v = N.finite(F.col(value))
    rows = df.withColumn("_i", F.row_number().over(w)).withColumn("_v", v).withColumn("_j", F.when(v.isNotNull(), F.col("_i")))
    last = lambda c: F.last(c, True).over(back)
    next_ = lambda c: F.last(c, True).over(ahead)
    rows = rows.withColumns({"_a": last("_v"), "_p": last("_j"), "_b": next_("_v"), "_q": next_("_j")})
    line = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_i") - F.col("_p")) / (F.col("_q") - F.col("_p"))
    filled = F.coalesce("_v", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), line), "_a", "_b", F.lit(0.0))
    return rows.withColumn(out, filled).drop("_i", "_v", "_j", "_a", "_p", "_b", "_q")


def derivative_signs(df: DataFrame, series: str, order: list[str], value: str, window: int) -> DataFrame:
    """step (difference to the row before), whether its sign changed, and the share of changes in the centred window."""
    w = Window.partitionBy(series).orderBy(*order)
    rows = df.withColumn("step", F.col(value) - F.lag(value).over(w))
    before = F.lag("step").over(w)
    rows = rows.withColumn("turned", F.coalesce((F.signum("step") * F.signum(before)) < 0, F.lit(False)))
    return rows.withColumn("turn_share", F.avg(F.col("turned").cast("double")).over(centred(series, order, window // 2)))


def gaussian_smear(df: DataFrame, series: str, x: str, y: str, sigma: float) -> DataFrame:
    """Gaussian kernel over the x distance up to 4 sigma; each value's kernel sums to 1 over the points it reaches.

    A range join: points are dealt into cells of 4 sigma and meet those of the neighbouring cells only.
    """
    size = 4.0 * sigma
    rows = df.groupBy(series, F.col(x).cast("double").alias("x")).agg(F.sum(F.col(y).cast("double")).alias("y")).withColumn("cell", F.floor(F.col("x") / size))
    near = rows.select(series, F.col("x").alias("to"), F.explode(F.array(*[F.col("cell") + k for k in (-1, 0, 1)])).alias("cell"))
    kernel = F.exp(-0.5 * F.pow((F.col("x") - F.col("to")) / sigma, 2))
    pairs = rows.join(near, [series, "cell"]).where(F.abs(F.col("x") - F.col("to")) <= size).withColumn("k", kernel)
    norm = pairs.groupBy(series, "x").agg(F.sum("k").alias("norm"))
    spread = pairs.join(norm, [series, "x"])
    return spread.groupBy(series, F.col("to").alias("x")).agg(F.sum(F.col("y") * F.col("k") / F.col("norm")).alias("smeared"))


def broaden(peaks: DataFrame, x: str, y: str, low: float, high: float, points: int, fwhm: float, eta: float = 0.5) -> DataFrame:
    """grid, x, intensity: area-normalised pseudo-Voigt peaks on an even grid, each up to 20 widths from its centre."""
    step = (high - low) / (points - 1)
    reach = 20 * fwhm
    first = F.greatest(F.ceil((F.col(x) - reach - low) / step), F.lit(0))
    last = F.least(F.floor((F.col(x) + reach - low) / step), F.lit(points - 1))
    spread = peaks.where(last >= first).withColumn("grid", F.explode(F.sequence(first, last)))
    d = (F.col("grid") * step + low - F.col(x)) / fwhm
    gauss = F.exp(-4 * float(np.log(2)) * d * d) * (2 * float(np.sqrt(np.log(2) / np.pi)) / fwhm)
    lorentz = 2 / (float(np.pi) * fwhm) / (1 + 4 * d * d)
    sums = spread.groupBy("grid").agg(F.sum(F.col(y) * (eta * lorentz + (1 - eta) * gauss)).alias("intensity"))
    return sums.select("grid", (F.col("grid") * step + low).alias("x"), "intensity")


def strictly_increasing(df: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """series and whether its values increase from row to row."""
    w = Window.partitionBy(series).orderBy(*order)
    return df.withColumn("_d", F.col(value) - F.lag(value).over(w)).groupBy(series).agg(F.coalesce(F.bool_and(F.col("_d") > 0), F.lit(True)).alias("increasing"))
