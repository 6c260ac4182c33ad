"""The cleaning chain of a series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import series as S


def clean_series(df: DataFrame, series: str, order: list[str], value: str, low: float, high: float, window: int = 5) -> DataFrame:
    """Fill gaps, clamp to bounds, drop local outliers, then smooth; all by series, in this order."""
    rows = S.interpolate_gaps(df, series, order, value, "clean")
    rows = S.apply_bounds(rows, "clean", low, high, "clamp", "clean")
    rows = S.local_outliers(rows, series, order, "clean").where(~F.col("is_outlier")).drop("is_outlier", "median", "mad")
    return S.moving_average(rows, series, order, "clean", window, "clean")
