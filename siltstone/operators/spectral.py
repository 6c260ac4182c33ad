"""Spectra: windows, periodograms, unit conversion, Fermi shifts, intensities."""

from __future__ import annotations

from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..joins import join_groups, numbered
from ..storage import cut
from .transform import BLOCK, padded, transform, with_lengths

#: Frequency units by THz.
PER_THZ = {"THz": 1.0, "eV": 4.135667696e-3, "meV": 4.135667696, "Ha": 1.519829846e-4, "cm-1": 33.35640952}


def convert_frequency(c: Column, unit: str) -> Column:
    """THz in another unit."""
    return c * PER_THZ[unit]


def window(position: Column, length: Column, kind: str = "hann") -> Column:
    """The weight of a position in a full window of a length: hann, gaussian (deviation of a sixth of the span) or none."""
    distance = F.abs(2 * position - (length - 1)) / (length - 1)
    if kind == "none":
        return F.lit(1.0)
    weight = 0.5 * (1 + F.cos(F.lit(pi) * distance)) if kind == "hann" else F.exp(-4.5 * distance * distance)
    return F.when(length > 1, weight).otherwise(1.0)


def window_energy(length: Column, kind: str = "hann") -> Column:
    """The sum of the squared weights of a window."""
    if kind == "none":
        return length.cast("double")
    if kind == "hann":
        return F.when(length > 3, 0.375 * (length - 1)).when(length == 2, 0.0).otherwise(1.0)

    @F.pandas_udf("double")
    def energy(lengths: pd.Series) -> pd.Series:
        def one(n: int) -> float:
            starts = range(0, n, 1 << 20)
            return float(sum(np.exp(-9.0 * ((2 * np.arange(s, min(s + (1 << 20), n)) - (n - 1)) / max(n - 1, 1)) ** 2).sum() for s in starts))

        known = {n: one(int(n)) if n > 1 else 1.0 for n in lengths.unique()}
        return lengths.map(known)

    return energy(length)


def power_spectrum(rows: DataFrame, group: str, component: str, position: str, value: str, step: float, kind: str = "hann", padding: float = 4.0, weight: str | None = None, block: int = BLOCK) -> DataFrame:
    """group, bin, frequency, power: one-sided spectra of the components of each group, added up by weight.

    Each component loses its mean, is multiplied by the window of its group's length and padded to a power of two; the squared
    transform times the step by the window's energy is the power, twice that between the ends. Positions count from 0; one
    without a sample, or with a null or infinite value, counts as the mean. `weight` is a column that is the same in all rows of
    a component (null counts as 0). A group of one position has no spectrum, one whose window has no energy (hann, two
    positions) a null power. Series of any length are dealt over tasks (see `transform`).
    """
    series, samples = with_lengths(rows, group, component, position, value)
    if weight is not None:
        weights = rows.groupBy(group, component).agg(F.first(F.coalesce(F.col(weight).cast("double"), F.lit(0.0))).alias("_weight"))
        series = series.join(weights, [group, component])
    else:
        series = series.withColumn("_weight", F.lit(1.0))
    length = F.col("_length")
    scale = F.sqrt(F.try_divide(F.col("_weight") * step, window_energy(length, kind)))
    series = cut(series.where(length > 1).select("_series", group, "_rows", "_mean", "_length", scale.alias("_scale"), padded(length, padding).alias("size")))
    facts = series.agg(F.max("size"), F.sum("_rows"), F.sum("size")).first()
    if facts[0] is None:
        return series.select(group, F.lit(0).cast("long").alias("bin"), F.col("_mean").alias("frequency"), F.col("_mean").alias("power")).where("false")
    joined = join_groups(samples.select("_series", "position", "value"), series, "_series", "_rows", facts[1], keep=lambda x: x)
    real = F.coalesce(F.col("value") - F.col("_mean"), F.lit(0.0)) * window(F.col("position"), length, kind) * F.col("_scale")
    found = transform(joined.select("_series", group, "position", real.alias("re"), F.lit(0.0).alias("im"), "size"), ["_series", group], facts[0], facts[2], block=block)
    sides = F.when((F.col("bin") == 0) | (F.col("bin") * 2 == F.col("size")), 1.0).otherwise(2.0)
    power = F.when(~F.isnan("re"), sides * (F.col("re") * F.col("re") + F.col("im") * F.col("im")))
    summed = found.select(group, "size", "bin", power.alias("power")).groupBy(group, "size", "bin").agg(F.sum("power").alias("power"))
    return summed.select(group, "bin", (F.col("bin") / (F.col("size") * F.lit(float(step)))).alias("frequency"), "power")


def periodogram(df: DataFrame, series: str, order: list[str], value: str, step: float, kind: str = "hann", padding: float = 4.0, block: int = BLOCK) -> DataFrame:
    """series, bin, frequency, power of one value by its order in each series: `power_spectrum` of a single component."""
    ranked = numbered(df.where(F.col(series).isNotNull()).select(series, *order, *([] if value in order else [value])), series, order, "position")
    return power_spectrum(ranked.withColumn("component", F.lit(0)), series, "component", "position", value, step, kind, padding, block=block)


def fourier_power(df: DataFrame, series: str, position: str, value: str, frequencies: list[float]) -> DataFrame:
    """series, frequency, power at stated frequencies: sums of cosines and sines, combined before the shuffle."""
    f = F.explode(F.array(*map(F.lit, frequencies)))
    rows = df.select(series, F.col(position).alias("t"), F.col(value).alias("v"), f.alias("frequency"))
    phase = 2 * float(np.pi) * F.col("frequency") * F.col("t")
    sums = rows.groupBy(series, "frequency").agg(F.sum(F.col("v") * F.cos(phase)).alias("re"), F.sum(F.col("v") * F.sin(phase)).alias("im"), F.count("*").alias("n"))
    return sums.select(series, "frequency", ((F.col("re") ** 2 + F.col("im") ** 2) / F.col("n")).alias("power"))


def shift_to_fermi(df: DataFrame, energy: str, fermi: str) -> DataFrame:
    return df.withColumn(energy, F.col(energy) - F.col(fermi))


def infrared_intensity(df: DataFrame, mode: str, mass: str = "mass") -> DataFrame:
    """mode, intensity: |sum over atoms of Z* e / sqrt(m)|^2, with charges z11 .. z33 and displacements ex, ey, ez."""
    parts = [F.sum(sum((F.col(f"z{a}{b}") * F.col(f"e{c}") for b, c in enumerate("xyz", 1)), F.lit(0.0)) / F.sqrt(mass)).alias(f"d{a}") for a in (1, 2, 3)]
    return df.groupBy(mode).agg(*parts).select(mode, (F.col("d1") ** 2 + F.col("d2") ** 2 + F.col("d3") ** 2).alias("intensity"))


def raman_activity(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> Column:
    """45 a^2 + 7 g^2 of a symmetric tensor."""
    a = (xx + yy + zz) / 3
    g2 = ((xx - yy) ** 2 + (yy - zz) ** 2 + (zz - xx) ** 2) / 2 + 3 * (xy**2 + xz**2 + yz**2)
    return 45 * a**2 + 7 * g2
