"""Discrete Fourier transforms of series of any length, dealt over tasks, and correlations by way of spectra."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..joins import join_groups
from ..storage import cut

#: A task transforms no more than about so many values at once; longer series are transformed in parts.
BLOCK = 1 << 20


def _sides(size: int, block: int) -> tuple[int, int]:
    """m, l with m * l = size: a short series is one column of l values, a long one m columns."""
    m = 1 if size <= block else 1 << ((size.bit_length()) // 2)
    return m, size // m


def _columns(keys: list[str], block: int, half: bool):
    """First step: transforms of the columns (values m apart), times the twiddle factors, cut into tiles for the second step."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, job in pdf.groupby([*keys, "_strip"], sort=False):
            size = int(job["size"].iloc[0])
            m, length = _sides(size, block)
            wide = min(m, max(1, block // length))
            strip = int(job["_strip"].iloc[0])
            at = job["position"].to_numpy(np.int64)
            values = np.zeros((length, wide), complex)
            np.add.at(values, (at // m, at % m - strip * wide), job["re"].to_numpy(float) + 1j * job["im"].to_numpy(float))
            found = np.fft.fft(values, axis=0)
            head = {k: job[k].iloc[0] for k in keys} | {"size": size, "_strip": strip}
            if m == 1:
                found = found[: size // 2 + 1 if half else size, 0]
                out.append(head | {"_tile": 0, "re": found.real, "im": found.imag})
                continue
            column = strip * wide + np.arange(wide)
            found *= np.exp(-2j * np.pi * (np.outer(np.arange(length), column) % size) / size)
            tall = max(1, block // m)
            for tile in range(-(-length // tall)):
                part = found[tile * tall : (tile + 1) * tall].ravel()
                out.append(head | {"_tile": tile, "re": part.real, "im": part.imag})
        return pd.DataFrame(out, columns=[*keys, "size", "_strip", "_tile", "re", "im"])

    return run


def _rows(keys: list[str], block: int, half: bool):
    """Second step: transforms of the rows of one tile each, along all columns."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, job in pdf.groupby([*keys, "_tile"], sort=False):
            size, tile = int(job["size"].iloc[0]), int(job["_tile"].iloc[0])
            m, length = _sides(size, block)
            job = job.sort_values("_strip")
            tall = min(max(1, block // m), length - tile * max(1, block // m))
            parts = [(np.asarray(a) + 1j * np.asarray(b)).reshape(tall, -1) for a, b in zip(job["re"], job["im"], strict=True)]
            strips = dict(zip(job["_strip"], parts, strict=True))
            # strips without a sample have no tile
            wide = min(m, max(1, block // length))
            empty = np.zeros((tall, wide), complex)
            found = np.fft.fft(np.hstack([strips.get(s, empty) for s in range(m // wide)]), axis=1)
            first = tile * max(1, block // m) + np.arange(tall)
            at = (first[:, None] + length * np.arange(m)[None, :]).ravel()
            found = found.ravel()
            if half:
                kept = at <= size // 2
                at, found = at[kept], found[kept]
            out.append(pd.DataFrame({k: job[k].iloc[0] for k in keys} | {"size": size, "bin": at, "re": found.real, "im": found.imag}, columns=[*keys, "size", "bin", "re", "im"]))
        return pd.concat(out)

    return run


def transform(rows: DataFrame, keys: list[str], largest: int, total: int, half: bool = True, block: int = BLOCK) -> DataFrame:
    """keys, size, bin, re, im: sum over positions of (re + i im) exp(-2 pi i position bin / size), a series for each key.

    `rows` has the keys (none of them null), position from 0 to size - 1, re, im, and size, a power of two and the same for all
    rows of a key; positions without a row count as 0. With `half` the bins go up to size / 2 only. `largest` is the largest
    size, `total` about the number of values in all. A series of up to `block` values is transformed in one task, together with
    others; a longer one is seen as a matrix: its columns are transformed strip by strip, multiplied by the twiddle factors, and
    its rows tile by tile, so each task holds about `block` values, and two shuffles carry each value once.
    """
    types = dict(rows.dtypes)
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)
    parts = max(1, -(-total // block))
    long = F.col("size") > block
    # sizes are powers of two, so their sides follow from the exponent
    exponent = F.round(F.log2(F.col("size").cast("double"))).cast("int")
    m = F.when(long, F.pow(F.lit(2.0), F.floor((exponent + 1) / 2))).otherwise(F.lit(1.0)).cast("long")
    wide = F.least(m, F.greatest(F.lit(1).cast("long"), F.floor(F.lit(block) * m / F.col("size")).cast("long")))
    strip = F.floor((F.col("position") % m) / wide).cast("long")
    deal = F.pmod(F.xxhash64(*keys, "_strip"), F.lit(parts))
    dealt = rows.select(*keys, F.col("position").cast("long").alias("position"), "re", "im", F.col("size").cast("long").alias("size"), strip.alias("_strip")).withColumn("_deal", deal)
    tiles = dealt.groupBy("_deal").applyInPandas(lambda pdf: _columns(keys, block, half)(pdf), f"{head}, size long, _strip long, _tile long, re array<double>, im array<double>")
    if largest > block:
        tiles = cut(tiles)
    listed = F.inline(F.arrays_zip(F.transform(F.sequence(F.lit(0), F.size("re") - 1), lambda k: k.cast("long")).alias("bin"), F.col("re"), F.col("im")))
    found = tiles.where(~long).select(*keys, "size", listed).toDF(*keys, "size", "bin", "re", "im")
    if largest <= block:
        return found
    again = tiles.where(long).withColumn("_deal", F.pmod(F.xxhash64(*keys, "_tile"), F.lit(parts)))
    return found.unionByName(again.groupBy("_deal").applyInPandas(lambda pdf: _rows(keys, block, half)(pdf), f"{head}, size long, bin long, re double, im double"))


def padded(length, factor: float = 1.0):
    """The least power of two that is no less than `factor` times a length (a column)."""
    least = F.greatest(F.ceil(length * F.lit(float(factor))), F.lit(1)).cast("long")
    # doubles are exact here: the length of an integer's binary form
    return F.pow(F.lit(2.0), F.length(F.bin(least - 1)) - F.when(least == 1, 1).otherwise(0)).cast("long")


def with_lengths(rows: DataFrame, group: str, component: str, position: str, value: str) -> tuple[DataFrame, DataFrame]:
    """The components (`_series`, group, component, rows, mean, components and length of its group) and the rows with their `_series`.

    A group is as long as its last position says, and all its components are. Rows with a null group, component, position or a
    position below 0 are left out; a null or infinite value counts as no sample.
    """
    v = F.col(value).cast("double")
    known = rows.where(F.col(group).isNotNull() & F.col(component).isNotNull() & (F.col(position) >= 0))
    known = known.select(F.col(group), F.col(component), F.col(position).cast("long").alias("position"), F.when(F.abs(v) < float("inf"), v).alias("value"))
    series = known.groupBy(group, component).agg(F.count("*").alias("_rows"), F.avg("value").alias("_mean"), F.max("position").alias("_last"))
    groups = series.groupBy(group).agg(F.count("*").alias("_components"), (F.max("_last") + 1).alias("_length"))
    joined = join_groups(series, groups, group, "_components")
    name = F.to_json(F.struct(F.col(group).alias("g"), F.col(component).alias("c")))
    return joined.withColumn("_series", name), known.withColumn("_series", name)


def autocorrelation(rows: DataFrame, group: str, component: str, position: str, value: str, most: int | None = None, block: int = BLOCK) -> DataFrame:
    """group, lag, value: products of values `lag` positions apart, averaged over positions and the group's components.

    Positions count from 0 without gaps. Each series is padded to at least twice its length and transformed, the squares are
    summed over the components of a group, and one transform back gives all lags at once (those up to `most`, if given).
    """
    series, samples = with_lengths(rows, group, component, position, value)
    series = cut(series.withColumn("size", padded(F.col("_length"), 2.0)))
    facts = series.agg(F.max("size"), F.sum("_rows"), F.sum("size")).first()
    if facts[0] is None:
        return samples.select(group, F.lit(0).cast("long").alias("lag"), "value").where("false")
    joined = join_groups(samples.select("_series", "position", "value"), series.select("_series", group, "size", "_rows"), "_series", "_rows", facts[1], keep=lambda x: x)
    inputs = joined.select("_series", group, "position", F.coalesce("value", F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"), "size")
    spectra = transform(inputs, ["_series", group], facts[0], facts[2], block=block)
    power = spectra.groupBy(group, "size", "bin").agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("re"))
    # the spectrum is even, so its other half is the mirror image
    inner = (F.col("bin") > 0) & (F.col("bin") * 2 < F.col("size"))
    places = F.explode(F.when(inner, F.array("bin", F.col("size") - F.col("bin"))).otherwise(F.array("bin")))
    whole = power.select(group, "size", places.alias("position"), "re", F.lit(0.0).alias("im"))
    back = transform(whole, [group], facts[0], facts[2], block=block)
    groups = series.groupBy(group).agg(F.first("_components").alias("_components"), F.first("_length").alias("_length"))
    lags = back.where(F.col("bin") <= most) if most is not None else back
    found = join_groups(lags.select(group, F.col("bin").alias("lag"), "re", "size"), groups, group, "_length")
    count = (F.col("_length") - F.col("lag")) * F.col("_components")
    return found.where(F.col("lag") < F.col("_length")).select(group, "lag", (F.col("re") / F.col("size") / count).alias("value"))
