"""Trajectories: unwrapping, mean squared displacement, diffusion fits, velocity autocorrelation, arc length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N


def unwrap(df: DataFrame, atom: str, frame: str, x: str, length: float, out: str = "unwrapped") -> DataFrame:
    """Positions with periodic jumps removed: minimum-image steps summed up from the first frame."""
    w = Window.partitionBy(atom).orderBy(frame)
    step = F.coalesce(N.min_image(F.col(x) - F.lag(x).over(w), length), F.lit(0.0))
    rows = df.withColumn("_step", step)
    total = F.first(x).over(w) + F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(out, total).drop("_step")


def msd(df: DataFrame, atom: str, frame: str, x: str, lags: list[int]) -> DataFrame:
    """lag, n_origins, msd, se: squared displacements, averaged over atoms for each origin, then over origins.

    Each row meets one partner a lag by an equi-join on atom and frame.
    """
    rows = df.select(F.col(atom).alias("atom"), F.col(frame).alias("frame"), F.col(x).cast("double").alias("x"))
    starts = rows.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("to", F.col("frame") + F.col("lag"))
    ends = rows.select("atom", F.col("frame").alias("to"), F.col("x").alias("y"))
    pairs = starts.join(ends, ["atom", "to"])
    origins = pairs.groupBy("lag", "frame").agg(F.avg((F.col("y") - F.col("x")) ** 2).alias("m"))
    se = F.stddev_samp("m") / F.sqrt(F.count("*").cast("double"))
    return origins.groupBy("lag").agg(F.count("*").alias("n_origins"), F.avg("m").alias("msd"), F.coalesce(se, F.lit(0.0)).alias("se"))


def einstein_fit(curve: DataFrame, x: str = "lag", y: str = "msd", low: float = 0.2, high: float = 0.8, dimensions: int = 1) -> DataFrame:
    """One row: slope, intercept, r2 and diffusion of a line over the middle of the lags; a flat curve has r2 = 1."""
    most = curve.agg(F.max(x).alias("most"))
    part = curve.crossJoin(F.broadcast(most)).where(F.col(x).between(low * F.col("most"), high * F.col("most")))  # one row
    fit = part.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.coalesce(F.regr_r2(y, x), F.lit(1.0)).alias("r2"))
    return fit.withColumn("diffusion", F.col("slope") / (2 * dimensions))


def velocities(df: DataFrame, atom: str, frame: str, x: str, dt: float = 1.0) -> DataFrame:
    """Central differences; the first and last frame of an atom have none."""
    w = Window.partitionBy(atom).orderBy(frame)
    v = (F.lead(x).over(w) - F.lag(x).over(w)) / (2 * dt)
    return df.select(atom, frame, v.alias("v")).where(F.col("v").isNotNull())


def vacf(vel: DataFrame, atom: str, frame: str, lags: list[int]) -> DataFrame:
    """lag, vacf, normalized: products of velocities, averaged over atoms, then origins; normalised by lag 0."""
    rows = vel.select(F.col(atom).alias("atom"), F.col(frame).alias("frame"), "v")
    starts = rows.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("to", F.col("frame") + F.col("lag"))
    pairs = starts.join(rows.select("atom", F.col("frame").alias("to"), F.col("v").alias("u")), ["atom", "to"])
    origins = pairs.groupBy("lag", "frame").agg(F.avg(F.col("u") * F.col("v")).alias("m"))
    curve = origins.groupBy("lag").agg(F.avg("m").alias("vacf"))
    zero = F.max(F.when(F.col("lag") == 0, F.col("vacf"))).over(Window.partitionBy(F.lit(0)))  # one row a lag
    return curve.withColumn("normalized", F.when(zero != 0, F.col("vacf") / zero).otherwise(0.0))


def arc_length(df: DataFrame, path: str, image: str, coords: list[str]) -> DataFrame:
    """path, image, length: cumulative distance between consecutive images."""
    w = Window.partitionBy(path).orderBy(image)
    step = N.distance([F.col(c) for c in coords], [F.lag(c).over(w) for c in coords])
    rows = df.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    return rows.withColumn("length", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def barrier(df: DataFrame, path: str, image: str, energy: str) -> DataFrame:
    """path, top image, forward and reverse barrier, reaction energy."""
    top = F.max_by(F.struct(F.col(image).alias("i"), F.col(energy).alias("e")), F.struct(F.col(energy), -F.col(image)))
    out = df.groupBy(path).agg(top.alias("top"), F.min_by(energy, image).alias("first"), F.max_by(energy, image).alias("last"))
    return out.select(path, F.col("top.i").alias("top_image"), (F.col("top.e") - F.col("first")).alias("forward"), (F.col("top.e") - F.col("last")).alias("reverse"), (F.col("last") - F.col("first")).alias("reaction"))
