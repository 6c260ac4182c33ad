"""Statistics: column summaries, histograms, boxes, densities, distributions, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import joins
from ..functions import numeric as N
from . import table


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, min, q05, median, mean, q95, max over the finite values; quantiles interpolate linearly.

    The columns become rows, and all statistics are aggregates by column; quantiles come from counts of equal values.
    """
    rows = table.unpivot(df.select(columns), [], columns).withColumn("value", N.finite(F.col("value")))
    base = rows.groupBy("key").agg(F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))
    out = base.join(joins.quantiles(rows, "key", "value", [0.05, 0.5, 0.95]), "key", "left")  # one row a column
    return out.select(F.col("key").alias("column"), "n", "min", F.col("q0").alias("q05"), F.col("q1").alias("median"), "mean", F.col("q2").alias("q95"), "max")


def color_domains(df: DataFrame, column: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """mode, low, high of the minmax, diverging (symmetric) and quantile domains; null without any finite value."""
    rows = df.select(F.lit(0).alias("all"), N.finite(F.col(column).cast("double")).alias("v"))
    ends = rows.groupBy("all").agg(F.min("v").alias("a"), F.max("v").alias("b")).withColumn("m", F.greatest(F.abs("a"), F.abs("b")))
    one = ends.join(joins.quantiles(rows, "all", "v", [low, high]), "all", "left")
    domain = lambda name, a, b: F.struct(F.lit(name).alias("mode"), a.alias("low"), b.alias("high"))
    modes = F.array(domain("minmax", F.col("a"), F.col("b")), domain("diverging", -F.col("m"), F.col("m")), domain("quantile", F.col("q0"), F.col("q1")))
    return one.select(F.explode(modes).alias("x")).select("x.*")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int, scale: str = "linear", normalize: str = "count") -> DataFrame:
    """bin, x0, x1, count and value of equal bins in linear, log or arcsinh space.

    Bins hold [x0, x1), the last one also its end; values outside and non-finite ones are dropped; empty bins are kept.
    `normalize`: count, probability (share) or density (share by width).
    """
    a, b = (N.to_scale(F.lit(float(x)), scale) for x in (low, high))
    v = F.col(column).cast("double")
    place = F.floor((N.to_scale(v, scale) - a) / (b - a) * bins).cast("long")
    inside = df.where(N.finite(v).isNotNull() & v.between(low, high)).select(F.least(place, F.lit(bins - 1)).cast("long").alias("bin"))
    counts = inside.groupBy("bin").agg(F.count("*").alias("count"))
    edge = lambda k: N.from_scale(a + (b - a) * k / bins, scale)
    spark = df.sparkSession
    full = spark.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    full = full.withColumn("x0", edge(F.col("bin"))).withColumn("x1", edge(F.col("bin") + 1))
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))  # one row a bin
    share = F.when(total > 0, F.col("count") / total).otherwise(0.0)
    value = {"count": F.col("count").cast("double"), "probability": share, "density": share / (F.col("x1") - F.col("x0"))}[normalize]
    return full.withColumn("value", value).select("bin", "x0", "x1", "count", "value")


def box_stats(df: DataFrame, group: str, column: str, mode: str = "tukey", reach: float = 1.5) -> DataFrame:
    """group, q1, median, q3, low, high, n_outliers. Whiskers: tukey, minmax, percentile (5 to 95) or std (one sample sd)."""
    v = F.col(column).cast("double")
    rows = df.where(N.finite(v).isNotNull()).select(group, v.alias("v"))
    base = rows.groupBy(group).agg(F.count("v").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    base = base.join(joins.quantiles(rows, group, "v", [0.25, 0.5, 0.75, 0.05, 0.95]), group)  # one row a group on both sides
    q1, q3 = F.col("q0"), F.col("q2")
    limits = {
        "tukey": (q1 - reach * (q3 - q1), q3 + reach * (q3 - q1)),
        "minmax": (F.col("a"), F.col("b")),
        "percentile": (F.col("q3"), F.col("q4")),
        "std": (F.greatest(F.col("a"), F.col("m") - F.coalesce("s", F.lit(0.0))), F.least(F.col("b"), F.col("m") + F.coalesce("s", F.lit(0.0)))),
    }[mode]
    base = base.select(group, "n", q1.alias("q1"), F.col("q1").alias("median"), q3.alias("q3"), limits[0].alias("from"), limits[1].alias("to"))
    joined = joins.join_groups(rows, base, group, "n")
    inside = F.col("v").between(F.col("from"), F.col("to"))
    low = F.min(F.when(inside, F.col("v"))) if mode == "tukey" else F.first("from")
    high = F.max(F.when(inside, F.col("v"))) if mode == "tukey" else F.first("to")
    return joined.groupBy(group).agg(F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"), low.alias("low"), high.alias("high"), F.count_if((F.col("v") < F.col("from")) | (F.col("v") > F.col("to"))).alias("n_outliers"))


def silverman(df: DataFrame, group: str, column: str) -> DataFrame:
    """group, n, low, high, bandwidth = 0.9 min(sd, IQR / 1.34) n^(-1/5); the sd where the IQR is 0, and 1 where both are."""
    v = F.col(column).cast("double")
    rows = df.where(N.finite(v).isNotNull()).select(group, v.alias("v"))
    base = rows.groupBy(group).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.stddev_samp("v").alias("s"))
    base = base.join(joins.quantiles(rows, group, "v", [0.25, 0.75]), group)  # one row a group on both sides
    iqr = (F.col("q1") - F.col("q0")) / 1.34
    spread = F.when(iqr > 0, F.least("s", iqr)).otherwise(F.col("s"))
    width = F.when((F.col("n") < 2) | (spread <= 0), 1.0).otherwise(0.9 * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    return base.select(group, "n", "low", "high", width.alias("bandwidth"))


def kde(df: DataFrame, group: str, column: str, points: int = 32, cut: float = 3.0) -> DataFrame:
    """group, point, x, density on an even grid that reaches `cut` bandwidths beyond the data.

    Equal values are counted first; each then adds to `points` sums of its group, which are combined before the shuffle.
    """
    base = silverman(df, group, column)
    v = F.col(column).cast("double")
    rows = df.where(N.finite(v).isNotNull()).groupBy(group, v.alias("v")).agg(F.count("*").alias("times"))
    rows = joins.join_groups(rows, base, group, "n")
    start, stop = F.col("low") - cut * F.col("bandwidth"), F.col("high") + cut * F.col("bandwidth")
    at = [start + (stop - start) * k / (points - 1) for k in range(points)]
    z = [(x - F.col("v")) / F.col("bandwidth") for x in at]
    norm = F.col("n") * F.col("bandwidth") * 2.5066282746310002
    sums = [F.sum(F.col("times") * F.exp(-0.5 * k * k) / norm).alias(f"d{i}") for i, k in enumerate(z)]
    wide = rows.groupBy(group).agg(*[F.first(c).alias(c) for c in ("low", "high", "bandwidth")], *sums)
    grid = F.array(*[F.struct(F.lit(i).alias("point"), x.alias("x"), F.col(f"d{i}").alias("density")) for i, x in enumerate(at)])
    return wide.select(group, F.explode(grid).alias("g")).select(group, "g.*")


def ecdf(df: DataFrame, group: str, column: str, weight: str | None = None) -> DataFrame:
    """group, value, cumulative: the weighted distribution; negative and non-finite weights are dropped.

    Ties are summed first, and the distinct values of a group are dealt over tasks by range.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(group, F.col(column).cast("double").alias("value"), w.alias("w"))
    rows = rows.where(N.finite(F.col("value")).isNotNull() & N.finite(F.col("w")).isNotNull() & (F.col("w") >= 0))
    sums = rows.groupBy(group, "value").agg(F.sum("w").alias("w"))
    totals = sums.groupBy(group).agg(F.sum("w").alias("whole"), F.count("*").alias("n"))
    known = joins.join_groups(joins.below(sums, group, "value", "w"), totals, group, "n")
    return known.select(group, "value", ((F.col("below") + F.col("w")) / F.col("whole")).alias("cumulative"))


def density_2d(df: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float], x_bins: int, y_bins: int, first: Column) -> DataFrame:
    """xb, yb, count and the smallest `first` of each non-empty cell; values at the upper ends belong to the last cells."""
    place = lambda c, r, n: F.least(F.floor((F.col(c) - r[0]) / (r[1] - r[0]) * n), F.lit(n - 1)).cast("long")
    rows = df.where(F.col(x).between(*x_range) & F.col(y).between(*y_range))
    return rows.groupBy(place(x, x_range, x_bins).alias("xb"), place(y, y_range, y_bins).alias("yb")).agg(F.count("*").alias("count"), F.min(first).alias("first_point"))


def marginal(df: DataFrame, position: str, weight: str, low: float, width: float) -> DataFrame:
    """bin and weight sums of a weighted marginal histogram."""
    rows = df.where((F.col(weight) >= 0) & N.finite(F.col(position).cast("double")).isNotNull())
    return rows.groupBy(F.floor((F.col(position) - low) / width).cast("long").alias("bin")).agg(F.sum(weight).alias("weight"), F.count("*").alias("n"))


def extents(df: DataFrame, group: str, columns: list[str], padding: float = 0.05) -> DataFrame:
    """Finite extent of all columns together by group, padded by a share of its length."""
    v = [N.finite(F.col(c).cast("double")) for c in columns]
    low = F.least(*map(F.min, v)) if len(v) > 1 else F.min(v[0])
    high = F.greatest(*map(F.max, v)) if len(v) > 1 else F.max(v[0])
    base = df.groupBy(group).agg(low.alias("a"), high.alias("b"))
    return base.select(group, (F.col("a") - padding * (F.col("b") - F.col("a"))).alias("low"), (F.col("b") + padding * (F.col("b") - F.col("a"))).alias("high"))


def facet_ranges(df: DataFrame, facet: str, row: str, column: str) -> DataFrame:
    """facet, own range, the range shared with its row, and the range shared by all."""
    own = df.groupBy(row, facet).agg(F.min(column).alias("low"), F.max(column).alias("high"))
    by_row, all_rows = Window.partitionBy(row), Window.partitionBy(F.lit(0))  # over one row a facet
    return own.select(facet, row, "low", "high", F.min("low").over(by_row).alias("row_low"), F.max("high").over(by_row).alias("row_high"), F.min("low").over(all_rows).alias("all_low"), F.max("high").over(all_rows).alias("all_high"))


def stacked_offsets(df: DataFrame, x: str, series: str, value: str) -> DataFrame:
    """x, series, value, offset: running total of the same sign at x before this series."""
    w = Window.partitionBy(x, F.col(value) >= 0).orderBy(series).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(value).over(w), F.lit(0.0))).select(x, series, value, "offset")


def stacked_ranges(df: DataFrame, x: str, value: str) -> DataFrame:
    """One row: the range of positive and negative stacks, with 0 inside."""
    v = F.col(value)
    sums = df.groupBy(x).agg(F.sum(F.when(v >= 0, v).otherwise(0.0)).alias("up"), F.sum(F.when(v < 0, v).otherwise(0.0)).alias("down"))
    return sums.agg(F.least(F.min("down"), F.lit(0.0)).alias("low"), F.greatest(F.max("up"), F.lit(0.0)).alias("high"))


def plottable(df: DataFrame, columns: list[str], least: float = 1e-6) -> DataFrame:
    """key, n, cv, keep: properties with at least two values and some variation are kept."""
    rows = table.unpivot(df.select(columns), [], columns).withColumn("value", N.finite(F.col("value")))
    out = rows.groupBy("key").agg(F.count("value").alias("n"), N.variation(F.col("value")).alias("cv"))
    return out.withColumn("keep", (F.col("n") >= 2) & (F.col("cv") >= least))


def normalize_values(df: DataFrame, group: str, x: str, y: str, mode: str = "max") -> DataFrame:
    """y over the group's largest |y| or its sum; rows without a group are one group."""
    named = df.select(group, x, y, F.to_json(F.struct(F.col(group))).alias("_group"))
    by = F.max(F.abs(y)) if mode == "max" else F.sum(y)
    groups = named.groupBy("_group").agg(by.alias("_by"), F.count("*").alias("_n"))
    joined = joins.join_groups(named, groups, "_group", "_n")
    return joined.select(group, x, F.when(F.col("_by") != 0, F.col(y) / F.col("_by")).otherwise(F.col(y)).alias("normalized"))
