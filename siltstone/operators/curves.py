"""Curves: interpolation at given places, monotone tangents, fills between two series, polygons, merged variances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interpolate(series: DataFrame, places: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """group, x, y at each place (group, x) by linear interpolation of the series; held flat beyond its ends, null without any.

    Places and samples are one ordered stream a group, so each place meets the samples around it without a range join.
    Of samples at one x the largest y counts.
    """
    samples = series.groupBy(group, x).agg(F.max(y).alias("_y")).select(group, x, "_y", F.lit(False).alias("_asked"))
    asked = places.select(group, x).distinct().select(group, x, F.lit(None).cast("double").alias("_y"), F.lit(True).alias("_asked"))
    both = samples.unionByName(asked)
    order = Window.partitionBy(group).orderBy(x, "_asked")
    known = F.when(~F.col("_asked"), F.struct(F.col(x).alias("x"), F.col("_y").alias("y")))
    before = F.last(known, True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, True).over(order.rowsBetween(0, Window.unboundedFollowing))
    out = both.withColumn("_a", before).withColumn("_b", after).where("_asked")
    inside = F.col("_a.y") + (F.col("_b.y") - F.col("_a.y")) * (F.col(x) - F.col("_a.x")) / (F.col("_b.x") - F.col("_a.x"))
    value = F.when(F.col("_a").isNull(), F.col("_b.y")).when(F.col("_b").isNull() | (F.col("_a.x") == F.col(x)), F.col("_a.y")).otherwise(inside)
    return out.select(group, x, value.alias(y))


def monotone_tangents(series: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """group, x, y, tangent: slopes of a cubic through the points that overshoots none of them (x strictly increasing).

    Inner slopes have the sign of both secants, or are 0, and are at most twice the flatter one; the end ones follow from
    their secant and their neighbour.
    """
    w = Window.partitionBy(group).orderBy(x)
    here = series.select(group, x, y).withColumn("_h", F.lead(x).over(w) - F.col(x)).withColumn("_s", (F.lead(y).over(w) - F.col(y)) / (F.lead(x).over(w) - F.col(x)))
    here = here.withColumn("_h0", F.lag("_h").over(w)).withColumn("_s0", F.lag("_s").over(w))
    mean = (F.col("_s0") * F.col("_h") + F.col("_s") * F.col("_h0")) / (F.col("_h0") + F.col("_h"))
    inner = (F.signum("_s0") + F.signum("_s")) * F.least(F.abs("_s0"), F.abs("_s"), F.abs(mean) / 2)
    here = here.withColumn("_t", F.when(F.col("_s0").isNotNull() & F.col("_s").isNotNull(), inner))
    first = F.coalesce((3 * F.col("_s") - F.lead("_t").over(w)) / 2, F.col("_s"))
    last = F.coalesce((3 * F.col("_s0") - F.lag("_t").over(w)) / 2, F.col("_s0"))
    tangent = F.coalesce("_t", F.when(F.col("_s0").isNull(), first).otherwise(last), F.lit(0.0))
    return here.select(group, x, y, tangent.alias("tangent"))


def evaluate(series: DataFrame, places: DataFrame, group: str, x: str, y: str, kind: str = "monotone") -> DataFrame:
    """group, x, y at each place: the `monotone` cubic, or steps that hold the last knot (`after`), the next (`before`) or switch midway (`step`).

    A knot's own place has its value. Beyond the ends the curve is held flat; without any knot it is null. Of knots at one x
    the largest y counts; knots without x or y are left out.
    """
    knots = series.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(group, x).agg(F.max(y).cast("double").alias(y))
    sloped = monotone_tangents(knots, group, x, y) if kind == "monotone" else knots.withColumn("tangent", F.lit(0.0))
    marked = sloped.select(group, x, F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col("tangent").alias("t")).alias("_k"), F.lit(0).alias("_asked"))
    asked = places.select(group, x).distinct().select(group, x, F.lit(None).cast(marked.schema["_k"].dataType).alias("_k"), F.lit(1).alias("_asked"))
    order = Window.partitionBy(group).orderBy(x, "_asked")
    before = F.last("_k", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_k", True).over(order.rowsBetween(0, Window.unboundedFollowing))
    out = marked.unionByName(asked).withColumn("_a", before).withColumn("_b", after).where("_asked = 1")
    a, b, width = F.col("_a"), F.col("_b"), F.col("_b.x") - F.col("_a.x")
    f = (F.col(x) - a["x"]) / width
    g, third = 1 - f, width / 3
    inside = {
        "monotone": g * g * g * a["y"] + 3 * g * g * f * (a["y"] + third * a["t"]) + 3 * g * f * f * (b["y"] - third * b["t"]) + f * f * f * b["y"],
        "after": a["y"], "before": b["y"], "step": F.when(f < 0.5, a["y"]).otherwise(b["y"]),
    }[kind]
    return out.select(group, x, F.when(a.isNull(), b["y"]).when(b.isNull() | (a["x"] == F.col(x)), a["y"]).otherwise(inside).alias(y))


def fill_segments(series: DataFrame, group: str, x: str, upper: str, lower: str) -> DataFrame:
    """group, segment, start, end, points, area of the stretches in which `upper` lies above `lower`; single points are left out."""
    w = Window.partitionBy(group).orderBy(x)
    rows = series.where(F.col(upper).isNotNull() & F.col(lower).isNotNull())
    gap = F.col(upper) - F.col(lower)
    marked = rows.select(group, x, gap.alias("_gap"), (gap > 0).alias("_on")).withColumn("_new", F.coalesce(F.col("_on") != F.lag("_on").over(w), F.lit(True)))
    marked = marked.withColumn("segment", F.sum(F.col("_new").cast("long")).over(w)).withColumn("_nx", F.lead(x).over(w)).withColumn("_ng", F.lead("_gap").over(w)).withColumn("_non", F.lead("_on").over(w))
    piece = F.when(F.col("_non"), (F.col("_nx") - F.col(x)) * (F.col("_gap") + F.col("_ng")) / 2)
    out = marked.where("_on").groupBy(group, "segment").agg(F.min(x).alias("start"), F.max(x).alias("end"), F.count("*").alias("points"), F.coalesce(F.sum(piece), F.lit(0.0)).alias("area"))
    return out.where("points > 1")


def polygons(corners: DataFrame, group: str, order: str, x: str, y: str) -> DataFrame:
    """group, area, cx, cy, and the bounding box of closed polygons given by their corners in order; the mean corner where the area is 0."""
    w = Window.partitionBy(group).orderBy(order)
    whole = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = corners.select(group, F.col(x).alias("_x"), F.col(y).alias("_y"), F.coalesce(F.lead(x).over(w), F.first(x).over(whole)).alias("_nx"), F.coalesce(F.lead(y).over(w), F.first(y).over(whole)).alias("_ny"))
    cross = F.col("_x") * F.col("_ny") - F.col("_nx") * F.col("_y")
    out = rows.groupBy(group).agg(
        (F.sum(cross) / 2).alias("_a"), F.sum((F.col("_x") + F.col("_nx")) * cross).alias("_mx"), F.sum((F.col("_y") + F.col("_ny")) * cross).alias("_my"),
        F.avg("_x").alias("_ax"), F.avg("_y").alias("_ay"), F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1"),
    )
    center = lambda m, a: F.when(F.abs("_a") > 1e-9, F.col(m) / (6 * F.col("_a"))).otherwise(F.col(a))
    return out.select(group, F.abs("_a").alias("area"), center("_mx", "_ax").alias("cx"), center("_my", "_ay").alias("cy"), "x0", "x1", "y0", "y1")


def merge_variances(parts: DataFrame, group: str) -> DataFrame:
    """group, n, mean, variance (sample) of groups from the counts, means and squared deviations (n, mean, m2) of their parts."""
    total = parts.groupBy(group).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("all_mean"))
    joined = parts.select(group, F.col("n").alias("k"), "mean", "m2").join(total, group)
    shift = F.col("mean") - F.col("all_mean")
    out = joined.groupBy(group).agg(F.first("n").alias("n"), F.first("all_mean").alias("mean"), F.sum(F.col("m2") + F.col("k") * shift * shift).alias("m2"))
    return out.select(group, "n", "mean", F.when(F.col("n") > 1, F.col("m2") / (F.col("n") - 1)).otherwise(0.0).alias("variance"))


def merge_series(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows of both; where a key is in both, the new value counts unless it is null."""
    there = new.select(*key, F.col(value).alias("_new"), F.lit(True).alias("_known"))
    both = old.select(*key, value).join(there, key, "full")
    return both.select(*key, F.coalesce("_new", value).alias(value), F.coalesce("_known", F.lit(False)).alias("updated"))
