"""Natural cubic splines through paths of any length, and the saddles of the curves.

The curvatures at a path's knots solve a tridiagonal system. Every `block`-th knot separates two blocks; a block writes the curvatures
within it as a sum of three solutions (its own, and one for the unit curvature at either end), so what is left is a tridiagonal system
of the separators, one row a block, and with its solution each block fills in its own. A path thus lies in as many tasks as it has
blocks; only the separators of one path meet in one task.

Rows without a place or a value (null or NaN) are no knots; of knots at one place the lowest value counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..joins import below
from ..storage import cut


def solve_tridiagonal(low: np.ndarray, mid: np.ndarray, high: np.ndarray, right: np.ndarray) -> np.ndarray:
    """x with low[i] x[i-1] + mid[i] x[i] + high[i] x[i+1] = right[i]; `right` may have several columns."""
    n = len(mid)
    c, d = np.empty(n), np.array(right, float)
    for i in range(n):
        pivot = mid[i] - (low[i] * c[i - 1] if i else 0.0)
        c[i] = high[i] / pivot
        d[i] = (d[i] - (low[i] * d[i - 1] if i else 0.0)) / pivot
    for i in range(n - 2, -1, -1):
        d[i] -= c[i] * d[i + 1]
    return d


def _parts(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(widths, slopes of the chords, curvatures within the block: own, for 1 at its first knot, for 1 at its last)."""
    h = np.diff(x)
    chord = np.diff(y) / h
    inner = np.zeros((max(len(x) - 2, 0), 3))
    if len(inner):
        inner[:, 0] = 6 * np.diff(chord)
        inner[0, 1] -= h[0]
        inner[-1, 2] -= h[-1]
        inner = solve_tridiagonal(h[:-1], 2 * (h[:-1] + h[1:]), h[1:], inner)
    return h, chord, np.vstack([[0.0, 1.0, 0.0], inner, [0.0, 0.0, 1.0]])


def _top(x: np.ndarray, y: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, value) of the highest point inside each segment of the cubic, NaN where none lies above both its ends."""
    h = np.diff(x)
    p, q, m, n = y[:-1], y[1:], slope[:-1] * h, slope[1:] * h
    a, b = 3 * (2 * p - 2 * q + m + n), 2 * (-3 * p + 3 * q - 2 * m - n)
    with np.errstate(invalid="ignore", divide="ignore"):
        root = np.sqrt(b * b - 4 * a * m)
        stable = -(b + np.where(b < 0, -root, root)) / 2  # without a difference of like numbers
        t = np.stack([stable / a, m / stable])
        t = np.where((t > 0) & (t < 1), t, np.nan)
        value = ((a / 3 * t + b / 2) * t + m) * t + p
    best = np.where(np.isnan(value), -np.inf, value).argmax(0)
    place, value = t[best, np.arange(len(h))], value[best, np.arange(len(h))]
    above = value > np.maximum(p, q)
    return np.where(above, x[:-1] + place * h, np.nan), np.where(above, value, np.nan)


def natural_cubic(df: DataFrame, path: str, x: str, y: str, block: int = 4096) -> DataFrame:
    """path, x, y, slope, top_x, top_y of every knot: its slope on the natural cubic spline, and the highest point of the segment that
    begins there if it lies above both ends. Paths of one knot have no slope."""
    if block < 1:
        raise ValueError("a block has at least one segment")
    kind = df.schema[path].dataType.simpleString()
    knots = df.select(F.col(path).alias("path"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    knots = knots.where("path IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").groupBy("path", "x").agg(F.min("y").alias("y"))
    placed = cut(below(knots.withColumn("one", F.lit(1)), "path", "x", "one").select("path", "x", "y", F.col("below").alias("n")))
    # a separator ends one block and begins the next
    first = F.floor(F.col("n") / block)
    own = placed.withColumn("block", F.explode(F.when((F.col("n") % block == 0) & (F.col("n") > 0), F.array(first - 1, first)).otherwise(F.array(first))))

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        if len(pdf) < 2:
            return pd.DataFrame(columns=["path", "block", "h0", "c0", "h1", "c1", "near0", "near1"])
        h, chord, parts = _parts(pdf["x"].to_numpy(), pdf["y"].to_numpy())
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "block": [pdf["block"].iloc[0]], "h0": h[0], "c0": chord[0], "h1": h[-1], "c1": chord[-1], "near0": [parts[1].tolist()], "near1": [parts[-2].tolist()]})

    def separators(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        h0, h1, near0, near1 = pdf["h0"].to_numpy()[1:], pdf["h1"].to_numpy()[:-1], np.array(pdf["near0"].tolist())[1:], np.array(pdf["near1"].tolist())[:-1]
        right = 6 * (pdf["c0"].to_numpy()[1:] - pdf["c1"].to_numpy()[:-1]) - h1 * near1[:, 0] - h0 * near0[:, 0]
        inner = solve_tridiagonal(h1 * near1[:, 1], 2 * (h0 + h1) + h1 * near1[:, 2] + h0 * near0[:, 1], h0 * near0[:, 2], right) if len(h0) else np.zeros(0)
        bend = np.concatenate([[0.0], inner, [0.0]])
        return pd.DataFrame({"path": pdf["path"], "block": pdf["block"], "left": bend[:-1], "right": bend[1:]})

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        x, y, last = pdf["x"].to_numpy(), pdf["y"].to_numpy(), bool(pdf["last"].iloc[0])
        if len(x) < 2:
            slope, top = np.array([np.nan]), (np.array([np.nan]), np.array([np.nan]))
        else:
            h, chord, parts = _parts(x, y)
            bend = parts @ [1.0, pdf["left"].iloc[0], pdf["right"].iloc[0]]
            slope = np.append(chord - h * (2 * bend[:-1] + bend[1:]) / 6, chord[-1] + h[-1] * (bend[-2] + 2 * bend[-1]) / 6)
            top = tuple(np.append(v, np.nan) for v in _top(x, y, slope))
        out = pd.DataFrame({"path": pdf["path"].to_numpy(), "x": x, "y": y, "slope": slope, "top_x": top[0], "top_y": top[1]}).astype({"slope": object, "top_x": object, "top_y": object})
        out = out.where(out.notna(), None)
        return out if last or len(out) < 2 else out.iloc[:-1]  # the last knot of a block is the first of the next

    sides = own.groupBy("path", "block").applyInPandas(ends, f"path {kind}, block long, h0 double, c0 double, h1 double, c1 double, near0 array<double>, near1 array<double>")
    bends = sides.groupBy("path").applyInPandas(separators, f"path {kind}, block long, left double, right double")
    whole = bends.groupBy("path").agg(F.max("block").alias("end"))
    known = cut(bends.join(whole, "path").select("path", "block", "left", "right", (F.col("block") == F.col("end")).alias("last")))
    # one row a block, so the join splits a path as its knots are split; a path of one knot has no block with sides
    rows = own.join(known, ["path", "block"], "left")
    single = rows.where("left IS NULL AND n = 0").withColumn("last", F.lit(True))
    rows = rows.where("left IS NOT NULL").unionByName(single)
    out = rows.groupBy("path", "block").applyInPandas(fill, f"path {kind}, x double, y double, slope double, top_x double, top_y double")
    return out.select(F.col("path").alias(path), F.col("x").alias(x), F.col("y").alias(y), "slope", "top_x", "top_y")


def saddles(curve: DataFrame, path: str, x: str, y: str) -> DataFrame:
    """path, saddle_x, saddle_y, at_knot, highest_x, highest_y: the highest point of each curve, and its highest knot (the first of equals)."""
    knot = F.max(F.struct(F.col(y).alias("y"), (-F.col(x)).alias("x"))).alias("knot")
    inside = F.max(F.when(F.col("top_y").isNotNull(), F.struct(F.col("top_y").alias("y"), (-F.col("top_x")).alias("x")))).alias("inside")
    found = curve.groupBy(path).agg(knot, inside)
    higher = F.coalesce(F.col("inside.y") > F.col("knot.y"), F.lit(False))
    best = F.when(higher, F.col("inside")).otherwise(F.col("knot"))
    return found.select(path, (-best["x"]).alias("saddle_x"), best["y"].alias("saddle_y"), (~higher).alias("at_knot"), (-F.col("knot.x")).alias("highest_x"), F.col("knot.y").alias("highest_y"))
