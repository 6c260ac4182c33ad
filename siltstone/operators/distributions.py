"""Partial and total pair distributions of groups of sites, reduced ones, and coordination numbers from them."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def composition(sites: DataFrame, group: str = "group", occupancy: str | None = None) -> DataFrame:
    """group, element, atoms, all_atoms: sites (or their occupancies) by element; sites without an element or with none left are left out."""
    share = F.lit(1.0) if occupancy is None else F.coalesce(F.col(occupancy).cast("double"), F.lit(1.0))
    counts = sites.where(F.col("element").isNotNull()).groupBy(group, "element").agg(F.sum(share).alias("atoms")).where("atoms > 0")
    # an element is a row, so a group has 118 at most
    return counts.join(counts.groupBy(group).agg(F.sum("atoms").alias("all_atoms")), group)


def _radius(width: float) -> Column:
    return (F.col("bin") + 0.5) * F.lit(width)


def partials(pairs: DataFrame, sites: DataFrame, cells: DataFrame, cutoff: float, bins: int, group: str = "group", site: str = "site", occupancy: str | None = None) -> DataFrame:
    """group, a, b, bin, r, n, g, atoms_a, atoms_b, all_atoms, volume for all pairs of elements a <= b of a group and all bins.

    `pairs` holds ordered pairs (group, site, other, distance) within the cutoff, each pair both ways; `cells` a volume a group.
    n counts pairs from a to b by occupancies, g is n by what an ideal gas of the group's density would hold; bins without a pair
    have 0, groups without a volume above 0 a null g. Pairs are counted by element and bin before the shuffle that adds them up.
    """
    width = cutoff / bins
    share = F.lit(1.0) if occupancy is None else F.coalesce(F.col(occupancy).cast("double"), F.lit(1.0))
    known = sites.where(F.col("element").isNotNull()).select(group, site, "element", share.alias("_share"))
    here = known.select(group, site, F.col("element").alias("a"), F.col("_share").alias("_sa"))
    there = known.select(group, F.col(site).alias("other"), F.col("element").alias("b"), F.col("_share").alias("_sb"))
    bin_of = F.floor(F.col("distance") / width + 1e-9).cast("long")
    placed = pairs.where(F.col("distance") > 0).select(group, site, "other", bin_of.alias("bin")).where(F.col("bin") < bins)
    met = placed.join(here, [group, site]).join(there, [group, "other"]).where("a <= b")
    counts = met.groupBy(group, "a", "b", "bin").agg(F.sum(F.col("_sa") * F.col("_sb")).alias("n"))
    elements = composition(sites, group, occupancy)
    first = elements.select(group, F.col("element").alias("a"), F.col("atoms").alias("atoms_a"), "all_atoms")
    second = elements.select(group, F.col("element").alias("b"), F.col("atoms").alias("atoms_b"))
    kinds = first.join(second, group).where("a <= b").join(cells.select(group, F.col("volume").cast("double").alias("volume")), group, "left")
    full = kinds.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    rows = full.join(counts, [group, "a", "b", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    k = F.col("bin").cast("double")
    shell = 4.0 / 3.0 * pi * width**3 * (3 * k * k + 3 * k + 1)
    g = F.when(F.col("volume") > 0, F.col("n") * F.col("volume") / (F.col("atoms_a") * F.col("atoms_b") * shell))
    return rows.select(group, "a", "b", "bin", _radius(width).alias("r"), "n", g.alias("g"), "atoms_a", "atoms_b", "all_atoms", "volume")


def reduced(r: Column, g: Column, density: Column) -> Column:
    """4 pi r density (g - 1), with the density of all atoms for partial distributions too."""
    return 4 * pi * r * density * (g - 1)


def total(parts: DataFrame, lengths: DataFrame, group: str = "group") -> DataFrame:
    """group, bin, r, g, reduced: partial distributions added up by c_a c_b b_a b_b / <b>^2, unlike pairs twice.

    `lengths` has a scattering length an element (columns element, length; 118 rows at most, so it is broadcast). A group with an
    element that has none, or whose mean is 0, has null values, as no weights add up to 1 there.
    """
    known = F.broadcast(lengths.groupBy("element").agg(F.first("length").cast("double").alias("_l")))
    rows = parts.join(known.select(F.col("element").alias("a"), F.col("_l").alias("_la")), "a", "left").join(known.select(F.col("element").alias("b"), F.col("_l").alias("_lb")), "b", "left")
    both = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    part = both * (F.col("atoms_a") / F.col("all_atoms")) * (F.col("atoms_b") / F.col("all_atoms")) * F.col("_la") * F.col("_lb")
    # the weights of a group's pairs add up to the square of its mean length
    lacking = F.count(F.when(part.isNull() | F.col("g").isNull(), 1))
    sums = rows.groupBy(group, "bin", "r").agg(F.sum(part * F.col("g")).alias("_g"), F.sum(part).alias("_w"), lacking.alias("_lacks"), F.first(F.try_divide("all_atoms", "volume")).alias("_density"))
    g = F.when((F.col("_lacks") == 0) & (F.abs("_w") > 1e-12), F.col("_g") / F.col("_w"))
    return sums.select(group, "bin", "r", g.alias("g"), reduced(F.col("r"), g, F.col("_density")).alias("reduced"))


def coordination(parts: DataFrame, width: float, low: float = 0.0, high: float = float("inf"), group: str = "group") -> DataFrame:
    """group, a, b, neighbours: atoms of b around one of a between two radii, the sum of 4 pi r^2 density_b g over the bins there.

    Null for a group without a volume.
    """
    if high <= low:
        raise ValueError("the upper radius has to lie above the lower one")
    inside = (F.col("r") >= low) & (F.col("r") < high)
    each = F.when(inside, 4 * pi * F.col("r") * F.col("r") * F.try_divide("atoms_b", "volume") * F.col("g") * width).otherwise(0.0)
    return parts.groupBy(group, "a", "b").agg(F.when(F.first("volume") > 0, F.sum(each)).alias("neighbours"))
