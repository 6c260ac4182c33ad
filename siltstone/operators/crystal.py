"""Crystals: lattice parameters, reciprocal points, diffraction patterns, supercells, local order."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N

AXES = ("a", "b", "c")


def _vector(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{k}") for k in "xyz"]


def _cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def _dot(u: list[Column], v: list[Column]) -> Column:
    return sum((x * y for x, y in zip(u, v, strict=True)), F.lit(0.0))


def lattice_parameters(cells: DataFrame, key: str) -> DataFrame:
    """key, a, b, c, alpha, beta, gamma, volume of cells with columns ax, ay, az, bx, ... (vectors as rows)."""
    a, b, c = map(_vector, AXES)
    size = {k: F.sqrt(_dot(v, v)) for k, v in zip(AXES, (a, b, c), strict=True)}
    angles = {"alpha": N.angle(b, c), "beta": N.angle(a, c), "gamma": N.angle(a, b)}
    return cells.select(key, *[v.alias(k) for k, v in (size | angles).items()], F.abs(N.volume([a, b, c])).alias("volume"))


def _reciprocal() -> list[Column]:
    a, b, c = map(_vector, AXES)
    v = N.volume([a, b, c])
    made = zip(AXES, (_cross(b, c), _cross(c, a), _cross(a, b)), strict=True)
    return [(x / v).alias(f"{name}{k}") for name, vector in made for k, x in zip("xyz", vector, strict=True)]


def reciprocal(cells: DataFrame, key: str) -> DataFrame:
    """The reciprocal vectors with a* . a = 1, in columns named as the cell's."""
    return cells.select(key, *_reciprocal())


def reflections(cells: DataFrame, key: str, wavelength: float, two_theta: tuple[float, float] = (0.0, 90.0)) -> DataFrame:
    """key, h, k, l, g (1 / d), two_theta of all reciprocal points in the range of angles.

    A cell's points are made and kept or dropped in the row of its reciprocal vectors, so no cell meets another and nothing is shuffled.
    """
    from math import radians, sin

    most = 2 * sin(radians(two_theta[1] / 2)) / wavelength
    least = 2 * sin(radians(two_theta[0] / 2)) / wavelength
    lengths = [F.sqrt(_dot(_vector(x), _vector(x))) for x in AXES]
    points = cells.select(key, *_reciprocal(), *[(F.ceil(size * most) + 1).cast("int").alias(f"n{x}") for x, size in zip(AXES, lengths, strict=True)])
    for n, x in zip("hkl", AXES, strict=True):
        points = points.withColumn(n, F.explode(F.sequence(-F.col(f"n{x}"), F.col(f"n{x}")))).drop(f"n{x}")
    g = [F.col("h") * F.col(f"a{x}") + F.col("k") * F.col(f"b{x}") + F.col("l") * F.col(f"c{x}") for x in "xyz"]
    points = points.select(key, "h", "k", "l", F.sqrt(_dot(g, g)).alias("g")).where((F.col("g") > 1e-12) & F.col("g").between(least, most))
    return points.withColumn("two_theta", 2 * F.degrees(F.asin(F.col("g") * wavelength / 2)))


def structure_factors(points: DataFrame, sites: DataFrame, key: str, weight: str = "weight") -> DataFrame:
    """Each reflection with |F|^2: a sum over the sites (fractional u, v, w) of its cell, combined before the shuffle.

    Both sides grow by explode(), which Spark's estimates leave out, so neither may be taken for small and broadcast.
    """
    joined = points.join(sites.select(key, "u", "v", "w", weight).hint("merge"), key)
    phase = 2 * pi * (F.col("h") * F.col("u") + F.col("k") * F.col("v") + F.col("l") * F.col("w"))
    sums = joined.groupBy(key, "h", "k", "l").agg(F.first("g").alias("g"), F.first("two_theta").alias("two_theta"), F.sum(F.col(weight) * F.cos(phase)).alias("re"), F.sum(F.col(weight) * F.sin(phase)).alias("im"))
    return sums.select(key, "h", "k", "l", "g", "two_theta", (F.col("re") ** 2 + F.col("im") ** 2).alias("f2"))


def powder_pattern(factors: DataFrame, key: str, least: float = 1e-3) -> DataFrame:
    """key, peak angle, intensity (100 for the strongest), multiplicity: Lorentz-polarised and merged within 1e-5 degrees."""
    theta = F.radians(F.col("two_theta") / 2)
    lorentz = (1 + F.cos(2 * theta) ** 2) / (F.sin(theta) ** 2 * F.cos(theta))
    peaks = factors.where(F.col("two_theta") < 180).groupBy(key, F.round("two_theta", 5).alias("two_theta")).agg(F.sum(F.col("f2") * lorentz).alias("i"), F.count("*").alias("multiplicity"))
    top = F.max("i").over(Window.partitionBy(key))
    return peaks.withColumn("intensity", 100 * F.col("i") / top).where(F.col("intensity") > 100 * least).select(key, "two_theta", "intensity", "multiplicity")


def families(points: DataFrame, key: str) -> DataFrame:
    """key, family (sorted absolute indices), its largest member as text, multiplicity."""
    sorted_ = F.array_sort(F.array(F.abs("h"), F.abs("k"), F.abs("l")))
    out = points.groupBy(key, F.array_join(sorted_, ",").alias("family")).agg(F.max(F.struct("h", "k", "l")).alias("m"), F.count("*").alias("multiplicity"))
    return out.select(key, "family", F.concat_ws(",", "m.h", "m.k", "m.l").alias("representative"), "multiplicity")


def supercell(sites: DataFrame, n: tuple[int, int, int]) -> DataFrame:
    """Sites (fractional u, v, w) of an n1 by n2 by n3 cell, with the image of each."""
    out = sites
    for name, c, k in zip(("i", "j", "k"), "uvw", n, strict=True):
        out = out.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn(c, (F.col(c) + F.col(name)) / k)
    return out


def boundary_images(sites: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Sites and their images on the far side of the cell, for coordinates near 0 or 1."""
    out = sites.withColumn("is_image", F.lit(False))
    for c in "uvw":
        near = lambda x: F.when(F.abs(x) < tolerance, F.array(x, x + 1)).when(F.abs(x - 1) < tolerance, F.array(x, x - 1)).otherwise(F.array(x))
        moved = out.select(*[x for x in out.columns if x not in (c, "is_image")], "is_image", F.posexplode(near(F.col(c))).alias("_k", c))
        out = moved.withColumn("is_image", F.col("is_image") | (F.col("_k") > 0)).drop("_k")
    return out


def apply_operations(sites: DataFrame, operations: DataFrame, key: list[str], tolerance_digits: int = 4) -> DataFrame:
    """Distinct equivalent positions: u' = R u + t, wrapped to the cell. operations: r11 .. r33, t1 .. t3 (a fixed small table)."""
    joined = sites.crossJoin(F.broadcast(operations))  # at most 192 operations of a space group
    new = [sum((F.col(f"r{i}{j}") * F.col(c) for j, c in enumerate("uvw", 1)), F.col(f"t{i}")) for i in (1, 2, 3)]
    wrapped = [F.pmod(F.round(N.wrap_fraction(x), tolerance_digits), F.lit(1.0)).alias(c) for c, x in zip("uvw", new, strict=True)]
    return joined.select(*key, *wrapped).distinct()


def crystal_system(number: Column) -> Column:
    """The crystal system of a space group number."""
    # fixed values: the last space group of each system
    last = {2: "triclinic", 15: "monoclinic", 74: "orthorhombic", 142: "tetragonal", 167: "trigonal", 194: "hexagonal", 230: "cubic"}
    out = F.when(number < 1, None)
    for n, name in last.items():
        out = out.when(number <= n, name)
    return out


def centrosymmetry(pairs: DataFrame, n: int = 12, group: str = "group", site: str = "site") -> DataFrame:
    """group, site, csp: the sum of the n / 2 smallest |r_i + r_j|^2 over pairs of the n nearest neighbours; null with fewer."""
    w = Window.partitionBy(group, site).orderBy("distance", "other")
    near = pairs.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    lists = near.groupBy(group, site).agg(F.collect_list(F.struct("dx", "dy", "dz")).alias("r"))  # n a site at most
    squares = F.flatten(F.transform("r", lambda a, i: F.transform(F.slice("r", i + 2, n), lambda b: (a["dx"] + b["dx"]) ** 2 + (a["dy"] + b["dy"]) ** 2 + (a["dz"] + b["dz"]) ** 2)))
    total = F.aggregate(F.slice(F.array_sort(squares), 1, n // 2), F.lit(0.0), lambda x, y: x + y)
    return lists.select(group, site, F.when(F.size("r") == n, total).alias("csp"))


def common_neighbours(pairs: DataFrame, group: str = "group", site: str = "site") -> DataFrame:
    """group, site, other, n_common, n_bonds: shared neighbours of each bond, and the bonds among these."""
    bonds = pairs.select(group, site, "other")
    shared = bonds.join(bonds.select(group, F.col(site).alias("other"), F.col("other").alias("third")), [group, "other"])
    shared = shared.join(bonds.select(group, site, F.col("other").alias("third")), [group, site, "third"])
    counts = shared.groupBy(group, site, "other").agg(F.count("*").alias("n_common"))
    left, right = shared.select(group, site, "other", F.col("third").alias("p")), shared.select(group, site, "other", F.col("third").alias("q"))
    inner = left.join(right, [group, site, "other"]).where("p < q").join(bonds.select(group, F.col(site).alias("p"), F.col("other").alias("q")), [group, "p", "q"])
    among = inner.groupBy(group, site, "other").agg(F.count("*").alias("n_bonds"))
    out = bonds.join(counts, [group, site, "other"], "left").join(among, [group, site, "other"], "left")
    return out.na.fill(0, ["n_common", "n_bonds"])


def density(sites: DataFrame, masses: DataFrame, volumes: DataFrame, key: str) -> DataFrame:
    """key, density in g / cm^3 from elements, their masses (a fixed table) and the cells' volumes in cubic angstroms."""
    total = sites.join(F.broadcast(masses), "element").groupBy(key).agg(F.sum("mass").alias("mass"))
    return total.join(volumes, key).select(key, (1.66053907 * F.col("mass") / F.col("volume")).alias("density"))
