"""Phase diagrams and chemical potentials: entry classes, regions, temperatures, gas terms, stability domains."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import thermo


def energy_per_atom(energy: Column, correction: Column, amounts: Column) -> Column:
    """(energy + correction) over the atoms of a composition map."""
    atoms = F.aggregate(F.map_values(amounts), F.lit(0.0), lambda x, y: x + y)
    return F.try_divide(energy + F.coalesce(correction, F.lit(0.0)), atoms)


def arity(amounts: Column) -> Column:
    """How many elements have a positive amount."""
    return F.size(F.map_filter(amounts, lambda k, v: v > 0))


def category(n: Column) -> Column:
    return F.when(n == 1, "unary").when(n == 2, "binary").when(n == 3, "ternary").when(n == 4, "quaternary").when(n >= 5, "multinary")


def stability(distance: Column, excluded: Column, tolerance: float = 1e-6) -> Column:
    """Is an entry on the hull? Null without a distance; excluded ones never are."""
    return F.when(excluded, False).when(distance.isNotNull() & ~F.isnan(distance), distance <= tolerance)


def convert_temperature(c: Column, from_unit: str, to_unit: str) -> Column:
    """Between K, C and F."""
    kelvin = {"K": c, "C": c + 273.15, "F": (c + 459.67) * 5 / 9}[from_unit]
    return {"K": kelvin, "C": kelvin - 273.15, "F": kelvin * 9 / 5 - 459.67}[to_unit]


def system_name(c: Column) -> Column:
    """Elements of a name such as "Fe-C" in alphabetical order."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(F.trim(c), r"\s*-\s*"))), "-")


def phase_at(points: DataFrame, regions: DataFrame, point: str, cells: int = 256) -> DataFrame:
    """point, region: of the polygons (region, number, vertices array of x, y) that hold a point (x, y) the last one, null outside all.

    Polygons and points are dealt over strips of x, in which they meet, so no point meets polygons that lie elsewhere. The ray test is
    an expression over the edges. Points without a place lie outside.
    """
    across = F.transform("vertices", lambda v: v["x"])
    wide = regions.where(F.size("vertices") > 2).select("region", "number", "vertices", F.array_min(across).alias("_low"), F.array_max(across).alias("_high"))
    low, high = wide.agg(F.min("_low"), F.max("_high")).first()
    if low is None:
        return points.select(point, F.lit(None).cast(regions.schema["region"].dataType).alias("region"))
    width = (high - low) / cells or 1.0
    strip = lambda x: F.floor((x - low) / width)
    dealt = wide.withColumn("_strip", F.explode(F.sequence(strip(F.col("_low")), strip(F.col("_high"))))).drop("_low", "_high")
    edges = F.arrays_zip(F.col("vertices").alias("a"), F.concat(F.slice("vertices", 2, F.size("vertices")), F.slice("vertices", 1, 1)).alias("b"))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = a["x"] + (F.col("y") - a["y"]) * (b["x"] - a["x"]) / F.when(b["y"] == a["y"], None).otherwise(b["y"] - a["y"])
        return F.when(((a["y"] > F.col("y")) != (b["y"] > F.col("y"))) & (F.col("x") < at), 1).otherwise(0)

    inside = F.aggregate(F.transform(edges, crosses), F.lit(0), lambda x, y: x + y) % 2 == 1
    placed = points.select(point, "x", "y", strip(F.col("x")).alias("_place"))
    joined = placed.join(dealt, (F.col("_place") == F.col("_strip")) & inside, "left")
    return joined.groupBy(point).agg(F.max_by("region", "number").alias("region"))


def gas_potential(c: Column, enthalpy: Column, entropy: Column, pressure: Column, atoms: Column) -> Column:
    """Potential per atom in eV at temperature c: (H - T S + k T ln P) / atoms, with the pressure in bar."""
    return (enthalpy - c * entropy + 8.617333262e-5 * c * F.log(pressure)) / atoms


def gas_corrected(entries: DataFrame, gases: DataFrame, temperature: float) -> DataFrame:
    """Unary entries of an element with an enabled gas get its potential added; gases is a small table a element."""
    mu = gas_potential(F.lit(temperature), F.col("enthalpy"), F.col("entropy"), F.col("pressure"), F.col("atoms"))
    table = gases.where("enabled").select("element", mu.alias("_mu"))
    joined = entries.join(F.broadcast(table), (F.col("arity") == 1) & (entries["unary_element"] == table["element"]), "left").drop(table["element"])
    shift = F.when(F.abs("_mu") >= 1e-12, F.col("_mu")).otherwise(0.0)
    return joined.withColumn("energy_per_atom", F.col("energy_per_atom") + F.coalesce(shift, F.lit(0.0))).drop("_mu")


def stability_domains(entries: DataFrame, system: str, entry: str, components: list[str], energy: str, low: float = -10.0) -> DataFrame:
    """system, entry, mu_...: the corners of each entry's domain of chemical potentials within low <= mu <= 0.

    The domains bound the region sum x_i mu_i <= e of all entries. Entries above the hull of their system bound nothing, so only those
    on its hull, also within its faces, are cut with each other and with the box, as many at a time as there are components.
    """
    kinds, d = dict(entries.dtypes), len(components)
    facets = thermo.sections(entries, system, entry, components, energy)
    corners = facets.select("system", F.explode(F.flatten("faces")).alias("c")).where("c.entry IS NOT NULL")
    stable = corners.select(F.col("system").alias(system), F.col("c.entry").alias(entry), *(F.col("c.x")[k].alias(c) for k, c in enumerate(components)), F.col("c.e").alias(energy)).distinct()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[components].to_numpy(float)
        x = x / x.sum(1, keepdims=True)
        planes = np.vstack([np.hstack([x, pdf[[energy]].to_numpy(float)]), np.hstack([np.eye(d), np.zeros((d, 1))]), np.hstack([-np.eye(d), np.full((d, 1), -low)])])
        rows = []
        for chosen in itertools.combinations(range(len(planes)), d):
            a, b = planes[list(chosen), :d], planes[list(chosen), d]
            if abs(np.linalg.det(a)) < 1e-10:
                continue
            corner = np.linalg.solve(a, b)
            if (planes[:, :d] @ corner <= planes[:, d] + 1e-8).all():
                rows += [(pdf[entry].iloc[k], *np.round(corner, 9)) for k in chosen if k < len(pdf)]
        out = pd.DataFrame(rows, columns=[entry, *(f"mu_{c}" for c in components)]).drop_duplicates()
        out.insert(0, system, pdf[system].iloc[0])
        return out

    return stable.groupBy(system).applyInPandas(run, f"{system} {kinds[system]}, {entry} {kinds[entry]}, " + ", ".join(f"mu_{c} double" for c in components))
