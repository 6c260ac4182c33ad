"""Formation free energies of phases at temperatures, each by the best of three models: tabulated, descriptor or static.

A phase with a table of free energies is read between its nearest temperatures. A solid compound without one can be described by its
volume and the reduced mass of its elements beside tables of the elements' own free energies (a published descriptor for what
a compound's free energy gains over its enthalpy at room temperature). Otherwise its energy stands at all temperatures. All are
relative to the elements: the lowest pure entry of each, by its own table or energy.

Everything is joins and sums: compositions become one row an element, meet the few numbers of that element (joins.join_groups, as one
element may be in most phases), and are summed up again by phase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..joins import join_groups
from ..storage import cut

#: The coefficients of the descriptor (eV an atom, cubic Angstrom, atomic mass units, Kelvin).
LOG_VOLUME, MASS_BY_VOLUME, LOG_TEMPERATURE, CONSTANT = -2.48e-4, -8.94e-5, 0.181, -0.882
MODES = ("auto", "tabulated", "descriptor", "static")


def descriptor(volume: Column, mass: Column, temperature: float) -> Column:
    """What a solid compound's free energy at this temperature differs from its enthalpy at room temperature, an atom."""
    return (LOG_VOLUME * F.log(volume) + MASS_BY_VOLUME * mass / volume) * temperature + F.lit(LOG_TEMPERATURE) * F.log(F.lit(temperature)) + CONSTANT


def reduced_mass(parts: Column) -> Column:
    """The mean over pairs of elements of (a + b) m n / (m + n), from (x, mass) of each; null for one element or without all masses."""
    pairs = F.transform(parts, lambda p, i: F.aggregate(F.slice(parts, i + 2, F.size(parts)), F.lit(0.0), lambda sum_, q: sum_ + (p["x"] + q["x"]) * p["mass"] * q["mass"] / (p["mass"] + q["mass"])))
    whole = F.forall(parts, lambda p: p["mass"].isNotNull() & (p["mass"] > 0))
    return F.when((F.size(parts) > 1) & whole, F.aggregate(pairs, F.lit(0.0), lambda a, b: a + b) / (F.size(parts) - 1))


def _at(table: DataFrame, key: str, temperatures: list[float], most_gap: float | None) -> DataFrame:
    """key, values: the table (key, temperature, g) between its nearest temperatures, null beyond them or over a larger gap."""
    t, pair = F.col("temperature"), F.struct(F.col("temperature").alias("t"), F.col("g").alias("g"))
    rows = table.where("temperature IS NOT NULL AND g IS NOT NULL").select(key, F.col("temperature").cast("double").alias("temperature"), F.col("g").cast("double").alias("g"))
    ends = [e for k, at in enumerate(temperatures) for e in (F.max_by(F.when(t <= at, pair), F.when(t <= at, t)).alias(f"a{k}"), F.min_by(F.when(t >= at, pair), F.when(t >= at, t)).alias(f"b{k}"))]
    found = rows.groupBy(key).agg(*ends)

    def value(k: int, at: float) -> Column:
        a, b = F.col(f"a{k}"), F.col(f"b{k}")
        gap = b["t"] - a["t"]
        near = gap <= most_gap if most_gap is not None else F.lit(True)
        return F.when(gap == 0, a["g"]).when(near, a["g"] + (b["g"] - a["g"]) * (at - a["t"]) / gap)

    return found.select(key, F.array(*(value(k, at) for k, at in enumerate(temperatures))).alias("values"))


def formation(entries: DataFrame, tables: DataFrame, elements: DataFrame, element_tables: DataFrame, temperatures: list[float], mode: str = "auto", shifts: DataFrame | None = None, most_gap: float = 500.0) -> DataFrame:
    """entry, temperature, source (tabulated, descriptor or static), dg_form (an atom) of every entry at every temperature.

    entries: entry (unique), composition (map of amounts), energy and volume an atom, e_form (or null). tables: entry, temperature, g.
    elements: element, mass. element_tables: element, temperature, g, between which lines are drawn. shifts: element, temperature and
    shift of its reference by an atmosphere, which compounds feel.

    The modes other than `auto` take their model where it can be had and the static one elsewhere. By `auto` a pure entry goes with the
    descriptor only if some compound does; it then keeps its distance to the lowest entry of its element. Elements without a pure
    entry stand at 0. Null where a table doesn't reach or has a gap wider than `most_gap`, where an energy lacks, and for
    compositions without a positive amount.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    n = len(temperatures)
    parts = entries.select("entry", F.explode("composition").alias("element", "amount")).where("amount > 0")
    amounts = parts.groupBy("entry").agg(F.sum("amount").alias("total"), F.count("*").alias("n_elements"))
    parts = parts.join(amounts, "entry").select("entry", "element", "n_elements", (F.col("amount") / F.col("total")).alias("x"))
    own = _at(tables, "entry", temperatures, most_gap).withColumnRenamed("values", "own")
    base = cut(entries.select("entry", F.col("energy").cast("double").alias("energy"), F.col("volume").cast("double").alias("volume"), F.col("e_form").cast("double").alias("e_form")).join(own, "entry", "left"))
    tabulated = F.col("own").isNotNull()

    # the lowest pure entry of each element, and what all its phases need to know of an element
    pure = parts.where("n_elements = 1").select("entry", "element").join(base, "entry").where("energy IS NOT NULL AND NOT isnan(energy)")
    lowest = pure.groupBy("element").agg(F.min_by(F.struct("energy", "own"), F.struct("energy", "entry")).alias("low"))
    static = F.array(*[F.coalesce(F.col("low.energy"), F.lit(0.0))] * n)
    by_table = F.col("low.own").isNotNull() & F.lit(mode != "static")
    known = parts.groupBy("element").agg(F.count("*").alias("n")).join(lowest, "element", "left").join(elements.select("element", F.col("mass").cast("double").alias("mass")), "element", "left")
    known = known.join(_at(element_tables, "element", temperatures, None).withColumnRenamed("values", "experiment"), "element", "left")
    if shifts is not None:
        felt = shifts.groupBy("element").agg(F.array(*(F.coalesce(F.max(F.when(F.col("temperature") == t, F.col("shift"))), F.lit(0.0)) for t in temperatures)).alias("felt"))
        known = known.join(felt, "element", "left")
    else:
        known = known.withColumn("felt", F.lit(None).cast("array<double>"))
    known = known.select("element", "n", "mass", "experiment", "felt", F.coalesce(F.col("low.energy"), F.lit(0.0)).alias("ref"), F.when(by_table, F.col("low.own")).otherwise(static).alias("refs"))
    met = join_groups(parts, known, "element", "n")

    def mixed(values: Column) -> Column:
        """The sum of shares times values, null if one is."""
        return F.when(F.count(values) == F.count("*"), F.sum(F.col("x") * values))

    each = lambda c: F.array(*(mixed(F.col(c)[k]) for k in range(n)))
    felt = F.array(*(F.sum(F.col("x") * F.coalesce(F.col("felt")[k], F.lit(0.0))) for k in range(n)))
    sums = met.groupBy("entry").agg(
        F.max("n_elements").alias("n_elements"), F.sort_array(F.collect_list(F.struct("element", "x", "mass"))).alias("parts"), F.bool_and(F.col("experiment").isNotNull()).alias("in_tables"),
        F.sum(F.col("x") * F.col("ref")).alias("ref"), each("refs").alias("refs"), each("experiment").alias("experiment"), felt.alias("felt"),
    )
    rows = base.join(sums, "entry", "left").withColumn("mass", reduced_mass(F.col("parts")))
    rows = cut(rows.withColumn("described", F.coalesce(F.col("in_tables") & ((F.col("n_elements") == 1) | ((F.col("volume") > 0) & F.col("mass").isNotNull())), F.lit(False))))
    if mode == "auto":
        some = not rows.where(~tabulated & F.col("described") & (F.col("n_elements") > 1)).isEmpty()
        fits = F.when(F.col("n_elements") == 1, F.lit(some)).otherwise(F.col("described"))
        source = F.when(tabulated, "tabulated").when(fits, "descriptor").otherwise("static")
    elif mode == "descriptor":
        source = F.when(F.col("described"), "descriptor").otherwise("static")
    else:
        source = F.when(tabulated & F.lit(mode == "tabulated"), "tabulated").otherwise("static")
    enthalpy = F.coalesce(F.col("e_form"), F.col("energy") - F.col("ref"))

    def value(k: int, t: float) -> Column:
        compound = F.col("n_elements") > 1
        shift = F.when(compound, F.col("felt")[k]).otherwise(0.0)
        by_descriptor = F.when(compound, enthalpy + descriptor(F.col("volume"), F.col("mass"), t) - F.col("experiment")[k] - shift).otherwise(F.col("energy") - F.col("ref"))
        by_own = F.when(F.col("source") == "tabulated", F.col("own")[k]).otherwise(F.col("energy")) - F.col("refs")[k] - shift
        return F.when(F.col("n_elements").isNull(), None).when(F.col("source") == "descriptor", by_descriptor).otherwise(by_own)

    at = F.array(*(F.struct(F.lit(float(t)).alias("temperature"), value(k, t).alias("dg_form")) for k, t in enumerate(temperatures)))
    return rows.withColumn("source", source).select("entry", "source", F.inline(at)).select("entry", "temperature", "source", "dg_form")
