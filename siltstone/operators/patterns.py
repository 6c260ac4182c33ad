"""Formulas by patterns with free elements, answered from an inverted index of element sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formula as C
from ..joins import join_groups
from ..storage import cut

#: Amounts are compared as whole numbers of this part of an atom, after the common divisor is taken out.
GRAIN = 10_000


def _divisor(amounts: Column) -> Column:
    """The common divisor of an array of whole numbers: in each step the larger of two is replaced by the rest."""

    def gcd(x: Column, y: Column) -> Column:
        # 45 steps reach the divisor of any two numbers below 2**31
        start = F.struct(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
        steps = F.sequence(F.lit(1), F.lit(45))
        return F.aggregate(steps, start, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b"))))["a"]

    return F.aggregate(amounts, F.lit(0).cast("long"), gcd)


def compositions(entries: DataFrame, text: str) -> DataFrame:
    """text, composition, system, elements, amounts, entries: one row for each different formula text that can be read.

    `composition` writes elements and whole amounts without a common divisor in alphabetical order; `amounts` are these by
    element, and `entries` is the number of rows with the text.
    """
    counted = entries.where(F.col(text).isNotNull()).groupBy(text).agg(F.count("*").alias("entries"))
    parsed = counted.withColumn("_map", C.parse_formula(F.col(text))).where(F.col("_map").isNotNull())
    names = F.array_sort(F.map_keys(F.map_filter("_map", lambda _, n: n > 0)))
    parsed = parsed.withColumn("elements", names).where(F.size("elements") > 0)
    whole = F.transform("elements", lambda e: F.round(F.element_at("_map", e) * GRAIN).cast("long"))
    parsed = parsed.withColumn("_n", whole).withColumn("_by", F.greatest(_divisor(F.col("_n")), F.lit(1)))
    parsed = parsed.withColumn("_n", F.transform("_n", lambda n: (n / F.col("_by")).cast("long")))
    name = F.array_join(F.transform(F.arrays_zip(F.col("elements").alias("e"), F.col("_n").alias("n")), lambda x: F.concat(x["e"], x["n"].cast("string"))), " ")
    return parsed.select(text, name.alias("composition"), F.array_join("elements", "-").alias("system"), "elements", F.map_from_arrays("elements", "_n").alias("amounts"), "entries")


def patterns_of(patterns: DataFrame, text: str) -> DataFrame:
    """text, fixed (elements), n (elements in all), amounts (by fixed element), free (amounts, ascending), one row a pattern text.

    Repeated elements add up; amounts of 0 are left out; texts that are no pattern, or hold nothing, are left out.
    """
    distinct = patterns.where(F.col(text).isNotNull()).select(text).distinct()
    listed = distinct.withColumn("_list", C.parse_wildcards(F.col(text))).select(text, F.posexplode("_list").alias("_k", "_x"))
    free = F.col("_x.element").isNull()
    amounts = listed.groupBy(text, F.col("_x.element").alias("element"), F.when(free, F.col("_k")).alias("_k")).agg(F.round(F.sum("_x.amount") * GRAIN).cast("long").alias("n")).where("n > 0")
    grouped = amounts.groupBy(text).agg(F.array_sort(F.collect_list(F.struct("element", "n"))).alias("_all"))
    by = F.greatest(_divisor(F.transform("_all", lambda x: x["n"])), F.lit(1))
    rows = grouped.withColumn("_by", by).withColumn("_all", F.transform("_all", lambda x: F.struct(x["element"].alias("element"), (x["n"] / F.col("_by")).cast("long").alias("n"))))
    fixed, loose = F.filter("_all", lambda x: x["element"].isNotNull()), F.filter("_all", lambda x: x["element"].isNull())
    return rows.select(text, F.transform(fixed, lambda x: x["element"]).alias("fixed"), F.size("_all").alias("n"), F.map_from_entries(fixed).alias("amounts"), F.array_sort(F.transform(loose, lambda x: x["n"])).alias("free"))


def candidate_systems(found: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """text (of the pattern), system: element sets of the pattern's size that hold all its fixed elements.

    The index has a row for each element of each different set, and one under an empty name for patterns without a fixed
    element. A pattern asks under its rarest element and the sets it meets there are tested for the others, so a frequent
    element is only asked for by patterns that have no other. There is one count an element, 119 at most, so they are broadcast.
    """
    sets = cut(found.select("system", "elements").distinct().withColumn("n", F.size("elements")))
    index = sets.select("system", "elements", "n", F.explode(F.concat("elements", F.array(F.lit("")))).alias("element"))
    often = index.groupBy("element").agg(F.count("*").alias("_often"))
    asked = wanted.select(text, "fixed", "n", F.explode(F.concat("fixed", F.array(F.lit("")))).alias("element"))
    # an element without a set leaves the pattern without an answer
    rated = asked.join(F.broadcast(often), "element", "left").withColumn("_often", F.coalesce("_often", F.lit(0)))
    rarest = rated.groupBy(text).agg(F.min_by(F.struct("fixed", "n", "element"), F.struct("_often", "element")).alias("_x")).select(text, "_x.*")
    met = rarest.join(index, ["element", "n"])
    return met.where(F.size(F.array_except("fixed", "elements")) == 0).select(text, "system")


def match(entries: DataFrame, formula: str, patterns: DataFrame, pattern: str, exact: bool = True) -> DataFrame:
    """The rows of `entries` with each `pattern` they match.

    Every `*` stands for an element of its own, other than the pattern's fixed ones. With `exact` a formula's amounts are those of
    the pattern up to a common factor, with the free amounts dealt to the other elements in any way; otherwise only the set of
    elements counts. Formulas and patterns that can't be read, or are null, match nothing; each pattern text counts once.
    """
    found = cut(compositions(entries, formula))
    wanted = cut(patterns_of(patterns, pattern))
    systems = candidate_systems(found, wanted, pattern)
    if exact:
        distinct = found.groupBy("composition").agg(F.first("system").alias("system"), F.first("amounts").alias("has"))
        met = systems.join(wanted.select(pattern, "amounts", "free"), pattern).join(distinct, "system")
        same = F.forall(F.map_keys("amounts"), lambda e: F.element_at("has", e) == F.element_at("amounts", e))
        others = F.array_sort(F.map_values(F.map_filter("has", lambda e, _: ~F.array_contains(F.map_keys("amounts"), e))))
        met, key = met.where(same & (others == F.col("free"))), "composition"
    else:
        met, key = systems, "system"
    # one row a composition (or system) with its patterns, so that rows of frequent formulas are not shuffled to one place
    answers = met.groupBy(key).agg(F.collect_set(pattern).alias("_patterns"))
    texts = found.select(formula, key, "entries").join(answers, key).select(formula, "entries", "_patterns")
    return join_groups(entries, texts, formula, "entries").withColumn(pattern, F.explode("_patterns")).drop("_patterns", "entries")
