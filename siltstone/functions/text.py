"""Text column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def strip_html(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def is_html(c: Column) -> Column:
    """Does the text hold a tag or an entity?"""
    return c.rlike(r"<[a-zA-Z/][^>]*>|&[a-zA-Z]+;|&#\d+;")


def parse_numeric(c: Column) -> Column:
    """The finite number of a text, without markup and uncertainty ("1.2 ± 0.1", "1.2 +- 0.1", "1.2(3)"), else null."""
    plain = F.trim(F.regexp_replace(strip_html(c), "−", "-"))
    plain = F.trim(F.regexp_replace(plain, r"\s*(±|\+-|\+/-).*$|\(\d+\)$", ""))
    return F.when(plain.rlike(NUMBER), plain.try_cast("double"))


def contains(c: Column, query: str) -> Column:
    """Case-insensitive substring test."""
    return F.contains(F.lower(c.cast("string")), F.lit(query.lower()))


def fuzzy(c: Column, query: str) -> Column:
    """Do the query's characters occur in order, whatever their case?"""
    escaped = [("\\" + x) if x in r"\.^$|?*+()[]{}" else x for x in query.lower()]
    return F.lower(c.cast("string")).rlike(".*".join(escaped))


def natural_key(c: Column) -> Column:
    """A sort key in which runs of digits compare as numbers, whatever the case."""
    padded = F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)")), lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(x))
    return F.array_join(padded, "")


def property_key(c: Column) -> Column:
    """Lower case without tags, brackets as blanks; the aliases of the maximal force as one."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(strip_html(F.lower(c)), r"[\[\](){}_]", " "), r"\s+", " "))
    return F.when(plain.isin("fmax", "f max", "force_max"), "force max").otherwise(plain)


#: Superscript digits and signs, and their plain forms.
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻", "0123456789+-"
#: Subscript digits.
SUBSCRIPTS = "₀₁₂₃₄₅₆₇₈₉"


def normalize_number(c: Column) -> Column:
    """A number's text with plain minus signs, and powers of ten (1.5×10⁻³, 2·10^4) as an exponent."""
    plain = F.translate(c, "−–", "--")
    power = F.translate(F.regexp_extract(plain, r"[×x·*]\s*10\^?([0-9⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻+-]+)\s*$", 1), *SUPERSCRIPTS)
    return F.when(power != "", F.concat(F.trim(F.regexp_replace(plain, r"\s*[×x·*]\s*10.*$", "")), F.lit("e"), power)).otherwise(F.trim(plain))


def normalize_formula(c: Column) -> Column:
    """A formula without white space, with plain subscripts, a superscript run as ^ and plain signs, and one kind of dot and minus."""
    text = F.translate(F.regexp_replace(c, r"\s+", ""), SUBSCRIPTS + "⋅•−", "0123456789··-")
    marked = F.regexp_replace(text, f"([{SUPERSCRIPTS[0]}]+)", "^$1")
    return F.translate(marked, *SUPERSCRIPTS)


def charges(c: Column) -> Column:
    """Elements with their oxidation states, as an array of structs (element, state), of texts like Fe3+ O2- or Na+."""
    found = F.regexp_extract_all(normalize_formula(c), F.lit(r"[A-Z][a-z]?\^?\d*[+-]"), 0)
    sign = lambda x: F.when(x.endswith("-"), -1).otherwise(1)
    size = lambda x: F.regexp_extract(x, r"(\d+)[+-]$", 1)
    state = lambda x: sign(x) * F.when(size(x) == "", 1).otherwise(size(x).cast("int"))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^([A-Z][a-z]?)", 1).alias("element"), state(x).alias("state")))


def scaling(c: Column) -> Column:
    """A supercell's three factors from `2x2x1`, `2×2×1` or `2`; null for other texts and for factors of 0."""
    parts = F.split(F.regexp_replace(F.trim(c), r"\s*[x×,*]\s*", "x"), "x")
    valid = F.trim(c).rlike(r"^[1-9]\d*(\s*[x×,*]\s*[1-9]\d*\s*[x×,*]\s*[1-9]\d*)?$")
    return F.when(valid, F.transform(F.when(F.size(parts) == 1, F.array_repeat(parts[0], 3)).otherwise(parts), lambda x: x.cast("int")))
