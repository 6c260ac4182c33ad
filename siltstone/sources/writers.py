"""Writers: rows as delimited, Markdown, LaTeX and JSON text; structures as POSCAR."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_field(c: Column) -> Column:
    """A field in quotes where it holds a comma, a quote or a line end; null as empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def tsv_field(c: Column) -> Column:
    """A field with its tabs and line ends as one blank."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\t\r\n]+", " ")


def markdown_field(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\|", r"\\|"), r"[\r\n]+", " ")


def latex_field(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"([&%$#_{}])", r"\\$1")


def lines(df: DataFrame, kind: str) -> DataFrame:
    """One text row (`value`) a row: csv, tsv, markdown, latex or json."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    made = {
        "csv": lambda: F.concat_ws(",", *map(csv_field, columns)),
        "tsv": lambda: F.concat_ws("\t", *map(tsv_field, columns)),
        "markdown": lambda: F.concat(F.lit("| "), F.concat_ws(" | ", *map(markdown_field, columns)), F.lit(" |")),
        "latex": lambda: F.concat(F.concat_ws(" & ", *map(latex_field, columns)), F.lit(r" \\")),
        "json": lambda: F.to_json(F.struct(*columns)),
    }[kind]
    return df.select(made().alias("value"))


def header(columns: list[str], kind: str) -> list[str]:
    """The lines above the rows."""
    if kind == "markdown":
        return [f"| {' | '.join(columns)} |", f"|{'|'.join(' --- ' for _ in columns)}|"]
    if kind == "latex":
        return [rf"\begin{{tabular}}{{{'l' * len(columns)}}}", r"\toprule", " & ".join(columns) + r" \\", r"\midrule"]
    return [] if kind == "json" else [("," if kind == "csv" else "\t").join(columns)]


def write(df: DataFrame, path: str, kind: str = "csv") -> None:
    """The rows as text files, written by the tasks; header() has the lines to put above."""
    lines(df, kind).write.mode("overwrite").text(path)


def poscar(atoms: DataFrame, lattices: DataFrame) -> DataFrame:
    """path, value: POSCAR text in Cartesian coordinates of atoms (path, site, element, x, y, z) and lattices (path, axis, x, y, z)."""
    place = F.format_string("%.10f %.10f %.10f", "x", "y", "z")
    cell = lattices.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("axis", place.alias("line")))).alias("cell"))
    kinds = atoms.groupBy("path", "element").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("site", place.alias("line")))).alias("lines"))
    body = kinds.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("element", "n", "lines"))).alias("kinds"))
    text = F.concat_ws(
        "\n",
        F.lit("structure"),
        F.lit("1.0"),
        F.transform("cell", lambda x: x["line"]),
        F.array_join(F.transform("kinds", lambda x: x["element"]), " "),
        F.array_join(F.transform("kinds", lambda x: x["n"].cast("string")), " "),
        F.lit("Cartesian"),
        F.flatten(F.transform("kinds", lambda x: F.transform(x["lines"], lambda y: y["line"]))),
    )
    return body.join(cell, "path").select("path", text.alias("value"))
