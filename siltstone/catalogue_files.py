"""Queries that write files from the tables, one a group, and read them back with the readers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalogue import query, rounded
from .sources import formats, structures, writers
from .sources.tables import table as load
from .storage import cut, discard, scratch

#: Sites of a nation's suppliers in a cubic cell of 10; coordinates with three digits, so that every format holds them.
_SITES = """
    SELECT 'n' || s_nationkey AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS site,
        CASE s_suppkey % 3 WHEN 0 THEN 'Fe' WHEN 1 THEN 'O' ELSE 'Li' END AS element,
        (s_suppkey % 83) / 10.0 AS x, (s_suppkey % 7) * 1.25 AS y, s_nationkey / 8.0 AS z FROM supplier
"""
_ATOMS_SQL = f"SELECT name, site::INTEGER AS site, element, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM ({_SITES})"


def _sites(spark, d) -> DataFrame:
    key = F.col("s_suppkey")
    return load(spark, d, "supplier").select(
        F.concat(F.lit("n"), "s_nationkey").alias("name"), key.alias("site"),
        F.when(key % 3 == 0, "Fe").when(key % 3 == 1, "O").otherwise("Li").alias("element"),
        ((key % 83) / 10.0).alias("x"), ((key % 7) * 1.25).alias("y"), (F.col("s_nationkey") / 8.0).alias("z"),
    )


def _back(texts: DataFrame, read: Callable[[str], DataFrame], *columns: str) -> DataFrame:
    """Texts (name, value) as a file each, and what the reader makes of them; the files go once the rows are stored."""
    spark = texts.sparkSession
    folder = scratch(spark, "files")
    texts.repartition("name").write.partitionBy("name").text(folder)
    found = read(folder).withColumn("name", F.regexp_extract("path", "name=([^/]+)", 1)).select("name", *columns)
    found = cut(found)
    discard(spark, folder)
    return rounded(found)


def _text(sites: DataFrame, head: list[str | Column], line: Column, foot: list[str | Column] = ()) -> DataFrame:
    """name, value: head lines, a line a site in order, foot lines; `n` is the number of sites. Null lines are left out."""
    grouped = sites.groupBy("name").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("site", line.alias("line")))).alias("rows"))
    parts = [x if isinstance(x, Column) else F.lit(x) for x in head]
    return grouped.select("name", F.concat_ws("\n", *parts, F.transform("rows", lambda r: r["line"]), *map(F.lit, foot)).alias("value"))


_ATOM = ("site", "element", "x", "y", "z")


@query(_ATOMS_SQL)
def xyz_file(spark, d):
    folder = scratch(spark, "files")
    sites = _sites(spark, d).select(F.col("name").alias("path"), F.lit(0).alias("frame"), *_ATOM, F.col("name").alias("comment"))
    structures.write_xyz(sites, folder)
    found = cut(structures.read_xyz(spark, folder).select(F.col("comment").alias("name"), *_ATOM))
    discard(spark, folder)
    return rounded(found)


@query(_ATOMS_SQL)
def lammps_file(spark, d):
    head = ["ITEM: TIMESTEP", "0", "ITEM: NUMBER OF ATOMS", F.col("n").cast("string"), "ITEM: BOX BOUNDS pp pp pp", "0 10", "0 10", "0 10", "ITEM: ATOMS id element x y z"]
    texts = _text(_sites(spark, d), head, F.format_string("%d %s %.4f %.4f %.4f", *_ATOM))
    return _back(texts, lambda p: formats.read_atoms(spark, p, "lammps"), *_ATOM)


@query(_ATOMS_SQL)
def pdb_file(spark, d):
    # the columns of serial and residue numbers hold five and four digits; beyond, they begin anew
    serial, residue = F.col("site") % 100_000, F.col("site") % 10_000
    line = F.format_string("ATOM  %5d %-4s RES A%4d    %8.3f%8.3f%8.3f  1.00  0.00          %2s", serial, "element", residue, "x", "y", "z", "element")
    return _back(_text(_sites(spark, d), ["HEADER    structure"], line, ["END"]), lambda p: formats.read_atoms(spark, p, "pdb"), *_ATOM)


@query(_ATOMS_SQL)
def mol_file(spark, d):
    # a V2000 count has three digits; larger molecules are V3000
    large = F.col("n") > 999
    sites = _sites(spark, d)
    sites = sites.join(sites.groupBy("name").agg(F.count("*").alias("n")), "name")
    counts = F.when(large, "  0  0  0     0  0            999 V3000").otherwise(F.format_string("%3d  0  0  0  0  0  0  0  0  0999 V2000", "n"))
    opening = F.when(large, F.format_string("M  V30 BEGIN CTAB\nM  V30 COUNTS %d 0 0 0 0\nM  V30 BEGIN ATOM", "n"))
    closing = F.when(large, "M  V30 END ATOM\nM  V30 END CTAB")
    short = F.format_string("%10.4f%10.4f%10.4f %-3s 0  0", "x", "y", "z", "element")
    line = F.when(large, F.format_string("M  V30 %d %s %.4f %.4f %.4f 0", F.col("site") + 1, "element", "x", "y", "z")).otherwise(short)
    texts = _text(sites, [F.col("name"), "", "", counts, opening], line, [closing, "M  END"])
    return _back(texts, lambda p: formats.read_atoms(spark, p, "mol"), *_ATOM)


@query(_ATOMS_SQL)
def cif_file(spark, d):
    cell = [f"_cell_length_{k} 10.0" for k in "abc"] + [f"_cell_angle_{k} 90" for k in ("alpha", "beta", "gamma")]
    heads = [f"_atom_site_{k}" for k in ("label", "type_symbol", "fract_x", "fract_y", "fract_z")]
    line = F.format_string("%s%d %s %.5f %.5f %.5f", "element", "site", "element", F.col("x") / 10, F.col("y") / 10, F.col("z") / 10)
    return _back(_text(_sites(spark, d), [F.concat(F.lit("data_"), "name"), *cell, "loop_", *heads], line), lambda p: formats.read_atoms(spark, p, "cif"), *_ATOM)


@query(f"""
    WITH s AS ({_SITES}), o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY element, site) - 1 AS k FROM s)
    SELECT name, k::INTEGER AS site, element, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM o
""")
def poscar_file(spark, d):
    sites = _sites(spark, d).withColumnRenamed("name", "path")
    axes = F.explode(F.array(*[F.struct(F.lit(k).alias("axis"), *[F.lit(10.0 if k == i else 0.0).alias(c) for i, c in enumerate("xyz")]) for k in range(3)])).alias("v")
    cells = sites.select("path").distinct().select("path", axes).select("path", "v.*")
    texts = writers.poscar(sites, cells).select(F.col("path").alias("name"), "value")
    return _back(texts, lambda p: structures.read_poscar(spark, p), *_ATOM)


@query(f"""
    SELECT name, f::INTEGER AS frame, site::INTEGER AS site, 'Fe' AS element, ((s + 5 * f) % 80 / 10.0)::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z
    FROM (SELECT *, round(x * 10)::BIGINT AS s FROM ({_SITES})), range(2) r(f)
""")
def xdatcar_file(spark, d):
    sites = _sites(spark, d).withColumn("s", F.round(F.col("x") * 10).cast("long"))
    part = lambda f: F.format_string("%.5f %.5f %.5f", (F.col("s") + 5 * f) % 80 / 100.0, F.col("y") / 10, F.col("z") / 10)
    rows = lambda f: F.transform("rows", lambda r: r[f"line{f}"])
    grouped = sites.groupBy("name").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("site", part(0).alias("line0"), part(1).alias("line1")))).alias("rows"))
    head = [F.col("name"), *map(F.lit, ("1.0", "10 0 0", "0 10 0", "0 0 10", "Fe")), F.col("n").cast("string")]
    value = F.concat_ws("\n", *head, F.lit("Direct configuration= 1"), rows(0), F.lit("Direct configuration= 2"), rows(1))
    return _back(grouped.select("name", value.alias("value")), lambda p: formats.read_atoms(spark, p, "xdatcar"), "frame", *_ATOM)


_GRID = "SELECT 'g' || g AS name, c, (g * 100 + c * c % 17)::DOUBLE AS v FROM (SELECT DISTINCT p_size % 5 AS g FROM part), range(24) r(c)"


def _grids(spark, d) -> DataFrame:
    g = load(spark, d, "part").select((F.col("p_size") % 5).alias("g")).distinct()
    cells = g.withColumn("site", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return cells.select(F.concat(F.lit("g"), "g").alias("name"), "site", (F.col("g") * 100 + F.col("site") * F.col("site") % 17).cast("double").alias("v"))


@query(f"SELECT name, c % 4 AS i, c // 4 % 3 AS j, c // 12 AS k, v / 8 AS value FROM ({_GRID})")
def chgcar_file(spark, d):
    head = [F.col("name"), "1.0", "2 0 0", "0 2 0", "0 0 2", "Fe", "1", "Direct", "0 0 0", "", "4 3 2"]
    return _back(_text(_grids(spark, d), head, F.format_string("%.6f", "v")), lambda p: formats.read_grids(spark, p, "chgcar"), "i", "j", "k", "value")


@query(f"SELECT name, c // 6 AS i, c // 2 % 3 AS j, c % 2 AS k, v AS value FROM ({_GRID})")
def cube_file(spark, d):
    head = [F.col("name"), "cube", "1 0 0 0", "4 0.5 0 0", "3 0 0.5 0", "2 0 0 0.5", "26 0 0 0 0"]
    return _back(_text(_grids(spark, d), head, F.format_string("%.6f", "v")), lambda p: formats.read_grids(spark, p, "cube"), "i", "j", "k", "value")


@query("""
    WITH s AS (SELECT replace(p_brand, '#', '') AS name, p_size, round(sum(p_retailprice), 2) AS y FROM part GROUP BY 1, 2)
    SELECT name, (row_number() OVER (PARTITION BY name ORDER BY p_size) - 1)::INTEGER AS row, p_size::DOUBLE AS x, y::DOUBLE AS y FROM s
""")
def scan_file(spark, d):
    name = F.replace("p_brand", F.lit("#"), F.lit(""))
    scans = load(spark, d, "part").groupBy(name.alias("name"), F.col("p_size").alias("site")).agg(F.round(F.sum("p_retailprice"), 2).alias("y"))
    texts = _text(scans, ["# a scan", "x, y"], F.format_string("%d, %.2f", "site", "y"))
    return _back(texts, lambda p: structures.read_scans(spark, p), "row", "x", "y")


@query("""
    SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS value FROM nation
""")
def json_lines(spark, d):
    rows = load(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    made = writers.lines(rows, "json")
    return made.select(F.get_json_object("value", "$.n_nationkey").cast(rows.schema["n_nationkey"].dataType).alias("n_nationkey"), "value")
