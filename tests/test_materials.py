"""Formats, graphs, spectra, phases and volumes on small made-up inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import crystal, graph, phases, spectral, volume
from siltstone.sources import formats, structures, writers

LAMMPS = """ITEM: TIMESTEP
0
ITEM: NUMBER OF ATOMS
2
ITEM: BOX BOUNDS pp pp pp
0 4
0 4
0 4
ITEM: ATOMS id type xs ys zs
2 1 0.5 0.5 0.5
1 2 0 0 0.25
ITEM: TIMESTEP
10
ITEM: NUMBER OF ATOMS
1
ITEM: BOX BOUNDS pp pp pp
0 4
0 4
0 4
ITEM: ATOMS id element x y z
1 He 1 2 3
"""
CIF = """data_salt
_cell_length_a 4.0(1)
_cell_length_b 4.0
_cell_length_c 4.0
_cell_angle_alpha 90
_cell_angle_beta 90
_cell_angle_gamma 90
loop_
_atom_site_label
_atom_site_type_symbol
_atom_site_fract_x
_atom_site_fract_y
_atom_site_fract_z
Na1 Na+ 0 0 0
Cl1 Cl- 0.5(2) 0.5 0.5

"""
XDATCAR = "md\n1.0\n2 0 0\n0 2 0\n0 0 2\nAr\n1\nDirect configuration= 1\n0 0 0\nDirect configuration= 2\n0.5 0 0\n"
PDB = "MODEL 1\nATOM      1  CA  GLY A   1      11.104   6.134  -6.504  1.00  0.00           C\nENDMDL\nMODEL 2\nHETATM    1  O   HOH A   2       1.000   2.000   3.000  1.00  0.00           O\nENDMDL\n"
MOL = "water\n  x\n\n  1  0  0  0  0  0            999 V2000\n    0.0000    0.1000    0.2000 O   0  0\nM  END\n"
CHGCAR = "c\n1.0\n2 0 0\n0 2 0\n0 0 2\nH\n1\nDirect\n0 0 0\n\n2 1 2\n8 16 24 32\n"
CUBE = "t\nt\n 1 0 0 0\n 1 1 0 0\n 2 0 1 0\n 2 0 0 1\n 1 1 0 0 0\n1 2\n3 4\n"


@pytest.mark.parametrize(
    ("kind", "text", "atoms"),
    [
        ("lammps", LAMMPS, [(0, 0, "2", 0.0, 0.0, 1.0), (0, 1, "1", 2.0, 2.0, 2.0), (1, 0, "He", 1.0, 2.0, 3.0)]),
        ("cif", CIF, [(0, 0, "Na", 0.0, 0.0, 0.0), (0, 1, "Cl", 2.0, 2.0, 2.0)]),
        ("xdatcar", XDATCAR, [(0, 0, "Ar", 0.0, 0.0, 0.0), (1, 0, "Ar", 1.0, 0.0, 0.0)]),
        ("pdb", PDB, [(0, 0, "C", 11.104, 6.134, -6.504), (1, 0, "O", 1.0, 2.0, 3.0)]),
        ("mol", MOL, [(0, 0, "O", 0.0, 0.1, 0.2)]),
    ],
)
def test_atoms(spark, tmp_path, kind, text, atoms):
    (tmp_path / "file").write_text(text)
    rows = formats.read_atoms(spark, str(tmp_path), kind).orderBy("frame", "site").collect()
    assert [(r.frame, r.site, r.element) for r in rows] == [a[:3] for a in atoms]
    assert np.allclose([(r.x, r.y, r.z) for r in rows], [a[3:] for a in atoms])


@pytest.mark.parametrize(("kind", "text", "values"), [("chgcar", CHGCAR, {(0, 0, 0): 1, (1, 0, 0): 2, (0, 0, 1): 3, (1, 0, 1): 4}), ("cube", CUBE, {(0, 0, 0): 1, (0, 0, 1): 2, (0, 1, 0): 3, (0, 1, 1): 4})])
def test_grids(spark, tmp_path, kind, text, values):
    (tmp_path / "file").write_text(text)
    assert {(r.i, r.j, r.k): round(r.value, 9) for r in formats.read_grids(spark, str(tmp_path), kind).collect()} == values


def test_poscar_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/POSCAR").write_text("t\n1.0\n2 0 0\n0 3 0\n0 0 4\nCl Na\n2 1\nCartesian\n0 0 0\n1 0 0\n0 1 2\n")
    atoms, cells = structures.read_poscar(spark, str(tmp_path / "in")), structures.read_lattices(spark, str(tmp_path / "in"))
    writers.poscar(atoms, cells).select("value").write.text(str(tmp_path / "out"))
    again = structures.read_poscar(spark, str(tmp_path / "out"))
    key = lambda df: sorted((r.element, r.x, r.y, r.z) for r in df.collect())
    assert key(again) == key(atoms)


def test_text_fields(spark):
    df = spark.createDataFrame([(1, 'a"b,c', None), (2, "x\ty\nz", 0.5)], "i int, t string, v double")
    assert [r.value for r in writers.lines(df, "csv").collect()] == ['1,"a""b,c",', '2,"x\ty\nz",0.5']
    assert [r.value for r in writers.lines(df, "tsv").collect()][1] == "2\tx y z\t0.5"
    assert [r.value for r in writers.lines(df, "json").collect()][1] == '{"i":2,"t":"x\\ty\\nz","v":0.5}'
    assert writers.header(["a", "b"], "markdown")[1] == "| --- | --- |"


@pytest.mark.parametrize("rows", [[("a", None), ("a", None)], [("a", "z")], [("a", "b"), ("b", "a")]])
def test_bad_parents(spark, rows):
    with pytest.raises(ValueError):
        graph.levels(spark.createDataFrame(rows, "name string, parent string"), "name", "parent")


def test_fragments_of_a_long_chain(spark):
    sites = spark.range(40).select(F.col("id").alias("site"))
    bonds = sites.where("site < 29 and site <> 9").select(F.col("site").alias("a"), (F.col("site") + 1).alias("b"))
    found = {r.site: r.fragment for r in graph.fragments(bonds, sites).collect()}
    assert all(found[k] == (0 if k < 10 else 10 if k < 30 else k) for k in range(40))


def test_periodogram_finds_a_tone(spark):
    df = spark.createDataFrame([("s", k, float(np.sin(2 * np.pi * 0.125 * k))) for k in range(256)], "s string, k int, v double")
    top = spectral.periodogram(df, "s", ["k"], "v", 1.0).orderBy(F.desc("power")).first()
    assert abs(top.frequency - 0.125) < 2e-3
    weights = [r.w for r in spark.range(5).select(spectral.window(F.col("id"), F.lit(5)).alias("w")).collect()]
    assert weights == pytest.approx([0, 0.5, 1, 0.5, 0])


def test_infrared(spark):
    z = {f"z{a}{b}": float(a == b) for a in (1, 2, 3) for b in (1, 2, 3)}
    rows = [(0, 1.0, 1.0, 0.0, 0.0, *z.values()), (0, 4.0, 1.0, 0.0, 0.0, *z.values())]
    df = spark.createDataFrame(rows, "mode int, mass double, ex double, ey double, ez double, " + ", ".join(f"{k} double" for k in z))
    assert spectral.infrared_intensity(df, "mode").first().intensity == pytest.approx(2.25)


def test_density_and_cells(spark):
    sites = spark.createDataFrame([(1, "Na"), (1, "Cl")], "cell int, element string")
    masses = spark.createDataFrame([("Na", 22.99), ("Cl", 35.45)], "element string, mass double")
    volumes = spark.createDataFrame([(1, 44.87)], "cell int, volume double")
    assert crystal.density(sites, masses, volumes, "cell").first().density == pytest.approx(2.163, abs=2e-3)


def test_gas_terms_touch_unary_entries_only(spark):
    entries = spark.createDataFrame([("o", 1, "O", -4.0), ("fe", 1, "Fe", -8.0), ("feo", 2, None, -7.0)], "id string, arity int, unary_element string, energy_per_atom double")
    gases = spark.createDataFrame([("O", True, 0.0, 0.002, 1.0, 2.0), ("Fe", False, 0.0, 1.0, 1.0, 1.0)], "element string, enabled boolean, enthalpy double, entropy double, pressure double, atoms double")
    got = {r.id: r.energy_per_atom for r in phases.gas_corrected(entries, gases, 1000.0).collect()}
    assert got == {"o": -5.0, "fe": -8.0, "feo": -7.0}


def test_expressions(spark):
    amounts = F.create_map(F.lit("Fe"), F.lit(2.0), F.lit("O"), F.lit(3.0), F.lit("H"), F.lit(0.0))
    row = spark.range(1).select(
        phases.energy_per_atom(F.lit(-9.0), F.lit(-1.0), amounts).alias("e"),
        phases.arity(amounts).alias("n"),
        phases.stability(F.lit(0.0), F.lit(True)).alias("out"),
        phases.stability(F.lit(1e-9), F.lit(False)).alias("on"),
        phases.system_name(F.lit("O - Fe-O")).alias("name"),
    ).first()
    assert (row.e, row.n, row.out, row.on, row.name) == (-2.0, 2, False, True, "Fe-O")


def test_finite_grids_clamp(spark):
    grid = spark.createDataFrame([(0, i, j, k, float(i)) for i in range(3) for j in range(2) for k in range(2)], "vol int, i long, j long, k long, value double")
    points = spark.createDataFrame([(0, 1, 0.25, 0.5, 0.5), (0, 2, 1.0, 1.0, 1.0), (0, 3, 9.0, 0.0, 0.0)], "vol int, p int, u double, v double, w double")
    assert {r.p: r.value for r in volume.sample(grid, points, "vol", "p", (3, 2, 2), periodic=False).collect()} == {1: 0.5, 2: 2.0, 3: 2.0}
    assert volume.plane(grid, "i", 1).count() == 4


def test_regions_over_strips(spark):
    """Points outside all regions stay; long and narrow regions, and points without a place."""
    box = lambda a, b, c, d: [(a, c), (b, c), (b, d), (a, d)]
    regions = spark.createDataFrame([("wide", 0, box(0.0, 1000.0, 0.0, 1.0)), ("thin", 1, box(10.0, 10.001, 0.0, 1.0)), ("line", 2, [(0.0, 0.0), (1.0, 1.0)])], "region string, number int, vertices array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(1, 500.0, 0.5), (2, 10.0005, 0.5), (3, 500.0, 2.0), (4, -5.0, 0.5), (5, None, 0.5), (6, 5e9, 0.5)], "id long, x double, y double")
    got = {r.id: r.region for r in phases.phase_at(points, regions, "id").collect()}
    assert got == {1: "wide", 2: "thin", 3: None, 4: None, 5: None, 6: None}
    assert {r.region for r in phases.phase_at(points, regions.limit(0), "id").collect()} == {None}
