"""More readers: LAMMPS dumps, XDATCAR, CIF, PDB, MOL, volumetric grids."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .structures import ATOMS, _files

GRIDS = "path string, block int, i long, j long, k long, value double"


def parse_lammps_dump(text: str) -> Iterator[tuple]:
    """(frame, site, element, x, y, z, step) of all frames of a LAMMPS dump; types stand for elements where none are named."""
    for frame, part in enumerate(text.split("ITEM: TIMESTEP")[1:]):
        lines = part.strip().splitlines()
        step = lines[0].strip()
        count = int(lines[next(k for k, x in enumerate(lines) if "NUMBER OF ATOMS" in x) + 1])
        box_at = next(k for k, x in enumerate(lines) if "BOX BOUNDS" in x)
        box = np.array([[float(v) for v in lines[box_at + k].split()[:2]] for k in (1, 2, 3)])
        at = next(k for k, x in enumerate(lines) if x.startswith("ITEM: ATOMS"))
        names = lines[at].split()[2:]
        scaled = "xs" in names
        where = [names.index(f"{c}s" if scaled else c if c in names else f"{c}u") for c in "xyz"]
        kind = names.index("element") if "element" in names else names.index("type")
        rows = [x.split() for x in lines[at + 1 : at + 1 + count]]
        if len(rows) < count:
            raise ValueError(f"frame {frame} ends early")
        if "id" in names:
            rows.sort(key=lambda r: int(r[names.index("id")]))
        for site, r in enumerate(rows):
            place = np.array([float(r[k]) for k in where])
            place = box[:, 0] + place * (box[:, 1] - box[:, 0]) if scaled else place
            yield frame, site, r[kind], *place.tolist(), step


def parse_xdatcar(text: str) -> Iterator[tuple]:
    """(frame, site, element, x, y, z, title) of the configurations of an XDATCAR with a constant cell."""
    lines = text.splitlines()
    lattice = np.array([[float(v) for v in lines[k].split()[:3]] for k in (2, 3, 4)]) * float(lines[1])
    names = [s for s, n in zip(lines[5].split(), lines[6].split(), strict=True) for _ in range(int(n))]
    heads = [k for k, x in enumerate(lines) if "configuration" in x.lower()]
    for frame, head in enumerate(heads):
        for site, name in enumerate(names):
            place = np.array([float(v) for v in lines[head + 1 + site].split()[:3]]) @ lattice
            yield frame, site, name, *place.tolist(), lines[0].strip()


def uncertain(text: str) -> float:
    """A number with its uncertainty in brackets, as CIF files write it."""
    return float(re.sub(r"\(.*\)$", "", text))


def parse_cif(text: str) -> Iterator[tuple]:
    """(0, site, element, x, y, z, block name) of the listed atoms, in Cartesian coordinates with a along x."""
    cell = {k: uncertain(v) for k, v in re.findall(r"_cell_(?:length|angle)_(a|b|c|alpha|beta|gamma)\s+(\S+)", text)}
    a, b, c = (cell[k] for k in "abc")
    ca, cb, cg = (np.cos(np.radians(cell[k])) for k in ("alpha", "beta", "gamma"))
    sg = np.sqrt(1 - cg**2)
    cy = (ca - cb * cg) / sg
    lattice = np.array([[a, 0, 0], [b * cg, b * sg, 0], [c * cb, c * cy, c * np.sqrt(1 - cb**2 - cy**2)]])
    name = re.search(r"^data_(\S*)", text, re.M)
    loop = re.search(r"loop_\s*\n((?:\s*_atom_site_\w+\s*\n)+)((?:(?!\s*(?:loop_|_|#|data_)).*\S.*\n?)+)", text)
    if not loop:
        raise ValueError("no atoms")
    heads = [x.strip().removeprefix("_atom_site_") for x in loop[1].split()]
    for site, line in enumerate(x for x in loop[2].splitlines() if x.strip()):
        row = dict(zip(heads, line.split(), strict=False))
        symbol = re.match(r"[A-Z][a-z]?", row.get("type_symbol") or row["label"])[0]
        place = np.array([uncertain(row[f"fract_{k}"]) for k in "xyz"]) @ lattice
        yield 0, site, symbol, *place.tolist(), name[1] if name else ""


def parse_pdb(text: str) -> Iterator[tuple]:
    """(model, site, element, x, y, z, residue) of ATOM and HETATM records."""
    model = site = 0
    for line in text.splitlines():
        if line.startswith("ENDMDL"):
            model, site = model + 1, 0
        elif line.startswith(("ATOM", "HETATM")):
            symbol = line[76:78].strip().capitalize() or re.sub(r"[^A-Za-z]", "", line[12:14]).capitalize()
            yield model, site, symbol, float(line[30:38]), float(line[38:46]), float(line[46:54]), line[17:20].strip()
            site += 1


def parse_mol(text: str) -> Iterator[tuple]:
    """(record, site, element, x, y, z, title) of the V2000 and V3000 records of a MOL or SDF file."""
    for record, part in enumerate(x for x in text.split("$$$$") if x.strip()):
        lines = part.lstrip("\n").splitlines() if record else part.splitlines()
        at = next(k for k, x in enumerate(lines) if x.rstrip().endswith(("V2000", "V3000")))
        if lines[at].rstrip().endswith("V3000"):
            tagged = [x.strip()[6:].strip() for x in lines[at + 1 :] if x.strip().startswith("M  V30")]
            if any(x.endswith("-") for x in tagged):
                raise ValueError("lines that go on in the next are not read")
            rows = [x.split()[1:5] for x in tagged[tagged.index("BEGIN ATOM") + 1 : tagged.index("END ATOM")]]
        else:
            rows = [(*r[3:], *r[:3]) for r in (lines[at + 1 + site].split()[:4] for site in range(int(lines[at][:3])))]
        for site, (symbol, x, y, z) in enumerate(rows):
            yield record, site, symbol, float(x), float(y), float(z), lines[0].strip()


def parse_chgcar(text: str) -> Iterator[tuple]:
    """(block, i, j, k, value) of the grids of a CHGCAR file: x runs fastest, values are divided by the cell's volume."""
    lines = text.splitlines()
    volume = abs(np.linalg.det(np.array([[float(v) for v in lines[k].split()[:3]] for k in (2, 3, 4)]) * float(lines[1])))
    counts_at = 6 if not lines[5].split()[0].isdigit() else 5
    at = counts_at + 2 + sum(map(int, lines[counts_at].split()))
    block = 0
    while at < len(lines):
        head = lines[at].split()
        at += 1
        if len(head) != 3 or not all(x.isdigit() for x in head):
            continue
        dims = tuple(map(int, head))
        values: list[float] = []
        while len(values) < np.prod(dims):
            values += map(float, lines[at].split())
            at += 1
        yield from _grid(block, np.array(values).reshape(dims[::-1]).T / volume)
        block += 1


def parse_cube(text: str) -> Iterator[tuple]:
    """(0, i, j, k, value) of a Gaussian cube file, in which z runs fastest."""
    lines = text.splitlines()
    atoms = abs(int(lines[2].split()[0]))
    dims = tuple(abs(int(lines[k].split()[0])) for k in (3, 4, 5))
    values = np.array(" ".join(lines[6 + atoms :]).split(), float)
    yield from _grid(0, values[-np.prod(dims) :].reshape(dims))


def _grid(block: int, values: np.ndarray) -> Iterator[tuple]:
    for (i, j, k), v in np.ndenumerate(values):
        yield block, i, j, k, float(v)


#: The reader of each format of atoms.
PARSERS = {"lammps": parse_lammps_dump, "xdatcar": parse_xdatcar, "cif": parse_cif, "pdb": parse_pdb, "mol": parse_mol}


def read_atoms(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Atoms of all files below the path: lammps, xdatcar, cif, pdb or mol."""
    return _files(spark, path, PARSERS[kind], ATOMS)


def read_grids(spark: SparkSession, path: str, kind: str = "chgcar") -> DataFrame:
    """Grid points of volumetric files: chgcar or cube."""
    return _files(spark, path, {"chgcar": parse_chgcar, "cube": parse_cube}[kind], GRIDS)
