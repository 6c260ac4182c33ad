"""Readers of structure, trajectory and scan files, and a writer. Files are read whole by Spark and parsed in tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATOMS = "path string, frame int, site int, element string, x double, y double, z double, comment string"
LATTICES = "path string, title string, axis int, x double, y double, z double"
SCANS = "path string, row int, x double, y double"


def _files(spark: SparkSession, path: str, parse: Callable[[str], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of all files below the path, with the file's path in front; a file that can't be parsed raises."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, text in zip(batch["path"], batch["value"], strict=True):
                yield pd.DataFrame([(name, *row) for row in parse(text)], columns=names)

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.mapInPandas(run, schema)


def parse_xyz(text: str) -> Iterator[tuple]:
    """(frame, site, element, x, y, z, comment) of the frames of an XYZ file."""
    lines, at, frame = text.splitlines(), 0, 0
    while at < len(lines):
        if not lines[at].strip():
            at += 1
            continue
        count = int(lines[at])
        if at + 1 + count >= len(lines) + (count == 0):
            raise ValueError(f"frame {frame} ends early")
        comment = lines[at + 1].strip()
        for site in range(count):
            element, x, y, z, *_ = lines[at + 2 + site].split()
            yield frame, site, re.sub(r"\d+$", "", element), float(x), float(y), float(z), comment
        at, frame = at + 2 + count, frame + 1


def parse_poscar(text: str) -> tuple[str, np.ndarray, list[tuple[str, float, float, float]]]:
    """(title, lattice rows, (element, x, y, z) in Cartesian coordinates) of a POSCAR file."""
    lines = text.splitlines()
    title, scale = lines[0].strip(), float(lines[1].split()[0])
    lattice = np.array([[float(x) for x in lines[k].split()[:3]] for k in (2, 3, 4)])
    lattice = lattice * (scale if scale > 0 else (-scale / abs(np.linalg.det(lattice))) ** (1 / 3))
    at = 5
    symbols = lines[at].split()
    if symbols[0].isdigit():
        symbols = title.split()
    else:
        at += 1
    counts = [int(x) for x in lines[at].split()]
    at += 1
    if lines[at].strip()[:1] in "sS":
        at += 1
    direct = lines[at].strip()[:1] not in ("c", "C", "k", "K")
    names = [s for s, n in zip(symbols, counts, strict=False) for _ in range(n)]
    found = []
    for k, name in enumerate(names, at + 1):
        place = np.array([float(x) for x in lines[k].split()[:3]])
        place = place @ lattice if direct else place * (scale if scale > 0 else 1)
        found.append((name, *place.tolist()))
    return title, lattice, found


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of all frames of XYZ files."""
    return _files(spark, path, parse_xyz, ATOMS)


def read_poscar(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of POSCAR files as one frame each."""

    def rows(text: str) -> Iterator[tuple]:
        title, _, atoms = parse_poscar(text)
        return ((0, k, *atom, title) for k, atom in enumerate(atoms))

    return _files(spark, path, rows, ATOMS)


def read_lattices(spark: SparkSession, path: str) -> DataFrame:
    """The lattice vectors of POSCAR files, a row an axis."""

    def rows(text: str) -> Iterator[tuple]:
        title, lattice, _ = parse_poscar(text)
        return ((title, k, *axis) for k, axis in enumerate(lattice.tolist()))

    return _files(spark, path, rows, LATTICES)


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    """x and y of two-column scan files (blanks, commas, semicolons or tabs between; `#`, `!` and text lines are left out)."""

    def rows(text: str) -> Iterator[tuple]:
        k = 0
        for line in text.splitlines():
            parts = re.split(r"[\s,;]+", line.strip())
            try:
                x, y = float(parts[0]), float(parts[1])
            except (ValueError, IndexError):
                continue
            yield k, x, y
            k += 1

    return _files(spark, path, rows, SCANS)


def write_xyz(atoms: DataFrame, path: str) -> None:
    """One XYZ text row a frame, written by Spark; columns path, frame, site, element, x, y, z, comment."""
    line = F.format_string("%s %.10f %.10f %.10f", "element", "x", "y", "z")
    frames = atoms.groupBy("path", "frame").agg(F.count("*").alias("n"), F.first("comment").alias("comment"), F.array_sort(F.collect_list(F.struct("site", line.alias("line")))).alias("lines"))
    text = F.concat_ws("\n", F.col("n").cast("string"), F.coalesce("comment", F.lit("")), F.transform("lines", lambda x: x["line"]))
    frames.select(text.alias("value")).write.mode("overwrite").text(path)
