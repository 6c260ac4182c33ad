"""Isosurfaces: closed surfaces, seams of blocks, measures of known bodies."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import mesh


def grid(spark, field, dims, key="g"):
    at = np.indices(dims).reshape(3, -1).T
    return spark.createDataFrame([(key, *map(int, p), float(field(*p))) for p in at], f"key string, i long, j long, k long, value double")


def sphere(x, y, z, r=4.3, c=6.1):
    return math.dist((x, y, z), (c, c, c)) - r


def torus(x, y, z):
    return (math.hypot(x - 8, y - 8) - 4.6) ** 2 + (z - 8) ** 2 - 2.4**2


def test_every_case_closes():
    """Each crossed edge of a cell is the end of one side that is not shared, in each of its two faces at most."""
    for case, found in enumerate(mesh.cell_triangles()):
        crossed = {e for e, (axis, c) in enumerate(mesh.EDGES) if (case >> c ^ case >> (c | 1 << axis)) & 1}
        assert {e for t in found for e in t} == crossed
        sides = [(t[k - 1], t[k]) for t in found for k in range(3)]
        assert len(set(sides)) == len(sides)  # one winding
        outer = [s for s in sides if s[::-1] not in sides]
        assert sorted(a for a, _ in outer) == sorted(b for _, b in outer) == sorted(crossed)


@pytest.mark.parametrize("block", [32, 5, 3])
def test_closed_surfaces_whatever_the_blocks(spark, block):
    lattice = np.diag([12.0, 12.0, 12.0])
    row = mesh.measures(mesh.isosurface(grid(spark, sphere, (13, 13, 13)), "key", (13, 13, 13), 0.0, lattice, periodic=False, block=block), "key").first()
    assert (row.euler, row.open) == (2, 0)
    assert row.volume == pytest.approx(4 / 3 * math.pi * 4.3**3, rel=0.05) and row.area == pytest.approx(4 * math.pi * 4.3**2, rel=0.05)
    row = mesh.measures(mesh.isosurface(grid(spark, torus, (17, 17, 17)), "key", (17, 17, 17), 0.0, periodic=False, block=block), "key").first()
    assert (row.euler, row.open) == (0, 0)


def test_blocks_give_the_same_vertices_and_triangles(spark):
    rng = np.random.default_rng(4)
    noise = rng.normal(size=(9, 7, 8))
    table = grid(spark, lambda *p: noise[p], (9, 7, 8))
    found = []
    for block in (32, 4, 3):
        surface = mesh.isosurface(table, "key", (9, 7, 8), 0.1, ((2, 0, 0), (0.3, 3, 0), (0, 0.2, 4)), block=block)
        points = {r.edge: tuple(round(v, 9) for v in r[2:]) for r in mesh.vertices(surface, "key").collect()}
        found.append((points, sorted(tuple(r.corners) for r in mesh.triangles(surface, "key").collect())))
        assert mesh.vertices(surface, "key").count() == len(points)
        assert {e for t in found[-1][1] for e in t} == set(points)
    assert found[0] == found[1] == found[2]


def test_normals_point_downwards(spark):
    for periodic in (True, False):
        dims, n = (16, 16, 16), 16 if periodic else 15
        rows = mesh.vertices(mesh.isosurface(grid(spark, lambda x, y, z: math.dist((x, y, z), (8, 8, 8)), dims), "key", dims, 5.2, periodic=periodic, centred=False), "key").collect()
        for r in rows:
            out = np.array([r.x, r.y, r.z]) * n - 8
            assert np.dot(out, [r.nx, r.ny, r.nz]) < -0.9 * np.linalg.norm(out)


def test_periodic_surfaces_end_at_the_sides(spark):
    """A plane wave: two sheets, flat, from side to side."""
    surface = mesh.isosurface(grid(spark, lambda x, y, z: math.cos(2 * math.pi * (x + 0.25) / 8), (8, 6, 4)), "key", (8, 6, 4), 0.0, centred=False)
    row = mesh.measures(surface, "key").first()
    assert row.area == pytest.approx(2) and row.euler == 2 and row.open == 2 * 2 * (6 + 4)


def test_missing_values_and_small_grids(spark):
    full = grid(spark, sphere, (13, 13, 13))
    holes = full.where("NOT (i = 6 AND j = 6 AND k = 6)").withColumn("value", F.when(F.expr("i = 6 AND j = 6 AND k = 7"), None).when(F.expr("i = 5 AND j = 6 AND k = 6"), float("nan")).otherwise(F.col("value")))
    row = mesh.measures(mesh.isosurface(holes, "key", (13, 13, 13), 0.0, periodic=False), "key").first()
    assert row.open == 0 and row.euler == 4  # the sphere, and a surface around what is missing
    assert mesh.isosurface(full, "key", (13, 13, 1), 0.0).count() == mesh.isosurface(full.limit(0), "key", (13, 13, 13), 0.0).count() == 0
    assert mesh.isosurface(full, "key", (13, 13, 13), F.lit(None)).count() == 0
    two = mesh.measures(mesh.isosurface(full.unionByName(full.withColumn("key", F.lit("h"))), "key", (13, 13, 13), F.when(F.col("key") == "h", 1.0).otherwise(0.0), periodic=False), "key")
    assert {r.key: r.euler for r in two.collect()} == {"g": 2, "h": 2} and len({r.volume for r in two.collect()}) == 2
