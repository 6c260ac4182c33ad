"""Natural cubic splines by blocks, saddles, classes of local structure."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import neighbours, pairs, splines

SCHEMA = "path string, x double, y double"


def plain_slopes(x, y):
    """By a dense system of the curvatures."""
    h, n = np.diff(x), len(x)
    a, b = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, b)
    s = np.diff(y) / h
    return np.append(s - h * (2 * m[:-1] + m[1:]) / 6, s[-1] + h[-1] * (m[-2] + 2 * m[-1]) / 6)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 4096])
def test_slopes_whatever_the_blocks(spark, block):
    rng = np.random.default_rng(3)
    paths = {f"p{n}": (np.cumsum(rng.random(n) + 0.05), rng.normal(size=n)) for n in (1, 2, 3, 4, 8, 15, 40)}
    rows = [(k, float(a), float(b)) for k, (x, y) in paths.items() for a, b in zip(x, y, strict=True)]
    rows += [("p8", None, 1.0), ("p8", 1.0, float("nan")), (None, 1.0, 1.0), ("p15", float(paths["p15"][0][4]), 99.0)]
    curve = splines.natural_cubic(spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("clash")), "path", "x", "y", block)
    got = {}
    for r in curve.orderBy("path", "x").collect():
        got.setdefault(r.path, []).append(r)
    assert {k: len(v) for k, v in got.items()} == {k: len(x) for k, (x, _) in paths.items()}
    assert got["p1"][0].slope is None
    tops = {r.path: r for r in splines.saddles(curve, "path", "x", "y").collect()}
    for k, (x, y) in paths.items():
        if len(x) > 1:
            assert [r.slope for r in got[k]] == pytest.approx(plain_slopes(x, y))
            s, fine = plain_slopes(x, y), []
            for i, h in enumerate(np.diff(x)):
                t = np.linspace(0, 1, 4001)
                fine.append(np.max((2 * t**3 - 3 * t**2 + 1) * y[i] + (t**3 - 2 * t**2 + t) * h * s[i] + (3 * t**2 - 2 * t**3) * y[i + 1] + (t**3 - t**2) * h * s[i + 1]))
            assert tops[k].saddle_y == pytest.approx(max(fine), abs=1e-5) and tops[k].saddle_y >= y.max()
        assert tops[k].highest_y == y.max() and tops[k].highest_x == x[y.argmax()]
        assert tops[k].at_knot == (tops[k].saddle_y == y.max())


def test_lines_parabolas_and_nothing(spark):
    rows = [("line", float(k), 2.0 * k) for k in range(9)] + [("hill", float(k), y) for k, y in enumerate((0.0, 3.0, 0.0))]
    curve = splines.natural_cubic(spark.createDataFrame(rows, SCHEMA), "path", "x", "y", 2)
    assert all(r.slope == pytest.approx(2) and r.top_y is None for r in curve.where("path = 'line'").collect())
    top = splines.saddles(curve, "path", "x", "y").where("path = 'hill'").first()
    assert (top.saddle_x, top.saddle_y, top.at_knot) == (1.0, 3.0, True)
    assert splines.natural_cubic(spark.createDataFrame([], SCHEMA), "path", "x", "y").count() == 0


def shell(kind):
    """The neighbours of a site at the origin, farther ones too."""
    if kind == "ico":
        g = (1 + math.sqrt(5)) / 2
        return [p for a, b in itertools.product((-1, 1), (-g, g)) for p in ((0, a, b), (a, b, 0), (b, 0, a))]
    span = range(-3, 4)
    if kind == "hcp":
        c = math.sqrt(8 / 3)
        return [(i + j / 2 + (k % 2) * 0.5, j * math.sqrt(3) / 2 + (k % 2) * math.sqrt(3) / 6, k * c / 2) for i, j, k in itertools.product(span, repeat=3)]
    basis = {"fcc": [(0, 0, 0), (0.5, 0.5, 0), (0.5, 0, 0.5), (0, 0.5, 0.5)], "bcc": [(0, 0, 0), (0.5, 0.5, 0.5)], "simple": [(0, 0, 0)], "diamond": [(0, 0, 0), (0.5, 0.5, 0), (0.5, 0, 0.5), (0, 0.5, 0.5), (0.25, 0.25, 0.25), (0.75, 0.75, 0.25), (0.75, 0.25, 0.75), (0.25, 0.75, 0.75)]}[kind]
    return [tuple(a + b for a, b in zip(cell, at, strict=True)) for cell in itertools.product(span, repeat=3) for at in basis]


@pytest.mark.parametrize("scale", [1.0, 3.7])
def test_classes_of_known_lattices(spark, scale):
    kinds, rng = ["fcc", "hcp", "bcc", "ico", "simple", "diamond"], np.random.default_rng(1)
    rows = []
    for site, kind in enumerate(kinds):
        for k, p in enumerate(shell(kind)):
            at = np.array(p) * scale
            far = float(np.linalg.norm(at))
            if far > 0:
                at = at + rng.normal(size=3) * 0.005 * scale
            rows.append(("g", site, k, far and float(np.linalg.norm(at)), *map(float, at)))
    table = spark.createDataFrame(rows, "group string, site long, other long, distance double, dx double, dy double, dz double")
    sites = spark.createDataFrame([("g", k) for k in range(7)], "group string, site long")
    got = {r.site: r.structure for r in neighbours.local_structure(table, sites).collect()}
    assert [got[k] for k in range(7)] == ["fcc", "hcp", "bcc", "ico", "other", "other", "other"]


def test_sites_of_a_crystal(spark):
    """The bulk of a block is told apart from its surface; pairs come from the radius join."""
    rows = [("g", n, *(math.sqrt(2) * float(c) for c in p)) for n, p in enumerate(p for p in itertools.product(np.arange(0, 3, 0.5), repeat=3) if (sum(p) * 2) % 2 == 0)]
    sites = spark.createDataFrame(rows, "group string, site long, x double, y double, z double")
    got = {r.site: r.structure for r in neighbours.local_structure(pairs.radius_pairs(sites, 1.45), sites).collect()}
    inner = {r[1] for r in rows if all(0.6 < c < math.sqrt(2) * 2.5 - 0.6 for c in r[2:])}
    assert {k for k, v in got.items() if v == "fcc"} == inner and set(got.values()) == {"fcc", "other"}
