"""Symmetry operations: kinds, axes, screw and glide parts, against numpy."""

import itertools

import numpy as np
import pytest

from siltstone.operators import symmetry

NAMES = [f"r{k}" for k in range(9)]
SHIFT = ["u", "v", "w"]
SCHEMA = "id long, " + ", ".join(f"{n} int" for n in NAMES) + ", " + ", ".join(f"{n} double" for n in SHIFT)
HEX6 = ((1, -1, 0), (1, 0, 0), (0, 0, 1))


def run(spark, ops):
    rows = [(k, *(int(x) for row in m for x in row), *map(float, t)) for k, (m, t) in enumerate(ops)]
    return [r for r in symmetry.elements(spark.createDataFrame(rows, SCHEMA), NAMES, SHIFT).orderBy("id").collect()]


def test_known_operations(spark):
    minus = [[-x for x in row] for row in np.eye(3, dtype=int)]
    four = ((0, -1, 0), (1, 0, 0), (0, 0, 1))
    three = ((0, 0, 1), (1, 0, 0), (0, 1, 0))
    glide = ((1, 0, 0), (0, -1, 0), (0, 0, 1))
    diagonal = ((0, 1, 0), (1, 0, 0), (0, 0, 1))
    ops = [(np.eye(3), (0, 0, 0)), (np.eye(3), (0.5, 0.5, 0)), (minus, (0.3, 0.2, 0.1)), (four, (0, 0, 0.25)), (four, (0.7, 0.1, 0.75)), (four, (0.5, 0.5, 1.0)), (three, (1 / 3, 1 / 3, 1 / 3)), (three, (0.5, -0.5, 0)),
           (glide, (0.5, 0.3, 0)), (glide, (1, 0.25, 0)), (diagonal, (0.5, -0.5, 0)), (diagonal, (0.5, 0, 0.5)), (HEX6, (0, 0, 5 / 6)), (-np.array(four), (0, 0, 0.4)), (-np.array(three), (0.1, 0.2, 0.3)), (2 * np.eye(3), (0, 0, 0))]
    got = [(r.kind, r.order, r.axis, r.label) for r in run(spark, ops)]
    assert got == [
        ("identity", 1, None, None), ("translation", 1, None, None), ("inversion", 1, None, "-1"), ("screw", 4, [0, 0, 1], "4_1"), ("screw", 4, [0, 0, 1], "4_3"), ("rotation", 4, [0, 0, 1], "4"),
        ("screw", 3, [1, 1, 1], "3_1"), ("rotation", 3, [1, 1, 1], "3"), ("glide", 2, [0, 1, 0], "g"), ("mirror", 2, [0, 1, 0], "m"), ("mirror", 2, [1, -1, 0], "m"), ("glide", 2, [1, -1, 0], "g"),
        ("screw", 6, [0, 0, 1], "6_5"), ("rotoinversion", 4, [0, 0, 1], "-4"), ("rotoinversion", 3, [1, 1, 1], "-3"), (None, None, None, None),
    ]
    glides = run(spark, [(diagonal, (0.5, 0, 0.5))])
    assert glides[0].intrinsic == pytest.approx([0.25, 0.25, 0.5])


def powers(m):
    """The order of a matrix by multiplication."""
    k, p = 1, m
    while not (p == np.eye(3)).all():
        k, p = k + 1, p @ m
    return k


def test_all_operations_of_two_groups(spark):
    cubic = [np.eye(3, dtype=int)[list(p)] * np.array(s)[:, None] for p in itertools.permutations(range(3)) for s in itertools.product((1, -1), repeat=3)]
    group, mirror = [np.array(HEX6)], np.array([[0, 1, 0], [1, 0, 0], [0, 0, 1]])
    hexagonal = {tuple(x.ravel()) for k in range(6) for x0 in (np.linalg.matrix_power(group[0], k),) for y in (np.eye(3, dtype=int), mirror) for z in (1, -1) for x in (z * x0 @ y,)}
    rng = np.random.default_rng(1)
    ops = [(m, rng.integers(0, 12, 3) / 12) for m in [*cubic, *(np.array(x).reshape(3, 3) for x in hexagonal)]]
    assert len(ops) == 48 + 24
    for r, (m, t) in zip(run(spark, ops), ops, strict=True):
        det, n = round(np.linalg.det(m)), powers(m)
        proper = det * m
        assert r.order == powers(proper) and (r.kind in ("rotation", "screw", "identity", "translation")) == (det == 1)
        if r.axis is not None:
            assert (proper @ r.axis == r.axis).all() and np.gcd.reduce(r.axis) == 1 and next(x for x in r.axis if x) > 0
        part = sum(np.linalg.matrix_power(m, k) @ t for k in range(n)) / n
        moved = np.abs(part - np.rint(part)).max() > 1e-6
        assert moved == (r.kind in ("screw", "glide", "translation"))
        if moved:
            assert r.intrinsic == pytest.approx(list(part), abs=1e-9)


def test_missing_numbers(spark):
    df = spark.createDataFrame([(1, *[None] * 9, 0.0, 0.0, 0.0), (2, 1, 0, 0, 0, 1, 0, 0, 0, 1, None, 0.0, 0.0)], SCHEMA)
    assert [r.kind for r in symmetry.elements(df, NAMES, SHIFT).collect()] == [None, None]
