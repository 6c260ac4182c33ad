"""Pair distributions of a random gas and of odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import distributions, pairs


def _gas(spark, n=900, side=6.0):
    rng = np.random.default_rng(3)
    rows = [("gas", k, "AB"[k % 3 == 0], *map(float, rng.uniform(0, side, 3))) for k in range(n)]
    sites = spark.createDataFrame(rows, "group string, site long, element string, x double, y double, z double")
    cells = spark.createDataFrame([("gas", side**3)], "group string, volume double")
    return sites, cells, pairs.periodic_pairs(sites, (side,) * 3, 2.0)


def test_a_gas_has_no_structure(spark):
    sites, cells, near = _gas(spark)
    parts = distributions.partials(near, sites, cells, 2.0, 4).cache()
    assert parts.count() == 12
    last = parts.where("bin = 3").collect()
    assert all(abs(r.g - 1) < 0.1 for r in last)
    lengths = spark.createDataFrame([("A", 1.0), ("B", 3.0)], "element string, length double")
    whole = {r.bin: r for r in distributions.total(parts, lengths).collect()}
    assert len(whole) == 4 and abs(whole[3].g - 1) < 0.05
    assert whole[3].reduced == pytest.approx(4 * np.pi * 1.75 * 900 / 216 * (whole[3].g - 1))
    # equal lengths give the distribution of all sites
    same = {r.bin: r.g for r in distributions.total(parts, lengths.withColumn("length", F.lit(2.0))).collect()}
    plain = {r.bin: r.g for r in pairs.pair_distribution(near, sites, 2.0, 4, 216.0).collect()}
    assert all(same[k] == pytest.approx(plain[k]) for k in plain)
    around = {(r.a, r.b): r.neighbours for r in distributions.coordination(parts, 0.5).collect()}
    counted = near.where("distance < 2").count() / 900
    assert sum(around[p] for p in (("A", "A"), ("A", "B"))) == pytest.approx(counted, rel=0.1)
    with pytest.raises(ValueError):
        distributions.coordination(parts, 0.5, 2.0, 1.0)


def test_groups_without_weights(spark):
    sites = spark.createDataFrame([("p", 1, "A", 0.5), ("p", 2, "B", None), ("q", 3, "A", 1.0), ("q", 4, None, 1.0), ("r", 5, "C", 0.0)], "group string, site long, element string, share double")
    near = spark.createDataFrame([("p", 1, 2, 0.5), ("p", 2, 1, 0.5), ("q", 3, 4, 0.5), ("q", 4, 3, 0.5)], "group string, site long, other long, distance double")
    cells = spark.createDataFrame([("p", 8.0), ("q", 0.0)], "group string, volume double")
    parts = distributions.partials(near, sites, cells, 1.0, 2, occupancy="share")
    got = {(r.group, r.a, r.b, r.bin): (r.n, r.atoms_a, r.all_atoms) for r in parts.collect()}
    assert got["p", "A", "B", 1] == (0.5, 0.5, 1.5) and len(got) == 8 and not any(k[0] == "r" for k in got)
    lengths = spark.createDataFrame([("A", 1.0), ("B", -0.5)], "element string, length double")
    found = {(r.group, r.bin): r.g for r in distributions.total(parts, lengths).collect()}
    assert found == {("p", 0): None, ("p", 1): None, ("q", 0): None, ("q", 1): None}  # a mean of 0, no volume


def test_no_volume_no_neighbours(spark):
    sites = spark.createDataFrame([("q", 3, "A"), ("q", 4, "A")], "group string, site long, element string")
    near = spark.createDataFrame([("q", 3, 4, 0.2), ("q", 4, 3, 0.2)], "group string, site long, other long, distance double")
    parts = distributions.partials(near, sites, spark.createDataFrame([], "group string, volume double"), 1.0, 2)
    assert [tuple(r) for r in distributions.coordination(parts, 0.5, 0.0, 0.5).collect()] == [("q", "A", "A", None)]
