"""Transforms in parts, correlations and spectra against numpy, with blocks so small that every series is dealt."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone import joins
from siltstone.operators import motion, spectral, transform


def _series(spark, lengths, seed=1):
    rng = np.random.default_rng(seed)
    values = {k: rng.normal(size=n) for k, n in lengths.items()}
    rows = [(k, 0, i, float(x)) for k, v in values.items() for i, x in enumerate(v)]
    return values, spark.createDataFrame(rows, "s string, c int, at long, v double")


@pytest.mark.parametrize("block", [4, 16, 1 << 20])
@pytest.mark.parametrize("half", [True, False])
def test_transform_of_any_length(spark, block, half):
    values, df = _series(spark, {"a": 256, "b": 8, "c": 1, "d": 128})
    sizes = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, len(v))])
    rows = df.select("s", F.col("at").alias("position"), F.col("v").alias("re"), (F.col("v") * F.col("at")).alias("im"), sizes[F.col("s")].cast("long").alias("size"))
    found = {}
    for r in transform.transform(rows, ["s"], 256, 393, half, block).collect():
        found[r.s, r.bin] = complex(r.re, r.im)
    for k, v in values.items():
        want = np.fft.fft(v + 1j * v * np.arange(len(v)))
        bins = len(v) // 2 + 1 if half else len(v)
        assert np.allclose([found.pop((k, b)) for b in range(bins)], want[:bins])
    assert not found


def test_missing_positions_count_as_zero(spark):
    rows = spark.createDataFrame([("a", 3, 2.0, 0.0, 64)], "s string, position long, re double, im double, size long")
    found = sorted((r.bin, r.re, r.im) for r in transform.transform(rows, ["s"], 64, 64, False, 8).collect())
    want = np.fft.fft(np.eye(64)[3] * 2)
    assert np.allclose([complex(a, b) for _, a, b in found], want) and [k for k, *_ in found] == list(range(64))


def test_padded(spark):
    got = spark.range(1, 70).select(transform.padded(F.col("id"), 2.0).alias("n")).collect()
    assert [r.n for r in got] == [1 << (2 * n - 1).bit_length() for n in range(1, 70)]


@pytest.mark.parametrize("block", [8, 1 << 20])
def test_autocorrelation(spark, block):
    values, df = _series(spark, {"a": 50, "b": 2, "c": 1})
    both = df.unionByName(df.where("s = 'a'").withColumn("c", F.lit(1)).withColumn("v", F.col("v") * 2))
    found = {(r.s, r.lag): r.value for r in transform.autocorrelation(both, "s", "c", "at", "v", block=block).collect()}
    for k, v in values.items():
        for lag in range(len(v)):
            assert found.pop((k, lag)) == pytest.approx(np.mean(v[: len(v) - lag] * v[lag:]) * (2.5 if k == "a" else 1))
    assert not found
    assert transform.autocorrelation(df.where("false"), "s", "c", "at", "v").count() == 0
    assert transform.autocorrelation(df, "s", "c", "at", "v", most=3).agg(F.max("lag")).first()[0] == 3


@pytest.mark.parametrize("kind", ["hann", "gaussian", "none"])
def test_power_in_parts_equals_power_at_once(spark, kind):
    values, df = _series(spark, {"a": 37, "b": 100})
    at_once = {(r.s, r.bin): r.power for r in spectral.power_spectrum(df, "s", "c", "at", "v", 0.5, kind).collect()}
    in_parts = {(r.s, r.bin): r.power for r in spectral.power_spectrum(df, "s", "c", "at", "v", 0.5, kind, block=16).collect()}
    assert at_once.keys() == in_parts.keys() and len(at_once) == 129 + 257
    assert all(at_once[k] == pytest.approx(in_parts[k], abs=1e-9) for k in at_once)
    for k, v in values.items():
        d = np.abs(2 * np.arange(len(v)) - (len(v) - 1)) / (len(v) - 1)
        w = {"hann": 0.5 * (1 + np.cos(np.pi * d)), "gaussian": np.exp(-0.5 * (3 * d) ** 2), "none": np.ones(len(v))}[kind]
        size = 1 << (4 * len(v) - 1).bit_length()
        power = np.abs(np.fft.rfft((v - v.mean()) * w, size)) ** 2 * 0.5 / (w * w).sum()
        power[1:-1] *= 2
        assert np.allclose([at_once[k, b] for b in range(size // 2 + 1)], power)


def test_power_of_odd_inputs(spark):
    rows = [("one", 0, 0, 1.0), ("two", 0, 0, 1.0), ("two", 0, 1, 3.0), ("gap", 0, 0, 1.0), ("gap", 0, 1, None), ("gap", 0, 3, 3.0), (None, 0, 0, 1.0), ("nan", 0, 0, float("nan")), ("nan", 0, 4, 1.0)]
    df = spark.createDataFrame(rows, "s string, c int, at long, v double")
    found = {}
    for r in spectral.power_spectrum(df, "s", "c", "at", "v", 1.0).collect():
        found.setdefault(r.s, []).append(r.power)
    assert set(found) == {"two", "gap", "nan"} and set(found["two"]) == {None}
    assert found["nan"] == pytest.approx([0] * len(found["nan"])) and len(found["gap"]) == 9
    assert spectral.power_spectrum(df.where("false"), "s", "c", "at", "v", 1.0).count() == 0


def test_numbers_dealt_by_range(spark, monkeypatch):
    rows = spark.range(500).select(F.when(F.col("id") % 50 == 0, None).otherwise((F.col("id") % 3 == 0).cast("string")).alias("g"), ((F.col("id") * 7919) % 500).alias("v"))
    want = sorted(joins.numbered(rows, "g", ["v"], "n").collect(), key=str)
    monkeypatch.setattr(joins, "IN_ONE_TASK", 20)
    assert sorted(joins.numbered(rows, "g", ["v"], "n").select("g", "v", "n").collect(), key=str) == want


def test_a_vibration_shows_without_its_drift(spark):
    rows = [("m", a, t, float(sign * np.sin(2 * np.pi * 0.125 * t) + 3.0 * np.sin(2 * np.pi * 0.3 * t)), 1.0) for t in range(128) for a, sign in enumerate((1, -1))]
    df = spark.createDataFrame(rows, "g string, atom int, frame long, x double, mass double")
    top = motion.vibrations(df, "g", "atom", "frame", ["x"], "mass", 1.0).orderBy(F.desc("power")).first()
    assert top.frequency == pytest.approx(0.125, abs=0.01)
    top = motion.vibrations(df, "g", "atom", "frame", ["x"], "mass", 1.0, drift=True).orderBy(F.desc("power")).first()
    assert top.frequency == pytest.approx(0.3, abs=0.01)
