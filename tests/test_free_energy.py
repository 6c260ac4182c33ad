"""Free energies: the choice of models, references, descriptors."""

import math

import pytest
from pyspark.sql import functions as F

from siltstone.operators import free_energy as fe

MASS = {"A": 20.0, "B": 30.0, "C": 50.0, "D": None}
T = [300.0, 500.0, 1000.0]


def tables(spark):
    entries = [
        ("a", {"A": 2.0}, -1.0, None, None), ("a2", {"A": 1.0}, -0.9, None, None), ("b", {"B": 1.0}, -2.0, None, None), ("ab", {"A": 1.0, "B": 3.0}, -2.5, 10.0, None),
        ("abc", {"A": 1.0, "B": 1.0, "C": 2.0}, -1.5, 12.0, -0.4), ("no volume", {"A": 1.0, "B": 1.0}, -1.7, None, None), ("no table", {"A": 1.0, "D": 1.0}, -1.2, 9.0, None),
        ("table", {"A": 1.0, "B": 1.0}, -1.6, 9.0, None), ("nothing", {"A": 0.0}, -1.0, 9.0, None), ("no energy", {"A": 1.0, "B": 1.0}, None, None, None),
    ]
    make = spark.createDataFrame
    own = [("table", 300.0, -1.8), ("table", 600.0, -2.1), ("table", 1200.0, -3.0), ("b", 300.0, -2.1), ("b", 700.0, -2.5), ("b", 1200.0, -3.0)]
    element = [(e, t, -k * 1e-4 * t) for k, e in enumerate("ABC", 1) for t in (300.0, 2000.0)]
    return make(entries, "entry string, composition map<string, double>, energy double, volume double, e_form double"), make(own, "entry string, temperature double, g double"), make(list(MASS.items()), "element string, mass double"), make(element, "element string, temperature double, g double")


def test_automatic_choice(spark):
    got = {(r.entry, r.temperature): r for r in fe.formation(*tables(spark), T).collect()}
    assert {k[0]: r.source for k, r in got.items()} == {"a": "descriptor", "a2": "descriptor", "b": "tabulated", "ab": "descriptor", "abc": "descriptor", "no volume": "static", "no table": "static", "table": "tabulated", "nothing": "descriptor", "no energy": "static"} | {"nothing": got["nothing", 300.0].source}
    g_b = {300.0: -2.1, 500.0: -2.3, 1000.0: -2.5 - 0.5 * 300 / 500}
    for t in T:
        assert got["a", t].dg_form == 0 and got["a2", t].dg_form == pytest.approx(0.1) and got["b", t].dg_form == pytest.approx(0)
        mass = (1 * 20 * 30 / 50) / 1
        gain = (-2.48e-4 * math.log(10) - 8.94e-5 * mass / 10) * t + 0.181 * math.log(t) - 0.882
        assert got["ab", t].dg_form == pytest.approx(-2.5 - (-1 * 0.25 - 2 * 0.75) + gain + (0.25 * 1e-4 + 0.75 * 2e-4) * t)
        mass = (0.5 * 12 + 0.75 * 20 * 50 / 70 + 0.75 * 30 * 50 / 80) / 2
        gain = (-2.48e-4 * math.log(12) - 8.94e-5 * mass / 12) * t + 0.181 * math.log(t) - 0.882
        assert got["abc", t].dg_form == pytest.approx(-0.4 + gain + (0.25e-4 + 0.5e-4 + 1.5e-4) * t)
        assert got["no volume", t].dg_form == pytest.approx(-1.7 + 0.5 - g_b[t] / 2)
        assert got["no table", t].dg_form == pytest.approx(-1.2 + 0.5)  # D has no pure entry and stands at 0
        assert got["nothing", t].dg_form is got["no energy", t].dg_form is None
    assert got["table", 500.0].dg_form == pytest.approx(-2.0 + 0.5 + 2.3 / 2)
    assert got["table", 1000.0].dg_form is None  # over a gap of 600 K


def test_other_modes(spark):
    data = tables(spark)
    static = {(r.entry, r.temperature): r for r in fe.formation(*data, T, "static").collect()}
    assert {r.source for r in static.values()} == {"static"}
    assert static["table", 1000.0].dg_form == pytest.approx(-1.6 + 0.5 + 1.0)
    by_table = {r.entry: r.source for r in fe.formation(*data, [500.0], "tabulated").collect()}
    assert {k for k, v in by_table.items() if v == "tabulated"} == {"table", "b"} and by_table["ab"] == "static"
    described = {r.entry: r.source for r in fe.formation(*data, [500.0], "descriptor").collect()}
    assert described["table"] == described["b"] == "descriptor" and described["no volume"] == "static"
    with pytest.raises(ValueError, match="mode"):
        fe.formation(*data, T, "best")


def test_shifts_and_ends(spark):
    data = tables(spark)
    shifts = spark.createDataFrame([("B", 500.0, 0.2), ("B", 300.0, 9.0)], "element string, temperature double, shift double")
    plain = {r.entry: r.dg_form for r in fe.formation(*data, [500.0]).collect()}
    shifted = {r.entry: r.dg_form for r in fe.formation(*data, [500.0], shifts=shifts).collect()}
    assert shifted["ab"] == pytest.approx(plain["ab"] - 0.15) and shifted["table"] == pytest.approx(plain["table"] - 0.1) and shifted["b"] == plain["b"]
    beyond = {r.entry: r.dg_form for r in fe.formation(*data, [2500.0]).collect()}
    assert beyond["ab"] is None and beyond["table"] is None and beyond["a2"] == pytest.approx(0.1)
    assert fe.formation(data[0].limit(0), *data[1:], [300.0]).count() == 0
    assert fe.formation(data[0].where("size(composition) = 1 AND entry <> 'b'"), *data[1:], [300.0]).where("entry = 'a'").first().source == "static"
