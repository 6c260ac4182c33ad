"""Thermodynamic databases: statements, pieces, references, values."""

import math

import pytest
from pyspark.sql import functions as F

from siltstone.sources import databases

TEXT = """
$ a small database
ELEMENT VA VACUUM 0.0 0.0 0.0 !
ELEMENT zn HCP_A3 6.5390E+01 5.6567E+03 4.1631E+01!
ELEMENT AL FCC_A1!

FUNCTION GAL 298.15 -7976.15+137.093038*T-24.3671976*T*LN(T)
   -1.884662D-3*T**2+74092*T**(-1);
 700 Y -11276.24+223.048446*T-38.5844296*T*LN(T); 933.47 Y
 -11278.378+188.684153*T; 2900 N !
FUNCTION GLIQ 298.15 +GAL#+11005.029-11.841867*T; 6000 N REF0 !
FUNCTION OPEN 500 2*GLIQ-GAL/2 !
FUNCTION BAD 300 1; 200 N !
PHASE LIQUID % 1 1.0 !
PHASE FCC_A1 %&A 2 1 1 !
CONSTITUENT FCC_A1 :AL,ZN : VA : !
TYPE_DEFINITION % SEQ *!
PARAMETER G(LIQUID,AL;0) 298.15 +GLIQ; 2000 N !
PARAMETER L(LIQUID,AL,ZN;1) 298.15 -3+0.5*T; 2000 N !
PARAMETER G(FCC_A1,AL:VA;0) 298.15 +GAL; 2000 N !
"""


def gal(t):
    if t < 700:
        return -7976.15 + 137.093038 * t - 24.3671976 * t * math.log(t) - 1.884662e-3 * t**2 + 74092 / t
    return -11276.24 + 223.048446 * t - 38.5844296 * t * math.log(t) if t < 933.47 else -11278.378 + 188.684153 * t


def test_statements():
    base = databases.parse(TEXT)
    assert [e.symbol for e in base.elements] == ["VA", "ZN", "AL"] and base.system() == "AL-ZN"
    assert (base.elements[1].mass, base.elements[2].mass) == (65.39, 0.0)
    assert base.phases["FCC_A1"].constituents == [["AL", "ZN"], ["VA"]] and base.phases["FCC_A1"].sites == [1.0, 1.0]
    assert [p[:2] for p in base.functions["GAL"]] == [(298.15, 700), (700, 933.47), (933.47, 2900)]
    assert base.functions["OPEN"][0][:2] == (500, 5000) and "BAD" not in base.functions
    assert base.temperatures() == (298.15, 6000) and base.comments == ["a small database"]
    assert [(p.kind, p.phase, p.constituents, p.order) for p in base.parameters] == [("G", "LIQUID", ["AL"], 0), ("L", "LIQUID", ["AL", "ZN"], 1), ("G", "FCC_A1", ["AL", "VA"], 0)]
    assert databases.parse("ELEMENT AL FCC_A1!").temperatures() == (298.15, 3000)
    for text in ("", "$ only a comment", "hello world !"):
        with pytest.raises(ValueError, match="no statement"):
            databases.parse(text)


def test_values_at_all_temperatures(spark):
    base = databases.parse(TEXT)
    temperatures = [298.15, 300.0, 699.99, 700.0, 900.0, 933.47, 2900.0, 250.0, 3000.0, None]
    df = spark.createDataFrame([(t, "clash") for t in temperatures], "t double, OTHER string")
    got = databases.with_functions(df, base, "t", ["gliq", "OPEN"]).collect()
    for r in got:
        inside = r.t is not None and 298.15 <= r.t <= 2900
        want = gal(r.t) + 11005.029 - 11.841867 * r.t if inside else None
        assert r.gliq == (pytest.approx(want) if inside else None)
        assert r.OPEN == (pytest.approx(2 * want - gal(r.t) / 2) if inside and r.t >= 500 else None)
    found, names = databases.with_parameters(df, base, "t", "liquid")
    assert names == ["g_al_0", "l_al_zn_1"] and found.columns == ["t", "OTHER", *names]
    row = found.where("t = 900").first()
    assert row.l_al_zn_1 == 447.0 and row.g_al_0 == pytest.approx(gal(900.0) + 11005.029 - 11.841867 * 900)


@pytest.mark.parametrize(("text", "value"), [("2+3*4", 14), ("-2**2", -4), ("2**3**2", 512), ("2**-1", 0.5), ("(1+2)*-3", -9), ("8/4/2", 1), ("EXP(0)+SQRT(T)", 3), ("1.5E+1-.5D1", 10), ("1/0", None), ("-T*LN(EXP(2))", -8)])
def test_expressions(spark, text, value):
    got = spark.range(1).select(databases.expression(text, F.lit(4.0), {}).alias("v")).first().v
    assert got == (None if value is None else pytest.approx(value))


@pytest.mark.parametrize("bad", ["1+", "(1", "1)", "2 3", "FOO", "1%2", ""])
def test_bad_expressions(bad):
    with pytest.raises(ValueError):
        databases.expression(bad, F.lit(1.0), {})


def test_references_in_order():
    base = databases.parse("FUNCTION A 1 B+C; 9 N ! FUNCTION B 1 C*2; 9 N ! FUNCTION C 1 5; 9 N ! FUNCTION P 1 Q; 9 N ! FUNCTION Q 1 P; 9 N ! FUNCTION Z 1 NONE; 9 N !")
    assert base.order(["A"]) == ["C", "B", "A"]
    with pytest.raises(ValueError, match="circle"):
        base.order(["P"])
    with pytest.raises(ValueError, match="no function NONE, to which Z refers"):
        base.order(["Z"])


def test_a_function_used_twice_at_every_level_stays_small(spark):
    text = "FUNCTION F0 1 T; 9999 N ! " + " ".join(f"FUNCTION F{k} 1 F{k - 1}+F{k - 1}; 9999 N !" for k in range(1, 16))
    got = databases.with_functions(spark.createDataFrame([(2.0,)], "t double"), databases.parse(text), "t", ["F15"]).first()
    assert got.F15 == 2.0**16
