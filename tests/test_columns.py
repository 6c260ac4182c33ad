"""Columns of JSON rows and the axes they suggest."""

import json

import pytest

from siltstone.operators import table


def _columns(spark, rows):
    df = spark.createDataFrame([(k, r if isinstance(r, str) or r is None else json.dumps(r)) for k, r in enumerate(rows)], "at long, props string")
    return table.extract_columns(df, "props", "at")


@pytest.mark.parametrize(("row", "want"), [
    ({"a": 1, "b": 2}, ("scatter", "a", "b", None, None)), ({"energy": 1, "time": 2}, ("scatter", "time", "energy", None, None)), ({"n": "s", "v": 1}, ("bar", "n", "v", None, None)),
    ({"only": 3.5}, ("histogram", "only", "only", None, None)), ({"s": "t"}, ("bar", "s", None, None, None)), ({"o": {"p": 1}}, ("table", None, None, None, None)),
    ({"x": 1, "Y": 2, "depth": 3, "w": 4}, ("scatter3d", "x", "Y", "depth", "w")), ({"value": "s", "v": 1, "w": 2}, ("scatter", "v", "w", None, None)), ({"p": 1, "z": 2}, ("scatter", "p", "z", None, None)),
])
def test_axes(spark, row, want):
    assert [tuple(r) for r in table.suggest_axes(_columns(spark, [row])).collect()] == [want]


def test_kinds_of_columns(spark):
    rows = [{"n": 1, "t": "2", "m": 1}, {"n": 2.5, "m": "x", "e": None}, {"n": None, "o": [1], "t": "x"}, {"n": 3, "b": True}, {"n": 4}, {"n": "5"}, None, "", "no", "[1, 2]", {}]
    got = {r.column: (r.first, r.place, r.n, r.n_numeric, r.n_string, r.kind) for r in _columns(spark, rows).collect()}
    assert got == {
        "n": (0, 0, 5, 4, 1, "numeric"), "t": (0, 1, 2, 0, 2, "string"), "m": (0, 2, 2, 1, 1, "mixed"), "e": (1, 2, 0, 0, 0, "mixed"), "o": (2, 1, 1, 0, 0, "mixed"), "b": (3, 1, 1, 0, 0, "mixed"),
    }
    assert [tuple(r) for r in table.suggest_axes(_columns(spark, [None])).collect()] == [("table", None, None, None, None)]
