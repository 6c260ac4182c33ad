"""Skew-safe joins, ordered counts, hulls and graphs against plain Python."""

import itertools
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone import catalogue, joins, storage
from siltstone.functions import dates
from siltstone.operators import curves, graph, thermo


def test_quantiles_of_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot", float(rng.randrange(50))) for _ in range(4000)] + [("some", rng.random()) for _ in range(700)] + [("one", 3.0), ("none", None)]
    got = {r.g: r for r in joins.quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", [0, 0.05, 0.5, 0.95, 1]).collect()}
    assert set(got) == {"hot", "some", "one"}
    for g, r in got.items():
        want = np.quantile([v for name, v in rows if name == g], [0, 0.05, 0.5, 0.95, 1])
        assert [r.q0, r.q1, r.q2, r.q3, r.q4] == pytest.approx(list(want))


def test_no_quantile_keeps_a_column_in_one_task(spark):
    df = spark.createDataFrame([("a", 1.0)], "g string, v double")
    assert "percentile" not in joins.quantiles(df, "g", "v", [0.5])._jdf.queryExecution().toString()


def test_sums_below(spark):
    rng = random.Random(2)
    counts = Counter((rng.choice("ab"), rng.randrange(300)) for _ in range(3000))
    rows = [(g, v, n) for (g, v), n in counts.items()]
    got = {(r.g, r.v): r.below for r in joins.below(spark.createDataFrame(rows, "g string, v int, n long"), "g", "v", "n").collect()}
    assert got == {(g, v): sum(n for (h, w), n in counts.items() if h == g and w < v) for g, v in counts}


def test_join_with_hot_and_cold_keys(spark):
    rows = [(1, k) for k in range(5000)] + [(k, k) for k in range(2, 1500)]
    df = spark.createDataFrame(rows, "key int, x int")
    groups = df.groupBy("key").count()
    got = joins.join_groups(df, groups, "key", "count")
    assert got.count() == len(rows) and got.where("key = 1 and count <> 5000").isEmpty()


def mixture(points, energies, x):
    """The least energy of all simplices of the points that hold x."""
    d, best = points.shape[1], np.inf
    for corners in itertools.combinations(range(len(points)), d):
        a = points[list(corners)].T
        if abs(np.linalg.det(a)) > 1e-9:
            share = np.linalg.solve(a, x)
            if share.min() > -1e-9:
                best = min(best, float(share @ energies[list(corners)]))
    return best


@pytest.mark.parametrize("d", [1, 2, 3, 4])
def test_hull_against_all_simplices(d):
    rng = np.random.default_rng(d)
    points = np.vstack([np.eye(d), rng.dirichlet(np.ones(d), 12), np.round(rng.dirichlet(np.ones(d), 6) * 4) / 4 if d == 2 else np.zeros((0, d))])
    points = points[points.sum(1) > 0.99]
    energies = rng.normal(size=len(points))
    hull = thermo.hull_energies(points, energies)
    assert hull == pytest.approx([mixture(points, energies, x) for x in points])


def test_hull_in_parts_equals_the_whole(spark):
    rng = np.random.default_rng(9)
    x = rng.dirichlet(np.ones(3), 300)
    e = rng.normal(size=300)
    rows = [("s", k, *map(float, p), float(v)) for k, (p, v) in enumerate(zip(x, e, strict=True))]
    df = spark.createDataFrame(rows, "system string, entry int, a double, b double, c double, e double")
    parts = {r.entry: r.e_above_hull for r in thermo.hull_distance(df, "system", "entry", ["a", "b", "c"], "e", part=40).collect()}
    want = np.maximum(e - thermo.hull_energies(x / x.sum(1, keepdims=True), e), 0)
    assert [parts[k] for k in range(300)] == pytest.approx(list(want), abs=1e-9)


def test_levels_of_a_deep_tree(spark):
    nodes = [("n0", None)] + [(f"n{k}", f"n{k - 1}") for k in range(1, 130)]
    got = {r.name: (r.depth, r.path) for r in graph.levels(spark.createDataFrame(nodes, "name string, parent string"), "name", "parent").collect()}
    assert got["n129"][0] == 129 and got["n3"] == (3, "n0/n1/n2/n3")


def test_interpolation_and_dates_at_their_edges(spark):
    series = spark.createDataFrame([("a", 1.0, 10.0), ("a", 3.0, 30.0)], "g string, x double, y double")
    places = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("a", 3.0), ("a", 9.0), ("b", 1.0)], "g string, x double")
    got = {(r.g, r.x): r.y for r in curves.interpolate(series, places, "g", "x", "y").collect()}
    assert got == {("a", 0.0): 10.0, ("a", 2.0): 20.0, ("a", 3.0): 30.0, ("a", 9.0): 30.0, ("b", 1.0): None}
    texts = spark.createDataFrame([("2020-02-30",), ("2020-02-29",), ("20200229",), ("",), (None,), ("1582",)], "t string")
    assert [r[0] is not None for r in texts.select(dates.parse_datetime(texts.t)).collect()] == [False, True, False, False, False, False]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(ValueError):
        storage.shared_dir(Session())


@pytest.mark.parametrize("kind", ["string", "binary"])
def test_hot_keys_of_other_types(spark, kind):
    df = spark.range(4000).selectExpr(f"cast(if(id % 3 = 0, 'hot', if(id % 7 = 0, null, concat('k', id))) as {kind}) as key", "id")
    groups = df.groupBy("key").count()
    assert joins.join_groups(df, groups, "key", "count").count() == df.where("key is not null").count()


@pytest.mark.parametrize("room", [1, 200_000])
def test_quantiles_whichever_way(spark, monkeypatch, room):
    monkeypatch.setattr(joins, "IN_ONE_TASK", room)
    rng = np.random.default_rng(2)
    rows = [("hot", float(v)) for v in rng.integers(0, 900, 3000)] + [("one", 5.0), ("ties", 1.0), ("ties", 1.0), ("ties", 4.0), ("empty", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.q0, r.q1, r.q2) for r in joins.quantiles(df, "g", "v", [0.05, 0.5, 1.0]).collect()}
    want = {g: tuple(np.quantile([v for h, v in rows if h == g], [0.05, 0.5, 1.0])) for g in ("hot", "one", "ties")}
    assert got == {g: pytest.approx(q) for g, q in want.items()}


def test_times_in_words(spark):
    import datetime as dt

    now = dt.datetime(2024, 3, 1, 12)
    cases = {0: "0m ago", 59: "0m ago", 60: "1m ago", 7500: "2h 5m ago", 7200: "2h 0m ago", 86400 * 8: "1w 1d 0m ago", -86400 * 3: "3d 0m from now", 86400 * 400 + 3600 * 2 + 300: "1y 1mo 5d ago", -30: "0m from now"}
    rows = spark.createDataFrame([(s, now - dt.timedelta(seconds=s), now) for s in cases] + [(None, None, now)], "s int, then timestamp, now timestamp")
    got = {r.s: r.age for r in rows.select("s", dates.since(F.col("then"), F.col("now")).alias("age")).collect()}
    assert got == cases | {None: None}
    assert rows.where("s = 60").select(dates.written(F.col("then"), "iso"), dates.written(F.col("then"), "time"), dates.written(F.col("then"), "relative", F.col("now"))).first() == ("2024-03-01T11:59:00.000Z", "11:59", "1m ago")


def test_one_time_of_day_makes_a_column_of_times(spark):
    rows = spark.createDataFrame([("2024-01-02", "2024-01-02", "x"), ("2024-01-03 10:00", "no date", None), (None, None, "12")], "a string, b string, c string")
    assert {r.column: r.kind for r in dates.infer_kind(rows, ["a", "b", "c"]).collect()} == {"a": "datetime", "b": "date", "c": None}


def test_kinds_of_dates_count_rows_without_a_key_and_repeated_ones(spark, tmp_path):
    orders = f"{tmp_path}/orders.parquet"
    keys = [0, 1, 2, 3, 4, 4, 5, 5, 5, None, None]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").selectExpr("o_orderkey", "timestamp_ntz'2024-01-02' AS o_orderdate", "'1-URGENT' AS o_orderpriority").write.parquet(orders)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{orders}/*.parquet'")
    got = {tuple(r) for r in catalogue.QUERIES["infer_date_columns"](spark, str(tmp_path)).collect()}
    assert got == {("mixed", 11, 8, "datetime"), ("bare", 11, 11, "date"), ("priority", 11, 0, None)} == set(db.sql(catalogue.ORACLE_SQL["infer_date_columns"]).fetchall())


def test_curves_at_places(spark):
    knots = spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, 1.0), ("a", 3.0, 5.0), ("a", 3.0, 4.0), ("b", 1.0, 7.0), ("c", None, 1.0)], "g string, x double, y double")
    places = spark.createDataFrame([(g, x) for g in "abcd" for x in (-1.0, 0.5, 1.0, 1.9, 2.5, 9.0)], "g string, x double")
    for kind, want in {"step": [0, 1, 1, 1, 5, 5], "after": [0, 0, 1, 1, 1, 5], "before": [0, 1, 1, 5, 5, 5]}.items():
        got = {(r.g, r.x): r.y for r in curves.evaluate(knots, places, "g", "x", "y", kind).collect()}
        assert [got["a", x] for x in (-1.0, 0.5, 1.0, 1.9, 2.5, 9.0)] == want
        assert {got["b", x] for x in (-1.0, 1.0, 9.0)} == {7.0} and {got[g, 0.5] for g in "cd"} == {None}
    got = [r.y for r in curves.evaluate(knots, places.where("g = 'a'"), "g", "x", "y").orderBy("x").collect()]
    assert got == sorted(got) and got[2] == 1.0 and 0 < got[1] < 1 < got[3] < got[4] < 5
