"""Edge cases of the operators that the supplied tables don't hold."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import formula, numeric, text
from siltstone.operators import pairs, series, stats, table, thermo
from siltstone.sources import structures
from siltstone.sources.tables import table_stream
from siltstone.streaming import frames

NAN = float("nan")


def test_column_stats_skip_what_is_not_finite(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (NAN,), (float("inf"),), (None,), (100.0,)], "v double")
    row = stats.column_stats(df, ["v"]).first()
    assert (row.n, row.min, row.median, row.max) == (3, 1.0, 2.0, 100.0)


def test_histogram_keeps_top_edge_and_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (10.5,), (None,), (NAN,)], "v double")
    rows = {r.bin: r["count"] for r in stats.histogram(df, "v", 0, 10, 5).collect()}
    assert rows == {0: 1, 1: 0, 2: 0, 3: 0, 4: 1}


def test_sort_keeps_null_and_nan_last_and_numbers_natural(spark):
    df = spark.createDataFrame([("item10", 1.0), ("Item2", NAN), (None, 3.0), ("item1", None)], "name string, v double")
    names = [r.name for r in df.orderBy(*table.sort_keys(df, [("name", True)])).collect()]
    assert names == ["item1", "Item2", "item10", None]
    values = [r.v for r in df.orderBy(*table.sort_keys(df, [("v", False)])).collect()]
    assert values[:2] == [3.0, 1.0] and all(v is None or math.isnan(v) for v in values[2:])


def test_moving_average_and_gaps_with_nan(spark):
    df = spark.createDataFrame([("a", 0, NAN), ("a", 1, 2.0), ("a", 2, None), ("a", 3, 4.0), ("b", 0, None)], "s string, i int, v double")
    filled = {(r.s, r.i): r.filled for r in series.interpolate_gaps(df, "s", ["i"], "v").collect()}
    assert filled == {("a", 0): 2.0, ("a", 1): 2.0, ("a", 2): 3.0, ("a", 3): 4.0, ("b", 0): 0.0}
    smooth = {(r.s, r.i): r.smoothed for r in series.moving_average(df, "s", ["i"], "v", 3).collect()}
    assert smooth["a", 2] == 3.0 and smooth["a", 0] == 2.0


def test_savgol_keeps_a_parabola(spark):
    df = spark.createDataFrame([("a", i, float(i * i)) for i in range(12)], "s string, i int, v double")
    rows = series.savitzky_golay(df, "s", ["i"], "v", 5).where("i between 2 and 9").collect()
    assert all(abs(r.smoothed - r.v) < 1e-9 for r in rows)
    with pytest.raises(ValueError):
        series.savgol_weights(4, 2)


def test_bounds_let_nan_pass(spark):
    df = spark.createDataFrame([(NAN,), (5.0,), (-1.0,)], "v double")
    assert sum(math.isnan(r.bounded) for r in series.apply_bounds(df, "v", 0.0, 3.0).collect()) == 1
    assert series.apply_bounds(df, "v", 0.0, 3.0, "filter").count() == 1


def test_periodic_pairs_count_images_from_both_ends(spark):
    df = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0)], "group int, site int, x double, y double, z double")
    rows = pairs.periodic_pairs(df, (1.0, 1.0, 1.0), 1.0).collect()
    assert len(rows) == 6 and all(r.distance == 1.0 for r in rows)


def test_hull_against_brute_force():
    rng = np.random.default_rng(3)
    points = np.vstack([np.eye(3), rng.dirichlet([1, 1, 1], 12)])
    energies = np.concatenate([[0, 0, 0], rng.normal(-0.2, 0.3, 12)])
    hull = thermo.hull_energies(points, energies)
    for i, p in enumerate(points):
        best = energies[i]
        for k in (1, 2, 3):
            for c in itertools.combinations(range(len(points)), k):
                share, *_ = np.linalg.lstsq(points[list(c)].T, p, rcond=None)
                if (share > -1e-9).all() and np.allclose(points[list(c)].T @ share, p, atol=1e-9):
                    best = min(best, share @ energies[list(c)])
        assert abs(hull[i] - best) < 1e-8


def test_hull_takes_lacking_corners_at_zero():
    assert thermo.hull_energies(np.array([[0.5, 0.5], [0.25, 0.75]]), np.array([1.0, -1.0])).tolist() == pytest.approx([-2 / 3, -1.0])


@pytest.mark.parametrize(
    ("written", "amounts"),
    [
        ("H2O", {"H": 2, "O": 1}),
        ("Ca3(PO4)2", {"Ca": 3, "P": 2, "O": 8}),
        ("CuSO4·5H2O", {"Cu": 1, "S": 1, "O": 9, "H": 10}),
        ("Li0.5CoO2", {"Li": 0.5, "Co": 1, "O": 2}),
        ("[Fe(CN)6]4-", {"Fe": 1, "C": 6, "N": 6}),
    ],
)
def test_formula(written, amounts):
    assert formula.parse(written) == amounts


@pytest.mark.parametrize("written", ["", "h2o", "Fe(", "Fe)", "Qq", "Fe$2"])
def test_no_formula(written):
    with pytest.raises(ValueError):
        formula.parse(written)


def test_reduction_and_order():
    assert formula.write(formula.reduced({"O": 6.0, "Fe": 4.0})) == "Fe2O3"
    assert formula.write({"H": 6, "C": 2, "O": 1}, "hill") == "C2H6O"


def test_angles_and_cells(spark):
    row = spark.range(1).select(
        numeric.angle([F.lit(1.0), F.lit(0.0)], [F.lit(0.0), F.lit(2.0)]).alias("right"),
        numeric.angle([F.lit(0.0)], [F.lit(1.0)]).alias("none"),
        numeric.volume([[F.lit(2.0), F.lit(0.0), F.lit(0.0)], [F.lit(0.0), F.lit(3.0), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(4.0)]]).alias("volume"),
        numeric.normalize_timestamp(F.lit(1.7e9)).alias("ms"),
        text.property_key(F.lit("<b>Fmax</b>")).alias("key"),
    ).first()
    assert (row.right, row.none, row.volume, row.ms, row.key) == (90.0, 0.0, 24.0, 1.7e12, "force max")


XYZ = "2\nfirst\nH 0 0 0\nO1 0 0 1.5\n1\nsecond\nHe 1 2 3\n"
POSCAR = "cubic NaCl\n2.0\n1 0 0\n0 1 0\n0 0 1\nNa Cl\n1 1\nDirect\n0 0 0\n0.5 0.5 0.5\n"


def test_read_and_write_structures(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.xyz").write_text(XYZ)
    atoms = structures.read_xyz(spark, str(tmp_path / "in"))
    assert [(r.frame, r.site, r.element, r.z) for r in atoms.orderBy("frame", "site").collect()] == [(0, 0, "H", 0.0), (0, 1, "O", 1.5), (1, 0, "He", 3.0)]
    structures.write_xyz(atoms, str(tmp_path / "out"))
    again = structures.read_xyz(spark, str(tmp_path / "out"))
    assert sorted((r.element, r.x, r.y, r.z, r.comment) for r in again.collect()) == sorted((r.element, r.x, r.y, r.z, r.comment) for r in atoms.collect())
    (tmp_path / "p").mkdir()
    (tmp_path / "p/POSCAR").write_text(POSCAR)
    assert [(r.element, r.x) for r in structures.read_poscar(spark, str(tmp_path / "p")).orderBy("site").collect()] == [("Na", 0.0), ("Cl", 1.0)]
    assert [r.y for r in structures.read_lattices(spark, str(tmp_path / "p")).orderBy("axis").collect()] == [0.0, 2.0, 0.0]
    (tmp_path / "s").mkdir()
    (tmp_path / "s/scan.xy").write_text("# angle, counts\n10 5\n20;7\ntext\n")
    assert [(r.x, r.y) for r in structures.read_scans(spark, str(tmp_path / "s")).orderBy("row").collect()] == [(10.0, 5.0), (20.0, 7.0)]


def test_truncated_xyz_fails():
    with pytest.raises(ValueError):
        list(structures.parse_xyz("3\nshort\nH 0 0 0\n"))


def test_streams_give_the_batch_result(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    stream = table_stream(spark, str(tmp_path), "events")
    out = frames.windowed_stats(stream, "ts", "event_type", "value", delay="1000 days")
    out.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start().awaitTermination()
    key = lambda r: (r.start, r.event_type)
    got = {key(r): (r.n, round(r["mean"], 6)) for r in spark.table("windows").collect()}
    want = {key(r): (r.n, round(r["mean"], 6)) for r in frames.windowed_stats(events, "ts", "event_type", "value").collect()}
    assert got == want
    doubled = table_stream(spark, str(tmp_path), "events")
    once = frames.first_frames(doubled.unionByName(table_stream(spark, str(tmp_path), "events")), ["event_id"], "ts", "1000 days")
    once.writeStream.format("memory").queryName("once").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == events.count()
