"""What the findings of round 4 named: plans, sizes and results that were wrong before."""

import duckdb
import pytest
from pyspark.sql import functions as F

from siltstone import catalogue
from siltstone.operators import pairs, phases, thermo

DATA = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["xrd_reflections", "hkl_families"])
def test_reflections_join_nothing(spark, name):
    assert "Join" not in _plan(catalogue.QUERIES[name](spark, DATA))


def test_pattern_broadcasts_no_exploded_rows(spark):
    assert "Broadcast" not in _plan(catalogue.QUERIES["xrd_pattern"](spark, DATA))


@pytest.mark.parametrize("name", ["local_structure", "periodic_pairs"])
def test_pairs_broadcast_no_exploded_sites(spark, name):
    assert "Broadcast" not in _plan(catalogue.QUERIES[name](spark, DATA))


def test_bond_orders_broadcast_no_exploded_atoms(spark):
    assert "Broadcast" not in _plan(catalogue.QUERIES["bond_orders"](spark, DATA))


@pytest.fixture(scope="module")
def many_suppliers(spark, tmp_path_factory):
    """More suppliers of one nation than a V2000 count holds, with keys of six digits."""
    folder = str(tmp_path_factory.mktemp("suppliers"))
    key = F.col("id") + 99_000
    spark.range(1500).select(key.alias("s_suppkey"), F.lit(3).alias("s_nationkey")).write.parquet(f"{folder}/supplier.parquet")
    return folder


def _same_as_sql(df, name, folder, tables):
    db = duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = db.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in df.columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    plain = lambda rows: sorted(tuple("null" if v is None else f"{float(v):.5f}" if isinstance(v, (int, float)) else str(v) for v in r) for r in rows)
    assert plain(df.collect()) == plain(want)


def test_pdb_numbers_beyond_their_columns(spark, many_suppliers):
    _same_as_sql(catalogue.QUERIES["pdb_file"](spark, many_suppliers), "pdb_file", many_suppliers, ["supplier"])


def test_mol_of_more_than_999_atoms(spark, many_suppliers):
    _same_as_sql(catalogue.QUERIES["mol_file"](spark, many_suppliers), "mol_file", many_suppliers, ["supplier"])


def test_ages_next_to_whole_minutes(spark, tmp_path):
    times = [f"'2024-01-1{day} 12:00:00'::TIMESTAMP + INTERVAL ({us}) MICROSECOND" for day in (4, 5, 6) for us in (-501, -500, -499, -1, 0, 1, 499, 500, 501)] + ["'1960-01-01 00:00:59.9995'::TIMESTAMP"]
    (tmp_path / "events.parquet").mkdir()
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {', '.join(f'({k}, {t})' for k, t in enumerate(times))}) v(event_id, ts)) TO '{tmp_path}/events.parquet/a.parquet' (FORMAT parquet)")
    _same_as_sql(catalogue.QUERIES["age_in_words"](spark, str(tmp_path)), "age_in_words", str(tmp_path), ["events"])


def test_entries_on_one_plane(spark):
    """Four binary compounds and the middle on one flat face: all of them are stable together."""
    rows = [("s", 1, 2.0, 1.0, 1.0, -1.0), ("s", 2, 1.0, 2.0, 1.0, -1.0), ("s", 3, 1.0, 1.0, 2.0, -1.0), ("s", 4, 1.0, 1.0, 1.0, -1.0), ("s", 5, 3.0, 3.0, 2.0, -1.0)]
    df = spark.createDataFrame(rows, "system string, entry long, a double, b double, c double, energy double")
    parts = ["a", "b", "c"]
    facets = thermo.sections(df, "system", "entry", parts, "energy")
    lines = {tuple(sorted((r.a.entry, r.b.entry))) for r in thermo.tie_lines(facets, "system").collect() if r.a.entry and r.b.entry}
    assert lines == {(i, j) for i in range(1, 6) for j in range(i + 1, 6)}
    domains = phases.stability_domains(df, "system", "entry", parts, "energy").collect()
    assert {r.entry for r in domains} == {1, 2, 3, 4, 5}
    for r in thermo.decompose(df, facets, "system", "entry", parts).collect():
        assert r.hull_energy == pytest.approx(-1.0)
        assert r.phases


@pytest.mark.parametrize("name", ["ternary_tie_lines", "stability_domains", "ternary_decomposition"])
def test_phases_on_one_plane_equal_sql(spark, name, tmp_path):
    """Energies that leave planes with more than three entries, by keys in which the odd term is a line."""
    made = spark.range(400).select((F.col("id") * 1009 * 97 + F.col("id") % 36).alias("p_partkey"), F.lit("b").alias("p_brand"), (F.floor(F.col("id") / 7) % 50 + 1).cast("int").alias("p_size"))
    made.write.parquet(f"{tmp_path}/part.parquet")
    _same_as_sql(catalogue.QUERIES[name](spark, str(tmp_path)), name, str(tmp_path), ["part"])


def test_nearest_in_blocks_with_ties(spark, monkeypatch):
    monkeypatch.setattr(pairs, "QUERY_BLOCK", 3)
    monkeypatch.setattr(pairs, "ITEM_BLOCK", 7)
    rows = spark.range(40).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 5).cast("float"), (F.col("id") % 3).cast("float")).alias("embedding"))
    got = pairs.nearest(rows.where("vec_id % 4 = 0"), rows, "embedding", "vec_id", 4).collect()
    at = [(k, (k % 5, k % 3)) for k in range(40)]
    want = set()
    for q, (x, y) in at[::4]:
        near = sorted((((x - a) ** 2 + (y - b) ** 2) ** 0.5, o) for o, (a, b) in at if o != q)[:4]
        want |= {(q, o, round(d, 9), n) for n, (d, o) in enumerate(near, 1)}
    assert {(r.vec_id, r.other, round(r.distance, 9), r.rank) for r in got} == want
    assert "CartesianProduct" not in _plan(pairs.nearest(rows, rows, "embedding", "vec_id", 4)) and "NestedLoop" not in _plan(pairs.nearest(rows, rows, "embedding", "vec_id", 4))


def test_gaps_read_no_open_frame(spark):
    plan = _plan(catalogue.QUERIES["clean_series"](spark, DATA))
    assert "unboundedfollowing" not in plan.lower()


@pytest.mark.parametrize("name", ["common_neighbours", "bond_angle_histogram", "coordination_polyhedra"])
def test_neighbours_meet_in_the_task_of_their_cell(spark, name):
    assert "FlatMapCoGroupsInPandas" in _plan(catalogue.QUERIES[name](spark, DATA))


def test_fragments_send_no_pairs(spark):
    plan = _plan(pairs.clusters(catalogue._sites(spark, DATA), 0.8))
    assert "FlatMapCoGroups" not in plan  # links of cells are stored before the rounds
    sites = spark.createDataFrame([(0, 9, 0.0, 0.0, 0.0), (0, 4, 0.9, 0.0, 0.0), (0, 2, 1.9, 0.0, 0.0), (0, 1, 3.0, 0.0, 0.0), (1, 0, 0.1, 0.0, 0.0), (1, 8, None, 0.0, 0.0)], "group int, site long, x double, y double, z double")
    assert {(r.site, r.fragment) for r in pairs.clusters(sites, 1.0).collect()} == {(9, 2), (4, 2), (2, 2), (1, 1), (0, 0), (8, 8)}
