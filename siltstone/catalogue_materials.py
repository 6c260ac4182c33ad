"""Registered queries of the crystal, volume, spectrum, graph, phase and writer operators."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .catalogue import _ODD, _OWNER, ORACLE_SQL, QUERIES, _PAIRS, _alloys, _alloys_sql, _sites, load, query, rounded
from .operators import crystal, graph, pairs, phases, spectral, volume
from .sources import writers

__all__ = ["ORACLE_SQL", "QUERIES"]


def _cells(spark, d):
    """Cells from the first nine numbers of a vector, with 4 added on the diagonal."""
    names = [f"{v}{k}" for v in "abc" for k in "xyz"]
    made = [(F.col("embedding")[i].cast("double") + (4.0 if i % 4 == 0 else 0.0)).alias(n) for i, n in enumerate(names)]
    return load(spark, d, "embeddings").select("vec_id", *made)


_CELLS = "WITH t AS (SELECT vec_id, " + ", ".join(
    f"embedding[{i + 1}]::DOUBLE + {4.0 if i % 4 == 0 else 0.0} AS {v}{k}" for i, (v, k) in enumerate((v, k) for v in "abc" for k in "xyz")
) + " FROM embeddings)"


def _quoted(sql: str) -> str:
    """The column `by` in quotes; keywords are in upper case here."""
    return re.sub(r"\bby\b", '"by"', sql)


_NORM = {v: f"sqrt({v}x * {v}x + {v}y * {v}y + {v}z * {v}z)" for v in "abc"}
_DET = "(ax * (by * cz - bz * cy) - ay * (bx * cz - bz * cx) + az * (bx * cy - by * cx))"


def _angle_sql(u: str, v: str) -> str:
    return f"round(degrees(acos(({u}x * {v}x + {u}y * {v}y + {u}z * {v}z) / ({_NORM[u]} * {_NORM[v]}))), 6)"


@query(_quoted(
    f"{_CELLS} SELECT vec_id, round({_NORM['a']}, 6) AS a, round({_NORM['b']}, 6) AS b, round({_NORM['c']}, 6) AS c, "
    f"{_angle_sql('b', 'c')} AS alpha, {_angle_sql('a', 'c')} AS beta, {_angle_sql('a', 'b')} AS gamma, round(abs({_DET}), 6) AS volume FROM t"
))
def lattice_parameters(spark, d):
    return rounded(crystal.lattice_parameters(_cells(spark, d), "vec_id"))


_RECIPROCAL = "SELECT vec_id, " + ", ".join(
    f"({u}{p} * {v}{q} - {u}{q} * {v}{p}) / {_DET} AS {n}{k}"
    for n, u, v in (("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b"))
    for k, p, q in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y"))
) + " FROM t"


@query(_quoted(f"{_CELLS}, r AS ({_RECIPROCAL}) SELECT vec_id, " + ", ".join(f"round({v}{k}, 9) AS {v}{k}" for v in "abc" for k in "xyz") + " FROM r"))
def reciprocal_lattice(spark, d):
    return rounded(crystal.reciprocal(_cells(spark, d), "vec_id"), 9)


_LEAST_MOST = "2 * sin(radians(5.0)) / 1.54184", "2 * sin(radians(25.0)) / 1.54184"
_POINTS = _quoted(f"""{_CELLS}, r AS ({_RECIPROCAL}),
    n AS (SELECT vec_id, (x.range - 7)::INTEGER AS h, (y.range - 7)::INTEGER AS k, (z.range - 7)::INTEGER AS l, r.* EXCLUDE vec_id FROM r, range(15) x, range(15) y, range(15) z),
    g AS (SELECT vec_id, h, k, l, sqrt((h * ax + k * bx + l * cx) ** 2 + (h * ay + k * by + l * cy) ** 2 + (h * az + k * bz + l * cz) ** 2) AS g FROM n),
    p AS (SELECT vec_id, h, k, l, g, 2 * degrees(asin(g * 1.54184 / 2)) AS two_theta FROM g WHERE g > 1e-12 AND g BETWEEN {_LEAST_MOST[0]} AND {_LEAST_MOST[1]})
""")


def _points(spark, d):
    return crystal.reflections(_cells(spark, d), "vec_id", 1.54184, (10.0, 50.0))


@query(_POINTS + "SELECT vec_id, h, k, l, round(g, 6) AS g, round(two_theta, 5) AS two_theta FROM p")
def xrd_reflections(spark, d):
    return _points(spark, d).select("vec_id", "h", "k", "l", F.round("g", 6).alias("g"), F.round("two_theta", 5).alias("two_theta"))


_ATOMS = """
    s AS (SELECT vec_id, 0.0 AS u, 0.0 AS v, 0.0 AS w, 11.0 AS weight FROM t UNION ALL SELECT vec_id, 0.5, 0.5, 0.5, 17.0 FROM t),
    f AS (SELECT p.vec_id, h, k, l, any_value(two_theta) AS two_theta,
        sum(weight * cos(2 * pi() * (h * u + k * v + l * w))) ** 2 + sum(weight * sin(2 * pi() * (h * u + k * v + l * w))) ** 2 AS f2 FROM p JOIN s ON p.vec_id = s.vec_id GROUP BY 1, 2, 3, 4)
"""


@query(_POINTS + "," + _ATOMS + """,
    i AS (SELECT vec_id, round(two_theta, 5) AS two_theta, sum(f2 * (1 + cos(radians(two_theta)) ** 2) / (sin(radians(two_theta / 2)) ** 2 * cos(radians(two_theta / 2)))) AS i, count(*) AS multiplicity FROM f GROUP BY 1, 2),
    x AS (SELECT *, 100 * i / max(i) OVER (PARTITION BY vec_id) AS intensity FROM i)
    SELECT vec_id, two_theta, round(intensity, 5) AS intensity, multiplicity FROM x WHERE intensity > 0.1
""")
def xrd_pattern(spark, d):
    cells = _cells(spark, d).select("vec_id")
    sites = cells.withColumn("site", F.explode(F.array(*[F.struct(F.lit(x).alias("u"), F.lit(x).alias("v"), F.lit(x).alias("w"), F.lit(z).alias("weight")) for x, z in ((0.0, 11.0), (0.5, 17.0))]))).select("vec_id", "site.*")
    return rounded(crystal.powder_pattern(crystal.structure_factors(_points(spark, d), sites, "vec_id"), "vec_id"), 5)


@query(_POINTS + """
    , f AS (SELECT vec_id, array_to_string(list_sort([abs(h), abs(k), abs(l)]), ',') AS family, {'h': h, 'k': k, 'l': l} AS m FROM p)
    SELECT vec_id, family, max(m).h || ',' || max(m).k || ',' || max(m).l AS representative, count(*) AS multiplicity FROM f GROUP BY 1, 2
""")
def hkl_families(spark, d):
    return crystal.families(_points(spark, d), "vec_id")


_FRACTIONS = "WITH f AS (SELECT vec_id, (vec_id % 10) / 10.0 AS u, (vec_id % 7) / 7.0 AS v, (vec_id % 4) / 4.0 AS w FROM embeddings)"


def _fractions(spark, d):
    return load(spark, d, "embeddings").select("vec_id", ((F.col("vec_id") % 10) / 10.0).alias("u"), ((F.col("vec_id") % 7) / 7.0).alias("v"), ((F.col("vec_id") % 4) / 4.0).alias("w"))


@query(_FRACTIONS + """
    SELECT vec_id, x.range::INTEGER AS i, y.range::INTEGER AS j, z.range::INTEGER AS k, round((u + x.range) / 2, 6) AS u, round((v + y.range) / 1, 6) AS v, round((w + z.range) / 3, 6) AS w
    FROM f, range(2) x, range(1) y, range(3) z
""")
def supercell(spark, d):
    return rounded(crystal.supercell(_fractions(spark, d), (2, 1, 3)))


@query(_FRACTIONS + """
    , a AS (SELECT vec_id, v, w, unnest(CASE WHEN u < 0.05 THEN [u, u + 1] WHEN 1 - u < 0.05 THEN [u, u - 1] ELSE [u] END) AS u2, u FROM f),
    b AS (SELECT vec_id, u2, u, w, v, unnest(CASE WHEN v < 0.05 THEN [v, v + 1] WHEN 1 - v < 0.05 THEN [v, v - 1] ELSE [v] END) AS v2 FROM a),
    c AS (SELECT *, unnest(CASE WHEN w < 0.05 THEN [w, w + 1] WHEN 1 - w < 0.05 THEN [w, w - 1] ELSE [w] END) AS w2 FROM b)
    SELECT vec_id, round(u2, 6) AS u, round(v2, 6) AS v, round(w2, 6) AS w, u2 <> u OR v2 <> v OR w2 <> w AS is_image FROM c
""")
def boundary_images(spark, d):
    return rounded(crystal.boundary_images(_fractions(spark, d)))


@query(_FRACTIONS + """
    , n AS (SELECT vec_id, u, v, w FROM f UNION ALL SELECT vec_id, -u, -v, -w FROM f UNION ALL SELECT vec_id, 0.5 + v, u, w FROM f)
    SELECT DISTINCT vec_id, round(u - floor(u), 4) % 1.0 AS u, round(v - floor(v), 4) % 1.0 AS v, round(w - floor(w), 4) % 1.0 AS w FROM n
""")
def equivalent_positions(spark, d):
    names = [f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)] + ["t1", "t2", "t3"]
    ops = [[1.0, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0], [-1.0, 0, 0, 0, -1, 0, 0, 0, -1, 0, 0, 0], [0.0, 1, 0, 1, 0, 0, 0, 0, 1, 0.5, 0, 0]]
    table = spark.createDataFrame([tuple(map(float, x)) for x in ops], ", ".join(f"{n} double" for n in names))
    return crystal.apply_operations(_fractions(spark, d), table, ["vec_id"])


@query("""
    SELECT o_orderkey, n AS number, CASE WHEN n < 1 THEN NULL WHEN n <= 2 THEN 'triclinic' WHEN n <= 15 THEN 'monoclinic' WHEN n <= 74 THEN 'orthorhombic'
        WHEN n <= 142 THEN 'tetragonal' WHEN n <= 167 THEN 'trigonal' WHEN n <= 194 THEN 'hexagonal' WHEN n <= 230 THEN 'cubic' END AS system FROM (SELECT o_orderkey, (o_orderkey % 235)::INTEGER AS n FROM orders)
""")
def crystal_systems(spark, d):
    numbered = load(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 235).cast("int").alias("number"))
    return numbered.withColumn("system", crystal.crystal_system(F.col("number")))


@query(_PAIRS + """
    , k AS (SELECT *, row_number() OVER (PARTITION BY "group", site ORDER BY distance, other) AS r FROM p),
    n AS (SELECT * FROM k WHERE r <= 4),
    q AS (SELECT a."group", a.site, (a.dx + b.dx) ** 2 + (a.dy + b.dy) ** 2 + (a.dz + b.dz) ** 2 AS s, row_number() OVER (PARTITION BY a."group", a.site ORDER BY (a.dx + b.dx) ** 2 + (a.dy + b.dy) ** 2 + (a.dz + b.dz) ** 2) AS o
        FROM n a JOIN n b ON a."group" = b."group" AND a.site = b.site AND a.r < b.r),
    c AS (SELECT "group", site, sum(s) AS csp FROM q WHERE o <= 2 GROUP BY 1, 2),
    m AS (SELECT "group", site, count(*) AS c FROM n GROUP BY 1, 2)
    SELECT "group", site, round(CASE WHEN c = 4 THEN csp END, 6) AS csp FROM m LEFT JOIN c USING ("group", site)
""")
def centrosymmetry(spark, d):
    return rounded(crystal.centrosymmetry(pairs.radius_pairs(_sites(spark, d), 0.8), 4))


@query(_PAIRS + """
    , t AS (SELECT a."group", a.site, a.other, b.other AS third FROM p a JOIN p b ON a."group" = b."group" AND a.other = b.site JOIN p c ON c."group" = a."group" AND c.site = a.site AND c.other = b.other),
    n AS (SELECT "group", site, other, count(*) AS n_common FROM t GROUP BY ALL),
    e AS (SELECT x."group", x.site, x.other, count(*) AS n_bonds FROM t x JOIN t y ON x."group" = y."group" AND x.site = y.site AND x.other = y.other AND x.third < y.third
        JOIN p z ON z."group" = x."group" AND z.site = x.third AND z.other = y.third GROUP BY ALL)
    SELECT p."group", p.site, p.other, coalesce(n_common, 0) AS n_common, coalesce(n_bonds, 0) AS n_bonds FROM p LEFT JOIN n USING ("group", site, other) LEFT JOIN e USING ("group", site, other)
""")
def common_neighbours(spark, d):
    return pairs.common_neighbours(_sites(spark, d), 0.8)


# --- volumes: a gyroid-like field of 12 by 10 by 8 points for each region ---

_GRID = """WITH g AS (SELECT r_regionkey AS vol, x.range AS i, y.range AS j, z.range AS k,
    sin(x.range * 0.5 + r_regionkey) * cos(y.range * 0.6) + sin(y.range * 0.6) * cos(z.range * 0.7) AS value FROM region, range(12) x, range(10) y, range(8) z)
"""


def _grid(spark, d):
    out = load(spark, d, "region").select(F.col("r_regionkey").alias("vol"))
    for name, n in zip("ijk", (12, 10, 8), strict=True):
        out = out.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")))
    value = F.sin(F.col("i") * 0.5 + F.col("vol")) * F.cos(F.col("j") * 0.6) + F.sin(F.col("j") * 0.6) * F.cos(F.col("k") * 0.7)
    return out.withColumn("value", value)


@query(_GRID + "SELECT vol, round(min(value), 6) AS low, round(max(value), 6) AS high, round(max(abs(value)), 6) AS abs_max, round(avg(value), 6) AS mean FROM g GROUP BY 1")
def grid_range(spark, d):
    return rounded(volume.data_range(_grid(spark, d), "vol"))


@query(_GRID + "SELECT vol, i * 5 // 12 AS i, j * 4 // 10 AS j, k * 3 // 8 AS k, round(avg(value), 6) AS value FROM g GROUP BY 1, 2, 3, 4")
def grid_downsample(spark, d):
    return rounded(volume.downsample(_grid(spark, d), "vol", (12, 10, 8), (5, 4, 3)))


@query(_GRID + """
    , p AS (SELECT vec_id, (vec_id % 5)::INTEGER AS vol, (vec_id % 17) / 17.0 * 12 AS x, (vec_id % 13) / 13.0 * 10 AS y, (vec_id % 11) / 11.0 * 8 AS z FROM embeddings),
    c AS (SELECT vec_id, vol, (floor(x) + a.range)::BIGINT % 12 AS i, (floor(y) + b.range)::BIGINT % 10 AS j, (floor(z) + e.range)::BIGINT % 8 AS k,
        abs(1 - a.range - (x - floor(x))) * abs(1 - b.range - (y - floor(y))) * abs(1 - e.range - (z - floor(z))) AS w FROM p, range(2) a, range(2) b, range(2) e)
    SELECT vol, vec_id, round(sum(w * value), 6) AS value FROM c JOIN g USING (vol, i, j, k) GROUP BY 1, 2
""")
def trilinear_samples(spark, d):
    points = load(spark, d, "embeddings").select((F.col("vec_id") % 5).cast("int").alias("vol"), "vec_id", *[((F.col("vec_id") % n) / float(n)).alias(c) for c, n in zip("uvw", (17, 13, 11), strict=True)])
    return rounded(volume.sample(_grid(spark, d), points, "vol", "vec_id", (12, 10, 8)))


@query(_GRID + """
    , m AS (SELECT vol, max(abs(value)) AS m FROM g GROUP BY 1)
    SELECT vol, range::INTEGER AS layer, round(m * (0.8 - 0.7 * range / 3), 6) AS level FROM m, range(4)
""")
def surface_levels(spark, d):
    return rounded(volume.surface_levels(volume.data_range(_grid(spark, d), "vol"), "vol", 4))


# --- spectra ---


@query("""
    WITH f AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events)
    SELECT user_id, f AS frequency, round((sum(value * cos(2 * pi() * f * t)) ** 2 + sum(value * sin(2 * pi() * f * t)) ** 2) / count(*), 4) AS power
    FROM f, (SELECT unnest([0.05, 0.1, 0.2, 0.4])::DOUBLE AS f) GROUP BY 1, 2
""")
def fourier_power(spark, d):
    from .catalogue import _frames

    return rounded(spectral.fourier_power(_frames(spark, d), "user_id", "frame", "value", [0.05, 0.1, 0.2, 0.4]), 4)


@query("""
    SELECT vec_id, round(45 * ((a + b + c) / 3) ** 2 + 7 * (((a - b) ** 2 + (b - c) ** 2 + (c - a) ** 2) / 2 + 3 * (e ** 2 + f ** 2 + g ** 2)), 6) AS activity
    FROM (SELECT vec_id, embedding[1]::DOUBLE a, embedding[2]::DOUBLE b, embedding[3]::DOUBLE c, embedding[4]::DOUBLE e, embedding[5]::DOUBLE f, embedding[6]::DOUBLE g FROM embeddings)
""")
def raman_activity(spark, d):
    parts = [F.col("embedding")[k].cast("double") for k in range(6)]
    return rounded(load(spark, d, "embeddings").select("vec_id", spectral.raman_activity(*parts).alias("activity")))


@query("SELECT event_id, round(value * 33.35640952, 6) AS wavenumber FROM events")
def frequency_units(spark, d):
    return rounded(load(spark, d, "events").select("event_id", spectral.convert_frequency(F.col("value"), "cm-1").alias("wavenumber")))


# --- graphs ---


@query("""
    SELECT 'r' || r_regionkey AS name, 0 AS depth, 'r' || r_regionkey AS path FROM region
    UNION ALL SELECT 'n' || n_nationkey, 1, 'r' || n_regionkey || '/n' || n_nationkey FROM nation
""")
def parent_levels(spark, d):
    top = load(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("name"), F.lit(None).cast("string").alias("parent"))
    below = load(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("name"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return graph.levels(top.unionByName(below), "name", "parent")


@query(_PAIRS.replace("WITH s AS", "WITH RECURSIVE s AS") + """
    , w AS (SELECT site, site AS f FROM s UNION SELECT p.other, w.f FROM w JOIN p ON p.site = w.site)
    SELECT site, min(f) AS fragment FROM w GROUP BY 1
""")
def fragments(spark, d):
    sites = _sites(spark, d)
    return pairs.clusters(sites, 0.8)


@query("""
    WITH RECURSIVE l AS (SELECT DISTINCT p_partkey % 60 AS s, CASE WHEN p_partkey % 60 IN (20, 44) THEN p_partkey % 60 - 5 ELSE p_partkey % 60 + 1 + p_size % 2 END AS t FROM part),
    r AS (SELECT s, t FROM l UNION SELECT r.s, l.t FROM r JOIN l ON l.s = r.t),
    c AS (SELECT DISTINCT s AS n FROM r WHERE s = t)
    SELECT n AS node FROM c UNION
    SELECT a.t FROM r a JOIN c ON c.n = a.s JOIN r b ON b.s = a.t JOIN c e ON e.n = b.t
""")
def cyclic_nodes(spark, d):
    s = F.col("p_partkey") % 60
    t = F.when(s.isin(20, 44), s - 5).otherwise(s + 1 + F.col("p_size") % 2)
    return graph.cyclic_nodes(load(spark, d, "part").select(s.alias("source"), t.alias("target")))


# --- phases ---


@query("""
    SELECT vec_id, CASE WHEN x >= 0.5 AND x < 1 AND y >= 0 AND y < 1 THEN 'right' WHEN x >= 0 AND x < 1 AND y >= 0 AND y < 1 THEN 'square' END AS region
    FROM (SELECT vec_id, (vec_id % 23) / 20.0 + 0.001 AS x, (vec_id % 31) / 28.0 + 0.001 AS y FROM embeddings)
""")
def phase_lookup(spark, d):
    points = load(spark, d, "embeddings").select("vec_id", ((F.col("vec_id") % 23) / 20.0 + 0.001).alias("x"), ((F.col("vec_id") % 31) / 28.0 + 0.001).alias("y"))
    box = lambda a: [(a, 0.0), (1.0, 0.0), (1.0, 1.0), (a, 1.0)]
    regions = spark.createDataFrame([("square", 0, box(0.0)), ("right", 1, box(0.5))], "region string, number int, vertices array<struct<x: double, y: double>>")
    return phases.phase_at(points, regions, "vec_id")


@query("""
    SELECT event_id, round((value + 459.67) * 5 / 9 - 273.15, 6) AS celsius, CASE WHEN user_id % 6 = 1 THEN 'unary' WHEN user_id % 6 = 2 THEN 'binary' WHEN user_id % 6 = 3 THEN 'ternary'
        WHEN user_id % 6 = 4 THEN 'quaternary' WHEN user_id % 6 = 5 THEN 'multinary' END AS kind FROM events
""")
def temperatures_and_categories(spark, d):
    rows = load(spark, d, "events")
    return rounded(rows.select("event_id", phases.convert_temperature(F.col("value"), "F", "C").alias("celsius"), phases.category(F.col("user_id") % 6).alias("kind")))


@query(_alloys_sql(3, _ODD, f"""
    , q AS (SELECT l.p_brand, l.x0, l.x1, l.x2, l.m, {_OWNER} AS entry FROM l
        UNION ALL SELECT DISTINCT p_brand, v.a, v.b, v.c, v.e, NULL FROM e, (VALUES (1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0), (-1.0, 0.0, 0.0, 10.0), (0.0, -1.0, 0.0, 10.0), (0.0, 0.0, -1.0, 10.0)) v(a, b, c, e)),
    g AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY x0, x1, x2, m, entry) AS n FROM q),
    z AS (SELECT a.p_brand, a.entry AS e0, b.entry AS e1, c.entry AS e2, a.x0 * (b.x1 * c.x2 - b.x2 * c.x1) - a.x1 * (b.x0 * c.x2 - b.x2 * c.x0) + a.x2 * (b.x0 * c.x1 - b.x1 * c.x0) AS det,
            a.m * (b.x1 * c.x2 - b.x2 * c.x1) + b.m * (c.x1 * a.x2 - c.x2 * a.x1) + c.m * (a.x1 * b.x2 - a.x2 * b.x1) AS y0,
            a.m * (b.x2 * c.x0 - b.x0 * c.x2) + b.m * (c.x2 * a.x0 - c.x0 * a.x2) + c.m * (a.x2 * b.x0 - a.x0 * b.x2) AS y1,
            a.m * (b.x0 * c.x1 - b.x1 * c.x0) + b.m * (c.x0 * a.x1 - c.x1 * a.x0) + c.m * (a.x0 * b.x1 - a.x1 * b.x0) AS y2
        FROM g a JOIN g b ON b.p_brand = a.p_brand AND b.n > a.n JOIN g c ON c.p_brand = a.p_brand AND c.n > b.n),
    u AS (SELECT DISTINCT p_brand, unnest([e0, e1, e2]) AS entry, y0 / det AS mu0, y1 / det AS mu1, y2 / det AS mu2 FROM z WHERE abs(det) > 1e-9)
    SELECT DISTINCT u.p_brand, u.entry AS p_partkey, round(round(mu0, 9), 6) + 0 AS mu_x0, round(round(mu1, 9), 6) + 0 AS mu_x1, round(round(mu2, 9), 6) + 0 AS mu_x2 FROM u
    WHERE u.entry IS NOT NULL AND NOT EXISTS (SELECT 1 FROM g WHERE g.p_brand = u.p_brand AND g.x0 * mu0 + g.x1 * mu1 + g.x2 * mu2 > g.m + 1e-8)
"""))
def stability_domains(spark, d):
    """The corners of every stable entry's domain, a ternary system a brand."""
    found = phases.stability_domains(_alloys(spark, d, 3, _ODD), "p_brand", "p_partkey", ["x0", "x1", "x2"], "energy")
    return rounded(found, 6).distinct()


# --- writers ---


@query("""
    SELECT p_partkey || ',' || chr(34) || p_name || ', ' || repeat(chr(34), 2) || 'new' || repeat(chr(34), 3) || ',' || p_size AS value FROM part
""")
def csv_lines(spark, d):
    rows = load(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(', "new"')).alias("name"), "p_size")
    return writers.lines(rows, "csv")


@query(r"SELECT '| ' || n_nationkey || ' | ' || n_name || '\|x |' AS value FROM nation")
def markdown_lines(spark, d):
    return writers.lines(load(spark, d, "nation").select("n_nationkey", F.concat("n_name", F.lit("|x"))), "markdown")


@query(r"SELECT n_nationkey || ' & ' || replace(n_name, '_', '\_') || '\_x \\' AS value FROM nation")
def latex_lines(spark, d):
    return writers.lines(load(spark, d, "nation").select("n_nationkey", F.concat("n_name", F.lit("_x"))), "latex")
