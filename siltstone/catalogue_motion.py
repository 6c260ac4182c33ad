"""Registered queries of spectra, correlations, formula patterns, bond orders and pair distributions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalogue import _FRAMES, _PAIRS, ORACLE_SQL, QUERIES, _events, _frames, _sites, load, query, rounded
from .operators import bond_orders as bond_order
from .operators import distributions, motion, pairs, patterns, spectral, transform

__all__ = ["ORACLE_SQL", "QUERIES"]

# --- spectra by direct sums ---

#: From `s` (g, c, position, value, weight, n of the group): padded size, and power by bin of each component.
_DIRECT = """
    z AS (SELECT *, avg(value) OVER (PARTITION BY g, c) AS mean, (2 ** ceil(log2(4 * n)))::BIGINT AS size FROM s),
    w AS (SELECT *, 0.5 * (1 + cos(pi() * abs(2 * position - (n - 1)) / (n - 1))) AS w FROM z WHERE n > 1),
    b AS (SELECT g, c, n, size, any_value(weight) AS weight, sum(w * w) AS energy, list((value - mean) * w ORDER BY position) AS v FROM w GROUP BY 1, 2, 3, 4),
    k AS (SELECT *, unnest(range(size // 2 + 1)) AS bin FROM b),
    t AS (SELECT g, c, n, size, weight, energy, bin, unnest(v) AS x, unnest(range(n)) AS j FROM k),
    q AS (SELECT g, c, size, bin, any_value(weight) / any_value(energy) AS scale, sum(x * cos(2 * pi() * ((j * bin) % size) / size)) AS re, sum(x * sin(2 * pi() * ((j * bin) % size) / size)) AS im FROM t GROUP BY 1, 2, 3, 4),
    p AS (SELECT g, size, bin, bin::DOUBLE / size AS frequency, sum(scale * CASE WHEN bin = 0 OR 2 * bin = size THEN 1 ELSE 2 END * (re * re + im * im)) AS power FROM q GROUP BY 1, 2, 3)
"""


@query(_FRAMES + f"""
    , s AS (SELECT user_id AS g, 0 AS c, frame - 1 AS position, value, 1.0 AS weight, count(*) OVER (PARTITION BY user_id) AS n FROM f), {_DIRECT}
    SELECT g AS user_id, bin, round(frequency, 6) AS frequency, round(power, 4) AS power FROM p
""")
def periodogram(spark, d):
    found = spectral.periodogram(_events(spark, d), "user_id", ["ts", "event_id"], "value", 1.0)
    return found.select("user_id", "bin", F.round("frequency", 6).alias("frequency"), (F.round("power", 4) + 0.0).alias("power"))


@query(_FRAMES + """
    SELECT a.user_id, b.frame - a.frame AS lag, round(avg(a.value * b.value) + 1.234567e-7, 4) AS value FROM f a JOIN f b ON b.user_id = a.user_id AND b.frame >= a.frame GROUP BY 1, 2
""")
def autocorrelation(spark, d):
    """All lags of every user's values; means of few products have few digits, so they are moved off rounding ties."""
    rows = _frames(spark, d).select("user_id", (F.col("frame") - 1).alias("position"), "value", F.lit(0).alias("component"))
    found = transform.autocorrelation(rows, "user_id", "component", "position", "value")
    return rounded(found.withColumn("value", F.col("value") + 1.234567e-7), 4)


_MOVING = """WITH e AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM embeddings)"""


def _moving(spark, d):
    """The vectors of a label as the frames of a trajectory."""
    w = Window.partitionBy("label").orderBy("vec_id")
    return load(spark, d, "embeddings").select("label", "embedding", (F.row_number().over(w) - 1).cast("long").alias("frame"))


@query(_MOVING + f"""
    , x AS (SELECT label, frame, a.range AS atom, 1 + a.range % 3 AS mass, c.range AS axis, embedding[(a.range * 2 + c.range + 1)::INTEGER]::DOUBLE AS x FROM e, range(4) a, range(2) c),
    v AS (SELECT label, frame, atom, mass, axis, (lead(x) OVER w - lag(x) OVER w) / 2 AS v FROM x WINDOW w AS (PARTITION BY label, atom, axis ORDER BY frame)),
    u AS (SELECT *, v - sum(mass * v) OVER (PARTITION BY label, frame, axis) / sum(mass) OVER (PARTITION BY label, frame, axis) AS r FROM v WHERE v IS NOT NULL),
    s AS (SELECT label AS g, atom * 2 + axis AS c, frame - 1 AS position, r AS value, mass AS weight, count(*) OVER (PARTITION BY label, atom, axis) AS n FROM u), {_DIRECT}
    SELECT g AS label, bin, round(frequency, 6) AS frequency, round(power, 6) AS power FROM p
""")
def vibration_spectra(spark, d):
    atoms = F.explode(F.array(*[F.struct(F.lit(a).alias("atom"), F.lit(1 + a % 3).alias("mass"), *[F.col("embedding")[2 * a + k].cast("double").alias(c) for k, c in enumerate("xy")]) for a in range(4)]))
    frames = _moving(spark, d).select("label", "frame", atoms.alias("a")).select("label", "frame", "a.*")
    return rounded(motion.vibrations(frames, "label", "atom", "frame", ["x", "y"], "mass", 1.0))


@query(_MOVING + f"""
    , s AS (SELECT label AS g, c.range AS c, frame AS position, embedding[c.range::INTEGER + 1]::DOUBLE AS value, 1.0 AS weight, count(*) OVER (PARTITION BY label, c.range) AS n FROM e, range(3) c), {_DIRECT}
    SELECT g AS label, bin, round(frequency, 6) AS frequency, round(power * (2 * pi() * frequency) ** 2, 6) AS power FROM p
""")
def infrared_spectra(spark, d):
    rows = _moving(spark, d).select("label", "frame", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")])
    return rounded(motion.infrared(rows, "label", "frame", ["x", "y", "z"], 1.0))


@query(_MOVING + f"""
    , h AS (SELECT label, frame, embedding[1]::DOUBLE AS xx, embedding[2]::DOUBLE AS yy, embedding[3]::DOUBLE AS zz, embedding[4]::DOUBLE AS xy, embedding[5]::DOUBLE AS xz, embedding[6]::DOUBLE AS yz FROM e),
    a AS (SELECT label, frame, unnest([(xx + yy + zz) / 3, xx - yy, yy - zz, zz - xx, xy, yz, xz]) AS value, unnest(range(7)) AS c FROM h),
    s AS (SELECT label * 2 + CASE WHEN c = 0 THEN 0 ELSE 1 END AS g, c, frame AS position, value, CASE WHEN c = 0 THEN 1.0 WHEN c < 4 THEN 0.5 ELSE 3.0 END AS weight, count(*) OVER (PARTITION BY label, c) AS n FROM a), {_DIRECT},
    r AS (SELECT g // 2 AS label, bin, frequency, sum(power * (2 * pi() * frequency) ** 2) FILTER (g % 2 = 0) AS i, sum(power * (2 * pi() * frequency) ** 2) FILTER (g % 2 = 1) AS a FROM p GROUP BY 1, 2, 3)
    SELECT label::INTEGER AS label, bin, round(frequency, 6) AS frequency, round(i, 6) AS isotropic, round(a, 6) AS anisotropic, round(45 * i + 4 * a, 6) AS vv, round(3 * a, 6) AS vh, round(45 * i + 7 * a, 6) AS unpolarized FROM r
""")
def raman_spectra(spark, d):
    names = ("xx", "yy", "zz", "xy", "xz", "yz")
    rows = _moving(spark, d).select("label", "frame", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(names)])
    return rounded(motion.raman(rows, "label", "frame", ("xx", "yy", "zz", "xy", "yz", "xz"), 1.0))


# --- formulas by patterns ---

_METALS, _ANIONS = ("Fe", "Co", "Ni", "Mn", "Cr"), ("O", "S", "F")
_COMPOUNDS = f"""
    c AS (SELECT p_partkey, p_partkey % 7 < 3 AS alloyed, 1 + p_size % 3 AS a, 1 + p_partkey % 4 AS b, 1 + p_partkey % 2 AS l,
        {list(_METALS)}[1 + p_size % 5] AS metal, {list(_ANIONS)}[1 + p_partkey % 3] AS anion FROM part)
"""


def _pick(names, k):
    return F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))


def _compounds(spark, d):
    """A binary compound a part, or a ternary one with lithium, and a pattern in which all but the anion are free."""
    key, size = F.col("p_partkey"), F.col("p_size")
    a, b, light = (x.cast("string") for x in (1 + size % 3, 1 + key % 4, 1 + key % 2))
    metal, anion, ternary = _pick(_METALS, size), _pick(_ANIONS, key), key % 7 < 3
    text = F.concat(F.when(ternary, F.concat(F.lit("Li"), light)).otherwise(F.lit("")), metal, a, anion, b)
    wild = F.concat(F.when(ternary, F.concat(F.lit("*"), light)).otherwise(F.lit("")), F.lit("*"), a, anion, b)
    return load(spark, d, "part").select(key, text.alias("formula"), wild.alias("pattern"))


_PATTERN_OF = "CASE WHEN alloyed THEN '*' || l ELSE '' END || '*' || a || anion || b"


@query(f"""
    WITH {_COMPOUNDS}, w AS (SELECT DISTINCT {_PATTERN_OF} AS pattern, alloyed, l, a, b, anion FROM c)
    SELECT c.p_partkey, w.pattern FROM c JOIN w ON w.alloyed = c.alloyed AND w.anion = c.anion
    WHERE (NOT c.alloyed AND w.a * c.b = c.a * w.b) OR (c.alloyed AND ((w.a * c.b = c.a * w.b AND w.l * c.b = c.l * w.b) OR (w.l * c.b = c.a * w.b AND w.a * c.b = c.l * w.b)))
""")
def pattern_matches(spark, d):
    """Compounds of the stoichiometry of each other's patterns."""
    rows = _compounds(spark, d)
    return patterns.match(rows.select("p_partkey", "formula"), "formula", rows.select("pattern"), "pattern").select("p_partkey", "pattern")


@query(f"""
    WITH {_COMPOUNDS}, w AS (SELECT DISTINCT {_PATTERN_OF} AS pattern, alloyed, anion FROM c WHERE p_partkey % 10 = 0)
    SELECT c.p_partkey, w.pattern FROM c JOIN w ON w.alloyed = c.alloyed AND w.anion = c.anion
""")
def system_matches(spark, d):
    """Compounds whose elements are those of a pattern, whatever their amounts; the patterns are those of every tenth part."""
    rows = _compounds(spark, d)
    found = patterns.match(rows.select("p_partkey", "formula"), "formula", rows.where("p_partkey % 10 = 0").select("pattern"), "pattern", exact=False)
    return found.select("p_partkey", "pattern")


# --- bond orders of molecules whose size and kind a part gives ---

#: A part's molecule: a ring (CH)n, flat or puckered; a chain O=C..C=O; a dinitrile N C..C N; n from 3 to 10.
_MOLECULES = """
    m AS (SELECT p_partkey * 32 AS base, 3 + p_size % 8 AS n, p_partkey % 3 AS kind, p_partkey % 2 = 0 AS flat FROM part),
    b AS (
        SELECT base, kind, n, flat, base + range AS a, base + range + 1 AS b, range AS k FROM m, range(9) WHERE range < n - 1
        UNION ALL SELECT base, kind, n, flat, base, base + n - 1, n - 1 FROM m WHERE kind = 0
        UNION ALL SELECT base, kind, n, flat, base + range, base + 16 + range, NULL FROM m, range(10) WHERE kind = 0 AND range < n
        UNION ALL SELECT base, kind, n, flat, base, base + 16, -1 FROM m WHERE kind > 0
        UNION ALL SELECT base, kind, n, flat, base + n - 1, base + 17, n - 1 FROM m WHERE kind > 0)
"""


@query(f"""
    WITH {_MOLECULES}, s AS (SELECT *, kind = 1 OR n % 2 = 0 AS fine FROM b)
    SELECT a, b, CASE WHEN NOT fine THEN 1 WHEN kind = 1 THEN 2 WHEN kind = 0 THEN CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END
        WHEN k % 2 = 0 THEN 1 WHEN k IN (-1, n - 1) OR k % 2 = 1 THEN 3 END AS "order",
        kind = 0 AND k IS NOT NULL AND fine AND flat AND n % 4 = 2 AS aromatic, fine AS perceived
    FROM s
""")
def bond_orders(spark, d):
    base, n, kind = F.col("p_partkey") * 32, 3 + F.col("p_size") % 8, F.col("p_partkey") % 3
    made = load(spark, d, "part").select(base.cast("long").alias("base"), n.cast("int").alias("n"), kind.cast("int").alias("kind"), (F.col("p_partkey") % 2 == 0).alias("flat"))
    chain = made.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    turn = F.col("k") * 2 * 3.141592653589793 / F.col("n")
    height = F.when(F.col("flat"), 0.0).otherwise(F.when(F.col("k") % 2 == 0, 0.6).otherwise(-0.6))
    ring = F.col("kind") == 0

    def atom(site, element, x, y, z):
        return F.struct(site.cast("long").alias("site"), F.lit(element).alias("element"), x.alias("x"), y.alias("y"), z.alias("z"))

    line = F.col("k").cast("double")
    carbon = atom(F.col("base") + F.col("k"), "C", F.when(ring, 1.5 * F.cos(turn)).otherwise(line), F.when(ring, 1.5 * F.sin(turn)).otherwise(0.0), F.when(ring, height).otherwise(0.0))
    hydrogen = atom(F.col("base") + 16 + F.col("k"), "H", 2.5 * F.cos(turn), 2.5 * F.sin(turn), height)
    atoms = chain.select(F.inline(F.when(ring, F.array(carbon, hydrogen)).otherwise(F.array(carbon))))
    ends = made.where("kind > 0").select(F.inline(F.array(*[F.struct((F.col("base") + 16 + k).alias("site"), F.when(F.col("kind") == 1, "O").otherwise("N").alias("element"), F.lit(float(20 * k - 5)).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")) for k in (0, 1)])))
    at = F.col("base") + F.col("k")
    bonds = chain.where("k < n - 1").select(at.alias("a"), (at + 1).alias("b"))
    bonds = bonds.unionByName(made.where(ring).select(F.col("base").alias("a"), (F.col("base") + F.col("n") - 1).alias("b")))
    bonds = bonds.unionByName(chain.where(ring).select(at.alias("a"), (at + 16).alias("b")))
    bonds = bonds.unionByName(made.where(~ring).select(F.inline(F.array(F.struct(F.col("base").alias("a"), (F.col("base") + 16).alias("b")), F.struct((F.col("base") + F.col("n") - 1).alias("a"), (F.col("base") + 17).alias("b"))))))
    return bond_order.perceive(atoms.unionByName(ends), bonds).select("a", "b", "order", "aromatic", "perceived")


# --- partial and total pair distributions ---

_LENGTHS = {"A": 1.0, "B": 2.5, "C": -0.5}
_PARTS = _PAIRS + """
    , t AS (SELECT "group", site, substr('ABC', (site % 3)::INTEGER + 1, 1) AS e FROM s),
    c AS (SELECT "group", e, count(*)::DOUBLE AS n FROM t GROUP BY 1, 2),
    m AS (SELECT "group", sum(n) AS total FROM c GROUP BY 1),
    h AS (SELECT p."group", a.e AS a, b.e AS b, floor(distance / 0.1 + 1e-9)::BIGINT AS bin, count(*)::DOUBLE AS n FROM p JOIN t a ON a."group" = p."group" AND a.site = p.site JOIN t b ON b."group" = p."group" AND b.site = p.other
        WHERE distance > 0 AND a.e <= b.e GROUP BY 1, 2, 3, 4),
    f AS (SELECT x."group", x.e AS a, y.e AS b, k.range AS bin, (k.range + 0.5)::DOUBLE * 0.1 AS r, coalesce(h.n, 0) AS n, x.n AS na, y.n AS nb, total,
            coalesce(h.n, 0) * 64 / (x.n * y.n * 4 / 3 * pi() * ((0.1 * (k.range + 1)) ** 3 - (0.1 * k.range) ** 3)) AS g
        FROM c x JOIN c y ON y."group" = x."group" AND x.e <= y.e JOIN m ON m."group" = x."group" CROSS JOIN range(8) k LEFT JOIN h ON h."group" = x."group" AND h.a = x.e AND h.b = y.e AND h.bin = k.range)
"""


def _parts(spark, d):
    sites = _sites(spark, d).withColumn("element", _pick(("A", "B", "C"), F.col("site")))
    cells = sites.select("group").distinct().withColumn("volume", F.lit(64.0))
    return distributions.partials(pairs.radius_pairs(sites, 0.8), sites, cells, 0.8, 8)


@query(_PARTS + """SELECT "group", a, b, bin, round(r, 6) AS r, n, round(g, 6) AS g, round(4 * pi() * r * (total / 64) * (g - 1), 6) AS reduced FROM f""")
def partial_distributions(spark, d):
    found = _parts(spark, d).withColumn("reduced", distributions.reduced(F.col("r"), F.col("g"), F.col("all_atoms") / F.col("volume")))
    return rounded(found.select("group", "a", "b", "bin", "r", "n", "g", "reduced"))


@query(_PARTS + """
    , l(e, l) AS (VALUES ('A', 1.0::DOUBLE), ('B', 2.5), ('C', -0.5)),
    w AS (SELECT c."group", sum(n / total * l) AS mean FROM c JOIN m USING ("group") JOIN l USING (e) GROUP BY 1),
    g AS (SELECT f."group", bin, any_value(r) AS r, any_value(total) AS total, sum(g * CASE WHEN a = b THEN 1 ELSE 2 END * na / total * nb / total * x.l * y.l / mean ** 2) AS g FROM f JOIN w USING ("group") JOIN l x ON x.e = a JOIN l y ON y.e = b GROUP BY 1, 2)
    SELECT "group", bin, round(r, 6) AS r, round(g, 6) AS g, round(4 * pi() * r * (total / 64) * (g - 1), 6) AS reduced FROM g
""")
def total_distribution(spark, d):
    lengths = spark.createDataFrame(list(_LENGTHS.items()), "element string, length double")
    return rounded(distributions.total(_parts(spark, d), lengths))


@query(_PARTS + """SELECT "group", a, b, round(sum(CASE WHEN r >= 0.2 AND r < 0.6 THEN 4 * pi() * r * r * nb / 64 * g * 0.1 ELSE 0 END), 6) AS neighbours FROM f GROUP BY 1, 2, 3""")
def shell_coordination(spark, d):
    return rounded(distributions.coordination(_parts(spark, d), 0.1, 0.2, 0.6))
