"""Queries of dates, numbers as text, planar geometry, curves and merged tables."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import functions as F

from .catalogue import query, rounded
from .functions import dates, geometry, text
from .operators import curves, table
from .sources.tables import table as load

# --- columns and dates ---


@query("""
    SELECT k AS "column", min(event_id) AS first, count(*) AS n, count(try_cast(json_extract_string(props, k) AS DOUBLE)) AS n_numeric, 'numeric' AS kind
    FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) GROUP BY 1
""")
def discover_columns(spark, d):
    return table.discover_columns(load(spark, d, "events"), "props", "event_id")


_OBJECTS = """
    o AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN json_object('name', p_name, 'time', p_size, 'Energy', p_retailprice, 'code', CASE WHEN p_partkey % 2 = 0 THEN to_json(p_size) ELSE to_json(p_brand) END)
        WHEN 1 THEN json_object('height', p_size / 2.0, 'time', p_size, 'gap', NULL, 'Energy', p_retailprice, 'digits', p_size::VARCHAR) ELSE json_object('time', NULL, 'name', p_brand, 'width', p_size, 'height', p_partkey) END AS props FROM part),
    k AS (SELECT p_partkey, k.unnest AS "column", (k.ordinality - 1)::BIGINT AS place, json_type(props, '$.' || k.unnest) AS t FROM o, unnest(json_keys(props)) WITH ORDINALITY k),
    c AS (SELECT "column", min(p_partkey) AS first, min_by(place, p_partkey) AS place, count(*) FILTER (t <> 'NULL') AS n, count(*) FILTER (t IN ('BIGINT', 'UBIGINT', 'DOUBLE')) AS n_numeric, count(*) FILTER (t = 'VARCHAR') AS n_string FROM k GROUP BY 1),
    j AS (SELECT *, CASE WHEN n > 0 AND n_numeric >= 0.8 * n THEN 'numeric' WHEN n > 0 AND n_string >= 0.8 * n THEN 'string' ELSE 'mixed' END AS kind FROM c)
"""


def _objects(spark, d):
    """JSON objects of three shapes, with nulls, numbers as text and a key of two types."""
    rows = load(spark, d, "part")
    code = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.concat(F.lit('"'), "p_brand", F.lit('"')))
    first = F.format_string('{"name": "%s", "time": %d, "Energy": %s, "code": %s}', "p_name", "p_size", F.col("p_retailprice").cast("string"), code)
    second = F.format_string('{"height": %s, "time": %d, "gap": null, "Energy": %s, "digits": "%d"}', (F.col("p_size") / 2.0).cast("string"), "p_size", F.col("p_retailprice").cast("string"), "p_size")
    third = F.format_string('{"time": null, "name": "%s", "width": %d, "height": %d}', "p_brand", "p_size", "p_partkey")
    kind = F.col("p_partkey") % 3
    return rows.select("p_partkey", F.when(kind == 0, first).when(kind == 1, second).otherwise(third).alias("props"))


@query(f"""WITH {_OBJECTS} SELECT * FROM j""")
def extracted_columns(spark, d):
    return table.extract_columns(_objects(spark, d), "props", "p_partkey")


@query(f"""
    WITH {_OBJECTS}, q AS (SELECT *, row_number() OVER (ORDER BY first, place) AS pos, lower("column") AS l FROM j),
    x AS (SELECT coalesce((SELECT min_by("column", pos) FROM q WHERE kind = 'numeric' AND l IN ('x', 'time', 'step', 'index', 'iteration', 'frame', 'epoch')),
        (SELECT min_by("column", pos) FROM q WHERE kind = 'string' AND l NOT IN ('y', 'energy', 'value', 'force', 'stress', 'loss', 'score'))) AS x),
    y AS (SELECT x, coalesce((SELECT min_by("column", pos) FROM q WHERE kind = 'numeric' AND "column" <> x AND l IN ('y', 'energy', 'value', 'force', 'stress', 'loss', 'score')), (SELECT min_by("column", pos) FROM q WHERE kind = 'numeric' AND "column" <> x)) AS y FROM x),
    z AS (SELECT x, y, (SELECT min_by("column", pos) FROM q WHERE kind = 'numeric' AND "column" NOT IN (x, y) AND l IN ('z', 'altitude', 'depth', 'height')) AS z FROM y)
    SELECT CASE WHEN z IS NOT NULL THEN 'scatter3d' ELSE 'scatter' END AS plot, x, y, z, (SELECT min_by("column", pos) FROM q WHERE kind = 'numeric' AND "column" NOT IN (x, y, z)) AS color FROM z
""")
def suggested_axes(spark, d):
    return table.suggest_axes(table.extract_columns(_objects(spark, d), "props", "p_partkey"))


_DATES = """
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT06:30:15.123456Z')
        WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d 06:30:15+02:00') ELSE strftime(o_orderdate, '%d.%m.%Y') END AS written FROM orders
"""


def _written(spark, d):
    at, kind = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 4
    made = F.when(kind == 0, F.date_format(at, "yyyy-MM-dd")).when(kind == 1, F.date_format(at, "yyyy-MM-dd'T06:30:15.123456Z'"))
    made = made.when(kind == 2, F.date_format(at, "yyyy-MM-dd' 06:30:15+02:00'")).otherwise(F.date_format(at, "dd.MM.yyyy"))
    return load(spark, d, "orders").withColumn("written", made)


@query("""
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN epoch_ms(o_orderdate) WHEN 1 THEN epoch_ms(o_orderdate) + 23415123 WHEN 2 THEN epoch_ms(o_orderdate) + 16215000 END AS millis FROM orders
""")
def parse_dates(spark, d):
    return _written(spark, d).select("o_orderkey", F.unix_millis(dates.parse_datetime(F.col("written"))).alias("millis"))


@query("""
    SELECT 'mixed' AS "column", count(*) AS n, count(*) FILTER (o_orderkey % 4 <> 3) AS n_dates, 'datetime' AS kind FROM orders
    UNION ALL SELECT 'bare', count(*), count(*), 'date' FROM orders
    UNION ALL SELECT 'priority', count(*), 0, NULL FROM orders
""")
def infer_date_columns(spark, d):
    bare = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd")
    rows = _written(spark, d).select(F.col("written").alias("mixed"), bare.alias("bare"), F.col("o_orderpriority").alias("priority"))
    return dates.infer_kind(rows, ["mixed", "bare", "priority"])


@query("""
    WITH s AS (SELECT o_orderkey, o_orderkey % 3 AS k, epoch_ms(o_orderdate) AS ms FROM orders)
    SELECT o_orderkey, CASE WHEN k = 0 AND ms >= 1000000000000 OR k = 1 AND ms >= 1000000000000 THEN ms WHEN k = 1 AND ms >= 1000000000 THEN ms * 1000 END AS millis FROM s
""")
def timestamps_of_numbers(spark, d):
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    kind = F.col("o_orderkey") % 3
    number = F.when(kind == 0, seconds).when(kind == 1, seconds * 1000).otherwise(F.lit(5))
    return load(spark, d, "orders").select("o_orderkey", F.unix_millis(dates.timestamp_of_number(number)).alias("millis"))


_NOW = "2024-01-15 12:00:00"


@query(f"""
    WITH s AS (SELECT event_id, epoch_ms('{_NOW}'::TIMESTAMP) - epoch_ms(ts) AS d, abs(epoch_ms('{_NOW}'::TIMESTAMP) - epoch_ms(ts)) // 60000 AS m FROM events),
    u AS (SELECT event_id, d, [[m // 525600, 0], [m % 525600 // 43200, 1], [m % 525600 % 43200 // 10080, 2], [m % 525600 % 43200 % 10080 // 1440, 3], [m % 525600 % 43200 % 10080 % 1440 // 60, 4], [m % 525600 % 43200 % 10080 % 1440 % 60, 5]] AS p FROM s)
    SELECT event_id, array_to_string(list_transform(list_filter(p, lambda x: x[1] > 0 OR x[2] = 5)[1:3], lambda x: x[1] || ['y', 'mo', 'w', 'd', 'h', 'm'][x[2] + 1]), ' ') || CASE WHEN d >= 0 THEN ' ago' ELSE ' from now' END AS age FROM u
""")
def age_in_words(spark, d):
    rows = load(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return rows.select("event_id", dates.since(F.col("ts"), F.to_timestamp(F.lit(_NOW))).alias("age"))


@query("""
    SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M') AS time, strftime(ts, '%Y-%m-%d %H:%M') AS datetime, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM events
""")
def written_times(spark, d):
    ts = F.col("ts").cast("timestamp")
    return load(spark, d, "events").select("event_id", *[dates.written(ts, mode).alias(mode) for mode in ("date", "time", "datetime", "iso")])


# --- numbers and formulas as text ---


@query("""
    SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '-' || p_size || 'e-3' WHEN 1 THEN p_size || 'e4' ELSE p_size::VARCHAR END AS plain FROM part
""")
def plain_numbers(spark, d):
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    written = F.when(kind == 0, F.concat(F.lit("−"), size, F.lit(" × 10⁻³"))).when(kind == 1, F.concat(size, F.lit("·10^4"))).otherwise(F.concat(F.lit(" "), size))
    return load(spark, d, "part").select("p_partkey", text.normalize_number(written).alias("plain"))


@query("""
    SELECT p_partkey, 'Fe' AS element, (1 + p_size % 3)::INTEGER AS state FROM part
    UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'O' ELSE 'Cl' END, CASE WHEN p_partkey % 2 = 0 THEN -2 ELSE -1 END FROM part
""")
def oxidation_states(spark, d):
    charge = F.element_at(F.array(F.lit("+"), F.lit("²⁺"), F.lit("3+")), (1 + F.col("p_size") % 3).cast("int"))
    other = F.when(F.col("p_partkey") % 2 == 0, "O₂²⁻").otherwise("Cl-")
    written = F.concat(F.lit("Fe"), charge, F.lit(" "), F.when(F.col("p_partkey") % 2 == 0, F.lit("O²⁻")).otherwise(other))
    return load(spark, d, "part").select("p_partkey", F.explode(text.charges(written)).alias("c")).select("p_partkey", "c.element", "c.state")


@query("SELECT p_partkey, 'Fe' || (1 + p_size % 4) || 'O' || p_size || '·2H2O^2-' AS formula FROM part")
def plain_formulas(spark, d):
    sub = F.translate((1 + F.col("p_size") % 4).cast("string"), "0123456789", text.SUBSCRIPTS)
    size = F.translate(F.col("p_size").cast("string"), "0123456789", text.SUBSCRIPTS)
    return load(spark, d, "part").select("p_partkey", text.normalize_formula(F.concat(F.lit("Fe "), sub, F.lit("O"), size, F.lit(" ⋅ 2H₂O²⁻"))).alias("formula"))


@query("""
    SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 OR p_size % 5 = 0 AND p_partkey % 4 = 1 THEN NULL WHEN p_partkey % 4 = 0 THEN 1 + p_size % 5 WHEN p_partkey % 4 = 1 THEN 2 * (p_size % 5) ELSE 6 END::BIGINT AS cells FROM part
""")
def supercell_scaling(spark, d):
    size, kind = F.col("p_size") % 5, F.col("p_partkey") % 4
    written = F.when(kind == 0, F.concat((1 + size).cast("string"), F.lit("x1x1"))).when(kind == 1, F.concat(F.lit("2×"), size.cast("string"), F.lit("×1"))).when(kind == 2, F.lit("1 x 2 x 3")).otherwise(F.lit("2x2"))
    cells = F.aggregate(text.scaling(written), F.lit(1).cast("long"), lambda a, b: a * b)
    return load(spark, d, "part").select("p_partkey", cells.alias("cells"))


# --- geometry and physics ---


@query("""
    SELECT event_id, round(CASE WHEN value > 0 THEN 1e10 * 6.62607015e-34 / sqrt(value * 1000 * 1.602176634e-19 * 2 * 9.1093837015e-31
        * (1 + value * 1000 * 1.602176634e-19 / (2 * 9.1093837015e-31 * 299792458.0 ** 2))) END, 9) AS wavelength FROM events
""")
def electron_wavelengths(spark, d):
    return rounded(load(spark, d, "events").select("event_id", geometry.electron_wavelength(F.col("value")).alias("wavelength")), 9)


@query("SELECT event_id, round(sqrt(greatest(0.1 * tan(radians(x / 2)) ** 2 - 0.05 * tan(radians(x / 2)) + 0.02, 0)), 9) AS width FROM (SELECT event_id, event_id % 170 AS x FROM events)")
def peak_widths(spark, d):
    return rounded(load(spark, d, "events").select("event_id", geometry.caglioti_width(F.col("event_id") % 170, 0.1, -0.05, 0.02).alias("width")), 9)


@query(f"""
    WITH s AS (SELECT p_partkey, 1.0 + p_partkey % 4 AS a, p_size % 3 AS b, p_size % 5 AS c, p_partkey % 7 AS d FROM part)
    SELECT p_partkey, round((b + c / 2) / (a + b + c), 9) AS x3, round(c * {sqrt(3) / 2} / (a + b + c), 9) AS y3,
        round((b + (c + d) / 2) / (a + b + c + d), 9) AS x4, round((c * {sqrt(3) / 2} + d * {sqrt(3) / 6}) / (a + b + c + d), 9) AS y4, round(d * {sqrt(2 / 3)} / (a + b + c + d), 9) AS z4 FROM s
""")
def simplex_places(spark, d):
    shares = [(1.0 + F.col("p_partkey") % 4), F.col("p_size") % 3, F.col("p_size") % 5, F.col("p_partkey") % 7]
    flat, solid = geometry.simplex_place(shares[:3]), geometry.simplex_place(shares)
    named = [c.alias(n) for c, n in zip([*flat, *solid], ("x3", "y3", "x4", "y4", "z4"), strict=True)]
    return rounded(load(spark, d, "part").select("p_partkey", *named), 9)


@query("""
    WITH s AS (SELECT event_id, event_id % 11 - 5.0 AS x0, event_id % 7 - 3.0 AS y0, event_id % 13 - 6.0 AS x1, event_id % 5 - 2.0 AS y1 FROM events),
    t AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy FROM s),
    c AS (SELECT *, greatest(0, CASE WHEN dx <> 0 THEN least((-2 - x0) / dx, (2 - x0) / dx) ELSE 0 END, CASE WHEN dy <> 0 THEN least((-1 - y0) / dy, (1 - y0) / dy) ELSE 0 END) AS f,
        least(1, CASE WHEN dx <> 0 THEN greatest((-2 - x0) / dx, (2 - x0) / dx) ELSE 1 END, CASE WHEN dy <> 0 THEN greatest((-1 - y0) / dy, (1 - y0) / dy) ELSE 1 END) AS l FROM t)
    SELECT event_id, round(x0 + f * dx, 6) + 0.0 AS ax, round(y0 + f * dy, 6) + 0.0 AS ay, round(x0 + l * dx, 6) + 0.0 AS bx, round(y0 + l * dy, 6) + 0.0 AS by FROM c
    WHERE f <= l AND NOT (dx = 0 AND abs(x0) > 2) AND NOT (dy = 0 AND abs(y0) > 1)
""")
def clipped_segments(spark, d):
    k = F.col("event_id")
    part = geometry.clip_segment(k % 11 - 5.0, k % 7 - 3.0, k % 13 - 6.0, k % 5 - 2.0, (-2.0, -1.0), (2.0, 1.0))
    return rounded(load(spark, d, "events").select("event_id", part.alias("s")).where("s is not null").select("event_id", "s.*"))


@query("""
    WITH c AS (SELECT s_nationkey, s_suppkey, (s_suppkey * 7) % 23 AS x, s_acctbal / 1000 AS y FROM supplier),
    n AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w2) AS nx, coalesce(lead(y) OVER w, first(y) OVER w2) AS ny FROM c
        WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey), w2 AS (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    a AS (SELECT s_nationkey, sum(x * ny - nx * y) / 2 AS a, sum((x + nx) * (x * ny - nx * y)) AS mx, sum((y + ny) * (x * ny - nx * y)) AS my, avg(x) AS ax, avg(y) AS ay,
        min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM n GROUP BY 1)
    SELECT s_nationkey, round(abs(a), 6) AS area, round(CASE WHEN abs(a) > 1e-9 THEN mx / (6 * a) ELSE ax END, 7) AS cx, round(CASE WHEN abs(a) > 1e-9 THEN my / (6 * a) ELSE ay END, 7) AS cy,
        x0::DOUBLE AS x0, x1::DOUBLE AS x1, round(y0, 6) AS y0, round(y1, 6) AS y1 FROM a
""")
def polygon_areas(spark, d):
    corners = load(spark, d, "supplier").select("s_nationkey", "s_suppkey", ((F.col("s_suppkey") * 7) % 23).cast("double").alias("x"), (F.col("s_acctbal") / 1000).alias("y"))
    out = curves.polygons(corners, "s_nationkey", "s_suppkey", "x", "y")
    exact = ("cx", "cy")
    return rounded(out.drop(*exact)).join(rounded(out.select("s_nationkey", *exact), 7), "s_nationkey")


# --- curves ---

_HOURS = "SELECT event_type, floor(epoch(ts) / 3600)::BIGINT AS h, round(avg(value), 6) AS v, round(avg(value) FILTER (user_id % 2 = 0), 6) AS even, round(avg(value) FILTER (user_id % 2 = 1), 6) AS odd FROM events GROUP BY 1, 2"


def _hours(spark, d):
    rows = load(spark, d, "events")
    h = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).cast("long")
    mean = lambda k: F.round(F.avg(F.when(F.col("user_id") % 2 == k, F.col("value"))), 6)
    return rows.groupBy("event_type", h.alias("h")).agg(F.round(F.avg("value"), 6).alias("v"), mean(0).alias("even"), mean(1).alias("odd"))


@query(f"""
    WITH s AS (SELECT * FROM ({_HOURS}) WHERE h % 3 = 0), q AS (SELECT event_type, h FROM ({_HOURS})),
    b AS (SELECT q.event_type, q.h, a.h AS ha, a.v AS va FROM q ASOF LEFT JOIN s a ON a.event_type = q.event_type AND a.h <= q.h),
    c AS (SELECT b.*, n.h AS hb, n.v AS vb FROM b ASOF LEFT JOIN s n ON n.event_type = b.event_type AND n.h >= b.h)
    SELECT event_type, h, round(CASE WHEN ha IS NULL THEN vb WHEN hb IS NULL OR ha = h THEN va ELSE va + (vb - va) * (h - ha) / (hb - ha) END, 6) AS v FROM c
""")
def interpolated_hours(spark, d):
    hours = _hours(spark, d)
    return rounded(curves.interpolate(hours.where("h % 3 = 0"), hours, "event_type", "h", "v"))


@query(f"""
    WITH s AS (SELECT *, lead(h) OVER w - h AS h1, (lead(v) OVER w - v) / (lead(h) OVER w - h) AS s1 FROM ({_HOURS}) WINDOW w AS (PARTITION BY event_type ORDER BY h)),
    p AS (SELECT *, lag(h1) OVER w AS h0, lag(s1) OVER w AS s0 FROM s WINDOW w AS (PARTITION BY event_type ORDER BY h)),
    t AS (SELECT *, CASE WHEN s0 IS NOT NULL AND s1 IS NOT NULL THEN (sign(s0) + sign(s1)) * least(abs(s0), abs(s1), abs((s0 * h1 + s1 * h0) / (h0 + h1)) / 2) END AS t FROM p)
    SELECT event_type, h, v, round(coalesce(t, CASE WHEN s0 IS NULL THEN coalesce((3 * s1 - lead(t) OVER w) / 2, s1) ELSE coalesce((3 * s0 - lag(t) OVER w) / 2, s0) END, 0), 6) AS tangent
    FROM t WINDOW w AS (PARTITION BY event_type ORDER BY h)
""")
def monotone_slopes(spark, d):
    return rounded(curves.monotone_tangents(_hours(spark, d), "event_type", "h", "v"))


_TANGENTS = f"""
    WITH r AS (SELECT event_type, h, v FROM ({_HOURS}) WHERE h % 3 = 0),
    s AS (SELECT *, lead(h) OVER w - h AS h1, (lead(v) OVER w - v) / (lead(h) OVER w - h) AS s1 FROM r WINDOW w AS (PARTITION BY event_type ORDER BY h)),
    p AS (SELECT *, lag(h1) OVER w AS h0, lag(s1) OVER w AS s0 FROM s WINDOW w AS (PARTITION BY event_type ORDER BY h)),
    t AS (SELECT *, CASE WHEN s0 IS NOT NULL AND s1 IS NOT NULL THEN (sign(s0) + sign(s1)) * least(abs(s0), abs(s1), abs((s0 * h1 + s1 * h0) / (h0 + h1)) / 2) END AS t FROM p),
    k AS (SELECT event_type, h, v, coalesce(t, CASE WHEN s0 IS NULL THEN coalesce((3 * s1 - lead(t) OVER w) / 2, s1) ELSE coalesce((3 * s0 - lag(t) OVER w) / 2, s0) END, 0) AS t FROM t WINDOW w AS (PARTITION BY event_type ORDER BY h)),
    q AS (SELECT event_type, h FROM ({_HOURS})),
    a AS (SELECT q.event_type, q.h, max(k.h) AS x0 FROM q LEFT JOIN k ON k.event_type = q.event_type AND k.h <= q.h GROUP BY 1, 2),
    b AS (SELECT q.event_type, q.h, min(k.h) AS x1 FROM q LEFT JOIN k ON k.event_type = q.event_type AND k.h > q.h GROUP BY 1, 2),
    j AS (SELECT a.event_type, a.h, a.x0, b.x1, c.v AS y0, c.t AS t0, d.v AS y1, d.t AS t1, (a.h - a.x0) / (b.x1 - a.x0)::DOUBLE AS f, (b.x1 - a.x0) / 3.0 AS e
        FROM a JOIN b USING (event_type, h) LEFT JOIN k c ON c.event_type = a.event_type AND c.h = a.x0 LEFT JOIN k d ON d.event_type = a.event_type AND d.h = b.x1)
"""


@query(_TANGENTS + """
    SELECT event_type, h, round(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 ELSE (1 - f) ** 3 * y0 + 3 * (1 - f) ** 2 * f * (y0 + e * t0) + 3 * (1 - f) * f ** 2 * (y1 - e * t1) + f ** 3 * y1 END, 6) AS monotone,
        round(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 WHEN f < 0.5 THEN y0 ELSE y1 END, 6) AS step,
        round(CASE WHEN x0 IS NULL THEN y1 ELSE y0 END, 6) AS "after", round(CASE WHEN x1 IS NULL OR h = x0 THEN y0 ELSE y1 END, 6) AS "before"
    FROM j
""")
def curve_values(spark, d):
    """Curves through every third hour at all hours."""
    hours = _hours(spark, d).select("event_type", "h", "v")
    knots, found = hours.where("h % 3 = 0"), None
    for kind in ("monotone", "step", "after", "before"):
        values = curves.evaluate(knots, hours, "event_type", "h", "v", kind).withColumnRenamed("v", kind)
        found = values if found is None else found.join(values, ["event_type", "h"])
    return rounded(found)


@query(f"""
    WITH g AS (SELECT event_type, h, even - odd AS g FROM ({_HOURS}) WHERE even IS NOT NULL AND odd IS NOT NULL),
    n AS (SELECT *, coalesce((g > 0) <> lag(g > 0) OVER w, true) AS new, lead(h) OVER w AS nh, lead(g) OVER w AS ng FROM g WINDOW w AS (PARTITION BY event_type ORDER BY h)),
    s AS (SELECT *, sum(new::BIGINT) OVER (PARTITION BY event_type ORDER BY h)::BIGINT AS segment FROM n)
    SELECT event_type, segment, min(h) AS start, max(h) AS "end", count(*) AS points, round(sum(CASE WHEN ng > 0 THEN (nh - h) * (g + ng) / 2 ELSE 0 END), 6) AS area
    FROM s WHERE g > 0 GROUP BY 1, 2 HAVING count(*) > 1
""")
def filled_segments(spark, d):
    return rounded(curves.fill_segments(_hours(spark, d), "event_type", "h", "even", "odd"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(var_samp(value), 0), 6) AS variance FROM events GROUP BY 1")
def merged_variances(spark, d):
    parts = load(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("m2"))
    return rounded(curves.merge_variances(parts.where("n > 0"), "event_type"))


@query("""
    WITH o AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN -c_acctbal END AS v FROM customer WHERE c_custkey % 2 = 0)
    SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(v, c_acctbal) AS c_acctbal, n.c_custkey IS NOT NULL AS updated FROM o FULL JOIN n ON n.c_custkey = o.c_custkey
""")
def merged_series(spark, d):
    rows = load(spark, d, "customer").select("c_custkey", "c_acctbal")
    new = rows.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 != 0, -F.col("c_acctbal")))
    return curves.merge_series(rows.where("c_custkey % 3 <> 0"), new, ["c_custkey"], "c_acctbal")
