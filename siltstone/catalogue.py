"""All registered queries of the engine on the supplied tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import formula, numeric, text
from .operators import hierarchy, json_tree, pairs, series, stats, table, thermo, trajectory
from .plans import cleaning
from .sources.tables import table as load
from .streaming import frames

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- table layer ---


@query("""
    WITH u AS (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
        ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME "column" VALUE v)
    SELECT "column", count(v) AS n, min(v) AS min, round(quantile_cont(v, 0.05), 6) AS q05, round(quantile_cont(v, 0.5), 6) AS median,
        round(avg(v), 6) AS mean, round(quantile_cont(v, 0.95), 6) AS q95, max(v) AS max FROM u GROUP BY 1
""")
def column_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.column_stats(load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query("""
    WITH s AS (SELECT min(o_totalprice) a, max(o_totalprice) b, quantile_cont(o_totalprice, 0.05) p, quantile_cont(o_totalprice, 0.95) q FROM orders)
    SELECT 'minmax' AS mode, round(a, 6) AS low, round(b, 6) AS high FROM s
    UNION ALL SELECT 'diverging', round(-greatest(abs(a), abs(b)), 6), round(greatest(abs(a), abs(b)), 6) FROM s
    UNION ALL SELECT 'quantile', round(p, 6), round(q, 6) FROM s
""")
def color_domains(spark, d):
    return rounded(stats.color_domains(load(spark, d, "orders"), "o_totalprice"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 50000 AND 100000")
def numeric_filter(spark, d):
    return table.numeric_filter(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 50000, 100000)


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def category_filter(spark, d):
    return table.category_filter(load(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'al')")
def text_filter(spark, d):
    return table.text_filter(load(spark, d, "part").select("p_partkey", "p_name"), "p_name", "AL")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'st') OR contains(lower(p_type), 'st')")
def row_search(spark, d):
    return table.search(load(spark, d, "part").select("p_partkey", "p_name", "p_type"), " ST ", ["p_name", "p_type"])


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), 'r.*d.*w.*d')")
def fuzzy_search(spark, d):
    return table.search(load(spark, d, "part").select("p_partkey", "p_name"), "RDwd", ["p_name"], fuzzy=True)


@query("""
    SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
    ORDER BY o_orderpriority ASC, o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50
""")
def multi_sort_page(spark, d):
    rows = load(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return table.page(rows, [("o_orderpriority", True), ("o_totalprice", False), ("o_orderkey", True)], 3)


@query("""
    WITH v AS (SELECT DISTINCT p_brand AS v FROM part WHERE p_brand IS NOT NULL)
    SELECT count(*) AS n_distinct, count(*) <= 40 AS is_category, CASE WHEN count(*) <= 40 THEN string_agg(v, '|' ORDER BY v) END AS options FROM v
""")
def category_options(spark, d):
    return table.category_options(load(spark, d, "part"), "p_brand")


@query("""
    WITH u AS (UNPIVOT (SELECT event_type, value::VARCHAR AS value, user_id::VARCHAR AS user_id FROM events) ON event_type, value, user_id INTO NAME "column" VALUE v),
    s AS (SELECT "column", count(v) AS n, count(*) FILTER (try_cast(v AS DOUBLE) IS NOT NULL) AS n_numeric FROM u GROUP BY 1)
    SELECT *, CASE WHEN n_numeric >= 0.8 * n THEN 'numeric' WHEN n - n_numeric >= 0.8 * n THEN 'string' ELSE 'mixed' END AS kind FROM s
""")
def infer_types(spark, d):
    return table.infer_types(load(spark, d, "events"), ["event_type", "value", "user_id"])


@query("""
    SELECT n_regionkey, round(coalesce(avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING'), 0), 6) AS "BUILDING",
        round(coalesce(avg(c_acctbal) FILTER (c_mktsegment = 'MACHINERY'), 0), 6) AS "MACHINERY"
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
""")
def pivot_matrix(spark, d):
    rows = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = table.pivot_matrix(rows, "n_regionkey", "c_mktsegment", ["BUILDING", "MACHINERY"], F.avg("c_acctbal"))
    return rounded(out.na.fill(0.0))


@query("""
    WITH v AS (SELECT c_nationkey, c_mktsegment, max(c_acctbal) AS c_acctbal FROM customer GROUP BY ALL),
    a AS (SELECT * FROM (SELECT DISTINCT c_nationkey FROM customer), (SELECT DISTINCT c_mktsegment FROM customer))
    SELECT a.c_nationkey, a.c_mktsegment, coalesce(c_acctbal, 0) AS c_acctbal FROM a LEFT JOIN v USING (c_nationkey, c_mktsegment)
""")
def categorical_densify(spark, d):
    return table.densify(load(spark, d, "customer").select("c_nationkey", "c_mktsegment", "c_acctbal"), "c_nationkey", "c_mktsegment", "c_acctbal")


@query("""
    SELECT c_nationkey, c_custkey, c_acctbal, rank FROM
    (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)::INTEGER AS rank FROM customer) WHERE rank <= 3
""")
def top_k_per_group(spark, d):
    return table.top_k(load(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), "c_nationkey", [F.desc("c_acctbal"), F.asc("c_custkey")], 3)


@query("SELECT event_id, value FROM events WHERE event_id % 10 = 0")
def stride_sample(spark, d):
    return table.stride_sample(load(spark, d, "events").select("event_id", "value"), "event_id", 10)


@query("""
    SELECT user_id, event_type, event_id, value FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1
""")
def first_wins(spark, d):
    rows = load(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return table.first_wins(rows, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts")


# --- statistics ---

_HISTOGRAM = """
    WITH c AS (SELECT least(floor(({to} - {a}) / ({b} - {a}) * 20), 19)::BIGINT AS bin, count(*) AS count
        FROM lineitem WHERE l_extendedprice BETWEEN 1000 AND 90000 GROUP BY 1),
    h AS (SELECT range AS bin, coalesce(count, 0) AS count, {edge0} AS x0, {edge1} AS x1 FROM range(20) LEFT JOIN c ON bin = range)
    SELECT bin, round(x0, 6) AS x0, round(x1, 6) AS x1, count, round({value}, 9) AS value FROM h
"""


def _hist_sql(to: str, a: str, b: str, edge: str, value: str) -> str:
    at = lambda k: edge.replace("?", f"({a} + ({b} - {a}) * {k} / 20)")
    return _HISTOGRAM.format(to=to, a=a, b=b, edge0=at("range"), edge1=at("(range + 1)"), value=value)


def _hist(spark, d, scale, normalize):
    out = stats.histogram(load(spark, d, "lineitem"), "l_extendedprice", 1000, 90000, 20, scale, normalize)
    return out.select("bin", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"), "count", F.round("value", 9).alias("value"))


@query(_hist_sql("l_extendedprice", "1000.0", "90000.0", "?", "count::DOUBLE"))
def histogram_linear(spark, d):
    return _hist(spark, d, "linear", "count")


@query(_hist_sql("log10(l_extendedprice)", "log10(1000.0)", "log10(90000.0)", "pow(10.0, ?)", "count / sum(count) OVER ()"))
def histogram_log_probability(spark, d):
    return _hist(spark, d, "log", "probability")


@query(_hist_sql("asinh(l_extendedprice)", "asinh(1000.0)", "asinh(90000.0)", "sinh(?)", "count / sum(count) OVER () / (x1 - x0)"))
def histogram_arcsinh_density(spark, d):
    return _hist(spark, d, "arcsinh", "density")


_BOX = """
    WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) q1, quantile_cont(o_totalprice, 0.5) median, quantile_cont(o_totalprice, 0.75) q3,
        quantile_cont(o_totalprice, 0.05) p5, quantile_cont(o_totalprice, 0.95) p95, min(o_totalprice) a, max(o_totalprice) b, avg(o_totalprice) m, stddev_samp(o_totalprice) s
        FROM orders GROUP BY 1),
    j AS (SELECT o_orderpriority, o_totalprice v, q1, median, q3, {low} AS f, {high} AS t FROM orders JOIN q USING (o_orderpriority))
    SELECT o_orderpriority, round(first(q1), 6) AS q1, round(first(median), 6) AS median, round(first(q3), 6) AS q3,
        round({lo}, 6) AS low, round({hi}, 6) AS high, count(*) FILTER (v < f OR v > t) AS n_outliers FROM j GROUP BY 1
"""


def _box(spark, d, mode):
    return rounded(stats.box_stats(load(spark, d, "orders"), "o_orderpriority", "o_totalprice", mode))


@query(_BOX.format(low="q1 - 1.5 * (q3 - q1)", high="q3 + 1.5 * (q3 - q1)", lo="min(v) FILTER (v BETWEEN f AND t)", hi="max(v) FILTER (v BETWEEN f AND t)"))
def box_tukey(spark, d):
    return _box(spark, d, "tukey")


@query(_BOX.format(low="a", high="b", lo="first(f)", hi="first(t)"))
def box_minmax(spark, d):
    return _box(spark, d, "minmax")


@query(_BOX.format(low="p5", high="p95", lo="first(f)", hi="first(t)"))
def box_percentile(spark, d):
    return _box(spark, d, "percentile")


@query(_BOX.format(low="greatest(a, m - s)", high="least(b, m + s)", lo="first(f)", hi="first(t)"))
def box_std(spark, d):
    return _box(spark, d, "std")


_SILVERMAN = """
    WITH b AS (SELECT event_type, count(value) n, min(value) low, max(value) high, stddev_samp(value) s,
        (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34 AS iqr FROM events GROUP BY 1),
    w AS (SELECT event_type, n, low, high, CASE WHEN n < 2 OR (CASE WHEN iqr > 0 THEN least(s, iqr) ELSE s END) <= 0 THEN 1.0
        ELSE 0.9 * (CASE WHEN iqr > 0 THEN least(s, iqr) ELSE s END) * pow(n, -0.2) END AS bandwidth FROM b)
"""


@query(_SILVERMAN + "SELECT event_type, n, low, high, round(bandwidth, 6) AS bandwidth FROM w")
def silverman_bandwidth(spark, d):
    out = stats.silverman(load(spark, d, "events"), "event_type", "value")
    return out.withColumn("bandwidth", F.round("bandwidth", 6))


@query(_SILVERMAN + """
    , g AS (SELECT *, range::INTEGER AS point, low - 3 * bandwidth + (high - low + 6 * bandwidth) * range / 31 AS x FROM w, range(32))
    SELECT event_type, point, round(any_value(x), 6) AS x, round(sum(exp(-0.5 * ((x - value) / bandwidth) ** 2) / (n * bandwidth * 2.5066282746310002)), 6) AS density
    FROM g JOIN events USING (event_type) GROUP BY 1, 2
""")
def kde_silverman(spark, d):
    return rounded(stats.kde(load(spark, d, "events"), "event_type", "value"))


@query("""
    WITH s AS (SELECT l_returnflag, l_discount AS value, sum(l_quantity) w FROM lineitem GROUP BY ALL)
    SELECT l_returnflag, value, round(sum(w) OVER (PARTITION BY l_returnflag ORDER BY value) / sum(w) OVER (PARTITION BY l_returnflag), 6) AS cumulative FROM s
""")
def ecdf_weighted(spark, d):
    return rounded(stats.ecdf(load(spark, d, "lineitem"), "l_returnflag", "l_discount", "l_quantity"))


@query("""
    SELECT least(floor((l_quantity - 1) / 49 * 10), 9)::BIGINT AS xb, least(floor((l_extendedprice - 0) / 100000 * 12), 11)::BIGINT AS yb,
        count(*) AS count, min(l_orderkey) AS first_point FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 AND l_extendedprice BETWEEN 0 AND 100000 GROUP BY 1, 2
""")
def density_2d(spark, d):
    return stats.density_2d(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice", (1, 50), (0, 100000), 10, 12, F.col("l_orderkey"))


@query("SELECT floor((l_quantity - 0) / 5)::BIGINT AS bin, round(sum(l_extendedprice), 2) AS weight, count(*) AS n FROM lineitem WHERE l_extendedprice >= 0 GROUP BY 1")
def marginal_weights(spark, d):
    return rounded(stats.marginal(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 0, 5), 2)


@query("""
    WITH e AS (SELECT l_returnflag, least(min(l_discount), min(l_tax)) a, greatest(max(l_discount), max(l_tax)) b FROM lineitem GROUP BY 1)
    SELECT l_returnflag, round(a - 0.05 * (b - a), 6) AS low, round(b + 0.05 * (b - a), 6) AS high FROM e
""")
def padded_extents(spark, d):
    return rounded(stats.extents(load(spark, d, "lineitem"), "l_returnflag", ["l_discount", "l_tax"]))


@query("""
    WITH o AS (SELECT n_nationkey, n_regionkey, min(c_acctbal) low, max(c_acctbal) high FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
    SELECT *, min(low) OVER (PARTITION BY n_regionkey) AS row_low, max(high) OVER (PARTITION BY n_regionkey) AS row_high, min(low) OVER () AS all_low, max(high) OVER () AS all_high FROM o
""")
def facet_ranges(spark, d):
    rows = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return stats.facet_ranges(rows, "n_nationkey", "n_regionkey", "c_acctbal")


_YEARS = "SELECT year(o_orderdate) AS y, o_orderstatus AS s, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2"


def _years(spark, d):
    rows = load(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y"), F.col("o_orderstatus").alias("s"))
    return rows.agg(F.round(F.sum("o_totalprice"), 2).alias("v"))


@query(f"""
    WITH t AS ({_YEARS}) SELECT y, s, v, round(coalesce(sum(v) OVER (PARTITION BY y, v >= 0 ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS "offset" FROM t
""")
def stacked_offsets(spark, d):
    return rounded(stats.stacked_offsets(_years(spark, d), "y", "s", "v"), 2)


@query(f"WITH t AS ({_YEARS}), s AS (SELECT y, sum(v) FILTER (v >= 0) up FROM t GROUP BY 1) SELECT 0.0::DOUBLE AS low, round(max(up), 2) AS high FROM s")
def stacked_totals(spark, d):
    return rounded(stats.stacked_ranges(_years(spark, d), "y", "v"), 2)


@query("""
    WITH u AS (UNPIVOT (SELECT l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME key VALUE v),
    s AS (SELECT key, count(v) AS n, CASE WHEN abs(avg(v)) <= 1e-10 THEN stddev_pop(v) ELSE stddev_pop(v) / abs(avg(v)) END AS cv FROM u GROUP BY 1)
    SELECT key, n, round(cv, 6) AS cv, n >= 2 AND cv >= 1e-6 AS keep FROM s
""")
def property_cv_filter(spark, d):
    return rounded(stats.plottable(load(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]))


@query("SELECT event_type, event_id, round(value / max(abs(value)) OVER (PARTITION BY event_type), 6) AS normalized FROM events")
def normalize_by_max(spark, d):
    return rounded(stats.normalize_values(load(spark, d, "events"), "event_type", "event_id", "value"))


# --- series ---


def _events(spark, d):
    return load(spark, d, "events").select("user_id", "event_id", "ts", "value")


_ROWS = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"


@query(f"SELECT user_id, event_id, round(avg(value) OVER {_ROWS}, 6) AS smoothed FROM events")
def moving_average(spark, d):
    return rounded(series.moving_average(_events(spark, d), "user_id", ["ts", "event_id"], "value", 7).select("user_id", "event_id", "smoothed"))


@query(f"SELECT user_id, event_id, round(coalesce(var_samp(value) OVER {_ROWS}, 0), 6) AS variance FROM events")
def local_variance(spark, d):
    return rounded(series.local_variance(_events(spark, d), "user_id", ["ts", "event_id"], "value", 7).select("user_id", "event_id", "variance"))


def _savgol_sql() -> str:
    names = ["lag(value, 2)", "lag(value, 1)", "value", "lead(value, 1)", "lead(value, 2)"]
    # fixed values: least-squares weights of the centre for five points and degree two, over 35
    weights = [-3, 12, 17, 12, -3]
    parts = [(f"({n} OVER w)" if n != "value" else n, w) for n, w in zip(names, weights, strict=True)]
    total = " + ".join(f"coalesce({n} * {w}, 0)" for n, w in parts)
    weight = " + ".join(f"(CASE WHEN {n} IS NULL THEN 0 ELSE {w} END)" for n, w in parts)
    return f"SELECT user_id, event_id, round(({total}) / ({weight}), 6) AS smoothed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


@query(_savgol_sql())
def savgol(spark, d):
    return rounded(series.savitzky_golay(_events(spark, d), "user_id", ["ts", "event_id"], "value", 5).select("user_id", "event_id", "smoothed"))


_NEAR = """
    WITH n AS (SELECT user_id, event_id, ts, value, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) a,
        list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) b FROM events),
    m AS (SELECT *, list_concat(coalesce(a, []), coalesce(b, [])) c FROM n),
    k AS (SELECT *, list_median(c) AS median FROM m),
    j AS (SELECT *, list_median(list_transform(c, lambda x: abs(x - median))) AS mad FROM k)
"""


@query(_NEAR + "SELECT user_id, event_id, len(c) = 14 AND mad > 0 AND abs(value - median) > 2 * mad AS is_outlier FROM j")
def mad_outliers(spark, d):
    return series.local_outliers(_events(spark, d), "user_id", ["ts", "event_id"], "value").select("user_id", "event_id", "is_outlier")


@query("SELECT user_id, event_id, least(greatest(value, 20), 80) AS bounded FROM events")
def bounds_clamp(spark, d):
    return series.apply_bounds(_events(spark, d), "value", 20.0, 80.0).select("user_id", "event_id", "bounded")


@query("""
    WITH v AS (SELECT user_id, event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS v, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    f AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS va, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS p,
        first_value(v IGNORE NULLS) OVER e AS vb, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER e AS q FROM v
        WINDOW b AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), e AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT user_id, event_id, round(coalesce(v, CASE WHEN va IS NOT NULL AND vb IS NOT NULL THEN va + (vb - va) * (i - p) / (q - p) END, va, vb, 0), 6) AS filled FROM f
""")
def interpolate_gaps(spark, d):
    rows = _events(spark, d).withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return rounded(series.interpolate_gaps(rows, "user_id", ["ts", "event_id"], "value").select("user_id", "event_id", "filled"))


@query("""
    WITH s AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events),
    t AS (SELECT *, coalesce(sign(step) * sign(lag(step) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 0, false) AS turned FROM s)
    SELECT user_id, event_id, turned, round(avg(turned::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS turn_share FROM t
""")
def instability_scores(spark, d):
    out = series.derivative_signs(_events(spark, d), "user_id", ["ts", "event_id"], "value", 7)
    return rounded(out.select("user_id", "event_id", "turned", "turn_share"))


@query("""
    WITH r AS (SELECT event_type, floor(value)::DOUBLE AS x, count(*)::DOUBLE AS y FROM events GROUP BY 1, 2),
    p AS (SELECT r.event_type, r.x, t.x AS u, r.y, exp(-0.5 * ((r.x - t.x) / 2.0) ** 2) AS k FROM r JOIN r t ON r.event_type = t.event_type AND abs(r.x - t.x) <= 8),
    n AS (SELECT event_type, x, sum(k) AS norm FROM p GROUP BY 1, 2)
    SELECT event_type, u AS x, round(sum(y * k / norm), 6) AS smeared FROM p JOIN n USING (event_type, x) GROUP BY 1, 2
""")
def gaussian_smear(spark, d):
    rows = load(spark, d, "events").groupBy("event_type", F.floor("value").cast("double").alias("x")).agg(F.count("*").cast("double").alias("y"))
    return rounded(series.gaussian_smear(rows, "event_type", "x", "y", 2.0))


@query("""
    WITH p AS (SELECT floor(value)::DOUBLE AS x, count(*)::DOUBLE AS y FROM events GROUP BY 1),
    g AS (SELECT range AS grid, range * 1.0 AS gx FROM range(101))
    SELECT grid, gx::DOUBLE AS x, round(sum(y * (0.5 * 2 / (pi() * 0.5) / (1 + 4 * ((gx - x) / 0.5) ** 2)
        + 0.5 * exp(-4 * ln(2) * ((gx - x) / 0.5) ** 2) * (2 * sqrt(ln(2) / pi()) / 0.5))), 6) AS intensity
    FROM g JOIN p ON abs(gx - x) <= 10 GROUP BY 1, 2
""")
def broaden_peaks(spark, d):
    peaks = load(spark, d, "events").groupBy(F.floor("value").cast("double").alias("x")).agg(F.count("*").cast("double").alias("y"))
    return rounded(series.broaden(peaks, "x", "y", 0.0, 100.0, 101, 0.5))


@query("""
    WITH d AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events)
    SELECT user_id, coalesce(bool_and(d > 0), true) AS increasing FROM d GROUP BY 1
""")
def strictly_increasing(spark, d):
    return series.strictly_increasing(_events(spark, d), "user_id", ["ts", "event_id"], "value")


@query(_NEAR.replace("FROM events", "FROM (SELECT user_id, event_id, ts, least(greatest(value, 5), 95) AS value FROM events)") + """
    , o AS (SELECT user_id, event_id, ts, value FROM j WHERE NOT coalesce(len(c) = 14 AND mad > 0 AND abs(value - median) > 2 * mad, false))
    SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS clean FROM o
""")
def clean_series(spark, d):
    return rounded(cleaning.clean_series(_events(spark, d), "user_id", ["ts", "event_id"], "value", 5.0, 95.0).select("user_id", "event_id", "clean"))


# --- hierarchies ---


@query("""
    WITH b AS (SELECT r_name, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT r_name AS path, 1 AS depth, count(*) AS value FROM b GROUP BY 1
    UNION ALL SELECT r_name || '/' || n_name, 2, count(*) FROM b GROUP BY 1
    UNION ALL SELECT r_name || '/' || n_name || '/' || c_mktsegment, 3, count(*) FROM b GROUP BY 1
""")
def sunburst_rollup(spark, d):
    rows = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return hierarchy.rollup_paths(rows, ["r_name", "n_name", "c_mktsegment"], F.count("*"))


@query("""
    WITH s AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2),
    m AS (SELECT *, n < 0.02 * sum(n) OVER (PARTITION BY p_brand) AS small FROM s),
    k AS (SELECT *, sum(small::INTEGER) OVER (PARTITION BY p_brand) AS c FROM m)
    SELECT p_brand, CASE WHEN small AND c >= 2 THEN 'Other' ELSE p_type END AS p_type, sum(n)::BIGINT AS n FROM k GROUP BY 1, 2
""")
def other_bucket(spark, d):
    rows = load(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return hierarchy.other_bucket(rows, "p_brand", "p_type", "n", 0.02)


@query("""
    SELECT 0 AS stage, o_orderstatus AS source, o_orderpriority AS target, count(*) AS value FROM orders GROUP BY 2, 3
""")
def sankey_flow(spark, d):
    return hierarchy.flow_links(load(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], F.count("*"))


@query("""
    WITH i AS (SELECT DISTINCT n_regionkey g, n_nationkey n FROM nation)
    SELECT a.g AS n_regionkey, a.n || '-' || b.n || '-' || c.n AS combination FROM i a JOIN i b ON a.g = b.g AND a.n < b.n JOIN i c ON b.g = c.g AND b.n < c.n
""")
def ternary_combinations(spark, d):
    out = hierarchy.combinations(load(spark, d, "nation"), "n_regionkey", "n_nationkey", 3)
    return out.select("n_regionkey", F.array_join(F.col("combination").cast("array<string>"), "-").alias("combination"))


# --- pairs ---


def _sites(spark, d):
    at = lambda k: F.col("embedding")[k].cast("double") * 10
    return load(spark, d, "embeddings").select(F.col("label").alias("group"), F.col("vec_id").alias("site"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


_SITES = 'WITH s AS (SELECT label AS "group", vec_id AS site, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z FROM embeddings), '
_PAIRS = _SITES + """
    p AS (SELECT a."group", a.site, b.site AS other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS distance, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz
        FROM s a JOIN s b ON a."group" = b."group" AND a.site <> b.site WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 0.8)
"""


@query(_PAIRS + 'SELECT "group", site, other, round(distance, 6) AS distance FROM p')
def radius_pairs(spark, d):
    return rounded(pairs.radius_pairs(_sites(spark, d), 0.8).select("group", "site", "other", "distance"))


@query(_PAIRS + ', c AS (SELECT "group", site, count(*) AS n FROM p GROUP BY 1, 2) SELECT s."group", s.site, coalesce(n, 0) AS neighbours FROM s LEFT JOIN c USING ("group", site)')
def coordination_numbers(spark, d):
    sites = _sites(spark, d)
    return pairs.coordination(pairs.radius_pairs(sites, 0.8), sites)


@query(_PAIRS + """
    , n AS (SELECT "group", count(*) AS n_sites FROM s GROUP BY 1),
    h AS (SELECT "group", floor(distance / 0.1 + 1e-9)::BIGINT AS bin, count(*) AS n FROM p WHERE distance > 0 GROUP BY 1, 2)
    SELECT "group", bin, round((bin + 0.5)::DOUBLE * 0.1, 6)::DOUBLE AS r, n, round(n / (n_sites * (n_sites / 64.0) * 4 / 3 * pi() * (((bin + 1) * 0.1) ** 3 - (bin * 0.1) ** 3)), 6) AS g
    FROM h JOIN n USING ("group") WHERE bin < 8
""")
def pair_distribution(spark, d):
    sites = _sites(spark, d)
    return rounded(pairs.pair_distribution(pairs.radius_pairs(sites, 0.8), sites, 0.8, 8, 64.0))


@query(_PAIRS + """
    , a AS (SELECT a."group", a.site, degrees(acos(greatest(-1, least(1, (a.dx * b.dx + a.dy * b.dy + a.dz * b.dz) / (sqrt((a.dx ** 2 + a.dy ** 2 + a.dz ** 2) * (b.dx ** 2 + b.dy ** 2 + b.dz ** 2))))))) AS deg
        FROM p a JOIN p b ON a."group" = b."group" AND a.site = b.site AND a.other < b.other)
    SELECT "group", least(floor(deg / 10), 17)::BIGINT AS bin, count(*) AS count FROM a GROUP BY 1, 2
""")
def bond_angle_histogram(spark, d):
    return pairs.angles_within(_sites(spark, d), 0.8, 18)


@query(_SITES + """
    w AS (SELECT "group", site, x - 4 * floor(x / 4) AS x, y - 4 * floor(y / 4) AS y, z - 4 * floor(z / 4) AS z FROM s),
    i AS (SELECT a.range - 1 AS sx, b.range - 1 AS sy, c.range - 1 AS sz FROM range(3) a, range(3) b, range(3) c),
    p AS (SELECT a."group", a.site, b.site AS other, sx::DOUBLE AS sx, sy::DOUBLE AS sy, sz::DOUBLE AS sz, sqrt((a.x - b.x - 4 * sx) ** 2 + (a.y - b.y - 4 * sy) ** 2 + (a.z - b.z - 4 * sz) ** 2) AS distance
        FROM w a JOIN w b ON a."group" = b."group", i WHERE NOT (a.site = b.site AND sx = 0 AND sy = 0 AND sz = 0))
    SELECT "group", site, other, sx, sy, sz, round(distance, 6) AS distance FROM p WHERE distance <= 0.5
""")
def periodic_pairs(spark, d):
    return rounded(pairs.periodic_pairs(_sites(spark, d), (4.0, 4.0, 4.0), 0.5))


@query("""
    WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0),
    p AS (SELECT q.vec_id, e.vec_id AS other, sqrt(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))) AS distance FROM q JOIN embeddings e ON e.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, other)::INTEGER AS rank FROM p)
    SELECT vec_id, other, round(distance, 6) AS distance, rank FROM r WHERE rank <= 5
""")
def knn_embeddings(spark, d):
    rows = load(spark, d, "embeddings").select("vec_id", "embedding")
    return rounded(pairs.nearest(rows.where("vec_id % 50 = 0"), rows, "embedding", "vec_id", 5))


@query(_SITES + """
    t AS (SELECT "group", site, x + 0.1 * (site % 7) AS ox, y - 0.05 * (site % 3) AS oy, z AS oz FROM s),
    j AS (SELECT "group", sqrt((x - ox) ** 2 + (y - oy) ** 2 + (z - oz) ** 2) AS d FROM s JOIN t USING ("group", site))
    SELECT "group", round(sqrt(avg(d * d)), 6) AS rmsd, round(max(d), 6) AS largest FROM j GROUP BY 1
""")
def displacement_rmsd(spark, d):
    sites = _sites(spark, d)
    moved = sites.withColumn("x", F.col("x") + 0.1 * (F.col("site") % 7)).withColumn("y", F.col("y") - 0.05 * (F.col("site") % 3))
    return rounded(pairs.displacements(sites, moved))


# --- trajectories: users as atoms, their events as frames, the value as a coordinate ---


def _frames(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _events(spark, d).withColumn("frame", F.row_number().over(w).cast("long"))


_FRAMES = "WITH f AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame FROM events)"
_LAGS = [1, 2, 3, 5, 8, 13]
_MSD = _FRAMES + """,
    p AS (SELECT lag, a.frame, (b.value - a.value) ** 2 AS q FROM f a, (SELECT unnest([1, 2, 3, 5, 8, 13]) AS lag) l JOIN f b ON a.user_id = b.user_id AND b.frame = a.frame + lag),
    o AS (SELECT lag, frame, avg(q) AS m FROM p GROUP BY 1, 2),
    c AS (SELECT lag, count(*) AS n_origins, avg(m) AS msd, coalesce(stddev_samp(m) / sqrt(count(*)), 0) AS se FROM o GROUP BY 1)
"""


@query(_MSD + "SELECT lag, n_origins, round(msd, 6) AS msd, round(se, 6) AS se FROM c")
def msd(spark, d):
    return rounded(trajectory.msd(_frames(spark, d), "user_id", "frame", "value", _LAGS))


@query(_MSD + """
    , g AS (SELECT * FROM c WHERE lag BETWEEN 0.2 * (SELECT max(lag) FROM c) AND 0.8 * (SELECT max(lag) FROM c))
    SELECT round(regr_slope(msd, lag), 6) AS slope, round(regr_intercept(msd, lag), 6) AS intercept, round(regr_r2(msd, lag), 6) AS r2, round(regr_slope(msd, lag) / 2, 6) AS diffusion FROM g
""")
def diffusion_fit(spark, d):
    return rounded(trajectory.einstein_fit(trajectory.msd(_frames(spark, d), "user_id", "frame", "value", _LAGS)))


@query(_FRAMES + """,
    v AS (SELECT user_id, frame, (lead(value) OVER w - lag(value) OVER w) / 2 AS v FROM f WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
    p AS (SELECT lag, a.frame, a.v * b.v AS q FROM v a, (SELECT unnest([0, 1, 2, 4]) AS lag) l JOIN v b ON a.user_id = b.user_id AND b.frame = a.frame + lag WHERE a.v IS NOT NULL AND b.v IS NOT NULL),
    o AS (SELECT lag, frame, avg(q) AS m FROM p GROUP BY 1, 2), c AS (SELECT lag, avg(m) AS vacf FROM o GROUP BY 1)
    SELECT lag, round(vacf, 6) AS vacf, round(vacf / (SELECT vacf FROM c WHERE lag = 0), 6) AS normalized FROM c
""")
def vacf(spark, d):
    return rounded(trajectory.vacf(trajectory.velocities(_frames(spark, d), "user_id", "frame", "value"), "user_id", "frame", [0, 1, 2, 4]))


@query(_FRAMES + """,
    s AS (SELECT user_id, frame, value, coalesce(value - lag(value) OVER w, 0) AS d FROM f WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
    m AS (SELECT *, d - 50 * floor(d / 50 + 0.5) AS e FROM s)
    SELECT user_id, frame, round(first_value(value) OVER w + sum(e) OVER w, 6) AS unwrapped FROM m WINDOW w AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def unwrap_positions(spark, d):
    return rounded(trajectory.unwrap(_frames(spark, d), "user_id", "frame", "value", 50.0).select("user_id", "frame", "unwrapped"))


@query(_FRAMES + """,
    s AS (SELECT user_id, frame, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY frame)), 0) AS d FROM f)
    SELECT user_id, frame, round(sum(d) OVER (PARTITION BY user_id ORDER BY frame), 6) AS length FROM s
""")
def reaction_coordinate(spark, d):
    return rounded(trajectory.arc_length(_frames(spark, d), "user_id", "frame", ["value"]).select("user_id", "frame", "length"))


@query(_FRAMES + """,
    t AS (SELECT user_id, arg_min(value, frame) AS a, arg_max(value, frame) AS z, max(value) AS m FROM f GROUP BY 1),
    x AS (SELECT user_id, min(frame) AS top_image FROM f JOIN t USING (user_id) WHERE value = m GROUP BY 1)
    SELECT user_id, top_image, round(m - a, 6) AS forward, round(m - z, 6) AS reverse, round(z - a, 6) AS reaction FROM t JOIN x USING (user_id)
""")
def barrier_analysis(spark, d):
    return rounded(trajectory.barrier(_frames(spark, d), "user_id", "frame", "value"))


# --- thermodynamics: parts as entries, brands as formulas, prices as energies ---


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS k FROM part) WHERE k = 1")
def min_entry_per_group(spark, d):
    rows = load(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice")
    return thermo.min_entries(rows, "p_brand", [F.col("p_retailprice"), F.col("p_partkey")])


@query("SELECT p_brand, count(*) AS count, min(p_retailprice) AS lowest, max(p_retailprice) AS highest, round(avg(p_retailprice), 6) AS mean FROM part GROUP BY 1")
def energy_stats_by_formula(spark, d):
    return rounded(thermo.energy_stats(load(spark, d, "part"), "p_brand", "p_retailprice"))


@query("""
    WITH r AS (SELECT p_type, p_partkey, count(*) OVER (PARTITION BY p_type) AS total, rank() OVER (PARTITION BY p_type ORDER BY p_size) - 1 AS lower,
        count(*) OVER (PARTITION BY p_type, p_size) - 1 AS equal FROM part)
    SELECT *, total - lower - equal - 1 AS higher FROM r
""")
def polymorph_ranks(spark, d):
    return thermo.polymorph_ranks(load(spark, d, "part").select("p_type", "p_partkey", "p_size"), "p_type", "p_partkey", "p_size")


@query("""
    WITH r AS (SELECT l_returnflag AS element, min(l_extendedprice) AS ref FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
    e AS (SELECT l_orderkey, l_returnflag AS element, sum(l_quantity) AS amount FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey AS entry_id, round(CASE WHEN bool_or(ref IS NULL) THEN NULL ELSE (o_totalprice - sum(amount * ref)) / sum(amount) END, 6) AS e_form_per_atom
    FROM e LEFT JOIN r USING (element) JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, o_totalprice
""")
def formation_energies(spark, d):
    items = load(spark, d, "lineitem")
    refs = items.where("l_returnflag <> 'R'").groupBy(F.col("l_returnflag").alias("element")).agg(F.min("l_extendedprice").alias("ref"))
    parts = items.groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").alias("amount"))
    maps = parts.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "amount"))).alias("composition"))
    entries = maps.join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("entry_id"), "composition", F.col("o_totalprice").alias("energy"))
    return rounded(thermo.formation_energy(entries, refs))


def _binary(spark, d):
    """Parts as entries of a binary system a brand: composition by size, with a pure entry at both ends."""
    x = F.when(F.col("p_partkey") % 5 == 0, 0.0).when(F.col("p_partkey") % 5 == 1, 1.0).otherwise(F.col("p_size") / 50.0)
    return load(spark, d, "part").select("p_brand", "p_partkey", x.alias("b"), (1 - x).alias("a"), (F.col("p_retailprice") % 97).alias("energy"))


@query("""
    WITH e AS (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 0.0 WHEN p_partkey % 5 = 1 THEN 1.0 ELSE p_size / 50.0 END::DOUBLE AS b, p_retailprice % 97 AS energy FROM part),
    k AS (SELECT p_brand, b, energy FROM e UNION ALL
        SELECT p_brand, c, 0.0 FROM (SELECT DISTINCT p_brand FROM e), (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) v(c) WHERE (p_brand, c) NOT IN (SELECT p_brand, b FROM e)),
    l AS (SELECT p_brand, b, min(energy) AS m FROM k GROUP BY 1, 2),
    h AS (SELECT t.p_brand, t.b, min(CASE WHEN r.b = f.b THEN f.m ELSE f.m + (r.m - f.m) * (t.b - f.b) / (r.b - f.b) END) AS hull
        FROM l t JOIN l f ON f.p_brand = t.p_brand AND f.b <= t.b JOIN l r ON r.p_brand = t.p_brand AND r.b >= t.b WHERE r.b > f.b OR f.b = t.b GROUP BY 1, 2)
    SELECT p_brand, p_partkey, round(greatest(energy - hull, 0), 6) AS e_above_hull FROM e JOIN h USING (p_brand, b)
""")
def hull_2d(spark, d):
    return rounded(thermo.hull_distance(_binary(spark, d), "p_brand", "p_partkey", ["a", "b"], "energy"))


#: The energies of the alloys; the second ones have no three points in a line.
_PLAIN, _ODD = "-(p_partkey * 7 % 97) / 5e1", "-(p_partkey * 7 % 97) / 5e1 - (p_partkey * 613 % 1009) / 3.3331e4"


def _alloys(spark, d, n, energy=_PLAIN):
    """Entries of n components with small whole shares; a tenth of them are pure."""
    most = (4, 3, 3) if n == 3 else (2, 2, 2, 2)
    numbers = [F.col("p_partkey"), F.col("p_size"), F.floor(F.col("p_partkey") / 7), F.floor(F.col("p_partkey") / 11)]
    parts = [x % m for x, m in zip(numbers, most, strict=False)]
    pure = F.col("p_partkey") % 10 == 0
    which = F.floor(F.col("p_partkey") / 10) % n
    shares = [F.when(pure, (which == k).cast("int")).otherwise(x + (1 if k == 0 else 0)).cast("double").alias(f"x{k}") for k, x in enumerate(parts)]
    return load(spark, d, "part").select("p_brand", "p_partkey", *shares, F.expr(energy).cast("double").alias("energy"))


def _alloys_sql(n: int, energy: str = _PLAIN, tail: str = "", gaps: bool = False) -> str:
    """Interpolated energies of all simplices of compositions that hold one, by Cramer's rule; the least is the hull's."""
    most = (4, 3, 3) if n == 3 else (2, 2, 2, 2)
    parts = [f"{x} % {m}" for x, m in zip(("p_partkey", "p_size", "p_partkey // 7", "p_partkey // 11"), most, strict=False)]
    parts[0] += " + 1"
    shares = ", ".join(f"(CASE WHEN p_partkey % 10 = 0 THEN (p_partkey // 10 % {n} = {k})::INT ELSE {x} END)::DOUBLE AS x{k}" for k, x in enumerate(parts))
    total = " + ".join(f"x{k}" for k in range(n))
    names = [f"x{k}" for k in range(n)]

    def det(rows: list[str]) -> str:
        if len(rows) == 1:
            return f"{rows[0]}.{names[0]}"
        # along the last column
        k = len(rows) - 1
        return "(" + " ".join(f"{'+' if (i + k) % 2 == 0 else '-'} {r}.{names[k]} * {det(rows[:i] + rows[i + 1 :])}" for i, r in enumerate(rows)) + ")"

    pure = ", ".join("(" + ", ".join(f"{float(i == k)}::DOUBLE" for i in range(n)) + ")" for k in range(n))
    corners = [f"c{k}" for k in range(n)]
    joins = "".join(f" JOIN l c{k} ON c{k}.p_brand = c0.p_brand AND c{k}.i > c{k - 1}.i" for k in range(1, n))
    # the same sums of products, with one corner replaced by the composition
    weights = [det([*corners[:k], "t", *corners[k + 1 :]]) for k in range(n)]
    closing = f"""SELECT r.p_brand, p_partkey, CASE WHEN hull IS NOT NULL THEN round(greatest(e.energy - hull, 0), 6) END AS e_above_hull FROM r LEFT JOIN e USING (p_partkey)
        LEFT JOIN l ON l.p_brand = e.p_brand AND {" AND ".join(f"l.{x} = e.{x}" for x in names)} LEFT JOIN h ON h.p_brand = l.p_brand AND h.i = l.i"""
    more = "t.m, " + "".join(f"s.i{k}, {w} / s.det AS w{k}, " for k, w in enumerate(weights)) if tail else ""
    if gaps:
        shares = f"* REPLACE ({', '.join(f'{x} * (p_partkey % 43 <> 7)::INT AS {x}' for x in names)}) FROM (SELECT p_partkey, {shares} FROM part)"
    rows = f"""SELECT CASE WHEN p_partkey % 47 <> 11 THEN p_brand END AS p_brand, CASE WHEN p_partkey % 41 <> 5 THEN {energy} END AS energy, s.* FROM part JOIN (SELECT {shares}) s USING (p_partkey)""" if gaps else f"SELECT p_brand, p_partkey, {energy} AS energy, {shares} FROM part"
    return f"""
        WITH r AS ({rows}),
        e AS (SELECT p_brand, p_partkey, energy::DOUBLE AS energy, {", ".join(f"x{k} / ({total}) AS x{k}" for k in range(n))} FROM r WHERE p_brand IS NOT NULL AND energy IS NOT NULL AND {total} > 0),
        k AS (SELECT p_brand, {", ".join(names)}, min(energy) AS m FROM e GROUP BY ALL UNION ALL
            SELECT p_brand, {", ".join(f"v.{x}" for x in names)}, 0.0 FROM (SELECT DISTINCT p_brand FROM e), (VALUES {pure}) v({", ".join(names)})
            WHERE (p_brand, {", ".join(f"v.{x}" for x in names)}) NOT IN (SELECT (p_brand, {", ".join(names)}) FROM e)),
        l AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY {", ".join(names)}) AS i FROM k),
        s AS (SELECT c0.p_brand, {", ".join(f"c{k}.i AS i{k}" for k in range(n))}, {det(corners)} AS det FROM l c0{joins}),
        w AS (SELECT t.p_brand, t.i, {more} ({" + ".join(f"{w} * c{k}.m" for k, w in enumerate(weights))}) / s.det AS hull, least({", ".join(f"{w} / s.det" for w in weights)}) AS least
            FROM s {" ".join(f"JOIN l c{k} ON c{k}.p_brand = s.p_brand AND c{k}.i = s.i{k}" for k in range(n))} JOIN l t ON t.p_brand = s.p_brand WHERE abs(s.det) > 1e-9),
        h AS (SELECT p_brand, i, min(hull) AS hull FROM w WHERE least > -1e-9 GROUP BY ALL)
        {tail or closing}
    """


@query(_alloys_sql(3))
def hull_ternary(spark, d):
    return rounded(thermo.hull_distance(_alloys(spark, d, 3), "p_brand", "p_partkey", ["x0", "x1", "x2"], "energy"))


@query(_alloys_sql(4))
def hull_quaternary(spark, d):
    return rounded(thermo.hull_distance(_alloys(spark, d, 4), "p_brand", "p_partkey", ["x0", "x1", "x2", "x3"], "energy"))


@query(_alloys_sql(3, gaps=True))
def hull_with_gaps(spark, d):
    """Entries without a system, without an energy or without any amount have no distance."""
    rows = _alloys(spark, d, 3)
    lacks = F.col("p_partkey") % 43 == 7
    rows = rows.select(F.when(F.col("p_partkey") % 47 != 11, F.col("p_brand")).alias("p_brand"), "p_partkey", *(F.when(lacks, 0.0).otherwise(F.col(f"x{k}")).alias(f"x{k}") for k in range(3)), F.when(F.col("p_partkey") % 41 != 5, F.col("energy")).alias("energy"))
    return rounded(thermo.hull_distance(rows, "p_brand", "p_partkey", ["x0", "x1", "x2"], "energy"))


_OWNER = "(SELECT min(p_partkey) FROM e WHERE e.p_brand = l.p_brand AND e.x0 = l.x0 AND e.x1 = l.x1 AND e.x2 = l.x2 AND e.energy = l.m)"


@query(_alloys_sql(3, _ODD, f"""
    , b AS (SELECT p_brand, i, unnest([(i0, w0), (i1, w1), (i2, w2)]) AS c, hull FROM w JOIN h USING (p_brand, i, hull) WHERE least > -1e-9),
    d AS (SELECT DISTINCT p_brand, i, c[1] AS k, round(c[2], 6) AS share, hull FROM b WHERE c[2] > 1e-6)
    SELECT e.p_brand, e.p_partkey, {_OWNER} AS phase, share, round(l.x0, 6) AS x0, round(l.x1, 6) AS x1, round(l.x2, 6) AS x2, round(hull, 6) AS hull_energy
    FROM e JOIN l o ON o.p_brand = e.p_brand AND o.x0 = e.x0 AND o.x1 = e.x1 AND o.x2 = e.x2 JOIN d ON d.p_brand = e.p_brand AND d.i = o.i JOIN l ON l.p_brand = d.p_brand AND l.i = d.k
"""))
def ternary_decomposition(spark, d):
    """The stable phases and their shares of every entry's composition."""
    rows, parts = _alloys(spark, d, 3, _ODD), ["x0", "x1", "x2"]
    found = thermo.decompose(rows, thermo.sections(rows, "p_brand", "p_partkey", parts, "energy"), "p_brand", "p_partkey", parts)
    once = F.array_distinct(F.transform("phases", lambda p: F.struct(p["entry"].alias("entry"), p["x"].alias("x"), F.round(p["share"], 6).alias("share"))))
    each = found.select("p_brand", "p_partkey", "hull_energy", F.inline(once))
    return rounded(each.select("p_brand", "p_partkey", F.col("entry").alias("phase"), "share", *(F.col("x")[k].alias(f"x{k}") for k in range(3)), "hull_energy"))


@query(_alloys_sql(3, _ODD, f"""
    , f AS (SELECT p_brand, i0, i1, i2 FROM (SELECT p_brand, i0, i1, i2, bool_and(hull <= m + 1e-9) AS low FROM w GROUP BY 1, 2, 3, 4) WHERE low),
    p AS (SELECT DISTINCT p_brand, unnest([(i0, i1), (i1, i2), (i0, i2)]) AS q FROM f),
    o AS (SELECT l.p_brand, l.i, {_OWNER} AS phase FROM l)
    SELECT p.p_brand, a.phase AS phase_a, b.phase AS phase_b FROM p JOIN o a ON a.p_brand = p.p_brand AND a.i = p.q[1] JOIN o b ON b.p_brand = p.p_brand AND b.i = p.q[2]
"""))
def ternary_tie_lines(spark, d):
    """The pairs of entries that are stable together."""
    lines = thermo.tie_lines(thermo.sections(_alloys(spark, d, 3, _ODD), "p_brand", "p_partkey", ["x0", "x1", "x2"], "energy"), "p_brand")
    return lines.select("p_brand", F.col("a.entry").alias("phase_a"), F.col("b.entry").alias("phase_b"))


@query("""
    WITH e AS (SELECT user_id, epoch(ts) / 3600.0 AS t, avg(value) AS v FROM events GROUP BY 1, 2),
    m AS (SELECT (min(t) + max(t)) / 2 AS mid FROM e),
    s AS (SELECT user_id, max(t) FILTER (t <= 473352.5) AS ta, arg_max(v, t) FILTER (t <= 473352.5) AS va, min(t) FILTER (t >= 473352.5) AS tb, arg_min(v, t) FILTER (t >= 473352.5) AS vb FROM e GROUP BY 1)
    SELECT user_id, round(CASE WHEN tb = ta THEN va WHEN tb - ta <= 500 THEN va + (vb - va) * (473352.5 - ta) / (tb - ta) END, 6) AS energy FROM s
""")
def energy_at_temperature(spark, d):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9
    rows = load(spark, d, "events").groupBy("user_id", t.alias("t")).agg(F.avg("value").alias("v"))
    return rounded(thermo.at_temperature(rows, "user_id", "t", "v", 473352.5))


@query("""
    SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount BETWEEN 0.02 AND 0.08 THEN (l_discount - 0.02) / (0.08 - 0.02) END, 6) AS share_high,
        round(1 - CASE WHEN l_discount BETWEEN 0.02 AND 0.08 THEN (l_discount - 0.02) / (0.08 - 0.02) END, 6) AS share_low FROM lineitem
""")
def lever_rule(spark, d):
    rows = load(spark, d, "lineitem").withColumn("low", F.lit(0.02)).withColumn("high", F.lit(0.08))
    return rounded(thermo.lever_rule(rows, "l_discount", "low", "high").select("l_orderkey", "l_linenumber", "share_high", "share_low"))


# --- scalar functions ---


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_path(spark, d):
    return load(spark, d, "events").select("event_id", json_tree.at_path(F.col("props"), "k", "long").alias("k"))


@query("SELECT event_id, k AS path, json_extract_string(props, k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_flatten(spark, d):
    return json_tree.flatten(load(spark, d, "events"), "event_id", "props")


@query("""
    SELECT event_id, 'k' AS path, 'changed' AS status FROM events WHERE event_id % 4 = 0 AND json_extract_string(props, '$.k') <> '7'
    UNION ALL SELECT event_id, 'k', 'removed' FROM events WHERE event_id % 4 = 1
""")
def json_diff(spark, d):
    rows = load(spark, d, "events")
    new = rows.where("event_id % 4 <> 1").withColumn("props", F.when(F.col("event_id") % 4 == 0, F.lit('{"k": 7}')).otherwise(F.col("props")))
    return json_tree.diff(json_tree.flatten(rows, "event_id", "props"), json_tree.flatten(new, "event_id", "props"), "event_id")


@query("SELECT page_id, md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS plain_md5, true AS is_html FROM pages")
def strip_html(spark, d):
    return load(spark, d, "pages").select("page_id", F.md5(text.strip_html(F.col("html")).cast("binary")).alias("plain_md5"), text.is_html(F.col("html")).alias("is_html"))


@query("""
    SELECT p_partkey, CASE p_partkey % 5 WHEN 3 THEN NULL WHEN 1 THEN -p_size ELSE p_size END::DOUBLE AS number FROM part
""")
def parse_numeric_text(spark, d):
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    cell = F.when(kind == 0, F.concat(F.lit("<b>"), size, F.lit("</b>"))).when(kind == 1, F.concat(F.lit("−"), size)).when(kind == 2, F.concat(size, F.lit(" ± 0.5")))
    cell = cell.when(kind == 3, F.concat(size, F.lit(" kg"))).otherwise(F.concat(size, F.lit("(2)")))
    return load(spark, d, "part").select("p_partkey", text.parse_numeric(cell).alias("number"))


_FORMULAS = """
    SELECT p_partkey, p_partkey % 3 AS kind, 1 + p_size % 6 AS a, 1 + p_partkey % 4 AS b, gcd(1 + p_size % 6, 1 + p_partkey % 4) AS g FROM part
"""
_FORMULA_OF = "CASE kind WHEN 0 THEN 'Fe' || a || 'O' || b WHEN 1 THEN 'Li' || a || '(PO4)' || b WHEN 2 THEN 'Xx' || a END"


def _formulas(spark, d):
    """p_partkey and a formula: iron oxides, lithium phosphates, and texts that are none."""
    a, b = (1 + F.col("p_size") % 6).cast("string"), (1 + F.col("p_partkey") % 4).cast("string")
    kind = F.col("p_partkey") % 3
    made = F.when(kind == 0, F.concat(F.lit("Fe"), a, F.lit("O"), b)).when(kind == 1, F.concat(F.lit("Li"), a, F.lit("(PO4)"), b)).otherwise(F.concat(F.lit("Xx"), a))
    return load(spark, d, "part").select("p_partkey", made.alias("formula"))


def _times(n: str) -> str:
    return f"CASE WHEN {n} = 1 THEN '' ELSE ({n})::BIGINT::VARCHAR END"


@query(f"""
    SELECT p_partkey, {_FORMULA_OF} AS formula,
        CASE kind WHEN 0 THEN 'Fe' || {_times("a / g")} || 'O' || {_times("b / g")}
            WHEN 1 THEN 'Li' || {_times("a / g")} || 'O' || {_times("4 * b / g")} || 'P' || {_times("b / g")} END AS reduced,
        CASE kind WHEN 0 THEN 'Fe-O' WHEN 1 THEN 'Li-O-P' END AS system FROM ({_FORMULAS})
""")
def formula_reduction(spark, d):
    return _formulas(spark, d).withColumn("reduced", formula.reduced_formula("formula")).withColumn("system", formula.chemical_system("formula"))


@query(f"SELECT CASE kind WHEN 0 THEN 'Fe-O' WHEN 1 THEN 'Li-O-P' END AS system, count(*)::INTEGER AS count FROM ({_FORMULAS}) GROUP BY 1")
def chem_sys_counts(spark, d):
    return _formulas(spark, d).groupBy(formula.chemical_system("formula").alias("system")).agg(F.count("*").cast("int").alias("count"))


@query(f"""
    WITH f AS (SELECT * FROM ({_FORMULAS}))
    SELECT p_partkey, 'Fe' AS element, round(a / (a + b), 6)::DOUBLE AS fraction FROM f WHERE kind = 0
    UNION ALL SELECT p_partkey, 'O', round(b / (a + b), 6) FROM f WHERE kind = 0
    UNION ALL SELECT p_partkey, 'Li', round(a / (a + 5 * b), 6) FROM f WHERE kind = 1
    UNION ALL SELECT p_partkey, 'P', round(b / (a + 5 * b), 6) FROM f WHERE kind = 1
    UNION ALL SELECT p_partkey, 'O', round(4 * b / (a + 5 * b), 6) FROM f WHERE kind = 1
""")
def fractional_composition(spark, d):
    parsed = _formulas(spark, d).withColumn("amounts", formula.parse_formula("formula"))
    return rounded(parsed.select("p_partkey", F.explode(formula.fractions(F.col("amounts"))).alias("element", "fraction")))


@query(f"SELECT p_partkey, {_FORMULA_OF} AS formula FROM ({_FORMULAS}) WHERE kind = 0")
def formula_filter(spark, d):
    return _formulas(spark, d).where(formula.matches_elements(formula.parse_formula("formula"), ["Fe", "O"], ["S", "P"]))


@query("SELECT event_id, round(CASE WHEN round(x, 15) >= 1 THEN 0 ELSE round(x, 15) END, 9) AS fraction FROM (SELECT event_id, value / 7 - floor(value / 7) AS x FROM events)")
def wrap_fractions(spark, d):
    return rounded(load(spark, d, "events").select("event_id", numeric.wrap_fraction(F.col("value") / 7).alias("fraction")), 9)


@query("SELECT c_custkey, 'customer#' || lpad(regexp_extract(c_name, '(\\d+)', 1), 20, '0') AS sort_key FROM customer")
def natural_sort_keys(spark, d):
    return load(spark, d, "customer").select("c_custkey", text.natural_key(F.col("c_name")).alias("sort_key"))


# --- streams, read as batches here; tests run them as streams ---


@query("""
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2
""")
def windowed_events(spark, d):
    out = rounded(frames.windowed_stats(load(spark, d, "events"), "ts", "event_type", "value"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


from . import catalogue_files, catalogue_geometry, catalogue_materials, catalogue_more, catalogue_motion  # noqa: E402, F401  register their queries
