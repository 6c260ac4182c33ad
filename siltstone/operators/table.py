"""Table layer: filters, search, sort order, pages, type inference and pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from ..functions import text as T


def numeric_filter(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows whose number lies within the inclusive bounds; text is parsed, and what is no number fails."""
    c = F.col(column)
    value = T.parse_numeric(c) if dict(df.dtypes)[column] == "string" else c
    out = df.where(value.isNotNull())
    out = out.where(value >= low) if low is not None else out
    return out.where(value <= high) if high is not None else out


def category_filter(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.where(F.col(column).cast("string").isin(values))


def text_filter(df: DataFrame, column: str, query: str) -> DataFrame:
    return df.where(T.contains(F.col(column), query))


def search(df: DataFrame, query: str, columns: list[str] | None = None, fuzzy: bool = False) -> DataFrame:
    """Rows of which any cell (of the given columns) matches the trimmed query."""
    query = query.strip()
    if not query:
        return df
    test = T.fuzzy if fuzzy else T.contains
    hit = F.lit(False)
    for c in columns or df.columns:
        hit = hit | F.coalesce(test(F.col(c), query), F.lit(False))
    return df.where(hit)


def sort_keys(df: DataFrame, criteria: list[tuple[str, bool]]) -> list[Column]:
    """Order for (column, ascending) criteria: null and NaN last in both directions, text in natural order."""
    keys: list[Column] = []
    for name, ascending in criteria:
        kind, c = dict(df.dtypes)[name], F.col(name)
        invalid = c.isNull() | (F.isnan(c) if kind in ("double", "float") else F.lit(False))
        key = T.natural_key(c) if kind == "string" else c
        keys += [invalid.asc(), key.asc() if ascending else key.desc()]
    return keys


def page(df: DataFrame, criteria: list[tuple[str, bool]], number: int, size: int = 25) -> DataFrame:
    """One page (from 1) of the sorted rows; a limit is what the operator is for. Ties must be broken by the criteria."""
    return df.orderBy(*sort_keys(df, criteria)).offset((max(number, 1) - 1) * size).limit(size)


def category_options(df: DataFrame, column: str, most: int = 40) -> DataFrame:
    """n distinct values, whether these make a list, and the sorted list if so (at most `most` values are gathered)."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("v")).distinct()
    total = values.agg(F.count("*").alias("n_distinct"))
    some = values.orderBy("v").limit(most + 1).agg(F.array_sort(F.collect_list("v")).alias("options"))
    return total.crossJoin(some).select("n_distinct", (F.col("n_distinct") <= most).alias("is_category"), F.when(F.col("n_distinct") <= most, F.array_join("options", "|")).alias("options"))


def infer_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """numeric where 80 % of the non-null texts are numbers, else string where 80 % are none, else mixed."""
    aggs = []
    for c in columns:
        number = T.parse_numeric(F.col(c).cast("string")).isNotNull()
        aggs += [F.count(c).alias(f"{c}__n"), F.count_if(F.col(c).isNotNull() & number).alias(f"{c}__num")]
    one = df.agg(*aggs)
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__n").alias("n"), F.col(f"{c}__num").alias("n_numeric")) for c in columns]))
    kind = F.when((F.col("n") > 0) & (F.col("n_numeric") >= 0.8 * F.col("n")), "numeric").when((F.col("n") > 0) & (F.col("n") - F.col("n_numeric") >= 0.8 * F.col("n")), "string").otherwise("mixed")
    return one.select(parts.alias("x")).select("x.*").withColumn("kind", kind)


def unpivot(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """key and value of each numeric column, with the id columns."""
    return df.unpivot([F.col(c) for c in ids], [F.col(c).cast("double").alias(c) for c in values], "key", "value")


def pivot_matrix(df: DataFrame, y: str, x: str, x_values: list[str], value: Column) -> DataFrame:
    """One row a y item with a column for each x item; `value` is an aggregate."""
    return df.groupBy(y).pivot(x, x_values).agg(value)


def densify(df: DataFrame, series: str, category: str, value: str, fill: float | None = 0.0) -> DataFrame:
    """Every series on all categories; of repeated categories the last (largest) value; missing ones are filled.

    Both axes are distinct values of category columns; their product is the result's size.
    """
    last = df.groupBy(series, category).agg(F.max(value).alias(value))
    axes = df.select(series).distinct().crossJoin(df.select(category).distinct())
    full = axes.join(last, [series, category], "left")
    return full if fill is None else full.withColumn(value, F.coalesce(value, F.lit(fill)))


def top_k(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of every group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def stride_sample(df: DataFrame, order: str, stride: int) -> DataFrame:
    """Rows whose integer position is a multiple of the stride."""
    return df.where(F.col(order) % stride == 0)


def first_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first by the order."""
    names = df.columns
    packed = df.groupBy(*key).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("row"))
    return packed.select("row.*")


def discover_columns(df: DataFrame, text: str, order: str) -> DataFrame:
    """column, first, n, n_numeric, kind: the keys of JSON objects in a text column, by their first row, with how their values look.

    All rows are read, whatever their number. The kind is numeric or string where 80 % of the values are, else mixed.
    """
    pairs = df.select(F.col(order).alias("_at"), F.explode(F.from_json(text, "map<string, string>")).alias("column", "value"))
    numeric = T.parse_numeric(F.col("value")).isNotNull()
    out = pairs.groupBy("column").agg(F.min("_at").alias("first"), F.count("value").alias("n"), F.count_if(numeric).alias("n_numeric"))
    kind = F.when((F.col("n") > 0) & (F.col("n_numeric") >= 0.8 * F.col("n")), "numeric").when((F.col("n") > 0) & (F.col("n") - F.col("n_numeric") >= 0.8 * F.col("n")), "string").otherwise("mixed")
    return out.withColumn("kind", kind)


def extract_columns(df: DataFrame, text: str, order: str) -> DataFrame:
    """column, first, place, n, n_numeric, n_string, kind: the columns of rows written as JSON objects.

    All rows are read. `first` is the least `order` of a row with the key, `place` its position there. A value's JSON type
    decides: n counts values that are not null, and the kind is numeric or string where 80 % of these are, else mixed. Texts that
    are null or no object have no columns. Counts are combined before the shuffle; a row is a key, however many rows have it.
    """
    pairs = df.select(F.col(order).alias("_at"), F.posexplode(F.from_json(text, "map<string, variant>")).alias("_place", "column", "_value"))
    typed = pairs.withColumn("_type", F.schema_of_variant("_value"))
    valid, number = F.col("_type") != "VOID", F.col("_type").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    counts = [F.min(F.struct("_at", "_place")).alias("_x"), F.count_if(valid).alias("n"), F.count_if(number).alias("n_numeric"), F.count_if(F.col("_type") == "STRING").alias("n_string")]
    found = typed.groupBy("column").agg(*counts)
    enough = F.col("n") * F.lit(8)
    kind = F.when((F.col("n") > 0) & (F.col("n_numeric") * 10 >= enough), "numeric").when((F.col("n") > 0) & (F.col("n_string") * 10 >= enough), "string").otherwise("mixed")
    return found.select("column", F.col("_x._at").alias("first"), F.col("_x._place").cast("long").alias("place"), "n", "n_numeric", "n_string", kind.alias("kind"))


#: Names by which a column takes an axis.
AXIS_NAMES = {
    "x": ("x", "time", "step", "index", "iteration", "frame", "epoch"),
    "y": ("y", "energy", "value", "force", "stress", "loss", "score"),
    "z": ("z", "altitude", "depth", "height"),
}


def suggest_axes(columns: DataFrame) -> DataFrame:
    """One row: plot, x, y, z, color (names of columns or null) for the table of `extract_columns`.

    x is the first numeric column named like one, else the first text that isn't named like a y, else the first of two or more
    numbers; y the first other number named like one, else the first other number; z a third number named like one; color the
    first number left. A z gives a scatter3d, a text as x a bar, a single number a histogram (as its x), nothing a table.
    """
    known = cut(columns.select("column", "kind", F.struct("first", "place", "column").alias("_order")))
    name, numeric, is_text = F.col("column"), F.col("kind") == "numeric", F.col("kind") == "string"
    named = {axis: F.lower("column").isin(*names) for axis, names in AXIS_NAMES.items()}

    def first(condition):
        return F.min_by(F.when(condition, name), F.when(condition, F.col("_order")))

    def following(chosen: DataFrame, *picks) -> DataFrame:
        """The chosen axes and those picked next from the columns left; one row is joined to all columns."""
        axes = [F.first(c).alias(c) for c in chosen.columns]
        return known.join(F.broadcast(chosen)).agg(*axes, *picks)  # chosen is one row

    x = F.coalesce(first(numeric & named["x"]), first(is_text & ~named["y"]), F.when(F.count_if(numeric) >= 2, first(numeric)))
    chosen = known.agg(x.alias("x"), F.count_if(numeric).alias("numbers"), F.max(F.when(is_text, 1)).alias("_texts"))
    left = numeric & ~name.eqNullSafe(F.col("x"))
    chosen = following(chosen, F.coalesce(first(left & named["y"]), first(left)).alias("y"))
    left = left & ~name.eqNullSafe(F.col("y"))
    chosen = following(chosen, F.when(F.first("numbers") >= 3, first(left & named["z"])).alias("z"))
    left = left & ~name.eqNullSafe(F.col("z"))
    chosen = following(chosen, first(left).alias("color"), first(numeric).alias("_number"), F.max(F.when(name == F.col("x"), F.col("kind"))).alias("_x"))
    lacks = F.col("x").isNull() | F.col("y").isNull()
    plot = F.when(F.col("z").isNotNull(), "scatter3d").when(F.col("_x") == "string", "bar").when(lacks & (F.col("numbers") >= 1), "histogram").when(lacks, "table").otherwise("scatter")
    return chosen.select(plot.alias("plot"), F.when(plot == "histogram", F.coalesce("x", "y", "_number")).otherwise(F.col("x")).alias("x"), "y", "z", "color")


def suggest_roles(df: DataFrame, names: dict[str, list[str]]) -> dict[str, str]:
    """The column for each role: the first whose name is in the role's list, else the first numeric one that no role has yet."""
    lower, numeric = {c.lower(): c for c in df.columns}, [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint") or t.startswith("decimal")]
    found = {role: next(lower[n] for n in wanted if n in lower) for role, wanted in names.items() if any(n in lower for n in wanted)}
    for role in names:
        free = [c for c in numeric if c not in found.values()]
        if role not in found and free:
            found[role] = free[0]
    return found
