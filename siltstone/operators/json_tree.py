"""JSON text: paths, flattening, typing, search and diff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at_path(c: Column, path: str, kind: str = "string") -> Column:
    """The value at a path such as `a.b[0]`, or null."""
    return F.try_variant_get(F.try_parse_json(c), "$." + path if path else "$", kind)


def flatten(df: DataFrame, key: str, column: str, depth: int = 3) -> DataFrame:
    """key, path, value (as text) of the leaves of JSON objects; objects below `depth` levels stay text."""
    rows = df.select(key, F.lit("").alias("path"), F.col(column).alias("value"))
    out = None
    for _ in range(depth):
        is_object = F.coalesce(F.ltrim("value").startswith("{"), F.lit(False))
        leaves = rows.where(~is_object & (F.col("path") != ""))
        out = leaves if out is None else out.unionByName(leaves)
        inner = rows.where(is_object).select(key, "path", F.explode(F.from_json("value", "map<string,string>")).alias("name", "value"))
        path = F.when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws(".", "path", "name"))
        rows = inner.select(key, path.alias("path"), "value")
    return out.unionByName(rows)


def search(flat: DataFrame, query: str) -> DataFrame:
    """Rows of which path or value contains the query, whatever the case."""
    q = F.lit(query.lower())
    return flat.where(F.contains(F.lower("path"), q) | F.coalesce(F.contains(F.lower("value"), q), F.lit(False)))


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, path, status (added, removed, changed) between two flattened tables."""
    joined = old.withColumnRenamed("value", "old").join(new.withColumnRenamed("value", "new"), [key, "path"], "full")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return joined.select(key, "path", status.alias("status")).where(F.col("status").isNotNull())
