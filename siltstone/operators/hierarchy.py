"""Hierarchies and flows: rollups by path, small-share buckets, flow links, combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rollup_paths(df: DataFrame, levels: list[str], value: Column) -> DataFrame:
    """path, depth, value of every node of the tree given by the level columns."""
    out = None
    for depth in range(1, len(levels) + 1):
        path = F.concat_ws("/", *levels[:depth])
        part = df.groupBy(path.alias("path")).agg(value.alias("value")).withColumn("depth", F.lit(depth))
        out = part if out is None else out.unionByName(part)
    return out.select("path", "depth", "value")


def other_bucket(df: DataFrame, parent: str, name: str, value: str, least: float) -> DataFrame:
    """Siblings with less than the share `least` become "Other", where there are two or more of them."""
    w = Window.partitionBy(parent)
    small = F.col(value) < least * F.sum(value).over(w)
    rows = df.withColumn("_small", small).withColumn("_n", F.sum(F.col("_small").cast("int")).over(w))
    label = F.when(F.col("_small") & (F.col("_n") >= 2), F.lit("Other")).otherwise(F.col(name))
    return rows.withColumn(name, label).groupBy(parent, name).agg(F.sum(value).alias(value))


def flow_links(df: DataFrame, stages: list[str], value: Column) -> DataFrame:
    """stage, source, target, value of the links between consecutive stage columns."""
    out = None
    for k, (a, b) in enumerate(zip(stages, stages[1:], strict=False)):
        part = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("source"), F.col(b).cast("string").alias("target")).agg(value.alias("value"))
        part = part.withColumn("stage", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out.select("stage", "source", "target", "value")


def combinations(df: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """All k-combinations of the items of a group, in order, as arrays of a dimension table's items."""
    items = df.select(group, item).distinct()
    out = items.select(group, F.array(item).alias("combination"))
    for _ in range(k - 1):
        out = out.join(items, group).where(F.col(item) > F.element_at("combination", -1)).select(group, F.concat("combination", F.array(item)).alias("combination"))
    return out
