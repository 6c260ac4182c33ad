"""Parent tables and links as graphs: levels, cycles, connected fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut


def levels(nodes: DataFrame, name: str, parent: str) -> DataFrame:
    """name, depth, path of every node below a root; a repeated name, an unknown parent or a cycle raises.

    Each round doubles the stretch of ancestors that a node knows, so the number of rounds grows with the logarithm of the depth.
    """
    if nodes.groupBy(name).count().where("count > 1").limit(1).count():
        raise ValueError("a node is named twice")
    up = F.col(parent)
    if not nodes.where(up.isNotNull()).join(nodes.select(F.col(name).alias(parent)), parent, "left_anti").isEmpty():
        raise ValueError("a node has an unknown parent")
    known = cut(nodes.select(F.col(name).alias("node"), up.alias("up"), up.isNotNull().cast("int").alias("depth"), F.col(name).cast("string").alias("path")))
    reach, total = 1, nodes.count()
    while not known.where("up is not null").isEmpty():
        if reach > total:
            raise ValueError("the parents form a cycle")
        above = known.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("depth").alias("more"), F.col("path").alias("head"))
        joined = known.where("up is not null").join(above, "up")
        longer = joined.select("node", F.col("far").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.concat_ws("/", "head", "path").alias("path"))
        known, reach = cut(known.where("up is null").unionByName(longer)), 2 * reach
    return known.select(F.col("node").alias(name), "depth", "path")


def cyclic_nodes(links: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Nodes that lie on or between cycles: links whose ends have no way in or out are taken off until none is left.

    A round takes one link off each end of a chain, so the rounds grow with the longest chain that leads into or out of the cycles.
    """
    edges = links.select(F.col(source).alias("s"), F.col(target).alias("t")).distinct()
    size = edges.count()
    while True:
        edges = edges.join(edges.select(F.col("t").alias("s")).distinct(), "s", "left_semi").join(edges.select(F.col("s").alias("t")).distinct(), "t", "left_semi").select("s", "t")
        edges = cut(edges)
        left = edges.count()
        if left == size:
            return edges.select(F.col("s").alias("node")).distinct()
        size = left


def fragments(bonds: DataFrame, sites: DataFrame, a: str = "a", b: str = "b", site: str = "site") -> DataFrame:
    """site, fragment: the smallest site that bonds lead to; labels halve their way each round.

    Sites and bonds may come from rows that Spark estimates far too small, so nothing here may be broadcast.
    """
    labels = sites.select(F.col(site).alias("site"), F.col(site).alias("fragment"))
    both = bonds.select(F.col(a).alias("p"), F.col(b).alias("q")).unionByName(bonds.select(F.col(b).alias("p"), F.col(a).alias("q"))).distinct()
    while True:
        near = both.join(labels.select(F.col("site").alias("q"), "fragment").hint("merge"), "q").groupBy(F.col("p").alias("site")).agg(F.min("fragment").alias("m"))
        new = labels.join(near.hint("merge"), "site", "left").select("site", F.least("fragment", F.coalesce("m", "fragment")).alias("fragment"))
        # jump: a label's own label
        jump = new.select(F.col("site").alias("fragment"), F.col("fragment").alias("j"))
        new = new.join(jump.hint("merge"), "fragment", "left").select("site", F.coalesce("j", "fragment").alias("fragment"))
        new = cut(new)
        if new.join(labels.withColumnRenamed("fragment", "old").hint("merge"), "site").where("fragment <> old").isEmpty():
            return new
        labels = new
