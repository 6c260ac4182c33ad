"""Joins and ordered counts that hold when a few keys have much of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

#: A key counts as hot when it holds more than 1/HOT_SHARE of all rows, so at most HOT_SHARE keys can be hot.
HOT_SHARE = 1000
#: A group with no more different values than this is summed up in one task.
IN_ONE_TASK = 200_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int | None = None, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """Inner join of rows to one row per key; `groups` has each key's row count in column `size`.

    The group rows of hot keys, HOT_SHARE at most, are broadcast; all others are joined by a shuffle in which no key is hot.
    Keys are of a plain type, null ones match nothing. `total` is the sum of the sizes or more, if known; `keep` stores the groups.
    """
    groups = keep(groups).where(F.col(key).isNotNull())
    if total is None:
        total = groups.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    hot = F.col(size) * HOT_SHARE > F.lit(total)
    hot_keys = [] if total <= HOT_SHARE else [r[0] for r in groups.where(hot).select(key).collect()]
    if not hot_keys:
        return rows.join(groups, key)
    is_hot = F.col(key).isin(hot_keys)
    return rows.where(is_hot).join(F.broadcast(groups.where(hot)), key).unionByName(rows.where(~is_hot).join(groups.where(~hot), key))


def numbered(rows: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """`rows` with the place of each in its group's order, from 0, in column `out`.

    A group of more than IN_ONE_TASK rows is dealt by range of group and order, numbered part by part, and moved up by the
    rows of earlier parts. Rows with equal order keys lie in one part and follow in no fixed order; null groups are one group.
    """
    largest = rows.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if largest <= IN_ONE_TASK:
        return rows.withColumn(out, (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("long"))
    dealt = cut(rows.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    parts = parts.select(F.col(group).alias("_group"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)) - 1
    placed = dealt.withColumn("_within", within).join(parts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_p")))
    return placed.withColumn(out, (F.col("_within") + F.col("_before")).cast("long")).drop("_part", "_p", "_group", "_within", "_before")


def below(counts: DataFrame, group: str, value: str, n: str) -> DataFrame:
    """`counts` (one row a group and value) with `below`: the sum of n over smaller values of the group.

    The rows are dealt by range of group and value, so a group with very many values lies in many tasks; sums of the
    parts, one row a part and group, are added up before those within a part.
    """
    dealt = cut(counts.repartitionByRange(group, value).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(group, "_part").agg(F.sum(n).alias("_sum"))
    parts = parts.select(group, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(group, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_within", F.coalesce(F.sum(n).over(within), F.lit(0)))
    return summed.join(parts, [group, "_part"]).withColumn("below", F.col("_before") + F.col("_within")).drop("_part", "_before", "_within")


def _with_totals(ranked: DataFrame, group: str) -> DataFrame:
    totals = ranked.groupBy(group).agg(F.max(F.col("below") + F.col("_n")).alias("_all"), F.count("*").alias("_rows"))
    return join_groups(ranked, totals, group, "_rows")


def quantiles(rows: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """group, q0, q1, ...: exact quantiles by linear interpolation of the values, nulls left out.

    Equal values are counted first; then the values at the two ranks around each quantile are found by their counts below.
    While no group has more than IN_ONE_TASK different values these are summed up group by group, else dealt by range.
    Both ways give the same rows; a null group has none.
    """
    counts = cut(rows.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n")))
    largest = counts.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if largest <= IN_ONE_TASK:
        before = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        known = counts.withColumn("below", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(group)))
    else:
        known = _with_totals(below(counts, group, value, "_n"), group)
    at = [F.col("_all") - F.lit(1) if s == 1 else (F.col("_all") - 1) * F.lit(float(s)) for s in shares]

    def there(rank: Column) -> Column:
        return F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("_n")), F.col(value)))

    ends = [there(end).alias(f"_{name}{k}") for k, p in enumerate(at) for name, end in (("low", F.floor(p)), ("high", F.ceil(p)))]
    found = known.groupBy(group).agg(F.first("_all").alias("_all"), *ends)
    share = [p - F.floor(p) for p in at]
    return found.select(group, *((F.col(f"_low{k}") * (1 - s) + F.col(f"_high{k}") * s).alias(f"q{k}") for k, s in enumerate(share)))
