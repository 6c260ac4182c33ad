"""Sharding: minimax contiguous partition of ordered atomic groups.

Rows with equal text form one atomic group. Groups are ordered by a 60-bit key of the text's digest, so the order does
not depend on the input's. The smallest capacity for which `shards` contiguous runs of groups suffice is found by binary
search; a capacity is checked greedily, each shard taking groups while they fit, and the groups are cut there.

The group sizes stay on the cluster. The driver holds sums over ranges of keys ("cells"), at most `cells` of them.
A search over cells gives bounds: cells taken as divisible bound the capacity from below, cells taken as whole from
above. Only cells in which a cut can still fall are split further, until these hold one group each; then both bounds
meet and the cuts are exact.

Defined results: a null text counts as the empty text; an empty table gives no rows; repeated rows are each placed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KEY_BITS = 60


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """doc_id, size, text_crc32 and key (60 bits of the text's digest) of every row."""
    text = common.text_or_empty("text")
    return common.own_columns(docs, id=id_col, text=text_col).select(
        F.col("id").alias(id_col),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"),
    )


class Cells:
    """Consecutive key ranges in order: first key, bits of width, sum, and whether one group at most is inside."""

    def __init__(self, first, bits, size, single):
        order = np.argsort(first)
        self.first, self.bits, self.size, self.single = (np.asarray(x)[order] for x in (first, bits, size, single))
        self.before = np.concatenate([[0], np.cumsum(self.size)])

    def fill(self, capacity: int, shards: int, whole: bool) -> np.ndarray | None:
        """End positions (in bytes) of the greedy shards, or None where these do not hold everything."""
        at, ends = 0, []
        for _ in range(shards):
            cell = int(np.searchsorted(self.before, at + capacity, "right")) - 1
            if cell >= len(self.size):
                at = int(self.before[-1])
            elif whole or self.single[cell]:
                at = max(int(self.before[cell]), at if not whole else 0)
            else:
                at += capacity
            ends.append(at)
        return np.array(ends, np.int64) if at >= self.before[-1] else None

    def smallest(self, shards: int, whole: bool) -> int:
        """Binary search of the smallest capacity that suffices."""
        total = int(self.before[-1])
        low, high = -(-total // shards), max(total, 1)
        while low < high:
            middle = (low + high) // 2
            if self.fill(middle, shards, whole) is None:
                low = middle + 1
            else:
                high = middle
        return low


def _cells(keyed: DataFrame, bits: int) -> list:
    """Sums over the key ranges of 2**bits keys: pre-aggregated by Spark, one row a range."""
    cell = F.shiftright("key", bits).alias("cell")
    return keyed.groupBy(cell).agg(F.sum("size").alias("size"), (F.min("key") == F.max("key")).alias("single"), F.min("key").alias("key")).collect()


def cuts(keyed: DataFrame, shards: int, cells: int = 1 << 14) -> tuple[int, list[int]]:
    """(smallest capacity, first keys of shards 1, 2, ...) of rows with `key` and `size`; trailing shards may be empty."""
    bits = KEY_BITS - (cells.bit_length() - 1)
    rows = _cells(keyed, bits)
    if not rows:
        return 0, [1 << KEY_BITS] * (shards - 1)
    now = Cells(*zip(*((r["key"] if r["single"] else r["cell"] << bits, 0 if r["single"] else bits, r["size"], r["single"]) for r in rows), strict=True))
    while True:
        low, high = now.smallest(shards, whole=False), now.smallest(shards, whole=True)
        late, early = now.fill(high, shards, whole=False), _pushed(now, low, shards)
        first = np.maximum(np.searchsorted(now.before, early, "right") - 1, 0)
        last = np.minimum(np.searchsorted(now.before, late, "right") - 1, len(now.size) - 1)
        inside = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)]))
        if now.single[inside].all():
            ends = now.fill(high, shards, whole=True)
            starts = np.searchsorted(now.before, ends[:-1], "left")
            return high, [int(now.first[k]) if k < len(now.first) else 1 << KEY_BITS for k in starts]
        # make the windows in which a cut can fall anew from finer cells; there are at most as many windows as shards
        more = max(1, (cells // len(inside)).bit_length() - 1)
        bits = max(0, int(now.bits[inside][~now.single[inside]].min()) - more)
        asked = F.lit(False)
        for run in np.split(inside, np.flatnonzero(np.diff(inside) > 1) + 1):
            asked = asked | F.col("key").between(int(now.first[run[0]]), int(now.first[run[-1]]) + (1 << int(now.bits[run[-1]])) - 1)
        fine = _cells(keyed.where(asked), bits)
        kept = np.setdiff1d(np.arange(len(now.size)), inside)
        now = Cells(
            [*now.first[kept].tolist(), *(r["key"] if r["single"] else r["cell"] << bits for r in fine)],
            [*now.bits[kept].tolist(), *(0 if r["single"] else bits for r in fine)],
            [*now.size[kept].tolist(), *(r["size"] for r in fine)],
            [*now.single[kept].tolist(), *(r["single"] for r in fine)],
        )


def _pushed(now: Cells, capacity: int, shards: int) -> np.ndarray:
    """Earliest ends that a greedy fill can have at this capacity: each shard gives up the cell it ends in."""
    at, ends = 0, []
    for _ in range(shards):
        cell = int(np.searchsorted(now.before, at + capacity, "right")) - 1
        at = int(now.before[min(cell, len(now.size))])
        ends.append(at)
    return np.array(ends, np.int64)


def place(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", buckets: int = 512) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; rows of equal text share a shard.

    Slots count from 0 without gaps within a shard. They are numbered in `buckets` buckets of hashed ids a shard, whose
    counts give each bucket's first slot, so no task holds a whole shard.
    """
    rows = common.cut(sized(docs, id_col, text_col))
    _, starts = cuts(rows.select("key", "size"), shards)
    shard = sum((F.when(F.col("key") >= F.lit(start), 1).otherwise(0) for start in starts), F.lit(0)).cast("int")
    placed = rows.withColumn("shard", shard).withColumn("bucket", F.pmod(F.xxhash64(id_col, "text_crc32", "key"), F.lit(buckets)).cast("int"))
    return number(placed, id_col)


def number(placed: DataFrame, id_col: str) -> DataFrame:
    """Add gapless slots to rows that have a shard and a bucket."""
    from pyspark.sql import Window

    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most shards * buckets rows, whatever the input
    first = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "bucket").orderBy(id_col, "text_crc32", "size")
    numbered = placed.withColumn("within", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(first), ["shard", "bucket"]).select(
        id_col, "size", "text_crc32", "shard", (F.col("within") + F.col("first")).cast("long").alias("slot")
    )
