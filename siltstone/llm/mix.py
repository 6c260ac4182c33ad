"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Each source's share of a budget follows from its weight, but no source is taken more than `most` times: what a source can't
give is shared again by weight among the others (`targets`). The mix is a sequence of slots. Slot t has the t-th point of a
golden-ratio sequence on the unit interval, which maps through the cumulative quotas of the sources to one source; the slot's rank
among the slots of that source says which block it takes (`schedule`). A source's documents are shuffled by a hash of their
identifier and laid end to end, again from the front once all are taken, and this line of words is cut into blocks of equal
size (`lay_out`); the last block ends at the target. Blocks and slots are joined by source and rank (`mix`).

The points fill every source's share evenly, so any stretch of the mix holds the sources near their weights. Points beyond a
source's quota are left out, and the few ranks that the points don't reach follow at the end, so that each source gives its target
to the word. Nothing here depends on how rows are dealt over tasks, so reruns agree.

Words are counted and points computed by built-in functions. Ranks and running sums are taken by parts (ranges of points, ranges of
hashes), whose totals are added up first, so a source with most of the rows lies in many tasks. Blocks hold
`block` words each, so the join by source and rank has no hot key, and the rows of the few hot sources' targets are broadcast
(joins.HOT_SHARE), others are joined by a shuffle.

Defined results: a null or empty text has no words, and is taken 0 times; a null source is a source of its own, the last; an empty
table gives no rows; without any words all targets are 0. Rows that share an identifier are rows of their own; rows repeated in
full are counted first and laid out beside each other, and which of them gives which words makes no difference. Very long
texts are cut into as many blocks as they fill. Extra columns are left out and can't clash.
"""

from __future__ import annotations

from collections.abc import Callable
from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..joins import below
from . import common

#: Points lie on a grid of 2**40, on which the golden ratio steps; slots up to that number have points of their own.
GRID_BITS = 40
STEP = round((sqrt(5) - 1) / 2 * (1 << GRID_BITS)) | 1
#: Points to a part when ranks are counted, rows to a part when documents are laid out.
POINTS, ROWS = 2048, 1024
CELLS = 1024
#: A larger list of sources is joined by a shuffle instead of a broadcast.
SHORT_LIST = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The number of words of a text, null as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_turn(*weights: float) -> Callable[[Column], Column]:
    """Weights that repeat over the sources in their order."""
    return lambda place: F.array(*(F.lit(float(w)) for w in weights))[(place % len(weights)).cast("int")]


def _source_key(source: Column) -> Column:
    """A string that orders sources by code point, null last."""
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("a"), source.cast("string")))


def targets(sizes: DataFrame, weigh: Callable[[Column], Column], share: float = 1.5, most: float = 2.0, keep: Callable[[DataFrame], DataFrame] = common.cut) -> DataFrame:
    """key, source_size, rows, weight, target of every source; `sizes` has key, source_size and rows.

    Round by round the sources whose share would exceed `most` times their size get that much, and the rest of the budget is
    shared by the others; only sums come to the driver.
    """
    ranked = below(sizes.select(F.lit(0).alias("all"), "key", F.lit(1).alias("one"), "source_size", "rows"), "all", "key", "one")
    known = keep(ranked.select("key", "source_size", "rows", weigh(F.col("below")).alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")))
    words_in_all = known.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    budget, level, free = words_in_all * float(share), 0.0, None
    while True:
        full = F.col("weight") * F.lit(level) >= F.col("cap")
        sums = known.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("capped"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weight"), F.count(F.when(~full, 1)).alias("free")).first()
        if not sums["free"] or sums["free"] == free:
            break
        capped, weight, free = sums["capped"], sums["weight"], sums["free"]
        level = (budget - capped) / weight
    if not words_in_all:
        return known.select("key", "source_size", "rows", "weight", F.lit(0.0).alias("target"))
    fair = F.lit(budget - capped) * F.col("weight") / F.lit(weight)
    return known.select("key", "source_size", "rows", "weight", F.when(full, F.col("cap")).otherwise(fair).alias("target"))


def point(slot: Column) -> Column:
    """The slot's point of the golden-ratio sequence, times 2**GRID_BITS; the product is taken in two halves that fit a long."""
    half, grid = 1 << (GRID_BITS // 2), 1 << GRID_BITS
    high = F.pmod(F.shiftright(slot, GRID_BITS // 2), F.lit(half)) * F.lit((STEP << (GRID_BITS // 2)) % grid)
    return F.pmod(F.pmod(slot, F.lit(half)) * F.lit(STEP) + F.pmod(high, F.lit(grid)), F.lit(grid))


def schedule(quotas: DataFrame, keep: Callable[[DataFrame], DataFrame] = common.cut) -> DataFrame:
    """slot, key, rank: `quota` slots for every source of `quotas` (key, quota), in mixed order."""
    spark, grid = quotas.sparkSession, 1 << GRID_BITS
    quotas = keep(quotas.where("quota > 0").select(F.lit(0).alias("all"), "key", "quota"))
    total, n_sources = quotas.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    # each source holds the points from `low` to below `high`; it is listed once for each cell of points that it meets
    at = lambda c: F.floor(c.cast("double") / F.lit(float(max(total, 1))) * F.lit(float(grid))).cast("long")
    shares = below(quotas, "all", "key", "quota").withColumns({"low": at(F.col("below")), "high": at(F.col("below") + F.col("quota"))})
    shares = keep(shares.select("key", "quota", "low", "high"))
    cell = grid // CELLS
    cells = shares.where("low < high").select("*", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("high") - 1) / cell))).alias("cell"))
    points = spark.range(total).select(F.col("id").alias("slot"), point(F.col("id")).alias("point")).withColumn("cell", F.floor(F.col("point") / cell))
    placed = points.join(F.broadcast(cells) if n_sources <= SHORT_LIST else cells, "cell").where("low <= point AND point < high")
    placed = placed.select("slot", "key", "quota", F.floor(F.col("slot") / POINTS).alias("part"))
    counts = keep(placed.groupBy("key", "part").agg(F.count("*").alias("n")))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("key", "part").orderBy("slot")
    ranked = placed.withColumn("inside", F.row_number().over(inside) - 1).join(starts, ["key", "part"])
    met = ranked.withColumn("rank", F.col("start") + F.col("inside")).where("rank < quota").select("slot", "key", "rank")
    # ranks that no point has reached follow at the end, source by source
    lacking = shares.join(counts.groupBy("key").agg(F.sum("n").alias("n")), "key", "left").select(F.lit(0).alias("all"), "key", "quota", F.greatest(F.lit(0).cast("long"), F.col("quota") - F.coalesce(F.col("n"), F.lit(0))).alias("lack"))
    tail = below(lacking.where("lack > 0"), "all", "key", "lack")
    tail = tail.select((F.lit(total) + F.col("below")).alias("first"), "key", "quota", "lack", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lack") - 1)).alias("k"))
    return met.unionByName(tail.select((F.col("first") + F.col("k")).alias("slot"), "key", (F.col("quota") - F.col("lack") + F.col("k")).alias("rank")))


def lay_out(rows: DataFrame, aims: DataFrame, keep: Callable[[DataFrame], DataFrame] = common.cut) -> DataFrame:
    """doc_id, source, size, copy, place, start, key, source_size, target of every row: `start` words of its source lie before it.

    Rows have doc_id, source, key, size and place (the order within a source); `copy` numbers rows repeated in full.
    """
    once = rows.groupBy("key", "place", "doc_id", "source", "size").agg(F.count("*").alias("n"))
    once = common.join_groups(once, aims, "key", "rows", keep=keep)
    # the first digits of the hash deal a source's rows over parts of about ROWS rows
    part = F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * F.ceil(F.col("rows") / ROWS)).cast("long")
    once = keep(once.withColumn("part", part))
    sums = once.groupBy("key", "part").agg(F.sum(F.col("size") * F.col("n")).alias("sum"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("key", "part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("key", "part").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = once.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0))).join(starts, ["key", "part"])
    zero = F.lit(0).cast("long")
    groups = laid.where("n > 1").withColumn("many", F.explode(F.sequence(zero, F.floor((F.col("n") - 1) / ROWS)))).repartition("key", "place", "many")
    each = F.explode(F.sequence(F.col("many") * ROWS, F.least(F.col("n"), (F.col("many") + 1) * ROWS) - 1))
    laid = laid.where("n = 1").withColumn("copy", zero).unionByName(groups.withColumn("copy", each).drop("many"))
    start = F.col("before") + F.col("inside") + F.col("copy") * F.col("size")
    return laid.select("doc_id", "source", "size", "copy", "place", start.alias("start"), "key", "source_size", "target")


def pieces(laid: DataFrame, block: int) -> DataFrame:
    """The rows of `laid` with rank, first, last: the words that a block of the source's line takes of a row.

    A row is met once in every round over its source, cut at the ends of blocks and at the target; a row of which nothing is
    taken stays, with nulls.
    """
    end = F.floor("target")
    rounds = F.when(F.col("source_size") > 0, F.ceil(end / F.col("source_size"))).otherwise(0).cast("long")
    zero = F.lit(0).cast("long")
    met = laid.withColumn("round", F.explode(F.when(rounds > 0, F.sequence(zero, rounds - 1)).otherwise(F.array(zero))))
    low = F.col("round") * F.col("source_size") + F.col("start")
    high = F.least(low + F.col("size"), end)
    met = met.withColumns({"low": low, "high": high})
    ranks = F.when(F.col("low") < F.col("high"), F.sequence(F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block)))
    met = met.withColumn("rank", F.explode_outer(ranks))
    first, last = F.greatest(F.col("low"), F.col("rank") * block) - F.col("low"), F.least(F.col("high"), (F.col("rank") + 1) * block) - F.col("low")
    return met.withColumns({"first": first, "last": last}).drop("low", "high", "start")


def mix(docs: DataFrame, weigh: Callable[[Column], Column], share: float = 1.5, most: float = 2.0, block: int = 1024, work: common.Workspace | None = None, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, copy, place, key, source_size, target, round, rank, first, last, slot.

    One row for each piece of a document that the mix takes: its words from `first` to before `last`, in the block at position `slot`;
    and a row without slot for a document of which a round takes nothing. `weigh` gives a source's weight by its place among the
    sources. Sorted by slot, round and place the pieces are the mixed text.
    """
    keep = work.keep if work else common.cut
    own = common.own_columns(docs, doc_id=doc, text=text, source=source)
    own = own.select("doc_id", F.col("source").cast("string").alias("source"), _source_key(F.col("source")).alias("key"), words(F.col("text")).alias("size"))
    # the size deals rows without an identifier
    place = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string")))
    rows = keep(own.withColumn("place", place))
    sizes = keep(rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    aims = keep(targets(sizes, weigh, share, most, keep))
    slots = schedule(aims.select("key", F.ceil(F.floor("target") / block).cast("long").alias("quota")), keep)
    taken = keep(pieces(lay_out(rows, aims.drop("weight"), keep), block))
    there = taken.where("rank IS NOT NULL").join(slots, ["key", "rank"])
    return there.unionByName(taken.where("rank IS NULL").withColumn("slot", F.lit(None).cast("long")))


def text_of(taken: DataFrame, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """slot, round, place, copy, text of every piece, its words joined by blanks; identifiers have to be unique."""
    whole = common.own_columns(docs, doc_id=doc, text=text)
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("first") + 1).cast("int"), (F.col("last") - F.col("first")).cast("int")), " ")
    return taken.where("slot IS NOT NULL").join(whole, "doc_id").select("slot", "round", "place", "copy", cut.alias("text"))


def account(docs: DataFrame, weigh: Callable[[Column], Column], **how) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words that mix() takes, repeats counted) of every row."""
    with common.Workspace(docs.sparkSession, "mix") as work:
        return common.cut(_account(mix(docs, weigh, work=work, **how)))


def _account(taken: DataFrame) -> DataFrame:
    by = ["key", "doc_id", "source", "size", "copy", "place", "source_size", "target"]
    return taken.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("last") - F.col("first"))), F.lit(0)).cast("long").alias("taken")).drop("key", "copy", "place")
