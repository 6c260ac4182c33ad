"""MinHash near-deduplication with tensored banding, and links confirmed on full sets.

A document's set holds its distinct shingles of five words, as 64-bit hashes. Two small collections of `side` bands of
`ROWS` minhashes each are computed; a table's key joins a band of the one with a band of the other, so side * side tables
need only 2 * side * ROWS minhashes. The least similarity s of a link and the probability `miss` that a pair at s shares no
table are parameters, from which `Scheme` derives the number of bands (two independent collections miss with
(1 - s**ROWS)**side each): 8 a side at 0.85 and 1e-4, 12 a side at 0.8 and 1e-5.

Documents with equal sets are one node. Candidates are compared in two rounds.

1. Every member of a key is compared with the key's smallest one. A code of two bits a minhash travels with the pair, and
   pairs whose codes agree in less than `least_equal` places are dropped (a true link has so few with a probability of a
   tenth of `miss` at most); the others are confirmed by the exact sizes of intersection and union.
2. Keys whose other members lie in several components are open, and their members are searched for further links by an exact
   prefix filter. The shingles of a set are ordered by how many of these members have them, rarest first. Two sets that share
   enough have their first common shingle at ranks that leave room for the intersection they need, on both sides. An inverted
   index of shingles meets only such ranks, and only members of different components. First each member of an entry is held
   against the entry's hub, which has the smallest share of shingles of its own and so is linked with most; then the members
   outside an entry's largest component against all of it. Entries with many members are dealt over tasks.
   No link of these members is lost, and members that are linked with nothing cost next to nothing, as the
   shingles that no other has come first.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing; a text with
fewer than five words has one shingle, the whole sequence; repeated rows, and rows that share an identifier but not the
text, are rows of their own, each with its own set. A row with a null identifier is in the component of its links that has
an identifier, else in a component without identifier. Very long texts are taken whole; their sets are held one at a time.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
ROWS = 2
#: What a link is unless told otherwise: the least similarity, and how often a pair at it may share no table.
SIMILARITY, MISS = 0.85, 1e-4
#: So many members of one shingle meet in one task at most; a code holds the lowest bits of so many minhashes a number.
DEALT, PLACES = 256, 32
#: So many rows of three numbers are broadcast at most.
SHORT_LIST = 500_000

#: Stores an intermediate table and reads it again.
Keep = Callable[[DataFrame], DataFrame]

_R = np.uint64(0x9E3779B97F4A7C15)


class Scheme:
    """Bands, minhashes and tests for links of at least `similarity`, of which a share of `miss` at most is not met."""

    def __init__(self, similarity: float = SIMILARITY, miss: float = MISS):
        if not 0 < similarity <= 1 or not 0 < miss < 1:
            raise ValueError("similarity is above 0 and 1 at most, miss is between 0 and 1")
        least = Fraction(str(similarity))
        self.num, self.den = least.numerator, least.denominator
        s = float(least)
        self.side = 1
        while 1 - (1 - (1 - s**ROWS) ** self.side) ** 2 > miss:
            self.side += 1
        self.half = self.side * ROWS
        self.hashes = n = 2 * self.half
        self.words = -(-n // PLACES)
        # two bits of different minhashes agree by chance in a quarter of the cases
        agree = s + (1 - s) / 4
        self.least_equal, below = 0, (1 - agree) ** n
        while self.least_equal < n and below <= miss / 10:
            self.least_equal += 1
            k = self.least_equal
            below += math.comb(n, k) * agree**k * (1 - agree) ** (n - k)
        self.multipliers = common.mix64(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)

    def similar(self, both, union):
        """Is the intersection (of numbers or columns) large enough for the union?"""
        return both * self.den >= union * self.num

    def room(self, n, rank):
        """The largest size of a set that can be linked with one of n shingles whose first common one has this rank (from 0)."""
        return F.floor((n - rank) * (self.num + self.den) / self.num) - n

    def codes_agree(self, x: str, y: str) -> Column:
        """Do the codes of two documents agree in enough places?"""
        differ = F.lit(0)
        for k in range(self.words):
            odd = F.col(f"{x}{k}").bitwiseXOR(F.col(f"{y}{k}"))
            pairs = odd.bitwiseOR(F.shiftrightunsigned(odd, 1)).bitwiseAND(F.lit(0x5555555555555555))
            differ = differ + F.bit_count(pairs)
        return differ <= self.hashes - self.least_equal


def word_hashes(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 1 << 18) -> np.ndarray:
    """Hashes of the words: the sum of one mixed number for each byte and its place in the word, over pieces of whole words.

    Every place and byte has a number of its own, so no pattern of letters cancels, as it does in a polynomial modulo 2**64.
    """
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + piece, "right")))
        size = ends[first:last] - starts[first:last]
        to = np.cumsum(size)
        place = np.arange(int(to[-1])) - np.repeat(to - size, size)
        at = place + np.repeat(starts[first:last], size)
        with np.errstate(over="ignore"):
            mixed = common.mix64(((place.astype(np.uint64) + np.uint64(1)) << np.uint64(8)) + lower[at])
            out[first:last] = np.add.reduceat(mixed, to - size) + size.astype(np.uint64)
        first = last
    return common.mix64(out)


def shingle_sets(offsets: np.ndarray, raw: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a buffer."""
    n = len(offsets) - 1
    if not len(raw):
        return [np.zeros(0, np.uint64)] * n
    lower = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    prev_blank = np.concatenate([[True], blank[:-1]]) | first[:-1]
    starts = np.flatnonzero(~blank & prev_blank)
    next_blank = np.concatenate([blank[1:], [True]]) | first[1:]
    ends = np.flatnonzero(~blank & next_blank) + 1
    words = word_hashes(lower, starts, ends)
    owner = np.searchsorted(offsets, starts, "right") - 1
    bounds = np.searchsorted(owner, np.arange(n + 1))
    count = max(0, len(words) - SHINGLE + 1)
    joined = np.zeros(count, np.uint64)
    sets = []
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            joined = joined * _R + words[k : k + count]
        joined = common.mix64(joined)
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b - a >= SHINGLE:
                found = np.sort(joined[a : b - SHINGLE + 1])
                sets.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
            elif b > a:
                whole = np.uint64(b - a)
                for word in words[a:b]:
                    whole = whole * _R + word
                sets.append(common.mix64(np.array([whole], np.uint64)))
            else:
                sets.append(np.zeros(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray], scheme: Scheme) -> np.ndarray:
    """The minhashes (32 bits, as signed integers) of each set; those of empty sets mean nothing."""
    sizes = np.array([len(x) for x in sets])
    out = np.zeros((len(sets), scheme.hashes), np.int32)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        with np.errstate(over="ignore"):
            for k, a in enumerate(scheme.multipliers):
                out[full, k] = np.minimum.reduceat((flat * a) >> np.uint64(32), at).astype(np.uint32).view(np.int32)
    return out


def codes(sig: np.ndarray, scheme: Scheme) -> list[np.ndarray]:
    """The lowest two bits of all minhashes, PLACES of them in each number."""
    low = (sig & 3).astype(np.uint64)
    out = []
    for k in range(scheme.words):
        part = low[:, k * PLACES : (k + 1) * PLACES]
        shifts = np.arange(part.shape[1], dtype=np.uint64) * np.uint64(2)
        out.append((part << shifts).sum(1, dtype=np.uint64).view(np.int64))
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str, scheme: Scheme) -> DataFrame:
    """id, mark (hash of the text), n (set size), set_id (digest of the set), sig (minhashes), codes of every row."""
    names = ["id", "mark", "n", "set_id", "sig", *(f"code{k}" for k in range(scheme.words))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            sets = shingle_sets(*common.text_buffers(batch.column("text")))
            sig = signatures(sets, scheme)
            digest = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
            size = np.array([len(x) for x in sets], np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, sig.size + 1, scheme.hashes, dtype=np.int32), pa.array(sig.ravel()))
            columns = [batch.column("id"), batch.column("mark"), pa.array(size), pa.array(digest, pa.binary()), lists, *map(pa.array, codes(sig, scheme))]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = common.own_columns(docs, id=id_col, text=text_col).select("id", common.mark("text").alias("mark"), "text")
    kinds = [rows.schema["id"].dataType.simpleString(), "long", "long", "binary", "array<int>", *["long"] * scheme.words]
    return rows.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in zip(names, kinds, strict=True)))


def full_sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, keep: Keep) -> DataFrame:
    """node, items (the whole set) of the wanted nodes (node, id and mark of the row to read); a short list is broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            sets = shingle_sets(*common.text_buffers(batch.column("text")))
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            items = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), items], ["node", "items"])

    wanted = keep(wanted.select("node", F.col("id").alias("_id"), F.col("mark").alias("_mark")))
    n = wanted.count()
    rows = common.own_columns(docs, id=id_col, text=text_col).withColumn("mark", common.mark("text"))
    rows = rows.join(F.broadcast(wanted) if n <= SHORT_LIST else wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    sets = keep(rows.select("node", "text").mapInArrow(run, "node long, items array<long>"))
    # repeated rows give a node's set more than once
    return sets if sets.count() == n else keep(sets.groupBy("node").agg(F.any_value("items").alias("items")))


def _keys(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """node, key: a row for each of the side * side tables."""
    side, half = scheme.side, scheme.half
    t = F.col("table")
    parts = [F.col("sig")[(F.floor(t / side) * ROWS + k).cast("int")] for k in range(ROWS)]
    parts += [F.col("sig")[(t % side * ROWS + half + k).cast("int")] for k in range(ROWS)]
    tables = nodes.select("node", "sig", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("table"))
    return tables.select("node", F.xxhash64(t, *parts).alias("key"))


def confirm(pairs: DataFrame, sets: DataFrame, scheme: Scheme, keep: Keep) -> DataFrame:
    """The pairs (x, y) whose full sets have the least similarity, by exact sizes of intersection and union."""
    left = sets.select(F.col("node").alias("x"), F.col("items").alias("left_items"))
    right = sets.select(F.col("node").alias("y"), F.col("items").alias("right_items"))
    dealt, left, x_key = common.deal(keep(pairs), left, "x", keep=keep)
    dealt, right, y_key = common.deal(keep(dealt), right, "y", keep=keep)
    joined = dealt.join(left, x_key).join(right, y_key)
    both = F.size(F.array_intersect("left_items", "right_items")).cast("long")
    return joined.where(scheme.similar(both, F.size("left_items") + F.size("right_items") - both)).select("x", "y")


def components(links: DataFrame, keep: Keep = common.cut) -> DataFrame:
    """id, component (the smallest id reachable) of all ids in the links (x, y), by alternating star contraction."""
    edges = keep(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct())
    count, seen = edges.count(), None
    while count:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("size"))
        # larger neighbours move to the smallest one
        moved = common.join_groups(both.where("v > u"), least, "u", "size", 2 * count, keep)
        large = keep(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        # smaller neighbours and the node itself move to the smallest one
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size"))
        moved = common.join_groups(large, lowest, "u", "size", 2 * count, keep)
        small = moved.select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = keep(small.distinct())
        # a star forest comes back unchanged: the same number of edges with the same sums
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen, count = now, now[0]
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of nodes with their component; a node without links is its own."""
    other = found.select(F.col("id").alias("node"), "component")
    return rows.join(other, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _open_members(buckets: DataFrame, found: DataFrame, keep: Keep) -> DataFrame:
    """node: the members of keys whose members, the smallest one left aside, lie in several components."""
    rest = _labelled(buckets.where("node <> center").select("key", "node"), found)
    keys = rest.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("size"))
    keys = keys.where("a <> b").select("key", "size")
    return common.join_groups(rest.select("key", "node"), keys, "key", "size", keep=keep).select("node").distinct()


def prefix_index(members: DataFrame, scheme: Scheme, keep: Keep) -> DataFrame:
    """shingle, node, n, room, alone: the shingles of members (node, n, items) that can be the first common one of a link.

    `room` is the largest partner that the shingle's rank leaves, `alone` the number of shingles that no other member has. These
    come first in the order, so a member with too many of them is linked with nothing and is not in the index.
    """
    shingles = lambda rows: rows.select("node", "n", *(["alone"] if "alone" in rows.columns else []), F.explode("items").alias("shingle"))
    often = keep(shingles(members).groupBy("shingle").agg(F.count("*").alias("often"), F.min("node").alias("node")))
    alone = often.where("often = 1").groupBy("node").agg(F.count("*").alias("alone"))
    able = members.join(alone, "node", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    able = keep(able.where((F.col("n") - F.col("alone")) * scheme.den >= F.col("n") * scheme.num))
    known = common.join_groups(shingles(able), often.where("often > 1").drop("node"), "shingle", "often", keep=keep)
    order = Window.partitionBy("node").orderBy("often", "shingle")
    ranked = known.withColumn("room", scheme.room(F.col("n"), F.col("alone") + F.row_number().over(order) - 1))
    # the least partner of a set of n has s * n
    return keep(ranked.where(F.col("room") * scheme.den >= F.col("n") * scheme.num).select("shingle", "node", "n", "room", "alone"))


def hub_pairs(index: DataFrame, keep: Keep) -> DataFrame:
    """(x, y) of the members of each entry and its hub, the one with the smallest share of shingles of its own."""
    hub = F.min(F.struct((F.col("alone") / F.col("n")).alias("share"), "node", "component", "n", "room")).alias("hub")
    entries = index.groupBy("shingle").agg(hub, F.count("*").alias("size")).where("size > 1")
    held = common.join_groups(index, entries, "shingle", "size", keep=keep)
    met = held.where("component <> hub.component and room >= hub.n and hub.room >= n")
    return met.select(F.greatest("node", "hub.node").alias("x"), F.least("node", "hub.node").alias("y")).distinct()


def prefix_pairs(index: DataFrame, keep: Keep) -> DataFrame:
    """(x, y) of members in different components that the prefix filter can't tell from links."""
    shares = index.groupBy("shingle", "component").agg(F.count("*").alias("size"), F.min("n").alias("least"))
    entries = shares.groupBy("shingle").agg(
        F.sum("size").alias("size"), F.count("*").alias("kinds"), F.min("least").alias("least"), F.max(F.struct("size", "component")).alias("main")
    )
    entries = entries.where("kinds > 1").select("shingle", "size", "least", F.col("main.component").alias("main"))
    held = common.join_groups(index, entries, "shingle", "size", keep=keep).where("room >= least")
    parts = F.ceil(F.col("size") / DEALT)
    side = lambda name: [F.col(c).alias(f"{name}_{c}") for c in ("node", "component", "n", "room")]
    few = held.where("component <> main").select("shingle", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), *side("x"))
    many = held.select("shingle", F.pmod(F.xxhash64("node"), parts).alias("part"), *side("y"))
    met = few.join(many, ["shingle", "part"]).where("x_component <> y_component and x_room >= y_n and y_room >= x_n")
    return met.select(F.greatest("x_node", "y_node").alias("x"), F.least("x_node", "y_node").alias("y")).distinct()


def _joined(found: DataFrame, links: DataFrame, keep: Keep) -> DataFrame:
    """The components (id, component) with more links."""
    if links.isEmpty():
        return found
    return components(found.select(F.col("id").alias("x"), F.col("component").alias("y")).unionByName(links), keep)


def _link(docs: DataFrame, id_col: str, text_col: str, similarity: float, miss: float) -> DataFrame:
    """id, mark, n, component, stays (is it the one row of its component that does) of every row, cut from its lineage."""
    scheme = Scheme(similarity, miss)
    with common.Workspace(docs.sparkSession, "near") as space:
        return common.cut(_placed(docs, id_col, text_col, scheme, space.keep))


def _placed(docs: DataFrame, id_col: str, text_col: str, scheme: Scheme, keep: Keep) -> DataFrame:
    sketched = keep(sketches(docs, id_col, text_col, scheme).withColumn("row", F.monotonically_increasing_id()))
    full = sketched.where("n > 0")
    # a node is a set; its number is the row that its content is read from
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "mark")).alias("first")
    groups = keep(full.groupBy("set_id").agg(first, F.count("*").alias("copies")).withColumn("node", F.col("first.row")))
    content = groups.select("node", F.col("first.id").alias("id"), F.col("first.mark").alias("mark"))
    code = [f"code{k}" for k in range(scheme.words)]
    nodes = full.select(F.col("row").alias("node"), "n", "sig", *code).join(groups.select("node"), "node", "left_semi")
    # a node makes side * side keys, so the nodes are dealt over as many tasks as the keys need
    keys = _keys(nodes.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), scheme)
    shared = keys.groupBy("key").agg(F.min("node").alias("center"), F.count("*").alias("size")).where("size > 1")
    buckets = keep(common.join_groups(keys, shared, "key", "size", keep=keep).select("key", "node", "center"))
    # first round: every member of a key against its smallest one
    stars = keep(buckets.where("node <> center").select(F.col("node").alias("x"), F.col("center").alias("y")).distinct())
    brief = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), *(F.col(k).alias(f"{c}_{k}") for k in code))
    centers = stars.groupBy("y").agg(F.count("*").alias("size")).join(brief("y"), "y")
    near = common.join_groups(stars.join(brief("x"), "x"), centers, "y", "size", keep=keep)
    near = near.where(scheme.similar(F.least("n_x", "n_y"), F.greatest("n_x", "n_y"))).where(scheme.codes_agree("x_code", "y_code"))
    near = keep(near.select("x", "y"))
    ends = near.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    links = keep(confirm(near, full_sets(docs, id_col, text_col, content.join(ends, "node", "left_semi"), keep), scheme, keep))
    # second round: members of open keys, across components
    found = components(links, keep)
    open_members = keep(_open_members(buckets, found, keep))
    sets = full_sets(docs, id_col, text_col, content.join(open_members, "node", "left_semi"), keep)
    index = prefix_index(sets.withColumn("n", F.size("items").cast("long")), scheme, keep)
    for pairs in (hub_pairs, prefix_pairs):
        more = keep(confirm(pairs(_labelled(index, found), keep), sets, scheme, keep))
        found = _joined(found, more, keep)
    placed = _labelled(groups, found)
    firsts = placed.groupBy("component").agg(F.min("first").alias("first"), F.count("*").alias("size"))
    placed = common.join_groups(placed.drop("first"), firsts, "component", "size", keep=keep).select("set_id", "copies", "first")
    named = common.join_groups(full.select("id", "mark", "row", "n", "set_id"), placed, "set_id", "copies", keep=keep)
    named = named.select("id", "mark", "n", F.col("first.id").alias("component"), (F.col("row") == F.col("first.row")).alias("stays"))
    empty = sketched.where("n = 0").select("id", "mark", "n", F.col("id").alias("component"), F.lit(True).alias("stays"))
    return named.unionByName(empty)


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    return _link(docs, id_col, text_col, similarity, miss).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, miss: float = MISS) -> DataFrame:
    """One row of each component stays, with all its columns: the one with the smallest id, of several such rows any one."""
    return common.take_rows(docs, _link(docs, id_col, text_col, similarity, miss), id_col, text_col)
