"""Audit of how far the sources of each language diverge in their terms, by sketch-prefiltered counting.

Terms are runs of ASCII letters, lower-cased, and of characters beyond ASCII. Each task counts the terms of its documents by language
and source and writes the counts (with document frequencies) to the shared folder. From these count-min sketches are made, one a
task, and merged; cells stop at the least document frequency that a term needs, and as a cell is never less than the frequency of
any of its terms, terms that the merged sketch puts below it are impossible and go before the shuffle. The survivors are
counted exactly, once a language and term, and those that are too rare after all go. The merged sketch has a fixed size (`width` cells in
DEPTH rows, four cells a byte), so it is broadcast; a sketch too narrow for a corpus lets more rare terms pass, and changes no result.

All arithmetic is in whole numbers. With N occurrences of the V kept terms in a group, p = 1 + floor(10**9 (count + 1) / (N + V)), and the
divergence of p from q is floor((p - q)**2 / q). The sum over all kept terms for each two sources of a language needs no walk
over V terms for each of them: a term that neither has adds the same for all such terms; what a term adds beyond that by being in one
of the two depends on its p alone, so it comes from each source's counts of equal p; and a sparse join by term, over the sources that
have it, adds the rest for terms in both. The pairs of a term's sources are formed in arrays and summed up before they leave a task.

A common term has one row a task and source when it is shuffled, and one row a source afterwards. Groups of a language are held as
one list, as long as the result has rows for one source.

Defined results: null texts, languages and sources count as empty; a group without kept terms has p of zero counts, and 0 for
all pairs of a language without kept terms; an empty table gives no rows; rows that share an identifier and repeated rows count each;
very long texts are read whole, in pieces that end between terms; ties are ranked by item in UTF-8. Extra columns can't clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

TERM, BETWEEN = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
LEAST_DOCUMENTS = 3
#: The sketch: cells in a row (a multiple of CHUNK), rows; cells are merged in pieces of CHUNK.
WIDTH, DEPTH, CHUNK = 1 << 22, 3, 1 << 16
#: Terms that a task counts before it writes them out; pairs that are formed at once; bytes of text that are split at once.
HELD, PAIRS, PIECE = 800_000, 1 << 20, 1 << 22
SCALE = 1_000_000_000


def _terms(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece."""
    text, at = text.lower(), 0  # of bytes, this lowers A to Z only
    while at < len(text):
        cut = BETWEEN.search(text, at + piece) if len(text) - at > piece else None
        end = cut.start() if cut else len(text)
        yield TERM.findall(text, at, end)
        at = end


COUNTS = "lang string, term string, df long, entries array<struct<source: string, n: long, df: long>>"


def _counted(lang: str, docs_with: Counter, sources: dict[str, Counter], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Rows of COUNTS; the document frequency stands in the row and again in its first entry."""
    terms, names = list(docs_with), list(sources)
    number = dict(zip(terms, range(len(terms)), strict=True))
    which = np.concatenate([np.fromiter(map(number.__getitem__, times), np.int64, len(times)) for times in sources.values()])
    n = np.concatenate([np.fromiter(times.values(), np.int64, len(times)) for times in sources.values()])
    source = np.repeat(np.arange(len(names)), [len(times) for times in sources.values()])
    order = np.argsort(which, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(terms)))])
    df = np.fromiter(docs_with.values(), np.int64, len(terms))
    first = np.zeros(len(which), np.int64)
    first[starts[:-1]] = df
    names = pa.array(names, pa.string())
    for at in range(0, len(terms), rows):
        to = min(at + rows, len(terms))
        part = order[starts[at] : starts[to]]
        entries = pa.StructArray.from_arrays([names.take(pa.array(source[part])), pa.array(n[part]), pa.array(first[starts[at] : starts[to]])], ["source", "n", "df"])
        lists = pa.ListArray.from_arrays(pa.array((starts[at : to + 1] - starts[at]).astype(np.int32)), entries)
        texts = pa.array(terms[at:to], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (to - at), pa.string()), texts, pa.array(df[at:to]), lists], ["lang", "term", "df", "entries"])


def count_terms(docs: DataFrame, held_terms: int = HELD) -> DataFrame:
    """COUNTS of each task: a row a language and term with its document frequency, and its occurrences in each source.

    docs has lang, source and text, no nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Counter, dict[str, Counter]]] = {}

        def told():
            for lang, (docs_with, sources) in held.items():
                if docs_with:
                    yield from _counted(lang, docs_with, sources)
            held.clear()

        for batch in common.slices(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
                docs_with, sources = held.setdefault(lang, (Counter(), {}))
                times = sources.setdefault(source, Counter())
                distinct: set[bytes] = set()
                for terms in _terms(text):
                    times.update(terms)
                    distinct.update(terms)
                docs_with.update(distinct)
            if sum(len(times) for _, sources in held.values() for times in sources.values()) > held_terms:
                yield from told()
        yield from told()

    return docs.mapInArrow(run, COUNTS)


def _cells(hashes: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell in each row of the sketch, from one 64-bit hash."""
    h = hashes.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((low + np.uint64(k) * high) % np.uint64(width)).astype(np.int64) for k in range(DEPTH)]


def sketch(counts: DataFrame, width: int = WIDTH) -> np.ndarray:
    """The merged count-min sketch of document frequencies by language and term, four cells a byte; cells stop at LEAST_DOCUMENTS."""
    most = LEAST_DOCUMENTS
    hashed = counts.select(F.xxhash64("lang", "term").alias("h"), F.least("df", F.lit(most)).alias("df"))

    def rows(cells: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for chunk, held in cells.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "cells": pa.array([held.tobytes()], pa.binary())})

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = np.zeros((DEPTH, width), np.uint16)
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):  # so many additions can't overflow a cell
                part = batch.slice(at, 10_000)
                df = part.column("df").to_numpy(zero_copy_only=False).astype(np.uint16)
                for k, cell in enumerate(_cells(part.column("h").to_numpy(zero_copy_only=False), width)):
                    np.add.at(made[k], cell, df)
                    made[k][cell] = np.minimum(made[k][cell], most)
        chunks = made.astype(np.uint8).reshape(-1, CHUNK)
        yield from rows({int(k): chunks[k] for k in np.flatnonzero(chunks.any(1))})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, cells in zip(batch.column("chunk").to_pylist(), batch.column("cells"), strict=True):
                more = np.frombuffer(cells.as_buffer(), np.uint8)
                met[chunk] = np.minimum(met[chunk] + more, most) if chunk in met else more
        yield from rows({chunk: sum(cells[k::4] << (2 * k) for k in range(4)) for chunk, cells in met.items()})

    form = "chunk long, cells binary"
    merged = np.zeros((DEPTH * width // CHUNK, CHUNK // 4), np.uint8)
    for row in hashed.mapInArrow(fill, form).repartition("chunk").mapInArrow(merge, form).collect():
        merged[row.chunk] = np.frombuffer(row.cells, np.uint8)
    return merged.reshape(DEPTH, width // 4)


def possible(counts: DataFrame, merged: np.ndarray) -> DataFrame:
    """The counts of terms that the sketch puts at LEAST_DOCUMENTS; no term with as many documents is lost."""
    known, width = counts.sparkSession.sparkContext.broadcast(merged), merged.shape[1] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = np.ones(batch.num_rows, bool)
            for k, cell in enumerate(_cells(batch.column("h").to_numpy(zero_copy_only=False), width)):
                stays &= (known.value[k][cell >> 2] >> ((cell & 3) * 2).astype(np.uint8)) & 3 >= LEAST_DOCUMENTS
            yield batch.drop_columns(["h"]).filter(pa.array(stays))

    return counts.withColumn("h", F.xxhash64("lang", "term")).mapInArrow(run, counts.schema)


def _p(count: str, n: str, v: str) -> Column:
    """1 + floor(10**9 (count + 1) / (n + v)); null without kept terms."""
    return F.expr(f"CASE WHEN {n} + {v} > 0 THEN CAST(1 + (CAST({count} + 1 AS DECIMAL(20, 0)) * {SCALE}) DIV CAST({n} + {v} AS DECIMAL(20, 0)) AS BIGINT) END")


def _f(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q)"""
    return F.call_function("div", (p - q) * (p - q), q)


def _in_both(terms: DataFrame, at_once: int) -> DataFrame:
    """lang, source, item, value: what terms that two sources have add beyond what they add by being in one of them.

    `terms` has lang and entries (source, p, p0) of each term.
    """

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    def summed(lang: str, names: list[str], keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        found, place = np.unique(keys, return_inverse=True)
        sums = np.zeros(len(found), np.int64)
        np.add.at(sums, place, values)
        return pa.RecordBatch.from_pydict({
            "lang": pa.array([lang] * len(found), pa.string()), "source": pa.array([names[k // len(names)] for k in found], pa.string()),
            "item": pa.array([names[k % len(names)] for k in found], pa.string()), "value": pa.array(sums, pa.int64()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            langs = whole.column("lang").dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                lists = whole.column("entries").filter(pa.array(np.asarray(langs.indices) == code))
                rows, flat = np.asarray(lists.value_lengths()), lists.flatten()
                source = flat.field("source").dictionary_encode()
                names, who = source.dictionary.to_pylist(), np.asarray(source.indices).astype(np.int64)
                p, p0 = np.asarray(flat.field("p")), np.asarray(flat.field("p0"))
                starts = np.cumsum(rows) - rows
                for k in np.unique(rows):
                    at = starts[rows == k][:, None] + np.arange(k)
                    wide = max(1, min(k, at_once // k))  # sources that are held against all k of a term at once
                    tall = max(1, at_once // (k * wide))
                    for top in range(0, len(at), tall):
                        h = at[top : top + tall, None, :]
                        for left in range(0, k, wide):
                            g = at[top : top + tall, left : left + wide, None]
                            more = f(p[g], p[h]) - f(p[g], p0[h]) - f(p0[g], p[h]) + f(p0[g], p0[h])
                            keys = who[g] * len(names) + who[h]
                            other = who[g] != who[h]
                            if other.any():
                                yield summed(lang, names, keys[other], more[other])

    return terms.mapInArrow(run, "lang string, source string, item string, value long")


def audit(docs: DataFrame, top: int = 200, width: int = WIDTH, held_terms: int = HELD, at_once: int = PAIRS, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: the divergence of a source from each other source of its language, over all kept terms. Part `term`: the `top`
    terms in which a source exceeds its language most. `width` is that of the sketch, `held_terms` and `at_once` bound what a
    task holds; none of them changes a result.
    """
    spark = docs.sparkSession
    own = common.own_columns(docs, lang=lang, source=source, text=text).select(*(common.text_or_empty(c).cast("string").alias(c) for c in ("lang", "source", "text")))
    with common.Workspace(spark, "divergence") as work:
        counts = work.keep(count_terms(own, held_terms))
        survivors = possible(counts, sketch(counts, width))
        # the entries are summed one by one: a common term has one for each task and source
        exact = survivors.repartition("lang", "term").select("lang", "term", F.inline("entries")).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
        kept = exact.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("entries"))
        kept = work.keep(kept.where(F.col("df") >= LEAST_DOCUMENTS).drop("df"))
        entries = kept.select("lang", "term", "total", F.explode("entries").alias("e")).select("lang", "term", "total", "e.source", "e.n")
        groups = _groups(own, kept, entries, work)
        rows = common.join_groups(entries.withColumn("group", _group_key()), groups.drop("lang", "source"), "group", "rows", keep=lambda df: df)
        rows = work.keep(rows.select("group", "lang", "source", "term", _p("n", "n_source", "v").alias("p"), "p0", _p("total", "n_lang", "v").alias("q")))
        place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        terms = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).cast("long").alias("value"))
        terms = terms.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
        pairs = _pairs(rows, groups, work, at_once).withColumn("rank", F.row_number().over(place))
        return common.cut(terms.unionByName(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")))


def _group_key() -> Column:
    return F.concat(F.length("lang").cast("string"), F.lit(":"), "lang", "source")


def _groups(own: DataFrame, kept: DataFrame, entries: DataFrame, work: common.Workspace) -> DataFrame:
    """group, lang, source, rows, n_source, n_lang, v, p0 of every group that occurs."""
    met = own.select("lang", "source").distinct()
    by_source = entries.groupBy("lang", "source").agg(F.sum("n").alias("n_source"), F.count("*").alias("rows"))
    by_lang = kept.groupBy("lang").agg(F.sum("total").alias("n_lang"), F.count("*").alias("v"))
    found = met.join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0, ["n_source", "rows", "n_lang", "v"])
    return work.keep(found.select(_group_key().alias("group"), "*").withColumn("p0", _p("0", "n_source", "v")))


def _pairs(rows: DataFrame, groups: DataFrame, work: common.Workspace, at_once: int) -> DataFrame:
    """lang, source, item, value for every two sources of a language."""
    peers = work.keep(groups.groupBy("lang").agg(F.collect_list(F.struct(F.col("source").alias("item"), F.col("p0").alias("item_p0"))).alias("peers"), F.sum(F.col("rows") + 1).alias("size")))
    p, p0, other = F.col("p"), F.col("p0"), F.col("item_p0")

    def met(table: DataFrame, *more: str) -> DataFrame:
        """The rows of a language beside each of its other sources."""
        joined = common.join_groups(table, peers, "lang", "size", keep=lambda df: df)
        return joined.select("lang", "source", "p0", *more, F.inline("peers")).where("item <> source")

    base = met(groups.select("lang", "source", "p0", "v"), "v").select("lang", "source", "item", F.coalesce(F.col("v") * _f(p0, other), F.lit(0)).cast("long").alias("value"))
    equal = rows.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("m"))
    alone = met(equal, "p", "m").groupBy("lang", "source", "item").agg(
        F.sum((F.col("m") * (_f(p, other) - _f(p0, other))).cast("long")).alias("ahead"), F.sum((F.col("m") * (_f(other, p) - _f(other, p0))).cast("long")).alias("behind")
    )
    ahead = alone.select("lang", "source", "item", F.col("ahead").alias("value"))
    behind = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("behind").alias("value"))
    terms = rows.repartition("lang", "term").groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("entries")).where(F.size("entries") > 1)
    both = _in_both(terms.select("lang", "entries"), at_once)
    found = base.unionByName(ahead).unionByName(behind).unionByName(both)
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
