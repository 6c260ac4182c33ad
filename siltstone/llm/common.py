"""Helpers shared by the training-data operators: shared storage, skew-safe joins, Arrow text buffers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..joins import join_groups

cut, scratch, discard = storage.cut, storage.scratch, storage.discard


def exists(spark: SparkSession, path: str) -> bool:
    """Is there such a path in the shared storage?"""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def touch(spark: SparkSession, path: str) -> None:
    """Make an empty file in the shared storage."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(there, True).close()


class Workspace:
    """Intermediate tables in a folder of the shared storage, which goes when the work is done.

    Unlike checkpoints they are columnar and compressed, and their true sizes are known to the optimizer.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.made = spark, scratch(spark, name), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.folder}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        discard(self.spark, self.folder)


def own_columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Select only the columns an operator works on, under its own names; extra columns cannot clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in wanted.items()])


def deal(rows: DataFrame, wide: DataFrame, key: str, part: int = 256, keep: Callable[[DataFrame], DataFrame] = cut) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows and wide content (one row per key) with a part number, and the columns to join them on.

    No more than about `part` rows of a key have the same number; the key's content is repeated for each of its numbers.
    """
    number = f"{key}_part"
    sizes = keep(rows.groupBy(key).agg(F.count("*").alias("_size")).withColumn("_parts", F.ceil(F.col("_size") / part)))
    dealt = join_groups(rows, sizes, key, "_size", keep=lambda df: df).withColumn(number, F.pmod(F.xxhash64(*rows.columns), F.col("_parts"))).drop("_size", "_parts")
    copies = wide.join(sizes, key).withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_size", "_parts")
    return dealt, copies, [key, number]


def mark(text: str) -> Column:
    """A hash of the text that, beside the identifier, tells rows apart."""
    return F.xxhash64(text_or_empty(text), F.col(text).isNull())


def take_rows(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that stay, with all their columns; `rows` has id, mark(text) and stays of every row.

    Rows with the same identifier (or none) and the same text can't be told apart: one of them stays if any does.
    """
    whole = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), F.col(f"`{id_col}`").alias("id"), mark(f"`{text_col}`").alias("mark")
    )
    kept = cut(rows.groupBy("id", "mark").agg(F.max("stays").alias("stays"), F.count("*").alias("n")).where("stays"))

    def pick(which: DataFrame) -> DataFrame:
        other = which.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"))
        return whole.join(other, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left_semi")

    repeated = kept.where("n > 1")
    if repeated.isEmpty():
        return pick(kept).select("whole.*")
    once = pick(repeated).groupBy("id", "mark").agg(F.any_value("whole").alias("whole"))
    return pick(kept.where("n = 1")).select("whole.*").unionByName(once.select("whole.*"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow string array; nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `limit` bytes of text; a longer single text goes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at, _ = text_buffers(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift-multiply rounds) over an unsigned array."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
