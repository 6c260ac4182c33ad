"""Exact deduplication by a stateful stream.

Every text becomes a narrow fingerprint row: digest, stable identifier, length and locator. The rows of a run are written
to the shared folder and read as a stream. Its keyed state (one entry a digest, in RocksDB on disk, checkpointed, never
expiring) retains digest, identifier and content locator of the row that stays, and the number of rows. Later runs on the
same state folder go on from there, so a corpus can arrive in pieces; a run returns the decisions about its own rows.

The full normalised bytes are compared by digest: the least and the greatest bytes of a digest are aggregated, combined
before the shuffle, so a digest with very many rows meets in no single task, and rows are never joined by identifier. With a
kept folder the content of every digest is stored once, by the run that met it first, and takes part in later checks.
Texts that differ under one digest (a collision) are grouped by their bytes.

A run on a kept folder is marked when its rows have arrived and when its decisions stand. A run that broke off in between is
taken up by the next call, which has to bring the same rows: they keep their number and are not counted again. Other rows are refused
until then.

Texts are equal when identical after deleting blanks and the characters U+0009 to U+000D. Of equal texts the row with
the most code points stays, then the smallest identifier, then the earliest run and any one row of it.

Defined results: a null text counts as empty, and all empty texts are equal; an empty table gives no rows. Identifiers are
integers or of any type that has an order; a null one stays only where its group has no other. Rows that share an identifier are rows of their own, each with
its own text's group; of repeated rows, with an identifier or without, one stays. Very long texts are hashed and
compared whole. Extra columns are kept and can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import IntegralType

from . import common

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, mark (hash of the text as it is), digest, chars, bytes (normalised) of every row."""
    rows = common.own_columns(docs, id=id_col, text=text_col)
    whole = isinstance(rows.schema["id"].dataType, IntegralType)
    return rows.select(
        (F.col("id").cast("long") if whole else F.col("id")).alias("id"),
        common.mark("text").alias("mark"),
        F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("digest"),
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("chars"),
        normalised(F.col("text")).alias("bytes"),
    )


def _best(*more: str) -> Column:
    """Of the rows, the one that stays: most characters, smallest identifier (null last), then the least of what follows."""
    return F.min(F.struct((-F.col("chars")).alias("order"), F.col("id").isNull().alias("nameless"), "id", *more)).alias("best")


class Deduplicator:
    """The keyed state under one folder of the shared storage; `add` takes more rows, `groups` reads the state."""

    def __init__(self, spark: SparkSession, folder: str | None = None, id_type: str = "bigint"):
        self.spark, self.folder = spark, folder or common.scratch(spark, "dedup")
        self.rows = f"id {id_type}, mark long, digest string, chars long, row long, run int"
        self.states = f"digest string, keep_id {id_type}, keep_run int, keep_row long, n long, batch int"

    def add(self, prints: DataFrame, files_a_batch: int = 10_000, finish: bool = True) -> int:
        """Run the stream over rows of fingerprints(); returns the number of the run, which `finish` (or a later call) ends."""
        run = 0
        while common.exists(self.spark, f"{self.folder}/done/{run}"):
            run += 1
        if not common.exists(self.spark, f"{self.folder}/whole/{run}"):
            numbered = prints.select("id", "mark", "digest", "chars", F.monotonically_increasing_id().alias("row"))
            numbered.write.mode("overwrite").parquet(f"{self.folder}/arrived/run={run}")  # the stream has not seen what may lie there
            common.touch(self.spark, f"{self.folder}/whole/{run}")
        elif _sum(self.arrived().where(F.col("run") == run)) != _sum(prints):
            raise ValueError(f"run {run} on {self.folder} did not finish; it has to be repeated with its own rows")
        self._stream(files_a_batch)
        if finish:
            self.finish(run)
        return run

    def finish(self, run: int) -> None:
        """The decisions of the run stand."""
        common.touch(self.spark, f"{self.folder}/done/{run}")

    def _stream(self, files_a_batch: int) -> None:
        session = self.spark.newSession()
        session.conf.set("spark.sql.shuffle.partitions", self.spark.conf.get("spark.sql.shuffle.partitions"))
        session.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        # many small stores: don't reserve some MB of disk for the logs of each
        session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
        arrived = session.readStream.schema(self.rows).option("maxFilesPerTrigger", files_a_batch).parquet(f"{self.folder}/arrived")
        # no watermark: the state of a digest is kept for good; run and row are the locator of the content
        state = arrived.groupBy("digest").agg(_best("run", "row"), F.count("*").alias("n"))
        changes = f"{self.folder}/changes"

        def keep(rows: DataFrame, batch: int) -> None:
            # a batch that is run again after a failure writes the same folder again
            located = rows.select("digest", F.col("best.id").alias("keep_id"), F.col("best.run").alias("keep_run"), F.col("best.row").alias("keep_row"), "n")
            located.write.mode("overwrite").parquet(f"{changes}/batch={batch}")

        query = (
            state.writeStream.outputMode("update")
            .foreachBatch(keep)
            .option("checkpointLocation", f"{self.folder}/state")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def arrived(self) -> DataFrame:
        """The fingerprints of all runs."""
        return self.spark.read.schema(self.rows).parquet(f"{self.folder}/arrived")

    def groups(self) -> DataFrame:
        """digest, keep_id, keep_run, keep_row, n: the newest state of every digest."""
        changes = self.spark.read.schema(self.states).parquet(f"{self.folder}/changes")
        newest = F.max_by(F.struct("keep_id", "keep_run", "keep_row", "n"), "batch").alias("newest")
        return changes.groupBy("digest").agg(newest).select("digest", "newest.*")

    def contents(self, run: int) -> DataFrame | None:
        """digest, bytes that the runs before this one have stored; None for the first."""
        stored = self.spark.read.schema("digest string, bytes string, run int")
        return stored.parquet(f"{self.folder}/content").where(F.col("run") < run).drop("run") if run else None

    def store(self, prints: DataFrame, run: int) -> None:
        """Store the content of the digests that no run before has met."""
        new = prints.groupBy("digest").agg(F.min("bytes").alias("bytes"))
        known = self.contents(run)
        new = new if known is None else new.join(known.select("digest"), "digest", "left_anti")
        new.write.mode("overwrite").parquet(f"{self.folder}/content/run={run}")


def _sum(prints: DataFrame) -> tuple:
    """A digest of the rows in any order."""
    row = F.xxhash64("id", "mark", "digest", "chars")
    return tuple(prints.agg(F.count("*"), F.bit_xor(row), F.sum(row.cast("decimal(38, 0)"))).first())


def _decided(docs: DataFrame, id_col: str, text_col: str, folder: str | None) -> DataFrame:
    """id, mark, keep_id, n, stays, digest of every row of docs, cut from its lineage."""
    prints = fingerprints(docs, id_col, text_col)
    tool = Deduplicator(docs.sparkSession, folder, prints.schema["id"].dataType.simpleString())
    run = tool.add(prints, finish=False)
    rows = tool.arrived().where(F.col("run") == run)
    groups = tool.groups()
    if run:
        groups = groups.join(rows.select("digest").distinct(), "digest", "left_semi")
    stays = (F.col("run") == F.col("keep_run")) & (F.col("row") == F.col("keep_row"))
    plain = common.cut(common.join_groups(rows, groups, "digest", "n").select("id", "mark", "keep_id", "n", stays.alias("stays"), "digest"))
    odd = common.cut(_collisions(prints, tool.contents(run)))
    if not odd.isEmpty():
        plain = plain.join(odd, "digest", "left_anti").unionByName(_by_bytes(prints, tool, odd, run))
        plain = common.cut(plain)
    if folder is None:
        common.discard(tool.spark, tool.folder)
    else:
        tool.store(prints, run)
        tool.finish(run)
    return plain


def _collisions(prints: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Digests of which the rows' full normalised bytes, those stored by earlier runs included, are not all the same."""
    ends = prints.groupBy("digest").agg(F.min("bytes").alias("least"), F.max("bytes").alias("most"))
    if stored is not None:
        before = stored.groupBy("digest").agg(F.min("bytes").alias("before"))
        ends = ends.join(before, "digest", "left")
        ends = ends.withColumn("least", F.least("least", "before")).withColumn("most", F.greatest("most", "before"))
    return ends.where("least <> most").select("digest")


def _by_bytes(prints: DataFrame, tool: Deduplicator, odd: DataFrame, run: int) -> DataFrame:
    """The rows of this run whose digest is that of several texts, grouped by their bytes.

    Rows of earlier runs count to the content that was stored for their digest.
    """
    bad = prints.join(odd, "digest", "left_semi").select("id", "mark", "digest", "chars", "bytes", F.lit(run).alias("run"))
    met, stored = bad, tool.contents(run)
    if stored is not None:
        before = tool.arrived().where(F.col("run") < run).join(odd, "digest", "left_semi").join(stored, "digest")
        met = bad.unionByName(before.select("id", "mark", "digest", "chars", "bytes", "run"))
    regrouped = met.groupBy("digest", "bytes").agg(_best("run", "mark"), F.count("*").alias("n"))
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("mark") == F.col("best.mark")) & (F.col("run") == F.col("best.run"))
    return bad.join(regrouped, ["digest", "bytes"]).select("id", "mark", F.col("best.id").alias("keep_id"), "n", stays.alias("stays"), "digest")


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; with a kept folder, groups count the rows of earlier runs too."""
    return _decided(docs, id_col, text_col, folder).select(
        F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), F.col("stays").alias("kept"), F.col("digest").alias("text_sha256")
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """The rows that stay, with all their columns."""
    return common.take_rows(docs, _decided(docs, id_col, text_col, folder), id_col, text_col)
