"""Toxicity: non-negative positive-unlabelled learning over words and word beginnings.

Confirmed toxic documents are the positives; the unlabelled text is a sample of all documents of the training fold,
whatever is known of them, so it holds toxic ones too. With the class prior p (the positives' share of the labelled
training rows) the risk of the negatives is estimated as
R_u(-) - p * R_p(-), which a flexible model can push below zero by overfitting; where a mini-batch's estimate falls
below zero, the step goes against it instead. The model is a linear one over the presence of features, trained with
numpy on the driver from a bounded sample, and sent to the executors as a bounded table of weights.

Features are lower-case words and their first 4 to 6 letters. Their document counts in the sample are aggregated by
Spark, and the `features` most telling ones are kept.

Defined results: a null or empty text has no features and gets the score of the bias alone; without any positive or
unlabelled example all scores are 0. Documents with several label rows count as toxic if any says so; repeated rows are each
scored; an empty table gives no rows; texts are scored whole, however long, some at a time; extra columns play no part in
a score, and `filter_clean` keeps them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = range(4, 7)


def features(text: str) -> set[str]:
    """Words (marked by a closing blank) and word beginnings of a text."""
    words = set(WORD.findall(text.lower()))
    found = {w + " " for w in words}
    for k in PREFIXES:
        found |= {w[:k] for w in words}
    return found


@dataclass
class Model:
    """Weights by feature, and the bias."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -np.inf

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        whole = {k[:-1] for k in self.weights if k[-1] == " "}
        starts = [(k, {w for w in self.weights if len(w) == k and w[-1] != " "}) for k in PREFIXES]
        weights, out = self.weights, np.full(len(texts), self.bias)
        for i, text in enumerate(texts):
            if text:
                words = set(WORD.findall(text.lower()))
                total = sum(weights[w + " "] for w in words & whole)
                for k, known in starts:
                    total += sum(weights[w] for w in {w[:k] for w in words} & known)
                out[i] += total
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-out))


def risk(f: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The two parts of the risk under the logistic loss, that of positives and the corrected one of negatives, and their slopes by f."""
    n_pos, n_unl = max(1, positive.sum()), max(1, (~positive).sum())
    sigma = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
    loss_neg = np.logaddexp(0, f)
    on_positive = prior * np.logaddexp(0, -f)[positive].sum() / n_pos
    on_negative = loss_neg[~positive].sum() / n_unl - prior * loss_neg[positive].sum() / n_pos
    by_positive = np.where(positive, prior * (sigma - 1) / n_pos, 0.0)
    by_negative = np.where(positive, -prior * sigma / n_pos, sigma / n_unl)
    return float(on_positive), float(on_negative), by_positive, by_negative


def fit(rows: list[np.ndarray], positive: np.ndarray, size: int, prior: float, steps: int = 600, rate: float = 0.05, sparsity: float = 0.02) -> tuple[np.ndarray, float]:
    """(weights, bias) of the linear model by non-negative PU learning with the logistic loss and Adam; `sparsity` shrinks the weights.

    rows: feature numbers of each example; positive: which examples are confirmed, all others being unlabelled.
    """
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, b = np.zeros(size), np.log(prior / (1 - prior))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        f = np.bincount(owner, w[flat], len(rows)) + b
        _, negative_part, by_positive, by_negative = risk(f, positive, prior)
        # where the negatives' risk is below zero, the step goes against it
        by_f = by_positive + by_negative if negative_part >= 0 else -by_negative
        grad = np.append(np.bincount(flat, by_f[owner], size), by_f.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparsity, 0)
    return w, float(b)


def held_out(id_col: str = "doc_id") -> Column:
    """Is crc32 of the identifier as text, mod 3, equal to 1? Such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 4000, most_features: int = 6000, least_ratio: float = 6.0, least_gain: float = 8.0) -> Model:
    """A model from at most `per_class` positive and 2 * `per_class` unlabelled texts of the training fold."""
    known = common.own_columns(labels, id=id_col, label=label_col).where(F.col("label").isNotNull() & ~held_out("id"))
    known = known.groupBy("id").agg((F.max("label") == 1).alias("positive"))
    counts = {r["positive"]: r["count"] for r in known.groupBy("positive").count().collect()}
    if len(counts) < 2:
        return Model()
    prior = counts[True] / sum(counts.values())
    rows = common.own_columns(docs, id=id_col, text=text_col)
    order = F.xxhash64(F.col("id"))
    confirmed = known.where("positive").orderBy(order, "id").limit(per_class).select("id", F.lit(True).alias("positive"))
    other = rows.where(~held_out("id")).select("id").orderBy(order, "id").limit(2 * per_class).withColumn("positive", F.lit(False))
    texts = rows.join(F.broadcast(confirmed.unionByName(other)), "id")  # the broadcast side has at most 3 * per_class rows

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            counts = [Counter(), Counter()]
            for text, label in zip(batch["text"].to_pylist(), batch["positive"].to_pylist(), strict=True):
                counts[label].update(features(text))
            names = list({*counts[0], *counts[1]})
            for at in range(0, len(names), 50_000):
                part = names[at : at + 50_000]
                sums = ([c[x] for x in part] for c in counts)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array(x, pa.int64()) for x in sums)], ["feature", "unl", "pos"])

    sampled = common.cut(texts.select("id", "positive", common.text_or_empty().alias("text")))
    n = {r["positive"]: r["count"] for r in sampled.groupBy("positive").count().collect()}
    if len(n) < 2:
        return Model()
    sums = sampled.mapInArrow(seen, "feature string, unl long, pos long").groupBy("feature").agg(F.sum("unl").alias("unl"), F.sum("pos").alias("pos"))
    share_pos = (F.col("pos") + 0.5) / n[True]
    # of the unlabelled documents with the feature, those that the positives do not account for
    negatives = F.greatest(F.col("unl") - prior * n[False] / n[True] * F.col("pos"), F.lit(0.0))
    ratio = share_pos / ((negatives + 0.5) / (n[False] * (1 - prior)))
    telling = sums.where(F.col("pos") >= 3).select("feature", ratio.alias("ratio"), (F.col("pos") * F.log(ratio)).alias("gain"))
    telling = telling.where((F.col("ratio") > least_ratio) & (F.col("gain") >= least_gain))
    names = [r["feature"] for r in telling.orderBy(F.desc("gain"), "feature").limit(most_features).collect()]
    number = {x: i for i, x in enumerate(names)}

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sorted(number[x] for x in features(text or "") if x in number) for text in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "positive": batch["positive"], "found": found})

    kind = sampled.schema["id"].dataType.simpleString()
    found = sampled.mapInPandas(numbered, f"id {kind}, positive boolean, found array<int>").orderBy("id", "positive").collect()
    positive = np.array([r["positive"] for r in found])
    w, b = fit([np.array(r["found"], np.int64) for r in found], positive, len(names), prior)
    return Model({x: float(w[i]) for x, i in number.items() if w[i]}, b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from the threshold on) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sent.value.score(batch.column("text").to_pylist()))], ["id", "score"])

    rows = common.own_columns(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def filter_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows that score below the threshold, with all their columns; the text is scored where it lies, without a join."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text_col):
            keep = sent.value.score(batch.column(text_col).to_pylist()) < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
