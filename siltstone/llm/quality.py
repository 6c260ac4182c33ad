"""Quality by hierarchical empirical Bayes: a document's own evidence combined with posteriors of its site.

A logistic regression (numpy, fitted on a bounded sample of labelled rows) over the make-up of the text gives each
document's evidence, the probability of good quality. Evidence is summed by path and host in grouped aggregates. The
spread of the hosts' means around the global mean, less what sampling explains, gives the strength of the global prior
by the method of moments, and likewise of the paths around their hosts. A host's posterior mean is shrunk toward the
global one, a path's toward its host's; sparse sites stay near their prior. A prior is worth within / between documents, where
`between` is taken as a thousandth of `within` at least, so 1,000 documents at most. The score moves the document's log-odds by
those of its path against the global ones; the document's own evidence is left out of its path and host there, or it would count twice,
and the only document of its site is moved by the global prior alone, that is not at all. Unless told otherwise the columns `source` and `lang` stand in for host and path,
since `documents` has no URL.

Defined results: null and empty texts have no make-up (all zeros) and are scored like others; null hosts or paths form
one site; without labels of both kinds the evidence is 0.5; an empty table gives no rows; repeated rows are each scored and
counted; texts are taken whole, however long, some at a time; extra columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

N_FEATURES = 10


def _kinds() -> np.ndarray:
    """The kind of each byte: lower case, upper case, digit, blank, line end, sentence mark, other mark, high byte."""
    kinds = np.full(256, 6, np.int64)
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:'\"()-?")):
        kinds[[ord(c) for c in chars]] = k
    kinds[128:] = 7
    return kinds


def features(offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The make-up of each text of a buffer: shares of kinds of bytes, distinct words, and the length."""
    n = len(offsets) - 1
    out = np.zeros((n, N_FEATURES))
    kinds = _kinds()[raw]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    out[:, :8] = np.bincount(owner * 8 + kinds, minlength=n * 8).reshape(n, 8) / np.maximum(np.diff(offsets), 1)[:, None]
    data = raw.tobytes()
    for k in range(n):
        words = data[offsets[k] : offsets[k + 1]].split()
        out[k, 8] = len(set(words)) / len(words) ** 0.9 if words else 0
    out[:, 9] = np.log1p(np.diff(offsets))
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Logistic regression on features and their squares by Newton's method: rows mean, scale, weights."""
    wide = np.hstack([x, x**2])
    mean, scale = wide.mean(0), wide.std(0) + 1e-9
    a = np.hstack([np.ones((len(x), 1)), (wide - mean) / scale])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) / len(y) + ridge * w
        hess = (a * (p * (1 - p))[:, None]).T @ a / len(y) + (ridge + 1e-6) * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return np.array([np.append(0, mean), np.append(1, scale), w])


def predict(model: np.ndarray, x: np.ndarray) -> np.ndarray:
    mean, scale, w = model
    z = np.hstack([x, x**2])
    return 1 / (1 + np.exp(-np.clip(w[0] + ((z - mean[1:]) / scale[1:]) @ w[1:], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 4000) -> np.ndarray | None:
    """A model from at most `per_class` labelled rows of each kind; None where one kind is missing."""
    known = common.own_columns(labels, id=id_col, label=label_col).where("label is not null and id is not null")
    known = known.where(usable) if usable is not None else known
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    order = F.xxhash64(F.col("id"))
    chosen = known.where("label = 1").orderBy(order, "id").limit(per_class).unionByName(known.where("label = 0").orderBy(order, "id").limit(per_class))
    texts = common.own_columns(docs, id=id_col, text=text_col).join(F.broadcast(chosen), "id")  # at most 2 * per_class rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            x = features(*common.text_buffers(batch.column("text")))
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, N_FEATURES, dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), lists], ["id", "label", "x"])

    kind = texts.schema["id"].dataType.simpleString()
    rows = texts.select("id", F.col("label").cast("int").alias("label"), "text").mapInArrow(run, f"id {kind}, label int, x array<double>").orderBy("id").collect()
    y = np.array([r["label"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    return fit(np.array([r["x"] for r in rows]), y)


def evidence(docs: DataFrame, model: np.ndarray | None, id_col: str, text_col: str, host: Column, path: Column) -> DataFrame:
    """id, host, path, p of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            x = features(*common.text_buffers(batch.column("text")))
            p = predict(model, x) if model is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), batch.column("path"), pa.array(p)], ["id", "host", "path", "p"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, host string, path string, p double")


def _strength(sites: DataFrame, mean: Column) -> DataFrame:
    """One row: how many documents the prior is worth, from the spread of site means beyond that of sampling.

    Of N documents in a site with spread v between sites, the mean varies by v + m(1 - m) / N around m.
    """
    between = F.avg((F.col("s") / F.col("n") - mean) ** 2) - F.avg(mean * (1 - mean) / F.col("n"))
    within = F.avg(mean * (1 - mean))
    return sites.agg((within / F.greatest(between, within * 1e-3)).alias("strength"))


def score(docs: DataFrame, model: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, score, keep (score >= threshold) of every row."""
    host, path = (F.col("source") if host is None else host), (F.col("lang") if path is None else path)
    rows = common.cut(evidence(docs, model, id_col, text_col, host, path).withColumn("site", F.sha2(F.concat_ws("\x1f", "host", "path"), 256)))
    paths = common.cut(rows.groupBy("site", "host").agg(F.sum("p").alias("s"), F.count("*").alias("n")))
    hosts = common.cut(paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
    total = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = min(max((total["s"] or 0) / max(total["n"] or 0, 1), 1e-6), 1 - 1e-6)
    shrunk = lambda prior, strength: (F.col("s") + prior * strength) / (F.col("n") + strength)
    strength = _strength(hosts, F.lit(mean)).first()["strength"] or 1.0
    hosts = hosts.select("host", F.col("s").alias("host_s"), F.col("n").alias("host_n"), shrunk(F.lit(mean), strength).alias("host_posterior"))
    # one row a path; a host with very many paths is no larger than its rows, and AQE splits such a join
    paths = common.cut(paths.join(hosts, "host"))
    path_strength = _strength(paths, F.col("host_posterior")).first()["strength"] or 1.0
    paths = paths.select("site", "s", "n", "host_s", "host_n", "host_posterior", shrunk(F.col("host_posterior"), path_strength).alias("path_posterior"))
    logit = lambda p: F.log(p / (1 - p))
    clip = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    joined = common.join_groups(rows.select("id", "site", "p"), paths, "site", "n")
    others = (F.col("host_s") - F.col("p") + mean * strength) / (F.col("host_n") - 1 + strength)
    others = (F.col("s") - F.col("p") + others * path_strength) / (F.col("n") - 1 + path_strength)
    odds = logit(clip(F.col("p"))) + logit(clip(others)) - float(np.log(mean / (1 - mean)))
    return joined.select(F.col("id").alias(id_col), F.col("p").alias("evidence"), "host_posterior", "path_posterior", (1 / (1 + F.exp(-odds))).alias("score")).withColumn("keep", F.col("score") >= threshold)
