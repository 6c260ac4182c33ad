"""Classes of local structure by common neighbours, with a cutoff of its own for each site."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Between the first and the second shell of a close packing; the first shell of bcc on the scale of its second.
MIDDLE, BCC_SCALE = (1 + np.sqrt(2)) / 2, 2 / np.sqrt(3)
CLOSE, BCC = 12, 14


def _signatures(at: np.ndarray, cutoff: np.ndarray) -> np.ndarray:
    """(common neighbours, bonds among them, bonds in the largest cluster of these) of each neighbour of each site.

    `at` holds the neighbours' places around their site; sites, neighbours and coordinates are its axes.
    """
    n = at.shape[1]
    apart = ((at[:, :, None] - at[:, None]) ** 2).sum(3)
    bonded = (apart <= cutoff[:, None, None] ** 2) & ~np.eye(n, dtype=bool)
    among = bonded[:, None] & bonded[:, :, :, None] & bonded[:, :, None, :]  # site, neighbour, two of its common neighbours
    reached = among | np.eye(n, dtype=bool)
    for _ in range(int(n).bit_length()):
        reached = (reached.astype(np.float32) @ reached.astype(np.float32)) > 0
    degree = among.sum(3)
    cluster = (reached * degree[:, :, None, :]).sum(3)  # twice the bonds of each one's cluster
    return np.stack([bonded.sum(2), degree.sum(2) // 2, cluster.max(2) // 2], 2)


def _count(signatures: np.ndarray, wanted: tuple[int, int, int]) -> np.ndarray:
    return (signatures == wanted).all(2).sum(1)


def classify_close(at: np.ndarray, cutoff: np.ndarray) -> np.ndarray:
    """fcc, hcp, ico or other, from twelve neighbours."""
    s = _signatures(at, cutoff)
    a, b, c = _count(s, (4, 2, 1)), _count(s, (4, 2, 2)), _count(s, (5, 5, 5))
    return np.select([a == 12, (a == 6) & (b == 6), c == 12], ["fcc", "hcp", "ico"], "other")


def classify_bcc(at: np.ndarray, cutoff: np.ndarray) -> np.ndarray:
    """bcc or other, from fourteen neighbours."""
    s = _signatures(at, cutoff)
    return np.where((_count(s, (6, 6, 6)) == 8) & (_count(s, (4, 4, 4)) == 6), "bcc", "other")


def local_structure(pairs: DataFrame, sites: DataFrame) -> DataFrame:
    """group, site, neighbours (within the pairs, 14 at most are used), structure (fcc, hcp, ico, bcc or other) of every site.

    `pairs` has group, site, other, distance, dx, dy, dz and has to reach the second shell. The cutoff of a site is halfway
    between shells by the mean distance of its own twelve (or, scaled, fourteen) nearest neighbours, so neither a lattice constant
    nor even strain matters. Of neighbours at one distance the smaller identifier is nearer. Only the nearest 14 pairs
    of a site leave a task, so sites with very many neighbours are no burden.
    """
    by = ["group", "site"]
    nearest = Window.partitionBy(*by).orderBy("distance", "other", "dx", "dy", "dz")
    counted = pairs.where("distance > 0")
    near = counted.withColumn("k", F.row_number().over(nearest)).where(F.col("k") <= BCC)
    lists = near.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("k", "distance", "dx", "dy", "dz"))).alias("to"))
    every = sites.select(*by).distinct().join(lists, by, "left")
    kinds = dict(sites.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = np.array([0 if t is None else len(t) for t in pdf["to"]])
            kind = np.full(len(n), "other", dtype=object)
            for first in range(0, len(n), 512):
                rows = np.arange(first, min(first + 512, len(n)))
                for least, classify in ((CLOSE, classify_close), (BCC, classify_bcc)):
                    some = rows[(n[rows] >= least) & (kind[rows] == "other")]
                    if len(some):
                        table = np.array([[(t["distance"], t["dx"], t["dy"], t["dz"]) for t in pdf["to"].iloc[i][:least]] for i in some])
                        far = table[:, :, 0] * (np.where(np.arange(least) < 8, BCC_SCALE, 1.0) if least == BCC else 1.0)
                        kind[some] = classify(table[:, :, 1:], far.mean(1) * MIDDLE)
            yield pd.DataFrame({"group": pdf["group"], "site": pdf["site"], "neighbours": n, "structure": kind})

    return every.mapInPandas(run, f"group {kinds['group']}, site {kinds['site']}, neighbours int, structure string")
