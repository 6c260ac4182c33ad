"""Isosurfaces of scalar grids (i, j, k, value): vertices on grid edges, triangles in cells.

The cells of a grid are dealt as blocks, each with the points of a layer around it, so that a grid of any size lies in many tasks and a
task holds one block. A vertex lies where an edge of the grid crosses the level, and is known by that edge, so blocks agree
about the vertices on their seams and no pass over all of them is needed: the block that owns an edge gives its vertex, and triangles
name three edges.

A cell's triangles follow from which of its corners lie below the level. On each face, a segment leads around every run of corners
that are below; the segments close to loops around the cell, and each loop is cut into triangles. Corners that are below and
only touch by a face's diagonal are kept apart; as this depends on the face alone, cells on both sides of it agree.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Corner c of a cell lies at (c & 1, c >> 1 & 1, c >> 2 & 1); an edge is (axis, its corner nearest the origin).
CORNERS = np.array([(c & 1, c >> 1 & 1, c >> 2 & 1) for c in range(8)])
EDGES = [(axis, c) for axis in range(3) for c in range(8) if not c >> axis & 1]


def _faces() -> list[list[int]]:
    """The corners of each face, counter-clockwise seen from outside."""
    out = []
    for axis, side in itertools.product(range(3), range(2)):
        u, v = 1 << (axis + 1) % 3, 1 << (axis + 2) % 3
        ring = [side << axis, side << axis | u, side << axis | u | v, side << axis | v]
        out.append(ring if side else ring[::-1])
    return out


def _edge_between(a: int, b: int) -> int:
    return EDGES.index(((a ^ b).bit_length() - 1, min(a, b)))


@functools.cache
def cell_triangles() -> list[list[tuple[int, int, int]]]:
    """For each set of corners below the level, the triangles of the cell as triples of edges; their normals point upwards in value."""
    faces = _faces()
    on_face = [{_edge_between(f[k], f[k - 1]) for k in range(4)} for f in faces]
    table = []
    for case in range(256):
        below = [case >> c & 1 for c in range(8)]
        after = {}
        for face in faces:
            for k in range(4):
                if below[face[k]] and not below[face[k - 1]]:  # a run begins here; its end is the next corner that is not below
                    end = next(e for e in range(k, k + 4) if not below[face[(e + 1) % 4]])
                    after[_edge_between(face[k - 1], face[k])] = _edge_between(face[end % 4], face[(end + 1) % 4])
        found = []
        while after:
            loop = [next(iter(after))]
            while (e := after.pop(loop[-1])) != loop[0]:
                loop.append(e)
            # fans without a diagonal in a face, which the cell beyond that face might use too
            turns = [loop[k:] + loop[:k] for k in range(len(loop))]
            loop = min(turns, key=lambda t: sum({t[0], x} <= f for x in t[2:-1] for f in on_face))
            found += [(loop[0], x, y) for x, y in itertools.pairwise(loop[1:])]
        table.append(found)
    return table


class Grid:
    """The shape of a grid: points along each axis, cells, blocks."""

    def __init__(self, dims: tuple[int, int, int], block: int, periodic: bool):
        self.dims, self.block, self.periodic = dims, block, periodic
        self.cells = tuple(n if periodic else n - 1 for n in dims)
        self.blocks = tuple(max(0, -(-c // block)) for c in self.cells)

    def places(self, axis: int, point: Column) -> Column:
        """The blocks that need a point, and where it lies for them: beyond the ends of the axis too if the grid is periodic."""
        n, b, last = self.dims[axis], self.block, self.blocks[axis] - 1

        def found(at: Column) -> Column:
            low = F.greatest(F.lit(0).cast("long"), F.ceil((at - 1) / F.lit(b)) - 1)
            high = F.least(F.lit(last).cast("long"), F.floor((at + 1) / F.lit(b)))
            there = F.transform(F.sequence(low, high), lambda g: F.struct(g.alias("g"), at.cast("long").alias("at")))
            return F.when(low <= high, there).otherwise(F.array().cast("array<struct<g: bigint, at: bigint>>"))

        return F.concat(*map(found, [point - n, point, point + n] if self.periodic else [point]))

    def edge_ids(self, axis: np.ndarray, at: np.ndarray) -> np.ndarray:
        i, j, k = np.moveaxis(at, -1, 0)
        return ((i * (self.dims[1] + 1) + j) * (self.dims[2] + 1) + k) * 3 + axis


def _gradients(values: np.ndarray, at: np.ndarray, low: np.ndarray, grid: Grid) -> np.ndarray:
    """Differences along each axis in fractional units, downwards; one-sided at open ends. `low` is where the values begin."""
    out = np.empty(at.shape)
    for axis, n in enumerate(grid.dims):
        step = np.eye(3, dtype=int)[axis]
        back = at - step if grid.periodic else np.maximum(at - step, 0)
        ahead = at + step if grid.periodic else np.minimum(at + step, n - 1)
        with np.errstate(invalid="ignore"):
            out[:, axis] = (values[tuple((back - low).T)] - values[tuple((ahead - low).T)]) / (ahead - back)[:, axis] * grid.cells[axis]
    return out


def _block(values: np.ndarray, low: np.ndarray, first: np.ndarray, last: np.ndarray, level: float, grid: Grid, lattice: np.ndarray, centred: bool) -> tuple[np.ndarray, ...]:
    """(edges, positions, normals, which the block owns, triangles as places in edges, cell of each triangle) of the cells from first to before last."""
    inside = values < level
    cells = tuple(last - first)
    case = np.zeros(cells, np.int64)
    start = first - low
    for c, d in enumerate(CORNERS):
        case |= inside[tuple(slice(s + o, s + o + n) for s, o, n in zip(start, d, cells, strict=True))].astype(np.int64) << c
    table = cell_triangles()
    count = np.array([len(t) for t in table])
    flat = np.array([t for part in table for t in part])
    where = np.argwhere(count[case] > 0)
    kind = case[tuple(where.T)]
    n = count[kind]
    which = np.repeat((np.cumsum(count) - count)[kind] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    corners = flat[which]  # triangles by edges of their cell
    axis = np.array([a for a, _ in EDGES])[corners]
    at = (np.repeat(where, n, 0) + first)[:, None] + CORNERS[[c for _, c in EDGES]][corners]
    ids, place, back = np.unique(grid.edge_ids(axis, at).ravel(), return_index=True, return_inverse=True)
    axis, at = axis.ravel()[place], at.reshape(-1, 3)[place]
    to = at + np.eye(3, dtype=int)[axis]
    a, b = values[tuple((at - low).T)], values[tuple((to - low).T)]
    with np.errstate(invalid="ignore", divide="ignore"):
        share = np.where(np.isinf(a), 1.0, np.where(np.isinf(b) | (np.abs(b - a) < 1e-10), 0.0, (level - a) / (b - a)))
    spot = (at + share[:, None] * (to - at)) / np.array(grid.cells) - (0.5 if centred else 0.0)
    slope = _gradients(values, at, low, grid)
    with np.errstate(invalid="ignore"):
        slope = slope + share[:, None] * (_gradients(values, to, low, grid) - slope)
    normal = slope @ np.linalg.inv(lattice).T
    size = np.linalg.norm(normal, axis=1, keepdims=True)
    flat_there = ~(np.isfinite(size) & (size > 1e-10))
    normal = np.where(flat_there, [0.0, 0.0, 1.0], normal / np.where(flat_there, 1.0, size))
    cell = np.minimum(at, np.array(grid.cells) - 1)  # the cell that owns the edge
    owned = ((cell >= first) & (cell < last)).all(1)
    own = (np.repeat(where, n, 0) + first) @ [grid.cells[1] * grid.cells[2], grid.cells[2], 1]
    return ids, spot @ lattice, normal, owned, back.reshape(-1, 3), own


def isosurface(grid: DataFrame, key: str, dims: tuple[int, int, int], level: Column | float, lattice: tuple | None = None, periodic: bool = True, centred: bool = True, block: int = 32) -> DataFrame:
    """key, edge, x, y, z, nx, ny, nz, cell, corners, area, volume of every vertex and triangle of the surfaces of all grids.

    A vertex has `edge` (its grid edge, three numbers an axis in one), its place and a normal that points downwards in value; a triangle
    has its cell (numbered along the last axis first), `corners` (three edges), its area and the signed volume between it and the origin, which sum to the volume below the level where
    the surface is closed. `lattice` has the three axes as rows (a unit cube by default). Periodic grids reach around to their
    first layer, and stay unwrapped there, so the surface ends at the sides of the cell; others end at their last points.

    Missing, null and NaN values are above any level, and vertices beside them lie at the known point. Points beyond dims
    are left out; of repeated points the lowest value counts. Grids with fewer than two points along an axis have no surface.
    """
    shape, cell = Grid(dims, block, periodic), np.array(lattice if lattice is not None else np.eye(3), float)
    kind = grid.schema[key].dataType.simpleString()
    form = f"{key} {kind}, edge long, x double, y double, z double, nx double, ny double, nz double, cell long, corners array<long>, area double, volume double"
    rows = grid.select(F.col(key).alias("key"), *(F.col(c).cast("long").alias(c) for c in "ijk"), F.col("value").cast("double").alias("value"), (level if isinstance(level, Column) else F.lit(float(level))).cast("double").alias("level"))
    if min(dims) < 2:
        rows = rows.limit(0)
    for axis, c in enumerate("ijk"):
        rows = rows.where(F.col(c).between(0, dims[axis] - 1)).withColumn(c, F.explode(shape.places(axis, F.col(c))))
    dealt = rows.select("key", "value", "level", *(F.col(f"{c}.g").alias(f"g{c}") for c in "ijk"), *(F.col(f"{c}.at").alias(c) for c in "ijk"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf[["gi", "gj", "gk"]].iloc[0].to_numpy() * block
        last = np.minimum(first + block, shape.cells)
        low = first - 1
        values = np.full(tuple(last - first + 3), np.inf)
        at = pdf[["i", "j", "k"]].to_numpy() - low
        known = pdf["value"].notna().to_numpy() & (at < values.shape).all(1)
        np.minimum.at(values, tuple(at[known].T), pdf["value"].to_numpy()[known])
        level, none = pdf["level"].iloc[0], pd.DataFrame(columns=[n.split()[0] for n in form.split(", ")])
        if pd.isna(level) or not (values < level).any():
            return none
        edges, spot, normal, owned, triangles, cells = _block(values, low, first, last, level, shape, cell, centred)
        p, q, r = (spot[triangles[:, k]] for k in range(3))
        across = np.cross(q - p, r - p)
        vertices = pd.DataFrame({"edge": edges[owned], **dict(zip("xyz", spot[owned].T, strict=True)), **dict(zip(("nx", "ny", "nz"), normal[owned].T, strict=True))})
        distinct = (edges[triangles] != np.roll(edges[triangles], 1, 1)).all(1)
        made = pd.DataFrame({"cell": cells[distinct], "corners": list(edges[triangles[distinct]]), "area": np.linalg.norm(across, axis=1)[distinct] / 2, "volume": (p * np.cross(q, r)).sum(1)[distinct] / 6})
        out = pd.concat([vertices, made], ignore_index=True)
        if out.empty:
            return none
        out[["edge", "cell"]] = out[["edge", "cell"]].astype("Int64")
        out["corners"] = [None] * len(vertices) + list(made["corners"])
        out.insert(0, key, pdf["key"].iloc[0])
        return out

    return dealt.groupBy("key", "gi", "gj", "gk").applyInPandas(run, form)


def vertices(surface: DataFrame, key: str) -> DataFrame:
    """key, edge, x, y, z, nx, ny, nz."""
    return surface.where("edge IS NOT NULL").select(key, "edge", "x", "y", "z", "nx", "ny", "nz")


def triangles(surface: DataFrame, key: str) -> DataFrame:
    """key, cell, corners, area, volume."""
    return surface.where("corners IS NOT NULL").select(key, "cell", "corners", "area", "volume")


def measures(surface: DataFrame, key: str) -> DataFrame:
    """key, vertices, edges, triangles, euler (vertices - edges + triangles), open (edges of one triangle only), area, volume."""
    pairs = F.array(*(F.struct(F.least(F.col("corners")[a], F.col("corners")[b]).alias("a"), F.greatest(F.col("corners")[a], F.col("corners")[b]).alias("b")) for a, b in ((0, 1), (1, 2), (0, 2))))
    sides = surface.where("corners IS NOT NULL").select(key, F.explode(pairs).alias("side")).groupBy(key, "side").agg(F.count("*").alias("n"))
    sides = sides.groupBy(key).agg(F.count("*").alias("edges"), F.count_if(F.col("n") == 1).alias("open"))
    whole = surface.groupBy(key).agg(F.count("edge").alias("vertices"), F.count("corners").alias("triangles"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"))
    found = whole.join(sides, key, "left").na.fill(0, ["edges", "open"])
    return found.select(key, "vertices", "edges", "triangles", (F.col("vertices") - F.col("edges") + F.col("triangles")).alias("euler"), "open", "area", "volume")
