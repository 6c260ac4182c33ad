"""Spectra of trajectories: vibrations from velocities, infrared from dipoles, Raman from polarizabilities."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spectral import power_spectrum
from .transform import BLOCK

#: Weights of the parts of a polarizability's anisotropy, in the order xx - yy, yy - zz, zz - xx, xy, yz, xz.
ANISOTROPY = (0.5, 0.5, 0.5, 3.0, 3.0, 3.0)
#: Shares of the isotropic and the anisotropic spectrum in what is scattered.
SCATTERED = {"isotropic": (1.0, 0.0), "anisotropic": (0.0, 1.0), "vv": (45.0, 4.0), "vh": (0.0, 3.0), "unpolarized": (45.0, 7.0)}


def velocities(frames: DataFrame, group: str, atom: str, frame: str, coords: list[str], step: float) -> DataFrame:
    """group, atom, frame, vx, vy, ...: central differences; frames without both neighbours have none.

    Each row is sent to the frames before and after it with opposite signs, so one sum a frame replaces an ordered window and
    no atom's frames meet in one task. A null coordinate gives a null velocity.
    """
    sides = F.explode(F.array(F.struct((F.col(frame) - 1).alias("frame"), F.lit(1).alias("sign")), F.struct((F.col(frame) + 1).alias("frame"), F.lit(-1).alias("sign"))))
    sent = frames.select(group, atom, sides.alias("_to"), *coords)
    sums = [F.when(F.count(c) == 2, F.sum(F.col("_to.sign") * F.col(c)) / (2 * step)).alias(f"v{c}") for c in coords]
    moved = sent.groupBy(group, atom, F.col("_to.frame").alias(frame)).agg(F.count("*").alias("_sides"), *sums)
    return moved.where(F.col("_sides") == 2).drop("_sides")


def without_drift(vel: DataFrame, group: str, frame: str, parts: list[str], mass: str) -> DataFrame:
    """Velocities less that of each frame's centre of mass, summed up before the shuffle. A null part counts in no centre."""
    centre = [(F.sum(F.col(mass) * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), F.col(mass)))).alias(f"_{c}") for c in parts]
    joined = vel.join(vel.groupBy(group, frame).agg(*centre), [group, frame])
    return joined.select(*[(F.col(c) - F.col(f"_{c}")).alias(c) if c in parts else F.col(c) for c in vel.columns])


def _components(rows: DataFrame, group: str, frame: str, parts: dict, key=None) -> DataFrame:
    """One row a value: group, component, frame, value, weight; `parts` holds value and weight by name."""
    listed = F.explode(F.array(*[F.struct(F.lit(name).alias("part"), v.cast("double").alias("value"), w.cast("double").alias("weight")) for name, (v, w) in parts.items()]))
    named = F.concat_ws("|", "_x.part", key.cast("string")) if key is not None else F.col("_x.part")
    return rows.select("*", listed.alias("_x")).select(group, named.alias("component"), F.col(frame).alias("frame"), "_x.value", "_x.weight")


def _spectrum(rows: DataFrame, group: str, step: float, kind: str, padding: float, block: int) -> DataFrame:
    return power_spectrum(rows, group, "component", "frame", "value", step, kind, padding, "weight", block)


def vibrations(frames: DataFrame, group: str, atom: str, frame: str, coords: list[str], mass: str, step: float, kind: str = "hann", padding: float = 4.0, drift: bool = False, block: int = BLOCK) -> DataFrame:
    """group, bin, frequency, power: mass-weighted spectra of all atoms' velocities, without the drift of the whole unless `drift`.

    Frames count from 0 without gaps; velocities start at the second, so they are counted from there.
    """
    vel = velocities(frames, group, atom, frame, coords, step)
    masses = frames.groupBy(group, atom).agg(F.first(mass).alias(mass))
    vel = vel.join(masses, [group, atom]).withColumn(frame, F.col(frame) - 1)
    parts = [f"v{c}" for c in coords]
    kept = vel if drift else without_drift(vel, group, frame, parts, mass)
    return _spectrum(_components(kept, group, frame, {p: (F.col(p), F.col(mass)) for p in parts}, F.col(atom)), group, step, kind, padding, block)


def infrared(rows: DataFrame, group: str, frame: str, dipole: list[str], step: float, current: bool = False, kind: str = "hann", padding: float = 4.0, block: int = BLOCK) -> DataFrame:
    """group, bin, frequency, power of a dipole (times the squared angular frequency) or of a current (as it is)."""
    found = _spectrum(_components(rows, group, frame, {c: (F.col(c), F.lit(1.0)) for c in dipole}), group, step, kind, padding, block)
    return found if current else found.withColumn("power", F.col("power") * F.pow(2 * pi * F.col("frequency"), F.lit(2.0)))


def raman(rows: DataFrame, group: str, frame: str, tensor: tuple[str, str, str, str, str, str], step: float, kind: str = "hann", padding: float = 4.0, block: int = BLOCK) -> DataFrame:
    """group, bin, frequency, isotropic, anisotropic, vv, vh, unpolarized of a polarizability (columns xx, yy, zz, xy, yz, xz).

    The isotropic part and the six anisotropic ones are transformed at once, as two groups of components.
    """
    xx, yy, zz, xy, yz, xz = (F.col(c).cast("double") for c in tensor)
    uneven = {str(k): (v, F.lit(w)) for k, (v, w) in enumerate(zip((xx - yy, yy - zz, zz - xx, xy, yz, xz), ANISOTROPY, strict=True))}
    values = _components(rows, group, frame, {"mean": ((xx + yy + zz) / 3, F.lit(1.0))} | uneven)
    pair = F.struct(F.col(group), (F.col("component") == "mean").alias("even"))
    found = _spectrum(values.withColumn("_pair", F.to_json(pair)), "_pair", step, kind, padding, block)
    known = F.from_json("_pair", f"`{group}` {dict(rows.dtypes)[group]}, even boolean")
    found = found.select(known.alias("_k"), "*").select(F.col(f"_k.{group}").alias(group), F.col("_k.even").alias("_even"), "bin", "frequency", (F.col("power") * F.pow(2 * pi * F.col("frequency"), F.lit(2.0))).alias("power"))
    both = found.groupBy(group, "bin", "frequency").agg(F.sum(F.when(F.col("_even"), F.col("power"))).alias("_i"), F.sum(F.when(~F.col("_even"), F.col("power"))).alias("_a"))
    return both.select(group, "bin", "frequency", *[(F.col("_i") * i + F.col("_a") * a).alias(name) for name, (i, a) in SCATTERED.items()])
