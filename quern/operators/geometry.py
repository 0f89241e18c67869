"""Geometry over tables of molecules: rows (key, coords, z), coords flat (x, y, z, x, ...) and z the atomic numbers.

Each molecule is one row, so kernels run in Arrow batches without a shuffle. A row without coordinates, or
with another number of them than three an atom, gives nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.functions import geometry as G
from quern.operators.ensembles import KT, weighted_stats


def fits(coords: list | None, z: list | None) -> bool:
    """Whether a row is a molecule: coordinates, three an atom, without nulls."""
    return bool(coords and z and len(coords) == 3 * len(z) and None not in coords and None not in z)


def per_molecule(df: DataFrame, key: str, kernel: Callable[[np.ndarray, np.ndarray], list[float]], names: list[str]) -> DataFrame:
    """key and the named doubles that ``kernel(xyz, z)`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for coords, z in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                rows.append(list(map(float, kernel(np.array(coords, np.float64).reshape(-1, 3), np.array(z)))) if fits(coords, z) else [None] * len(names))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.float64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))]], names=[key, *names])

    cols = df.select(F.col(key), F.col("coords").cast("array<double>"), F.col("z").cast("array<int>"))
    return cols.mapInArrow(run, ", ".join([f"`{key}` {df.schema[key].dataType.simpleString()}", *[f"`{n}` double" for n in names]]))


def buried_volumes(df: DataFrame, key: str, centre: int = 0, plane: tuple[int, int, int] = (0, 1, 2), radius: float = 3.5, spacing: float = 0.25) -> DataFrame:
    def kernel(x: np.ndarray, z: np.ndarray) -> list[float]:
        return [*G.buried_volume(x, G.radii(z), centre, G.plane_normal(*x[list(plane)]), radius, spacing)]

    return per_molecule(df, key, kernel, ["vbur_si", "vbur_re", "vbur_diff", "vbur_total"])


def sterimols(df: DataFrame, key: str, origin: int, group: list[int]) -> DataFrame:
    return per_molecule(df, key, lambda x, z: [*G.sterimol(x, G.radii(z), origin, np.array([i for i in group if i < len(x)], int))], ["l", "b1", "b5"])


def dihedrals(df: DataFrame, key: str, atoms: tuple[int, int, int, int]) -> DataFrame:
    """sin and cos of a dihedral."""
    return per_molecule(df, key, lambda x, z: [f(G.dihedral(x[list(atoms)])) for f in (np.sin, np.cos)], ["sin_tau", "cos_tau"])


def orientations(df: DataFrame, key: str, centre: int) -> DataFrame:
    """Of each molecule in the standard orientation: z of the centre's nearest atom, y and z of the next nearest; three atoms or more."""

    def kernel(x: np.ndarray, z: np.ndarray) -> list[float]:
        d = np.linalg.norm(x - x[centre], axis=1)
        d[centre] = np.inf
        first, second = np.argsort(d, kind="stable")[:2]
        y = G.standardised(x, centre)
        return [y[first, 2], y[second, 1], y[second, 2]]

    return per_molecule(df, key, kernel, ["first_z", "second_y", "second_z"])


def spherical_maps(df: DataFrame, key: str, centre: int = 0, **shape) -> DataFrame:
    """key, map: the flat spherical map of each molecule as it lies."""
    n = shape.get("n_theta", 10) * shape.get("n_phi", 20)
    cells = per_molecule(df, key, lambda x, z: [*G.spherical_map(x, G.radii(z), centre, **shape).ravel()], [f"c{i}" for i in range(n)])
    return cells.select(key, F.array(*[f"c{i}" for i in range(n)]).alias("map"))


def mean_maps(df: DataFrame, group: str, weight: str, centre: int = 0, **shape) -> DataFrame:
    """group, cell, distance: the spherical maps of a group's molecules averaged by ``weight``, cell by cell.

    A task adds up its molecules' maps by group, so that what is shuffled are sums and not maps. A molecule without a map
    counts by its weight alone, one without weight not at all; a group of none that counts has nulls.
    """
    n = shape.get("n_theta", 10) * shape.get("n_phi", 20)

    def rows(sums: dict) -> pa.RecordBatch:
        names = pa.array(list(sums), kind)
        weights = pa.array([w if any_weight else None for w, any_weight, *_ in sums.values()], pa.float64())
        maps = pa.array([m.tolist() if any_map else None for *_, m, any_map in sums.values()], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([names, weights, maps], names=["g", "w", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in batches:
            for g, w, coords, z in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if g not in sums and len(sums) >= 1024:
                    yield rows(sums)
                    sums = {}
                s = sums.setdefault(g, [0.0, False, np.zeros(n), False])
                if w is None:
                    continue
                s[0], s[1] = s[0] + w, True
                if fits(coords, z):
                    x, z = np.array(coords, np.float64).reshape(-1, 3), np.array(z)
                    s[2] += w * G.spherical_map(x, G.radii(z), centre, **shape).ravel()
                    s[3] = True
        if sums:
            yield rows(sums)

    cols = df.select(F.col(group).alias("g"), F.col(weight).cast("double").alias("w"), F.col("coords").cast("array<double>"), F.col("z").cast("array<int>"))
    kind = to_arrow_type(cols.schema["g"].dataType)
    parts = cols.mapInArrow(run, f"g {cols.schema['g'].dataType.simpleString()}, w double, m array<double>")
    cells = parts.select("g", "w", "m", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("cell"))
    return cells.groupBy(F.col("g").alias(group), "cell").agg((F.sum(F.get("m", "cell")) / F.sum("w")).alias("distance"))


def face_features(df: DataFrame, key: str, plane: tuple[int, int, int] = (0, 1, 2), centre: int = 0, size: int = 10, extent: float = 5.0) -> DataFrame:
    """24 features of the maps above and below a plane: the profile of each, and four that compare them."""

    def kernel(x: np.ndarray, z: np.ndarray) -> list[float]:
        si, re = (G.grid_profile(m) for m in G.face_maps(x, G.radii(z), x[centre], G.plane_normal(*x[list(plane)]), size, extent))
        return [*si, *re, si[0] - re[0], si[2] - re[2], si[0] / (re[0] + 1e-8), abs(si[0] - re[0])]

    return per_molecule(df, key, kernel, [*[f"{side}_{n}" for side in ("si", "re") for n in G.PROFILE], "diff_mean", "diff_min", "ratio", "asymmetry"])


def blocking(df: DataFrame, key: str, ring: list[int], centre: int) -> DataFrame:
    """Face blocking of a ring atom by the atoms outside the ring."""
    names = ["si_share", "re_share", "asymmetry", "clash"]
    return per_molecule(df, key, lambda x, z: [*G.face_blocking(x[ring], np.delete(x, ring, 0), x[centre])], names)


def ensemble(df: DataFrame, group: str, energy: str, descriptors: list[str], kt: float = KT) -> DataFrame:
    """group and mean and std of each descriptor over its conformers, Boltzmann-weighted; nulls are left out."""
    w = F.exp(-(F.col(energy) - F.col("__low")) / kt)
    low = df.groupBy(group).agg(F.min(energy).alias("__low"))
    long = df.join(low, group).select(group, w.alias("__w"), F.explode(F.array(*[F.struct(F.lit(d).alias("name"), F.col(d).alias("value")) for d in descriptors])).alias("s"))
    long = long.select(F.struct(F.col(group), F.col("s.name").alias("name")).alias("at"), F.col("s.value").alias("value"), "__w").where("value IS NOT NULL")
    stats = weighted_stats(long, "at", "value", "__w").select(f"at.{group}", "at.name", "mean", "std")
    return stats.groupBy(group).pivot("name", descriptors).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))


def representatives(df: DataFrame, group: str, member: str, energy: str, cut: float = 1.0, most: int = 8, kt: float = KT) -> DataFrame:
    """Of each group's conformers (coords of one length), the lowest of each average-linkage cluster of their distances, with Boltzmann weights.

    group, member, energy, cluster, weight. Each group is held by one task, so it must be small (the conformers of a molecule).
    """

    def run(t: pa.Table) -> pa.Table:
        x = np.array(t["coords"].to_pylist(), np.float64).reshape(len(t), -1, 3)
        e, label = t[energy].to_numpy(), G.average_linkage(G.rmsd(x), cut, most)
        order = np.lexsort((t[member].to_numpy(), e, label))
        first = order[np.unique(label[order], return_index=True)[1]]
        w = np.exp(-(e[first] - e[first].min()) / kt)
        keep = t.take(first)
        return pa.table([keep[group], keep[member], keep[energy], pa.array(label[first].astype(np.int32)), pa.array(w / w.sum())], names=[group, member, energy, "cluster", "weight"])

    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, member)}
    rows = df.select(group, member, F.col(energy).cast("double").alias(energy), F.col("coords").cast("array<double>").alias("coords")).where(F.col(energy).isNotNull() & F.col("coords").isNotNull())
    return rows.groupBy(group).applyInArrow(run, f"`{group}` {kinds[group]}, `{member}` {kinds[member]}, `{energy}` double, cluster int, weight double")
