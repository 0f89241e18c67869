"""Geometry kernels over one molecule's coordinates, in numpy: ``xyz`` (n, 3) and the atoms' radii."""

from __future__ import annotations

import numpy as np

# Van der Waals radii by atomic number, in angstroms; others count as carbon.
RADII = {1: 1.20, 5: 1.92, 6: 1.70, 7: 1.55, 8: 1.52, 9: 1.47, 14: 2.10, 15: 1.80, 16: 1.80, 17: 1.75, 35: 1.85, 53: 1.98}
CARBON = 1.70


def radii(z: np.ndarray) -> np.ndarray:
    return np.array([RADII.get(int(x), CARBON) for x in z])


def plane_normal(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Unit normal of the plane of three points; z where they lie in line."""
    n = np.cross(b - a, c - a)
    size = np.linalg.norm(n)
    return n / size if size >= 1e-10 else np.array([0.0, 0.0, 1.0])


def best_normal(points: np.ndarray) -> np.ndarray:
    """Unit normal of the plane that fits best; of the two, the one whose largest component is positive."""
    n = np.linalg.svd(points - points.mean(0))[2][-1]
    return n * np.sign(n[np.abs(n).argmax()])


def buried_volume(xyz: np.ndarray, r: np.ndarray, centre: int, normal: np.ndarray, radius: float = 3.5, spacing: float = 0.25) -> tuple[float, ...]:
    """Per cent of a sphere's grid points inside any other atom: on the normal's side, on the other, their difference, in all."""
    ticks = np.linspace(-radius, radius, int(2 * radius / spacing) + 1)
    grid = np.stack(np.meshgrid(ticks, ticks, ticks), -1).reshape(-1, 3)
    grid = grid[(grid * grid).sum(1) <= radius * radius]
    inside = np.zeros(len(grid), bool)
    for j in np.flatnonzero(np.arange(len(xyz)) != centre):
        inside |= ((grid - (xyz[j] - xyz[centre])) ** 2).sum(1) <= r[j] ** 2
    up = grid @ normal > 0
    share = lambda mask: 100.0 * inside[mask].sum() / max(mask.sum(), 1)
    si, re = share(up), share(~up)
    return si, re, si - re, 100.0 * inside.mean()


def sterimol(xyz: np.ndarray, r: np.ndarray, origin: int, group: np.ndarray) -> tuple[float, float, float]:
    """L, B1, B5 of a group along the axis from ``origin`` to its centroid; 0 without atoms."""
    if not len(group):
        return 0.0, 0.0, 0.0
    x, r = xyz[group] - xyz[origin], r[group]
    axis = x.mean(0)
    size = np.linalg.norm(axis)
    axis = axis / size if size >= 1e-6 else np.array([1.0, 0.0, 0.0])
    along = x @ axis
    across = np.linalg.norm(x - along[:, None] * axis, axis=1) + r
    far = along.argmax()
    return along[far] + r[far], across.min(), across.max()


def dihedral(p: np.ndarray) -> float:
    """Angle of four points in radians; 0 where three of them lie in line."""
    a, b, c = np.diff(p, axis=0)
    m, n = np.cross(a, b), np.cross(b, c)
    if np.linalg.norm(m) < 1e-8 or np.linalg.norm(n) < 1e-8:
        return 0.0
    return float(np.arctan2(np.linalg.norm(b) * (a @ n), m @ n))


def rotation(axis: np.ndarray, angle: float) -> np.ndarray:
    """The matrix that turns by ``angle`` around a unit axis."""
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def standardised(xyz: np.ndarray, centre: int) -> np.ndarray:
    """Moved and turned: the centre at the origin, its nearest atom on +z, the next nearest in the yz plane with y >= 0."""
    x = xyz - xyz[centre]
    d = np.linalg.norm(x, axis=1)
    d[centre] = np.inf
    order = np.argsort(d, kind="stable")
    if len(x) < 2 or d[order[0]] < 1e-8:
        return x
    v = x[order[0]] / d[order[0]]
    axis = np.cross(v, [0.0, 0.0, 1.0])
    size = np.linalg.norm(axis)
    if size > 1e-12:
        x = x @ rotation(axis / size, np.arccos(np.clip(v[2], -1, 1))).T
    elif v[2] < 0:
        x = x * [1.0, -1.0, -1.0]
    if len(x) > 2:
        w = x[order[1]]
        x = x @ rotation(np.array([0.0, 0.0, 1.0]), np.arctan2(w[0], w[1])).T
    return x


def surface_distance(points: np.ndarray, xyz: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Of each point the distance to the nearest atom's surface."""
    return (np.linalg.norm(points[:, None] - xyz, axis=2) - r).min(1)


def spherical_map(xyz: np.ndarray, r: np.ndarray, centre: int, radius: float = 10.0, n_theta: int = 10, n_phi: int = 20) -> np.ndarray:
    """(n_theta, n_phi) distances from a sphere around an atom to the other atoms' surfaces."""
    t, p = np.meshgrid(np.linspace(0, np.pi, n_theta), np.linspace(0, 2 * np.pi, n_phi, endpoint=False), indexing="ij")
    points = radius * np.stack([np.sin(t) * np.cos(p), np.sin(t) * np.sin(p), np.cos(t)], -1).reshape(-1, 3) + xyz[centre]
    others = np.arange(len(xyz)) != centre
    return surface_distance(points, xyz[others], r[others]).reshape(n_theta, n_phi)


def face_maps(xyz: np.ndarray, r: np.ndarray, centre: np.ndarray, normal: np.ndarray, size: int = 10, extent: float = 5.0) -> list[np.ndarray]:
    """(size, size) distances to the atoms' surfaces from a grid above the plane and from one below it."""
    u = np.cross(normal, [0.0, 0.0, 1.0] if abs(normal[2]) < 0.9 else [1.0, 0.0, 0.0])
    u /= np.linalg.norm(u)
    ticks = np.linspace(-extent, extent, size)
    out = []
    for n in (normal, -normal):
        v = np.cross(n, u)
        points = centre + ticks[:, None, None] * u + ticks[None, :, None] * (v / np.linalg.norm(v)) + extent * n
        out.append(surface_distance(points.reshape(-1, 3), xyz, r).reshape(size, size))
    return out


#: Names of ``grid_profile``.
PROFILE = ["mean", "std", "min", "max", "q25", "q75", "tl", "tr", "bl", "br"]


def grid_profile(grid: np.ndarray) -> list[float]:
    """Mean, population std, extremes, quartiles and the means of the four quadrants."""
    h, w = grid.shape[0] // 2, grid.shape[1] // 2
    quadrants = [grid[:h, :w], grid[:h, w:], grid[h:, :w], grid[h:, w:]]
    return [*map(float, (grid.mean(), grid.std(), grid.min(), grid.max(), *np.percentile(grid, [25, 75]), *(q.mean() for q in quadrants)))]


def face_blocking(ring: np.ndarray, others: np.ndarray, centre: np.ndarray) -> tuple[float, float, float, float]:
    """Shares of the closeness 1 / (d + 0.5) above and below the ring's plane, their difference, and the greatest clash."""
    if not len(others):
        return 0.0, 0.0, 0.0, 0.0
    x = others - centre
    d = np.linalg.norm(x, axis=1)
    close, up = 1 / (d + 0.5), x @ best_normal(ring) > 0
    total = close.sum() + 1e-8
    si, re = close[up].sum() / total, close[~up].sum() / total
    return si, re, abs(si - re), float(np.clip((CARBON - d.min()) / 3.0, 0, 1))


#: Ring atoms from the metal round to the second oxygen: their radius as a factor of the metal's bond (first) or in angstroms, and the puckering.
RING_RADIUS, METAL_FACTOR, PUCKER = (1.30, 1.40, 1.40, 1.40, 1.30), 0.7, 0.30


def chair(metal_bond: float = 2.00) -> np.ndarray:
    """An idealised six-ring chair in the xy plane."""
    angle = np.arange(6) * np.pi / 3
    r = np.array([metal_bond * METAL_FACTOR, *RING_RADIUS])
    return np.stack([r * np.cos(angle), r * np.sin(angle), PUCKER * np.where(np.arange(6) % 2, -1, 1)], 1)


def average_linkage(distance: np.ndarray, cut: float, most: int) -> np.ndarray:
    """Cluster numbers 0, 1, ... (by first member): merges at an average distance up to ``cut``, and on until ``most`` clusters or fewer are left."""
    d = distance.astype(np.float64).copy()
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n), np.arange(n)
    alive = np.ones(n, bool)
    while alive.sum() > 1:
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        if d[i, j] > cut and alive.sum() <= most:
            break
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i], d[i, i] = merged, merged, np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def rmsd(members: np.ndarray) -> np.ndarray:
    """Root mean square distances of all pairs of (m, atoms, 3), as they lie."""
    x = members[:, None] - members[None]
    return np.sqrt((x * x).sum(-1).mean(-1))
