"""Numpy kernels of registration: poses, normal equations, neighbour search in a broadcast cloud."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 256


def rotation_of_twist(w: np.ndarray) -> np.ndarray:
    """Rotation matrix of a rotation vector; first order below 1e-12."""
    k = np.array([[0.0, -w[2], w[1]], [w[2], 0.0, -w[0]], [-w[1], w[0], 0.0]])
    angle = float(np.sqrt(w @ w))
    if angle < 1e-12:
        return np.eye(3) + k
    k /= angle
    return np.eye(3) + np.sin(angle) * k + (1.0 - np.cos(angle)) * (k @ k)


def moved_by_twist(twist: np.ndarray, pose: np.ndarray) -> np.ndarray:
    step = np.eye(4)
    step[:3, :3] = rotation_of_twist(twist[:3])
    step[:3, 3] = twist[3:]
    return step @ pose


def orthonormalized(pose: np.ndarray) -> np.ndarray:
    """The pose with its rotation brought back to an exact rotation, column by column."""
    out = pose.copy()
    a, b = pose[:3, 0], pose[:3, 1]
    a = a / np.linalg.norm(a)
    b = b - (b @ a) * a
    b = b / np.linalg.norm(b)
    c = np.cross(a, b)
    out[:3, 0], out[:3, 1], out[:3, 2] = a, b, c / np.linalg.norm(c)
    return out


def rigid_inverse(pose: np.ndarray) -> np.ndarray:
    out = np.eye(4)
    out[:3, :3] = pose[:3, :3].T
    out[:3, 3] = -pose[:3, :3].T @ pose[:3, 3]
    return out


def full_pivot_solve(matrix: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, int]:
    """Solution by elimination with full pivoting and the rank; unknowns without a pivot are 0.

    A pivot counts if it exceeds epsilon * size * the largest pivot.
    """
    a, b, n = matrix.astype(float).copy(), right.astype(float).copy(), len(right)
    order, pivots = np.arange(n), np.zeros(n)
    for k in range(n):
        i, j = np.unravel_index(np.abs(a[k:, k:]).argmax(), (n - k, n - k))
        i, j = i + k, j + k
        if a[i, j] == 0.0 or not np.isfinite(a[i, j]):
            break
        a[[k, i]], b[[k, i]] = a[[i, k]], b[[i, k]]
        a[:, [k, j]], order[[k, j]] = a[:, [j, k]], order[[j, k]]
        pivots[k] = abs(a[k, k])
        factor = a[k + 1 :, k] / a[k, k]
        a[k + 1 :] -= factor[:, None] * a[k]
        b[k + 1 :] -= factor * b[k]
    rank = int((pivots > np.finfo(float).eps * n * pivots.max(initial=0.0)).sum())
    x = np.zeros(n)
    for k in range(rank - 1, -1, -1):
        x[k] = (b[k] - a[k, k + 1 : rank] @ x[k + 1 : rank]) / a[k, k]
    out = np.empty(n)
    out[order] = x
    return out, rank


def transform_points(pose: np.ndarray, p: np.ndarray) -> np.ndarray:
    """((m0 x + m1 y) + m2 z) + m3 for every row, in that grouping."""
    x, y, z = p[:, 0], p[:, 1], p[:, 2]
    return np.column_stack([((pose[r, 0] * x + pose[r, 1] * y) + pose[r, 2] * z) + pose[r, 3] for r in range(3)])


def contributions(p: np.ndarray, q: np.ndarray, normal: np.ndarray | None, information: np.ndarray | None, huber: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per pair: 6 x 6 matrices, 6-vectors (rotation first, left-multiplied increments) and absolute residuals.

    With normals the residual is the distance to the plane, else the distance. Huber weights use the residual; an
    information matrix enters the equations only.
    """
    e = p - q
    residual = np.einsum("ij,ij->i", normal, e) if normal is not None else np.sqrt(np.einsum("ij,ij->i", e, e))
    size = np.abs(residual)
    weight = np.where(size <= huber, 1.0, huber / np.maximum(size, np.finfo(float).tiny))
    if normal is not None:
        j = np.concatenate([np.cross(p, normal), normal], axis=1)
        return weight[:, None, None] * j[:, :, None] * j[:, None, :], (-weight * residual)[:, None] * j, size
    j = np.zeros((len(p), 3, 6))
    j[:, 0, 1], j[:, 0, 2] = p[:, 2], -p[:, 1]
    j[:, 1, 0], j[:, 1, 2] = -p[:, 2], p[:, 0]
    j[:, 2, 0], j[:, 2, 1] = p[:, 1], -p[:, 0]
    j[:, :, 3:] = np.eye(3)
    weighted = weight[:, None, None] * np.swapaxes(j, 1, 2)
    if information is not None:
        weighted = weighted @ information
    return weighted @ j, -(weighted @ e[:, :, None])[:, :, 0], size


def block_sums(block: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of rows by block; rows of a block are added in their order."""
    ids, first = np.unique(block, return_index=True)
    return ids, np.add.reduceat(values, first, axis=0) if len(ids) else values[:0]


def principal(points: np.ndarray) -> np.ndarray:
    """Axes (n, 3, 3) of neighbourhoods (n, k, 3), that of least spread first."""
    centred = points - points.mean(axis=1, keepdims=True)
    values, vectors = np.linalg.eigh(np.einsum("nki,nkj->nij", centred, centred))
    if not np.isfinite(values).all() or (values[:, 1] <= 1e-12).any():
        raise ValueError("a covariance neighbourhood is collinear or coincident")
    return vectors


def regularized(points: np.ndarray, epsilon: float) -> np.ndarray:
    """Covariances (n, 3, 3) of neighbourhoods (n, k, 3) with eigenvalues replaced by (epsilon, 1, 1)."""
    vectors = principal(points)
    return np.einsum("nij,j,nkj->nik", vectors, np.array([epsilon, 1.0, 1.0]), vectors)


def flattened(axis: np.ndarray, epsilon: float) -> np.ndarray:
    """The covariances of ``regularized`` from their first axes (n, 3), but for rounding."""
    return np.eye(3) + (epsilon - 1.0) * axis[:, :, None] * axis[:, None, :]


#: Pairs that are looked at together.
PAIRS = 400_000


def _least(q: np.ndarray, j: np.ndarray, d2: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """(queries, k): of each query's n >= k pairs the k least by (d2, j), by j. Pairs are in the order of q."""
    width, first = int(n.max()), np.cumsum(n) - n
    if len(n) * width > 4 * len(q):
        order = np.lexsort((j, d2, q))
        return np.sort(j[order][first[:, None] + np.arange(k)], axis=1)
    place = np.arange(len(q)) - first[q]
    d, at = np.full((len(n), width), np.inf), np.full((len(n), width), np.iinfo(np.int64).max)
    d[q, place], at[q, place] = d2, j
    chosen = d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    ties = chosen.sum(axis=1) > k
    out = np.empty((len(n), k), dtype=np.int64)
    out[~ties] = at[~ties][chosen[~ties]].reshape(-1, k)
    if ties.any():
        out[ties] = np.take_along_axis(at[ties], np.lexsort((at[ties], d[ties]), axis=1)[:, :k], axis=1)
    return np.sort(out, axis=1)


def k_nearest(points: np.ndarray, asked: np.ndarray, k: int, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(some of ``asked``, their k nearest points): places in ``points``, least first; -1 where fewer than k are within ``reach``.

    Nearest by (squared distance, place). Radii grow up to the reach, and end for a point once k are within.
    """
    order = np.lexsort(points.T)
    starts = np.append(True, (points[order[1:]] != points[order[:-1]]).any(axis=1))
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
    others = np.sort(order[rank < k])  # of the points at one place the k first
    left = asked
    radii = [reach / 2.0 ** (i / 2.0) for i in range(6, -1, -1)]
    while radii:
        radius = radii.pop(0)
        cells = np.floor(points / radius).astype(np.int64)
        low = cells.min(axis=0) - 1
        size = cells.max(axis=0) - low + 2
        key = ((cells[:, 0] - low[0]) * size[1] + cells[:, 1] - low[1]) * size[2] + cells[:, 2] - low[2]
        by = others[np.argsort(key[others], kind="stable")]
        keys, columns = key[by], np.array([(a * size[1] + b) * size[2] for a in (-1, 0, 1) for b in (-1, 0, 1)])

        def ranges(some: np.ndarray, keys: np.ndarray = keys, key: np.ndarray = key, columns: np.ndarray = columns) -> tuple[np.ndarray, np.ndarray]:
            at = key[some][:, None] + columns
            first = np.searchsorted(keys, at - 1)
            return first, np.searchsorted(keys, at + 1, side="right") - first

        if radii:  # a radius at which most points have too few others is left out
            some = left[:: max(1, len(left) // 64)]
            if (ranges(some)[1].sum(axis=1) < 2.5 * k).mean() > 0.5:
                continue
        left = left[np.argsort(key[left], kind="stable")]
        again, done = [], 0
        while done < len(left):
            first, size_of = ranges(left[done : done + 8192])
            upto = max(1, int(np.searchsorted(np.cumsum(size_of.sum(axis=1)), PAIRS)))
            some, first, size_of = left[done : done + upto], first[:upto], size_of[:upto]
            done += len(some)
            flat = size_of.ravel()
            ends = np.cumsum(flat)
            j = by[np.arange(ends[-1]) + np.repeat(first.ravel() - ends + flat, flat)]
            q = np.repeat(np.arange(len(some)), size_of.sum(axis=1))
            d2 = np.zeros(len(q))
            for c in range(3):
                d = points[some, c][q] - points[j, c]
                d2 += d * d
            near = d2 <= radius * radius
            q, j, d2 = q[near], j[near], d2[near]
            n = np.bincount(q, minlength=len(some))
            whole = n >= k
            if not whole.all():
                again.append(some[~whole])
                kept = whole[q]
                q, j, d2 = (np.cumsum(whole) - 1)[q[kept]], j[kept], d2[kept]
            if whole.any():
                yield some[whole], _least(q, j, d2, n[whole], k)
        left = np.concatenate(again) if again else left[:0]
        if not len(left):
            return
    yield left, np.full((len(left), k), -1)


#: Cells of more points are looked through for points at one place.
CROWD = 32


class CellIndex:
    """Exact nearest neighbour within a radius over a cloud held in memory: cells of a few points, searched in rings."""

    def __init__(self, points: np.ndarray, radius: float) -> None:
        self.points, self.radius, self.edge = points, radius, radius
        for _ in range(3):  # smaller cells while they still hold several points
            cells = np.floor(points / self.edge)
            if len(points) <= 4 * len(np.unique(cells, axis=0)):
                break
            self.edge /= 2.0
        cells = np.floor(points / self.edge).astype(np.int64)
        self.low = cells.min(axis=0) - 1
        self.size = cells.max(axis=0) - self.low + 2
        key = self._key(cells)
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]
        if np.diff(np.append(np.flatnonzero(np.diff(self.keys, prepend=-2)), len(points))).max() > CROWD:
            kept = self._first_at_place()[self.order]
            self.order, self.keys = self.order[kept], self.keys[kept]

    def _first_at_place(self) -> np.ndarray:
        """Which points come first of those at their place: the others are never nearest."""
        order = np.lexsort(self.points.T)
        first = np.ones(len(order), dtype=bool)
        first[order[1:]] = (self.points[order[1:]] != self.points[order[:-1]]).any(axis=1)
        return first

    def _key(self, cells: np.ndarray) -> np.ndarray:
        c = cells - self.low
        inside = ((c >= 0) & (c < self.size)).all(axis=1)
        return np.where(inside, (c[:, 0] * self.size[1] + c[:, 1]) * self.size[2] + c[:, 2], -1)

    def nearest(self, q: np.ndarray) -> np.ndarray:
        """Place of the nearest point within the radius, inclusive, least place on ties; -1 if there is none."""
        return self.search(q)[0]

    def search(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``nearest`` and the squared distances, in the arithmetic of the points' type."""
        kind = self.points.dtype.type
        best = np.full(len(q), np.inf, dtype=kind)
        place = np.full(len(q), -1, dtype=np.int64)
        home = np.floor(q / self.edge).astype(np.int64)
        open_ = np.arange(len(q))
        limit = kind(self.radius) * kind(self.radius)
        rings = int(np.ceil(self.radius / self.edge))
        for ring in range(rings + 1):
            if not len(open_):
                break
            span = range(-ring, ring + 1)
            for a in span:
                for b in span:
                    for c in span if max(abs(a), abs(b)) == ring else ((-ring, ring) if ring else (0,)):
                        key = self._key(home[open_] + np.array([a, b, c]))
                        first, last = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
                        last = np.where(key < 0, first, last)
                        for step in range(int((last - first).max(initial=0))):
                            some = np.flatnonzero(first + step < last)
                            i, j = open_[some], self.order[(first + step)[some]]
                            d = q[i] - self.points[j]
                            d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
                            better = (d2 <= limit) & ((d2 < best[i]) | (d2 == best[i]) & (j < place[i]))
                            best[i[better]], place[i[better]] = d2[better], j[better]
            # what lies beyond this ring is farther than the distance to the ring's outer face
            face = np.minimum(q[open_] - (home[open_] - ring) * self.edge, (home[open_] + ring + 1) * self.edge - q[open_]).min(axis=1)
            open_ = open_[~(best[open_] < np.maximum(face, 0.0) ** 2 * (1.0 - 1e-6))]
        return place, best
