"""Singular values and right singular vectors of a small triangular matrix, by bidiagonal qd.

Householder reflections make the matrix upper bidiagonal; dqds finds all singular values, the small ones as accurately
as the large ones; twisted factorisations give the vectors of those that are wanted, without a product of rotations.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps
_TINY = np.finfo(float).tiny


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v and t with (I - t v v') x = (alpha, 0, ...)."""
    v, norm = x.copy(), np.linalg.norm(x)
    if norm == 0 or not x[1:].any():
        return v, 0.0
    v[0] += np.copysign(norm, x[0])
    return v, 2.0 / (v @ v)


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, v): the diagonal and the superdiagonal of an upper bidiagonal u' r v, and v."""
    m, d = r.astype(float).copy(), r.shape[1]
    right = np.eye(d)
    for k in range(d):
        v, t = _reflector(m[k:, k])
        if t:
            m[k:, k:] -= t * np.outer(v, v @ m[k:, k:])
        if k < d - 2:
            v, t = _reflector(m[k, k + 1 :])
            if t:
                m[k:, k + 1 :] -= t * np.outer(m[k:, k + 1 :] @ v, v)
                right[:, k + 1 :] -= t * np.outer(right[:, k + 1 :] @ v, v)
    return np.diag(m).copy(), np.diag(m, 1).copy(), right


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One dqds step, and the sum of the d's inverses; None if the shift is beyond the smallest eigenvalue."""
    n, d, inverse = len(q), q[0] - shift, 0.0
    if d < 0:
        return None
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    for i in range(n - 1):
        inverse += 1 / d if d > _TINY else np.inf
        new_q[i] = s = d + e[i]
        if s == 0:
            return None
        t = q[i + 1] / s
        new_e[i] = e[i] * t
        d = d * t - shift
        if d < 0 or d != d:
            return None
    new_q[-1] = d
    return new_q, new_e, inverse + (1 / d if d > _TINY else np.inf)


def _bottom(q: list[float], e: list[float]) -> float:
    """The smaller eigenvalue of the last two rows' block."""
    trace, det = q[-2] + e[-1] + q[-1], q[-2] * q[-1]
    return det / (trace / 2 + max(trace * trace / 4 - det, 0.0) ** 0.5) if trace > 0 else 0.0


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The squares of the singular values of the bidiagonal matrix with diagonal a and superdiagonal b, falling."""
    if not len(a):
        return np.empty(0)
    scale = max(np.abs(a).max(), np.abs(b).max(initial=0.0)) or 1.0
    stack = [([float(x) for x in (a / scale) ** 2], [float(x) for x in (b / scale) ** 2], 0.0)]
    found: list[float] = []
    while stack:
        q, e, sigma = stack.pop()
        sweeps = 0
        while True:
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= _EPS * _EPS * (sigma + q[i] + q[i + 1])), None)
            if cut is not None:
                stack.append((q[: cut + 1], e[:cut], sigma))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if len(q) == 1:
                found.append(sigma + q[0])
                break
            if len(q) == 2:
                big = (q[0] + e[0] + q[1]) / 2
                big += max(big * big - q[0] * q[1], 0.0) ** 0.5
                found += [sigma + big, sigma + q[0] * q[1] / big]
                break
            # A shift at the bottom block's eigenvalue converges fast, but may be too large; Newton's bound never is.
            shift = _bottom(q, e) * (1 - 1e-10)
            stepped = _sweep(q, e, shift) if shift > _EPS * sigma else None
            if stepped is None:
                plain = _sweep(q, e, 0.0)
                if plain is None:
                    raise ArithmeticError("a bidiagonal matrix that isn't finite")
                shift = 1 / plain[2] * (1 - 1e-10) if np.isfinite(plain[2]) else 0.0
                stepped = _sweep(q, e, shift) if shift > _EPS * sigma else None
                if stepped is None:
                    shift, stepped = 0.0, plain
            q, e, _ = stepped
            sigma += shift
            sweeps += 1
            if sweeps > 60 * (len(q) + 10):
                raise ArithmeticError("dqds didn't converge")
    return np.sort(np.array(found))[::-1] * scale * scale


def twisted_vector(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """The unit eigenvector of B'B for its eigenvalue ``value``: the stationary factorisation from above and the
    progressive one from below meet where their common pivot is smallest."""
    n = len(a)
    floor = (_EPS * max(np.abs(a).max(), np.abs(b).max(initial=0.0))) ** 2 or _TINY
    d = np.maximum(a * a, floor)
    low = b * np.copysign(np.sqrt(d[:-1]), a[:-1]) / d[:-1]  # L of B'B = L D L'
    pivot = floor * 1e-3

    def safe(x: float) -> float:
        return x if abs(x) > pivot else np.copysign(pivot, x)

    s, down = np.empty(n), np.empty(n - 1)
    s[0] = -value
    for i in range(n - 1):
        plus = safe(s[i] + d[i])
        down[i] = d[i] * low[i] / plus
        s[i + 1] = down[i] * low[i] * s[i] - value
    p, up = np.empty(n), np.empty(n - 1)
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        t = d[i] / safe(d[i] * low[i] ** 2 + p[i + 1])
        up[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    k = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def right_singular(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(squares, vectors): the squares of the largest singular values of a square matrix, at most ``count`` and those only
    that are above rounding errors, and their right singular vectors as columns."""
    a, b, right = bidiagonalise(r)
    squares = dqds(a, b)
    if not len(squares) or squares[0] <= 0:
        return np.empty(0), np.empty((len(a), 0))
    squares = squares[:count][squares[:count] > (len(a) * _EPS) ** 2 * squares[0]]
    square = np.diag(a * a) + np.diag(np.r_[0.0, b * b]) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    z, draw = np.empty((len(a), len(squares))), np.random.default_rng(7)
    for i, value in enumerate(squares):
        x = twisted_vector(a, b, value)
        near = [j for j in range(i) if squares[j] - value <= 1e-3 * squares[j]]
        for attempt in range(6):  # vectors of a cluster are made orthogonal; where two coincide, inverse iteration finds another
            y = x - z[:, near] @ (z[:, near].T @ x)
            y -= z[:, near] @ (z[:, near].T @ y)
            if np.isfinite(y).all() and np.linalg.norm(y) > 0.1 and np.linalg.norm(square @ y - value * y) <= 1e-10 * squares[0] * np.linalg.norm(y):
                break
            start = draw.standard_normal(len(a)) if attempt % 2 == 0 or not np.isfinite(y).all() else y
            start -= z[:, near] @ (z[:, near].T @ start)
            x = np.linalg.solve(square - value * (1 + 4 * _EPS * (attempt + 1)) * np.eye(len(a)), start)
            x /= np.linalg.norm(x)
        z[:, i] = y / np.linalg.norm(y)
    vectors = right @ z
    return squares, vectors / np.linalg.norm(vectors, axis=0)
