"""Singular values and right singular vectors of a small triangular matrix:
Householder bidiagonalisation, the dqds iteration, twisted factorisations."""
from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit vector u with (I - 2 u u') x = r e1, and r."""
    size = float(np.linalg.norm(x))
    if size == 0:
        return np.zeros_like(x), 0.0
    u, r = x / size, -float(np.copysign(size, x[0]))
    u[0] += np.copysign(1.0, x[0])
    return u / np.linalg.norm(u), r


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, V): diagonal and superdiagonal of upper bidiagonal B = U' R V."""
    m = np.array(r, np.float64)
    n = m.shape[1]
    a, b, v = np.zeros(n), np.zeros(max(n - 1, 0)), np.eye(n)
    for i in range(n):
        u, a[i] = _reflector(m[i:, i])
        m[i:, i + 1:] -= 2 * np.outer(u, u @ m[i:, i + 1:])
        if i + 1 < n:
            w, b[i] = _reflector(m[i, i + 1:])
            m[i + 1:, i + 1:] -= 2 * np.outer(m[i + 1:, i + 1:] @ w, w)
            v[:, i + 1:] -= 2 * np.outer(v[:, i + 1:] @ w, w)
    return a, b, v


def _newton(q: list, e: list) -> float:
    """Lower bound of the smallest eigenvalue: 1 / trace of the inverse, whose
    terms are all positive."""
    c = 1 / q[0]
    total = c
    for i in range(1, len(q)):
        c = (1 + e[i - 1] * c) / q[i]
        total += c
    return 1 / total * (1 - 8 * len(q) * EPS)


def _dqds(q: list, e: list, shift: float) -> tuple[list, list] | None:
    """One transform; None if the shift was too large."""
    n = len(q)
    new_q, new_e, d = [0.0] * n, [0.0] * (n - 1), q[0] - shift
    for i in range(n - 1):
        if not d >= 0:
            return None
        new_q[i] = d + e[i]
        if new_q[i] == 0:
            return None
        t = q[i + 1] / new_q[i]
        new_e[i], d = e[i] * t, d * t - shift
    if not d >= 0:
        return None
    new_q[-1] = d
    return new_q, new_e


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of the bidiagonal matrix, largest first. Only
    positive terms are added, so small ones keep their relative accuracy."""
    n = len(a)
    if n == 0:
        return np.zeros(0)
    floor = (EPS * max(np.abs(a).max(), np.abs(b).max() if n > 1 else 0)) ** 2 * 1e-6 or np.finfo(float).tiny
    q, e = np.maximum(a * a, floor).tolist(), (b * b).tolist()
    out, parts = [], [(q, e, 0.0)]
    while parts:
        q, e, base = parts.pop()
        for _ in range(40 * len(q) + 40):
            if len(q) == 1:
                out.append(base + q[0])
                break
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= EPS * EPS * (base + min(q[i], q[i + 1]))), None)
            if cut is not None:
                parts.append((q[:cut + 1], e[:cut], base))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            shift = _newton(q, e)
            step = _dqds(q, e, shift)
            while step is None:
                shift = shift * 0.5 if shift > 1e-3 * min(q) else 0.0
                step = _dqds(q, e, shift)
            (q, e), base = step, base + shift
            q = [max(x, floor * 1e-6) for x in q]
        else:
            raise ArithmeticError("dqds did not converge")
    return np.sort(np.array(out))[::-1]


class Twisted:
    """Twisted factorisations of B'B - lam I: the stationary one from the top, the
    progressive one from the bottom, and the pivot of every place they can meet."""

    def __init__(self, a: np.ndarray, b: np.ndarray, lam: float):
        n = len(a)
        d, low = a * a, b / a[:-1]
        tiny = np.finfo(float).tiny ** 0.5 + EPS * EPS * lam
        self.n, self.plus, self.minus = n, np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
        self.top, self.bottom = np.zeros(n), np.zeros(n)  # pivots
        s, p = np.zeros(n), np.zeros(n)
        s[0], p[-1] = -lam, d[-1] - lam
        for i in range(n - 1):
            x = s[i] + d[i]
            self.top[i] = x = x if abs(x) > tiny else tiny
            self.plus[i] = d[i] * low[i] / x
            s[i + 1] = self.plus[i] * low[i] * s[i] - lam
        for i in range(n - 2, -1, -1):
            x = d[i] * low[i] ** 2 + p[i + 1]
            self.bottom[i + 1] = x = x if abs(x) > tiny else tiny
            self.minus[i] = low[i] * d[i] / x
            p[i] = d[i] * (p[i + 1] / x if low[i] else 1.0) - lam
        self.gamma = s + p + lam
        self.gamma = np.where(np.abs(self.gamma) > EPS * lam * 1e-3, self.gamma, EPS * lam * 1e-3 + tiny)

    def vector(self, r: int) -> np.ndarray:
        """The solution that leaves a residual at place ``r`` alone."""
        z = np.zeros(self.n)
        z[r] = 1
        for i in range(r - 1, -1, -1):
            z[i] = -self.plus[i] * z[i + 1]
        for i in range(r, self.n - 1):
            z[i + 1] = -self.minus[i] * z[i]
        return z / np.linalg.norm(z)

    def solve(self, r: int, z: np.ndarray) -> np.ndarray:
        """One step of inverse iteration by the factorisation twisted at ``r``."""
        y = z.copy()
        for i in range(1, r + 1):
            y[i] -= self.plus[i - 1] * y[i - 1]
        for i in range(self.n - 2, r - 1, -1):
            y[i] -= self.minus[i] * y[i + 1]
        x = np.zeros(self.n)
        x[r] = y[r] / self.gamma[r]
        for i in range(r - 1, -1, -1):
            x[i] = y[i] / self.top[i] - self.plus[i] * x[i + 1]
        for i in range(r + 1, self.n):
            x[i] = y[i] / self.bottom[i] - self.minus[i - 1] * x[i - 1]
        return x / np.linalg.norm(x)


def vectors(a: np.ndarray, b: np.ndarray, lams: np.ndarray) -> np.ndarray:
    """Orthonormal eigenvectors of B'B in columns, for falling ``lams``. Where the
    value stands apart, the vector of the smallest pivot is it; in a cluster steps
    of inverse iteration are kept orthogonal to the vectors already found."""
    n = len(a)
    top = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    a = np.where(np.abs(a) > EPS * top * 1e-3, a, EPS * top * 1e-3)
    out, first = np.zeros((n, len(lams))), 0
    for k, lam in enumerate(lams):
        if k and lams[k - 1] - lam > 1e-3 * lams[k - 1]:
            first = k
        t, near = Twisted(a, b, float(lam)), out[:, first:k]
        r = int(np.abs(t.gamma).argmin())
        z = t.vector(r)
        left = z - near @ (near.T @ z)
        if np.linalg.norm(left) < 0.5:  # much the same vector as one before
            left = np.random.default_rng(k).normal(size=n)
            for _ in range(4):
                left -= near @ (near.T @ left)
                left = t.solve(r, left / np.linalg.norm(left))
        for _ in range(2):
            left -= near @ (near.T @ left)
            left /= np.linalg.norm(left)
        out[:, k] = left
    return out


def right_vectors(r: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(sigma, V): the largest ``keep`` singular values that are not zero to
    rounding, and their right singular vectors in columns."""
    if not r.any():
        return np.zeros(0), np.zeros((r.shape[1], 0))
    a, b, v = bidiagonalise(r)
    sigma = np.sqrt(squares(a, b))
    rank = int((sigma > max(r.shape) * EPS * sigma[0]).sum()) if sigma[0] > 0 else 0
    sigma = sigma[:min(keep, rank)]
    if not len(sigma):
        return sigma, np.zeros((r.shape[1], 0))
    w = v @ vectors(a, b, sigma ** 2)
    flip = np.sign(w[np.abs(w).argmax(axis=0), np.arange(w.shape[1])])
    return sigma, w * flip
