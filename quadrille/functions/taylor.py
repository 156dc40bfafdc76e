"""Cartesian Taylor expansions of radial kernels in numpy: arrays of rows in, arrays of rows out."""

from __future__ import annotations

import math
from itertools import product

import numpy as np

from .kernels import bessel_k


class Coulomb:
    """1/r, nothing where the points coincide.  ``terms`` of a kernel: (1/r d/dr)^m of it, m = 0 .. upto, from r^2."""

    def terms(self, r2: np.ndarray, upto: int) -> list[np.ndarray]:
        inv2 = np.divide(1.0, r2, out=np.zeros_like(r2), where=r2 > 0)
        out = [np.sqrt(inv2)]
        for m in range(upto):
            out.append(-(2 * m + 1) * out[-1] * inv2)
        return out


class Log:
    """-log r, nothing where the points coincide."""

    def terms(self, r2: np.ndarray, upto: int) -> list[np.ndarray]:
        inv2 = np.divide(1.0, r2, out=np.zeros_like(r2), where=r2 > 0)
        out = [-0.5 * np.log(np.where(r2 > 0, r2, 1.0)), -inv2]
        for m in range(1, upto):
            out.append(-2 * m * out[-1] * inv2)
        return out[: upto + 1]


class Matern:
    """Matern covariance of smoothness nu and range sigma, one where the points coincide.

    R^nu K_nu(R) has the derivatives -R^(nu-1) K_(nu-1)(R) by R dR; K of half an odd number comes from its closed form by the
    recurrence, of any other order from its integral, which is slow.  Terms beyond the first need nu > 1 where points coincide.
    """

    def __init__(self, nu: float = 1.5, sigma: float = 2.0):
        self.nu, self.rate = nu, math.sqrt(2 * nu) / sigma

    def bessel(self, order: float, x: np.ndarray) -> np.ndarray:
        order = abs(order)
        if order % 1 != 0.5:
            return bessel_k(order, x)
        below = at = np.sqrt(math.pi / (2 * x)) * np.exp(-x)  # orders -1/2 and 1/2
        for k in range(int(order)):
            below, at = at, below + (2 * k + 1) / x * at
        return at

    def terms(self, r2: np.ndarray, upto: int) -> list[np.ndarray]:
        x = self.rate * np.sqrt(np.where(r2 > 0, r2, 1.0))
        scale, out = 2 ** (1 - self.nu) / math.gamma(self.nu), []
        for m in range(upto + 1):
            value = scale * (-(self.rate**2)) ** m * x ** (self.nu - m) * self.bessel(self.nu - m, x)
            none = 1.0 if m == 0 else -(self.rate**2) / (2 * (self.nu - 1)) if m == 1 and self.nu > 1 else 0.0
            out.append(np.where(r2 > 0, value, none))
        return out


class Expansion:
    """Expansions in all products of powers up to a total order, by multi-index."""

    def __init__(self, dims: int, order: int):
        self.dims, self.order = dims, order
        self.of = sorted((k for k in product(range(order + 1), repeat=dims) if sum(k) <= order), key=lambda k: (sum(k), k))
        self.at = {k: i for i, k in enumerate(self.of)}
        self.size = len(self.of)

    def less(self, k: tuple, axis: int, by: int = 1) -> tuple:
        return tuple(x - by * (a == axis) for a, x in enumerate(k))

    def powers(self, d: np.ndarray) -> np.ndarray:
        """d^k / k! of each row d, each from one before."""
        out = np.ones((len(d), self.size))
        for k in self.of[1:]:
            axis = next(a for a, x in enumerate(k) if x)
            out[:, self.at[k]] = out[:, self.at[self.less(k, axis)]] * d[:, axis] / k[axis]
        return out

    def raised(self, m: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Moments about centres that lie d behind the old ones."""
        p, out = self.powers(d), np.zeros_like(m)
        for k in self.of:
            for j in product(*[range(x + 1) for x in k]):
                out[:, self.at[k]] += m[:, self.at[tuple(a - b for a, b in zip(k, j, strict=True))]] * p[:, self.at[j]]
        return out

    def lowered(self, local: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Local expansions about centres that lie d ahead of the old ones."""
        p, out = self.powers(d), np.zeros_like(local)
        for n in self.of:
            for k in self.of:
                if (both := self.at.get(tuple(a + b for a, b in zip(n, k, strict=True)))) is not None:
                    out[:, self.at[n]] += local[:, both] * p[:, self.at[k]]
        return out

    def derivatives(self, kernel, d: np.ndarray) -> np.ndarray:
        """All derivatives of the kernel at d: a step along an axis takes d from the next radial term, and one power down."""
        terms = kernel.terms((d * d).sum(1), self.order)
        found = {(m, (0,) * self.dims): g for m, g in enumerate(terms)}
        for k in self.of[1:]:
            axis = next(a for a, x in enumerate(k) if x)
            low = self.less(k, axis)
            for m in range(self.order - sum(k) + 1):
                value = d[:, axis] * found[m + 1, low]
                if low[axis]:
                    value = value + low[axis] * found[m + 1, self.less(low, axis)]
                found[m, k] = value
        return np.stack([found[0, k] for k in self.of], 1)

    def met(self, m: np.ndarray, kernel, d: np.ndarray) -> np.ndarray:
        """Local expansions, at centres d ahead, of the fields of moments m."""
        grown, out = self.derivatives(kernel, d), np.zeros_like(m)
        for n in self.of:
            for k in self.of:
                if (both := self.at.get(tuple(a + b for a, b in zip(n, k, strict=True)))) is not None:
                    out[:, self.at[n]] += (-1) ** sum(k) * m[:, self.at[k]] * grown[:, both]
        return out

    def value(self, local: np.ndarray, d: np.ndarray) -> np.ndarray:
        """(rows, 1 + dims): the field and its gradient d off the centre of one local expansion."""
        p, out = self.powers(d), np.zeros((len(d), 1 + self.dims))
        out[:, 0] = p @ local
        for a in range(self.dims):
            for k in self.of:
                if k[a]:
                    out[:, 1 + a] += local[self.at[k]] * p[:, self.at[self.less(k, a)]]
        return out


def direct(kernel, targets: np.ndarray, sources: np.ndarray, charges: np.ndarray) -> np.ndarray:
    """(targets, 1 + dims): the field and its gradient, pair by pair."""
    d = targets[:, None, :] - sources[None, :, :]
    value, slope = kernel.terms((d * d).sum(2), 1)
    return np.concatenate([(value @ charges)[:, None], np.einsum("ij,ijk,j->ik", slope, d, charges)], 1)
