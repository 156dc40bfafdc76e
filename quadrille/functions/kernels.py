"""Pair kernels: Column in, Column out."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def softened_inverse(r2: Column, eps2: float) -> Column:
    return 1 / F.sqrt(r2 + F.lit(eps2))


def coulomb(r2: Column) -> Column:
    """1/r, nothing where the points coincide."""
    return F.when(r2 > 0, 1 / F.sqrt(r2)).otherwise(F.lit(0.0))


def log_kernel(r2: Column) -> Column:
    """-log r, nothing where the points coincide."""
    return F.when(r2 > 0, -0.5 * F.log(r2)).otherwise(F.lit(0.0))


def matern_three_halves(r2: Column, sigma: float = 2.0) -> Column:
    """Matern covariance for nu = 3/2, where it has the closed form (1 + R) exp(-R)."""
    r = F.sqrt(r2) * F.lit(math.sqrt(3.0) / sigma)
    return (1 + r) * F.exp(-r)


def bessel_k(nu: float, x: np.ndarray, steps: int = 4000, upto: float = 12.0) -> np.ndarray:
    """Modified Bessel function of the second kind as the integral of exp(-x cosh t) cosh(nu t)."""
    t = np.linspace(0, upto, steps + 1)
    weight = np.full(steps + 1, upto / steps)
    weight[[0, -1]] /= 2
    return (np.exp(-np.outer(x, np.cosh(t))) * np.cosh(nu * t) * weight).sum(1)


def matern(nu: float, r: np.ndarray, sigma: float = 2.0) -> np.ndarray:
    """Matern covariance for any nu; one at no distance."""
    big = np.asarray(r, float) * math.sqrt(2 * nu) / sigma
    safe = np.maximum(big, 1e-12)
    return np.where(big < 1e-12, 1.0, safe**nu * bessel_k(nu, safe) / (2 ** (nu - 1) * math.gamma(nu)))


def sigmoid(x: Column, x0: float, k: float) -> Column:
    return 1 / (1 + F.exp(-F.lit(k) * (F.lit(x0) - x)))


def huber(residual: Column, delta: float) -> Column:
    a = F.abs(residual)
    return F.when(a <= delta, 0.5 * residual * residual).otherwise(delta * (a - 0.5 * delta))


def bessel_i(nu: float, x: np.ndarray, terms: int = 40) -> np.ndarray:
    """Modified Bessel function of the first kind by its power series."""
    half = np.asarray(x, float) / 2
    return sum(half ** (2 * m + nu) / (math.factorial(m) * math.gamma(m + nu + 1)) for m in range(terms))
