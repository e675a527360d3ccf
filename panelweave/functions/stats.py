"""Scalar statistics as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0, by the polynomial 26.2.17 of Abramowitz and Stegun."""
    # Its coefficients.
    k = 1 / (1 + 0.2316419 * z)
    poly = k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    return 0.3989422804014327 * F.exp(-z * z / 2) * poly


def upper_tail(z: Column) -> Column:
    return F.when(z >= 0, normal_tail(F.abs(z))).otherwise(1 - normal_tail(F.abs(z)))


def effect_label(rho: Column) -> Column:
    a = F.abs(rho)
    return F.when(rho.isNull(), None).when(a >= 0.40, "moderate-strong").when(a >= 0.25, "moderate").when(a >= 0.10, "weak").otherwise("negligible")


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; null where either side is constant."""
    return F.when((F.stddev_pop(x) > 1e-12) & (F.stddev_pop(y) > 1e-12), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def sample_skew(x: Column) -> Column:
    """Skewness adjusted for bias; null for fewer than three rows or a constant."""
    n = F.count(x).cast("double")
    m2 = F.var_pop(x)
    return F.when((n > 2) & (m2 > 1e-20), F.skewness(x) * F.sqrt(F.greatest(n * (n - 1), F.lit(0.0))) / F.nullif(n - 2, F.lit(0.0)))


def draw(n: Column, *keys: Column) -> Column:
    """A whole number in 0 .. n - 1 from an md5 of the keys: the same in any engine and any run."""
    digits = F.substring(F.md5(F.concat_ws("|", *(k.cast("string") for k in keys))), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), n)


def student_p(t: np.ndarray, df: np.ndarray, steps: int = 4000) -> np.ndarray:
    """Two-sided p of Student's t, for the few rows of a result: the density's integral over an angle, by Simpson's rule.

    With t = sqrt(df) tan(a) the density is proportional to cos(a) ** (df - 1), over 0 .. pi / 2.
    """
    t, df = np.abs(np.atleast_1d(np.asarray(t, dtype=float))), np.atleast_1d(np.asarray(df, dtype=float))
    weights = np.ones(steps + 1)
    weights[1:-1:2], weights[2:-1:2] = 4, 2

    def area(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        # where df is large, all of the density lies near 0
        high = np.minimum(high, np.maximum(low, 40 / np.sqrt(np.maximum(df, 1))))
        a = low[:, None] + (high - low)[:, None] * np.linspace(0, 1, steps + 1)
        return (np.maximum(np.cos(a), 0) ** (df[:, None] - 1) * weights).sum(1) * (high - low) / steps / 3

    angle = np.arctan(t / np.sqrt(df))
    half = np.full_like(angle, np.pi / 2)
    with np.errstate(invalid="ignore"):
        return np.where(df > 0, np.clip(area(angle, half) / area(np.zeros_like(angle), half), 0, 1), np.nan)


def normal_p(z: np.ndarray) -> np.ndarray:
    """Two-sided p of a standard normal."""
    return np.array([math.erfc(abs(x) / math.sqrt(2)) if x == x else math.nan for x in np.atleast_1d(z)])
