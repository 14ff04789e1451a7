"""Distribution tails and small solvers in numpy, for use inside pandas UDFs and grouped fits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def log_beta_tail(x: np.ndarray, a: np.ndarray, b: float, rounds: int = 2000) -> np.ndarray:
    """log of the regularised incomplete beta I_x(a, b) by its continued fraction (modified Lentz)."""
    x, a = np.broadcast_arrays(np.asarray(x, float), np.asarray(a, float))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, rounds):
        for up in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + up * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + up / np.where(np.abs(c) < tiny, tiny, c)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    with np.errstate(divide="ignore", invalid="ignore"):
        front = p * np.log(z) + q * np.log1p(-z) - (_lgamma(p) + _lgamma(q) - _lgamma(p + q)) - np.log(p)
        part = front + np.log(h)
        return np.where(swap, np.log1p(-np.exp(np.minimum(part, 0))), part)


def log_t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """log of P(|T| > |t|) of Student's t; holds far below the smallest double."""
    t, df = np.abs(np.asarray(t, float)), np.asarray(df, float)
    with np.errstate(invalid="ignore", divide="ignore"):
        x = np.where(t > 1e8, df / t / t, df / (df + t * t))
        out = log_beta_tail(np.clip(x, 0, 1), df / 2, 0.5)
    return np.where(t == 0, 0.0, np.where(np.isfinite(t) & (df > 0), out, np.where(np.isinf(t), -np.inf, np.nan)))


def t_two_sided_double(t: np.ndarray, df: np.ndarray, rounds: int = 150) -> np.ndarray:
    """P(|T| > |t|) for a small tail in the steps of the SQL, whose doubles lose digits below 1e-308 and end at 0."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    p, q, x, rest = df / 2, 0.5, df / (df + t * t), t * t / (df + t * t)
    acc = np.ones_like(p)
    with np.errstate(under="ignore"):
        for m in range(rounds, 0, -1):
            odd = 1 - (p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1)) / acc
            acc = 1 + m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m)) / odd
        front = np.exp(p * np.log(x) + q * np.log(rest) + _lgamma(p + q) - _lgamma(p) - math.lgamma(q)) / p
        return front / (1 - (p + q) * x / (p + 1) / acc)


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    return _erfc(np.abs(np.asarray(z, float)) / math.sqrt(2.0))


def normal_p(z: Column | str) -> Column:
    """Two-sided p of a normal deviate; null stays null."""

    def tail(batch: pd.Series) -> pd.Series:
        out, good = np.full(len(batch), np.nan), batch.notna().to_numpy()
        out[good] = normal_two_sided(batch.to_numpy()[good])
        return pd.Series(out).where(pd.Series(good))

    return F.pandas_udf(tail, "double")(F.col(z) if isinstance(z, str) else z)


def p_text(p: Column, z: Column | None = None) -> Column:
    """A p-value as text: NA, three decimals in scientific form, or '<1e-300' where it has underflowed."""
    shown = F.when(p <= 0, F.lit("<1e-300")).otherwise(scientific(p, 3))
    return F.when(p.isNull() | F.isnan(p), F.lit("NA")).otherwise(shown)


def scientific(x: Column, digits: int) -> Column:
    """x in scientific form, rounded from its exact binary value as C's printf does (a tie goes to the even digit); null stays null."""

    def shown(batch: pd.Series) -> pd.Series:
        return batch.map(lambda v: f"{v:.{digits}e}", na_action="ignore").astype(object)

    return F.when(F.isnan(x), F.lit("nan")).otherwise(F.pandas_udf(shown, "string")(x))


def pinv_symmetric(m: np.ndarray, cut: float = 1e-12) -> tuple[np.ndarray, int]:
    """Pseudo-inverse of a symmetric matrix and its rank."""
    values, vectors = np.linalg.eigh(m)
    good = values > cut * max(values.max(initial=0.0), 1e-300)
    return (vectors[:, good] / values[good]) @ vectors[:, good].T, int(good.sum())


def fit_moments(n: float, s: np.ndarray, c: np.ndarray, names: list[str], scaled: set[str]) -> dict[str, tuple[float, float]]:
    """name -> (coefficient, p) of least squares with an intercept ('const') from centred moments.

    s: means of the columns and, last, of y; c: their centred cross products. Columns without
    variance are left out; the scaled ones are divided by their population deviation.
    Rank-deficient designs get the solution of least norm.
    """
    p = len(names)
    size = np.maximum(np.abs(s[:p]), 1.0) * 1e-9
    keep = [i for i in range(p) if c[i, i] / n > size[i] ** 2]
    mean = np.array([0.0 if names[i] in scaled else s[i] for i in keep])
    unit = np.array([math.sqrt(c[i, i] / n) if names[i] in scaled else 1.0 for i in keep])
    inner = c[np.ix_(keep, keep)] / np.outer(unit, unit)
    m = len(keep)
    xtx = np.zeros((m + 1, m + 1))
    xtx[0, 0], xtx[0, 1:], xtx[1:, 0] = n, n * mean, n * mean
    xtx[1:, 1:] = inner + n * np.outer(mean, mean)
    xty = np.concatenate([[n * s[p]], c[keep, p] / unit + n * mean * s[p]])
    inverse, rank = pinv_symmetric(xtx)
    beta = inverse @ xty
    slope = beta[1:]
    rss = c[p, p] - 2 * slope @ (c[keep, p] / unit) + slope @ inner @ slope if rank == m + 1 else c[p, p] + n * s[p] ** 2 - beta @ xty
    df = n - rank
    out = {}
    for k, name in enumerate(["const", *(names[i] for i in keep)]):
        if df > 0 and rss > 0 and inverse[k, k] > 0:
            t = beta[k] / math.sqrt(rss / df * inverse[k, k])
            out[name] = (float(beta[k]), float(np.exp(log_t_two_sided(np.array([t]), np.array([df]))[0])))
        else:
            out[name] = (float(beta[k]), math.nan)
    return out


def lstsq_fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(coefficients, covariance, residual degrees of freedom) of least squares of least norm."""
    inverse = np.linalg.pinv(x)
    beta = inverse @ y
    rank = np.linalg.matrix_rank(x)
    df = len(y) - rank
    rest = y - x @ beta
    return beta, (rest @ rest / df if df > 0 else math.nan) * (inverse @ inverse.T), df


def negative_binomial(x: np.ndarray, y: np.ndarray, alpha: float = 1.0, rounds: int = 100, tolerance: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, covariance) of a log-link negative binomial model of fixed alpha, by reweighted least squares."""
    mu = (y + y.mean()) / 2
    if not np.all(np.isfinite(mu)) or (mu <= 0).any():
        raise ValueError("the response doesn't start the fit")
    eta, deviance = np.log(mu), None
    for _ in range(rounds):
        w = mu / (1 + alpha * mu)
        z = eta + (y - mu) / mu
        root = np.sqrt(w)
        beta = np.linalg.pinv(x * root[:, None]) @ (z * root)
        eta = x @ beta
        mu = np.exp(eta)
        if not np.all(np.isfinite(mu)):
            raise ValueError("the fit diverged")
        with np.errstate(divide="ignore", invalid="ignore"):
            part = np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0.0)
        now = 2 * (part - (y + 1 / alpha) * np.log((1 + alpha * y) / (1 + alpha * mu))).sum()
        if deviance is not None and abs(now - deviance) <= tolerance * max(abs(deviance), 1e-300) + tolerance:
            deviance = now
            break
        deviance = now
    w = mu / (1 + alpha * mu)
    return beta, np.linalg.pinv((x * w[:, None]).T @ x)
