"""Student's t through the regularised incomplete beta function, for comparison."""

from math import erfc, lgamma

import numpy as np

_log_gamma = np.vectorize(lgamma, otypes=[float])
_erfc = np.vectorize(erfc, otypes=[float])
NORMAL_FROM = 1e7  # degrees of freedom from which Student's t is taken as normal (error below 1/df)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 20_000) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (modified Lentz iteration); an error
    where it does not converge."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    swap = x > (a + 1.0) / (a + b + 2.0)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    inner = np.clip(z, 1e-300, 1.0 - 1e-16)
    front = np.exp(
        _log_gamma(p + q) - _log_gamma(p) - _log_gamma(q)
        + p * np.log(inner) + q * np.log1p(-inner)
    ) / p
    tiny = 1e-300
    c = np.ones_like(inner)
    d = 1.0 - (p + q) * inner / (p + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    total = d.copy()
    for m in range(1, rounds):
        for step in (
            m * (q - m) * inner / ((p + 2 * m - 1.0) * (p + 2 * m)),
            -(p + m) * (p + q + m) * inner / ((p + 2 * m) * (p + 2 * m + 1.0)),
        ):
            d = 1.0 + step * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            total = total * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    else:
        raise ArithmeticError("the incomplete beta function did not converge")
    value = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * total))
    return np.where(swap, 1.0 - value, value)


def correlation_p(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p-value of a correlation ``r`` over ``n`` pairs; NaN for fewer than three pairs."""
    r, n = np.asarray(r, dtype=float), np.asarray(n, dtype=float)
    ok = ~np.isnan(r) & (n > 2)
    df = np.where(ok, n - 2.0, 1.0)
    rr = np.where(ok, np.clip(r, -1.0, 1.0), 0.0)
    large = df >= NORMAL_FROM
    few = np.where(large, 1.0, df)
    p = incomplete_beta(few / 2.0, np.full_like(few, 0.5), 1.0 - rr * rr)
    if large.any():
        with np.errstate(divide="ignore"):
            t = np.abs(rr) * np.sqrt(df / (1.0 - rr * rr))
        p = np.where(large, _erfc(t / np.sqrt(2.0)), p)
    return np.where(ok, p, np.nan)
