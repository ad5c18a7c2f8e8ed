"""Measures of one window as an array: plain numpy, and their Arrow wrappers."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def lempel_ziv(signs: np.ndarray) -> float:
    """Phrases of an incremental parse, each the shortest not seen before, over the length."""
    seen, text, at, size = set(), (signs > 0).astype(np.uint8).tobytes(), 0, 1
    while at + size <= len(text):
        phrase = text[at : at + size]
        if phrase in seen:
            size += 1
        else:
            seen.add(phrase)
            at, size = at + size, 1
    return len(seen) / len(text)


def kontoyiannis(signs: np.ndarray) -> float:
    """Mean of log2(i + 1) / (1 + longest match of the text at i that begins before i
    and is i long at most), for i up to half the length; 1 at most."""
    text = (signs > 0).astype(np.uint8).tobytes()
    total, n = 0.0, len(text) // 2
    for i in range(1, n + 1):
        low = 0
        # a match of some length holds matches of every shorter one
        while low < i and text.find(text[i : i + low + 1], 0, i + low) not in (-1, i) and i + low + 1 <= len(text):
            low += 1
        total += math.log2(i + 1) / (low + 1)
    return min(total / n, 1.0) if n else float("nan")


def sample_entropy(x: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    """-ln of the ratio of close pairs of (m + 1)- to m-vectors; NaN without the
    latter, infinity without the former."""
    bound = r * x.std()

    def close(size: int) -> int:
        if len(x) < size:
            return 0
        v = np.lib.stride_tricks.sliding_window_view(x, size)
        return int((np.abs(v[:, None, :] - v[None, :, :]).max(2) <= bound).sum()) - len(v)

    few, many = close(m + 1), close(m)
    return float("nan") if not many else float("inf") if not few else -math.log(few / many)


def t_two_sided(t: float, dof: int) -> float:
    """P(|T| > t) of Student's distribution, by the continued fraction of the incomplete beta function."""
    if math.isnan(t) or dof <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    return incomplete_beta(dof / 2, 0.5, dof / (dof + t * t))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function (Lentz's algorithm)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    out = d
    for m in range(1, 300):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + n * d, 1 + n / c
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = c if abs(c) > 1e-300 else 1e-300
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out / a


def hurst(r: np.ndarray, power: int) -> tuple[float, float, float]:
    """(slope, t, p) of log2 of the mean rescaled range on p = 2 .. power, over blocks of 2**p returns."""
    ps = np.arange(2, power + 1)
    y = []
    for p in ps:
        blocks = r.reshape(-1, 2**p)
        sums = np.cumsum(blocks - blocks.mean(1, keepdims=True), axis=1)
        y.append(np.log2(((sums.max(1) - sums.min(1)) / blocks.std(1)).mean()))
    y = np.array(y)
    centre = ps - ps.mean()
    slope = (centre * y).sum() / (centre**2).sum()
    left = y - (y.mean() + slope * centre)
    # the design has no intercept column in this variance: a fixed trait of the definition
    error = math.sqrt((left**2).sum() / (len(ps) - 1) / (ps.astype(float) ** 2).sum()) if len(ps) > 1 else 0.0
    t = slope / error if error else 0.0
    return slope, t, t_two_sided(abs(t), len(ps) - 1)


def ou(x: np.ndarray) -> tuple[float, float, float, float]:
    """(mean, theta, sigma, half-life) of an Ornstein-Uhlenbeck process: the
    differences regressed on the deviations; zeros unless it reverts."""
    mean = x.mean()
    dev, diff = x[:-1] - mean, np.diff(x)
    centre = dev - dev.mean()
    spread = (centre**2).sum()
    slope = (centre * diff).sum() / spread if spread else 0.0
    left = diff - diff.mean() - slope * centre
    theta = -slope
    if theta <= 0:
        return mean, 0.0, 0.0, 0.0
    return mean, theta, math.sqrt(left.var() * 2 * theta), math.log(2) / theta


def kalman_ou(x: np.ndarray, coefficient: float) -> tuple[float, float]:
    """The last state and variance of a scalar Kalman filter with OU transition."""
    mean, theta, sigma, _ = ou(x)
    theta = max(theta, 1e-4)
    noise = sigma * coefficient
    state, variance = mean, max(noise**2 / (2 * theta), 1e-8)
    for v in x.tolist():
        gain = variance / (variance + sigma**2)
        state = mean + (1 - theta) * (state + gain * (v - state) - mean)
        variance = max((1 - theta) ** 2 * (1 - gain) * variance + noise**2, 1e-8)
    return state, variance


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ y
    left = y - x @ beta
    return beta, inverse, float(left @ left)


#: MacKinnon (1994, 2010) response surface for the ADF test with a constant: fixed values.
_ADF_SMALL = (2.1659, 1.4412, 0.038269)
_ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
_ADF_STAR, _ADF_MIN, _ADF_MAX = -1.61, -18.83, 2.74
#: Kwiatkowski et al. (1992) critical values of the level test: fixed values.
_KPSS = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))


def adf(x: np.ndarray) -> tuple[float, float]:
    """(statistic, p) of the augmented Dickey-Fuller test with a constant; the lag
    has the least AIC up to 12 * (n / 100) ** 0.25. Raises ValueError if x is too short or constant."""
    n = len(x)
    if n < 4 or x.max() == x.min():
        raise ValueError("the series is too short or constant")
    top = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    if top < 0:
        raise ValueError("the series is too short")
    d = np.diff(x)

    def design(lags: int, skip: int):
        rows = np.arange(skip, len(d))
        return np.column_stack([np.ones(len(rows)), x[rows], *[d[rows - k] for k in range(1, lags + 1)]]), d[rows]

    best = None
    for lags in range(top + 1):
        a, b = design(lags, top)
        rss = _ols(a, b)[2]
        aic = len(b) * (math.log(2 * math.pi) + math.log(max(rss, 1e-300) / len(b)) + 1) + 2 * a.shape[1]
        if best is None or aic < best[0]:
            best = (aic, lags)
    a, b = design(best[1], best[1])
    beta, inverse, rss = _ols(a, b)
    stat = beta[1] / math.sqrt(rss / max(len(b) - a.shape[1], 1) * inverse[1, 1])
    if stat > _ADF_MAX:
        return stat, 1.0
    if stat < _ADF_MIN:
        return stat, 0.0
    z = sum(c * stat**k for k, c in enumerate(_ADF_SMALL if stat <= _ADF_STAR else _ADF_LARGE))
    return stat, 0.5 * math.erfc(-z / math.sqrt(2))


def kpss(x: np.ndarray) -> tuple[float, float]:
    """(statistic, p) of the KPSS level test, lags by Hobijn et al. (1998); p is
    interpolated between its critical values and held at 0.01 and 0.1."""
    n = len(x)
    left = x - x.mean()
    s0 = float(left @ left) / n
    if n < 3 or s0 == 0:
        raise ValueError("the series is too short or constant")
    m = int(n ** (2 / 9))
    a, b = s0, 0.0
    for k in range(1, m + 1):
        c = 2 * float(left[k:] @ left[: n - k]) / n
        a, b = a + c, b + k * c
    lags = min(int(1.1447 * ((b / a) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    var = s0 + sum(2 * (1 - k / (lags + 1)) * float(left[k:] @ left[: n - k]) / n for k in range(1, lags + 1))
    stat = float((np.cumsum(left) ** 2).sum()) / n**2 / var
    return stat, float(np.interp(stat, [c for c, _ in _KPSS], [p for _, p in _KPSS]))


def by_array(function: Callable, kind: str, *columns: Column) -> Column:
    """``function`` of each row's arrays (any null or error gives null), batched through Arrow."""

    @F.arrow_udf(kind)
    def run(*arrays: pa.Array) -> pa.Array:
        out, known = [], {}
        for row in zip(*(a.to_pylist() for a in arrays)):
            if any(v is None for v in row):
                out.append(None)
                continue
            key = tuple(map(tuple, row))
            if key not in known:
                try:
                    value = function(*(np.array(v, dtype=float) for v in row))
                    known[key] = [None if isinstance(v, float) and math.isnan(v) else float(v) for v in value] if isinstance(value, tuple) else None if math.isnan(value) else float(value)
                except (ValueError, ZeroDivisionError, FloatingPointError):
                    known[key] = None
            out.append(known[key])
        if kind == "double":
            return pa.array(out, type=pa.float64())
        return pa.array(out, type=pa.list_(pa.float64()))

    return run(*columns)
