"""Distances between vectors and series, and distance correlation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrova.series import CODE


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def _zip(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))


def distance(name: str, a: Column, b: Column, p: float = 3.0) -> Column:
    """The distance of two arrays: euclidean, manhattan, chebyshev, minkowski, hamming (share of places that differ),
    angular (1 - cosine) or jaccard (bit by bit: 1 - the sum of a & b over the sum of a | b, values as whole numbers; null without bits)."""
    gap = lambda x, y: F.abs(x - y)
    if name == "euclidean":
        return F.sqrt(_sum(_zip(a, b, lambda x, y: (x - y) * (x - y))))
    if name == "manhattan":
        return _sum(_zip(a, b, gap))
    if name == "chebyshev":
        return F.array_max(_zip(a, b, gap))
    if name == "minkowski":
        return F.pow(_sum(_zip(a, b, lambda x, y: F.pow(gap(x, y), F.lit(p)))), F.lit(1 / p))
    if name == "hamming":
        return _sum(_zip(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0))) / F.size(a)
    if name == "angular":
        dot = _sum(_zip(a, b, lambda x, y: x * y))
        return 1 - F.try_divide(dot, F.sqrt(_sum(_zip(a, a, lambda x, y: x * y))) * F.sqrt(_sum(_zip(b, b, lambda x, y: x * y))))
    if name == "jaccard":
        both, some = (F.aggregate(F.zip_with(a, b, f), F.lit(0).cast("long"), lambda x, y: x + y) for f in (lambda x, y: x.cast("long").bitwiseAND(y.cast("long")), lambda x, y: x.cast("long").bitwiseOR(y.cast("long"))))
        return 1 - F.try_divide(both.cast("double"), some.cast("double"))
    raise ValueError(f"unknown distance {name!r}")


def pearson(df: DataFrame, a: str, b: str, by: tuple[str, ...] = (CODE,)) -> DataFrame:
    return df.groupBy(*by).agg(F.corr(a, b).alias("pearson"))


def _gap_sums(x: np.ndarray) -> np.ndarray:
    """For each value the sum of its absolute differences from all."""
    order = np.argsort(x, kind="stable")
    y, n = x[order], len(x)
    before = np.cumsum(y) - y
    out = np.empty(n)
    out[order] = y * np.arange(n) - before + (before[-1] + y[-1] - before - y) - y * np.arange(n - 1, -1, -1)
    return out


def _gap_products(x: np.ndarray, y: np.ndarray) -> float:
    """The sum over all pairs of places of abs(x - x') abs(y - y'). With places by x, (x' - x)(y' - y) counts as it is
    where y rises and with the other sign where it falls. Pairs are met as in a merge sort: halves of 1, 2, 4, ...
    places, each right half against its left half, by running sums in order of y."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    n = len(x)
    by_y, total = np.argsort(y, kind="stable"), 0.0
    half = 1
    while half < n:
        place = by_y[np.argsort(by_y // (2 * half), kind="stable")]  # by block, then by y
        left = place // half % 2 == 0
        at, px, py = np.flatnonzero(~left), x[place], y[place]
        if len(at):
            first = np.searchsorted(place // (2 * half), place[at] // (2 * half))
            last = np.searchsorted(place // (2 * half), place[at] // (2 * half), side="right")

            def below_less_above(value):
                run = np.concatenate([[0.0], np.cumsum(np.where(left, value, 0.0))])
                return 2 * run[at] - run[first] - run[last]  # noqa: B023

            rx, ry = px[at], py[at]
            total += float((rx * ry * below_less_above(np.ones(n)) - ry * below_less_above(px) - rx * below_less_above(py) + below_less_above(px * py)).sum())
        half *= 2
    return 2 * total


def _distance_correlation(x: np.ndarray, y: np.ndarray) -> float | None:
    n = len(x)
    if not n:
        return None
    x, y = x - x[0], y - y[0]
    a, b = _gap_sums(x), _gap_sums(y)

    def mean(products, a, b):
        return max(products / n**2 - 2 * float((a * b).sum()) / n**3 + float(a.sum() * b.sum()) / n**4, 0.0)

    squares = [2 * n * float((v * v).sum()) - 2 * float(v.sum()) ** 2 for v in (x, y)]
    own = np.sqrt(mean(squares[0], a, a) * mean(squares[1], b, b))
    return float(np.sqrt(mean(_gap_products(x, y), a, b) / own)) if own > 0 else None


def distance_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """(code, distance_correlation) with absolute differences, over all pairs of places of a code, which are summed in
    n log(n)**2 steps by sorting, so there is no limit on a code's rows; one code's two columns are one task's.
    Rows with a null in either column don't count. Null where a column has one value only, or no row is left."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.dropna()
        return pd.DataFrame({CODE: frame[CODE].iloc[:1], "distance_correlation": [_distance_correlation(rows["a"].to_numpy(float), rows["b"].to_numpy(float))]})

    rows = df.select(CODE, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    return rows.groupBy(CODE).applyInPandas(run, f"{CODE} {rows.schema[CODE].dataType.simpleString()}, distance_correlation double")
