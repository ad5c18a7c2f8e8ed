"""Ordered series as DataFrames: one row a position, keyed by (code, seq).

Frames are by row count, never by time. ``T(w)`` ends at the row itself, ``G(w)``
ends at the row before it, ``A(v)`` begins at the row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CODE, SEQ = "code", "seq"
#: Keeps a divisor from being zero; a fixed value of the definitions.
TINY = 1e-8


def with_seq(df: DataFrame, code: Column | str, order: Sequence[Column | str], **columns: Column) -> DataFrame:
    """(code, seq, columns): positions from 0 in a total order within each code."""
    keyed = df.select((F.col(code) if isinstance(code, str) else code).alias(CODE), *[(F.col(o) if isinstance(o, str) else o).alias(f"_o{k}") for k, o in enumerate(order)], *[c.alias(n) for n, c in columns.items()])
    place = F.row_number().over(Window.partitionBy(CODE).orderBy(*[f"_o{k}" for k in range(len(order))])) - 1
    return keyed.withColumn(SEQ, place.cast("long")).select(CODE, SEQ, *columns)


def null_if_nan(df: DataFrame, *columns: str) -> DataFrame:
    """NaN and infinity become null: Spark's aggregates skip null but pass NaN on."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.withColumns({c: F.when(~bad(F.col(c)), F.col(c)) for c in columns})


def relative(gap: Column, base: Column) -> Column:
    """``gap`` over ``base``. From a base of zero it is infinite on the side of the gap, and null if there is no gap."""
    far = float("inf")
    return F.coalesce(F.try_divide(gap, base), F.when(gap > 0, far).when(gap < 0, -far))


def quotient(a: Column, b: Column) -> Column:
    """a / b of doubles: over zero infinite, or NaN if a is zero or NaN, where Spark's own is null."""
    a, b, far = a.cast("double"), b.cast("double"), float("inf")
    side = F.when(b.cast("string").startswith("-"), -1.0).otherwise(1.0)
    over_zero = F.when((a == 0) | F.isnan(a), float("nan")).when(a > 0, side * far).when(a < 0, -side * far)
    return F.when(b == 0, over_zero).otherwise(F.try_divide(a, b))


class Staged:
    """Columns that build on each other through windows.

    A window expression can't stand inside another, so each belongs to a level;
    equal ones are kept once. ``apply`` adds the levels one after the other, all
    with one exchange and one sort, as they share partitioning and order."""

    def __init__(self, code: str = CODE, seq: str = SEQ):
        self.order: WindowSpec = Window.partitionBy(code).orderBy(seq)
        self.code, self.seq = code, seq
        self.levels: list[dict[str, Column]] = []

    def T(self, w: int) -> WindowSpec:  # noqa: N802
        return self.order.rowsBetween(-(w - 1), 0)

    def G(self, w: int) -> WindowSpec:  # noqa: N802
        return self.order.rowsBetween(-w, -1)

    def A(self, v: int) -> WindowSpec:  # noqa: N802
        return self.order.rowsBetween(0, v - 1)

    def span(self, first: int, last: int) -> WindowSpec:
        return self.order.rowsBetween(first, last)

    def put(self, level: int, name: str, expr: Column) -> str:
        name = re.sub(r"\W", "_", name)
        while len(self.levels) <= level:
            self.levels.append({})
        self.levels[level].setdefault(name, expr)
        return name

    def lag(self, c: Column | str, n: int = 1) -> Column:
        return F.lag(c, n).over(self.order)

    def lead(self, c: Column | str, n: int = 1) -> Column:
        return F.lead(c, n).over(self.order)

    def full(self, expr: Column, c: Column | str, frame: WindowSpec, w: int) -> Column:
        """``expr`` where the frame holds w values, else null."""
        return F.when(F.count(c).over(frame) == w, expr)

    def apply(self, df: DataFrame, *last: Column, keep: Sequence[str] | None = None) -> DataFrame:
        keep = df.columns if keep is None else list(keep)
        for level in self.levels:
            df = df.select("*", *[e.alias(n) for n, e in level.items()])
        return df.select(*keep, *last)


def smooth(s: Staged, x: str, method: str | None = None, window: int | None = None, decay: float | None = None) -> str:
    """The name of a column with x smoothed: as it is (None), a plain mean
    ('average'), or a mean of ``window`` values with weights (1 - decay) ** age
    ('ewma'). Null until the window is full."""
    if method is None:
        return x
    frame = s.T(window)
    if method == "average":
        return s.put(0, f"_{x}_average_{window}", s.full(F.avg(x).over(frame), x, frame, window))
    if method == "ewma":
        weights = [(1 - decay) ** k for k in range(window)]
        return s.put(0, f"_{x}_ewma_{window}_{decay}", kernel(s, x, [w / sum(weights) for w in weights], 0))
    raise ValueError(f"unknown smoothing method {method!r}: None, 'average' or 'ewma'")


def kernel(s: Staged, x: str, weights: Sequence[float], first: int) -> Column:
    """sum of weights[k] * x at (first + k) rows before; null if one is."""
    if len(weights) <= 64:
        total = None
        for k, w in enumerate(weights):
            term = (s.lag(x, first + k) if first + k else F.col(x)) * F.lit(float(w))
            total = term if total is None else total + term
        return total
    n = len(weights)
    values = F.collect_list(x).over(s.span(-(first + n - 1), -first))
    dot = F.aggregate(F.zip_with(values, F.array(*[F.lit(float(w)) for w in reversed(weights)]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return F.when(F.size(values) == n, dot)


def fracdiff(s: Staged, x: str, d: float, floor: float = 1e-5, most: int = 1000) -> Column:
    """Fractional difference of order d over the rows before this one: weights
    w[k] = -w[k-1] * (d - k + 1) / k down to ``floor``."""
    weights = [1.0]
    while len(weights) < most:
        w = -weights[-1] * (d - len(weights) + 1) / len(weights)
        if abs(w) < floor:
            break
        weights.append(w)
    return kernel(s, x, weights, 1)
