"""Labels of ordered series: from the future of a price, and from another label.

Each labeller takes a DataFrame of (code, seq, x) and returns it with a column
``label``: 1, 0 or -1. Nulls in x are left out first, so positions count the rows
that have a value; ties keep the order of seq. A return from a price of zero to
another is infinite: it crosses any barrier, and windows that hold it have no volatility.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kestrova.functions.fold import fold
from kestrova.series import CODE, SEQ, Staged, relative


def _order() -> WindowSpec:
    return Window.partitionBy(CODE).orderBy(SEQ)


def _values(df: DataFrame, x: str) -> DataFrame:
    return df.filter(F.col(x).isNotNull())


def _side(score: Column, bound: float) -> Column:
    return F.when(score > bound, 1).when(score < -bound, -1).otherwise(0)


def length_filter(df: DataFrame, label: str, window: int) -> DataFrame:
    """Runs of equal labels shorter than ``window`` become 0. A null is a run of one."""
    before = F.lag(label).over(_order())
    new = F.when(F.col(label).eqNullSafe(before) & F.col(label).isNotNull(), 0).otherwise(1)
    runs = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(_order()))
    size = F.count(F.lit(1)).over(Window.partitionBy(CODE, "_run"))
    return runs.withColumn("_size", size).withColumn(label, F.when(F.col("_size") < window, 0).otherwise(F.col(label))).drop("_new", "_run", "_size")


def _returns(s: Staged, x: str) -> Column:
    """Returns from row to row: 0 at the start and from zero to zero, null from zero to another price."""
    before = s.lag(x)
    return F.when(before.isNull() | ((before == 0) & (F.col(x) == 0)), 0.0).otherwise(F.try_divide(F.col(x), before) - 1)


def naive(df: DataFrame, threshold: float, vol_window: int, x: str = "x") -> DataFrame:
    """The last return against ``threshold`` deviations of the last ``vol_window`` returns."""
    s = Staged()
    r = s.put(0, "_r", _returns(s, x))
    vol = s.full(F.stddev_samp(r).over(s.T(vol_window)), r, s.T(vol_window), vol_window)
    df = _values(df, x)
    return s.apply(df, F.coalesce(_side(F.try_divide(F.col(r), vol), threshold), F.lit(0)).alias("label"))


def triple_barrier(df: DataFrame, upper: float, lower: float, vertical: int, vol_window: int, x: str = "x") -> DataFrame:
    """Which barrier the next ``vertical`` rows cross. Barriers scale with volatility, and
    which of them count depends on the label before: an automaton of three states.
    Its next state for each state is a column, and a code's rows are folded in order."""
    s = Staged()
    r = s.put(0, "_r", _returns(s, x))
    frame = s.T(vol_window)
    vol = s.full(F.stddev_samp(r).over(frame), r, frame, vol_window) * (vol_window**0.5)
    ahead = s.A(vertical)
    up, down = (relative(f(x).over(ahead) - F.col(x), F.col(x)) for f in (F.max, F.min))
    high, low, v = s.put(1, "_up", up), s.put(1, "_dn", down), s.put(1, "_vol", vol)
    rises = lambda b: F.col(high) > b * F.col(v)
    falls = lambda b: F.col(low) < -b * F.col(v)
    states = {0: F.when(rises(upper), 1).when(falls(upper), -1), 1: F.when(rises(upper), 1).when(falls(lower), -1), -1: F.when(falls(upper), -1).when(rises(lower), 1)}
    steps = s.apply(_values(df, x), *[e.otherwise(0).alias(f"_from{k}") for k, e in states.items()])
    return fold(steps, ["_from0", "_from1", "_from-1"], "label int", lambda: 0, lambda before, a, b, c: ((now := b if before == 1 else c if before == -1 else a), (now,)), keep=df.columns)


def look_forward(df: DataFrame, window: int, min_trend: int, volatility_threshold: float, x: str = "x") -> DataFrame:
    """The return of the next ``window`` rows in its own trailing deviations; short runs become 0."""
    s = Staged()
    ahead = s.put(0, "_ahead", F.try_divide(s.lead(x, window), F.col(x)) - 1)
    vol = s.full(F.stddev_samp(ahead).over(s.T(window)), ahead, s.T(window), window)
    labelled = s.apply(_values(df, x), F.coalesce(_side(F.try_divide(F.col(ahead), vol), volatility_threshold), F.lit(0)).alias("label"))
    return length_filter(labelled, "label", min_trend)


def _horizons(horizon: int, extension: float) -> range:
    return range(horizon, round(horizon * (1 + extension)))


def _best(df: DataFrame, horizon: int, extension: float, x: str, rank) -> DataFrame:
    """Label by the sign of the slope at the horizon that ranks first, the shortest of equals, which are
    ranks less than 1e-9 a row of horizon apart: equal slopes of different horizons differ by rounding errors.
    Frames end with the series, and the last horizon - 1 rows stay 0."""
    s = Staged()
    row = F.col(SEQ).cast("double")
    left = F.count(F.lit(1)).over(s.order.rowsBetween(0, Window.unboundedFollowing))
    fits = [F.struct((rank(s.A(h), row) * 1e6 - h * 1e-3).alias("rank"), F.lit(-h).alias("h"), F.regr_slope(F.col(x), row).over(s.A(h)).alias("slope")) for h in _horizons(horizon, extension)]
    fit = s.put(0, "_fit", F.array_max(F.array(*fits)))
    many = s.put(0, "_left", left)
    return s.apply(_values(df, x), F.when(F.col(many) < horizon, 0).when(F.col(f"{fit}.rank").isNull(), 0).when(F.col(f"{fit}.slope") > 0, 1).otherwise(-1).alias("label"))


def regression_rank(df: DataFrame, horizon: int, extension: float, r2_threshold: float, min_trend: int, x: str = "x") -> DataFrame:
    """The sign of the forward line that fits best, if its r2 is over the threshold."""

    def rank(frame, row):
        fit = F.when(F.var_pop(x).over(frame) > 0, F.regr_r2(F.col(x), row).over(frame)).otherwise(0.0)
        return F.when(fit > max(r2_threshold, 0.0), fit)

    return length_filter(_best(df, horizon, extension, x, rank), "label", min_trend)


def slope(df: DataFrame, horizon: int, extension: float, min_trend: int, x: str = "x") -> DataFrame:
    """The sign of the steepest forward line; short runs take the label before them, null at the start."""

    def rank(frame, row):
        steep = F.abs(F.regr_slope(F.col(x), row).over(frame))
        return F.when(steep > 0, steep)

    kept = length_filter(_best(df, horizon, extension, x, rank), "label", min_trend)
    held = F.last(F.when(F.col("label") != 0, F.col("label")), ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumn("label", held)


def boosted(df: DataFrame, window: int, min_trend: int, volatility_threshold: float, horizon: int, extension: float, r2_threshold: float, trend_size: int, x: str = "x") -> DataFrame:
    """``look_forward`` and ``regression_rank`` together: holes between equal trends of the latter are
    bridged, and where it disagrees with the held label there is none.

    The definition adds frames whose columns don't match and yields nothing; this is
    its evident intent on single columns."""
    a = look_forward(df, window, min_trend, volatility_threshold, x).withColumnRenamed("label", "_a")
    both = regression_rank(a, horizon, extension, r2_threshold, min_trend, x).withColumnRenamed("label", "_b")
    mark = F.when(F.col("_b") != 0, F.col("_b"))
    past = F.last(mark, ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, 0))
    future = F.first(mark, ignorenulls=True).over(_order().rowsBetween(0, Window.unboundedFollowing))
    bridged = both.withColumn("_trend", F.when(past == future, past).otherwise(F.when(past.isNotNull() & future.isNotNull(), 0)))
    score = F.col("_a") * 2 + F.col("_trend")
    held = F.last(F.when(F.abs(score) != 1, F.signum(score).cast("int")), ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, 0))
    joined = bridged.withColumn("_held", held).withColumn("label", F.when(F.col("_held") * F.col("_trend") == -1, 0).otherwise(F.col("_held")))
    kept = length_filter(joined, "label", trend_size)
    after = F.lead("label").over(_order())
    return kept.withColumn("_after", after).withColumn("label", F.when(F.col("_after") == 0, 0).otherwise(F.col("label"))).select(*df.columns, "label")


def binary_meta(label: str = "label", signal: str = "signal", trade_lock: bool = False, no_zero: bool = False) -> Column:
    """1 where a signal was right. ``trade_lock`` lets no signal pass; ``no_zero``, which wins, fails it."""
    same = F.col(signal) == F.col(label)
    if no_zero:
        same = same & (F.col(signal) != 0)
    elif trade_lock:
        same = same | (F.col(signal) == 0)
    return F.when(same, 1).otherwise(0)


def trinary_meta(label: str = "label", signal: str = "signal", extension: bool = False, no_zero: bool = False) -> Column:
    """1 right, 0 missed, -1 the wrong side, in that order."""
    s, t = F.col(signal), F.col(label)
    good = (s == t) & (s != 0) if no_zero else s == t
    if extension:
        good = good | ((s == 0) & (t == 0))
    return F.when(good, 1).when((s == 0) & (t != 0), 0).when(s * t == -1, -1).otherwise(0)


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of several frames with the same columns, one after the other."""
    first, *rest = frames
    for frame in rest:
        if set(frame.columns) != set(first.columns):
            raise ValueError(f"columns differ: {sorted(set(frame.columns) ^ set(first.columns))}")
        first = first.unionByName(frame)
    return first
