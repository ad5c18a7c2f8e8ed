"""Rolling features as columns: distribution, trend, entropy and spread.

    Feature("momentum", window=[5, 10], smoothing_method=[None, "ewma"], window_smooth=[3],
            lambda_smooth=[0.2]).extract(df)

Every parameter is a list; each combination is a column. All columns of a call
share one window order, so one exchange and one sort, and combinations that
differ in knobs without effect share one computation. Columns are named
``{name}_{parameters}_{method}_{window_smooth}_{lambda_smooth}``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrova.functions.arrays import adf, by_array, hurst, kalman_ou, kontoyiannis, kpss, lempel_ziv, ou, sample_entropy
from kestrova.plans.grid import canonical, universe
from kestrova.series import CODE, SEQ, TINY, Staged, smooth

Made = Iterator[tuple[str, Column]]


def _returns(s: Staged, x: str) -> str:
    return s.put(1, f"_ret{x}", F.try_divide(F.col(x), s.lag(x)) - 1)


def _diff(s: Staged, x: str) -> str:
    return s.put(1, f"_diff{x}", F.col(x) - s.lag(x))


def _signs(s: Staged, x: str) -> str:
    """+-1 for a rise or fall; a standstill goes on as before; 1 at the start."""
    d = _diff(s, x)
    held = F.last(F.nullif(F.signum(d), F.lit(0.0)), ignorenulls=True).over(s.order.rowsBetween(Window.unboundedPreceding, 0))
    return s.put(2, f"_sign{x}", F.coalesce(held, F.lit(1.0)))


# -- distribution: one column x, frames that end at the row -----------------------


def _relative(stat: Callable[[str], Column]) -> Callable:
    def make(s: Staged, x: str, window: int) -> Made:
        yield "", s.full(stat(x).over(s.T(window)), x, s.T(window), window) / (F.col(x) + TINY) - 1

    return make


def _moment(stat: Callable[[str, int], Callable[[Column], Column]]) -> Callable:
    def make(s: Staged, x: str, window: int) -> Made:
        r, frame = _returns(s, x), s.T(window)
        yield "", s.full(stat(r, window)(frame), r, frame, window)

    return make


def volatility(s: Staged, x: str, window: int) -> Made:
    """Population deviation of the returns."""
    r = _returns(s, x)
    yield "", s.full(F.stddev_pop(r).over(s.T(window)), r, s.T(window), window)


def _skew(r: str, w: int):
    return lambda frame: F.skewness(r).over(frame) * math.sqrt(w * (w - 1)) / (w - 2)


def _kurt(r: str, w: int):
    """Bias-corrected excess kurtosis, and 3 off again: a trait of the definition."""
    return lambda frame: ((w + 1) * F.kurtosis(r).over(frame) + 6) * (w - 1) / ((w - 2) * (w - 3)) - 3


def quantile(s: Staged, x: str, quantile: float, window: int) -> Made:
    r = _returns(s, x)
    yield "", s.full(F.percentile(r, quantile).over(s.T(window)), r, s.T(window), window)


# -- trend ----------------------------------------------------------------------


def momentum(s: Staged, x: str, window: int) -> Made:
    first = s.lag(x, window - 1)
    yield "", s.full(F.try_divide(F.col(x) - first, first), x, s.T(window), window)


def z_momentum(s: Staged, x: str, window: int) -> Made:
    """Momentum over the deviation of the window - 1 returns in it, scaled to its length."""
    r = _returns(s, x)
    first = s.lag(x, window - 1)
    spread = F.stddev_pop(r).over(s.T(window - 1)) * math.sqrt(window - 1)
    yield "", s.full(F.try_divide(F.col(x) - first, first) / (spread + TINY), x, s.T(window), window)


def _row(s: Staged) -> Column:
    return F.col(s.seq).cast("double")


def linear_temp_reg(s: Staged, x: str, window: int) -> Made:
    """Slope of a line over the window, as a share of the last value, and its fit (0 if flat)."""
    frame = s.T(window)
    slope = F.regr_slope(F.col(x), _row(s)).over(frame)
    fit = F.when(F.var_pop(x).over(frame) > 0, F.regr_r2(F.col(x), _row(s)).over(frame)).otherwise(0.0)
    yield "slope", s.full(slope / (F.col(x) + TINY), x, frame, window)
    yield "r2", s.full(fit, x, frame, window)


def _dot(s: Staged, x: str, weights: np.ndarray) -> Column:
    """sum of weights[k] * x, the first weight at the window's oldest row."""
    total, n = None, len(weights)
    for k, w in enumerate(weights):
        term = (s.lag(x, n - 1 - k) if k < n - 1 else F.col(x)) * float(w)
        total = term if total is None else total + term
    return total


def nonlinear_temp_reg(s: Staged, x: str, window: int) -> Made:
    """Slope at the window's start and acceleration of a parabola, as shares of the
    last value, and its fit. The design is the same for every window, so
    the coefficients are fixed weights of its values."""
    k = np.arange(window, dtype=float)
    rows = np.linalg.pinv(np.column_stack([np.ones(window), k, k * k]))
    frame = s.T(window)
    centre = np.full(window, 1 / window)
    base, slope, bend = (s.put(1, f"_par{i}{x}_{window}", _dot(s, x, w)) for i, w in enumerate(rows))
    # explained = |fitted|^2 - n mean^2, and |fitted|^2 = beta' X'y
    moments = [s.put(1, f"_mom{i}{x}_{window}", _dot(s, x, k**i)) for i in range(3)]
    square = s.put(1, f"_sq{x}_{window}", F.sum(F.col(x) * F.col(x)).over(frame))
    mean = F.col(s.put(1, f"_mean{x}_{window}", _dot(s, x, centre)))
    total = F.col(square) - window * mean * mean
    left = F.col(square) - (F.col(base) * F.col(moments[0]) + F.col(slope) * F.col(moments[1]) + F.col(bend) * F.col(moments[2]))
    yield "slope", s.full(F.col(slope) / (F.col(x) + TINY), x, frame, window)
    yield "acceleration", s.full(F.col(bend) / (F.col(x) + TINY), x, frame, window)
    yield "r2", s.full(F.when(total > 1e-12 * F.col(square), 1 - left / total).otherwise(0.0), x, frame, window)


def hurst_exponent(s: Staged, x: str, power: int) -> Made:
    """Rescaled-range exponent of the last 2**power returns, less a half; its t and p
    less their means over the last 252 rows."""
    r, n = _returns(s, x), 2**power
    values = s.put(2, f"_hv{x}_{power}", F.when(F.count(r).over(s.T(n)) == n, F.collect_list(r).over(s.T(n))))
    found = s.put(3, f"_h{x}_{power}", by_array(lambda a: hurst(a, power), "array<double>", F.col(values)))
    part = lambda k: F.col(found)[k]
    year = s.T(252)
    yield f"exponent{power}", part(0) - 0.5
    for name, k in (("tstat", 1), ("pvalue", 2)):
        own = s.put(4, f"_h{k}{x}_{power}", part(k))
        yield f"{name}_{power}", F.col(own) - s.full(F.avg(own).over(year), own, year, 252)


def kama(s: Staged, x: str, window: int, fastest_window: int, slowest_window: int) -> Made:
    """Two steps of Kaufman's adaptive average, begun two rows back."""
    n = min(slowest_window, window - 2)
    d = _diff(s, x)
    fast, slow = 2 / (fastest_window + 1), 2 / (slowest_window + 1)

    def weight(value: Column, before: Column, path: Column) -> Column:
        rate = F.abs(value - before) / (path + TINY)
        return F.pow(rate * (fast - slow) + slow, F.lit(2.0))

    size = F.abs(F.col(d))
    one = weight(s.lag(x, 1), s.lag(x, 1 + n), F.sum(size).over(s.span(-n, -1)))
    two = weight(F.col(x), s.lag(x, n), F.sum(size).over(s.span(-(n - 1), 0)))
    first = s.lag(x, 2) + one * (s.lag(x, 1) - s.lag(x, 2))
    last = first + two * (F.col(x) - first)
    yield "", s.full(last / (F.col(x) + TINY) - 1, x, s.T(window), window)


def _gains(s: Staged, x: str) -> tuple[str, str]:
    d = _diff(s, x)
    up = s.put(2, f"_up{x}", F.when(F.col(d) > 0, F.col(d)).otherwise(F.when(F.col(d).isNotNull(), 0.0)))
    down = s.put(2, f"_down{x}", F.when(F.col(d) < 0, -F.col(d)).otherwise(F.when(F.col(d).isNotNull(), 0.0)))
    return up, down


def rsi(s: Staged, x: str, window: int) -> Made:
    """Gains over gains and losses of the window - 1 steps in it, from 0 to 1."""
    up, down = _gains(s, x)
    frame = s.T(window - 1)
    rate = (F.sum(up).over(frame) / window) / (F.sum(down).over(frame) / window + TINY)
    yield "", s.full(rate / (1 + rate), x, s.T(window), window)


def stochastic_rsi(s: Staged, x: str, window: int) -> Made:
    """Where the half-window strength index stands in its range within the window."""
    half = window // 2
    up, down = _gains(s, x)

    def index(first: int, last: int) -> Column:
        rate = (F.sum(up).over(s.span(first, last)) / half) / (F.sum(down).over(s.span(first, last)) / half + TINY)
        return 100 - 100 / (1 + rate)

    own = s.put(3, f"_rsi{x}_{half}", F.when(F.count(_diff(s, x)).over(s.T(half)) == half, index(-(half - 1), 0)))
    # the window's first index sees one step less: its first step has none before it
    edge = s.put(3, f"_rsie{x}_{window}", index(-(window - 2), -(window - half)))
    inner = s.span(-(window - 1 - half), 0)
    low = F.least(F.min(own).over(inner), F.col(edge))
    high = F.greatest(F.max(own).over(inner), F.col(edge))
    yield "", s.full((F.col(own) - low) / (high - low + TINY), x, s.T(window), window)


def oscillator(s: Staged, x: str, window: int) -> Made:
    """The last value's distance from the line through the window, in its deviations."""
    frame = s.T(window)
    line = F.avg(x).over(frame) + F.regr_slope(F.col(x), _row(s)).over(frame) * ((window - 1) / 2)
    yield "", s.full((F.col(x) - line) / (F.stddev_samp(x).over(frame) + TINY), x, frame, window)


def ehlers_fisher(s: Staged, high: str, low: str, window: int) -> Made:
    """Fisher transform of the mid price's place in its range; the frame ends at the row before."""
    mid = s.put(1, f"_mid{high}{low}", (F.col(high) + F.col(low)) / 2)
    frame = s.G(window)
    top, bottom = F.max(mid).over(frame), F.min(mid).over(frame)
    place = F.try_divide(2 * (s.lag(mid) - bottom), top - bottom) - 1
    place = F.least(F.greatest(place, F.lit(-0.999)), F.lit(0.999))
    yield "", s.full(F.when(top == bottom, 0.0).otherwise(0.5 * F.log((1 + place) / (1 - place))), mid, frame, window)


def vortex(s: Staged, mid: str, high: str, low: str, window: int, strict_tr: bool = False) -> Made:
    """Movement up and down over true range, both 1 where either is over 3. The true range
    has two arms, as its definition's third never counts; ``strict_tr`` adds it."""
    before = s.lag(mid)
    up = s.put(1, f"_vp{mid}", F.abs(F.col(high) - s.lag(low)))
    down = s.put(1, f"_vm{mid}", F.abs(F.col(low) - s.lag(high)))
    arms = [F.col(high) - F.col(low), F.abs(F.col(high) - before)] + [F.abs(F.col(low) - before)] * strict_tr
    span = s.put(1, f"_tr{mid}{strict_tr}", F.when(before.isNotNull(), F.greatest(*arms)))
    frame = s.span(-(window - 1), -1)
    a, b = (F.try_divide(F.sum(c).over(frame), F.sum(span).over(frame)) for c in (up, down))
    far = (a > 3) | (b > 3)
    for name, c in (("plus", a), ("minus", b)):
        yield name, s.full(F.when(far, 1.0).otherwise(c), mid, s.G(window), window)


def vigor(s: Staged, open: str, close: str, high: str, low: str, window: int) -> Made:
    """Body over range of the row before; the window only sets the warm-up."""
    body = (F.col(close) - F.col(open)) / (F.col(high) - F.col(low) + TINY)
    own = s.put(1, f"_vig{open}", body)
    yield "", s.full(s.lag(own), own, s.G(window), window)


def stochastic_oscillator(s: Staged, mid: str, high: str, low: str, window: int) -> Made:
    frame = s.G(window)
    bottom, span = F.min(low).over(frame), F.max(high).over(frame) - F.min(low).over(frame) + TINY
    yield "fast", s.full((s.lag(mid) - bottom) / span, mid, frame, window)
    yield "slow", s.full((F.avg(mid).over(s.span(-3, -1)) - bottom) / span, mid, frame, window)


# -- entropy of the signs of movements ---------------------------------------------


def _shannon(p: Column) -> Column:
    part = lambda q: F.when(q > 0, q * F.log2(q)).otherwise(0.0)
    return -(part(p) + part(1 - p))


def _share(s: Staged, x: str, first: int, last: int) -> Column:
    sign = _signs(s, x)
    return F.avg(F.when(F.col(sign) > 0, 1.0).otherwise(0.0)).over(s.span(first, last))


def _enough(s: Staged, window: int) -> Column:
    return F.col(s.seq) >= window - 1


def shannon_entropy(s: Staged, x: str, window: int) -> Made:
    yield "", F.when(_enough(s, window), _shannon(_share(s, x, -(window - 1), 0)))


def plugin_entropy(s: Staged, x: str, window: int, word_length: int = 1) -> Made:
    """Entropy of the words of the window, without its last: a trait of the definition."""
    if word_length == 1:
        yield "", F.when(_enough(s, window), _shannon(_share(s, x, -(window - 1), -1)))
        return
    sign = _signs(s, x)
    n = window - word_length
    bits = F.transform(F.collect_list(sign).over(s.T(window)), lambda v: F.when(v > 0, "1").otherwise("0"))
    words = s.put(3, f"_words{x}_{window}_{word_length}", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.array_join(F.slice(bits, i, word_length), "")))
    count = lambda w: F.size(F.filter(F.col(words), lambda v: v == w))
    terms = F.transform(F.array_distinct(words), lambda w: count(w) / n * F.log2(count(w) / n))
    yield "", F.when(_enough(s, window), -F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / word_length)


def _of_signs(function: Callable[..., float]) -> Callable:
    def make(s: Staged, x: str, window: int, **more: float) -> Made:
        sign = _signs(s, x)
        held = s.put(3, f"_signs{x}_{window}", F.when(_enough(s, window), F.collect_list(sign).over(s.T(window))))
        yield "", by_array(lambda a: function(a, **more), "double", F.col(held))

    return make


lempel_ziv_entropy, kontoyiannis_entropy = _of_signs(lempel_ziv), _of_signs(kontoyiannis)


def sample_entropy_feature(s: Staged, x: str, sub_vector_size: int, threshold_distance: float, window: int) -> Made:
    yield from _of_signs(lambda a: sample_entropy(a, sub_vector_size, threshold_distance))(s, x, window)


# -- spread of two series; frames that end at the row before -----------------------


def _fit(s: Staged, a: str, b: str, window: int) -> tuple[Column, Column]:
    frame = s.G(window)
    return F.regr_slope(F.col(a), F.col(b)).over(frame), F.regr_intercept(F.col(a), F.col(b)).over(frame)


def _pair(s: Staged, a: str, b: str, window: int) -> tuple[str, str]:
    frame = s.G(window)
    whole = F.count(F.col(a) + F.col(b)).over(frame) == window
    return tuple(s.put(1, f"_g{c}_{window}", F.when(whole, F.collect_list(c).over(frame))) for c in (a, b))


def _residual(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    centre = b - b.mean()
    spread = (centre**2).sum()
    beta = (centre * a).sum() / spread if spread else 0.0
    return a - beta * b - (a.mean() - beta * b.mean())


def cointegration(s: Staged, a: str, b: str, window: int) -> Made:
    """Slope, intercept and last residual of a on b, and the ADF and KPSS p-values of the residuals."""
    beta, alpha = _fit(s, a, b, window)
    whole = lambda c: s.full(c, F.col(a) + F.col(b), s.G(window), window)
    yield "beta", whole(beta)
    yield "intercept", whole(alpha)
    yield "residuals", whole(s.lag(a) - beta * s.lag(b) - alpha)
    pair = _pair(s, a, b, window)
    tests = s.put(2, f"_tests{a}{b}_{window}", by_array(lambda x, y: (adf(_residual(x, y))[1], kpss(_residual(x, y))[1]), "array<double>", *map(F.col, pair)))
    yield "ADF_pvalue", F.col(tests)[0]
    yield "KPSS_pvalue", F.col(tests)[1]


def _spread(a: np.ndarray, b: np.ndarray, weights: tuple[float, float] | None) -> np.ndarray:
    return _residual(a, b) if weights is None else a - weights[0] * b - weights[1]


def ou_process(s: Staged, a: str, b: str, window: int, residuals_weights: tuple[float, float] | None = None) -> Made:
    """Mean, reversion, noise and half-life of the residual as an Ornstein-Uhlenbeck process."""
    pair = _pair(s, a, b, window)
    found = s.put(2, f"_ou{a}{b}_{window}_{residuals_weights}", by_array(lambda x, y: ou(_spread(x, y, residuals_weights)), "array<double>", *map(F.col, pair)))
    for k, name in enumerate(("mu", "theta", "sigma", "half_life")):
        yield name, F.col(found)[k]


def kalman_ou_process(s: Staged, a: str, b: str, window: int, smooth_coefficient: float, residuals_weights: tuple[float, float] | None = None) -> Made:
    pair = _pair(s, a, b, window)
    found = s.put(2, f"_kou{a}{b}_{window}_{smooth_coefficient}_{residuals_weights}", by_array(lambda x, y: kalman_ou(_spread(x, y, residuals_weights), smooth_coefficient), "array<double>", *map(F.col, pair)))
    yield "state", F.col(found)[0]
    yield "variance", F.col(found)[1]


#: name -> (function, its input columns, its own parameters in the order of the column name)
CATALOG: dict[str, tuple[Callable, tuple[str, ...], tuple[str, ...]]] = {
    "average": (_relative(F.avg), ("x",), ("window",)),
    "median": (_relative(lambda x: F.percentile(x, 0.5)), ("x",), ("window",)),
    "minimum": (_relative(F.min), ("x",), ("window",)),
    "maximum": (_relative(F.max), ("x",), ("window",)),
    "volatility": (volatility, ("x",), ("window",)),
    "skewness": (_moment(_skew), ("x",), ("window",)),
    "kurtosis": (_moment(_kurt), ("x",), ("window",)),
    "quantile": (quantile, ("x",), ("quantile", "window")),
    "momentum": (momentum, ("x",), ("window",)),
    "Z_momentum": (z_momentum, ("x",), ("window",)),
    "linear_tempReg": (linear_temp_reg, ("x",), ("window",)),
    "nonlinear_tempReg": (nonlinear_temp_reg, ("x",), ("window",)),
    "hurst": (hurst_exponent, ("x",), ("power",)),
    "kama": (kama, ("x",), ("window", "fastest_window", "slowest_window")),
    "stochastic_rsi": (stochastic_rsi, ("x",), ("window",)),
    "rsi": (rsi, ("x",), ("window",)),
    "ehlers_fisher": (ehlers_fisher, ("high", "low"), ("window",)),
    "oscillator": (oscillator, ("x",), ("window",)),
    "vortex": (vortex, ("mid", "high", "low"), ("window",)),
    "vigor": (vigor, ("open", "close", "high", "low"), ("window",)),
    "stochastic_oscillator": (stochastic_oscillator, ("mid", "high", "low"), ("window",)),
    "shannon_entropy": (shannon_entropy, ("x",), ("window",)),
    "plugin_entropy": (plugin_entropy, ("x",), ("window",)),
    "lempel_ziv_entropy": (lempel_ziv_entropy, ("x",), ("window",)),
    "kontoyiannis_entropy": (kontoyiannis_entropy, ("x",), ("window",)),
    "sample_entropy": (sample_entropy_feature, ("x",), ("sub_vector_size", "threshold_distance", "window")),
    "cointegration": (cointegration, ("s1", "s2"), ("window",)),
    "OU": (ou_process, ("s1", "s2"), ("window",)),
    "kalmanOU": (kalman_ou_process, ("s1", "s2"), ("window", "smooth_coefficient")),
}


class Feature:
    """A feature with lists of parameters; ``extract`` adds a column for each combination."""

    def __init__(self, kind: str, name: str | None = None, **params: list):
        if kind not in CATALOG:
            raise ValueError(f"unknown feature {kind!r}")
        self.kind, self.name = kind, name or kind
        self.function, self.inputs, self.own = CATALOG[kind]
        self.params: dict[str, list] = {}
        self.set_params(**params)

    def set_params(self, **params: list) -> Feature:
        self.params |= params
        return self

    def _label(self, part: str, point: dict) -> str:
        if self.kind == "kama":
            own = [f"f{point['fastest_window']}", f"s{point['slowest_window']}", point["window"]]
        else:
            own = [] if self.kind == "hurst" else [point[p] for p in self.own]
        more = [f"b{point['residuals_weights'][0]}a{point['residuals_weights'][1]}"] if point.get("residuals_weights") else []
        tail = [point.get("smoothing_method"), point.get("window_smooth"), point.get("lambda_smooth")]
        return "_".join(str(v) for v in [self.name, *([part] if part else []), *own, *more, *tail])

    def columns(self, s: Staged, inputs: Sequence[str]) -> Iterator[Column]:
        """One named column for each grid point; equal computations are staged once."""
        grid = {p: self.params[p] for p in self.own} | {p: v for p, v in self.params.items() if p not in self.own}
        grid = {k: v if v is not None else [None] for k, v in grid.items()}
        done: dict[str, list[tuple[str, Column]]] = {}
        for point in universe(grid):
            real = canonical(point)
            if str(real) not in done:
                knobs = ("smoothing_method", "window_smooth", "lambda_smooth")
                names = [smooth(s, c, *(real.get(k) for k in knobs)) for c in inputs]
                done[str(real)] = list(self.function(s, *names, **{k: v for k, v in real.items() if k not in knobs}))
            for part, column in done[str(real)]:
                yield column.alias(self._label(part, point))

    def extract(self, df: DataFrame, inputs: Sequence[str] | None = None, code: str = CODE, seq: str = SEQ) -> DataFrame:
        """``df`` with this feature's columns. A series shorter than a window gives nulls."""
        return extract_all(df, [self], inputs, code, seq)


def extract_all(df: DataFrame, features: Sequence[Feature], inputs: Sequence[str] | None = None, code: str = CODE, seq: str = SEQ, at_once: int = 60) -> DataFrame:
    """``df`` with the columns of several features, in one pass over the sorted series; at
    most ``at_once`` window columns a projection keep generated code in bounds."""
    s = Staged(code, seq)
    made = [c for f in features for c in f.columns(s, inputs or f.inputs)]
    keep = df.columns
    for level in s.levels:
        df = df.select("*", *[e.alias(n) for n, e in level.items()])
    names = list(keep)
    for k in range(0, len(made), at_once):
        before = len(df.columns)
        df = df.select("*", *made[k : k + at_once])
        names += df.columns[before:]
    return df.select(*[f"`{n}`" for n in names])
