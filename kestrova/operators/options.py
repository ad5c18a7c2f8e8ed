"""European options: closed form, binomial tree, implied volatility, contract chains."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrova.series import CODE, SEQ

#: Abramowitz and Stegun 26.2.17 won't do for prices; these are W. J. Cody's (1969)
#: rational approximations of erf and erfc: fixed values.
_P1 = (3.209377589138469472562e03, 3.774852376853020208137e02, 1.138641541510501556495e02, 3.161123743870565596947e00, 1.857777061846031526730e-01)
_Q1 = (2.844236833439170622273e03, 1.282616526077372275645e03, 2.440246379344441733056e02, 2.360129095234412093499e01, 1.0)
_P2 = (1.23033935479799725272e03, 2.05107837782607146532e03, 1.71204761263407058314e03, 8.81952221241769090411e02, 2.98635138197400131132e02, 6.61191906371416294775e01, 8.88314979438837594118e00, 5.64188496988670089180e-01, 2.15311535474403846343e-08)
_Q2 = (1.23033935480374942043e03, 3.43936767414372163696e03, 4.36261909014324715820e03, 3.29079923573345962678e03, 1.62138957456669018874e03, 5.37181101862009857509e02, 1.17693950891312499305e02, 1.57449261107098347253e01, 1.0)
_P3 = (6.58749161529837803157e-04, 1.60837851487422766278e-02, 1.25781726111229246204e-01, 3.60344899949804439429e-01, 3.05326634961232344035e-01, 1.63153871373020978498e-02)
_Q3 = (2.33520497626869185443e-03, 6.05183413124413191178e-02, 5.27905102951428412248e-01, 1.87295284992346725209e00, 2.56852019228982242072e00, 1.0)


def _poly(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def normal_cdf(z: Column) -> Column:
    """The normal distribution function as a column expression, to about 1e-16. z is bound
    once, by a transform of one element, as generated code would repeat it."""
    return F.transform(F.array(z), _cdf)[0]


def _cdf(z: Column) -> Column:
    return F.transform(F.array(F.abs(z) / math.sqrt(2)), lambda y: _cdf_of(z, y))[0]


def _cdf_of(z: Column, y: Column) -> Column:
    square = y * y
    inner = y * _poly(_P1, square) / _poly(_Q1, square)
    middle = F.exp(-square) * _poly(_P2, y) / _poly(_Q2, y)
    back = F.try_divide(F.lit(1.0), square)
    outer = F.exp(-square) / y * (1 / math.sqrt(math.pi) - back * _poly(_P3, back) / _poly(_Q3, back))
    upper = F.when(y <= 0.46875, 1 - inner).when(y <= 4.0, middle).when(y < 26.5, outer).otherwise(0.0) / 2
    return F.when(z > 0, 1 - upper).otherwise(upper)


def _positive(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & (c > 0)
    return out


def black_scholes(spot: Column, strike: Column, maturity: Column, rate: Column, volatility: Column) -> tuple[Column, Column, Column]:
    """(call, put, delta of the call). An input that isn't positive raises when it's computed."""
    root = volatility * F.sqrt(maturity)
    d1 = (F.log(spot / strike) + (rate + 0.5 * volatility * volatility) * maturity) / root
    paid = strike * F.exp(-rate * maturity)
    ok = _positive(spot, strike, maturity, volatility)
    wrong = F.raise_error(F.lit("option inputs must be strictly positive")).cast("double")
    guard = lambda c: F.when(ok, c).otherwise(wrong)
    return guard(spot * normal_cdf(d1) - paid * normal_cdf(d1 - root)), guard(paid * normal_cdf(root - d1) - spot * normal_cdf(-d1)), guard(normal_cdf(d1))


def binomial_tree(spot: Column, strike: Column, maturity: Column, rate: Column, volatility: Column, steps: int, up: float = 0.0, down: float = 0.0) -> tuple[Column, Column]:
    """(call, put) by backward induction over an array of payoffs."""
    dt = maturity / steps
    u = F.lit(1 + up) if up > 0 and down > 0 else F.exp(volatility * F.sqrt(dt))
    d = F.lit(1 - down) if up > 0 and down > 0 else 1 / u
    disc = F.exp(-rate * dt)
    p = (F.exp(rate * dt) - d) / (u - d)

    def value(payoff) -> Column:
        ends = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda j: F.greatest(F.lit(0.0), payoff(spot * F.pow(u, steps - j) * F.pow(d, j.cast("double")))))
        fold = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), ends, lambda v, i: F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: disc * (p * a + (1 - p) * b)))
        bad = F.raise_error(F.lit("the risk-neutral probability is out of bounds")).cast("double")
        return F.when((p > 0) & (p < 1), fold[0]).otherwise(bad)

    return value(lambda s: s - strike), value(lambda s: strike - s)


def _price(spot, strike, t, rate, vol) -> tuple[float, float]:
    if min(spot, strike, t, vol) <= 0:
        raise ValueError("option inputs must be strictly positive")
    cdf = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    root = vol * math.sqrt(t)
    d1 = (math.log(spot / strike) + (rate + 0.5 * vol * vol) * t) / root
    paid = strike * math.exp(-rate * t)
    return spot * cdf(d1) - paid * cdf(d1 - root), paid * cdf(root - d1) - spot * cdf(-d1)


def implied(spot, strike, t, rate, call, put, tolerance=1e-6, most=1000) -> tuple[float, float]:
    """(call, put) volatilities by false position. Both share one bracket: a trait of the definition."""
    low, high = 1e-5, 5.0
    (c0, p0), (c1, p1) = _price(spot, strike, t, rate, low), _price(spot, strike, t, rate, high)
    c = p = math.nan
    for _ in range(most):
        c, p = low + (call - c0) * (high - low) / (c1 - c0), low + (put - p0) * (high - low) / (p1 - p0)
        cv, pv = _price(spot, strike, t, rate, c)[0], _price(spot, strike, t, rate, p)[1]
        if abs(cv - call) < tolerance and abs(pv - put) < tolerance:
            break
        if cv < call:
            low, c0 = c, cv
        else:
            high, c1 = c, cv
        if pv < put:
            low, p0 = min(low, p), pv
        else:
            high, p1 = max(high, p), pv
    return c, p


def implied_volatility(spot: Column, strike: Column, maturity: Column, rate: Column, call: Column, put: Column, tolerance: float = 1e-6, most: int = 1000) -> Column:
    """A struct (call_vol, put_vol), batched through Arrow; null where the search fails."""

    @F.arrow_udf("struct<call_vol: double, put_vol: double>")
    def run(*columns: pa.Array) -> pa.Array:
        out = []
        for row in zip(*(c.to_pylist() for c in columns)):
            try:
                out.append(dict(zip(("call_vol", "put_vol"), implied(*row, tolerance, most))))
            except (ValueError, ZeroDivisionError, OverflowError, TypeError):
                out.append(None)
        return pa.array(out, type=pa.struct([("call_vol", pa.float64()), ("put_vol", pa.float64())]))

    return run(spot, strike, maturity, rate, call, put)


def chain(df: DataFrame, strikes: Sequence[int] = tuple(range(80, 130, 5)), maturities: Sequence[int] = (30, 60, 90, 180)) -> DataFrame:
    """``df`` with each contract of a grid: strike_pct, time_to_maturity (days) and id."""
    grid = [(k, t, f"{k}_{t}") for k in strikes for t in maturities]
    contracts = F.array(*[F.struct(F.lit(k).alias("strike_pct"), F.lit(t).alias("time_to_maturity"), F.lit(n).alias("id")) for k, t, n in grid])
    return df.withColumn("_c", F.explode(contracts)).select(*df.columns, "_c.*")


def realised_payoff(df: DataFrame, days: int, strike: Column, rate: Column, spot: str = "x") -> tuple[Column, Column]:
    """(call, put) paid ``days`` rows later, discounted; null where the series ends before."""
    later = F.lead(spot, days).over(Window.partitionBy(CODE).orderBy(SEQ))
    disc = F.exp(-rate * (days / 252))
    return F.when(later.isNotNull(), F.greatest(later - strike, F.lit(0.0)) * disc), F.when(later.isNotNull(), F.greatest(strike - later, F.lit(0.0)) * disc)


def delta(spot: Column, strike: Column, maturity: Column, rate: Column, volatility: Column) -> tuple[Column, Column]:
    call = black_scholes(spot, strike, maturity, rate, volatility)[2]
    return call, call - 1


def reference_prices(spot: np.ndarray, strike: float, t: float, rate: float, vol: float) -> np.ndarray:
    return np.array([_price(s, strike, t, rate, vol) for s in spot])
