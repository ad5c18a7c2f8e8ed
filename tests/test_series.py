"""Windows, features of arrays and labels against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrova.functions import arrays
from kestrova.operators import labels, sampling
from kestrova.operators.features import CATALOG, Feature, extract_all
from kestrova.series import Staged, fracdiff, null_if_nan, smooth


def frame(spark, values, code="a"):
    return spark.createDataFrame([(code, i, v) for i, v in enumerate(values)], "code string, seq long, x double")


def column(df, name):
    return [r[0] for r in df.orderBy("seq").select(f"`{name}`").collect()]


def lempel_ziv(s):
    seen, i, n = [], 0, 1
    while i + n <= len(s):
        if s[i : i + n] in seen:
            n += 1
        else:
            seen.append(s[i : i + n])
            i, n = i + n, 1
    return len(seen) / len(s)


def kontoyiannis(s):
    s, total, n = "".join("1" if v > 0 else "0" for v in s), 0.0, len(s) // 2
    for i in range(1, n + 1):
        best = 0
        for size in range(1, i + 1):
            if any(s[j : j + size] == s[i : i + size] for j in range(i)):
                best = len(s[i : i + size])
        total += math.log2(i + 1) / (best + 1)
    return min(total / n, 1.0)


def test_entropies_of_arrays():
    rng = np.random.default_rng(0)
    for n in (4, 9, 16, 31):
        for _ in range(20):
            s = rng.choice([-1.0, 1.0], n)
            assert arrays.lempel_ziv(s) == pytest.approx(lempel_ziv(s.tolist()))
            assert arrays.kontoyiannis(s) == pytest.approx(kontoyiannis(s.tolist()))
            r = 0.2 * s.std()
            close = lambda m: sum(max(abs(s[i + k] - s[j + k]) for k in range(m)) <= r for i in range(n - m + 1) for j in range(n - m + 1) if i != j)  # noqa: B023, E731
            value = arrays.sample_entropy(s)
            assert math.isnan(value) if not close(2) else value == (math.inf if not close(3) else pytest.approx(-math.log(close(3) / close(2))))


def test_hurst():
    r = np.random.default_rng(1).normal(size=16)
    ys = []
    for p in (2, 3, 4):
        blocks = [r[k : k + 2**p] for k in range(0, 16, 2**p)]
        ys.append(np.log2(np.mean([(max(c) - min(c)) / b.std() for b in blocks for c in [np.cumsum(b - b.mean())]])))
    assert arrays.hurst(r, 4)[0] == pytest.approx(np.polyfit([2, 3, 4], ys, 1)[0])


def test_student_distribution():
    assert arrays.t_two_sided(12.706, 1) == pytest.approx(0.05, abs=1e-5)
    assert arrays.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert arrays.t_two_sided(0.0, 5) == pytest.approx(1.0)


def test_stationarity_tests():
    rng = np.random.default_rng(2)
    noise = rng.normal(size=400)
    walk = np.cumsum(noise)
    assert arrays.adf(noise)[1] < 0.01 < 0.05 < arrays.adf(walk)[1]
    assert arrays.kpss(noise)[1] > 0.05 > arrays.kpss(walk)[1]
    with pytest.raises(ValueError):
        arrays.adf(np.ones(50))
    with pytest.raises(ValueError):
        arrays.kpss(np.ones(50))


def test_ou_and_kalman():
    x = np.random.default_rng(3).normal(size=200)
    mean, theta, sigma, half = arrays.ou(x)
    slope = np.polyfit(x[:-1] - x.mean(), np.diff(x), 1)[0]
    assert theta == pytest.approx(-slope) and half == pytest.approx(math.log(2) / theta) and mean == pytest.approx(x.mean())
    assert arrays.ou(np.exp(np.linspace(0, 3, 20)))[1:] == (0.0, 0.0, 0.0)
    state, variance = arrays.kalman_ou(x, 0.5)
    assert abs(state) < 3 and variance >= 1e-8


def test_flat_short_and_null_series(spark):
    one = [Feature(k, **{p: [{"window": 5, "quantile": 0.5, "power": 3, "fastest_window": 2, "slowest_window": 3, "sub_vector_size": 2, "threshold_distance": 0.2}[p]] for p in CATALOG[k][2]}) for k in CATALOG if CATALOG[k][1] == ("x",)]
    for values in ([7.0] * 12, [1.0, 2.0], [None] * 6, [None, None, 3.0, None, 5.0, 6.0, 7.0, 8.0, 9.0], []):
        out = extract_all(frame(spark, values), one).collect()
        assert len(out) == len(values)
        if len(values) < 5:  # shorter than the window: nothing but nulls
            assert all(r[f"{k}_5_None_None_None"] is None for r in out for k in ("average", "rsi", "momentum", "shannon_entropy"))
    flat = extract_all(frame(spark, [7.0] * 12), [Feature("linear_tempReg", window=[5]), Feature("volatility", window=[5])])
    assert column(flat, "linear_tempReg_r2_5_None_None_None")[-1] == 0.0
    assert column(flat, "volatility_5_None_None_None")[-1] == 0.0


def test_grid_shares_and_names_columns(spark):
    f = Feature("average", window=[3], smoothing_method=[None, "average", "ewma"], window_smooth=[2], lambda_smooth=[0.1, 0.2])
    s = Staged()
    made = list(f.columns(s, ["x"]))
    assert len(made) == 6 and len(s.levels[0]) == 3  # a plain mean and two decays
    out = f.extract(frame(spark, [1.0, 2.0, 4.0, 8.0]))
    assert "average_3_average_2_0.1" in out.columns and "average_3_None_2_0.2" in out.columns
    with pytest.raises(ValueError):
        smooth(s, "x", "other", 3)
    with pytest.raises(ValueError):
        Feature("nothing")


def test_one_exchange_and_one_sort(spark):
    out = extract_all(frame(spark, [1.0, 2.0]), [Feature("rsi", window=[5, 10]), Feature("kama", window=[10], fastest_window=[2], slowest_window=[6])])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    physical = out._jdf.queryExecution().sparkPlan().toString()
    assert "Python" not in plan and physical.count("Exchange") <= 1


def test_fracdiff_and_nan(spark):
    s = Staged()
    x = [float(v) for v in range(1, 9)]
    got = column(s.apply(frame(spark, x), fracdiff(s, "x", 1.0, 0.01).alias("v")), "v")
    assert got[0] is None and got[3:] == pytest.approx([1.0] * 5)
    assert column(null_if_nan(frame(spark, [1.0, float("nan"), float("inf")]), "x"), "x") == [1.0, None, None]


def test_length_filter(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 1, 0, -1, None, 1, 1, 1])], "code string, seq long, label int")
    assert column(labels.length_filter(rows, "label", 2), "label") == [1, 1, 0, 0, 0, 1, 1, 1]


def test_triple_barrier_by_hand(spark):
    x = [100, 101, 99, 103, 98, 104, 97, 105, 120, 80, 81, 79, 100, 130]
    out = labels.triple_barrier(frame(spark, [float(v) for v in x]), 0.5, 0.25, 3, 3)
    a = np.array(x, float)
    r = np.concatenate([[0], a[1:] / a[:-1] - 1])
    side, want = 0, []
    for i in range(len(a)):
        vol = r[i - 2 : i + 1].std(ddof=1) * math.sqrt(3) if i >= 2 else math.nan
        up, down = a[i : i + 3].max() / a[i] - 1, a[i : i + 3].min() / a[i] - 1
        if side == 1:
            side = 1 if up > 0.5 * vol else -1 if down < -0.25 * vol else 0
        elif side == -1:
            side = -1 if down < -0.5 * vol else 1 if up > 0.25 * vol else 0
        else:
            side = 1 if up > 0.5 * vol else -1 if down < -0.5 * vol else 0
        want.append(side)
    assert column(out, "label") == want


def test_concurrency_by_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [("a", i, int(s), int(s + rng.integers(0, 6)), int(rng.integers(0, 2))) for i, s in enumerate(range(40))]
    got = {r.seq: r.concurrent for r in sampling.concurrency(spark.createDataFrame(rows, "code string, seq long, start long, end long, label int")).collect()}
    for _, i, s, e, lab in rows:
        same = [(a, b) for _, _, a, b, k in rows if k == lab]
        assert got[i] == 1 + sum(a < s <= b for a, b in same) + sum(a < e <= b for a, b in same)


def test_bars_reset_and_draws_repeat(spark):
    rows = frame(spark, [3.0, 4.0, 5.0, 1.0, 1.0, 20.0, 2.0])
    assert column(sampling.bar_ids(rows, "x", 7.0), "bar") == [0, 0, 1, 1, 1, 2, 3]
    w = rows.withColumn("sample_weight", F.col("x"))
    a, b = (sorted(r.seq for r in sampling.draw(w, 3).collect()) for _ in range(2))
    assert a == b and len(a) == 3
    assert sampling.draw(w, 20, replacement=True).count() == 20
    got = sampling.draw(w.withColumn("g", F.col("seq") % 2), 2000, by=["g"], replacement=True).groupBy("g", "seq").count().collect()
    total = {g: sum(r["count"] for r in got if r.g == g) for g in (0, 1)}
    assert total == {0: 7000, 1: 7000}
    held = {0: 3.0 + 5 + 1 + 2, 1: 4.0 + 1 + 20}
    x = [3.0, 4.0, 5.0, 1.0, 1.0, 20.0, 2.0]
    assert all(abs(r["count"] / 7000 - x[r.seq] / held[r.g]) < 0.03 for r in got)
    equal = frame(spark, [1.0] * 10).withColumn("sample_weight", F.lit(1.0))
    some = [sorted(r.seq for r in sampling.draw(equal, 10, replacement=True, seed=k).collect()) for k in range(3)]
    assert all(len(s) == 10 for s in some) and any(len(set(s)) < 10 for s in some)
    with pytest.raises(ValueError):
        labels.stack([rows, rows.withColumn("y", F.lit(1))])


def test_prices_of_zero(spark):
    x = [100.0, 101.0, 99.0, 103.0, 0.0, 0.0, 5.0, 6.0, 4.0, 7.0, 5.0, 0.0, 6.0]
    rows = frame(spark, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.array(x)
        r = np.concatenate([[0], a[1:] / a[:-1] - 1])
        r[np.isnan(r)] = 0
        side, want = 0, []
        for i in range(len(a)):
            own = r[i - 2 : i + 1]
            vol = own.std(ddof=1) * math.sqrt(3) if i >= 2 and np.isfinite(own).all() else math.nan
            up, down = ((f(a[i : i + 3]) - a[i]) / a[i] for f in (np.max, np.min))
            long, short = (up > (0.25 if side == -1 else 0.5) * vol), (down < -(0.25 if side == 1 else 0.5) * vol)
            side = (-1 if short else 1 if long else 0) if side == -1 else 1 if long else -1 if short else 0
            want.append(side)
    assert column(labels.triple_barrier(rows, 0.5, 0.25, 3, 3), "label") == want and want[5] == 1
    assert len(column(labels.look_forward(rows, 3, 1, 0.5), "label")) == len(x)
    assert column(labels.look_forward(rows, 3, 1, 0.5), "label")[4] == 0
    marked = rows.withColumn("label", F.lit(1))
    got = {r.seq: r for r in sampling.events(marked, 0.5, 3, 3).collect()}
    assert got[4].event_returns is None and got[4].end > got[4].start and 5 not in got
    assert all(r.sample_weight is None or math.isfinite(r.sample_weight) for r in sampling.sample_weights(marked, 0.5, 3, 3).collect())
    daily = spark.createDataFrame([("a", i, i, o, c, max(o, c), min(o, c)) for i, (o, c) in enumerate([(1.0, 2.0), (2.0, 0.0), (3.0, 4.0), (4.0, 5.0)])], "code string, seq long, date int, open double, close double, high double, low double")
    out = {(r.kind, r.date): r for r in sampling.decompose(daily).collect()}
    assert out["intraday", 1].close == 0 and out["overnight", 1].close is None and out["overnight", 2].open is None and out["complete", 2].close == 4.0
