"""Models, quality, backtest, options, simulation, sources, plans and streams."""

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrova.functions.arrays import adf
from kestrova.operators import backtest, codependence, metrics, options, quality, simulate, strategy
from kestrova.operators.models import Classifier, LinearModel, SequenceTree, grid_search, impurity
from kestrova.plans import grid
from kestrova.sources import market
from kestrova.streaming import ops


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    y = 2 + 1.5 * x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=300) * 0.1
    label = np.sign(np.round(x[:, 0]))
    return spark.createDataFrame([("a", i, float(a), float(b), float(c), int(k)) for i, ((a, b), c, k) in enumerate(zip(x, y, label))], "code string, seq long, a double, b double, y double, label int")


def test_least_squares_and_descent(rows):
    p = rows.toPandas()
    x = np.column_stack([np.ones(len(p)), p.a, p.b])
    exact = np.linalg.lstsq(x, p.y, rcond=None)[0]
    m = LinearModel().fit(rows, ["a", "b"], "y")
    assert [m.intercept, *m.coefficients] == pytest.approx(exact.tolist())
    d = LinearModel("mse", epochs=200).fit(rows, ["a", "b"], "y")
    beta, rate, last = np.zeros(3), 0.01, math.inf
    for _ in range(200):
        e = x @ beta - p.y
        loss = (e @ e) / len(p)
        rate *= 0.5 if loss > last else 1.05
        if last != math.inf and abs(loss - last) < 1e-5:
            break
        last = loss
        beta = beta - rate * 2 / len(p) * (x.T @ e)
    assert [d.intercept, *d.coefficients] == pytest.approx(beta.tolist(), rel=1e-6)
    size = lambda **k: np.abs(LinearModel("ridge", l2=0.1, epochs=60, **k).fit(rows, ["a", "b"], "y").coefficients).sum()
    assert size(sign="standard") < np.abs(d.coefficients).sum() < size(sign="reference")
    predicted = m.predict(rows)
    t = metrics.significance(predicted, ["a", "b"], "y", "prediction", m.coefficients)
    assert t[0]["t_stat"] > 50 and t[0]["p_value"] < 1e-6
    with pytest.raises(ValueError):
        LinearModel("other")


def test_classifiers_abstain_and_search(rows):
    tree = Classifier("tree", maxDepth=3).fit(rows, ["a", "b"])
    out = tree.predict(rows)
    assert metrics.classification(out).first().accuracy > 0.95
    assert tree.importances()[0][0] == "a"
    sure = Classifier("tree", maxDepth=1, min_proba=0.99).fit(rows, ["a", "b"]).predict(rows)
    assert sure.filter("prediction = 0").count() > out.filter("prediction = 0").count()
    best, score, every = grid_search(rows, ["a", "b"], "tree", {"maxDepth": [1, 3]})
    assert best == {"maxDepth": 3} and len(every) == 2 and score > 0.8


def test_plot_numbers(rows):
    scored = rows.select(F.when(F.col("label") == 1, 0.9).otherwise(0.2).alias("p"), (F.col("label") == 1).cast("int").alias("y"))
    at = {round(r.threshold, 2): r for r in metrics.roc(scored, "p", "y").collect()}
    assert (at[0.5].true_positive_rate, at[0.5].false_positive_rate, at[0.5].precision) == (1.0, 0.0, 1.0) and at[0.0].false_positive_rate == 1.0
    assert [(r.bin, r.share) for r in metrics.calibration(scored, "p", "y").orderBy("bin").collect()] == [(2, 0.0), (9, 1.0)]


def test_sequence_tree(rows):
    for criterion in ("gini", "shannon", "plugin"):
        t = SequenceTree(criterion, 3).fit(rows.limit(60), ["a", "b"])
        assert t.importances()["a"] > 0.5
    assert impurity(np.array([1, 1, -1, -1]), "gini") == 0.5
    with pytest.raises(ValueError):
        impurity(np.array([1]), "other")


def test_quality(spark, rows):
    wide = rows.withColumns({"copy": F.col("a") * 2, "flat": F.lit(1.0), "big": F.col("a") + 100})
    assert quality.correlated(wide, ["a", "b", "copy"]) == ["copy"]
    assert set(quality.unusable(wide, ["a", "flat", "big"])) == {"flat", "big"}
    s = quality.Sanitizer(["a", "flat"]).fit(wide)
    got = s.extract_new(wide).agg(F.avg("a"), F.stddev("a")).first()
    assert s.features == ["a"] and got[0] == pytest.approx(0, abs=1e-9) and got[1] == pytest.approx(1)
    assert quality.stationarity(rows, ["a"]).first().is_adf_stationary == (adf(np.array([r.a for r in rows.orderBy("seq").collect()]))[1] < 0.05)


def ledger(spark, signal, size, price=None):
    n = len(signal)
    price = price or [100.0 + i for i in range(n)]
    data = [("a", i, s, float(z), 0.5, date(2020, 1, 1 + i), p + 0.5, p - 0.5) for i, (s, z, p) in enumerate(zip(signal, size, price))]
    return spark.createDataFrame(data, "code string, seq long, signal int, size double, portfolio_weight double, date date, ask_open double, bid_open double")


def test_ledger_by_hand(spark):
    s = ledger(spark, [1, 1, 1, -1, -1, 0, 0], [1, 2, 1, 1, 1, 0, 0])
    ops_ = [tuple(r) for r in backtest.operations(s).orderBy("seq", "part").select("seq", "side", "size", "size_op", "entry_price", "exit_price", "unit_pnl").collect()]
    assert ops_ == [
        (1, 1, 1.0, 1.0, 101.5, None, 0.0), (2, 1, 2.0, 1.0, 102.5, None, 0.0), (3, 1, 1.0, -1.0, 102.0, 102.5, 0.5),
        (4, 1, 1.0, -1.0, 102.0, 103.5, 1.5), (4, -1, 1.0, 1.0, 103.5, None, 0.0), (6, -1, 1.0, -1.0, 103.5, 106.5, -3.0),
    ]
    with pytest.raises(ValueError):
        backtest.operations(s.drop("size"))


def test_ledger_skips_rows_without_prices(spark):
    kind = "code string, seq long, date date, signal int, size double, ask_open double, bid_open double, portfolio_weight double"
    prices = [(10.0, 9.0), (None, 9.0), (12.0, 11.0), (14.0, None), (15.0, 14.0)]
    rows = [("x", i, date(2024, 1, 1 + i), 1 if i < 4 else 0, 1.0, ask, bid, 1.0) for i, (ask, bid) in enumerate(prices)]
    got = [tuple(r) for r in backtest.operations(spark.createDataFrame(rows, kind)).orderBy("seq").select("seq", "entry_price", "exit_price").collect()]
    assert got == [(2, 12.0, None), (4, 12.0, 14.0)]
    open_ = backtest.operations(spark.createDataFrame(rows[:4], kind)).select("seq").collect()
    assert [r.seq for r in open_] == [2]


def test_ledger_conserves_quantity(spark):
    rng = np.random.default_rng(5)
    n = 28
    s = ledger(spark, rng.integers(-1, 2, n).tolist(), rng.integers(1, 4, n).tolist(), (100 + rng.normal(size=n).cumsum()).tolist())
    ops_, days = backtest.run_backtest(s, slippage=0.001, brokerage=0.001)
    left = ops_.groupBy("trade_id").agg(F.sum("size_op").alias("s")).collect()
    assert left and all(abs(r.s) < 1e-9 for r in left)
    total = 1.0
    for r in days.orderBy("date").collect():
        total *= 1 + r.daily_returns
        assert r.cumulative_returns == pytest.approx(total)


def test_options(spark):
    df = spark.range(40).select((F.col("id") * 0.5 - 10).alias("z"))
    for r in df.select("z", options.normal_cdf(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(0.5 * math.erfc(-r.z / math.sqrt(2)), rel=1e-12, abs=1e-300)
    one = spark.range(1)
    lit = [F.lit(v) for v in (100.0, 105.0, 0.5, 0.03, 0.25)]
    call, put, _ = one.select(*options.black_scholes(*lit)).first()
    assert (call, put) == pytest.approx(options.reference_prices(np.array([100.0]), 105.0, 0.5, 0.03, 0.25)[0].tolist())
    assert call - put == pytest.approx(100 - 105 * math.exp(-0.015))
    tree = one.select(*options.binomial_tree(*lit, 200)).first()
    assert tuple(tree) == pytest.approx((call, put), abs=0.05)
    assert options.implied(100, 105, 0.5, 0.03, call, put) == pytest.approx((0.25, 0.25), abs=1e-4)
    with pytest.raises(Exception, match="positive"):
        one.select(options.black_scholes(F.lit(-1.0), *lit[1:])[0]).collect()


def test_simulations(spark):
    ends = [r.x for r in simulate.wiener(spark, 400, 50).filter("seq = 49").collect()]
    assert abs(np.mean(ends)) < 0.15 and np.std(ends) == pytest.approx(1, abs=0.12)
    same = simulate.wiener(spark, 3, 10).repartition(7).orderBy("code", "seq").collect()
    assert same == simulate.wiener(spark, 3, 10).orderBy("code", "seq").collect()
    pair = simulate.correlated_geometric(spark, [[1, 0.8], [0.8, 1]], 2000, [100, 100], [0, 0], [0.2, 0.2]).groupBy("seq").pivot("code", [0, 1]).agg(F.first("x")).orderBy("seq").toPandas()
    moves = np.diff(np.log(pair[["0", "1"]].to_numpy()), axis=0)
    assert np.corrcoef(moves.T)[0, 1] == pytest.approx(0.8, abs=0.05)
    assert simulate.power_law(spark, 5, 100).agg(F.min("x")).first()[0] >= 1
    assert simulate.fractional(spark, 3, 20).count() == 60
    last = simulate.ornstein_uhlenbeck(spark, 200, 200, start=5.0, theta=10.0).filter("seq = 199").agg(F.avg("x")).first()[0]
    assert abs(last) < 0.2


def test_market_files(spark, tmp_path):
    head = "date,open,high,low,close,volume\n"
    for folder, price in (("NYSE", 1), ("ETFs", 2)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "AA.csv").write_text(f"{head}2020-01-01,{price},1,1,{price},1\n2020-01-02,,1,1,1,1\n")
    (tmp_path / "Rates").mkdir()
    (tmp_path / "Rates" / "ZT=F.csv").write_text(f"{head}2020-01-01,9,9,9,9,9\n")
    got = market.ordered(market.load(spark, str(tmp_path))).orderBy("code", "seq").collect()
    assert [(r.code, r.seq, r.open) for r in got] == [("AA", 0, 1.0), ("AA", 1, None), ("ZT=F", 0, 9.0)]
    assert market.load(spark, str(tmp_path), ["ZT=F"]).count() == 1
    with pytest.raises(FileNotFoundError):
        market.load(spark, str(tmp_path), ["BB"])


def test_plans():
    assert grid.universe({"a": [1, 2], "b": [3]}) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]
    assert len(grid.random_universe({"a": list(range(9))}, 4, seed=1)) == 4
    spans = grid.walk_forward(date(2010, 1, 31), date(2016, 1, 1), "4Y", "6M")
    assert spans[0] == (date(2010, 1, 31), date(2014, 1, 31), date(2014, 1, 31), date(2014, 7, 31)) and spans[-1][3] <= date(2016, 1, 1)
    with pytest.raises(ValueError):
        grid.months("4D")


def test_distances(spark):
    a, b = [1.0, 2.0, 2.0], [1.0, 0.0, 3.0]
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    got = {n: df.select(codependence.distance(n, F.col("a"), F.col("b"))).first()[0] for n in ("euclidean", "manhattan", "chebyshev", "hamming", "angular", "jaccard", "minkowski")}
    assert got == pytest.approx({"euclidean": math.sqrt(5), "manhattan": 3, "chebyshev": 2, "hamming": 2 / 3, "angular": 1 - 7 / (3 * math.sqrt(10)), "jaccard": 0.5, "minkowski": 9 ** (1 / 3)})


def test_strategy(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 2.0, 1.5, 3.0])], "code string, seq long, x double")
    assert [r.signal for r in strategy.momentum_signal(df, 1).orderBy("seq").collect()] == [0, 1, -1, 1]
    with pytest.raises(ValueError):
        strategy.check_signals(df)


def test_streams_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(int(u), i, int(s)) for i, (u, s) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(-1, 2, 60)))], "code long, seq long, signal int")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ops.confirm(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 1)
    q = stream.writeStream.format("memory").queryName("confirmed").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.code, r.seq): r.confirmed for r in spark.table("confirmed").collect()}
    assert got == {(r.code, r.seq): r.confirmed for r in backtest.confirm(rows, 1).collect()}


def test_partial_autocorrelation_of_all_codes(spark, small):
    from kestrova.queries import QUERIES, bars

    got = {(r.code, r.lag): r.partial_autocorrelation for r in QUERIES["partial_autocorrelation"](spark, small).collect()}
    rows = bars(spark, small).select("code", "seq", "x").toPandas()
    assert {c for c, _ in got} == set(rows.code) and len(got) == 4 * rows.code.nunique() > 4
    for code, own in rows.sort_values("seq").groupby("code"):
        x = own.x.to_numpy(float)
        for k in range(1, 5):
            past = np.stack([np.ones(len(x) - k), *[x[k - i : len(x) - i] for i in range(1, k + 1)]], axis=1)
            assert got[code, k] == pytest.approx(np.linalg.lstsq(past, x[k:], rcond=None)[0][-1], abs=1e-6)


def test_partial_autocorrelation_of_short_codes(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 1.0), ("b", 1, 2.0), ("b", 2, None)], "code string, seq long, x double")
    got = {(r.code, r.lag): r.partial_autocorrelation for r in metrics.partial_autocorrelation(df, 2).collect()}
    assert got[("a", 1)] is got[("a", 2)] is got[("b", 2)] is None and math.isfinite(got[("b", 1)])


def test_open_to_close_learns_from_balanced_draws(spark, small, monkeypatch):
    from kestrova import queries
    from kestrova.plans import directional

    searched, fitted = [], []
    search, fit = directional.grid_search, Classifier.fit
    monkeypatch.setattr(directional, "grid_search", lambda rows, chosen, kind, grid, **k: searched.append(search(rows, chosen, kind, {n: v[:2] for n, v in list(grid.items())[:1]}, **k)) or searched[-1])
    monkeypatch.setattr(Classifier, "fit", lambda self, rows, *a, **k: fitted.append(rows.select("code", "seq", "label").toPandas()) or fit(self, rows, *a, **k))
    out = queries.QUERIES["directional_open_to_close"](spark, small)
    learnt = fitted[-1]
    counts = learnt.label.value_counts()
    assert len(searched) == 1 and len(searched[0][2]) > 1
    assert len(counts) == 3 and counts.max() < 1.15 * counts.min()
    assert learnt.duplicated(["code", "seq"]).any() and out.count() > 0


def test_distance_correlation_of_all_pairs(spark):
    rng = np.random.default_rng(3)

    def plain(x, y):
        u, v = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
        u, v = (m - m.mean(0) - m.mean(1)[:, None] + m.mean() for m in (u, v))
        return np.sqrt((u * v).mean() / np.sqrt((u * u).mean() * (v * v).mean()))

    x = rng.normal(size=2500).round(1)
    y = {"square": x * x, "ties": rng.integers(0, 3, 2500).astype(float), "free": rng.normal(size=2500)}
    rows = [(k, i, float(a), float(b)) for k, v in y.items() for i, (a, b) in enumerate(zip(x, v))]
    rows += [("flat", i, 2.0, float(i)) for i in range(4)] + [("free", 9999, None, 5.0), ("null", 0, None, 1.0)]
    got = {r.code: r.distance_correlation for r in codependence.distance_correlation(spark.createDataFrame(rows, "code string, seq long, a double, b double"), "a", "b").collect()}
    for k, v in y.items():
        assert got[k] == pytest.approx(plain(x, v), abs=1e-9)
    assert got["flat"] is None and got["null"] is None and len(got) == 5
    assert codependence.distance_correlation(spark.createDataFrame([], "code string, seq long, a double, b double"), "a", "b").count() == 0


def test_roc_counts_scores_beyond_its_grid(spark):
    rows = [(-0.5, 1), (1.7, 1), (0.5, 0), (0.5, 1), (None, 1), (0.5, None)]
    at = {round(r.threshold, 2): r for r in metrics.roc(spark.createDataFrame(rows, "p double, y int"), "p", "y").collect()}
    assert (at[1.0].true_positive_rate, at[1.0].precision) == (pytest.approx(1 / 3), 1.0)
    assert (at[0.0].true_positive_rate, at[0.0].false_positive_rate, at[0.0].precision) == (pytest.approx(2 / 3), 1.0, pytest.approx(2 / 3))
