"""Measures of classifications, regressions and returns, each one aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrova.functions.arrays import t_two_sided
from kestrova.series import CODE, SEQ

CLASSES = (-1, 0, 1)
#: Periods a year: fixed values.
YEAR = {"daily": 252, "5m": 19656, "1m": 98280}


def _ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(otherwise)


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction", classes: Sequence[int] = CLASSES, by: Sequence[str] = ()) -> DataFrame:
    """A row for each class, with the predictions of each as ``predicted_<class>``."""
    every = F.explode(F.array(*[F.lit(c) for c in classes])).alias("class")
    counted = df.groupBy(*by).agg(*[F.count_if((F.col(label) == a) & (F.col(prediction) == b)).alias(f"_{i}_{j}") for i, a in enumerate(classes) for j, b in enumerate(classes)])
    pick = lambda j: F.coalesce(*[F.when(F.col("class") == a, F.col(f"_{i}_{j}")) for i, a in enumerate(classes)]).alias(f"predicted_{str(classes[j]).replace('-', 'm')}")
    return counted.select("*", every).select(*by, "class", *[pick(j) for j in range(len(classes))])


def classification(df: DataFrame, label: str = "label", prediction: str = "prediction", classes: Sequence[int] = CLASSES, by: Sequence[str] = ()) -> DataFrame:
    """accuracy, precision, recall, f1 (all classes over 0 are positive), balanced_accuracy, mcc, cohen_kappa."""
    y, p = F.col(label), F.col(prediction)
    positive = lambda c: c.isin([v for v in classes if v > 0])
    known = y.isin(list(classes))
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if((y == p) & known).alias("hit"), F.count_if(positive(p) & positive(y)).alias("tp"), F.count_if(positive(p) & ~positive(y)).alias("fp"), F.count_if(~positive(p) & positive(y)).alias("fn"),
        *[F.count_if(y == c).alias(f"y{k}") for k, c in enumerate(classes)], *[F.count_if(p == c).alias(f"p{k}") for k, c in enumerate(classes)], *[F.count_if((y == c) & (p == c)).alias(f"h{k}") for k, c in enumerate(classes)],
    )
    ks = range(len(classes))
    n, hit = F.col("n").cast("double"), F.col("hit").cast("double")
    total = lambda f: sum((f(k) for k in ks), F.lit(0.0))
    c = lambda name: F.col(name).cast("double")
    precision, recall = _ratio(c("tp"), c("tp") + c("fp")), _ratio(c("tp"), c("tp") + c("fn"))
    both = total(lambda k: c(f"y{k}") * c(f"p{k}"))
    spread = F.sqrt((n * n - total(lambda k: c(f"p{k}") * c(f"p{k}"))) * (n * n - total(lambda k: c(f"y{k}") * c(f"y{k}"))))
    chance = both / (n * n)
    return counts.select(
        *by, _ratio(hit, n).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), _ratio(2 * precision * recall, precision + recall).alias("f1_score"),
        (total(lambda k: _ratio(c(f"h{k}"), c(f"y{k}"))) / len(classes)).alias("balanced_accuracy"), _ratio(hit * n - both, spread).alias("mcc"), _ratio(hit / n - chance, 1 - chance).alias("cohen_kappa"),
    )


def report(df: DataFrame, label: str = "label", prediction: str = "prediction", classes: Sequence[int] = CLASSES, by: Sequence[str] = ()) -> DataFrame:
    """precision, recall, f1_score and support of each class; 0 where undefined."""
    y, p, k = F.col(label), F.col(prediction), F.col("class")
    rows = df.select(*by, label, prediction, F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"))
    counts = rows.groupBy(*by, "class").agg(F.count_if((y == k) & (p == k)).alias("tp"), F.count_if(p == k).alias("said"), F.count_if(y == k).alias("support"))
    precision, recall = _ratio(F.col("tp"), F.col("said")), _ratio(F.col("tp"), F.col("support"))
    return counts.select(*by, "class", precision.alias("precision"), recall.alias("recall"), _ratio(2 * precision * recall, precision + recall).alias("f1_score"), "support")


def calibration(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, share): the numbers behind a calibration plot."""
    place = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("share"))


def roc(df: DataFrame, score: str, label: str, thresholds: int = 101) -> DataFrame:
    """(threshold, true_positive_rate, false_positive_rate, precision) on an even grid of thresholds from 0 to 1.
    A score at or over a threshold says 1; scores below 0 never do. Null scores and labels don't count."""
    y = F.col(label) == 1
    place = F.greatest(F.least(F.floor(F.col(score) * (thresholds - 1)), F.lit(thresholds - 1)), F.lit(-1)).cast("int")
    counts = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(place.alias("place")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    grid = df.sparkSession.range(-1, thresholds).select(F.col("id").cast("int").alias("place"))
    over = Window.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    rows = grid.join(F.broadcast(counts), "place", "left").na.fill(0)
    rows = rows.withColumns({"tp": F.sum("pos").over(over), "fp": F.sum("neg").over(over), "p": F.sum("pos").over(every), "n": F.sum("neg").over(every)})
    return rows.filter("place >= 0").select((F.col("place") / (thresholds - 1)).alias("threshold"), _ratio(F.col("tp"), F.col("p")).alias("true_positive_rate"), _ratio(F.col("fp"), F.col("n")).alias("false_positive_rate"), _ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0).alias("precision"))


# -- returns -------------------------------------------------------------------


def _g1(x: str) -> Column:
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def _g2(x: str) -> Column:
    n = F.count(x).cast("double")
    return F.when(n > 3, ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def distribution(df: DataFrame, returns: str = "r", frequency: str = "daily", by: Sequence[str] = (CODE,)) -> DataFrame:
    year = YEAR[frequency]
    root = year**0.5
    low = F.when(F.col(returns) < 0, F.col(returns))
    return df.groupBy(*by).agg(
        (F.avg(returns) * year).alias("expected_return"), (F.stddev_samp(returns) * root).alias("volatility"), F.when(F.coalesce(F.sum(low), F.lit(0.0)) != 0, F.stddev_samp(low) * root).otherwise(0.0).alias("downside_deviation"),
        (F.percentile(returns, 0.5) * year).alias("median_return"), _g1(returns).alias("skew"), _g2(returns).alias("kurtosis"),
    )


def risk(df: DataFrame, returns: str = "r", by: Sequence[str] = (CODE,), order: str = SEQ) -> DataFrame:
    """mean and maximum drawdown, its longest duration, and value at risk and expected shortfall at 5 %."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.filter(F.col(returns).isNotNull()).withColumn("_c", F.product(1 + F.col(returns)).over(w))
    peak = F.max("_c").over(w)
    rows = rows.withColumn("_dd", F.col("_c") / F.when(peak == 0, 1e-10).otherwise(peak) - 1)
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_dd") == 0, 1).otherwise(0)).over(w))
    below = F.sum(F.when(F.col("_dd") < 0, 1).otherwise(0)).over(Window.partitionBy(*by, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_below", below).withColumn("_var", F.percentile(returns, 0.05).over(Window.partitionBy(*by)))
    return rows.groupBy(*by).agg(F.avg("_dd").alias("mean_drawdown"), F.min("_dd").alias("maximum_drawdown"), F.max("_below").alias("max_drawdown_duration"), F.max("_var").alias("var_95"), F.avg(F.when(F.col(returns) <= F.col("_var"), F.col(returns))).alias("cvar_95"))


def market(df: DataFrame, returns: str = "r", market: str = "m", frequency: str = "daily", by: Sequence[str] = (CODE,)) -> DataFrame:
    year = YEAR[frequency]
    r, m = F.col(returns), F.col(market)
    beta = F.covar_samp(returns, market) / F.var_samp(market)
    capture = lambda on: F.try_divide(F.avg(F.when(on, r)), F.avg(F.when(on, m)))
    return df.groupBy(*by).agg(beta.alias("beta"), (F.avg(r) * year - beta * F.avg(m) * year).alias("alpha"), capture(m > 0).alias("upside_capture"), capture(m < 0).alias("downside_capture"), (F.stddev_samp(r - m) * year**0.5).alias("tracking_error"), (F.avg(m) * year).alias("market_return"))


def performance(df: DataFrame, returns: str = "r", market_returns: str = "m", risk_free: float = 0.0, frequency: str = "daily", by: Sequence[str] = (CODE,), order: str = SEQ) -> DataFrame:
    """Sharpe, Sortino, Treynor, information and Calmar ratios, 0 where undefined, with what they come from."""
    every = distribution(df, returns, frequency, by).join(risk(df, returns, by, order), list(by)).join(market(df, returns, market_returns, frequency, by), list(by))
    e = F.col("expected_return")
    return every.withColumns({
        "sharpe_ratio": _ratio(e - risk_free, F.col("volatility")), "sortino_ratio": _ratio(e, F.col("downside_deviation")), "treynor_ratio": _ratio(e, F.col("beta")),
        "information_ratio": _ratio(e - F.col("market_return"), F.col("tracking_error")), "calmar_ratio": _ratio(e, F.abs("maximum_drawdown")),
    })


# -- regressions ---------------------------------------------------------------


def regression(df: DataFrame, target: str = "y", prediction: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """rmse, mse, smape, max_error and r2 (0 for a constant target)."""
    y, p = F.col(target), F.col(prediction)
    square, gap = (y - p) * (y - p), F.abs(y - p)
    total = F.var_pop(target) * F.count(target)
    smape = F.avg(F.when(F.abs(y) + F.abs(p) != 0, gap / ((F.abs(y) + F.abs(p)) / 2)).otherwise(0.0))
    return df.groupBy(*by).agg(F.sqrt(F.avg(square)).alias("rmse"), F.avg(square).alias("mse"), smape.alias("smape"), F.max(gap).alias("max_error"), F.when(total != 0, 1 - F.sum(square) / total).otherwise(0.0).alias("r2"))


def residuals(df: DataFrame, residual: str = "e", by: Sequence[str] = (CODE,), order: str = SEQ) -> DataFrame:
    """durbin_watson; jarque_bera with its approximate p-value."""
    step = F.col(residual) - F.lag(residual).over(Window.partitionBy(*by).orderBy(order))
    rows = df.withColumn("_step", step)
    e = F.col(residual)
    n = F.count(residual).cast("double")
    jb = n / 6 * (F.pow(_g1(residual), F.lit(2.0)) + F.pow(_g2(residual), F.lit(2.0)) / 4)
    out = rows.groupBy(*by).agg(_ratio(F.sum(F.col("_step") * F.col("_step")), F.sum(e * e)).alias("durbin_watson"), jb.alias("jarque_bera"), n.alias("_n"))
    return out.withColumn("jarque_bera_p", 1 - F.pow(1 / (1 + 0.5 * F.col("jarque_bera")), F.col("_n"))).drop("_n")


def cross_products(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray]:
    """(rows, matrix of sums of products of 1 and the columns): all that a linear model needs,
    in one aggregation of the square of the number of columns."""
    terms = [F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in columns]]
    n = len(terms)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    row = df.agg(*[F.sum(terms[i] * terms[j]).alias(f"s{k}") for k, (i, j) in enumerate(pairs)]).first()
    out = np.zeros((n, n))
    for k, (i, j) in enumerate(pairs):
        out[i, j] = out[j, i] = row[k] or 0.0
    return int(out[0, 0]), out


def significance(df: DataFrame, features: Sequence[str], target: str, prediction: str, coefficients: Sequence[float]) -> list[dict]:
    """t and p of each coefficient. The variance has no intercept column and n - k degrees of freedom, as defined."""
    n, sums = cross_products(df.dropna(subset=[*features, target, prediction]), [*features, target, prediction])
    k = len(features)
    if n <= k:
        raise ValueError("there must be more rows than features")
    y, p = k + 1, k + 2
    rss = sums[y, y] - 2 * sums[y, p] + sums[p, p]
    error = np.sqrt(np.diag(max(rss, 0.0) / (n - k) * np.linalg.pinv(sums[1 : k + 1, 1 : k + 1])))
    out = []
    for name, c, e in zip(features, coefficients, error):
        t = float(c / e) if e else 0.0
        out.append({"feature": name, "coefficient": float(c), "t_stat": t, "p_value": t_two_sided(abs(t), n - k)})
    return out


def breusch_pagan(df: DataFrame, features: Sequence[str], residual: str) -> tuple[float, float]:
    """(LM, p) by the definition's formulas: half the unexplained sum of squares over the variance explained."""
    rows = df.withColumn("_sq", F.col(residual) * F.col(residual))
    n, sums = cross_products(rows, [*features, "_sq"])
    a, b, c = sums[:-1, :-1], sums[:-1, -1], sums[-1, -1]
    beta = np.linalg.solve(a, b)
    explained = beta @ a @ beta / n - (beta @ a[:, 0] / n) ** 2
    lm = float((c - 2 * beta @ b + beta @ a @ beta) / 2 / explained) if explained else 0.0
    return lm, 1 - float(np.exp(-lm / 2))


def autocorrelation(df: DataFrame, lags: int, x: str = "x") -> DataFrame:
    """(code, lag, autocorrelation): the correlation with the value ``lag`` rows before."""
    order = Window.partitionBy(CODE).orderBy(SEQ)
    rows = df.select(CODE, SEQ, x, *[F.lag(x, k).over(order).alias(f"_l{k}") for k in range(1, lags + 1)])
    one = rows.groupBy(CODE).agg(*[F.corr(x, f"_l{k}").alias(f"c{k}") for k in range(1, lags + 1)])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"c{k}").alias("autocorrelation")) for k in range(1, lags + 1)]))
    return one.select(CODE, pairs.alias("p")).select(CODE, "p.*")


def partial_autocorrelation(df: DataFrame, lags: int, x: str = "x") -> DataFrame:
    """(code, lag, partial_autocorrelation): for each k the last coefficient of a regression on the k values before,
    null where no row has them. Sums of products by code, in one aggregation, are all that is solved."""
    order = Window.partitionBy(CODE).orderBy(SEQ)
    value = F.col(x).cast("double")
    rows = df.select(CODE, SEQ, F.when(~F.isnan(value), value).alias("_l0")).select(CODE, *[F.lag("_l0", k).over(order).alias(f"_l{k}") for k in range(lags + 1)])
    sums = []
    for k in range(1, lags + 1):
        full = reduce(lambda a, b: a & b, [F.col(f"_l{i}").isNotNull() for i in range(k + 1)])
        terms = [F.lit(1.0), *[F.col(f"_l{i}") for i in range(1, k + 1)], F.col("_l0")]
        sums.append(F.array(*[F.coalesce(F.sum(F.when(full, terms[i] * terms[j])), F.lit(0.0)) for i in range(k + 2) for j in range(i, k + 2)]))
    one = rows.groupBy(CODE).agg(*[s.alias(f"s{k}") for k, s in enumerate(sums, 1)])

    def solve(batches):
        for batch in batches:
            for k in range(1, lags + 1):
                upper, found = np.triu_indices(k + 2), []
                for flat in batch.column(f"s{k}").to_pylist():
                    m = np.zeros((k + 2, k + 2))
                    m[upper] = flat
                    m.T[upper] = flat
                    found.append(float((np.linalg.pinv(m[:-1, :-1]) @ m[:-1, -1])[-1]) if m[0, 0] else None)
                yield pa.RecordBatch.from_arrays([batch.column(CODE), pa.array([k] * len(found), pa.int32()), pa.array(found, pa.float64())], names=[CODE, "lag", "partial_autocorrelation"])

    return one.mapInArrow(solve, f"{CODE} {one.schema[CODE].dataType.simpleString()}, lag int, partial_autocorrelation double")


def series_report(df: DataFrame, x: str = "x", by: Sequence[str] = (CODE,)) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(x).alias("n_values"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.percentile(x, 0.5).alias("median"), F.max(x).alias("max"), _g1(x).alias("skew"), _g2(x).alias("kurtosis"))
