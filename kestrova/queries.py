"""Queries over the driver's tables, one an operator, and the DuckDB SQL for their results."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrova.operators import backtest, codependence, labels, metrics, options, quality, sampling, simulate, strategy
from kestrova.operators.features import CATALOG, Feature, extract_all
from kestrova.operators.models import Classifier, LinearModel
from kestrova.plans.directional import OpenToClose
from kestrova.series import CODE, SEQ, Staged, fracdiff, smooth, with_seq
from kestrova.sources.market import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return add


# -- the series ----------------------------------------------------------------


def ticks(spark: SparkSession, d: str) -> DataFrame:
    return with_seq(table(spark, d, "events"), "user_id", ["ts"], x=F.col("value"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("date", F.to_date("o_orderdate"))
    day = o.groupBy(F.col("o_orderpriority").alias(CODE), "date").agg(F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max_by("o_totalprice", "o_orderkey").alias("close"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.count(F.lit(1)).alias("volume"))
    return day.withColumn(SEQ, (F.row_number().over(Window.partitionBy(CODE).orderBy("date")) - 1).cast("long"))


def bars(spark: SparkSession, d: str) -> DataFrame:
    return with_seq(table(spark, d, "orders"), "o_orderstatus", ["o_orderdate", "o_orderkey"], x=F.col("o_totalprice"), date=F.to_date("o_orderdate"))


TICKS = "ticks AS (SELECT user_id AS code, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS seq, value AS x FROM events)"
DAILY = """day AS (SELECT o_orderpriority AS code, CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, o_orderkey) AS open,
    arg_max(o_totalprice, o_orderkey) AS close, max(o_totalprice) AS high, min(o_totalprice) AS low, count(*) AS volume FROM orders GROUP BY 1, 2),
daily AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) - 1 AS seq FROM day)"""
BARS = "bars AS (SELECT o_orderstatus AS code, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) - 1 AS seq, o_totalprice AS x, CAST(o_orderdate AS DATE) AS date FROM orders)"
STEPS = TICKS + """, steps AS (SELECT *, x / nullif(lag(x) OVER o, 0) - 1 AS r, x - lag(x) OVER o AS d FROM ticks WINDOW o AS (PARTITION BY code ORDER BY seq))"""
FRAMES = """WINDOW o AS (PARTITION BY code ORDER BY seq), t AS (PARTITION BY code ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
    t9 AS (PARTITION BY code ORDER BY seq ROWS BETWEEN 8 PRECEDING AND CURRENT ROW), g AS (PARTITION BY code ORDER BY seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
    g9 AS (PARTITION BY code ORDER BY seq ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING)"""


def rounded(df: DataFrame, names: dict[str, str], keys: tuple[str, ...] = (CODE, SEQ), places: int = 6) -> DataFrame:
    return df.select(*keys, *[F.round(F.col(f"`{n}`"), places).alias(a) for n, a in names.items()])


def near(c: Column, places: int) -> Column:
    """``c`` rounded as DuckDB does: the double c * 10**places to the nearest whole number. Spark rounds c's shortest decimal
    instead, which differs where c lies within a rounding error of the middle between two results."""
    made = F.round(c * 10.0**places) / 10.0**places
    return F.when(F.abs(made) < float("inf"), made).otherwise(c)


def _feature(kind: str, source: Callable, aliases: tuple[str, ...], inputs: tuple[str, ...] | None, params: dict) -> Callable:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = source(spark, d)
        out = Feature(kind, **params).extract(df, inputs)
        return rounded(out, dict(zip([c for c in out.columns if c not in df.columns], aliases)))

    return run


def feature_query(kind: str, sql: dict[str, str] | None, source: Callable = ticks, inputs: tuple[str, ...] | None = None, aliases: tuple[str, ...] = (), cte: str = STEPS, table_name: str = "steps", guard: str = "count(x) OVER t = 10", frames: str = FRAMES, **params) -> None:
    params = {k: [v] for k, v in ({"window": 10} | params).items() if k in CATALOG[kind][2] or k not in ("window",)}
    names = tuple(sql) if sql else aliases
    text = None
    if sql:
        text = f"WITH {cte} SELECT code, seq, " + ", ".join(f"round(CASE WHEN {guard} THEN {e} END, 6) AS {a}" for a, e in sql.items()) + f" FROM {table_name} {frames}"
    query(f"feature_{kind.lower()}", text)(_feature(kind, source, names, inputs, params))


for _kind, _stat in {"average": "avg(x)", "median": "quantile_cont(x, 0.5)", "minimum": "min(x)", "maximum": "max(x)"}.items():
    feature_query(_kind, {"value": f"{_stat} OVER t / (x + 1e-8) - 1"})
for _kind, _stat in {"volatility": "stddev_pop(r) OVER t", "skewness": "skewness(r) OVER t", "kurtosis": "kurtosis(r) OVER t - 3"}.items():
    feature_query(_kind, {"value": _stat}, guard="count(r) OVER t = 10")
feature_query("quantile", {"value": "quantile_cont(r, 0.25) OVER t"}, guard="count(r) OVER t = 10", quantile=0.25)
feature_query("momentum", {"value": "(x - lag(x, 9) OVER o) / nullif(lag(x, 9) OVER o, 0)"})
feature_query("Z_momentum", {"value": "(x - lag(x, 9) OVER o) / nullif(lag(x, 9) OVER o, 0) / (stddev_pop(r) OVER t9 * sqrt(9) + 1e-8)"})
feature_query("linear_tempReg", {"slope": "regr_slope(x, seq) OVER t / (x + 1e-8)", "r2": "CASE WHEN var_pop(x) OVER t > 0 THEN regr_r2(x, seq) OVER t ELSE 0 END"})
feature_query("oscillator", {"value": "(x - (avg(x) OVER t + regr_slope(x, seq) OVER t * 4.5)) / (stddev_samp(x) OVER t + 1e-8)"})


def _weights_sql(weights: np.ndarray) -> str:
    return " + ".join(f"lag(x, {len(weights) - 1 - k}) OVER o * ({w!r})" for k, w in enumerate(weights.tolist()))


_K = np.arange(10.0)
_ROWS = np.linalg.pinv(np.column_stack([np.ones(10), _K, _K * _K]))
_CURVE = STEPS + ", curve AS (SELECT code, seq, x, " + ", ".join(f"{_weights_sql(w)} AS b{i}" for i, w in enumerate(_ROWS)) + ", var_pop(x) OVER t * 10 AS total, " + ", ".join(f"lag(x, {9 - k}) OVER o AS x{k}" for k in range(10)) + f" FROM steps {FRAMES})"
_LEFT = " + ".join(f"(x{k} - b0 - b1 * {k} - b2 * {k * k}) ** 2" for k in range(10))
feature_query("nonlinear_tempReg", {"slope": "b1 / (x + 1e-8)", "acceleration": "b2 / (x + 1e-8)", "r2": f"CASE WHEN total > 0 THEN 1 - ({_LEFT}) / total ELSE 0 END"}, cte=_CURVE, table_name="curve")
_MOVES = STEPS + ", moves AS (SELECT *, abs(d) AS size, CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0 END AS up, CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0 END AS down FROM steps)"
feature_query("rsi", {"value": "(sum(up) OVER t9 / 10) / (sum(down) OVER t9 / 10 + 1e-8) / (1 + (sum(up) OVER t9 / 10) / (sum(down) OVER t9 / 10 + 1e-8))"}, cte=_MOVES, table_name="moves")
_HALF = _MOVES + """, halves AS (SELECT *, CASE WHEN count(d) OVER h = 5 THEN 100 - 100 / (1 + (sum(up) OVER h / 5) / (sum(down) OVER h / 5 + 1e-8)) END AS own,
    100 - 100 / (1 + (sum(up) OVER e / 5) / (sum(down) OVER e / 5 + 1e-8)) AS edge FROM moves
    WINDOW h AS (PARTITION BY code ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), e AS (PARTITION BY code ORDER BY seq ROWS BETWEEN 8 PRECEDING AND 5 PRECEDING))"""
_T5 = FRAMES + ", t5 AS (PARTITION BY code ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
feature_query("stochastic_rsi", {"value": "(own - least(min(own) OVER t5, edge)) / (greatest(max(own) OVER t5, edge) - least(min(own) OVER t5, edge) + 1e-8)"}, cte=_HALF, table_name="halves", frames=_T5)
_FAST, _SLOW = 2 / 3, 2 / 7
_KAMA = _MOVES + f""", rates AS (SELECT *, power(abs(lag(x, 1) OVER o - lag(x, 7) OVER o) / (sum(size) OVER p + 1e-8) * ({_FAST - _SLOW!r}) + {_SLOW!r}, 2) AS c1,
    power(abs(x - lag(x, 6) OVER o) / (sum(size) OVER q + 1e-8) * ({_FAST - _SLOW!r}) + {_SLOW!r}, 2) AS c2, lag(x, 2) OVER o AS z, lag(x, 1) OVER o AS y FROM moves
    WINDOW o AS (PARTITION BY code ORDER BY seq), p AS (PARTITION BY code ORDER BY seq ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), q AS (PARTITION BY code ORDER BY seq ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))"""
feature_query("kama", {"value": "(z + c1 * (y - z) + c2 * (x - (z + c1 * (y - z)))) / (x + 1e-8) - 1"}, cte=_KAMA, table_name="rates", fastest_window=2, slowest_window=6)
_SIGNS = STEPS + ", signs AS (SELECT code, seq, x, coalesce(last_value(nullif(sign(d), 0) IGNORE NULLS) OVER (PARTITION BY code ORDER BY seq ROWS UNBOUNDED PRECEDING), 1) AS s FROM steps), shares AS (SELECT *, avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END) OVER t AS p, avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END) OVER g9 AS q FROM signs " + FRAMES + ")"
_ENTROPY = "-(CASE WHEN {0} > 0 THEN {0} * log2({0}) ELSE 0 END + CASE WHEN {0} < 1 THEN (1 - {0}) * log2(1 - {0}) ELSE 0 END) + 0.0"
feature_query("shannon_entropy", {"value": _ENTROPY.format("p")}, cte=_SIGNS, table_name="shares", guard="seq >= 9")
feature_query("plugin_entropy", {"value": _ENTROPY.format("q")}, cte=_SIGNS, table_name="shares", guard="seq >= 9")
feature_query("lempel_ziv_entropy", None, aliases=("value",))
feature_query("kontoyiannis_entropy", None, aliases=("value",))
feature_query("sample_entropy", None, aliases=("value",), sub_vector_size=2, threshold_distance=0.2)
feature_query("hurst", None, aliases=("exponent", "tstat", "pvalue"), power=4)

_PRICES = DAILY + ", prices AS (SELECT *, (high + low) / 2 AS mid FROM daily)"


def prices(spark: SparkSession, d: str) -> DataFrame:
    return daily(spark, d).withColumn("mid", (F.col("high") + F.col("low")) / 2)


feature_query("ehlers_fisher", {"value": "CASE WHEN max(mid) OVER g = min(mid) OVER g THEN 0 ELSE 0.5 * ln((1 + p) / (1 - p)) END"}, source=prices, guard="count(mid) OVER g = 10", table_name="placed",
              cte=_PRICES + f", placed AS (SELECT *, greatest(least(2 * (lag(mid) OVER o - min(mid) OVER g) / nullif(max(mid) OVER g - min(mid) OVER g, 0) - 1, 0.999), -0.999) AS p FROM prices {FRAMES})")
_VORTEX = _PRICES + ", ranges AS (SELECT *, abs(high - lag(low) OVER o) AS vp, abs(low - lag(high) OVER o) AS vm, CASE WHEN lag(mid) OVER o IS NOT NULL THEN greatest(high - low, abs(high - lag(mid) OVER o)) END AS tr FROM prices WINDOW o AS (PARTITION BY code ORDER BY seq))"
_FAR = "CASE WHEN sum(vp) OVER g9 / nullif(sum(tr) OVER g9, 0) > 3 OR sum(vm) OVER g9 / nullif(sum(tr) OVER g9, 0) > 3 THEN 1 ELSE sum({}) OVER g9 / nullif(sum(tr) OVER g9, 0) END"
feature_query("vortex", {"plus": _FAR.format("vp"), "minus": _FAR.format("vm")}, source=prices, cte=_VORTEX, table_name="ranges", guard="count(mid) OVER g = 10")
feature_query("vigor", {"value": "lag((close - open) / (high - low + 1e-8)) OVER o"}, source=prices, cte=_PRICES, table_name="prices", guard="count(mid) OVER g = 10")
_SPAN = "(max(high) OVER g - min(low) OVER g + 1e-8)"
_G3 = FRAMES + ", g3 AS (PARTITION BY code ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
feature_query("stochastic_oscillator", {"fast": f"(lag(mid) OVER o - min(low) OVER g) / {_SPAN}", "slow": f"(avg(mid) OVER g3 - min(low) OVER g) / {_SPAN}"}, source=prices, cte=_PRICES, table_name="prices", guard="count(mid) OVER g = 10", frames=_G3)


@query("feature_cointegration", f"WITH {_PRICES} SELECT code, seq, round(CASE WHEN count(mid) OVER g = 10 THEN regr_slope(close, open) OVER g END, 6) AS beta, round(CASE WHEN count(mid) OVER g = 10 THEN lag(close) OVER o - regr_slope(close, open) OVER g * lag(open) OVER o - regr_intercept(close, open) OVER g END, 3) AS residual FROM prices {FRAMES}")
def _(spark, d):
    out = Feature("cointegration", "c", window=[10]).extract(prices(spark, d), ("close", "open"))
    return out.select(CODE, SEQ, F.round("`c_beta_10_None_None_None`", 6).alias("beta"), F.round("`c_residuals_10_None_None_None`", 3).alias("residual"))


@query("feature_cointegration_tests")
def _(spark, d):
    out = Feature("cointegration", "c", window=[30]).extract(prices(spark, d), ("close", "open"))
    return out.select(CODE, SEQ, F.col("c_ADF_pvalue_30_None_None_None").alias("adf_p"), F.col("c_KPSS_pvalue_30_None_None_None").alias("kpss_p"))


_OU_CTE = DAILY + ", spread AS (SELECT *, close - 0.7 * open AS x FROM daily), moved AS (SELECT *, lead(x) OVER (PARTITION BY code ORDER BY seq) - x AS d FROM spread), fitted AS (SELECT *, avg(x) OVER g AS mu, -regr_slope(d, x) OVER h AS theta, count(x) OVER g AS n FROM moved WINDOW g AS (PARTITION BY code ORDER BY seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), h AS (PARTITION BY code ORDER BY seq ROWS BETWEEN 10 PRECEDING AND 2 PRECEDING))"


@query("feature_ou", f"WITH {_OU_CTE} SELECT code, seq, round(CASE WHEN n = 10 THEN mu END, 4) AS mu, round(CASE WHEN n = 10 THEN greatest(theta, 0) END, 6) AS theta, round(CASE WHEN n = 10 THEN CASE WHEN theta > 0 THEN ln(2) / theta ELSE 0 END END, 4) AS half_life FROM fitted")
def _(spark, d):
    out = Feature("OU", window=[10], residuals_weights=[(0.7, 0.0)]).extract(daily(spark, d), ("close", "open"))
    made = {c.split("_10_")[0]: c for c in out.columns if c.startswith("OU_")}
    return out.select(CODE, SEQ, F.round(f"`{made['OU_mu']}`", 4).alias("mu"), F.round(f"`{made['OU_theta']}`", 6).alias("theta"), F.round(f"`{made['OU_half_life']}`", 4).alias("half_life"))


feature_query("kalmanOU", None, source=prices, inputs=("close", "open"), aliases=("state", "variance"), smooth_coefficient=0.5)


# -- smoothing -------------------------------------------------------------------


@query("smoothing_average", f"WITH {TICKS} SELECT code, seq, round(CASE WHEN count(x) OVER t = 10 THEN avg(x) OVER t END, 6) AS value FROM ticks {FRAMES}")
def _(spark, d):
    s = Staged()
    name = smooth(s, "x", "average", 10)
    return rounded(s.apply(ticks(spark, d), F.col(name).alias("v")), {"v": "value"})


_EW = [0.8**k for k in range(5)]


@query("smoothing_ewma", f"WITH {TICKS} SELECT code, seq, round(({' + '.join(f'lag(x, {k}) OVER o * ({w!r})' for k, w in enumerate(_EW))}) / {sum(_EW)!r}, 6) AS value FROM ticks WINDOW o AS (PARTITION BY code ORDER BY seq)")
def _(spark, d):
    s = Staged()
    name = smooth(s, "x", "ewma", 5, 0.2)
    return rounded(s.apply(ticks(spark, d), F.col(name).alias("v")), {"v": "value"})


def _frac(d: float, floor: float) -> list[float]:
    w = [1.0]
    while abs(-w[-1] * (d - len(w) + 1) / len(w)) >= floor:
        w.append(-w[-1] * (d - len(w) + 1) / len(w))
    return w


@query("fracdiff", f"WITH {TICKS} SELECT code, seq, round({' + '.join(f'lag(x, {k + 1}) OVER o * ({w!r})' for k, w in enumerate(_frac(0.5, 0.01)))}, 6) AS value FROM ticks WINDOW o AS (PARTITION BY code ORDER BY seq)")
def _(spark, d):
    s = Staged()
    return rounded(s.apply(ticks(spark, d), fracdiff(s, "x", 0.5, 0.01).alias("v")), {"v": "value"})


@query("feature_grid", f"WITH {STEPS}, smooth AS (SELECT code, seq, x, CASE WHEN count(x) OVER p = 3 THEN avg(x) OVER p END AS y FROM steps WINDOW p AS (PARTITION BY code ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT code, seq, round(CASE WHEN count(x) OVER t = 10 THEN avg(x) OVER t / (x + 1e-8) - 1 END, 6) AS plain, round(CASE WHEN count(y) OVER t = 10 THEN avg(y) OVER t / (y + 1e-8) - 1 END, 6) AS smoothed FROM smooth {FRAMES}")
def _(spark, d):
    out = Feature("average", window=[10], smoothing_method=[None, "average"], window_smooth=[3], lambda_smooth=[0.1, 0.2]).extract(ticks(spark, d))
    return rounded(out, {"average_10_None_3_0.1": "plain", "average_10_average_3_0.2": "smoothed"})


# -- labels ----------------------------------------------------------------------

_RET = "(SELECT *, CASE WHEN before IS NULL OR (before = 0 AND x = 0) THEN 0 ELSE x / nullif(before, 0) - 1 END AS r FROM (SELECT *, lag(x) OVER (PARTITION BY code ORDER BY seq) AS before FROM ticks))"


def _relative(gap: str) -> str:
    return f"CASE WHEN x <> 0 THEN ({gap}) / x WHEN ({gap}) > 0 THEN CAST('Infinity' AS DOUBLE) WHEN ({gap}) < 0 THEN CAST('-Infinity' AS DOUBLE) END"


_RUNS = "runs AS (SELECT *, sum(n) OVER (PARTITION BY code ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY code ORDER BY seq) THEN 0 ELSE 1 END AS n FROM raw)), kept AS (SELECT code, seq, CASE WHEN count(*) OVER (PARTITION BY code, run) < {0} THEN 0 ELSE label END AS label FROM runs)"


@query("label_naive", f"WITH {TICKS} SELECT code, seq, coalesce(CASE WHEN z > 1 THEN 1 WHEN z < -1 THEN -1 ELSE 0 END, 0) AS label FROM (SELECT code, seq, CASE WHEN count(r) OVER t = 10 THEN r / nullif(stddev_samp(r) OVER t, 0) END AS z FROM {_RET} {FRAMES})")
def _(spark, d):
    return labels.naive(ticks(spark, d), 1.0, 10).select(CODE, SEQ, "label")


_LF = f"{TICKS}, ahead AS (SELECT *, lead(x, 5) OVER (PARTITION BY code ORDER BY seq) / nullif(x, 0) - 1 AS a FROM ticks), raw AS (SELECT code, seq, coalesce(CASE WHEN z > 0.5 THEN 1 WHEN z < -0.5 THEN -1 ELSE 0 END, 0) AS label FROM (SELECT code, seq, CASE WHEN count(a) OVER p = 5 THEN a / nullif(stddev_samp(a) OVER p, 0) END AS z FROM ahead WINDOW p AS (PARTITION BY code ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)))"


@query("label_look_forward", f"WITH {_LF}, {_RUNS.format(2)} SELECT * FROM kept")
def _(spark, d):
    return labels.look_forward(ticks(spark, d), 5, 2, 0.5).select(CODE, SEQ, "label")


def _horizon_sql(rank: str, keep: str) -> str:
    rows = " UNION ALL ".join(f"SELECT code, seq, {h} AS h, regr_slope(x, seq) OVER f AS slope, {rank} AS rank, count(*) OVER (PARTITION BY code ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM ticks WINDOW f AS (PARTITION BY code ORDER BY seq ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING)" for h in range(5, 8))
    return f"{TICKS}, fits AS ({rows}), raw AS (SELECT code, seq, CASE WHEN max(n) < 5 THEN 0 ELSE coalesce(arg_max(CASE WHEN slope > 0 THEN 1 ELSE -1 END, rank * 1e6 - h * 1e-3) FILTER ({keep}), 0) END AS label FROM fits GROUP BY code, seq)"


@query("label_regression_rank", f"WITH {_horizon_sql('CASE WHEN var_pop(x) OVER f > 0 THEN regr_r2(x, seq) OVER f ELSE 0 END', 'rank > 0.3')}, {_RUNS.format(2)} SELECT * FROM kept")
def _(spark, d):
    return labels.regression_rank(ticks(spark, d), 5, 0.6, 0.3, 2).select(CODE, SEQ, "label")


@query("label_slope", f"WITH {_horizon_sql('abs(regr_slope(x, seq) OVER f)', 'rank > 0')}, {_RUNS.format(2)} SELECT code, seq, last_value(nullif(label, 0) IGNORE NULLS) OVER (PARTITION BY code ORDER BY seq ROWS UNBOUNDED PRECEDING) AS label FROM kept")
def _(spark, d):
    return labels.slope(ticks(spark, d), 5, 0.6, 2).select(CODE, SEQ, "label")


@query("label_triple_barrier", f"""WITH RECURSIVE {TICKS}, ret AS {_RET}, v AS (SELECT code, seq, {_relative('max(x) OVER f - x')} AS up, {_relative('min(x) OVER f - x')} AS dn, CASE WHEN count(r) OVER t = 10 THEN stddev_samp(r) OVER t * sqrt(10) END AS vol FROM ret
    {FRAMES}, f AS (PARTITION BY code ORDER BY seq ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
    walk AS (SELECT code, seq, CASE WHEN up > 0.5 * vol THEN 1 WHEN dn < -0.5 * vol THEN -1 ELSE 0 END AS label FROM v WHERE seq = 0
    UNION ALL SELECT v.code, v.seq, CASE walk.label WHEN 1 THEN CASE WHEN up > 0.5 * vol THEN 1 WHEN dn < -0.3 * vol THEN -1 ELSE 0 END WHEN -1 THEN CASE WHEN dn < -0.5 * vol THEN -1 WHEN up > 0.3 * vol THEN 1 ELSE 0 END ELSE CASE WHEN up > 0.5 * vol THEN 1 WHEN dn < -0.5 * vol THEN -1 ELSE 0 END END
    FROM walk JOIN v ON v.code = walk.code AND v.seq = walk.seq + 1) SELECT code, seq, label FROM walk""")
def _(spark, d):
    return labels.triple_barrier(ticks(spark, d), 0.5, 0.3, 5, 10).select(CODE, SEQ, "label")


@query("label_boosted")
def _(spark, d):
    return labels.boosted(ticks(spark, d), 5, 2, 0.5, 5, 0.6, 0.3, 2).select(CODE, SEQ, "label")


_PAIRS = "SELECT doc_id, 2 * quality - 1 AS label, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 2 * toxic - 1 END AS signal FROM labels"


def _pairs(spark, d):
    return table(spark, d, "labels").select("doc_id", (2 * F.col("quality") - 1).alias("label"), F.when(F.col("doc_id") % 3 == 0, 0).otherwise(2 * F.col("toxic") - 1).alias("signal"))


@query("label_binary_meta", f"WITH p AS ({_PAIRS}) SELECT doc_id, CAST(signal = label AS INT) AS plain, CAST(signal = label OR signal = 0 AS INT) AS locked, CAST(signal = label AND signal <> 0 AS INT) AS no_zero FROM p")
def _(spark, d):
    return _pairs(spark, d).select("doc_id", labels.binary_meta().alias("plain"), labels.binary_meta(trade_lock=True).alias("locked"), labels.binary_meta(no_zero=True).alias("no_zero"))


@query("label_trinary_meta", f"WITH p AS ({_PAIRS}) SELECT doc_id, CASE WHEN signal = label THEN 1 WHEN signal = 0 AND label <> 0 THEN 0 WHEN signal * label = -1 THEN -1 ELSE 0 END AS plain, CASE WHEN signal = label AND signal <> 0 THEN 1 WHEN signal * label = -1 THEN -1 ELSE 0 END AS no_zero FROM p")
def _(spark, d):
    return _pairs(spark, d).select("doc_id", labels.trinary_meta().alias("plain"), labels.trinary_meta(no_zero=True).alias("no_zero"))


@query("vertical_stacking", f"WITH {TICKS} SELECT code, seq, round(x, 6) AS x, 1 AS param_id FROM ticks UNION ALL SELECT code, seq, round(2 * x, 6) AS x, 2 AS param_id FROM ticks")
def _(spark, d):
    t = ticks(spark, d)
    return rounded(labels.stack([t.withColumn("param_id", F.lit(1)), t.withColumn("x", 2 * F.col("x")).withColumn("param_id", F.lit(2))]), {"x": "x"}, (CODE, SEQ, "param_id"))


# -- sampling ----------------------------------------------------------------------

_BAR_WALK = f"""RECURSIVE {BARS}, walk AS (SELECT code, seq, x, date, CASE WHEN x >= 500000 THEN 0.0 ELSE x END AS total, CAST(0 AS BIGINT) AS bar, CASE WHEN x >= 500000 THEN 1 ELSE 0 END AS hit FROM bars WHERE seq = 0
    UNION ALL SELECT b.code, b.seq, b.x, b.date, CASE WHEN w.total + b.x >= 500000 THEN 0.0 ELSE w.total + b.x END, w.bar + w.hit, CASE WHEN w.total + b.x >= 500000 THEN 1 ELSE 0 END FROM walk w JOIN bars b ON b.code = w.code AND b.seq = w.seq + 1)"""


@query("bars_cumulative", f"WITH {_BAR_WALK} SELECT code, bar, arg_min(x, seq) AS open, max(x) AS high, min(x) AS low, arg_max(x, seq) AS close, round(sum(x), 4) AS volume FROM walk GROUP BY code, bar")
def _(spark, d):
    rows = bars(spark, d).withColumns({c: F.col("x") for c in ("open", "high", "low", "close", "volume")})
    out = sampling.cumulative_bars(rows.drop("date", "x"), "volume", 500000.0)
    return out.select(CODE, "bar", "open", "high", "low", "close", F.round("volume", 4).alias("volume"))


@query("bars_dynamic_threshold", f"WITH {BARS}, t AS (SELECT code, date, sum(x) AS total FROM bars GROUP BY 1, 2), h AS (SELECT code, date, CASE WHEN count(total) OVER p = 3 THEN floor(avg(total) OVER p / 2) ELSE 100000.0 END AS threshold FROM t WINDOW p AS (PARTITION BY code ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) SELECT code, seq, threshold FROM bars JOIN h USING (code, date)")
def _(spark, d):
    return sampling.dynamic_threshold(bars(spark, d), "date", "x", 2, 3, 100000.0).select(CODE, SEQ, "threshold")


@query("series_decomposition", f"""WITH {DAILY}, n AS (SELECT *, lead(open) OVER (PARTITION BY code ORDER BY date) AS nxt FROM daily),
    m AS (SELECT code, date, 'intraday' AS kind, open AS a, close AS b, high AS h, low AS l FROM n WHERE nxt IS NOT NULL UNION ALL SELECT code, date, 'overnight', close, nxt, greatest(close, nxt), least(close, nxt) FROM n WHERE nxt IS NOT NULL
    UNION ALL SELECT code, date, 'complete', open, nxt, greatest(open, nxt, high), least(open, nxt, low) FROM n WHERE nxt IS NOT NULL),
    c AS (SELECT *, CASE WHEN count(nullif(a, 0)) OVER o = count(*) OVER o THEN first_value(a) OVER o * product(b / nullif(a, 0)) OVER o END AS cl, row_number() OVER o AS n FROM m WINDOW o AS (PARTITION BY code, kind ORDER BY date ROWS UNBOUNDED PRECEDING)),
    p AS (SELECT *, CASE WHEN n = 1 THEN a ELSE lag(cl) OVER (PARTITION BY code, kind ORDER BY date) END AS op FROM c), s AS (SELECT *, op / nullif(a, 0) AS f FROM p)
    SELECT code, date, kind, round(ln(CASE WHEN op > 0 THEN op END), 6) AS log_open, round(ln(CASE WHEN cl > 0 THEN cl END), 6) AS log_close, round(ln(CASE WHEN h * f > 0 THEN h * f END), 6) AS log_high, round(ln(CASE WHEN l * f > 0 THEN l * f END), 6) AS log_low FROM s""")
def _(spark, d):
    out = sampling.decompose(daily(spark, d))
    return out.select(CODE, "date", "kind", *[F.round(F.log(c), 6).alias(f"log_{c}") for c in ("open", "close", "high", "low")])


def _labelled(spark, d):
    return labels.naive(ticks(spark, d), 1.0, 10)


_EVENTS = f"""{TICKS}, lab AS (SELECT code, seq, x, r, coalesce(CASE WHEN z > 1 THEN 1 WHEN z < -1 THEN -1 ELSE 0 END, 0) AS label FROM (SELECT *, CASE WHEN count(r) OVER t = 10 THEN r / nullif(stddev_samp(r) OVER t, 0) END AS z FROM {_RET} {FRAMES})),
    ret2 AS (SELECT code, seq, x, label, x / nullif(lag(x) OVER (PARTITION BY code ORDER BY seq), 0) - 1 AS r2 FROM lab),
    vol AS (SELECT *, CASE WHEN count(r2) OVER t = 10 THEN stddev_samp(r2) OVER t * sqrt(10) END AS volatility FROM ret2 {FRAMES}),
    used AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY seq) - 1 AS start FROM vol WHERE volatility IS NOT NULL),
    ext AS (SELECT *, max(x) OVER f AS hi, min(x) OVER f AS lo, last_value(x) OVER f AS fin, max(start) OVER f AS stop FROM used WINDOW f AS (PARTITION BY code ORDER BY start ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
    hits AS (SELECT e.*, (SELECT min(u.start) FROM used u WHERE u.code = e.code AND u.start BETWEEN e.start AND e.start + 5 AND u.x = e.hi) AS hi_at, (SELECT min(u.start) FROM used u WHERE u.code = e.code AND u.start BETWEEN e.start AND e.start + 5 AND u.x = e.lo) AS lo_at, 0.5 * volatility AS bound, {_relative('hi - x')} AS up, {_relative('lo - x')} AS dn, {_relative('fin - x')} AS final FROM ext e),
    ev AS (SELECT code, seq, label, start, CASE WHEN label = 1 AND up >= bound THEN hi_at WHEN label = -1 AND dn <= -bound THEN lo_at ELSE stop END AS "end",
    CASE WHEN x <> 0 OR label = 0 THEN CASE label WHEN 1 THEN CASE WHEN up < bound THEN CASE WHEN final > 0 THEN final END ELSE up END WHEN -1 THEN CASE WHEN dn > -bound THEN CASE WHEN final < 0 THEN -final END ELSE -dn END ELSE bound / 2 END END AS gain FROM hits)"""


@query("event_extraction", f'WITH {_EVENTS} SELECT code, seq, label, start, "end", round(gain, 6) AS event_returns FROM ev')
def _(spark, d):
    return sampling.events(_labelled(spark, d), 0.5, 5, 10).select(CODE, SEQ, "label", "start", "end", F.round("event_returns", 6).alias("event_returns"))


_CONC = _EVENTS + """, conc AS (SELECT e.code, e.seq, e.label, e.start, e.gain, 1 + count(*) FILTER (o.start < e.start AND o."end" >= e.start) + count(*) FILTER (o.start < e."end" AND o."end" >= e."end") AS concurrent
    FROM ev e JOIN ev o ON o.code = e.code AND o.label = e.label GROUP BY ALL)"""


@query("concurrent_events", f"WITH {_CONC} SELECT code, seq, concurrent FROM conc")
def _(spark, d):
    return sampling.concurrency(sampling.events(_labelled(spark, d), 0.5, 5, 10)).select(CODE, SEQ, "concurrent")


@query("sample_weights", f"WITH {_CONC}, w AS (SELECT code, seq, (1 / concurrent) / sum(1 / concurrent) OVER c * ((start + 1) / sum(start + 1) OVER c) * gain / sum(gain) OVER c AS w FROM conc WINDOW c AS (PARTITION BY code)) SELECT code, seq, round(w / sum(w) OVER (PARTITION BY code), 8) AS sample_weight FROM w")
def _(spark, d):
    return sampling.sample_weights(_labelled(spark, d), 0.5, 5, 10).select(CODE, SEQ, F.round("sample_weight", 8).alias("sample_weight"))


@query("sample_draw")
def _(spark, d):
    return sampling.draw(sampling.sample_weights(_labelled(spark, d), 0.5, 5, 10), 0.5, by=["label"]).select(CODE, SEQ, "label")


@query("sample_draw_replacement")
def _(spark, d):
    return sampling.draw(sampling.sample_weights(_labelled(spark, d), 0.5, 5, 10), 0.5, by=["label"], replacement=True).select(CODE, SEQ, "label")


@query("linear_time_decay", f"WITH {TICKS} SELECT code, seq, round((seq + 1) / count(*) OVER (PARTITION BY code), 8) AS decay FROM ticks")
def _(spark, d):
    return ticks(spark, d).select(CODE, SEQ, F.round(sampling.time_decay(), 8).alias("decay"))


# -- quality -----------------------------------------------------------------------

_GAPS = f"{TICKS}, gaps AS (SELECT code, seq, CASE WHEN seq < 3 OR seq % 11 = 5 THEN NULL ELSE x END AS x FROM ticks)"


def _gaps(spark, d):
    return ticks(spark, d).withColumn("x", F.when((F.col(SEQ) < 3) | (F.col(SEQ) % 11 == 5), None).otherwise(F.col("x")))


@query("sanitize_error_values", f"WITH {_GAPS}, f AS (SELECT *, min(seq) FILTER (x IS NOT NULL) OVER (PARTITION BY code) AS first FROM gaps) SELECT code, 'x' AS feature, count(*) FILTER (x IS NULL AND seq < first) AS beginning_nans, count(*) FILTER (x IS NULL AND seq >= first) AS middle_nans, round(count(*) FILTER (x IS NULL AND seq >= first) / count(*) FILTER (seq >= first), 8) AS error_proportion FROM f GROUP BY code")
def _(spark, d):
    return quality.error_values(_gaps(spark, d), ["x"]).select(CODE, "feature", "beginning_nans", "middle_nans", F.round("error_proportion", 8).alias("error_proportion"))


@query("sanitize_check", f"WITH {_GAPS}, f AS (SELECT code, seq, last_value(x IGNORE NULLS) OVER (PARTITION BY code ORDER BY seq ROWS UNBOUNDED PRECEDING) AS x FROM gaps), z AS (SELECT *, avg(x) OVER c AS m, stddev_samp(x) OVER c AS s FROM f WINDOW c AS (PARTITION BY code)), k AS (SELECT *, abs((x - m) / s) > 2 AS far FROM z WHERE x IS NOT NULL) SELECT code, 'x' AS feature, count(*) FILTER (far) AS outliers_count, round(count(*) FILTER (far) / count(*) FILTER (NOT far), 8) AS outliers_proportion, round(2 * max(s) + max(m), 6) AS outliers_threshold, round(avg(x) FILTER (NOT far), 6) AS mean, round(stddev_samp(x) FILTER (NOT far), 6) AS std FROM k GROUP BY code")
def _(spark, d):
    out = quality.check(_gaps(spark, d), ["x"], 2.0)
    return out.select(CODE, "feature", "outliers_count", F.round("outliers_proportion", 8).alias("outliers_proportion"), *[F.round(c, 6).alias(c) for c in ("outliers_threshold", "mean", "std")])


@query("sanitize_stationarity")
def _(spark, d):
    return quality.stationarity(ticks(spark, d), ["x"])


@query("sanitize_extract")
def _(spark, d):
    rows = _gaps(spark, d).withColumn("x", F.col("x") / 100)
    return quality.Sanitizer(["x"], 2.0).fit(rows).extract(rows).select(CODE, SEQ, "x")


@query("sanitize_extract_new")
def _(spark, d):
    rows = _gaps(spark, d).withColumn("x", F.col("x") / 100)
    return quality.Sanitizer(["x"], 2.0).fit(rows).extract_new(rows).select(CODE, SEQ, "x")


_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("correlation_selector", "WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c, corr(l_quantity, l_tax) AS d, corr(l_extendedprice, l_tax) AS e, corr(l_discount, l_tax) AS f FROM lineitem) SELECT 'l_extendedprice' AS feature FROM c WHERE abs(a) > 0.5 UNION ALL SELECT 'l_discount' FROM c WHERE abs(b) > 0.5 OR abs(c) > 0.5 UNION ALL SELECT 'l_tax' FROM c WHERE abs(d) > 0.5 OR abs(e) > 0.5 OR abs(f) > 0.5")
def _(spark, d):
    drop = quality.correlated(table(spark, d, "lineitem"), _NUMERIC, 0.5)
    return spark.createDataFrame([(f,) for f in drop], "feature string")


# -- metrics -----------------------------------------------------------------------

_PREDS = "preds AS (SELECT doc_id, CAST(2 * quality - 1 AS INT) AS label, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE CAST(1 - 2 * toxic AS INT) END AS prediction FROM labels)"


def _preds(spark, d):
    return table(spark, d, "labels").select("doc_id", (2 * F.col("quality") - 1).alias("label"), F.when(F.col("doc_id") % 5 == 0, 0).otherwise(1 - 2 * F.col("toxic")).alias("prediction"))


_COUNTS = _PREDS + ", n AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (label = prediction) AS hit, count(*) FILTER (prediction = 1 AND label = 1) AS tp, count(*) FILTER (prediction = 1 AND label <> 1) AS fp, count(*) FILTER (prediction <> 1 AND label = 1) AS fn, " + ", ".join(f"count(*) FILTER ({c} = {v}) AS {c[0]}{k}" for c in ("label", "prediction") for k, v in enumerate((-1, 0, 1))) + ", " + ", ".join(f"count(*) FILTER (label = {v} AND prediction = {v}) AS h{k}" for k, v in enumerate((-1, 0, 1))) + " FROM preds)"
_BOTH = "(l0 * p0 + l1 * p1 + l2 * p2)"


@query("metrics_classification", f"WITH {_COUNTS} SELECT round(hit / n, 8) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 8) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 8) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 8) AS f1_score, round((coalesce(h0 / nullif(l0, 0), 0) + coalesce(h1 / nullif(l1, 0), 0) + coalesce(h2 / nullif(l2, 0), 0)) / 3, 8) AS balanced_accuracy, round((hit * n - {_BOTH}) / sqrt((n * n - p0 * p0 - p1 * p1 - p2 * p2) * (n * n - l0 * l0 - l1 * l1 - l2 * l2)), 8) AS mcc, round((hit / n - {_BOTH} / (n * n)) / (1 - {_BOTH} / (n * n)), 8) AS cohen_kappa FROM n")
def _(spark, d):
    out = metrics.classification(_preds(spark, d))
    return out.select(*[F.round(c, 8).alias(c) for c in out.columns])


@query("metrics_report", f"WITH {_PREDS}, k AS (SELECT unnest([-1, 0, 1]) AS class), c AS (SELECT class, count(*) FILTER (label = class AND prediction = class) AS tp, count(*) FILTER (prediction = class) AS said, count(*) FILTER (label = class) AS support FROM preds, k GROUP BY class) SELECT class, round(coalesce(tp / nullif(said, 0), 0), 8) AS precision, round(coalesce(tp / nullif(support, 0), 0), 8) AS recall, round(coalesce(2 * tp / nullif(said + support, 0), 0), 8) AS f1_score, support FROM c")
def _(spark, d):
    out = metrics.report(_preds(spark, d))
    return out.select("class", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1_score")], "support")


@query("metrics_confusion", f"WITH {_PREDS}, k AS (SELECT unnest([-1, 0, 1]) AS class) SELECT class, count(*) FILTER (label = class AND prediction = -1) AS predicted_m1, count(*) FILTER (label = class AND prediction = 0) AS predicted_0, count(*) FILTER (label = class AND prediction = 1) AS predicted_1 FROM preds, k GROUP BY class")
def _(spark, d):
    return metrics.confusion(_preds(spark, d))


_MARKET = f"{DAILY}, ret AS (SELECT code, seq, close / lag(close) OVER (PARTITION BY code ORDER BY seq) - 1 AS c, open / lag(open) OVER (PARTITION BY code ORDER BY seq) - 1 AS m FROM daily), rr AS (SELECT code, seq, c / 100 AS r, m / 100 AS m FROM ret WHERE c IS NOT NULL)"


def _market(spark, d):
    s = Staged()
    out = s.apply(daily(spark, d), *[((F.col(c) / s.lag(c) - 1) / 100).alias(n) for c, n in (("close", "r"), ("open", "m"))], keep=[CODE, SEQ])
    return out.dropna()


@query("metrics_distribution", f"WITH {_MARKET} SELECT code, round(avg(r) * 252, 6) AS expected_return, round(stddev_samp(r) * sqrt(252), 6) AS volatility, round(stddev_samp(r) FILTER (r < 0) * sqrt(252), 6) AS downside_deviation, round(median(r) * 252, 6) AS median_return, round(skewness(r), 6) AS skew, round(kurtosis(r), 5) AS kurtosis FROM rr GROUP BY code")
def _(spark, d):
    out = metrics.distribution(_market(spark, d))
    return out.select(CODE, *[F.round(c, 5 if c == "kurtosis" else 6).alias(c) for c in out.columns if c != CODE])


_RISK = _MARKET + """, cum AS (SELECT *, exp(sum(ln(1 + r)) OVER w) AS c FROM rr WINDOW w AS (PARTITION BY code ORDER BY seq ROWS UNBOUNDED PRECEDING)), dd AS (SELECT *, max(c) OVER w AS peak FROM cum WINDOW w AS (PARTITION BY code ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    ru AS (SELECT *, sum(CASE WHEN c = peak THEN 1 ELSE 0 END) OVER (PARTITION BY code ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run, quantile_cont(r, 0.05) OVER (PARTITION BY code) AS v FROM dd), du AS (SELECT *, sum(CASE WHEN c < peak THEN 1 ELSE 0 END) OVER (PARTITION BY code, run ORDER BY seq ROWS UNBOUNDED PRECEDING) AS below FROM ru)"""


@query("metrics_risk", f"WITH {_RISK} SELECT code, round(avg(c / peak - 1), 6) AS mean_drawdown, round(min(c / peak - 1), 6) AS maximum_drawdown, CAST(max(below) AS BIGINT) AS max_drawdown_duration, round(max(v), 6) AS var_95, round(avg(r) FILTER (r <= v), 6) AS cvar_95 FROM du GROUP BY code")
def _(spark, d):
    out = metrics.risk(_market(spark, d))
    return out.select(CODE, "max_drawdown_duration", *[F.round(c, 6).alias(c) for c in ("mean_drawdown", "maximum_drawdown", "var_95", "cvar_95")])


@query("metrics_market", f"WITH {_MARKET} SELECT code, round(covar_samp(r, m) / var_samp(m), 6) AS beta, round(avg(r) * 252 - covar_samp(r, m) / var_samp(m) * avg(m) * 252, 6) AS alpha, round(avg(r) FILTER (m > 0) / avg(m) FILTER (m > 0), 6) AS upside_capture, round(avg(r) FILTER (m < 0) / avg(m) FILTER (m < 0), 6) AS downside_capture, round(stddev_samp(r - m) * sqrt(252), 6) AS tracking_error FROM rr GROUP BY code")
def _(spark, d):
    out = metrics.market(_market(spark, d))
    return out.select(CODE, *[F.round(c, 6).alias(c) for c in ("beta", "alpha", "upside_capture", "downside_capture", "tracking_error")])


@query("metrics_performance", f"WITH {_RISK}, a AS (SELECT code, avg(r) * 252 AS e, stddev_samp(r) * sqrt(252) AS v, stddev_samp(r) FILTER (r < 0) * sqrt(252) AS dn, covar_samp(r, m) / var_samp(m) AS beta, stddev_samp(r - m) * sqrt(252) AS te, avg(m) * 252 AS mk, min(c / peak - 1) AS mdd FROM du GROUP BY code) SELECT code, round(e / v, 5) AS sharpe_ratio, round(e / dn, 5) AS sortino_ratio, round(e / beta, 5) AS treynor_ratio, round((e - mk) / te, 5) AS information_ratio, round(e / abs(mdd), 5) AS calmar_ratio FROM a")
def _(spark, d):
    out = metrics.performance(_market(spark, d))
    return out.select(CODE, *[F.round(f"{c}_ratio", 5).alias(f"{c}_ratio") for c in ("sharpe", "sortino", "treynor", "information", "calmar")])


_LINE = "line AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS y, 1500 * l_quantity AS p, l_extendedprice - 1500 * l_quantity AS e FROM lineitem)"


def _line(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y"), (1500 * F.col("l_quantity")).alias("p"), "l_quantity", "l_discount")


@query("metrics_regression", f"WITH {_LINE} SELECT round(sqrt(avg((y - p) ** 2)), 4) AS rmse, round(avg((y - p) ** 2), 2) AS mse, round(avg(abs(y - p) / ((abs(y) + abs(p)) / 2)), 8) AS smape, round(max(abs(y - p)), 4) AS max_error, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 8) AS r2 FROM line")
def _(spark, d):
    out = metrics.regression(_line(spark, d))
    return out.select(F.round("rmse", 4).alias("rmse"), F.round("mse", 2).alias("mse"), F.round("smape", 8).alias("smape"), F.round("max_error", 4).alias("max_error"), F.round("r2", 8).alias("r2"))


@query("metrics_residuals", f"WITH {TICKS}, e AS (SELECT *, x - avg(x) OVER (PARTITION BY code) AS e FROM ticks), s AS (SELECT *, e - lag(e) OVER (PARTITION BY code ORDER BY seq) AS st FROM e), j AS (SELECT code, sum(st * st) / sum(e * e) AS dw, count(*) / 6 * (skewness(e) ** 2 + kurtosis(e) ** 2 / 4) AS jb, count(*) AS n FROM s GROUP BY code) SELECT code, round(dw, 6) AS durbin_watson, round(jb, 5) AS jarque_bera, round(1 - (1 / (1 + 0.5 * jb)) ** n, 6) AS jarque_bera_p FROM j")
def _(spark, d):
    rows = ticks(spark, d).withColumn("e", F.col("x") - F.avg("x").over(Window.partitionBy(CODE)))
    return metrics.residuals(rows).select(CODE, F.round("durbin_watson", 6).alias("durbin_watson"), F.round("jarque_bera", 5).alias("jarque_bera"), F.round("jarque_bera_p", 6).alias("jarque_bera_p"))


@query("metrics_breusch_pagan")
def _(spark, d):
    lm, p = metrics.breusch_pagan(_line(spark, d).withColumn("e", (F.col("y") - F.col("p")) / 1e4), ["l_quantity"], "e")
    return spark.createDataFrame([(lm, p)], "lm double, p_value double")


@query("metrics_significance")
def _(spark, d):
    model = LinearModel().fit(_line(spark, d), ["l_quantity", "l_discount"], "y")
    rows = metrics.significance(model.predict(_line(spark, d)), model.features, "y", "prediction", model.coefficients)
    return spark.createDataFrame([(r["feature"], r["coefficient"], r["t_stat"], r["p_value"]) for r in rows], "feature string, coefficient double, t_stat double, p_value double")


@query("autocorrelation", f"WITH {TICKS}, l AS (SELECT code, x, " + ", ".join(f"lag(x, {k}) OVER (PARTITION BY code ORDER BY seq) AS l{k}" for k in (1, 2, 3)) + " FROM ticks) " + " UNION ALL ".join(f"SELECT code, {k} AS lag, round(corr(x, l{k}), 6) AS autocorrelation FROM l GROUP BY code" for k in (1, 2, 3)))
def _(spark, d):
    return metrics.autocorrelation(ticks(spark, d), 3).select(CODE, "lag", F.round("autocorrelation", 6).alias("autocorrelation"))


@query("partial_autocorrelation")
def _(spark, d):
    return metrics.partial_autocorrelation(bars(spark, d), 4)


@query("series_report", f"WITH {TICKS} SELECT code, count(*) AS n, count(x) AS n_values, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min, round(median(x), 6) AS median, max(x) AS max, round(skewness(x), 6) AS skew, round(kurtosis(x), 5) AS kurtosis FROM ticks GROUP BY code")
def _(spark, d):
    out = metrics.series_report(ticks(spark, d))
    return out.select(CODE, "n", "n_values", "min", "max", *[F.round(c, 5 if c == "kurtosis" else 6).alias(c) for c in ("mean", "std", "median", "skew", "kurtosis")])


# -- models ------------------------------------------------------------------------


@query("model_ols", "SELECT round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem")
def _(spark, d):
    m = LinearModel().fit(_line(spark, d), ["l_quantity"], "y")
    return spark.createDataFrame([(float(m.coefficients[0]), m.intercept)], "slope double, intercept double").select(F.round("slope", 5).alias("slope"), F.round("intercept", 3).alias("intercept"))


def _linear(kind: str, **params):
    def run(spark, d):
        rows = _line(spark, d).select(((F.col("l_quantity") - 25) / 15).alias("a"), (F.col("l_discount") * 20 - 1).alias("b"), (F.col("y") / 50000).alias("y"))
        m = LinearModel(kind, learning_rate=0.05, epochs=300, **params).fit(rows, ["a", "b"], "y")
        return spark.createDataFrame([(*m.coefficients.tolist(), m.intercept, len(m.losses))], "a double, b double, intercept double, epochs long")

    return run


for _kind, _params in {"mse": {}, "ridge": {"l2": 0.1, "sign": "standard"}, "lasso": {"l1": 0.05, "sign": "standard"}, "elastic_net": {"l2": 0.05, "l1": 0.05, "sign": "standard"}}.items():
    query(f"model_{_kind}")(_linear(_kind, **_params))


def _classifier(kind: str, **params):
    def run(spark, d):
        rows = extract_all(_labelled(spark, d), [Feature("momentum", "m", window=[5]), Feature("rsi", "r", window=[5])])
        rows = rows.select(CODE, SEQ, "label", *[F.col(f"`{c}`").alias(a) for c, a in (("m_5", "m"), ("r_5", "r")) for c in [next(x for x in rows.columns if x.startswith(c))]]).dropna()
        return Classifier(kind, **params).fit(rows, ["m", "r"]).predict(rows).select(CODE, SEQ, "label", "prediction")

    return run


for _kind, _params in {"tree": {"maxDepth": 3, "min_proba": 0.4}, "random_forest": {"numTrees": 5, "maxDepth": 3, "balanced": True}, "logistic_regression": {"maxIter": 10}, "gradient_boosting": {"maxIter": 3, "maxDepth": 2}}.items():
    query(f"classifier_{_kind}")(_classifier(_kind, **_params))


# -- signals and backtest ------------------------------------------------------------


def _signals(spark, d):
    rows = strategy.momentum_signal(ticks(spark, d), 3)
    return rows.withColumns({"size": F.lit(1.0) + F.pmod(F.col(SEQ), F.lit(4)).cast("double"), "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col(SEQ).cast("int")), "ask_open": F.col("x") + 0.5, "bid_open": F.col("x") - 0.5, "portfolio_weight": F.lit(0.1)})


@query("strategy_momentum_signal", f"WITH {TICKS} SELECT code, seq, CAST(coalesce(sign(x - lag(x, 3) OVER (PARTITION BY code ORDER BY seq)), 0) AS INT) AS signal FROM ticks")
def _(spark, d):
    return strategy.momentum_signal(ticks(spark, d), 3).select(CODE, SEQ, "signal")


@query("signal_confirmation", f"""WITH RECURSIVE {TICKS}, s AS (SELECT code, seq, CAST(coalesce(sign(x - lag(x, 3) OVER (PARTITION BY code ORDER BY seq)), 0) AS INT) AS signal FROM ticks),
    walk AS (SELECT code, seq, signal AS held, 0 AS n FROM s WHERE seq = 0 UNION ALL SELECT s.code, s.seq, CASE WHEN s.signal <> w.held AND w.n + 1 > 1 THEN s.signal ELSE w.held END, CASE WHEN s.signal = w.held OR w.n + 1 > 1 THEN 0 ELSE w.n + 1 END FROM walk w JOIN s ON s.code = w.code AND s.seq = w.seq + 1)
    SELECT code, seq, held AS confirmed FROM walk""")
def _(spark, d):
    return backtest.confirm(strategy.momentum_signal(ticks(spark, d), 3), 1).select(CODE, SEQ, "confirmed")


@query("backtest_operations")
def _(spark, d):
    return backtest.with_returns(backtest.operations(_signals(spark, d), 0.001, 0.0005))


@query("backtest_daily_summary")
def _(spark, d):
    return backtest.run_backtest(_signals(spark, d), slippage=0.001, brokerage=0.0005)[1]


@query("backtest_underlying", f"WITH {BARS}, u AS (SELECT code, date, arg_max(x, seq) AS close FROM bars GROUP BY 1, 2) SELECT code, date, close, round(coalesce(close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1, 0), 6) AS daily_returns FROM u")
def _(spark, d):
    out = backtest.underlying_summary(bars(spark, d), "x")
    return out.select(CODE, "date", "close", F.round("daily_returns", 6).alias("daily_returns"))


@query("quick_backtest", f"WITH {TICKS}, s AS (SELECT *, CAST(coalesce(sign(x - lag(x, 3) OVER o), 0) AS INT) AS signal, lead(x) OVER o / x - 1 AS r FROM ticks WINDOW o AS (PARTITION BY code ORDER BY seq)) SELECT code, seq, round(r * signal, 6) + 0.0 AS strategy_return FROM s")
def _(spark, d):
    return backtest.quick_returns(strategy.momentum_signal(ticks(spark, d), 3)).select(CODE, SEQ, (near(F.col("strategy_return"), 6) + 0.0).alias("strategy_return"))


@query("strategy_volatility_size", f"WITH {STEPS} SELECT code, seq, round(coalesce(least(0.1 / nullif(CASE WHEN count(r) OVER t = 10 THEN stddev_samp(r) OVER t END, 0), 1.0), 0), 6) AS size FROM steps {FRAMES}")
def _(spark, d):
    out = strategy.volatility_size(ticks(spark, d), 0.1, 10)
    return out.select(CODE, SEQ, F.round("size", 6).alias("size"))


@query("directional_open_to_close")
def _(spark, d):
    rows = daily(spark, d)
    return OpenToClose(kind="tree", grid={"maxDepth": [2, 3, 5], "minInstancesPerNode": [1, 10]}).fit(rows).signals(rows).select(CODE, "date", "signal")


# -- options, codependence, simulation -------------------------------------------------


def _spots(spark, d):
    return daily(spark, d).select(CODE, SEQ, F.col("close").alias("x"))


@query("options_chain", f"WITH {DAILY}, k AS (SELECT unnest(range(80, 130, 5)) AS strike_pct), t AS (SELECT unnest([30, 60, 90, 180]) AS time_to_maturity) SELECT code, seq, CAST(strike_pct AS INT) AS strike_pct, CAST(time_to_maturity AS INT) AS time_to_maturity, strike_pct || '_' || time_to_maturity AS id, round(close * strike_pct / 100, 4) AS strike FROM daily, k, t")
def _(spark, d):
    return options.chain(_spots(spark, d)).select(CODE, SEQ, "strike_pct", "time_to_maturity", "id", F.round(F.col("x") * F.col("strike_pct") / 100, 4).alias("strike"))


@query("options_realised_payoff", f"WITH {DAILY}, l AS (SELECT code, seq, close AS x, lead(close, 30) OVER (PARTITION BY code ORDER BY seq) AS later FROM daily) SELECT code, seq, round(greatest(later - x, CASE WHEN later IS NOT NULL THEN 0 END) * exp(-0.03 * (30 / 252)), 4) AS call, round(greatest(x - later, CASE WHEN later IS NOT NULL THEN 0 END) * exp(-0.03 * (30 / 252)), 4) AS put FROM l")
def _(spark, d):
    rows = _spots(spark, d)
    call, put = options.realised_payoff(rows, 30, F.col("x"), F.lit(0.03))
    return rows.select(CODE, SEQ, F.round(call, 4).alias("call"), F.round(put, 4).alias("put"))


@query("options_black_scholes")
def _(spark, d):
    call, put, delta = options.black_scholes(F.col("x"), F.col("x") * 1.05, F.lit(0.5), F.lit(0.03), F.lit(0.25))
    return _spots(spark, d).select(CODE, SEQ, call.alias("call"), put.alias("put"), delta.alias("delta"))


@query("options_binomial_tree")
def _(spark, d):
    call, put = options.binomial_tree(F.col("x"), F.col("x") * 1.05, F.lit(0.5), F.lit(0.03), F.lit(0.25), 20)
    return _spots(spark, d).select(CODE, SEQ, call.alias("call"), put.alias("put"))


@query("options_implied_volatility")
def _(spark, d):
    args = (F.lit(100.0), F.lit(105.0), F.lit(0.5), F.lit(0.03))
    vol = F.lit(0.1) + F.pmod(F.col(SEQ), F.lit(40)) / 100
    call, put, _ = options.black_scholes(*args, vol)
    priced = _spots(spark, d).select(CODE, SEQ, call.alias("call"), put.alias("put")).repartition(CODE)  # keeps the prices out of the search's arguments
    return priced.select(CODE, SEQ, options.implied_volatility(*args, F.col("call"), F.col("put")).alias("iv")).select(CODE, SEQ, "iv.*")


_DISTANCES = {
    "euclidean": "sqrt(list_sum(list_transform(range(1, 65), lambda i: (a[i] - b[i]) ** 2)))", "manhattan": "list_sum(list_transform(range(1, 65), lambda i: abs(a[i] - b[i])))", "chebyshev": "list_max(list_transform(range(1, 65), lambda i: abs(a[i] - b[i])))",
    "minkowski": "list_sum(list_transform(range(1, 65), lambda i: abs(a[i] - b[i]) ** 3)) ** (1 / 3.0)", "hamming": "list_sum(list_transform(range(1, 65), lambda i: CASE WHEN a[i] <> b[i] THEN 1.0 ELSE 0.0 END)) / 64",
    "angular": "1 - list_sum(list_transform(range(1, 65), lambda i: a[i] * b[i])) / (sqrt(list_sum(list_transform(range(1, 65), lambda i: a[i] * a[i]))) * sqrt(list_sum(list_transform(range(1, 65), lambda i: b[i] * b[i]))))",
}


@query("distances", "WITH p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, CAST(lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS DOUBLE[]) AS b FROM embeddings) SELECT vec_id, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in _DISTANCES.items()) + " FROM p WHERE b IS NOT NULL")
def _(spark, d):
    rows = table(spark, d, "embeddings").withColumn("b", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).filter("b is not null")
    return rows.select("vec_id", *[F.round(codependence.distance(n, F.col("embedding"), F.col("b")), 6).alias(n) for n in _DISTANCES])


_TWO = f"{TICKS}, two AS (SELECT code, seq, x AS a, x * (seq % 3) AS b FROM ticks)"


@query("distance_jaccard", "WITH p AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v > 0 AS INT)) AS a, lead(list_transform(embedding, lambda v: CAST(v > 0 AS INT))) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) SELECT vec_id, round(1 - list_sum(list_transform(range(1, 65), lambda i: a[i] & b[i])) / list_sum(list_transform(range(1, 65), lambda i: a[i] | b[i])), 6) AS jaccard FROM p WHERE b IS NOT NULL")
def _(spark, d):
    bits = F.transform("embedding", lambda v: F.when(v > 0, 1).otherwise(0))
    rows = table(spark, d, "embeddings").select("vec_id", bits.alias("a"), F.lead(bits).over(Window.partitionBy("label").orderBy("vec_id")).alias("b")).filter("b is not null")
    return rows.select("vec_id", F.round(codependence.distance("jaccard", F.col("a"), F.col("b")), 6).alias("jaccard"))


@query("pearson_correlation", f"WITH {_TWO} SELECT code, round(corr(a, b), 6) AS pearson FROM two GROUP BY code")
def _(spark, d):
    rows = ticks(spark, d).select(CODE, SEQ, F.col("x").alias("a"), (F.col("x") * (F.col(SEQ) % 3)).alias("b"))
    return codependence.pearson(rows, "a", "b").select(CODE, F.round("pearson", 6).alias("pearson"))


@query("distance_correlation", f"WITH {_TWO}, p AS (SELECT l.code, l.seq AS i, r.seq AS j, abs(l.a - r.a) AS u, abs(l.b - r.b) AS v FROM two l JOIN two r USING (code)), c AS (SELECT code, u - avg(u) OVER i - avg(u) OVER j + avg(u) OVER k AS u, v - avg(v) OVER i - avg(v) OVER j + avg(v) OVER k AS v FROM p WINDOW i AS (PARTITION BY code, i), j AS (PARTITION BY code, j), k AS (PARTITION BY code)) SELECT code, round(sqrt(avg(u * v) / sqrt(avg(u * u) * avg(v * v))), 6) AS distance_correlation FROM c GROUP BY code")
def _(spark, d):
    rows = ticks(spark, d).select(CODE, SEQ, F.col("x").alias("a"), (F.col("x") * (F.col(SEQ) % 3)).alias("b"))
    return codependence.distance_correlation(rows, "a", "b").select(CODE, F.round("distance_correlation", 6).alias("distance_correlation"))


for _name, _make in {
    "wiener": lambda s: simulate.wiener(s, 20, 100), "general_wiener": lambda s: simulate.general_wiener(s, 20, 100), "geometric": lambda s: simulate.geometric(s, 20, 100), "ornstein_uhlenbeck": lambda s: simulate.ornstein_uhlenbeck(s, 20, 100),
    "correlated_geometric": lambda s: simulate.correlated_geometric(s, [[1.0, 0.6], [0.6, 1.0]], 200, [100.0, 50.0], [0.05, 0.02], [0.2, 0.3]),
    "fractional": lambda s: simulate.fractional(s, 10, 100), "power_law": lambda s: simulate.power_law(s, 20, 100), "power_law_walk": lambda s: simulate.power_law_walk(s, 20, 100),
}.items():
    query(f"simulate_{_name}")(lambda spark, d, make=_make: make(spark))
