"""Sanitizing of features, and selection by correlation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrova.functions.arrays import adf, by_array, kpss
from kestrova.series import CODE, SEQ

_BAD = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))


def unusable(df: DataFrame, features: Sequence[str], most: float = 10.0) -> list[str]:
    """Features without a value, with one distinct value at most, or with a mean or deviation over ``most``:
    one wide aggregation."""
    row = df.agg(*[f(c).alias(f"{n}{k}") for k, c in enumerate(features) for n, f in (("n", F.count), ("d", F.approx_count_distinct), ("lo", F.min), ("hi", F.max), ("m", F.avg), ("s", F.stddev_samp))]).first()
    out = []
    for k, c in enumerate(features):
        n, low, high, mean, spread = (row[f"{x}{k}"] for x in ("n", "lo", "hi", "m", "s"))
        if not n or low == high or (mean is not None and mean > most) or (spread is not None and spread > most):
            out.append(c)
    return out


def error_values(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(code, feature, beginning_nans, middle_nans, infinite, error_proportion, n): nulls before and
    after the first value (an infinite one counts as a value), infinities, and the share of errors after it."""
    long = melt(df, features)
    x, value = F.col("value"), ~F.isnan("value") & F.col("value").isNotNull()
    first = F.min(F.when(value, F.col(SEQ))).over(Window.partitionBy(CODE, "feature"))
    null = F.col("value").isNull() | F.isnan("value")
    rows = long.withColumn("_first", first)
    out = rows.groupBy(CODE, "feature").agg(
        F.count_if(null & (F.col("_first").isNull() | (F.col(SEQ) < F.col("_first")))).alias("beginning_nans"),
        F.count_if(null & (F.col(SEQ) >= F.col("_first"))).alias("middle_nans"),
        F.count_if(F.abs(x) == float("inf")).alias("infinite"),
        F.count(F.lit(1)).alias("n"),
    )
    left = F.col("n") - F.col("beginning_nans")
    share = F.when(left > 0, (F.col("middle_nans") + F.col("infinite")) / left).otherwise(1.0)
    return out.select(CODE, "feature", "beginning_nans", "middle_nans", "infinite", share.alias("error_proportion"), "n")


def melt(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(code, seq, feature, value)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in features]))
    return df.select(CODE, SEQ, pairs.alias("p")).select(CODE, SEQ, "p.*")


def _filled(c: str) -> Column:
    clean = F.when(~_BAD(F.col(f"`{c}`")), F.col(f"`{c}`"))
    return F.last(clean, ignorenulls=True).over(Window.partitionBy(CODE).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0))


def check(df: DataFrame, features: Sequence[str], outliers: float = 5.0) -> DataFrame:
    """(code, feature, outliers_count, outliers_proportion, outliers_threshold, mean, std) of each feature of each
    series: infinities and nulls take the value before; values further than ``outliers`` deviations from the mean are outliers; mean
    and deviation are of the rest."""
    filled = df.select(CODE, SEQ, *[_filled(c).alias(c) for c in features])
    own = Window.partitionBy(CODE, "feature")
    rows = melt(filled, features).withColumn("_m", F.avg("value").over(own)).withColumn("_s", F.stddev_samp("value").over(own))
    far = F.coalesce(F.abs(F.try_divide(F.col("value") - F.col("_m"), F.col("_s"))) > outliers, F.lit(False))
    rows = rows.withColumn("_far", far).withColumn("_kept", F.when(~far, F.col("value")))
    out = rows.groupBy(CODE, "feature").agg(F.count_if("_far").alias("outliers_count"), F.count("_kept").alias("_n"), F.when(F.max("_s") > 0, outliers * F.max("_s") + F.max("_m")).alias("outliers_threshold"), F.avg("_kept").alias("mean"), F.stddev_samp("_kept").alias("std"))
    return out.select(CODE, "feature", "outliers_count", F.when(F.col("_n") > 0, F.col("outliers_count") / F.col("_n")).otherwise(0.0).alias("outliers_proportion"), "outliers_threshold", "mean", "std")


def stationarity(df: DataFrame, features: Sequence[str], threshold: float = 0.05) -> DataFrame:
    """(code, feature, is_adf_stationary, is_kpss_stationary); both false for a series too short to test."""
    values = melt(df, features).filter(F.col("value").isNotNull() & ~_BAD(F.col("value")))
    held = values.groupBy(CODE, "feature").agg(F.transform(F.sort_array(F.collect_list(F.struct(SEQ, "value"))), lambda v: v["value"]).alias("v"))
    tests = by_array(lambda x: (adf(x)[1], kpss(x)[1]), "array<double>", F.col("v"))
    found = held.withColumn("_p", tests)
    return found.select(CODE, "feature", F.coalesce(F.col("_p")[0] < threshold, F.lit(False)).alias("is_adf_stationary"), F.coalesce(F.col("_p")[1] > threshold, F.lit(False)).alias("is_kpss_stationary"))


class Sanitizer:
    """Learns, on several series, each feature's scale and bound; applies them to these and to new rows."""

    def __init__(self, features: Sequence[str], outliers: float = 5.0):
        self.features, self.outliers = list(features), outliers
        self.rules: dict[str, tuple[float, float, float]] = {}

    def fit(self, df: DataFrame) -> Sanitizer:
        bad = set(unusable(df, self.features))
        self.features = [c for c in self.features if c not in bad]
        if self.features:
            means = check(df, self.features, self.outliers).groupBy("feature").agg(F.avg("mean"), F.avg("std"), F.avg("outliers_threshold")).collect()
            self.rules = {r[0]: (r[1], r[2], r[3]) for r in means}
        return self

    def extract(self, df: DataFrame) -> DataFrame:
        """The training series: each by its own mean and deviation, without outliers, filled forward, rows with nulls dropped."""
        own = Window.partitionBy(CODE)
        filled = df.withColumns({c: _filled(c) for c in self.features})
        z = lambda c: F.try_divide(F.col(c) - F.avg(c).over(own), F.stddev_samp(c).over(own))
        kept = filled.withColumns({c: F.when(F.abs(z(c)) <= self.outliers, F.col(c)) for c in self.features})
        scaled = kept.withColumns({c: z(c) for c in self.features})
        return scaled.withColumns({c: _filled(c) for c in self.features}).dropna(subset=self.features)

    def extract_new(self, df: DataFrame) -> DataFrame:
        """New rows by the learnt rules: literals only, so a projection."""
        out = {}
        for c in self.features:
            mean, spread, bound = (math.nan if v is None else v for v in self.rules[c])
            x = F.when(F.abs(F.col(c)) <= bound, F.col(c)) if not math.isnan(bound) else F.col(c)
            out[c] = F.try_divide(x - mean, F.lit(spread))
        return df.withColumns(out)


def correlations(df: DataFrame, features: Sequence[str]) -> np.ndarray:
    """The correlation matrix: one aggregation of features * (features - 1) / 2 values."""
    n = len(features)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    out = np.eye(n)
    if pairs:
        row = df.agg(*[F.corr(f"`{features[i]}`", f"`{features[j]}`").alias(f"c{k}") for k, (i, j) in enumerate(pairs)]).first()
        for k, (i, j) in enumerate(pairs):
            out[i, j] = out[j, i] = math.nan if row[k] is None else row[k]
    return out


def correlated(df: DataFrame, features: Sequence[str], threshold: float | Sequence[float] = 0.9) -> list[str]:
    """Features to drop: the later of each pair whose correlation is over the threshold in
    size, even where the earlier is dropped too."""
    bound = threshold if isinstance(threshold, (int, float)) else threshold[0]
    c = np.abs(correlations(df, features))
    return [f for j, f in enumerate(features) if any(c[i, j] > bound for i in range(j))]


def any_null(features: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in features])
