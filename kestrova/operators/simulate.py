"""Random paths: (code, seq, x), one code a path.

Draws are hashes of seed, path and step turned normal (Box and Muller), so a path is the
same however it is partitioned. They can't be NumPy's: tests look at distributions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from kestrova.functions.fold import fold
from kestrova.series import CODE, SEQ

def _so_far() -> WindowSpec:
    return Window.partitionBy(CODE).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0)


def grid(spark: SparkSession, paths: int, steps: int) -> DataFrame:
    return spark.range(paths * steps).select(F.floor(F.col("id") / steps).cast("long").alias(CODE), F.pmod(F.col("id"), F.lit(steps)).cast("long").alias(SEQ))


def uniform(seed: int, *keys: Column | str | int) -> Column:
    of = [F.lit(k) if isinstance(k, int) else k for k in keys]
    return (F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(2**53 - 1)) + 1) / float(2**53)


def normal(seed: int, *keys: Column | str | int) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed, 1, *keys))) * F.cos(2 * math.pi * uniform(seed, 2, *keys))


def wiener(spark: SparkSession, paths: int, steps: int, horizon: float = 1.0, seed: int = 0) -> DataFrame:
    """From 0: sums of independent normal steps."""
    step = F.when(F.col(SEQ) == 0, 0.0).otherwise(normal(seed, CODE, SEQ) * math.sqrt(horizon / max(steps - 1, 1)))
    return grid(spark, paths, steps).withColumn("z", step).select(CODE, SEQ, F.sum("z").over(_so_far()).alias("x"))


def general_wiener(spark: SparkSession, paths: int, steps: int, start: float = 100.0, drift: float = 0.05, volatility: float = 0.2, horizon: float = 1.0, seed: int = 0) -> DataFrame:
    """``start`` times the exponential of summed steps, each of drift and volatility over horizon / steps; the first row is after one step."""
    dt = horizon / steps
    step = drift * dt + volatility * math.sqrt(dt) * normal(seed, CODE, SEQ)
    return grid(spark, paths, steps).withColumn("z", step).select(CODE, SEQ, (start * F.exp(F.sum("z").over(_so_far()))).alias("x"))


def geometric(spark: SparkSession, paths: int, steps: int, start: float = 100.0, drift: float = 0.05, volatility: float = 0.2, horizon: float = 1.0, seed: int = 0) -> DataFrame:
    dt = horizon / max(steps - 1, 1)
    t = F.col(SEQ) * dt
    return wiener(spark, paths, steps, horizon, seed).select(CODE, SEQ, (start * F.exp((drift - 0.5 * volatility**2) * t + volatility * F.col("x"))).alias("x"))


def correlated_geometric(spark: SparkSession, correlation: Sequence[Sequence[float]], steps: int, start: Sequence[float], drift: Sequence[float], volatility: Sequence[float], horizon: float = 1.0, seed: int = 0) -> DataFrame:
    """One path an asset, whose steps have the given correlation (by its Cholesky factor)."""
    factor, n = np.linalg.cholesky(np.array(correlation)), len(start)
    dt = horizon / max(steps - 1, 1)
    rows = grid(spark, n, steps)
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col(CODE).cast("int") + 1)
    mixed = sum((pick(factor[:, k]) * normal(seed, SEQ, k) for k in range(n)), F.lit(0.0))
    v = pick(volatility)
    move = F.when(F.col(SEQ) == 0, 0.0).otherwise((pick(drift) - 0.5 * v * v) * dt + v * math.sqrt(dt) * mixed)
    return rows.withColumn("z", move).select(CODE, SEQ, (pick(start) * F.exp(F.sum("z").over(_so_far()))).alias("x"))


def ornstein_uhlenbeck(spark: SparkSession, paths: int, steps: int, start: float = 0.0, mean: float = 0.0, theta: float = 1.0, sigma: float = 0.3, horizon: float = 1.0, seed: int = 0) -> DataFrame:
    """Euler steps, so each needs the one before: a fold."""
    dt = horizon / max(steps - 1, 1)
    rows = grid(spark, paths, steps).withColumn("z", normal(seed, CODE, SEQ))
    step = lambda x, z: ((y := start if x is None else x + theta * (mean - x) * dt + sigma * math.sqrt(dt) * z), (y,))
    return fold(rows, ["z"], "x double", lambda: None, step, keep=[CODE, SEQ])


def fractional(spark: SparkSession, paths: int, steps: int, hurst: float = 0.7, horizon: float = 1.0, seed: int = 0) -> DataFrame:
    """Fractional Brownian motion by the Cholesky factor of its covariance: steps**2 numbers in each
    task, so ``steps`` is what bounds it."""
    t = np.arange(1, steps) * horizon / max(steps - 1, 1)
    power = 2 * hurst
    covariance = 0.5 * (t[:, None] ** power + t[None, :] ** power - np.abs(t[:, None] - t[None, :]) ** power)

    def make(batches):
        factor = np.linalg.cholesky(covariance + 1e-12 * np.eye(len(t))) if len(t) else np.zeros((0, 0))
        for batch in batches:
            for path in batch.column(0).to_pylist():
                z = np.random.default_rng([seed, path]).normal(size=len(t))
                x = np.concatenate([[0.0], factor @ z])[:steps]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(x), type=pa.int64()), pa.array(range(len(x)), type=pa.int64()), pa.array(x)], names=[CODE, SEQ, "x"])

    return spark.range(paths).mapInArrow(make, "code long, seq long, x double")


def power_law(spark: SparkSession, paths: int, steps: int, alpha: float = 3.0, least: float = 1.0, seed: int = 0) -> DataFrame:
    """Independent values with density falling as x ** -alpha from ``least``."""
    value = least * F.pow(uniform(seed, CODE, SEQ), F.lit(-1 / (alpha - 1)))
    return grid(spark, paths, steps).select(CODE, SEQ, value.alias("x"))


def power_law_walk(spark: SparkSession, paths: int, steps: int, alpha: float = 3.0, hurst: float = 0.5, seed: int = 0) -> DataFrame:
    """Sums of power-law steps of either sign; a step keeps the last sign with probability ``hurst``."""
    rows = power_law(spark, paths, steps, alpha, 1.0, seed).withColumn("u", uniform(seed + 1, CODE, SEQ))
    turned = F.sum(F.when(F.col("u") > hurst, 1).otherwise(0)).over(_so_far())
    signed = rows.withColumn("z", F.col("x") * F.when(F.pmod(turned, F.lit(2)) == 0, 1).otherwise(-1))
    return signed.select(CODE, SEQ, F.sum("z").over(_so_far()).alias("x"))
