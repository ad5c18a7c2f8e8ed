"""From signals to sized, weighted signals: own designs where only names are given."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrova.series import CODE, SEQ, Staged

COLUMNS = ("code", "signal", "size", "date", "price")


def check_signals(df: DataFrame) -> DataFrame:
    missing = [c for c in COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def volatility_size(df: DataFrame, target: float, window: int, price: str = "x", max_leverage: float = 1.0, minimum_change: float = 0.0) -> DataFrame:
    """``df`` with ``size``: the target over the deviation of the last returns, at most the leverage, in
    multiples of ``minimum_change``. An extension: only its parameters' names are given."""
    s = Staged()
    r = s.put(0, "_r", F.try_divide(F.col(price), s.lag(price)) - 1)
    vol = s.full(F.stddev_samp(r).over(s.T(window)), r, s.T(window), window)
    size = F.least(F.try_divide(F.lit(target), vol), F.lit(max_leverage))
    if minimum_change:
        size = F.floor(size / minimum_change) * minimum_change
    return s.apply(df.drop("size"), F.coalesce(size, F.lit(0.0)).alias("size"))


def equal_weights(df: DataFrame, by: str = "date") -> DataFrame:
    """``portfolio_weight``: one over the codes with a signal at the time. An extension."""
    held = F.count_if(F.col("signal") != 0).over(Window.partitionBy(by))
    return df.withColumn("portfolio_weight", F.when((F.col("signal") != 0) & (held > 0), 1 / held).otherwise(0.0))


def momentum_signal(df: DataFrame, window: int, price: str = "x") -> DataFrame:
    """``signal``: the sign of the price's change over ``window`` rows. An extension."""
    before = F.lag(price, window).over(Window.partitionBy(CODE).orderBy(SEQ))
    return df.withColumn("signal", F.coalesce(F.signum(F.col(price) - before).cast("int"), F.lit(0)))
