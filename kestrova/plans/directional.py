"""The open-to-close pipeline: decomposition, features, labels, resampling, selection, model, signals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrova.operators import labels
from kestrova.operators.features import Feature, extract_all
from kestrova.operators.models import Classifier, grid_search
from kestrova.operators.quality import correlated
from kestrova.operators.sampling import decompose, draw, sample_weights
from kestrova.series import CODE, SEQ

KINDS = ("intraday", "overnight", "complete")
REQUIRED = ("date", "open", "close", "high", "low")


class OpenToClose:
    """``fit`` on bars (code, seq, date, open, close, high, low), ``signals`` for others.

    Three chained daily series give features; the label is the next day's, by the
    sign of the intraday move in its own deviations. At inference a row sees the day before.

    The model learns from training rows drawn by their uniqueness, recency and return on the intraday
    series, as many of each label: ``resampling`` holds the parameters of ``sample_weights`` and ``draw``."""

    def __init__(self, features: Sequence[Feature] | None = None, threshold: float = 0.5, vol_window: int = 10, max_correlation: float = 0.9, kind: str = "random_forest", grid: dict[str, list] | None = None, n_samples: int = 500, n_folds: int = 3, resampling: dict | None = None):
        self.features = list(features or [Feature("momentum", window=[5, 10]), Feature("rsi", window=[10]), Feature("volatility", window=[10])])
        self.threshold, self.vol_window, self.max_correlation = threshold, vol_window, max_correlation
        self.kind, self.grid, self.n_samples, self.n_folds = kind, grid or {"numTrees": [10], "maxDepth": [3]}, n_samples, n_folds
        self.resampling = {"upper": 0.3, "vertical": 21, "vol_window": 21, "n": 1.3, "replacement": True, "seed": 72} | (resampling or {})
        self.chosen: list[str] = []
        self.model: Classifier | None = None

    def _daily(self, bars: DataFrame) -> tuple[DataFrame, list[str]]:
        missing = [c for c in REQUIRED if c not in bars.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        days = decompose(bars)
        place = (F.row_number().over(Window.partitionBy(CODE, "kind").orderBy("date")) - 1).cast("long")
        days = days.withColumn(SEQ, place).withColumn("x", F.col("close"))
        wide = days.groupBy(CODE, SEQ, "date").pivot("kind", list(KINDS)).agg(F.first("x"))
        frames, names = wide, []
        for k in KINDS:
            before = frames.columns
            made = [Feature(f.kind, f"{k}_{f.name}", **f.params) for f in self.features]
            frames = extract_all(frames, made, inputs=[k])
            names += [c for c in frames.columns if c not in before]
        return frames, names

    def _training(self, bars: DataFrame) -> tuple[DataFrame, list[str]]:
        daily, names = self._daily(bars)
        labelled = labels.naive(daily.withColumn("x", F.col("intraday")), self.threshold, self.vol_window).withColumnRenamed("label", "_now")
        return labelled.withColumn("label", F.lead("_now").over(Window.partitionBy(CODE).orderBy(SEQ))).drop("_now", "x"), names

    def _resampled(self, rows: DataFrame) -> DataFrame:
        """``rows`` drawn with balanced labels; a row drawn more than once stands as often."""
        p = self.resampling
        weighed = sample_weights(rows, p["upper"], p["vertical"], p["vol_window"], price="intraday").select(CODE, SEQ, "sample_weight")
        return draw(rows.join(weighed, [CODE, SEQ]), p["n"], by=["label"], replacement=p["replacement"], seed=p["seed"]).select(*rows.columns)

    def fit(self, bars: DataFrame) -> OpenToClose:
        rows, names = self._training(bars)
        safe = {n: f"f{k}" for k, n in enumerate(names)}
        rows = rows.select(CODE, SEQ, "label", "intraday", *[F.col(f"`{n}`").alias(s) for n, s in safe.items()]).dropna()
        rows = self._resampled(rows)
        # the search plans many jobs on these rows: they don't carry the features' windows along
        rows = (rows.checkpoint() if rows.sparkSession.conf.get("spark.checkpoint.dir", None) else rows).persist()
        try:
            self.names = safe
            drop = set(correlated(rows, list(safe.values()), self.max_correlation))
            self.chosen = [s for s in safe.values() if s not in drop]
            points = reduce(lambda n, v: n * len(v), self.grid.values(), 1)
            best = {k: v[0] for k, v in self.grid.items()} if points == 1 else grid_search(rows, self.chosen, self.kind, self.grid, n_folds=self.n_folds, n_samples=self.n_samples)[0]
            self.model = Classifier(self.kind, **best).fit(rows, self.chosen)
        finally:
            rows.unpersist()
        return self

    def signals(self, bars: DataFrame) -> DataFrame:
        """``bars`` of the days that have features of the day before, with ``signal``."""
        daily, names = self._daily(bars)
        order = Window.partitionBy(CODE).orderBy(SEQ)
        late = daily.select(CODE, "date", *[F.lag(f"`{n}`").over(order).alias(self.names[n]) for n in names]).dropna()
        predicted = self.model.predict(late, out="signal").select(CODE, "date", "signal")
        return bars.join(predicted, [CODE, "date"], "left").dropna(subset=["signal"])
