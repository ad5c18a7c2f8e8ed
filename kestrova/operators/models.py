"""Linear models from sums of products, classifiers of Spark ML, and tuning."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrova.operators.metrics import classification, cross_products
from kestrova.plans.grid import random_universe, universe
from kestrova.series import CODE, SEQ

LABELS = (-1, 0, 1)


class LinearModel:
    """OLS, or gradient descent on the squared error with penalties.

    The loss and its gradient depend on the data only through the sums of products of the columns,
    so these are collected once (a matrix as large as the features) and
    the descent runs on them: the same steps as over the rows, without a pass each. The
    rate halves when the loss rose and grows by a twentieth when it fell; a change under 1e-5 ends it.

    ``sign='reference'`` keeps the definition's sign of the penalty, which pushes weights away from
    zero; 'standard' shrinks them. ``l2`` and ``l1`` are the squared and absolute penalties."""

    def __init__(self, kind: str = "ols", learning_rate: float = 0.01, epochs: int = 1000, l2: float = 0.0, l1: float = 0.0, sign: str = "reference"):
        if kind not in ("ols", "mse", "ridge", "lasso", "elastic_net"):
            raise ValueError(f"unknown model {kind!r}")
        if sign not in ("reference", "standard"):
            raise ValueError(f"unknown sign {sign!r}")
        self.kind, self.learning_rate, self.epochs, self.sign = kind, learning_rate, epochs, sign
        self.l2 = l2 if kind in ("ridge", "elastic_net") else 0.0
        self.l1 = l1 if kind in ("lasso", "elastic_net") else 0.0
        self.features: list[str] = []
        self.coefficients, self.intercept, self.losses = np.zeros(0), 0.0, []

    def fit(self, df: DataFrame, features: Sequence[str], target: str) -> LinearModel:
        """Rows with a null in a used column are left out."""
        self.features = list(features)
        n, sums = cross_products(df.dropna(subset=[*features, target]), [*features, target])
        if not n:
            raise ValueError("no rows to fit")
        a, b, c = sums[:-1, :-1], sums[:-1, -1], sums[-1, -1]
        if self.kind == "ols":
            beta = np.linalg.pinv(a) @ b
        else:
            beta, rate, last = np.zeros(len(b)), self.learning_rate, math.inf
            way = -1.0 if self.sign == "reference" else 1.0
            self.losses = []
            for _ in range(self.epochs):
                w = beta[1:]
                loss = (c - 2 * beta @ b + beta @ a @ beta) / n + self.l2 * w @ w + self.l1 * np.abs(w).sum()
                self.losses.append(float(loss))
                rate *= 0.5 if loss > last else 1.05
                if last != math.inf and abs(loss - last) < 1e-5:
                    break
                last = loss
                slope = 2 * (a @ beta - b) / n
                slope[1:] += way * (2 * self.l2 * w + self.l1 * np.sign(w))
                beta = beta - rate * slope
        self.intercept, self.coefficients = float(beta[0]), beta[1:]
        return self

    def prediction(self) -> Column:
        """As an expression: no model to ship."""
        out = F.lit(self.intercept)
        for f, c in zip(self.features, self.coefficients.tolist()):
            out = out + F.col(f"`{f}`") * c
        return out

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.prediction())


def _index(label: str, labels: Sequence[int]) -> Column:
    out = F.lit(None).cast("double")
    for k, v in enumerate(labels):
        out = F.when(F.col(label) == v, float(k)).otherwise(out)
    return out


class Classifier:
    """'tree', 'random_forest', 'logistic_regression' or 'gradient_boosting' on labels in -1, 0, 1.

    With ``min_proba`` a prediction less sure than that abstains: 0. ``balanced``
    weights classes by the inverse of their share. Nulls are left out of the fit,
    and give a null prediction."""

    def __init__(self, kind: str, labels: Sequence[int] = LABELS, min_proba: float = 0.0, balanced: bool = False, seed: int = 72, **params):
        makers = {"tree": DecisionTreeClassifier, "random_forest": RandomForestClassifier, "logistic_regression": LogisticRegression, "gradient_boosting": GBTClassifier}
        if kind not in makers:
            raise ValueError(f"unknown classifier {kind!r}")
        self.kind, self.labels, self.min_proba, self.balanced, self.params = kind, list(labels), min_proba, balanced, params
        seeded = {} if kind == "logistic_regression" else {"seed": seed}
        self.estimator = makers[kind](featuresCol="_features", labelCol="_label", weightCol="_weight", **seeded, **params)
        if kind == "gradient_boosting":
            self.estimator = OneVsRest(classifier=self.estimator, featuresCol="_features", labelCol="_label", weightCol="_weight")
        self.model: Model | None = None
        self.features: list[str] = []

    def _assembled(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.features, outputCol="_features", handleInvalid="skip").transform(df)

    def fit(self, df: DataFrame, features: Sequence[str], label: str = "label") -> Classifier:
        self.features = list(features)
        rows = self._assembled(df.filter(F.col(label).isin(self.labels))).withColumn("_label", _index(label, self.labels))
        weight = F.lit(1.0)
        if self.balanced:
            counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
            total = sum(counts.values())
            for v, n in counts.items():
                weight = F.when(F.col(label) == v, total / (len(counts) * n)).otherwise(weight)
        self.model = self.estimator.fit(rows.withColumn("_weight", weight))
        return self

    def predict(self, df: DataFrame, out: str = "prediction", raw: bool = False) -> DataFrame:
        scored = self.model.transform(self._assembled(df))
        back = F.element_at(F.array(*[F.lit(v) for v in self.labels]), F.col("prediction").cast("int") + 1)
        if self.min_proba and not raw and "probability" in scored.columns:
            back = F.when(F.array_max(vector_to_array("probability")) >= self.min_proba, back).otherwise(0)
        return scored.withColumn("_out", back).select(*[c for c in df.columns if c != out], F.col("_out").alias(out))

    def importances(self) -> list[tuple[str, float]]:
        vector = getattr(self.model, "featureImportances", None)
        return [] if vector is None else sorted(zip(self.features, vector.toArray().tolist()), key=lambda p: -p[1])


def folds(df: DataFrame, n: int, order: Sequence[str] = (SEQ,)) -> DataFrame:
    """``df`` with ``fold``: n contiguous parts of each code."""
    return df.withColumn("fold", F.ntile(n).over(Window.partitionBy(CODE).orderBy(*order)))


def grid_search(df: DataFrame, features: Sequence[str], kind: str, grid: dict[str, list], label: str = "label", n_folds: int = 3, n_samples: int | None = None, metric: str = "balanced_accuracy", seed: int = 72) -> tuple[dict, float, list[tuple[dict, float]]]:
    """(best point, score, all scores). Inverted cross-validation: each point is trained on one fold and tested on each
    of the others, with scores weighted by the folds' rows; the first best wins."""
    split = folds(df, n_folds).persist()
    try:
        sizes = {r.fold: r["count"] for r in split.groupBy("fold").count().collect()}
        scores = []
        for point in universe(grid) if n_samples is None else random_universe(grid, n_samples, seed):
            total, weight = 0.0, 0
            for k in sizes:
                model = Classifier(kind, **point).fit(split.filter(F.col("fold") == k), features, label)
                tested = classification(model.predict(split.filter(F.col("fold") != k)), label, by=["fold"]).select("fold", metric).collect()
                for r in tested:
                    total, weight = total + r[metric] * sizes[r.fold], weight + sizes[r.fold]
            scores.append((point, total / weight if weight else 0.0))
    finally:
        split.unpersist()
    best = max(scores, key=lambda s: s[1])
    return best[0], best[1], scores


def impurity(labels: np.ndarray, criterion: str) -> float:
    """Of a node's labels in order: gini, shannon, plugin, lempel_ziv or kontoyiannis."""
    from kestrova.functions.arrays import kontoyiannis, lempel_ziv

    _, counts = np.unique(labels, return_counts=True)
    p = counts / len(labels)
    if criterion == "gini":
        return float(1 - (p * p).sum())
    if criterion == "shannon":
        return float(-(p * np.log2(p)).sum())
    if criterion == "plugin":
        return impurity(labels[:-1], "shannon") if len(labels) > 1 else 0.0
    if criterion == "lempel_ziv":
        return lempel_ziv(labels)
    if criterion == "kontoyiannis":
        return kontoyiannis(labels) if len(labels) > 1 else 0.0
    raise ValueError(f"unknown criterion {criterion!r}")


class SequenceTree:
    """CART whose criterion may depend on the order of a node's rows, which Spark ML
    can't express. Trained on one bounded group (``most`` rows) as numpy arrays; it predicts as a column
    expression. ``max_depth`` None is no limit."""

    def __init__(self, criterion: str = "gini", max_depth: int | None = 4, min_rows: int = 2, most: int = 100_000):
        self.criterion, self.max_depth, self.min_rows, self.most = criterion, max_depth, min_rows, most
        self.root: dict = {}

    def fit(self, df: DataFrame, features: Sequence[str], label: str = "label", order: Sequence[str] = (CODE, SEQ)) -> SequenceTree:
        rows = df.select(*order, *features, label).dropna().orderBy(*order).limit(self.most + 1).toPandas()
        if len(rows) > self.most:
            raise ValueError(f"over {self.most} rows; draw a sample first")
        self.features = list(features)
        self.root = self._grow(rows[self.features].to_numpy(float), rows[label].to_numpy(), 0)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> dict:
        values, counts = np.unique(y, return_counts=True)
        node = {"label": int(values[counts.argmax()]) if len(values) else 0, "n": len(y)}
        if len(values) < 2 or len(y) < self.min_rows or (self.max_depth is not None and depth >= self.max_depth):
            return node
        best = None
        for f in range(x.shape[1]):
            points = np.unique(x[:, f])
            for cut in (points[1:] + points[:-1]) / 2:
                left = x[:, f] <= cut
                a, b = y[left], y[~left]
                cost = (len(a) * impurity(a, self.criterion) + len(b) * impurity(b, self.criterion)) / len(y)
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, float(cut), left)
        if best is None or best[0] >= impurity(y, self.criterion):
            return node
        _, f, cut, left = best
        return node | {"feature": f, "cut": cut, "left": self._grow(x[left], y[left], depth + 1), "right": self._grow(x[~left], y[~left], depth + 1)}

    def prediction(self, node: dict | None = None) -> Column:
        node = self.root if node is None else node
        if "cut" not in node:
            return F.lit(node["label"])
        return F.when(F.col(f"`{self.features[node['feature']]}`") <= node["cut"], self.prediction(node["left"])).otherwise(self.prediction(node["right"]))

    def importances(self) -> dict[str, float]:
        """Each feature's share of the rows that pass a cut on it."""
        total = dict.fromkeys(self.features, 0)

        def walk(node):
            if "cut" in node:
                total[self.features[node["feature"]]] += node["n"]
                walk(node["left"])
                walk(node["right"])

        walk(self.root)
        return {f: n / max(sum(total.values()), 1) for f, n in total.items()}
