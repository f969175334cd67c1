"""Linear models: closed form by one aggregate, and descent with validation, checkpoints and early stopping."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Params = dict[str, float]


def fit_linear(df: DataFrame, features: list[str], label: str) -> Params:
    """Ordinary least squares: the moments of all columns are one aggregate, whatever the number of rows."""
    names = [*features, label]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    rows = df.na.drop(subset=names)
    m = rows.agg(F.count("*").alias("n"), *[F.avg(a).alias(f"m_{a}") for a in names], *[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs]).first()
    if not m["n"]:
        raise ValueError("no complete row to fit on")
    cov = {(a, b): m[f"c_{a}_{b}"] for a, b in pairs}
    s = np.array([[cov.get((a, b), cov.get((b, a))) for b in features] for a in features], float)
    w = np.linalg.lstsq(s, np.array([cov[(a, label)] for a in features], float), rcond=None)[0]
    return {**dict(zip(features, w.tolist(), strict=True)), "bias": float(m[f"m_{label}"] - w @ [m[f"m_{a}"] for a in features])}


def predict(df: DataFrame, params: Params, name: str = "prediction") -> DataFrame:
    return df.withColumn(name, sum((F.col(k) * v for k, v in params.items() if k != "bias"), F.lit(params["bias"])))


def predict_missing(df: DataFrame, params: Params, target: str) -> DataFrame:
    """Observed and predicted target values together, with a mark of which is which."""
    seen = df.where(F.col(target).isNotNull()).withColumn("predicted", F.lit(False))
    guess = predict(df.where(F.col(target).isNull()), params, target).withColumn("predicted", F.lit(True))
    return seen.unionByName(guess)


class Trainer:
    """Gradient descent on squared loss, on moments that are one aggregate a table.

    The best parameters by validation loss are kept, and training ends after patience epochs without a better one.
    warm_start takes parameters of another model: unknown names are left out, missing ones start at 0.
    """

    def __init__(self, features: list[str], label: str, rate: float = 0.1, epochs: int = 10, patience: int = 10, early_stopping: bool = True, warm_start: Params | None = None, on_epoch: Callable[[int, float, float], None] | None = None):
        self.features, self.label, self.rate, self.epochs, self.patience = features, label, rate, epochs, patience
        self.early_stopping, self.on_epoch = early_stopping, on_epoch
        start = warm_start or {}
        self.params = {f: float(start.get(f, 0.0)) for f in [*features, "bias"]}
        self.history: list[tuple[int, float, float]] = []

    def _moments(self, df: DataFrame) -> np.ndarray | None:
        """E[z z'] of z = (features, 1, label): all that the squared loss and its gradient need of a table, in one aggregate."""
        z = [*[F.col(f) for f in self.features], F.lit(1.0), F.col(self.label)]
        row = df.agg(*[F.avg(a * b) for i, a in enumerate(z) for b in z[i:]]).first()
        if row[0] is None:
            return None
        out = np.zeros((len(z), len(z)))
        out[np.triu_indices(len(z))] = list(row)
        return out + np.triu(out, 1).T

    def _loss(self, moments: np.ndarray) -> float:
        v = np.array([*self.params.values(), -1.0])
        return float(v @ moments @ v)

    def loss(self, df: DataFrame) -> float:
        return self._loss(self._moments(df))

    def train(self, train: DataFrame, test: DataFrame | None = None) -> Params:
        """All epochs follow from the moments of both tables, so each is read once whatever the number of epochs."""
        names = [*self.features, self.label]
        fit = self._moments(train.select(*names).na.drop())
        check = fit if test is None else self._moments(test.select(*names).na.drop())
        if fit is None or check is None:
            raise ValueError("no complete row to fit on or to check with")
        best, strikes, kept = float("inf"), 0, dict(self.params)
        for epoch in range(self.epochs):
            loss = self._loss(fit)
            slope = fit @ np.array([*self.params.values(), -1.0])
            self.params = {f: p - self.rate * 2 * float(g) for (f, p), g in zip(self.params.items(), slope[:-1], strict=True)}
            valid = self._loss(check)
            self.history.append((epoch, loss, valid))
            if self.on_epoch:
                self.on_epoch(epoch, loss, valid)
            if valid < best:
                best, strikes, kept = valid, 0, dict(self.params)
            else:
                strikes += 1
                if self.early_stopping and strikes >= self.patience:
                    break
        self.params = kept
        return kept
