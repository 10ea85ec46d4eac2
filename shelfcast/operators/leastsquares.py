"""Multi-output least squares from additive statistics.

With z = (1, features, labels) of a row, the sum of z zT holds all that a linear
fit of every label needs: the counts, the means, XtX and XtY, and YtY for its
squared loss.  `moments` sums it in one pass, for each key; sums of disjoint rows
add up, so that the statistics of any union of keys (the folds of a rolling
origin) are sums of theirs, and a whole path of penalties is solved, and its loss
known, without another scan.  Only absolute errors need one, and one serves all
folds and penalties.

A task sends one matrix a key ((1 + 98 + 7)^2 doubles, 90 kB); they are added up
in two rounds, so that no task reads all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.exprs import r6
from shelfcast.operators.windows import HORIZON

SPREAD = 64  # first-round groups of each key

MODEL_SCHEMA = "step int, coefficients array<double>, intercept double"


@dataclass(frozen=True)
class LinearModel:
    """A linear function a label: `coef` (labels, features) and `intercept`."""
    coef: np.ndarray
    intercept: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.coef.T + self.intercept

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(h, [float(v) for v in c], float(b)) for h, (c, b) in enumerate(zip(self.coef, self.intercept))]
        spark.createDataFrame(rows, MODEL_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> LinearModel:
        rows = sorted(spark.read.schema(MODEL_SCHEMA).parquet(path).collect())  # one row a label
        return LinearModel(np.array([r["coefficients"] for r in rows]), np.array([r["intercept"] for r in rows]))


@dataclass(frozen=True)
class Moments:
    """The sum of z zT over rows, z = (1, features, labels)."""
    matrix: np.ndarray
    labels: int = HORIZON

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.matrix + other.matrix, self.labels)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.matrix - other.matrix, self.labels)

    @property
    def n(self) -> int:
        return int(self.matrix[0, 0])

    def ridge(self, penalty: float) -> LinearModel:
        """Least squares plus `penalty` / 2 times the coefficients' squares, of
        half the mean squared error; the intercept is free of it.  Where the
        equations do not fix the coefficients, the smallest ones."""
        d = len(self.matrix) - 1 - self.labels
        mean = self.matrix[0, 1:] / self.matrix[0, 0]
        spread = self.matrix[1:, 1:] / self.matrix[0, 0] - np.outer(mean, mean)
        coef = np.linalg.lstsq(spread[:d, :d] + penalty * np.eye(d), spread[:d, d:], rcond=1e-12)[0].T
        return LinearModel(coef, mean[d:] - coef @ mean[:d])

    def loss(self, model: LinearModel) -> np.ndarray:
        """Mean squared error of each label."""
        d = model.coef.shape[1]
        # Residual = (-intercept, -coef, 1 at its label) . z.
        turn = np.hstack([-model.intercept[:, None], -model.coef, np.eye(self.labels)])
        assert turn.shape[1] == 1 + d + self.labels
        return np.maximum(np.einsum("ij,jk,ik->i", turn, self.matrix, turn), 0) / self.matrix[0, 0]


def moments(rows: DataFrame, keys: list[str], labels: int = HORIZON) -> dict[tuple, Moments]:
    """Moments by key of rows (keys, f, ys); keys are few."""
    names = [*keys, "m"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + ", m binary"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for key, part in b.groupby(keys, dropna=False, sort=False):
                z = np.column_stack([np.ones(len(part)), np.stack(part["f"].to_numpy()), np.stack(part["ys"].to_numpy())])
                sums[key] = sums.get(key, 0) + z.T @ z
        if sums:
            yield pd.DataFrame([(*k, m.tobytes()) for k, m in sums.items()], columns=names)

    def added(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(m) for m in part["m"])
        return part.iloc[:1][keys].assign(m=[total.tobytes()])

    made = rows.select(*keys, "f", "ys").mapInPandas(partial, schema).withColumn(
        "_spread", F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)) + F.pmod(F.spark_partition_id(), F.lit(SPREAD)))
    once = made.groupBy(*keys, "_spread").applyInPandas(lambda p: added(p), schema)
    out = {}
    for r in once.groupBy(*keys).applyInPandas(lambda p: added(p), schema).collect():  # one row a key
        flat = np.frombuffer(r["m"])
        size = int(round(len(flat) ** 0.5))
        out[tuple(r[k] for k in keys)] = Moments(flat.reshape(size, size), labels)
    return out


def fit(rows: DataFrame, penalty: float) -> LinearModel:
    """The ridge fit of all labels over rows (f, ys), in one pass."""
    found = moments(rows.select(F.lit(0).alias("_all"), "f", "ys"), ["_all"])
    if not found:
        raise ValueError("no training windows")
    return found[0,].ridge(penalty)


def residual_moments(rows: DataFrame, model: LinearModel, penalty: float) -> DataFrame:
    """(step, feature, n, moment) of the rows a model was fitted on: the mean
    product of a step's residuals and a feature, less the penalty's share; zero
    in a least-squares fit.  Feature -1 is the constant."""
    coef, intercept = model.coef, model.intercept

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = 0.0, 0
        for b in batches:
            if len(b):
                x = np.stack(b["f"].to_numpy())
                residual = np.stack(b["ys"].to_numpy()) - (x @ coef.T + intercept)
                total, n = total + residual.T @ np.column_stack([np.ones(len(b)), x]), n + len(b)
        if n:
            steps, features = total.shape
            yield pd.DataFrame({"step": np.repeat(np.arange(steps), features), "feature": np.tile(np.arange(features) - 1, steps),
                                "total": total.ravel(), "n": n})

    sums = (rows.select("f", "ys").mapInPandas(partial, "step int, feature int, total double, n long")
            .groupBy("step", "feature").agg(F.sum("total").alias("total"), F.sum("n").alias("n")))
    shares = rows.sparkSession.createDataFrame(
        [(h, j - 1, float(penalty * c)) for h, row in enumerate(coef) for j, c in enumerate(np.append(0.0, row))],
        "step int, feature int, share double")
    return sums.join(shares, ["step", "feature"]).select("step", "feature", "n", r6(F.col("total") / F.col("n") - F.col("share")).alias("moment"))
