"""Linear models solved from moments: scaling, least squares, ridge and lasso need no further pass.

Moments of disjoint rows add up, so one pass over fold blocks gives every expanding fold, its model and
the error of that model on the next block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.operators.moments import Moments, series_moments, total

SINGULAR = 1e-11  # shares of the greatest eigenvalue below this count as none
CONSTANT = 1e-10  # a deviation of at most this share of the mean is rounding, the column is constant
LASSO_SWEEPS, LASSO_TOLERANCE = 1000, 1e-9

# (products per row, cross products with y per row, rows) -> weights; all may carry a leading series axis
Solver = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def least_squares(gram: np.ndarray, cross: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Minimum-norm solution, so repeated or constant columns share or get no weight."""
    return np.einsum("...ij,...j->...i", np.linalg.pinv(gram, rcond=SINGULAR, hermitian=True), cross)


def ridge_solver(alpha: float) -> Solver:
    """Penalty alpha on the sum of squared weights, against the sum (not the mean) of squared errors."""

    def solve(gram: np.ndarray, cross: np.ndarray, n: np.ndarray) -> np.ndarray:
        penalty = (alpha / np.asarray(n, float))[..., None, None] * np.eye(gram.shape[-1])
        return np.linalg.solve(gram + penalty, cross[..., None])[..., 0]

    return solve


def lasso_solver(alpha: float, sweeps: int = LASSO_SWEEPS) -> Solver:
    """Penalty alpha on absolute weights against half the mean squared error, by coordinate descent."""

    def solve(gram: np.ndarray, cross: np.ndarray, n: np.ndarray) -> np.ndarray:
        weights, size = np.zeros(cross.shape), np.diagonal(gram, axis1=-2, axis2=-1)
        scale = np.where(size > 0, size, 1.0)
        for _ in range(sweeps):
            before = weights.copy()
            for j in range(cross.shape[-1]):
                pull = cross[..., j] - np.einsum("...i,...i->...", gram[..., j, :], weights) + size[..., j] * weights[..., j]
                shrunk = np.sign(pull) * np.maximum(np.abs(pull) - alpha, 0.0) / scale[..., j]
                weights[..., j] = np.where(size[..., j] > 0, shrunk, 0.0)
            if np.abs(weights - before).max(initial=0.0) < LASSO_TOLERANCE:
                break
        return weights

    return solve


@dataclass(frozen=True)
class Plane:
    """A fitted linear function: weights of the columns as they are, and those of the scaled columns."""

    intercept: float
    weights: np.ndarray
    coefficients: np.ndarray

    def column(self, columns: Sequence[str]) -> Column:
        value = F.lit(float(self.intercept))
        for c, w in zip(columns, self.weights):
            value = value + F.lit(float(w)) * F.col(c)
        return value

    def mean_squared_error(self, moments: Moments) -> float:
        """Error on the rows of the moments, whose last column is y."""
        direction = np.append(-self.weights, 1.0)
        bias = float(direction @ moments.mean) - self.intercept
        return max(float(direction @ moments.products @ direction) / moments.n, 0.0) + bias * bias


def _design(mean: np.ndarray, spread: np.ndarray, scaled: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(products, cross products, scale) of the design columns; constant columns have no products, and so no weight.

    All may carry a leading series axis.
    """
    deviation = np.sqrt(np.maximum(np.diagonal(spread, axis1=-2, axis2=-1)[..., :-1], 0.0))
    varies = deviation > CONSTANT * np.abs(mean[..., :-1])
    scale = np.where(varies, deviation, 1.0) if scaled else np.ones(deviation.shape)
    part = varies / scale
    gram = spread[..., :-1, :-1] * part[..., :, None] * part[..., None, :]
    return gram, spread[..., :-1, -1] * part, scale


def solve_planes(solver: Solver, moments: Sequence[Moments], scaled: bool) -> list[Plane]:
    """For each moments: the last column fitted on the others, centred, and scaled to unit deviation if wanted.

    All systems are solved together.
    """
    if not moments:
        return []
    n, mean = np.array([m.n for m in moments]), np.stack([m.mean for m in moments])
    spread = np.stack([m.products for m in moments]) / n[:, None, None]
    gram, cross, scale = _design(mean, spread, scaled)
    coefficients = solver(gram, cross, n)
    weights = coefficients / scale
    intercepts = mean[:, -1] - (weights * mean[:, :-1]).sum(axis=1)
    return [Plane(float(i), w, c) for i, w, c in zip(intercepts, weights, coefficients)]


def fit_with_folds(
    solver: Solver, blocks: dict[int, Moments], width: int, n_splits: int, scaled: bool
) -> tuple[Plane, list[float]]:
    """The model of all blocks, and the RMSE on block i of the model of all blocks before it.

    Folds without rows on either side are left out.
    """
    known = [total((blocks[b] for b in sorted(blocks) if b < fold), width) for fold in range(1, n_splits + 1)]
    folds = [fold for fold, m in enumerate(known, 1) if m.n and fold in blocks]
    whole = total((blocks[b] for b in sorted(blocks)), width)
    plane, *planes = solve_planes(solver, [whole, *(known[fold - 1] for fold in folds)], scaled)
    return plane, [p.mean_squared_error(blocks[fold]) ** 0.5 for p, fold in zip(planes, folds)]


def _square(flat: np.ndarray, width: int) -> np.ndarray:
    """Full symmetric products out of their upper rows, for many series at once."""
    full = np.zeros((len(flat), width, width))
    rows, columns = np.triu_indices(width)
    full[:, rows, columns] = flat
    full[:, columns, rows] = flat
    return full


def fit_series(
    df: DataFrame, columns: Sequence[str], y: str, keys: Sequence[str], solver: Solver = least_squares, scaled: bool = True
) -> DataFrame:
    """One model per key: (keys, n, intercept, weights), weights in the order of the columns.

    The products come from one grouped aggregation; systems of a batch of keys are solved together, so
    the number of series costs rows, not jobs or calls.
    """
    width = len(columns) + 1

    def solve(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for n, means, products in batches:
            rows = n.to_numpy(float)
            mean = np.stack(means.to_numpy())
            spread = _square(np.stack(products.to_numpy()), width) / rows[:, None, None]
            gram, cross, scale = _design(mean, spread, scaled)
            weights = solver(gram, cross, rows) / scale
            intercept = mean[:, -1] - (weights * mean[:, :-1]).sum(axis=1)
            yield pd.DataFrame({"intercept": intercept, "weights": list(weights)})

    solved = F.pandas_udf("intercept double, weights array<double>")(_typed(solve))
    moments = series_moments(df, [*columns, y], keys)
    fitted = moments.select(*keys, "n", solved("n", "means", "products").alias("fit"))
    return fitted.select(*keys, F.col("n").cast("bigint").alias("n"), "fit.*")


def _typed(solve):
    """The iterator signature that the column function is recognised by."""

    def typed(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        return solve(batches)

    typed.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return typed


def predict_series(df: DataFrame, fitted: DataFrame, columns: Sequence[str], keys: Sequence[str], pred: str = "pred") -> DataFrame:
    """df with the prediction of its own key's model; rows of keys without a model get null."""
    value = F.col("intercept")
    for i, c in enumerate(columns):
        value = value + F.col("weights")[i] * F.col(c)
    joined = df.join(fitted.select(*keys, "intercept", "weights"), list(keys), "left")
    return joined.withColumn(pred, value).drop("intercept", "weights")
