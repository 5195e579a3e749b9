"""Non-negative linear blending of model columns from pre-aggregated moments."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.scalar import col
from shelfcast.operators.ordinal import with_position

ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)  # fixed values
FOLDS = 3


@dataclass(frozen=True)
class Blend:
    """Fitted blend: intercept plus a non-negative coefficient per model."""

    coefficients: dict[str, float]
    intercept: float
    alpha: float
    cv_rmse: dict[float, float] = field(default_factory=dict)

    @property
    def weights(self) -> dict[str, float]:
        total = sum(self.coefficients.values())
        n = len(self.coefficients)
        return {k: (v / total if total > 0 else 1.0 / n) for k, v in self.coefficients.items()}


@dataclass(frozen=True)
class _Moments:
    n: float
    mean: np.ndarray
    scatter: np.ndarray  # sums of products around the mean; the last column is the target

    def merged(self, other: _Moments) -> _Moments:
        if self.n == 0 or other.n == 0:
            return other if self.n == 0 else self
        n, gap = self.n + other.n, other.mean - self.mean
        shift = np.outer(gap, gap) * (self.n * other.n / n)
        return _Moments(n, self.mean + gap * (other.n / n), self.scatter + other.scatter + shift)


def fold_blocks(df: DataFrame, order: tuple[str, ...], folds: int = FOLDS) -> DataFrame:
    """Tag each row with the expanding-window fold it is tested in: 0 is only ever trained on,
    fold k trains on the blocks below k. Rows are placed in the given total order."""
    placed = with_position(df, [], order, "pos")
    rows = df.agg(F.count(F.lit(1))).scalar()
    size = F.floor(rows / (folds + 1))
    first = rows - size * folds
    block = F.when(F.col("pos") < first, 0).otherwise(F.floor(F.try_divide(F.col("pos") - first, size)) + 1)
    return placed.withColumn("fold", block.cast("int"))


def _moments_by_block(df: DataFrame, actual: str, columns: list[Column]) -> list[_Moments]:
    xs = [c.cast("double") for c in columns] + [F.col(actual).cast("double")]
    k = len(xs)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    aggs += [F.covar_pop(xs[i], xs[j]).alias(f"c{i}_{j}") for i, j in pairs]
    by_fold = {r["fold"]: r for r in df.groupBy("fold").agg(*aggs).collect()}  # at most FOLDS + 1 rows
    out = []
    for b in range(FOLDS + 1):
        r = by_fold.get(b)
        if r is None:
            out.append(_Moments(0, np.zeros(k), np.zeros((k, k))))
            continue
        scatter = np.zeros((k, k))
        for i, j in pairs:
            scatter[i, j] = scatter[j, i] = r[f"c{i}_{j}"] * r["n"]
        out.append(_Moments(r["n"], np.array([r[f"m{i}"] for i in range(k)]), scatter))
    return out


def nonnegative_solution(gram: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Minimise w'Gw - 2t'w over w >= 0 with an active set: the coefficient whose gain is steepest
    joins, and those that would turn negative leave again."""
    m = len(target)
    w, active = np.zeros(m), np.zeros(m, bool)
    least = 1e-10 * max(1.0, float(np.abs(target).max(initial=0.0)))
    for _ in range(10 * m):
        gain = np.where(active, -np.inf, target - gram @ w)
        if gain.max(initial=-np.inf) <= least:
            break
        active[int(gain.argmax())] = True
        while True:
            idx = np.flatnonzero(active)
            best = np.linalg.lstsq(gram[np.ix_(idx, idx)], target[idx], rcond=None)[0]
            if (best > 0).all():
                w = np.zeros(m)
                w[idx] = best
                break
            falling = best <= 0
            step = (w[idx][falling] / (w[idx][falling] - best[falling])).min()
            w[idx] += step * (best - w[idx])
            active &= w > 1e-14
            w[~active] = 0.0
            if not active.any():
                break
    return w


def optimality(df: DataFrame, actual: str, models: Mapping[str, str | Column], blend: Blend) -> DataFrame:
    """One row per model: coefficient and slope of the penalised fit in it, relative to the sizes of
    model and error. At the best blend the slope is 0 where the coefficient is positive, else not
    positive."""
    names = sorted(models)
    point = F.lit(blend.intercept)
    for n in names:
        point = point + F.lit(blend.coefficients[n]) * col(models[n])
    error = F.col(actual) - point
    parts = []
    for n in names:
        x = col(models[n]).cast("double")
        slope = F.covar_pop(x, error) * F.count(x) - F.lit(blend.alpha * blend.coefficients[n])
        size = F.count(x) * F.stddev_pop(x) * F.stddev_pop(F.col(actual))
        parts.append(F.struct(F.lit(n).alias("model"), F.lit(blend.coefficients[n]).alias("coefficient"), F.try_divide(slope, size).alias("slope")))
    return df.agg(F.array(*parts).alias("rows")).select(F.inline("rows"))


def _solve(moments: _Moments, alpha: float) -> tuple[np.ndarray, float]:
    m = len(moments.mean) - 1
    gram = moments.scatter[:m, :m] + alpha * np.eye(m)
    w = nonnegative_solution(gram, moments.scatter[:m, m])
    return w, float(moments.mean[m] - w @ moments.mean[:m])


def _rmse(moments: _Moments, w: np.ndarray, intercept: float) -> float:
    v = np.append(-w, 1.0)
    centre = float(v @ moments.mean) - intercept
    return float(np.sqrt(max(v @ moments.scatter @ v, 0.0) / moments.n + centre * centre))


def fit_blend(
    df: DataFrame,
    actual: str,
    models: Mapping[str, str | Column],
    order: tuple[str, ...] = ("date", "store_nbr", "family"),
    regularized: bool = True,
) -> Blend:
    """Ridge blend with the penalty chosen over expanding folds, or plain least squares. The
    rows are only aggregated into one small moment table per fold block; the solve on it is
    a problem of as many unknowns as models."""
    names = sorted(models)
    columns = [col(models[n]) for n in names]
    tagged = fold_blocks(df, order) if regularized else df.withColumn("fold", F.lit(0))
    blocks = _moments_by_block(tagged, actual, columns)
    if sum(b.n for b in blocks) == 0:
        raise ValueError("no rows to fit a blend on")
    prefix = [blocks[0]]
    for b in blocks[1:]:
        prefix.append(prefix[-1].merged(b))
    scores: dict[float, float] = {}
    if regularized:
        usable = [k for k in range(1, FOLDS + 1) if prefix[k - 1].n > 0 and blocks[k].n > 0]
        for alpha in ALPHAS:
            each = [_rmse(blocks[k], *_solve(prefix[k - 1], alpha)) for k in usable]
            scores[alpha] = float(np.mean(each)) if each else float("inf")
        alpha = min(ALPHAS, key=lambda x: scores[x]) if usable else 1.0
    else:
        alpha = 0.0
    w, intercept = _solve(prefix[-1], alpha)
    return Blend(dict(zip(names, map(float, w))), intercept, alpha, scores)
