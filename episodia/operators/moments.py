"""Linear models from sums: one pass holds what any number of least-squares fits need.

A task adds up cross products of the median-filled features and labels, by label
(rows that lack it do not count) and by group; the driver gets one small matrix each.
Ridge paths, models with some of the features, validation errors and fits that leave a
fold out are arithmetic on these matrices.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodia.operators.models import LinearScore

#: accuracy of medians; a smaller table's are exact
RANKS = 100_000


@dataclass
class Moments:
    """Cross products of (1, features, label) by (group, label), centred at ``centre``."""

    features: list[str]
    centre: dict[str, np.ndarray]
    sums: dict[tuple, np.ndarray]

    def of(self, label: str, groups: Sequence | None = None) -> np.ndarray:
        size = len(self.features) + 2
        some = [m for (g, l), m in self.sums.items() if l == label and (groups is None or g in groups)]
        return sum(some, np.zeros((size, size)))

    def fit(self, label: str, features: Sequence[str] | None = None, alpha: float = 0.0, standardised: bool = False, groups: Sequence | None = None) -> LinearScore:
        """Least squares of ``label``; ``alpha`` penalises the squared weights (of standardised features), never the intercept."""
        used = list(features or self.features)
        at = [1 + self.features.index(c) for c in used]
        m = self.of(label, groups)
        n = max(m[0, 0], 1.0)
        mean_x, mean_y = m[0, at] / n, m[0, -1] / n
        xx = m[np.ix_(at, at)] - n * np.outer(mean_x, mean_x)
        xy = m[at, -1] - n * mean_x * mean_y
        penalty = np.diag(xx) / max(n - 1, 1.0) if standardised else np.ones(len(at))
        w = np.linalg.lstsq(xx + alpha * np.diag(penalty), xy, rcond=None)[0] if at else np.zeros(0)
        centre = self.centre[label][[i - 1 for i in at]]
        return LinearScore(used, [float(x) for x in w], float(mean_y - w @ (mean_x + centre)), dict(zip(used, map(float, centre))))

    def squared_error(self, model: LinearScore, label: str, groups: Sequence | None = None) -> float:
        """Mean squared error of a model fitted here, on the rows of ``groups``."""
        m = self.of(label, groups)
        v = np.zeros(len(m))
        at = [self.features.index(c) for c in model.features]
        w = np.array(model.weights)
        v[[1 + i for i in at]] = -w
        v[0] = -(model.intercept + w @ self.centre[label][at])
        v[-1] = 1.0
        return float(v @ m @ v / m[0, 0]) if m[0, 0] else float("nan")

    def path(self, label: str, alphas: Sequence[float], train: Sequence, valid: Sequence, **options) -> list[tuple[float, LinearScore, float]]:
        """(penalty, model, validation error) for every penalty."""
        fits = [(a, self.fit(label, alpha=a, groups=train, **options)) for a in alphas]
        return [(a, m, self.squared_error(m, label, valid)) for a, m in fits]


def moments(df: DataFrame, features: Sequence[str], labels: Sequence[str], group: Column | None = None, fill_groups: Sequence | None = None) -> Moments:
    """Sums for all fits of ``labels`` on ``features`` by ``group`` (few values).

    Missing features take the median over the rows that have the label (of ``fill_groups`` only, if given);
    sums are taken around it.
    """
    rows = df.select((group if group is not None else F.lit(None)).cast("string").alias("_g"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)],
                     *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(labels)])
    counts = F.lit(True) if fill_groups is None else F.col("_g").isin([str(g) for g in fill_groups])
    cells = [F.percentile_approx(F.when(counts & F.col(f"y{j}").isNotNull(), F.col(f"x{i}")), F.lit(0.5), F.lit(RANKS)).alias(f"m{j}_{i}") for j in range(len(labels)) for i in range(len(features))]
    found = rows.agg(*cells).first() if cells else []
    centre = {c: np.array([float(v or 0.0) for v in found[j * len(features):(j + 1) * len(features)]]) for j, c in enumerate(labels)}
    upper = np.triu_indices(len(features) + 2)
    names, wanted = [f"s{i}" for i in range(len(upper[0]))], list(labels)

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            group_of = np.array(batch.column(0).to_pylist(), object)
            columns = [batch.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i in range(batch.num_columns - 1)]
            x, ys = np.stack(columns[:len(features)], 1) if features else np.zeros((batch.num_rows, 0)), columns[len(features):]
            for g in set(group_of):
                for label, y in zip(wanted, ys):
                    some = (group_of == g) & ~np.isnan(y)
                    z = np.concatenate([np.ones((some.sum(), 1)), np.nan_to_num(x[some] - centre[label]), y[some, None]], 1)
                    sums[g, label] = sums.get((g, label), 0.0) + z.T @ z
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()),
             *[pa.array([m[upper][i] for m in sums.values()], pa.float64()) for i in range(len(names))]], ["_g", "label", *names])

    parts = rows.mapInArrow(run, "_g string, label string, " + ", ".join(f"{n} double" for n in names))
    out = {}
    for r in parts.groupBy("_g", "label").agg(*[F.sum(n).alias(n) for n in names]).collect():  # one row a group and label
        m = np.zeros((len(features) + 2,) * 2)
        m[upper] = r[2:]
        out[r["_g"], r["label"]] = m + np.triu(m, 1).T
    return Moments(list(features), centre, out)


def left_out_errors(df: DataFrame, m: Moments, label: str, alphas: Sequence[float]) -> list[float]:
    """Mean squared error of each row under the fit without it, for every penalty, from one more pass.

    A row's residual grows by one over one minus its leverage, which the inverse of the sums gives.
    ``df`` holds the rows that ``m`` was made of.
    """
    k = len(m.features)
    s = m.of(label)
    n = s[0, 0]
    mean = s[0, 1:-1] / n
    xx = s[1:-1, 1:-1] - n * np.outer(mean, mean)
    fits = [m.fit(label, alpha=a) for a in alphas]
    weights = np.array([f.weights for f in fits]).T
    at_mean = np.array([f.intercept for f in fits]) + (mean + m.centre[label]) @ weights
    inverse = [np.linalg.pinv(xx + a * np.eye(k)) for a in alphas]
    centre, size = m.centre[label], len(alphas)

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(k + 1)]
            x, y = np.nan_to_num(np.stack(columns[:k], 1) - centre) - mean, columns[k]
            leverage = np.stack([1 / n + np.einsum("ij,jk,ik->i", x, v, x) for v in inverse], 1)
            residual = y[:, None] - at_mean - x @ weights
            total += ((residual / np.maximum(1 - leverage, 1e-12)) ** 2).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], [f"e{i}" for i in range(size)])

    rows = df.filter(F.col(label).isNotNull()).select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(m.features)], F.col(label).cast("double").alias("y"))
    sums = rows.mapInArrow(run, ", ".join(f"e{i} double" for i in range(size))).agg(*[F.sum(f"e{i}") for i in range(size)]).first()
    return [float(v or 0.0) / max(n, 1.0) for v in sums]


def ridge_left_out(df: DataFrame, features: Sequence[str], label: str, alphas: Sequence[float]) -> tuple[LinearScore, float]:
    """The penalty with the smallest left-out error and its model; two passes for the whole path."""
    m = moments(df, features, [label])
    errors = left_out_errors(df, m, label, alphas)
    best = int(np.argmin(errors))
    return m.fit(label, alpha=alphas[best]), alphas[best]
