"""Boosted trees for many targets at once, and forests as flat arrays that score inside the row.

Features are turned into bin numbers once.  A score depends on the bins alone, so rows of
equal bins become one row with counts and sums of their targets, which give the same
gradients.  A level of all targets' trees costs one pass over these: each task adds up
gradients by (target, node, feature, bin) and sends its
sums, Spark adds them up, and the driver picks the splits from a table whose size
depends on the model alone.  Every ``KEEP`` rounds the scores so far are written, so a pass
walks a bounded number of trees.

Fitted Q grows a forest a round, thousands of trees that depend on each other.  Up to
``WHOLE_ROWS`` different rows one task holds them and grows a whole forest; more take the passes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodia.functions.scalars import decode_bit
from episodia.session import durable

#: rounds between two written states of the scores
KEEP = 5
#: sums that the tasks of a pass may send to the driver without being added up by a shuffle
DIRECT_CELLS = 1 << 20
#: different rows of bins that one task may hold while it grows a forest
WHOLE_ROWS = 1 << 20


def walk(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node that each row of bin numbers ends in; nodes ``2i + 1`` and ``2i + 2`` are below ``i``."""
    node = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    for _ in range(depth):
        f = feature[node]
        down = 2 * node + 1 + (bins[rows, np.maximum(f, 0)] > cut[node])
        node = np.where(f >= 0, down, node)
    return node


@dataclass
class Forest:
    """Trees as arrays (tree, node): feature (-1 at a leaf), last bin that goes left, value."""

    features: list[str]
    cuts: list[np.ndarray]
    base: float
    depth: int
    logistic: bool = False
    bounds: tuple[float, float] | None = None
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    gains: np.ndarray | None = None

    def binned(self, columns: Sequence) -> np.ndarray:
        """Bin numbers: 0 for a missing value, else 1 and the number of cuts below it."""
        out = np.zeros((len(columns[0]) if columns else 0, len(columns)), np.int16)
        for i, (x, cuts) in enumerate(zip(columns, self.cuts)):
            x = np.asarray(x, np.float64)
            out[:, i] = np.where(np.isnan(x), 0, 1 + np.searchsorted(cuts, x))
        return out

    def margins(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        total = np.zeros(len(bins))
        for f, c, v in zip(self.feature[first:], self.cut[first:], self.value[first:]):
            total += v[walk(bins, f, c, self.depth)]
        return total

    def predicted(self, bins: np.ndarray) -> np.ndarray:
        return self._outcome(self.margins(bins))

    def _outcome(self, margins: np.ndarray) -> np.ndarray:
        out = self.base + margins
        out = 1 / (1 + np.exp(-out)) if self.logistic else out
        return np.clip(out, *self.bounds) if self.bounds else out

    def _inputs(self, overrides: Mapping[str, Column] | None) -> list[Column]:
        over = overrides or {}
        return [over.get(c, F.col(c)).cast("double") for c in self.features]

    def column(self, overrides: Mapping[str, Column] | None = None) -> Column:
        """The prediction (a probability for a logistic forest) as a column."""
        def score(*xs: pd.Series) -> pd.Series:
            return pd.Series(self.predicted(self.binned(xs)))

        score.__annotations__ = {"xs": pd.Series, "return": pd.Series}
        return F.pandas_udf(score, "double")(*self._inputs(overrides))

    def score(self, df: DataFrame, name: str, overrides: Mapping[str, Column] | None = None) -> DataFrame:
        return df.withColumn(name, self.column(overrides))

    def flag_margins(self, bins: np.ndarray, at: Sequence[int], off: Sequence[int], on: Sequence[int]) -> np.ndarray:
        """Margins (row, setting) under all settings of the features ``at``, each tree passed once for all of them.

        A leaf is reached by rows and by settings; of a tree each pair reaches one leaf, so the product
        of both adds nothing but zeros to its value.
        """
        codes, place = np.arange(1 << len(at)), {i: k for k, i in enumerate(at)}
        total = np.zeros((len(bins), len(codes)))
        for f, c, v in zip(self.feature, self.cut, self.value):
            todo, ends = [(0, np.ones(len(bins), bool), np.ones(len(codes), bool))], []
            while todo:
                node, rows, settings = todo.pop()
                j = f[node]
                if j < 0:
                    ends.append((rows, settings * v[node]))
                elif j in place:
                    k = place[j]
                    high = np.where(codes >> k & 1, on[k], off[k]) > c[node]
                    todo += [(2 * node + 1 + i, rows, settings & s) for i, s in enumerate((~high, high)) if (settings & s).any()]
                else:
                    high = bins[:, j] > c[node]
                    todo += [(2 * node + 1, rows & ~high, settings), (2 * node + 2, rows & high, settings)]
            total += np.stack([r for r, _ in ends], 1).astype(np.float64) @ np.stack([s for _, s in ends])
        return total

    def _all_settings(self, flags: Sequence[str]):
        at, off, on = self.flag_bins(flags)
        return lambda xs: self.under_settings(self.binned(xs), at, off, on)

    def under_settings(self, bins: np.ndarray, at: Sequence[int], off: Sequence[int], on: Sequence[int]) -> np.ndarray:
        """Predictions (row, setting); rows that differ in the features ``at`` alone are scored once."""
        bins = bins.copy()
        bins[:, at] = 0
        once, of = np.unique(bins, axis=0, return_inverse=True)
        return self._outcome(self.flag_margins(once, at, off, on))[of.reshape(-1)]

    def flag_bins(self, flags: Sequence[str]) -> tuple[list[int], list[int], list[int]]:
        """Places of ``flags`` among the features and the bins of 0 and of 1 there."""
        at = [self.features.index(c) for c in flags]
        return at, *([int(self.binned([np.array([v])] * len(self.features))[0, i]) for i in at] for v in (0.0, 1.0))

    def over_flags(self, flags: Sequence[str], overrides: Mapping[str, Column] | None = None) -> Column:
        """Predictions under all on/off settings of ``flags``, as an array indexed by their bit code.

        Rows are not repeated: a batch is binned once and each tree is passed once.
        """
        predicted = self._all_settings(flags)

        def score(*xs: pd.Series) -> pd.Series:
            return pd.Series(list(predicted(xs)), dtype=object)

        score.__annotations__ = {"xs": pd.Series, "return": pd.Series}
        return F.pandas_udf(score, "array<double>")(*self._inputs(overrides))

    def best_over_flags(self, flags: Sequence[str], overrides: Mapping[str, Column] | None = None, largest: bool = True) -> Column:
        """Best prediction over all settings of ``flags`` and the lowest bit code that has it, as (value, code)."""
        predicted = self._all_settings(flags)

        def score(*xs: pd.Series) -> pd.DataFrame:
            values = predicted(xs)
            code = values.argmax(1) if largest else values.argmin(1)
            return pd.DataFrame({"value": values[np.arange(len(values)), code], "code": code.astype(np.int32)})

        score.__annotations__ = {"xs": pd.Series, "return": pd.DataFrame}
        return F.pandas_udf(score, "value double, code int")(*self._inputs(overrides))

    def importances(self) -> dict[str, float]:
        """Share of the gain that splits on each feature brought."""
        total = float(self.gains.sum()) or 1.0
        return {c: float(g) / total for c, g in zip(self.features, self.gains)}


def quantile_cuts(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Distinct approximate quantiles of each feature, all from one aggregation."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, F.lit(100_000)).alias(f"c{i}") for i, c in enumerate(features)]).first()
    return [np.unique(np.array(v or [], np.float64)) for v in row]


def fit_forests(df: DataFrame, features: Sequence[str], targets: Mapping[str, bool], trees: int = 300, depth: int = 6, rate: float = 0.05,
                bins: int = 64, least_rows: int = 20, balanced: bool = False, ridge: float = 0.0,
                bounds: Mapping[str, tuple[float, float]] | None = None, cuts: list[np.ndarray] | None = None) -> dict[str, Forest]:
    """One boosted forest for each of ``targets`` (column to whether it is a 0/1 label), grown together.

    Rows without a target do not count for it; missing features go left.  Labels take the
    logistic loss, with equal total weight of both classes if ``balanced``; numbers the squared
    loss.  A split needs ``least_rows`` on each side and a positive gain.
    """
    names = list(targets)
    cuts = cuts or quantile_cuts(df, features, bins)
    n_t, n_f = len(names), len(features)
    pairs = _pairs(targets)
    unfitted = Forest(list(features), cuts, 0.0, depth)

    def prepare(batches):
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_f)]
            rows = unfitted.binned(columns).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), *[batch.column(n_f + i) for i in range(n_t)]],
                                             ["bins", *[f"y{i}" for i in range(n_t)]])

    start = df.select(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)],
                      *[F.nanvl(F.col(t).cast("double"), F.lit(None).cast("double")).alias(f"y{i}") for i, t in enumerate(names)])
    binned = start.mapInArrow(prepare, "bins binary" + "".join(f", y{i} double" for i in range(n_t)))
    known = [F.col(f"y{i}") if side is None else F.when((F.col(f"y{i}") > 0.5) == side, F.col(f"y{i}")) for i, side in pairs]
    state = durable(binned.groupBy("bins").agg(
        *[F.count(y).cast("double").alias(f"n{p}") for p, y in enumerate(known)], *[F.coalesce(F.sum(y), F.lit(0.0)).alias(f"t{p}") for p, y in enumerate(known)]
    ).select("*", *[F.lit(0.0).alias(f"s{i}") for i in range(n_t)]))
    return grown(state, features, cuts, targets, trees, depth, rate, least_rows, balanced, ridge, bounds)


def _pairs(targets: Mapping[str, bool]) -> list[tuple]:
    """One pair of count and sum for a number, one for each class of a label."""
    return [(i, side) for i, logistic in enumerate(targets.values()) for side in ((False, True) if logistic else (None,))]


def grown(state: DataFrame, features: Sequence[str], cuts: list[np.ndarray], targets: Mapping[str, bool], trees: int = 300, depth: int = 6, rate: float = 0.05,
          least_rows: int = 20, balanced: bool = False, ridge: float = 0.0, bounds: Mapping[str, tuple[float, float]] | None = None) -> dict[str, Forest]:
    """Forests from ``state``: different rows of bins, counts and sums of each pair, scores so far."""
    names, flags = list(targets), [bool(v) for v in targets.values()]
    n_t, n_f, n_b = len(names), len(features), max(len(c) for c in cuts) + 2
    pairs = _pairs(targets)
    of = [[p for p, (t, _) in enumerate(pairs) if t == i] for i in range(n_t)]
    kept = ", ".join(["bins binary", *[f"{c}{p} double" for c in "nt" for p in range(len(pairs))], *[f"s{i} double" for i in range(n_t)]])
    first, tasks = 0, state.select(F.spark_partition_id().alias("p")).distinct().count()
    whole = state.agg(*[F.sum(f"{c}{p}").alias(f"{c}{p}") for c in "nt" for p in range(len(pairs))]).first()
    forests, weights = [], []
    for i, (name, logistic) in enumerate(zip(names, flags)):
        rows, total = (sum(whole[f"{c}{p}"] or 0.0 for p in of[i]) for c in "nt")
        m = total / rows if rows else 0.0
        share = min(max(m, 1e-9), 1 - 1e-9)
        weights.append((0.5 / (1 - share), 0.5 / share) if logistic and balanced else (1.0, 1.0))
        base = (0.0 if balanced else float(np.log(share / (1 - share)))) if logistic else m
        forests.append(Forest(list(features), cuts, base, depth, logistic, (bounds or {}).get(name), gains=np.zeros(len(features))))

    def parts(batch):
        rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint16).reshape(-1, n_f)
        cells = [batch.column(i + 1).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(2 * len(pairs) + n_t)]
        return rows, cells[:len(pairs)], cells[len(pairs):2 * len(pairs)], cells[2 * len(pairs):]

    for k in range(trees):
        size = (1 << (depth + 1)) - 1
        for f in forests:
            f.feature.append(np.full(size, -1))
            f.cut.append(np.zeros(size, np.int64))
            f.value.append(np.zeros(size))
        for level in range(depth):
            low = (1 << level) - 1
            if level and not any((f.feature[-1][(low - 1) // 2:low] >= 0).any() for f in forests):
                break
            grown = [(f.logistic, f.base, [t[first:] for t in (f.feature, f.cut, f.value)]) for f in forests]

            def run(batches, level=level, low=low, grown=grown):
                width = (1 << level) * n_f * n_b
                sums = np.zeros((n_t, 3, width))
                for batch in batches:
                    rows, counts, totals, scores = parts(batch)
                    for i, (logistic, base, (feature, cut, value)) in enumerate(grown):
                        n = sum(counts[p] for p in of[i])
                        here = walk(rows, feature[-1], cut[-1], level) - low
                        some = np.flatnonzero((here >= 0) & (n > 0))
                        here_rows, node, n = rows[some], here[some], n[some]
                        s = base + scores[i][some] + sum(v[walk(here_rows, a, c, depth)] for a, c, v in zip(feature[:-1], cut[:-1], value[:-1]))
                        if logistic:
                            p = 1 / (1 + np.exp(-s))
                            g = sum(w * (p * counts[k][some] - totals[k][some]) for w, k in zip(weights[i], of[i]))
                            h = p * (1 - p) * sum(w * counts[k][some] for w, k in zip(weights[i], of[i]))
                        else:
                            g, h = n * s - totals[of[i][0]][some], n
                        for j in range(n_f):
                            cell = (node * n_f + j) * n_b + here_rows[:, j]
                            for m, v in enumerate((g, h, n)):
                                sums[i, m] += np.bincount(cell, v, width)
                target, cell = np.nonzero(sums[:, 2])
                yield pa.RecordBatch.from_arrays([pa.array(target * width + cell), *[pa.array(sums[target, m, cell]) for m in range(3)]], ["cell", "g", "h", "n"])

            cells = n_t * (1 << level) * n_f * n_b
            said = state.mapInArrow(run, "cell long, g double, h double, n double")
            if tasks * cells > DIRECT_CELLS:
                said = said.groupBy("cell").agg(*[F.sum(c).alias(c) for c in "ghn"])
            said = said.toArrow()
            at = said.column("cell").to_numpy()
            table = np.stack([np.bincount(at, said.column(c).to_numpy(), cells) for c in "ghn"])
            _split(table.reshape(3, n_t, 1 << level, n_f, n_b), forests, level, rate, least_rows, ridge)
        if (k + 1 - first) >= KEEP and k + 1 < trees:
            def settle(batches, begin=first):
                for batch in batches:
                    rows, _, _, scores = parts(batch)
                    new = [pa.array(s + f.margins(rows, begin)) for s, f in zip(scores, forests)]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:1 + 2 * len(pairs)], *new], batch.schema.names)

            state, first = durable(state.mapInArrow(settle, kept)), k + 1
    return dict(zip(names, forests))


def fit_whole(state: DataFrame, features: Sequence[str], cuts: list[np.ndarray], target: str, trees: int = 300, depth: int = 6, rate: float = 0.05,
              least_rows: int = 20, balanced: bool = False, ridge: float = 0.0, bounds: Mapping[str, tuple[float, float]] | None = None) -> Forest:
    """The forest of one number from ``bins, n0, t0`` (different rows of bins, counts and sums), grown in one task if it can hold them."""
    if state.count() > WHOLE_ROWS:
        return grown(state.withColumn("s0", F.lit(0.0)), features, cuts, {target: False}, trees, depth, rate, least_rows, balanced, ridge, bounds)[target]
    n_f = len(features)

    def run(batches):
        held = [(b.column(0).to_pylist(), *[b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)]) for b in batches]
        keys = np.array([k for b in held for k in b[0]], dtype=object)
        rows = np.frombuffer(b"".join(keys), np.uint16).reshape(-1, n_f)
        n, total = (np.concatenate([b[i] for b in held] or [np.zeros(0)]) for i in (1, 2))
        order = np.lexsort(rows.T)  # sums do not depend on the order of arrival
        f = grow_whole(rows[order], n[order], total[order], Forest(list(features), cuts, 0.0, depth, gains=np.zeros(n_f)), trees, rate, least_rows, ridge)
        trees_of = [pa.array([x.tolist() for x in part], kind) for part, kind in ((f.feature, pa.list_(pa.int32())), (f.cut, pa.list_(pa.int32())), (f.value, pa.list_(pa.float64())))]
        yield pa.RecordBatch.from_arrays([pa.array(range(trees), pa.int32()), *trees_of, pa.array([f.base] * trees, pa.float64()), pa.array([f.gains.tolist()] * trees, pa.list_(pa.float64()))],
                                         ["tree", "feature", "cut", "value", "base", "gains"])

    said = state.select("bins", "n0", "t0").coalesce(1).mapInArrow(run, "tree int, feature array<int>, cut array<int>, value array<double>, base double, gains array<double>").collect()
    said = sorted(said, key=lambda r: r["tree"])
    out = Forest(list(features), cuts, said[0]["base"] if said else 0.0, depth, False, (bounds or {}).get(target), gains=np.array(said[0]["gains"]) if said else np.zeros(n_f))
    out.feature, out.cut, out.value = ([np.array(r[c]) for r in said] for c in ("feature", "cut", "value"))
    return out


def grow_whole(rows: np.ndarray, n: np.ndarray, total: np.ndarray, forest: Forest, trees: int, rate: float, least_rows: int, ridge: float) -> Forest:
    """Grow ``forest`` on rows of bins with counts and sums of the target.

    A level adds up the rows of the smaller half of each node; the other half is the node without these.
    """
    n_f, n_b, depth = rows.shape[1], max(len(c) for c in forest.cuts) + 2, forest.depth
    width, size, every = n_f * n_b, (1 << (depth + 1)) - 1, np.arange(len(rows))
    columns = [rows[:, j].astype(np.int64) + j * n_b for j in range(n_f)]
    forest.base = float(total.sum() / n.sum()) if n.sum() else 0.0
    margin = np.zeros(len(rows))

    def added(some, at, nodes):
        out = np.zeros((2, nodes * width))
        for column in columns:
            cell = at * width + (column if some is None else column[some])
            for m, v in enumerate((g, n)):
                out[m] += np.bincount(cell, v if some is None else v[some], nodes * width)
        return out.reshape(2, nodes, width)

    for _ in range(trees):
        feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        forest.feature.append(feature)
        forest.cut.append(cut)
        forest.value.append(value)
        g, node = n * (forest.base + margin) - total, np.zeros(len(rows), np.int64)
        sums = added(None, node, 1)
        for level in range(depth):
            nodes, low = 1 << level, (1 << level) - 1
            cells = sums.reshape(2, 1, nodes, n_f, n_b)
            _split(cells[[0, 1, 1]], [forest], level, rate, least_rows, ridge)
            split = feature[low:low + nodes] >= 0
            if not split.any():
                break
            # rows of nodes that end here stay where they are
            here = np.flatnonzero((node >= low) & (feature[node] >= 0)) if not (split.all() and level == 0) else every
            at = node[here]
            node[here] = 2 * at + 1 + (rows[here, feature[at]] > cut[at])
            if level + 1 == depth:
                break
            child = node[here] - (2 * low + 1)
            sizes = np.bincount(child, minlength=2 * nodes).reshape(nodes, 2)
            small = (sizes[:, 1] < sizes[:, 0]).astype(np.int64)
            few = (child & 1) == small[child >> 1]
            lesser = added(here[few], child[few] >> 1, nodes)
            rest = np.where(split[:, None], sums - lesser, 0.0)
            rest[0][rest[1] == 0] = 0.0
            sums = np.empty((2, nodes, 2, width))
            sums[:, np.arange(nodes), small], sums[:, np.arange(nodes), 1 - small] = lesser, rest
            sums = sums.reshape(2, 2 * nodes, width)
        margin += value[node]
    return forest


def _split(table: np.ndarray, forests: Sequence[Forest], level: int, rate: float, least_rows: int, ridge: float) -> None:
    """Split the nodes of a level where that helps most; ties go to the first feature and the lowest bin."""
    low, deepest = (1 << level) - 1, level + 1 == forests[0].depth
    left = table.cumsum(-1)[..., :-1]
    whole = table.sum(-1, keepdims=True)
    right = whole - left

    def gain(x):
        return x[0] * x[0] / np.where(x[1] + ridge > 0, x[1] + ridge, np.inf)

    better = gain(left) + gain(right) - gain(whole)
    better[(left[2] < least_rows) | (right[2] < least_rows)] = -np.inf
    flat = better.reshape(*better.shape[:2], -1)
    # sums in another order differ in their last digits; such gains are ties
    pick = np.argmax(flat >= flat.max(-1, keepdims=True) * (1 - 1e-9), -1)
    for t, f in enumerate(forests):
        for node in range(1 << level):
            j, b = divmod(int(pick[t, node]), better.shape[-1])
            found = better[t, node, j, b]
            if level == 0 and not found > 1e-12:
                g, h, _ = whole[:, t, node, 0, 0]
                f.value[-1][0] = -rate * g / (h + ridge) if h + ridge > 0 else 0.0
            if not found > 1e-12:
                continue
            at = low + node
            f.feature[-1][at], f.cut[-1][at] = j, b
            f.gains[j] += found
            for side, x in ((1, left), (2, right)):
                g, h, _ = x[:, t, node, j, b]
                f.value[-1][2 * at + side] = -rate * g / (h + ridge) if h + ridge > 0 else 0.0


def best_flags(df: DataFrame, forest: Forest, flags: Sequence[str], action: str = "action", value: str = "value", largest: bool = True) -> DataFrame:
    """The flag setting with the best prediction in each row; ties go to the lowest code."""
    out = df.withColumn("_best", forest.best_over_flags(flags, largest=largest))
    out = out.withColumn(value, F.col("_best.value")).withColumn(action, F.col("_best.code")).drop("_best")
    return out.withColumns({f"best_{c}": decode_bit(action, i) for i, c in enumerate(flags)})
