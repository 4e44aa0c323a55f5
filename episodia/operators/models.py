"""Models fitted with Spark ML and applied as columns.

Fitted linear and logistic models are turned into column expressions, so
scoring stays in generated code and needs no vectors.  Boosted trees are
applied with ``transform``.  Only coefficients, medians and importances (one
number per feature) ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodia.functions.scalars import add_effects, clip, decode_bit, uniform
from episodia.operators.aggregates import column_profile
from episodia.operators.forests import Forest, fit_forests, fit_whole, quantile_cuts
from episodia.operators.joins import with_action_grid
from episodia.operators.sampling import best_action, rank_of
from episodia.session import durable

_X = "_features"
#: values of so many next states may be sent to all tasks
FEW_STATES = 1 << 18


def medians(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Median per feature; a feature without values takes 0."""
    known = df.agg(*[F.count(c).alias(c) for c in features]).first()
    present = [c for c in features if known[c] > 0]
    out = {c: 0.0 for c in features}
    if present:
        fitted = Imputer(strategy="median", inputCols=present, outputCols=[f"_i_{c}" for c in present]).fit(
            df.select(*[F.col(c).cast("double").alias(c) for c in present])
        )
        out.update(fitted.surrogateDF.first().asDict())
    return out


def filled(features: Sequence[str], fill: Mapping[str, float], overrides: Mapping[str, Column] | None = None) -> list[Column]:
    over = overrides or {}
    return [
        F.coalesce(over.get(c, F.col(c)).cast("double"), F.lit(float(fill[c]))).alias(c) for c in features
    ]


def assembled(df: DataFrame, features: Sequence[str], fill: Mapping[str, float], keep: Sequence[str],
              overrides: Mapping[str, Column] | None = None) -> DataFrame:
    """``keep`` columns and one feature vector; missing features take ``fill``."""
    names = [f"_f_{c}" for c in features]
    cols = [c.alias(n) for c, n in zip(filled(features, fill, overrides), names)]
    return VectorAssembler(inputCols=names, outputCol=_X).transform(df.select(*keep, *cols)).drop(*names)


# --- linear and logistic -------------------------------------------------------

@dataclass
class LinearScore:
    """Intercept plus weighted, median-filled features; ``logistic`` adds the link."""

    features: list[str]
    weights: list[float]
    intercept: float
    fill: dict[str, float]
    logistic: bool = False

    def column(self, overrides: Mapping[str, Column] | None = None) -> Column:
        cols = filled(self.features, self.fill, overrides)
        margin = reduce(lambda a, b: a + b, [c * F.lit(float(w)) for c, w in zip(cols, self.weights)],
                        F.lit(float(self.intercept)))
        return 1 / (1 + F.exp(-margin)) if self.logistic else margin

    def score(self, df: DataFrame, name: str, overrides: Mapping[str, Column] | None = None) -> DataFrame:
        return df.withColumn(name, self.column(overrides))


def fit_logistic(df: DataFrame, features: Sequence[str], label: str, reg: float = 0.0,
                 balanced: bool = False) -> LinearScore:
    """Median fill, standardise, logistic regression."""
    rows = df.filter(F.col(label).isNotNull())
    fill = medians(rows, features)
    data = assembled(rows, features, fill, [F.col(label).cast("double").alias("label")])
    options = {}
    if balanced:
        mean = rows.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.5
        w1, w0 = 0.5 / max(mean, 1e-9), 0.5 / max(1 - mean, 1e-9)
        data = data.withColumn("weight", F.when(F.col("label") == 1, w1).otherwise(w0))
        options["weightCol"] = "weight"
    model = LogisticRegression(featuresCol=_X, labelCol="label", regParam=reg, standardization=True,
                               maxIter=100, **options).fit(data)
    return LinearScore(list(features), [float(w) for w in model.coefficients], float(model.intercept), fill, True)


def fit_linear(df: DataFrame, features: Sequence[str], label: str, alpha: float = 0.0,
               standardised: bool = False) -> LinearScore:
    """Median fill, least squares; ``alpha`` is the ridge penalty on the sum of squares."""
    rows = df.filter(F.col(label).isNotNull())
    fill = medians(rows, features)
    data = assembled(rows, features, fill, [F.col(label).cast("double").alias("label")])
    reg = 0.0
    if alpha:
        # Spark divides the penalty by the spread of the label
        size = data.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("s")).first()
        reg = alpha / max(size["n"], 1) * (size["s"] or 1.0)
    model = LinearRegression(featuresCol=_X, labelCol="label", regParam=reg, elasticNetParam=0.0,
                             standardization=standardised, solver="normal").fit(data)
    return LinearScore(list(features), [float(w) for w in model.coefficients], float(model.intercept), fill)


def fit_propensities(df: DataFrame, treatments: Sequence[str], confounders: Sequence[str],
                     c: float = 1.0) -> dict[str, LinearScore]:
    """One propensity model per treatment; the treatment itself is left out.

    A missing treatment counts as not given.  The squared weights of the
    standardised features are penalised by ``1 / (2 * c)`` against the summed loss.
    """
    rows = df.withColumns({t: F.coalesce(F.col(t).cast("int"), F.lit(0)) for t in treatments})
    reg = 1 / (c * max(rows.count(), 1))
    return {t: fit_logistic(rows, [x for x in confounders if x != t], t, reg) for t in treatments}


def score_propensities(df: DataFrame, models: Mapping[str, LinearScore], prefix: str = "p_") -> DataFrame:
    return df.withColumns({f"{prefix}{t}": m.column() for t, m in models.items()})


def potential_outcomes(df: DataFrame, model: LinearScore, treatment: str, mu1: str = "mu1", mu0: str = "mu0") -> DataFrame:
    """Predictions with the treatment flag forced to 1 and to 0."""
    return df.withColumns({
        mu1: model.column({treatment: F.lit(1.0)}), mu0: model.column({treatment: F.lit(0.0)}),
    })


def ridge_by_validation(train: DataFrame, valid: DataFrame, features: Sequence[str], label: str,
                        alphas: Sequence[float]) -> tuple[LinearScore, float]:
    """Penalty with the smallest validation error; one pass serves the whole path."""
    from episodia.operators.moments import moments

    tagged = train.select(*features, label, F.lit("t").alias("_part")).unionByName(valid.select(*features, label, F.lit("v").alias("_part")))
    path = moments(tagged, features, [label], F.col("_part"), ["t"]).path(label, alphas, ["t"], ["v"])
    alpha, model, _ = min(path, key=lambda p: p[2])
    return model, alpha


@dataclass
class MaskedLinearModel:
    """One linear model per next-state column with its allowed features."""

    scores: dict[str, LinearScore]
    residual_std: dict[str, float]
    done: LinearScore

    def predict(self, df: DataFrame, overrides: Mapping[str, Column] | None = None, prefix: str = "pred_") -> DataFrame:
        out = {f"{prefix}{c}": m.column(overrides) for c, m in self.scores.items()}
        out[f"{prefix}done"] = self.done.column(overrides)
        return df.withColumns(out)


def fit_masked_linear(df: DataFrame, states: Sequence[str], actions: Sequence[str],
                      allowed: Mapping[str, Sequence[str]], next_prefix: str = "next_", done: str = "done",
                      alpha: float = 1.0) -> MaskedLinearModel:
    """Ridge per dynamic state on states and its allowed actions, all from one pass; balanced end model."""
    from episodia.operators.moments import moments

    sums = moments(df, [*states, *actions], [f"{next_prefix}{s}" for s in allowed])
    scores = {s: sums.fit(f"{next_prefix}{s}", [*states, *acts], alpha, True) for s, acts in allowed.items()}
    spread = {s: sums.squared_error(m, f"{next_prefix}{s}") ** 0.5 for s, m in scores.items()}  # residuals have mean 0
    end = fit_logistic(df, [*states, *actions], done, balanced=True)
    return MaskedLinearModel(scores, {s: 0.0 if v != v else v for s, v in spread.items()}, end)


@dataclass
class ActionPolicy:
    """Multinomial logged-behaviour policy as per-action margins."""

    features: list[str]
    fill: dict[str, float]
    actions: list[int]
    weights: list[list[float]]
    intercepts: list[float]

    def probabilities(self) -> Column:
        """Array of probabilities in the order of ``actions``."""
        cols = filled(self.features, self.fill)
        margins = F.array(*[
            reduce(lambda a, b: a + b, [c * F.lit(w) for c, w in zip(cols, ws)], F.lit(i))
            for ws, i in zip(self.weights, self.intercepts)
        ])
        # a lambda's variable is computed once a row, a column as often as it is named
        bound = lambda value, use: F.transform(F.array(value), use)[0]
        powers = bound(margins, lambda ms: bound(F.array_max(ms), lambda top: F.transform(ms, lambda m: F.exp(m - top))))
        return bound(powers, lambda ps: bound(F.aggregate(ps, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(ps, lambda x: x / total)))

    def of_action(self, action: str) -> Column:
        place = F.array_position(F.array(*[F.lit(a) for a in self.actions]), F.col(action).cast("int")).cast("int")
        return F.when(place > 0, F.try_element_at(self.probabilities(), place)).otherwise(F.lit(0.0))


def fit_action_policy(df: DataFrame, features: Sequence[str], action: str, n_actions: int, reg: float = 0.01) -> ActionPolicy:
    rows = df.filter(F.col(action).isNotNull())
    fill = medians(rows, features)
    data = assembled(rows, features, fill, [F.col(action).cast("double").alias("label")])
    model = LogisticRegression(featuresCol=_X, labelCol="label", family="multinomial", regParam=reg, maxIter=100).fit(data)
    matrix = model.coefficientMatrix.toArray()
    return ActionPolicy(list(features), fill, list(range(matrix.shape[0]))[:n_actions],
                        [[float(x) for x in r] for r in matrix][:n_actions],
                        [float(x) for x in model.interceptVector][:n_actions])


# --- boosted trees -----------------------------------------------------------------

@dataclass
class TreeScore:
    """A fitted tree ensemble and how to feed it."""

    model: object
    features: list[str]
    fill: dict[str, float]
    classifier: bool
    bounds: tuple[float, float] | None = None

    def score(self, df: DataFrame, name: str, overrides: Mapping[str, Column] | None = None) -> DataFrame:
        """Add the prediction (probability for a classifier), clipped if bounded."""
        rows = assembled(df, self.features, self.fill, df.columns, overrides)
        drop = [c for c in ("prediction", "rawPrediction", "probability") if c not in df.columns]
        out = self.model.transform(rows)
        value = vector_to_array("probability")[1] if self.classifier else F.col("prediction")
        if self.bounds:
            value = clip(value, *self.bounds)
        return out.withColumn(name, value).drop(_X, *drop)

    def importances(self) -> dict[str, float]:
        """Importance per feature, summing to 1."""
        values = self.model.featureImportances.toArray()
        total = float(values.sum()) or 1.0
        return {c: float(v) / total for c, v in zip(self.features, values)}


def fit_trees(df: DataFrame, features: Sequence[str], label: str, classifier: bool = False, balanced: bool = False,
              trees: int = 20, depth: int = 4, seed: int = 42, bounds: tuple[float, float] | None = None) -> TreeScore:
    rows = df.filter(F.col(label).isNotNull())
    fill = medians(rows, features)
    data = assembled(rows, features, fill, [F.col(label).cast("double").alias("label")])
    options = dict(featuresCol=_X, labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed)
    if balanced:
        mean = rows.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.5
        data = data.withColumn(
            "weight", F.when(F.col("label") == 1, 0.5 / max(mean, 1e-9)).otherwise(0.5 / max(1 - mean, 1e-9))
        )
        options["weightCol"] = "weight"
    data = data.persist()
    try:
        model = (GBTClassifier if classifier else GBTRegressor)(**options).fit(data)
    finally:
        data.unpersist()
    return TreeScore(model, list(features), fill, classifier, bounds)


@dataclass
class NextStateModels:
    """One forest per next-state column plus the end-of-episode model."""

    continuous: dict[str, Forest] = field(default_factory=dict)
    binary: dict[str, Forest] = field(default_factory=dict)
    done: Forest | None = None

    def predict(self, df: DataFrame, overrides: Mapping[str, Column] | None = None, prefix: str = "pred_") -> DataFrame:
        """Clipped values, binary flags at 0.5, and the probability of the end."""
        out = {f"{prefix}{c}": m.column(overrides) for c, m in self.continuous.items()}
        out |= {f"{prefix}{c}": (m.column(overrides) >= 0.5).cast("int") for c, m in self.binary.items()}
        if self.done is not None:
            out[f"{prefix}done"] = self.done.column(overrides)
        return df.withColumns(out)


def fit_next_state(df: DataFrame, features: Sequence[str], continuous: Sequence[str], binary: Sequence[str],
                   done: str | None = "done_next", prefix: str = "next_", **options) -> NextStateModels:
    """Fit all targets together; values are bounded by the 1st and 99th train percentile."""
    shares = F.array(F.lit(0.01), F.lit(0.99))
    ends = df.agg(*[F.percentile_approx(F.col(f"{prefix}{c}").cast("double"), shares, F.lit(100_000)).alias(c) for c in continuous]).first() if continuous else {}
    bounds = {f"{prefix}{c}": (float(ends[c][0]), float(ends[c][1])) for c in continuous if ends[c]}
    targets = {f"{prefix}{c}": False for c in continuous} | {f"{prefix}{c}": True for c in binary} | ({done: True} if done else {})
    fits = fit_forests(df, features, targets, bounds=bounds, **options)
    return NextStateModels({c: fits[f"{prefix}{c}"] for c in continuous}, {c: fits[f"{prefix}{c}"] for c in binary}, fits[done] if done else None)


def action_sensitivity(df: DataFrame, models: Mapping[str, TreeScore | LinearScore | Forest], actions: Sequence[str]) -> DataFrame:
    """Prediction with each flag forced on minus off, per output; one pass over ``df`` for all of them."""
    rows, diffs = df, {}
    for a in actions:
        on, off = {a: F.lit(1.0)}, {a: F.lit(0.0)}
        for name, m in models.items():
            d = f"_d{len(diffs)}"
            if isinstance(m, TreeScore):
                rows = m.score(m.score(rows, "_on", on), "_off", off).withColumn(d, F.col("_on") - F.col("_off")).drop("_on", "_off")
            else:
                rows = rows.withColumn(d, m.column(on) - m.column(off))
            diffs[d] = (a, name)
    cells = [
        F.struct(F.lit(a).alias("action"), F.lit(name).alias("output"), F.avg(d).alias("mean_diff"), F.stddev_pop(d).alias("std_diff"),
                 F.avg((F.abs(d) > 1e-6).cast("double")).alias("share_affected")) for d, (a, name) in diffs.items()]
    return rows.agg(F.array(*cells).alias("_rows")).select(F.inline("_rows"))


def importance_table(df_session, scores: Mapping[str, TreeScore | Forest]) -> DataFrame:
    """(target, feature, importance) rows; one row per target and feature."""
    rows = [(t, f, v) for t, s in scores.items() for f, v in s.importances().items()]
    return df_session.createDataFrame(rows, "target string, feature string, importance double")


def variable_ranking(df: DataFrame, features: Sequence[str], label: str, **options) -> DataFrame:
    """Normalised importance, percent missing, a flag above 20 % and the rank."""
    table = importance_table(df.sparkSession, fit_forests(df, features, {label: True}, balanced=True, **options))
    missing = column_profile(df, features).select(
        F.col("column_name").alias("feature"), ((1 - F.col("coverage")) * 100).alias("percent_missing")
    )
    out = table.drop("target").join(missing, "feature", "left")
    out = out.withColumn("high_missing", (F.col("percent_missing") > 20).cast("int"))
    return rank_of(out, "importance", "feature")


# --- policies -----------------------------------------------------------------------

def exhaustive_policy(df: DataFrame, keys: list[str], drugs: Sequence[str], effects: Mapping[tuple[str, str], float],
                      outcomes: Mapping[str, str], risk: LinearScore | TreeScore | Forest) -> DataFrame:
    """Best of all drug combinations per row, with the two comparison strategies.

    ``outcomes`` maps an outcome to the column of its prediction without any
    drug.  The baseline is predicted once per row.  A linear, logistic or forest risk
    is compared inside the row: one column per combination, whose effects are
    summed up beforehand.  A Spark ML risk needs the rows repeated per combination
    and reduced per key again.
    Returns keys, action, policy_risk, nothing_risk, observed_risk and flags;
    equal risks go to the lowest action.
    """
    def corrected(flag_of) -> dict[str, Column]:
        return {
            o: add_effects(base, [(flag_of(d), F.lit(effects.get((d, o), 0.0))) for d in drugs])
            for o, base in outcomes.items()
        }

    place = {d: i for i, d in enumerate(drugs)}
    nothing = {o: F.col(b) for o, b in outcomes.items()}
    observed = corrected(lambda d: F.coalesce(F.col(d).cast("int"), F.lit(0)))
    if not isinstance(risk, TreeScore):
        options = []
        for code in range(1 << len(drugs)):
            active = [d for d, i in place.items() if code >> i & 1]
            moved = {o: F.col(b) + F.lit(float(sum(effects.get((d, o), 0.0) for d in active))) for o, b in outcomes.items()}
            options.append(F.struct(risk.column(moved).alias("policy_risk"), F.lit(code).alias("action")))
        best = df.select(
            *keys, (F.least(*options) if len(options) > 1 else options[0]).alias("_b"), risk.column(nothing).alias("nothing_risk"),
            risk.column(observed).alias("observed_risk"),
        ).select(*keys, "_b.action", "_b.policy_risk", "nothing_risk", "observed_risk")
    else:
        base = risk.score(risk.score(df, "nothing_risk", nothing), "observed_risk", observed)
        grid = with_action_grid(base, len(drugs))
        scored = risk.score(grid, "policy_risk", corrected(lambda d: decode_bit("action", place[d])))
        best = scored.groupBy(*keys).agg(
            F.min_by(F.struct("action", "policy_risk", "nothing_risk", "observed_risk"),
                     F.struct("policy_risk", "action")).alias("_b")
        ).select(*keys, "_b.*")
    return best.withColumns({f"policy_{d}": decode_bit("action", i) for d, i in place.items()})


def fitted_q(transitions: DataFrame, states: Sequence[str], action: str, reward: str, done: str, n_actions: int,
             iterations: int = 3, gamma: float = 0.99, next_prefix: str = "next_", **options) -> TreeScore:
    """Fitted Q over logged transitions, from the targets of :func:`q_backup`.

    Each round scores the next states once per action as extra columns and
    takes the row-wise maximum, so rows are never repeated.
    """
    q: TreeScore | None = None
    for _ in range(iterations):
        rows = q_backup(transitions, q, states, action, reward, done, n_actions, gamma, next_prefix)
        q = fit_trees(rows, [*states, action], "_target", **options)
    return q


def q_backup(transitions: DataFrame, q: TreeScore | LinearScore | None, states: Sequence[str], action: str, reward: str, done: str,
             n_actions: int, gamma: float, next_prefix: str = "next_", name: str = "_target") -> DataFrame:
    """``r + gamma * max_a Q(s', a)``, the reward alone at the end or without a Q."""
    if q is None:
        return transitions.withColumn(name, F.col(reward).cast("double"))
    rows, following = transitions, {s: F.col(f"{next_prefix}{s}") for s in states}
    for a in range(n_actions):
        rows = q.score(rows, f"_q{a}", {**following, action: F.lit(float(a))})
    values = [F.col(f"_q{a}") for a in range(n_actions)]
    best = F.greatest(*values) if n_actions > 1 else values[0]
    target = F.col(reward) + F.when(F.col(done) == 1, F.lit(0.0)).otherwise(gamma * best)
    return rows.withColumn(name, target.cast("double")).drop(*[f"_q{a}" for a in range(n_actions)])


def fitted_q_flags(transitions: DataFrame, states: Sequence[str], flags: Sequence[str], reward: str, done: str, iterations: int = 10,
                   gamma: float = 0.99, next_prefix: str = "next_", bins: int = 64, **options) -> Forest:
    """Fitted Q over all on/off settings of several flags.

    Each round scores the next state under every setting and backs the best
    one up, then grows a new forest on the states and flags.  Bins are cut once, and both ends of a
    transition are known by their bins: equal ones are one row with their number and
    the sum of their rewards, and a next state is scored once a round.
    """
    features = [*states, *flags]
    cuts = quantile_cuts(transitions, features, bins)
    moves = durable(binned_moves(transitions, features, len(states), cuts, reward, done, next_prefix))
    following = durable(moves.filter("next is not null").select("next").distinct())
    few, q = following.count() <= FEW_STATES, None
    for _ in range(iterations):
        state = durable(q_backup_moves(moves, following, few, q, states, flags, gamma))
        q = fit_whole(state, features, cuts, "_target", **options)
    return q


def binned_moves(transitions: DataFrame, features: Sequence[str], n_states: int, cuts: list[np.ndarray], reward: str, done: str, next_prefix: str) -> DataFrame:
    """``bins, next, n, r``: bins of the features and, unless the episode ends, of the next states; number of transitions and sum of rewards.

    Transitions without a reward have no target and drop out.
    """
    here, ahead = Forest(list(features), cuts, 0.0, 0), Forest(list(features[:n_states]), cuts[:n_states], 0.0, 0)

    def prepare(batches):
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns - 2)]
            ends = [pa.array([r.tobytes() for r in f.binned(x).astype(np.uint16)], pa.binary()) for f, x in ((here, columns[:len(features)]), (ahead, columns[len(features):]))]
            yield pa.RecordBatch.from_arrays([*ends, *batch.columns[-2:]], ["bins", "next", "over", "r"])

    rows = transitions.select(
        *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)], *[F.col(f"{next_prefix}{c}").cast("double").alias(f"g{i}") for i, c in enumerate(features[:n_states])],
        F.coalesce(F.col(done) == 1, F.lit(False)).alias("over"), F.col(reward).cast("double").alias("r"))
    binned = rows.filter(F.col("r").isNotNull() & ~F.isnan("r")).mapInArrow(prepare, "bins binary, next binary, over boolean, r double")
    return binned.groupBy("bins", F.when(~F.col("over"), F.col("next")).alias("next")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("r").alias("r"))


def q_backup_moves(moves: DataFrame, following: DataFrame, few: bool, q: Forest | None, states: Sequence[str], flags: Sequence[str], gamma: float) -> DataFrame:
    """``bins, n0, t0``: number and sum of the targets of :func:`q_backup_flags` for the transitions of :func:`binned_moves`."""
    if q is None:
        return moves.groupBy("bins").agg(F.sum("n").alias("n0"), F.sum("r").alias("t0"))
    at, off, on = q.flag_bins(flags)

    def score(batches):
        for batch in batches:
            bins = np.zeros((batch.num_rows, len(q.features)), np.int16)
            bins[:, :len(states)] = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint16).reshape(-1, len(states))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(q.under_settings(bins, at, off, on).max(1), pa.float64())], ["next", "best"])

    best = following.mapInArrow(score, "next binary, best double")
    backed = moves.join(F.broadcast(best) if few else best, "next", "left")
    return backed.groupBy("bins").agg(F.sum("n").alias("n0"), F.sum(F.col("r") + gamma * F.col("n") * F.coalesce("best", F.lit(0.0))).alias("t0"))


def q_backup_flags(transitions: DataFrame, q: Forest | None, states: Sequence[str], flags: Sequence[str], reward: str, done: str,
                   gamma: float, next_prefix: str = "next_", name: str = "_target") -> DataFrame:
    """``r + gamma * max over settings of Q(s', setting)``, the reward alone at the end or without a Q."""
    if q is None:
        return transitions.withColumn(name, F.col(reward).cast("double"))
    best = q.best_over_flags(flags, {s: F.col(f"{next_prefix}{s}") for s in states})["value"]
    return transitions.withColumn(name, (F.col(reward) + F.when(F.col(done) == 1, F.lit(0.0)).otherwise(gamma * best)).cast("double"))


def greedy_action(df: DataFrame, q: TreeScore, action: str, n_actions: int, name: str = "best_action",
                  value: str = "best_value") -> DataFrame:
    """Action with the largest Q value; ties go to the lowest action."""
    rows = df
    for a in range(n_actions):
        rows = q.score(rows, f"_q{a}", {action: F.lit(float(a))})
    cols = [F.col(f"_q{a}") for a in range(n_actions)]
    best = F.greatest(*cols) if n_actions > 1 else cols[0]
    pick = F.array_position(F.array(*cols), best).cast("int") - 1
    return rows.withColumns({name: pick, value: best}).drop(*[f"_q{a}" for a in range(n_actions)])


def counterfactual_sweep(df: DataFrame, model: MaskedLinearModel, actions: Sequence[str]) -> DataFrame:
    """One-step prediction of every row under every flag combination."""
    grid = with_action_grid(df, len(actions))
    return model.predict(grid, {a: decode_bit("action", i) for i, a in enumerate(actions)})


# --- per-row effects -----------------------------------------------------------------

def row_effects(df: DataFrame, key: str, treatment: str, outcome: str, confounders: Sequence[str], folds: int = 2,
                seed: int = 42, name: str = "row_effect") -> DataFrame:
    """Effect per row by residual-on-residual regression with cross-fitting.

    Nuisance models of a fold are fitted on the other folds.  The last stage
    regresses the outcome residual on the treatment residual and its products
    with the centred confounders.
    """
    rows = df.filter(F.col(treatment).isNotNull() & F.col(outcome).isNotNull())
    rows = rows.withColumn("_fold", F.floor(uniform(F.lit("fold"), F.lit(seed), key) * folds))
    from episodia.operators.moments import moments

    sums = moments(rows, confounders, [outcome], F.col("_fold"))  # a fold's model comes from the others' sums
    y_hat, t_hat = F.lit(None).cast("double"), F.lit(None).cast("double")
    for k in range(folds):
        others = rows.filter(F.col("_fold") != k)
        my, mt = sums.fit(outcome, groups=[str(g) for g in range(folds) if g != k]), fit_logistic(others, confounders, treatment)
        y_hat = F.when(F.col("_fold") == k, my.column()).otherwise(y_hat)
        t_hat = F.when(F.col("_fold") == k, mt.column()).otherwise(t_hat)
    fill = medians(rows, confounders)
    rt = F.col(treatment) - t_hat
    means = rows.agg(*[F.avg(c).alias(n) for c, n in zip(filled(confounders, fill), confounders)]).first()
    centred = {c: col - F.lit(float(means[c] or 0.0)) for c, col in zip(confounders, filled(confounders, fill))}
    staged = rows.withColumns({"_ry": F.col(outcome) - y_hat, "_rt": rt, **{f"_c_{c}": v for c, v in centred.items()}})
    inputs = ["_rt", *[f"_rt_{c}" for c in confounders]]
    crossed = staged.withColumns({f"_rt_{c}": F.col("_rt") * F.col(f"_c_{c}") for c in confounders})
    data = VectorAssembler(inputCols=inputs, outputCol=_X).transform(crossed.select("_ry", *inputs))
    fit = LinearRegression(featuresCol=_X, labelCol="_ry", fitIntercept=False, standardization=False, regParam=1e-6,
                           elasticNetParam=0.0).fit(data)
    w = [float(x) for x in fit.coefficients]
    effect = reduce(lambda a, b: a + b, [F.col(f"_c_{c}") * F.lit(x) for c, x in zip(confounders, w[1:])], F.lit(w[0]))
    return staged.withColumn(name, effect).drop("_fold", "_ry", "_rt", *[f"_c_{c}" for c in confounders])


def row_effect_summary(df: DataFrame, treatment: str, outcome: str, name: str = "row_effect") -> DataFrame:
    return df.agg(
        F.lit(treatment).alias("treatment"), F.lit(outcome).alias("outcome"),
        F.avg(name).alias("effect"), F.stddev_pop(name).alias("effect_std"), F.count(name).alias("n"),
    )


# --- stability selection ----------------------------------------------------------------

def _partial_correlations(moments: pd.DataFrame, columns: list[str], drugs: list[str], deltas: list[str],
                          alpha: float, n_drugs: int, n_deltas: int, n_base: int, seed: int) -> pd.DataFrame:
    """Per run: a Fisher-z test of every drawn (drug, delta) pair given the rest."""
    from math import erfc, log, sqrt

    base = [c for c in columns if c not in drugs and c not in deltas]
    out = []
    for row in moments.itertuples(index=False):
        run, n = int(row.run), float(row.n)
        draw = np.random.default_rng(seed + run)
        ds = sorted(draw.permutation(drugs)[:n_drugs])
        ts = sorted(draw.permutation(deltas)[:n_deltas])
        used = sorted(draw.permutation(base)[:n_base]) + list(ds) + list(ts)
        index = {c: i for i, c in enumerate(columns)}
        sums = np.asarray(row.sums, dtype=float)
        p = len(columns)
        cross = np.zeros((p, p))
        cross[np.triu_indices(p)] = np.asarray(row.products, dtype=float)
        cross = cross + np.triu(cross, 1).T
        mean = sums / n
        cov = cross / n - np.outer(mean, mean)
        at = [index[c] for c in used]
        part = cov[np.ix_(at, at)]
        spread = np.sqrt(np.clip(np.diag(part), 0, None))
        if n < len(used) + 4 or (spread < 1e-6).any():
            continue
        inverse = np.linalg.pinv(part / np.outer(spread, spread))
        for d in ds:
            for t in ts:
                i, j = used.index(d), used.index(t)
                r = -inverse[i, j] / sqrt(inverse[i, i] * inverse[j, j])
                r = min(max(r, -0.999999999), 0.999999999)
                z = 0.5 * log((1 + r) / (1 - r)) * sqrt(n - (len(used) - 2) - 3)
                p_value = erfc(abs(z) / sqrt(2))
                kind = "definite" if p_value < alpha else ("possible" if p_value < 2 * alpha else None)
                out.append((run, d, t, float(r), float(p_value), kind))
    return pd.DataFrame(out, columns=["run", "drug", "delta", "partial", "p_value", "edge_type"])


def stability_runs(df: DataFrame, key: str, drugs: Sequence[str], deltas: Sequence[str], base: Sequence[str], runs: int,
                   share: float, alpha: float = 0.05, n_drugs: int = 2, n_deltas: int = 2, n_base: int = 3,
                   seed: int = 42) -> DataFrame:
    """Conditional-independence tests over random subsamples and variable sets.

    Each run takes the rows whose hash falls below ``share``.  Sums and cross
    products per run are ordinary aggregations; only those small matrices, one
    row per run, are handled by numpy.  This is a partial-correlation test, not
    a graph search.
    """
    columns = [*base, *drugs, *deltas]
    rows = df.dropna(subset=columns).select(key, *[F.col(c).cast("double").alias(c) for c in columns])
    spread = rows.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).filter(
        uniform(F.lit("run"), F.lit(seed), "run", key) < share
    )
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    moments = spread.groupBy("run").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(c) for c in columns]).alias("sums"),
        F.array(*[F.sum(F.col(a) * F.col(b)) for a, b in pairs]).alias("products"),
    )
    drug_names, delta_names = list(drugs), list(deltas)

    def test(batches):
        for batch in batches:
            yield _partial_correlations(batch, columns, drug_names, delta_names, alpha, n_drugs, n_deltas, n_base, seed)

    return moments.mapInPandas(
        test, "run long, drug string, delta string, partial double, p_value double, edge_type string"
    )


# --- imputation from similar rows -------------------------------------------------------

def imputed_from_similar(df: DataFrame, columns: Sequence[str], groups: int = 20, max_missing: float = 0.9,
                         seed: int = 42) -> DataFrame:
    """Fill nulls with the mean of similar rows.

    Own definition: similar rows share a k-means cluster of the standardised
    columns (nulls at the mean).  Columns with at least ``max_missing`` nulls
    are left alone.  Cluster means are one aggregation; no rows are paired.
    """
    stats = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(c).alias(f"k_{c}") for c in columns], *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
    ).first()
    n = stats["n"] or 1
    used = [c for c in columns if stats[f"k_{c}"] / n > 1 - max_missing]
    if not used:
        return df
    scaled = [
        F.coalesce((F.col(c) - F.lit(float(stats[f"m_{c}"]))) / F.lit(float(stats[f"s_{c}"] or 1.0)), F.lit(0.0)).alias(f"_z_{c}")
        for c in used
    ]
    rows = VectorAssembler(inputCols=[f"_z_{c}" for c in used], outputCol=_X).transform(df.select("*", *scaled))
    model = KMeans(k=groups, seed=seed, featuresCol=_X, predictionCol="_group", maxIter=10).fit(rows)
    placed = model.transform(rows).drop(_X, *[f"_z_{c}" for c in used])
    # one row per cluster: ``groups`` rows bound the broadcast
    means = placed.groupBy("_group").agg(*[F.avg(c).alias(f"_g_{c}") for c in used])
    out = placed.join(F.broadcast(means), "_group", "left")
    return out.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.col(f"_g_{c}"), F.lit(float(stats[f"m_{c}"]))) for c in used
    }).drop("_group", *[f"_g_{c}" for c in used])
