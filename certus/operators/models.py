"""Correctness models: ridge classifiers from sums, calibration, boosted trees, search, and scoring.

A ridge fit needs a fold's and class's sums only, so one aggregation serves all folds, penalties and class weights.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certus.functions.text import clipped
from certus.operators import metrics
from certus.operators.boosting import SAMPLE_ROWS, Boosted, Grower, Setting, binned_table, fit_sample, fit_together, held_out_scores, quantile_cuts
from certus.operators.isotonic import Steps, fit_steps
from certus.operators.sampling import folds
from certus.plans.staging import staged


@dataclass(frozen=True)
class Costs:
    """Costs of a missed wrong answer and of a review; both positive."""

    miss: float = 0.94
    review: float = 0.64

    def __post_init__(self):
        if self.miss <= 0 or self.review <= 0:
            raise ValueError("costs must be positive")

    def positive_weights(self) -> list[float]:
        """Weights to try for the positive class: steps around review / miss, 0.1 at least."""
        return [max(0.1, s * self.review / self.miss) for s in (0.5, 0.8, 1.0, 1.2, 1.5, 2.0)]


@dataclass(frozen=True)
class Linear:
    """score = intercept + sum of weight * (x - mean) / std, and a sigmoid of a * score + b if it was calibrated."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]
    weight: tuple[float, ...]
    intercept: float
    a: float | None = None
    b: float = 0.0

    def score(self) -> Column:
        out = F.lit(self.intercept)
        for f, m, s, w in zip(self.features, self.mean, self.std, self.weight):
            out = out + F.lit(w) * (F.coalesce(clipped(F.col(f).cast("double")), F.lit(m)) - m) / (s or 1.0)
        return out

    def probability(self) -> Column:
        if self.a is None:
            raise ValueError("the model isn't calibrated; see min_max_scores")
        return 1 / (1 + F.exp(-(F.lit(self.a) * self.score() + self.b)))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Linear:
        return Linear(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items()})


@dataclass(frozen=True)
class Averaged:
    """The mean of ridge models' probabilities: each by its own sigmoid or, with ``steps``, by the monotone function of its
    number."""

    members: tuple[Linear, ...]
    steps: tuple[Steps, ...] = ()

    @property
    def features(self) -> tuple[str, ...]:
        return self.members[0].features

    def probability(self) -> Column:
        each = [s.value(m.score()) for m, s in zip(self.members, self.steps)] if self.steps else [m.probability() for m in self.members]
        return sum(each, F.lit(0.0)) / len(each)

    def to_json(self) -> str:
        return json.dumps({"kind": "averaged", **asdict(self)})

    @staticmethod
    def from_json(text: str) -> Averaged:
        d = json.loads(text)
        steps = tuple(Steps(tuple(s["x"]), tuple(s["p"])) for s in d["steps"])
        return Averaged(tuple(Linear.from_json(json.dumps(m)) for m in d["members"]), steps)


@dataclass
class Sums:
    """n, sums and sums of products of the features, for one class of one fold."""

    n: float
    x: np.ndarray
    xx: np.ndarray

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.n + other.n, self.x + other.x, self.xx + other.xx)


def class_sums(df: DataFrame, features: list[str], target: str, fold: str | None = None) -> dict[tuple[int, int], Sums]:
    """Sums by (fold, class), in one aggregation; null features count as 0 after centring by the mean of a pass before.

    The sums are centred at those means; ``"centre"`` holds them.
    """
    clean = df.filter(F.col(target).isNotNull()).select(F.col(target).cast("int").alias("y"), (F.col(fold) if fold else F.lit(0)).alias("fold"), *(clipped(F.col(f).cast("double")).alias(f) for f in features))
    centre = np.array([v or 0.0 for v in clean.agg(*(F.avg(f) for f in features)).first()])
    x = [F.coalesce(F.col(f) - c, F.lit(0.0)) for f, c in zip(features, centre.tolist())]
    pairs = list(itertools.combinations_with_replacement(range(len(features)), 2))
    rows = clean.groupBy("fold", "y").agg(F.count("*").alias("n"), *(F.sum(v).alias(f"x{i}") for i, v in enumerate(x)), *(F.sum(x[i] * x[j]).alias(f"x{i}_{j}") for i, j in pairs)).collect()
    out: dict = {"centre": centre}
    for r in rows:
        xx = np.zeros((len(features), len(features)))
        for i, j in pairs:
            xx[i, j] = xx[j, i] = r[f"x{i}_{j}"]
        out[r["fold"], r["y"]] = Sums(r["n"], np.array([r[f"x{i}"] for i in range(len(features))]), xx)
    return out


def ridge(sums: dict, features: list[str], alpha: float = 1.0, positive_weight: float = 1.0, without: int | None = None) -> Linear:
    """Ridge on targets -1 and 1, an intercept without penalty, standardised features; ``without`` leaves a fold out."""
    k = len(features)
    by_class = {y: sum((s for key, s in sums.items() if key != "centre" and key[1] == y and key[0] != without), Sums(0.0, np.zeros(k), np.zeros((k, k)))) for y in (0, 1)}
    both = by_class[0] + by_class[1]
    if not both.n:
        raise ValueError("no labelled rows")
    mean = both.x / both.n
    std = np.sqrt(np.maximum(np.diag(both.xx) / both.n - mean**2, 0.0))
    scale = np.where(std > 1e-12, std, 1.0)
    weight = {0: 1.0, 1: positive_weight}
    n = sum(weight[y] * s.n for y, s in by_class.items())
    x = sum(weight[y] * s.x for y, s in by_class.items())
    xx = sum(weight[y] * s.xx for y, s in by_class.items())
    sign = {0: -1.0, 1: 1.0}
    y_sum = sum(weight[y] * sign[y] * s.n for y, s in by_class.items())
    xy = sum(weight[y] * sign[y] * s.x for y, s in by_class.items())
    cov = (xx - np.outer(x, x) / n) / np.outer(scale, scale)
    rhs = (xy - x * y_sum / n) / scale
    w = np.linalg.solve(cov + alpha * np.eye(k), rhs) if k else np.zeros(0)
    intercept = y_sum / n - float(w @ ((x / n - mean) / scale))
    at = mean + sums["centre"]
    return Linear(tuple(features), tuple(at.tolist()), tuple(scale.tolist()), tuple(w.tolist()), intercept)


def calibrate_folds(df: DataFrame, fold: str, fits: list[Linear], target: str, steps: int = 8) -> list[Linear]:
    """Each model with a sigmoid fitted on the labelled rows of the fold of its number, by Newton steps.

    A step sums the gradients of all folds in one aggregation over staged scores. Targets are smoothed by the class
    counts. A fold without labelled rows: ValueError.
    """
    score = F.lit(None).cast("double")
    for i, m in enumerate(fits):
        score = F.when(F.col(fold) == i, m.score()).otherwise(score)
    s = staged(df.filter(F.col(target).isNotNull()).select(F.col(fold).alias("fold"), score.alias("s"), F.col(target).cast("double").alias("y")), "fold-scores")
    n = {r["fold"]: (r["p"], r["n"]) for r in s.groupBy("fold").agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect()}
    if any(i not in n for i in range(len(fits))):
        raise ValueError("no labelled rows")
    pick = lambda values: F.element_at(F.array(*(F.lit(float(v)) for v in values)), F.col("fold") + 1)
    pos, neg = [n[i][0] for i in range(len(fits))], [n[i][1] - n[i][0] for i in range(len(fits))]
    goal = F.when(F.col("y") == 1, pick((p + 1) / (p + 2) for p in pos)).otherwise(pick(1 / (q + 2) for q in neg))
    a, b = [1.0] * len(fits), [float(np.log((p + 1) / (q + 1))) for p, q in zip(pos, neg)]
    for _ in range(steps):
        p = 1 / (1 + F.exp(-(pick(a) * F.col("s") + pick(b))))
        rows = s.select("fold", "s", (p - goal).alias("d"), (p * (1 - p)).alias("h"))
        sums = rows.groupBy("fold").agg(F.sum(F.col("d") * F.col("s")).alias("ds"), F.sum("d").alias("d"), F.sum(F.col("h") * F.col("s") * F.col("s")).alias("hss"), F.sum(F.col("h") * F.col("s")).alias("hs"), F.sum("h").alias("h"))
        for g in sums.collect():  # a row for each fold
            i = g["fold"]
            step = np.linalg.solve(np.array([[g["hss"], g["hs"]], [g["hs"], g["h"]]]) + 1e-9 * np.eye(2), np.array([g["ds"], g["d"]]))
            a[i], b[i] = a[i] - float(step[0]), b[i] - float(step[1])
    return [Linear(m.features, m.mean, m.std, m.weight, m.intercept, a[i], b[i]) for i, m in enumerate(fits)]


def calibrate_sigmoid(df: DataFrame, model: Linear, target: str, steps: int = 8) -> Linear:
    """The model with a sigmoid fitted on labelled rows; rows that trained the model should be left out."""
    return calibrate_folds(df.withColumn("__fold", F.lit(0)), "__fold", [model], target, steps)[0]


def calibrated_model(df: DataFrame, features: list[str], target: str, key: str, k: int = 3, alpha: float = 1.0, method: str = "sigmoid", seed: int = 42, positive_weight: float = 1.0) -> Averaged:
    """The mean of k ridge models, each fitted without one fold and calibrated on it.

    method: sigmoid, or isotonic. The folds are staged, as every step reads them. A fold without labelled rows: ValueError.
    """
    if method not in ("sigmoid", "isotonic"):
        raise ValueError(f"unknown calibration: {method}")
    parted = staged(folds(df.filter(F.col(target).isNotNull()), key, target, k, seed), "folds")
    sums = class_sums(parted, features, target, "fold")
    fits = [ridge(sums, features, alpha, positive_weight, without=i) for i in range(k)]
    if method == "sigmoid":
        return Averaged(tuple(calibrate_folds(parted, "fold", fits, target)))
    score = F.lit(None).cast("double")
    for i, m in enumerate(fits):
        score = F.when(F.col("fold") == i, m.score()).otherwise(score)
    steps = fit_steps(parted, score, F.col(target), k, F.col("fold"))
    if not all(s.x for s in steps):
        raise ValueError("no labelled rows")
    return Averaged(tuple(fits), tuple(steps))


def calibrated_probability(df: DataFrame, features: list[str], target: str, key: str, k: int = 3, alpha: float = 1.0, method: str = "sigmoid", seed: int = 42, positive_weight: float = 1.0):
    """A function from a table to its column ``probability`` by ``calibrated_model``."""
    model = calibrated_model(df, features, target, key, k, alpha, method, seed, positive_weight)
    return lambda table: table.withColumn("probability", model.probability())


def search_ridge(df: DataFrame, features: list[str], target: str, key: str, costs: Costs = Costs(), alphas: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0), metric: str = "f1", k: int = 3, seed: int = 42) -> tuple[Linear, DataFrame]:
    """The model refitted with the best (alpha, weight), and (alpha, positive_weight, means over folds of the metrics).

    Every configuration scores the fold it hasn't seen, all in one job; for ``cost`` less is better.
    """
    parted = staged(folds(df.filter(F.col(target).isNotNull()), key, target, k, seed), "folds")
    sums = class_sums(parted, features, target, "fold")
    grid = list(itertools.product(alphas, costs.positive_weights()))
    fits = [[ridge(sums, features, alpha, weight, fold) for fold in range(k)] for alpha, weight in grid]
    long = staged(_grid_scores(parted, features, target, fits), "grid-scores")
    configs = df.sparkSession.createDataFrame([(n, float(a), float(w)) for n, (a, w) in enumerate(grid)], "config int, alpha double, positive_weight double")
    table, best = _chosen(configs, long, costs, metric, cut=0.0)
    return ridge(sums, features, *grid[best]), table.drop("config")


def _grid_scores(parted: DataFrame, features: list[str], target: str, fits: list[list[Linear]]) -> DataFrame:
    """(config, fold, y, score) of each row by the models ``fits[config][fold]`` that didn't see its fold."""
    weight = np.array([[np.array(m.weight) / np.array([s or 1.0 for s in m.std]) for m in by_fold] for by_fold in fits])
    mean = np.array([[m.mean for m in by_fold] for by_fold in fits])
    intercept = np.array([[m.intercept for m in by_fold] for by_fold in fits])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, fold = b.column(0), b.column(1).to_numpy()
            x = np.stack([b.column(2 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))], 1)
            for config in range(len(fits)):
                centred = np.nan_to_num(x - mean[config][fold], nan=0.0)
                score = (centred * weight[config][fold]).sum(1) + intercept[config][fold]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), config, np.int32)), pa.array(fold), y, pa.array(score)], ["config", "fold", "y", "score"])

    columns = [clipped(F.col(f).cast("double")).alias(f"f{i}") for i, f in enumerate(features)]
    return parted.select(F.col(target).cast("int").alias("y"), F.col("fold").cast("int").alias("fold"), *columns).mapInArrow(rows, "config int, fold int, y int, score double")


def _chosen(configs: DataFrame, scored: DataFrame, costs: Costs, metric: str, cut: float = 0.5) -> tuple[DataFrame, int]:
    """(configs with the means over folds of the metrics, number of the best one) from rows (config, fold, y, score)."""
    if metric not in metrics.SEARCHED:
        raise ValueError(f"unknown metric: {metric}")
    by_fold = metrics.search_metrics(scored, ["config", "fold"], costs.miss, costs.review, cut)
    means = by_fold.groupBy("config").agg(*(F.avg(m).alias(m) for m in metrics.SEARCHED))
    # a row for each configuration
    table = staged(configs.join(means, "config"), "search")
    order = F.round(metric, 12)
    return table, table.orderBy(order.asc_nulls_last() if metric == "cost" else order.desc_nulls_last(), "config").first()["config"]


def fit_boosted(df: DataFrame, features: list[str], target: str, key: str, setting: Setting = Setting(), cuts=None, rows: int | None = None) -> Boosted:
    """Boosted trees grown on all labelled rows, or on about ``rows`` of them in one task."""
    cuts = quantile_cuts(df, features) if cuts is None else cuts
    table, growers = binned_table(df, features, target, key, cuts), [Grower(setting, len(features))]
    return (fit_together(table, features, cuts, growers) if rows is None else fit_sample(table, features, cuts, growers, rows))[0]


def draw_settings(n: int, costs: Costs = Costs(), trees: tuple[int, int] = (50, 200), seed: int = 42) -> list[Setting]:
    """Seeded random settings of boosted trees.

    Evenly: trees, depth 3 to 5, shares of rows and features 0.7 to 1, least hessian of a child 3 to 7, the weight of the
    positive class; evenly in the logarithm: step 0.05 to 0.3, alpha 0.1 to 5, l2 0.5 to 20, gamma 0.001 to 0.1.
    """
    rng = np.random.default_rng(seed)
    weights = costs.positive_weights()
    log = lambda low, high: float(np.exp(rng.uniform(np.log(low), np.log(high))))
    return [
        Setting(
            trees=int(rng.integers(*trees)), depth=int(rng.integers(3, 6)), step=log(0.05, 0.3), subsample=float(rng.uniform(0.7, 1.0)), columns=float(rng.uniform(0.7, 1.0)),
            positive_weight=float(weights[rng.integers(len(weights))]), alpha=log(0.1, 5.0), l2=log(0.5, 20.0), gamma=log(1e-3, 0.1), min_child=float(rng.integers(3, 8)), seed=seed,
        )
        for _ in range(n)
    ]


def search_boosted(df: DataFrame, features: list[str], target: str, key: str, n_iter: int = 10, costs: Costs = Costs(), metric: str = "f1", k: int = 3, trees: tuple[int, int] = (50, 200), seed: int = 42, rows: int = SAMPLE_ROWS) -> tuple[Boosted, DataFrame]:
    """(trees of the best settings, table of settings and mean metrics over folds).

    Each of ``n_iter`` drawn settings is fitted k times, without one fold, and scores all rows of that fold. A fit is a
    task of its own on about ``rows`` rows (all of a smaller table); the best settings are then fitted in the same way.
    For ``cost`` less is better.
    """
    labelled = df.filter(F.col(target).isNotNull())
    cuts = quantile_cuts(labelled, features)
    table = binned_table(folds(labelled, key, target, k, seed), features, target, key, cuts, "fold")
    drawn = draw_settings(n_iter, costs, trees, seed)
    growers = [Grower(s, len(features), without=fold) for s in drawn for fold in range(k)]
    fitted = fit_sample(table, features, cuts, growers, rows)
    configs = df.sparkSession.createDataFrame([(n, *asdict(s).values()) for n, s in enumerate(drawn)], "config int, trees int, depth int, step double, subsample double, columns double, positive_weight double, alpha double, l2 double, gamma double, min_child double, seed int")
    result, best = _chosen(configs, staged(held_out_scores(table, fitted, k, len(features)), "search-scores"), costs, metric)
    return fit_sample(table, features, cuts, [Grower(drawn[best], len(features))], rows)[0], result.drop("seed")


def model_from_json(text: str) -> Linear | Averaged | Boosted:
    """The model that a ``to_json`` wrote."""
    kinds = {"boosted": Boosted, "averaged": Averaged}
    return kinds.get(json.loads(text).get("kind"), Linear).from_json(text)


def min_max_scores(df: DataFrame, score: Column) -> DataFrame:
    """``probability`` for models without one: scores brought to 0..1 by their extremes over all rows."""
    scored = df.withColumn("__s", score)
    low, high = scored.agg(F.min("__s"), F.max("__s")).first()  # two numbers
    return scored.withColumn("probability", (F.col("__s") - F.lit(low)) / (F.lit(high) - F.lit(low) + 1e-12)).drop("__s")


def predictions(scored: DataFrame, threshold: float) -> DataFrame:
    """(content_id, meta_model_probability, meta_model_prediction, threshold_used)."""
    p = F.col("probability")
    return scored.select("content_id", p.alias("meta_model_probability"), (p >= threshold).cast("int").alias("meta_model_prediction"), F.lit(float(threshold)).alias("threshold_used"))


def holdout(scored: DataFrame, target: str, costs: Costs = Costs()) -> tuple[float, DataFrame]:
    """The threshold of least cost, and (threshold, metrics) at 0.5 and at it."""
    tuned = metrics.best_threshold(metrics.threshold_sweep(scored, target, "probability", costs.miss, costs.review)).first()["threshold"]
    out = None
    for t in (0.5, tuned):
        counts = metrics.confusion(scored.withColumn("__p", (F.col("probability") >= t).cast("int")), target, "__p")
        row = metrics.business_cost(metrics.rates(counts), costs.miss, costs.review).withColumn("threshold", F.lit(float(t)))
        out = row if out is None else out.unionByName(row)
    return tuned, out
