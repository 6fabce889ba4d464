"""The whole workloads: the feature table, batch scoring, and an experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certus.functions.uncertainty import with_entry_features, with_features
from certus.operators import metrics, models, preprocess, sampling, validate
from certus.plans.staging import staged
from certus.sources.records import read_records


def feature_table(records: DataFrame) -> DataFrame:
    """Labelled samples with their features, from raw records, in one narrow stage."""
    return with_entry_features(preprocess.samples(preprocess.concept_rows(records)))


def score_records(records: DataFrame, model: models.Linear | models.Averaged | models.Boosted, threshold: float, max_records: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(predictions, rejected records). A linear model must be calibrated."""
    valid, rejected = validate.prepare(records, max_records)
    ready = validate.aligned(with_features(valid), list(model.features))
    return models.predictions(ready.withColumn("probability", model.probability()), threshold), rejected


def score_file(spark: SparkSession, path: str, model: models.Linear | models.Averaged | models.Boosted, threshold: float, max_records: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Score a file; no record that can be scored: ValueError."""
    scored, rejected = score_records(read_records(spark, path), model, threshold, max_records)
    if not scored.limit(1).count():
        raise ValueError("no valid records")
    return scored, rejected


def evaluate(scored: DataFrame, target: str, costs: models.Costs) -> tuple[float, DataFrame, DataFrame]:
    """(tuned threshold, metrics at 0.5 and there, error analysis) of rows with ``probability``."""
    tuned, report = models.holdout(scored, target, costs)
    analysed = metrics.error_analysis(scored, "probability") if "llm_prediction" in scored.columns else scored.withColumn("meta_model_confidence", F.col("probability"))
    return tuned, report, analysed


def experiment(table: DataFrame, key: str, target: str, features: list[str], method: str = "hybrid", costs: models.Costs = models.Costs(), seed: int = 42, train_ratio: float = 6.0, test_ratio: float = 6.0, metric: str = "f1", parts: tuple | None = None, searched: DataFrame | None = None) -> tuple[float, DataFrame, DataFrame]:
    """(tuned threshold, metrics at 0.5 and there, error analysis of the test rows).

    Split, balance, search the ridge's penalty and class weight by folds, calibrate with the best ones, evaluate. The
    table, the balanced parts, the folds and the scores are staged, as several jobs read each. ``parts`` may hold the
    result of ``split_and_balance``, and ``searched`` the table of a search over its training rows.
    """
    train, test, _, _ = parts or sampling.split_and_balance(staged(table, "experiment"), key, target, features, method, train_ratio, test_ratio, seed=seed)
    searched = models.search_ridge(train, features, target, key, costs, metric=metric, seed=seed)[1] if searched is None else searched
    best = searched.orderBy(F.col(metric).asc() if metric == "cost" else F.col(metric).desc(), "alpha", "positive_weight").first()
    probability = models.calibrated_probability(train, features, target, key, alpha=best["alpha"], seed=seed, positive_weight=best["positive_weight"])
    return evaluate(staged(probability(test), "scored"), target, costs)


#: Experiments by name: the family, and the metric by which its search chooses.
EXPERIMENTS = {"Ridge_f1": ("ridge", "f1"), "Boosted_f1": ("boosted", "f1"), "Ridge_cost": ("ridge", "cost")}


def all_experiments(table: DataFrame, key: str, target: str, features: list[str], experiments: dict[str, tuple[str, str]] = EXPERIMENTS, method: str = "hybrid", costs: models.Costs = models.Costs(), seed: int = 42, n_iter: int = 10) -> DataFrame:
    """A row for each experiment with its tuned threshold and test metrics, best test_f1 first.

    All share one split and balance, 6 to 1 on both sides, and the ridge experiments one search.
    """
    parts = sampling.split_and_balance(staged(table, "experiment"), key, target, features, method, 6.0, 6.0, seed=seed)
    train, test = parts[:2]
    grid = None
    out = None
    for name, (family, metric) in experiments.items():
        if family == "boosted":
            model, _ = models.search_boosted(train, features, target, key, n_iter, costs, metric, seed=seed)
            scored = staged(test.withColumn("probability", model.probability()), "scored")
            tuned, report, _ = evaluate(scored, target, costs)
        else:
            grid = models.search_ridge(train, features, target, key, costs, metric=metric, seed=seed)[1] if grid is None else grid
            tuned, report, scored = experiment(table, key, target, features, method, costs, seed, metric=metric, parts=parts, searched=grid)
        ranks = metrics.ranking_metrics(scored, target, "probability" if "probability" in scored.columns else "meta_model_confidence")
        ranked = ranks.first()  # a few numbers
        row = report.filter(F.col("threshold") == tuned).limit(1).withColumns({c: F.lit(ranked[c]).cast("double") for c in ranks.columns})
        row = row.select(F.lit(name).alias("experiment_name"), F.col("threshold").alias("optimal_threshold"), *(F.col(c).alias(f"test_{c}") for c in ("f1", "f1_macro", "precision", "recall", "accuracy", "balanced_accuracy", "cost", "roc_auc", "average_precision")))
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("test_f1"), "experiment_name")
