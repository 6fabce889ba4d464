"""Feature selection: variance inflation, forest importance, and a vote over methods."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certus.operators import information, stats
from certus.plans.staging import staged


def gram_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Sums of products of all pairs of columns, over rows without null, from one aggregation."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.dropna(subset=columns).agg(*(F.sum(F.col(columns[i]).cast("double") * F.col(columns[j])).alias(f"s{i}_{j}") for i, j in pairs)).first()
    g = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        g[i, j] = g[j, i] = row[f"s{i}_{j}"] or 0.0
    return g


def inflation(gram: np.ndarray) -> np.ndarray:
    """Variance inflation of each column by a regression without constant on the others; infinite if they determine it."""
    out = np.ones(len(gram))
    for i in range(len(gram)):
        others = np.delete(np.arange(len(gram)), i)
        explained = gram[i, others] @ np.linalg.pinv(gram[np.ix_(others, others)], rcond=1e-12) @ gram[others, i] if len(others) else 0.0
        rest = gram[i, i] - explained
        out[i] = gram[i, i] / rest if rest > 1e-10 * gram[i, i] else np.inf
    return out


def drop_inflated(gram: np.ndarray, columns: list[str], most: float = 15.0) -> tuple[list[str], list[tuple[str, float]]]:
    """Columns that stay, and what was dropped with its inflation: the first largest one each time, on sub-matrices."""
    left, dropped = list(range(len(columns))), []
    while len(left) > 1:
        values = inflation(gram[np.ix_(left, left)])
        worst = int(np.argmax(values))
        if not values[worst] > most:
            break
        dropped.append((columns[left[worst]], float(values[worst])))
        del left[worst]
    return [columns[i] for i in left], dropped


def inflation_table(df: DataFrame, columns: list[str]) -> DataFrame:
    values = inflation(gram_matrix(df, columns))
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, values)], "feature string, vif double")


def forest_importance(df: DataFrame, columns: list[str], target: str, trees: int = 100, seed: int = 42) -> DataFrame:
    """(feature, importance, selected): selected above the mean importance. Rows with nulls are left out."""
    rows = staged(df.select(target, *columns).dropna(), "forest-rows")  # each level of the trees reads them
    ready = VectorAssembler(inputCols=columns, outputCol="features").transform(rows)
    model = RandomForestClassifier(labelCol=target, numTrees=trees, seed=seed).fit(ready.select("features", F.col(target).cast("double").alias(target)))
    values = model.featureImportances.toArray()
    return df.sparkSession.createDataFrame([(c, float(v), int(v > values.mean())) for c, v in zip(columns, values)], "feature string, importance double, selected int")


def select_features(df: DataFrame, columns: list[str], target: str, trees: int = 100, top: int = 15, least_r: float = 0.1, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """The vote of correlation with the target, mutual information and forest importance, as ``vote`` gives it.

    Collinear columns (|r| over 0.9) and inflated ones go first. Columns without any value in over half of the rows are
    left out, as the forest and the inflation need rows without nulls.
    """
    ready = staged(df.select(target, *columns), "selection")
    high = {r["feature"] for r in stats.missing_report(ready, columns).collect() if r["high_missing"]}
    columns = [c for c in columns if c not in high]
    r = {x["feature"]: x for x in stats.target_correlations(ready, columns, target, alpha).collect()}
    pairs = [(x["f1"], x["f2"]) for x in stats.collinear_pairs(stats.correlations(ready, columns)).collect()]
    gone = set(stats.drop_collinear(pairs, {c: x["r"] for c, x in r.items()}))
    left, _ = drop_inflated(gram_matrix(ready, [c for c in columns if c not in gone]), [c for c in columns if c not in gone])
    by_r = [c for c in left if r[c]["r"] is not None and abs(r[c]["r"]) > least_r and r[c]["significant"]]
    by_mi = [x["feature"] for x in information.neighbour_information(ready, left, target).orderBy(F.desc("mi"), "feature").limit(top).collect()]
    by_forest = [x["feature"] for x in forest_importance(ready, left, target, trees, seed).filter("selected = 1").collect()]
    return vote(df.sparkSession, {"statistical": by_r, "mutual_info": by_mi, "random_forest": by_forest}, left)


def needed_votes(n_methods: int) -> int:
    return min(2, max(1, n_methods // 2))


def vote(spark, selections: dict[str, list[str]], columns: list[str]) -> DataFrame:
    """(feature, a 0/1 column for each method, total_votes, vote_percentage, consensus): consensus with enough votes,
    or, if none has, the five with the most."""
    rows = spark.createDataFrame([(f,) for f in columns], "feature string")
    for method, chosen in selections.items():
        rows = rows.withColumn(method, F.col("feature").isin(list(chosen)).cast("int") if chosen else F.lit(0))
    total = sum((F.col(m) for m in selections), F.lit(0))
    rows = rows.withColumns({"total_votes": total, "vote_percentage": 100.0 * total / len(selections)})
    need = needed_votes(len(selections))
    if rows.filter(F.col("total_votes") >= need).limit(1).count():
        return rows.withColumn("consensus", (F.col("total_votes") >= need).cast("int"))
    five = [r["feature"] for r in rows.filter("total_votes > 0").orderBy(F.desc("total_votes"), "feature").limit(5).collect()]
    return rows.withColumn("consensus", F.col("feature").isin(five).cast("int"))
