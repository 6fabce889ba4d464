"""Classification metrics, thresholds and error analysis.

Confusion counts are sums over conditions; curves are prefix sums over distinct scores in two levels, so that no task
sees all of them.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certus.plans.staging import staged


def confusion(df: DataFrame, truth: str, prediction: str, by: list[str] = ()) -> DataFrame:
    """tp, fp, tn, fn with 1 as the positive class; zeros for what isn't there."""
    count = lambda y, p: F.coalesce(F.sum(((F.col(truth) == y) & (F.col(prediction) == p)).cast("bigint")), F.lit(0).cast("bigint"))
    return df.groupBy(*by).agg(count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(0, 0).alias("tn"), count(1, 0).alias("fn"))


def normalised(counts: DataFrame) -> DataFrame:
    """Confusion counts by the rows of their true class; 0 for a class that isn't there."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b)), F.lit(0.0))
    return counts.withColumns({"tp_rate": share("tp", "fn"), "fn_rate": share("fn", "tp"), "fp_rate": share("fp", "tn"), "tn_rate": share("tn", "fp")})


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def rates(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of either class and their means, accuracy and balanced accuracy; x / 0 counts as 0.

    Balanced accuracy is the mean recall of the classes that are there.
    """
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = counts.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "precision_neg": _ratio(tn, tn + fn), "recall_neg": _ratio(tn, tn + fp)})
    out = out.withColumns({"f1": _ratio(2 * tp, 2 * tp + fp + fn), "f1_neg": _ratio(2 * tn, 2 * tn + fp + fn), "accuracy": _ratio(tp + tn, tp + fp + tn + fn)})
    present = ((tp + fn) > 0).cast("int") + ((tn + fp) > 0).cast("int")
    return out.withColumns({m: (F.col(m.removesuffix("_macro")) + F.col(m.removesuffix("_macro") + "_neg")) / 2 for m in ("precision_macro", "recall_macro", "f1_macro")} | {"balanced_accuracy": _ratio(F.col("recall") + F.col("recall_neg"), present)})


def class_report(counts: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of the classes, their plain and their weighted means."""
    r = rates(counts)
    n1, n0 = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    weighted = lambda m: _ratio(F.col(m) * n1 + F.col(f"{m}_neg") * n0, n1 + n0)
    row = lambda label, p, q, f, n: F.struct(F.lit(label).alias("label"), p.alias("precision"), q.alias("recall"), f.alias("f1"), n.alias("support"))
    options = F.array(
        row("0", F.col("precision_neg"), F.col("recall_neg"), F.col("f1_neg"), n0),
        row("1", F.col("precision"), F.col("recall"), F.col("f1"), n1),
        row("macro avg", F.col("precision_macro"), F.col("recall_macro"), F.col("f1_macro"), n0 + n1),
        row("weighted avg", weighted("precision"), weighted("recall"), weighted("f1"), n0 + n1),
    )
    return r.select(F.explode(options).alias("o")).select("o.*")


def business_cost(counts: DataFrame, miss: float, review: float) -> DataFrame:
    """fp * miss + tn * (review - miss) + fn * review."""
    return counts.withColumn("cost", F.col("fp") * miss + F.col("tn") * (review - miss) + F.col("fn") * review)


def log_loss(df: DataFrame, truth: str, score: str, eps: float = 2.220446049250313e-16) -> DataFrame:
    p = F.greatest(F.least(F.col(score), F.lit(1 - eps)), F.lit(eps))
    return df.agg(F.avg(-F.when(F.col(truth) == 1, F.ln(p)).otherwise(F.ln(1 - p))).alias("log_loss"))


def score_counts(df: DataFrame, truth: str, score: str, by: list[str] = ()) -> DataFrame:
    """(by, score, pos, neg, pos_above, neg_above): counts at each distinct score of a group, and at its larger ones.

    Scores are dealt to ranges, the same ones for all groups; sums within a group's range and the sums of its ranges above
    add up, so no task sees a whole group. Groups are few: their ranges are broadcast.
    """
    c, starts = _ranked(df, truth, score, list(by))
    return c.join(F.broadcast(starts), [*by, "range"]).select(*by, "score", "pos", "neg", (F.col("p") + F.col("sp")).alias("pos_above"), (F.col("n") + F.col("sn")).alias("neg_above"))


def _ranked(df: DataFrame, truth: str, score: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(by, range, score, pos, neg, p and n above it in its range), and (by, range, rp, rn of the range, sp and sn above it).

    Scores are counted once and staged, as their ranges, sums and ranks all read the counts.
    """
    spark = df.sparkSession
    at = df.filter(F.col(truth).isNotNull() & F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.sum((F.col(truth) == 1).cast("bigint")).alias("pos"), F.sum((F.col(truth) == 0).cast("bigint")).alias("neg"))
    at = staged(at, "score-counts")
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(at.approxQuantile("score", [i / n for i in range(1, n)], 0.25 / n))) or [0.0]
    ranged = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="score", outputCol="range").transform(at)
    above = Window.partitionBy(*by, "range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = ranged.withColumns({"p": F.sum("pos").over(above) - F.col("pos"), "n": F.sum("neg").over(above) - F.col("neg")})
    by_range = ranged.groupBy(*by, "range").agg(F.sum("pos").alias("rp"), F.sum("neg").alias("rn"))
    # one row for each range of a group
    before = Window.partitionBy(*by).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = by_range.select(*by, "range", "rp", "rn", (F.sum("rp").over(before) - F.col("rp")).alias("sp"), (F.sum("rn").over(before) - F.col("rn")).alias("sn"))
    return inner, staged(starts, "score-ranges")


def ranking_metrics(df: DataFrame, truth: str, score: str, by: list[str] = ()) -> DataFrame:
    """(by, roc_auc, average_precision, average_precision_neg): ties count half; null with one class only.

    The last one is that of the negative class by falling certainty of it.
    """
    by = list(by)
    c, starts = _ranked(df, truth, score, by)
    group = Window.partitionBy(*by)
    known = starts.withColumns({"all_pos": F.sum("rp").over(group), "all_neg": F.sum("rn").over(group)})
    # a row for each range of a group
    c = c.join(F.broadcast(known), [*by, "range"]).withColumns({"pos_above": F.col("p") + F.col("sp"), "neg_above": F.col("n") + F.col("sn")})
    pos, neg = F.max("all_pos"), F.max("all_neg")
    wins = F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2))
    tp, tn = F.col("pos_above") + F.col("pos"), F.col("all_neg") - F.col("neg_above")
    precision = F.col("pos") * tp / (tp + F.col("neg_above") + F.col("neg"))
    precision_neg = F.col("neg") * tn / (tn + F.col("all_pos") - F.col("pos_above"))
    return c.groupBy(*by).agg(
        F.try_divide(wins.cast("double"), pos * neg).alias("roc_auc"),
        F.try_divide(F.sum(precision), F.when(neg > 0, pos)).alias("average_precision"),
        F.try_divide(F.sum(precision_neg), F.when(pos > 0, neg)).alias("average_precision_neg"),
    )


#: The metrics that searches choose by; of ``cost`` less is better.
SEARCHED = ("roc_auc", "balanced_accuracy", "cost", "f1_macro", "f1", "average_precision_neg", "f1_neg", "average_precision", "precision", "recall", "accuracy")


def search_metrics(scored: DataFrame, by: list[str], miss: float, review: float, cut: float = 0.5) -> DataFrame:
    """(by, SEARCHED) from rows (by, y, score), all groups in one pass each for counts and ranks."""
    marked = scored.withColumn("prediction", (F.col("score") >= cut).cast("int"))
    counts = business_cost(rates(confusion(marked, "y", "prediction", by)), miss, review)
    return counts.join(ranking_metrics(scored, "y", "score", by), by).select(*by, *SEARCHED)


def roc_points(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr) at each distinct score."""
    c = score_counts(df, truth, score)
    all_ = c.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()  # two numbers
    share = lambda above, here, n: F.try_divide((F.col(above) + F.col(here)).cast("double"), F.lit(n))
    return c.select(F.col("score").alias("threshold"), share("neg_above", "neg", all_["neg"]).alias("fpr"), share("pos_above", "pos", all_["pos"]).alias("tpr"))


def threshold_sweep(df: DataFrame, truth: str, score: str, miss: float, review: float, low: float = 0.35, high: float = 0.7, steps: int = 100) -> DataFrame:
    """(threshold, tp, fp, tn, fn, cost) on an even grid, from counts by the number of thresholds a score reaches."""
    width = (high - low) / (steps - 1)
    grid = [low + width * i for i in range(steps)]
    spark = df.sparkSession
    # how many thresholds are <= score: a guess by division, put right against the grid itself
    s = F.col(score).cast("double")
    guess = F.greatest(F.lit(0), F.least(F.lit(steps), F.floor((s - low) / width).cast("int") + 1))
    g = F.array(*map(F.lit, grid))
    up = F.when((guess < steps) & (F.get(g, guess) <= s), guess + 1).otherwise(guess)
    reach = F.when((up > 0) & (F.get(g, up - 1) > s), up - 1).otherwise(up)
    counts = df.filter(F.col(truth).isNotNull() & s.isNotNull()).groupBy(reach.alias("reach")).agg(F.sum((F.col(truth) == 1).cast("bigint")).alias("pos"), F.sum((F.col(truth) == 0).cast("bigint")).alias("neg"))
    table = spark.createDataFrame([(i, t) for i, t in enumerate(grid, 1)] + [(0, None)], "reach int, threshold double").join(counts, "reach", "left").fillna(0, ["pos", "neg"])
    # at most steps + 1 rows from here on
    down = Window.orderBy(F.desc("reach")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy(F.desc("reach")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table = table.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down), "__p": F.sum("pos").over(whole), "__n": F.sum("neg").over(whole)})
    table = table.filter("threshold IS NOT NULL").select("threshold", "tp", "fp", (F.col("__n") - F.col("fp")).alias("tn"), (F.col("__p") - F.col("tp")).alias("fn"))
    return business_cost(table, miss, review)


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row of least cost; of equal ones that of the lowest threshold."""
    return sweep.orderBy(F.round("cost", 9), "threshold").limit(1)


def error_analysis(df: DataFrame, probability: str, threshold: float = 0.5) -> DataFrame:
    """Columns that say where the correctness model is right, and the answers after those judged wrong are flipped."""
    yes = lambda c: (F.col(c) == "YES").cast("int")
    out = df.withColumns({"meta_model_confidence": F.col(probability), "meta_model_prediction": (F.col(probability) >= threshold).cast("int"), "llm_prediction_binary": yes("llm_prediction"), "ground_truth_binary": F.col("ground_truth").cast("int")})
    m, y = F.col("meta_model_prediction"), F.col("is_correct")
    flipped = F.when(m == 0, 1 - F.col("llm_prediction_binary")).otherwise(F.col("llm_prediction_binary"))
    return out.withColumns({
        "meta_model_correct": (m == y).cast("int"),
        "false_positive": ((m == 1) & (y == 0)).cast("int"),
        "false_negative": ((m == 0) & (y == 1)).cast("int"),
        "llm_wrong_detected": ((m == 0) & (y == 0)).cast("int"),
        "llm_correct_accepted": ((m == 1) & (y == 1)).cast("int"),
        "llm_corrected_prediction_binary": flipped,
        "llm_after_label_flipping_binary": flipped,
        "llm_after_label_flipping": F.when(flipped == 1, "YES").otherwise("NO"),
    })


def detection_summary(analysed: DataFrame) -> DataFrame:
    """How many wrong answers were found, and how many right ones accepted."""
    n = lambda c: F.sum(c).cast("bigint")
    return analysed.agg(n("llm_wrong_detected").alias("wrong_detected"), n((F.col("is_correct") == 0).cast("int")).alias("wrong_total"), n("llm_correct_accepted").alias("correct_accepted"), n((F.col("is_correct") == 1).cast("int")).alias("correct_total"))


def flip_comparison(analysed: DataFrame) -> DataFrame:
    """(metric, original, flipped, delta) of the answers before and after flipping, against the ground truth."""
    parts = []
    for name, column in (("original", "llm_prediction_binary"), ("flipped", "llm_after_label_flipping_binary")):
        parts.append(rates(confusion(analysed, "ground_truth_binary", column)).withColumn("answers", F.lit(name)))
    both = parts[0].unionByName(parts[1])
    metrics = ("f1", "f1_macro", "precision", "recall", "accuracy", "balanced_accuracy")
    long = both.select("answers", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))).alias("o")).select("answers", "o.*")
    wide = long.groupBy("metric").pivot("answers", ["original", "flipped"]).agg(F.first("value"))
    return wide.withColumn("delta", F.col("flipped") - F.col("original"))


def review_queue(analysed: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Least confident first; only the first n, if given."""
    ordered = analysed.orderBy("meta_model_confidence", key)
    return ordered.limit(n) if n is not None else ordered


def top_models(results: DataFrame, metrics: tuple[str, ...] = ("test_f1", "test_f1_macro", "test_roc_auc", "test_accuracy"), n: int = 10) -> DataFrame:
    """(metric, rank, experiment_name, value): the best n experiments by each metric that the table has."""
    there = [m for m in metrics if m in results.columns]
    long = results.select("experiment_name", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in there))).alias("o")).select("experiment_name", "o.*").filter("value IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("value"), "experiment_name"))
    return long.withColumn("rank", rank).filter(F.col("rank") <= n)


def best_result(results: DataFrame, metric: str, ascending: bool = False) -> DataFrame:
    """The experiment with the largest (or least) value."""
    order = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    return results.orderBy(order, "experiment_name").limit(1)
