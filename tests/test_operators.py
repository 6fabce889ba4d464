"""Sampling, neighbours, metrics and models on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from certus.operators import metrics, models, neighbors, sampling, selection, stats
from certus.streaming.scoring import score_stream


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(400):
        y = int(rnd.random() < 0.8)
        rows.append((i, y, round(rnd.gauss(y, 1), 1), round(rnd.gauss(-y, 1), 1)))
    return spark.createDataFrame(rows, "k int, y int, a double, b double").repartition(7)


def test_split_is_exact_and_independent_of_partitions(spark, table):
    one = {r["k"]: r["is_test"] for r in sampling.split(table, "k", "y").collect()}
    two = {r["k"]: r["is_test"] for r in sampling.split(table.coalesce(1), "k", "y").collect()}
    assert one == two and sum(one.values()) == 80


def test_quotas():
    assert sampling.test_quotas({1: 36, 0: 14}, 0.2) == {1: 7, 0: 3}
    assert sampling.balance_plan({0: 50, 1: 50}, 6).majority == 0
    with pytest.raises(ValueError):
        sampling.balance_plan({1: 5}, 6)
    with pytest.raises(ValueError):
        models.Costs(0, 1)


def test_few_labels_are_split_without_strata(table):
    few = table.filter("k < 15")
    assert sum(r["is_test"] for r in sampling.split(few, "k", "y").collect()) == 4
    assert sampling.split(few.limit(0), "k", "y").count() == 0


def test_settings_are_drawn_from_their_ranges():
    drawn = models.draw_settings(40, seed=1)
    assert drawn == models.draw_settings(40, seed=1)
    assert all(50 <= d.trees < 200 and 3 <= d.depth <= 5 and 0.05 <= d.step <= 0.3 and 0.7 <= d.subsample <= 1 and 0.7 <= d.columns <= 1 for d in drawn)
    assert all(0.1 <= d.alpha <= 5 and 0.5 <= d.l2 <= 20 and 0.001 <= d.gamma <= 0.1 and d.min_child in range(3, 8) for d in drawn)


def test_folds_are_even(table):
    sizes = {(r["y"], r["fold"]): r["count"] for r in sampling.folds(table, "k", "y", 3).groupBy("y", "fold").count().collect()}
    for y in (0, 1):
        of = [n for (c, _), n in sizes.items() if c == y]
        assert max(of) - min(of) <= 1


def test_cleaners_agree_with_brute_force(table):
    rows = [(r["k"], r["y"], r["a"], r["b"]) for r in table.collect()]
    near = {k: sorted((((a - c) ** 2 + (b - d) ** 2), j, z) for j, z, c, d in rows if j != k)[:3] for k, _, a, b in rows}
    label = {k: y for k, y, _, _ in rows}
    tomek = {k for k in near if label[k] == 1 and label[near[k][0][1]] == 0 and near[near[k][0][1]][0][1] == k}
    enn = {k for k in near if label[k] == 1 and any(z == 0 for _, _, z in near[k])}
    assert {r["k"] for r in neighbors.tomek_removed(table, "k", "y", ["a", "b"], 1).collect()} == tomek
    assert {r["k"] for r in neighbors.enn_removed(table, "k", "y", ["a", "b"], 1).collect()} == enn


@pytest.mark.parametrize("shape", ["cloud", "one column repeats", "few places", "three features", "nine features", "rings"])
def test_nearest_over_many_cells(spark, monkeypatch, shape):
    monkeypatch.setattr(neighbors, "CELL", 300 if shape == "rings" else 25)
    monkeypatch.setattr(neighbors, "RING", 20)
    rnd = random.Random(8)
    features = {"three features": ["a", "b", "c"], "nine features": [*"abcdefghi"]}.get(shape, ["a", "b"])
    rows = []
    for i in range(700):
        x = [rnd.gauss(i % 3, 1) for _ in features]
        if shape == "one column repeats":
            x[0] = 0.5 if i % 3 else x[0]
        if shape == "few places":
            x = [float(round(x[0])), 1.0]
        rows.append((i, i % 4, x[0] * (100 if i == 5 else 1), *x[1:]))
    df = spark.createDataFrame(rows, "k int, y int, " + ", ".join(f"{f} double" for f in features)).repartition(5)
    at = {r[0]: r[2:] for r in rows}
    want = set()
    for k in range(0, 700, 7):
        near = sorted((sum((p - q) ** 2 for p, q in zip(at[k], x)), j) for j, x in at.items() if j != k)[:3]
        want |= {(k, n, j, j % 4) for n, (_, j) in enumerate(near, 1)}
    found = neighbors.nearest(df.filter("k % 7 = 0"), df, "k", features, 3, "y", compared=True).collect()
    assert {(r["k"], r["rank"], r["neighbour"], r["y"]) for r in found} == want and len(found) == len(want)
    if shape in ("cloud", "three features", "rings"):
        assert sum(r["compared"] for r in found if r["rank"] == 1) < 100 * 700 * 0.7


def test_nearest_of_other_points(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "CELL", 20)
    rnd = random.Random(3)
    points = spark.createDataFrame([(i, i % 2, rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(200)], "k int, y int, a double, b double")
    far = spark.createDataFrame([(1000 + i, 0, 50.0 + i, 3.0) for i in range(5)] + [(2000, 0, None, 1.0)], points.schema)
    found = neighbors.nearest(far, points, "k", ["a", "b"], 2, "y").collect()
    rows = points.collect()
    for q in range(5):
        near = sorted(((r["a"] - 50.0 - q) ** 2 + (r["b"] - 3.0) ** 2, r["k"]) for r in rows)[:2]
        assert [r["neighbour"] for r in sorted(found, key=lambda r: r["rank"]) if r["k"] == 1000 + q] == [k for _, k in near]
    assert len(found) == 10
    assert neighbors.nearest(far, points.limit(0), "k", ["a", "b"], 2, "y").count() == 0


def test_nulls_make_cleaning_random(table):
    holed = table.withColumn("a", F.when(F.col("k") != 3, F.col("a")))
    a = {r["k"] for r in neighbors.clean(holed, "k", "y", ["a", "b"], "enn", 2.0).filter("kept").collect()}
    b = {r["k"] for r in sampling.undersample(holed, "k", "y", 2.0).filter("kept").collect()}
    assert a == b
    with pytest.raises(ValueError):
        neighbors.clean(table, "k", "y", ["a"], "other")


def test_single_class_metrics(spark):
    df = spark.createDataFrame([(1, 0, 0.2), (2, 0, 0.9)], "k int, y int, p double").withColumn("m", F.lit(0))
    r = metrics.rates(metrics.confusion(df, "y", "m")).first()
    assert (r["tn"], r["tp"], r["f1"]) == (2, 0, 0.0)
    assert metrics.ranking_metrics(df, "y", "p").first()["roc_auc"] is None
    empty = metrics.rates(metrics.confusion(df.limit(0), "y", "m")).first()
    assert (empty["tp"], empty["accuracy"]) == (0, 0.0)


def test_business_cost(spark):
    counts = spark.createDataFrame([(5, 2, 3, 1)], "tp int, fp int, tn int, fn int")
    assert round(metrics.business_cost(counts, 0.94, 0.64).first()["cost"], 6) == 1.62


def test_auc_counts_pairs(table):
    rows = [(r["y"], r["a"]) for r in table.collect()]
    pairs = [(x > z) + 0.5 * (x == z) for y, x in rows if y == 1 for w, z in rows if w == 0]
    assert math.isclose(metrics.ranking_metrics(table, "y", "a").first()["roc_auc"], sum(pairs) / len(pairs), rel_tol=1e-9)


def test_p_values():
    assert math.isclose(stats.pearson_p(0.5, 20), 0.02476989, abs_tol=1e-6)
    assert stats.pearson_p(None, 9) is None


def test_constant_columns_and_inflation(table):
    assert stats.constant_columns(table.withColumn("c", F.lit(1)), ["a", "c"]) == ["c"]
    g = selection.gram_matrix(table.withColumn("d", F.col("a") * 2 + 0.001 * F.col("b")), ["a", "b", "d"])
    stay, dropped = selection.drop_inflated(g, ["a", "b", "d"])
    assert len(stay) == 2 and dropped[0][1] > 15


def test_drop_collinear_prefers_the_target():
    assert stats.drop_collinear([("a", "b"), ("b", "c")], {"a": 0.5, "b": 0.2, "c": None}) == ["b"]
    assert stats.drop_collinear([("a", "b")], {"a": 0.2, "b": 0.2}) == ["a"]


def test_ridge_separates_and_calibrates(table):
    model = models.ridge(models.class_sums(table, ["a", "b"], "y"), ["a", "b"])
    assert models.Linear.from_json(model.to_json()) == model
    scored = table.withColumn("probability", models.calibrate_sigmoid(table, model, "y").probability())
    assert metrics.ranking_metrics(scored, "y", "probability").first()["roc_auc"] > 0.8
    mean = scored.agg(F.avg("probability"), F.avg("y")).first()
    assert abs(mean[0] - mean[1]) < 0.02
    apply = models.calibrated_probability(table, ["a", "b"], "y", "k", method="isotonic")
    assert metrics.ranking_metrics(apply(table), "y", "probability").first()["roc_auc"] > 0.8


def test_stream_scores_like_a_batch(spark, tmp_path):
    rows = [(str(i), f'[{{"token":"YES","logprob":-0.{i}}},{{"token":"NO","logprob":-2}}]', None) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "content_id string, top_logprobs string, logprobs_data string")
    df.write.parquet(str(tmp_path / "in"))
    model = models.Linear(("model_logprob_gap",), (0.0,), (1.0,), (1.0,), 0.0, 1.0, 0.0)
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = score_stream(stream, model, 0.5).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    batch = {tuple(r) for r in score_stream(df, model, 0.5).collect()}
    assert {tuple(r) for r in spark.table("scored").collect()} == batch and len(batch) == 8


def test_scores_are_counted_once(spark, table):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def noted(a):
        seen.add(1)
        return a

    counted = table.select("y", F.col("k") % 3, noted("a").alias("a")).toDF("y", "g", "a")
    # once for the filter of missing scores, and once for the counts
    assert metrics.ranking_metrics(counted, "y", "a", ["g"]).count() == 3 and seen.value <= 2 * 400
