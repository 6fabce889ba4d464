"""Monotone fits against the min-max formula, and saved models of every kind."""

import math
import random

import pytest
from pyspark.sql import functions as F

from certus.operators import boosting, models
from certus.operators.isotonic import Steps, fit_steps


def min_max(rows):
    xs = sorted({x for x, _ in rows})
    total = [sum(y for x, y in rows if x == v) for v in xs]
    n = [sum(1 for x, _ in rows if x == v) for v in xs]
    mean = lambda i, j: sum(total[i : j + 1]) / sum(n[i : j + 1])
    return {x: max(min(mean(j, k) for k in range(i, len(xs))) for j in range(i + 1)) for i, x in enumerate(xs)}


@pytest.mark.parametrize("shape", ["noisy", "falling", "one value", "rising"])
def test_fit_is_the_min_max_formula(spark, shape):
    rnd = random.Random(5)
    rows = []
    for i in range(500):
        x = {"one value": 0.5, "rising": float(i)}.get(shape, round(rnd.random(), 2))
        y = {"falling": rnd.random() < 1 - x, "rising": i > 250}.get(shape, rnd.random() < x)
        rows.append((x, float(y)))
    df = spark.createDataFrame([*rows, (None, 1.0), (math.nan, 1.0), (0.3, None)], "x double, y double").repartition(6)
    (steps,) = fit_steps(df, F.col("x"), F.col("y"))
    want = min_max(rows)
    got = {r["x"]: r["p"] for r in df.select("x", steps.value(F.col("x")).alias("p")).collect() if r["x"] is not None and not math.isnan(r["x"])}
    assert set(want) <= set(got) and all(math.isclose(got[x], want[x], abs_tol=1e-12) for x in want)
    assert df.filter("x IS NULL OR isnan(x)").select(steps.value(F.col("x")).alias("p")).filter("p IS NOT NULL").count() == 0


def test_folds_are_fitted_apart(spark):
    rnd = random.Random(6)
    rows = [(i % 3, round(rnd.random(), 1), float(rnd.random() < 0.5)) for i in range(300)]
    df = spark.createDataFrame(rows, "f int, x double, y double")
    found = fit_steps(df, F.col("x"), F.col("y"), 4, F.col("f"))
    for f in range(3):
        want = min_max([(x, y) for g, x, y in rows if g == f])
        assert all(math.isclose(p, want[x], abs_tol=1e-12) for x, p in zip(found[f].x, found[f].p))
    assert found[3] == Steps((), ())


def test_values_between_and_beyond_points(spark):
    steps = Steps((0.0, 1.0, 3.0), (0.1, 0.5, 0.9))
    df = spark.createDataFrame([(-5.0,), (0.0,), (0.5,), (1.0,), (2.0,), (3.0,), (9.0,), (None,)], "x double")
    got = [r["p"] for r in df.select(steps.value(F.col("x")).alias("p")).collect()]
    assert [None if p is None else round(p, 9) for p in got] == [0.1, 0.1, 0.3, 0.5, 0.7, 0.9, 0.9, None]
    assert df.select(Steps((2.0,), (0.4,)).value(F.col("x")).alias("p")).distinct().count() == 2


def test_every_kind_of_model_is_saved_and_scores_alike(spark):
    rnd = random.Random(7)
    rows = [(i, int(rnd.random() < 0.7), rnd.gauss(0, 1), rnd.gauss(0, 1) if i % 9 else None) for i in range(400)]
    df = spark.createDataFrame([(k, y, a + y, b) for k, y, a, b in rows], "k int, y int, a double, b double")
    made = [models.calibrated_model(df, ["a", "b"], "y", "k", method=m) for m in ("sigmoid", "isotonic")]
    made.append(models.fit_boosted(df, ["a", "b"], "y", "k", boosting.Setting(trees=5), rows=1000))
    for model in made:
        again = models.model_from_json(model.to_json())
        assert type(again) is type(model) and again.features == ("a", "b")
        first, second = (df.select("k", m.probability().alias("p")).orderBy("k").collect() for m in (model, again))
        assert first == second and all(0 <= r["p"] <= 1 for r in first)
    plan = df.select(made[1].probability())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    with pytest.raises(ValueError):
        models.calibrated_model(df, ["a"], "y", "k", method="other")
