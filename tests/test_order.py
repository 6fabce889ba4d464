"""Exact quantiles against sorted lists."""

import random

import numpy as np
import pytest

from certus.operators import order, stats


@pytest.mark.parametrize("kept", [3, 100_000])
def test_quantiles_equal_those_of_sorted_lists(spark, monkeypatch, kept):
    monkeypatch.setattr(order, "KEPT", kept)
    monkeypatch.setattr(order, "ACCURACY", 40)
    rnd = random.Random(2)
    rows = []
    for i in range(3000):
        rows.append((rnd.gauss(0, 1), float(rnd.choice([1, 1, 1, 2, 9])), 10.0 ** rnd.uniform(-200, 200), float(i < 1500), 7.0, rnd.random() if i % 3 else None, None))
    names = ["normal", "ties", "wide", "halves", "constant", "holes", "nothing"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5)
    shares = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = order.quantiles(df, names, shares)
    for i, name in enumerate(names):
        values = [r[i] for r in rows if r[i] is not None]
        want = np.quantile(values, shares) if values else [None] * len(shares)
        assert found[name] == [None] * len(shares) if not values else np.allclose(found[name], want, rtol=1e-9), name


def test_exact_statistics_of_empty_and_small_tables(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None)], "a double, b double")
    got = {r["feature"]: r for r in stats.feature_statistics(df, ["a", "b"], exact=True).collect()}
    assert (got["a"]["q25"], got["a"]["median"], got["a"]["q75"]) == (1.5, 2.0, 3.0) and got["b"]["median"] is None
    assert stats.feature_statistics(df.limit(0), ["a"], exact=True).first()["median"] is None
