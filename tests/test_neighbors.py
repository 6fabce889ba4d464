"""Neighbours over many cells, many copies, and rows that take no part."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from certus import queries
from certus.operators import neighbors


def wanted(x, ids, queries, k):
    out = set()
    for q in queries:
        d = sum(((x[q, j] - x[:, j]) ** 2 for j in range(x.shape[1])), np.zeros(len(x)))
        order = [i for i in np.lexsort((ids, d)) if i != q][:k]
        out |= {(ids[q], n, ids[i]) for n, i in enumerate(order, 1)}
    return out


def test_few_points_are_compared(spark):
    """A query looks at some buckets, not at the ring of a cell that grows with the table."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60_000, 2))
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(x)), "y": 0, "a": x[:, 0], "b": x[:, 1]})).repartition(4)
    found = neighbors.nearest(df.filter("k % 500 = 0"), df, "k", ["a", "b"], 3, "y", compared=True).toPandas()
    assert set(zip(found["k"], found["rank"], found["neighbour"])) == wanted(x, np.arange(len(x)), range(0, len(x), 500), 3)
    assert found[found["rank"] == 1]["compared"].mean() < 150


@pytest.mark.parametrize("cell", [10, 150])
def test_many_copies(spark, monkeypatch, cell):
    """Places on a grid with equal distances, one of them with most of the rows; keys are strings."""
    monkeypatch.setattr(neighbors, "CELL", cell)
    monkeypatch.setattr(neighbors, "RING", 30, raising=False)
    rng = np.random.default_rng(6)
    x = rng.integers(0, 12, size=(1500, 2)) / 4
    x[rng.random(1500) < 0.6] = 0.75
    ids = np.array([f"r{i:05d}" for i in rng.permutation(1500)])
    df = spark.createDataFrame(pd.DataFrame({"k": ids, "y": 1, "a": x[:, 0], "b": x[:, 1]})).repartition(4)
    some = list(range(0, 1500, 9))
    queries = df.filter(F.col("k").isin(ids[some].tolist()))
    found = neighbors.nearest(queries, df, "k", ["a", "b"], 3, "y").toPandas()
    assert set(zip(found["k"], found["rank"], found["neighbour"])) == wanted(x, ids, some, 3)


def test_rows_without_a_place_are_kept(spark):
    rng = np.random.default_rng(7)
    rows = [(i, int(i % 4 > 0), float(rng.normal()) if i % 10 else float("nan"), float(rng.normal())) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, y int, a double, b double")
    kept = {r["k"] for r in neighbors.clean(df, "k", "y", ["a", "b"], "hybrid", 6.0).filter("kept").collect()}
    assert {k for k, *_ in rows if k % 10 == 0} <= kept and len(kept) < 200


def test_columns_that_nothing_reads_are_not_staged(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(queries, "_balanced", lambda df, features: seen.append(df.columns))
    queries.uq_hybrid_balance(spark, "/root/testdata/sf0.001")
    assert set(seen[0]) == {"k", "is_correct", "lp1", "lp2"}
