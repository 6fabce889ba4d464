"""Nearest-neighbour mutual information against brute force."""

import math
import random
from collections import Counter

import pytest

from certus.operators import information


def brute(rows, k=3):
    """Ross' estimate from (y, x)."""
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, n))
    counts = Counter(y for y, _ in rows)
    rows = [(y, x) for y, x in rows if counts[y] > 1]
    total = 0.0
    for i, (y, x) in enumerate(rows):
        kk = min(k, counts[y] - 1)
        d = sorted(abs(x - z) for j, (c, z) in enumerate(rows) if c == y and j != i)[kk - 1]
        m = sum(abs(x - z) < d or z == x for _, z in rows)
        kk = kk if d else sum(c == y and z == x for c, z in rows) - 1
        total += psi(kk) - psi(counts[y]) - psi(m)
    return max(0.0, psi(len(rows)) + total / len(rows))


@pytest.mark.parametrize("size", [100_000, 7])
def test_information(spark, monkeypatch, size):
    monkeypatch.setattr(information, "RANGE", size)
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        y = int(rnd.random() < 0.7)
        rows.append((i, y if i % 50 else None, float(round(rnd.gauss(3 * y, 1) * 1000)), float(rnd.randrange(5)), float(rnd.choice([0, 0, 0, rnd.randrange(900)])) if i % 9 else None, float(y)))
    rows += [(900, 2, 5.0, 1.0, None, 1.0)]  # a class of its own
    df = spark.createDataFrame(rows, "k int, y int, a double, b double, c double, d double").repartition(4)
    got = {r["feature"]: r for r in information.neighbour_information(df, ["a", "b", "c", "d"], "y").collect()}
    for at, f in enumerate("abcd", 2):
        known = [(r[1], r[at]) for r in rows if r[1] is not None and r[at] is not None]
        assert math.isclose(got[f]["mi"], brute(known), abs_tol=1e-8), f
        assert got[f]["n"] == len([y for y, _ in known if y != 2])
    assert got["a"]["mi"] > 0.3 and got["b"]["mi"] < 0.05 and got["d"]["mi"] > 0.5


def test_no_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 2.0)], "y int, a double")
    assert information.neighbour_information(df, ["a"], "y").count() == 0
    assert information.neighbour_information(df.limit(0), ["a"], "y").count() == 0
