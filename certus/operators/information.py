"""Mutual information of features with a class by nearest neighbours (Ross 2014), each feature by itself.

A value's radius is the distance to its k-th neighbour of its class; the information follows from how many values of any
class lie within it. Equal values are one row with their number. Values are dealt to ranges; a range gets the k values of
each class on either side of it (its halo), and positions are looked up in the range that they lie in and added to what
the ranges below hold. So no task sees a whole feature, and a frequent value is one row for each class.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certus.functions.text import clipped
from certus.plans.staging import staged

#: Distinct values of a range, about, and ranges of a feature at most.
RANGE, RANGES = 100_000, 4_096


def digamma(n: Column) -> Column:
    """Of whole numbers from 1 on: six steps up, then the asymptotic series."""
    x = n.cast("double")
    up = sum((1 / (x + i) for i in range(6)), F.lit(0.0))
    z = 1 / ((x + 6) * (x + 6))
    return F.ln(x + 6) - 0.5 / (x + 6) - z * (1 / 12 - z * (1 / 120 - z / 252)) - up


def _radii(rows: pd.DataFrame, k: dict[int, int], before: dict, after: dict) -> pd.DataFrame:
    """(feature, y, value, n, radius) of the values of a range; before and after: halos by (feature, range, class)."""
    out = []
    at = (rows["feature"].iloc[0], int(rows["range"].iloc[0]))
    for y, own in rows.groupby("y"):
        own = own.sort_values("value")
        kth = k[int(y)]
        # more than k + 1 equal values are no nearer to each other than k + 1
        times = np.minimum(own["n"].to_numpy(), kth + 1)
        left, right = before.get((*at, int(y)), []), after.get((*at, int(y)), [])
        x = np.r_[np.full(kth, -np.inf), left, np.repeat(own["value"].to_numpy(float), times), right, np.full(kth, np.inf)]
        place = kth + len(left) + np.cumsum(times) - times
        v, radius = x[place], np.full(len(own), np.inf)
        for j in range(kth + 1):  # windows of k + 1 values with the value in them
            radius = np.minimum(radius, np.maximum(v - x[place - j], x[place - j + kth] - v))
        n = own["n"].to_numpy()
        out.append(pd.DataFrame({"feature": at[0], "y": int(y), "value": v, "n": n, "radius": radius, "k": np.where(radius == 0, n - 1, kth)}))
    return pd.concat(out)


def _ranks(asked: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
    """Signed numbers of values of a range below the positions asked for (or up to them, where ``upto``)."""
    points = points.sort_values("value")
    x, n = points["value"].to_numpy(float), np.r_[0, np.cumsum(points["n"].to_numpy())]
    pos, upto = asked["pos"].to_numpy(float), asked["upto"].to_numpy(bool)
    at = np.where(upto, np.searchsorted(x, pos, "right"), np.searchsorted(x, pos, "left"))
    return pd.DataFrame({"feature": asked["feature"], "y": asked["y"], "value": asked["value"], "n": asked["n"], "k": asked["k"], "found": (n[at] + asked["base"].to_numpy()) * asked["sign"].to_numpy()})


def neighbour_information(df: DataFrame, features: list[str], target: str, k: int = 3) -> DataFrame:
    """(feature, n, mi) in nats, 0 at least; rows with a null count for the other features only.

    A class with one value of a feature is left out of that feature, and with k or fewer its other values are the
    neighbours. No noise is added to ties: a value with k equal ones in its class has all of those as its neighbours, and
    all equal values within its radius (Gao et al. 2017).
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), clipped(F.col(f).cast("double")).alias("value")) for f in features)))
    long = df.filter(F.col(target).isNotNull()).select(F.col(target).cast("int").alias("y"), pairs.alias("o")).select("y", "o.*").filter("value IS NOT NULL")
    values = staged(long.groupBy("feature", "y", "value").agg(F.count("*").alias("n")), "feature-values")
    # a row for each feature and class
    sizes = values.groupBy("feature", "y").agg(F.sum("n").alias("class_n"), F.count("*").alias("distinct")).collect()
    class_n = {(r["feature"], r["y"]): r["class_n"] for r in sizes if r["class_n"] > 1}
    schema = "feature string, n bigint, mi double"
    if not class_n:
        return df.sparkSession.createDataFrame([], schema)
    distinct: dict[str, int] = {}
    for r in sizes:
        distinct[r["feature"]] = distinct.get(r["feature"], 0) + r["distinct"]
    wanted = max(1, min(RANGES, max(distinct.values()) // RANGE))
    cuts = {f: np.empty(0) for f in distinct}
    if wanted > 1:
        found = values.groupBy("feature").agg(F.percentile_approx("value", [i / wanted for i in range(1, wanted)], 10 * wanted).alias("cuts"))
        cuts |= {r["feature"]: np.unique(r["cuts"]) for r in found.collect()}  # RANGES for each feature at most

    @F.arrow_udf("int")
    def range_of(feature: pa.Array, value: pa.Array) -> pa.Array:
        names, at = np.array(feature.to_pylist(), object), value.to_numpy(zero_copy_only=False)
        out = np.zeros(len(at), np.int32)
        for name, edges in cuts.items():
            here = names == name
            out[here] = np.searchsorted(edges, at[here])
        return pa.array(out)

    usable = F.lit(False)
    for f, y in class_n:
        usable = usable | ((F.col("feature") == f) & (F.col("y") == y))
    placed = staged(values.filter(usable).withColumn("range", range_of("feature", "value")), "ranged-values")
    # of each class of a range the k first and the k last values, each k + 1 times at most; totals of ranges
    edge = lambda order: F.row_number().over(Window.partitionBy("feature", "range", "y").orderBy(order))
    edges = placed.withColumns({"first": edge(F.asc("value")), "last": edge(F.desc("value"))}).filter((F.col("first") <= k) | (F.col("last") <= k)).collect()
    before, after = _halos(edges, k)
    totals = placed.groupBy("feature", "range").agg(F.sum("n").alias("n")).collect()  # RANGES for each feature
    base, seen = {}, {}
    for r in sorted(totals, key=lambda r: (r["feature"], r["range"])):
        base[r["feature"], r["range"]] = seen.get(r["feature"], 0)
        seen[r["feature"]] = seen.get(r["feature"], 0) + r["n"]
    kth = {f: {y: min(k, n - 1) for (g, y), n in class_n.items() if g == f} for f in distinct}
    radii = placed.groupBy("feature", "range").applyInPandas(lambda rows: _radii(rows, kth[rows["feature"].iloc[0]], before, after), "feature string, y int, value double, n bigint, radius double, k bigint")
    v, r = F.col("value"), F.col("radius")
    # inside the radius, or at the value itself where that is 0
    high = F.struct((v + r).alias("pos"), (r == 0).alias("upto"), F.lit(1).alias("sign"))
    low = F.struct((v - r).alias("pos"), (r > 0).alias("upto"), F.lit(-1).alias("sign"))
    asked = staged(radii.select("feature", "y", "value", "n", "k", F.explode(F.array(high, low)).alias("o")).select("feature", "y", "value", "n", "k", "o.*"), "positions")
    asked = asked.withColumn("range", range_of("feature", "pos"))
    starts = df.sparkSession.createDataFrame([(f, i, n) for (f, i), n in base.items()], "feature string, range int, base bigint")
    filled = placed.select("feature", "range", "value", "n")
    known = F.broadcast(starts.withColumn("own", F.lit(1)))
    # a position may lie in a range without values: then all that lies below it is in earlier ranges
    asked = asked.join(known, ["feature", "range"], "left")
    filled_at = {f: np.array(sorted(i for g, i in base if g == f), np.int64) for f in distinct}
    below = {f: np.array([*(base[f, i] for i in at.tolist()), seen.get(f, 0)], np.int64) for f, at in filled_at.items()}

    @F.arrow_udf("bigint")
    def base_of(feature: pa.Array, at: pa.Array) -> pa.Array:
        names, at = np.array(feature.to_pylist(), object), at.to_numpy(zero_copy_only=False)
        out = np.zeros(len(at), np.int64)
        for name in set(names):
            here = names == name
            out[here] = below[name][np.searchsorted(filled_at[name], at[here])]
        return pa.array(out)

    empty = asked.filter("own IS NULL").select("feature", "y", "value", "n", "k", (base_of("feature", "range") * F.col("sign")).alias("found"))
    within = asked.filter("own IS NOT NULL").groupBy("feature", "range").cogroup(filled.groupBy("feature", "range")).applyInPandas(_ranks, "feature string, y int, value double, n bigint, k bigint, found bigint")
    counted = within.unionByName(empty).groupBy("feature", "y", "value", "n", "k").agg(F.sum("found").alias("m"))
    sums = counted.groupBy("feature").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * (digamma(F.col("k")) - digamma(F.col("m")))) / F.sum("n")).alias("inside"))
    classes = df.sparkSession.createDataFrame([(f, n) for (f, _), n in class_n.items()], "feature string, class_n bigint")
    shares = classes.groupBy("feature").agg((F.sum(F.col("class_n") * digamma(F.col("class_n"))) / F.sum("class_n")).alias("classes"))
    # a row for each feature
    return sums.join(F.broadcast(shares), "feature").select("feature", "n", F.greatest(F.lit(0.0), digamma(F.col("n")) - F.col("classes") + F.col("inside")).alias("mi"))


def _halos(edges: list, k: int) -> tuple[dict, dict]:
    """The k values of each class before and after each range, by (feature, range, class), from the ranges' own edges."""
    by: dict = {}
    for r in edges:
        by.setdefault((r["feature"], r["y"]), {}).setdefault(r["range"], []).append((r["value"], r["n"], r["first"], r["last"]))
    before, after = {}, {}
    for (feature, y), ranges in by.items():
        ordered = sorted(ranges)
        for order, rank, out in ((ordered, 3, before), (ordered[::-1], 2, after)):
            halo: list[float] = []
            for at in order:
                out[feature, at, y] = np.array(sorted(halo))
                near = sorted((e for e in ranges[at] if e[rank] <= k), key=lambda e: e[rank])
                own = [v for v, n, *_ in near for _ in range(min(n, k))][:k]
                halo = (own + halo)[:k]
    return before, after
