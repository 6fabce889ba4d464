"""Exact, seeded splits and undersampling that don't depend on partitioning.

Rows are ordered by the md5 of seed and key. A class's first n rows are found without sorting it: counts by the hash's
first three digits give the one digit group in which the cut falls, and only that group is ranked.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certus.plans.staging import staged


def seeded_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(key).cast("string")))


def first_by_hash(df: DataFrame, quotas: dict, key: str, target: str, seed: int, flag: str) -> DataFrame:
    """``df`` with boolean ``flag``: whether a row is among its class's first ``quotas[class]`` by hash (missing: 0).

    Classes are few; the counts by class and hash group are at most 4096 rows for each. Keys must be unique.
    """
    hashed = df.withColumns({"__h": seeded_hash(key, seed)}).withColumn("__g", F.substring("__h", 1, 3))
    counts = hashed.filter(F.col(target).isin(list(quotas))).groupBy(target, "__g").count().orderBy(target, "__g").collect()
    cuts, seen = {}, {}
    for row in counts:
        y, before = row[target], seen.get(row[target], 0)
        if before < quotas[y] <= before + row["count"]:
            cuts[y] = (row["__g"], quotas[y] - before)
        seen[y] = before + row["count"]
    whole, edge, rank_limit = F.lit(False), F.lit(False), F.lit(0)
    for y, quota in quotas.items():
        mine = F.col(target) == F.lit(y)
        if y in cuts:
            group, rest = cuts[y]
            whole, edge, rank_limit = whole | (mine & (F.col("__g") < group)), edge | (mine & (F.col("__g") == group)), F.when(mine, F.lit(rest)).otherwise(rank_limit)
        elif quota > 0:
            whole = whole | mine
    # only the rows of the cut's group of each class are ranked: about 1 in 4096
    inside = hashed.filter(edge).select(F.col(key).alias("__k"), F.col(target).alias("__y"), "__h", rank_limit.alias("__limit"))
    rank = F.row_number().over(Window.partitionBy("__y").orderBy("__h", "__k"))
    chosen = inside.withColumn("__r", rank).filter("__r <= __limit").select("__k", F.lit(True).alias("__in"))
    marked = hashed.join(chosen, F.col(key) == F.col("__k"), "left")
    return marked.withColumn(flag, F.coalesce(whole, F.lit(False)) | F.coalesce("__in", F.lit(False))).drop("__h", "__g", "__k", "__in")


def class_counts(df: DataFrame, target: str) -> dict:
    return {r[target]: r["count"] for r in df.filter(F.col(target).isNotNull()).groupBy(target).count().collect()}


def test_quotas(counts: dict, share: float) -> dict:
    """Test rows of each class: ceil(share * n) in all, dealt by largest remainder."""
    n = sum(counts.values())
    total = math.ceil(share * n)
    exact = {y: total * c / n for y, c in counts.items()}
    out = {y: int(v) for y, v in exact.items()}
    for y in sorted(exact, key=lambda y: (out[y] - exact[y], y))[: total - sum(out.values())]:
        out[y] += 1
    return out


def split(df: DataFrame, key: str, target: str, share: float = 0.2, seed: int = 42, small: int = 20) -> DataFrame:
    """``df`` with boolean ``is_test``: stratified; with fewer than ``small`` labels, a quarter without strata."""
    counts = class_counts(df, target)
    if sum(counts.values()) < small:
        one = df.withColumn("__all", F.lit(0))
        return first_by_hash(one, {0: math.ceil(0.25 * df.count())}, key, "__all", seed, "is_test").drop("__all")
    return first_by_hash(df, test_quotas(counts, share), key, target, seed, "is_test")


def folds(df: DataFrame, key: str, target: str, k: int = 3, seed: int = 42) -> DataFrame:
    """``df`` with ``fold`` 0..k-1: within each class in turn by hash order, so that fold sizes differ by one at most.

    Ranks come from counts by class and hash group and a rank within the group, so no task sees a class.
    """
    hashed = df.withColumn("__h", seeded_hash(key, seed)).withColumn("__g", F.substring("__h", 1, 3))
    totals = hashed.groupBy(target, "__g").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(target).orderBy("__g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = totals.withColumn("__start", F.sum("__n").over(before) - F.col("__n")).select(F.col(target).alias("__y"), F.col("__g").alias("__gg"), "__start")
    rank = F.row_number().over(Window.partitionBy(target, "__g").orderBy("__h", key)) - 1
    # 4096 rows for each class at most
    placed = hashed.withColumn("__r", rank).join(F.broadcast(starts), F.col(target).eqNullSafe(F.col("__y")) & (F.col("__g") == F.col("__gg")))
    return placed.withColumn("fold", F.pmod(F.col("__start") + F.col("__r"), F.lit(k)).cast("int")).drop("__h", "__g", "__r", "__y", "__gg", "__start")


@dataclass(frozen=True)
class BalancePlan:
    majority: int
    target: int
    n_min: int
    n_maj: int


def balance_plan(counts: dict, ratio: float, least: int = 10) -> BalancePlan:
    """Which class is cut, and to how many rows: int(ratio * minority), at least ``least``, at most what there is."""
    if set(counts) != {0, 1}:
        raise ValueError("exactly two classes are needed")
    majority = 1 if counts[1] > counts[0] else 0
    n_min, n_maj = counts[1 - majority], counts[majority]
    target = min(int(ratio * n_min), n_maj)
    return BalancePlan(majority, target if target >= least else min(least, n_maj), n_min, n_maj)


def check_size(counts: dict, least: int) -> None:
    if sum(counts.values()) < 2 * least:
        raise ValueError(f"at least {2 * least} labelled rows are needed")


def undersample(df: DataFrame, key: str, target: str, ratio: float = 6.0, seed: int = 42, counts: dict | None = None, target_rows: int | None = None) -> DataFrame:
    """``df`` with boolean ``kept``: the whole minority, and the majority's first rows by hash up to the plan's number."""
    counts = counts or class_counts(df, target)
    plan = balance_plan(counts, ratio)
    quota = plan.target if target_rows is None else target_rows
    return first_by_hash(df, {plan.majority: min(quota, counts[plan.majority]), 1 - plan.majority: counts[1 - plan.majority]}, key, target, seed, "kept")


def stage_report(stages: dict[str, DataFrame], target: str) -> DataFrame:
    """(stage, pos, neg, total, ratio) of each table; the ratio is 0 without negatives."""
    out = None
    for name, df in stages.items():
        pos, neg = F.count_if(F.col(target) == 1), F.count_if(F.col(target) == 0)
        row = df.agg(pos.alias("pos"), neg.alias("neg")).select(F.lit(name).alias("stage"), "pos", "neg", (F.col("pos") + F.col("neg")).alias("total"), F.coalesce(F.try_divide(F.col("pos").cast("double"), F.col("neg")), F.lit(0.0)).alias("ratio"))
        out = row if out is None else out.unionByName(row)
    return out


def reduction_report(before: dict[str, DataFrame], after: dict[str, DataFrame], target: str) -> DataFrame:
    """(stage, pos, neg, total, ratio, pos_after, neg_after, total_after, ratio_after, removed, reduction_pct) for each
    name in both; the reduction is 0 where there was nothing."""
    first = stage_report(before, target)
    then = stage_report(after, target).select("stage", *(F.col(c).alias(f"{c}_after") for c in ("pos", "neg", "total", "ratio")))
    both = first.join(then, "stage")
    removed = F.col("total") - F.col("total_after")
    return both.withColumns({"removed": removed, "reduction_pct": F.coalesce(F.try_divide(100.0 * removed, F.col("total")), F.lit(0.0))})


def split_and_balance(df: DataFrame, key: str, target: str, features: list[str], method: str = "random", train_ratio: float = 6.0, test_ratio: float = 3.0, share: float = 0.2, seed: int = 42, least: int = 10) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(balanced train, balanced test, removed train, removed test).

    method: random, tomek, enn or hybrid; nulls in features make it random. After tomek and hybrid, all positives that
    were removed from training move to the test side before that is balanced.
    """
    from certus.operators.neighbors import clean

    counts = class_counts(df, target)
    check_size(counts, least)
    balance_plan(counts, train_ratio)
    parted = staged(split(df.filter(F.col(target).isNotNull()), key, target, share, seed), "split")
    train, test = parted.filter("NOT is_test").drop("is_test"), parted.filter("is_test").drop("is_test")
    marked_train = staged(clean(train, key, target, features, method, train_ratio, seed), "balanced-train")
    kept, removed = marked_train.filter("kept").drop("kept"), marked_train.filter("NOT kept").drop("kept")
    if method in ("tomek", "hybrid"):
        test = test.unionByName(removed.filter(F.col(target) == 1))
        removed = removed.filter(F.col(target) != 1)
    marked_test = staged(clean(test, key, target, features, method, test_ratio, seed), "balanced-test")
    return kept, marked_test.filter("kept").drop("kept"), removed, marked_test.filter("NOT kept").drop("kept")
