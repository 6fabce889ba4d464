"""Monotone fits by pooling adjacent violators: lists of blocks of score ranges, merged level by level."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certus.plans.staging import staged

_BLOCKS = "fold int, low double, high double, total double, n bigint"
#: Lists of blocks that one task of the next level merges.
MERGED = 16


def _numbers(values: tuple[float, ...]) -> Column:
    """An array of constants; as text it is one expression, which the optimizer folds."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


@dataclass(frozen=True)
class Steps:
    """A monotone function through points with ascending ``x``: straight between them, constant beyond the ends."""

    x: tuple[float, ...]
    p: tuple[float, ...]

    def value(self, score: Column) -> Column:
        """The function as a column, by binary search in built-in expressions; null for null and NaN."""
        n = len(self.x)
        if not n:
            return F.lit(None).cast("double")
        x, p = _numbers(self.x), _numbers(self.p)
        jumps = F.array(*(F.lit(1 << b) for b in reversed(range(n.bit_length()))))
        start = F.struct(score.alias("s"), F.lit(0).alias("at"))

        def jump(found: Column, by: Column) -> Column:
            there = found["at"] + by
            fits = (there <= n) & (F.get(x, there - 1) <= found["s"])
            return F.struct(found["s"].alias("s"), F.when(fits, there).otherwise(found["at"]).alias("at"))

        def between(found: Column) -> Column:
            at, s = found["at"], found["s"]
            x0, x1, p0, p1 = F.get(x, at - 1), F.get(x, at), F.get(p, at - 1), F.get(p, at)
            inside = F.when(at == 0, F.lit(self.p[0])).when(at == n, F.lit(self.p[-1])).otherwise(p0 + (p1 - p0) * (s - x0) / (x1 - x0))
            return F.when(s.isNotNull() & ~F.isnan(s), inside)

        return F.aggregate(jumps, start, jump, between)


def pooled(fold: np.ndarray, low: np.ndarray, high: np.ndarray, total: np.ndarray, n: np.ndarray) -> list[tuple]:
    """Blocks (fold, low, high, total, n) with rising means, from blocks in the order of fold and score.

    Pooling the pooled lists of two neighbouring ranges gives what pooling the whole range gives.
    """
    out: list[tuple] = []
    for block in zip(fold.tolist(), low.tolist(), high.tolist(), total.tolist(), n.tolist()):
        f, lo, hi, t, m = block
        while out and out[-1][0] == f and out[-1][3] * m >= t * out[-1][4]:
            _, lo, _, t0, m0 = out.pop()
            t, m = t + t0, m + m0
        out.append((f, lo, hi, t, m))
    return out


def _pool_ranges(blocks: DataFrame, parts: int) -> DataFrame:
    """``blocks`` pooled inside each of ``parts`` ranges of (fold, low)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        for b in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if kept:
                columns = [np.concatenate([np.array(a), c]) for a, c in zip(zip(*kept), columns)]
            kept = pooled(*columns)
        types = [pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
        columns = zip(*kept) if kept else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["fold", "low", "high", "total", "n"])

    return blocks.repartitionByRange(parts, "fold", "low").sortWithinPartitions("fold", "low").mapInArrow(run, _BLOCKS)


def fit_steps(df: DataFrame, score: Column, target: Column, k: int = 1, fold: Column | None = None) -> list[Steps]:
    """The monotone fit of each fold 0..k-1 (without ``fold``: of all rows), over rows with a score and a target.

    Equal scores meet first. Ranges are pooled in parallel and their lists merged ``MERGED`` at a time; a fold without
    rows has no points. With targets 0 and 1 the blocks of n rows have different means, fractions whose denominators add
    up to n at most, so there are fewer than n ** (2/3) of them in the last task and on the driver.
    """
    rows = df.select((F.lit(0) if fold is None else fold.cast("int")).alias("fold"), score.cast("double").alias("low"), target.cast("double").alias("y"))
    rows = rows.filter("fold IS NOT NULL AND low IS NOT NULL AND NOT isnan(low) AND y IS NOT NULL")
    blocks = staged(rows.groupBy("fold", "low").agg(F.col("low").alias("high"), F.sum("y").alias("total"), F.count("*").alias("n")).select("fold", "low", "high", "total", "n"), "scores")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while parts > 1:
        blocks = staged(_pool_ranges(blocks, parts), "blocks")
        parts = -(-parts // MERGED)
    found = _pool_ranges(blocks, 1).collect()
    out = []
    for f in range(k):
        x, p = [], []
        for b in sorted((b for b in found if b["fold"] == f), key=lambda b: b["low"]):
            for at in dict.fromkeys((b["low"], b["high"])):
                x.append(at)
                p.append(b["total"] / b["n"])
        out.append(Steps(tuple(x), tuple(p)))
    return out
