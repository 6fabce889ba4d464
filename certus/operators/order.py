"""Exact order statistics in bounded memory: ranks are bracketed by sketches, round by round."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certus.plans.staging import staged

#: Values of a bracket that are sorted in the end, for each rank.
KEPT = 1_000
#: Accuracy of the sketches: a bracket keeps about six of so many rows.
ACCURACY = 1_000


@dataclass
class _Rank:
    """The value of rank ``at`` (from 0) of a column is ``value`` or lies strictly between ``low`` and ``high``, with
    ``below`` values up to ``low`` and ``inside`` ones between."""

    column: str
    at: int
    low: float
    high: float
    below: int
    inside: int
    value: float | None = None

    def between(self) -> Column:
        x = F.col(self.column)
        return (x > F.lit(self.low)) & (x < F.lit(self.high))


def _settle(rank: _Rank, low: float, high: float, under: int, at_low: int, upto: int, at_high: int) -> None:
    """Take over a bracket low..high, of which ``under`` values are below it and ``upto`` not above it. An end that the
    sketch has misplaced is left where it was."""
    if rank.at >= under:
        if rank.at < under + at_low:
            rank.value = low
            return
        rank.inside -= under + at_low - rank.below
        rank.low, rank.below = low, under + at_low
    if rank.at < upto:
        if rank.at >= upto - at_high:
            rank.value = high
            return
        rank.high, rank.inside = high, upto - at_high - rank.below


def order_statistics(df: DataFrame, ranks: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """The values of the given ranks (from 0, among the values that aren't null) of double columns; NaN is the largest.

    A round is two aggregations for all columns: sketches propose two values around each rank, counts make them a
    bracket, and the next round looks between them only. Values that hold many rows are found as ends of brackets. At most
    ``KEPT`` values for each rank are sorted at the end. The columns are staged, as each round reads them; the number of rounds grows as the logarithm of the rows.
    """
    columns = list(ranks)
    if not any(ranks.values()):
        return {}
    x = staged(df.select(*(F.col(c).cast("double").alias(c) for c in columns)), "columns")
    ends = x.agg(*(f(c).alias(f"{c}__{n}") for c in columns for n, f in (("low", F.min), ("high", F.max)))).first()
    counts = x.agg(*(e.alias(f"{c}__{n}") for c in columns for n, e in (("n", F.count(c)), ("low", F.count_if(F.col(c) == F.lit(ends[f"{c}__low"]))), ("high", F.count_if(F.col(c) == F.lit(ends[f"{c}__high"])))))).first()
    known: list[_Rank] = []
    for c in columns:
        low, high, n = ends[f"{c}__low"], ends[f"{c}__high"], counts[f"{c}__n"]
        for at in sorted(set(ranks[c])):
            if not 0 <= at < n:
                raise ValueError(f"no rank {at} among {n} values of {c}")
            rank = _Rank(c, at, low, high, 0, n)
            _settle(rank, low, high, 0, counts[f"{c}__low"], n, counts[f"{c}__high"])
            known.append(rank)
    while wide := [r for r in known if r.value is None and r.inside > KEPT]:
        proposed = []
        for i, r in enumerate(wide):
            share, slack = (r.at - r.below + 0.5) / r.inside, 2.0 / ACCURACY
            both = F.array(F.lit(max(0.0, share - slack)), F.lit(min(1.0, share + slack)))
            proposed.append(F.percentile_approx(F.when(r.between(), F.col(r.column)), both, ACCURACY).alias(f"r{i}"))
        ends = x.agg(*proposed).first()
        counted = []
        for i, r in enumerate(wide):
            v, (low, high) = F.col(r.column), ends[f"r{i}"]
            tests = {"under": v < F.lit(low), "low": v == F.lit(low), "upto": v <= F.lit(high), "high": v == F.lit(high)}
            counted += [F.count_if(t).alias(f"{n}{i}") for n, t in tests.items()]
        found = x.agg(*counted).first()
        for i, r in enumerate(wide):
            before = (r.low, r.high)
            _settle(r, *ends[f"r{i}"], *(found[f"{n}{i}"] for n in ("under", "low", "upto", "high")))
            if r.value is None and (r.low, r.high) == before:
                raise RuntimeError("a bracket didn't shrink")
    few = [r for r in known if r.value is None]
    if few:
        lists = x.agg(*(F.get(F.sort_array(F.collect_list(F.when(r.between(), F.col(r.column)))), F.lit(r.at - r.below)).alias(f"r{i}") for i, r in enumerate(few))).first()
        for i, r in enumerate(few):
            r.value = lists[f"r{i}"]
    return {(r.column, r.at): r.value for r in known}


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of each column, straight between the two values around; None for a column without values."""
    n = df.agg(*(F.count(c).alias(c) for c in columns)).first()
    place = {c: [(n[c] - 1) * s for s in shares] for c in columns if n[c]}
    found = order_statistics(df, {c: [r for p in at for r in (math.floor(p), math.ceil(p))] for c, at in place.items()})
    out: dict[str, list[float | None]] = {}
    for c in columns:
        out[c] = [None] * len(shares)
        for i, p in enumerate(place.get(c, [])):
            a, b = found[c, math.floor(p)], found[c, math.ceil(p)]
            out[c][i] = a if a == b else a + (b - a) * (p - math.floor(p))
    return out
