"""Repeated rows: work that pairs texts must meet each row of an id and text once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from certus.plans.staging import staged


def each_once(texts: DataFrame, keys: tuple[str, ...] = ("doc_id", "text_hash")) -> DataFrame:
    """``texts``, repeated rows once. Equal rows must have equal keys; rows with a null key go.

    Only the keys are grouped; just the texts of rows that really stand there several times are compared, and are
    combined within tasks before they are shuffled.
    """
    known = texts.dropna(subset=list(keys))
    repeated = staged(known.groupBy(*keys).count().filter("count > 1").select(*keys), "repeated-rows")
    if not repeated.limit(1).count():
        return known
    return known.join(repeated, list(keys), "left_anti").unionByName(known.join(repeated, list(keys), "left_semi").distinct())
