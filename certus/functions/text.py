"""Small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certus.schema import ENTRIES, TOKENS


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are made by a generator of one row.

    The optimizer copies a projection's expressions into every filter above it, and those of the projections below into
    them; a generator stops that, so costly columns that several others need are computed once for a row.
    """
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; SQL's trim takes blanks only."""
    return F.btrim(c, F.lit(" \t\n\r\f\u000b"))


def finite(c: Column) -> Column:
    """Null for NaN and infinities: Spark orders NaN above all numbers."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def clipped(c: Column, most: float = 1e10) -> Column:
    """Finite values cut to -most..most; null stays null."""
    value = F.when(F.isnan(c), None).otherwise(c)
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(most)), F.lit(-most)))


def parse_tokens(text: Column) -> Column:
    """array of tokens from JSON; an unparsable text or another type gives an empty array.

    Elements are parsed one by one, so that an ill-typed one is left out alone.
    """
    parts = F.from_json(text, "array<string>")
    parsed = F.transform(parts, lambda p: F.from_json(p, "token string, logprob double, linear_prob double"))
    return F.coalesce(F.filter(parsed, lambda t: t.isNotNull() & (t["token"].isNotNull() | t["logprob"].isNotNull())), F.array().cast(TOKENS))


def parse_entries(text: Column) -> Column:
    """array of question-answer entries from JSON, element by element; unparsable: empty."""
    parts = F.from_json(text, "array<string>")
    parsed = F.transform(parts, lambda p: F.from_json(p, ENTRIES.elementType))
    return F.coalesce(F.filter(parsed, lambda e: e.isNotNull()), F.array().cast(ENTRIES))


def parse_number_list(text: Column) -> Column:
    """array<double> of a comma-separated text, brackets allowed; null, '', 'None' or any bad number: empty."""
    inner = F.btrim(strip(text), F.lit("[]"))
    numbers = F.transform(F.split(inner, ","), lambda x: strip(x).try_cast("double"))
    bad = strip(text).isNull() | strip(text).isin("", "None", "[]") | F.exists(numbers, lambda x: x.isNull())
    return F.when(bad, F.array().cast("array<double>")).otherwise(numbers)
