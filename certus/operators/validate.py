"""Checking and normalising records before scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certus.functions.text import computed_once, parse_entries, parse_tokens
from certus.schema import TOKENS


def tokens_of(records: DataFrame, parse_strings: bool = False) -> Column:
    """The tokens of either shape: a list in top_logprobs wins, else that of the first entry; none: empty.

    From JSON lines both columns are text. A list that is itself a JSON string counts only with ``parse_strings``.
    """
    dtypes = dict(records.dtypes)
    out = []
    if "top_logprobs" in dtypes:
        c = F.col("top_logprobs")
        if dtypes["top_logprobs"] == "string":
            is_list = F.startswith(F.ltrim(c), F.lit("["))
            text = F.when(is_list, c) if not parse_strings else F.when(is_list, c).otherwise(F.get_json_object(F.concat(F.lit('{"t":'), c, F.lit("}")), "$.t"))
            c = F.when(text.isNotNull(), parse_tokens(text))
        out.append(c)
    if "logprobs_data" in dtypes:
        c = F.col("logprobs_data")
        out.append(F.get(parse_entries(c) if dtypes["logprobs_data"] == "string" else c, F.lit(0))["top_logprobs"])
    return F.coalesce(*out, F.array().cast(TOKENS))


def reject_reason(content_id: Column, tokens: Column) -> Column:
    """Why a record can't be scored; null if it can. Only its first two tokens need both keys."""
    lacks = F.exists(F.slice(tokens, 1, 2), lambda t: t["token"].isNull() | t["logprob"].isNull())
    return F.when(content_id.isNull() | (content_id == ""), "missing content_id").when(F.size(tokens) == 0, "missing/empty top_logprobs").when(lacks, "top_logprobs items missing required keys")


def checked(records: DataFrame, parse_strings: bool = False) -> DataFrame:
    """(content_id, top_logprobs, reason) of each record; reason: why it can't be scored, null if it can."""
    content_id = F.col("content_id").cast("string")
    # made once, as filters on the reason would copy the parsing
    parsed = computed_once(records.withColumn("__id", content_id), {"__tokens": tokens_of(records, parse_strings)})
    return parsed.select(F.col("__id").alias("content_id"), F.col("__tokens").alias("top_logprobs"), reject_reason(F.col("__id"), F.col("__tokens")).alias("reason"))


def prepare(records: DataFrame, max_records: int | None = None, parse_strings: bool = False) -> tuple[DataFrame, DataFrame]:
    """(content_id, top_logprobs) of the records that can be scored, and (content_id, reason) of the others.

    max_records: only so many, the first by content_id.
    """
    both = checked(records, parse_strings)
    valid = both.filter("reason IS NULL").drop("reason")
    if max_records is not None:
        valid = valid.orderBy("content_id").limit(max_records)
    return valid, both.filter("reason IS NOT NULL").select("content_id", "reason")


def aligned(df: DataFrame, required: list[str], keep: list[str] = ("content_id",)) -> DataFrame:
    """The required features in their order; those that are missing as 0.0."""
    return df.select(*keep, *(F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in required))
