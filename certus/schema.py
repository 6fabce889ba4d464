"""Schemas of answer records: nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

TOKEN = T.StructType([T.StructField("token", T.StringType()), T.StructField("logprob", T.DoubleType()), T.StructField("linear_prob", T.DoubleType())])
TOKENS = T.ArrayType(TOKEN)
ENTRY = T.StructType([T.StructField("question", T.StringType()), T.StructField("answer", T.StringType()), T.StructField("top_logprobs", TOKENS), T.StructField("error", T.StringType())])
ENTRIES = T.ArrayType(ENTRY)

#: Concept, column of its ground truth, and its question variants, lower-cased ("foradult" is in the data).
CONCEPTS: dict[str, tuple[str, list[str]]] = {
    "ADULT": ("ADULT_thumbnail+text", ["contain list of questions involve or intended foradult content", "contain question involve or intended for adult content"]),
    "KIDS": ("KIDS_thumbnail+text", ["contain list of questions involve or intended for content aimed at kids", "contain question involve or intended for content aimed at kids"]),
    "DIMC": ("DIMC_thumbnail+text", ["contain list of questions involve or intended for dimc"]),
    "DAT": ("DAT_thumbnail+text", ["contain list of questions involve or intended for dat"]),
}

#: A raw training record; logprobs_data stays text until it is parsed tolerantly.
RECORD = T.StructType(
    [T.StructField("content_id", T.StringType())]
    + [T.StructField(column, T.IntegerType()) for column, _ in CONCEPTS.values()]
    + [T.StructField(c, T.StringType()) for c in ("logprobs_data", "title", "transcript", "error")]
)

#: A record to score: the tokens directly, or inside the first entry.
SCORING_RECORD = T.StructType([T.StructField("content_id", T.StringType()), T.StructField("top_logprobs", T.StringType()), T.StructField("logprobs_data", T.StringType())])
