"""From raw documents to token ids: quality rules, near-dedup, substring dedup, mixing, byte-level BPE.

Every stage takes the documents that the one before it left and, but for the last, returns the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certus.llm import bpe, mixing, near_dup, quality_rules, substring_dedup
from certus.plans.staging import staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and the learned rules. Null texts fail the base test; rows without id are judged
    like others."""
    rules = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.judge(docs, rules).filter("__quality_kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five words, similarity 0.8).

    Of repeated rows of an id and text the first by their other columns stays; an id's different texts are one document,
    which stays or goes as a whole. Rows without id stay.
    """
    kept = near_dup.near_duplicates(docs, size=5, percent=80).filter("doc_id = component_id").select("doc_id").distinct()
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    chosen = docs.join(kept, "doc_id", "left_semi")
    rest = F.struct(*others) if others else F.struct(F.lit(0))
    once = chosen.groupBy("doc_id", "text").agg(F.min_by(rest, F.to_json(rest)).alias("__rest"))
    once = once.select(*(F.col(c) if c in ("doc_id", "text") else F.col("__rest")[c].alias(c) for c in docs.columns))
    return once.unionByName(docs.filter("doc_id IS NULL"))


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-word windows that an earlier one has; those with no word left go."""
    cut = substring_dedup.remove_repeats(docs, size=50).filter("__dedup_n_removed = 0 OR __dedup_n_removed < __dedup_n_words")
    text = F.when(F.col("__dedup_n_removed") > 0, F.col("__dedup_kept")).otherwise(F.col("text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix of sources takes: a row for each document and pass. Null texts have no words and are never taken."""
    taken = mixing.taken_texts(docs, mixing.mix_sources(docs))
    return taken.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, round_trip): round_trip says that the ids decode to the text again."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    done = bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, keep=["source", "text"])
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return done.select("doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring),
    ("mixing sources to target weights", mix),
    ("byte-level BPE", tokens),
]

#: Learned rules, signatures and draws aren't expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents. Each stage's result is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = staged(docs, f"stage{number}")
    return docs
