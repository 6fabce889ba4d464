"""From content records to labelled samples: one for each concept with a question, a valid answer and ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from certus.functions.text import parse_entries, strip
from certus.schema import CONCEPTS


def concept_rows(records: DataFrame, concepts: dict[str, tuple[str, list[str]]] = CONCEPTS) -> DataFrame:
    """A row for each record with an id and each concept, with ``skip_reason`` (null: a sample).

    Of a record's entries the first that asks one of the concept's questions counts. logprobs_data may be JSON or typed.
    """
    typed = dict(records.dtypes)["logprobs_data"] != "string"
    entries = F.col("logprobs_data") if typed else parse_entries(F.col("logprobs_data"))
    known = records.filter("content_id IS NOT NULL AND content_id NOT IN ('', '0')").withColumn("entries", entries)
    asked = lambda questions: F.get(F.filter("entries", lambda e: F.lower(strip(e["question"])).isin(*questions)), F.lit(0))
    options = F.array(*(F.struct(F.lit(c).alias("concept"), F.col(f"`{label}`").cast("int").alias("ground_truth"), asked(q).alias("entry")) for c, (label, q) in concepts.items()))
    keep = [F.col(c) for c in ("title", "transcript") if c in records.columns]
    rows = known.select("content_id", *keep, F.explode(options).alias("o")).select("content_id", *keep, "o.*")
    answer = F.upper(strip(F.col("entry.answer")))
    reason = F.when(F.col("ground_truth").isNull(), "missing ground truth").when(F.col("entry").isNull(), "no question").when(~F.coalesce(answer.isin("YES", "NO"), F.lit(False)), "bad answer")
    return rows.withColumns({"llm_prediction": answer, "skip_reason": reason})


def correctness(ground_truth: Column, prediction: Column) -> Column:
    """1 if the answer agrees with a ground truth of 0 or 1; any other ground truth is never met."""
    return F.when(((ground_truth == 1) & (prediction == "YES")) | ((ground_truth == 0) & (prediction == "NO")), 1).otherwise(0)


def samples(rows: DataFrame) -> DataFrame:
    """Labelled samples of ``concept_rows``, each with its key and entry in one row."""
    keep = [c for c in ("title", "transcript") if c in rows.columns]
    return rows.filter("skip_reason IS NULL").select(
        F.concat_ws("_", "content_id", "concept").alias("content_concept_id"),
        "content_id",
        "concept",
        *keep,
        "ground_truth",
        "llm_prediction",
        correctness(F.col("ground_truth"), F.col("llm_prediction")).alias("is_correct"),
        F.col("entry.question").alias("question_used"),
        F.array("entry").alias("logprobs_data"),
    )


def skip_report(rows: DataFrame) -> DataFrame:
    """Rows of each concept by reason; ``kept`` for samples."""
    return rows.groupBy("concept", F.coalesce("skip_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def label_distribution(df: DataFrame) -> DataFrame:
    right = F.sum("is_correct").cast("bigint")
    n = F.count("*")
    return df.agg(n.alias("n"), right.alias("n_correct"), F.try_divide(100.0 * right, n).alias("pct_correct"), F.try_divide(100.0 * (n - right), n).alias("pct_incorrect"))


def concept_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("concept").agg(F.count("*").alias("n"), F.sum("is_correct").alias("n_correct"), F.sum((F.col("ground_truth") == 1).cast("int")).alias("n_positive"))


def question_usage(df: DataFrame, preview: int = 80) -> DataFrame:
    """How often each question was used, with its first characters."""
    q = F.col("question_used")
    shown = F.when(F.char_length(q) > preview, F.concat(F.substring(q, 1, preview), F.lit("..."))).otherwise(q)
    return df.groupBy("concept", "question_used").agg(F.count("*").alias("n")).withColumn("preview", shown)


def prediction_rates(df: DataFrame) -> DataFrame:
    return df.agg((100 * F.avg((F.col("ground_truth") == 1).cast("double"))).alias("pct_ground_truth_positive"), (100 * F.avg((F.col("llm_prediction") == "YES").cast("double"))).alias("pct_yes"))


def write_with_totals(records: DataFrame, path: str, make=lambda records: samples(concept_rows(records))) -> DataFrame:
    """Write what ``make`` gives for the records, and (what, n) of input records and output samples.

    Both are counted by the job that writes, so the records are read once.
    """
    read, made = Observation("input records"), Observation("output samples")
    out = make(records.observe(read, F.count(F.lit(1)).alias("n"))).observe(made, F.count(F.lit(1)).alias("n"))
    out.write.mode("overwrite").parquet(path)
    rows = [(what, seen.get["n"]) for what, seen in (("input records", read), ("output samples", made))]
    return records.sparkSession.createDataFrame(rows, "what string, n bigint")


def concept_rows_by_table(records: DataFrame, truths: DataFrame, questions: DataFrame, most_broadcast: int = 1_000_000) -> DataFrame:
    """``concept_rows`` for any number of concepts: a row for each truth (content_id, concept, ground_truth).

    questions: (concept, question), several of a concept, compared without case and outer white space; one that several
    concepts have counts for each. Of a record's entries the first that asks one of the concept's questions counts. The
    questions are broadcast if they are ``most_broadcast`` rows at most, else joined by a shuffle; results are equal.
    Truths without a record, null or '' or '0' ids: no row. Repeated records of an id: the first entry of any of them, by
    its place and then its text.
    """
    norm = lambda c: F.lower(strip(c))
    wanted = questions.select("concept", norm(F.col("question")).alias("asked")).filter("concept IS NOT NULL AND asked IS NOT NULL").distinct()
    typed = dict(records.dtypes)["logprobs_data"] != "string"
    known = records.filter("content_id IS NOT NULL AND content_id NOT IN ('', '0')")
    entries = F.col("logprobs_data") if typed else parse_entries(F.col("logprobs_data"))
    asked = known.select("content_id", F.posexplode(entries).alias("place", "entry")).withColumn("asked", norm(F.col("entry.question"))).filter("asked IS NOT NULL")
    small = wanted.limit(most_broadcast + 1).count() <= most_broadcast
    found = asked.join(F.broadcast(wanted) if small else wanted, "asked")
    first = found.groupBy("content_id", "concept").agg(F.min_by("entry", F.struct("place", F.to_json("entry"))).alias("entry"))
    ids = known.select("content_id").distinct()
    rows = truths.select("content_id", "concept", F.col("ground_truth").cast("int").alias("ground_truth")).join(ids, "content_id", "left_semi").join(first, ["content_id", "concept"], "left")
    answer = F.upper(strip(F.col("entry.answer")))
    reason = F.when(F.col("ground_truth").isNull(), "missing ground truth").when(F.col("entry").isNull(), "no question").when(~F.coalesce(answer.isin("YES", "NO"), F.lit(False)), "bad answer")
    return rows.withColumns({"llm_prediction": answer, "skip_reason": reason})
