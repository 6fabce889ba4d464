"""Run history, accounting in the job that writes, and concepts in a table."""

import pytest
from pyspark.sql import functions as F

from certus.operators import preprocess
from certus.sources.history import RunHistory
from certus.sources.sinks import load_or_make


def test_only_complete_runs_are_seen(spark, tmp_path):
    history = RunHistory(spark, f"file://{tmp_path}/h")
    assert history.runs().count() == 0
    with pytest.raises(ValueError):
        history.table("scores")
    one = spark.createDataFrame([(1, 0.5)], "a int, b double")
    assert history.append("first", {"scores": one, "other": one})
    assert history.append("second", {"scores": one.withColumn("c", F.lit("x"))}, note="wider")
    assert not history.append("first", {"scores": one.withColumn("a", F.lit(9))})
    with pytest.raises(Exception, match="on purpose"):
        history.append("third", {"scores": one, "zz": one.select(F.raise_error("on purpose").alias("a"))})
    rows = {(r["run_id"], r["a"], r["c"]) for r in history.table("scores").collect()}
    assert rows == {("first", 1, None), ("second", 1, "x")} and history.table("other").count() == 1
    assert {(r["run_id"], r["note"]) for r in history.runs().collect()} == {("first", ""), ("second", "wider")}
    with pytest.raises(ValueError):
        history.append("a/b", {"scores": one})


def test_a_table_without_its_mark_is_made_again(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    make = lambda v: lambda: spark.createDataFrame([("c", v)], "concept string, v int")
    assert load_or_make(spark, path, make(1)).first()["v"] == 1
    assert load_or_make(spark, path, make(2)).first()["v"] == 1
    (tmp_path / "t" / "_SUCCESS").unlink()
    assert load_or_make(spark, path, make(3)).first()["v"] == 3


def test_totals_come_from_the_job_that_writes(spark, tmp_path):
    df = spark.range(10).select("id")
    found = preprocess.write_with_totals(df, f"file://{tmp_path}/out", lambda d: d.filter("id % 3 = 0"))
    assert {tuple(r) for r in found.collect()} == {("input records", 10), ("output samples", 4)}
    empty = preprocess.write_with_totals(df.limit(0), f"file://{tmp_path}/none", lambda d: d)
    assert {r["n"] for r in empty.collect()} == {0}


@pytest.mark.parametrize("most_broadcast", [0, 100])
def test_concepts_in_a_table(spark, most_broadcast):
    entries = '[{"question":" Q2 ","answer":"yes"},{"question":"q1","answer":"no"},{"question":null,"answer":"no"}]'
    records = spark.createDataFrame([("a", entries), ("b", "junk"), ("c", '[{"question":"q3","answer":"?"}]'), ("0", entries), (None, entries), ("d", None)], "content_id string, logprobs_data string")
    questions = spark.createDataFrame([("A", "q1"), ("A", "Q2"), ("A", "q2 "), ("B", "q1"), ("C", "q3"), (None, "q1"), ("D", None)], "concept string, question string")
    truths = spark.createDataFrame([("a", "A", 1), ("a", "B", 1), ("a", "C", 0), ("b", "A", 1), ("c", "C", 1), ("c", "A", None), ("zz", "A", 1), ("0", "A", 1), ("d", "B", 0)], "content_id string, concept string, ground_truth int")
    rows = preprocess.concept_rows_by_table(records, truths, questions, most_broadcast)
    got = {(r["content_id"], r["concept"]): (r["llm_prediction"], r["skip_reason"]) for r in rows.collect()}
    assert got == {("a", "A"): ("YES", None), ("a", "B"): ("NO", None), ("a", "C"): (None, "no question"), ("b", "A"): (None, "no question"), ("c", "C"): ("?", "bad answer"), ("c", "A"): (None, "missing ground truth"), ("d", "B"): (None, "no question")}
