"""Worked values and edge cases of the features, readers and checks."""

import json
import math

import pytest
from pyspark.sql import functions as F

from certus.functions.text import parse_number_list
from certus.functions.uncertainty import FEATURES, softmax, with_entry_features, with_features
from certus.operators import preprocess, validate
from certus.schema import RECORD
from certus.sources import records, sinks

README_TOKENS = [("NO", -0.105, 0.9), ("YES", -2.303, 0.1), ("Maybe", -4.605, 0.01)]
SCHEMA = "id int, top_logprobs array<struct<token:string,logprob:double,linear_prob:double>>"


def featured(spark, cases):
    rows = with_features(spark.createDataFrame(list(enumerate(cases)), SCHEMA)).collect()
    return [r.asDict() for r in sorted(rows, key=lambda r: r["id"])]


def test_worked_values(spark):
    (f,) = featured(spark, [README_TOKENS])
    want = {
        "model_outcome_entropy_top_5": 0.544262, "model_outcome_normalized_entropy_top_5": 0.343391, "model_effective_choices_top_5": 1.458274,
        "model_confidence_score_top_5": 0.656609, "model_max_softmax_prob": 0.891159, "model_p1_p2_gap": 0.792218, "model_p1_p2_gap_normalized": 0.888975,
        "model_confidence_ratio": 9.006982, "model_logprob_gap": -2.198, "model_logprob_gap_normalized": 0.954407, "model_outcome_entropy_filtered": 0.468774,
        "model_effective_choices_filtered": 1.383933, "model_confidence_score_filtered": 0.531226, "model_p1_p2_gap_filtered": 0.800140,
    }
    assert {k: round(f[k], 6) for k in want} == want
    assert f["model_max_softmax_prob_filtered"] is None
    assert set(FEATURES) <= set(f)


def test_degenerate_arrays(spark):
    empty, one, others, padded, rising, zero, missing, none, null = featured(
        spark,
        [[], [("YES", -0.1, None)], [("a", -0.1, None), ("b", -1.0, None)], [(" yes ", -0.1, None), ("No\n", -1.0, None)], [("NO", -3.0, None), ("YES", -0.1, None)], [("NO", -1.0, None), ("YES", 0.0, None)], [("NO", -1.0, None), ("YES", None, None)], [("NO", None, None), ("YES", None, None)], None],
    )
    for f in (empty, one):
        assert (f["model_outcome_entropy_top_5"], f["model_confidence_score_top_5"], f["model_max_softmax_prob"], f["model_logprob_gap_normalized"]) == (0.0, 1.0, 1.0, 1.0)
    assert others["model_outcome_entropy_filtered"] == 0.0 and others["model_outcome_entropy_top_5"] > 0 and others["model_max_softmax_prob_filtered"] == 1.0
    assert padded["model_outcome_entropy_filtered"] > 0
    assert rising["model_p1_p2_gap"] < 0 and rising["model_max_softmax_prob"] < 0.1
    assert zero["model_logprob_gap_normalized"] == 1.0
    assert missing["model_p1_p2_gap"] == 1.0 and missing["model_logprob_gap"] == 0.0
    assert none["model_outcome_entropy_top_5"] is None and none["model_logprob_gap"] == 0.0
    assert null["model_outcome_entropy_top_5"] == 0.0 and null["model_outcome_entropy_filtered"] is None


def test_entry_features_are_null_without_entry(spark):
    df = spark.createDataFrame([(1, []), (2, [("q", "YES", [("YES", -0.1, None), ("NO", -2.0, None)], None)])], "id int, logprobs_data array<struct<question:string,answer:string,top_logprobs:array<struct<token:string,logprob:double,linear_prob:double>>,error:string>>")
    a, b = with_entry_features(df).orderBy("id").collect()
    assert a["model_max_softmax_prob"] is None and b["model_max_softmax_prob"] > 0.8


def test_number_list(spark):
    df = spark.createDataFrame([("-0.1, -2",), ("[1,2]",), ("None",), ("",), (None,), ("1,x",)], "t string")
    assert [r[0] for r in df.select(parse_number_list(F.col("t"))).collect()] == [[-0.1, -2.0], [1.0, 2.0], [], [], [], []]


def record(i, question, answer, truth, tokens=README_TOKENS, **more):
    entry = {"question": question, "answer": answer, "top_logprobs": [{"token": t, "logprob": p} for t, p, _ in tokens], "error": None}
    return json.dumps({"content_id": i, "DAT_thumbnail+text": truth, "logprobs_data": json.dumps([{"question": 3}, entry, dict(entry, answer="YES")])} | more)


def test_lines_to_samples(spark, tmp_path):
    q = " Contain LIST of questions involve or intended for DAT\t"
    lines = [record("a", q, " no ", 0) + ",", record("b", q, "Maybe", 1), record("c", q, "NO", 2) + " , ", record("", q, "NO", 0), record("d", q, "NO", None), record("e", "other", "NO", 1), "", "{broken", record("f", q, None, 1)]
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join(lines))
    good, bad = records.parse_lines(spark.read.text(str(path)), RECORD)
    assert bad.count() == 2
    rows = preprocess.concept_rows(good)
    made = {r["content_concept_id"]: r["is_correct"] for r in preprocess.samples(rows).collect()}
    assert made == {"a_DAT": 1, "c_DAT": 0}
    reasons = {(r["concept"], r["reason"]): r["n"] for r in preprocess.skip_report(rows).collect()}
    assert reasons["DAT", "bad answer"] == 2 and reasons["DAT", "no question"] == 1 and reasons["DAT", "missing ground truth"] == 1


def test_scoring_inputs(spark, tmp_path):
    tokens = [{"token": "NO", "logprob": -0.1}, {"token": "YES", "logprob": -2.0}, {"x": 1}]
    objects = [{"content_id": 1, "top_logprobs": tokens}, {"content_id": "2", "logprobs_data": [{"top_logprobs": tokens}]}, {"content_id": "3", "top_logprobs": json.dumps(tokens)}, {"top_logprobs": tokens}, {"content_id": "5", "top_logprobs": [{"token": "a"}]}, {"content_id": "6"}]
    (tmp_path / "in.JSONL").write_text("\n".join([*map(json.dumps, objects), "", "[1]", "{"]))
    (tmp_path / "in.json").write_text(json.dumps([*objects, 7]))
    (tmp_path / "in.csv").write_text('content_id,top_logprobs\n1,"' + json.dumps(tokens).replace('"', '""') + '"\n2,oops\n')
    for name in ("in.JSONL", "in.json"):
        valid, rejected = validate.prepare(records.read_records(spark, str(tmp_path / name)))
        assert sorted(r["content_id"] for r in valid.collect()) == ["1", "2"], name
        reasons = {(r["content_id"], r["reason"]) for r in rejected.collect()}
        assert (None, "missing content_id") in reasons and ("3", "missing/empty top_logprobs") in reasons and ("5", "top_logprobs items missing required keys") in reasons
    valid, rejected = validate.prepare(records.read_records(spark, str(tmp_path / "in.csv")))
    assert [r["content_id"] for r in valid.collect()] == ["1"] and rejected.count() == 1
    with pytest.raises(ValueError):
        records.read_records(spark, "x.txt")
    with pytest.raises(ValueError):
        sinks.write_predictions(valid, str(tmp_path / "o"), "xml")


def test_metadata_round_trip(spark, tmp_path):
    assert sinks.load_metadata(spark, str(tmp_path / "none")) == {"selected_features": [], "optimal_threshold": 0.5}
    sinks.save_metadata(spark, str(tmp_path / "m"), optimal_threshold=0.41, selected_features=["a"])
    assert sinks.load_metadata(spark, str(tmp_path / "m"))["optimal_threshold"] == 0.41


def test_probabilities_sum_to_one(spark):
    from certus.functions.uncertainty import softmax

    df = spark.createDataFrame([(1, README_TOKENS)], SCHEMA)
    assert math.isclose(sum(df.select(softmax(F.col("top_logprobs"))).first()[0]), 1.0)


def test_softmax_takes_its_largest_value_once(spark):
    assert softmax(F.col("t"))._jc.toString().count("array_max") == 1
