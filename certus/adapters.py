"""Answer logs derived from the test tables: no table holds log probabilities, so they follow from hashes of a key.

The expressions are the same text for Spark and for the comparison SQL, but for the hash to a number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certus.schema import TOKENS

_STEPS: list[dict[str, str]] = [
    {"lp1": "-0.0001e0-0.7e0*u1*u1", "lp2": "-0.75e0-8e0*(1e0-u1)*u2", "answer": "case when u4 < 0.6e0 then 'YES' else 'NO' end", "is_correct": "case when u3 < 0.55e0+0.4e0*(1e0-u1) then 1 else 0 end"},
    {"lp3": "lp2-0.5e0-2e0*u5", "n_tokens": "case when u5 < 0.5e0 then 3 when u5 > 0.99e0 then 0 when u5 > 0.97e0 then 1 else 2 end", "swapped": "case when u5 > 0.9e0 and u5 < 0.95e0 then 1 else 0 end", "other": "case when answer = 'YES' then 'NO' else 'YES' end"},
    {"ground_truth": "case when (is_correct = 1) = (answer = 'YES') then 1 else 0 end", "a1": "case when swapped = 1 then lp2 else lp1 end", "a2": "case when swapped = 1 then lp1 else lp2 end", "p": "round(0.2e0+0.6e0*(1e0-u1)+0.2e0*u2, 3)"},
]
_CONCEPT = "case event_type when 'click' then 'ADULT' when 'view' then 'KIDS' when 'purchase' then 'DIMC' else 'DAT' end"
TABLES = {"events": ("event_id", _CONCEPT), "customer": ("c_custkey", "case c_nationkey % 4 when 0 then 'ADULT' when 1 then 'KIDS' when 2 then 'DIMC' else 'DAT' end")}


def answer_log(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """(content_id, concept, answer, ground_truth, is_correct, p, top_logprobs, ...) with one row for each of the table."""
    key, concept = TABLES[table]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).alias("k"), F.expr(concept).alias("concept"))
    number = "cast(conv(substr(md5(concat('{}', cast(k as string))),1,8),16,10) as double)/4294967296e0"
    df = df.withColumns({f"u{i}": F.expr(number.format(c)) for i, c in enumerate("abcde", 1)})
    for step in _STEPS:
        df = df.withColumns({n: F.expr(e) for n, e in step.items()})
    token = lambda t, lp: F.struct(F.expr(t).alias("token"), F.col(lp).alias("logprob"), F.lit(None).cast("double").alias("linear_prob"))
    first, second = "case when swapped = 1 then other else answer end", "case when swapped = 1 then answer else other end"
    tokens = F.slice(F.array(token(first, "a1"), token(second, "a2"), token("'Maybe'", "lp3")), F.lit(1), F.col("n_tokens"))
    return df.withColumns({"content_id": F.col("k").cast("string"), "llm_prediction": F.col("answer"), "top_logprobs": tokens.cast(TOKENS)})


def answer_log_sql(table: str = "events") -> str:
    """A query for the comparison engine that gives the same numbers."""
    key, concept = TABLES[table]
    number = "cast(('0x'||substr(md5('{}'||k),1,8))::bigint as double)/4294967296e0"
    inner = f"select {key} as k, {concept} as concept from {table}"
    steps = [{f"u{i}": number.format(c) for i, c in enumerate("abcde", 1)}, *_STEPS]
    for step in steps:
        inner = f"select *, {', '.join(f'{e} as {n}' for n, e in step.items())} from ({inner})"
    return inner


def features_sql(table: str = "events") -> str:
    """The same with the features by their formulas: e.. weights, p.. probabilities; q.. over answers only."""
    softmax = f"select *, exp(a1-lp1) as e1, case when n_tokens >= 2 then exp(a2-lp1) else 0e0 end as e2, case when n_tokens = 3 then exp(lp3-lp1) else 0e0 end as e3, case when n_tokens = 1 then a1 else lp1 end as mx from ({answer_log_sql(table)})"
    probs = f"select *, case when n_tokens = 1 then 1e0 else e1/(e1+e2+e3) end as p1, e2/(e1+e2+e3) as p2, e3/(e1+e2+e3) as p3, e1/(e1+e2) as q1, e2/(e1+e2) as q2 from ({softmax})"
    ent = lambda *ps: "-(" + "+".join(f"(case when {x} > 0 then {x}*log2({x}) else 0e0 end)" for x in ps) + ")"
    few = lambda e, d: f"case when n_tokens < 2 then {d}e0 else {e} end"
    h, hq = ent("p1", "p2", "p3"), ent("q1", "q2")
    columns = {
        "model_outcome_entropy_top_5": few(h, 0),
        "model_outcome_normalized_entropy_top_5": few(f"({h})/log2(n_tokens)", 0),
        "model_effective_choices_top_5": few(f"pow(2e0,{h})", 0),
        "model_confidence_score_top_5": few(f"1e0-({h})/log2(n_tokens)", 1),
        "model_max_softmax_prob": few("p1", 1),
        "model_p1_p2_gap": few("p1-p2", 0),
        "model_p1_p2_gap_normalized": few("(p1-p2)/(p1+1e-12)", 0),
        "model_confidence_ratio": few("p1/(p2+1e-12)", 0),
        "model_logprob_gap": few("a2-a1", 0),
        "model_logprob_gap_normalized": few("(a2-a1)/a2", 1),
        "model_outcome_entropy_filtered": few(hq, 0),
        "model_outcome_normalized_entropy_filtered": few(hq, 0),
        "model_effective_choices_filtered": few(f"pow(2e0,{hq})", 0),
        "model_confidence_score_filtered": few(f"1e0-({hq})", 1),
        "model_max_softmax_prob_filtered": "case when n_tokens < 2 then 1e0 end",
        "model_p1_p2_gap_filtered": few("q1-q2", 0),
        "model_p1_p2_gap_normalized_filtered": few("(q1-q2)/(q1+1e-12)", 0),
        "model_confidence_ratio_filtered": few("q1/(q2+1e-12)", 0),
        "model_logprob_gap_filtered": few("a2-a1", 0),
        "model_logprob_gap_normalized_filtered": few("(a2-a1)/a2", 1),
    }
    return f"select *, {', '.join(f'{e} as {n}' for n, e in columns.items())} from ({probs})"
