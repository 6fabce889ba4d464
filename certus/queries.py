"""Registered queries over the test tables, each with comparison SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from certus.adapters import answer_log, answer_log_sql, features_sql
from certus.functions.text import clipped
from certus.functions.uncertainty import FEATURES, with_features
from certus.operators import boosting, information, isotonic, metrics, models, neighbors, preprocess, sampling, selection, stats, validate
from certus.plans import workloads
from certus.plans.staging import new_path, staged
from certus.schema import CONCEPTS, ENTRIES, TOKENS
from certus.sources.history import RunHistory
from certus.sources.records import read_json_lines, read_records
from certus.sources.sinks import load_metadata, load_or_make, save_metadata, write_predictions, write_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Features that the statistics run on, by short names.
SHORT = {"h": "model_outcome_entropy_top_5", "p1": "model_max_softmax_prob", "g": "model_p1_p2_gap", "lg": "model_logprob_gap", "lgn": "model_logprob_gap_normalized"}
MISS, REVIEW = 0.94, 0.64


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c: str | Column, name: str | None = None) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


def _log(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    return answer_log(spark, sf_dir, table)


def _features(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    return with_features(_log(spark, sf_dir, table))


def _short(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """The short features; null in one of seven rows for lg, so that missing values are met."""
    f = _features(spark, sf_dir, table)
    return f.select("k", "concept", F.col("is_correct").alias("y"), "p", *(F.when((F.lit(s) != "lg") | (F.col("k") % 7 != 0), F.col(c)).alias(s) for s, c in SHORT.items()))


def _short_sql(table: str = "events") -> str:
    return f"select k, concept, is_correct as y, p, {', '.join(f'case when k % 7 <> 0 then {c} end as {s}' if s == 'lg' else f'{c} as {s}' for s, c in SHORT.items())} from (select k, concept, is_correct, p, {', '.join(dict.fromkeys(SHORT.values()))} from ({features_sql(table)}))"


_A, _S = answer_log_sql(), _short_sql()


@query(f"select concept, count(*) as n, round(avg(is_correct::double), 6) as accuracy, round(avg(model_outcome_entropy_top_5), 6) as mean_entropy, round(avg(model_logprob_gap), 6) as mean_gap from ({features_sql()}) group by concept")
def uq_concept_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By concept: how uncertain is the model, and how often is it right?"""
    f = _features(spark, sf_dir)
    return f.groupBy("concept").agg(F.count("*").alias("n"), r6(F.avg("is_correct"), "accuracy"), r6(F.avg("model_outcome_entropy_top_5"), "mean_entropy"), r6(F.avg("model_logprob_gap"), "mean_gap"))


@query(f"select k, {', '.join(f'round(log10({c}+1e0), 6) as {c}' if 'ratio' in c else f'round({c}, 6) as {c}' for c in FEATURES)} from ({features_sql()})")
def uq_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("k", *(r6(F.log10(F.col(c) + 1), c) if "ratio" in c else r6(c) for c in FEATURES))


def _records(spark: SparkSession, sf_dir: str, keep: list[str] = ()) -> DataFrame:
    """Raw records with JSON answers: white space around questions and answers, invalid answers, missing truth and ids."""
    log = _log(spark, sf_dir)
    question = F.expr("case concept " + " ".join(f"when '{c}' then '  {q[-1].upper()}\n'" for c, (_, q) in CONCEPTS.items()) + " end")
    answer = F.when(F.col("k") % 11 == 0, "Maybe").otherwise(F.concat(F.lit("\t"), F.lower("answer"), F.lit(" ")))
    entry = F.struct(question.alias("question"), answer.alias("answer"), F.col("top_logprobs"), F.lit(None).cast("string").alias("error"))
    other = F.struct(F.lit("an unrelated question").alias("question"), F.lit("YES").alias("answer"), F.col("top_logprobs"), F.lit(None).cast("string").alias("error"))
    text = F.when(F.col("k") % 13 == 0, "not json").otherwise(F.to_json(F.array(other, entry)))
    truth = {label: F.when((F.col("concept") == c) & (F.col("k") % 5 != 0), F.col("ground_truth")) for c, (label, _) in CONCEPTS.items()}
    return log.select(F.when(F.col("k") % 17 != 0, F.col("content_id")).alias("content_id"), *(v.alias(k) for k, v in truth.items()), text.alias("logprobs_data"), *keep)


_ROWS = f"select r.*, c.concept as asked, case when c.concept <> r.concept or r.k % 5 = 0 then 'missing ground truth' when r.k % 13 = 0 then 'no question' when r.k % 11 = 0 then 'bad answer' else 'kept' end as reason from ({_A}) r cross join (values ('ADULT'),('KIDS'),('DIMC'),('DAT')) c(concept) where r.k % 17 <> 0"


@query(f"select k::varchar || '_' || concept as content_concept_id, concept, ground_truth, answer as llm_prediction, is_correct from ({_ROWS}) where reason = 'kept'")
def uq_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = preprocess.samples(preprocess.concept_rows(_records(spark, sf_dir)))
    return s.select("content_concept_id", "concept", "ground_truth", "llm_prediction", "is_correct")


@query(ORACLE_SQL["uq_samples"])
def uq_sample_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples are made and written once, by concept, and then loaded."""
    path = new_path(spark, "samples")
    for _ in range(2):
        s = load_or_make(spark, path, lambda: preprocess.samples(preprocess.concept_rows(_records(spark, sf_dir))))
    return s.select("content_concept_id", "concept", "ground_truth", "llm_prediction", "is_correct")


@query(f"select asked as concept, reason, count(*) as n from ({_ROWS}) group by all")
def uq_skip_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.skip_report(preprocess.concept_rows(_records(spark, sf_dir)))


@query(f"select count(*) as n, sum(is_correct)::bigint as n_correct, round(100e0*sum(is_correct)/count(*), 6) as pct_correct, round(100e0*(count(*)-sum(is_correct))/count(*), 6) as pct_incorrect from ({_A})")
def uq_label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.label_distribution(_log(spark, sf_dir)).select("n", "n_correct", r6("pct_correct"), r6("pct_incorrect"))


@query(f"select concept, count(*) as n, sum(is_correct)::bigint as n_correct, sum(ground_truth)::bigint as n_positive from ({_A}) group by concept")
def uq_concept_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.concept_stats(_log(spark, sf_dir))


_ASKED = "case concept " + " ".join(f"when '{c}' then '  '||'{q[-1].upper()}'||chr(10)" for c, (_, q) in CONCEPTS.items()) + " end"


@query(f"select concept, q as question_used, count(*) as n, case when length(q) > 40 then left(q, 40)||'...' else q end as preview from (select concept, {_ASKED} as q from ({_ROWS}) where reason = 'kept') group by all")
def uq_question_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.question_usage(preprocess.samples(preprocess.concept_rows(_records(spark, sf_dir))), preview=40)


@query(f"select 'input records' as what, count(*) as n from ({_A}) union all select 'output samples', count(*) from ({_ROWS}) where reason = 'kept'")
def uq_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.write_with_totals(_records(spark, sf_dir), new_path(spark, "samples"))


#: Concepts of five variants each: the concept's name and a number from the key, 1,000 for each of the four.
_WIDE = "concept || '-' || cast(k % 1000 as varchar(9))"


@query(f"select concept, reason, count(*) as n, sum(k)::bigint as ids from (select {_WIDE} as concept, k, case when k % 5 = 0 then 'missing ground truth' when k % 13 = 0 then 'no question' when k % 6 = 5 then 'no question' when k % 11 = 0 then 'bad answer' else 'kept' end as reason from ({_A}) where k % 17 <> 0) group by all")
def uq_many_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of 4,000 concepts with five variants of their question each: 20,000 questions in a table."""
    log = _log(spark, sf_dir).withColumn("name", F.concat_ws("-", "concept", (F.col("k") % 1000).cast("string")))
    content_id = F.when(F.col("k") % 17 != 0, F.col("content_id")).alias("content_id")
    truths = log.select(content_id, F.col("name").alias("concept"), F.when(F.col("k") % 5 != 0, F.col("ground_truth")).alias("ground_truth"))
    names = log.select(F.col("name").alias("concept")).distinct()
    questions = names.select("concept", F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat(F.lit("Is it about "), F.col("concept"), F.lit(" "), i.cast("string"))).alias("question")).alias("question"))
    entry = lambda question, answer: F.struct(question.alias("question"), answer.alias("answer"), F.col("top_logprobs"), F.lit(None).cast("string").alias("error"))
    asked = F.concat(F.lit("\n is it ABOUT "), F.col("name"), F.lit(" "), (F.col("k") % 6).cast("string"), F.lit(" "))
    answer = F.when(F.col("k") % 11 == 0, "Maybe").otherwise(F.lower("answer"))
    again = F.concat(F.lit("is it about "), F.col("name"), F.lit(" 0"))
    late = F.when(F.col("k") % 6 != 5, entry(again, F.lit("later")))
    text = F.when(F.col("k") % 13 == 0, "not json").otherwise(F.to_json(F.array(entry(F.lit("an unrelated question"), F.lit("YES")), entry(asked, answer), late)))
    rows = preprocess.concept_rows_by_table(log.select(content_id, text.alias("logprobs_data")), truths, questions)
    return rows.groupBy("concept", F.coalesce("skip_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.sum(F.col("content_id").cast("bigint")).alias("ids"))


_WITH_FEATURES = f"select r.k::varchar || '_' || r.concept as content_concept_id, r.is_correct, {', '.join(f'round(f.{c}, 6) as {c}' for c in SHORT.values())} from ({_ROWS}) r join ({features_sql()}) f on r.k = f.k where r.reason = 'kept'"


@query(_WITH_FEATURES)
def uq_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw records to labelled samples with features."""
    return workloads.feature_table(_records(spark, sf_dir)).select("content_concept_id", "is_correct", *(r6(c) for c in SHORT.values()))


@query(f"select round(100e0*avg(ground_truth::double), 6) as pct_ground_truth_positive, round(100e0*avg((answer = 'YES')::int::double), 6) as pct_yes from ({_A})")
def uq_prediction_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = preprocess.prediction_rates(_log(spark, sf_dir))
    return rates.select(r6("pct_ground_truth_positive"), r6("pct_yes"))


def _scoring_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    text = F.to_json(F.transform("top_logprobs", lambda t: F.struct(t["token"].alias("token"), F.when(F.col("k") % 19 != 0, t["logprob"]).alias("logprob"))))
    return log.select(F.when(F.col("k") % 17 != 0, F.col("content_id")).alias("content_id"), F.when(F.col("k") % 3 != 0, text).alias("top_logprobs"), F.when(F.col("k") % 3 == 0, F.concat(F.lit('[{"top_logprobs":'), text, F.lit("}]"))).alias("logprobs_data"))


_REASON = "case when k % 17 = 0 then 'missing content_id' when n_tokens = 0 then 'missing/empty top_logprobs' when k % 19 = 0 then 'top_logprobs items missing required keys' else 'valid' end"


@query(f"select {_REASON} as reason, count(*) as n, sum(case when k % 17 <> 0 then k else 0 end)::bigint as id_sum from ({_A}) group by all")
def uq_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, rejected = validate.prepare(_scoring_records(spark, sf_dir))
    both = valid.select("content_id", F.lit("valid").alias("reason")).unionByName(rejected)
    return both.groupBy("reason").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("content_id").cast("bigint"), F.lit(0))).alias("id_sum"))


@query(f"select k::varchar as content_id from ({_A}) where {_REASON} = 'valid' order by 1 limit 100")
def uq_first_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.prepare(_scoring_records(spark, sf_dir), max_records=100)[0].select("content_id")


_LABELS = [label for label, _ in CONCEPTS.values()]


@query(f"select case when k % 17 <> 0 then k::varchar end as content_id, " + ", ".join(f"(case when concept = '{c}' and k % 5 <> 0 then ground_truth end)::int as label_{c}" for c in CONCEPTS) + f" from ({_A}) where k % 23 <> 0")
def uq_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training records written as lines, with commas behind them and every 23rd cut off, and read tolerantly."""
    records = _records(spark, sf_dir, keep=["k"])
    line = F.to_json(F.struct("content_id", *_LABELS, "logprobs_data"))
    lines = records.select(F.when(F.col("k") % 23 == 0, F.substring(line, 1, 12)).when(F.col("k") % 2 == 0, F.concat(line, F.lit(", "))).otherwise(line).alias("value"))
    path = new_path(spark, "lines.jsonl")
    lines.write.text(path)
    return read_json_lines(spark, path).select("content_id", *(F.col(f"`{label}`").alias(f"label_{c}") for c, (label, _) in CONCEPTS.items()))


_VALID_SQL = f"select {_REASON} as reason, count(*) as n, sum(case when k % 17 <> 0 then k else 0 end)::bigint as id_sum from ({_A}) {{}} group by all"


def _by_reason(records: DataFrame) -> DataFrame:
    both = validate.checked(records).withColumn("reason", F.coalesce("reason", F.lit("valid")))
    return both.groupBy("reason").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("content_id").cast("bigint"), F.lit(0))).alias("id_sum"))


@query(_VALID_SQL.format(""))
def uq_read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to score, written as lines with blank and broken ones between them, read by their suffix and checked."""
    path = new_path(spark, "records.jsonl")
    line = F.to_json(F.struct("content_id", F.from_json("top_logprobs", TOKENS).alias("top_logprobs"), F.from_json("logprobs_data", ENTRIES).alias("logprobs_data")))
    lines = _scoring_records(spark, sf_dir).select(F.explode(F.array(line, F.lit(""), F.lit("[1]"), F.lit('{"content_id": '))).alias("value"))
    lines.write.text(path)
    return _by_reason(read_records(spark, path))


@query(_VALID_SQL.format("where k % 3 <> 0"))
def uq_read_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a cell of JSON, written as CSV and read back."""
    path = new_path(spark, "records.csv")
    _scoring_records(spark, sf_dir).filter("top_logprobs IS NOT NULL").select("content_id", "top_logprobs").write.csv(path, header=True, quote='"', escape='"')
    return _by_reason(read_records(spark, path))


@query(_VALID_SQL.format("where k % 3 <> 0"))
def uq_read_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of records, one list of about a hundred in each file, other items among them."""
    path = new_path(spark, "records.json")
    item = F.to_json(F.struct("content_id", F.from_json("top_logprobs", TOKENS).alias("top_logprobs")))
    some = staged(_scoring_records(spark, sf_dir).filter("top_logprobs IS NOT NULL").select(item.alias("item")), "items")
    files = max(1, some.count() // 100)
    lists = some.groupBy(F.pmod(F.xxhash64("item"), F.lit(files)).alias("file")).agg(F.concat(F.lit("[7, "), F.concat_ws(", ", F.collect_list("item")), F.lit("]")).alias("value"))
    lists.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return _by_reason(read_records(spark, path))


@query(f"select (count(*) filter (where k % 7 <> 0))::bigint as n_values, (count(*) filter (where {SHORT['h']} <> 0))::bigint as n_inverse, round(max(least(1e0/nullif({SHORT['h']},0), 5e0)),6) as most from ({features_sql()})")
def uq_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Infinities become null, values are cut, and columns with one value or too few are found."""
    f = _features(spark, sf_dir).select("is_correct", F.when(F.col("k") % 7 != 0, F.lit(1.0)).alias("constant"), F.when(F.col(SHORT["h"]) == 0, float("inf")).otherwise(1 / F.when(F.col(SHORT["h"]) != 0, F.col(SHORT["h"]))).alias("inverse"), F.lit(None).cast("double").alias("empty"))
    clean = stats.cleaned(f, ["constant", "inverse", "empty"], "is_correct")
    left = [c for c in stats.usable_features(clean) if c not in ("is_correct", *stats.constant_columns(clean, ["empty"]))]
    return clean.select(*left).agg(F.count("constant").alias("n_values"), F.count("inverse").alias("n_inverse"), F.round(F.max(clipped(F.col("inverse"), 5.0)), 6).alias("most"))


def _stat_sql(s: str) -> str:
    m = f"(select avg({s}) from d)"
    central = lambda k: f"avg(pow({s}-{m},{k}))"
    return f"select '{s}' as feature, count({s}) as count, round(avg({s}),6) as mean, round(stddev_samp({s}),6) as std, round(min({s}),6) as min, round(max({s}),6) as max, round(quantile_cont({s},0.5),6) as median, round(quantile_cont({s},0.25),6) as q25, round(quantile_cont({s},0.75),6) as q75, round({central(3)}/pow({central(2)},1.5),5) as skewness, round({central(4)}/pow({central(2)},2)-3,5) as kurtosis, round(stddev_samp({s})/avg({s}),5) as cv, round(100e0*count({s})/count(*),6) as non_null_pct from d"


@query(f"with d as ({_S}) " + " union all ".join(map(_stat_sql, SHORT)))
def uq_feature_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.feature_statistics(_short(spark, sf_dir), list(SHORT), exact=True)
    five = ("skewness", "kurtosis", "cv")
    return s.select("feature", "count", *(F.round(c, 5 if c in five else 6).alias(c) for c in ("mean", "std", "min", "max", "median", "q25", "q75", *five, "non_null_pct")))


_PAIRS = [(a, b) for i, a in enumerate(SHORT) for b in list(SHORT)[i + 1 :]]


@query(f"with d as ({_S}) " + " union all ".join(f"select '{a}' as f1, '{b}' as f2, count(case when {a} is not null and {b} is not null then 1 end) as n, round(corr({a},{b}),6) as r from d" for a, b in _PAIRS))
def uq_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.correlations(_short(spark, sf_dir), list(SHORT)).select("f1", "f2", "n", r6("r"))


@query(f"with d as ({_S}), c as (" + " union all ".join(f"select '{a}' as f1, '{b}' as f2, corr({a},{b}) as r from d" for a, b in _PAIRS) + ") select f1, f2 from c where abs(r) > 0.9e0")
def uq_collinear_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.collinear_pairs(stats.correlations(_short(spark, sf_dir), list(SHORT)), 0.9).select("f1", "f2")


@query(f"with d as ({_S}) " + " union all ".join(f"select '{s}' as feature, count({s}) as n, round(corr({s},y),6) as r from d" for s in SHORT))
def uq_target_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_by_correlation(stats.target_correlations(_short(spark, sf_dir), list(SHORT), "y")).select("feature", "n", r6("r"))


@query(f"with d as ({_S}) " + " union all ".join(f"select '{s}' as feature, round(avg(({s} is null)::int::double),6) as null_rate, 0 as high_missing from d" for s in SHORT))
def uq_missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.missing_report(_short(spark, sf_dir), list(SHORT)).select("feature", r6("null_rate"), "high_missing")


_LONG = f"select y, feature, v from ({_S}) unpivot (v for feature in ({', '.join(SHORT)}))"
_ROUNDED = f"select y, feature, round(v, 4) as v from ({_LONG})"


def _rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(spark, sf_dir).withColumns({s: F.round(s, 4) for s in SHORT})


@query(f"with l as ({_ROUNDED}), e as (select feature, y, min(v) as lo, max(v) as hi, count(*) as t from l group by all) select l.feature, l.y, least(floor((v-lo)/(hi-lo)*20), 19)::int as bin, count(*) as n, round(count(*)*20e0/any_value(t)/any_value(hi-lo),4) as density from l join e on l.feature = e.feature and l.y = e.y group by 1, 2, 3")
def uq_class_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.class_histograms(_rounded(spark, sf_dir), list(SHORT), "y").select("feature", "y", "bin", "n", F.round("density", 4).alias("density"))


@query(f"with l as ({_ROUNDED}), e as (select feature, min(v) as lo, max(v) as hi from l group by all), b as (select l.feature, y, least(floor((v-lo)/(hi-lo)*10), 9)::int as bin, count(*)::double as n from l join e on l.feature = e.feature group by all), m as (select *, sum(n) over (partition by feature, bin) as nb, sum(n) over (partition by feature, y) as ny, sum(n) over (partition by feature) as nn from b) select feature, round(sum(n/nn*ln(n*nn/(nb*ny))),6) as mi from m group by feature")
def uq_mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mutual_information(_rounded(spark, sf_dir), list(SHORT), "y").select("feature", r6("mi"))


#: Whole numbers, so that distances are exact in any engine.
_GRID = f"select k, y, feature, round(v * 1e4) as v from ({_LONG.replace('select y,', 'select k, y,')})"


def _digamma_sql(x: str) -> str:
    z = f"(1e0/(({x})+6e0)/(({x})+6e0))"
    return f"(ln(({x})+6e0) - 0.5e0/(({x})+6e0) - {z}*(1e0/12 - {z}*(1e0/120 - {z}/252e0)) - ({'+'.join(f'1e0/(({x})+{i})' for i in range(6))}))"


@query(f"""with l as materialized ({_GRID}), c as (select feature, y, count(*) as nc from l group by all having count(*) > 1), r as materialized (select l.*, nc, least(3, nc - 1) as kk from l join c on l.feature = c.feature and l.y = c.y),
    v as materialized (select feature, y, v, count(*) as n, any_value(nc) as nc, any_value(kk) as kk from r group by feature, y, v), a as materialized (select feature, v, sum(n) as n from v group by all),
    e as (select feature, y, v, unnest(range(least(n, 4))) as copy from v),
    d as materialized (select v.feature, v.y, v.v, v.n, v.nc, v.kk, list_extract(min(abs(v.v - e.v), 4), v.kk + 1) as d from v join e on v.feature = e.feature and v.y = e.y group by v.feature, v.y, v.v, v.n, v.nc, v.kk),
    m as (select d.feature, d.y, d.v, any_value(d.n) as n, any_value(d.nc) as nc, any_value(case when d.d = 0 then d.n - 1 else d.kk end) as kk, sum(a.n) as m from d join a on d.feature = a.feature and (abs(a.v - d.v) < d.d or a.v = d.v) group by d.feature, d.y, d.v)
    select feature, sum(n)::bigint as n, round(greatest(0, {_digamma_sql('sum(n)')} + sum(n * {_digamma_sql('kk')}) / sum(n) - sum(n * {_digamma_sql('nc')}) / sum(n) - sum(n * {_digamma_sql('m')}) / sum(n)), 6) as mi from m group by feature""")
def uq_neighbour_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual information by the third neighbour of a value's class."""
    whole = _short(spark, sf_dir).withColumns({s: F.round(F.col(s) * 1e4) for s in SHORT})
    return information.neighbour_information(whole, list(SHORT), "y").select("feature", "n", r6("mi"))


@query(f"with d as ({_S}), s as (select sum(h*h) as aa, sum(g*g) as bb, sum(h*g) as ab from d) select unnest(['h','g']) as feature, round(1e0/(1e0-ab*ab/(aa*bb)),4) as vif from s")
def uq_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.inflation_table(_short(spark, sf_dir), ["h", "g"]).select("feature", F.round("vif", 4).alias("vif"))


@query(f"with d as ({_S}) " + " union all ".join(f"select '{s}' as feature, (abs(corr({s},y)) > 0.1e0)::int as selected from d" for s in SHORT))
def uq_statistical_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """|r| over 0.1 with the target; at these sizes such an r is always significant."""
    r = stats.target_correlations(_short(spark, sf_dir), list(SHORT), "y")
    return r.select("feature", F.coalesce((F.abs("r") > 0.1) & (F.col("significant") == 1), F.lit(False)).cast("int").alias("selected"))


@query()
def uq_forest_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _features(spark, sf_dir)
    return selection.forest_importance(f, [c for c in FEATURES if c != "model_max_softmax_prob_filtered"], "is_correct", trees=100)


@query()
def uq_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vote over correlation, mutual information and a forest of 100 trees, on what is left of all 20 features."""
    return selection.select_features(_features(spark, sf_dir), list(FEATURES), "is_correct", trees=100)


def _quota_sql(table: str, rest: str) -> str:
    return f"with a as ({answer_log_sql(table)}), c as (select is_correct, count(*) as n, (select count(*) from a) as t from a group by 1), x as (select *, ceil(0.2e0*t)*n/t as exact from c), q as (select is_correct, floor(exact) + case when row_number() over (order by floor(exact)-exact, is_correct) <= ceil(0.2e0*t)-sum(floor(exact)) over () then 1 else 0 end as quota from x), r as (select a.*, row_number() over (partition by is_correct order by md5('42:'||k), k) as rn from a) {rest}"


@query(_quota_sql("events", "select k, r.is_correct, (rn <= quota)::int as is_test from r join q on r.is_correct = q.is_correct"))
def uq_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split(_log(spark, sf_dir), "k", "is_correct", 0.2, 42).select("k", "is_correct", F.col("is_test").cast("int").alias("is_test"))


@query(_quota_sql("events", "select k, r.is_correct, (rn <= quota)::int as is_test from r join q on r.is_correct = q.is_correct"))
def uq_split_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a split, written as the tables of a run and read back."""
    parted, path = sampling.split(_log(spark, sf_dir), "k", "is_correct", 0.2, 42), new_path(spark, "run")
    write_tables({"train": parted.filter("NOT is_test"), "test": parted.filter("is_test")}, path)
    both = spark.read.parquet(f"{path}/train").unionByName(spark.read.parquet(f"{path}/test"))
    return both.select("k", "is_correct", F.col("is_test").cast("int").alias("is_test"))


@query(f"with a as ({_A}), r as (select *, row_number() over (partition by is_correct order by md5('42:'||k), k) as rn, count(*) filter (is_correct = 0) over () as n0 from a) select k, is_correct, (is_correct = 0 or rn <= 2*n0)::int as kept from r")
def uq_undersample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.undersample(_log(spark, sf_dir), "k", "is_correct", 2.0, 42).select("k", "is_correct", F.col("kept").cast("int").alias("kept"))


@query(f"select k, ((row_number() over (partition by is_correct order by md5('42:'||k), k)-1) % 3)::int as fold from ({_A})")
def uq_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.folds(_log(spark, sf_dir), "k", "is_correct", 3, 42).select("k", "fold")


@query(_quota_sql("events", "select case when rn <= quota then 'test' else 'train' end as stage, sum((r.is_correct = 1)::int)::bigint as pos, sum((r.is_correct = 0)::int)::bigint as neg, count(*) as total, round(sum((r.is_correct = 1)::int)::double/sum((r.is_correct = 0)::int),6) as ratio from r join q on r.is_correct = q.is_correct group by 1"))
def uq_stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    parted = sampling.split(_log(spark, sf_dir), "k", "is_correct", 0.2, 42)
    return sampling.stage_report({"train": parted.filter("NOT is_test"), "test": parted.filter("is_test")}, "is_correct").withColumn("ratio", F.round("ratio", 6))


@query(f"with a as ({_A}), r as (select *, row_number() over (partition by is_correct order by md5('42:'||k), k) as rn, count(*) filter (is_correct = 0) over () as n0 from a), s as (select sum(is_correct)::bigint as pos, sum(1-is_correct)::bigint as neg, sum((is_correct = 1 and rn <= 2*n0)::int)::bigint as pos_after from r) select 'all' as stage, pos, neg, pos+neg as total, round(pos::double/neg,6) as ratio, pos_after, neg as neg_after, pos_after+neg as total_after, round(pos_after::double/neg,6) as ratio_after, pos-pos_after as removed, round(100e0*(pos-pos_after)/(pos+neg),6) as reduction_pct from s")
def uq_reduction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    kept = sampling.undersample(log, "k", "is_correct", 2.0, 42).filter("kept")
    report = sampling.reduction_report({"all": log}, {"all": kept}, "is_correct")
    return report.withColumns({c: F.round(c, 6) for c in ("ratio", "ratio_after", "reduction_pct")})


def _kept_sql(ratio: int) -> str:
    return f"select 'ratio {ratio}' as run_id, sum(case when y = 1 then least(m, {ratio}*n0) end)::bigint as pos, any_value(n0)::bigint as neg from (select is_correct as y, count(*) as m, sum(count(*) filter (is_correct = 0)) over () as n0 from ({_A}) group by 1)"


@query(" union all ".join(map(_kept_sql, (2, 3))))
def uq_run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of a balance in one history; a run that breaks and one that is repeated leave no rows."""
    log = _log(spark, sf_dir)
    history = RunHistory(spark, new_path(spark, "history"))

    def report(ratio: float) -> dict[str, DataFrame]:
        kept = sampling.undersample(log, "k", "is_correct", ratio, 42).filter("kept")
        return {"balance": sampling.stage_report({"kept": kept}, "is_correct")}

    for run_id, ratio in (("ratio 2", 2.0), ("ratio 3", 3.0), ("ratio 2", 4.0)):
        history.append(run_id, report(ratio))
    broken = log.limit(1).select(F.raise_error("broken on purpose").alias("stage"))
    try:
        history.append("broken", report(5.0) | {"late": broken})
    except PySparkException:
        pass  # what it wrote before stays unseen
    return history.table("balance").select("run_id", "pos", "neg")


_NN_FEATURES = ["lp1", "lp2"]
_NN = "select a.k, any_value(a.y) as y, unnest(min_by(b, struct_pack(d := pow(a.lp1-b.lp1,2)+pow(a.lp2-b.lp2,2), k := b.k), {n})) as b from {q} a join d b on a.k <> b.k group by a.k"
_POINTS = f"with d as (select k, is_correct as y, lp1, lp2 from ({_A}))"


@query(f"{_POINTS}, m as ({_NN.format(q='(select * from d where y = 0)', n=1)}), h as (select d.* from d semi join (select b.k from m where b.y = 1) x on d.k = x.k), z as ({_NN.format(q='h', n=1)}) select distinct z.k from z join m on z.b.k = m.k and m.b.k = z.k")
def uq_tomek(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.tomek_removed(_log(spark, sf_dir), "k", "is_correct", _NN_FEATURES, 1)


@query(f"{_POINTS}, n as ({_NN.format(q='(select * from d where y = 1)', n=3)}) select distinct k from n where b.y = 0")
def uq_enn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.enn_removed(_log(spark, sf_dir), "k", "is_correct", _NN_FEATURES, 1)


#: Nine uncertainty features without nulls; rounded, so that equal values stay equal in any engine.
_NINE = {"u1": "model_outcome_entropy_top_5", "u2": "model_outcome_normalized_entropy_top_5", "u3": "model_effective_choices_top_5", "u4": "model_confidence_score_top_5", "u5": "model_max_softmax_prob", "u6": "model_p1_p2_gap", "u7": "model_logprob_gap", "u8": "model_outcome_entropy_filtered", "u9": "model_effective_choices_filtered"}
_NINE_SQL = f"select k, is_correct, {', '.join(f'round({c}, 4) as {u}' for u, c in _NINE.items())} from ({features_sql()})"


def _nine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, is_correct, the nine features), staged: neighbours are searched several times."""
    return staged(_features(spark, sf_dir).select("k", "is_correct", *(F.round(c, 4).alias(u) for u, c in _NINE.items())), "nine-features")


def _nn_sql(queries: str, points: str, features: list[str], n: int) -> str:
    d = " + ".join(f"pow(a.{f} - b.{f}, 2)" for f in features)
    return f"(select a.k, any_value(a.y) as y, unnest(min_by(b, struct_pack(d := {d}, k := b.k), {n})) as b from ({queries}) a join {points} b on a.k <> b.k group by a.k)"


def _tomek_sql(t: str, p: str, features: list[str]) -> str:
    """CTEs on a table ``t`` (k, y, features): {p}_tomek has the keys of the majority (1) to be removed."""
    return f"""{p}_m as materialized {_nn_sql(f"select * from {t} where y = 0", t, features, 1)}, {p}_h as materialized (select x.* from {t} x semi join (select b.k from {p}_m where b.y = 1) m on x.k = m.k),
        {p}_z as materialized {_nn_sql(f"select * from {p}_h", t, features, 1)}, {p}_tomek as materialized (select distinct z.k from {p}_z z join {p}_m m on z.b.k = m.k and m.b.k = z.k)"""


def _enn_sql(t: str, p: str, features: list[str]) -> str:
    return f"{p}_n as materialized {_nn_sql(f'select * from {t} where y = 1', t, features, 3)}, {p}_enn as materialized (select distinct k from {p}_n where b.y = 0)"


def _hybrid_sql(source: str, features: list[str], ratio: float) -> str:
    """The report of ``split_and_balance`` with the hybrid method, majority 1."""

    def clean(t: str, p: str) -> str:
        return f"""{_tomek_sql(t, p, features)}, {p}_left as materialized (select x.* from {t} x anti join {p}_tomek r on x.k = r.k), {_enn_sql(f"{p}_left", p, features)},
        {p}_rest as materialized (select x.* from {p}_left x anti join {p}_enn r on x.k = r.k),
        {p}_kept as materialized (select * from (select *, row_number() over (partition by y order by md5('42:'||k), k) as place from {p}_rest) where y = 0 or place <= (select least(floor({ratio} * count(*) filter (y = 0)), count(*) filter (y = 1)) from {t})),
        {p}_gone as materialized (select x.* from {t} x anti join {p}_kept r on x.k = r.k)"""

    columns = ", ".join(["k", "y", *features])
    rows = lambda name, t, where="true": f"select '{name}' as stage, sum(y)::bigint as pos, sum(1 - y)::bigint as neg, count(*) as total from {t} where {where}"
    parts = " union all ".join([rows("kept_train", "tr_kept"), rows("kept_test", "te_kept"), rows("removed_train", "tr_gone", "y <> 1"), rows("removed_test", "te_gone")])
    return f"""with d as materialized (select k, is_correct as y, {", ".join(features)} from ({source})), c as (select y, count(*) as n, (select count(*) from d) as t from d group by 1), x as (select *, ceil(0.2e0*t)*n/t as exact from c),
        q as (select y, floor(exact) + case when row_number() over (order by floor(exact)-exact, y) <= ceil(0.2e0*t)-sum(floor(exact)) over () then 1 else 0 end as quota from x),
        r as materialized (select d.*, row_number() over (partition by d.y order by md5('42:'||k), k) <= quota as is_test from d join q on d.y = q.y),
        tr as materialized (select {columns} from r where not is_test), {clean("tr", "tr")}, te as materialized (select {columns} from r where is_test union all select {columns} from tr_gone where y = 1), {clean("te", "te")}
        select stage, coalesce(pos, 0) as pos, coalesce(neg, 0) as neg, total, round(coalesce(pos::double/nullif(neg, 0), 0), 6) as ratio from ({parts})"""


def _balanced(df: DataFrame, features: list[str]) -> DataFrame:
    kept_train, kept_test, gone_train, gone_test = sampling.split_and_balance(df, "k", "is_correct", features, "hybrid", 2.0, 2.0)
    parts = {"kept_train": kept_train, "kept_test": kept_test, "removed_train": gone_train, "removed_test": gone_test}
    return sampling.stage_report(parts, "is_correct").withColumn("ratio", F.round("ratio", 6))


@query(_hybrid_sql(_A, _NN_FEATURES, 2.0))
def uq_hybrid_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split, then Tomek links, edited neighbours and undersampling on either side."""
    return _balanced(_log(spark, sf_dir).select("k", "is_correct", *_NN_FEATURES), _NN_FEATURES)


@query(f"with d as materialized (select k, is_correct as y, {', '.join(_NINE)} from ({_NINE_SQL})), {_tomek_sql('d', 'd', list(_NINE))} select k from d_tomek")
def uq_tomek_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.tomek_removed(_nine(spark, sf_dir), "k", "is_correct", list(_NINE), 1)


@query(f"with d as materialized (select k, is_correct as y, {', '.join(_NINE)} from ({_NINE_SQL})), {_enn_sql('d', 'd', list(_NINE))} select k from d_enn")
def uq_enn_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.enn_removed(_nine(spark, sf_dir), "k", "is_correct", list(_NINE), 1)


@query(_hybrid_sql(_NINE_SQL, list(_NINE), 2.0))
def uq_hybrid_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on nine uncertainty features."""
    return _balanced(_nine(spark, sf_dir), list(_NINE))


_SIDES = "b as (select r.k, r.is_correct, (rn <= quota)::int as is_test from r join q on r.is_correct = q.is_correct), s as (select *, row_number() over (partition by is_test, is_correct order by md5('42:'||k), k) as place, count(*) filter (is_correct = 0) over (partition by is_test) as n0 from b)"


@query(_quota_sql("events", "").rstrip() + f", {_SIDES} select k, is_test, (is_correct = 0 or place <= 2*n0)::int as kept from s")
def uq_random_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split, then cut the majority of either side to twice the minority; features with nulls take this way, too."""
    log = _log(spark, sf_dir).withColumn("holed", F.when(F.col("k") % 9 != 0, F.col("lp1")))
    kept_train, kept_test, gone_train, gone_test = sampling.split_and_balance(log, "k", "is_correct", ["holed"], "enn", 2.0, 2.0)
    out = None
    for part, is_test, kept in ((kept_train, 0, 1), (kept_test, 1, 1), (gone_train, 0, 0), (gone_test, 1, 0)):
        rows = part.select("k", F.lit(is_test).alias("is_test"), F.lit(kept).alias("kept"))
        out = rows if out is None else out.unionByName(rows)
    return out


_CONF = f"(select sum((is_correct=1 and p>=0.6e0)::int)::bigint as tp, sum((is_correct=0 and p>=0.6e0)::int)::bigint as fp, sum((is_correct=0 and p<0.6e0)::int)::bigint as tn, sum((is_correct=1 and p<0.6e0)::int)::bigint as fn from ({_A}))"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_log(spark, sf_dir).withColumn("prediction", (F.col("p") >= 0.6).cast("int")), "is_correct", "prediction")


_RATES = {"precision": "tp::double/(tp+fp)", "recall": "tp::double/(tp+fn)", "precision_neg": "tn::double/(tn+fn)", "recall_neg": "tn::double/(tn+fp)", "f1": "2e0*tp/(2*tp+fp+fn)", "f1_neg": "2e0*tn/(2*tn+fp+fn)", "accuracy": "(tp+tn)::double/(tp+fp+tn+fn)"}


@query(f"select tp, fp, tn, fn, {', '.join(f'round({e},6) as {n}' for n, e in _RATES.items())}, round((f1_+f1n_)/2,6) as f1_macro, round((re_+ren_)/2,6) as balanced_accuracy, round(fp*{MISS}e0+tn*({REVIEW}e0-{MISS}e0)+fn*{REVIEW}e0,6) as cost from (select *, 2e0*tp/(2*tp+fp+fn) as f1_, 2e0*tn/(2*tn+fp+fn) as f1n_, tp::double/(tp+fn) as re_, tn::double/(tn+fp) as ren_ from {_CONF})")
def uq_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.business_cost(metrics.rates(_counts(spark, sf_dir)), MISS, REVIEW)
    return m.select("tp", "fp", "tn", "fn", *(r6(c) for c in (*_RATES, "f1_macro", "balanced_accuracy", "cost")))


@query(f"with c as (select *, tn+fp as n0, tp+fn as n1, tn::double/(tn+fn) as p0, tp::double/(tp+fp) as p1, tn::double/(tn+fp) as r0, tp::double/(tp+fn) as r1, 2e0*tn/(2*tn+fp+fn) as f0, 2e0*tp/(2*tp+fp+fn) as f1 from {_CONF}) select '0' as label, round(p0,6) as precision, round(r0,6) as recall, round(f0,6) as f1, n0 as support from c union all select '1', round(p1,6), round(r1,6), round(f1,6), n1 from c union all select 'macro avg', round((p0+p1)/2,6), round((r0+r1)/2,6), round((f0+f1)/2,6), n0+n1 from c union all select 'weighted avg', round((p0*n0+p1*n1)/(n0+n1),6), round((r0*n0+r1*n1)/(n0+n1),6), round((f0*n0+f1*n1)/(n0+n1),6), n0+n1 from c")
def uq_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_report(_counts(spark, sf_dir)).select("label", r6("precision"), r6("recall"), r6("f1"), "support")


@query(f"select round(avg(-case when is_correct = 1 then ln(p) else ln(1-p) end),6) as log_loss from ({_A})")
def uq_log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.log_loss(_log(spark, sf_dir), "is_correct", "p").select(r6("log_loss"))


_CURVE = f"(select p, sum(pos) over (order by p desc)::double as tp, sum(neg) over (order by p desc)::double as fp, pos, neg, sum(pos) over ()::double as np, sum(neg) over ()::double as nn from (select p, sum(is_correct) as pos, sum(1-is_correct) as neg from ({_A}) group by p))"


@query(f"select round(sum(neg*(tp-pos+pos/2e0))/any_value(np*nn),6) as roc_auc, round(sum(pos*tp/(tp+fp))/any_value(np),6) as average_precision from {_CURVE}")
def uq_ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ranking_metrics(_log(spark, sf_dir), "is_correct", "p").select(r6("roc_auc"), r6("average_precision"))


@query(f"select p as threshold, round(fp/nn,6) as fpr, round(tp/np,6) as tpr from {_CURVE}")
def uq_roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_points(_log(spark, sf_dir), "is_correct", "p").select("threshold", r6("fpr"), r6("tpr"))


_SWEEP = f"(select t.i, round(0.35e0+(0.7e0-0.35e0)/99*t.i,9) as threshold, sum((is_correct=1 and p>=0.35e0+(0.7e0-0.35e0)/99*t.i)::int)::bigint as tp, sum((is_correct=0 and p>=0.35e0+(0.7e0-0.35e0)/99*t.i)::int)::bigint as fp, sum((is_correct=0 and p<0.35e0+(0.7e0-0.35e0)/99*t.i)::int)::bigint as tn, sum((is_correct=1 and p<0.35e0+(0.7e0-0.35e0)/99*t.i)::int)::bigint as fn from ({_A}) cross join (select unnest(range(100)) as i) t group by t.i)"


@query(f"select threshold, tp, fp, tn, fn, round(fp*{MISS}e0+tn*({REVIEW}e0-{MISS}e0)+fn*{REVIEW}e0,6) as cost from {_SWEEP}")
def uq_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = metrics.threshold_sweep(_log(spark, sf_dir), "is_correct", "p", MISS, REVIEW)
    return s.select(F.round("threshold", 9).alias("threshold"), "tp", "fp", "tn", "fn", r6("cost"))


@query(f"select threshold, round(fp*{MISS}e0+tn*({REVIEW}e0-{MISS}e0)+fn*{REVIEW}e0,6) as cost from {_SWEEP} order by 2, 1 limit 1")
def uq_best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = metrics.best_threshold(metrics.threshold_sweep(_log(spark, sf_dir), "is_correct", "p", MISS, REVIEW))
    return best.select(F.round("threshold", 9).alias("threshold"), r6("cost"))


_FLIP = f"select k, is_correct, ground_truth, p, (answer='YES')::int as yes, (p>=0.6e0)::int as m, case when p<0.6e0 then 1-(answer='YES')::int else (answer='YES')::int end as flipped from ({_A})"


@query(f"select k, m as meta_model_prediction, (m=is_correct)::int as meta_model_correct, (m=1 and is_correct=0)::int as false_positive, (m=0 and is_correct=1)::int as false_negative, (m=0 and is_correct=0)::int as llm_wrong_detected, flipped as llm_after_label_flipping_binary from ({_FLIP})")
def uq_error_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = metrics.error_analysis(_log(spark, sf_dir), "p", 0.6)
    return a.select("k", "meta_model_prediction", "meta_model_correct", "false_positive", "false_negative", "llm_wrong_detected", "llm_after_label_flipping_binary")


@query(f"select sum((m=0 and is_correct=0)::int)::bigint as wrong_detected, sum((is_correct=0)::int)::bigint as wrong_total, sum((m=1 and is_correct=1)::int)::bigint as correct_accepted, sum(is_correct)::bigint as correct_total from ({_FLIP})")
def uq_detection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.detection_summary(metrics.error_analysis(_log(spark, sf_dir), "p", 0.6))


_SIX = {"f1": "2e0*tp/(2*tp+fp+fn)", "f1_macro": "(2e0*tp/(2*tp+fp+fn)+2e0*tn/(2*tn+fp+fn))/2", "precision": "tp::double/(tp+fp)", "recall": "tp::double/(tp+fn)", "accuracy": "(tp+tn)::double/(tp+fp+tn+fn)", "balanced_accuracy": "(tp::double/(tp+fn)+tn::double/(tn+fp))/2"}
_BOTH = " union all ".join(f"select '{name}' as answers, sum(({c}=1 and ground_truth=1)::int)::bigint as tp, sum(({c}=1 and ground_truth=0)::int)::bigint as fp, sum(({c}=0 and ground_truth=0)::int)::bigint as tn, sum(({c}=0 and ground_truth=1)::int)::bigint as fn from ({_FLIP})" for name, c in (("original", "yes"), ("flipped", "flipped")))


@query(f"with c as ({_BOTH}), m as (" + " union all ".join(f"select answers, '{m}' as metric, {e} as v from c" for m, e in _SIX.items()) + ") select o.metric, round(o.v,6) as original, round(f.v,6) as flipped, round(f.v-o.v,6) as delta from m o join m f on o.metric = f.metric where o.answers = 'original' and f.answers = 'flipped'")
def uq_flip_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = metrics.flip_comparison(metrics.error_analysis(_log(spark, sf_dir), "p", 0.6))
    return c.select("metric", r6("original"), r6("flipped"), r6("delta"))


@query(f"select k, p as meta_model_confidence from ({_A}) order by p, k limit 50")
def uq_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.review_queue(metrics.error_analysis(_log(spark, sf_dir), "p", 0.6), "k", 50).select("k", "meta_model_confidence")


@query(f"select concept, round(tp::double/(tp+fp),6) as precision, round(tp::double/(tp+fn),6) as recall from (select concept, sum((is_correct=1 and p>=0.6e0)::int) as tp, sum((is_correct=0 and p>=0.6e0)::int) as fp, sum((is_correct=1 and p<0.6e0)::int) as fn from ({_A}) group by concept)")
def uq_metrics_by_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = metrics.confusion(_log(spark, sf_dir).withColumn("m", (F.col("p") >= 0.6).cast("int")), "is_correct", "m", ["concept"])
    return metrics.rates(c).select("concept", r6("precision"), r6("recall"))


@query(f"with b as (select concept, avg(is_correct::double) as test_accuracy, avg(p) as test_f1 from ({_A}) group by concept), l as (select concept as experiment_name, unnest(['test_accuracy','test_f1']) as metric, unnest([test_accuracy, test_f1]) as value from b) select metric, experiment_name, round(value,6) as value, row_number() over (partition by metric order by value desc, experiment_name)::int as rank from l")
def uq_top_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _log(spark, sf_dir).groupBy(F.col("concept").alias("experiment_name")).agg(F.avg("is_correct").alias("test_accuracy"), F.avg("p").alias("test_f1"))
    return metrics.top_models(results).select("metric", "experiment_name", r6("value"), "rank")


@query(f"with d as ({_S}), m as (select avg(h) as mh, stddev_pop(h) as sh, avg(2e0*y-1) as my, count(*)::double as n from d), w as (select sum((h-mh)/sh*(2e0*y-1-my))/(any_value(n)+1e0) as w from d, m) select 'h' as feature, round(w,6) as weight, round(my,6) as intercept, round(mh,6) as mean, round(sh,6) as std from w, m")
def uq_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = models.ridge(models.class_sums(_short(spark, sf_dir), ["h"], "y"), ["h"], alpha=1.0)
    rows = [(model.features[0], round(model.weight[0], 6), round(model.intercept, 6), round(model.mean[0], 6), round(model.std[0], 6))]
    return spark.createDataFrame(rows, "feature string, weight double, intercept double, mean double, std double")


_LINEAR = models.Linear(("model_outcome_entropy_top_5", "model_logprob_gap"), (0.5, -3.0), (0.4, 2.0), (-0.7, 0.3), 0.2, 1.5, -0.1)


@query(f"select k::varchar as content_id, round(q,6) as meta_model_probability, (q>=0.5e0)::int as meta_model_prediction, 0.5e0 as threshold_used from (select k, 1e0/(1e0+exp(-(1.5e0*(0.2e0-0.7e0*(model_outcome_entropy_top_5-0.5e0)/0.4e0+0.3e0*(model_logprob_gap+3e0)/2e0)-0.1e0))) as q from ({features_sql()}) where {_REASON} = 'valid')")
def uq_batch_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = workloads.score_records(_scoring_records(spark, sf_dir), _LINEAR, 0.5)
    return scored.withColumn("meta_model_probability", F.round("meta_model_probability", 6))


@query(f"with d as ({_S}) select k, round((h-(select min(h) from d))/((select max(h)-min(h) from d)+1e-12),6) as probability from d")
def uq_min_max_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.min_max_scores(_short(spark, sf_dir), F.col("h")).select("k", r6("probability"))


@query(f"select concept as experiment_name, round(avg(is_correct::double),6) as test_f1 from ({_A}) group by concept order by 2 desc, 1 limit 1")
def uq_best_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of a table of results."""
    results = _log(spark, sf_dir).groupBy(F.col("concept").alias("experiment_name")).agg(r6(F.avg("is_correct"), "test_f1"))
    return metrics.best_result(results, "test_f1")


@query(f"select k::varchar as content_id, round(q,6) as meta_model_probability, (q>=0.5e0)::int as meta_model_prediction, 0.5e0 as threshold_used from (select k, 1e0/(1e0+exp(-(1.5e0*(0.2e0-0.7e0*(model_outcome_entropy_top_5-0.5e0)/0.4e0+0.3e0*(model_logprob_gap+3e0)/2e0)-0.1e0))) as q from ({features_sql()}) where {_REASON} = 'valid')")
def uq_score_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of records to a file of predictions: written, read, checked, scored, written as CSV and read back."""
    path, out = new_path(spark, "records.parquet"), new_path(spark, "predictions")
    _scoring_records(spark, sf_dir).write.parquet(path)
    scored, _ = workloads.score_file(spark, path, _LINEAR, 0.5)
    write_predictions(scored.withColumn("meta_model_probability", F.round("meta_model_probability", 6)), out, "csv")
    return spark.read.schema("content_id string, meta_model_probability double, meta_model_prediction int, threshold_used double").csv(out, header=True)


#: The monotone fit at a value is the greatest, over starts up to it, of the least mean up to an end from it on.
_MONOTONE = f"with d as ({_A}), g as (select p, sum(is_correct) as t, count(*) as n from d group by p), c as (select p, sum(t) over o as ct, sum(n) over o as cn, t, n from g window o as (order by p)), m as (select a.p as first, b.p as last, (b.ct-a.ct+a.t)::double/(b.cn-a.cn+a.n) as mean from c a join c b on a.p <= b.p), l as (select first, last as p, min(mean) over (partition by first order by last desc) as least from m), f as (select p, max(least) as fitted from l group by p)"


@query(f"{_MONOTONE} select d.k, round(fitted,6) as fitted from d join f on d.p = f.p")
def uq_isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correctness as a monotone function of the confidence, for each answer."""
    log = _log(spark, sf_dir)
    (steps,) = isotonic.fit_steps(log, F.col("p"), F.col("is_correct"))
    return log.select("k", r6(steps.value(F.col("p")), "fitted"))


_STEPPED = models.Averaged((models.Linear(("model_outcome_entropy_top_5",), (0.5,), (0.4,), (-1.0,), 0.0), models.Linear(("model_outcome_entropy_top_5",), (0.0,), (1.0,), (1.0,), 0.25)), (isotonic.Steps((-1.5, -0.5, 0.25, 1.0), (0.1, 0.3, 0.7, 0.9)), isotonic.Steps((0.75,), (0.6,))))
_STUMPS = boosting.Boosted(("model_logprob_gap", "model_max_softmax_prob"), ((-4.0, -1.5), (0.5, 0.8)), tuple(boosting.Tree(np.array([f, -1, -1], np.int32), np.array([b, 0, 0], np.int32), np.array([left, False, False]), np.array([0.0, low, high])) for f, b, left, low, high in ((0, 1, True, 0.75, -0.5), (1, 2, False, -0.25, 1.0))), boosting.Setting(trees=2, depth=1))
_S1 = "(-(least(greatest(model_outcome_entropy_top_5,-1e10),1e10)-0.5e0)/0.4e0)"
_STEPPED_SQL = f"(0.6e0 + case when s <= -1.5e0 then 0.1e0 when s < -0.5e0 then 0.1e0+0.2e0*(s+1.5e0) when s < 0.25e0 then 0.3e0+0.4e0*(s+0.5e0)/0.75e0 when s < 1e0 then 0.7e0+0.2e0*(s-0.25e0)/0.75e0 else 0.9e0 end)/2"
_STUMPS_SQL = "1e0/(1e0+exp(-(case when model_logprob_gap <= -4e0 then 0.75e0 else -0.5e0 end + case when model_max_softmax_prob <= 0.8e0 then -0.25e0 else 1e0 end)))"
_LINEAR_SQL = "1e0/(1e0+exp(-(1.5e0*(0.2e0-0.7e0*(model_outcome_entropy_top_5-0.5e0)/0.4e0+0.3e0*(model_logprob_gap+3e0)/2e0)-0.1e0)))"


@query(f"with d as (select *, {_S1} as s from ({features_sql()}) where {_REASON} = 'valid') " + " union all ".join(f"select '{kind}' as kind, k::varchar as content_id, round({sql},6) as meta_model_probability from d" for kind, sql in (("averaged", _STEPPED_SQL), ("boosted", _STUMPS_SQL), ("linear", _LINEAR_SQL))))
def uq_saved_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of each kind are saved, loaded, and score a file of records."""
    path = new_path(spark, "records.parquet")
    _scoring_records(spark, sf_dir).write.parquet(path)
    out = None
    for kind, model in (("averaged", _STEPPED), ("boosted", _STUMPS), ("linear", _LINEAR)):
        saved = new_path(spark, kind)
        save_metadata(spark, saved, model=model.to_json(), optimal_threshold=0.5)
        found = load_metadata(spark, saved)
        scored, _ = workloads.score_file(spark, path, models.model_from_json(found["model"]), found["optimal_threshold"])
        rows = scored.select(F.lit(kind).alias("kind"), "content_id", r6("meta_model_probability"))
        out = rows if out is None else out.unionByName(rows)
    return out


_FITTED = ["h", "g", "lgn"]


@query()
def uq_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid balancing, search of the ridge, calibration, and evaluation at 0.5 and the tuned threshold."""
    return workloads.experiment(_short(spark, sf_dir), "k", "y", _FITTED)[1]


@query()
def uq_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of results after hybrid balancing, ridges and boosted trees (five settings), best test_f1 first."""
    return workloads.all_experiments(_short(spark, sf_dir), "k", "y", _FITTED, n_iter=5)


@query()
def uq_ridge_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.search_ridge(staged(_short(spark, sf_dir), "features"), _FITTED, "y", "k")[1]


#: The first split of a tree by every feature, at fixed cuts.
_CUTS = {"h": [0.05 * i for i in range(1, 31)], "p1": [0.05 * i for i in range(5, 20)], "g": [0.05 * i for i in range(1, 20)], "lg": [0.25 * i for i in range(1, 40)], "lgn": [0.05 * i for i in range(1, 20)]}
_FIRST = boosting.Setting(positive_weight=0.5, alpha=0.75, l2=2.5, min_child=4.0)


def _first_split_sql(s: str) -> str:
    cuts = ", ".join(f"{c!r}::double" for c in _CUTS[s])
    row = f"select case when y = 1 then -0.25e0 else 0.5e0 end as g, case when y = 1 then 0.125e0 else 0.25e0 end as h, {s} as v from d"
    return f"""select '{s}' as feature, * from (
        with r as ({row}), t as (select sum(g) as g, sum(h) as h, coalesce(sum(g) filter (v is null), 0) as gn, coalesce(sum(h) filter (v is null), 0) as hn from r),
        c as (select cut, l.null_left, coalesce(sum(r.g) filter (v <= cut or (v is null and l.null_left)), 0) as gl, coalesce(sum(r.h) filter (v <= cut or (v is null and l.null_left)), 0) as hl
            from r, (select unnest([{cuts}]) as cut), (select unnest([false, true]) as null_left) l group by all),
        k as (select c.*, t.g - gl as gr, t.h - hl as hr, t.g, t.h from c, t where hl >= 4 and t.h - hl >= 4 and (not null_left or hn > 0)),
        z as (select *, pow(greatest(abs(gl) - 0.75, 0), 2) / (hl + 2.5) + pow(greatest(abs(gr) - 0.75, 0), 2) / (hr + 2.5) - pow(greatest(abs(g) - 0.75, 0), 2) / (h + 2.5) as gain from k)
        select round(gain, 5) as gain, round(cut, 6) as cut, null_left, round(-sign(gl) * greatest(abs(gl) - 0.75, 0) / (hl + 2.5), 6) as left_weight, round(-sign(gr) * greatest(abs(gr) - 0.75, 0) / (hr + 2.5), 6) as right_weight
        from z where gain > 1e-6 order by round(gain, 9) desc, cut, null_left limit 1)"""


@query(f"with d as ({_S}) " + " union all ".join(map(_first_split_sql, _CUTS)))
def uq_first_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains of the best first splits and the weights of their leaves, from sums by bin with a bin for nulls."""
    features, cuts = list(_CUTS), tuple(map(tuple, _CUTS.values()))
    table = boosting.binned_table(_short(spark, sf_dir), features, "y", "k", cuts)
    found = spark.createDataFrame(boosting.first_splits(table, features, cuts, _FIRST), "feature string, gain double, cut double, null_left boolean, left_weight double, right_weight double")
    return found.select("feature", F.round("gain", 5).alias("gain"), r6("cut"), "null_left", r6("left_weight"), r6("right_weight"))


_SCORED = f"""with d as (select p, k, is_correct as y, ((row_number() over (partition by is_correct order by md5('42:'||k), k)-1) % 3)::int as fold from ({_A})),
    s as (select 0 as config, fold, y, p as score from d union all select 1, fold, y, round(p, 1) from d),
    c as (select config, fold, score, sum(y)::double as pos, sum(1-y)::double as neg from s group by all),
    r as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by config, fold) as np, sum(neg) over (partition by config, fold) as nn from c window w as (partition by config, fold order by score desc)),
    k as (select config, fold, sum(neg*(tp-pos+pos/2))/any_value(np*nn) as roc_auc, sum(pos*tp/(tp+fp))/any_value(np) as average_precision, sum(neg*(nn-fp+neg)/(nn-fp+neg+np-tp+pos))/any_value(nn) as average_precision_neg from r group by all),
    m as (select config, fold, sum((y=1 and score>=0.5)::int)::double as tp, sum((y=0 and score>=0.5)::int)::double as fp, sum((y=0 and score<0.5)::int)::double as tn, sum((y=1 and score<0.5)::int)::double as fn from s group by all)
    select config, fold, round(roc_auc,6) as roc_auc, round(average_precision,6) as average_precision, round(average_precision_neg,6) as average_precision_neg, round(2*tp/(2*tp+fp+fn),6) as f1, round(coalesce(2*tn/nullif(2*tn+fp+fn,0),0),6) as f1_neg,
        round((2*tp/(2*tp+fp+fn)+coalesce(2*tn/nullif(2*tn+fp+fn,0),0))/2,6) as f1_macro, round((tp/(tp+fn)+tn/(tn+fp))/2,6) as balanced_accuracy, round(fp*{MISS}e0+tn*({REVIEW}e0-{MISS}e0)+fn*{REVIEW}e0,6) as cost from k join m using (config, fold)"""


@query(_SCORED)
def uq_search_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics that searches choose by, for each (setting, fold) at once; the second setting's scores tie."""
    parted = sampling.folds(_log(spark, sf_dir), "k", "is_correct", 3, 42)
    both = F.explode(F.array(F.struct(F.lit(0).alias("config"), F.col("p").alias("score")), F.struct(F.lit(1).alias("config"), F.round("p", 1).alias("score"))))
    scored = staged(parted.select("fold", F.col("is_correct").alias("y"), both.alias("o")).select("fold", "y", "o.*"), "scores")
    found = metrics.search_metrics(scored, ["config", "fold"], MISS, REVIEW)
    return found.select("config", "fold", *(r6(c) for c in ("roc_auc", "average_precision", "average_precision_neg", "f1", "f1_neg", "f1_macro", "balanced_accuracy", "cost")))


@query()
def uq_boosted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten random settings of 50 to 199 trees on all features, three folds, all metrics."""
    return models.search_boosted(staged(_features(spark, sf_dir).select("k", "is_correct", *FEATURES), "features"), list(FEATURES), "is_correct", "k", n_iter=10, k=3)[1]


@query()
def uq_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees grown on all training rows, a level at a time, score the test rows."""
    parted = staged(sampling.split(_features(spark, sf_dir).select("k", "is_correct", *FEATURES), "k", "is_correct"), "split")
    setting = boosting.Setting(trees=20, depth=3, step=0.2, subsample=0.9, columns=0.8, alpha=0.5, l2=2.0, gamma=0.01, min_child=3.0)
    model = models.fit_boosted(parted.filter("NOT is_test"), list(FEATURES), "is_correct", "k", setting)
    return parted.filter("is_test").select("k", r6(model.probability(), "probability"))
