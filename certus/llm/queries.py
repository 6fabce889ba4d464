"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certus.llm import bpe, collocations, fill_middle, fingerprints, lm_scoring, mixing, near_dup, packing, quality_rules, substring_dedup, token_counts, toxicity, url_filter
from certus.llm.url_filter import UrlRule


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [
    UrlRule(True, "org", "/"),
    UrlRule(False, "example.org", "/es/"),
    UrlRule(False, "example.org", "/en/1"),
    UrlRule(True, "com", "/fr/"),
    UrlRule(False, "com", "/de/"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.fit(pages, URL_RULES), URL_RULES, keep=["page_id"])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, _table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(docs, rules)
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(
        "doc_id",
        *(F.col(f"__quality_counts.{c}").alias(c) for c in base),
        F.col("__quality_base_failed").alias("base_failed"),
        F.col("__quality_kept").alias("kept"),
        F.col("__quality_rule").alias("rule"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5)
    # one row for each source
    return mix.taken().join(F.broadcast(mix.source_rows()), "source_number").select("doc_id", "size", "source_size", "target", "taken")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))
    near = made.withColumns({
        "near_edited": fingerprints.likeness(F.col("fingerprint"), F.col("edited_fingerprint")),
        "near_next": fingerprints.likeness(F.col("fingerprint"), F.col("next_fingerprint")),
    })
    digests = near.withColumns({c: fingerprints.digest(F.col(c)) for c in ("fingerprint", "edited_fingerprint")})
    return digests.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), size=4, percent=80).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = bpe.encode_documents(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(remainder == 2, F.lit(True)).alias("held_out"))
    return lm_scoring.score_documents(docs, ~F.col("held_out"), keep=["held_out"])


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = token_counts.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer, public_tokenizers.PATTERN)
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), size=50)
    return cleaned.select(
        "doc_id",
        F.col("__dedup_n_words").alias("n_words"),
        F.col("__dedup_n_removed").alias("n_removed"),
        F.sha2("__dedup_kept", 256).alias("kept_sha256"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    docs = _table(spark, sf_dir, "documents")
    net = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~held_out)
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.toxicity(F.col("text"), net).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = fill_middle.rearrange_documents(_table(spark, sf_dir, "documents"), seed=42, rate=50, spm=80)
    return moved.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(_table(spark, sf_dir, "documents"), longest=4, least=30, most=2000, share=80)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = packing.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer, end=1, capacity=2048)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_quality_rules": op2_quality_rules,
    "op3_mixing": op3_mixing,
    "op4_fingerprints": op4_fingerprints,
    "op5_near_dup": op5_near_dup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_token_counts": op8_token_counts,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_fill_middle": op11_fill_middle,
    "op12_collocations": op12_collocations,
    "op13_packing": op13_packing,
}

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_PHRASE = "array_to_string(w[{i} : {j}], ' ')"

#: DuckDB SQL where SQL can say the same. The other operators learn, draw or merge; they are tested against brute force,
#: public libraries or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op5_near_dup": f"""
        with recursive w as (select doc_id, {_WORDS.format(text=_LOWER)} as ws from documents),
        s as (select distinct doc_id, array_to_string(ws[i : i + 3], ' ') as shingle from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) as i from w where len(ws) > 0)),
        n as (select doc_id, count(*) as n from s group by doc_id),
        p as (select x.doc_id as a, y.doc_id as b, count(*) as common from s x join s y on x.shingle = y.shingle and x.doc_id < y.doc_id group by all),
        l as (select a, b from p join n x on p.a = x.doc_id join n y on p.b = y.doc_id where 100 * common >= 80 * (x.n + y.n - common)),
        e as (select a, b from l union all select b, a from l),
        r(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, e.b from r join e on r.other = e.a)
        select r.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(other) as component_id, r.doc_id = min(other) as kept from r left join n on r.doc_id = n.doc_id group by r.doc_id""",
    "op9_substring_dedup": f"""
        with w as (select doc_id, {_WORDS.format(text="coalesce(text, '')")} as ws from documents),
        x as (select doc_id, i, array_to_string(ws[i : i + 49], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w where len(ws) >= 50)),
        f as (select k, min(doc_id) as first_doc from x group by k),
        g as (select doc_id, list_distinct(flatten(list(range(i, i + 50)))) as gone from x join f on x.k = f.k where x.doc_id > f.first_doc group by doc_id),
        j as (select w.doc_id, ws, coalesce(gone, []) as gone from w left join g on w.doc_id = g.doc_id)
        select doc_id, len(ws)::bigint as n_words, len(gone)::bigint as n_removed, sha256(coalesce(array_to_string(list_filter(ws, lambda word, i: not list_contains(gone, i)), ' '), '')) as kept_sha256 from j""",
    "op11_fill_middle": r"""
        with t as (select doc_id, coalesce(text, '') as x, sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
        u as (select *, regexp_extract_all(x, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::bigint) as d from t),
        c as (select *, len(u) as n, least(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) as a, greatest(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) as b from u),
        p as (select *, array_to_string(u[1 : a], '') as p, array_to_string(u[a + 1 : b], '') as m, array_to_string(u[b + 1 :], '') as s,
            case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or d[3] % 100 >= 50 then 'plain' when d[4] % 100 < 80 then 'spm' else 'psm' end as form from c)
        select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end::bigint as prefix_chars, case when form <> 'plain' then length(m) end::bigint as middle_chars,
            sha256(case form when 'plain' then x when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(x) as restored_sha256 from p""",
    "op12_collocations": f"""
        with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
        ws as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
        x as (select lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: {_PHRASE.format(i="i", j="i + size - 1")})) as phrase from ws, (select unnest([1, 2, 3, 4]) as size) where len(w) >= size),
        f as (select lang, size, phrase, count(*) as a from x group by all),
        totals as (select lang, sum(a)::bigint as n from f where size = 1 group by lang),
        g as (select * from f where a >= 30),
        c as (select *, string_split(phrase, ' ') as w from g where size > 1),
        inner_of as (select lang, unnest(list_transform(range(1, size - k + 2), lambda i: {_PHRASE.format(i="i", j="i + k - 1")})) as phrase, a as longer from c, (select unnest([2, 3]) as k) where k < size),
        covering as (select lang, phrase, max(longer) as longer from inner_of group by all),
        kept as (select c.* from c left join covering v on c.lang = v.lang and c.phrase = v.phrase where longer is null or 100 * longer::hugeint < 80 * c.a::hugeint),
        cuts as (select lang, size, phrase, a, k, {_PHRASE.format(i="1", j="k")} as head, {_PHRASE.format(i="k + 1", j="size")} as tail from kept, (select unnest([1, 2, 3]) as k) where k < size),
        scored as (select cuts.lang, cuts.phrase, cuts.a, k, x.a as l, y.a as r, (2000000 * cuts.a::hugeint // (x.a + y.a)::hugeint)::bigint as score
            from cuts join g x on cuts.lang = x.lang and cuts.head = x.phrase join g y on cuts.lang = y.lang and cuts.tail = y.phrase),
        best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
        select b.lang, row_number() over (partition by b.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from best b join totals t on b.lang = t.lang qualify rank <= 2000""",
}
