"""Uncertainty features of one answer's token log probabilities, as column expressions.

The tokens' order counts: the first listed token is taken as the answer. Missing values are null, never NaN.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certus.functions.text import computed_once, finite, strip

ANSWERS = ("YES", "NO")
Extractor = Callable[[Column], dict[str, Column]]

_EPS = 1e-12


def answer_tokens(tokens: Column, answers: tuple[str, ...] = ANSWERS) -> Column:
    """The tokens that are answers, in their order."""
    return F.filter(tokens, lambda t: F.upper(strip(t["token"])).isin(*answers))


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, and not for each element of the arrays in ``f``."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def softmax(tokens: Column) -> Column:
    """Probabilities over the listed tokens; a missing logprob counts as probability 0, no token as [1.0].

    Where every logprob is missing the result holds nulls.
    """
    weights = lambda top: F.transform(tokens, lambda t: F.when(top.isNotNull(), F.coalesce(F.exp(t["logprob"] - top), F.lit(0.0))))
    shares = lambda e: _with(F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x), lambda total: F.transform(e, lambda x: F.try_divide(x, total)))
    probabilities = _with(F.array_max(F.transform(tokens, lambda t: t["logprob"])), lambda top: _with(weights(top), shares))
    return F.when(F.size(tokens) == 0, F.array(F.lit(1.0))).otherwise(probabilities)


def entropy(p: Column) -> Column:
    """Base 2; 0 * log 0 is 0."""
    return F.aggregate(p, F.lit(0.0), lambda acc, x: acc - F.when(x > 0, x * F.log2(F.greatest(x, F.lit(1e-300)))).when(x.isNull(), None).otherwise(F.lit(0.0)))


def entropy_features(tokens: Column, h: Column, suffix: str) -> dict[str, Column]:
    """Of the entropy h: itself, normalised entropy, effective choices and confidence; fewer than two tokens: 0, 0, 0 and 1."""
    n = F.size(tokens)
    few = n < 2
    normal = h / F.log2(F.greatest(n, F.lit(2)).cast("double"))
    pick = lambda value, default: F.when(few, F.lit(default)).otherwise(finite(value))
    return {
        f"model_outcome_entropy{suffix}": pick(h, 0.0),
        f"model_outcome_normalized_entropy{suffix}": pick(normal, 0.0),
        f"model_effective_choices{suffix}": pick(F.pow(F.lit(2.0), h), 0.0),
        f"model_confidence_score{suffix}": pick(1 - normal, 1.0),
    }


def confidence_features(tokens: Column, p: Column, suffix: str, top_always: bool) -> dict[str, Column]:
    """First token's probability, its gap to the second, that gap by it, and their ratio; few tokens: 1, 0, 0, 0."""
    few = F.size(tokens) < 2
    first, second = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    pick = lambda value: F.when(few, F.lit(0.0)).otherwise(finite(value))
    top = F.when(few, F.lit(1.0))
    return {
        f"model_max_softmax_prob{suffix}": top.otherwise(first) if top_always else top,
        f"model_p1_p2_gap{suffix}": pick(first - second),
        f"model_p1_p2_gap_normalized{suffix}": pick((first - second) / (first + _EPS)),
        f"model_confidence_ratio{suffix}": pick(first / (second + _EPS)),
    }


def logprob_gap_features(tokens: Column, suffix: str) -> dict[str, Column]:
    """Second logprob less the first, and that by the second; missing: 0 and 1."""
    lp1, lp2 = F.get(tokens, F.lit(0))["logprob"], F.get(tokens, F.lit(1))["logprob"]
    gap = lp2 - lp1
    return {f"model_logprob_gap{suffix}": F.coalesce(gap, F.lit(0.0)), f"model_logprob_gap_normalized{suffix}": F.coalesce(F.try_divide(gap, lp2), F.lit(1.0))}


def with_features(df: DataFrame, tokens_col: str = "top_logprobs", extra: list[Extractor] = ()) -> DataFrame:
    """``df`` with the 20 features of the token array, and those of ``extra`` extractors (later names win;
    one that raises is left out with a warning).

    A null array gives the values of no token to the features over all tokens, and null to those over answers.
    Token lists, softmaxes and entropies are made by generators, so that they are computed once, whatever filters follow.
    """
    tokens = F.col(tokens_col)
    given = computed_once(df, {"__all": F.coalesce(tokens, F.array().cast(df.schema[tokens_col].dataType)), "__answers": answer_tokens(tokens)})
    given = computed_once(given, {"__p_all": softmax(F.col("__all")), "__p_answers": softmax(F.col("__answers"))})
    given = computed_once(given, {"__h_all": entropy(F.col("__p_all")), "__h_answers": entropy(F.col("__p_answers"))})
    every, answers, p, q = (F.col(c) for c in ("__all", "__answers", "__p_all", "__p_answers"))
    features = entropy_features(every, F.col("__h_all"), "_top_5") | confidence_features(every, p, "", True) | logprob_gap_features(every, "")
    filtered = entropy_features(answers, F.col("__h_answers"), "_filtered") | confidence_features(answers, q, "_filtered", False) | logprob_gap_features(answers, "_filtered")
    features |= {k: F.when(answers.isNotNull(), v) for k, v in filtered.items()}
    for extract in extra:
        try:
            features |= extract(tokens)
        except Exception as error:  # the others' features are still wanted
            warnings.warn(f"an extractor was left out: {error!r}", stacklevel=2)
    return given.withColumns(features).drop("__all", "__answers", "__p_all", "__p_answers", "__h_all", "__h_answers")


def with_entry_features(df: DataFrame, entries_col: str = "logprobs_data", **how) -> DataFrame:
    """Features of the first entry; all null where there is no entry."""
    first = df.withColumn("__tokens", F.get(F.col(entries_col), F.lit(0))["top_logprobs"])
    done = with_features(first, "__tokens", **how)
    names = [c for c in done.columns if c not in first.columns]
    return done.withColumns({c: F.when(F.size(entries_col) > 0, F.col(c)) for c in names}).drop("__tokens")


#: Names of the features in their order.
FEATURES = (
    [f"model_{n}_top_5" for n in ("outcome_entropy", "outcome_normalized_entropy", "effective_choices", "confidence_score")]
    + [f"model_{n}" for n in ("max_softmax_prob", "p1_p2_gap", "p1_p2_gap_normalized", "confidence_ratio", "logprob_gap", "logprob_gap_normalized")]
    + [f"model_{n}_filtered" for n in ("outcome_entropy", "outcome_normalized_entropy", "effective_choices", "confidence_score", "max_softmax_prob", "p1_p2_gap", "p1_p2_gap_normalized", "confidence_ratio", "logprob_gap", "logprob_gap_normalized")]
)
