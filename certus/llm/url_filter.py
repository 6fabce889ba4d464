"""URL filters: rules on host and path, and boosted trees on lexical features for the urls that no rule decides.

The rules label the urls that they fit; the trees learn from those labels and judge the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certus.plans.staging import staged

#: Labelled urls that training takes at most, about (a bounded sample by hash of the url).
MAX_LABELLED = 20_000
#: Parts of the labelled urls; a training url's statistics come from the other parts.
PARTS = 5
#: Labels that a suffix or path segment without any counts as having, at the mean share of blocks.
_PRIOR = 10


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and its subdomains where the url's path starts with ``path``."""

    allow: bool
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or url."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://`` or url."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*((?:/[^?#]*)?)", 1), F.lit(""))


def first_rule(host: Column, path: Column, rules: list[UrlRule]) -> tuple[Column, Column]:
    """Text and verdict (boolean) of the longest rule that fits, null if none does; of equally long ones the first."""
    text, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for rule in reversed(sorted(rules, key=lambda r: -len(r.text))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, allow = F.when(fits, F.lit(rule.text)).otherwise(text), F.when(fits, F.lit(rule.allow)).otherwise(allow)
    return text, allow


def _entropy(text: Column) -> Column:
    """Bits per character. A character's count is what the text gets shorter by without it."""
    n = F.char_length(text)
    times = lambda c: F.greatest(n - F.char_length(F.replace(text, c, F.lit(""))), F.lit(1))
    characters = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    bits = F.aggregate(characters, F.lit(0.0), lambda acc, c: acc + times(c) / n * F.log2(n / times(c)))
    return F.when(n > 0, bits).otherwise(F.lit(0.0))


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Doubles from the url's characters alone; a null url counts as empty."""
    url = F.coalesce(url, F.lit(""))
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    length = F.char_length(url).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return {
        "length": length,
        "host_length": F.char_length(host).cast("double"),
        "path_length": F.char_length(path).cast("double"),
        "depth": count(path, "/[^/]"),
        "host_labels": count(host, r"[^.]+"),
        "digit_ratio": count(url, "[0-9]") / F.greatest(length, F.lit(1.0)),
        "host_digits": count(host, "[0-9]"),
        "hyphens": count(url, "-"),
        "host_hyphens": count(host, "-"),
        "entropy": _entropy(url),
        "host_entropy": _entropy(host),
        "parameters": count(query, r"[^&]+"),
        "query_length": F.char_length(query).cast("double"),
        "fragment": F.contains(url, F.lit("#")).cast("double"),
        "secure": url.startswith("https://").cast("double"),
    }


def _suffix(host: Column) -> Column:
    """The host's last two labels."""
    return F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1)


def _segment(path: Column) -> Column:
    """The path's first segment."""
    return F.regexp_extract(path, "^/([^/]*)", 1)


#: What statistics are kept of.
_KINDS = {"suffix": (_suffix, "__host"), "segment": (_segment, "__path")}


@dataclass
class UrlModel:
    """Fitted trees with the statistics of host suffixes and path segments, or one verdict where the labels have one class
    or none."""

    assembler: VectorAssembler | None
    trees: object | None
    statistics: dict[str, DataFrame] | None
    prior_block: float

    def _with_features(self, urls: DataFrame, part: Column | None = None) -> DataFrame:
        """``urls`` with the statistics; of labels outside ``part``, if given. A value without labels has the prior.

        The tables have a row for each suffix or segment, so the engine broadcasts them by their size or shuffles.
        """
        for kind, table in self.statistics.items():
            urls = urls.join(table.withColumnsRenamed({"n": "__n", "b": "__b", "parts": "__parts"}), f"__{kind}", "left")
            n, b = (F.coalesce(f"__{c}", F.lit(0)) for c in "nb")
            if part is not None:
                own = F.try_element_at("__parts", part)
                n, b = n - F.coalesce(own["n"], F.lit(0)), b - F.coalesce(own["b"], F.lit(0))
            urls = urls.withColumns({f"__{kind}_log_count": F.log1p(n), f"__{kind}_block": (b + _PRIOR * self.prior_block) / (n + _PRIOR)}).drop("__n", "__b", "__parts")
        return urls


def _prepared(urls: DataFrame, url_col: str, rules: list[UrlRule]) -> DataFrame:
    """``urls`` with helper columns that start with two underscores."""
    url = F.col(url_col)
    parts = urls.withColumns({"__host": url_host(url), "__path": url_path(url)})
    text, allow = first_rule(F.col("__host"), F.col("__path"), rules)
    numbers = lexical_features(url, F.col("__host"), F.col("__path"))
    return parts.withColumns({"__rule": text, "__rule_allow": allow, **{f"__{k}": of(F.col(c)) for k, (of, c) in _KINDS.items()}, **{f"__f_{k}": v for k, v in numbers.items()}})


def _statistics(labelled: DataFrame, kind: str) -> DataFrame:
    """(value of the kind, labels n, blocks b, parts: a map from part to its n and b) over all labelled urls."""
    by_part = labelled.groupBy(f"__{kind}", "__part").agg(F.count("*").alias("n"), F.sum("label").cast("bigint").alias("b"))
    pairs = F.map_from_entries(F.collect_list(F.struct("__part", F.struct("n", "b"))))  # PARTS at most
    return staged(by_part.groupBy(f"__{kind}").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), pairs.alias("parts")), f"url-{kind}")


def fit(urls: DataFrame, rules: list[UrlRule], url_col: str = "url", max_labelled: int = MAX_LABELLED, trees: int = 20, depth: int = 4, seed: int = 11) -> UrlModel:
    """Fit on the urls that a rule decides.

    Statistics count all of them, each distinct url once; the trees learn from about ``max_labelled``, sampled by hash. A
    url's own label, and those of its part, stay out of the statistics that the trees see with it.
    """
    url = F.col(url_col)
    text, allow = first_rule(url_host(url), url_path(url), rules)
    once = urls.select(url.alias("url"), allow.alias("allow")).filter("allow IS NOT NULL").groupBy("url").agg(F.first("allow").alias("allow"))
    place = F.xxhash64("url")
    parts = once.select("url", (~F.col("allow")).cast("int").alias("label"), url_host(F.col("url")).alias("__host"), url_path(F.col("url")).alias("__path"), F.pmod(place, F.lit(PARTS)).cast("int").alias("__part"))
    labelled = staged(parts.select("url", "label", "__part", *(of(F.col(c)).alias(f"__{k}") for k, (of, c) in _KINDS.items())), "url-labels")
    by_class = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n, blocked = sum(by_class.values()), by_class.get(1, 0)
    if len(by_class) < 2:
        return UrlModel(None, None, None, 1.0 if blocked else 0.0)
    sample = labelled.select("url", "label", "__part")
    if n > max_labelled:
        # another hash than the parts'; a share of 63 bits never rounds to nothing
        sample = sample.filter(F.shiftrightunsigned(F.xxhash64("url", F.lit(seed)), 1).cast("double") < F.lit(max_labelled / n * float(1 << 63)))
    sample = staged(_prepared(sample, "url", rules), "url-sample")
    names = [c for c in sample.columns if c.startswith("__f_")] + [f"__{k}_{s}" for k in _KINDS for s in ("log_count", "block")]
    model = UrlModel(VectorAssembler(inputCols=names, outputCol="__features"), None, {k: _statistics(labelled, k) for k in _KINDS}, blocked / n)
    ready = model.assembler.transform(model._with_features(sample, F.col("__part")))
    if len(ready.select("label").distinct().collect()) < 2:
        return UrlModel(None, None, None, float(round(blocked / n)))
    gbt = GBTClassifier(featuresCol="__features", labelCol="label", maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.2, seed=seed)
    model.trees = gbt.fit(ready)
    return model


def judge(urls: DataFrame, model: UrlModel, rules: list[UrlRule], url_col: str = "url", keep: list[str] = ()) -> DataFrame:
    """(columns in ``keep``, host, path, rule, verdict, block_score) for each row of ``urls``, repeated rows included.

    The longest rule that fits decides; else block_score, the trees' probability of a block, from 0.5 on. Null, empty
    and malformed urls have empty host and path and are judged by the trees. Other columns are ignored.
    """
    picked = urls.select(F.col(url_col).alias("__url"), *(F.col(c).alias(f"__keep_{c}") for c in keep))
    ready = _prepared(picked, "__url", rules)
    if model.trees is None:
        scored = ready.withColumn("block_score", F.lit(float(model.prior_block)))
    else:
        # an url that a rule decides may have been learned from: its own label stays out of its score, as it did then
        part = F.when(F.col("__rule").isNotNull(), F.pmod(F.xxhash64("__url"), F.lit(PARTS)).cast("int"))
        scored = model.trees.transform(model.assembler.transform(model._with_features(ready, part)))
        scored = scored.withColumn("block_score", vector_to_array("probability")[1])
    allowed = F.coalesce(F.col("__rule_allow"), F.col("block_score") < 0.5)
    return scored.select(*(F.col(f"__keep_{c}").alias(c) for c in keep), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.when(allowed, "allow").otherwise("block").alias("verdict"), "block_score")
