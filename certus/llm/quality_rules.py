"""Quality rules: a decision list learned from labelled texts by sequential covering.

Each round grows one conjunction of thresholds on text statistics by information gain on two thirds of the examples
that are left, prunes it on the other third, and keeps it if it is precise there. The list is emitted as an ordered
``when`` expression, so applying it is one narrow projection.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labelled rows that training takes at most, about (a bounded sample by hash of the id).
MAX_LABELLED = 20_000

_COUNTS = {
    "n_words": "bigint",
    "word_chars": "bigint",
    "n_symbols": "bigint",
    "n_dup_lines": "bigint",
    "n_repeat_words": "bigint",
    "n_lines": "bigint",
    "n_distinct_words": "bigint",
    "n_upper": "bigint",
    "n_digits": "bigint",
    "n_marks": "bigint",
    "n_end_marks": "bigint",
}
_STRUCT = "struct<" + ",".join(f"{k}:{v}" for k, v in _COUNTS.items()) + ">"
_SPACE = np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_MARKS = np.array([c for c in range(33, 127) if not chr(c).isalnum()])


def _repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    repeated = np.fromiter((found[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(windows)] |= repeated
    return int(covered.sum())


def _counts(text: str | None) -> tuple[int, ...]:
    data = (text or "").encode()
    words = data.split()  # of bytes: blank, tab, \n, \v, \f and \r only
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    code_points = len(data) - int(by_byte[0x80:0xC0].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words),
        code_points - int(by_byte[_SPACE].sum()),
        int(by_byte[_SYMBOLS].sum()),
        len(lines) - len(set(lines)),
        _repeat_words(words),
        len(lines),
        len(set(words)),
        int(by_byte[65:91].sum()),
        int(by_byte[48:58].sum()),
        int(by_byte[_MARKS].sum()),
        int(by_byte[[33, 46, 63]].sum()),
    )


def text_counts(text: Column) -> Column:
    """Struct of counts of a whole text; all 0 for null and empty texts."""

    @F.arrow_udf(_STRUCT)
    def counts(texts: pa.Array) -> pa.Array:
        columns = list(zip(*map(_counts, texts.to_pylist()))) or [()] * len(_COUNTS)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(_COUNTS))

    # non-deterministic for the optimizer only: it must not run the function twice to push a filter down
    return counts.asNondeterministic()(text)


def features(s: str) -> dict[str, Column]:
    """The statistics that rules may test, from the struct column ``s``."""
    c = {k: F.col(f"{s}.{k}").cast("double") for k in _COUNTS}
    per = lambda a, b: a / F.greatest(b, F.lit(1.0))
    return {
        "mean_word_chars": per(c["word_chars"], c["n_words"]),
        "symbols_per_word": per(c["n_symbols"], c["n_words"]),
        "dup_lines_per_line": per(c["n_dup_lines"], c["n_lines"]),
        "repeat_words_per_word": per(c["n_repeat_words"], c["n_words"]),
        "distinct_per_word": per(c["n_distinct_words"], c["n_words"]),
        "upper_per_char": per(c["n_upper"], c["word_chars"]),
        "digits_per_char": per(c["n_digits"], c["word_chars"]),
        "marks_per_word": per(c["n_marks"], c["n_words"]),
        "end_marks_per_word": per(c["n_end_marks"], c["n_words"]),
        "words_per_line": per(c["n_words"], c["n_lines"]),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, values: dict[str, Column]) -> Column:
        return values[self.feature] > self.threshold if self.above else values[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _matches(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for c in rule:
        v = x[:, names.index(c.feature)]
        hit &= v > c.threshold if c.above else v <= c.threshold
    return hit


def _best_condition(x: np.ndarray, y: np.ndarray, names: list[str], bins: int) -> tuple[float, Condition | None]:
    """The threshold with the largest information gain for class 1, and that gain."""
    pos, total = y.sum(), len(y)
    base = np.log2(pos / total)
    best, found = 1e-9, None
    for j, name in enumerate(names):
        cuts = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]))
        order = np.argsort(x[:, j], kind="stable")
        v, cum = x[order, j], np.r_[0, np.cumsum(y[order])]
        n_low = np.searchsorted(v, cuts, side="right")
        p_low = cum[n_low]
        for above, p, n in ((False, p_low, n_low), (True, pos - p_low, total - n_low)):
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(n, 1)) - base), -1.0)
            k = int(gain.argmax()) if len(gain) else -1
            if k >= 0 and gain[k] > best and n[k] < total:
                halfway = (float(cuts[k]) + float(v[min(n_low[k], total - 1)])) / 2  # between the values on either side
                best, found = float(gain[k]), Condition(name, above, halfway)
    return best, found


def learn_rules(x: np.ndarray, y: np.ndarray, names: list[str], min_precision: float = 0.95, min_rows: int = 5, max_rules: int = 12, max_conditions: int = 4, bins: int = 64, seed: int = 7) -> list[Rule]:
    """Ordered conjunctions that find class 1. x: rows by features, without NaN. y: 0 or 1.

    One class only, or too few rows: no rules. The same input gives the same rules.
    """
    rules: list[Rule] = []
    rng = np.random.default_rng(seed)
    x, y = np.asarray(x, float).reshape(-1, len(names)), np.asarray(y, int)
    while len(rules) < max_rules and y.sum() >= min_rows and y.sum() < len(y):
        grow = rng.random(len(y)) < 2 / 3
        gx, gy = x[grow], y[grow]
        rule: Rule = ()
        inside = np.ones(len(gy), bool)
        while len(rule) < max_conditions and 0 < gy[inside].sum() < inside.sum():
            _, condition = _best_condition(gx[inside], gy[inside], names, bins)
            if condition is None:
                break
            rule += (condition,)
            inside = _matches(rule, gx, names)
        if not rule:
            break
        px, py = x[~grow], y[~grow]

        def worth(r: Rule) -> float:
            hit = _matches(r, px, names)
            return (2 * py[hit].sum() - hit.sum()) / max(1, hit.sum())

        rule = max((rule[:n] for n in range(1, len(rule) + 1)), key=worth)  # the shortest of equally good ones
        hit, held = _matches(rule, x, names), _matches(rule, px, names)
        if y[hit].sum() < min_rows or y[hit].mean() < min_precision or (held.any() and py[held].mean() < min_precision):
            break
        rules.append(rule)
        x, y = x[~hit], y[~hit]
    return rules


def rule_number(rules: list[Rule], values: dict[str, Column]) -> Column:
    """Number (from 1) of the first rule that holds, as one ordered conditional expression; 0 if none does."""
    out = F.lit(0)
    for n, rule in reversed(list(enumerate(rules, 1))):
        test = F.lit(True)
        for c in rule:
            test = test & c.column(values)
        out = F.when(test, F.lit(n)).otherwise(out)
    return out


def base_failed(s: str) -> Column:
    """Fewer than 50 words, or more than half of the words in repeated 3-word windows."""
    return (F.col(f"{s}.n_words") < 50) | (100 * F.col(f"{s}.n_repeat_words") > 50 * F.col(f"{s}.n_words"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED, **how) -> list[Rule]:
    """Learn rules that find documents labelled 0 among those that pass the base test.

    labels: (id, label 0 or 1); null ids and labels are left out, and an id with several labels has the smallest. About
    ``max_labelled`` labelled ids are sampled by hash if there are more; their texts are read whole, two of an id that has
    several. No usable label: no rules.
    """
    usable = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label")).filter("__id IS NOT NULL AND __label IN (0, 1)").groupBy("__id").agg(F.min("__label").alias("__label"))
    n = usable.count()
    if n > max_labelled:
        # a share of 63 bits never rounds to nothing
        usable = usable.filter(F.shiftrightunsigned(F.xxhash64("__id"), 1).cast("double") < F.lit(max_labelled / n * float(1 << 63)))
    # at most about max_labelled ids, 16 bytes each
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(usable), "__id")
    turn = F.row_number().over(Window.partitionBy("__id").orderBy(F.xxhash64("__text"), "__text"))
    sample = sample.withColumn("__turn", turn).filter("__turn <= 2")
    counted = sample.select("__id", "__label", text_counts(F.col("__text")).alias("__s")).filter(~base_failed("__s"))
    values = features("__s")
    rows = counted.select("__id", "__label", *(v.alias(k) for k, v in values.items())).toPandas()  # about 2 * max_labelled rows at most
    rows = rows.sort_values([*rows.columns], kind="stable")
    return learn_rules(rows[list(values)].to_numpy(float), 1 - rows["__label"].to_numpy(int), list(values), **how)


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text", prefix: str = "__quality") -> DataFrame:
    """``docs`` with columns ``{prefix}_counts`` (struct), ``_base_failed``, ``_rule`` (0: none) and ``_kept``.

    Every row is judged, repeated rows too; null and empty texts fail the base test. Columns of those names are replaced.
    """
    counts = f"{prefix}_counts"
    return docs.withColumn(counts, text_counts(F.col(text_col))).withColumns({f"{prefix}_base_failed": base_failed(counts), f"{prefix}_rule": rule_number(rules, features(counts))}).withColumn(f"{prefix}_kept", ~F.col(f"{prefix}_base_failed") & (F.col(f"{prefix}_rule") == 0))
