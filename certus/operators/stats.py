"""Statistics of feature columns: one pass over the data for all columns, long results of a few rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certus.functions.text import finite
from certus.operators.order import quantiles


def constant_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with one value or none besides null."""
    row = df.agg(*(F.equal_null(F.min(c), F.max(c)).alias(c) for c in columns)).first()
    return [c for c in columns if row[c]]


def cleaned(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Rows with a target, and null for non-finite values."""
    return df.filter(F.col(target).isNotNull()).withColumns({c: finite(F.col(c)) for c in columns})


def missing_report(df: DataFrame, columns: list[str], most: float = 0.5) -> DataFrame:
    """(feature, null_rate, high_missing) in one pass."""
    rates = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    return _long(rates, columns, lambda c: {"null_rate": F.col(c)}).withColumn("high_missing", (F.col("null_rate") > most).cast("int"))


def usable_features(df: DataFrame, least: int = 10) -> list[str]:
    """Numeric columns with at least so many values."""
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    row = df.agg(*(F.count(c).alias(c) for c in numeric)).first()
    return [c for c in numeric if row[c] >= least]


def _long(one_row: DataFrame, columns: list[str], fields) -> DataFrame:
    """One row for each feature out of a single wide row."""
    options = F.array(*(F.struct(F.lit(c).alias("feature"), *(v.alias(k) for k, v in fields(c).items())) for c in columns))
    return one_row.select(F.explode(options).alias("o")).select("o.*")


def feature_statistics(df: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    """count, mean, std, extremes, quartiles, biased skewness and excess kurtosis, cv and share of values of each feature.

    exact: interpolated quartiles by rounds of brackets (``order.quantiles``); else approximate ones in the same pass.
    """
    shares = [0.25, 0.5, 0.75]
    known = quantiles(df, columns, shares) if exact else {}
    quart = lambda c: F.percentile_approx(c, F.array(*map(F.lit, shares)), 10_000)
    aggs: list[Column] = [F.count("*").alias("__n")]
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"), F.skewness(x).alias(f"{c}__skewness"), F.kurtosis(x).alias(f"{c}__kurtosis")]
        if not exact:
            aggs.append(quart(x).alias(f"{c}__q"))
    wide = df.agg(*aggs)

    def fields(c: str) -> dict[str, Column]:
        g = lambda n: F.col(f"{c}__{n}")
        q = lambda i: F.lit(known[c][i]).cast("double") if exact else F.get(g("q"), F.lit(i))
        return {"count": g("count"), "mean": g("mean"), "std": g("std"), "min": g("min"), "max": g("max"), "median": q(1), "q25": q(0), "q75": q(2), "skewness": g("skewness"), "kurtosis": g("kurtosis"), "cv": F.when(g("mean") == 0, float("inf")).otherwise(F.try_divide(g("std"), g("mean"))), "non_null_pct": F.try_divide(100.0 * g("count"), F.col("__n"))}

    return _long(wide, columns, fields)


def _means(df: DataFrame, columns: list[str]) -> dict[str, float]:
    row = df.agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in columns)).first()
    return {c: row[c] or 0.0 for c in columns}


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(f1, f2, n, r) of each pair in column order, over rows with both values; null where one is constant.

    All pairs' sums come from one aggregation, centred by the means of a pass before it.
    """
    mean = _means(df, columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    schema = "f1 string, f2 string, n bigint, r double"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    aggs = []
    for k, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x = F.when(both, F.col(a).cast("double") - mean[a])
        y = F.when(both, F.col(b).cast("double") - mean[b])
        aggs.append(F.struct(F.count(x).alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy")).alias(f"p{k}"))
    s = F.col("o.s")
    cov, vx, vy = s["xy"] - s["x"] * s["y"] / F.greatest(s["n"], F.lit(1)), s["xx"] - s["x"] * s["x"] / F.greatest(s["n"], F.lit(1)), s["yy"] - s["y"] * s["y"] / F.greatest(s["n"], F.lit(1))
    tiny = 1e-18
    r = F.when((vx > tiny) & (vy > tiny), cov / F.sqrt(vx) / F.sqrt(vy))
    options = F.array(*(F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(f"p{k}").alias("s")) for k, (a, b) in enumerate(pairs)))
    return df.agg(*aggs).select(F.explode(options).alias("o")).select("o.f1", "o.f2", s["n"].alias("n"), r.alias("r"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def pearson_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation of n pairs; None where it has none."""
    if r is None or n < 3:
        return None
    return incomplete_beta((n - 2) / 2, 0.5, max(0.0, 1 - r * r))


def target_correlations(df: DataFrame, columns: list[str], target: str, alpha: float = 0.05) -> DataFrame:
    """(feature, n, r, p, significant) with the target; no value where r isn't defined. The p of a few scalars."""
    mean = _means(df, [*columns, target])
    aggs = []
    for c in columns:
        both = F.col(c).isNotNull() & F.col(target).isNotNull()
        x, y = F.when(both, F.col(c).cast("double") - mean[c]), F.when(both, F.col(target).cast("double") - mean[target])
        aggs.append(F.struct(F.count(x).alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy")).alias(c))
    row = df.agg(*aggs).first()
    out = []
    for c in columns:
        s = row[c]
        r = None
        if s["n"] >= 2:
            vx, vy = s["xx"] - s["x"] ** 2 / s["n"], s["yy"] - s["y"] ** 2 / s["n"]
            r = (s["xy"] - s["x"] * s["y"] / s["n"]) / math.sqrt(vx) / math.sqrt(vy) if vx > 1e-18 and vy > 1e-18 else None
        p = pearson_p(r, s["n"])
        out.append((c, s["n"], r, p, int(p is not None and p < alpha)))
    return df.sparkSession.createDataFrame(out, "feature string, n bigint, r double, p double, significant int")


def top_by_correlation(correlated: DataFrame, n: int = 18) -> DataFrame:
    """The n features with the largest |r|; no r counts as 0."""
    return correlated.orderBy(F.abs(F.coalesce("r", F.lit(0.0))).desc(), "feature").limit(n)


def collinear_pairs(correlation: DataFrame, threshold: float = 0.9) -> DataFrame:
    return correlation.filter(F.abs("r") > threshold)


def drop_collinear(pairs: list[tuple[str, str]], target_r: dict[str, float | None]) -> list[str]:
    """Features to drop, going through the pairs in column order: of two that are left, the one with the lower |r| to
    the target goes; the first of them if equal or unknown."""
    gone: list[str] = []
    for a, b in pairs:
        if a in gone or b in gone:
            continue
        ra, rb = target_r.get(a), target_r.get(b)
        gone.append(b if ra is not None and rb is not None and abs(ra) > abs(rb) else a)
    return gone


def class_histograms(df: DataFrame, columns: list[str], target: str, bins: int = 20) -> DataFrame:
    """(feature, y, bin, n, density): equal bins over each class's own range; a constant's range is widened by 0.5.

    Pre-aggregated by feature, class and bin before the shuffle.
    """
    long = df.filter(F.col(target).isNotNull()).select(F.col(target).alias("y"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns))).alias("o")).select("y", "o.*").filter("v IS NOT NULL")
    edges = long.groupBy("feature", "y").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("total"))
    edges = edges.withColumns({"lo": F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")), "hi": F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi"))})
    placed = long.join(F.broadcast(edges), ["feature", "y"])  # a row for each feature and class
    bin_ = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    counted = placed.groupBy("feature", "y", bin_.alias("bin"), "lo", "hi", "total").agg(F.count("*").alias("n"))
    return counted.select("feature", "y", "bin", "n", (F.col("n") * bins / F.col("total") / (F.col("hi") - F.col("lo"))).alias("density"))


def mutual_information(df: DataFrame, columns: list[str], target: str, bins: int = 10) -> DataFrame:
    """(feature, mi) in nats between equal-width bins of a feature and the target, over rows with both."""
    long = df.filter(F.col(target).isNotNull()).select(F.col(target).alias("y"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns))).alias("o")).select("y", "o.*").filter("v IS NOT NULL")
    edges = long.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    placed = long.join(F.broadcast(edges), "feature")  # a row for each feature
    bin_ = F.coalesce(F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int"), F.lit(0))
    joint = placed.groupBy("feature", bin_.alias("bin"), "y").agg(F.count("*").alias("n"))
    by_bin = joint.groupBy("feature", "bin").agg(F.sum("n").alias("nb"))
    by_y = joint.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    all_ = joint.groupBy("feature").agg(F.sum("n").alias("nn"))
    j = joint.join(by_bin, ["feature", "bin"]).join(by_y, ["feature", "y"]).join(all_, "feature")
    n, nn = F.col("n").cast("double"), F.col("nn").cast("double")
    return j.groupBy("feature").agg(F.sum(n / nn * F.ln(n * nn / (F.col("nb") * F.col("ny")))).alias("mi"))
