"""Document fingerprints: a homomorphic hash of a text's multiset of paragraphs, in DataFrame functions only.

A text's paragraphs (lines; one of more than 16 words counts in pieces of 16, from its start) are hashed to vectors of
128 lanes with 16-bit entries, and the vectors are added lane by lane modulo 2^30. The sum doesn't depend on the
paragraphs' order; adding or subtracting a paragraph's vector inserts or deletes it. As the entries, centred, behave
like random projections, the cosine of two sums estimates how much of the texts is shared (its error is about 0.09).
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 64-bit words of a fingerprint; each holds two lanes of 30 bits, with room for a carry above each.
WORDS = 64
#: A piece ends with its line, or after 16 words of it.
_PIECE = r"(?:[^ \n]* ){0,15}[^ \n]*[ \n]"
_ENTRIES = 0x0000FFFF0000FFFF
_LANES = 0x3FFFFFFF3FFFFFFF
_LANE = 0x3FFFFFFF
_CENTRE = 32768  # of a 16-bit entry
_HALF = 1 << 29


def paragraphs(text: Column) -> Column:
    """Array of a text's paragraphs or their pieces; a null text counts as empty, which has one empty paragraph."""
    return F.regexp_extract_all(F.concat(F.coalesce(text, F.lit("")), F.lit("\n")), F.lit(_PIECE), 0)


def multiset_hash(items: Column, words: int = WORDS) -> Column:
    """array<bigint> of an array<bigint> of items' hashes: the number of items, then the words of the summed vectors."""
    start = F.lit(0).cast("bigint")
    add = lambda k: lambda acc, h: (acc + F.xxhash64(h, k).bitwiseAND(F.lit(_ENTRIES))).bitwiseAND(F.lit(_LANES))
    sums = F.transform(F.sequence(F.lit(1), F.lit(words)), lambda k: F.aggregate(items, start, add(k)))
    return F.concat(F.array(F.size(items).cast("bigint")), sums)


def with_fingerprint(df: DataFrame, text_col: str, out: str, words: int = WORDS) -> DataFrame:
    """``df`` with the fingerprint (array<bigint>) of the whole text as column ``out``; equal texts have equal ones."""
    hashes = F.transform(paragraphs(F.col(text_col)), lambda p: F.xxhash64(p))
    return df.withColumn(f"{out}__items", hashes).withColumn(out, multiset_hash(F.col(f"{out}__items"), words)).drop(f"{out}__items")


def merged(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of both."""
    return F.concat(F.array(a[0] + b[0]), F.zip_with(_tail(a), _tail(b), lambda x, y: (x + y).bitwiseAND(F.lit(_LANES))))


def without(a: Column, b: Column) -> Column:
    """Fingerprint of ``a`` after the paragraphs of ``b``, which it must contain, are deleted."""

    def lanes(x: Column, y: Column) -> Column:
        lower = (_low(x) + F.lit(_LANE + 1) - _low(y)).bitwiseAND(F.lit(_LANE))
        upper = (_high(x) + F.lit(_LANE + 1) - _high(y)).bitwiseAND(F.lit(_LANE))
        return F.shiftleft(upper, 32) + lower

    return F.concat(F.array(a[0] - b[0]), F.zip_with(_tail(a), _tail(b), lanes))


def _tail(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.size(a) - 1)


def _low(word: Column) -> Column:
    return word.bitwiseAND(F.lit(_LANE))


def _high(word: Column) -> Column:
    return F.shiftright(word, 32).bitwiseAND(F.lit(_LANE))


def digest(fingerprint: Column) -> Column:
    """A short string that is equal for equal fingerprints."""
    return F.sha2(F.array_join(fingerprint.cast("array<string>"), ","), 256)


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the centred lanes, cut to 0 to 1: about the share of common paragraphs. 1 for equal fingerprints."""
    # n entries sum to about n * 32768; modulo 2^30, that depends on n modulo 2^15
    def centred(fingerprint: Column) -> Column:
        moved = F.lit(_HALF) - fingerprint[0].bitwiseAND(F.lit((1 << 15) - 1)) * F.lit(_CENTRE)
        lanes = F.concat(F.transform(_tail(fingerprint), _low), F.transform(_tail(fingerprint), _high))
        return F.transform(lanes, lambda v: ((v + moved).bitwiseAND(F.lit(_LANE)) - F.lit(_HALF)).cast("double"))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)

    x, y = centred(a), centred(b)
    cosine = F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine, F.lit(0.0)))))


def with_next_row(docs: DataFrame, prepare, id_col: str, carried: list[str], out: str) -> DataFrame:
    """``prepare(docs)`` with struct ``out``: the carried columns of the next row by id; after the last, the first's.

    Rows are dealt to ranges of ids of about equal numbers of rows, four for each shuffle partition. Each range also
    gets a copy of the next range's first row (the last range: of the very first), and a window looks one row ahead
    within each range. Rows of equal id follow each other by hash of the carried columns; null ids come first.
    """
    n = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.coalesce(F.col(id_col).cast("double"), F.lit(-1.0e308))
    placed = docs.withColumn("__place", place)
    cuts = sorted(set(placed.approxQuantile("__place", [i / n for i in range(1, n)], 0.25 / n))) or [0.0]
    ranged = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="__place", outputCol="__range").transform(placed).drop("__place")
    # one row of three numbers for each range
    firsts = ranged.groupBy("__range").agg(F.min(F.struct(F.col(id_col).isNotNull().alias("known"), F.col(id_col).alias("id"))).alias("first"))
    turn = Window.orderBy("__range")
    before = F.coalesce(F.lag("__range").over(turn), F.max("__range").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = firsts.select(F.col("__range").alias("__at"), F.col("first.id").alias("__first"), before.alias("__before"))
    copies = ranged.join(F.broadcast(firsts), (F.col("__range") == F.col("__at")) & F.col(id_col).eqNullSafe(F.col("__first")))
    copies = copies.withColumn("__range", F.col("__before")).drop("__at", "__first", "__before")
    both = prepare(ranged.withColumn("__copy", F.lit(0))).unionByName(prepare(copies.withColumn("__copy", F.lit(1))))
    order = Window.partitionBy("__range").orderBy("__copy", F.col(id_col).asc_nulls_first(), F.xxhash64(*carried))
    return both.withColumn(out, F.lead(F.struct(*carried)).over(order)).filter("__copy = 0").drop("__copy", "__range")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, next_fingerprint) for each row, repeated rows included.

    edited: the last half of the text's code points replaced by as many first ones of the next text by id. Null texts
    are empty. Other columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with_next = with_next_row(texts, lambda d: with_fingerprint(d, "text", "fingerprint", words), "doc_id", ["text", "fingerprint"], "next")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    kept = with_next.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "fingerprint", F.col("next.fingerprint").alias("next_fingerprint"))
    return with_fingerprint(kept, "edited", "edited_fingerprint", words)
