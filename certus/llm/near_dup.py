"""Near-duplicate documents by a multi-index Hamming join of minhash signatures.

A signature has 96 minhashes of 16 bits. Pairs with a similarity of 0.8 differ in about 19 places; those that differ in
37 at most (all but one in 100,000 of the pairs at 0.8) are all found: of 19 chunks, one has at most one wrong place, so
the signatures share a key made of that chunk without one of its places. Documents with equal sets are one node.

Documents that share a key aren't paired with each other but with one of them, a centre that differs between keys; a
centre and those paired with it are a star. Pairs within 37 wrong places are confirmed on the full sets. Then only
documents of stars in which several components remain are compared across components, and only those that can be alike
by their rarest shingles: in any common order of shingles, two sets with 0.8 of their union in common share one of the
first few, at places that leave room for the rest (a prefix filter). Shingles that only one component has can't be
shared across, so they come first, then the rare ones. Groups of documents that are near each other but not near enough
so part by what each has for itself, without meeting pair by pair, and no link is lost that joins components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certus.llm.components import smallest_reachable
from certus.llm.repeats import each_once
from certus.llm.words import hashed_words, mix, text_slices, window_hashes
from certus.plans.staging import staged

PLACES = 96
#: Places in which signatures of linked documents may differ.
MAX_ERRORS = 37
_CENTRES = 4
#: The signature cut to 8 bits a place: twelve words of eight places. It never differs in more places than the whole one.
_SHORT = [f"short{i}" for i in range(PLACES // 8)]

_RNG = np.random.default_rng(20_240_601)
_TURN = _RNG.integers(1, 1 << 63, PLACES, dtype=np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(1, 1 << 63, PLACES, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Of each text: sorted 64-bit hashes of its distinct ``size``-word shingles, A-Z in lower case; fewer words are one."""
    for _, words, counts in hashed_words(texts, lower=True):
        windows, ends = window_hashes(words, size), np.cumsum(counts)
        for begin, end in zip((ends - counts).tolist(), ends.tolist()):
            n = end - begin
            if n >= size:
                yield np.unique(windows[begin : end - size + 1])
            else:
                yield window_hashes(words[begin:end], n) ^ np.uint64(n) if n else np.empty(0, np.uint64)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """The smallest of the shingles' hashes under each of the PLACES orders."""
    least = np.full(PLACES, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[at : at + 2048, None] * _TURN).min(0))
    return mix(least)


def chunk_numbers(places: int = PLACES, errors: int = MAX_ERRORS) -> np.ndarray:
    """The chunk of each place: so many chunks that one of them has at most one of the errors."""
    chunks = errors // 2 + 1
    return np.arange(places) * chunks // places


def signature_keys(signatures: np.ndarray) -> np.ndarray:
    """Keys of each signature (rows of PLACES 16-bit values): its chunk without the place, for each place."""
    chunk = chunk_numbers()
    terms = signatures.astype(np.uint64) * _PLACE
    sums = np.add.reduceat(terms, np.flatnonzero(np.r_[True, np.diff(chunk) > 0]), axis=1)
    return mix(sums[:, chunk] - terms + np.arange(1, PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _signed_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n_shingles, set_key, signature and its 8-bit form)."""
    shifts = np.arange(0, 64, 8, dtype=np.uint64)
    for batch in batches:
        counts, keys, signatures, short = [], [], [], np.zeros((len(batch), len(_SHORT)), np.int64)
        for n, shingles in enumerate(shingle_sets(batch.column(1), size)):
            counts.append(len(shingles))
            if not len(shingles):
                keys.append(None)
                signatures.append(None)
                continue
            found = minhashes(shingles)
            keys.append(xxhash.xxh3_128_digest(shingles.tobytes()))
            signatures.append((found >> np.uint64(48)).astype(np.uint16).tobytes())
            short[n] = (((found >> np.uint64(48)) & np.uint64(255)).reshape(-1, 8) << shifts).sum(1, dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary()), *(pa.array(c) for c in np.ascontiguousarray(short.T))],
            ["doc_id", "n_shingles", "set_key", "signature", *_SHORT],
        )


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, signature) to a row (key, node) for each key."""
    for batch in batches:
        for at in range(0, len(batch), 2048):
            some = batch.slice(at, 2048)
            keys = signature_keys(np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint16).reshape(-1, PLACES))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(some.column(0).to_numpy(), PLACES))], ["key", "node"])


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node) in order of keys to (key, node, centre) for the keys that several nodes have; the first is the centre."""
    last_key, centre, alone = None, 0, False
    for batch in batches:
        key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        opens = np.r_[last_key is None or key[0] != last_key, key[1:] != key[:-1]]
        head = np.maximum.accumulate(np.where(opens, np.arange(len(key)), -1))
        middle = np.where(head >= 0, node[np.maximum(head, 0)], centre)
        follows = ~opens
        # a group's first row comes out when a second one is seen
        shown = follows.copy()
        shown[:-1] |= opens[:-1] & follows[1:]
        keys, nodes, centres = key[shown], node[shown], middle[shown]
        if alone and follows[0]:
            keys, nodes, centres = np.r_[last_key, keys], np.r_[centre, nodes], np.r_[centre, centres]
        alone, last_key, centre = bool(opens[-1]), key[-1], middle[-1]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (keys, nodes, centres)], ["key", "node", "centre"])


def _set_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(node, text), ordered by node, to (node, shingles array<bigint>): the different sets of each node."""
    last, seen = None, set()
    for batch in batches:
        for at, n in text_slices(batch.column(1)):
            some = batch.slice(at, n)
            nodes, sets = [], []
            for node, found in zip(some.column(0).to_pylist(), shingle_sets(some.column(1), size)):
                if node != last:
                    last, seen = node, set()
                digest = xxhash.xxh3_128_digest(found.tobytes())
                if digest not in seen:
                    seen.add(digest)
                    nodes.append(node)
                    sets.append(found.view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), lists], ["node", "shingles"])


def _short_errors(a: str, b: str) -> Column:
    """Places in which two 8-bit forms (columns with these prefixes) differ."""
    total = F.lit(0)
    for word in _SHORT:
        x = F.col(a + word).bitwiseXOR(F.col(b + word))
        for by in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def _alike(a: str, b: str, percent: int) -> Column:
    """Whether sizes and signatures of two nodes (columns with these prefixes) allow a link."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (_short_errors(a, b) <= MAX_ERRORS)


def _named(df: DataFrame, prefix: str, node: str) -> DataFrame:
    """What is known of nodes, under names with a prefix; the node itself as ``node``."""
    return df.select(F.col("node").alias(node), *(F.col(c).alias(prefix + c) for c in ("n", *_SHORT)))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    linked = 100 * both >= percent * (F.size("sa") + F.size("sb") - both)
    return pairs.join(left, "a").join(right, "b").filter(linked).select("a", "b").distinct()


def _least_overlap(sizes: Column, percent: int) -> Column:
    """Common shingles that two linked sets with so many in both together have at least."""
    return F.ceil(sizes * percent / F.lit(100 + percent))


def _crossing(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, label) with other labels whose sets can be linked, with their labels (a_label,
    b_label) and the number of places at which they meet (shared).

    Only shingles that several labels have can be common to such a pair. They are ordered by the number of nodes that
    have them; places count from those that one label has alone. The first place at which two linked sets meet leaves
    as many shingles behind it in either set as they must have in common.
    """
    shingles = staged(sets.join(nodes, "node").select("node", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")), "crossing-shingles")
    held = shingles.groupBy("shingle").agg(F.count("*").alias("holders"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("shingle", "holders")
    common = shingles.join(held, "shingle").groupBy("node").agg(F.first("label").alias("label"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("holders", "shingle"))).alias("common"))
    # a linked set has percent of the larger one's size in common with it, so this is the last place of a larger set
    last = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    first = F.col("n") - F.size("common")
    prefixes = staged(
        common.filter(last > first)
        .select("node", "label", "n", first.alias("before"), F.posexplode(F.slice("common", F.lit(1), (last - first).cast("int"))).alias("k", "one"))
        .select("node", "label", "n", (F.col("before") + F.col("k") + 1).alias("at"), F.col("one.shingle").alias("shingle")),
        "prefixes",
    )
    a = prefixes.select("shingle", *(F.col(c).alias(f"a_{c}") for c in ("node", "label", "n", "at"))).filter(F.col("a_at") <= F.col("a_n") - _least_overlap(2 * F.col("a_n"), percent) + 1)
    b = prefixes.select("shingle", *(F.col(c).alias(f"b_{c}") for c in ("node", "label", "n", "at")))
    smaller = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_node") < F.col("b_node")))
    room = 1 + F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")) >= _least_overlap(F.col("a_n") + F.col("b_n"), percent)
    met = a.join(b.hint("merge"), "shingle").filter(smaller & room & (F.col("a_label") != F.col("b_label")) & (F.col("a_n") * 100 >= F.col("b_n") * percent))
    return staged(met.groupBy(F.col("a_node").alias("a"), F.col("b_node").alias("b"), "a_label", "b_label").agg(F.count("*").alias("shared")), "met")


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``, repeated rows included.

    component_id is the smallest doc_id that links lead to. Null texts and texts without words have empty sets and link
    with nothing; rows without id have no component. Rows of one id with different texts are one document that
    has the links of each, so they share a component. Linked: 100 * intersection >= percent * union of the distinct ``size``-word shingles;
    signatures are laid out for percent 80 and more. Ids must be numbers: others raise.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    longs = ", ".join(f"{c} bigint" for c in _SHORT)
    signed = staged(texts.mapInArrow(lambda it: _signed_rows(it, size), f"doc_id bigint, n_shingles bigint, set_key binary, signature binary, {longs}"), "signatures")
    known = signed.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    nodes = staged(
        known.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), *(F.first(c).alias(c) for c in _SHORT)),
        "nodes",
    )
    keys = nodes.select("node", "signature").mapInArrow(_key_rows, "key bigint, node bigint")
    ordered = keys.repartition("key").sortWithinPartitions("key", F.xxhash64("node", F.col("key").bitwiseAND(F.lit(_CENTRES - 1))))
    stars = staged(ordered.mapInArrow(_shared_rows, "key bigint, node bigint, centre bigint").select("centre", "node").distinct(), "stars")
    about = nodes.select("node", "n", *_SHORT)
    # both sides grow with the input, so it is a merge join at every size
    sharing = stars.select("node").distinct()
    once = each_once(texts.filter("text IS NOT NULL").withColumn("text_hash", F.xxhash64("text")))
    sets = staged(once.withColumnRenamed("doc_id", "node").join(sharing.hint("merge"), "node").select("node", "text").mapInArrow(lambda it: _set_rows(it, size), "node bigint, shingles array<bigint>"), "shingle-sets")

    ends = stars.filter("node != centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    tried = staged(ends.join(_named(about, "a_", "a"), "a").join(_named(about, "b_", "b"), "b").filter(_alike("a_", "b_", percent)).select("a", "b"), "pairs")
    # (doc_id, n_shingles, node) of each row; the sets of an id that has several are one document
    owners = staged(known.join(nodes.select("set_key", "node"), "set_key").select("doc_id", "n_shingles", "node"), "owners")
    several = owners.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("doc_id", "a")
    same = owners.join(several, "doc_id").filter("node > a").select("a", F.col("node").alias("b")).distinct()
    links = staged(_confirmed(tried, sets, percent).unionByName(same), "links")
    labels = smallest_reachable(links)

    labelled = staged(stars.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled-stars")
    mixed = labelled.groupBy("centre").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("centre")
    met = _crossing(labelled.join(mixed, "centre").select("node", "label").distinct(), sets, percent)
    # first each document's best partner in each other component, then what that hasn't joined
    best = F.row_number().over(Window.partitionBy("a", "b_label").orderBy(F.desc("shared"), "b"))
    first = staged(met.withColumn("rank", best).filter("rank = 1").select("a", "b"), "best-pairs")
    labels = smallest_reachable(staged(_confirmed(first, sets, percent), "links"), labels)
    for side in "ab":
        now = labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_now"))
        met = met.join(now, side, "left").withColumn(f"{side}_label", F.coalesce(f"{side}_now", side)).drop(f"{side}_now")
    rest = staged(met.filter("a_label != b_label").select("a", "b").join(first, ["a", "b"], "left_anti"), "pairs")
    if rest.limit(1).count():
        labels = smallest_reachable(staged(_confirmed(rest, sets, percent), "links"), labels)

    joined = owners.join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("label", "node").alias("component_id"))
    alone = signed.filter("set_key IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    # an id's rows without words follow its others
    least = joined.groupBy("doc_id").agg(F.min("component_id").alias("component"))
    alone = alone.join(least, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "component_id").alias("component_id"))
    return joined.unionByName(alone)
