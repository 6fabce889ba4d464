"""Mixing sources to target weights, block by block.

Each source's words, document after document, are one stream that is cut into blocks of a fixed number of words.
Output shards draw how many slots each source gets from multinomials; a source's slots are numbered, and a
pseudorandom permutation of its block numbers, another one for each pass, says which block fills a slot. Slots and
blocks then meet in a join by index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certus.llm.words import mix, words_of
from certus.plans.staging import staged

#: Words in a block.
BLOCK = 64
#: Output shards; shards grow with the input, not their number.
SHARDS = 64
#: Sources whose totals the driver holds; more are refused.
MAX_SOURCES = 10_000
#: Buckets of the documents' order: their number follows the number of rows up to this, and nothing else.
MAX_BUCKETS = 1 << 16
#: Slots that one row expands to at most.
_CHUNK = 4096


def word_count(text: Column) -> Column:
    """Number of runs without blank, tab, \\n, \\v, \\f and \\r (bigint); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint"), F.lit(0).cast("bigint"))


def capped_targets(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Share ``total`` by weight; none gets over ``most`` times its size, and the excess goes to the others by weight."""
    targets, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = total
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = most * sizes[i]
        left -= sum(targets[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def draw_slots(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Slots of each source in each shard (shards by sources): multinomial draws whose columns sum to the quotas.

    Every shard draws with probabilities in proportion to what the sources have left, so that the draws together meet
    the quotas; a draw over what is left is cut and its rest drawn again from the others.
    """
    rng = np.random.default_rng(seed)
    left, out = quotas.astype(np.int64).copy(), np.zeros((shards, len(quotas)), np.int64)
    for shard in range(shards):
        room = int(left.sum()) // (shards - shard)
        while room:
            drawn = np.minimum(rng.multinomial(room, left / left.sum()), left)
            out[shard] += drawn
            left -= drawn
            room -= int(drawn.sum())
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each key: a Feistel network on enough bits, walked until inside."""
    half = (np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2))).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while todo.size:
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        low, high = out[todo] & m, out[todo] >> h
        for turn in range(4):
            low, high = high ^ (mix(low + k + np.uint64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & m), low
        out[todo] = (high << h) | low
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Source:
    """A source with its number in code point order (null last), words, blocks, target and quota of slots."""

    name: str | None
    number: int
    size: int
    blocks: int
    target: float
    slots: int


def plan_sources(totals: list[tuple[str | None, int]], weights: tuple[float, ...], share: float, block: int) -> list[Source]:
    """Targets of the sources: the weights repeat over the sources in order and share ``share`` times all words."""
    totals = sorted(totals, key=lambda t: (t[0] is None, t[0] or ""))
    sizes = [size for _, size in totals]
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes))
    out = []
    for number, ((name, size), target) in enumerate(zip(totals, targets)):
        blocks = -(-size // block)
        # a full pass takes the whole source; the rest takes as many blocks as come nearest
        passes = int(target // size) if size else 0
        slots = passes * blocks + round((target - passes * size) / block) if size else 0
        out.append(Source(name, number, size, blocks, target, min(slots, 2 * blocks)))
    return out


def _slot_rows(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """(shard, source, from_slot, n, blocks, at) to a row (shard, slot, source, turn, block) for each slot."""
    names = ["shard", "slot", "source", "turn", "block"]
    for batch in batches:
        for shard, source, first, n, blocks, at in zip(*(batch.column(i).to_pylist() for i in range(6))):
            slot = np.arange(first, first + n)
            keys = mix(np.uint64(seed) + np.uint64(source) * np.uint64(0x100000001B3) + (slot // blocks).astype(np.uint64))
            block = permuted(slot % blocks, np.full(n, blocks), keys)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(at, at + n)), pa.array(np.full(n, source, np.int32)), pa.array((slot // blocks).astype(np.int32)), pa.array(block)], names)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, text_hash, size) of each row, staged: all that planning needs."""
    return staged(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("text_hash"), word_count(F.col(text_col)).alias("size")), "sizes")


def with_offsets(sizes: DataFrame, rows: int) -> DataFrame:
    """``sizes`` with ``offset``, the words before the row in its source's stream, in order of a hash of id and text,
    and ``copy``, a number from 1 for repeated rows.

    Rows are dealt to buckets (of 256 rows, if that makes no more than MAX_BUCKETS) by that hash; sums within a bucket
    and sums of the buckets before it, source by source, add up, so no task sees a whole source.
    """
    n = min(MAX_BUCKETS, 1 << max(0, (rows // 256)).bit_length())
    dealt = sizes.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(n)).cast("int"))
    by_bucket = Window.partitionBy("bucket", "source")
    inner = by_bucket.orderBy("doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("bucket", "source", "doc_id", "text_hash").orderBy("size")
    local = dealt.repartition("bucket").withColumns({"offset": F.sum("size").over(inner) - F.col("size"), "copy": F.row_number().over(same)})
    # at most one row for each source and bucket
    totals = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), (F.sum("words").over(before) - F.col("words")).alias("start"))
    joined = local.join(starts, (F.col("bucket") == F.col("b")) & F.col("source").eqNullSafe(F.col("s")))
    return joined.select("doc_id", "source", "text_hash", "copy", "size", (F.col("offset") + F.col("start")).alias("offset"))


@dataclass
class Mix:
    """What was mixed.

    spans: (shard, slot, source_number, turn, block, doc_id, text_hash, copy, start, n_words), a row for each piece of a
    document in a slot; start counts the document's words from 0, turn the passes over its source. documents: (doc_id, source, source_number, text_hash,
    copy, size, offset), a row for each document; the first of these but ``source`` tell documents apart.
    """

    spans: DataFrame
    documents: DataFrame
    sources: list[Source]

    def source_rows(self) -> DataFrame:
        """(source_number, source_size, target), one row for each source, MAX_SOURCES at most."""
        return self.documents.sparkSession.createDataFrame([(s.number, s.size, s.target) for s in self.sources], "source_number int, source_size bigint, target double")

    def taken(self) -> DataFrame:
        """``documents`` with ``taken``: the words that the mix takes of each, repeats counted."""
        key = ["source_number", "doc_id", "text_hash", "copy"]
        sums = self.spans.groupBy(*key).agg(F.sum("n_words").alias("taken")).select(*(F.col(c).alias(f"t_{c}") for c in key), "taken")
        same = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in key]
        return self.documents.join(sums, same, "left").drop(*(f"t_{c}" for c in key)).fillna(0, ["taken"])


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, block: int = BLOCK, shards: int = SHARDS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """Mix all documents; reruns on the same rows agree, however they are partitioned.

    Null texts have no words; a null source is a source of its own, the last one. Repeated rows are separate documents
    of the same content: they lie next to each other in the stream. An empty table gives an empty mix.
    """
    spark = docs.sparkSession
    sizes = sized(docs, id_col, text_col, source_col)
    totals = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources = plan_sources([(r["source"], r["size"]) for r in totals], weights, share, block)
    counts = draw_slots(np.array([s.slots for s in sources], np.int64), shards, seed)
    first = np.cumsum(counts, axis=0) - counts
    place = np.cumsum(counts, axis=1) - counts
    # a row for each shard and source
    rows = [(shard, s.number, int(first[shard, n]), int(counts[shard, n]), s.blocks, int(place[shard, n])) for shard in range(shards) for n, s in enumerate(sources) if counts[shard, n]]
    table = spark.createDataFrame(rows, "shard int, source int, first bigint, n bigint, blocks bigint, at bigint")
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(_CHUNK).cast("bigint"))).alias("skip")
    chunks = table.select("*", chunk).select("shard", "source", F.col("first") + F.col("skip"), F.least(F.col("n") - F.col("skip"), F.lit(_CHUNK).cast("bigint")), "blocks", F.col("at") + F.col("skip"))
    slots = chunks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(lambda it: _slot_rows(it, seed), "shard int, slot bigint, source int, turn int, block bigint")
    numbers = spark.createDataFrame([(s.name, s.number) for s in sources], "name string, source_number int")
    # one row for each source, MAX_SOURCES at most
    placed = with_offsets(sizes, sum(r["rows"] for r in totals)).join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    documents = staged(placed, "placed")
    last = F.col("offset") + F.col("size") - 1
    blocks = F.explode(F.sequence(F.floor(F.col("offset") / block), F.floor(last / block)))
    pieces = documents.filter("size > 0").select("source_number", "doc_id", "text_hash", "copy", "offset", "size", blocks.alias("block"))
    begin = F.greatest(F.col("block") * block, F.col("offset"))
    end = F.least((F.col("block") + 1) * block, F.col("offset") + F.col("size"))
    pieces = pieces.select("source_number", "block", "doc_id", "text_hash", "copy", (begin - F.col("offset")).alias("start"), (end - begin).alias("n_words"))
    # both sides grow with the input: never a broadcast, however small the files look before blocks are listed
    spans = slots.withColumnRenamed("source", "source_number").join(pieces.hint("merge"), ["source_number", "block"])
    return Mix(spans, documents, sources)


def taken_texts(docs: DataFrame, mixed: Mix, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as documents: a row with the columns of ``docs`` for each document and pass that takes any of its words.

    The text is what the pass takes, in the document's order: unchanged if that is all, else words joined by one blank.
    """
    keyed = docs.withColumns({"__id": F.col(id_col).cast("bigint"), "__hash": F.xxhash64(text_col), "__source": F.col(source_col).cast("string")})
    one = keyed.dropDuplicates(["__id", "__hash", "__source"])  # repeated rows come back by their own spans
    names = mixed.documents.sparkSession.createDataFrame([(s.number, s.name) for s in mixed.sources], "source_number int, name string")
    turns = mixed.spans.groupBy("source_number", "doc_id", "text_hash", "copy", "turn").agg(F.sort_array(F.collect_list(F.struct("start", "n_words"))).alias("__spans")).join(F.broadcast(names), "source_number")
    turns = turns.select("__spans", F.col("doc_id").alias("__t_id"), F.col("text_hash").alias("__t_hash"), F.col("name").alias("__t_source"))
    same = F.col("__id").eqNullSafe(F.col("__t_id")) & (F.col("__hash") == F.col("__t_hash")) & F.col("__source").eqNullSafe(F.col("__t_source"))
    joined = one.join(turns, same)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(texts.to_pylist(), lists.to_pylist()):
            words = words_of(text)
            if sum(s["n_words"] for s in spans) < len(words):
                text = b" ".join(w for s in spans for w in words[s["start"] : s["start"] + s["n_words"]]).decode()
            out.append(text)
        return pa.array(out, pa.string())

    return joined.withColumn(text_col, cut(F.col(text_col), F.col("__spans"))).select(*docs.columns)
