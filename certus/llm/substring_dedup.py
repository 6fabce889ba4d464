"""Substring dedup: windows of words that an earlier document has, found by super-k-mer partitioning.

A window's minimiser is the smallest hash of its 8-word runs. Consecutive windows that share it form a super-k-mer.
Equal windows have equal minimisers, so super-k-mers whose minimiser only one document has need not travel. The others
travel as packed strings: equal strings meet first (only the earliest document's goes on), then the strings of one
minimiser meet in a bucket, where sorting their windows finds the equal ones. The strings of a bucket with very many of
them (such as those around a common line) must also agree on the words beside the minimiser, and are then dealt out by
window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certus.llm.repeats import each_once
from certus.llm.words import hashed_words, text_slices, window_hashes, words_of
from certus.plans.staging import staged

#: Words of the runs whose hashes are compared for a minimiser.
RUN = 8
#: Windows in one super-k-mer at most; a longer run of equal minimisers makes several.
MAX_WINDOWS = 64
#: Different strings that a bucket sorts at most; beyond that its windows are dealt out one by one.
MAX_BUCKET = 512


def _sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    reach, out = 1, values
    while reach * 2 <= size:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = size - reach
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _super_kmers(hashes: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Of documents laid one after another: document, start, windows and minimiser of each super-k-mer."""
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    least = _sliding_min(window_hashes(hashes, RUN), size - RUN + 1) if len(hashes) >= size else np.empty(0, np.uint64)
    at = np.flatnonzero(doc[: len(least)] == doc[size - 1 :][: len(least)])  # windows within one document
    if not at.size:
        return (np.empty(0, np.int64),) * 4
    value, owner = least[at], doc[at]
    first = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]
    run_start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    heads = np.flatnonzero((np.arange(len(at)) - run_start) % MAX_WINDOWS == 0)
    windows = np.diff(np.r_[heads, len(at)])
    owner = owner[heads]
    return owner, at[heads] - (ends[owner] - lengths[owner]), windows, value[heads].view(np.int64)


def _super_kmer_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, text) to (minimiser, doc_id, text_hash, start, windows)."""
    for batch in batches:
        ids, hashes, texts = (batch.column(i) for i in range(3))
        for begin, words, lengths in hashed_words(texts):
            owner, start, windows, minimiser = _super_kmers(words, lengths, size)
            rows = pa.array(owner + begin)
            yield pa.RecordBatch.from_arrays(
                [pa.array(minimiser), ids.take(rows), hashes.take(rows), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32))],
                ["minimiser", "doc_id", "text_hash", "start", "windows"],
            )


def _packed_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, text, spans) to one row for each different packed string of a document."""
    names = ["minimiser", "key", "doc_id", "text_hash", "starts", "windows", "packed"]
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.binary()]
    schema = pa.schema(list(zip(names, types)))
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text_hash, text, spans in zip(*batch.columns):
            words, found = words_of(text.as_py()), {}
            start, windows, minimiser = (spans.values.field(k).to_pylist() for k in ("start", "windows", "minimiser"))
            for at, n, m in zip(start, windows, minimiser):
                packed = b" ".join(words[at : at + n + size - 1])
                found.setdefault(packed, (m, n, []))[2].append(at)
            rows += ((m, xxhash.xxh3_128_digest(packed), doc_id.as_py(), text_hash.as_py(), starts, n, packed) for packed, (m, n, starts) in found.items())
            if len(rows) > 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=schema)


def _windows(packed: bytes, size: int) -> list[bytes]:
    data = np.frombuffer(packed, np.uint8)
    blanks = np.flatnonzero(data == 32)
    begins, ends = [0, *(blanks + 1).tolist()], [*blanks.tolist(), len(packed)]
    return [packed[b:e] for b, e in zip(begins, ends[size - 1 :])]


def _bucket_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Strings ordered by minimiser to the windows (doc_id, text_hash, start, windows) that an earlier document has."""

    def repeated(bucket: list[tuple]) -> list[tuple]:
        if len({doc for _, doc, *_ in bucket}) < 2:
            return []
        entries = sorted((w, doc, n, k) for n, (_, doc, _, _, packed) in enumerate(bucket) for k, w in enumerate(_windows(packed, size)))
        out, last, least = [], None, 0
        for window, doc, n, k in entries:
            if window != last:
                last, least = window, doc
            elif doc > least:
                out += ((doc, bucket[n][2], s + k, 1) for s in bucket[n][3])
        return out

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "text_hash", "start", "windows"])

    bucket: list[tuple] = []
    out: list[tuple] = []
    for batch in batches:
        parts = (batch.slice(at, 1024) for at in range(0, len(batch), 1024))
        for row in (r for part in parts for r in zip(*(c.to_pylist() for c in part.columns))):
            if bucket and bucket[0][0] != row[0]:
                out += repeated(bucket)
                bucket = []
                if len(out) > 20_000:
                    yield batch_of(out)
                    out = []
            bucket.append(row)
    yield batch_of(out + repeated(bucket))


def _side_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Strings to rows (side, doc_id, text_hash, starts, packed, offsets): windows that agree on a side of the minimiser.

    A window reaches over half of its other words beyond its minimiser's run, to the left or else to the right; equal
    windows have equal words there.
    """
    reach = (size - RUN) // 2
    names = ["side", "doc_id", "text_hash", "starts", "packed", "offsets"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32())]
    for batch in batches:
        rows: list[tuple] = []
        for minimiser, doc_id, text_hash, starts, packed in zip(*(batch.column(i).to_pylist() for i in range(5))):
            words = packed.split(b" ")
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            places = np.flatnonzero(window_hashes(hashes, RUN).view(np.int64) == minimiser).tolist()
            sides: dict[int, list[int]] = {}
            at = 0
            for k in range(len(words) - size + 1):
                while places[at] < k:
                    at += 1
                p = places[at]
                left = p - k >= reach
                part = words[p - reach : p + RUN] if left else words[p : p + RUN + reach]
                sides.setdefault(xxhash.xxh3_64_intdigest(b" ".join(part), seed=left) - (1 << 63), []).append(k)
            rows += ((side, doc_id, text_hash, starts, packed, offsets) for side, offsets in sides.items())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _single_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Strings with offsets to a row (window_key, doc_id, text_hash, start) for each of those windows."""
    for batch in batches:
        for doc_id, text_hash, starts, packed, offsets in zip(*(batch.column(i).to_pylist() for i in range(5))):
            windows = _windows(packed, size)
            rows = [(xxhash.xxh3_128_digest(windows[k]), doc_id, text_hash, s + k) for k in offsets for s in starts]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.int32()))], ["window_key", "doc_id", "text_hash", "start"])


def repeated_windows(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text", max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(doc_id, text_hash, start, windows): runs of windows of ``size`` words that also start in a smaller doc_id.

    start counts words from 0. text_hash (xxhash64) tells rows of one id with different texts apart; such rows, and
    repeated rows, remove nothing from each other. Rows without id take no part. size must be at least 8.
    """
    if size < RUN:
        raise ValueError(f"windows need at least {RUN} words")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    texts = each_once(texts)
    kmers = staged(texts.mapInArrow(lambda it: _super_kmer_rows(it, size), "minimiser bigint, doc_id bigint, text_hash bigint, start int, windows int"), "super-kmers")
    shared = kmers.groupBy("minimiser").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("minimiser")
    spans = kmers.join(shared, "minimiser").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "windows", "minimiser")).alias("spans"))
    once = texts.join(spans, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "spans")
    packed = staged(
        once.mapInArrow(lambda it: _packed_rows(it, size), "minimiser bigint, key binary, doc_id bigint, text_hash bigint, starts array<int>, windows int, packed binary"),
        "packed-strings",
    )
    # equal strings: all but the earliest document's are repeated as a whole
    earliest = packed.groupBy("key").agg(F.min("doc_id").alias("first_doc"))
    marked = staged(packed.join(earliest, "key"), "marked-strings")
    copies = marked.filter("doc_id > first_doc").select("doc_id", "text_hash", F.explode("starts").alias("start"), "windows")
    rest = marked.filter("doc_id = first_doc").select("minimiser", "doc_id", "text_hash", "starts", "packed")
    crowded = rest.groupBy("minimiser").count().filter(F.col("count") > max_bucket).select("minimiser", F.lit(True).alias("crowded"))
    sorted_out = staged(rest.join(crowded, "minimiser", "left"), "bucket-strings")
    row = "doc_id bigint, text_hash bigint, start int, windows int"
    buckets = sorted_out.filter("crowded IS NULL").select("minimiser", "doc_id", "text_hash", "starts", "packed").repartition("minimiser").sortWithinPartitions("minimiser")
    from_buckets = buckets.mapInArrow(lambda it: _bucket_rows(it, size), row)
    sides = staged(
        sorted_out.filter("crowded").select("minimiser", "doc_id", "text_hash", "starts", "packed").mapInArrow(lambda it: _side_rows(it, size), "side bigint, doc_id bigint, text_hash bigint, starts array<int>, packed binary, offsets array<int>"),
        "crowded-sides",
    )
    agreed = sides.groupBy("side").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("side")
    chosen = sides.join(agreed, "side").select("doc_id", "text_hash", "starts", "packed", "offsets")
    singles = staged(chosen.mapInArrow(lambda it: _single_rows(it, size), "window_key binary, doc_id bigint, text_hash bigint, start int"), "single-windows")
    least = singles.groupBy("window_key").agg(F.min("doc_id").alias("least"))
    from_windows = singles.join(least, "window_key").filter("doc_id > least").select("doc_id", "text_hash", "start", F.lit(1).alias("windows"))
    return copies.unionByName(from_buckets).unionByName(from_windows)


def remove_repeats(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text", prefix: str = "__dedup", **how) -> DataFrame:
    """``docs`` with ``{prefix}_n_words``, ``_n_removed`` (bigint) and ``_kept`` (the kept words joined by one blank).

    Every row comes back once, repeated rows too. Null texts and ids: nothing is removed. Columns of those names are
    replaced.
    """
    spans = repeated_windows(docs, size, id_col, text_col, **how).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "windows")).alias(f"{prefix}_spans"))

    names, types = ["n_words", "n_removed", "kept"], [pa.int64(), pa.int64(), pa.string()]

    @F.arrow_udf("struct<n_words:bigint,n_removed:bigint,kept:string>")
    def cut(texts: pa.Array, lists: pa.Array) -> pa.Array:
        parts = [pa.StructArray.from_arrays([pa.array([], t) for t in types], names)]
        for at, n in text_slices(texts):
            out = []
            for text, found in zip(texts.slice(at, n).to_pylist(), lists.slice(at, n)):
                words = kept = words_of(text)
                if found.is_valid:
                    starts, windows = (found.values.field(k).to_numpy(zero_copy_only=False) for k in ("start", "windows"))
                    steps = np.zeros(len(words) + 1, np.int64)
                    np.add.at(steps, starts, 1)
                    np.add.at(steps, starts + windows + size - 1, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
            parts.append(pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names))
        return pa.concat_arrays(parts)

    keyed = docs.withColumns({f"{prefix}_id": F.col(id_col).cast("bigint"), f"{prefix}_hash": F.xxhash64(text_col)})
    spans = spans.withColumnsRenamed({"doc_id": f"{prefix}_id", "text_hash": f"{prefix}_hash"})
    joined = keyed.join(spans, [f"{prefix}_id", f"{prefix}_hash"], "left")
    result = cut.asNondeterministic()(F.col(text_col), F.col(f"{prefix}_spans"))
    fields = {f"{prefix}_{f}": F.col(f"{prefix}_result.{f}") for f in ("n_words", "n_removed", "kept")}
    return joined.withColumn(f"{prefix}_result", result).select(*(c for c in docs.columns if c not in fields), *(v.alias(k) for k, v in fields.items()))
