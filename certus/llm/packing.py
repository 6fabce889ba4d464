"""Packing of token sequences into windows by minimum bin slack.

Every document fills whole windows by itself; what is left of it, its tail, shares windows with others. Tails are planned
by their lengths: a window takes the longest length that is left, and a subset-sum over the other lengths, as a bitset of
reachable sums, picks the multiset that comes closest to the window's capacity. If it doesn't reach it, one more tail is
cut. The same multiset serves as many windows as the counts allow, so the plan is a small table of lengths and ranges of
ranks, whose size follows the window's capacity and not the number of documents. Documents then look up their places by
the rank that they have among the tails of their length; these ranks come from counters inside tasks and prefix sums.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from certus.llm.word_bpe import encode_texts, word_vocabulary
from certus.llm.words import text_slices
from certus.plans.staging import staged

#: Bytes of text that are encoded at once, about.
_BYTES = 6 << 20
#: Ids of a task's rows that are cut to pieces at once, about.
_IDS = 1 << 20
#: Bits of a sequence number below the number of a task.
_TASK_BITS = 40


class Step(NamedTuple):
    """Tails of one length with ranks from ``start`` on (``count`` of them), and the windows that they go to.

    Rank start + q goes to window first_window + q // each, at offset + (q % each) * length. ``cut`` is 0, or the ids that
    go there of a tail whose rest becomes the tail of length ``length - cut`` with rank rest_start + q.
    """

    length: int
    start: int
    count: int
    each: int
    first_window: int
    offset: int
    cut: int
    rest_start: int


def read_tokenizer(path: str) -> str:
    """The tokenizer file's content. It is read once on the driver (a few MB) and travels with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths (length to number, of ``counts`` at most) whose sum comes closest to ``capacity``.

    Sums are bits of an integer. Lengths are added from the longest on, in numbers of 1, 2, 4, ... that make up their count,
    until the capacity is reached; the way back takes a number only where the sum isn't reachable without it.
    """
    full, reached, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, lot = min(counts[length], capacity // length), 1
        while left:
            lot = min(lot, left)
            steps.append((reached, length, lot))
            reached |= (reached << (length * lot)) & full
            left -= lot
            lot *= 2
        if reached >> capacity:
            break
    total, taken = reached.bit_length() - 1, defaultdict(int)
    for before, length, lot in reversed(steps):
        if not before >> total & 1:
            taken[length] += lot
            total -= length * lot
    return dict(taken)


def plan_windows(histogram: dict[int, int], capacity: int) -> list[Step]:
    """Windows for tails of these lengths (each under ``capacity``) and counts.

    Every window is full but for the last ids, fewer than ``capacity``: they go to windows of a power of two each, which
    need no padding. Each length's steps follow one another by rank without a gap.
    """
    left = {length: n for length, n in histogram.items() if n}
    made, placed = dict(left), dict.fromkeys(left, 0)  # tails of a length so far, and those that have a place
    total, steps, window = sum(length * n for length, n in left.items()), [], 0
    while left:
        size = capacity if total >= capacity else 1 << (total.bit_length() - 1)
        longest = max((length for length in left if length <= size), default=None)
        chosen = {}
        if longest is not None:
            others = {length: n - (length == longest) for length, n in left.items() if length <= size and n > (length == longest)}
            chosen = best_fill(others, size - longest)
            chosen[longest] = chosen.get(longest, 0) + 1
        slack = size - sum(length * n for length, n in chosen.items())
        # whatever isn't in the window is longer than its slack, or it would be
        cut = max((length for length, n in left.items() if n > chosen.get(length, 0) and length > slack), default=0) if slack else 0
        need = {length: chosen.get(length, 0) + (length == cut) for length in {*chosen, *([cut] if cut else [])}}
        times = min(min(left[length] // n for length, n in need.items()), total // size)
        offset = 0
        for length in sorted(chosen, reverse=True):
            each = chosen[length]
            steps.append(Step(length, placed[length], each * times, each, window, offset, 0, 0))
            placed[length] += each * times
            offset += length * each
        if cut:
            rest = cut - slack
            steps.append(Step(cut, placed[cut], times, 1, window, offset, slack, made.setdefault(rest, 0)))
            placed[cut] += times
            placed.setdefault(rest, 0)
            made[rest] += times
            left[rest] = left.get(rest, 0) + times
        for length, n in need.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
        window += times
        total -= size * times
    return steps


class _Plan:
    """Steps as arrays, looked up for many tails at once."""

    def __init__(self, steps: list[Step]):
        ordered = sorted(steps)
        self.columns = np.array(ordered, np.int64).reshape(-1, len(Step._fields)).T
        self.windows = max((s.first_window + -(-s.count // s.each) for s in steps), default=0)
        self.first = {}
        for at, s in enumerate(ordered):
            self.first.setdefault(s.length, at)
        self.last = {s.length: at + 1 for at, s in enumerate(ordered)}

    def places(self, length: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(number of the tail, ids of it before the piece, its ids, window, offset) for the first pieces, then the next."""
        who, before = np.flatnonzero(length > 0), np.zeros(len(length), np.int64)
        length, rank = length.copy(), rank.copy()
        while who.size:
            at = np.empty(len(who), np.int64)
            for one in np.unique(length[who]).tolist():
                these = length[who] == one
                first, last = self.first[one], self.last[one]
                at[these] = first + np.searchsorted(self.columns[1, first:last], rank[who[these]], "right") - 1
            _, start, _, each, window, offset, cut, rest_start = self.columns[:, at]
            nth = rank[who] - start
            size = np.where(cut > 0, cut, length[who])
            yield who, before[who], size, window + nth // each, offset + nth % each * length[who]
            before[who] += size
            rank[who] = rest_start + nth
            length[who] -= size
            who = who[cut > 0]


def _counted_rows(batches: Iterator[pa.RecordBatch], content: str, end: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """(id, text) to (doc_id, ids, doc_tokens, tail, part, rank, full): rank among the task's tails of that length, and the
    number of whole windows of the task before this row."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    vocabulary, part = word_vocabulary(content), TaskContext.get().partitionId()
    seen, windows = np.zeros(capacity, np.int64), 0
    for batch in batches:
        for at, n in text_slices(batch.column(1), _BYTES):
            ids = encode_texts(batch.column(1).slice(at, n), vocabulary, end)
            sizes = ids.value_lengths().to_numpy().astype(np.int64)
            tail, whole = sizes % capacity, sizes // capacity
            order = np.argsort(tail, kind="stable")
            runs = np.r_[0, np.flatnonzero(np.diff(tail[order])) + 1]
            nth = np.empty(n, np.int64)
            nth[order] = np.arange(n) - np.repeat(runs, np.diff(np.r_[runs, n]))
            rank = seen[tail] + nth
            seen += np.bincount(tail, minlength=capacity)
            full = windows + np.cumsum(whole) - whole
            windows += int(whole.sum())
            columns = [batch.column(0).slice(at, n), ids, pa.array(sizes), pa.array(tail), pa.array(np.full(n, part, np.int64)), pa.array(rank), pa.array(full)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "doc_tokens", "tail", "part", "rank", "full"])


def _piece_rows(batches: Iterator[pa.RecordBatch], steps: list[Step], capacity: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids, part, full, tail, rank) to the pieces; the rank is the one among all tails of that length."""
    plan = _Plan(steps)
    for batch in batches:
        lists = batch.column("ids")
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        group = np.cumsum(sizes) // _IDS
        for some in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(group)) + 1) if len(sizes) else []:
            rows = batch.slice(some[0], len(some))
            part, full, tail, rank = (rows.column(c).to_numpy() for c in ("part", "full", "tail", "rank"))
            size = sizes[some]
            whole = size // capacity
            owner = np.repeat(np.arange(len(some)), whole)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole)
            number = plan.windows + (part[owner] << _TASK_BITS) + full[owner] + nth
            found = [(owner, nth * capacity, np.full(len(owner), capacity), number, np.zeros(len(owner), np.int64))]
            found += [(who, whole[who] * capacity + before, length, window, offset) for who, before, length, window, offset in plan.places(tail, rank)]
            owner, start, length, window, offset = (np.concatenate(c) for c in zip(*found))
            lists = rows.column("ids")
            values = np.ascontiguousarray(lists.flatten().to_numpy(), "<u4")
            begin = (np.cumsum(size) - size)[owner] + start
            crc = np.fromiter((zlib.crc32(values[b : b + n]) for b, n in zip(begin.tolist(), length.tolist())), np.int64, len(begin))
            columns = [rows.column("doc_id").take(pa.array(owner)), *(pa.array(c.astype(np.int64)) for c in (start, length, crc, size[owner], window, offset))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 1, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece of each row of ``docs``.

    A row's ids are its text's and ``end``; null and empty texts have ``end`` alone. Its pieces cover start 0 to doc_tokens
    without gap or overlap. Sequences hold ``capacity`` ids, but for one of each power of two below that at most, which
    together hold what is left of the whole table; so nothing is padded. Rows with equal or null ids are packed one by one, and
    other columns are ignored. tokenizer: content of a file, see ``read_tokenizer``; it must drop white space.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    counted = staged(
        texts.mapInArrow(lambda it: _counted_rows(it, tokenizer, end, capacity), f"doc_id {id_type}, ids array<int>, doc_tokens bigint, tail bigint, part bigint, rank bigint, full bigint"),
        "counted-tokens",
    )
    # a row for each task and length: what earlier tasks have of that length comes before
    parts = counted.groupBy("tail", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = staged(parts.select("tail", "part", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "tails-before")
    # capacity rows at most
    histogram = {r["tail"]: r["n"] for r in base.filter("tail > 0").groupBy("tail").agg(F.sum("n").alias("n")).collect()}
    steps = plan_windows(histogram, capacity)
    ranked = counted.join(base.drop("n"), ["tail", "part"]).select("doc_id", "ids", "part", "full", "tail", (F.col("rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(lambda it: _piece_rows(it, steps, capacity), f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
