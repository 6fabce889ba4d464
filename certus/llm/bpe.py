"""Byte-level BPE encoding and decoding with rank files.

The distinct pre-tokens of some megabytes of text are bucketed by length and held as padded matrices of token ids. In each
round every row merges its leftmost pair of minimum rank; finished rows leave, and the others are compacted by one column.
Texts are taken apart and ids put together by Arrow's dictionaries and gathers, without a step for each word.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certus.llm.pretokens import PairTable, split_texts, units_to_pieces
from certus.llm.words import slices, text_slices

#: Longer pre-tokens (runs without a break) are merged one at a time with a heap, as a matrix would cost n * n.
LONG_PIECE = 2048

_NEVER = np.int32((1 << 31) - 1)
#: Bytes of text that are encoded, and ids that are decoded, at once, about.
_BYTES, _IDS = 3 << 20, 1 << 20


def read_ranks(path: str) -> bytes:
    """The rank file's content. It is read once on the driver (about 1 MB) and travels with the tasks."""
    with open(path, "rb") as f:
        return f.read()


class _Vocabulary:
    def __init__(self, content: bytes):
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}
        self.token_bytes = {rank: token for token, rank in ranks.items()}
        self.symbol_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        merged = np.array(merged, np.int64)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), merged, merged)
        self.ranks = ranks
        self.known = pa.array(list(ranks), pa.binary())
        self.known_ids = np.array(list(ranks.values()), np.int32)
        self.by_id = pa.array([self.token_bytes.get(i) for i in range(max(self.token_bytes) + 1)], pa.binary())
        self.first_rank = self._first_ranks()

    def _first_ranks(self) -> np.ndarray:
        n = len(self.symbol_ids)
        pair = np.arange(n * n)
        return self._rank(self.symbol_ids[pair // n], self.symbol_ids[pair % n])

    def _symbols(self, raw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers of the symbols that merging starts from, for rows of bytes: here each byte's own."""
        return raw

    def _pair_rank(self, left: int, right: int) -> int | None:
        return self.ranks.get(self.token_bytes[left] + self.token_bytes[right])

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as the bytes of an int32 array."""
        lists = self.encode_array(pa.array(pieces, pa.binary()))
        return [ids.values.to_numpy().tobytes() for ids in lists]

    def encode_array(self, pieces: pa.Array) -> pa.Array:
        """Ids (list<int32>) of an array of pieces (binary, none null or empty)."""
        _, offsets, data = pieces.buffers()
        begins = np.frombuffer(offsets, np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
        raw = np.frombuffer(data or b"", np.uint8)
        at = pc.index_in(pieces, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(at >= 0)
        finished = [(whole, np.ones(len(whole), np.int64), self.known_ids[at[whole]])]
        rest = np.flatnonzero(at < 0)
        lengths = np.diff(begins)[rest]
        for n, size in zip(rest[lengths > LONG_PIECE].tolist(), lengths[lengths > LONG_PIECE].tolist()):
            ids = self._merge_long(raw[begins[n] : begins[n] + size].tobytes())
            finished.append((np.array([n]), np.array([len(ids)]), ids))
        width = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
        width[lengths > LONG_PIECE] = -1
        for bucket in np.unique(width[width >= 0]).tolist():
            rows = rest[width == bucket]
            step = max(1, (1 << 19) >> bucket)
            for k in range(0, len(rows), step):
                self._merge_rows(raw, begins, rows[k : k + step], finished)
        owner, sizes, ids = (np.concatenate(c) for c in zip(*finished))
        place = np.empty(len(pieces), np.int64)
        place[owner] = np.arange(len(owner))
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(ids, pa.int32())).take(pa.array(place))

    def _merge_rows(self, data: np.ndarray, begins: np.ndarray, owner: np.ndarray, finished: list) -> None:
        lengths = begins[owner + 1] - begins[owner]
        width = int(lengths.max())
        filled = np.arange(width) < lengths[:, None]
        raw = np.where(filled, data[np.minimum(begins[owner, None] + np.arange(width), len(data) - 1)], 0).astype(np.int32)
        raw = self._symbols(raw, lengths)
        ids = self.symbol_ids[raw]
        rank = self.first_rank[raw[:, :-1] * len(self.symbol_ids) + raw[:, 1:]]
        rank[~filled[:, 1:]] = _NEVER
        while True:
            at = rank.argmin(1)  # the first of equal ranks
            row = np.arange(len(at))
            best = rank[row, at]
            done = best == _NEVER
            if done.any():
                finished.append((owner[done], lengths[done], ids[done][np.arange(ids.shape[1]) < lengths[done][:, None]]))
                live = ~done
                ids, rank, owner, lengths, at, best = ids[live], rank[live], owner[live], lengths[live], at[live], best[live]
                if not len(at):
                    return
                row = np.arange(len(at))
            lengths = lengths - 1
            width = int(lengths.max())
            shift = np.arange(ids.shape[1] - 1) > at[:, None]
            ids = np.where(shift, ids[:, 1:], ids[:, :-1])[:, :width]
            ids[row, at] = best
            if width == 1:
                rank = np.full((len(at), 1), _NEVER, np.int32)
                continue
            rank = np.where(shift[:, :-1], rank[:, 1:], rank[:, :-1])[:, : width - 1]
            right = np.flatnonzero(at < lengths - 1)
            rank[right, at[right]] = self._rank(ids[right, at[right]], ids[right, at[right] + 1])
            ending = np.flatnonzero((at >= lengths - 1) & (at < width - 1))
            rank[ending, at[ending]] = _NEVER
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self._rank(ids[left, at[left] - 1], ids[left, at[left]])

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.minimum(self.pairs.ranks(self.pairs.find(left, right)), _NEVER).astype(np.int32)

    def _merge_long(self, piece: bytes) -> np.ndarray:
        n = len(piece)
        token = self.symbol_ids[self._symbols(np.frombuffer(piece, np.uint8).astype(np.int32)[None], np.array([n]))[0]].tolist()
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, token[i], token[i + 1]) for i in range(n - 1) if (r := self._pair_rank(token[i], token[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j < 0 or token[j] != b:
                continue
            token[i], token[j] = rank, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else -1
                if y >= 0 and (r := self._pair_rank(token[x], token[y])) is not None:
                    heapq.heappush(heap, (r, x, token[x], token[y]))
        return np.array([t for t in token if t >= 0], np.int32)


@functools.lru_cache(maxsize=4)
def _vocabulary(content: bytes) -> _Vocabulary:
    return _Vocabulary(content)


@functools.lru_cache(maxsize=4)
def _compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def _joined(lists: pa.Array, counts: np.ndarray) -> pa.Array:
    """Lists put together: the first counts[0] of them are one list, and so on."""
    ends = np.r_[0, np.cumsum(counts)]
    return pa.ListArray.from_arrays(pa.array(lists.offsets.to_numpy()[ends], pa.int32()), lists.values)


def _encode_some(texts: pa.Array, vocabulary: _Vocabulary, pattern: regex.Pattern) -> pa.Array:
    units, codes, counts = split_texts(texts)
    pieces, per_unit = units_to_pieces(units, pattern)
    distinct = pieces.dictionary_encode()
    by_piece = vocabulary.encode_array(distinct.dictionary.cast(pa.binary())) if len(pieces) else pa.array([], pa.list_(pa.int32()))
    by_unit = _joined(by_piece.take(distinct.indices), per_unit)
    return _joined(by_unit.take(pa.array(codes)), counts)


def bpe_encode(text: Column, ranks: bytes, pattern: str) -> Column:
    """Token ids (array<int>) of a string column; null and empty texts have none.

    ranks: content of a rank file, see ``read_ranks``. pattern: splits a text into the pieces that merge separately.
    Strings of special tokens are ordinary text.
    """

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        texts = texts.fill_null("")
        parts = [_encode_some(texts.slice(at, n), _vocabulary(ranks), _compiled(pattern)) for at, n in text_slices(texts, _BYTES)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return encode(text)


def _decode_all(lists: pa.Array, vocabulary: _Vocabulary) -> pa.Array:
    tokens, out = vocabulary.by_id, []
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for at, n in slices(sizes, _IDS):
        found = tokens.take(lists.slice(at, n).flatten())
        if found.null_count:
            raise KeyError("an id that the vocabulary doesn't have")
        _, offsets, data = found.buffers()
        ends = np.frombuffer(offsets, np.int32)[: len(found) + 1][np.r_[0, np.cumsum(sizes[at : at + n])]]
        out.append(pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), data]))
    return pa.concat_arrays(out) if out else pa.array([], pa.binary())


def bpe_decode(ids: Column, ranks: bytes) -> Column:
    """The bytes (binary) that a column of token ids stands for; null gives no bytes. Unknown ids raise an error."""

    @F.arrow_udf("binary")
    def decode(lists: pa.Array) -> pa.Array:
        return _decode_all(lists, _vocabulary(ranks))

    return decode(ids)


def _round_trips(batches: Iterator[pa.RecordBatch], ranks: bytes, pattern: str) -> Iterator[pa.RecordBatch]:
    """Rows with their text last to rows with (ids, decoded) in its place, a few megabytes of text at once."""
    for batch in batches:
        for at, n in text_slices(batch.columns[-1], _BYTES):
            some, vocabulary = batch.slice(at, n), _vocabulary(ranks)
            ids = _encode_some(some.columns[-1].fill_null(""), vocabulary, _compiled(pattern))
            yield pa.RecordBatch.from_arrays([*some.columns[:-1], ids, _decode_all(ids, vocabulary)], [*batch.schema.names[:-1], "ids", "decoded"])


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """(doc_id, keep, ids array<int>, decoded binary) for each row of ``docs``, repeated rows included.

    decoded: the bytes that the ids stand for. Other columns are ignored. A text is encoded once, whatever is read of it.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), *(F.col(c) for c in keep))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    texts = docs.select(F.col(id_col).alias("doc_id"), *(F.col(c) for c in keep), F.col(text_col).alias("__text"))
    return texts.mapInArrow(lambda it: _round_trips(it, ranks, pattern), f"{columns}, ids array<int>, decoded binary")
