"""Token counts by rank-synchronous merging.

The pre-tokens of a batch lie one after another in one flat array of symbols. In each round every sequence merges all
places of its lowest-ranked pair at once; what is left when no pair can merge is counted.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certus.llm.pretokens import MISS, PairTable, UnitCache, split_units

#: Texts whose units are held at once.
_TEXTS = 512


def read_tokenizer(path: str) -> bytes:
    """The tokenizer file's content. It is read once on the driver (a few MB) and travels with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def _byte_symbols() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a printable character: itself where it is one, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + n) for n, b in enumerate(others)}


class _Merges:
    def __init__(self, content: bytes):
        spec = json.loads(content)
        vocabulary = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        symbols = _byte_symbols()
        self.byte_ids = np.array([vocabulary[symbols[b]] for b in range(256)], np.int64)
        ids = lambda strings: np.array([vocabulary[s] for s in strings], np.int64)
        left, right = ids(a for a, _ in merges), ids(b for _, b in merges)
        self.pairs = PairTable(left, right, np.arange(len(merges), dtype=np.int64), ids(a + b for a, b in merges))

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Number of tokens of each piece."""
        counts = np.array([len(p) for p in pieces], np.int64)
        if not counts.sum():
            return counts
        symbols = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), counts)
        while symbols.size:
            same = np.zeros(len(owner), bool)
            same[:-1] = owner[:-1] == owner[1:]
            slots = np.full(len(owner), -1, np.int64)
            at = np.flatnonzero(same)
            slots[at] = self.pairs.find(symbols[at], symbols[at + 1])
            rank = self.pairs.ranks(slots)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(owner)]))
            live = lowest < MISS
            place = np.flatnonzero((rank == lowest) & live)
            if not place.size:
                break
            # in a run such as "aaaa" the places overlap: every second one counts, from the left
            new_run = np.r_[True, np.diff(place) != 1]
            run_start = place[np.maximum.accumulate(np.where(new_run, np.arange(len(place)), 0))]
            place = place[(place - run_start) % 2 == 0]
            symbols[place] = self.pairs.merged[slots[place]]
            np.subtract.at(counts, owner[place], 1)
            live[place + 1] = False
            symbols, owner = symbols[live], owner[live]
        return counts


@functools.lru_cache(maxsize=4)
def _merges(content: bytes) -> _Merges:
    return _Merges(content)


@functools.lru_cache(maxsize=4)
def _unit_counts(content: bytes, pattern: str) -> UnitCache:
    merges = _merges(content)
    return UnitCache(pattern, lambda pieces: merges.count(pieces).tolist(), sum)


def token_count(text: Column, tokenizer: bytes, pattern: str) -> Column:
    """Number of tokens (bigint) of a string column; null and empty texts have 0.

    tokenizer: content of a byte-level BPE file in JSON, see ``read_tokenizer``. Strings of special tokens inside a text
    count as that one token, as that format's library takes them by default; nothing is added, cut or padded.
    """

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        cache, special = _unit_counts(tokenizer, pattern), _merges(tokenizer).special
        out = np.zeros(len(texts), np.int64)
        for at in range(0, len(texts), _TEXTS):
            units, owner = [], []
            for n, text in enumerate(texts.slice(at, _TEXTS).to_pylist(), at):
                parts = [text or ""]
                for token in special:
                    if token in (text or ""):
                        cut = [p.split(token) for p in parts]
                        out[n] += sum(len(c) - 1 for c in cut)
                        parts = [p for c in cut for p in c]
                units += map(split_units, parts)
                owner += [n] * len(parts)
            cache.prepare(units)
            after = cache.after.__getitem__
            np.add.at(out, owner, [cache.first[head] + sum(map(after, tail)) for head, tail in units])
        return pa.array(out, pa.int64())

    return count(text)


def count_tokens(docs: DataFrame, tokenizer: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) for each row of ``docs``, repeated rows included; other columns are ignored."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), token_count(text, tokenizer, pattern).alias("n_tokens"))
