"""Cutting texts before byte-level merges, and the hashed table of mergeable pairs."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

MISS = np.int64(1 << 40)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: A blank before something that isn't white space always starts a pre-token, whatever stands before it.
_CUT = re.compile(r" (?=\S)")
_LOOSE_BLANK = re.compile(r" (?:\s|\Z)")


def split_units(text: str) -> tuple[str, list[str]]:
    """The first unit of a text, and the following ones without the blank that each starts with.

    No pre-token of the usual byte-level patterns crosses a unit's start, so units can be looked up separately.
    """
    units = _CUT.split(text) if _LOOSE_BLANK.search(text) else text.split(" ")
    return units[0], units[1:]


#: A blank that doesn't start a unit: white space of any kind or the end follows.
_LOOSE = r" (?:[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)"


def split_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct units of all texts (with their blank), the unit's number at each place, and each text's count of places."""
    split = pc.split_pattern(texts, " ")
    loose = np.flatnonzero(pc.match_substring_regex(texts, _LOOSE).to_numpy(zero_copy_only=False))
    if len(loose):
        others = pa.array([_CUT.split(t) for t in texts.take(pa.array(loose)).to_pylist()], split.type)
        place = np.arange(len(texts))
        place[loose] = len(texts) + np.arange(len(loose))
        split = pa.concat_arrays([split, others]).take(pa.array(place))
    flat, ends = split.flatten().dictionary_encode(), split.offsets.to_numpy() - split.offsets[0].as_py()
    heads = flat.take(pa.array(ends[:-1])).dictionary_decode().dictionary_encode()
    codes = flat.indices.to_numpy().copy()
    codes[ends[:-1]] = len(flat.dictionary) + heads.indices.to_numpy()
    units = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar(""), flat.dictionary, pa.scalar(" ")), heads.dictionary])
    return units, codes, np.diff(ends)


def units_to_pieces(units: pa.Array, pattern: regex.Pattern) -> tuple[pa.Array, np.ndarray]:
    """Pre-tokens of the units, one unit after the other, and how many each has."""
    letters = pc.utf8_is_alpha(pc.replace_substring_regex(units, "^ ", "")).to_numpy(zero_copy_only=False)  # one pre-token, as most are
    several = np.flatnonzero(~letters)
    mixed = units.take(pa.array(several)).to_pylist()
    # those that start with a blank can stand next to each other, as they do in texts
    led = [u for u in mixed if u[:1] == " "]
    found, sizes = pattern.findall("".join(led)), np.array([len(u) for u in led], np.int64)
    starts = np.cumsum([0, *map(len, found)])
    if len(led) and starts[-1] == sizes.sum() and np.isin(np.cumsum(sizes), starts).all():
        counts = np.bincount(np.searchsorted(np.cumsum(sizes), starts[:-1], side="right"), minlength=len(led))
    else:
        lists = [pattern.findall(u) for u in led]
        found, counts = [p for some in lists for p in some], np.array([len(some) for some in lists], np.int64)
    rest = [pattern.findall(u) for u in mixed if u[:1] != " "]
    per_mixed = np.empty(len(mixed), np.int64)
    is_led = np.array([u[:1] == " " for u in mixed], bool)
    per_mixed[is_led] = counts
    per_mixed[~is_led] = [len(some) for some in rest]
    per_unit = np.ones(len(units), np.int64)
    per_unit[several] = per_mixed
    # bring the pieces into the units' order
    source = pa.concat_arrays([units.filter(pa.array(letters)), pa.array(found, pa.string()), pa.array([p for some in rest for p in some], pa.string())])
    owner = np.concatenate([np.flatnonzero(letters), np.repeat(several[is_led], per_mixed[is_led]), np.repeat(several[~is_led], per_mixed[~is_led])])
    return source.take(pa.array(np.argsort(owner, kind="stable"))), per_unit


class PairTable:
    """Open-addressing hash table from a pair of token ids to (rank, merged id), looked up by whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        keys = self._key(left, right)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        size = 1 << self.bits
        self.mask = np.int64(size - 1)
        self.keys = np.full(size, _EMPTY)
        self.rank = np.full(size, MISS)
        self.merged = np.full(size, -1, np.int64)
        pending, slot = np.arange(len(keys)), self._slot(keys)
        while pending.size:
            free = pending[self.keys[slot[pending]] == _EMPTY]
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.keys[slot[placed]] = keys[placed]
            self.rank[slot[placed]] = rank[placed]
            self.merged[slot[placed]] = merged[placed]
            pending = np.setdiff1d(pending, placed, assume_unique=True)
            slot[pending] = (slot[pending] + 1) & self.mask

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs; -1 where a pair can't merge. Negative ids are padding."""
        keys = self._key(left, right)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, slot, -1)
        rest = np.flatnonzero((found != keys) & (found != _EMPTY))
        while rest.size:
            slot[rest] = (slot[rest] + 1) & self.mask
            found = self.keys[slot[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = slot[rest[hit]]
            rest = rest[~hit & (found != _EMPTY)]
        return np.where((left < 0) | (right < 0), -1, out)

    def ranks(self, slots: np.ndarray) -> np.ndarray:
        return np.where(slots < 0, MISS, self.rank[slots])


class UnitCache:
    """Results by unit, from results by pre-token; new ones are computed together, and each cache has ``limit`` entries.

    compute: pre-tokens (bytes) to their results. combine: a list of results to the unit's.
    """

    def __init__(self, pattern: str, compute, combine, limit: int = 250_000):
        self.pattern, self.compute, self.combine, self.limit = regex.compile(pattern), compute, combine, limit
        self.first: dict[str, object] = {}
        self.after: dict[str, object] = {}
        self.pieces: dict[str, object] = {}

    def prepare(self, texts: list[tuple[str, list[str]]]) -> None:
        """Make sure that the units of these texts are known."""
        if len(self.first) + len(self.after) > self.limit:
            self.first, self.after = {}, {}
        if len(self.pieces) > self.limit:
            self.pieces = {}
        first = list({head for head, _ in texts}.difference(self.first))
        after = list(set().union(*(tail for _, tail in texts)).difference(self.after))
        single, several = [], {}
        for unit in [*first, *(" " + u for u in after)]:
            if (unit[1:] if unit[:1] == " " else unit).isalpha():
                single.append(unit)  # letters only, as most are: one pre-token
            else:
                several[unit] = self.pattern.findall(unit)
        known = self.pieces
        new = list({p for p in (*single, *(p for found in several.values() for p in found)) if p not in known})
        known.update(zip(new, self.compute([p.encode() for p in new])))
        for unit, found in several.items():
            several[unit] = self.combine([known[p] for p in found])
        for cache, units, lead in ((self.first, first, ""), (self.after, after, " ")):
            cache.update((u, several[lead + u] if lead + u in several else known[lead + u]) for u in units)
