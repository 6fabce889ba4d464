"""Token ids of lower-case vocabularies with word ends, by the padded matrices of ``bpe``.

The texts' distinct words are encoded once a slice. Words of printable ASCII and of the letters from U+00C0 to U+00FF are
cut and merged here; any other word, and those with a special token in them, are left to the tokenizers library itself.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from certus.llm.bpe import _joined, _Vocabulary
from certus.llm.pretokens import PairTable
from certus.llm.token_counts import _byte_symbols
from certus.llm.words import split_words

#: What a file must say for the cuts below to be right.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_PLAIN = r"^[\x21-\x7e\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+$"
_LETTERS = r"^[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]+$"
#: _SPLIT for plain words in lower case, and the blank between them.
_CUT = re.compile(r" |'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ a-zß-öø-ÿ0-9]+")


class WordVocabulary(_Vocabulary):
    """Merges of a JSON file: a word's last symbol carries the mark of its end."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, cuts = spec["model"], spec["pre_tokenizer"].get("pretokenizers", [{}])
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or model["ignore_merges"] or model["dropout"] or steps != _NORMALIZERS or cuts[0].get("pattern") != {"Regex": _SPLIT} or spec["truncation"] or spec["padding"]:
            raise ValueError("not a tokenizer of lower-case words with word ends")
        ids, end = model["vocab"], model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        symbols = _byte_symbols()
        self.symbol_ids = np.array([ids[symbols[b]] for b in range(256)] + [ids[symbols[b] + end] for b in range(256)], np.int32)
        left, right, merged = (np.array([ids[x] for x in side], np.int64) for side in ([a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges]))
        if (np.diff(merged) <= 0).any():
            raise ValueError("the merges' ids aren't in the order of their ranks")
        self.pairs = PairTable(left, right, merged, merged)
        self.pair_ranks = dict(zip(zip(left.tolist(), right.tolist()), merged.tolist()))
        self.first_rank = self._first_ranks()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.library = Tokenizer.from_str(content)
        # whole words that merging leads to, so that they can be looked up
        byte_of = {c: b for b, c in symbols.items()}
        whole = [(bytes(map(byte_of.get, token.removesuffix(end))), i) for token, i in ids.items() if token.endswith(end) and set(token.removesuffix(end)) <= byte_of.keys()]
        self.known, self.known_ids = pa.array([bytes([b]) for b in range(256)], pa.binary()), self.symbol_ids[256:]
        pieces = pa.array([w for w, _ in whole if w], pa.binary())
        found, want = self.encode_array(pieces), np.array([i for w, i in whole if w], np.int32)
        single = np.flatnonzero(found.value_lengths().to_numpy() == 1)
        single = single[found.take(pa.array(single)).flatten().to_numpy() == want[single]]
        self.known, self.known_ids = pa.concat_arrays([self.known, pieces.take(pa.array(single))]), np.r_[self.known_ids, want[single]]

    def _symbols(self, raw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        raw = raw.copy()
        raw[np.arange(len(raw)), lengths - 1] += 256
        return raw

    def _pair_rank(self, left: int, right: int) -> int | None:
        return self.pair_ranks.get((left, right))

    def encode_words(self, words: pa.Array) -> pa.Array:
        """Ids (list<int32>) of words without white space at which texts are split."""
        plain = pc.match_substring_regex(words, _PLAIN)
        for token in self.special:
            plain = pc.and_not(plain, pc.match_substring(words, token))
        plain = plain.to_numpy(zero_copy_only=False)
        others = self.library.encode_batch(words.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)
        other_ids = pa.array([e.ids for e in others], pa.list_(pa.int32()))
        low = pc.utf8_lower(words.filter(pa.array(plain)))
        letters = pc.match_substring_regex(low, _LETTERS).to_numpy(zero_copy_only=False)
        found = _CUT.findall(" ".join(low.filter(pa.array(~letters)).to_pylist()))
        real = np.array([p != " " for p in found], bool)
        mixed = np.bincount(np.cumsum(~real)[real], minlength=int((~letters).sum()))
        pieces = pa.concat_arrays([low.filter(pa.array(letters)), pa.array(found, pa.string()).filter(pa.array(real))]).dictionary_encode()
        merged = self.encode_array(pieces.dictionary.cast(pa.binary())).take(pieces.indices) if len(pieces) else pa.array([], pa.list_(pa.int32()))
        by_word = pa.concat_arrays([_joined(merged, np.r_[np.ones(int(letters.sum()), np.int64), mixed]), other_ids])
        source = np.flatnonzero(plain)
        place = np.empty(len(words), np.int64)
        place[np.r_[source[letters], source[~letters], np.flatnonzero(~plain)]] = np.arange(len(words))
        return by_word.take(pa.array(place))


@functools.lru_cache(maxsize=2)
def word_vocabulary(content: str) -> WordVocabulary:
    return WordVocabulary(content)


def encode_texts(texts: pa.Array, vocabulary: WordVocabulary, end: int) -> pa.ListArray:
    """Ids (list<int32>) of each text and ``end``; null texts have that only.

    White space is dropped by the tokenizer and none of its rules reaches across, so words can be encoded by themselves.
    """
    words, codes, counts = split_words(texts)
    by_word = pa.concat_arrays([vocabulary.encode_words(words), pa.array([[end]], pa.list_(pa.int32()))])
    ends = np.cumsum(counts)
    return _joined(by_word.take(pa.array(np.insert(codes, ends, len(words)))), counts + 1)
