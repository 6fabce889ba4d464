"""Words of texts and their hashes, by Arrow arrays of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are cut to words at once, about; a longer text is cut alone.
BYTES = 2 << 20


def slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows (start, number) that hold about ``most`` together; a larger row is a range of its own."""
    group = (np.cumsum(sizes) - 1) // most
    starts = np.flatnonzero(np.r_[True, np.diff(group) > 0]) if len(sizes) else np.empty(0, np.int64)
    return list(zip(starts.tolist(), np.diff(np.r_[starts, len(sizes)]).tolist()))


def text_slices(texts: pa.Array, most: int = BYTES) -> list[tuple[int, int]]:
    """Ranges of texts (start, number) of about ``most`` bytes together."""
    return slices(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), most)


def words_of(text: str | None) -> list[bytes]:
    """The longest runs without blank, tab, \\n, \\v, \\f and \\r."""
    return (text or "").encode().split()


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts (A-Z in lower case, if asked for), the word's number at each place, and each text's
    count of words. Null texts have none."""
    texts = texts.fill_null("")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten()
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty string
    ends = np.r_[0, np.cumsum(real)][lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    words = flat.dictionary_encode()
    return words.dictionary, words.indices.to_numpy()[real], np.diff(ends)


def hashed_words(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, 64-bit hashes of the words, counts of words) of slices of the texts."""
    for at, n in text_slices(texts):
        words, codes, counts = split_words(texts.slice(at, n), lower)
        distinct = words.cast(pa.binary()).to_pylist()
        yield at, np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[codes], counts


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive values."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    return mix(total)
