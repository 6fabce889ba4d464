"""Phrases whose words keep together, counted by prefix-free parsing.

Each piece of a text (no phrase crosses its ends) is cut where the hash of a few words in a row says so. Neighbouring
chunks share those words, so that every phrase lies whole in a chunk, and a phrase counts for the chunk that its first
word belongs to: the shared words belong to the later chunk. As cuts depend on the words alone, repeated passages have
equal chunks. Words are counted on the way; the dictionary of different chunks with the number of times each was met is
all that is counted afterwards. It is kept in blocks of some megabytes, in which words are numbers already.

Phrases of n words are counted only where both phrases of n - 1 words inside them are frequent enough: a phrase is no more
frequent than its parts. Which those are is told to tasks by a bitmap of hashes, whose size is fixed; it may let a rare
phrase through, which is then counted and dropped, but never holds a frequent one back.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from certus.llm.words import mix, text_slices, window_hashes
from certus.plans.staging import staged

#: One in so many runs of words is a cut.
CUT_ONE_IN = 16
#: The bitmap of frequent phrases has 2 ** BITS bits (8 MB), however many there are.
BITS = 26
#: Bytes of text, or of chunks, that are worked on at once, about.
_BYTES = 4 << 20
#: Names of phrases stay below this.
_NAMES = 1 << 63

_PIECE_END = np.zeros(256, bool)
_PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True


class _Words:
    """The words of an array of texts: their codes in ``distinct``, the text and the piece that each is in.

    lower: the texts are as they were given, and A-Z are put in lower case. Otherwise they are this module's own chunks or
    phrases: words joined by one blank each, at least one word in each text and no end of a piece.
    """

    def __init__(self, texts: pa.Array, lower: bool):
        texts = texts.fill_null("")
        texts = (pc.ascii_lower(texts) if lower else texts).cast(pa.binary())
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]
        inside, sizes = (self._given if lower else self._joined)(raw, bounds - bounds[0])
        flat = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.py_buffer(raw[inside])]).dictionary_encode()
        self.distinct = flat.dictionary
        self.codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    @cached_property
    def distinct_hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.distinct.to_pylist()), np.uint64, len(self.distinct))

    @cached_property
    def hashes(self) -> np.ndarray:
        return self.distinct_hashes[self.codes]

    def _joined(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes in words, and each word's size."""
        inside = raw != 0x20
        blanks, n = np.flatnonzero(~inside), len(bounds) - 1
        lasts = np.searchsorted(blanks, bounds[1:]) + np.arange(n)  # each text's last word
        is_last = np.zeros(len(blanks) + n, bool)
        is_last[lasts] = True
        ends = np.empty(len(is_last), np.int64)
        ends[is_last], ends[~is_last] = bounds[1:], blanks
        sizes = np.diff(np.r_[0, ends])
        sizes[1:] -= ~is_last[:-1]
        self.text = self.piece = np.repeat(np.arange(n), np.diff(np.r_[-1, lasts]))
        return inside, sizes

    def _given(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes in words, and each word's size."""
        ends_piece = _PIECE_END[raw]
        inside = ~(ends_piece | _BLANK[raw])
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        # a text's first and last byte may stand next to another text's
        edges = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(raw))]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(bounds, starts, "right") - 1
        self.piece = np.searchsorted(np.flatnonzero(ends_piece), starts) + self.text
        return inside, ends - starts

    def runs(self, starts: np.ndarray, size: int) -> pa.Array:
        """As many words from each start on, joined by blanks."""
        return _runs(self.distinct, self.codes, starts, size)

    def phrases(self, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """The words from each start on, joined by blanks."""
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), self.distinct.take(pa.array(self.codes[at])))
        return pc.binary_join(lists, b" ").cast(pa.string())


def _runs(distinct: pa.Array, codes: np.ndarray, starts: np.ndarray, size: int) -> pa.Array:
    found = [distinct.take(pa.array(codes[starts + k])) for k in range(size)]
    return pc.binary_join_element_wise(*found, b" ").cast(pa.string()) if size > 1 else found[0].cast(pa.string())


def _numbered(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place at which each different name stands, and the number of the name at each place."""
    coded = pa.array(names).dictionary_encode()
    number = coded.indices.to_numpy()
    shown = np.empty(len(coded.dictionary), np.int64)
    shown[number] = np.arange(len(number))
    return shown, number.astype(np.int64)


def chunks(words: _Words, overlap: int, one_in: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and number of own words of each chunk; the others are the next chunk's."""
    n = len(words.codes)
    opens = np.r_[True, words.piece[1:] != words.piece[:-1]][:n]
    cut = window_hashes(words.hashes, overlap) % np.uint64(one_in) == 0
    cut &= words.piece[: len(cut)] == words.piece[overlap - 1 :][: len(cut)]
    begins = opens.copy()
    begins[: len(cut)] |= cut
    starts = np.flatnonzero(begins)
    own = np.diff(np.r_[starts, n])
    goes_on = np.r_[~opens[starts[1:]], False][: len(starts)]
    return starts, own + goes_on * overlap, own


def _chunk_rows(batches: Iterator[pa.RecordBatch], overlap: int, one_in: int) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, chunk, own, times): the chunks of some megabytes of text, each once, and their words, each
    once, with own = 0."""
    for batch in batches:
        for at, n in text_slices(batch.column(1), _BYTES):
            words = _Words(batch.column(1).slice(at, n), lower=True)
            starts, sizes, own = chunks(words, overlap, one_in)
            lang = batch.column(0).slice(at, n).take(pa.array(words.text[starts]))
            table = pa.table({"lang": lang, "chunk": words.phrases(starts, sizes), "own": pa.array(own.astype(np.int32))})
            counted = table.group_by(["lang", "chunk", "own"]).aggregate([([], "count_all")]).rename_columns(["lang", "chunk", "own", "times"])
            yield from counted.combine_chunks().to_batches()
            coded = batch.column(0).slice(at, n).dictionary_encode()
            of_text = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            shown, number = _numbered(of_text[words.text] * len(words.distinct) + words.codes)
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary.take(pa.array(of_text[words.text[shown]])), words.runs(shown, 1), pa.array(np.zeros(len(shown), np.int32)), pa.array(np.bincount(number, minlength=len(shown)))],
                ["lang", "chunk", "own", "times"],
            )


#: A block of chunks: their languages; their different words one behind another, the bytes and the hash of each; the words'
#: numbers, chunk by chunk; each chunk's words, own words, times, and number of its language. All but the languages are
#: compressed, as a task's blocks pass through Arrow together.
_BLOCK = {"langs": pa.list_(pa.string()), **dict.fromkeys(("spelled", "bytes", "hashes", "codes", "sizes", "owns", "times", "lang_codes"), pa.binary())}
_BLOCK_DDL = "langs array<string>, " + ", ".join(f"{k} binary" for k in list(_BLOCK)[1:])
_COUNTED = {"lang": pa.string(), "phrase": pa.string(), "a": pa.int64(), "n": pa.int64()}


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, chunk, own, times) to rows of three kinds, in which what belongs to the others is null: (lang, phrase, a) of
    each word, (lang, n) with the number of all own words, and blocks of chunks."""
    schema = pa.schema(_COUNTED | _BLOCK)
    filled = lambda n, /, **found: pa.RecordBatch.from_arrays([found.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)
    held, size = [], 0
    for batch in batches:
        own = pc.greater(batch.column(2), 0)
        words, rest = batch.filter(pc.invert(own)), batch.filter(own)
        if len(words):
            yield filled(len(words), lang=words.column(0), phrase=words.column(1), a=words.column(3))
        for at, n in text_slices(rest.column(1), _BYTES):
            held.append(rest.slice(at, n))
            size += pc.sum(pc.binary_length(held[-1].column(1))).as_py()
            if size >= _BYTES:
                yield from _packed(held, filled)
                held, size = [], 0
    if held:
        yield from _packed(held, filled)


def _compressed(data: pa.Buffer | np.ndarray) -> pa.Array:
    data = pa.py_buffer(data)
    return pa.array([data.size.to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)], pa.binary())


def _restored(value: pa.BinaryScalar) -> pa.Buffer:
    data = value.as_buffer()
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd")


def _packed(held: list[pa.RecordBatch], filled) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    words = _Words(rows.column(1), lower=False)
    lang, own, times = rows.column(0).dictionary_encode(), rows.column(2).to_numpy(), rows.column(3).to_numpy()
    of_lang = lang.indices.to_numpy().astype(np.int32)
    n = np.zeros(len(lang.dictionary), np.int64)
    np.add.at(n, of_lang, own * times)
    yield filled(len(n), lang=lang.dictionary, n=pa.array(n))
    _, offsets, data = words.distinct.buffers()
    bounds = np.frombuffer(offsets, np.int32)[words.distinct.offset : words.distinct.offset + len(words.distinct) + 1]
    parts = {
        "bytes": np.diff(bounds), "hashes": words.distinct_hashes, "codes": words.codes.astype(np.int32), "sizes": np.bincount(words.text, minlength=len(rows)).astype(np.int32),
        "owns": own, "times": times, "lang_codes": of_lang,
    }
    yield filled(
        1,
        langs=pa.array([lang.dictionary.to_pylist()], _BLOCK["langs"]),
        spelled=_compressed((data or pa.py_buffer(b""))[int(bounds[0]) : int(bounds[-1])]),
        **{k: _compressed(np.ascontiguousarray(v)) for k, v in parts.items()},
    )


def _bit(langs: np.ndarray, windows: np.ndarray, bits: int) -> np.ndarray:
    return (mix(windows ^ langs) >> np.uint64(64 - bits)).astype(np.int64)


def _name_hashes(langs: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in langs.to_pylist()), np.uint64, len(langs))


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    return _name_hashes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]


def _phrase_rows(batches: Iterator[pa.RecordBatch], size: int, bitmap: np.ndarray | None, bits: int) -> Iterator[pa.RecordBatch]:
    """(lang, chunk, own, times) to (lang, phrase, a) of phrases of ``size`` words."""
    for rows in _block_rows(batches):
        yield from _block_phrases(iter([rows.filter(rows.column("codes").is_valid()).select(list(_BLOCK))]), size, bitmap, bits)


def _block_phrases(batches: Iterator[pa.RecordBatch], size: int, bitmap: np.ndarray | None, bits: int) -> Iterator[pa.RecordBatch]:
    """Blocks to (lang, phrase, a) of phrases of ``size`` words: those of a block, each once."""
    types = {"bytes": np.int32, "hashes": np.uint64, "codes": np.int32, "sizes": np.int32, "owns": np.int32, "times": np.int64, "lang_codes": np.int32}
    for batch in batches:
        for row in range(len(batch)):
            langs = batch.column(0)[row].values
            lengths, hashes, codes, sizes, owns, times, of_lang = (np.frombuffer(_restored(batch.column(k)[row]), types[k]) for k in types)
            offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
            distinct = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), _restored(batch.column("spelled")[row])])
            place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            starts = np.flatnonzero(place < np.repeat(np.minimum(owns, sizes - size + 1), sizes))
            owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            if bitmap is not None and len(starts):
                windows = window_hashes(hashes[codes], size - 1)
                at_bit = _bit(_name_hashes(langs)[of_lang][owner[: len(windows)]], windows, bits)
                frequent = (bitmap[at_bit >> 6] >> (at_bit & 63).astype(np.uint64)) & np.uint64(1) == 1
                starts = starts[frequent[starts] & frequent[starts + 1]]
            if not len(starts):
                continue
            # equal phrases have equal names: a name stands for the name of all words but the last, and the last
            name, span = of_lang[owner[starts]].astype(np.int64), len(langs)
            for k in range(size):
                if span * len(distinct) >= _NAMES:
                    shown, name = _numbered(name)
                    span = len(shown)
                name, span = name * len(distinct) + codes[starts + k], span * len(distinct)
            shown, name = _numbered(name)
            a = np.zeros(len(shown), np.int64)
            np.add.at(a, name, times[owner[starts]])
            shown = starts[shown]
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(of_lang[owner[shown]])), _runs(distinct, codes, shown, size), pa.array(a)], ["lang", "phrase", "a"])


def _bit_rows(batches: Iterator[pa.RecordBatch], size: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase) of phrases of ``size`` words to (at, mask): 64-bit words of a task's bitmap that aren't empty."""
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    for batch in batches:
        for at, n in text_slices(batch.column(1), _BYTES):
            words = _Words(batch.column(1).slice(at, n), lower=False)
            bit = _bit(_lang_hashes(batch.column(0).slice(at, n)), window_hashes(words.hashes, size)[::size], bits)
            np.bitwise_or.at(bitmap, bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64))
    at = np.flatnonzero(bitmap)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bitmap[at].view(np.int64))], ["at", "mask"])


def _bitmap(frequent: DataFrame, size: int, bits: int) -> np.ndarray:
    """The bitmap of these phrases, gathered on the driver: 2 ** (bits - 6) rows at most."""
    rows = frequent.select("lang", "phrase").mapInArrow(lambda it: _bit_rows(it, size, bits), "at bigint, mask bigint")
    found = rows.groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    bitmap[found.column("at").to_numpy()] = found.column("mask").to_numpy()
    return bitmap.view(np.uint64)


def phrase_counts(docs: DataFrame, longest: int = 4, least: int = 30, lang_col: str = "lang", text_col: str = "text", bits: int = BITS, one_in: int = CUT_ONE_IN) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, a) for phrases of 1 to ``longest`` words with a >= ``least``, and (lang, n): all words.

    a counts all occurrences in pieces, overlapping ones too. The phrase's words, A-Z in lower case, are joined by blanks.
    """
    overlap = longest - 1
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    met = texts.mapInArrow(lambda it: _chunk_rows(it, overlap, one_in), "lang string, chunk string, own int, times bigint")
    # of words, only the frequent ones are needed
    met = met.groupBy("lang", "chunk", "own").agg(F.sum("times").alias("times")).filter((F.col("own") > 0) | (F.col("times") >= least))
    dictionary = staged(met.mapInArrow(_block_rows, f"lang string, phrase string, a bigint, n bigint, {_BLOCK_DDL}"), "chunks")
    totals = dictionary.filter("n is not null").groupBy("lang").agg(F.sum("n").alias("n"))
    levels, bitmap = [], None
    for size in range(1, longest + 1):
        if size == 1:
            level = dictionary.filter("phrase is not null").select("lang", "phrase", "a")
        else:
            blocks = dictionary.filter("codes is not null").select(*_BLOCK)
            found = blocks.mapInArrow(lambda it, size=size, bitmap=bitmap: _block_phrases(it, size, bitmap, bits), "lang string, phrase string, a bigint")
            level = found.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
        level = staged(level, f"phrases-{size}")
        levels.append(level.select("lang", F.lit(size).alias("size"), "phrase", "a"))
        if size < longest:
            bitmap = _bitmap(level, size, bits)
    counts = levels[0]
    for level in levels[1:]:
        counts = counts.unionByName(level)
    return counts, totals


def mine_phrases(docs: DataFrame, longest: int = 4, least: int = 30, most: int = 2000, share: int = 80, lang_col: str = "lang", text_col: str = "text", **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``most`` best phrases of 2 to ``longest`` words.

    Candidates have a >= ``least`` occurrences. A cut after the first words has l and r occurrences of its parts and the
    score floor(2000000 * a / (l + r)); the lowest-scoring cut counts, of equal ones the first. A candidate inside a longer
    one with 100 * f >= ``share`` * a goes. Order: score and a descending, then the phrase by its bytes. Products are
    decimals of 38 digits. n is the language's number of words. Null languages are ``und``; null and empty texts have no
    words; repeated rows count each time; other columns are ignored. An empty table gives no rows.
    """
    counts, totals = phrase_counts(docs, longest, least, lang_col, text_col, **how)
    big = lambda c: F.col(c).cast("decimal(20,0)")
    words = F.split("phrase", " ")
    long = counts.filter("size > 1")
    # a longer candidate that is frequent enough has one of a word more inside that is at least as frequent
    inner = long.filter("size > 2").select(
        "lang", F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("size") - 1), " "))).alias("phrase"), F.col("a").alias("longer")
    )
    covering = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = long.join(covering, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * big("longer") < share * big("a"))).select("lang", "size", "phrase", "a")
    kept = staged(kept, "phrases-kept")
    parts = kept.select("lang", "size", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("tail")
    )
    side = lambda part, name: counts.select("lang", F.col("phrase").alias(part), F.col("a").alias(name))
    cuts = parts.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"])
    cuts = cuts.withColumn("score", F.expr("(2000000BD * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the best of parts of a language come first, so that no task gets all of its candidates
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = best.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= most)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
