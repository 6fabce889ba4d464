"""Fill-in-the-middle: texts rearranged so that their middle comes last, as pyarrow.compute pipelines over batches.

A batch's texts are split to lists of units, the units are flattened beside their text's number, their ordinals give them
a role (prefix, middle or suffix), each role's units become lists again and are joined to pieces, and the pieces are put
together around the sentinels. All steps are kernels over whole arrays; memory follows a slice of about 2 MB of text, or
one longer text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certus.llm.words import text_slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_SENTINEL = "<[PSM]>"
#: White space before a word belongs to its unit; white space at the end is a unit.
_UNIT = rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: A byte that no UTF-8 text has.
_GAP = b"\xff"
_RESULT = "struct<n:bigint,form:string,output:string,prefix_chars:bigint,middle_chars:bigint>"


def unit_lists(texts: pa.Array) -> pa.ListArray:
    """The units of each text (binary, no nulls), and an empty one behind them."""
    return pc.split_pattern(pc.replace_substring_regex(texts, pattern=_UNIT, replacement=rb"\0" + _GAP), pattern=_GAP)


def _modulo(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _rebuilt(flat: pa.Array, chosen: pa.Array, sizes: pa.Array) -> pa.Array:
    """The chosen units as lists of these sizes, each joined to one string."""
    offsets = np.r_[0, np.cumsum(sizes.to_numpy(zero_copy_only=False))]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat.filter(chosen)), b"")


def pieces(texts: pa.Array, first: pa.Array, second: pa.Array) -> tuple[pa.Array, ...]:
    """(number of units, prefix, middle, suffix) of each text: cut after ``first`` % (n + 1) and ``second`` % (n + 1) units."""
    lists = unit_lists(texts)
    n = pc.subtract(pc.cast(pc.list_value_length(lists), pa.int64()), 1)
    places = pc.add(n, 1)
    one, other = _modulo(first, places), _modulo(second, places)
    low, high = pc.min_element_wise(one, other), pc.max_element_wise(one, other)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    starts = pa.array(np.r_[0, np.cumsum(places.to_numpy())[:-1]]) if len(texts) else pa.array([], pa.int64())
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), starts.take(parent))
    before, until = pc.less(ordinal, low.take(parent)), pc.less(ordinal, high.take(parent))
    return (
        n,
        _rebuilt(flat, before, low),
        _rebuilt(flat, pc.and_not(until, before), pc.subtract(high, low)),
        _rebuilt(flat, pc.invert(until), pc.subtract(places, high)),
    )


def _rearranged(texts: pa.Array, draws: list[pa.Array], rate: int, spm: int) -> pa.StructArray:
    texts = texts.fill_null("").cast(pa.binary())
    n, prefix, middle, suffix = pieces(texts, draws[0], draws[1])
    plain = pc.or_(
        pc.or_(pc.equal(n, 0), pc.match_substring_regex(texts, pattern=_SENTINEL)),
        pc.greater_equal(_modulo(draws[2], pa.scalar(100)), rate),
    )
    by_suffix = pc.less(_modulo(draws[3], pa.scalar(100)), spm)
    join = pc.binary_join_element_wise
    form = pc.if_else(plain, "plain", pc.if_else(by_suffix, "spm", "psm"))
    output = pc.if_else(
        plain, texts, pc.if_else(by_suffix, join(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, b""), join(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, b""))
    )
    chars = lambda piece: pc.if_else(plain, pa.scalar(None, pa.int64()), pc.cast(pc.utf8_length(piece.cast(pa.string())), pa.int64()))
    return pa.StructArray.from_arrays([n, form, output.cast(pa.string()), chars(prefix), chars(middle)], ["n", "form", "output", "prefix_chars", "middle_chars"])


def _restored(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts that outputs of these forms were made of."""
    outputs, moved = outputs.fill_null(""), pc.fill_null(pc.not_equal(forms, "plain"), False)
    # a text without sentinels has three of them in its output, so four parts, the first of them empty
    parts = pc.split_pattern_regex(outputs.filter(moved), pattern=_SENTINEL)
    flat, at = parts.flatten(), np.arange(len(parts)) * 4
    if len(flat) != 4 * len(parts):
        raise ValueError("an output without its three sentinels")
    part = lambda k: flat.take(pa.array(at + k))
    by_suffix = pc.equal(forms.filter(moved), "spm")
    texts = pc.binary_join_element_wise(pc.if_else(by_suffix, part(2), part(1)), part(3), pc.if_else(by_suffix, part(1), part(2)), "")
    return pc.replace_with_mask(outputs, moved, texts)


def fill_in_middle(text: Column, key: Column, seed: int = 42, rate: int = 50, spm: int = 80) -> Column:
    """A struct (n, form, output, prefix_chars, middle_chars) for each text.

    ``key`` tells texts apart (an id): the sha256 of ``seed:key`` gives four numbers. The first two, modulo n + 1, are the
    units after which the prefix and the middle end; ``rate`` percent of the texts by the third are moved, ``spm`` percent
    of those by the fourth as suffix, prefix, middle, the others as prefix, suffix, middle. Null and empty texts (n = 0),
    and those with a sentinel in them, are plain: output is the text, prefix_chars and middle_chars are null. A null key
    counts as an empty one; equal keys draw alike.
    """

    @F.arrow_udf(_RESULT)
    def rearrange(texts: pa.Array, one: pa.Array, two: pa.Array, three: pa.Array, four: pa.Array) -> pa.Array:
        spans = text_slices(texts) or [(0, 0)]
        return pa.concat_arrays([_rearranged(texts.slice(at, n), [d.slice(at, n) for d in (one, two, three, four)], rate, spm) for at, n in spans])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]
    # so that the optimizer doesn't copy the call into each use of the result
    return rearrange.asNondeterministic()(text, *draws)


def restore_text(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` made this output of; null gives an empty one. Outputs of another make raise."""

    @F.arrow_udf("string")
    def restore(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        spans = text_slices(outputs) or [(0, 0)]
        return pa.concat_arrays([_restored(outputs.slice(at, n), forms.slice(at, n)) for at, n in spans])

    return restore(output, form)


def rearrange_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, n, form, output, prefix_chars, middle_chars, restored) for each row, repeated rows included.

    Other columns are ignored. ``restored`` is the text rebuilt from output and form.
    """
    moved = docs.select(F.col(id_col).alias("doc_id"), fill_in_middle(F.col(text_col), F.col(id_col), **how).alias("moved"))
    return moved.select("doc_id", "moved.*", restore_text(F.col("moved.output"), F.col("moved.form")).alias("restored"))
