"""Readers of answer records: JSON lines with faults, JSON, CSV with JSON cells, Parquet."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certus.functions.text import strip
from certus.plans.staging import staged
from certus.schema import RECORD, SCORING_RECORD

#: Bytes of a JSON file up to which one task reads it whole.
WHOLE = 1 << 18
_BLANKS = re.compile(r"[ \t\n\r]*")
_DECODER = json.JSONDecoder(parse_float=str, parse_int=str, strict=False)


def _parsed(text: Column, schema: T.StructType) -> Column:
    """Struct of the known fields of a JSON object; of a scoring record's lists as their JSON text.

    There, a list that is written as a JSON string keeps its quotes, so that it isn't taken for a list.
    """
    plain = F.from_json(text, T.MapType(T.StringType(), T.StringType()))
    exact = F.try_parse_json(text)
    quoted = {"top_logprobs", "logprobs_data"} if schema == SCORING_RECORD else set()
    field = lambda f: F.to_json(F.try_variant_get(exact, f"$.{f.name}", "variant")) if f.name in quoted else plain[f.name].try_cast(f.dataType)
    return F.struct(*(field(f).alias(f.name) for f in schema))


def parse_lines(lines: DataFrame, schema: T.StructType = RECORD, strip_commas: bool = True) -> tuple[DataFrame, DataFrame]:
    """Records of the column ``value``, and the lines that aren't JSON objects (blank ones too)."""
    text = strip(F.col("value"))
    text = F.rtrim(text, F.lit(", ")) if strip_commas else text
    tried = lines.select("value", text.alias("__text")).withColumn("__ok", F.startswith("__text", F.lit("{")) & F.from_json("__text", T.MapType(T.StringType(), T.StringType())).isNotNull())
    good = tried.filter("__ok").select(_parsed(F.col("__text"), schema).alias("r")).select("r.*")
    return good, tried.filter("NOT coalesce(__ok, false)").select("value")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType = RECORD, strip_commas: bool = True) -> DataFrame:
    """Records of a file of JSON lines; faulty lines are left out, see ``parse_lines`` for them."""
    return parse_lines(spark.read.text(path), schema, strip_commas)[0]


def _count(text: Column, one: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(one), F.lit("")))


def _before(value: Column, within: Window) -> Column:
    """Sum of a column over the rows before this one."""
    return F.coalesce(F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def objects(text: str) -> list[str] | None:
    """The objects of a list of items, or the one object, as the text has them; None if it isn't JSON."""
    blanks = lambda at: _BLANKS.match(text, at).end()
    at, out = blanks(0), []
    if at == len(text):
        return out
    several = text[at] == "["
    at = blanks(at + several)
    more = not several or text[at : at + 1] != "]"
    try:
        while more:
            item, end = _DECODER.raw_decode(text, at)
            if isinstance(item, dict):
                out.append(text[at:end])
            at = blanks(end)
            more = several and text[at : at + 1] == ","
            at = blanks(at + more)
    except (ValueError, RecursionError):
        return None
    if several:
        at = blanks(at + 1) if text[at : at + 1] == "]" else -1
    return out if at == len(text) else None


def _file_objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, bytes) to (value, None) for each object, and (None, file) for a file that isn't JSON."""
    for b in batches:
        for file, raw in zip(b.column(0).to_pylist(), b.column(1)):
            try:
                found = objects(raw.as_buffer().to_pybytes().decode())
            except UnicodeDecodeError:
                found = None
            values, files = ([None], [file]) if found is None else (found, [None] * len(found))
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(files, pa.string())], ["value", "file"])


def json_items(spark: SparkSession, path: str) -> DataFrame:
    """(value): the objects of files with a list of items, or with one object, read by many tasks; other items are left out.

    Small files are read whole; large ones, and those that aren't JSON, by ``_pieces``.
    """
    size, file = F.col("_metadata.file_size"), F.col("_metadata.file_path")
    small = spark.read.text(path, wholetext=True).filter(size <= WHOLE).select(file.alias("file"), F.col("value").cast("binary").alias("raw"))
    # Spark counts each file as some megabytes, and so takes few into a task
    tasks = small.rdd.getNumPartitions()
    small = small.coalesce(max(1, min(tasks, max(-(-tasks // 16), 4 * spark.sparkContext.defaultParallelism))))
    whole = staged(small.mapInArrow(_file_objects, "value string, file string"), "json-files")
    found = whole.filter("value IS NOT NULL").select("value")
    pieces = spark.read.text(path, lineSep="}").select("value", file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), size.alias("size"))
    large = pieces.filter(F.col("size") > WHOLE).drop("size")
    broken = whole.filter("value IS NULL").select("file")
    if not broken.isEmpty():
        found = found.unionByName(_pieces(pieces.filter(F.col("size") <= WHOLE).drop("size").join(broken, "file", "left_semi")))
    return found if large.isEmpty() else found.unionByName(_pieces(large))


def _pieces(pieces: DataFrame) -> DataFrame:
    """(value): the objects of files from (value, file, block, place) of pieces.

    A file is cut behind every closing brace. Blocks of these pieces say how many quotes they hold, so that sums over the
    blocks before tell where strings begin, and then how many braces and brackets they open and close outside strings. An
    object of the list starts where one brace opens at the list's depth; the pieces of longer objects are put together by a
    shuffle. A file that isn't JSON gives what looks like objects, which ``parse_lines`` checks.
    """
    # escapes are masked by as many characters, so that the quotes that are left begin or end strings
    pieces = pieces.withColumn("masked", F.regexp_replace("value", r"(?s)\\.", "__"))
    pieces = staged(pieces.withColumn("odd", F.pmod(_count(F.col("masked"), '"'), F.lit(2))), "json-pieces")
    in_block, in_file = Window.partitionBy("file", "block").orderBy("place"), Window.partitionBy("file").orderBy("block")
    # a file has a block for some hundred megabytes
    quotes = pieces.groupBy("file", "block").agg(F.sum("odd").alias("odds")).select("file", "block", _before(F.col("odds"), in_file).alias("entered"))
    known = pieces.join(quotes, ["file", "block"]).withColumn("inside", F.pmod(F.col("entered") + _before(F.col("odd"), in_block), F.lit(2)) == 1)
    # what follows the string that the piece begins in
    begins = F.when(~F.col("inside"), F.lit(0)).when(F.contains("masked", F.lit('"')), F.instr("masked", '"'))
    rest = F.when(begins.isNotNull(), F.expr("substring(masked, begins + 1)"))
    known = known.withColumn("begins", begins).withColumn("rest", F.coalesce(rest, F.lit("")))
    outside = F.regexp_replace(F.regexp_replace("rest", '"[^"]*"', ""), '"[^"]*$', "")
    closes = (F.pmod(F.col("inside").cast("int") + F.col("odd"), F.lit(2)) == 0).cast("int")
    known = known.withColumn("outside", outside).withColumn("steps", _count(F.col("outside"), "{") + _count(F.col("outside"), "[") - _count(F.col("outside"), "]") - closes)
    lead = F.regexp_extract("rest", r'^([^"{]*+(?:"[^"]*+"[^"{]*+)*+)\{', 1)
    opens = F.contains("outside", F.lit("{"))
    plain = F.regexp_replace(lead, '"[^"]*"', "")
    known = staged(known.withColumns({"lead": F.when(opens, F.char_length(lead)), "lead_steps": _count(plain, "[") - _count(plain, "]")}).select("file", "block", "place", "value", "begins", "steps", "lead", "lead_steps"), "json-depths")
    heads = known.groupBy("file").agg(F.startswith(F.ltrim(F.regexp_replace(F.min_by("value", F.struct("block", "place")), r"^\s+", "")), F.lit("[")).cast("int").alias("base"))
    depths = known.groupBy("file", "block").agg(F.sum("steps").alias("all")).select("file", "block", _before(F.col("all"), in_file).alias("above"))
    deep = known.join(depths, ["file", "block"]).join(heads, "file").withColumn("depth", F.col("above") + _before(F.col("steps"), in_block))
    deep = deep.withColumns({"starts": F.col("lead").isNotNull() & (F.col("depth") + F.col("lead_steps") == F.col("base")), "ends": F.col("depth") + F.col("steps") == F.col("base")})
    deep = staged(deep.select("file", "block", "place", "starts", "ends", F.when(F.col("starts"), F.expr("substring(value, begins + lead + 1)")).otherwise(F.col("value")).alias("text")), "json-items")
    alone = F.col("starts") & F.col("ends")
    firsts = deep.groupBy("file", "block").agg(F.count_if("starts").alias("n")).select("file", "block", _before(F.col("n"), in_file).alias("items"))
    upto = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = deep.join(firsts, ["file", "block"]).withColumn("item", F.col("items") + F.sum(F.col("starts").cast("int")).over(upto)).filter(~alone & (F.col("item") > 0))
    # pieces behind an object's end belong to items that aren't objects
    several = numbered.groupBy("file", "item").agg(F.max("starts").alias("whole"), F.min(F.when(F.col("ends"), F.struct("block", "place"))).alias("end"), F.sort_array(F.collect_list(F.struct("block", "place", "text"))).alias("parts")).filter("whole AND end IS NOT NULL")
    kept = F.filter("parts", lambda p: F.struct(p["block"], p["place"]) <= F.struct(F.col("end.block"), F.col("end.place")))
    joined = several.select(F.concat(F.array_join(F.transform(kept, lambda p: p["text"]), "}"), F.lit("}")).alias("value"))
    return deep.filter(alone).select(F.concat("text", F.lit("}")).alias("value")).unionByName(joined)


def read_json(spark: SparkSession, path: str, schema: T.StructType = SCORING_RECORD) -> DataFrame:
    """Files with a list of objects or one object; other items are left out."""
    return parse_lines(json_items(spark, path), schema, strip_commas=False)[0]


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """(text): the rows of CSV files without their headers, line breaks in quoted cells included, read by many tasks.

    A line starts a row if an even number of quotes stands before it. Blocks of a file say how many quotes they have and
    how many rows start in them either way; sums over the blocks before tell each block where it stands. Only rows of
    several lines are put together by a shuffle. Quotes in cells that aren't quoted aren't allowed; empty lines are left
    out.
    """
    read = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    lines = staged(read.withColumn("odd", F.pmod(quotes, F.lit(2))), "csv-lines")
    inside = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    turned = lines.withColumn("turned", F.pmod(F.coalesce(F.sum("odd").over(inside), F.lit(0)), F.lit(2)))
    blocks = turned.groupBy("file", "block").agg(F.sum("odd").alias("odds"), F.count_if(F.col("turned") == 0).alias("even_starts"), F.count_if(F.col("turned") == 1).alias("odd_starts"))
    # a file has a block for some hundred megabytes
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("entered", F.pmod(F.coalesce(F.sum("odds").over(earlier), F.lit(0)), F.lit(2)))
    starts = F.when(F.col("entered") == 0, F.col("even_starts")).otherwise(F.col("odd_starts"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum(starts).over(earlier), F.lit(0))).select("file", "block", "entered", "before")
    upto = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turned.join(blocks, ["file", "block"]).withColumn("starts", F.col("turned") == F.col("entered"))
    numbered = placed.withColumn("row", F.col("before") + F.sum(F.col("starts").cast("int")).over(upto)).select("file", "row", "place", "value", "starts", "odd")
    numbered = staged(numbered.filter("row > 1"), "csv-numbered")  # the first is the header
    alone = F.col("starts") & (F.col("odd") == 0)
    several = numbered.filter(~alone).groupBy("file", "row").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("parts"))
    joined = several.select(F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("text"))
    rows = numbered.filter(alone).select(F.col("value").alias("text")).unionByName(joined)
    return rows.select(F.regexp_replace("text", "\r$", "").alias("text")).filter("text <> ''")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """content_id and a cell with JSON tokens; see ``csv_rows``."""
    parsed = F.from_csv("text", F.lit("content_id string, top_logprobs string"), {"quote": '"', "escape": '"'})
    return csv_rows(spark, path).select(parsed.alias("r")).select("r.*").withColumn("logprobs_data", F.lit(None).cast("string"))


def read_records(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Scoring records by the path's suffix (any case), or ``fmt``. An unknown one: ValueError; no file: as Spark says."""
    kind = (fmt or path.rsplit(".", 1)[-1]).lower()
    if kind == "jsonl":
        return read_json_lines(spark, path, SCORING_RECORD, strip_commas=False)
    if kind == "json":
        return read_json(spark, path)
    if kind == "csv":
        return read_csv(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported input format: {kind}")
