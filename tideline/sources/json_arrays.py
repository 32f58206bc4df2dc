"""Files that are one JSON array of objects, read by as many tasks as they have splits.

Spark splits text at any line separator, here the closing brace. What a piece means depends on what is before it: whether
it begins inside a string, and how deep. Both are running sums over the pieces of a file (quotes, modulo two, and brackets
outside strings), so that the borders of records come from two scans and no task reads a file from its start.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.temporal import cut, ranged, running, shared_folder

ORDER = ["block", "n"]


def _count(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text of the files cut after every closing brace (which is left out), with what puts the pieces in order: file, block, n."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("piece"))


def is_array(spark: SparkSession, path: str) -> bool:
    """Whether all files begin with an array."""
    firsts = pieces(spark, path).where("block = 0").groupBy("file").agg(F.min_by(F.ltrim(F.substring("piece", 1, 1_000)), "n").alias("first"))
    found = firsts.agg(F.bool_and(F.col("first").rlike(r"^[\s\x{FEFF}]*\[")).alias("ok")).first()["ok"]
    return bool(found)


def records(spark: SparkSession, path: str) -> DataFrame:
    """Columns file, record (their order in it) and json, a line of text for every object of each file's array.

    An element that isn't an object is an error when it is met.
    """
    # no escape can straddle a border: a backslash before a closing brace is none in JSON
    plain = F.regexp_replace("piece", r"\\.", "")
    stored = ranged(pieces(spark, path).withColumns({"plain": plain, "quotes": _count(plain, '"')}), ["file", *ORDER])
    quoted = running(stored.select("file", *ORDER, "_part", "plain", "quotes"), ORDER, {"upto": F.col("quotes")}, by=["file"])
    inside = (F.col("upto") - F.col("quotes")) % 2 == 1
    bare = F.regexp_replace(F.when(inside, F.concat(F.lit('"'), F.col("plain"))).otherwise(F.col("plain")), r'"[^"]*("|$)', "")
    closes = F.col("upto") % 2 == 0
    steps = cut(quoted.select("file", *ORDER, "_part", closes.alias("closes"), (_count(bare, "{[") - _count(bare, "}]") - closes.cast("int")).alias("step")))
    deep = cut(running(steps, ORDER, {"depth": F.col("step")}, by=["file"]).select("file", *ORDER, "_part", (F.col("closes") & (F.col("depth") == 1)).cast("int").alias("ends")))
    numbered = running(deep, ORDER, {"ended": F.col("ends")}, by=["file"]).select("n", (F.col("ended") - F.col("ends")).alias("record"), "ends")
    rows = stored.select("file", *ORDER, "piece").join(numbered, "n").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct(*ORDER, "piece"))).alias("all"), F.max("ends").alias("whole"))
    text = F.concat(F.array_join(F.transform("all", lambda x: x["piece"]), "}"), F.lit("}"))
    start = F.instr(text, "{")
    lead = F.substring(text, F.lit(1), start - 1)
    fault = F.raise_error(F.concat(F.lit("an element of the array is no object: "), F.substring(text, 1, 80))).cast("string")
    line = F.when(lead.rlike(r"^[\s,\[\x{FEFF}]*$"), F.translate(F.substring(text, start, F.char_length(text)), "\r\n", "  ")).otherwise(fault)
    # what follows the last object is the array's end
    tail = F.when(F.regexp_replace(F.array_join(F.transform("all", lambda x: x["piece"]), "}"), r"[\s\[\]]", "") != "", fault)
    return rows.select("file", "record", F.when(F.col("whole") == 1, line).otherwise(tail).alias("json")).where("json is not null")


def as_lines(spark: SparkSession, path: str, *, limit: int | None = None) -> str:
    """A new folder below the shared one with the records as JSON lines; with a limit, the first ones of the files in order of their names."""
    out = f"{shared_folder(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
    found = records(spark, path)
    found = found if limit is None else found.orderBy("file", "record").limit(limit)
    found.select("json").write.text(out)
    return out
