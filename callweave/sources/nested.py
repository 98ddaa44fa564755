"""Large nested documents, read by as many tasks as they have blocks.

A JSON document may be one line of any length. It is read in pieces that end at a closing
brace, wherever a block of the file begins or ends. Whether a piece starts inside a string,
and how deep, follows from all pieces before it, so both are prefix sums: first within a
block, then over the blocks' totals. Where the depth is back at one, an entry of the outer
object ends, and its pieces are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import checkpointed

#: Pieces that a task takes, and a block: Spark would count them by their compressed bytes, and alike texts are little of these.
TASK_PIECES, BLOCK_PIECES = 250_000, 25_000


def before(rows: DataFrame, value: Column, out: str, tasks: int) -> DataFrame:
    """``rows`` (file, block, n, ..) with the sum of ``value`` over all rows of the file before each, a block at a time."""
    rows = rows.withColumn("_v", value.cast("long")).repartition(tasks, "file", "block")
    totals = rows.groupBy("file", "block").agg(F.sum("_v").alias("_all"))
    blocks = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("file", "block", F.coalesce(F.sum("_all").over(blocks), F.lit(0)).alias("_shift"))
    own = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn(out, F.coalesce(F.sum("_v").over(own), F.lit(0)))
    return placed.join(shifts, ["file", "block"]).withColumn(out, F.col(out) + F.col("_shift")).drop("_v", "_shift")


def json_entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, entry, value): the outer object of each JSON file at ``path`` in parts, in order, each an object of one entry or a few.

    Entries whose values are no objects come with the next that is one. What follows the
    outer object is left out; an empty or blank file gives nothing.
    """
    raw = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    # a block of the file is cut into blocks of few pieces
    raw = raw.withColumn("block", F.struct("block", F.floor(F.col("n") / BLOCK_PIECES).alias("cut")))
    # escapes never straddle a piece: a brace is not escaped in JSON
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    opens, closes = lambda s: F.length(F.regexp_replace(s, r"[^{\[]+", "")), lambda s: F.length(F.regexp_replace(s, r"[^\]]+", ""))
    braces = lambda odd: (lambda s: opens(s) - closes(s))(F.array_join(F.filter(parts, lambda x, i: i % 2 == odd), ""))
    pieces = checkpointed(raw.select("file", "block", "n", "value", (F.size(parts) - 1).alias("quotes"), braces(0).alias("outside"), braces(1).alias("inside")))
    tasks = max(spark.sparkContext.defaultParallelism, -(-pieces.count() // TASK_PIECES))
    pieces = before(pieces, F.col("quotes"), "quoted", tasks)
    starts_in, ends_in = F.col("quoted") % 2 == 1, (F.col("quoted") + F.col("quotes")) % 2 == 1
    opened = F.when(starts_in, F.col("inside")).otherwise(F.col("outside"))
    pieces = checkpointed(pieces.select("file", "block", "n", "value", (opened - (~ends_in).cast("int")).alias("change"), ends_in.alias("ends_in")))
    pieces = before(pieces, F.col("change"), "depth", tasks).withColumn("after", F.col("depth") + F.col("change"))
    # the outer object's own end, and what comes behind it
    pieces = pieces.where((F.col("after") >= 0) & ((F.col("depth") > 0) | (F.col("change") >= 0)))
    ends = ~F.col("ends_in") & (F.col("after") <= 1)
    pieces = checkpointed(pieces.select("file", "block", "n", "value", "depth", "after", ends.alias("ends")))
    pieces = before(pieces, F.col("ends"), "entry", tasks).repartition(tasks, "file", "entry")
    text = F.when(F.col("depth") == 0, F.regexp_replace("value", r"^\s*\{", "")).otherwise(F.col("value"))
    whole = pieces.groupBy("file", "entry").agg(F.sort_array(F.collect_list(F.struct("block", "n", text.alias("text")))).alias("own"), F.min("after").alias("last"))
    body = F.concat(F.array_join(F.col("own.text"), "}"), F.when(F.col("last") >= 1, "}").otherwise(""))
    found = whole.select("file", "entry", F.regexp_replace(body, r"^[\s,]+", "").alias("body"))
    return found.where(F.trim("body") != "").select("file", "entry", F.concat(F.lit("{"), "body", F.lit("}")).alias("value"))


def xml_elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """The elements ``tag`` of the XML files at ``path``, attributes led by ``_``; elements of that name do not nest.

    An element is a row of its own, however long the line is that it stands in, so a large
    document is read by many tasks. An element without content has nothing below it to read
    and is left out.
    """
    pieces = spark.read.option("lineSep", f"</{tag}>").text(path).where(F.col("value").rlike(rf"<{tag}[\s>]"))
    element = F.concat(F.regexp_replace("value", rf"(?s)^.*(?=<{tag}[\s>])", ""), F.lit(f"</{tag}>"))
    return pieces.select(F.from_xml(element, F.lit(f"struct<{schema}>")).alias("e")).select("e.*")


def beginning(spark: SparkSession, path: str, size: int = 4096) -> str:
    """The first bytes of the file at ``path``, or of the first file with content in that folder, as text."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [s for s in fs.listStatus(at) if s.isFile() and s.getLen() and s.getPath().getName()[0] not in "_."]
    if not files:
        return ""
    stream = fs.open(min(files, key=lambda s: s.getPath().toString()).getPath())
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size), "UTF-8")
    finally:
        stream.close()
