"""The function that a cursor stands in, found from the text of the lines at and above it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Declarations by language, in the order to try, and words that are no names.
DECLARATIONS = (
    r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(",
    r"^\s*(?:public|private|protected|static|async|override|\*)*\s*(\w+)\s*\(",
    r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:\(|function)",
    r"^\s*(?:async\s+)?def\s+(\w+)\s*\(",
    r"(?:public|private|protected|static|final|abstract|override|virtual|async)\s+\S+\s+(\w+)\s*\(",
    r"(?:pub\s+)?(?:async\s+)?fn\s+(\w+)\s*[<(]",
    r"^func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)\s*\(",
)
NO_NAMES = ("if", "else", "for", "while", "switch", "catch", "return", "new", "class")
# The declarations that a caret is looked up by, in the order to try, and how many lines above it.
CARET_DECLARATIONS = (
    r"(?:export\s+)?(?:async\s+)?function\s+(\w+)",
    r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(",
    r"(?:public|private|protected|internal)?\s*(?:static\s+)?(?:suspend\s+)?(?:fun|void|int|long|String|boolean|[\w<>\[\]]+)\s+(\w+)\s*\(",
    r"def\s+(\w+)\s*\(",
    r"(?:pub\s+)?(?:async\s+)?fn\s+(\w+)",
    r"func\s+(?:\([^)]*\)\s+)?(\w+)\s*\(",
    r"(?:public|private|protected|internal)\s+(?:static\s+)?(?:async\s+)?(?:[\w<>\[\]]+)\s+(\w+)\s*\(",
)
CARET_REACH = 20


def declared(text: Column) -> Column:
    """The name that a line declares; null if none."""
    found = [F.regexp_extract(text, p, 1) for p in DECLARATIONS]
    return F.coalesce(*[F.when((x != "") & ~x.isin(*NO_NAMES), x) for x in found])


def _above(lines: DataFrame, cursors: DataFrame, mark: Column) -> DataFrame:
    """``cursors`` (file_path, line) with ``mark`` of the last line at or above them that has one: a sort-merge by file, no pairs."""
    marks = lines.select("file_path", "line", mark.alias("_mark"), F.lit(0).alias("_asks")).where("_mark IS NOT NULL")
    asks = cursors.select("file_path", "line").distinct()
    both = marks.unionByName(asks.withColumn("_asks", F.lit(1)), allowMissingColumns=True)
    last = F.last("_mark", ignorenulls=True).over(Window.partitionBy("file_path").orderBy("line", "_asks"))
    return both.withColumn("_mark", last).where("_asks = 1").select("file_path", "line", "_mark")


def function_at(lines: DataFrame, cursors: DataFrame) -> DataFrame:
    """(file_path, line, name): for each cursor the name declared nearest at or above its line; null if none. ``lines``: file_path, line, text."""
    return _above(lines, cursors, declared(F.col("text"))).select("file_path", "line", F.col("_mark").alias("name"))


def function_near(lines: DataFrame, cursors: DataFrame, reach: int = CARET_REACH) -> DataFrame:
    """(file_path, line, name, found_line, found_column): the nearest declaration at most ``reach`` lines above; found places count from 1."""
    found = [F.when(F.regexp_extract("text", p, 1) != "", F.struct(F.regexp_extract("text", p, 1).alias("name"), F.col("line").alias("at"), F.regexp_instr("text", F.lit(p)).alias("column"))) for p in CARET_DECLARATIONS]
    near = _above(lines, cursors, F.coalesce(*found))
    hit = F.col("line") - F.col("_mark.at") <= reach
    return near.select("file_path", "line", F.when(hit, F.col("_mark.name")).alias("name"), F.when(hit, F.col("_mark.at") + 1).cast("long").alias("found_line"), F.when(hit, F.col("_mark.column")).cast("long").alias("found_column"))
