"""Readers: coverage reports, diffs, git history, annotations, configuration."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import history, nested

ISTANBUL = "map<string,struct<statementMap:map<string,struct<start:struct<line:long,column:long>,end:struct<line:long,column:long>>>,s:map<string,long>>>"
HITS = "file_path string, line long, hits long"


def _carried(rows: DataFrame, mark, out: str) -> DataFrame:
    """The last non-null ``mark`` at or above each line of the same file."""
    return rows.withColumn(out, F.last(mark, ignorenulls=True).over(Window.partitionBy("_file").orderBy("pos")))


def lcov(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, line, hits, seq) of an lcov report; of a line or file reported twice the last counts."""
    # a record is a row, so a large report is read by many tasks; within a task rows come in the file's order
    records = spark.read.option("lineSep", "end_of_record").text(path).select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start")).alias("_at"), F.monotonically_increasing_id().alias("_n"))
    each = records.select(F.col("_n").alias("_file"), "_at", F.posexplode(F.split("value", "\r?\n")).alias("i", "value")).select("_file", F.struct("_at", "_file", "i").alias("pos"), F.trim("value").alias("value"))
    rows = _carried(each, F.when(F.col("value").startswith("SF:"), F.struct(F.substr("value", F.lit(4)).alias("file"), "pos")), "_sf")
    hit = rows.where(F.col("value").rlike(r"^DA:\d+,\d+") & F.col("_sf").isNotNull()).select("_sf.file", F.col("_sf.pos").alias("record"), "pos", F.regexp_extract("value", r"^DA:(\d+),(\d+)", 1).cast("long").alias("line"), F.regexp_extract("value", r"^DA:(\d+),(\d+)", 2).cast("long").alias("hits"))
    newest = hit.groupBy("file").agg(F.max("record").alias("record"), F.min("record").alias("seq"))
    return hit.join(newest, ["file", "record"]).groupBy(F.col("file").alias("file_path"), "line").agg(F.max_by("hits", "pos").alias("hits"), F.first("seq").alias("seq"))


def istanbul(spark: SparkSession, path: str) -> DataFrame:
    """A line's hits are the most of any statement that covers it. A report's files are read by many tasks."""
    doc = nested.json_entries(spark, path).select(F.struct("file", "entry").alias("_at"), F.explode(F.from_json("value", ISTANBUL)).alias("file_path", "f"))
    # a statement's place and its hits stand in two maps: both are dealt out by id, as a look-up in a map goes through all of it
    none = F.lit(None).cast("long")
    places = F.transform(F.map_entries("f.statementMap"), lambda e: F.struct(e["key"].alias("id"), e["value"]["start"]["line"].alias("start"), e["value"]["end"]["line"].alias("end"), none.alias("hits")))
    hits = F.transform(F.map_entries("f.s"), lambda e: F.struct(e["key"].alias("id"), none.alias("start"), none.alias("end"), e["value"].alias("hits")))
    each = doc.select("_at", "file_path", F.explode(F.concat(places, F.coalesce(hits, F.slice(places, 1, 0)))).alias("x")).groupBy("_at", "file_path", "x.id").agg(F.max("x.start").alias("start"), F.max("x.end").alias("end"), F.max("x.hits").alias("hits"))
    spread = each.select("file_path", F.explode(F.sequence("start", "end")).alias("line"), F.coalesce("hits", F.lit(0)).alias("hits"))
    return spread.groupBy("file_path", "line").agg(F.max("hits").alias("hits")).withColumn("seq", F.lit(0).cast("long"))


def _is_istanbul(spark: SparkSession, path: str) -> bool:
    first = F.element_at(F.map_values(F.from_json("value", ISTANBUL)), 1)
    return bool((nested.json_entries(spark, path).orderBy("file", "entry").select(F.coalesce(first["statementMap"].isNotNull(), F.lit(False))).first() or [False])[0])


def jacoco(spark: SparkSession, path: str) -> DataFrame:
    """A line is hit if an instruction of it was covered; lines without instructions are left out. A report's packages are read by many tasks."""
    packages = nested.xml_elements(spark, path, "package", "_name:string,sourcefile:array<struct<_name:string,line:array<struct<_nr:long,_mi:long,_ci:long>>>>")
    files = packages.select(F.col("_name").alias("pkg"), F.explode("sourcefile").alias("f"))
    each = files.select(F.concat_ws("/", F.nullif("pkg", F.lit("")), "f._name").alias("file_path"), F.explode("f.line").alias("l"))
    return each.where(F.col("l._mi") + F.col("l._ci") > 0).groupBy("file_path", F.col("l._nr").alias("line")).agg(F.max((F.col("l._ci") > 0).cast("long")).alias("hits")).withColumn("seq", F.lit(0).cast("long"))


def coverage(spark: SparkSession, path: str) -> DataFrame:
    """The report at ``path`` in whichever format its beginning shows."""
    head = nested.beginning(spark, path).lstrip()
    if head.startswith(("TN:", "SF:")):
        return lcov(spark, path)
    if "<report" in head:
        return jacoco(spark, path)
    if head.startswith("{") and _is_istanbul(spark, path):
        return istanbul(spark, path)
    raise ValueError("Unsupported coverage format. Supported formats: lcov, Istanbul JSON, JaCoCo XML")


def diff_hunks(rows: DataFrame) -> DataFrame:
    """(file_path, start_line, end_line) from numbered lines of unified diffs; a hunk of no lines is left out."""
    file = F.when(F.col("value").startswith("+++ b/"), F.substr("value", F.lit(7))).when(F.col("value").startswith("+++ "), "")
    here = _carried(rows, file, "file_path").where(F.col("value").rlike(r"^@@ .*\+\d+") & (F.col("file_path") != ""))
    start = F.regexp_extract("value", r"\+(\d+)", 1).cast("long")
    size = F.coalesce(F.nullif(F.regexp_extract("value", r"\+\d+,(\d+)", 1), F.lit("")).cast("long"), F.lit(1))
    return here.select("file_path", start.alias("start_line"), (start + size - 1).alias("end_line"), size.alias("_n")).where("_n > 0").drop("_n")


def diff_text(spark: SparkSession, text: str) -> DataFrame:
    rows = spark.createDataFrame([("diff", i, v) for i, v in enumerate(text.splitlines())], "_file string, pos long, value string")
    return diff_hunks(rows)


def git_diff(spark: SparkSession, root: str) -> DataFrame:
    """The hunks that the working tree has beside HEAD; none if git fails or takes over ten seconds."""
    rows = history.diff_lines(spark, root)
    return diff_hunks(spark.createDataFrame([], history.LINES) if rows is None else rows)


def git_commits(spark: SparkSession, root: str, days: int | None = None) -> DataFrame:
    """(commit_id, author_ts, file_path, status): the whole history, each file under the name it has now."""
    return history.commits(spark, root, days)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """The annotations of a sidecar file that have an id, a node id and a text; none if the file is missing or malformed."""
    from pyspark.errors import AnalysisException

    shape = "struct<version:string,annotations:array<struct<id:string,nodeId:string,text:string,author:string,timestamp:string>>>"
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], "id string, node_id string, text string, author string, timestamp string")
    each = raw.select(F.from_json("value", shape).alias("d")).where("d.version IS NOT NULL").select(F.explode("d.annotations").alias("a"))
    return each.select("a.id", F.col("a.nodeId").alias("node_id"), "a.text", "a.author", "a.timestamp").where("id IS NOT NULL AND node_id IS NOT NULL AND text IS NOT NULL")


def write_annotations(rows: DataFrame, path: str) -> None:
    """One JSON document; annotations are written by people, so there are few."""
    found = [{"id": r["id"], "nodeId": r["node_id"], "text": r["text"], "author": r["author"], "timestamp": r["timestamp"]} for r in rows.orderBy("timestamp", "id").toLocalIterator()]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps({"version": "1.0.0", "annotations": found}, indent=2))


# What a project is made of unless its configuration says otherwise.
INCLUDE = ["**/*.{ts,tsx,mts,cts}", "**/*.{js,jsx,mjs,cjs}", "**/*.java", "**/*.rs", "**/*.{py,pyi}", "**/*.go", "**/*.cs"]
EXCLUDE = [
    "**/node_modules/**", "**/dist/**", "**/build/**", "**/.git/**", "**/vendor/**", "**/target/**", "**/__pycache__/**", "**/bin/**", "**/obj/**",
    "**/.next/**", "**/.nuxt/**", "**/coverage/**", "**/playwright-report/**", "**/android/**", "**/ios/**", "**/Pods/**", "**/.expo/**", "**/.gradle/**",
    "**/*.bundle.js", "**/*.min.js", "**/*.d.ts", "**/generated/**", "**/__generated__/**", "**/.cache/**", "**/tmp/**", "**/temp/**",
]
CONFIG_FILE = ".callweave.json"


@dataclass
class Config:
    include: list[str] = field(default_factory=lambda: list(INCLUDE))
    exclude: list[str] = field(default_factory=lambda: list(EXCLUDE))
    language_overrides: dict[str, str] = field(default_factory=dict)
    default_depth: float = float("inf")
    default_format: str = "json"
    cache_max_size_mb: int = 500
    timeout_seconds: int = 60

    @staticmethod
    def load(root: str, flags: dict | None = None) -> Config:
        """Defaults, then the project's file, then flags; a value of the wrong type is ignored by itself."""
        config = Config()
        try:
            own = json.loads((Path(root) / CONFIG_FILE).read_text())
        except (OSError, json.JSONDecodeError):
            own = {}
        texts = lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v)
        number = lambda v: isinstance(v, int | float) and not isinstance(v, bool) and v > 0
        rules = {
            "include": ("include", texts),
            "exclude": ("exclude", texts),
            "languageOverrides": ("language_overrides", lambda v: isinstance(v, dict) and texts(list(v.values()))),
            "defaultDepth": ("default_depth", number),
            "defaultFormat": ("default_format", lambda v: v in ("json", "mermaid", "text")),
            "cacheMaxSizeMB": ("cache_max_size_mb", number),
            "timeoutSeconds": ("timeout_seconds", number),
        }
        for layer in (own if isinstance(own, dict) else {}, flags or {}):
            for key, (name, good) in rules.items():
                if key in layer and good(layer[key]):
                    setattr(config, name, layer[key])
        return config
