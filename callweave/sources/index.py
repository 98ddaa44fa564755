"""A code index as a set of DataFrames: built from files, updated by file, kept as Parquet."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import __version__
from . import scan as S

for _module in (S, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)  # executors need no copy of the package

#: More than any file has symbols, calls or conditionals.
PLACES = 1 << 24
TABLES = ("symbols", "calls", "conditionals", "imports", "exports", "errors", "files")
#: What a scan looks for; errors are found with the first three.
KINDS = ("symbols", "calls", "conditionals", "imports")
#: What one file's scan gives, every kind in one row shape.
TAGGED = "tag string, file_path string, language_id string, pos long, name string, qualified_name string, kind string, line long, column long, name_column long, end_line long, branches long, text string, visibility string, source string, specifiers array<string>"
_COLUMNS = [c.split()[0] for c in TAGGED.split(", ")]


def glob_regex(glob: str) -> str:
    """A glob with ``**``, ``*``, ``?`` and braces as a regular expression for the end of a path."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] in "{}":
            out, i = out + ("(?:" if glob[i] == "{" else ")"), i + 1
        elif glob[i] == ",":
            out, i = out + "|", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return rf"(?:^|/){out}$"


def discover(spark: SparkSession, root: str, include: list[str], exclude: list[str], overrides: dict[str, str] | None = None) -> DataFrame:
    """The project's files of a supported language: file_path, language_id, content (null: not UTF-8), sha256."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^[a-z]+:/*", "/")
    below = F.substr(path, F.lit(len(root.rstrip("/")) + 2))
    keep, drop = (f"(?:{'|'.join(map(glob_regex, g))})" if g else None for g in (include, exclude))
    ext = F.substring_index("file_path", ".", -1)
    known = F.create_map(*[F.lit(x) for kv in (S.LANGUAGES | {k.lstrip("."): v for k, v in (overrides or {}).items()}).items() for x in kv])
    files = raw.select(path.alias("file_path"), below.alias("_below"), "content").where(F.col("_below").rlike(keep) if keep else F.lit(True)).where(~F.col("_below").rlike(drop) if drop else F.lit(True))
    files = files.withColumn("language_id", F.try_element_at(known, ext)).where("language_id IS NOT NULL")
    return files.select("file_path", "language_id", F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8")).alias("content") if hasattr(F, "is_valid_utf8") else F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("sha256"))


#: Rows of a frame that a scan hands over; a file's own rows stay together.
FRAME = 20_000


def _frame(rows: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_COLUMNS)
    for c in ("pos", "line", "column", "name_column", "end_line", "branches"):
        frame[c] = frame[c].astype("Int64")
    return frame


def _scan(batches: Iterator[pd.DataFrame], kinds: tuple[str, ...] = KINDS) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, lang, text in zip(batch["file_path"], batch["language_id"], batch["content"]):
            base = {c: None for c in _COLUMNS} | {"file_path": path, "language_id": lang}
            if text is None:
                rows.append(base | {"tag": "error", "line": 0, "column": 0, "text": "Not readable as UTF-8"})
                continue
            found = S.scan(path, text, lang, kinds) if set(kinds) - {"imports"} else S.Found()
            for i, x in enumerate(found.symbols):
                rows.append(base | {"tag": "symbol", "pos": i, "name": x["name"], "qualified_name": x["qualified_name"], "kind": x["kind"], "line": x["line"], "column": x["column"], "end_line": x["body_end"], "text": x["signature"], "visibility": x["visibility"]})
            for i, x in enumerate(found.calls):
                rows.append(base | {"tag": "call", "pos": i, "name": x["callee_name"], "line": x["line"], "column": x["column"], "name_column": x["name_column"]})
            for i, x in enumerate(found.conditionals):
                rows.append(base | {"tag": "conditional", "pos": i, "kind": x["kind"], "line": x["line"], "column": x["column"], "end_line": x["end_line"], "branches": x["branches"], "text": x["condition_text"]})
            for i, x in enumerate(S.imports(path, text, lang) if "imports" in kinds else []):
                rows.append(base | {"tag": "import", "pos": i, "source": x["source"], "specifiers": x["specifiers"]})
            for x in found.errors:
                rows.append(base | {"tag": "error", "line": x["line"], "column": x["column"], "text": x["message"]})
            if len(rows) >= FRAME:
                yield _frame(rows)
                rows = []
        yield _frame(rows)


@dataclass
class Index:
    """``symbols`` and so on as DataFrames. ``seq`` orders rows by file, then by place in the file."""

    symbols: DataFrame
    calls: DataFrame
    conditionals: DataFrame
    imports: DataFrame
    exports: DataFrame
    errors: DataFrame
    files: DataFrame

    @staticmethod
    def build(files: DataFrame, kinds: tuple[str, ...] = KINDS) -> Index:
        """Scan ``files`` (file_path, language_id, content, sha256) in parallel and derive every table; of ``kinds`` left out, and what comes of them, there are no rows."""
        # a scan takes long beside its bytes, so files are dealt out to all cores, however few bytes they have
        dealt = files.select("file_path", "language_id", "content").repartition(4 * files.sparkSession.sparkContext.defaultParallelism, "file_path")
        tagged = dealt.mapInPandas(lambda batches: _scan(batches, kinds), TAGGED)
        return Index.of(tagged, files.select("file_path", "language_id", "sha256"))

    @staticmethod
    def of(tagged: DataFrame, files: DataFrame) -> Index:
        from ..operators.graph import checkpointed

        # a number that orders like (path, place in the file)
        ranks = path_ranks(files).withColumnRenamed("file_path", "_path")
        t = checkpointed(tagged.join(ranks, F.col("file_path") == F.col("_path"), "left"))
        seq = (F.coalesce("rank", F.lit(0)) * PLACES + F.coalesce("pos", F.lit(0))).alias("seq")
        line = F.col("line")
        symbols = t.where("tag = 'symbol'").select("name", "qualified_name", "kind", "file_path", line, "column", F.col("text").alias("signature"), line.alias("body_start"), F.col("end_line").alias("body_end"), "visibility", "language_id", F.concat_ws(":", "file_path", line.cast("string"), "name").alias("node_id"), seq)
        calls = t.where("tag = 'call'").select(F.col("name").alias("callee_name"), "file_path", line, "column", "name_column", F.lit(None).cast("array<string>").alias("arguments"), seq)
        conditionals = t.where("tag = 'conditional'").select("kind", "file_path", line, "column", "end_line", "branches", F.col("text").alias("condition_text"), seq)
        imports = t.where("tag = 'import'").select("source", "specifiers", "file_path")
        exports = symbols.where("visibility = 'public'").select("name", "kind", "file_path")
        errors = t.where("tag = 'error'").select("file_path", line, "column", F.col("text").alias("message"))
        return Index(symbols, calls, conditionals, imports, exports, errors, files)

    def update(self, changed: Index) -> Index:
        """The rows of ``changed``'s files in place of this index's rows of those files, and after all others in order."""
        gone = changed.files.select("file_path")
        last = [getattr(self, t).agg(F.max("seq")).first()[0] for t in ("symbols", "calls", "conditionals")]
        shift = (max([x for x in last if x is not None], default=-PLACES) // PLACES + 1) * PLACES
        new = {t: getattr(changed, t).withColumn("seq", F.col("seq") + shift) if t in ("symbols", "calls", "conditionals") else getattr(changed, t) for t in TABLES}
        return Index(*[replace_files(getattr(self, t), new[t], gone) for t in TABLES])

    def changed(self, files: DataFrame) -> DataFrame:
        """The files that are new or whose hash differs."""
        return files.join(self.files.select("file_path", "sha256"), ["file_path", "sha256"], "left_anti")

    def save(self, path: str) -> None:
        for t in TABLES:
            getattr(self, t).write.mode("overwrite").parquet(f"{path}/{t}")
        spark = self.symbols.sparkSession
        spark.createDataFrame([(__version__,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{path}/version")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index | None:
        """The saved index; None if there is none, it is damaged, or another version wrote it."""
        from pyspark.errors import AnalysisException

        try:
            if spark.read.parquet(f"{path}/version").first()[0] != __version__:
                return None
            return Index(*[spark.read.parquet(f"{path}/{t}") for t in TABLES])
        except (AnalysisException, TypeError):
            return None

    def single_imports(self) -> DataFrame:
        """A row for each specifier (null where an import names none)."""
        return self.imports.select("file_path", "source", F.explode_outer("specifiers").alias("specifier"))


def path_ranks(files: DataFrame) -> DataFrame:
    """(file_path, rank): each file's number, from 0, in the order of paths.

    Paths are sorted in ranges; a range's numbers are shifted by the files of the ranges before.
    """
    from ..operators.graph import checkpointed

    ranged = checkpointed(files.select("file_path").distinct().repartitionByRange("file_path").withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    shifts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("file_path")) - 1
    return ranged.withColumn("_own", own).join(F.broadcast(shifts), "_part").select("file_path", (F.col("_own") + F.col("_shift")).alias("rank"))


def replace_files(old: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    return old.join(files.select("file_path").distinct(), "file_path", "left_anti").select(old.columns).unionByName(new)


def name_lookup(symbols: DataFrame) -> DataFrame:
    """(lookup, node_id): every symbol under its simple name and, where it differs, its qualified name."""
    return symbols.select(F.col("name").alias("lookup"), "node_id").unionAll(symbols.where("qualified_name <> name").select("qualified_name", "node_id"))


# What a relative import may leave out, in the order to try.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` (file_path, source) with ``resolved_path``: the file that a relative source means; null for packages."""
    from ..functions.text import joined_path

    path = F.translate("file_path", "\\", "/")
    folder = F.regexp_replace(path, "/[^/]*$", "")
    local = F.col("source").startswith(".") | F.col("source").startswith("/")
    base = F.when(F.col("source").startswith("/"), F.col("source")).when(local, joined_path(folder, F.col("source")))
    ends = ["", *EXTENSIONS, *(f"/index{e}" for e in EXTENSIONS)]
    tries = imports.select("file_path", "source").distinct().withColumn("_base", base).where("_base IS NOT NULL").select("file_path", "source", "_base", F.posexplode(F.array(*map(F.lit, ends))).alias("_rank", "_end"))
    hit = tries.withColumn("_try", F.concat("_base", "_end")).join(files.select(F.col("file_path").alias("_try")).distinct(), "_try")
    best = hit.groupBy("file_path", "source").agg(F.min_by("_try", "_rank").alias("resolved_path"))
    return imports.join(best, ["file_path", "source"], "left")
