"""An index that grows on demand: files are scanned when a question first needs them.

Each request scans its files as one parallel job and adds their tables to those at hand.
Symbols are found by their simple names only, as the growing index knows no others.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import BUILT_INS
from .index import TABLES, Index, path_ranks, resolve_imports

#: Files scanned at a time in search of a symbol, and at most for one.
BATCH, BUDGET = 50, 200


def by_simple_name(symbols: DataFrame) -> DataFrame:
    """(name, definitions): every symbol under its simple name alone, in index order."""
    entry = F.struct("seq", "node_id", "qualified_name", "kind", "file_path", "line")
    return symbols.groupBy("name").agg(F.array_sort(F.collect_list(entry)).alias("definitions"))


def likely_built_in(name: str) -> bool:
    return name in BUILT_INS or name.find(".") > 0 and name.split(".", 1)[0] in BUILT_INS


def search_order(files: DataFrame, batch: int = BATCH) -> DataFrame:
    """(file_path, batch): the batch in which a search reaches each file, by path."""
    return path_ranks(files).select("file_path", F.floor(F.col("rank") / batch).alias("batch"))


def searched(files: DataFrame, symbols: DataFrame, names: DataFrame, batch: int = BATCH, budget: int = BUDGET) -> DataFrame:
    """(name, batches, found): how many batches a search for each name scans before it stops, and whether it finds it.

    Built-in names are not searched. The search ends with the first batch that defines the
    name, with the last file, or when the budget is spent.
    """
    order = search_order(files, batch)
    head = F.substring_index("name", ".", 1)
    known = F.col("name").isin(*BUILT_INS) | (F.instr("name", ".") > 1) & head.isin(*BUILT_INS)
    first = symbols.select("name", "file_path").distinct().join(order, "file_path").groupBy("name").agg(F.min("batch").alias("_first"))
    last = order.agg((F.coalesce(F.max("batch"), F.lit(-1)) + 1).alias("_all"))  # one row
    limit = F.least(F.col("_all"), F.lit(-(-budget // batch)))
    asked = names.select("name").distinct().join(first, "name", "left").crossJoin(F.broadcast(last))
    scans = F.when(known, 0).when(F.col("_first") < limit, F.col("_first") + 1).otherwise(limit)
    return asked.select("name", scans.cast("long").alias("batches"), F.coalesce(~known & (F.col("_first") < limit), F.lit(False)).alias("found"))


def import_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, name, source, resolved_path): the files that a file's imports say define a name ('*': any). ``imports`` has a row for each specifier."""
    local = imports.where("specifier IS NOT NULL").select("file_path", "source", F.col("specifier").alias("name"))
    known = resolve_imports(local.select("file_path", "source").distinct(), files).where("resolved_path IS NOT NULL")
    return local.join(known, ["file_path", "source"]).select("file_path", "name", "source", "resolved_path")


@dataclass
class LazyIndex:
    """``files`` (file_path, language_id, content, sha256), of which those asked for are scanned."""

    files: DataFrame
    index: Index | None = None
    parsed: set[str] = field(default_factory=set)

    def _scan(self, paths: list[str]) -> None:
        new = sorted(set(paths) - self.parsed)
        if new:
            part = Index.build(self.files.where(F.col("file_path").isin(new)))
            found = [r[0] for r in part.files.select("file_path").collect()]  # no more than asked for
            self.index = part if self.index is None else Index(*[getattr(self.index, t).unionByName(getattr(part, t)) for t in TABLES])
            self.parsed.update(found)

    def ensure_file(self, path: str) -> None:
        self._scan([path, path.replace("\\", "/")])

    def has(self, name: str) -> bool:
        return self.index is not None and not self.index.symbols.where(F.col("name") == name).isEmpty()

    def ensure_symbol(self, name: str, batch: int = BATCH, budget: int = BUDGET) -> None:
        """Scan further files, by path, until one defines ``name`` or the budget is spent; nothing for built-in names."""
        if self.has(name) or likely_built_in(name):
            return
        left = self.files.where(~F.col("file_path").isin(sorted(self.parsed))) if self.parsed else self.files
        paths = [r[0] for r in left.select("file_path").orderBy("file_path").limit(-(-budget // batch) * batch).collect()]
        for lo in range(0, min(len(paths), budget), batch):
            self._scan(paths[lo : lo + batch])
            if self.has(name):
                return

    def ensure_import(self, name: str, path: str) -> None:
        """Scan the files from which ``path`` imports ``name`` or everything, until one defines it."""
        if self.index is None or self.has(name):
            return
        own = self.index.single_imports().where((F.col("file_path") == path) & F.col("specifier").isin(name, "*"))
        for r in import_targets(own, self.files).select("resolved_path").distinct().orderBy("resolved_path").toLocalIterator():
            self._scan([r[0]])
            if self.has(name):
                return

    @property
    def parse_count(self) -> int:
        return len(self.parsed)

    def total_files(self) -> int:
        return self.files.count()
