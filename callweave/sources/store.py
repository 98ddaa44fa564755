"""A code index on shared storage that takes changes in proportion to their size.

A change is a run: the rows of its files alone, and the names of all files that it rules over,
deleted ones too. Readers merge the runs, the newest that names a file ruling it. A run's
level is the logarithm of its files; ``fanout`` runs at the end of the list that are of a
level or below are merged into one of the next. So a row is rewritten once a level, a large
old run is left alone by small changes, and there are few runs at any time. A manifest, put in place whole, says which runs count; a
reader sees the index before a change or after it, never half of it.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from .index import PLACES, TABLES, Index

ORDERED = ("symbols", "calls", "conditionals")


class Folder:
    """Small files and folders in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _fs(self):
        return self.at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def put(self, name: str, text: str, replace: bool = True) -> bool:
        """Write a file whole; False if there is one and it is not to be replaced."""
        fs, goal = self._fs(), self.at(name)
        part = self.at(".writing", goal.getName() + "." + self.spark._jvm.java.util.UUID.randomUUID().toString())
        out = fs.create(part, True)
        out.write(text.encode())
        out.close()
        fs.mkdirs(goal.getParent())
        if replace and fs.exists(goal):
            fs.delete(goal, False)
        return fs.rename(part, goal)

    def get(self, name: str) -> str:
        stream = self._fs().open(self.at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def has(self, name: str) -> bool:
        return self._fs().exists(self.at(name))

    def names(self, *parts: str) -> list[str]:
        fs, where = self._fs(), self.at(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def size(self, *parts: str) -> int:
        fs, where = self._fs(), self.at(*parts)
        return fs.getContentSummary(where).getLength() if fs.exists(where) else 0

    def delete(self, *parts: str) -> None:
        self._fs().delete(self.at(*parts), True)


class Store:
    """Versions of an index at ``path``. The last ``keep`` manifests and their runs stay for readers that hold them."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 4, keep: int = 2):
        self.spark, self.folder, self.fanout, self.keep = spark, Folder(spark, path), fanout, keep

    def _manifests(self) -> list[int]:
        return sorted(int(x.removesuffix(".json")) for x in self.folder.names("manifest"))

    def manifest(self, before: int | None = None) -> dict | None:
        """The newest manifest, or the newest older than version ``before``; None if there is none or another engine wrote it."""
        known = [n for n in self._manifests() if before is None or n < before]
        found = json.loads(self.folder.get(f"manifest/{known[-1]}.json")) if known else None
        return found if found and found["engine"] == __version__ else None

    def _table(self, run: str, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.path}/runs/{run}/{table}")

    def _merged(self, runs: list[dict]) -> tuple[Index, DataFrame]:
        """The rows of ``runs``, oldest first, and the files that they name."""
        if len(runs) == 1:
            return Index(*[self._table(runs[0]["name"], t) for t in TABLES]), self._table(runs[0]["name"], "touched")
        number = lambda t: [self._table(r["name"], t).withColumn("_run", F.lit(i)) for i, r in enumerate(runs)]
        together = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(together(frames[1:]))
        newest = together(number("touched")).groupBy("file_path").agg(F.max("_run").alias("_run"))
        merged = [together(number(t)).join(newest, ["file_path", "_run"], "left_semi").drop("_run") for t in TABLES]
        return Index(*merged), newest.select("file_path")

    def read(self) -> Index | None:
        found = self.manifest()
        return self._merged(found["runs"])[0] if found else None

    def _write(self, name: str, index: Index, touched: DataFrame) -> None:
        for t in TABLES:
            getattr(index, t).write.mode("overwrite").parquet(f"{self.folder.path}/runs/{name}/{t}")
        touched.write.mode("overwrite").parquet(f"{self.folder.path}/runs/{name}/touched")

    def apply(self, version: int, changed: Index, deleted: DataFrame | None = None) -> None:
        """The files of ``changed`` in place of what the index has of them, after all others in order; ``deleted`` (file_path) have no rows any more.

        A version that is applied again, after a failure, gives the same index.
        """
        old = self.manifest(before=version)
        if any(n > version for n in self._manifests()):
            return  # it is in already
        base, runs = (old["next"], list(old["runs"])) if old else (0, [])
        shifted = Index(*[getattr(changed, t).withColumn("seq", F.col("seq") + base * PLACES) if t in ORDERED else getattr(changed, t) for t in TABLES])
        touched = changed.files.select("file_path")
        self._write(f"v{version}", shifted, (touched if deleted is None else touched.unionByName(deleted.select("file_path"))).distinct())
        files = self._table(f"v{version}", "touched").count()
        runs.append({"name": f"v{version}", "level": int(math.log(max(files, 1), self.fanout) + 1e-9)})
        level = 0
        while level <= max(r["level"] for r in runs):
            tail = next((i for i, r in enumerate(reversed(runs)) if r["level"] > level), len(runs))
            if sum(r["level"] == level for r in runs[len(runs) - tail :]) >= self.fanout:
                self._write(f"v{version}-{level + 1}", *self._merged(runs[-tail:]))
                runs[-tail:] = [{"name": f"v{version}-{level + 1}", "level": level + 1}]
            level += 1
        self.folder.put(f"manifest/{version}.json", json.dumps({"engine": __version__, "next": base + files, "runs": runs}))
        self._clean()

    def _clean(self) -> None:
        """Delete manifests but the last few, and runs that none of those names."""
        known = self._manifests()
        live = {r["name"] for n in known[-self.keep :] for r in json.loads(self.folder.get(f"manifest/{n}.json"))["runs"]}
        for n in known[: -self.keep]:
            self.folder.delete("manifest", f"{n}.json")
        for run in self.folder.names("runs"):
            if run not in live:
                self.folder.delete("runs", run)
