"""Git history and working-tree diffs, read by the executors.

A data source cuts the log into ranges of commits, each read by a task of its own, so no row
of the history passes through the driver. The project's folder must be one that executors
share. Renames are followed in DataFrames: a path at a commit is governed by the next newer
event of that path, a rename away from it or the addition of another file; renames that lead
to renames are chains, shortened by pointer doubling.
"""

from __future__ import annotations

import subprocess
import sys
import time
import warnings
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.graph import checkpointed

LOG = "commit_order long, commit_id string, at long, status string, file_path string, old_path string"
LINES = "_file string, pos long, value string"
#: Commits that one task reads; tasks that read a diff.
COMMITS, DIFF_TASKS = 2_000, 16


def git(root: str, *args: str, seconds: float | None = None) -> str:
    return subprocess.run(["git", "-C", root, "-c", "core.quotePath=false", *args], capture_output=True, text=True, errors="replace", timeout=seconds, check=True).stdout


def asked(root: str, *args: str, seconds: float | None = None) -> str | None:
    """What git prints; None, with a warning, if it fails or takes longer than ``seconds``."""
    try:
        return git(root, *args, seconds=seconds)
    except (OSError, subprocess.SubprocessError) as e:
        warnings.warn(f"git {args[0]} gave nothing: {e}", stacklevel=3)
        return None


class Part(InputPartition):
    def __init__(self, first: int, n: int):
        self.first, self.n = first, n


class Log(DataSource):
    """The files that each commit touches, from the commit ``head`` back; ``commit_order`` counts from the newest."""

    @classmethod
    def name(cls) -> str:
        return "callweave_git_log"

    def schema(self) -> str:
        return LOG

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options)


class LogReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.head, self.since = options["path"], options["head"], options.get("since", "")
        self.count, self.each = int(options["count"]), int(options.get("each", COMMITS))

    def partitions(self) -> list[Part]:
        return [Part(i, self.each) for i in range(0, self.count, self.each)]

    def read(self, partition: Part) -> Iterator[tuple]:
        """A range of commits. Fails if git does: a task may be tried again, but a range is never left out."""
        since = [f"--since={self.since}"] if self.since else []
        out = git(self.root, "log", "--format=@%H %at", "--name-status", "--find-renames", f"--skip={partition.first}", f"--max-count={partition.n}", *since, self.head)
        order, commit = partition.first - 1, ("", 0)
        for row in out.splitlines():
            if row.startswith("@"):
                h, _, t = row[1:].partition(" ")
                order, commit = order + 1, (h, int(t))
            elif "\t" in row:
                status, *paths = row.split("\t")
                yield order, *commit, status[0], paths[-1], paths[0] if status[0] == "R" else None


class Diff(DataSource):
    """Numbered lines of what the working tree has beside HEAD, a share of its files for each task."""

    @classmethod
    def name(cls) -> str:
        return "callweave_git_diff"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return DiffReader(self.options)


class DiffReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.tasks = options["path"], int(options.get("tasks", DIFF_TASKS))

    def partitions(self) -> list[Part]:
        return [Part(i, self.tasks) for i in range(self.tasks)]

    def read(self, partition: Part) -> Iterator[tuple]:
        names = git(self.root, "diff", "HEAD", "--name-only", "-z", "--no-renames").split("\0")[:-1]
        for name in names[partition.first :: partition.n]:
            # names are from the top of the work tree, wherever the project lies in it
            for i, row in enumerate(git(self.root, "diff", "HEAD", "--no-renames", "--", f":(top,literal){name}").splitlines()):
                yield name, i, row


def diff_lines(spark: SparkSession, root: str) -> DataFrame | None:
    """(_file, pos, value): lines of the working tree's diff; None if git fails or takes over ten seconds."""
    if asked(root, "diff", "HEAD", "--name-only", seconds=10) is None:
        return None
    spark.dataSource.register(Diff)
    return spark.read.format(Diff.name()).load(root)


def log(spark: SparkSession, root: str, days: int | None = None, each: int = COMMITS) -> DataFrame | None:
    """The log of HEAD; None if git fails. The commit that HEAD is now holds for every task."""
    since = f"@{int(time.time()) - days * 86400}" if days else ""
    head = asked(root, "rev-parse", "HEAD")
    count = head and asked(root, "rev-list", "--count", *([f"--since={since}"] if since else []), head.strip())
    if not count:
        return None
    spark.dataSource.register(Log)
    return spark.read.format(Log.name()).options(head=head.strip(), count=count.strip(), since=since, each=each).load(root)


def current_names(rows: DataFrame) -> DataFrame:
    """``rows`` (commit_order, file_path, old_path, status, ..) with ``name_now``: the name that the file has in the end.

    Status R renames old_path to file_path; A adds a file, so an older one of that name was
    another. Only what is newer than a row's commit governs it. Paths never renamed keep
    their names; an order of commits that renames in circles ends, as each step is newer.
    """
    events = rows.where("status IN ('A', 'R')").select(F.coalesce("old_path", "file_path").alias("path"), F.col("commit_order").alias("order"), F.when(F.col("status") == "R", F.col("file_path")).alias("to"))
    # of a file renamed and another added in one commit under its old name, the rename is the older file's
    events = events.groupBy("path", "order").agg(F.max("to").alias("to"))
    points = rows.select(F.col("file_path").alias("path"), F.col("commit_order").alias("order")).distinct()
    both = events.select("path", "order", F.struct("path", "order", "to").alias("event")).unionByName(points.select("path", "order", F.lit(None).cast("struct<path:string,order:bigint,to:string>").alias("event")))
    newer = Window.partitionBy("path").orderBy("order").rangeBetween(Window.unboundedPreceding, -1)
    governed = both.withColumn("by", F.last("event", ignorenulls=True).over(newer)).where("event IS NULL AND by.to IS NOT NULL").select("path", "order", F.struct("by.path", "by.order").alias("by"))
    governed = checkpointed(governed)
    # a rename's next is what governs its new name at its commit
    renames = events.where("to IS NOT NULL").select(F.struct("path", "order").alias("id"), F.col("to").alias("name"), F.col("to").alias("path"), "order")
    chain = checkpointed(renames.join(governed, ["path", "order"], "left").select("id", "name", F.col("by").alias("next")))
    while not chain.where("next IS NOT NULL").isEmpty():
        far = chain.select(F.col("id").alias("next"), F.col("name").alias("far_name"), F.col("next").alias("far_next"))
        chain = checkpointed(chain.join(far, "next", "left").select("id", F.coalesce("far_name", "name").alias("name"), F.col("far_next").alias("next")))
    named = governed.join(chain.select(F.col("id").alias("by"), "name"), "by").select(F.col("path").alias("file_path"), F.col("order").alias("commit_order"), "name")
    return rows.join(named, ["file_path", "commit_order"], "left").select(*rows.columns, F.coalesce("name", "file_path").alias("name_now"))


def commits(spark: SparkSession, root: str, days: int | None = None, each: int = COMMITS) -> DataFrame:
    """(commit_id, author_ts, file_path, status): what each commit touched, each file under the name it has now."""
    found = log(spark, root, days, each)
    if found is None:
        return spark.createDataFrame([], "commit_id string, author_ts timestamp, file_path string, status string")
    return current_names(checkpointed(found)).select("commit_id", F.timestamp_seconds("at").alias("author_ts"), F.col("name_now").alias("file_path"), "status")


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package
