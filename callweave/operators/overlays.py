"""Analyses over a code graph: complexity, coverage, churn, impact, dead code, clusters.

Lines of nodes count from 0 while coverage files and diffs count from 1; by default they
are compared as they are (``compat=True``), as the results to match do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .calls import in_body

CALLABLE = ("function", "method")
#: Names that are never dead code.
ENTRY_NAMES = ("main", "constructor", "init", "setup", "teardown")
#: Directory names that say nothing about a cluster.
GENERIC_DIRS = ("src", "lib", "app", "main", "core", "common", "shared", "utils", "util", "helpers", "internal")
COVERAGE_WINDOW = 500
#: Lines over which the running totals of coverage are summed by themselves.
COVERAGE_BIN = 1024


def complexity(symbols: DataFrame, conditionals: DataFrame) -> DataFrame:
    """(node_id, complexity): one more than the branches beyond the first of all conditionals in the body; functions and methods only."""
    own = symbols.where(F.col("kind").isin(*CALLABLE))
    more = in_body(conditionals, own).groupBy("sym_node_id").agg(F.sum(F.greatest(F.col("branches") - 1, F.lit(0))).alias("more"))
    return own.select("node_id").join(more, F.col("node_id") == F.col("sym_node_id"), "left").select("node_id", (1 + F.coalesce("more", F.lit(0))).cast("long").alias("complexity"))


def coverage(symbols: DataFrame, hits: DataFrame, window: int = COVERAGE_WINDOW, compat: bool = True) -> DataFrame:
    """(node_id, covered, total, ratio, tier) over the instrumented lines from the definition on; nodes without any have no row.

    Windows overlap, so a line is no row for each node around it: a node asks for the running
    totals at both ends of its window. They are summed within a bin of lines first, then
    shifted by the bins of the file before.
    """
    own = symbols.where(F.col("kind").isin(*CALLABLE)).select("node_id", "file_path", (F.col("line") + (0 if compat else 1)).alias("_from")).withColumn("_to", F.col("_from") + window - 1).where("_from <= _to")
    end = lambda line, sign: F.struct(line.cast("long").alias("line"), F.lit(sign).alias("sign"))
    asks = own.select("file_path", "node_id", F.explode(F.array(end(F.col("_from") - 1, -1), end(F.col("_to"), 1))).alias("e")).select("file_path", "node_id", "e.line", "e.sign", F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("t"))
    lines = hits.where("file_path IS NOT NULL AND line IS NOT NULL").groupBy("file_path", F.col("line").cast("long").alias("line")).agg(F.count_if(F.col("hits") > 0).alias("c"), F.count("*").alias("t"))
    points = lines.select("file_path", F.lit(None).cast("string").alias("node_id"), "line", F.lit(0).alias("sign"), "c", "t").unionByName(asks)
    points = points.withColumn("_bin", F.floor(F.col("line") / COVERAGE_BIN)).repartition("file_path", "_bin")
    before = Window.partitionBy("file_path").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # a row a bin
    bins = points.groupBy("file_path", "_bin").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    shifts = bins.select("file_path", "_bin", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_c"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("_t"))
    upto = Window.partitionBy("file_path", "_bin").orderBy("line", F.col("sign") != 0).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = points.withColumns({"c": F.sum("c").over(upto), "t": F.sum("t").over(upto)}).where("sign <> 0").join(shifts, ["file_path", "_bin"])
    n = asked.groupBy("node_id").agg(F.sum(F.col("sign") * (F.col("c") + F.col("_c"))).alias("covered"), F.sum(F.col("sign") * (F.col("t") + F.col("_t"))).alias("total")).where("total > 0")
    ratio = F.col("covered") / F.col("total")
    return n.withColumn("ratio", ratio).withColumn("tier", coverage_tier(F.col("ratio")))


def coverage_tier(ratio: Column) -> Column:
    return F.when(ratio > 0.8, "covered").when(ratio >= 0.2, "partial").otherwise("uncovered")


def ends_alike(a: DataFrame, path: str, b: DataFrame, other: str) -> DataFrame:
    """Rows of both tables of which one's path ends with the other's, at a slash; back slashes count as slashes.

    The longer path is dealt out under its ends, and the shorter one is such an end, so files
    of one base name don't all meet.
    """
    clean = lambda c: F.translate(c, "\\", "/")
    own = lambda c: F.regexp_replace(clean(c), "^/+", "")

    def ends(c: str) -> Column:
        parts = F.split(own(c), "/")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))

    one = a.withColumn("_key", F.explode(ends(path))).join(b.withColumn("_key", own(other)), "_key")
    two = a.withColumn("_key", own(path)).join(b.withColumn("_key", F.explode(ends(other))), "_key")
    p, q = clean(path), clean(other)
    return one.unionByName(two).drop("_key").where(p.endswith(q) | q.endswith(p)).distinct()


def match_paths(nodes: DataFrame, reported: DataFrame) -> DataFrame:
    """(file_path, reported_path): each node file with the reported file that equals it, else the first (by ``seq``) of which one ends with the other."""
    clean = lambda c: F.translate(c, "\\", "/")
    b = reported.select(F.col("file_path").alias("reported_path"), "seq")
    p, q = clean("file_path"), clean("reported_path")
    hit = ends_alike(nodes.select("file_path").distinct(), "file_path", b, "reported_path")
    return hit.groupBy("file_path").agg(F.min_by("reported_path", F.struct((p != q).alias("other"), "seq")).alias("reported_path"))


def modified_nodes(symbols: DataFrame, hunks: DataFrame, compat: bool = True) -> DataFrame:
    """Symbols whose definition line lies in a hunk of their file (the path of one ends with the other's)."""
    files = ends_alike(symbols.select("file_path").distinct(), "file_path", hunks.select(F.col("file_path").alias("_hf")).distinct(), "_hf")
    h = files.join(hunks.select(F.col("file_path").alias("_hf"), "start_line", "end_line"), "_hf").select(F.col("file_path").alias("_f"), "start_line", "end_line")
    line = F.col("line") + (0 if compat else 1)
    return symbols.join(h, (F.col("file_path") == F.col("_f")) & line.between(F.col("start_line"), F.col("end_line")), "left_semi")


def dead_code(symbols: DataFrame, calls: DataFrame, exports: DataFrame) -> DataFrame:
    """Callables no call names (dotted calls name nothing), that no export is named like and that are no usual entry."""
    own = symbols.where(F.col("kind").isin(*CALLABLE) & ~F.lower("name").isin(*ENTRY_NAMES))
    return own.join(calls.select(F.col("callee_name").alias("name")), "name", "left_anti").join(exports.select("name"), "name", "left_anti").select(symbols.columns)


def churn(commits: DataFrame, anchor: Column, days: int = 90) -> DataFrame:
    """(file_path, churn, last_modified, recently_added): commits in the window before ``anchor``, the last one, and whether the earliest add lies in the window."""
    since = anchor - F.expr(f"INTERVAL {days} DAYS")
    stats = commits.groupBy("file_path").agg(F.count_if(F.col("author_ts") >= since).alias("churn"), F.max("author_ts").alias("last_modified"), F.min(F.when(F.col("status") == "A", F.col("author_ts"))).alias("_added"))
    return stats.withColumn("recently_added", F.coalesce(F.col("_added") >= since, F.lit(False))).drop("_added")


def node_churn(nodes: DataFrame, commits: DataFrame, anchor: Column, days: int = 90) -> DataFrame:
    """(node_id, file_path, churn, last_modified, recently_added) of every node; of a file without commits: none, ``anchor`` and false.

    A history names files from the repository's root, so paths match by their ends.
    """
    stats = churn(commits, anchor, days).withColumnRenamed("file_path", "reported_path")
    paths = match_paths(nodes, stats.select(F.col("reported_path").alias("file_path"), F.lit(0).alias("seq")))
    files = paths.join(stats, "reported_path").drop("reported_path")
    found = nodes.select("node_id", "file_path").join(files, "file_path", "left")
    return found.select("node_id", "file_path", F.coalesce("churn", F.lit(0)).cast("long").alias("churn"), F.coalesce("last_modified", anchor).alias("last_modified"), F.coalesce("recently_added", F.lit(False)).alias("recently_added"))


def undirected(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(a, b) with a < b: each pair of linked nodes once, without self loops and, given ``nodes``, dangling ends."""
    e = edges.where("source_id <> target_id")
    if nodes is not None:
        for c in ("source_id", "target_id"):
            e = e.join(nodes.select(F.col("node_id").alias(c)), c, "left_semi")
    return e.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()


def weighted_degree(pairs: DataFrame, weight: Column | None = None) -> DataFrame:
    w = weight if weight is not None else F.lit(1.0)
    ends = pairs.select(F.col("a").alias("node_id"), w.alias("w")).unionAll(pairs.select(F.col("b").alias("node_id"), w.alias("w")))
    return ends.groupBy("node_id").agg(F.sum("w").alias("degree"))


def modularity(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row (modularity, standard): over linked pairs only, as the results to match do, and over all pairs of a cluster."""
    k = weighted_degree(pairs)
    m2 = pairs.agg((2.0 * F.count("*")).alias("m2"))
    side = lambda c: k.join(clusters, "node_id").select(F.col("node_id").alias(c), F.col("degree").alias(f"k_{c}"), F.col("cluster").alias(f"c_{c}"))
    inside = pairs.join(side("a"), "a").join(side("b"), "b").where("c_a = c_b").crossJoin(F.broadcast(m2))  # one row
    linked = inside.agg(F.coalesce(F.sum(2 * (1.0 - F.col("k_a") * F.col("k_b") / F.col("m2")) / F.col("m2")), F.lit(0.0)).alias("modularity"), F.coalesce(F.sum(2.0 / F.col("m2")), F.lit(0.0)).alias("_in"))
    total = k.join(clusters, "node_id").groupBy("cluster").agg(F.sum("degree").alias("t")).crossJoin(F.broadcast(m2)).agg(F.coalesce(F.sum(F.pow(F.col("t") / F.col("m2"), 2)), F.lit(0.0)).alias("_out"))
    return linked.crossJoin(total).select("modularity", (F.col("_in") - F.col("_out")).alias("standard"))


def inter_cluster_edges(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, edges): every edge between clusters counts once for both."""
    s = clusters.select(F.col("node_id").alias("source_id"), F.col("cluster").alias("_s"))
    t = clusters.select(F.col("node_id").alias("target_id"), F.col("cluster").alias("_t"))
    cross = edges.join(s, "source_id").join(t, "target_id").where("_s <> _t")
    return cross.select(F.explode(F.array("_s", "_t")).alias("cluster")).groupBy("cluster").agg(F.count("*").alias("edges"))


def cluster_names(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, cluster_name): the most frequent telling parent directory, the one met first on ties; else the first node's name."""
    n = nodes.join(clusters, "node_id")
    parts = F.split(F.translate("file_path", "\\", "/"), "/")
    n = n.withColumn("_dir", F.when(F.size(parts) >= 2, F.element_at(parts, -2)))
    telling = (F.col("_dir") != "") & ~F.lower("_dir").isin(*GENERIC_DIRS)
    dirs = n.where(telling).groupBy("cluster", "_dir").agg(F.count("*").alias("_n"), F.min("seq").alias("_first"))
    best = dirs.groupBy("cluster").agg(F.max_by("_dir", F.struct("_n", -F.col("_first"))).alias("_best"))
    first = n.groupBy("cluster").agg(F.min_by("name", "seq").alias("_name"))
    return first.join(best, "cluster", "left").select("cluster", F.coalesce("_best", "_name").alias("cluster_name"))


def orphan_annotations(annotations: DataFrame, nodes: DataFrame) -> DataFrame:
    return annotations.join(nodes.select("node_id"), "node_id", "left_anti").select(annotations.columns)


def latest_annotation(annotations: DataFrame) -> DataFrame:
    """(node_id, text, author): the last written of each node."""
    last = F.max_by(F.struct("text", "author"), F.col("id"))
    return annotations.groupBy("node_id").agg(last.alias("l")).select("node_id", "l.text", "l.author")


def upsert_annotations(annotations: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` in place of the annotations of the same nodes."""
    return annotations.join(new.select("node_id"), "node_id", "left_anti").select(annotations.columns).unionByName(new)


def remove_annotations(annotations: DataFrame, ids: DataFrame) -> DataFrame:
    return annotations.join(ids, "id", "left_anti").select(annotations.columns)


def evicted(files: DataFrame, limit: int) -> DataFrame:
    """Cache files to delete, oldest first, until the rest take at most ``limit`` bytes. ``files``: path, size, mtime.

    A running total over hash-free ranges of mtime: each day's total first, then within the days.
    """
    f = files.withColumn("_day", F.to_date("mtime"))
    days = f.groupBy("_day").agg(F.sum("size").alias("_sum"))
    newer = Window.orderBy(F.col("_day").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    days = days.select("_day", F.coalesce(F.sum("_sum").over(newer), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_day").orderBy(F.col("mtime").desc(), F.col("path").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return f.join(days, "_day").withColumn("_kept", F.sum("size").over(own) + F.col("_before")).where(F.col("_kept") > limit).select("path", "size", "mtime")


