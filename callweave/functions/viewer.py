"""What a graph viewer shows: labels, classes, which nodes and edges are visible."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import checkpointed
from . import text as T

# The sign before a node's name, by kind.
ICONS = {"function": "ƒ", "method": "M", "class": "C", "conditional": "?", "loop": "↻", "callback": "λ", "unresolved": "?"}


def label(kind: Column, name: Column, hidden: Column | None = None) -> Column:
    """Icon and name; of a collapsed node also the number of nodes that it hides (null: not collapsed)."""
    icon = reduce(lambda a, kv: F.when(kind == kv[0], kv[1]).otherwise(a), ICONS.items(), F.lit(""))
    plain = F.concat(icon, F.lit(" "), name)
    return plain if hidden is None else F.coalesce(F.concat(plain, F.lit(" [+"), hidden.cast("string"), F.lit("]")), plain)


def boundary(cluster: Column) -> Column:
    """The class of a feature boundary by the parity of its number; null where ``cluster`` has none."""
    number = F.regexp_extract(F.replace(cluster, F.lit("cluster-"), F.lit("")), r"^\s*(\d+)", 1)
    return F.when(number != "", F.concat(F.lit("boundary-"), F.pmod(number.cast("long"), F.lit(2)).cast("string")))


def project_key(root: Column) -> Column:
    """Twelve hex digits that name a project's folder in a cache."""
    return F.substring(F.sha2(root, 256), 1, 12)


def viewer_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge for each pair of shown nodes, with the kind met first (by ``seq``); self loops are left out."""
    shown = nodes.select("node_id").distinct()
    kept = edges.where("source_id <> target_id")
    for end in ("source_id", "target_id"):
        kept = kept.join(shown.select(F.col("node_id").alias(end)), end, "left_semi")
    return kept.groupBy("source_id", "target_id").agg(F.min_by("kind", "seq").alias("kind"))


def cascaded(hidden: DataFrame, nodes: DataFrame, edges: DataFrame, missing_hidden: bool = False) -> DataFrame:
    """``hidden`` (node_id) and the conditionals of ``nodes`` (node_id, kind) all of whose targets are hidden, again and again.

    A conditional without edges stays. Targets that are no node count as hidden if
    ``missing_hidden``, else such edges don't count.
    """
    hidden = checkpointed(hidden.select("node_id").distinct())
    known = nodes.select(F.col("node_id").alias("target_id"), F.lit(True).alias("known"))
    own = edges.join(nodes.where("kind = 'conditional'").select(F.col("node_id").alias("source_id")), "source_id", "left_semi")
    own = checkpointed(own.select("source_id", "target_id").distinct().join(known, "target_id", "left").where(F.lit(missing_hidden) | F.col("known").isNotNull()))
    while True:
        marked = own.join(hidden.select(F.col("node_id").alias("target_id"), F.lit(True).alias("gone")), "target_id", "left")
        full = marked.groupBy("source_id").agg(F.bool_and(F.col("gone").isNotNull() | F.col("known").isNull()).alias("all")).where("all")
        new = checkpointed(full.select(F.col("source_id").alias("node_id")).join(hidden, "node_id", "left_anti"))
        if new.isEmpty():
            return hidden
        hidden = checkpointed(hidden.unionAll(new))


def states(nodes: DataFrame, edges: DataFrame, passes: Column, matches: Column, hide_library: bool) -> DataFrame:
    """(node_id, state): hidden, highlighted or dimmed; with ``hide_library`` unresolved nodes are hidden, and conditionals that lead to hidden nodes only."""
    unresolved = F.col("kind") == "unresolved"
    state = nodes.select("node_id", T.visibility_state(hide_library, unresolved, passes, matches).alias("state"))
    if not hide_library:
        return state
    gone = cascaded(nodes.where(unresolved), nodes, edges).withColumn("_gone", F.lit(True))
    return state.join(gone, "node_id", "left").select("node_id", F.when(F.col("_gone"), "hidden").otherwise(F.col("state")).alias("state"))


def list_view(nodes: DataFrame, edges: DataFrame, query: str = "", keep: Column | None = None, hide_library: bool = False, path: list[str] | None = None) -> DataFrame:
    """The nodes that a list shows: on the path (by id, or by a name that ends one of its ids), not hidden, kept by the preset and found by the query."""
    out = nodes
    if path:
        ends = F.exists(F.array(*map(F.lit, path)), lambda p: p.endswith(F.concat(F.lit(":"), F.col("name"))))
        out = out.where(F.concat_ws(":", "file_path", F.col("line").cast("string"), "name").isin(path) | ends)
    if hide_library:
        out = out.join(cascaded(nodes.where("kind = 'unresolved'"), nodes, edges, missing_hidden=True), "node_id", "left_anti")
    if keep is not None:
        out = out.where(keep)
    if query:
        out = out.where(T.match_field(query, F.col("name"), F.col("qualified_name"), F.col("file_path"), F.col("kind")).isNotNull())
    return out.select(nodes.columns)


def overlay_classes(nodes: DataFrame, dead: DataFrame, modified: DataFrame, radius: DataFrame, paths: DataFrame, sinks: DataFrame) -> DataFrame:
    """(node_id, classes): the classes that analyses give a node, in this order: dead code, modified or else in the radius, on a data-flow path, sink.

    All but ``nodes`` hold node_id; ``paths`` a row for each node on a path.
    """
    marks = ((dead, "dead-code"), (modified, "impact-modified"), (radius, "impact-blast-radius"), (paths, "dataflow-path"), (sinks, "dataflow-sink"))
    every = reduce(DataFrame.unionAll, [d.select("node_id", F.lit(i).alias("i"), F.lit(name).alias("class")) for i, (d, name) in enumerate(marks)])
    found = every.join(nodes.select("node_id").distinct(), "node_id", "left_semi").groupBy("node_id").agg(F.array_sort(F.collect_set(F.struct("i", "class"))).alias("c"))
    named = F.transform("c", lambda x: x["class"])
    return found.select("node_id", F.when(F.array_contains(named, "impact-modified"), F.array_remove(named, "impact-blast-radius")).otherwise(named).alias("classes"))
