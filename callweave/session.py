"""The library's front: a code base as an index, and every question about it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import render
from .functions import text as T
from .operators import calls as C
from .operators import communities, exact, ranking
from .operators import graph as G
from .operators import overlays as O
from .sources import readers as R
from .sources.index import Index, discover


class Project:
    """An index and the graphs and overlays over it. Everything is lazy but what a walk needs."""

    def __init__(self, spark: SparkSession, index: Index, config: R.Config | None = None, root: str = ""):
        self.spark, self.index, self.config, self.root = spark, index, config or R.Config(), root

    @staticmethod
    def open(spark: SparkSession, root: str, flags: dict | None = None) -> Project:
        config = R.Config.load(root, flags)
        return Project(spark, Index.build(discover(spark, root, config.include, config.exclude, config.language_overrides)), config, root)

    @cached_property
    def code(self) -> exact.Code:
        i = self.index
        return exact.Code(i.symbols, i.calls.drop("arguments", "name_column"), i.conditionals, i.single_imports())

    def entry(self, spec: str) -> str | None:
        row = C.find_entry(self.index.symbols, spec).first()
        return row["node_id"] if row else None

    def graph(self, entry: str, direction: str = "downstream", options: exact.Options = exact.Options()) -> exact.Graph:
        walk = {"downstream": exact.downstream, "upstream": exact.upstream, "bidirectional": exact.bidirectional}
        if direction not in walk:
            raise ValueError(f"direction must be one of {', '.join(walk)}")
        return walk[direction](self.code, entry, options)

    def rank(self, description: str) -> DataFrame:
        return ranking.rank_entries(self.index.symbols, description)

    def trace(self, condition: str, depth: int = 10) -> dict[str, DataFrame]:
        """Where a condition is evaluated, what leads there, and the chains through it."""
        s, calls, word = self.index.symbols, self.index.calls.drop("arguments"), condition.lower()
        around = C.enclosing(calls, s, calls.columns).select("callee_name", "line", F.col("sym_node_id").alias("node_id"))
        named = s.where(F.lower("name").contains(word)).select("node_id", "line", F.lit(1).alias("pass"), F.col("signature").alias("snippet"))
        called = around.where(F.lower("callee_name").contains(word)).select("node_id", "line", F.lit(2).alias("pass"), F.concat(F.lit("calls "), "callee_name", F.lit("()")).alias("snippet"))
        direct = named.unionAll(called).groupBy("node_id").agg(F.min(F.struct("pass", "line", "snippet")).alias("m")).select("node_id", "m.line", "m.snippet", F.lit("direct_evaluation").alias("match_type"))
        direct = G.checkpointed(direct)
        callers = around.join(s.select(F.col("name").alias("callee_name"), F.col("node_id").alias("target_id")), "callee_name").select(F.col("node_id").alias("source_id"), "target_id").distinct()
        far = G.condition_closure(self.spark, direct, callers, depth, G.SMALL).join(s.select("node_id", "name"), "node_id").select("node_id", "dist", T.transitive_match(F.col("name")).alias("match_type"))
        callees = C.callees_in(s.join(direct.select("node_id"), "node_id", "left_semi"), calls, F.lit(True))
        up = callers.join(direct.select(F.col("node_id").alias("target_id")), "target_id", "left_semi")
        chains = direct.select("node_id").join(up.select(F.col("target_id").alias("node_id"), F.col("source_id").alias("before")), "node_id", "left").join(callees.select(F.col("caller_id").alias("node_id"), F.col("callee_id").alias("after")), "node_id", "left")
        return {"direct": direct, "transitive": far, "paths": chains.select(F.array_compact(F.array("before", "node_id", "after")).alias("nodes"))}

    def overlay(self, kind: str, entry: str | None = None, **kw) -> DataFrame | dict[str, DataFrame]:
        """complexity, deadcode, coverage, temporal, impact, boundary or dataflow, over the whole index or an entry's graph."""
        s = self.index.symbols
        if kind == "deadcode":
            return O.dead_code(s, self.index.calls, self.index.exports)
        nodes, edges, g = s, None, None
        if entry is not None:
            g = self.graph(entry)
            n, edges = g.frames(self.spark)
            nodes = s.join(n.select("node_id"), "node_id", "left_semi")
        if kind == "complexity":
            return O.complexity(nodes, self.index.conditionals)
        if kind == "coverage":
            report = R.coverage(self.spark, kw["report"])
            paths = O.match_paths(nodes, report.groupBy("file_path").agg(F.min("seq").alias("seq")))
            hits = report.withColumnRenamed("file_path", "reported_path").join(paths, "reported_path").select("file_path", "line", "hits")
            return O.coverage(nodes, hits)
        if kind == "temporal":
            commits = kw.get("commits")
            commits = R.git_commits(self.spark, self.root) if commits is None else commits
            return O.node_churn(nodes, commits, kw.get("anchor", F.current_timestamp()), kw.get("days", 90))
        edges = edges if edges is not None else C.call_edges(self.index.calls.drop("arguments"), s, self.index.single_imports())
        if kind == "impact":
            hunks = R.diff_text(self.spark, kw["diff"]) if "diff" in kw else R.git_diff(self.spark, self.root)
            modified = O.modified_nodes(nodes, hunks).select("node_id")
            radius = G.blast_radius(edges, modified, G.SMALL)
            return {"modified": modified, "radius": radius, "external": G.external_dependents(radius, edges, entry)}
        if kind == "boundary":
            found = communities.detect(nodes, O.undirected(edges, nodes), kw.get("method", "louvain"))
            return O.cluster_names(nodes, found).join(O.inter_cluster_edges(edges, found), "cluster", "left")
        if kind == "dataflow":
            if g is None:
                raise ValueError("dataflow needs an entry")
            calls_in = kw["calls_in"] if "calls_in" in kw else exact.calls_in(g, self.index.calls)
            named = n.select("name", "qualified_name", T.sink(F.col("name"), F.col("qualified_name")).alias("sink")).where("sink IS NOT NULL")
            known = {(r["name"], r["qualified_name"]): r["sink"] for r in named.toLocalIterator()}  # of the nodes of one graph
            paths, sinks = exact.data_flow(g, kw.get("source", g.entry), kw["variable"], calls_in, lambda *names: known.get(names))
            return {"paths": self.spark.createDataFrame([(p,) for p in paths], "nodes array<string>"), "sinks": self.spark.createDataFrame(sinks, "node_id string, sink string, variable string")}
        raise ValueError(f"unknown overlay: {kind}")

    def path(self, source: str, target: str) -> list[str]:
        """A shortest path between two nodes of the source's graph in both directions."""
        return G.shortest_path(self.graph(source, "bidirectional").frames(self.spark)[1], source, target, G.SMALL)


def rendered(g: exact.Graph, form: str, root: str = "") -> str:
    return {"json": lambda: render.to_json(g, root), "mermaid": lambda: render.to_mermaid(g), "text": lambda: render.to_tree(g)}[form]()
