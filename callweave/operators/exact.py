"""The call graph in source order: depth-first, with cycle, depth and cap flags.

Which nodes are flagged depends on the order of calls, so the walk itself is sequential
and runs on the driver. What it walks is prepared in DataFrames: every body's calls,
resolved and dispatched, and its conditionals. The walk fetches the bodies it enters, and
their targets' in the same job; the node cap bounds how many.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import calls as C
from .graph import checkpointed, stored

MOST_NODES = 500
#: Callers that a walk upstream fetches ahead at most.
AHEAD = 50_000


@dataclass
class Options:
    max_depth: int | None = None
    max_nodes: int = MOST_NODES
    conditionals: bool = True


@dataclass
class Node:
    id: str
    name: str
    qualified_name: str
    kind: str
    file_path: str
    line: int
    column: int = 0
    signature: str = ""
    visibility: str = "default"
    depth_limited: bool = False
    unresolved: bool = False
    on_cycle: bool = False


@dataclass
class Edge:
    source: str
    target: str
    kind: str = "call"
    branches: int | None = None


@dataclass
class Graph:
    """Nodes by id in order of discovery, and edges in order, repeats included."""

    entry: str
    direction: str = "downstream"
    nodes: dict[str, Node] = field(default_factory=dict)
    edges: list[Edge] = field(default_factory=list)
    max_depth: int | None = None
    truncated: bool = False
    cap_hit: bool = False

    def frames(self, spark) -> tuple[DataFrame, DataFrame]:
        nodes = [(n.id, n.name, n.qualified_name, n.kind, n.file_path, n.line, n.depth_limited, n.unresolved, n.on_cycle, i) for i, n in enumerate(self.nodes.values())]
        edges = [(e.source, e.target, e.kind, e.branches, i) for i, e in enumerate(self.edges)]
        return (
            spark.createDataFrame(nodes, "node_id string, name string, qualified_name string, kind string, file_path string, line long, depth_limited boolean, unresolved boolean, on_cycle boolean, seq long"),
            spark.createDataFrame(edges, "source_id string, target_id string, kind string, branches long, seq long"),
        )


def node_of(row) -> Node:
    kind = row["kind"] if row["kind"] in ("function", "method") else "function"
    has = row.asDict() if hasattr(row, "asDict") else row
    return Node(row["node_id"], row["name"], row["qualified_name"], kind, row["file_path"], row["line"], has.get("column") or 0, has.get("signature") or "", row["visibility"])


class Code:
    """Prepared tables: ``bodies`` (a row for each call or conditional of each body) and ``symbols``."""

    def __init__(self, symbols: DataFrame, calls: DataFrame, conditionals: DataFrame, imports: DataFrame | None = None):
        self.symbols = checkpointed(symbols)
        self.raw_calls, self.conditionals, self.imports = calls, conditionals, imports
        self._rows: dict[str, list] = {}
        self._symbols: dict[str, Node] = {}
        self._declared: dict[str, str] = {}
        self._bodied: dict[str, list[str]] = {}
        self.most = 0

    @cached_property
    def bodies(self) -> DataFrame:
        """Every body's calls and conditionals; only a walk downstream reads them."""
        resolved = C.resolve_calls(self.raw_calls, self.symbols, self.imports)
        none, conditionals = F.lit(None).cast("long"), self.conditionals
        condition, column = (F.col(c) if c in conditionals.columns else F.lit(d) for c, d in (("condition_text", ""), ("column", 0)))
        a = C.in_body(resolved, self.symbols).select(F.col("sym_node_id").alias("owner"), F.lit("call").alias("what"), "seq", "line", F.col("callee_name").alias("text"), "file_path", none.alias("end_line"), none.alias("branches"), "target", F.lit("").alias("condition"), none.alias("column"))
        b = C.in_body(conditionals, self.symbols).select(F.col("sym_node_id").alias("owner"), F.lit("cond").alias("what"), "seq", "line", F.col("kind").alias("text"), "file_path", "end_line", "branches", F.lit(None).cast("string").alias("target"), F.coalesce(condition, F.lit("")).alias("condition"), column.cast("long").alias("column"))
        return stored(a.unionAll(b))

    def body(self, owner: str, most: int = MOST_NODES) -> list:
        """The calls and conditionals of a body in order; a call has at most one target more than ``most`` (a walk stops at so many nodes)."""
        if most > self.most:
            self.most = most
            self._rows.clear()
            self._bodied.clear()
        if owner not in self._rows:
            self._fetch([owner])
            more = {t for r in self._rows[owner] for t in r["targets"]} - self._rows.keys()
            if more:
                self._fetch(sorted(more)[:2000])
        return self._rows[owner]

    def _fetch(self, owners: list[str]) -> None:
        for o in owners:
            self._rows[o] = []
        found = self.bodies.where(F.col("owner").isin(owners)).orderBy("owner", "seq").collect()
        self.learn({r["target"] for r in found if r["target"] is not None} | set(owners))
        # a one-line declaration stands for its namesakes with a body: asked for the bodies that are entered, not for all calls
        if names := sorted({self._declared[r["target"]] for r in found if r["target"] in self._declared} - self._bodied.keys()):
            self._bodied.update({n: [] for n in names})
            bodied = self.symbols.where(F.col("name").isin(names) & (F.col("body_start") != F.col("body_end")))
            first = bodied.withColumn("_rank", F.row_number().over(Window.partitionBy("name").orderBy("seq", "node_id"))).where(F.col("_rank") <= self.most + 1)
            for r in first.orderBy("name", "_rank").collect():
                self._bodied[r["name"]].append(r["node_id"])
        for r in found:
            t = r["target"]
            targets = [] if t is None else self._bodied.get(self._declared.get(t)) or [t]
            self._rows[r["owner"]].append(r.asDict() | {"targets": targets})
        self.learn({t for o in owners for r in self._rows[o] for t in r["targets"]})

    def learn(self, ids: set[str]) -> None:
        """Fetch the symbols of those that are not known yet, together."""
        if missing := sorted(ids - self._symbols.keys()):
            for r in self.symbols.where(F.col("node_id").isin(missing)).collect():
                self._symbols[r["node_id"]] = node_of(r)
                if r["body_start"] == r["body_end"]:
                    self._declared[r["node_id"]] = r["name"]

    def node(self, id_: str) -> Node:
        self.learn({id_})
        n = self._symbols[id_]
        return Node(**n.__dict__)


def downstream(code: Code, entry: str, options: Options = Options()) -> Graph:
    g = Graph(entry, "downstream", max_depth=options.max_depth)
    g.nodes[entry] = code.node(entry)
    stack, done = set(), set()
    full = lambda: len(g.nodes) >= options.max_nodes

    def visit(node: Node, depth: int):
        """A generator: yields the node to enter next; resumed when that one is finished."""
        stack.add(node.id)
        limited = options.max_depth is not None and depth >= options.max_depth or full()
        if limited:
            node.depth_limited = True
        else:
            rows = code.body(node.id, options.max_nodes)
            held = []
            if options.conditionals:
                for r in (r for r in rows if r["what"] == "cond"):
                    id_ = f"{r['file_path']}:{r['line']}:{r['text']}"
                    if id_ not in g.nodes:
                        said = f"{r['text']} ({r['condition']})" if r["condition"] else r["text"]
                        g.nodes[id_] = Node(id_, said, f"{node.qualified_name}.{said}", "conditional", r["file_path"], r["line"], r["column"] or 0, r["condition"])
                    g.edges.append(Edge(node.id, id_, "conditional_flow", r["branches"]))
                    # a later conditional of the same kind on the line takes the earlier one's place
                    held = [h if h[0] != id_ else (id_, r) for h in held] if any(h[0] == id_ for h in held) else [*held, (id_, r)]
            for r in (r for r in rows if r["what"] == "call"):
                if full():
                    g.cap_hit = True
                    break
                source = next((i for i, c in held if c["branches"] > 1 and c["line"] <= r["line"] <= c["end_line"]), node.id)
                if not r["targets"]:
                    id_ = f"{r['file_path']}:{r['line']}:{r['text']}"
                    g.nodes.setdefault(id_, Node(id_, r["text"], r["text"], "unresolved", r["file_path"], r["line"], unresolved=True))
                    g.edges.append(Edge(source, id_))
                for t in r["targets"]:
                    if full():
                        g.cap_hit = True
                        break
                    known = g.nodes.setdefault(t, code.node(t))
                    if t in stack:
                        known.on_cycle = node.on_cycle = True
                        g.edges.append(Edge(source, t, "cycle_back_edge"))
                        continue
                    g.edges.append(Edge(source, t))
                    if t not in done and not known.depth_limited:
                        yield known, depth + 1
        stack.discard(node.id)
        done.add(node.id)

    _walk(visit, g.nodes[entry])
    prune(g)
    g.truncated = len(g.nodes) >= options.max_nodes
    return g


def _walk(visit, node: Node) -> None:
    """Depth-first without recursion."""
    todo = [visit(node, 0)]
    while todo:
        nxt = next(todo[-1], None)
        if nxt is None:
            todo.pop()
        else:
            todo.append(visit(*nxt))


def upstream(code: Code, target: str, options: Options = Options()) -> Graph:
    """Callers of callers: exact callee text, enclosed by the first-inserted symbol, itself left out; no conditionals."""
    g = Graph(target, "upstream", max_depth=options.max_depth)
    g.nodes[target] = code.node(target)
    # each caller of a name is a node, so the walk stops before it has passed more of them than nodes, and the name's own
    found = C.enclosing(code.raw_calls, code.symbols, code.raw_calls.columns, "first").groupBy("callee_name", "sym_node_id").agg(F.min("seq").alias("s"), F.first("sym_name").alias("sym_name"))
    rank = F.row_number().over(Window.partitionBy("callee_name").orderBy("s", "sym_node_id"))
    around = checkpointed(found.withColumn("r", rank).where(F.col("r") <= options.max_nodes + 1))
    cache: dict[str, list[tuple[str, str]]] = {}
    stack, done = set(), set()

    def fetch(names: list[str]) -> None:
        cache.update({n: [] for n in names})
        for r in around.where(F.col("callee_name").isin(names)).orderBy("callee_name", "r").collect():
            cache[r["callee_name"]].append((r["sym_node_id"], r["sym_name"]))

    def callers(name: str) -> list[tuple[str, str]]:
        if name not in cache:
            fetch([name])
            # the walk goes on to these, so theirs come with one more job
            if more := list(dict.fromkeys(n for _, n in cache[name] if n not in cache)):
                fetch(more[: max(1, AHEAD // options.max_nodes)])
        return cache[name]

    def visit(node: Node, depth: int):
        stack.add(node.id)
        if options.max_depth is not None and depth >= options.max_depth or len(g.nodes) >= options.max_nodes:
            node.depth_limited = True
        else:
            for c, name in callers(node.name):
                if c == node.id:
                    continue
                if len(g.nodes) >= options.max_nodes:
                    g.cap_hit = True
                    break
                # where it stands is asked for all nodes at the end
                known = g.nodes.setdefault(c, Node(c, name, name, "function", "", 0))
                if c in stack:
                    known.on_cycle = node.on_cycle = True
                    g.edges.append(Edge(c, node.id, "cycle_back_edge"))
                    continue
                g.edges.append(Edge(c, node.id))
                if c not in done and not known.depth_limited:
                    yield known, depth + 1
        stack.discard(node.id)
        done.add(node.id)

    _walk(visit, g.nodes[target])
    code.learn(set(g.nodes))
    g.nodes = {i: replace(code.node(i), depth_limited=n.depth_limited, on_cycle=n.on_cycle) for i, n in g.nodes.items()}
    g.truncated = len(g.nodes) >= options.max_nodes
    return g


def bidirectional(code: Code, entry: str, options: Options = Options()) -> Graph:
    """Both directions; nodes distinct by id (downstream's win), edges by source, target and kind."""
    down, up = downstream(code, entry, options), upstream(code, entry, options)
    g = Graph(entry, "bidirectional", {**up.nodes, **down.nodes}, max_depth=options.max_depth)
    g.nodes = {**down.nodes, **{k: v for k, v in up.nodes.items() if k not in down.nodes}}
    g.edges = list({(e.source, e.target, e.kind): e for e in reversed([*down.edges, *up.edges])}.values())[::-1]
    prune(g)
    g.truncated = len(g.nodes) >= options.max_nodes
    return g


def prune(g: Graph) -> None:
    """Drop conditionals that lead nowhere or to unresolved nodes only, until none is left."""
    while True:
        out: dict[str, list[str]] = {}
        for e in g.edges:
            out.setdefault(e.source, []).append(e.target)
        dead = {i for i, n in g.nodes.items() if n.kind == "conditional" and all(t not in g.nodes or g.nodes[t].unresolved for t in out.get(i, []))}
        if not dead:
            return
        g.nodes = {i: n for i, n in g.nodes.items() if i not in dead}
        g.edges = [e for e in g.edges if e.source not in dead and e.target not in dead]


def without_unresolved(g: Graph) -> Graph:
    kept = {i: n for i, n in g.nodes.items() if not n.unresolved}
    return Graph(g.entry, g.direction, kept, [e for e in g.edges if e.source in kept and e.target in kept], g.max_depth, g.truncated, g.cap_hit)


def data_flow(g: Graph, source: str, variable: str, calls_in: dict[str, list] | None, sink_of) -> tuple[list, list]:
    """Paths of ``variable`` from ``source`` along the graph, and the sinks met.

    ``calls_in``: by file, (callee text, arguments or None) of its calls; a file without an
    entry passes the variable on. Returns ([node ids], ...) and (node, sink type, variable).
    """
    out: dict[str, list[str]] = {}
    for e in g.edges:
        out.setdefault(e.source, []).append(e.target)
    paths, sinks, seen = [], [], set()

    def passes(a: Node, b: Node) -> bool:
        own = None if calls_in is None else calls_in.get(a.file_path)
        return own is None or any(text in (b.name, b.qualified_name) and (args is None or any(variable in x for x in args)) for text, args in own)

    def visit(id_: str, path: tuple[str, ...]):
        node = g.nodes.get(id_)
        if node is not None and (kind := sink_of(node.name, node.qualified_name)):
            sinks.append((id_, kind, variable))
        ends = id_ in seen
        seen.add(id_)
        if not ends:
            ends = True
            for t in out.get(id_, []):
                if node is not None and t in g.nodes and passes(node, g.nodes[t]):
                    ends = False
                    yield t, (*path, t)
        if ends and len(path) > 1:
            paths.append(list(path))

    todo = [visit(source, (source,))]
    while todo:
        nxt = next(todo[-1], None)
        if nxt is None:
            todo.pop()
        else:
            todo.append(visit(*nxt))
    return paths, sinks


def calls_in(g: Graph, calls: DataFrame) -> dict[str, list]:
    """By file of the graph's nodes, the calls to any of them: (text, arguments or None); no entry for a file without calls."""
    files = sorted({n.file_path for n in g.nodes.values()})
    texts = sorted({x for n in g.nodes.values() for x in (n.name, n.qualified_name)})
    own = calls.where(F.col("file_path").isin(files))
    out: dict[str, list] = {r[0]: [] for r in own.select("file_path").distinct().collect()}  # a graph's files
    for r in own.where(F.col("callee_name").isin(texts)).select("file_path", "callee_name", "arguments").distinct().toLocalIterator():
        out[r["file_path"]].append((r["callee_name"], r["arguments"]))
    return out


def affected_paths(direct: list[str], callers: dict[str, list[str]], callees: dict[str, list[str]]) -> list[list[str]]:
    """Chains caller, match, callee through every direct match, as long as each has such neighbours."""
    found = []
    for d in direct:
        for a in callers.get(d) or [None]:
            for b in callees.get(d) or [None]:
                found.append([x for x in (a, d, b) if x is not None])
    return found


def reach(g: Graph, start: str) -> dict[str, int]:
    """Distances along the graph's edges."""
    out: dict[str, list[str]] = {}
    for e in g.edges:
        out.setdefault(e.source, []).append(e.target)
    dist, queue = {start: 0}, deque([start])
    while queue:
        n = queue.popleft()
        for t in out.get(n, []):
            if t not in dist:
                dist[t] = dist[n] + 1
                queue.append(t)
    return dist
