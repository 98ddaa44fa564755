"""Walks against models: flags, pruning, loops, communities, renderings."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callweave.functions import render
from callweave.operators import calls as C
from callweave.operators import communities, exact
from callweave.operators import graph as G
from callweave.operators import overlays as O

F1 = "src/app.ts"


def symbol(name, line, end, kind="function", file=F1, seq=None):
    return (name, name, kind, file, line, line, end, "public", f"{file}:{line}:{name}", seq if seq is not None else line)


SYMBOL = "name string, qualified_name string, kind string, file_path string, line long, body_start long, body_end long, visibility string, node_id string, seq long"


def code(spark, symbols, calls, conds=()):
    return exact.Code(
        spark.createDataFrame(list(symbols), SYMBOL),
        spark.createDataFrame([(n, F1, line, 0, i) for i, (n, line) in enumerate(calls)], "callee_name string, file_path string, line long, column long, seq long"),
        spark.createDataFrame([(k, F1, a, b, n, i) for i, (k, a, b, n) in enumerate(conds)], "kind string, file_path string, line long, end_line long, branches long, seq long"),
    )


def ids(name, line):
    return f"{F1}:{line}:{name}"


def test_diamond_cycle_and_recursion(spark):
    c = code(spark, [symbol("a", 0, 9), symbol("b", 10, 19), symbol("c", 20, 29), symbol("d", 30, 39)], [("b", 1), ("c", 2), ("d", 11), ("d", 21), ("a", 31), ("d", 32)])
    g = exact.downstream(c, ids("a", 0))
    kinds = [(e.source.rsplit(":", 1)[1], e.target.rsplit(":", 1)[1], e.kind) for e in g.edges]
    assert kinds == [("a", "b", "call"), ("b", "d", "call"), ("d", "a", "cycle_back_edge"), ("d", "d", "cycle_back_edge"), ("a", "c", "call"), ("c", "d", "call")]
    assert {n.name for n in g.nodes.values() if n.on_cycle} == {"a", "d"}
    assert not g.truncated
    up = exact.upstream(c, ids("d", 30))
    assert {n.name for n in up.nodes.values()} == {"a", "b", "c", "d"}
    both = exact.bidirectional(c, ids("a", 0))
    assert len({(e.source, e.target, e.kind) for e in both.edges}) == len(both.edges)


def test_depth_flag_stays_after_a_shorter_path(spark):
    c = code(spark, [symbol("a", 0, 9), symbol("b", 10, 19), symbol("c", 20, 29), symbol("d", 30, 39)], [("b", 1), ("c", 2), ("c", 11), ("d", 21)])
    g = exact.downstream(c, ids("a", 0), exact.Options(max_depth=2))
    assert g.nodes[ids("c", 20)].depth_limited and ids("d", 30) not in g.nodes


def test_cap(spark):
    c = code(spark, [symbol("a", 0, 9), *[symbol(f"f{i}", 10 * i, 10 * i + 5) for i in range(1, 9)]], [(f"f{i}", 1) for i in range(1, 9)])
    g = exact.downstream(c, ids("a", 0), exact.Options(max_nodes=4))
    assert len(g.nodes) == 4 and g.truncated and g.cap_hit


def test_conditionals_route_and_prune(spark):
    c = code(spark, [symbol("a", 0, 9), symbol("b", 10, 19)], [("b", 2), ("lost", 5), ("b", 8)], [("if", 1, 3, 2), ("switch", 4, 6, 3), ("if", 8, 8, 1)])
    g = exact.downstream(c, ids("a", 0))
    assert {n.kind for n in g.nodes.values()} == {"function", "conditional", "unresolved"}
    # the switch leads to an unresolved call only, the guard to nothing
    assert [n.line for n in g.nodes.values() if n.kind == "conditional"] == [1]
    assert [(e.source, e.target) for e in g.edges if e.target == ids("b", 10)] == [(f"{F1}:1:if", ids("b", 10)), (ids("a", 0), ids("b", 10))]
    assert not any(n.unresolved for n in exact.without_unresolved(g).nodes.values())


def test_interface_dispatch(spark):
    rows = [symbol("a", 0, 9), symbol("run", 10, 10, "method", seq=1), symbol("run", 20, 25, "method", "src/x.ts", 2), symbol("run", 30, 35, "method", "src/y.ts", 3)]
    g = exact.downstream(code(spark, rows, [("run", 1)]), ids("a", 0))
    assert [e.target for e in g.edges] == ["src/x.ts:20:run", "src/y.ts:30:run"]


def graph():
    n = lambda i, name, **k: exact.Node(f"{F1}:{i}:{name}", name, name, k.pop("kind", "function"), F1, i, **k)
    nodes = [n(0, "main"), n(3, "if", kind="conditional"), n(10, 'say "<x>"'), n(20, "deep", depth_limited=True), n(30, "gone", kind="unresolved", unresolved=True)]
    edges = [exact.Edge(nodes[0].id, nodes[1].id, "conditional_flow", 2), exact.Edge(nodes[1].id, nodes[2].id), exact.Edge(nodes[0].id, nodes[3].id), exact.Edge(nodes[0].id, nodes[4].id), exact.Edge(nodes[2].id, nodes[0].id, "cycle_back_edge")]
    return exact.Graph(nodes[0].id, "downstream", {x.id: x for x in nodes}, edges)


def test_json_round_trip():
    g = graph()
    again = render.from_json(render.to_json(g))
    assert again.nodes == g.nodes and again.edges == g.edges and again.entry == g.entry
    assert json.loads(render.to_json(g))["overlays"] == {}


@pytest.mark.parametrize(("text", "said"), [("{", "malformed"), ("[]", "object at root"), ("{}", "version"), ('{"version":1}', "metadata"), ('{"version":1,"metadata":{}}', "nodes"), ('{"version":1,"metadata":{},"nodes":[]}', "edges"), ('{"version":1,"metadata":{},"nodes":{},"edges":[]}', "array")])
def test_json_errors(text, said):
    with pytest.raises(ValueError, match=said):
        render.from_json(text)


def test_mermaid():
    rows = render.to_mermaid(graph()).split("\n")
    assert rows[0] == "graph LR" and any("#quot;&lt;x&gt;#quot;" in r and "app.ts:11" in r for r in rows)
    assert sum("-.->|conditional|" in r for r in rows) == 1 and sum("--x|cycle|" in r for r in rows) == 1


def test_tree():
    assert render.to_tree(graph()).split("\n") == [
        "main (app.ts:1) [function]",
        "├── if (app.ts:4) [conditional, 2 branches]",
        '│   └── say "<x>" (app.ts:11) [function]',
        "│       └── ⟲ main [cycle]",
        "├── deep (app.ts:21) [function] ...",
        "└── ? gone [unresolved]",
    ]
    assert render.to_tree(exact.Graph("x")) == ""


def edge_frame(spark, pairs):
    return spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "source_id string, target_id string")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=25))
def test_bfs_small_and_distributed_agree(spark, pairs):
    e, start = edge_frame(spark, pairs), spark.createDataFrame([("0",)], "node_id string")
    near = sorted(map(tuple, G.bfs(e, start).collect()))
    assert near == sorted(map(tuple, G.bfs(e, start, small=G.SMALL).collect()))
    dist, front = {0: 0}, [0]
    while front:
        front = [b for a in front for x, b in pairs if x == a and b not in dist and not dist.update({b: dist[a] + 1})]
    assert near == sorted((str(k), v) for k, v in dist.items())


def test_paths_and_views(spark):
    e = spark.createDataFrame([("a", "b", 0), ("b", "c", 1), ("a", "c", 2), ("c", "d", 3), ("d", "b", 4)], "source_id string, target_id string, seq long")
    assert G.shortest_path(e, "a", "d") == ["a", "c", "d"] and G.shortest_path(e, "d", "a") == ["d", "c", "a"] and G.shortest_path(e, "a", "z") == []
    assert G.max_depth(e, "a") == 2 and G.ancestors(e, "c")[0] == "a"
    chains = {r["node_id"]: r["chain"] for r in G.ancestor_chains(e).collect()}
    assert chains == {"b": ["d", "c", "a"], "c": ["a"], "d": ["c", "a"]}
    counts = {r[0]: r[1] for r in G.descendant_counts(e, spark.createDataFrame([("a",), ("b",), ("z",)], "node_id string")).collect()}
    assert counts == {"a": 3, "b": 3, "z": 0}
    seen = {r[0] for r in G.visible_nodes(e, "a", spark.createDataFrame([("c",)], "node_id string")).collect()}
    assert seen == {"a", "b", "c"}


def test_louvain_two_triangles(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f")]
    found, q = communities.louvain(list("abcdef"), [(a, b, 1.0) for a, b in pairs])
    assert len({found[x] for x in "abc"}) == 1 and len({found[x] for x in "def"}) == 1 and round(q, 6) == 0.530612
    frame = spark.createDataFrame(pairs, "a string, b string")
    row = O.modularity(frame, spark.createDataFrame(list(found.items()), "node_id string, cluster long")).first()
    assert round(row["modularity"], 6) == 0.530612 and round(row["standard"], 6) == 0.357143
    label = communities.label_propagation(list("abcdef"), pairs)
    assert set(label) == set("abcdef")
    assert communities.propagate(spark.createDataFrame([(x,) for x in "abcdef"], "node_id string"), frame).count() == 6
    assert communities.louvain(["x"], [])[0] == {"x": 0}


def test_data_flow():
    g = graph()
    paths, sinks = exact.data_flow(g, g.entry, "v", None, lambda n, q: "logging" if "say" in n else None)
    assert [f"{F1}:0:main", f"{F1}:20:deep"] in paths and sinks == [(f'{F1}:10:say "<x>"', "logging", "v")]
    none, _ = exact.data_flow(g, g.entry, "v", {F1: [("deep", ["w"]), ("if", None)]}, lambda n, q: None)
    assert all(p[-1] != f"{F1}:20:deep" for p in none)


def test_affected_paths():
    assert exact.affected_paths(["d"], {"d": ["a"]}, {"d": ["x", "y"]}) == [["a", "d", "x"], ["a", "d", "y"]]
    assert exact.affected_paths(["d"], {}, {}) == [["d"]]


def test_ancestors_of_chains_and_circles(spark):
    """Chains of any length, circles with tails, self loops and a tie, against a walk up from each node."""
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (102, 103), (103, 104), (7, 7), (200, 200), (50, 3)]
    e = edge_frame(spark, pairs).withColumn("seq", F.monotonically_increasing_id())
    seq = {(r["source_id"], r["target_id"]): r["seq"] for r in e.collect()}
    parent = {}
    for (a, b), _ in sorted(seq.items(), key=lambda x: x[1]):
        parent[b] = a
    want = {}
    for n in parent:
        chain, here = [], n
        while (up := parent.get(here)) is not None and up not in (n, *chain):
            chain.append(up)
            here = up
        if chain:
            want[n] = chain
    assert {r["node_id"]: r["chain"] for r in G.ancestor_chains(e).collect()} == want


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=30), st.sampled_from([None, 1, 2]))
def test_descendants_by_walking(spark, pairs, depth):
    def reached(n):
        front = seen = {b for a, b in pairs if a == n}
        for _ in range(100 if depth is None else depth - 1):
            front = {b for a, b in pairs if a in front} - seen
            seen = seen | front
        return len(seen)

    nodes = spark.createDataFrame([(str(i),) for i in range(14)], "node_id string")
    got = {r["node_id"]: r["descendants"] for r in G.descendant_counts(edge_frame(spark, pairs), nodes, depth).collect()}
    assert got == {str(i): reached(i) for i in range(14)}


def test_descendants_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(G, "BITS", 7)
    e = edge_frame(spark, [(i, i + 1) for i in range(12)] + [(12, 4)])
    nodes = spark.createDataFrame([(str(i),) for i in range(13)], "node_id string")
    got = {r["node_id"]: r["descendants"] for r in G.descendant_counts(e, nodes).collect()}
    assert got == {str(i): 12 - i if i < 4 else 9 for i in range(13)}


def test_callers_by_name_are_no_row_for_each_namesake(spark, monkeypatch):
    callers = spark.createDataFrame([("a", "f"), ("b", "g"), ("c", "f"), ("a", "h")], "source_id string, callee_name string")
    names = spark.createDataFrame([("f", f"f{i}") for i in range(500)] + [("g", "a"), ("h", "h")], "name string, node_id string")
    sizes, real = [], G.checkpointed
    monkeypatch.setattr(G, "checkpointed", lambda df: sizes.append((out := real(df)).count()) or out)
    starts = spark.createDataFrame([("f3",)], "node_id string")
    assert {tuple(r) for r in G.bfs_by_name(callers, names, starts).collect()} == {("f3", 0), ("a", 1), ("c", 1), ("b", 2)}
    assert {tuple(r) for r in G.bfs_by_name(callers, names, starts, 1).collect()} == {("f3", 0), ("a", 1), ("c", 1)}
    assert max(sizes) <= 4 + 502


@pytest.mark.parametrize("seed", range(4))
def test_descendants_around_a_large_cycle(spark, seed, monkeypatch):
    import random

    draw = random.Random(seed)
    ring = [(f"r{i}", f"r{(i + 1) % 30}") for i in range(30)] if seed else []
    edges = ring + [(draw.choice("rst") + str(draw.randrange(30)), draw.choice("rsu") + str(draw.randrange(30))) for _ in range(25)]
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)

    def closure(n):
        seen, front = set(), [n]
        while front:
            new = out.get(front.pop(), set()) - seen
            seen |= new
            front += new
        return len(seen)

    asked, real = [], G._descendant_bitmaps
    monkeypatch.setattr(G, "_descendant_bitmaps", lambda e, *more: asked.append(e.count()) or real(e, *more))
    nodes = sorted({x for e in edges for x in e} | {"alone"})
    got = {r[0]: r[1] for r in G.descendant_counts(spark.createDataFrame(edges, "source_id string, target_id string"), spark.createDataFrame([(n,) for n in nodes], "node_id string")).collect()}
    assert got == {n: closure(n) for n in nodes}
    assert not seed or all(n <= 25 for n in asked)  # no edge of the ring takes a bitmap


def test_declarations_are_dispatched_in_entered_bodies_only(spark):
    rows = [("m:0:main", "main", "m", 0, 0, 5, 0), ("d:0:f", "f", "d", 0, 0, 0, 1)] + [(f"i{i}:0:f", "f", f"i{i}", 0, 0, 3, 2 + i) for i in range(40)]
    symbols = spark.createDataFrame([(i, n, n, "function", p, at, a, b, "public", s) for i, n, p, at, a, b, s in rows], "node_id string, name string, qualified_name string, kind string, file_path string, line long, body_start long, body_end long, visibility string, seq long")
    calls = spark.createDataFrame([("m", 1, 0, "f", 0)], "file_path string, line long, col_no long, callee_name string, seq long")
    conds = spark.createDataFrame([], "file_path string, line long, end_line long, kind string, branches long, seq long")
    code = exact.Code(symbols, calls, conds)
    assert "targets" not in code.bodies.columns
    few = exact.downstream(code, "m:0:main", exact.Options(5, 10))
    assert list(few.nodes) == ["m:0:main", *[f"i{i}:0:f" for i in range(9)]] and few.cap_hit and max(len(r["targets"]) for r in code._rows["m:0:main"]) == 11
    whole = exact.downstream(code, "m:0:main", exact.Options(5, 500))
    assert list(whole.nodes) == ["m:0:main", *[f"i{i}:0:f" for i in range(40)]] and not whole.cap_hit


def test_enclosing_leaves_rows_where_the_join_dealt_them(spark):
    points = spark.createDataFrame([("f", i, 0, "x") for i in range(200)], "file_path string, line long, col_no long, callee_name string")
    bodies = spark.createDataFrame([(f"n{i}", "f", 10 * i, 10 * i + 12, i) for i in range(20)], "node_id string, file_path string, body_start long, body_end long, seq long").hint("merge")
    got = C.enclosing(points, bodies, points.columns, "first")
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # the join's two sides
    assert {(r["line"], r["sym_node_id"]) for r in got.collect()} == {(i, f"n{max(0, -(-(i - 12) // 10))}") for i in range(200)}


def test_enclosing_sorts_no_points(spark):
    points = spark.createDataFrame([("f", i, 0, "x") for i in range(200)] + [("f", None, 0, "x"), ("g", 5, 0, "x")], "file_path string, line long, col_no long, callee_name string")
    bodies = spark.createDataFrame([(f"n{i}", "a", "f", 10 * i, 10 * i + 12, i) for i in range(20)] + [("all", "b", "f", 0, 300, 99), ("same", "a", "f", 0, 12, 50), ("bad", "a", "f", 9, 3, 0)], "node_id string, name string, file_path string, body_start long, body_end long, seq long").hint("merge")
    for mode, want in (("smallest", lambda i: f"n{max(0, -(-(i - 12) // 10))}"), ("first", lambda i: f"n{max(0, -(-(i - 12) // 10))}")):
        got = C.enclosing(points, bodies, points.columns, mode)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Sort " not in plan and "Window" not in plan
        assert sorted((r["line"], r["sym_node_id"], r["sym_name"]) for r in got.collect()) == [(i, want(i), "a") for i in range(200)]


def test_edges_with_repeats_are_shuffled_once(spark):
    calls = spark.createDataFrame([("f", i, i % 3, "g") for i in range(20)], "file_path string, line long, col_no long, callee_name string")
    symbols = spark.createDataFrame([("g", "f", "f:0:g", 0, 9, 0), ("h", "f", "f:10:h", 10, 19, 1)], "name string, file_path string, node_id string, body_start long, body_end long, seq long")
    every = C.call_edges(calls, symbols, repeats=True)
    assert every.count() == 20 and sorted(map(tuple, every.distinct().collect())) == sorted(map(tuple, C.call_edges(calls, symbols).collect())) == [("f:0:g", "f:0:g"), ("f:10:h", "f:0:g")]
    assert every._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # the bodies' and the points' bins


def test_import_sources_meet_paths_once(spark):
    symbols = spark.createDataFrame([("m", f"src/a{i}.ts", f"n{i}", 10 - i) for i in range(4)] + [("other", "src/z.ts", "z", 0)], "name string, file_path string, node_id string, seq long")
    calls = spark.createDataFrame([("src/q.ts", "obj.m"), ("src/r.ts", "obj.m"), ("src/q.ts", "obj.m"), ("src/z.ts", None)], "file_path string, callee_name string")
    imports = spark.createDataFrame([("src/q.ts", "./a1"), ("src/q.ts", "./a3"), ("src/q.ts", None), ("src/r.ts", "react")], "file_path string, source string")
    found = C.resolve_calls(calls, symbols, imports)
    assert sorted((r["file_path"], r["target"]) for r in found.collect()) == [("src/q.ts", "n3"), ("src/q.ts", "n3"), ("src/r.ts", None), ("src/z.ts", None)]
    assert "exists(" not in found._jdf.queryExecution().optimizedPlan().toString()  # no caller is tried against every path


def test_upstream_prepares_no_bodies(spark):
    symbols = spark.createDataFrame([("a", "a", "function", "f", 0, 0, 5, "default", "f:0:a", 0), ("b", "b", "function", "f", 10, 10, 15, "default", "f:10:b", 1)], "name string, qualified_name string, kind string, file_path string, line long, body_start long, body_end long, visibility string, node_id string, seq long")
    calls = spark.createDataFrame([("f", 12, 0, "a", 0)], "file_path string, line long, col_no long, callee_name string, seq long")
    conds = spark.createDataFrame([], "file_path string, line long, end_line long, kind string, branches long, seq long")
    code = exact.Code(symbols, calls, conds)
    assert list(exact.upstream(code, "f:0:a").nodes) == ["f:0:a", "f:10:b"] and "bodies" not in code.__dict__
    down = exact.downstream(code, "f:10:b")
    assert [(e.source, e.target) for e in down.edges] == [("f:10:b", "f:0:a")] and all("/stored-" in f for f in code.bodies.inputFiles())


def test_upstream_fetches_no_more_callers_than_nodes(spark, monkeypatch):
    # 40 callers of a, each called by 30 others and by itself
    symbols = [symbol("a", 0, 5)] + [symbol(f"c{i}", 10 * i + 10, 10 * i + 15) for i in range(70)]
    calls = [(f"c{j}", 10 * i + 11) for i in range(40, 70) for j in range(40)] + [(f"c{i}", 10 * i + 11) for i in range(40)] + [("a", 10 * i + 12) for i in range(40)]
    asked = []
    monkeypatch.setattr(exact.Code, "learn", lambda self, ids, own=exact.Code.learn: asked.append(len(ids)) or own(self, ids))
    up = exact.upstream(code(spark, symbols, calls), ids("a", 0), exact.Options(max_nodes=6))
    assert [n.name for n in up.nodes.values()] == ["a", "c0", "c40", "c41", "c42", "c43"] and up.cap_hit and up.truncated
    assert [(e.source.rsplit(":", 1)[1], e.target.rsplit(":", 1)[1]) for e in up.edges] == [("c0", "a"), *[(f"c{i}", "c0") for i in range(40, 44)]]
    assert up.nodes[ids("c0", 10)].line == 10 and max(asked) <= 7


def test_sweeps_send_numbers_and_give_the_plain_answer(spark):
    ids = [f"n{(i * 37) % 60}" for i in range(60)]
    links = {tuple(sorted((f"n{i}", f"n{(i * i + j) % 23}"))) for i in range(50) for j in range(3)}
    links = sorted(p for p in links if p[0] != p[1])
    nodes, pairs = spark.createDataFrame([(n, i) for i, n in enumerate(ids)], "node_id string, seq long"), spark.createDataFrame(links, "a string, b string")
    names, both, label, parts = communities._numbered(nodes, pairs)
    assert {f.dataType.simpleString() for f in both.schema.fields} <= {"bigint", "int"} and both.count() == 2 * len(links)
    own, near = {n: n for n in ids}, {n: [] for n in ids}
    for a, b in links:
        near[a].append(b)
        near[b].append(a)
    for _ in range(2):
        votes = {n: [own[m] for m in near[n]] for n in ids}
        own = {n: min(set(v), key=lambda c, v=v: (-v.count(c), c)) if v else own[n] for n, v in votes.items()}
    assert dict(map(tuple, communities.propagate(nodes, pairs, 2).collect())) == own


def test_moving_gives_the_plain_answer_and_plans_do_not_grow(spark, monkeypatch):
    links = sorted({tuple(sorted((f"n{i:02}", f"n{(i * i + 7 * j) % 41:02}"))) for i in range(41) for j in range(3)} - {(f"n{i:02}", f"n{i:02}") for i in range(41)})
    nodes, pairs = spark.createDataFrame([(f"n{i:02}", i) for i in range(42)], "node_id string, seq long"), spark.createDataFrame(links, "a string, b string")
    sizes = []
    bits = lambda df: int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length()
    monkeypatch.setattr(communities, "_heard", lambda both, label, own=communities._heard: sizes.append(bits(label)) or own(both, label))
    got = dict(map(tuple, communities.move(nodes, pairs, 5).collect()))
    turn = {r["node_id"]: r["turn"] for r in communities._numbered(nodes, pairs)[0].collect()}
    near = {n: [b if a == n else a for a, b in links if n in (a, b)] for n in sorted(turn)}
    home, double, quiet = {n: n for n in near}, 2.0 * len(links), 0
    for i in range(2 * 5):
        weight = {c: sum(len(near[n]) for n in near if home[n] == c) for c in home.values()}

        def key(n, c, home=home, weight=weight):
            rest = weight[c] - (len(near[n]) if c == home[n] else 0)
            return (-(sum(home[m] == c for m in near[n]) / double - 2.0 * rest * len(near[n]) / double**2), c != home[n], c)

        new = {n: min({home[n], *(home[m] for m in near[n])}, key=lambda c, n=n: key(n, c)) if turn[n] == i % 2 else home[n] for n in near}
        quiet, home = (quiet + 1 if new == home else 0), new
        if quiet == 2:
            break
    assert got == {f"n{i:02}": home.get(f"n{i:02}", f"n{i:02}") for i in range(42)}
    assert len(sizes) == i + 1 and max(sizes) <= 64 and len(sizes) > 4


def test_dealt_rows_stay_where_they_lie(spark):
    edges = G.dealt(spark.createDataFrame([("a", "b"), ("b", "c")], "source_id string, target_id string").repartition(8, "source_id").distinct())
    plan = edges.groupBy("source_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_resolving_reads_calls_for_the_last_join_alone(spark, tmp_path, monkeypatch):
    symbols = spark.createDataFrame([("m", f"src/a{i}.ts", f"n{i}", 10 - i) for i in range(4)] + [("other", "src/z.ts", "z", 0)], "name string, file_path string, node_id string, seq long")
    imports = spark.createDataFrame([("src/q.ts", "./a1")], "file_path string, source string")
    spark.createDataFrame([("src/q.ts", "obj.m"), ("src/z.ts", "other"), ("src/q.ts", "obj.m"), ("src/z.ts", "none"), ("src/z.ts", None)], "file_path string, callee_name string").write.parquet(str(tmp_path / "calls"))
    calls = spark.read.parquet(str(tmp_path / "calls"))
    for few in (C.FEW_TEXTS, 0):
        monkeypatch.setattr(C, "FEW_TEXTS", few)
        found = C.resolve_calls(calls, symbols, imports)
        assert sorted((r["callee_name"] or "", r["target"]) for r in found.collect()) == [("", None), ("none", None), ("obj.m", "n1"), ("obj.m", "n1"), ("other", "z")]
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [file_path") == 1
