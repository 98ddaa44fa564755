"""Viewer states and lists, cursor lookup, the growing index, distributed communities, histories."""

import hashlib
import re
import subprocess

import pytest
from pyspark.sql import functions as F

from callweave.functions import viewer as V
from callweave.operators import communities, overlays
from callweave.sources import cursor, lazy
from callweave.sources import readers as R
from callweave.sources.index import Index, path_ranks

NODE = "node_id string, name string, qualified_name string, file_path string, line long, kind string"


@pytest.fixture(scope="module")
def view(spark):
    rows = [("f", "function"), ("c1", "conditional"), ("c2", "conditional"), ("c3", "conditional"), ("c4", "conditional"), ("u", "unresolved"), ("g", "function")]
    nodes = spark.createDataFrame([(f"a.ts:{i}:{n}", n, f"X.{n}", "a.ts", i, k) for i, (n, k) in enumerate(rows)], NODE)
    at = {n: f"a.ts:{i}:{n}" for i, (n, _) in enumerate(rows)}
    # c1 leads to c2, which leads to the library only; c3 leads to both; c4 leads nowhere
    pairs = [("f", "c1"), ("c1", "c2"), ("c2", "u"), ("c3", "u"), ("c3", "g"), ("f", "c3"), ("f", "c4"), ("c2", "gone"), ("f", "f"), ("f", "c1")]
    edges = spark.createDataFrame([(at.get(a, a), at.get(b, b), "call" if i % 2 else "callback", i) for i, (a, b) in enumerate(pairs)], "source_id string, target_id string, kind string, seq long")
    return nodes, edges, at


def test_cascade_and_states(view):
    nodes, edges, at = view
    got = {r["node_id"]: r["state"] for r in V.states(nodes, edges, F.col("kind") == "function", F.col("name") != "g", True).collect()}
    assert got == {at["f"]: "highlighted", at["c1"]: "hidden", at["c2"]: "hidden", at["c3"]: "dimmed", at["c4"]: "dimmed", at["u"]: "hidden", at["g"]: "dimmed"}
    open_ = {r["node_id"]: r["state"] for r in V.states(nodes, edges, F.lit(True), F.lit(True), False).collect()}
    assert set(open_.values()) == {"highlighted"}


def test_viewer_edges(view):
    nodes, edges, at = view
    got = {(r["source_id"], r["target_id"]): r["kind"] for r in V.viewer_edges(edges, nodes).collect()}
    assert (at["f"], at["f"]) not in got and len(got) == 7 and got[at["f"], at["c1"]] == "callback"


def test_list_view(view):
    nodes, edges, at = view
    names = lambda **k: {r["name"] for r in V.list_view(nodes, edges, **k).collect()}
    assert names(hide_library=True) == {"f", "c3", "c4", "g"}
    assert names(query="X.C") == {"c1", "c2", "c3", "c4"} and names(query="unres") == {"u"}
    assert names(path=[at["f"], "other.ts:9:g"]) == {"f", "g"}
    assert names(keep=F.col("kind") == "function") == {"f", "g"}


def test_classes_and_labels(spark, view):
    nodes, _, at = view
    ids = lambda *n: spark.createDataFrame([(at.get(x, x),) for x in n], "node_id string")
    got = {r["node_id"]: r["classes"] for r in V.overlay_classes(nodes, ids("f", "none"), ids("g"), ids("g", "f"), ids("u"), ids("u")).collect()}
    assert got == {at["f"]: ["dead-code", "impact-blast-radius"], at["g"]: ["impact-modified"], at["u"]: ["dataflow-path", "dataflow-sink"]}
    one = spark.range(1).select(V.label(F.lit("loop"), F.lit("x")).alias("a"), V.label(F.lit("other"), F.lit("x"), F.lit(3)).alias("b"), V.boundary(F.lit("cluster-13")).alias("c"), V.boundary(F.lit("none")).alias("d"), V.project_key(F.lit("/p")).alias("e")).first()
    assert tuple(one) == ("↻ x", " x [+3]", "boundary-1", None, hashlib.sha256(b"/p").hexdigest()[:12])


LINES = ["export async function alpha(a) {", "  if (x) {", "  while(y) {", "}", "const beta = (a) => {", "  x = 1", "class K {", "  private static gamma(a) {", "  return(1)", "def delta(a):", "pub async fn eps<T>(a)", "func (r *Repo) zeta(a) {", "  public int eta(int a) {", *["x"] * 25]


def test_cursor(spark):
    lines = spark.createDataFrame([("a", i, t) for i, t in enumerate(LINES)], "file_path string, line long, text string")
    asked = spark.createDataFrame([("a", i) for i in range(len(LINES))] + [("b", 3)], "file_path string, line long")

    def declared(text):
        for p in cursor.DECLARATIONS:
            m = re.search(p, text, re.A)
            if m and m[1] not in cursor.NO_NAMES:
                return m[1]

    got = {(r["file_path"], r["line"]): r["name"] for r in cursor.function_at(lines, asked).collect()}
    for i in range(len(LINES)):
        assert got["a", i] == next((n for t in LINES[i::-1] if (n := declared(t))), None), LINES[i]
    assert got["b", 3] is None and got["a", 3] == "alpha" and got["a", 8] == "gamma"

    def near(i):
        for k in range(21):
            if i - k < 0:
                return None
            for p in cursor.CARET_DECLARATIONS:
                if m := re.search(p, LINES[i - k], re.A):
                    return m[1], i - k + 1, m.start() + 1

    found = {r["line"]: r for r in cursor.function_near(lines, asked.where("file_path = 'a'")).collect()}
    for i in range(len(LINES)):
        r, want = found[i], near(i)
        assert (None if r["name"] is None else (r["name"], r["found_line"], r["found_column"])) == want, LINES[i]
    assert found[len(LINES) - 1]["name"] is None


@pytest.fixture(scope="module")
def sources(spark):
    text = {"/p/a.ts": 'import { b } from "./b";\nimport * as all from "./sub";\nexport function a() {\n  b();\n}\n', "/p/b.ts": "export function b() {\n  return 1;\n}\n", "/p/sub/index.ts": "export function deep() {\n  return 2;\n}\n", "/p/z.ts": "export function z() {\n  return 3;\n}\n"}
    return spark.createDataFrame([(p, "typescript", t, hashlib.sha256(t.encode()).hexdigest()) for p, t in text.items()], "file_path string, language_id string, content string, sha256 string")


def test_lazy_index(sources):
    x = lazy.LazyIndex(sources)
    assert x.parse_count == 0 and x.total_files() == 4
    x.ensure_file("\\p\\a.ts")
    x.ensure_file("/p/a.ts")
    assert x.parsed == {"/p/a.ts"} and x.has("a") and not x.has("b")
    x.ensure_import("nothing", "/p/a.ts")
    assert x.parsed == {"/p/a.ts"}
    x.ensure_import("b", "/p/a.ts")
    assert x.parsed == {"/p/a.ts", "/p/b.ts"} and x.has("b")
    x.ensure_symbol("console.log")
    assert x.parse_count == 2
    x.ensure_symbol("deep", batch=1)
    assert x.parsed == {"/p/a.ts", "/p/b.ts", "/p/sub/index.ts"}
    x.ensure_symbol("missing", batch=1, budget=5)
    assert x.parse_count == 4
    assert {r["name"]: len(r["definitions"]) for r in lazy.by_simple_name(x.index.symbols).collect()} == {"a": 1, "b": 1, "deep": 1, "z": 1}


def test_paths_order_symbols_and_updates_come_last(sources):
    assert [r["file_path"] for r in path_ranks(sources).orderBy("rank").collect()] == ["/p/a.ts", "/p/b.ts", "/p/sub/index.ts", "/p/z.ts"]
    index = Index.build(sources)
    order = lambda i: [r["name"] for r in i.symbols.orderBy("seq").collect()]
    assert order(index) == ["a", "b", "deep", "z"]
    assert order(index.update(Index.build(sources.where("file_path = '/p/b.ts'")))) == ["a", "deep", "z", "b"]


def test_distributed_communities_agree_on_clear_ones(spark):
    groups = ["abcde", "fghij", "klmno"]
    pairs = [(x, y) for g in groups for x in g for y in g if x < y] + [("e", "f"), ("j", "k")]
    nodes = spark.createDataFrame([(x, i) for i, x in enumerate("zabcdefghijklmno")], "node_id string, seq long")
    frame = spark.createDataFrame(pairs, "a string, b string")
    for method in ("louvain", "labels"):
        for most in (0, 1000):
            got = {r["node_id"]: r["cluster"] for r in communities.detect(nodes, frame, method, most).collect()}
            assert [len({got[x] for x in g}) for g in groups] == [1, 1, 1] and got["z"] == 0
            if method == "louvain" and most:
                assert [got[g[0]] for g in groups] == [1, 2, 3]


def test_paths_meet_at_their_ends(spark):
    nodes = spark.createDataFrame([("src/a/index.ts", 5), ("src/b/index.ts", 5), ("/abs/c.ts", 5)], "file_path string, line long")
    reported = spark.createDataFrame([("/build/src/a/index.ts", 1), ("b\\index.ts", 2), ("c.ts", 3), ("index.ts", 4)], "file_path string, seq long")
    assert {tuple(r) for r in overlays.match_paths(nodes, reported).collect()} == {("src/a/index.ts", "/build/src/a/index.ts"), ("src/b/index.ts", "b\\index.ts"), ("/abs/c.ts", "c.ts")}
    hunks = spark.createDataFrame([("b/index.ts", 1, 9), ("c.ts", 7, 9)], "file_path string, start_line long, end_line long")
    assert [r["file_path"] for r in overlays.modified_nodes(nodes, hunks).collect()] == ["src/b/index.ts"]


def test_histories_follow_renames(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    git("init", "-q")
    body = "".join(f"line {i}\n" for i in range(30))
    for i, (name, text) in enumerate([("old.ts", body), ("old.ts", body + "more\n")]):
        (tmp_path / name).write_text(text)
        git("add", "-A")
        git("commit", "-qm", str(i))
    git("mv", "old.ts", "new.ts")
    git("commit", "-qm", "moved")
    commits = R.git_commits(spark, str(tmp_path))
    assert {(r["file_path"], r["status"]) for r in commits.collect()} == {("new.ts", "A"), ("new.ts", "M"), ("new.ts", "R")}
    nodes = spark.createDataFrame([("n", f"{tmp_path}/new.ts"), ("m", f"{tmp_path}/none.ts")], "node_id string, file_path string")
    got = {r["node_id"]: (r["churn"], r["recently_added"]) for r in overlays.node_churn(nodes, commits, F.current_timestamp()).collect()}
    assert got == {"n": (3, True), "m": (0, False)}
    (tmp_path / "new.ts").write_text("first\n" + body)
    assert {r["file_path"] for r in R.git_diff(spark, str(tmp_path)).collect()} == {"new.ts"}
    with pytest.warns(UserWarning):
        assert R.git_commits(spark, str(tmp_path / "nowhere")).count() == 0
