"""Scanner, index, readers, configuration, service and stream."""

import json
import time

import pytest

from callweave.operators import overlays as O
from callweave.session import Project
from callweave.sources import index as I
from callweave.sources import readers as R
from callweave.sources import scan as S
from callweave.streaming import service as V

TS = """import { a, b as c } from './x';
const z = require('zed');
export class Foo {
  constructor(x: number) { this.init(); }
  get size(): number { return this.n; }
  private run(a: string): void {
    if (a === "x) {") { this.go(a); } else if (b()) { c(); } else { d(); }
    switch (a) { case 'a': e(); break; default: f(); }
    const t = a ? g(1) : h(2);
  }
}
export function top(a) {
  return outer(inner(a));
}
const arrow = (x) => { top(x); };
"""


def kinds(found):
    return [(x["kind"], x["qualified_name"], x["body_start"], x["body_end"], x["visibility"]) for x in found.symbols]


def test_typescript():
    f = S.scan("a.ts", TS, "typescript")
    assert kinds(f) == [("class", "Foo", 2, 10, "public"), ("constructor", "Foo.constructor", 3, 3, "default"), ("getter", "Foo.size", 4, 4, "default"), ("method", "Foo.run", 5, 9, "private"), ("function", "top", 11, 13, "public"), ("function", "arrow", 14, 14, "default")]
    assert [c["callee_name"] for c in f.calls] == ["require", "init", "go", "b", "c", "d", "e", "f", "g", "h", "outer", "inner", "top"]
    assert [(c["kind"], c["line"], c["branches"]) for c in f.conditionals] == [("if", 6, 2), ("switch", 7, 2), ("ternary", 8, 2)]
    assert S.imports("a.ts", TS, "typescript") == [{"source": "./x", "specifiers": ["a", "c"], "file_path": "a.ts"}, {"source": "zed", "specifiers": ["z"], "file_path": "a.ts"}]


@pytest.mark.parametrize(
    ("lang", "text", "symbols", "calls", "conds"),
    [
        ("java", "public class A {\n  public A() { init(); }\n  private int f(int a) { if (a > 0) return g(a); else return obj.h(a); }\n}\n", [("class", "A", 0, 3, "public"), ("constructor", "A.A", 1, 1, "public"), ("method", "A.f", 2, 2, "private")], ["init", "g", "obj.h"], [("if", 2)]),
        ("rust", 'pub struct P;\nimpl P {\n  pub fn go(&self) { match self.x { 1 => a(), _ => { b() } } println!("x(") }\n}\n', [("class", "P", 0, 0, "public"), ("class", "P", 1, 3, "default"), ("function", "P.go", 2, 2, "public")], ["a", "b"], [("match", 2)]),
        ("go", "package m\nfunc Foo(x int) int {\n  if x > 0 { fmt.Println(x) }\n  return 1\n}\nfunc (s *S) run() { s.go2() }\n", [("function", "Foo", 1, 4, "public"), ("method", "run", 5, 5, "default")], ["fmt.Println", "s.go2"], [("if", 1)]),
        ("csharp", "public class C {\n  public int F(int a) { return a > 0 ? G(a) : H(); }\n}\n", [("class", "C", 0, 2, "public"), ("method", "C.F", 1, 1, "public")], ["G", "H"], [("ternary", 2)]),
        ("python", "class K:\n    def _m(self):\n        if x:\n            f()\n        elif y:\n            self.g(h())\n", [("class", "K", 0, 5, "public"), ("method", "K._m", 1, 5, "protected")], ["f", "self.g", "h"], [("if", 2)]),
        ("javascript", "function a() { return x.map(function (q) { return b(q); }); }\n", [("function", "a", 0, 0, "default"), ("function", "<anonymous>", 0, 0, "default")], ["x.map", "b"], []),
    ],
)
def test_languages(lang, text, symbols, calls, conds):
    f = S.scan("f", text, lang)
    assert kinds(f) == symbols and [c["callee_name"] for c in f.calls] == calls and [(c["kind"], c["branches"]) for c in f.conditionals] == conds and not f.errors


def test_scan_errors():
    assert S.scan("a.py", "def (", "python").errors and S.scan("a.ts", "function f( {", "typescript").errors and S.scan("a", "", "cobol").errors
    assert S.scan("a.ts", "", "typescript") == S.Found()


def test_imports_of_other_languages():
    get = lambda lang, text: [(i["source"], i["specifiers"]) for i in S.imports("f", text, lang)]
    assert get("python", "import os, sys as s\nfrom a import b as c, *") == [("os", ["os"]), ("sys", ["sys"]), ("a", ["c"])]
    assert get("java", "import static a.b.C;\n") == [("a.b.C", ["C"])]
    assert get("rust", "use a::{b, c as d};\nuse x::Y;\n") == [("a", ["b", "c as d"]), ("x::Y", ["Y"])]
    assert get("go", 'import "fmt"\nimport (\n  m "a/b"\n)\n"c"\n') == [("fmt", ["fmt"]), ("a/b", ["b"])]
    assert get("csharp", "using System.IO;\nusing X = Y;\n") == [("System.IO", ["IO"])]
    assert S.quoted("x `a` 'b' \"c\"") == "c"


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("proj")
    (root / "src").mkdir()
    (root / "node_modules").mkdir()
    (root / "src/a.ts").write_text("import { help } from './b';\nexport function main() {\n  help();\n  lost();\n}\n")
    (root / "src/b.ts").write_text("export function help() {\n  return deep();\n}\nfunction deep() {\n  return 1;\n}\nfunction unused() {\n  return 2;\n}\n")
    (root / "node_modules/c.ts").write_text("function no() {}\n")
    (root / "src/bad.py").write_bytes(b"\xff\xfe\xfa")
    return Project.open(spark, str(root))


def test_project(spark, project):
    entry = project.entry("src/a.ts:main")
    g = project.graph(entry)
    assert [n.name for n in g.nodes.values()] == ["main", "help", "deep", "lost"] and g.nodes[next(i for i in g.nodes if "lost" in i)].unresolved
    assert {r["name"] for r in project.overlay("deadcode").collect()} == {"unused"}
    assert project.index.errors.count() == 1
    assert project.path(entry, project.entry("deep"))[0] == entry
    found = I.resolve_imports(project.index.imports.select("file_path", "source"), project.index.files).first()
    assert found["resolved_path"].endswith("/src/b.ts")
    t = project.trace("help")
    assert t["direct"].count() == 2 and t["paths"].count() > 0
    assert project.overlay("impact", diff="+++ b/src/b.ts\n@@ -1 +3,2 @@\n")["radius"].count() >= 1


def test_index_update_and_save(spark, project, tmp_path):
    new = spark.createDataFrame([(project.index.files.where("file_path LIKE '%b.ts'").first()["file_path"], "typescript", "function fresh() {\n}\n", "x")], "file_path string, language_id string, content string, sha256 string")
    assert project.index.changed(new).count() == 1
    updated = project.index.update(I.Index.build(new))
    assert {r["name"] for r in updated.symbols.collect()} == {"main", "fresh"}
    updated.save(f"file://{tmp_path}/i")
    again = I.Index.load(spark, f"file://{tmp_path}/i")
    assert again.symbols.count() == 2 and I.Index.load(spark, f"file://{tmp_path}/none") is None


def test_service(project, tmp_path):
    s = V.Service(project)
    got = s.answer(["", "{", '{"id": "1"}', json.dumps({"id": "2", "type": "analyze", "payload": {"entryPoint": "main"}}), json.dumps({"id": "3", "type": "nope"}), json.dumps({"id": "4", "type": "analyze", "payload": {"entryPoint": "zzz"}}), json.dumps({"id": "5", "type": "file_changed", "payload": {"filePath": "x"}})])
    assert [(r["id"], r["type"], (r["payload"] or {}).get("code")) for r in got] == [("", "error", "PARSE_ERROR"), ("1", "error", "INVALID_REQUEST"), ("2", "result", None), ("3", "error", "UNKNOWN_TYPE"), ("4", "error", "SYMBOL_NOT_FOUND"), ("5", "result", None)]
    assert s.handle({"id": "6", "type": "annotate_add", "payload": {"id": "n", "nodeId": "x", "text": "t"}})["type"] == "result" and s.annotations.count() == 1
    assert s.handle({"id": "7", "type": "annotate_remove", "payload": {"id": "n"}})["type"] == "result" and s.annotations.count() == 0
    assert s.handle({"id": "8", "type": "overlay", "payload": {"overlay": "complexity"}})["payload"]
    assert s.handle({"id": "9", "type": "analyze_nl", "payload": {"description": "the main"}})["type"] in ("result", "candidates")


def test_streams(spark, project, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/r.txt").write_text(json.dumps({"id": "1", "type": "file_changed", "payload": {}}) + "\n")
    V.serve(V.Service(project), f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/c1").awaitTermination()
    assert json.loads(spark.read.text(f"file://{tmp_path}/out/batch-0").first()[0])["id"] == "1"
    rows = spark.createDataFrame([("/p/a.ts", "typescript", "function f() {\n}\n", "1")], "file_path string, language_id string, content string, sha256 string")
    rows.write.parquet(f"file://{tmp_path}/ch")
    V.follow(spark, spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/ch"), f"file://{tmp_path}/ix", f"file://{tmp_path}/c2").awaitTermination()
    assert V.current(spark, f"file://{tmp_path}/ix").symbols.first()["name"] == "f"


def test_coverage_readers(spark, tmp_path):
    (tmp_path / "l.info").write_text("TN:\nSF:a.ts\nDA:1,2\nDA:1,0\nDA:2,1\nend_of_record\nSF:b.ts\nDA:5,1\n")
    rows = lambda p: sorted((r["file_path"], r["line"], r["hits"]) for r in R.coverage(spark, f"file://{p}").collect())
    assert rows(tmp_path / "l.info") == [("a.ts", 1, 0), ("a.ts", 2, 1), ("b.ts", 5, 1)]
    at = lambda a, b: {"start": {"line": a, "column": 0}, "end": {"line": b, "column": 1}}
    (tmp_path / "i.json").write_text(json.dumps({"a.ts": {"statementMap": {"0": at(1, 3), "1": at(2, 2)}, "s": {"0": 1, "1": 4}}}))
    assert rows(tmp_path / "i.json") == [("a.ts", 1, 1), ("a.ts", 2, 4), ("a.ts", 3, 1)]
    (tmp_path / "j.xml").write_text('<?xml version="1.0"?><report name="r"><package name="p"><sourcefile name="A.java"><line nr="3" mi="0" ci="2"/><line nr="4" mi="1" ci="0"/><line nr="5" mi="0" ci="0"/></sourcefile></package><package name="q"><sourcefile name="B.java"><line nr="1" mi="0" ci="1"/></sourcefile></package></report>')
    assert rows(tmp_path / "j.xml") == [("p/A.java", 3, 1), ("p/A.java", 4, 0), ("q/B.java", 1, 1)]
    (tmp_path / "x.txt").write_text("hello")
    with pytest.raises(ValueError, match="lcov"):
        R.coverage(spark, f"file://{tmp_path}/x.txt")


def test_diff_annotations_config(spark, tmp_path):
    hunks = R.diff_text(spark, "+++ b/a.ts\n@@ -1,2 +3,4 @@\n+x\n@@ -9 +11 @@\n@@ -1,2 +5,0 @@\n+++ /dev/null\n@@ -1 +1 @@\n")
    assert sorted(map(tuple, hunks.collect())) == [("a.ts", 3, 6), ("a.ts", 11, 11)]
    rows = spark.createDataFrame([("1", "n", "t", "me", "2024")], "id string, node_id string, text string, author string, timestamp string")
    R.write_annotations(rows, str(tmp_path / "s/a.json"))
    assert R.annotations(spark, f"file://{tmp_path}/s/a.json").collect() == rows.collect()
    assert R.annotations(spark, f"file://{tmp_path}/none.json").count() == 0
    (tmp_path / "bad.json").write_text("{}")
    assert R.annotations(spark, f"file://{tmp_path}/bad.json").count() == 0
    (tmp_path / R.CONFIG_FILE).write_text('{"include": ["**/*.py"], "timeoutSeconds": "x", "defaultDepth": 5}')
    c = R.Config.load(str(tmp_path), {"defaultFormat": "text", "defaultDepth": -1})
    assert (c.include, c.timeout_seconds, c.default_depth, c.default_format) == (["**/*.py"], 60, 5, "text")


def test_line_offset_mode(spark):
    s = spark.createDataFrame([("f", "function", "a.ts", 4, "a.ts:4:f")], "name string, kind string, file_path string, line long, node_id string")
    hunk = spark.createDataFrame([("/r/a.ts", 5, 5)], "file_path string, start_line long, end_line long")
    assert O.modified_nodes(s, hunk).count() == 0 and O.modified_nodes(s, hunk, compat=False).count() == 1


@pytest.mark.parametrize("lang, line", [("python", "def fn{0}(a):\n    if a > 1:\n        fn{0}(a)\n"), ("rust", "fn fn{0}(a: i32) {{\n  match a {{\n    1 => fn{0}(a),\n    _ => obj.fn{0}(a),\n  }}\n}}\n"), ("typescript", "const fn{0} = (a) => a > 1 ? fn{0}(a) : a\n")])
def test_a_scan_costs_what_the_file_is_long(lang, line):
    began = time.perf_counter()
    found = S.scan("a", "".join(line.format(i) for i in range(2000)), lang)
    assert len(found.symbols) == len(found.conditionals) == 2000 and time.perf_counter() - began < 15
