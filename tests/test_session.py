"""A project of real files: labels, data flow by calls, churn by node, whole answers, prompts, paths."""

import json

import pytest

from callweave.functions import render
from callweave.operators import exact
from callweave.session import Project, rendered
from callweave.streaming.service import Service

FILES = {
    "src/app.ts": """import { load } from "./store/db";
export function main(id) {
  if (id > 0) {
    load(id);
  } else {
    report(id);
  }
}
function report(id) {
  switch (id) {
    case 1: saveAll(id); break;
    default: unknownThing(id);
  }
}
""",
    "src/store/db.ts": """export function load(id) {
  return report(id);
}
export function saveAll(id) {
  return other.query(id);
}
export function alone() {
}
""",
}


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return Project.open(spark, str(root))


def test_conditionals_carry_their_text(project):
    g = project.graph(project.entry("main"))
    shown = {n.name: n for n in g.nodes.values() if n.kind == "conditional"}
    assert set(shown) == {"if (id > 0)", "switch (id)"}
    n = shown["if (id > 0)"]
    assert (n.qualified_name, n.line, n.column, n.signature) == ("main.if (id > 0)", 2, 2, "id > 0") and n.id.endswith(":2:if")
    assert "if (id > 0)" in rendered(g, "text") and "if (id &gt; 0)" in rendered(g, "mermaid")
    names = {n.id: n.name for n in g.nodes.values()}
    routed = {(names[e.source], names[e.target]) for e in g.edges}
    assert {("main", "if (id > 0)"), ("if (id > 0)", "load"), ("if (id > 0)", "report"), ("switch (id)", "saveAll"), ("load", "report")} <= routed


def test_data_flow_asks_for_calls(project):
    found = project.overlay("dataflow", project.entry("main"), variable="id")
    paths = {tuple(x.rsplit(":", 1)[1] for x in r["nodes"]) for r in found["paths"].collect()}
    # from main into its conditional there is no call of that name, so nothing is passed on through it
    assert paths == set()
    g = project.graph(project.entry("main"), options=exact.Options(conditionals=False))
    flow, sinks = exact.data_flow(g, g.entry, "id", exact.calls_in(g, project.index.calls), lambda n, q: "database_query" if "query" in n else None)
    last = {tuple(x.rsplit(":", 1)[1] for x in p) for p in flow}
    assert ("main", "load", "report", "saveAll", "other.query") in last and {k for _, k, _ in sinks} == {"database_query"}
    calls = exact.calls_in(g, project.index.calls)
    calls[next(f for f in calls if f.endswith("app.ts"))] = []  # a file whose calls name none of the targets
    assert exact.data_flow(g, g.entry, "id", calls, lambda n, q: None)[0] == []


def test_churn_by_node(spark, project):
    commits = spark.sql("SELECT '1' AS commit_id, current_timestamp() AS author_ts, 'src/app.ts' AS file_path, 'A' AS status")
    rows = project.overlay("temporal", project.entry("load"), commits=commits).collect()
    by = {r["node_id"].rsplit(":", 1)[1]: (r["churn"], r["recently_added"], r["last_modified"] is not None) for r in rows}
    assert by["report"] == (1, True, True) and by["load"] == (0, False, True) and "alone" not in by


def test_answers_are_whole_unless_a_limit_is_asked(project):
    s = Service(project)
    whole = s.handle({"id": "1", "type": "search_condition", "payload": {"condition": "report"}})["payload"]
    assert len(whole["direct"]) == 3 and "truncated" not in whole
    cut = s.handle({"id": "2", "type": "search_condition", "payload": {"condition": "report", "limit": 1}})["payload"]
    assert len(cut["direct"]) == 1 and "direct" in cut["truncated"]
    assert len(s.handle({"id": "3", "type": "overlay", "payload": {"overlay": "complexity"}})["payload"]) == 5
    some = s.handle({"id": "4", "type": "overlay", "payload": {"overlay": "complexity", "limit": 2}})["payload"]
    assert len(some["rows"]) == 2 and some["truncated"] == ["rows"]


def test_paths_and_prompts(project):
    main, save = project.entry("main"), project.entry("saveAll")
    assert [x.rsplit(":", 1)[1] for x in project.path(main, save)] in (["main", "if", "report", "switch", "saveAll"], ["main", "if", "load", "report", "switch", "saveAll"])
    g = project.graph(main)
    said = render.context(g, next(n.id for n in g.nodes.values() if n.name == "report"))
    assert "Function: report" in said and "load (" in said and "Calls:" in said
    assert json.loads(rendered(g, "json"))["nodes"]
