"""Reports of many blocks, and histories in ranges of commits."""

import json
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from callweave.sources import history as H
from callweave.sources import nested
from callweave.sources import readers as R


@pytest.fixture()
def small_blocks(spark):
    """Files are read in blocks of 2 KB, so that a small report is a large one."""
    names = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def report(n=120):
    r = random.Random(4)
    at = lambda a, b: {"start": {"line": a, "column": 0}, "end": {"line": b, "column": 9}}
    out = {}
    for i in range(n):
        lines = [r.randint(1, 60) for _ in range(r.randint(0, 6))]
        name = f"src/{i}/" + r.choice(["a.ts", 'q"uo}te{.ts', "back\\slash.ts", "é}.ts", "br}{ace.ts"])
        out[name] = {"path": name, "note": r.choice(["", '}"{', "\\", '\\"}']), "statementMap": {str(k): at(x, x + r.randint(0, 3)) for k, x in enumerate(lines)}, "s": {str(k): r.randint(0, 3) for k in range(len(lines))}, "fnMap": {}, "b": {"0": [1, 0]}}
    return out


def lines_of(doc):
    best = {}
    for name, f in doc.items():
        for k, s in f["statementMap"].items():
            for x in range(s["start"]["line"], s["end"]["line"] + 1):
                best[name, x] = max(best.get((name, x), 0), f["s"].get(k, 0))
    return sorted((*k, v) for k, v in best.items())


def rows(df):
    return sorted((r["file_path"], r["line"], r["hits"]) for r in df.collect())


@pytest.mark.parametrize("indent", [None, 2])
def test_json_report_in_blocks(spark, small_blocks, tmp_path, indent):
    doc = report()
    (tmp_path / "r.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=False) + "\n")
    path = f"file://{tmp_path}/r.json"
    assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 5
    assert rows(R.coverage(spark, path)) == lines_of(doc)
    entries = nested.json_entries(spark, path).orderBy("entry").collect()
    assert len(entries) == len(doc) and list({k: v for e in entries for k, v in json.loads(e["value"]).items()}.items()) == list(doc.items())


@pytest.mark.parametrize(("text", "want"), [("{}", {}), ("", {}), ("  \n", {}), ('{"a": 1}', {"a": 1}), ('{"a": {}}', {"a": {}}), ('{"a": 1, "b": {"x": {}}, "c": [1, {"y": 2}, 3], "d": "}"}', {"a": 1, "b": {"x": {}}, "c": [1, {"y": 2}, 3], "d": "}"}), ('\n { "a" : { } , "b" : { "c" : "{" } } \n', {"a": {}, "b": {"c": "{"}})])
def test_odd_documents(spark, tmp_path, text, want):
    (tmp_path / "d.json").write_text(text)
    got = {}
    for e in nested.json_entries(spark, f"file://{tmp_path}/d.json").orderBy("entry").collect():
        got |= json.loads(e["value"])
    assert got == want


def test_xml_report_in_blocks(spark, small_blocks, tmp_path):
    r = random.Random(3)
    want, packages = {}, []
    for p in range(60):
        files = []
        for f in range(r.randint(1, 4)):
            hits = {n: r.randint(0, 2) for n in r.sample(range(1, 90), r.randint(0, 12))}
            files.append(f'<sourcefile name="F{f}.java">' + "".join(f'<line nr="{n}" mi="{2 - c}" ci="{c}" mb="0" cb="0"/>' for n, c in hits.items()) + "</sourcefile>")
            want |= {(f"p{p}/F{f}.java", n): int(c > 0) for n, c in hits.items()}
        packages.append(f'<package name="p{p}"><class name="C"/>{"".join(files)}<counter type="LINE" missed="1" covered="2"/></package>')
    text = '<?xml version="1.0"?><!DOCTYPE report PUBLIC "-//X//DTD Report 1.1//EN" "report.dtd"><report name="r"><sessioninfo id="x"/><group name="g">' + "".join(packages) + "</group></report>"
    (tmp_path / "j.xml").write_text(text)
    path = f"file://{tmp_path}/j.xml"
    read = nested.xml_elements(spark, path, "package", "_name:string")
    assert read.rdd.getNumPartitions() > 5 and len({r[0] for r in read.select(F.spark_partition_id()).distinct().collect()}) > 5
    assert rows(R.coverage(spark, path)) == sorted((*k, v) for k, v in want.items())


def test_formats_are_told_by_their_beginning(spark, tmp_path):
    (tmp_path / "a").write_text('{"x": {"other": {}}}')
    (tmp_path / "b").write_text("")
    (tmp_path / "c").write_text("SF:a.ts\nDA:1,1\n")
    for name in "ab":
        with pytest.raises(ValueError, match="Supported formats"):
            R.coverage(spark, f"file://{tmp_path}/{name}")
    assert rows(R.coverage(spark, f"file://{tmp_path}/c")) == [("a.ts", 1, 1)]


def git_in(root):
    return lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True, text=True).stdout


def test_history_in_ranges(spark, tmp_path):
    """A file renamed three times, a new file under its first name, and names with spaces and accents, in ranges of two commits."""
    git = git_in(tmp_path)
    git("init", "-q")
    body = "".join(f"line {i}\n" for i in range(40))
    steps = [("write", "a.ts", body), ("write", "other é x.ts", "own\n" * 9), ("move", "a.ts", "b.ts"), ("write", "b.ts", body + "1\n"), ("move", "b.ts", "c.ts"), ("write", "a.ts", "something else\n" * 20), ("write", "a.ts", "something else\n" * 21), ("move", "c.ts", "d.ts"), ("write", "d.ts", body + "2\n"), ("move", "a.ts", "c.ts")]
    for i, (kind, name, text) in enumerate(steps):
        if kind == "move":
            git("mv", name, text)
        else:
            (tmp_path / name).write_text(text)
        git("add", "-A")
        git("commit", "-qm", str(i))
    read = H.log(spark, str(tmp_path), each=2)
    assert read.rdd.getNumPartitions() == 5
    found = H.commits(spark, str(tmp_path), each=2).groupBy("file_path").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("status")).alias("s")).collect()
    assert {r["file_path"]: (r["n"], "".join(r["s"])) for r in found} == {"d.ts": (6, "AMMRRR"), "c.ts": (3, "AMR"), "other é x.ts": (1, "A")}
    assert len(git("log", "--follow", "--format=%H", "--", "d.ts").split()) == 6
    (tmp_path / "d.ts").write_text("new\n" + body)
    (tmp_path / "other é x.ts").write_text("own\n" * 8)
    assert {r["file_path"] for r in R.git_diff(spark, str(tmp_path)).collect()} >= {"d.ts"}
    with pytest.warns(UserWarning):
        assert R.git_diff(spark, str(tmp_path / "nowhere")).count() == 0


def test_names_by_walking(spark):
    """Chains of renames against a walk over the log from the newest commit back."""
    r = random.Random(8)
    log, now = [], {}
    for order in range(400):
        paths = r.sample("abcdefgh", 2)
        status = r.choice("RMMA")
        log.append((order, paths[1], paths[0] if status == "R" else None, status))
    want = []
    for order, path, old, status in log:
        name = now.get(path, path)
        want.append((order, name))
        if status == "R":
            now[old] = name
        elif status == "A":
            now.pop(path, None)
    df = spark.createDataFrame(log, "commit_order long, file_path string, old_path string, status string")
    assert sorted((x["commit_order"], x["name_now"]) for x in H.current_names(df).collect()) == want


def test_scanning_needs_no_package_on_workers(tmp_path):
    """A session whose Python workers can't import the library, as on a cluster."""
    root = str(Path(__file__).resolve().parents[1])
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/c").getOrCreate()
from callweave.sources.index import Index
files = spark.createDataFrame([("/p/a.ts", "typescript", "function f() {{\\n}}\\n", "1")], "file_path string, language_id string, content string, sha256 string")
print("FOUND", [r["name"] for r in Index.build(files).symbols.collect()])
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert "FOUND ['f']" in done.stdout, done.stderr[-2000:]
