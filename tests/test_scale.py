from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from callweave import queries
from callweave.operators import calls as C
from callweave.queries import QUERIES
from callweave.sources import index as I
from callweave.sources import readers

SF = "/root/testdata/sf0.001"


def test_annotations_lie_in_files_of_bounded_size(spark, monkeypatch):
    want = sorted(map(tuple, QUERIES["annotation_file"](spark, SF).collect()))
    seen = []
    monkeypatch.setattr(queries, "SIDECAR", 100)
    monkeypatch.setattr(readers, "annotations", lambda s, at, own=readers.annotations: seen.append([len(r[0]) for r in s.read.text(at, wholetext=True).collect()]) or own(s, at))
    assert sorted(map(tuple, QUERIES["annotation_file"](spark, SF).collect())) == want
    assert len(seen[0]) > 5 and max(seen[0]) < sum(seen[0]) / 4


def test_istanbul_looks_nothing_up_in_a_map(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"f": {"statementMap": {"0": {"start": {"line": 1, "column": 0}, "end": {"line": 2, "column": 0}}, "1": {"start": {"line": 2, "column": 0}, "end": {"line": 2, "column": 9}}}, "s": {"0": 3, "9": 8}}, "g": {"statementMap": {"0": {"start": {"line": 5, "column": 0}, "end": {"line": 5, "column": 1}}}}}')
    found = readers.istanbul(spark, str(tmp_path))
    assert sorted((r["file_path"], r["line"], r["hits"]) for r in found.collect()) == [("f", 1, 3), ("f", 2, 3), ("g", 5, 0)]
    assert "element_at(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_istanbul_entries_are_bounded(spark, monkeypatch):
    want = sorted(map(tuple, QUERIES["istanbul_hits"](spark, SF).collect()))
    seen = []
    monkeypatch.setattr(queries, "STATEMENTS", 4)
    monkeypatch.setattr(readers, "istanbul", lambda s, at, own=readers.istanbul: seen.extend(r[0].count('"start"') for r in s.read.text(at).collect()) or own(s, at))
    assert sorted(map(tuple, QUERIES["istanbul_hits"](spark, SF).collect())) == want
    assert max(seen) <= 4 and sum(seen) > 100


def test_a_scan_looks_only_for_what_is_asked(monkeypatch):
    files = pd.DataFrame({"file_path": ["a.ts"], "language_id": ["typescript"], "content": ['import {{ f }} from "./f";\nexport function g(a) { if (a) { f(a); } }'.replace("{{", "{").replace("}}", "}")]})
    tags = lambda *k: set(pd.concat(I._scan(iter([files]), k or I.KINDS))["tag"])
    assert tags() == {"symbol", "call", "conditional", "import"}
    monkeypatch.setattr(I.S.Scanner, "calls", None)
    assert tags("symbols") == {"symbol"} and tags("conditionals") == {"conditional"}
    monkeypatch.setattr(I.S, "scan", None)
    assert tags("imports") == {"import"}


def test_pairs_of_one_name_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(C, "CALLER_LOT", 20)
    monkeypatch.setattr(C, "NAMED_LOT", 5)
    symbols = spark.createDataFrame([(f"c{i}", "caller", f"f{i}", 1, 9) for i in range(200)] + [(f"d{i}", "hot", "g", 0, -1) for i in range(30)] + [("e", "cold", "g", 0, -1)], "node_id string, name string, file_path string, body_start long, body_end long")
    calls = spark.createDataFrame([(f"f{i}", i % 9 + 1, n) for i in range(200) for n in ("hot", "cold", "none")], "file_path string, line long, callee_name string")
    found = C.callees_in(symbols, calls, F.lit(True)).withColumn("at", F.spark_partition_id()).collect()
    assert sorted((r["caller_id"], r["callee_id"]) for r in found) == sorted((f"c{i}", d) for i in range(200) for d in ["e", *[f"d{j}" for j in range(30)]])
    assert max(Counter(r["at"] for r in found).values()) < len(found) / 2
