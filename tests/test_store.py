"""The index as runs: what readers see, what changes cost, and what is cleared away."""

import pytest

from callweave.sources.index import TABLES, Index
from callweave.sources.store import Store
from callweave.streaming import service as V

FILES = "file_path string, language_id string, content string, sha256 string"


def files(spark, of):
    return spark.createDataFrame([(f"/p/f{i:03}.ts", "typescript", f"import {{ g }} from './x'\nexport function f{i}_{v}(a) {{\n  if (a) {{ g() }}\n}}\n", f"{i}-{v}") for i, v in of], FILES)


def rows(index):
    out = {t: sorted(str(sorted(r.asDict().items())) for r in getattr(index, t).drop("seq").collect()) for t in TABLES}
    return out | {"order": [r["name"] for r in index.symbols.orderBy("seq").collect()]}


def test_runs_equal_updates_and_cost_what_changes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/ix", fanout=3)
    want = Index.build(files(spark, [(i, 0) for i in range(60)]))
    store.apply(0, want)
    whole = store.folder.size("runs", "v0")
    for v in range(1, 8):
        new = Index.build(files(spark, [(v % 5, v), (100 + v, v)]))
        store.apply(v, new)
        want = want.update(new)
        if v in (1, 4, 7):
            got, plain = rows(store.read()), rows(want)
            assert got == plain
        names = [r["name"] for r in store.manifest()["runs"]]
        assert len(names) <= 6 and "v0" in names or v > 5
        assert store.folder.size("runs", f"v{v}") < whole or f"v{v}" not in names
    # two manifests are kept, and no run that neither names
    assert len(store._manifests()) == 2
    live = {r["name"] for r in store.manifest()["runs"]} | {r["name"] for r in store.manifest(before=7)["runs"]}
    assert set(store.folder.names("runs")) == live


def test_deleted_files_and_repeated_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/ix", fanout=2)
    store.apply(0, Index.build(files(spark, [(0, 0), (1, 0), (2, 0)])))
    gone = files(spark, [(1, 0)]).select("file_path")
    for _ in range(2):  # the second time as after a failure
        store.apply(1, Index.build(files(spark, [(2, 1)])), gone)
    assert {r["name"] for r in store.read().symbols.collect()} == {"f0_0", "f2_1"}
    assert {r["file_path"] for r in store.read().files.collect()} == {"/p/f000.ts", "/p/f002.ts"}
    store.apply(2, Index.build(files(spark, [(1, 2)])))
    assert {r["name"] for r in store.read().symbols.collect()} == {"f0_0", "f1_2", "f2_1"}
    store.apply(1, Index.build(files(spark, [(0, 9)])))  # an old version comes too late
    assert {r["name"] for r in store.read().symbols.collect()} == {"f0_0", "f1_2", "f2_1"}
    assert Store(spark, f"file://{tmp_path}/none").read() is None


@pytest.mark.parametrize("with_deletes", [False, True])
def test_follow(spark, tmp_path, with_deletes):
    first = files(spark, [(0, 0), (1, 0)])
    changes = first.selectExpr("*", "false AS deleted") if with_deletes else first
    changes.write.parquet(f"file://{tmp_path}/ch")
    run = lambda: V.follow(spark, spark.readStream.schema(changes.schema).parquet(f"file://{tmp_path}/ch"), f"file://{tmp_path}/ix", f"file://{tmp_path}/c").awaitTermination()
    run()
    second = files(spark, [(1, 1)])
    (second.selectExpr("*", "file_path LIKE '%f001%' AS deleted") if with_deletes else second).write.mode("append").parquet(f"file://{tmp_path}/ch")
    run()
    want = {"f0_0"} if with_deletes else {"f0_0", "f1_1"}
    assert {r["name"] for r in V.current(spark, f"file://{tmp_path}/ix").symbols.collect()} == want
