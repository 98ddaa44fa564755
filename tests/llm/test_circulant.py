"""Circulant MinHash against an exact join of all sets, and on odd rows."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.llm import circulant, queries
from callweave.llm.simhash import shingles

DATA = "/root/testdata/sf0.001"


def exact(rows, percent=85):
    """{row: (n, component)} by comparing all pairs of sets."""
    sets = [set(np.unique(shingles((t or "").encode(), 3)).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [(d, len(sets[i]), least.get(top(i))) for i, (d, _) in enumerate(rows)]


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_query_equals_exact(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = queries.op13_circulant(spark, DATA)
    assert found(got) == sorted(exact(rows), key=str)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_large_buckets_in_chunks(spark, monkeypatch):
    """A group of near copies, some of which only meet by way of others, settled in many small chunks."""
    monkeypatch.setattr(circulant, "CHUNK", 16)
    r = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in r.choice(120, r.integers(0, 7), replace=False):
            words[at] = f"x{r.integers(1000)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = exact(rows)
    assert 5 < len({c for _, _, c in want}) < 140
    assert found(circulant.near_duplicates(df)) == sorted(want, key=str)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977} v{i % 89}" for i in range(30_000))
    rows = [(1, "A b c"), (1, "A b c"), (1, "other words here now"), (2, None), (None, "a B c"), (3, ""), (4, " \n\t "), (5, long), (6, long + " end"), (None, None), (None, "only here without id"), (7, "two words"), (8, "TWO  words"), (9, "É b c"), (10, "é b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("digest", "n", "keys", "node", "component_id", "kept", "n_shingles"):
        df = df.withColumn(c, F.lit("taken"))
    out = circulant.near_duplicates(df)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in out.collect()), key=str)
    want = [(1, 1, True), (1, 1, True), (1, 1, True), (2, 2, True), (None, 1, False), (3, 3, True), (4, 4, True), (5, 5, True), (6, 5, False), (None, None, True), (None, None, True), (7, 7, True), (8, 7, False), (9, 9, True), (10, 10, True)]
    assert got == sorted(want, key=str)
    assert {r["doc_id"]: r["n_shingles"] for r in out.where("doc_id IN (2, 3, 4, 7)").collect()} == {2: 0, 3: 0, 4: 0, 7: 1}
    assert circulant.near_duplicates(df.limit(0)).collect() == []


def test_signatures_are_circulant_permutations():
    c = circulant.Circulant(size=64, bits=10)
    everything = np.arange(1 << 10, dtype=np.uint64)
    assert sorted(c.first(everything).tolist()) == list(range(1 << 10))  # a permutation
    table = c.shifted[:, 0]
    assert sorted(table.tolist()) == list(range(1 << 10))
    for k in (1, 63):  # coordinate k is the same table, turned by k places
        assert np.array_equal(c.shifted[:, k], np.roll(table, -k))


@pytest.mark.parametrize("same", [0.5, 0.85, 0.95])
def test_coordinates_agree_as_often_as_sets_overlap(same):
    r, c, hits = np.random.default_rng(2), circulant.Circulant(), []
    for _ in range(60):
        both = r.integers(0, 1 << 63, 300, np.uint64)
        n = int(300 * (1 - same) / (1 + same))
        a, b = (np.concatenate([both[: 300 - n], r.integers(0, 1 << 63, n, np.uint64)]) for _ in range(2))
        true = (300 - n) / (300 + n)
        hits.append((c.signature(a) == c.signature(b)).mean() - true)
    assert abs(np.mean(hits)) < 0.02
