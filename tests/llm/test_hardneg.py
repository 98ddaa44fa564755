"""Hard negatives against their SQL twin, brute force on ties and extremes, and odd rows."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from callweave.llm import hardneg, queries

DATA = "/root/testdata/sf0.001"
ROW = "vec_id long, embedding array<double>, label int"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, every=50, positives=5, negatives=3):
    """The contract in plain integers; rows are distinct (id, vector, label)."""
    whole = [(i, [(lambda n, d: 256 * n // d)(*x.as_integer_ratio()) for x in v], c) for i, v, c in rows if i is not None and v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = sorted({(i, tuple(v), c) for i, v, c in whole})
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    out = []
    for i, a, c in whole:
        if i % every:
            continue
        near = sorted((-clip(sum(x * y for x, y in zip(a, v))), j, d) for j, v, d in whole if j != i and len(v) == len(a))
        for p, j in [(-s, j) for s, j, d in near if d == c][:positives]:
            own = [(-s, x) for s, x, d in near if d != c and 50 * p <= -100 * s <= 95 * p][:negatives]
            out += [(i, j, r + 1, x, p, s) for r, (s, x) in enumerate(own)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_query_equals_twin(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({hardneg.SQL})").fetchall()
    assert len(want) > 50 and got(queries.op11_hardneg(spark, DATA)) == sorted(want)


def test_ties_copies_and_shards(spark, monkeypatch):
    """Few distinct vectors, a third of all rows one of them, in many shards and blocks."""
    monkeypatch.setattr(hardneg, "SHARD", 16)
    monkeypatch.setattr(hardneg, "BLOCK", 4)
    r = np.random.default_rng(3)
    some = r.integers(-3, 4, (40, 6)) / 8
    rows = [(i, some[0 if r.random() < 0.33 else r.integers(40)].tolist(), int(r.integers(3))) for i in range(400)]
    df = spark.createDataFrame(rows, ROW)
    want = brute(rows, 20)
    assert len(want) > 30 and got(hardneg.mine(df, F.col("vec_id") % 20 == 0)) == want


def test_odd_rows(spark):
    big, nan = 1e300, float("nan")
    rows = [(0, [0.5, 1.0], 1), (0, [0.5, 1.0], 1), (0, [1.0, 0.25], 2), (1, [0.5, 0.75], 1), (2, [0.25, 0.5], 2), (3, None, 1), (4, [0.5, None], 1), (5, [nan, 1.0], 1), (6, [float("inf"), 1.0], 2), (7, [0.5, 0.5], None), (None, [0.5, 0.5], 1), (8, [0.0, -0.0], 1), (9, [0.0, 0.0], 2), (10, [1.0], 1), (11, [1.0], 2), (12, [0.75], 2), (50, [], 1), (51, [], 1), (52, [], 2), (100, [1e9, 1.0], 1), (13, [big, 1.0], 1), (14, [2e8, 0.0], 2), (15, [0.7, 0.0], 2), (150, [1.0], 1), (200, [-1.0, -1.0], 1)]
    df = spark.createDataFrame(rows, ROW)
    want = brute(rows)
    assert {a for a, *_ in want} >= {0, 50, 100, 150}
    plain = got(hardneg.mine(df, F.col("vec_id") % 50 == 0))
    assert plain == want
    for c in ("id", "v", "dim", "asked", "anchor", "ids", "shard", "block", "rank", "positive_id"):
        df = df.withColumn(c, F.lit("taken"))
    assert got(hardneg.mine(df, F.col("vec_id") % 50 == 0)) == want
    assert hardneg.mine(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.parametrize("n", [3, 700])
def test_bounds_hold_and_prune(n):
    r = np.random.default_rng(n)
    points, asked = np.rint(r.normal(0, 30, (n, 64))).astype(np.int64), np.rint(r.normal(0, 30, (9, 64))).astype(np.int64)
    low, high = hardneg.Approximations(points).bounds(asked, np.arange(n))
    true = points @ asked.T
    assert (low <= true).all() and (true <= high).all()
    frame = pd.DataFrame({"ids": [[i] for i in range(n)], "label": [str(i % 4) for i in range(n)], "v": list(points / 256.0)})
    anchors = pd.DataFrame({"id": range(1000, 1009), "label": ["0"] * 9, "v": list(asked / 256.0)})
    shard = hardneg.Shard(frame, anchors, 256)
    best = {i: [x for a, _, x in shard.positives(5) if a == i] for i in range(9)}
    assert all(best[i] == sorted((x for x in range(0, n, 4)), key=lambda x: (-true[x, i], x))[:5] for i in range(9))
    if n > 100:
        assert shard.scored / 9 < 9 * n / 4 / 4  # of 175 rows with the label, under a quarter a pass are scored
