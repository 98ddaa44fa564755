"""The filter audit against its SQL twin, plain counting in every order, and odd rows."""

import re
from collections import Counter
from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from callweave.llm import audit, queries

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(docs, labels):
    """Walk all documents through all orders."""
    rows = []
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {c for c, x in {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)}.items() if x}
        rows.append((part or "", fails, i is not None and any(j == i and q == 1 for j, q, _ in labels), i is not None and any(j == i and x == 1 for j, _, x in labels)))
    out = {}
    for part in {r[0] for r in rows}:
        own, shapley = [r for r in rows if r[0] == part], Counter()
        for order in permutations("ABCDE"):
            alive = own
            for k, c in enumerate(order):
                lost = [r for r in alive if c in r[1]]
                alive = [r for r in alive if c not in r[1]]
                shapley[c] += len(lost)
                out[part, "".join(order), k + 1] = [len(alive), len(lost), sum(c in r[1] for r in own) - len(lost), sum(r[1] == {c} for r in own), sum(r[2] for r in lost), sum(r[3] for r in lost)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return sorted((*k, *v) for k, v in out.items())


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_query_equals_twin(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({audit.SQL})").fetchall()
    assert len(want) == 600 * con.sql("SELECT count(DISTINCT coalesce(lang, '')) FROM documents").fetchall()[0][0]
    assert got(queries.op12_audit(spark, DATA)) == sorted(want)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    docs = [(1, "a b c", "en"), (1, "a b c", "en"), (2, None, None), (None, "a b c", "en"), (3, "", "en"), (4, " \n\t ", ""), (5, long, "fr"), (6, long, "en"), (None, None, None), (7, "SHOUT # loud", "fr"), (8, "x " * 200, "fr"), (9, "ÉCOLE é", "de"), (10, long + " |", "fr")]
    labels = [(1, 1, 0), (1, 0, 1), (6, 1, None), (7, None, 1), (None, 1, 1), (99, 1, 1)]
    df = spark.createDataFrame([(i, t, c, "s", 1) for i, t, c in docs], DOCS)
    for c in ("part", "A", "E", "same", "good", "toxic", "n", "mask", "is_first"):
        df = df.withColumn(c, F.lit("taken"))
    kinds = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("taken")).withColumn("part", F.lit("taken"))
    assert got(audit.audit(audit.flagged(df, kinds))) == brute(docs, labels)
    assert got(audit.audit(audit.flagged(df.limit(0), kinds))) == []
    assert {r[8] for r in got(audit.audit(audit.flagged(df, kinds.limit(0))))} == {0}


def test_fewer_filters(spark):
    """Any set of flags can be audited, not only the five of the query."""
    rows = spark.createDataFrame([("p", True, False, True, False), ("p", True, True, False, False), ("p", False, False, False, True)], "part string, X boolean, Y boolean, good boolean, toxic boolean")
    want = [("p", "XY", 1, 1, 2, 0, 1, 1, 0, 3), ("p", "XY", 2, 1, 0, 1, 0, 0, 0, 1), ("p", "YX", 1, 2, 1, 0, 0, 0, 0, 1), ("p", "YX", 2, 1, 1, 1, 1, 1, 0, 3)]
    assert got(audit.audit(rows, "XY")) == want
