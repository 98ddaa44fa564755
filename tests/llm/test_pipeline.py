"""The pipeline's stages: each one's decisions take effect and nothing else changes."""

from collections import Counter

import corpus_pipeline as P
import numpy as np
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs
    for name, stage in P.STAGES[:-1]:
        after = P.written(stage(spark, before, DATA))
        assert after.columns == docs.columns, name
        before = after
    pieces = P.STAGES[-1][1](spark, before, DATA)
    whole = Counter(r["doc_id"] for r in before.collect())
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == set(whole)
    assert [n for n, _ in P.STAGES] == ["language ID", "line dedup", "near-dedup", "mixing", "packing"]


def test_run(spark):
    assert P.run(spark, DATA).count() > 0


def test_odd_rows_and_empty_table(spark):
    rows = [(1, "the cat sat on the mat with the hat", "en", "x", 5), (1, "the cat sat on the mat with the hat", "en", "x", 5), (2, None, None, None, None), (None, "the dog ran over the hill and far away", "en", None, 1), (3, "", "en", "x", 0), (4, "12 34", None, "y", 4), (5, "the end of the road is near " * 4000, "en", "y", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("_row_key", F.lit("clash")).withColumn("lang_pred", F.lit("clash"))
    for name, stage in P.STAGES:
        stage(spark, df, DATA).collect()
        assert stage(spark, df.limit(0), DATA).collect() == [], name


def test_odd_rows_by_value(spark):
    rows = [(1, "the cat sat on the mat", "en", "x", 5), (1, "the cat sat on the mat", "en", "x", 5), (2, None, None, None, None), (None, "the dog ran over the hill\nthe cat sat on the mat", "en", None, 1), (3, "", "en", "x", 0), (4, "12 34", None, "y", 4)]
    df = spark.createDataFrame(rows, DOCS)
    kept = lambda stage: sorted(((r["doc_id"], r["text"]) for r in stage(spark, df, DATA).collect()), key=repr)
    alike = lambda found: sorted(found, key=repr)
    letters = [(1, rows[0][1]), (1, rows[0][1]), (None, rows[3][1])]
    assert kept(P.language_id) == alike(letters)
    # null ids come first, so both rows of id 1 lose their only line, and go
    assert kept(P.line_dedup) == alike([(2, None), (None, rows[3][1]), (3, ""), (4, "12 34")])
    assert kept(P.near_dedup) == alike([(1, rows[0][1]), (2, None), (None, rows[3][1]), (4, "12 34")])
    mixed = P.mix_sources(spark, df, DATA).collect()
    assert {r["doc_id"] for r in mixed} <= {1, None, 4} and all(set(r["text"].split()) <= set(rows[0][1].split()) | set(rows[3][1].split()) | {"12", "34"} for r in mixed)
    packed = P.pack(spark, df, DATA).collect()
    assert len(packed) == len(rows) and {r["doc_tokens"] for r in packed if r["doc_id"] in (2, 3)} == {1}


def test_near_dedup_keeps_one_of_each_group(spark):
    r = np.random.default_rng(0)
    base = [" ".join(f"w{x}" for x in r.integers(0, 5000, 150)) for _ in range(20)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(base)] + [(100 + i, t, "en", "s", 0) for i, t in enumerate(base[:10])] + [(200 + i, t + " end", "en", "s", 0) for i, t in enumerate(base[:10])] + [(0, base[0], "en", "s", 0)]
    kept = sorted(r["doc_id"] for r in P.near_dedup(spark, spark.createDataFrame(rows, DOCS), DATA).collect())
    assert kept == list(range(20))


def test_near_dedup_takes_the_links_of_simhash(spark, monkeypatch):
    alone = lambda docs, key, **_: docs.select(F.col(key).alias("doc_id"), F.col(key).alias("component_id"))
    monkeypatch.setattr(P.circulant, "near_duplicates", alone)
    rows = [(1, "a b c d e f g", "en", "s", 0), (2, "A b c d e f g", "en", "s", 0), (3, "h i j k l m n", "en", "s", 0)]
    assert sorted(r["doc_id"] for r in P.near_dedup(spark, spark.createDataFrame(rows, DOCS), DATA).collect()) == [1, 3]


def test_language_stage_rejects_only_what_has_no_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    junk = spark.createDataFrame([(10**6, "1234 5678", "en", "s", 0), (10**6 + 1, None, "en", "s", 0)], DOCS)
    kept = P.language_id(spark, docs.unionByName(junk), DATA)
    assert kept.count() == docs.count()


def test_mixing_repeats_texts(spark):
    docs = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i}", "en", f"s{i % 3}", 0) for i in range(60)], DOCS)
    out = P.mix_sources(spark, docs, DATA).collect()
    words = sum(len(r["text"].split()) for r in out)
    assert abs(words - 1.5 * 240) <= 3 * 32 and max(Counter(r["doc_id"] for r in out).values()) <= 2
