"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, packing.

Near-dedup unites the links of SimHash with those of circulant MinHash, whose similarity SimHash does not reach: see README.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of
``docs``. Every stage takes null in any column, empty and very long texts, repeated rows,
an empty table and further columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import circulant, langid, linededup, mixing, packing, simhash
from callweave.llm.components import components
from callweave.llm.queries import tokenizer_path
from callweave.llm.shared import SPACE, WORD, maybe_broadcast, table, written

#: A document whose best language accounts for less of its n-grams than this is rejected.
LEAST_SCORE = 0.3
KEY = "_row_key"
#: Keys of near-dedup: of pairs at a similarity of 0.8, all but one in 35,000 share one.
BANDS, ROWS = 20, 4


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key that orders like doc_id (null last) and tells texts of one id apart; equal rows share it."""
    number = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 20, "0")
    return docs.withColumn(KEY, F.concat_ws(":", F.coalesce(number, F.lit("~")), F.hex(F.xxhash64("text", F.coalesce("source", F.lit(""))))))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter or whose n-grams belong to no learned language. With nothing to learn from, all stay that have a letter."""
    model = langid.fit(docs, by=F.xxhash64("doc_id"))
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    known = langid.predict(docs, model)
    return known.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SCORE)).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later similar lines go; so does a document that lost lines and has no word left."""
    kept = linededup.dedup_lines(docs)
    return kept.where((F.col("lines_removed") == 0) | F.coalesce(F.col("text").rlike(WORD), F.lit(False))).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays (one row of it)."""
    rows = keyed(docs)
    close = circulant.near_duplicates(rows, KEY, shingle=5, percent=80, bands=BANDS, rows=ROWS, blank_alike=True)
    alike = simhash.groups(simhash.fingerprints(rows, KEY))
    links = [d.where("doc_id <> component_id").select("doc_id", "component_id") for d in (alike, close)]
    groups = components(links[0].unionByName(links[1]), "doc_id", "component_id")
    lost = written(groups.where("node <> component").select(F.col("node").alias(KEY)).distinct())
    kept = rows.join(maybe_broadcast(lost), KEY, "left_anti")
    repeats = written(rows.groupBy(KEY).agg(F.count("*").alias("n")).where("n > 1").select(KEY))
    if repeats.count():
        again = kept.join(maybe_broadcast(repeats), KEY, "left_semi").dropDuplicates([KEY])
        kept = kept.join(maybe_broadcast(repeats), KEY, "left_anti").unionByName(again)
    return kept.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the document at a source's quota gives its first words once more."""
    rows = keyed(docs)
    takes = written(mixing.mix(rows, KEY).groupBy(F.col("doc_id").alias(KEY)).agg(F.max("size").alias("_size"), F.max("taken").alias("_taken")).where("_taken > 0"))
    both = rows.join(maybe_broadcast(takes), KEY)
    # one row for each pass over the text, the last perhaps in part
    passes = both.withColumn("_pass", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_taken") - 1) / F.col("_size")))))
    words = F.least(F.col("_size"), F.col("_taken") - F.col("_pass") * F.col("_size"))
    part = F.array_join(F.slice(F.array_remove(F.split("text", SPACE), ""), F.lit(1), words.cast("int")), " ")
    text = F.when(words < F.col("_size"), part).otherwise(F.col("text"))
    return passes.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, each with its sequence and offset."""
    return packing.pieces(docs, tokenizer_path())


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("mixing", mix_sources), ("packing", pack)]

#: SQL cannot express SimHash groups or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
