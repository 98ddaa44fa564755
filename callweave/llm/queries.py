"""One query per operator of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, circulant, hardneg, langid, linededup, lm, mixing, neighbours, packing, search, sharding, simhash, substring
from .shared import table

#: A document without an id is not held out.
HELD_OUT = "coalesce(pmod(crc32(CAST(doc_id AS STRING)), 4) = 2, false)"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("_same"))
    placed = sharding.shard_groups(docs, "_same", "size", shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.groups(simhash.fingerprints(table(spark, sf_dir, "documents")))
    return linked.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), F.col("doc_id") % 50 == 0)


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lm.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lm.score_encoded(words, lm.fit_encoded(words))


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "lines", "lines_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(f"NOT ({HELD_OUT})"), by=F.xxhash64("doc_id"))
    known = langid.predict(docs.select("doc_id", "text", F.expr(HELD_OUT).alias("held_out")), model)
    return known.select("doc_id", "held_out", F.col("lang_pred"), F.col("lang_score").alias("score"))


def op11_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.of_embeddings(table(spark, sf_dir, "embeddings"))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.of_tables(spark, sf_dir)


def op13_circulant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_sharding": op2_sharding,
    "op3_simhash": op3_simhash,
    "op4_mixing": op4_mixing,
    "op5_search": op5_search,
    "op6_lm": op6_lm,
    "op7_linededup": op7_linededup,
    "op8_substring": op8_substring,
    "op9_neighbours": op9_neighbours,
    "op10_langid": op10_langid,
    "op11_hardneg": op11_hardneg,
    "op12_audit": op12_audit,
    "op13_circulant": op13_circulant,
}

ORACLE_SQL: dict[str, str] = {"op4_mixing": mixing.SQL, "op5_search": search.SQL, "op7_linededup": linededup.SQL, "op8_substring": substring.SQL, "op11_hardneg": hardneg.SQL, "op12_audit": audit.SQL}
