"""Entry points ranked for a description in words."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def rank_entries(s: DataFrame, description: str, most: int = 5, least: float = 0.1) -> DataFrame:
    """The best entry points for a description in words: score, and why."""
    words = [w for w in (re.sub("[^a-zA-Z0-9]", "", x).lower() for x in description.split()) if w and w not in T.STOP_WORDS]
    near = T.similarity(words, F.col("name"), F.col("qualified_name"), F.col("_n"), F.col("_q")) if words else F.lit(0.0)
    lift = T.boost(F.col("name"), F.col("qualified_name"), F.col("signature"), F.col("file_path"), F.col("visibility"))
    scored = s.withColumns({"_n": T.bare(F.col("name")), "_q": T.bare(F.col("qualified_name"))}).withColumn("_near", near).withColumn("_lift", lift).withColumn("score", 0.6 * F.col("_near") + 0.4 * F.col("_lift"))
    scored = scored.withColumn("reason", T.reason(F.col("_near"), F.col("_lift"), F.col("name"), F.col("signature")))
    return scored.where(F.col("score") > least).orderBy(F.round("score", 9).desc(), "seq").limit(most).drop("_near", "_lift", "_n", "_q")
