"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets are water-filled under each source's limit, then blocks of equal token count go to
the sources by highest quotients target / (2k + 1), which gives every shard of the mix an
integer quota of each source's blocks. Blocks are runs of words in a seeded order of the
source's documents; a shard takes the blocks that follow the shard before, and the order is
passed over again where the quotas exceed it. Built of DataFrame functions alone.

All sources together pass through a few single tasks (one row a source, and about four a
shard): thousands of sources are fine, and their number does not grow with the documents.

Quota method: a source's seats lie within ``share * sources`` of its rounded exact share,
so only that many quotients a source (about four a source in all) compete for the seats
that are open below; no loop over blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, by_value, cut

WEIGHTS = (5, 2, 1)
SHARE, LIMIT, BLOCK, SEED = 1.5, 2, 32, "mix-1"
#: Shards of the mix, of equal block count.
SHARDS = 8
#: Hex digits of the seeded order that name a bucket: no task orders more than a 4096th of a source.
DIGITS = 3


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(src_null, src, source_size) with the source's ``weight`` and ``target``.

    Weights repeat along the sources in code point order, null last. A target stops at
    ``limit`` times the source's size and the excess is shared again by weight.
    """
    everything = Window.partitionBy()
    nth = F.row_number().over(Window.orderBy("src_null", "src")) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", w.cast("long")).withColumn("_cap", F.col("source_size") * limit)
    s = s.withColumn("_all", F.sum("source_size").over(everything) * F.lit(share)).withColumn("_w", F.sum("weight").over(everything))
    before = Window.orderBy(F.col("_cap") / F.col("weight"), "src_null", "src").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (F.col("_w") - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    s = s.withColumn("_full", F.col("_level") * F.col("weight") > F.col("_cap"))
    level = (F.col("_all") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(everything), F.lit(0))) / F.nullif(F.sum(F.when(~F.col("_full"), F.col("weight"))).over(everything), F.lit(0))
    s = s.withColumn("target", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(level * F.col("weight")))
    return s.select("src_null", "src", "source_size", "weight", "target")


def quotas(aims: DataFrame, seats: int | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """``aims`` with ``blocks``: ``seats`` seats by the highest quotients target / (2k + 1), ties to the earlier source; for each value of ``by`` apart."""
    seats = F.lit(seats) if isinstance(seats, int) else seats
    everything = Window.partitionBy(*by)
    a = aims.withColumn("_part", F.col("target") / F.nullif(F.sum("target").over(everything), F.lit(0.0))).withColumn("_n", F.count("*").over(everything))
    a = a.withColumn("_part", F.coalesce("_part", F.lit(0.0))).withColumn("_seats", seats.cast("long"))
    near, spread = F.floor(F.col("_part") * F.col("_seats") + 0.5), F.ceil(F.col("_part") * F.col("_n")) + 2
    a = a.withColumn("_base", F.greatest(F.lit(0), near - spread).cast("long")).withColumn("_top", (near + spread).cast("long"))
    a = a.withColumn("_open", F.col("_seats") - F.sum("_base").over(everything))
    q = a.where("target > 0").withColumn("_k", F.explode(F.sequence("_base", "_top")))
    best = Window.partitionBy(*by).orderBy((F.col("target") / (2 * F.col("_k") + 1)).desc(), "src_null", "src", "_k")
    won = q.withColumn("_r", F.row_number().over(best)).where("_r <= _open").groupBy(*by, "src_null", "src").agg(F.count("*").alias("_won"))
    return a.join(won, [*by, "src_null", "src"], "left").withColumn("blocks", F.col("_base") * (F.col("target") > 0).cast("long") + F.coalesce("_won", F.lit(0))).select(*aims.columns, "blocks")


def shard_quotas(aims: DataFrame, seats: int, shards: int) -> DataFrame:
    """Blocks of each source in each of ``shards`` shards of equal block count: (shard, src_null, src, first_block, blocks).

    Sainte-Laguë never takes back a seat when seats are added, so a shard's quota is what its
    end has beyond its begin, and it takes the blocks that follow in the source's seeded order.
    """
    ends = aims.withColumn("_end", F.explode(F.sequence(F.lit(0), F.lit(shards))))
    at = quotas(ends, F.floor(F.lit(seats) * F.col("_end") / F.lit(shards)), ("_end",))
    last = Window.partitionBy("src_null", "src").orderBy("_end")
    at = at.withColumn("first_block", F.lag("blocks").over(last)).where("_end > 0")
    return at.select((F.col("_end") - 1).alias("shard"), "src_null", "src", "first_block", (F.col("blocks") - F.col("first_block")).alias("blocks"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT, block: int = BLOCK, seed: str = SEED, shards: int = SHARDS) -> DataFrame:
    """What each shard of the mix takes of each document: (doc_id, size, source_size, target, taken, shard_words).

    ``shard_words`` has the words that shards 0, 1, .. take, joined by commas; ``taken`` is
    their sum. A shard takes the blocks of its own quota of each source, those that follow
    the shard before in the source's seeded order of documents.

    A null text has size 0 and gives none; very long texts are read as a whole; a null source
    is a source; null or repeated ids and repeated rows are kept (rows that are equal may
    change places in the seeded order); further columns, whatever their names, take no part;
    an empty table gives no rows.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    name = F.col(source)
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))
    base = cut(docs.select(F.col(doc_id).alias("doc_id"), size.alias("size"), name.isNull().alias("src_null"), F.coalesce(name, F.lit("")).alias("src"), order.alias("_key")))
    base = base.withColumn("_bucket", F.substring("_key", 1, DIGITS))
    buckets = cut(base.groupBy("src_null", "src", "_bucket").agg(F.sum("size").alias("_words")))
    aims = cut(targets(buckets.groupBy("src_null", "src").agg(F.sum("_words").alias("source_size")), weights, share, limit))
    seats = int((aims.agg(F.sum("target")).first()[0] or 0.0) / block + 0.5)
    ends = shard_quotas(aims, seats, shards).groupBy("src_null", "src").agg(F.sort_array(F.collect_list(F.struct("shard", (F.col("first_block") + F.col("blocks")).alias("end")))).alias("_e"))
    # shard i takes the source's words from the i-th of these to the next, counted on over the passes
    cuts = F.transform(F.concat(F.array(F.lit(0).cast("long")), F.col("_e.end")), lambda e: F.least(e * block, F.col("source_size") * limit))
    plan = aims.join(ends, ["src_null", "src"]).select("src_null", "src", "source_size", "target", cuts.alias("_cuts"))
    earlier = Window.partitionBy("src_null", "src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = buckets.withColumn("_shift", F.coalesce(F.sum("_words").over(earlier), F.lit(0))).drop("_words").join(plan, ["src_null", "src"])
    own = Window.partitionBy("src_null", "src", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = base.withColumn("_end", F.sum("size").over(own)).join(shifts, ["src_null", "src", "_bucket"])
    at = at.withColumn("_end", F.col("_end") + F.col("_shift")).withColumn("_begin", F.col("_end") - F.col("size"))

    def taken_by(i: Column) -> Column:
        low, high = F.get("_cuts", i), F.get("_cuts", i + 1)
        parts = [F.least(high, F.col("_end") + p * F.col("source_size")) - F.greatest(low, F.col("_begin") + p * F.col("source_size")) for p in range(limit)]
        return sum((F.greatest(x, F.lit(0)) for x in parts), F.lit(0).cast("long")).cast("long")

    at = at.withColumn("_taken", F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), taken_by))
    taken = F.aggregate("_taken", F.lit(0).cast("long"), lambda a, x: a + x)
    return at.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.array_join(F.col("_taken").cast("array<string>"), ",").alias("shard_words"))


SQL = rf"""
WITH d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, source IS NULL AS src_null, coalesce(source, '') AS src,
                  md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
s AS (SELECT src_null, src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][1 + CAST((row_number() OVER (ORDER BY src_null, src) - 1) % {len(WEIGHTS)} AS INT)] AS weight, source_size * {LIMIT} AS cap FROM s),
f AS (SELECT *, (sum(source_size) OVER () * CAST({SHARE} AS DOUBLE) - coalesce(sum(cap) OVER o, 0)) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS DOUBLE) AS lvl
      FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, src_null, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, lvl * weight > cap AS is_full FROM f),
t AS (SELECT src_null, src, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE weight * ((SELECT sum(source_size) * CAST({SHARE} AS DOUBLE) - coalesce(sum(cap) FILTER (is_full), 0) FROM g) / (SELECT CAST(sum(weight) FILTER (NOT is_full) AS DOUBLE) FROM g)) END AS target FROM g),
n AS (SELECT CAST(floor(sum(target) / {BLOCK} + 0.5) AS BIGINT) AS seats FROM t),
q AS (SELECT src_null, src, target / (2 * k + 1) AS quotient, k FROM t, n, range(0, seats + 1) r(k) WHERE target > 0 AND k <= target / {BLOCK} + 40),
r AS (SELECT *, row_number() OVER (ORDER BY quotient DESC, src_null, src, k) AS r FROM q),
b AS (SELECT src_null, src, e, count(*) FILTER (r <= seats * e // {SHARDS}) AS blocks FROM r, n, range(0, {SHARDS + 1}) x(e) GROUP BY ALL),
p AS (SELECT t.src_null, t.src, e - 1 AS shard, coalesce(least(lag(blocks) OVER (PARTITION BY t.src_null, t.src ORDER BY e) * {BLOCK}, source_size * {LIMIT}), 0) AS lo, coalesce(least(blocks * {BLOCK}, source_size * {LIMIT}), 0) AS hi
      FROM t LEFT JOIN b USING (src_null, src)),
c AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY src_null, src ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS ends, row_number() OVER () AS row FROM d JOIN t USING (src_null, src)),
m AS (SELECT row, shard, CAST(sum(greatest(least(hi, ends + pass * source_size) - greatest(lo, ends - size + pass * source_size), 0)) AS BIGINT) AS words
      FROM c JOIN p USING (src_null, src), range(0, {LIMIT}) x(pass) WHERE shard >= 0 GROUP BY ALL),
a AS (SELECT row, CAST(sum(words) AS BIGINT) AS taken, string_agg(CAST(words AS VARCHAR), ',' ORDER BY shard) AS shard_words FROM m GROUP BY row)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, coalesce(taken, 0) AS taken, coalesce(shard_words, '{",".join("0" * SHARDS)}') AS shard_words FROM c LEFT JOIN a USING (row)
"""


by_value(__name__)
