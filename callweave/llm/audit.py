"""What filters remove alone and together, in every order that they may run in.

Documents are counted by part and by which filters they fail, before anything is shuffled.
An SQL CUBE over the failure flags and the part then gives, in its rows with all selected
flags false, how many documents survive each subset of the filters. A step of an order is a
pair of such subsets, before it and after it: one join for each side.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import SPACE, by_value, table, written

COUNTS = ("n", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """A: under 100 words; B: under 80 % of the words distinct; C: over 10 % capitals A-Z; D: one of ``#$%&*|``."""
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n < 100, "B": 100 * F.size(F.array_distinct(words)) < 80 * n, "C": 100 * capitals > 10 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def flagged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) for each row of ``docs``; E: its text is that of a smaller doc_id, anywhere in the table.

    A null text is empty, a null part the empty string. Rows without an id are no copies;
    rows that repeat an id and its text fail E alike. A document is good (toxic) if any of
    its rows in ``labels`` has quality (toxic) 1. Very long texts are read as a whole;
    further columns, whatever their names, take no part; an empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = written(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(body, 256)).alias("same"), *[x.alias(c) for c, x in text_failures(body).items()]))
    # a text's first document is found by both keys, so copies of one text spread over all tasks
    first = rows.groupBy("same").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("is_first", F.lit(True))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    both = rows.join(first, ["same", "doc_id"], "left").join(known, "doc_id", "left")
    later = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return both.select("part", *"ABCD", later.alias("E"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def survivors(rows: DataFrame, names: str) -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part that pass all filters of each subset; bit i of ``mask`` stands for filter i."""
    counted = rows.groupBy("part", *names).agg(F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in COUNTS[1:]])
    mask = sum(((1 - F.grouping(c)).cast("int") * (1 << i) for i, c in enumerate(names)), F.lit(0))
    cubed = counted.cube(*names, "part").agg(*[F.sum(c).alias(c) for c in COUNTS], mask.alias("mask"), F.grouping("part").alias("all_parts"))
    passed = F.lit(True)
    for c in names:
        passed = passed & ~F.coalesce(c, F.lit(False))
    alive = cubed.where(passed & (F.col("all_parts") == 0)).select("part", "mask", *COUNTS)
    # subsets that nobody survives
    every = counted.select("part").distinct().withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1))))
    return every.join(alive, ["part", "mask"], "left").select("part", "mask", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS])


def steps(spark: SparkSession, names: str) -> DataFrame:
    """(filter_order, step, filter, before, after): the subsets on both sides of every step of every order."""
    bit, out = {c: 1 << i for i, c in enumerate(names)}, []
    for order in permutations(names):
        for k, c in enumerate(order):
            before = sum(bit[x] for x in order[:k])
            out.append(("".join(order), k + 1, c, before, before | bit[c]))
    return spark.createDataFrame(out, "filter_order string, step int, filter string, before int, after int")


def audit(rows: DataFrame, names: str = "ABCDE") -> DataFrame:
    """One row for each part, order of the filters ``names`` and step, with what the step does.

    ``rows`` has part, a boolean for each filter (true: fails), good and toxic, none of them
    null, as :func:`flagged` gives them. kept and removed are counts after and at the step;
    redundant: failing the step's filter, but removed before; unique_fails: failing it alone;
    good_lost and toxic_lost: removed here; shapley: removed by the filter, over all orders.
    Zeros are kept, an empty table gives no rows.
    """
    alive = written(survivors(rows, names))
    everything = (1 << len(names)) - 1
    at = lambda mask: F.max(F.when(F.col("mask") == mask, F.col("n")))
    alone = [F.struct(F.lit(c).alias("filter"), (at(0) - at(1 << i)).alias("fails"), (at(everything ^ 1 << i) - at(everything)).alias("unique_fails")) for i, c in enumerate(names)]
    own = alive.groupBy("part").agg(F.array(*alone).alias("all")).select("part", F.inline("all"))
    side = lambda name: alive.select("part", F.col("mask").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in COUNTS])
    pairs = side("before").join(F.broadcast(steps(rows.sparkSession, names)), "before").join(side("after"), ["part", "after"]).join(own, ["part", "filter"])
    removed = F.col("before_n") - F.col("after_n")
    lost = {f"{c}_lost": F.col(f"before_{c}") - F.col(f"after_{c}") for c in COUNTS[1:]}
    orders = Window.partitionBy("part", "filter")
    return pairs.select("part", "filter_order", "step", F.col("after_n").alias("kept"), removed.alias("removed"), (F.col("fails") - removed).alias("redundant"), "unique_fails", *[x.alias(c) for c, x in lost.items()], F.sum(removed).over(orders).alias("shapley"))


def of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
first AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) AS INT)
             + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(d.doc_id > least, false) AS INT) AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
      FROM d JOIN first USING (t) LEFT JOIN l ON d.doc_id = l.doc_id),
g AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
x(c, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p.c || q.c || r.c || s.c || u.c AS filter_order, [p.b, q.b, r.b, s.b, u.b] AS bits FROM x p, x q, x r, x s, x u WHERE p.b | q.b | r.b | s.b | u.b = 31),
st AS (SELECT filter_order, CAST(k AS INT) AS step, bits[k] AS bit, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INT) AS before FROM o, range(1, 6) t(k)),
r AS (SELECT part, filter_order, step, bit,
             CAST(coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS BIGINT) AS kept,
             CAST(coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS BIGINT) AS removed,
             CAST(coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS BIGINT) AS redundant,
             CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
             CAST(coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS BIGINT) AS good_lost,
             CAST(coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS BIGINT) AS toxic_lost
      FROM st, g GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""


by_value(__name__)
