"""Line deduplication by an exact set-similarity join, in DataFrame functions alone.

A line is the set of its words. A line goes if an earlier line (by document id, then line
number) has a word set at Jaccard similarity ``4/5`` or more. Equal lines are settled
first. Words are ordered by rarity, and two similar sets must share a word among their
rarest ``n - ceil(0.8 n) + 1``. Pairs that meet on such a word pass a length filter, a
positional filter (words left after the meeting point) and a bitmap filter (a 128-bit
signature of each set bounds the overlap). What passes is verified on the words.

Rarity is counted over the whole corpus in ``BUCKETS`` hash buckets, a table of fixed size.
Any order gives the same result; the counts only make the prefixes selective. Words are
held as 63-bit numbers, the rarity class of their bucket followed by 47 bits of their hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, WORD, by_value, cut, maybe_broadcast, without, written

BUCKETS, HASH_BITS = 1 << 18, 47
#: A prefix word of so many lines is hot; its lines first meet the earliest line of each of a few hash classes.
HOT, PARTNERS = 256, 4
#: Without it Spark's analyzer takes no scalar subquery inside a lambda function.
IN_LAMBDA = "spark.sql.analyzer.allowSubqueryExpressionsInLambdasOrHigherOrderFunctions"


# Exploding the outer way here is the same, as the arrays are never empty, and spares the filter
# that Spark otherwise infers below an explode, which would compute the arrays twice.
def words(line: Column) -> Column:
    return F.array_remove(F.split(line, SPACE), "")


def rarity(docs: DataFrame, text: str) -> DataFrame:
    """One row, one column: for each bucket a class of 15 bits, larger for more words of the corpus, in the bits above the hash's."""
    each = docs.select(F.explode_outer(F.split(text, SPACE)).alias("w")).select(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("b"), F.lit(1).cast("long").alias("n"))
    every = each.unionAll(docs.sparkSession.range(BUCKETS).select(F.col("id").alias("b"), F.lit(0).cast("long").alias("n")))
    n = every.groupBy("b").agg(F.sum("n").alias("n")).select("b", F.call_function("shiftleft", F.floor(F.log2(F.col("n") + 1) * 512).cast("long"), F.lit(HASH_BITS)).alias("c"))
    return cut(n.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "c"))), lambda x: x["c"]).alias("classes")))  # exactly BUCKETS rows


def overlap(n: Column, m: Column) -> Column:
    """The fewest common words of sets of n and m words at Jaccard 4/5: ceil(4 (n + m) / 9)."""
    return F.floor((4 * (n + m) + 8) / 9)


def prefix(n: Column) -> Column:
    """How many of its rarest words a set of n shares one with any similar set: n - ceil(4 n / 5) + 1."""
    return n - F.floor((4 * n + 4) / 5) + 1


def lines_of(docs: DataFrame, without_: DataFrame | None = None) -> DataFrame:
    """(begin, text_hash, place, own): the lines of ``docs`` that hold a word, without those that ``without_`` (begin, text_hash, gone) names."""
    if without_ is None:
        each = docs.select("begin", "text_hash", F.posexplode_outer(F.split("text", "\n")).alias("line", "own"))
    else:
        # a lambda would split the text again for each line, so the parts are a column first
        docs = _named(docs, without_, "left").select("begin", "text_hash", "gone", F.split("text", "\n").alias("parts"))
        some = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "gone")
        whole = F.when(F.col("gone").isNull(), F.transform("parts", lambda x, i: F.struct(i.alias("line"), x.alias("own")))).otherwise(F.transform(some, lambda i: F.struct(i.alias("line"), F.get("parts", i).alias("own"))))
        each = docs.select("begin", "text_hash", F.explode_outer(whole).alias("x")).select("begin", "text_hash", "x.line", "x.own")
    return each.where(F.col("own").rlike(WORD)).select("begin", "text_hash", (F.col("begin") + F.col("line")).alias("place"), "own")


def _named(docs: DataFrame, numbers: DataFrame, how: str) -> DataFrame:
    """``docs`` with the array that ``numbers`` (begin, text_hash, and an array) has for them."""
    return docs.join(maybe_broadcast(numbers), ["begin", "text_hash"], how)


def by_text(lines: DataFrame) -> DataFrame:
    """(begin, text_hash, gone): the numbers within their texts of ``lines`` (begin, text_hash, place)."""
    return lines.groupBy("begin", "text_hash").agg(F.collect_set((F.col("place") - F.col("begin")).cast("int")).alias("gone"))


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, gone): the numbers, from 0, of the lines that go, for each text that loses some."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    own = cut(docs.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.max(F.size(F.split("text", "\n"))).alias("lines")))
    if not own.where("n > 1").isEmpty():
        docs = docs.dropDuplicates(["doc_id", "text", "text_hash"])  # rows that are equal are one place
    # a line's place is its number in the corpus by (doc_id, line); texts of one id share their places
    texts = own.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("lines").cast("long").alias("lines"))
    unique = texts.where("n > 1").isEmpty()
    places = begins(texts, "doc_id", "lines", "begin")
    every = docs
    docs = docs.join(maybe_broadcast(places.withColumnRenamed("doc_id", "_d")), F.col("doc_id").eqNullSafe(F.col("_d"))).select("begin", "text_hash", "text")

    # equal lines first: only the earliest is compared with others
    ids = lines_of(docs).select("begin", "text_hash", "place", F.xxhash64("own").alias("s1"), F.xxhash64(F.lit("second"), "own").alias("s2"))
    least = ids.groupBy("s1", "s2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = cut(by_text(ids.join(least, ["s1", "s2"]).where("place > first")))
    single = lines_of(docs, copies)

    table = rarity(every, "text").scalar()
    mask = F.lit((1 << HASH_BITS) - 1)
    before = spark.conf.get(IN_LAMBDA, "false")
    spark.conf.set(IN_LAMBDA, "true")
    try:
        hashes = F.transform(words(F.col("own")), lambda w: F.xxhash64(w).bitwiseAND(mask))
        ranked = F.transform(hashes, lambda h: F.get(table, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).bitwiseOR(h))
        sets = single.select("begin", "text_hash", "place", F.sort_array(F.array_distinct(ranked)).alias("t"))
    finally:
        spark.conf.set(IN_LAMBDA, before)
    n = F.size("t")
    rarest = F.transform(F.slice("t", F.lit(1), prefix(n).cast("int")), lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    # once written, the numbers stay what they are; of unique ids the place will do as the number
    number = F.col("place") if unique else F.monotonically_increasing_id()
    bare = written(sets.select(number.alias("id"), "begin", "text_hash", "place", n.alias("n"), _bits("t", 0).alias("sig0"), _bits("t", 1).alias("sig1"), rarest.alias("r")))
    rows = bare.select("id", *([] if unique else ["place"]), "n", "sig0", "sig1", "r")
    place = "id" if unique else "place"

    # One earlier partner is enough. Where many lines are alike all would pair up, so the lines of a hot word first
    # meet a few early ones; what that settles looks for no earlier line any more.
    each = rows.select("*", F.posexplode_outer("r").alias("p", "w")).drop("r")
    hot = cut(each.groupBy("w").agg(F.count("*").alias("c")).where(F.col("c") >= HOT).select("w"))
    sure = None
    if not hot.isEmpty():
        each = each.join(maybe_broadcast(hot), "w")
        first = each.groupBy("w", F.pmod(F.xxhash64("id"), F.lit(PARTNERS)).alias("h")).agg(F.min(F.struct(*dict.fromkeys((place, "id", "n", "p", "sig0", "sig1")))).alias("v")).select("w", "v.*")
        n, m = F.col("x.n"), F.col("y.n")
        ahead = (F.col(f"y.{place}") < F.col(f"x.{place}")) & (F.least(n - F.col("x.p"), m - F.col("y.p")) >= overlap(n, m))
        met = each.alias("x").join(first.alias("y"), (F.col("x.w") == F.col("y.w")) & ahead & may(n, m))
        best = met.groupBy("x.id").agg(F.min_by("y.id", lost("x", "y") + lost("y", "x")).alias("id_"))
        sure = cut(_verified(cut(best), bare, docs))
        rows = rows.join(maybe_broadcast(cut(sure.select("id").distinct()).withColumn("s", F.lit(1))), "id", "left")
    else:
        rows = rows.withColumn("s", F.lit(0))

    # one long for the size, the position and whether the line is settled
    left = lambda c, k: F.call_function("shiftleft", c.cast("long"), F.lit(k))
    keyed = rows.select("id", *([] if unique else ["place"]), left(F.col("n"), 32).bitwiseOR(F.coalesce("s", F.lit(0)).cast("long")).alias("n"), "sig0", "sig1", F.posexplode_outer("r").alias("p", "w"))
    keyed = keyed.withColumn("n", F.col("n").bitwiseOR(left(F.col("p"), 1))).drop("p")
    longer, shorter = keyed.alias("x"), keyed.alias("y")  # one exchange serves both sides
    part = lambda s: (F.shiftright(f"{s}.n", 32), F.shiftright(f"{s}.n", 1).bitwiseAND(F.lit((1 << 31) - 1)), F.col(f"{s}.n").bitwiseAND(F.lit(1)))
    (n, p, done), (m, q, done_) = part("x"), part("y")
    order = (n > m) | ((n == m) & (F.col("x.id") > F.col("y.id")))
    asks = F.when(F.col(f"x.{place}") > F.col(f"y.{place}"), done).otherwise(done_) == 0
    near = (F.col("x.w") == F.col("y.w")) & order & (F.least(n - p, m - q) >= overlap(n, m)) & asks & may(n, m)
    pairs = cut(longer.join(shorter, near).select("x.id", F.col("y.id").alias("id_")).distinct())

    found = _verified(pairs, bare, docs)
    found = (found if sure is None else sure.unionAll(found)).select("begin", "text_hash", "place")
    equal = copies.select("begin", "text_hash", F.explode("gone").alias("line")).select("begin", "text_hash", (F.col("begin") + F.col("line")).alias("place"))
    gone = by_text(found.unionAll(equal))
    return gone.join(maybe_broadcast(places), "begin").select("doc_id", "text_hash", "gone")


def begins(rows: DataFrame, key: str, size: str, out: str) -> DataFrame:
    """(key, out): the sum of the sizes of all rows before, by key, null first; summed within ranges of keys and shifted by the ranges before."""
    ranged = cut(rows.select(key, size).repartitionByRange(F.asc_nulls_first(key)).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    shifts = ranged.groupBy("_part").agg(F.sum(size).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = Window.partitionBy("_part").orderBy(F.asc_nulls_first(key)).rowsBetween(Window.unboundedPreceding, -1)
    return cut(ranged.withColumn("_own", F.coalesce(F.sum(size).over(own), F.lit(0))).join(F.broadcast(shifts), "_part").select(key, (F.col("_own") + F.col("_shift")).alias(out)))


def _bits(t: str, i: int) -> Column:
    """The i-th 64 bits of a signature of 128, in which bits 20 to 26 of each word's hash set one; never null, lest it be computed again to filter nulls."""
    here = lambda x: F.shiftright(x, 26).bitwiseAND(F.lit(1)) == i
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x, 20).bitwiseAND(F.lit(63)).cast("int"))
    return F.coalesce(F.aggregate(t, F.lit(0).cast("long"), lambda a, x: F.when(here(x), a.bitwiseOR(one(x))).otherwise(a)), F.lit(0).cast("long"))


def lost(a: str, b: str) -> Column:
    """Bits of a's signature that b's lacks: at least so many words of a are not in b."""
    return sum(F.bit_count(F.col(f"{a}.sig{i}").bitwiseAND(F.bitwise_not(F.col(f"{b}.sig{i}")))) for i in range(2))


def may(n: Column, m: Column) -> Column:
    """Whether the sets of n and m words of x and y can be similar, by their sizes and signatures."""
    o = overlap(n, m)
    return (5 * m >= 4 * n) & (5 * n >= 4 * m) & (n - lost("x", "y") >= o) & (m - lost("y", "x") >= o)


def _verified(pairs: DataFrame, bare: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, begin, text_hash, place) of the later lines of the pairs (id, id_) whose word sets are alike; a line may come several times."""
    asked = pairs.select("id").unionAll(pairs.select("id_")).distinct()
    asked = cut(bare.select("id", "begin", "text_hash", "place", "n").join(asked, "id").groupBy("begin", "text_hash").agg(F.collect_list(F.struct("id", "place", "n")).alias("at")))
    texts = _named(docs, asked, "inner").select("begin", "text_hash", "at", F.split("text", "\n").alias("parts"))
    one = F.when(F.size("parts") > 0, F.transform("at", lambda a: F.struct(a["id"].alias("id"), a["place"].alias("place"), a["n"].alias("n"), F.get("parts", (a["place"] - F.col("begin")).cast("int")).alias("own"))))
    lines = written(texts.select("begin", "text_hash", F.explode_outer(one).alias("x")).select("x.id", "begin", "text_hash", "x.place", "x.n", "x.own"))
    x, y = (lines.select([F.col(c).alias(f"{s}{c}") for c in lines.columns]) for s in "xy")
    both = pairs.join(x, F.col("id") == F.col("xid")).join(y, F.col("id_") == F.col("yid"))
    common = F.size(F.array_remove(F.array_intersect(F.split("xown", SPACE), F.split("yown", SPACE)), ""))
    alike = both.where("xplace <> yplace").where(9 * common >= 4 * (F.col("xn") + F.col("yn")))
    line = lambda s: F.struct(*[F.col(f"{s}{c}").alias(c) for c in ("id", "begin", "text_hash", "place")])
    return alike.select(F.when(F.col("xplace") > F.col("yplace"), line("x")).otherwise(line("y")).alias("v")).select("v.*")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the later of similar lines taken out of ``text``, and ``lines`` and ``lines_removed``.

    A null text has no lines and stays null; blank lines stay. A text that loses every line
    becomes empty. Null ids come first in the order; rows that repeat an id are one place in
    it, so they never take lines from each other. Columns of these names are replaced; an
    empty table gives no rows.
    """
    gone = cut(removed_lines(docs, doc_id, text)).withColumnsRenamed({"doc_id": "_line_id", "text_hash": "_line_hash", "gone": "_line_gone"})
    docs = without(docs, ["lines", "lines_removed"])
    same = F.col(doc_id).eqNullSafe(F.col("_line_id")) & (F.xxhash64(text) == F.col("_line_hash"))
    both = docs.join(maybe_broadcast(gone), same, "left").withColumn("_line_parts", F.split(text, "\n"))
    parts = F.col("_line_parts")
    kept = F.when(F.col("_line_gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_line_gone")), lambda i: F.get(parts, i)), "\n"))
    # Catalyst evaluates the new columns from the old text
    return both.select(*[kept.alias(c) if c == text else F.col(c) for c in docs.columns], F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("lines"), F.coalesce(F.size("_line_gone"), F.lit(0)).cast("long").alias("lines_removed"))


#: Every pair of lines that share a word, by brute force.
SQL = r"""
WITH l AS (SELECT doc_id, line, list_distinct(regexp_extract_all(own, '[^\x20\x09-\x0D]+')) AS t
           FROM (SELECT doc_id, unnest(p) AS own, generate_subscripts(p, 1) - 1 AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL))),
s AS (SELECT row_number() OVER () AS id, t, len(t) AS n, min((doc_id, line)) AS f FROM (SELECT doc_id, line, list_sort(t) AS t FROM l WHERE len(t) > 0) GROUP BY t),
w AS (SELECT id, n, f, unnest(t) AS w FROM s),
c AS (SELECT a.id AS id, a.n AS n, b.n AS m, b.f AS f, count(*) AS common FROM w a JOIN w b ON a.w = b.w AND b.f < a.f AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n GROUP BY ALL),
e AS (SELECT id, min(f) AS f FROM c WHERE 9 * common >= 4 * (n + m) GROUP BY id),
g AS (SELECT s.t AS t, coalesce(e.f, s.f) AS f FROM s LEFT JOIN e USING (id)),
r AS (SELECT l.doc_id, l.line FROM l JOIN g ON list_sort(l.t) = g.t WHERE (l.doc_id, l.line) > g.f),
k AS (SELECT d.doc_id, d.own, d.line, r.line IS NULL AS kept FROM (SELECT doc_id, unnest(p) AS own, generate_subscripts(p, 1) - 1 AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) d LEFT JOIN r ON d.doc_id = r.doc_id AND d.line = r.line)
SELECT doc_id, count(*) AS lines, count(*) FILTER (NOT kept) AS lines_removed, md5(coalesce(string_agg(own, chr(10) ORDER BY line) FILTER (kept), '')) AS kept_md5 FROM k GROUP BY doc_id
"""


by_value(__name__)
