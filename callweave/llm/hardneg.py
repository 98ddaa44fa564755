"""Hard negatives by a vector-approximation file.

Rows are dealt to shards of bounded size. A shard quantises each dimension into ``CELLS``
cells of about equal count, a byte a component. For an anchor, one small table a dimension
holds the least and the most that a component in each cell can add to the score; looking up
and adding gives each row a lower and an upper bound. Only rows whose bounds let them enter
what is sought are scored exactly: first the anchors' best rows of their own label, merged
over the shards, and then, for the window below each of these, the best rows of other labels.

Scores are inner products of integers, exact at any size. Rows of one label with one vector
are held once, with the smallest ids that a result can name. Anchors visit the shards in
blocks, so a task holds one block and one shard; the work is anchors times rows, as bounds
save exact scores, not the look at each approximation.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import by_value, table, written

CELLS = 64
SHARD, BLOCK, LOT = 4096, 4096, 64
LONG = (1 << 63) - 1


class Approximations:
    """The cells of the rows of ``vectors`` (integers), and what bounds a component in each cell."""

    def __init__(self, vectors: np.ndarray, cells: int = CELLS):
        n, dim = vectors.shape
        self.cell = np.empty((dim, n), np.uint8)
        self.low, self.high = np.zeros((dim, cells), np.int64), np.zeros((dim, cells), np.int64)
        for d in range(dim):
            x = np.sort(vectors[:, d])
            edges = np.unique(x[np.arange(1, cells) * n // cells])
            cell = np.searchsorted(edges, vectors[:, d], side="right")
            self.cell[d] = cell
            begin = np.searchsorted(x, edges)
            full = np.unique(cell)
            starts = np.concatenate(([0], begin))
            ends = np.concatenate((begin, [n]))
            self.low[d, full], self.high[d, full] = x[starts[full]], x[ends[full] - 1]

    def bounds(self, anchors: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, anchor): the least and the most that the score can be."""
        most = int(np.abs(anchors).max(initial=0)) * int(max(np.abs(self.low).max(initial=0), np.abs(self.high).max(initial=0))) * max(1, anchors.shape[1])
        kind = np.int32 if most < 1 << 31 else np.int64
        lower, upper = (np.zeros((len(rows), len(anchors)), kind) for _ in range(2))
        part = np.empty_like(lower)
        for d, a in enumerate(anchors.T):
            at = self.cell[d, rows].astype(np.intp)
            ends = np.multiply.outer(self.low[d], a).astype(kind), np.multiply.outer(self.high[d], a).astype(kind)
            for total, added in ((lower, np.minimum(*ends)), (upper, np.maximum(*ends))):
                np.take(added, at, axis=0, out=part, mode="clip")
                total += part
        return lower, upper


def integers(vectors: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of each component, those of wild rows as 0; and which rows are wild: their products could leave 64 bits."""
    limit = math.isqrt((1 << 61) // max(1, vectors.shape[1]))
    wild = (np.abs(vectors) * scale >= limit).any(1) if vectors.shape[1] else np.zeros(len(vectors), bool)
    return np.floor(np.where(wild[:, None], 0.0, vectors) * scale).astype(np.int64), wild


def product(a: np.ndarray, b: np.ndarray, scale: int) -> int:
    """The integer inner product of two vectors of any size; what a long can't hold is its end."""
    whole = lambda x: (lambda n, d: n * scale // d)(*float(x).as_integer_ratio())
    return max(-LONG - 1, min(LONG, sum(whole(x) * whole(y) for x, y in zip(a, b))))


def kth(values: np.ndarray, k: int) -> int:
    """The k-th largest, or what is below all if there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -LONG - 1


class Shard:
    """Rows (ids, label, vector) of one shard, to be searched for one block of anchors."""

    def __init__(self, rows: pd.DataFrame, anchors: pd.DataFrame, scale: int):
        stacked = lambda frame: np.stack(frame["v"].to_list()).reshape(len(frame), -1)
        self.scale, self.raw, self.asked = scale, stacked(rows), stacked(anchors)
        self.points, self.wild = integers(self.raw, scale)
        self.queries, self.wild_query = integers(self.asked, scale)
        self.ids, self.own = [np.asarray(x).tolist() for x in rows["ids"]], anchors["id"].to_list()
        names, code = np.unique(np.concatenate([rows["label"].to_numpy(str), anchors["label"].to_numpy(str)]), return_inverse=True)
        self.label, self.asked_label = code[: len(rows)], code[len(rows) :]
        self.file = Approximations(self.points)
        #: Of each id the rows that hold it, for the anchors' own.
        mine = set(self.own)
        self.holds: dict[int, list[int]] = {}
        for i, ids in enumerate(self.ids):
            for x in mine.intersection(ids):
                self.holds.setdefault(x, []).append(i)
        self.scored = 0

    def lots(self, same: bool):
        """(anchor numbers, rows, lower, upper): lots of anchors of one label with the rows of that label, or of all others."""
        tame = np.flatnonzero(~self.wild)
        for c in np.unique(self.asked_label):
            who = np.flatnonzero((self.asked_label == c) & ~self.wild_query)
            rows = tame[(self.label[tame] == c) == same]
            for lo in range(0, len(who), LOT):
                part = who[lo : lo + LOT]
                yield part, rows, *(np.ascontiguousarray(x.T) for x in self.file.bounds(self.queries[part], rows))

    def named(self, i: int, rows: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        """(score, id) of ``rows`` against anchor i, exactly: at least the k best in each window; its own id left out."""
        self.scored += len(rows)
        scores = self.points[rows] @ self.queries[i]
        few, k = np.zeros(len(rows), bool), k + len(self.holds.get(self.own[i], []))
        for least, most in windows:
            here = (scores >= least) & (scores <= most)
            few |= here & (scores >= kth(scores[here], k))
        return [(s, x) for r, s in zip(rows[few].tolist(), scores[few].tolist()) for x in self.ids[r] if x != self.own[i]]

    def odd(self, i: int, same: bool) -> list[tuple[int, int]]:
        """(score, id) where anchor i or the row is wild: too large for bounds, few, and scored one by one."""
        rows = np.arange(len(self.ids)) if self.wild_query[i] else np.flatnonzero(self.wild)
        rows = rows[(self.label[rows] == self.asked_label[i]) == same]
        return [(s, x) for r in rows.tolist() for s in [product(self.raw[r], self.asked[i], self.scale)] for x in self.ids[r] if x != self.own[i]]

    def positives(self, k: int):
        """(anchor number, score, id): the k best rows of the anchor's label here."""
        found: dict[int, list[tuple[int, int]]] = {}
        for part, rows, lower, upper in self.lots(True):
            place = np.full(len(self.ids), -1)
            place[rows] = np.arange(len(rows))
            for j, i in enumerate(part.tolist()):
                sure = lower[j]
                if mine := [p for r in self.holds.get(self.own[i], []) if (p := place[r]) >= 0]:
                    sure = np.delete(sure, mine)  # the anchor itself is no rival
                found[i] = self.named(i, rows[upper[j] >= kth(sure, k)], [(-LONG - 1, LONG)], k)
        for i in range(len(self.own)):
            best = sorted(found.get(i, []) + self.odd(i, True), key=lambda p: (-p[0], p[1]))[:k]
            yield from ((i, s, x) for s, x in best)

    def negatives(self, windows: list[list[tuple[int, int]]], k: int):
        """(anchor number, window number, score, id): the k best rows of other labels whose score lies in each of the anchor's windows (least, most)."""
        found: dict[int, list[tuple[int, int]]] = {}
        for part, rows, lower, upper in self.lots(False):
            held = {r for i in part.tolist() for r in self.holds.get(self.own[i], [])}
            safe = np.array([r not in held for r in rows.tolist()], bool) if held else np.ones(len(rows), bool)
            for j, i in enumerate(part.tolist()):
                low, high = lower[j], upper[j]
                wanted = np.zeros(len(rows), bool)
                for least, most in windows[i]:
                    may = (low <= most) & (high >= least)
                    sure = may & (high <= most) & (low >= least) & safe
                    wanted |= may & (high >= kth(low[sure], k))
                found[i] = self.named(i, rows[wanted], windows[i], k)
        for i in range(len(self.own)):
            best = found.get(i, []) + self.odd(i, False)
            best.sort(key=lambda p: (-p[0], p[1]))
            for w, (least, most) in enumerate(windows[i]):
                yield from ((i, w, s, x) for s, x in [p for p in best if least <= p[0] <= most][:k])


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and most n with low * score <= 100 * n <= high * score."""
    return -(-low * score // 100), high * score // 100


def mine(rows: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str | Column = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A component x counts as floor(scale * x), a score is the integer inner product with the
    anchor, higher ones first, ties by smaller id. Positives are the anchor's first rows of
    its label; of each, the first rows of other labels with a score between ``low`` and
    ``high`` per cent of the positive's.

    Rows with a null id, label or vector, or a null or non-finite component, take no part.
    Vectors meet those of their own length only; an empty one scores 0. Equal rows count
    once; other rows that share an id are each a row, and each an anchor if that id is; a row
    with the anchor's id is never its positive or negative. Scores beyond a long count as its
    end. Further columns, whatever their names, take no part; an empty table gives no rows.
    """
    kind = F.col(label) if isinstance(label, str) else label
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    base = rows.select(F.col(vec_id).cast("long").alias("id"), kind.cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asked"))
    base = base.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(finite)
    # -0.0 is 0.0; of rows with one label and vector no result names more than its best few ids and the anchor's own
    base = base.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("dim", F.size("v"))
    nth = Window.partitionBy("label", "v").orderBy("id")
    distinct = base.groupBy("id", "label", "v", "dim").agg(F.max("asked").alias("asked"))
    base = written(distinct.withColumn("anchor", F.monotonically_increasing_id()))
    few = base.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= max(positives, negatives) + 1)
    points = written(few.groupBy("label", "v", "dim").agg(F.collect_list("id").alias("ids")).withColumn("h", F.xxhash64("label", "v")))
    n, m = points.count(), base.where("asked").count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-m // BLOCK))
    own = points.select("ids", "label", "v", "dim", F.pmod("h", F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = base.where("asked").select("anchor", "id", "label", "v", "dim", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    keys = ["dim", "shard", "block"]
    best = lambda df, by, score, other, k: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), other))).where(F.col("rank") <= k)

    def near(points_: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        found = Shard(points_, anchors, scale).positives(positives) if len(points_) and len(anchors) else []
        out = pd.DataFrame(found, columns=["anchor", "positive_score", "positive_id"], dtype="int64")
        return out.assign(anchor=anchors["anchor"].to_numpy()[out["anchor"]] if len(out) else out["anchor"])

    def hard(points_: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        columns = ["anchor", "positive_id", "positive_score", "negative_id", "negative_score"]
        if not len(points_) or not len(anchors):
            return pd.DataFrame(columns=columns, dtype="int64")
        number, ids, scores = (anchors[c].to_list() for c in ("anchor", "positive_id", "positive_score"))
        windows = [[window(int(p), low, high) for p in own] for own in scores]
        found = [(number[i], ids[i][w], scores[i][w], x, s) for i, w, s, x in Shard(points_, anchors, scale).negatives(windows, negatives)]
        return pd.DataFrame(found, columns=columns, dtype="int64")

    def together(anchors: DataFrame, run, schema: str) -> DataFrame:
        return own.groupBy(*keys).cogroup(anchors.groupBy(*keys)).applyInPandas(run, schema)

    first = best(together(asked, near, "anchor long, positive_score long, positive_id long"), ["anchor"], "positive_score", "positive_id", positives)
    chosen = written(first.groupBy("anchor").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("p")).select("anchor", "p.positive_id", "p.positive_score"))
    found = together(asked.join(chosen, "anchor"), hard, "anchor long, positive_id long, positive_score long, negative_id long, negative_score long")
    ranked = best(found, ["anchor", "positive_id"], "negative_score", "negative_id", negatives)
    return ranked.join(base.select("anchor", F.col("id").alias("anchor_id")), "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def of_embeddings(rows: DataFrame) -> DataFrame:
    """The registered mining: every 50th row an anchor, and every seventh row with a label that is one off."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, F.col("vec_id") % 50 == 0, label=label)


SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY rank <= 3
"""


by_value(__name__)
