"""Approximate nearest neighbours by a hash-prefix forest.

Rows are dealt to shards of bounded size. A shard keeps, for each of ``trees`` seeded sets
of random hyperplanes, the sorted array of its vectors' bit strings. A query descends in
every tree to its longest matching prefix, then all trees ascend together, a bit at a time,
and every vector under the common prefix gets a vote for each tree and level. The ascent
ends at the level where the trees meet ``MEET`` times as many entries as there are vectors. Votes tell
near vectors from chance company well, so the few per cent with the most are the candidates.
They are scored by exact cosine in double precision, and the shards' best are merged.

Every row is indexed; copies of a vector are indexed once and expanded by id. Queries visit
the shards in blocks of bounded size, so no task holds more than a block and a shard. Every
query visits every shard, so work grows with queries times shards.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import by_value, cut

TREES, BITS, MEET = 512, 24, 4
SHARD, BLOCK = 16384, 16384
#: Candidates: this share of a shard's distinct vectors, but so many at least.
ENOUGH, LEAST = 0.02, 200
#: Ranges of prefixes up to this length are looked up, not searched.
NEAR_ROOT = 12


class Forest:
    """Of every tree the sorted codes and the vectors they belong to."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 0):
        self.planes = np.random.default_rng(seed).standard_normal((trees, bits, vectors.shape[1])).astype(np.float32)
        self.trees, self.bits, self.n = trees, bits, len(vectors)
        codes = self.codes(vectors)
        order = np.argsort(codes, axis=1, kind="stable")
        self.keys = np.take_along_axis(codes, order, axis=1)
        self.order = order.astype(np.int32).ravel()
        self.top = min(bits, NEAR_ROOT)
        edges = np.arange((1 << self.top) + 1, dtype=np.int32) << (bits - self.top)
        self.starts = np.stack([np.searchsorted(k, edges) for k in self.keys]).astype(np.int32)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        unit = (vectors / np.abs(vectors).max(1, keepdims=True)).astype(np.float32)
        weight = (1 << np.arange(self.bits - 1, -1, -1)).astype(np.float32)  # exact below 2**24
        return np.stack([((unit @ p.T > 0).astype(np.float32) @ weight).astype(np.int32) for p in self.planes])

    def descend(self, codes: np.ndarray) -> np.ndarray:
        """Of each query (column) the longest prefix that any tree matches."""
        near = np.zeros(codes.shape[1], np.int64)
        for own, asked in zip(self.keys, codes):
            at = np.searchsorted(own, asked)
            for i in (np.maximum(at - 1, 0), np.minimum(at, self.n - 1)):
                near = np.maximum(near, self.bits - np.ceil(np.log2((own[i] ^ asked) + 1.0)).astype(np.int64))
        return np.clip(near, 0, self.bits)

    def ranges(self, codes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each tree (row) and query (column) the first entry under the prefix, and the first after it."""
        if level <= self.top:
            low = (codes >> (self.bits - level)) << (self.top - level)
            tree = np.arange(self.trees)[:, None]
            return self.starts[tree, low], self.starts[tree, low + (1 << (self.top - level))]
        low = (codes >> (self.bits - level)) << (self.bits - level)
        return tuple(np.stack([np.searchsorted(k, x) for k, x in zip(self.keys, at)]) for at in (low, low + (1 << (self.bits - level))))

    def candidates(self, codes: np.ndarray, enough: int, meet: float = MEET) -> list[np.ndarray]:
        """For each query the ``enough`` vectors with the most votes, and those that have as many as the last of them."""
        start, n = self.descend(codes), codes.shape[1]
        votes, met = np.zeros((n, self.n), np.int32), np.zeros(n, np.int64)
        base = (np.arange(self.trees) * self.n)[:, None]
        left = np.arange(n)
        # below the directory an entry or two a tree is met: its levels are worth a look only for queries that match so far
        for level in range(int(start.max(initial=0)), -1, -1):  # ascend together
            here = left[start[left] >= level]
            if len(here):
                a, b = self.ranges(codes[:, here], level)
                size, first = b - a, a + base
                for j, i in enumerate(here.tolist()):
                    own = np.flatnonzero(size[:, j])
                    many = size[own, j]
                    ends = np.cumsum(many)
                    if len(ends):
                        entries = np.repeat(first[own, j] - ends + many, many) + np.arange(ends[-1])
                        votes[i] += np.bincount(self.order[entries], minlength=self.n).astype(np.int32)
                        met[i] = ends[-1]
            # each tree may hold the query itself, or a copy
            left = left[met[left] < meet * self.n + self.trees]
            if not len(left):
                break
        if self.n <= enough:
            return [np.arange(self.n)] * n
        least = -np.partition(-votes, enough - 1, axis=1)[:, enough - 1]
        return [np.flatnonzero(v >= max(x, 1)) for v, x in zip(votes, least.tolist())]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors, those with very large or very small components brought near 1 by a power of two, which changes no cosine."""
    most = np.abs(vectors).max(1)
    odd = (most > 1e100) | (most < 1e-100)
    if odd.any():
        vectors = vectors.copy()
        vectors[odd] = np.ldexp(vectors[odd], -np.frexp(most[odd])[1][:, None])
    return vectors


def best(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, share: float, trees: int, bits: int) -> tuple[list[tuple[int, int, float]], int]:
    """(query, vector, cosine): the k nearest of the candidates of each query, ties to the smaller id; and how many vectors were scored."""
    distinct, group = np.unique(points, axis=0, return_inverse=True)
    by = np.lexsort((ids, group.ravel()))
    first = np.concatenate(([0], np.cumsum(np.bincount(group.ravel(), minlength=len(distinct)))))
    vectors, queries = scaled(distinct), scaled(queries)
    norms = np.sqrt((vectors * vectors).sum(1))
    forest = Forest(distinct, trees, bits)
    enough = max(k + 1, LEAST, math.ceil(share * len(distinct)))
    out, scored = [], 0
    for lo in range(0, len(queries), 64):
        part = queries[lo : lo + 64]
        found = forest.candidates(forest.codes(part), enough)
        for q, own, c in zip(part, query_ids[lo : lo + 64].tolist(), found):
            scored += len(c)
            score = (vectors[c] * q).sum(1) / (norms[c] * math.sqrt((q * q).sum()))
            if len(c) > k + 1:  # of equal vectors only the query's own is left out, so k + 1 are enough
                keep = score >= np.partition(score, len(c) - k - 1)[len(c) - k - 1]
                c, score = c[keep], score[keep]
            named = [(-s, i) for g, s in zip(c.tolist(), score.tolist()) for i in ids[by[first[g] : min(first[g + 1], first[g] + k + 1)]].tolist() if i != own]
            out += [(own, i, -s) for s, i in sorted(named)[:k]]
    return out, scored


def usable(vector: Column) -> Column:
    """Neither null nor zero, and every component a finite number."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(rows: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, share: float = ENOUGH, trees: int = TREES, bits: int = BITS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k nearest other rows found.

    Rows with a null id, and null, empty, zero or non-finite vectors, take no part. Vectors
    are compared with those of their own length only. Very large and very small components
    are scaled by a power of two first. A row that repeats the query's id is not its
    neighbour; other rows that repeat an id are found each by itself; ties go to the smaller
    id; further columns, whatever their names, take no part. An empty table gives no rows.
    """
    base = cut(rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v")))
    n, m = base.agg(F.count("*"), F.count_if("q")).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-m // BLOCK))
    points = base.select("id", "v", "dim", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = base.where("q").dropDuplicates(["id"]).select("id", "v", "dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int").alias("block"))

    def search(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        found, _ = best(np.stack(own["v"].to_list()), own["id"].to_numpy(), np.stack(queries["v"].to_list()), queries["id"].to_numpy(), k, share, trees, bits)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["dim", "shard", "block"]
    found = points.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


by_value(__name__)
