"""Sharding by best-fit-decreasing bin packing.

Indivisible groups, largest first, enter the shard with the tightest remaining capacity
that still holds them; a balanced tree over the remaining capacities finds it. The driver
packs classes, not groups: groups of one size class are alike, so a class enters a shard
as a run of ranks. Classes up to ``EXACT`` bytes are exact sizes; above that a class keeps
the size's leading bits and is packed at its upper bound (less than a 1,024th above the
size, so it is best fit on sizes rounded up by 0.1 %), so a shard never overflows and
the number of classes is bounded (about ``EXACT`` times 50) whatever the table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import by_value, cut, gapless, maybe_broadcast, without

BITS = 11
EXACT = 1 << BITS
RANK_BUCKETS = 64
#: A group of so many rows is joined by broadcast.
MANY = 1024


class Tree:
    """An AA tree of (remaining capacity, shard): ordered, balanced by level, smallest entry not below a key in O(log n)."""

    class Node:
        __slots__ = ("key", "level", "left", "right")

        def __init__(self, key):
            self.key, self.level, self.left, self.right = key, 1, None, None

    def __init__(self):
        self.root = None

    @staticmethod
    def _skew(t):
        if t and t.left and t.left.level == t.level:
            low = t.left
            t.left, low.right = low.right, t
            return low
        return t

    @staticmethod
    def _split(t):
        if t and t.right and t.right.right and t.right.right.level == t.level:
            high = t.right
            t.right, high.left = high.left, t
            high.level += 1
            return high
        return t

    def add(self, key) -> None:
        def put(t):
            if t is None:
                return Tree.Node(key)
            if key < t.key:
                t.left = put(t.left)
            else:
                t.right = put(t.right)
            return self._split(self._skew(t))

        self.root = put(self.root)

    def remove(self, key) -> None:
        def cut_(t, key):
            if t is None:
                return None
            if key < t.key:
                t.left = cut_(t.left, key)
            elif key > t.key:
                t.right = cut_(t.right, key)
            elif t.left is None:
                return t.right
            elif t.right is None:
                return t.left
            else:
                last = t.left
                while last.right:
                    last = last.right
                t.key = last.key
                t.left = cut_(t.left, last.key)
            low = min(t.left.level if t.left else 0, t.right.level if t.right else 0) + 1
            if low < t.level:
                t.level = low
                if t.right and t.right.level > low:
                    t.right.level = low
            t = self._skew(t)
            if t.right:
                t.right = self._skew(t.right)
                if t.right.right:
                    t.right.right = self._skew(t.right.right)
            t = self._split(t)
            if t.right:
                t.right = self._split(t.right)
            return t

        self.root = cut_(self.root, key)

    def at_least(self, size) -> tuple | None:
        t, best = self.root, None
        while t:
            if t.key[0] >= size:
                best, t = t.key, t.left
            else:
                t = t.right
        return best


@dataclass
class Packed:
    """Runs: for each class, consecutive ranks [first, last] and the shard they enter."""

    capacity: int
    shards: int
    runs: list[tuple[int, int, int, int]] = field(default_factory=list)


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int, most: int | None = None) -> Packed | None:
    """Pack (size, count) classes, given in any order, into shards of ``capacity``; None if more than ``most`` are needed.

    A group larger than the capacity gets a shard of its own.
    """
    tree, out = Tree(), Packed(capacity, 0)
    for size, count in sorted(classes, reverse=True):
        rank = 0
        while rank < count:
            hit = tree.at_least(size)
            if hit is None:
                if most is not None and out.shards >= most:
                    return None
                hit = (max(capacity, size), out.shards)
                out.shards += 1
            else:
                tree.remove(hit)
            take = min(count - rank, hit[0] // size if size else count - rank)
            out.runs.append((size, rank, rank + take - 1, hit[1]))
            tree.add((hit[0] - take * size, hit[1]))
            rank += take
    return out


def into(classes: list[tuple[int, int]], shards: int) -> Packed:
    """The packing into at most ``shards`` shards with about the smallest capacity that allows it.

    A group larger than a fair share gets a shard of its own; the rest share the others.
    """
    classes = sorted(((s, n) for s, n in classes if n), reverse=True)
    alone: list[tuple[int, int]] = []
    left = shards
    while classes and left > 1 and classes[0][0] * left > sum(s * n for s, n in classes):
        size, n = classes[0]
        alone.append((size, len(alone)))
        classes = ([(size, n - 1)] if n > 1 else []) + classes[1:]
        left -= 1
    total = sum(s * n for s, n in classes)
    low = max(-(-total // left), classes[0][0]) if classes else 0
    step, packed = 1, best_fit_decreasing(classes, low, left)
    while packed is None:
        packed = best_fit_decreasing(classes, low + max(step, low * step // 4096), left)
        step *= 2
    ranks: dict[int, int] = {}
    for size, k in alone:
        packed.runs.append((size, ranks.get(size, 0), ranks.get(size, 0), shards - 1 - k))
        ranks[size] = ranks.get(size, 0) + 1
    packed.runs = [(s, a + ranks[s], b + ranks[s], k) if s in ranks and k < left else (s, a, b, k) for s, a, b, k in packed.runs]
    return packed


def size_class(size: Column) -> Column:
    """The smallest number with at most BITS leading bits that is not below ``size``."""
    unit = F.greatest(F.lit(0), F.length(F.bin(size)) - BITS)
    step = F.pow(F.lit(2.0), unit).cast("long")
    return (F.ceil(size / step) * step).cast("long")


def shard_groups(rows: DataFrame, group: str, size: str, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """Add ``shard`` and ``slot`` to ``rows`` so that rows of one ``group`` share a shard.

    Give ``capacity`` for as few shards of that size as best-fit-decreasing finds, or
    ``shards`` for that many of near equal size. ``size`` is a non-null integer; null groups
    are one group, and so are rows that repeat; ties of size go in the order of classes, so
    reruns agree; a very long text is one size like any other. Slots number a shard's rows from 0 without gaps. Columns of these names
    in the input are replaced, all others are kept. An empty table gives no rows.
    """
    rows = without(rows, ["shard", "slot", "_class", "_rank", "_large"])
    groups = cut(rows.groupBy(F.col(group).alias("_g")).agg(F.sum(size).alias("_size"), F.count("*").alias("_n")).withColumn("_class", size_class(F.col("_size"))))
    histogram = [(r["_class"], r["n"]) for r in groups.groupBy("_class").agg(F.count("*").alias("n")).collect()]  # bounded by the number of classes
    packed = into(histogram, shards) if capacity is None else best_fit_decreasing(histogram, capacity)
    spark = rows.sparkSession
    runs = spark.createDataFrame(packed.runs or [(0, 0, -1, 0)], "_c long, _first long, _last long, shard int")
    ranked = gapless(groups, "_class", "_rank", ["_g"], RANK_BUCKETS)
    inside = (F.col("_class") == F.col("_c")) & F.col("_rank").between(F.col("_first"), F.col("_last"))
    placed = cut(ranked.join(F.broadcast(runs), inside).select("_g", "_n", "shard"))  # runs: at most classes plus shards
    # the rows of a large group would meet in one task; there are few such groups, so they are sent to the rows
    same, many = F.col(group).eqNullSafe(F.col("_g")), maybe_broadcast(placed.where(F.col("_n") >= MANY).select("_g", F.col("shard").alias("_large")))
    marked = rows.join(many, same, "left").drop("_g")
    large = marked.where("_large IS NOT NULL").withColumnRenamed("_large", "shard")
    others = marked.where("_large IS NULL").drop("_large").join(placed.where(F.col("_n") < MANY).select("_g", "shard"), same).drop("_g")
    dealt = cut(large.unionByName(others))
    key = [c for c in dealt.columns if c != "shard"]
    return gapless(dealt, "shard", "slot", key)


by_value(__name__)
