"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations of [0, 2^22) make a whole signature. The first scatters the shingle hashes;
coordinate k of a signature is the least value of the second, shifted circularly by k, over
the scattered set. The shifts are a sliding window over one table, so all coordinates of a
shingle are one contiguous read. ``BANDS`` bands of ``ROWS`` coordinates are the keys: of
pairs at a similarity of 0.85, all but one in 100,000 share one.

Equal texts are one class. Buckets of at most ``SMALL`` classes give all their pairs; larger
ones give each class with the bucket's first. Those pairs are verified on whole shingle sets.
What is then still apart in a large bucket is compared exactly as well, in pairs of chunks of
bounded size: a chunk pair is one task's work and emits a spanning forest of the links that it
finds, never its pairs. So a bucket of any size is settled, by as many tasks as it needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import WORD, by_value, cut, maybe_broadcast, slices, written
from .simhash import shingles

SEED = 42
DOMAIN_BITS = 22
BANDS, ROWS = 20, 5
SMALL = 8
#: Classes and bytes of shingle sets in a chunk of a large bucket.
CHUNK, CHUNK_BYTES = 2048, 16_000_000


class Circulant:
    """Signatures of sets of 64-bit hashes: ``size`` coordinates from two permutations of [0, 2^bits)."""

    def __init__(self, size: int = BANDS * ROWS, bits: int = DOMAIN_BITS, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.bits, self.size = bits, size
        self.factor, self.offset = int(r.integers(0, 1 << bits)) | 1, int(r.integers(0, 1 << bits))
        second = r.permutation(1 << bits).astype(np.uint32)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: size - 1]]), size)

    def first(self, x: np.ndarray) -> np.ndarray:
        """The first permutation: steps that can each be undone, modulo 2^bits."""
        low, half = (1 << self.bits) - 1, self.bits // 2
        x = (x.astype(np.int64) ^ self.offset) * self.factor & low
        x = (x ^ x >> half) * self.factor & low
        return x ^ x >> half

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        at = self.first(hashes & np.uint64((1 << self.bits) - 1))
        least = np.full(self.size, np.iinfo(np.uint32).max, np.uint32)
        for lo in range(0, len(at), 1024):
            np.minimum(least, self.shifted[at[lo : lo + 1024]].min(0), out=least)
        return least

    def keys(self, hashes: np.ndarray, bands: int = BANDS) -> np.ndarray:
        """A key for each band, of all its coordinates and its number."""
        key = np.arange(1, bands + 1, dtype=np.uint64)
        for row in self.signature(hashes).reshape(bands, -1).T.astype(np.uint64):
            key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
            key = key ^ key >> np.uint64(29)
        return key


def _sketched(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, digest, n, keys) of (doc_id, digest, text): the size of the shingle set and its band keys, none for an empty set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circulant = Circulant(bands * rows)
        known: dict[bytes, tuple[int, np.ndarray]] = {}
        for batch in slices(batches):
            if len(known) > 4096:
                known.clear()
            n, keys = [], []
            for digest, raw in zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()).to_pylist()):
                if digest not in known:
                    h = np.unique(shingles(raw or b"", shingle))
                    known[digest] = len(h), circulant.keys(h, bands) if len(h) else np.zeros(0, np.uint64)
                n.append(known[digest][0])
                keys.append(known[digest][1])
            ends = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
            flat = np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["doc_id", "digest", "n", "keys"])

    return docs.mapInArrow(run, f"doc_id {kind}, digest binary, n long, keys array<long>")


def _sets(nodes: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(node, own) of the asked ``nodes``: the sorted shingle hashes as 8 bytes each."""
    asked = classes.join(maybe_broadcast(nodes), "node", "left_semi").select("digest", "node")
    found = texts.join(maybe_broadcast(asked), "digest").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [np.unique(shingles(raw or b"", shingle)).tobytes() for raw in batch.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["node", "own"])

    # copies of a text are one class; any of them gives its set
    return written(found.dropDuplicates(["node"]).mapInArrow(run, "node long, own binary"))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the ``pairs`` (u, v) with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            same = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                same.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield batch.select([0, 1]).filter(pa.array(same, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("own").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("own").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def forest(sets: list[np.ndarray], component: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (row, row) between the rows ``left`` and ``right``, enough to connect what they connect; rows of one component need none."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    pieces = [flat[a:b] for a, b in zip(starts[:-1], starts[1:])]
    there = np.concatenate([pieces[j] for j in right.tolist()])
    begin = np.concatenate(([0], np.cumsum(sizes[right])))[:-1]
    label, out = component.copy(), []
    held = np.zeros(int(flat.max()) + 1, np.int32)
    for i in left.tolist():
        if not (label[right] != label[i]).any():
            continue
        held[pieces[i]] = 1
        shared = np.add.reduceat(held[there], begin)
        held[pieces[i]] = 0
        union = sizes[i] + sizes[right] - shared
        for j in right[(100 * shared >= percent * union) & (label[right] != label[i])].tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _settled(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between the rows of one key in ``apart`` (key, node, component, chunks); each pair of chunks by itself."""
    mine = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = apart.withColumn("chunk", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)))
    dealt = dealt.select("node", "component", "chunk", "key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")).join(sets, "node")

    def run(group: pa.Table) -> pa.Table:
        nodes, component, chunk = (group.column(c).to_numpy() for c in ("node", "component", "chunk"))
        low, high = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        rows = [np.frombuffer(x, np.uint64) for x in group.column("own").to_pylist()]
        left, right = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
        found = forest(rows, component, left, right, percent) if len(left) and len(right) else []
        u, v = (nodes[[x[k] for x in found]] if found else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, percent: int = 85, bands: int = BANDS, rows: int = ROWS, blank_alike: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): component_id is the smallest doc_id that links reach, kept says that it is the document's own.

    A link is 100 * intersection >= percent * union of the sets of shingles of lower-cased
    (A-Z) words; a text of fewer words than a shingle is one shingle. Null, empty and blank
    texts have none and are linked with nothing, not even with each other. Null ids are
    linked like others but name a component, and are kept, only where all its ids are null.
    Rows that repeat an id, with the same text or another, are judged each by itself;
    very long texts are read as a whole; further columns, whatever their names, take no
    part; an empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    if blank_alike:
        body = F.when(body.rlike(WORD), body).otherwise("")
    texts = docs.select(F.unhex(F.md5(body)).alias("digest"), body.alias("text"))
    found = written(_sketched(docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.md5(body)).alias("digest"), body.alias("text")), shingle, bands, rows))
    filled = found if blank_alike else found.where("n > 0")
    least = filled.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    sketch = filled.dropDuplicates(["digest"]).select("digest", "n", "keys")
    # numbers hold once they are written
    classes = written(least.join(sketch, "digest").withColumn("node", F.monotonically_increasing_id()))
    keyed = classes.select("node", "n", F.explode("keys").alias("key"))
    buckets = written(keyed.groupBy("key").agg(F.min("node").alias("first"), F.min_by("n", "node").alias("first_n"), F.count("*").alias("size")).where("size > 1"))
    shared = written(keyed.join(maybe_broadcast(buckets), "key"))
    alike = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    star = shared.where((F.col("size") > SMALL) & (F.col("node") != F.col("first")) & alike("n", "first_n")).select(F.col("first").alias("u"), F.col("node").alias("v"))
    few = shared.where(F.col("size") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("own"))
    pairs = few.select("own", F.posexplode("own").alias("at", "a")).select("a", F.explode(F.slice("own", F.col("at") + 2, F.lit(SMALL))).alias("b")).where(alike("a.n", "b.n"))
    pairs = written(pairs.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).unionAll(star).distinct())
    sets = _sets(pairs.select(F.col("u").alias("node")).unionAll(pairs.select("v")).distinct(), classes, texts, shingle)
    links = cut(_linked(pairs, sets, percent))
    labels = cut(components(links))
    # the first of a bucket has met all others
    rest = shared.where((F.col("size") > SMALL) & (F.col("node") != F.col("first"))).select("key", "node", "n").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rest = written(rest)
    chunks = F.ceil(F.greatest(F.col("rows") / CHUNK, 8 * F.col("bytes") / CHUNK_BYTES)).cast("long")
    open_ = rest.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("rows"), F.sum("n").alias("bytes")).where("low < high").select("key", chunks.alias("chunks"))
    apart = written(rest.join(maybe_broadcast(written(open_)), "key").select("key", "node", "component", "chunks"))
    if not apart.isEmpty():
        more = cut(_settled(apart, _sets(apart.select("node").distinct(), classes, texts, shingle), percent))
        if not more.isEmpty():
            labels = cut(components(links.unionAll(more)))
    named = classes.select("digest", "node", "least", "copies").join(labels, "node", "left").where("copies > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "node"))
    ends = named.groupBy("component").agg(F.min("least").alias("component_id"))
    moved = written(named.join(ends, "component").select("digest", "component_id", F.lit(True).alias("grouped")))
    out = found.select("doc_id", "digest", "n").join(maybe_broadcast(moved), "digest", "left")
    component = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


by_value(__name__)
