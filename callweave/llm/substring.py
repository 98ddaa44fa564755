"""Passage deduplication with a log-structured fingerprint index.

Two documents that share a window of ``window`` words share the smallest hash among the
window's half-length word grams. Those smallest hashes (about one for 13 words) are a
document's anchors. The index keeps them as sorted immutable runs, tables bucketed by hash;
each new batch of documents is merge-joined with every run, bucket by bucket without an
exchange, its hits noted, and its own run added; two runs of one level are compacted into one
of the next, so there are as many as the logarithm of the batches. Only texts that hold an
anchor known from another document, of this call or an earlier one with the same index, are
read again; there every window that contains such an anchor is hashed to 128 bits and matched
word run for word run through that hash, which verifies the hit.

Exact copies are settled before: of texts with equal words only the smallest id takes part.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import by_value, cut, maybe_broadcast, written

WINDOW = 50
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
MOST_WORDS_KEPT = 400_000


class Memo(dict):
    """Word hashes, computed once a word; bounded by :func:`hashes`."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word, 7)
        return value


def hashes(memo: Memo, words: list[bytes]) -> np.ndarray:
    if len(memo) > MOST_WORDS_KEPT:
        memo.clear()
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
    up[1:], down[1:] = base, pow(base, -1, 1 << 64)
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def rolling(w: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of every run of k words."""
    if len(w) < k:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(w))
    s = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w * up[: len(w)], dtype=np.uint64)))
    return mixed((s[k:] - s[:-k]) * down[: len(w) - k + 1])


def anchors(w: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram hashes of half the window's length, and the smallest of each window's grams."""
    k = max(1, window // 2)
    g = rolling(w, k, BASES[0])
    span = window - k + 1
    if len(g) < span:
        return g, g[:0]
    m, size = g, 1
    while 2 * size <= span:
        m, size = np.minimum(m[:-size], m[size:]), 2 * size
    return g, np.minimum(m[: len(g) - span + 1], m[span - size : span - size + len(g) - span + 1])


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def short(sha: str) -> int:
    """The first 63 bits of a digest: with the id it names one text, and is narrower in a shuffle."""
    return int(sha[:16], 16) >> 1


def _raw(column) -> list[bytes]:
    return [v or b"" for v in column.cast(pa.large_binary()).to_pylist()]


def _first(window: int):
    """A row for each document, then one for each of its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            ids = batch.column(0)
            n_words, shas, of, found, sigs = [], [], [], [], []
            for i, raw in enumerate(_raw(batch.column(1))):
                words = raw.split()
                n_words.append(len(words))
                shas.append(digest(words))
                sigs.append(short(shas[-1]))
                if len(words) >= window:
                    own = np.unique(anchors(hashes(memo, words), window)[1])
                    found.append(own)
                    of.append(np.full(len(own), i))
            n = len(n_words)
            sig = pa.array(sigs, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), ids, sig, pa.array(n_words, pa.int64()), pa.array(shas, pa.string())], ["h", "doc_id", "sig", "n_words", "sha"])
            if found:
                h, at = np.concatenate(found), pa.array(np.concatenate(of))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), ids.take(at), sig.take(at), pa.nulls(len(h), pa.int64()), pa.nulls(len(h), pa.string())], ["h", "doc_id", "sig", "n_words", "sha"])

    return run


def _windows(window: int):
    """128-bit hashes of the windows around the shared anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        k = max(1, window // 2)
        for batch in batches:
            ids, known = batch.column(0), batch.column(2).to_pylist()
            for i, raw in enumerate(_raw(batch.column(1))):
                words = raw.split()
                w = hashes(memo, words)
                g, _ = anchors(w, window)
                at = np.flatnonzero(np.isin(g, np.array(known[i], np.int64).view(np.uint64)))
                mark = np.zeros(len(w) + 2, np.int64)
                np.add.at(mark, np.maximum(at - (window - k), 0), 1)
                np.add.at(mark, at + 1, -1)
                start = np.flatnonzero(np.cumsum(mark)[: max(0, len(w) - window + 1)] > 0)
                if len(start):
                    n = len(start)
                    h1, h2 = rolling(w, window, BASES[0])[start], rolling(mixed(w + np.uint64(1)), window, BASES[1])[start]
                    yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), ids.slice(i, 1).take(pa.array(np.zeros(n, np.int64))), pa.array(np.full(n, short(digest(words)))), pa.array(start.astype(np.int32))], ["h1", "h2", "doc_id", "sig", "start"])

    return run


def _strip(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas, before, texts = [], [], [], []
            for raw, starts in zip(_raw(batch.column(1)), batch.column(2).to_pylist()):
                words = raw.split()
                mark = np.zeros(len(words) + 1, np.int64)
                np.add.at(mark, starts, 1)
                np.add.at(mark, np.minimum(np.array(starts) + window, len(words)), -1)
                gone = np.cumsum(mark)[:-1] > 0
                kept = [w for w, x in zip(words, gone.tolist()) if not x]
                removed.append(int(gone.sum()))
                before.append(short(digest(words)))
                shas.append(digest(kept))
                texts.append(b" ".join(kept).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(before, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())], ["doc_id", "sig", "n_removed", "kept_sha256", "kept_text"])

    return run


class RunIndex:
    """Sorted immutable runs of (anchor hash, smallest and largest doc_id), and where the documents they come from are.

    A run is a table in the session's warehouse, in ``buckets`` buckets by hash. The
    documents themselves are not copied: :func:`dedup` reads those of earlier calls again
    from their own tables, which must still be there.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark = spark
        # as many as an aggregation has partitions, so that each bucket is written by one task
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str]] = []
        self.marks: list[DataFrame] = []
        self.texts: list[DataFrame] = []

    def _write(self, run: DataFrame) -> str:
        name = f"callweave_run_{uuid.uuid4().hex}"
        run.write.bucketBy(self.buckets, "h").sortBy("h").format("parquet").saveAsTable(name)
        return name

    def add(self, batch: DataFrame) -> DataFrame:
        """Merge-join the batch (h, doc_id) with the runs; returns the hashes it shares with other documents, old or new."""
        new = self._write(batch.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")))
        own = self.spark.table(new)
        hits = own.where("lo < hi").select("h")
        for _, run in self.runs:
            hits = hits.unionAll(own.select("h").join(self.spark.table(run).select("h"), "h", "left_semi"))
        hits = cut(hits.distinct())
        level = 0
        while same := [r for at, r in self.runs if at == level]:
            both = self.spark.table(new).unionAll(self.spark.table(same[0]))
            merged = self._write(both.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
            for old in (new, same[0]):
                self.spark.sql(f"DROP TABLE {old}")
            self.runs.remove((level, same[0]))
            new, level = merged, level + 1
        self.runs.append((level, new))
        return hits

    def drop(self) -> None:
        for _, run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        self.runs, self.marks, self.texts = [], [], []


#: A window hash of so many rows is matched apart, lest its rows meet in one task.
HOT = 2048


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, batches: int = 2, index: RunIndex | None = None) -> DataFrame:
    """Remove each word covered by a window of words that also starts in a document with a smaller id.

    Returns (doc_id, n_words, n_removed, kept_sha256). Null text has no words. A document
    with a null id is kept whole and takes nothing from others; rows that repeat an id with
    another text are judged each by itself, equal rows alike; ids may be texts; a very long
    text is read as a whole; further columns take no part; an empty table gives no rows. The
    documents enter ``index`` in ``batches``. With the index of earlier calls their documents
    count as well, but are not judged again.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = written(docs.mapInArrow(_first(window), f"h long, doc_id {kind}, sig long, n_words long, sha string"))
    rows = seen.where("h IS NULL").select("doc_id", "sig", "n_words", "sha")
    first = rows.groupBy("sha").agg(F.min("doc_id").alias("first"))
    judged = cut(rows.join(first, "sha"))
    # anchors of later exact copies need no look: the copy goes as a whole
    copies = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= window)
    marks = seen.where("h IS NOT NULL AND doc_id IS NOT NULL").select("h", "doc_id", "sig")
    marks = marks.join(maybe_broadcast(cut(judged.where(copies).select("doc_id", "sig").distinct())), ["doc_id", "sig"], "left_anti").select("h", "doc_id")
    held = index or RunIndex(docs.sparkSession)
    hits = None
    for i in range(batches):
        new = held.add(marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i))
        hits = new if hits is None else hits.unionAll(new)
    every, texts = marks, docs
    for old in held.marks:
        every = every.unionAll(old)
    for old in held.texts:
        texts = texts.unionAll(old)
    if index is None:
        held.drop()
    else:
        held.marks.append(marks)
        held.texts.append(docs)
    shared = every.join(maybe_broadcast(cut(hits.distinct())), "h", "left_semi").groupBy("doc_id").agg(F.collect_set("h").alias("known"))  # no longer than the document
    again = written(texts.join(shared, "doc_id").select("doc_id", "text", "known"))
    windows = written(again.mapInArrow(_windows(window), f"h1 long, h2 long, doc_id {kind}, sig long, start int"))
    least = cut(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("least < last").drop("last"))
    hot = least.where(F.col("n") >= HOT)
    few = windows.join(maybe_broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti").join(least.where(F.col("n") < HOT), ["h1", "h2"])
    late = windows.join(maybe_broadcast(hot), ["h1", "h2"]).unionByName(few).where("doc_id > least")
    gone = late.groupBy("doc_id", "sig").agg(F.collect_set("start").alias("starts")).select(F.col("doc_id").alias("_d"), F.col("sig").alias("_s"), "starts")
    own = F.sha2(F.array_join(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""), " "), 256)
    of = F.shiftrightunsigned(F.conv(F.substring(own, 1, 16), 16, -10).cast("long"), 1)
    found = again.select("doc_id", "text").distinct()
    stripped = found.join(gone, F.col("doc_id") == F.col("_d")).where(of == F.col("_s")).select("doc_id", "text", "starts").mapInArrow(_strip(window), f"doc_id {kind}, sig long, n_removed long, kept_sha256 string, kept_text string")
    stripped = stripped.drop("kept_text").withColumnsRenamed({"doc_id": "_d", "sig": "_s"})
    none = hashlib.sha256(b"").hexdigest()
    out = judged.join(stripped, (F.col("doc_id") == F.col("_d")) & (F.col("sig") == F.col("_s")), "left")
    return out.select("doc_id", "n_words", F.when(copies, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), F.when(copies, F.lit(none)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT doc_id, unnest([md5(array_to_string(w[s:s + 49], ' ')) FOR s IN range(1, len(w) - 48)]) AS h, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50),
b AS (SELECT doc_id, s FROM h JOIN (SELECT h, min(doc_id) AS least FROM h GROUP BY h) m USING (h) WHERE least < doc_id),
w AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
c AS (SELECT w.doc_id, i, word, coalesce(i - max(s) OVER (PARTITION BY w.doc_id ORDER BY i) <= 49, false) AS gone FROM w LEFT JOIN b ON b.doc_id = w.doc_id AND s = i),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""


by_value(__name__)
