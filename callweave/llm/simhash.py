"""Near duplicates by SimHash and Golay-code fuzzy hashing.

A fingerprint bit is 1 where over half of a text's shingle hashes have it set. The binary
Golay code (23, 12) is perfect: every 23-bit word is within 3 bits of exactly one codeword
and within 4 bits of one to six. Two words that differ in at most one bit therefore share a
codeword when each is keyed by all its codewords within 4 bits.

``links``: 64 bits are four blocks of 16. At most 3 differing bits leave one block equal,
and, of the two Golay words in the other 48 bits, one with at most one differing bit. So a
key is (block, its value, word, codeword index): 28 bits of selectivity, about 43 keys a
fingerprint, and no link is missed.

Fingerprints are made distinct first. A bucket emits a spanning forest of its links, found
by breadth-first search, never all its pairs; components are then joined across buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import by_value, cut

SEED = 42
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the generator of the cyclic Golay code.
GENERATOR = 0xAE3
WORD_BITS, DATA_BITS, CHECK_BITS = 23, 12, 11
LOW23 = np.uint64((1 << WORD_BITS) - 1)
SMALL = 8


def _syndrome(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.uint64)
    for bit in range(WORD_BITS - 1, CHECK_BITS - 1, -1):
        rest = np.where(rest >> np.uint64(bit) & np.uint64(1), rest ^ np.uint64(GENERATOR << (bit - CHECK_BITS)), rest)
    return rest.astype(np.int64)


def decoding() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the error patterns of weight 4 or less that lead to a codeword, padded with -1, and how many."""
    from itertools import combinations

    patterns = np.array([sum(1 << b for b in c) for w in range(5) for c in combinations(range(WORD_BITS), w)], dtype=np.uint64)
    syndromes = _syndrome(patterns)
    out, n = np.full((1 << CHECK_BITS, 6), -1, np.int64), np.zeros(1 << CHECK_BITS, np.int64)
    for pattern, s in zip(patterns.tolist(), syndromes.tolist()):
        out[s, n[s]] = pattern
        n[s] += 1
    return out, n


def codewords(words: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index) for every codeword within 4 bits of each 23-bit word."""
    errors = table[0][_syndrome(words)]
    row, k = np.nonzero(errors >= 0)
    return row, (words[row] ^ errors[row, k].astype(np.uint64)) >> np.uint64(CHECK_BITS)


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``shingle`` words; a shorter text is one run, a blank one has none."""
    own = text.lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    n = max(1, len(own) - shingle + 1)
    joined = b" ".join(own)
    size = np.fromiter(map(len, own), np.int64, len(own))
    begin = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    ends = (begin + size)[min(shingle, len(own)) - 1 :].tolist()
    hash_ = xxhash.xxh64_intdigest
    return np.array([hash_(joined[a:b], SEED) for a, b in zip(begin[:n].tolist(), ends)], dtype=np.uint64)


def fingerprint(text: bytes, shingle: int, words: int) -> list[int]:
    """``words`` 64-bit fingerprint words of a text: the first from XXH64 (seed 42), others from XXH64 of further seeds of the same shingles."""
    h = shingles(text, shingle)
    n, out = len(h), []
    if not n:
        return [0] * words
    for w in range(words):
        if w:  # splitmix64 of the first hash
            h = h + np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
        octets = h.view(np.uint8).reshape(-1, 8)
        ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ BITS for i in range(8)])
        out.append(int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little"))
    return out


#: Bit values of each octet, lowest bit first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, words: int = 1) -> DataFrame:
    """(doc_id, f0, f1): fingerprints as signed longs; f1 is 0 for one word.

    Null or blank text: zero. Null ids and repeated rows are kept, equal texts alike; a very
    long text is read as a whole; further columns take no part; an empty table gives no rows.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("f0", T.LongType()), T.StructField("f1", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).cast(pa.large_binary()).to_pylist()
            found = np.array([fingerprint(v or b"", shingle, words) for v in raw], dtype=np.uint64).reshape(len(raw), words)
            f = np.zeros((len(raw), 2), np.uint64)
            f[:, :words] = found
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(f[:, i]).view(np.int64)) for i in (0, 1))], ["doc_id", "f0", "f1"])

    return docs.select(doc_id, text).mapInArrow(run, schema)


def exact_keys(f0: np.ndarray, f1: np.ndarray, table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for block in range(4):
        at = np.uint64(16 * block)
        value = f0 >> at & np.uint64(0xFFFF)
        low = f0 & ((np.uint64(1) << at) - np.uint64(1))
        rest = low | (f0 >> at >> np.uint64(16) << at)
        for word in range(2):
            row, index = codewords(rest >> np.uint64(WORD_BITS * word) & LOW23, table)
            yield row, (np.uint64(2 * block + word) << np.uint64(28)) | value[row] << np.uint64(DATA_BITS) | index


def forest(f0: np.ndarray, f1: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links in one bucket: each found fingerprint and the one that found it."""
    u, v = [], []
    left = np.arange(len(f0))
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            p = front.pop()
            near = np.bitwise_count(f0[left] ^ f0[p]).astype(np.int16) + np.bitwise_count(f1[left] ^ f1[p]) <= most
            found = left[near].tolist()
            u += found
            v += [p] * len(found)
            front += found
            left = left[~near]
    return u, v


def _in_buckets(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def link(key, f0, f1) -> pa.RecordBatch | None:
            new = np.concatenate(([True], key[1:] != key[:-1]))
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(key)))
            of = np.repeat(size, size)
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in range(1, SMALL):
                i = np.flatnonzero((of[:-k] <= SMALL) & (key[:-k] == key[k:])) if len(key) > k else np.zeros(0, np.int64)
                near = np.bitwise_count(f0[i] ^ f0[i + k]).astype(np.int16) + np.bitwise_count(f1[i] ^ f1[i + k]) <= most
                us.append(i[near])
                vs.append(i[near] + k)
            for s, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
                u, v = forest(f0[s : s + n], f1[s : s + n], most)
                us.append(np.array(u, np.int64) + s)
                vs.append(np.array(v, np.int64) + s)
            u, v = np.concatenate(us), np.concatenate(vs)
            if not len(u):
                return None
            found = np.unique(np.stack([f0[u], f1[u], f0[v], f1[v]], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, i]).view(np.int64)) for i in range(4)], ["a0", "a1", "b0", "b1"])

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            columns = [columns[0], columns[1].view(np.uint64), columns[2].view(np.uint64)]
            if kept:
                columns = [np.concatenate(c) for c in zip(kept, columns)]
            last = np.searchsorted(columns[0], columns[0][-1]) if len(columns[0]) else 0  # sorted by key
            if last and (out := link(*(c[:last] for c in columns))) is not None:
                yield out
            kept = [c[last:] for c in columns]
        if kept and len(kept[0]) and (out := link(*kept)) is not None:
            yield out

    return run


def _links(distinct: DataFrame, keys, most: int) -> DataFrame:
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding()
        for batch in batches:
            f0, f1 = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            for row, key in keys(f0, f1, table):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(f0[row].view(np.int64)), pa.array(f1[row].view(np.int64))], ["key", "f0", "f1"])

    rows = distinct.select("f0", "f1").mapInArrow(expand, "key long, f0 long, f1 long")
    ordered = rows.repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(_in_buckets(most), "a0 long, a1 long, b0 long, b1 long")


def groups(prints: DataFrame, keys=exact_keys, most: int = 3) -> DataFrame:
    """(doc_id, f0, f1, component_id) from fingerprints: component_id is the smallest doc_id that links reach.

    Equal fingerprints are linked. Null ids are kept and never name a component unless all
    its ids are null; repeated rows stay; further columns are kept; an empty table gives no rows.
    """
    prints = cut(prints)
    node = F.xxhash64("f0", "f1")
    distinct = cut(prints.groupBy("f0", "f1").agg(F.min("doc_id").alias("least")).withColumn("node", node))
    edges = _links(distinct, keys, most).select(F.xxhash64("a0", "a1").alias("u"), F.xxhash64("b0", "b1").alias("v"))
    labels = components(edges)
    named = distinct.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.join(least, "component").select(F.col("f0").alias("_f0"), F.col("f1").alias("_f1"), "component_id")
    return prints.join(of, (F.col("f0") == F.col("_f0")) & (F.col("f1") == F.col("_f1"))).drop("_f0", "_f1")


by_value(__name__)
