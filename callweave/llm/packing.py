"""Packing by vector bin packing with the dot-product heuristic.

Every example has three demands: tokens, segments (one) and loss-bearing tokens. A
sequence is filled by adding, again and again, the example whose demand vector has the
largest dot product with what is left of the sequence's limits, among those that still
fit. Examples longer than a sequence are cut; every full piece is a sequence of its own,
so only remainders compete. Each task packs the pieces of its own partition, in lots of
bounded size, so packing needs no shuffle and its memory does not grow with the table;
what a partition leaves unfilled is at most its last few sequences.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import by_value, slices


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 1024
    segments: int = 1024
    loss: int = 1024


#: Pieces that are packed against each other at a time.
#: Rows that a task packs, at least, while there are as many.
TASK_ROWS = 2_048
LOT = 8192
EOS = 0
#: Where both tokenizers split alike for sure: other texts go to the reference tokenizer.
COMMON = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ‐-‧€]|<\||\s{200}|\S{2000}")


def pack(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Sequence (from 0) and offset of each example. Zero-token examples take a segment; none may exceed the limits."""
    n = len(tokens)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return where, offset
    kinds, inverse = np.unique(np.stack([tokens, loss], 1), axis=0, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    left = np.bincount(inverse, minlength=len(kinds))
    nxt = np.concatenate(([0], np.cumsum(left)))[:-1]
    t, l = kinds[:, 0].astype(np.float64), kinds[:, 1].astype(np.float64)
    cap = np.array([limits.tokens, limits.segments, max(limits.loss, 1)], np.float64)
    vt, vl, vs = t / cap[0], l / cap[2], 1.0 / cap[1]
    weight = np.array([(tokens / cap[0]).mean(), vs, (loss / cap[2]).mean()]) + 1e-9
    bin_, done = -1, 0
    free = np.zeros(3)
    while done < n:
        pick = -1
        if bin_ >= 0 and free[1] >= 1:
            score = np.where((left > 0) & (t <= free[0]) & (l <= free[2]), weight[0] * free[0] / cap[0] * vt + weight[1] * free[1] / cap[1] * vs + weight[2] * free[2] / cap[2] * vl, -1.0)
            pick = int(score.argmax())
            if score[pick] < 0:
                pick = -1
        if pick < 0:
            bin_, free = bin_ + 1, cap.copy()
            free[2] = limits.loss
            score = np.where(left > 0, weight[0] * vt + weight[2] * vl, -1.0)
            pick = int(score.argmax())
        item = order[nxt[pick]]
        nxt[pick] += 1
        left[pick] -= 1
        where[item], offset[item] = bin_, int(cap[0] - free[0])
        free -= (t[pick], 1, l[pick])
        done += 1
    return where, offset


class Ids:
    """Token ids by the tokenizer file, through a faster reader of the same vocabulary where both agree."""

    def __init__(self, path: str):
        self.path, self.fast = path, None
        try:
            import tiktoken
            from public_tokenizers import PATTERN

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path.removesuffix(".json") + ".tiktoken", "rb"))}
            self.fast = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        except (ImportError, OSError):
            pass

    @cached_property
    def slow(self):
        """Read with the first text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and not COMMON.search(text):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limits: Limits = Limits(), keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack ``docs``; one row per piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with
    ``keep_ids`` the ids themselves. A null text is empty: it has the end id only. Null ids
    are kept; repeated rows are packed one by one; a very long text is cut into full
    sequences and a rest; ties go to the smaller id; further columns take no part; an empty
    table gives no rows.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])
    if keep_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, context = Ids(tokenizer), TaskContext.get()
        base, used = (context.partitionId() if context else 0) << 36, 0
        lot: list[tuple] = []
        whole: list[tuple] = []
        names = schema.fieldNames()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            kinds = [arrow_id, *[pa.int64()] * 6, *[pa.list_(pa.int32())] * keep_ids]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal used, lot
            lot.sort(key=lambda r: (-r[2], r[3], r[0] is None, r[0] if r[0] is not None else 0, r[1]))
            n = np.array([r[2] for r in lot], np.int64)
            # the first token of a document has nothing before it to be predicted from
            loss = n - np.array([r[1] == 0 for r in lot], np.int64)
            where, offset = pack(n, np.minimum(loss, limits.loss), limits)
            if lot:
                yield out([(*r[:5], base + used + int(w), int(o), *r[5:]) for r, w, o in zip(lot, where, offset)])
                used += int(where.max()) + 1
            lot = []

        for batch in slices(batches):
            arrow_id = batch.schema.field(0).type
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.array([*ids_of(value or ""), EOS], dtype="<u4")
                for start in range(0, len(own), limits.tokens):
                    part = own[start : start + limits.tokens]
                    row = (key, start, len(part), zlib.crc32(part.tobytes()), len(own), *([part.astype(np.int32)] if keep_ids else ()))
                    if len(part) == limits.tokens:
                        whole.append((*row[:5], base + used, 0, *row[5:]))
                        used += 1
                    else:
                        lot.append(row)
                if len(whole) >= 4096:
                    yield out(whole)
                    whole = []
                if len(lot) >= LOT:
                    yield from flush()
        if whole:
            yield out(whole)
        yield from flush()

    # a task leaves a sequence or so unfilled, so partitions of few rows are read together; never more partitions than
    # there are: Spark would take this number in place of a smaller one that the caller set
    texts = docs.select(doc_id, text)
    return texts.coalesce(max(1, min(texts.rdd.getNumPartitions(), -(-docs.count() // TASK_ROWS)))).mapInArrow(run, schema)


def pack_examples(examples: DataFrame, tokens: str, loss: str, limits: Limits = Limits()) -> DataFrame:
    """Pack examples whose demands are columns: adds ``sequence_id`` and ``offset``.

    For instruction data, where only the answers bear loss. Null demands count as 0. An
    example that no sequence can hold gets null in both columns. Repeated rows are packed one
    by one, of equal demands the earlier row first. Columns of those names in the input are
    replaced. An empty table gives no rows.
    """
    keep = examples.drop("sequence_id", "offset")
    schema = T.StructType([*keep.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at, bt = keep.columns.index(tokens), keep.columns.index(loss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        used = (context.partitionId() if context else 0) << 36
        for batch in batches:
            for lo in range(0, batch.num_rows, LOT):
                part = batch.slice(lo, LOT)
                n, m = (np.array([v or 0 for v in part.column(i).to_pylist()], np.int64) for i in (at, bt))
                fits = (n <= limits.tokens) & (m <= limits.loss)
                seq, off = np.full(len(n), -1, np.int64), np.full(len(n), -1, np.int64)
                where, offset = pack(n[fits], m[fits], limits)
                seq[fits], off[fits] = where + used, offset
                used += int(where.max(initial=-1)) + 1
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(seq, mask=~fits), pa.array(off, mask=~fits)], schema.fieldNames())

    return keep.mapInArrow(run, schema)


def sequences(packed: DataFrame, limits: Limits = Limits(), pad: int = 0) -> DataFrame:
    """Join the pieces (with ids) of each sequence: sequence_id, input_ids padded to the limit, segment_ids (0 for padding), n_tokens.

    A sequence whose length is a power of two is not padded.
    """
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    segments = F.flatten(F.transform("p", lambda x, i: F.array_repeat(i + 1, F.size(x["ids"]))))
    n = F.size("input_ids")
    short = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(limits.tokens - n)
    filled = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), short))
    return parts.select("sequence_id", ids.alias("input_ids"), segments.alias("segment_ids")).select("sequence_id", filled(F.col("input_ids"), pad).alias("input_ids"), filled(F.col("segment_ids"), 0).alias("segment_ids"), n.cast("long").alias("n_tokens"))


by_value(__name__)
