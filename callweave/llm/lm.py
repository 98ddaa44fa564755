"""Language-model scoring by masked pseudo-likelihood.

A bidirectional window network predicts every token from the tokens on both sides: the
embeddings of the ``REACH`` tokens before and after, weighted by position, are added and
passed through tanh; three softmaxes of ``FAN`` ways, each given the choice before, lead to
one of the ``VOCABULARY`` tokens. A document's score is the sum of the conditional
log-probabilities of its tokens, each with all others shown.

Words (A-Z lower-cased) are counted over the whole corpus in ``BUCKETS`` hash buckets. The
most frequent are tokens of their own; all others share the last token, and such a word
adds the logarithm of its bucket's share of the others' count, so probabilities add up to
one over all buckets.

Training takes every window of the corpus once over the rounds: round r takes those whose
number in their share is r modulo ``rounds``. Documents are dealt to shares by a hash of
their rows, so the weights don't depend on how the table is partitioned. Every share starts
a round from the common weights and runs minibatch updates in numpy; the next round starts
from the mean of the shares' weights, weighted by tokens and summed in the shares' order by
a tree of fan-in ``WAYS``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import by_value, cut, without, written

BUCKETS = 1 << 20
FAN, WIDTH, REACH = 16, 16, 2
VOCABULARY = FAN**3
OTHER, PAD = VOCABULARY - 1, VOCABULARY
ROUNDS, BATCH, RATE = 2, 8192, 2.0
#: Tokens of a training share, and how many models one task adds up.
SHARE, WAYS = 4_000_000, 16
SIDES = np.array([d for d in range(-REACH, REACH + 1) if d])
WORDS = "_lm_words"


class Memo(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word, 11) % BUCKETS
        return value


def buckets(memo: Memo, raw: bytes) -> np.ndarray:
    words = raw.lower().split()
    if len(memo) > 400_000:
        memo.clear()
    return np.fromiter(map(memo.__getitem__, words), np.int32, len(words))


@dataclass
class Model:
    """The network's weights, the token of every bucket, and for buckets of the last token the logarithm of their share of it."""

    weights: dict[str, np.ndarray]
    token: np.ndarray
    share: np.ndarray


def start(n: np.ndarray) -> Model:
    """The untrained model of the bucket counts ``n``: every token has its rate in the corpus."""
    top = np.lexsort((np.arange(BUCKETS), -n))[:OTHER]
    top = top[n[top] > 0]
    token = np.full(BUCKETS, OTHER, np.int16)
    token[top] = np.arange(len(top))
    rest = np.where(token == OTHER, n + 0.01, 0.0)  # no bucket is impossible
    share = np.where(token == OTHER, np.log(np.maximum(rest, 0.01) / rest.sum()), 0.0)
    rate = np.bincount(token, n, VOCABULARY) + 1.0
    r = np.random.default_rng(1)
    weights = {"embed": r.standard_normal((VOCABULARY + 1, WIDTH)) * 0.3, "place": np.full((len(SIDES), WIDTH), 0.5)}
    weights["embed"][PAD] = 0
    for level in range(3):
        own = rate.reshape(FAN**level, FAN, -1).sum(2)
        weights[f"w{level}"] = r.standard_normal((FAN**level, WIDTH, FAN)) * 0.1
        weights[f"b{level}"] = np.log(own / own.sum(1, keepdims=True))
    return Model({k: v.astype(np.float32) for k, v in weights.items()}, token, share.astype(np.float32))


def padded(tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts' tokens, end to end up to ``ends``, with REACH blanks before, between and after; and every token's place."""
    size = np.diff(ends, prepend=0)
    at = np.arange(len(tokens)) + REACH * (np.repeat(np.arange(len(size)), size) + 1)
    flat = np.full(len(tokens) + REACH * (len(size) + 1), PAD, np.int16)
    flat[at] = tokens
    return flat, at


def hidden(p: dict, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros((len(at), WIDTH), np.float32)
    for side, place in zip(SIDES, p["place"]):
        total += (p["embed"] * place).take(flat[at + side], 0)
    return np.tanh(total, out=total)


def _nodes(own: np.ndarray, level: int) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """For sorted tokens: (node, first, last) of each softmax of a level that is met, the node of each row, and which way each goes."""
    way = own >> (4 * (2 - level))
    node = way >> 4
    first = np.flatnonzero(np.diff(node, prepend=-1))
    return list(zip(node[first].tolist(), first.tolist(), [*first[1:].tolist(), len(own)])), node, way & (FAN - 1)


def _logits(p: dict, level: int, h: np.ndarray, own: np.ndarray):
    nodes, node, way = _nodes(own, level)
    w = p[f"w{level}"]
    z, h = np.empty((len(own), FAN), w.dtype), h.astype(w.dtype, copy=False)
    for k, a, b in nodes:
        np.matmul(h[a:b], w[k], out=z[a:b])
    z = z.astype(np.float32, copy=False)
    z += p[f"b{level}"].take(node, 0)
    # hidden units lie within -1 and 1, so the weights bound every logit
    if np.abs(w).sum(1).max() + np.abs(p[f"b{level}"]).max() > 60:
        z -= z.max(1, keepdims=True)
    return nodes, way, z


def log_probabilities(p: dict, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of every token at ``at`` given its window.

    Products are taken in double precision and rounded: in single, a row's last bits depend
    on how many rows are multiplied with it, so a text's score would on its neighbours.
    """
    p = p | {f"w{level}": p[f"w{level}"].astype(float) for level in range(3)}
    out = np.empty(len(at))
    for lo in range(0, len(at), 32768):
        part = at[lo : lo + 32768]
        order = np.argsort(flat[part], kind="stable")
        part = part[order]
        own, rows = flat[part], np.arange(len(part))
        h, got = hidden(p, flat, part), np.zeros(len(part), np.float32)
        for level in range(3):
            _, way, z = _logits(p, level, h, own)
            got += z[rows, way] - np.log(np.exp(z).sum(1))
        out[lo + order] = got
    return out


def step(p: dict, flat: np.ndarray, at: np.ndarray, rate: float) -> None:
    """One minibatch of gradient ascent on the mean conditional log-probability, in place."""
    at = at[np.argsort(flat[at], kind="stable")]
    own, rows, n = flat[at], np.arange(len(at)), len(at)
    h = hidden(p, flat, at)
    dh = np.zeros_like(h)
    for level in range(3):
        w, bias = p[f"w{level}"], p[f"b{level}"]
        nodes, way, d = _logits(p, level, h, own)
        np.exp(d, out=d)
        d /= d.sum(1, keepdims=True)
        d[rows, way] -= 1
        for k, a, b in nodes:
            part, scale = d[a:b], rate / (b - a + 16)
            dh[a:b] += part @ w[k].T
            w[k] -= scale * (h[a:b].T @ part)
            bias[k] -= scale * part.sum(0)
    dx = dh * (1 - h * h)
    near = np.concatenate([flat[at + side] for side in SIDES])
    order = np.argsort(near, kind="stable")
    near = near[order]
    first = np.flatnonzero(np.diff(near, prepend=-1))
    moves = np.concatenate([dx * place for place in p["place"]]).take(order, 0)
    total = np.add.reduceat(moves, first, 0)
    for j, side in enumerate(SIDES):
        p["place"][j] -= rate / n * 0.1 * (dx * p["embed"].take(flat[at + side], 0)).sum(0)
    p["embed"][near[first]] -= rate * total / (np.diff(first, append=len(near))[:, None] + 16)
    p["embed"][PAD] = 0


def encoded(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` but with the buckets of its words, written once for training and scoring."""
    docs = docs.drop(WORDS)
    keep = [c for c in docs.columns if c != text]
    schema = T.StructType([*docs.select(keep).schema.fields, T.StructField(WORDS, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                found = [buckets(memo, v or b"") for v in batch.column(0).cast(pa.large_binary()).to_pylist()]
                ends = np.cumsum([0, *map(len, found)])
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))], schema.fieldNames())

    return written(docs.select(text, *keep).mapInArrow(run, schema))


def _arrays(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists end to end, and where each list ends."""
    ends = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], ends[1:] - ends[0]


def counted(words: DataFrame) -> np.ndarray:
    n = np.zeros(BUCKETS, np.int64)
    found = words.select(F.explode(WORDS).alias("b")).groupBy("b").agg(F.count("*").alias("n")).toArrow()  # at most BUCKETS rows
    n[found.column("b").to_numpy()] = found.column("n").to_numpy()
    return n


def _trainer(p: dict[str, np.ndarray], r: int, rounds: int, batch_size: int):
    """Train each share, whose rows come one after another, from the common weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of, seen, held, size = None, None, 0, [], 0

        def learn() -> None:
            nonlocal held, size, seen
            ends = np.concatenate([e + s for (_, e), s in zip(held, np.cumsum([0, *[len(t) for t, _ in held]]))])
            flat, at = padded(np.concatenate([t for t, _ in held]), ends)
            mine = at[(np.arange(len(at)) + seen) % rounds == r]
            seen += len(at)
            mine = np.random.default_rng(len(mine)).permutation(mine)
            for lo in range(0, len(mine), batch_size):
                step(own, flat, mine[lo : lo + batch_size], RATE / (1 + r))
            held, size = [], 0

        def done() -> pa.RecordBatch:
            if size:
                learn()
            k = len(own)
            return pa.RecordBatch.from_arrays([pa.array([of] * k, pa.int64()), pa.array([seen] * k, pa.int64()), pa.array(list(own)), pa.array([own[x].ravel() * float(seen) for x in own], pa.list_(pa.float64()))], ["share", "n", "name", "w"])

        for batch in batches:
            share = batch.column(0).to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(share)]
            for a, b in zip(bounds[:-1], bounds[1:]):
                if a == b:
                    continue
                if of is None or share[a] != of:
                    if of is not None:
                        yield done()
                    own, of, seen = {k: v.copy() for k, v in p.items()}, int(share[a]), 0
                for lo in range(a, b, 64):
                    part = _arrays(batch.column(1).slice(lo, min(64, b - lo)))
                    held.append(part)
                    size += len(part[0])
                    if size >= 16 * batch_size * rounds:
                        learn()
        if of is not None:
            yield done()

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the models of each group of shares, which come one after another in order."""
    at, n, total = None, 0, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([n], pa.int64()), pa.array([at[1]]), pa.array([total], pa.list_(pa.float64()))], ["share", "n", "name", "w"])

    for batch in batches:
        for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            w = batch.column(4)[i].values.to_numpy()
            if key != at:
                if at is not None:
                    yield out()
                at, n, total = key, 0, np.zeros(len(w))
            n, total = n + batch.column(3)[i].as_py(), total + w
    if at is not None:
        yield out()


def fit_encoded(words: DataFrame, rounds: int = ROUNDS, share: int = SHARE, batch_size: int = BATCH) -> Model:
    n = counted(words)
    model = start(n)
    shares = max(1, -(-int(n.sum()) // share))

    def to_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = _arrays(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(model.token[values]))], ["key", "tokens"])

    key = F.xxhash64(*[c for c in words.columns])
    dealt = words.where(F.size(WORDS) > 0).select(key.alias("key"), WORDS).mapInArrow(to_tokens, "key long, tokens array<short>").select(F.pmod(F.col("key"), F.lit(shares)).alias("share"), "key", "tokens")
    dealt = cut(dealt.repartition(min(shares, 100_000), "share").sortWithinPartitions("share", "key").select("share", "tokens"))
    p = model.weights
    for r in range(rounds):
        sent, left = dealt.mapInArrow(_trainer(p, r, rounds, batch_size), "share long, n long, name string, w array<double>"), shares
        while True:
            sent = sent.select(F.floor(F.col("share") / WAYS).alias("to"), "name", "share", "n", "w").repartition(min(-(-left // WAYS) * len(p), 100_000), "to", "name").sortWithinPartitions("to", "name", "share").mapInArrow(_added, "share long, n long, name string, w array<double>")
            left = -(-left // WAYS)
            if left == 1:
                break
        p = p | {row["name"]: (np.array(row["w"]) / row["n"]).astype(np.float32).reshape(p[row["name"]].shape) for row in sent.toArrow().to_pylist()}
    return Model(p, model.token, model.share)


def fit(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, share: int = SHARE, batch_size: int = BATCH) -> Model:
    """Train on every text of ``docs``.

    Null and blank texts have no windows; repeated rows train as often as they come; a very
    long text is one run of windows; ids take no part but in dealing rows to shares. The
    model of an empty corpus is the starting one, in which all buckets are alike.
    """
    return fit_encoded(encoded(docs, text), rounds, share, batch_size)


def score_encoded(words: DataFrame, model: Model) -> DataFrame:
    """As :func:`score`, of rows that :func:`encoded` has made: without words 0 tokens and 0; further columns are kept, repeated rows scored alike."""
    words = without(words, ["lm_tokens", "lm_log_prob"])
    at = words.columns.index(WORDS)
    keep = [i for i in range(len(words.columns)) if i != at]
    schema = T.StructType([*words.drop(WORDS).schema.fields, T.StructField("lm_tokens", T.LongType()), T.StructField("lm_log_prob", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                values, ends = _arrays(batch.column(at))
                tokens = model.token[values]
                flat, where = padded(tokens, ends)
                each = log_probabilities(model.weights, flat, where) + model.share[values]
                first = np.append(0, ends[:-1])
                total = np.zeros(len(ends))
                some = ends > first  # a text's sum is its own, whatever texts come before it
                total[some] = np.add.reduceat(each, first[some]) if some.any() else 0.0
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array((ends - first).astype(np.int64)), pa.array(total)], schema.fieldNames())

    return words.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lm_tokens`` and ``lm_log_prob``, the sum of its tokens' conditional log-probabilities.

    Null and blank texts have no tokens and 0; equal texts have equal scores, whatever their
    ids, null ones too, so repeated rows do. A very long text is scored as a whole. Columns of
    these names are replaced, all others are kept. An empty table gives no rows.
    """
    texts = docs.withColumn("_lm_text", F.col(text))
    return score_encoded(encoded(texts, "_lm_text"), model).select(*without(docs, ["lm_tokens", "lm_log_prob"]).columns, "lm_tokens", "lm_log_prob")


by_value(__name__)
