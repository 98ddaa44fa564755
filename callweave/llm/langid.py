"""Language identification with bit-sliced Bloom filters over byte n-grams.

One table of ``2**bits`` rows holds a filter for every language at once: bit ``l`` of a
row is that row of language ``l``'s filter. Looking an n-gram up ANDs the rows its hashes
name and so returns the set of all languages that contain it. A document's count per
language is corrected for the chance that the filter says yes by accident; the largest
corrected count decides.

Fitting uses a bounded sample of the labelled rows (``per_lang`` documents a language on
average, chosen by a hash of the id). The table has a fixed size, so broadcasting it does
not depend on the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import by_value, maybe_broadcast, slices, without

N = 4
PROBES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], dtype=np.uint64)
#: Lower-case ASCII letters stay, other ASCII bytes become a space, bytes of longer characters stay.
CLEAN = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Characters worked on at a time: a few dozen bytes of working memory each.
CHUNK = 500_000


@dataclass
class LanguageFilters:
    """The fitted model. ``rows`` is [2**bits, words], 64 languages a word (fewer bits where they fit)."""

    languages: list[str]
    rows: np.ndarray
    bits: int
    by_chance: np.ndarray


def grams(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every byte N-gram whose inner bytes are letters: its code, and whether it counts."""
    b = buf.astype(np.uint32)
    code = b[: -N + 1] | b[1 : -N + 2] << np.uint32(8) | b[2 : -N + 3] << np.uint32(16) | b[3:] << np.uint32(24)
    inner = buf != 32
    return code, inner[1 : -N + 2] & inner[2 : -N + 3]


def slots(code: np.ndarray, bits: int) -> list[np.ndarray]:
    wide = code.astype(np.uint64)
    return [(wide * p) >> np.uint64(64 - bits) for p in PROBES]


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The cleaned texts in one buffer, each between blanks, and where each begins."""
    parts = [(t or "").lower().encode("utf-8", "replace").translate(CLEAN) for t in texts]
    starts = np.cumsum([0] + [len(p) + N for p in parts])
    return np.frombuffer((b" " * N).join([b"", *parts, b"", b""])[:], dtype=np.uint8), starts


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, set(text)))


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Slices of about CHUNK characters, of one text at least."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= CHUNK):
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        by: dict[str, list[str]] = {}
        for lang, text in zip(langs, texts):
            by.setdefault(lang, []).append(text)
        for lang, own in by.items():
            parts = []
            for a, b in chunks(own):
                code, ok = grams(joined(own[a:b])[0])
                parts.append(np.unique(code[ok], return_counts=True))
            found, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([p[1] for p in parts]), minlength=len(found))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", by: Column | None = None, per_lang: int = 1500, bits: int = 20, least: int = 3, share: float = 0.2) -> LanguageFilters:
    """Learn from the labelled rows of ``docs`` (null texts and languages teach nothing).

    ``per_lang`` bounds the sample; a language contains an n-gram if it was seen ``least``
    times and at no less than ``share`` of the rate of the language that uses it most.
    Empty texts have no n-gram; a very long text is read as a whole; repeated rows count as
    often as they come; further columns take no part; an empty table teaches no language.
    """
    key = by if by is not None else F.xxhash64(text)
    known = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), key.alias("key")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    languages = sorted(sizes)
    if not languages:
        return LanguageFilters([], np.zeros((1 << bits, 1), np.uint8), bits, np.zeros(0))
    rates = docs.sparkSession.createDataFrame([(name, min(1.0, per_lang / n)) for name, n in sizes.items()], "lang string, rate double")
    drawn = F.pmod(F.xxhash64("key", F.lit("langid")), F.lit(1 << 30)) < F.col("rate") * float(1 << 30)
    sample = known.join(maybe_broadcast(rates), "lang").where(drawn).select("lang", "text")
    counts = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(_over("lang"))
    rated = counts.withColumn("rate", F.col("n") / total).withColumn("most", F.max("rate").over(_over("gram")))
    kept = rated.where((F.col("n") >= least) & (F.col("rate") >= share * F.col("most"))).select("lang", "gram").toPandas()  # at most the n-grams of the bounded sample
    words = (len(languages) + 63) // 64
    kind = next(k for k, w in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 10**9)) if len(languages) <= w)
    rows = np.zeros((1 << bits, words), dtype=kind)
    fill = np.zeros(len(languages))
    for i, name in enumerate(languages):
        own = kept.loc[kept["lang"] == name, "gram"].to_numpy(np.uint32)
        for s in slots(own, bits):
            rows[s, i // 64] |= kind(1 << (i % 64))
        fill[i] = np.mean((rows[:, i // 64] >> kind(i % 64)) & kind(1))
    return LanguageFilters(languages, rows, bits, fill ** len(PROBES))


def _over(name: str):
    from pyspark.sql import Window

    return Window.partitionBy(name)


def decide(model: LanguageFilters, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The language and score of each text; ``und`` and 0 for a null text or one without a letter."""
    names, scores = ["und"] * len(texts), np.zeros(len(texts))
    if not model.languages or not texts:
        return names, scores
    for at, end in chunks(texts):
        buf, starts = joined(texts[at:end])
        code, ok = grams(buf)
        where = np.flatnonzero(ok)
        code = code[where]
        s = slots(code, model.bits)
        bounds = np.searchsorted(where, starts)
        n = np.diff(bounds)
        hits = np.zeros((end - at, len(model.languages)))
        for w in range(model.rows.shape[1]):
            column = model.rows[:, w]
            mask = column[s[0]] & column[s[1]] & column[s[2]]
            for i in range(64 * w, min(64 * w + 64, len(model.languages))):
                run = np.concatenate(([0], np.cumsum((mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1), dtype=np.int64)))
                hits[:, i] = np.diff(run[bounds])
        chance = model.by_chance
        right = np.clip((hits - n[:, None] * chance) / np.maximum(1 - chance, 1e-9), 0, None)
        best = right.argmax(1)
        share = right[np.arange(end - at), best] / np.maximum(n, 1)
        letters = (buf >= 97) & (buf <= 122)
        run = np.concatenate(([0], np.cumsum(letters, dtype=np.int64)))
        plain = np.diff(run[np.minimum(starts + N, len(buf))]) if len(starts) > 1 else np.zeros(0)
        for j in range(end - at):
            text = texts[at + j]
            if text is not None and (plain[j] > 0 or has_letter(text)):
                names[at + j], scores[at + j] = model.languages[best[j]], min(1.0, share[j])
    return names, scores


def predict(docs: DataFrame, model: LanguageFilters, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``; a column of that name in ``docs`` is replaced.

    Null text or no letter: ``und``, 0. Letters but no known n-gram: the first language, 0;
    ties go to the first language by name. Repeated rows are judged alike, a very long text as
    a whole; an empty table gives no rows.
    """
    docs = without(docs, ["lang_pred", "lang_score"])
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, scores = decide(model, batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, schema)


by_value(__name__)
