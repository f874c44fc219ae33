"""Language identification: multinomial naive Bayes over hashed character n-grams.

Fitting counts n-grams per language on Spark (only sums reach the driver: languages x buckets); the log-probability
matrix is broadcast, and each Arrow batch is scored in numpy over whole texts.

The score is the posterior of the best language among the learnt ones and none of them: a model by which all buckets are equally
likely. A text whose n-grams fit no language better than that (another script, random letters) scores near 0.

Defined cases: a text that is null or has no letter gets ``und`` with score 0; rows without a language or text are
never learnt from; with nothing to learn from every row gets ``und``; of equal scores the language first in order wins; a null
doc_id counts as held out; repeated rows are predicted each; very long texts are scored whole, alone; an empty table gives no rows; other
columns of the input are ignored, whatever their names. ``lang``, ``source`` and ``doc_id`` are no inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import arrow_map

UNDETERMINED = "und"
AT_ONCE = 1 << 20  # characters that are scored together


@dataclass
class Model:
    langs: list[str]
    logs: np.ndarray  # languages x buckets, float32
    prior: np.ndarray
    orders: tuple[int, ...]


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """For each code point: its lower-case letter, or a space where it is no letter."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _grams(codes: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram at each position (the last order - 1 positions have none)."""
    n = len(codes) - order + 1
    h = np.full(max(n, 0), order, dtype=np.uint32)
    for k in range(order):
        h = (h ^ codes[k : k + n]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0x85EBCA6B) >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int32)


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of texts: (first, last, folded characters with a space around each text, its start)."""
    begin, size = 0, 0
    for i, text in enumerate([*texts, None]):
        size += len(text or "") + 1
        if i == len(texts) or size > AT_ONCE:
            end = min(i + 1, len(texts))
            if end > begin:
                block = [t or "" for t in texts[begin:end]]
                codes = _folded()[np.frombuffer((" " + " ".join(block) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
                starts = np.cumsum([0, *[len(t) + 1 for t in block]])
                yield begin, end, codes, starts
            begin, size = end, 0


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the doc_id as text, modulo 4, is 2: rows that are kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, fit_rows: int = 20_000, buckets: int = 1 << 16, orders: tuple[int, ...] = (2, 3), smooth: float = 0.5) -> Model:
    """Learn from about ``fit_rows`` labelled rows that aren't held out (all, if there are fewer), picked by a hash of doc_id."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = min(1.0, fit_rows / max(rows.count(), 1))
    rows = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < round(share * (1 << 20))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for begin, end, codes, starts in _pieces(texts):
                of = np.repeat(np.arange(end - begin), np.diff(starts))
                names = sorted(set(langs[begin:end]))
                which = np.array([names.index(x) for x in langs[begin:end]])[of] if end > begin else of
                for order in orders:
                    grams = _grams(codes, order, buckets)
                    for k, name in enumerate(names):
                        own = grams[: len(of)][which[: len(grams)] == k]
                        total = sums.setdefault(name, np.zeros(buckets + 1, dtype=np.int64))
                        total[:buckets] += np.bincount(own, minlength=buckets)
                for name in langs[begin:end]:
                    sums[name][buckets] += 1
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "bucket", "n"])

    table = arrow_map(rows, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table["lang"].to_pylist()))
    counts = np.zeros((len(langs), buckets + 1))
    for lang, bucket, n in zip(table["lang"].to_pylist(), table["bucket"].to_pylist(), table["n"].to_pylist(), strict=True):
        counts[langs.index(lang), bucket] = n
    grams = counts[:, :buckets] + smooth
    logs = np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32)
    return Model(langs, logs, np.log((counts[:, buckets] + 1) / (counts[:, buckets] + 1).sum()), orders)


def score(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Predicted language of each whole text and its posterior, with none of the languages as an alternative."""
    names, best = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if not model.langs:
        return names, best
    buckets = model.logs.shape[1]
    for begin, end, codes, starts in _pieces(texts):
        letters = np.add.reduceat(codes != 32, starts[:-1])
        logs, seen = np.zeros((len(model.langs), end - begin)), np.zeros(end - begin)
        for order in model.orders:
            grams = _grams(codes, order, buckets)
            at = np.minimum(starts[:-1], max(len(grams) - 1, 0))
            seen += np.diff(np.append(at, len(grams)))
            for k in range(len(model.langs)):
                if len(grams):
                    logs[k] += np.add.reduceat(model.logs[k][grams], at, dtype=np.float64)
        logs += model.prior[:, None]
        top = logs.argmax(axis=0)
        none = -seen * np.log(buckets) - np.log(len(model.langs) + 1)
        best_log = logs.max(axis=0)
        posterior = 1 / (np.exp(logs - best_log).sum(axis=0) + np.exp(np.minimum(none - best_log, 700)))
        for i in np.flatnonzero(letters > 0):
            names[begin + i] = model.langs[top[i]]
            best[begin + i] = posterior[i]
    return names, best


def predict(docs: DataFrame, model: Model, lang: str = "lang_pred", confidence: str = "score") -> DataFrame:
    """``docs`` (any columns, a ``text``) with the columns ``lang`` and ``confidence``, which it must not have yet."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, best = score(shared.value, batch.column(at).to_pylist())
            yield pa.record_batch([*batch.columns, pa.array(names, pa.string()), pa.array(best)], names=[*batch.schema.names, lang, confidence])

    return arrow_map(docs, run, T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(confidence, T.DoubleType())]))


def identify(docs: DataFrame, fit_rows: int = 20_000) -> DataFrame:
    """The result of the query: doc_id, held_out, lang_pred, score for every document."""
    model = fit(docs, fit_rows)
    return predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
