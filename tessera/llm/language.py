"""Language identification by multinomial naive Bayes over hashed character n-grams.

Counts per language come from all rows outside the held-out fold: each task adds up its own, and two rounds of
streaming sums merge them, so no task holds more than one set of counts. The matrix of log probabilities has a
fixed width and is broadcast; texts are scored in batches, each as a sparse row of n-gram counts times the matrix.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import labelled
from tessera.runtime import Scratch, arrow_rows

ORDERS, BITS = (1, 2, 3), 14
#: Added to every count.
SMOOTHING = 0.5
UNKNOWN = "und"
WIDTH = len(ORDERS) << BITS
#: Characters of one text that are looked at together.
_STEP = 1 << 18
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTER[0]


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a text's letters, all else being one gap; None if it has no letter."""
    if not text:
        return None
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of other characters the first stays, as a space
    keep[0] = True
    code = np.where(letter, code, 32).astype(np.uint32)[keep]
    out = np.zeros(WIDTH, np.int64)
    for lo in range(0, len(code), _STEP):
        part = code[max(0, lo - ORDERS[-1] + 1) : lo + _STEP]
        skip = min(lo, ORDERS[-1] - 1)
        h = np.zeros(len(part), np.uint32)
        for k, n in enumerate(range(1, ORDERS[-1] + 1)):
            # h[i] covers the n characters that end at i
            h = (part + (np.concatenate(([0], h[:-1])) if n > 1 else 0) * np.uint32(0x9E3779B1)).astype(np.uint32)
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            bucket = mixed[max(skip, n - 1) :] >> np.uint32(32 - BITS)
            out[k << BITS : (k + 1) << BITS] += np.bincount(bucket, minlength=1 << BITS)
    return out


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray
    log_p: np.ndarray  # (WIDTH, languages)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for lo in range(0, len(texts), 64):
            counts = [gram_counts(t) for t in texts[lo : lo + 64]]
            if not self.langs:
                counts = [None] * len(counts)
            rows = [c for c in counts if c is not None]
            if rows:
                at = [np.flatnonzero(c) for c in rows]  # sparse rows
                z = np.array([c[i] @ self.log_p[i] for c, i in zip(rows, at, strict=True)]) + self.prior
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
            k = 0
            for c in counts:
                if c is None:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    names.append(self.langs[int(p[k].argmax())])
                    scores.append(float(p[k].max()))
                    k += 1
        return names, scores


_COUNTS = "lang string, docs bigint, counts binary"


def _rows(found: dict[str, list]):
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1].tobytes() for v in found.values()], pa.binary())], names=["lang", "docs", "counts"])


def _count(batches):
    found: dict[str, list] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if (c := gram_counts(text)) is not None:
                own = found.setdefault(lang, [0, np.zeros(WIDTH, np.int64)])
                own[0] += 1
                own[1] += c
    yield from _rows(found)


def _add(batches):
    found: dict[str, list] = {}
    for batch in batches:
        for r in batch.to_pylist():
            own = found.setdefault(r["lang"], [0, np.zeros(WIDTH, np.int64)])
            own[0] += r["docs"]
            own[1] += np.frombuffer(r["counts"], np.int64)
    yield from _rows(found)


def train(docs: DataFrame) -> Model:
    """Count over all rows with a language outside the held-out fold; without any, every text is unknown."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "language")
    rows = docs.where(F.col("lang").isNotNull() & ~labelled.held_out(F.col("doc_id"))).select(F.col("lang").cast("string"), F.col("text").cast("string").alias("text"))
    with arrow_rows(spark, 64):
        first = rows.mapInArrow(_count, _COUNTS).repartition(16).mapInArrow(_add, _COUNTS)
        sums = scratch.table(scratch.table(first, "first").repartition(1).mapInArrow(_add, _COUNTS), "sums").collect()
    sums.sort(key=lambda r: r["lang"])
    counts = np.array([np.frombuffer(bytes(r["counts"]), np.int64) for r in sums], np.float64).reshape(len(sums), len(ORDERS), 1 << BITS) + SMOOTHING
    log_p = np.log(counts / counts.sum(axis=2, keepdims=True)).reshape(len(sums), WIDTH).T
    prior = np.log(np.array([r["docs"] for r in sums], np.float64) / max(1, sum(r["docs"] for r in sums)))
    return Model([r["lang"] for r in sums], prior, np.ascontiguousarray(log_p))


def _scorer(shared):
    def run(batches):
        for batch in batches:
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run, "doc_id bigint, lang_pred string, score double"


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs``; ``score`` is the posterior probability.

    Null texts and texts without a letter are ``und`` with score 0. Of equal posteriors the first language by
    name wins. Ids may be null or repeat; other columns are ignored.
    """
    run, schema = _scorer(docs.sparkSession.sparkContext.broadcast(model))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs)).select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
