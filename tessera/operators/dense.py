"""Exact nearest neighbours by inner product, and truncated embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries are multiplied with all rows in blocks of at most so many numbers, each broadcast on its own.
BLOCK_VALUES = 1 << 19
_AT_ONCE = 512


def normalised(v: Column, dim: int | None = None) -> Column:
    """The first ``dim`` numbers divided by their length, which counts as 1e-12 at least."""
    cut = F.transform(F.slice(v, 1, dim) if dim else v, lambda x: x.cast("double"))
    norm = F.greatest(F.sqrt(F.aggregate(cut, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
    return F.transform(cut, lambda x: x / norm)


def _merge(scores: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` of each row, and what ties with the last: the final rank decides by id."""
    if scores.shape[1] <= k:
        return scores, names
    edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    width = int((scores >= edge).sum(axis=1).max())
    order = np.argsort(-scores, axis=1, kind="stable")[:, :width]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)


def _block_top(shared, k: int):
    """Arrow function: each task's best ``k`` rows for every query of a block."""

    def run(batches):
        ids, q = shared.value
        spans = [slice(i, i + _AT_ONCE) for i in range(0, len(ids), _AT_ONCE)]
        best = [(np.zeros((len(ids[s]), 0)), np.zeros((len(ids[s]), 0), object)) for s in spans]
        for batch in batches:
            eids = np.array(batch.column("eid").to_pylist(), object)
            if not len(eids):
                continue
            m = np.array(batch.column("v").to_pylist(), np.float64).T
            for i, s in enumerate(spans):
                new = np.round(q[s] @ m, 6)
                best[i] = _merge(np.concatenate((best[i][0], new), axis=1), np.concatenate((best[i][1], np.broadcast_to(eids, new.shape)), axis=1), k)
        for s, (scores, names) in zip(spans, best, strict=True):
            own = np.repeat(np.array(ids[s], object), scores.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(own.tolist(), pa.string()), pa.array(names.ravel().tolist(), pa.string()), pa.array(scores.ravel())], names=["sid", "eid", "score"])

    return run


def knn(queries: DataFrame, pool: DataFrame, k: int = 200) -> DataFrame:
    """``sid, eid, score, rank``: the ``k`` pool vectors with the largest inner product for each query.

    ``queries`` (sid, v) is the stated query set; it meets all rows of ``pool`` (eid, v) in blocks of bounded size,
    so no pair leaves a task unless it is among the task's best. Ids must be strings; null vectors match nothing.
    Scores are rounded to six places and ties go to the smaller id.
    """
    spark = queries.sparkSession
    rows = pool.where("eid is not null and v is not null").select("eid", "v")
    found, ids, block, held = None, [], [], 0

    def flush():
        nonlocal found, ids, block, held
        shared = spark.sparkContext.broadcast((ids, np.array(block, np.float64)))
        part = rows.mapInArrow(_block_top(shared, k), "sid string, eid string, score double")
        found = part if found is None else found.unionByName(part)
        ids, block, held = [], [], 0

    for r in queries.where("sid is not null and v is not null").select("sid", "v").toLocalIterator():
        ids.append(r["sid"])
        block.append(r["v"])
        held += len(r["v"])
        if held >= BLOCK_VALUES:
            flush()
    if ids or found is None:
        if not ids:
            return spark.createDataFrame([], "sid string, eid string, score double, rank int")
        flush()
    by = Window.partitionBy("sid").orderBy(F.desc("score"), "eid")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """An embedding without a model: counts of hashed character trigrams, normalised."""
    from tessera.functions.text import padded_grams

    slots = F.transform(padded_grams(F.lower(text)), lambda g: F.pmod(F.xxhash64(g), F.lit(dim)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    return normalised(counts)
