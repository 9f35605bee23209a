"""Exact top-k search for binary codes by incremental multi-index hashing.

A vector's code is one bit per number: whether it is positive. Equal codes are one class with its smallest ids, so
a code that many rows share is compared once. Classes are dealt into index blocks; in a block, the code is cut into
segments of about log2(classes) bits, each with a bucket table. A query looks up its own segments first, then all
segment values at distance 1, then 2, and so on, one segment at a time. After the s-th of m segments at radius t
every code within Hamming distance m*t + s (s from 0) has been met, and the query is done as soon as the distance
of its kth verified code is covered. Over all radii a segment has as many lookups as values, about as many as the
block has codes, so a query that ends late costs a small multiple of comparing everything and needs no other way.
Queries are the stated query set: their codes are broadcast in blocks of bounded size.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import Scratch, arrow_rows

K, QUERY_STEP = 10, 20
#: Codes of queries in one broadcast, classes in one index block, and candidates verified together.
BLOCK_QUERIES, BLOCK_CLASSES = 1 << 17, 1 << 18
_AT_ONCE = 1 << 20
_U = np.uint64


def sign_code(vector: Column, bits: int = 64) -> Column:
    """The signs of the first ``bits`` numbers as one long; null for a null vector. Missing numbers count as 0."""
    one = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.when(F.get(vector, i) > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return F.when(vector.isNotNull(), F.aggregate(one, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b)))


class Index:
    """Bucket tables over the segments of a block's distinct codes."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, bits: int = 64):
        self.codes, self.weights, self.bits = codes, weights, bits
        self.m = max(1, min(bits, round(bits / max(4.0, min(20.0, np.log2(max(2, len(codes))))))))
        cuts = [bits * i // self.m for i in range(self.m + 1)]
        self.segments = list(zip(cuts[:-1], cuts[1:], strict=True))
        self.tables = []
        for a, b in self.segments:
            v = self.part(codes, a, b)
            order = np.argsort(v, kind="stable")
            self.tables.append((order, np.searchsorted(v[order], np.arange((1 << (b - a)) + 1))))
        self.masks: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def part(codes: np.ndarray, a: int, b: int) -> np.ndarray:
        return ((codes >> _U(a)) & _U((1 << (b - a)) - 1)).astype(np.int64)

    def at_radius(self, width: int, t: int) -> np.ndarray:
        """All values of ``width`` bits with ``t`` bits set."""
        if (width, t) not in self.masks:
            self.masks[width, t] = np.array([sum(1 << i for i in c) for c in combinations(range(width), t)], np.int64)
        return self.masks[width, t]

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, class, distance) of all classes up to each query's kth distance; all classes if they hold fewer than k rows."""
        out = []
        hist = np.zeros((len(queries), self.bits + 1), np.int64)
        active = np.arange(len(queries))
        t = 0
        while len(active) and t <= max(b - a for a, b in self.segments):  # the last radius has met every code
            for s, (a, b) in enumerate(self.segments):
                if not len(active):
                    break
                if t > b - a:
                    continue
                out += self._probe(queries, active, hist, s, t, k)
                # kth verified distance against what is covered by now
                kth = self._kth(hist[active], k)
                active = active[kth > self.m * t + s]
            t += 1
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, c, d = (np.concatenate(x) for x in zip(*out, strict=True))
        keep = d <= self._kth(hist, k)[q]
        return q[keep], c[keep], d[keep]

    def _kth(self, hist: np.ndarray, k: int) -> np.ndarray:
        reached = np.cumsum(hist, axis=1) >= k
        return np.where(reached.any(axis=1), reached.argmax(axis=1), self.bits + 1)

    def _probe(self, queries, active, hist, s, t, k):
        a, b = self.segments[s]
        order, starts = self.tables[s]
        masks = self.at_radius(b - a, t)
        own = self.part(queries[active], a, b)
        step = max(1, _AT_ONCE // (4 * len(masks)))
        for lo in range(0, len(active), step):
            values = own[lo : lo + step, None] ^ masks[None, :]
            first, size = starts[values], starts[values + 1] - starts[values]
            per = size.sum(axis=1)
            cut = 0
            while cut < len(per):  # at most so many candidates at once, but one query at least
                to = max(cut + 1, int(np.searchsorted(np.cumsum(per[cut:]), _AT_ONCE, side="right")) + cut)
                f, z = first[cut:to].ravel(), size[cut:to].ravel()
                if total := int(z.sum()):
                    at = np.repeat(f - np.concatenate(([0], np.cumsum(z)[:-1])), z) + np.arange(total)
                    c = order[at]
                    q = np.repeat(active[lo + cut : lo + to], per[cut:to])
                    yield from self._verify(queries, q, c, hist, s, t, k)
                cut = to

    def _verify(self, queries, q, c, hist, s, t, k):
        """Distances of candidates that no earlier lookup has met, and that can still be among the k nearest."""
        x = queries[q] ^ self.codes[c]
        new = np.ones(len(x), bool)
        for i, (a, b) in enumerate(self.segments):
            if i != s:
                d = np.bitwise_count(x & _U(((1 << (b - a)) - 1) << a))
                new &= d > t if i < s else d >= t
        q, c, d = q[new], c[new], np.bitwise_count(x[new]).astype(np.int64)
        np.add.at(hist, (q, d), self.weights[c])
        asked, own = np.unique(q, return_inverse=True)
        near = d <= self._kth(hist[asked], k)[own]  # the kth distance only shrinks
        if near.any():
            yield q[near], c[near], d[near]


def _searcher(shared, k: int):
    def run(batches):
        batches = list(batches)  # one index block
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        codes = table.column("code").to_numpy().astype(np.int64).view(_U)
        ids = table.column("ids").to_pylist()
        first = np.array([i[0] for i in ids], np.int64)
        index, queries = Index(codes, np.array([len(i) for i in ids], np.int64)), shared.value
        for lo in range(0, len(queries), 4096):
            part = queries[lo : lo + 4096]
            q, c, d = index.search(part, k)
            order = np.lexsort((first[c], d, q))
            q, c, d = q[order], c[order], d[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
            q, c, d = q[rank < k], c[rank < k], d[rank < k]  # a class holds one row at least
            yield pa.RecordBatch.from_arrays([pa.array(part[q].view(np.int64)), pa.array(d, pa.int32()), pa.array([ids[i] for i in c], pa.list_(pa.int64()))], names=["code", "distance", "ids"])

    return run, "code bigint, distance int, ids array<bigint>"


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, vec_id, distance, rank``: for each query (query_id, code) the ``k`` rows (vec_id, code) with the
    smallest Hamming distance, ties to the smaller id; a query that is itself a row finds itself.

    Rows and queries with a null id or code take no part. Repeated ids count once. Fewer rows than ``k`` are all
    returned. Further columns are ignored.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "hamming")
    first = Window.partitionBy("code").orderBy("vec_id")
    known = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "code").where("vec_id is not null and code is not null")
    # the k smallest ids of a code; the rank has a group limit, so a hot code does not gather
    few = known.groupBy("code", "vec_id").agg(F.lit(1).alias("one")).withColumn("at", F.row_number().over(first)).where(F.col("at") <= k)
    classes = scratch.table(few.groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "classes")
    asked = scratch.table(queries.select(F.col("query_id").cast("bigint").alias("query_id"), "code").where("query_id is not null and code is not null").distinct(), "asked")
    codes = scratch.table(asked.select("code").distinct(), "codes")
    n = classes.count()
    blocks = max(1, -(-n // BLOCK_CLASSES), min(spark.sparkContext.defaultParallelism, n // 4096))
    dealt = classes.repartition(blocks)
    found, block = None, []

    def flush():
        nonlocal found, block
        run, schema = _searcher(spark.sparkContext.broadcast(np.array(block, np.int64).view(_U)), k)
        part = dealt.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
        block = []

    for r in codes.toLocalIterator():
        block.append(r["code"])
        if len(block) >= BLOCK_QUERIES:
            flush()
    if block or found is None:
        flush()
    by = Window.partitionBy("code").orderBy("distance", "vec_id")
    with arrow_rows(spark, 10_000):
        best = scratch.table(found.select("code", "distance", F.explode("ids").alias("vec_id")).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k), "best")
    return asked.join(best, "code").select("query_id", "vec_id", "distance", "rank")


def op2_hamming_topk(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", sign_code(F.col("embedding")).alias("code"))
    rows = Scratch(spark, "codes").table(rows, "codes")
    return top_k(rows, rows.where(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("query_id"), "code"))


OP2_SQL = """
with q as (select vec_id query_id, embedding a from embeddings where vec_id % 20 = 0),
d as (select query_id, vec_id, cast(len(list_filter(range(1, 65), lambda i: (a[i] > 0) <> (embedding[i] > 0))) as int) distance from q, embeddings)
select query_id, vec_id, distance, cast(r as int) as rank from (select *, row_number() over (partition by query_id order by distance, vec_id) r from d) where r <= 10
"""
