"""Gradient-boosted trees of a fixed depth, fitted to all rows by the tasks of one barrier job.

The method is MLlib's: logistic loss, each tree a regression on its gradient by the variance of weighted rows, candidate
thresholds from quantiles. MLlib runs a job for each level of each tree; here the tasks stay, each with its share of the
distinct binned vectors, and add up their histograms over sockets.
"""

from __future__ import annotations

import hmac
import math
import secrets
import socket
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import Scratch

#: A task has so many distinct vectors at least, if there are as many.
TASK_VECTORS = 20_000
#: Cells of a table that counts several features together; rows that are counted, and scored, at a time.
_CELLS, _CHUNK, _SCORED = 4096, 1 << 16, 1 << 14
#: Positives and negatives are counted as one number while a task has fewer of each.
_PACK = float(1 << 26)
_TREES = "tree int, feature array<int>, threshold array<double>, value array<double>"


@dataclass
class BoostedTrees:
    """Perfect trees in heap order, a row for each. At a node, values up to its threshold go left; a node that is not
    split has the threshold infinity. ``value`` has the leaves' parts of the margin."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def __post_init__(self):
        real = np.isfinite(self.threshold)
        n = 1 + int(self.feature.max(initial=0))
        self.edges = [np.unique(self.threshold[real & (self.feature == f)]) for f in range(n)]
        if any(len(e) > 65_534 for e in self.edges):
            raise ValueError("a feature has more than 65,534 thresholds")
        self.cut = np.full(self.threshold.shape, 65_535, np.uint16)
        for f, e in enumerate(self.edges):
            here = real & (self.feature == f)
            self.cut[here] = np.searchsorted(e, self.threshold[here])

    def probability(self, columns: list[np.ndarray]) -> np.ndarray:
        """Of label 1, for rows given as one array a feature; a missing value is above all thresholds."""
        out, depth = np.empty(len(columns[0])), self.value.shape[1].bit_length() - 1
        for at in range(0, len(out), _SCORED):
            x = np.stack([np.searchsorted(e, c[at : at + _SCORED]).astype(np.uint16) for e, c in zip(self.edges, columns, strict=False)])
            n = x.shape[1]
            flat, row, margin = x.ravel(), np.arange(n), np.zeros(n)
            for feature, cut, value in zip(self.feature * n, self.cut, self.value, strict=True):
                node = np.zeros(n, np.intp)
                for level in range(depth):
                    place = feature.take(node) + row if level else feature[0] + row
                    right = flat.take(place) > (cut.take(node) if level else cut[0])
                    node <<= 1
                    node += 1
                    node += right
                node -= len(value) - 1
                margin += value.take(node)
            out[at : at + _SCORED] = 1 / (1 + np.exp(-2 * margin))
        return out

    def score(self, df: DataFrame, features: tuple[str, ...]) -> DataFrame:
        """Adds ``score``, the probability of label 1."""

        def run(batches):
            for b in batches:
                columns = [_numbers(b.column(f)) for f in features]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(self.probability(columns), pa.float64())], names=[*b.schema.names, "score"])

        return df.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), "score double"]))

    def save(self, path: str) -> None:
        rows = [(k, f.tolist(), t.tolist(), v.tolist()) for k, (f, t, v) in enumerate(zip(self.feature, self.threshold, self.value, strict=True))]
        SparkSession.active().createDataFrame(rows, _TREES).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, path: str) -> BoostedTrees:
        return cls._of(SparkSession.active().read.schema(_TREES).parquet(path).collect())

    @classmethod
    def _of(cls, rows) -> BoostedTrees:
        rows = sorted(rows, key=lambda r: r["tree"])
        return cls(*(np.array([r[c] for r in rows], kind) for c, kind in (("feature", np.intp), ("threshold", np.float64), ("value", np.float64))))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def fit(df: DataFrame, features: tuple[str, ...], rounds: int, depth: int, rate: float, least: int, bins: int = 32) -> BoostedTrees:
    """Trees for ``label`` 0 or 1 over all rows of ``df``, which is read twice. Positive rows weigh negatives per positive.

    A feature has up to ``bins`` bins, half of them by the quantiles of each label. Rows with the same bins are one vector
    with two counts, so nothing is lost; the vectors must fit the tasks' memory, at about 60 bytes each with 17 features.
    The job needs all its tasks at once: one for each core of the cluster, or fewer for few vectors.
    """
    if not 2 <= bins <= 255:
        raise ValueError("bins must be from 2 to 255")
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "boosting")
    df = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col("label").cast("int").alias("label"))
    half = bins // 2
    marks = [k / max(1, half - 1) for k in range(half)]
    found = {r["label"]: r for r in df.groupBy("label").agg(F.count("*").alias("n"), *[F.percentile_approx(f, marks, 1000).alias(f) for f in features]).collect()}
    up = max(1e-6, (found[0]["n"] if 0 in found else 0) / max(1, found[1]["n"] if 1 in found else 0))
    edges = []
    for f in features:
        values = np.array([v for r in found.values() for v in r[f] or ()], np.float64)
        values = np.unique(values[np.isfinite(values)])
        edges.append(values[:-1] + (values[1:] - values[:-1]) / 2)

    def binned(batches):
        for b in batches:
            x = np.stack([np.searchsorted(e, _numbers(b.column(f))).astype(np.uint8) for f, e in zip(features, edges, strict=True)], axis=1)
            keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(features)), len(x), [None, pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([keys.cast(pa.binary()), b.column("label")], names=["bins", "label"])

    one = F.count_if(F.col("label") == 1)
    vectors = scratch.table(df.mapInArrow(binned, "bins binary, label int").groupBy("bins").agg(one.alias("p"), (F.count("*") - one).alias("q")), "vectors")
    tasks = max(1, min(spark.sparkContext.defaultParallelism, vectors.count() // TASK_VECTORS))
    widths, token = [len(e) + 1 for e in edges], secrets.token_bytes(32)

    def run(batches):
        found = [(b"".join(b.column("bins").to_pylist()), b.column("p").to_numpy(), b.column("q").to_numpy()) for b in batches]
        x = np.frombuffer(b"".join(f[0] for f in found), np.uint8).reshape(-1, len(widths))
        p, q = (np.concatenate([np.zeros(0), *(f[i] for f in found)]) for i in (1, 2))
        del found
        order = np.lexsort(x.T)  # like vectors side by side go to the same nodes, which saves a seventh of the time
        x, p, q = x[order], p[order], q[order]
        ranks = _Ranks(token) if tasks > 1 else _Alone()
        trees = list(_Task(ranks, np.ascontiguousarray(x.T), p, q, widths, up, depth, least).trees(rounds, rate))
        ranks.close()
        if ranks.rank == 0:
            for k, (feature, cut, value) in enumerate(trees):
                threshold = [float(edges[f][c]) if c >= 0 else math.inf for f, c in zip(feature, cut, strict=True)]
                yield pa.RecordBatch.from_pylist([{"tree": k, "feature": feature.tolist(), "threshold": threshold, "value": value.tolist()}], pa.schema([("tree", pa.int32()), ("feature", pa.list_(pa.int32())), ("threshold", pa.list_(pa.float64())), ("value", pa.list_(pa.float64()))]))

    model = BoostedTrees._of(vectors.repartition(tasks).mapInArrow(run, _TREES, barrier=tasks > 1).collect())
    scratch.drop("vectors")
    return model


class _Alone:
    rank = 0

    def total(self, x: np.ndarray) -> np.ndarray:
        return x

    def share(self, x: np.ndarray) -> np.ndarray:
        return x

    def close(self) -> None:
        pass


class _Ranks:
    """The tasks of a barrier stage as a binary tree: arrays are added up towards rank 0 and shared from it."""

    def __init__(self, token: bytes):
        ctx = BarrierTaskContext.get()
        self.rank, hosts = ctx.partitionId(), [t.address.rsplit(":", 1)[0] for t in ctx.getTaskInfos()]
        below = [k for k in (2 * self.rank + 1, 2 * self.rank + 2) if k < len(hosts)]
        door = socket.create_server(("", 0), backlog=16)
        ports = ctx.allGather(str(door.getsockname()[1]))
        self.up, self.down = None, {}
        if self.rank:
            above = (self.rank - 1) // 2
            self.up = socket.create_connection(("127.0.0.1" if hosts[above] == hosts[self.rank] else hosts[above], int(ports[above])), 60)
            self.up.sendall(token + self.rank.to_bytes(4, "big"))
        door.settimeout(60)
        while len(self.down) < len(below):
            s, _ = door.accept()
            s.settimeout(60)
            hello = bytearray(36)
            _fill(s, hello)
            if hmac.compare_digest(hello[:32], token):
                self.down[int.from_bytes(hello[32:], "big")] = s
        door.close()
        for s in self._all():
            s.settimeout(None)
            s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    def _all(self):
        return [*([self.up] if self.up else []), *(self.down[k] for k in sorted(self.down))]

    def total(self, x: np.ndarray) -> np.ndarray:
        """The sum over all ranks, at rank 0."""
        part = np.empty_like(x)
        for k in sorted(self.down):  # always in the same order
            _fill(self.down[k], memoryview(part).cast("B"))
            x = x + part
        if self.up:
            self.up.sendall(memoryview(x).cast("B"))
        return x

    def share(self, x: np.ndarray) -> np.ndarray:
        """Rank 0's array; others give one of its shape."""
        if self.up:
            _fill(self.up, memoryview(x).cast("B"))
        for s in self.down.values():
            s.sendall(memoryview(x).cast("B"))
        return x

    def close(self) -> None:
        for s in self._all():
            s.close()


def _fill(s: socket.socket, into) -> None:
    view = memoryview(into)
    while len(view):
        n = s.recv_into(view)
        if not n:
            raise ConnectionError("another task of the stage ended")
        view = view[n:]


class _Task:
    """One rank's vectors: ``x`` (features, vectors) with the bins, ``p`` and ``q`` their positive and negative rows."""

    def __init__(self, ranks, x: np.ndarray, p: np.ndarray, q: np.ndarray, widths: list[int], up: float, depth: int, least: int):
        self.ranks, self.x, self.p, self.q, self.up, self.depth, self.least = ranks, x, p, q, up, depth, max(1, least)
        self.widths, self.bins = widths, max(widths)
        self.weight = up * p + q
        self.counts = [p + _PACK * q] if max(p.sum(), q.sum()) < _PACK else [p, q]
        # several features are counted in one table, which holds every combination of their bins
        self.groups: list[tuple[list[int], np.ndarray, int]] = []
        bags: list[tuple[list[int], int]] = []
        for f in sorted(range(len(widths)), key=lambda f: -widths[f]):
            k = next((k for k, (_, size) in enumerate(bags) if size * widths[f] <= _CELLS), len(bags))
            members, size = bags[k] if k < len(bags) else ([], 1)
            bags[k : k + 1] = [([*members, f], size * widths[f])]
        for members, size in bags:
            code = np.zeros(x.shape[1], np.uint16)
            for f in members:
                code *= np.uint16(widths[f])
                code += x[f]
            self.groups.append((members, code, size))

    def histograms(self, nodes: list[np.ndarray | None], gradient: np.ndarray) -> np.ndarray:
        """(3, nodes, features, bins): positives, negatives and gradient of the rows of each node, None being all."""
        values = [*self.counts, gradient]
        tables = [np.zeros((len(values), len(nodes), size)) for _, _, size in self.groups]
        for k, rows in enumerate(nodes):
            n = self.x.shape[1] if rows is None else len(rows)
            for at in range(0, n, _CHUNK):
                part = slice(at, at + _CHUNK) if rows is None else rows[at : at + _CHUNK]
                some = [v[part] for v in values]
                for (_, code, size), table in zip(self.groups, tables, strict=True):
                    c = code[part].astype(np.intp)
                    for t, v in zip(table, some, strict=True):
                        t[k] += np.bincount(c, v, size)
        out = np.zeros((len(values), len(nodes), len(self.widths), self.bins))
        for (members, _, _), table in zip(self.groups, tables, strict=True):
            for f in members:
                table = table.reshape(*table.shape[:2], self.widths[f], -1)
                out[:, :, f, : self.widths[f]] = table.sum(axis=3)
                table = table.sum(axis=2)
        if len(values) == 3:
            return out
        q = np.floor(out[0] / _PACK)
        return np.stack([out[0] - _PACK * q, q, out[1]])

    def choose(self, hist: np.ndarray) -> np.ndarray:
        """(nodes, 5): feature or -1, last bin of the left child, which child has fewer rows, values of both children or
        the node's own."""
        p, q, g = np.cumsum(hist, axis=3)
        n, w = p + q, self.up * p + q
        whole = lambda x: x[:, :, -1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            nr, wr, gr = whole(n) - n, whole(w) - w, whole(g) - g
            gain = np.where((n >= self.least) & (nr >= self.least), g * g / w + gr * gr / wr - whole(g) ** 2 / whole(w), 0.0)
            best = np.nan_to_num(gain).reshape(len(gain), -1)
            at = best.argmax(axis=1)
            k = np.arange(len(at))
            f, b = np.divmod(at, self.bins)
            own = np.nan_to_num(g[:, 0, -1] / w[:, 0, -1])
            split = best[k, at] > 0
            left, right = (g[k, f, b] / w[k, f, b]), (gr[k, f, b] / wr[k, f, b])
        return np.stack([np.where(split, f, -1), b, n[k, f, b] > nr[k, f, b], np.where(split, left, own), np.where(split, right, own)], axis=1).astype(np.float64)

    def trees(self, rounds: int, rate: float):
        """Each tree as features, last left bins (-1 where all go left) and leaf values in heap order."""
        margin = np.zeros(self.x.shape[1])
        for t in range(rounds):
            # MLlib's first tree fits labels of -1 and 1 and counts in full
            gradient = self.up * self.p - self.q if t == 0 else 4 * (self.weight / (1 + np.exp(2 * margin)) - self.q)
            yield self._tree(gradient, margin, 1.0 if t == 0 else rate)

    def _tree(self, gradient: np.ndarray, margin: np.ndarray, share: float):
        inner = (1 << self.depth) - 1
        feature, cut, value = np.zeros(inner, np.int32), np.full(inner, -1, np.int32), np.zeros(inner + 1)
        nodes: list[tuple[int, np.ndarray]] = [(0, np.arange(len(margin), dtype=np.intp))]
        hist = self.ranks.total(self.histograms([None], gradient))
        for level in range(self.depth):
            last = level == self.depth - 1
            choice = self.ranks.share(self.choose(hist) if self.ranks.rank == 0 else np.empty((len(nodes), 5)))
            after, fewer = [], []
            for (node, rows), (f, b, small, *values) in zip(nodes, choice, strict=True):
                ends = self.depth - level  # levels below
                if f < 0:
                    value[((node + 1) << ends) - 1 - inner] = share * values[0]
                    margin[rows] += share * values[0]
                    continue
                feature[node], cut[node] = f, b
                left = self.x[int(f)].take(rows) <= b
                if last:
                    value[2 * node + 1 - inner : 2 * node + 3 - inner] = share * np.array(values)
                    margin[rows] += share * np.where(left, *values)
                else:
                    children = rows[left], rows[~left]
                    after += [(2 * node + 1 + side, own) for side, own in enumerate(children)]
                    fewer.append(children[int(small)])
            if not after:
                break
            found = self.ranks.total(self.histograms(fewer, gradient))
            if self.ranks.rank == 0:  # the other child has the rest
                split = choice[:, 0] >= 0
                rest, small = hist[:, split] - found, choice[split, 2][:, None, None] > 0
                hist = np.stack([np.where(small, rest, found), np.where(small, found, rest)], axis=2).reshape(3, -1, *found.shape[2:])
            nodes = after
        return feature, cut, value
