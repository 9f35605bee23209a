"""Quality by a byte-level convolutional network in numpy.

Bytes are embedded; learned filters, eight bytes wide and four apart, run over the whole document and are
max-pooled over overlapping chunks of 256 bytes. A small dense layer turns each chunk's pooled filters into a
logit of low quality; the document's is the largest of its chunks' logits. Training sends each document's error
through the chunk, and the filter positions, that were the maximum.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import labelled
from tessera.llm.batches import released, slices, texts

_STEP, _HALF = 4, 128  # bytes between filter positions, and in half a chunk
#: Bytes that run through the network at once.
_BATCH = 1 << 18


@dataclass(frozen=True)
class Settings:
    dim: int = 8
    filters: int = 32
    hidden: int = 16
    visits: int = 40_000  # texts that training looks at in all, each as often as any other
    short: float = 0.25
    rate: float = 0.008
    seed: int = 11


@dataclass
class Model:
    cfg: Settings
    w: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def padded(text: bytes | None) -> int:
        """Bytes that a text takes in ``blocks``."""
        return ((len(text or b"") + _STEP) // _HALF + 1) * _HALF

    def blocks(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All bytes, every text padded by zeros to whole half chunks; the first half of each text; its length."""
        sizes = np.array([len(t or b"") for t in texts])
        halves = (sizes + _STEP) // _HALF + 1  # at least one block of padding
        first = np.concatenate(([0], np.cumsum(halves)))
        data = np.zeros(first[-1] * _HALF, np.uint8)
        for t, at in zip(texts, first[:-1] * _HALF, strict=True):
            if t:
                data[at : at + len(t)] = np.frombuffer(t, np.uint8)
        return data, first, sizes

    def pooled(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filters max-pooled over half chunks, and the position of each maximum."""
        w, f = self.w, self.cfg.filters
        x = w["embed"][data].reshape(len(data) // _STEP, -1)
        h = x @ w["left"] + w["bias"]
        right = x @ w["right"]
        h[:-1] += right[1:]
        h[first[1:] * (_HALF // _STEP) - 1] = w["bias"]  # padding: the next text is not looked at
        h = h.reshape(-1, _HALF // _STEP, f)
        at = h.argmax(axis=1)
        return np.maximum(np.take_along_axis(h, at[:, None, :], 1)[:, 0], 0), at

    def chunks(self, pooled: np.ndarray, first: np.ndarray, sizes: np.ndarray):
        """Pooled filters of every chunk, the half that each maximum lies in, and each text's first chunk."""
        last = np.zeros(len(pooled), bool)
        last[first[1:] - 1] = True
        alone = np.diff(first) == 1
        start = np.flatnonzero(~last | np.isin(np.arange(len(pooled)), first[:-1][alone]))
        after = np.where(last[start], start, start + 1)
        later = pooled[after] > pooled[start]
        owner = np.searchsorted(first, start, side="right") - 1
        fill = np.clip((sizes[owner] - (start - first[owner]) * _HALF) / (2 * _HALF), 0, 1)
        return np.maximum(pooled[start], pooled[after]), np.where(later, after[:, None], start[:, None]), np.searchsorted(start, first[:-1]), fill

    def logits(self, texts: list[bytes | None]) -> np.ndarray:
        """The largest chunk logit of low quality of each text."""
        out = np.empty(len(texts))
        lo = 0
        while lo < len(texts):
            to, size = lo, 0
            while to < len(texts) and (to == lo or size + self.padded(texts[to]) <= _BATCH):
                size += self.padded(texts[to])
                to += 1
            out[lo:to] = self._logits(texts[lo:to])
            lo = to
        return out

    def _logits(self, texts) -> np.ndarray:
        data, first, sizes = self.blocks(texts)
        pooled = np.concatenate([self._pool_part(data, first, a) for a in self._parts(first)]) if len(data) > 2 * _BATCH else self.pooled(data, first)[0]
        z, _, begun, fill = self.chunks(pooled, first, sizes)
        return np.maximum.reduceat(self.dense(z, fill)[0], begun)

    def _parts(self, first):
        step = _BATCH // _HALF
        return [(a, min(a + step, int(first[-1]))) for a in range(0, int(first[-1]), step)]

    def _pool_part(self, data, first, part):
        """Pooled filters of some half chunks of very long texts, the next block's bytes being looked at within a text."""
        a, b = part
        piece = np.concatenate((data[a * _HALF : b * _HALF], data[b * _HALF : b * _HALF + _HALF], np.zeros(0 if (b + 1) * _HALF <= len(data) else _HALF, np.uint8)))
        ends = first[(first > a) & (first <= b)] - a
        return self.pooled(piece, np.concatenate(([0], ends, [len(piece) // _HALF])))[0][: b - a]

    def dense(self, z: np.ndarray, fill: np.ndarray):
        w = self.w
        x = np.concatenate((z, fill[:, None]), axis=1, dtype=np.float32)
        a = np.maximum(x @ w["hidden"] + w["hidden_bias"], 0)
        return a @ w["out"] + w["out_bias"], a, x

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """Probability that each text is of high quality."""
        return 1 / (1 + np.exp(np.clip(self.logits(texts).astype(np.float64), -500, 500)))


def fit(texts: list[bytes], labels: list[int], cfg: Settings = Settings()) -> Model:
    """Train on labelled texts (1: high quality) with Adam; without both classes every text counts as good."""
    rng = np.random.default_rng(cfg.seed)
    # good texts are good from their first words on: short beginnings teach what little text looks like
    begun = [t[: int(rng.integers(0, 100))].decode("utf-8", "ignore").encode() for t, y in zip(texts, labels, strict=True) if y == 1 and rng.random() < cfg.short]
    texts, labels = [*texts, *begun], [*labels, *[1] * len(begun)]
    d, f, k = cfg.dim * _STEP, cfg.filters, cfg.hidden
    draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    w = {"embed": draw(256, cfg.dim, scale=0.5), "left": draw(d, f, scale=0.25), "right": draw(d, f, scale=0.25), "bias": np.zeros(f, np.float32), "hidden": draw(f + 1, k, scale=0.25), "hidden_bias": np.zeros(k, np.float32), "out": draw(k, scale=0.25), "out_bias": np.zeros(1, np.float32)}
    model = Model(cfg, w)
    bad = 1.0 - np.array(labels, np.float32)
    if not len(bad) or bad.min() == bad.max():
        w["out"][:] = 0
        w["out_bias"][:] = -5
        return model
    weight = np.where(bad == 1, 0.5 / bad.mean(), 0.5 / (1 - bad).mean()).astype(np.float32)
    m1, m2, t = {n: np.zeros_like(x) for n, x in w.items()}, {n: np.zeros_like(x) for n, x in w.items()}, 0
    per = _HALF // _STEP
    epochs = -(-cfg.visits // len(texts))
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        at = 0
        while at < len(order):
            to, size = at, 0
            while to < len(order) and to - at < 32 and (to == at or size + len(texts[order[to]]) <= _BATCH):
                size += len(texts[order[to]])
                to += 1
            part, at = order[at:to], to
            data, first, sizes = model.blocks([texts[i] for i in part])
            pooled, where = model.pooled(data, first)
            z, half, begun, fill = model.chunks(pooled, first, sizes)
            logit, act, x = model.dense(z, fill)
            ends = np.append(begun[1:], len(logit))
            best = np.array([a + int(logit[a:b].argmax()) for a, b in zip(begun, ends, strict=True)])
            p = 1 / (1 + np.exp(-np.clip(logit[best], -50, 50)))
            dl = (p - bad[part]) * weight[part] / len(part)
            g = {"out": act[best].T @ dl, "out_bias": np.array([dl.sum()])}
            da = np.outer(dl, w["out"]) * (act[best] > 0)
            g["hidden"], g["hidden_bias"] = x[best].T @ da, da.sum(axis=0)
            dz = (da @ w["hidden"].T)[:, :f] * (z[best] > 0)
            row, col = np.nonzero(dz)
            h = half[best][row, col]
            pos = h * per + where[h, col]
            ok = pos + 1 < len(data) // _STEP
            row, col, pos = row[ok], col[ok], pos[ok]
            v = dz[row, col]
            byte = data.reshape(-1, _STEP)
            a0, a1 = w["embed"][byte[pos]].reshape(-1, d), w["embed"][byte[pos + 1]].reshape(-1, d)
            g["embed"] = np.zeros_like(w["embed"])
            hot = np.zeros((len(v), f), np.float32)
            hot[np.arange(len(v)), col] = v
            g["left"], g["right"], g["bias"] = a0.T @ hot, a1.T @ hot, hot.sum(axis=0)
            np.add.at(g["embed"], byte[pos].ravel(), (hot @ w["left"].T).reshape(-1, cfg.dim))
            np.add.at(g["embed"], byte[pos + 1].ravel(), (hot @ w["right"].T).reshape(-1, cfg.dim))
            t += 1
            rate = cfg.rate * min(1, 2 * (1 - epoch / epochs))
            for n in w:
                m1[n] += 0.1 * (g[n] - m1[n])
                m2[n] += 0.001 * (g[n] ** 2 - m2[n])
                w[n] -= (rate * (m1[n] / (1 - 0.9**t)) / (np.sqrt(m2[n] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return model


def _scorer(shared):
    def run(batches):
        model = shared.value
        for batch in slices(batches):
            p = model.scores(texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return run, "doc_id bigint, score double"


def train(docs: DataFrame, labels: DataFrame, cfg: Settings = Settings()) -> Model:
    """Fit on a bounded sample of labelled rows (see ``labelled``), never on the held-out fold."""
    return fit(*labelled.training_sample(docs, labels, "quality", F.min), cfg)


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for every row of ``docs``: the probability that its whole text is of high quality.

    Null and empty texts are scored as one chunk of padding; texts of any length are scored whole, in parts of bounded size.
    Ids may be null or repeat, and repeated rows are scored each; other columns are ignored; no rows give no rows. Without
    labels of both classes all texts count as good.
    """
    run, schema = _scorer(docs.sparkSession.sparkContext.broadcast(model))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), schema)


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with their columns; null texts are scored as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array(shared.value.scores(texts(batch)) >= threshold))

    return docs.mapInArrow(released(run), docs.schema)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """``documents`` by a model of the labelled ones outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = quality(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
