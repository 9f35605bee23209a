"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is its character n-grams, hashed to rows of an embedding table; a window of ``Settings.window`` consecutive words
is the average of all its n-grams' vectors, which a linear layer and a softmax turn into a probability. Embeddings
and layer are trained together. The windows overlap and cover the whole document, which is as toxic as its most toxic
window: an average over a long text would hide one slur. Training pulls on each document's most toxic window;
words that were never seen share n-grams, and so vectors, with known ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import labelled
from tessera.llm.batches import released, slices, texts
from tessera.llm.shingles import mix

_U = np.uint64
_STRIP = "".join(c for c in map(chr, range(33, 128)) if not c.isalnum())
#: The margin of what has no n-grams.
_CLEAN = -10.0
#: Words whose sums a worker remembers at once.
REMEMBERED = 250_000


@dataclass(frozen=True)
class Settings:
    grams: tuple[int, ...] = (3, 4, 5)
    bucket_bits: int = 17
    dim: int = 12
    window: int = 4
    visits: int = 40_000  # documents that training looks at in all, each as often as any other
    clean_windows: int = 4
    rate: float = 0.15
    seed: int = 7


def words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def _grams(tokens: list[bytes], cfg: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the tokens, and each token's first position there (with the end)."""
    data = [f"<{t.decode('utf-8', 'replace').lower().strip(_STRIP)}>".encode("utf-32-le") for t in tokens]  # malformed bytes as U+FFFD
    code = np.frombuffer(b"".join(data), np.uint32).astype(_U)
    sizes = np.array([len(d) // 4 for d in data])
    owner = np.repeat(np.arange(len(tokens)), sizes)
    buckets, owners = [], []
    for n in cfg.grams:
        if len(code) < n:
            continue
        h = np.zeros(len(code) - n + 1, _U)
        for j in range(n):
            h = (h + code[j : j + len(h)]) * _U(0x9E3779B97F4A7C15)
            h ^= h >> _U(29)
        inside = owner[: len(h)] == owner[n - 1 :]
        buckets.append(mix(h[inside], n) >> _U(64 - cfg.bucket_bits))
        owners.append(owner[: len(h)][inside])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(len(tokens) + 1, np.int64)
    own = np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return np.concatenate(buckets)[order].astype(np.int64), np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(tokens)))))


def window_means(sums: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Mean over the n-grams of every window of ``width`` words; one window if there are fewer words.

    Windows without n-grams say nothing: they count as clean.
    """
    if width > 1:
        width = min(width, max(1, len(sums)))
        s, c = np.concatenate(([0], np.cumsum(sums))), np.concatenate(([0], np.cumsum(counts)))
        sums, counts = s[width:] - s[:-width], c[width:] - c[:-width]
    if not len(sums):
        return np.array([_CLEAN])
    return np.where(counts > 0, sums / np.maximum(1, counts), _CLEAN)


@dataclass
class Model:
    """``margin`` holds, per bucket, its vector's product with the difference of the two softmax rows."""

    margin: np.ndarray
    bias: float
    cfg: Settings

    def __post_init__(self):
        self.known: dict[bytes, complex] = {}

    def _learn(self, lists: list[list[bytes]]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({w for ws in lists for w in ws if w not in self.known})
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            buckets, first = _grams(part, self.cfg)
            total = np.concatenate(([0.0], np.cumsum(self.margin[buckets])))
            for w, s, c in zip(part, (total[first[1:]] - total[first[:-1]]).tolist(), np.diff(first).tolist(), strict=True):
                self.known[w] = complex(s, c)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """Probability of toxicity of each text: that of its most toxic window; of a text without words, of an empty one."""
        out = np.empty(len(texts))
        for lo in range(0, len(texts), 256):
            lists = [words(t) for t in texts[lo : lo + 256]]
            self._learn(lists)
            for i, ws in enumerate(lists):
                x = np.array([self.known[w] for w in ws], complex)
                out[lo + i] = window_means(x.real, x.imag, self.cfg.window).max() + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def fit(texts: list[bytes], labels: list[int], cfg: Settings = Settings()) -> Model:
    """Train embeddings and softmax layer on labelled texts; without both classes nothing counts as toxic."""
    y = np.array(labels, np.float64)
    size = 1 << cfg.bucket_bits
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(size), -5.0, cfg)
    rng = np.random.default_rng(cfg.seed)
    vocab: dict[bytes, int] = {}
    docs = [np.array([vocab.setdefault(w, len(vocab)) for w in words(t)] or [vocab.setdefault(b"", len(vocab))], np.int32) for t in texts]
    names, buckets, counts = list(vocab), [], []
    del vocab
    for lo in range(0, len(names), 20_000):
        own, at = _grams(names[lo : lo + 20_000], cfg)
        buckets.append(own.astype(np.int32))
        counts.append(np.diff(at))
    del names
    buckets, counts = np.concatenate(buckets), np.concatenate(counts)
    first = np.concatenate(([0], np.cumsum(counts)))
    table = (rng.random((size, cfg.dim)) - 0.5) * 0.1
    layer = (rng.random((cfg.dim, 2)) - 0.5) * 0.5
    bias = np.zeros(2)
    g_table, g_layer, g_bias = np.full(size, 1e-8), np.full(layer.shape, 1e-8), np.full(2, 1e-8)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    flat = np.concatenate(docs)
    starts = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    per = counts[flat]
    spans = [(lo, min(lo + 20_000, len(counts))) for lo in range(0, len(counts), 20_000)]
    for epoch in range(-(-cfg.visits // len(docs))):
        margin = table @ (layer[:, 1] - layer[:, 0])
        per_word = np.concatenate([np.add.reduceat(np.append(margin[buckets[first[lo] : first[hi]]], 0.0), first[lo:hi] - first[lo]) for lo, hi in spans])
        sums = np.where(counts > 0, per_word, 0.0)[flat]
        order = rng.permutation(len(docs))
        # the most toxic window of each document; of clean ones a few, and one at random
        picks = []
        for i in order:
            a, b = starts[i], starts[i + 1]
            m = window_means(sums[a:b], per[a:b], cfg.window)
            at = {int(rng.integers(len(m))) if epoch == 0 else int(m.argmax())}
            if y[i] == 0:
                at |= {*np.argpartition(m, -min(cfg.clean_windows, len(m)))[-cfg.clean_windows :].tolist(), int(rng.integers(len(m)))}
            elif epoch < 3:  # at first any window of a toxic text may be the one
                at |= set(rng.integers(len(m), size=8).tolist())
            picks += [(i, a + k, min(b, a + k + cfg.window)) for k in at]
        for lo in range(0, len(picks), 64):
            part = picks[lo : lo + 64]
            idx = [np.concatenate([buckets[first[w] : first[w + 1]] for w in flat[a:b]]) for _, a, b in part]
            n = np.array([len(x) for x in idx])
            use = np.flatnonzero(n)
            if not len(use):
                continue
            cat = np.concatenate([idx[k] for k in use])
            own = np.repeat(np.arange(len(use)), n[use])
            mean = np.zeros((len(use), cfg.dim))
            np.add.at(mean, own, table[cat])
            mean /= n[use][:, None]
            z = mean @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            docs_of = np.array([part[k][0] for k in use])
            p[np.arange(len(use)), y[docs_of].astype(int)] -= 1
            p *= weight[docs_of][:, None]
            d_mean = (p @ layer.T) / n[use][:, None]
            d_layer, d_bias = mean.T @ p / len(use), p.mean(axis=0)
            grad = np.zeros((len(uniq := np.unique(cat)), cfg.dim))
            np.add.at(grad, np.searchsorted(uniq, cat), d_mean[own])
            g_table[uniq] += (grad**2).mean(axis=1)
            table[uniq] -= cfg.rate * grad / np.sqrt(g_table[uniq])[:, None]
            g_layer += d_layer**2
            layer -= cfg.rate * d_layer / np.sqrt(g_layer)
            g_bias += d_bias**2
            bias -= cfg.rate * d_bias / np.sqrt(g_bias)
    return Model(table @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]), cfg)


def _scorer(shared):
    def run(batches):
        model = shared.value
        for batch in slices(batches):
            p = model.scores(texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return run, "doc_id bigint, score double"


def train(docs: DataFrame, labels: DataFrame, cfg: Settings = Settings()) -> Model:
    """Fit on a bounded sample of labelled rows (see ``labelled``), never on the held-out fold."""
    return fit(*labelled.training_sample(docs, labels, "toxic", F.max), cfg)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for every row of ``docs``: the probability of toxicity of its whole text.

    Null, empty and wordless texts get a low score; texts of any length are scored whole, malformed UTF-8 as U+FFFD. Ids may be null or repeat, and
    repeated rows are scored each; other columns are ignored; no rows give no rows. Without labels of both classes
    all scores are low.
    """
    run, schema = _scorer(docs.sparkSession.sparkContext.broadcast(model))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), schema)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with their columns; null and wordless texts stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array(shared.value.scores(texts(batch)) < threshold))

    return docs.mapInArrow(released(run), docs.schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """``documents`` by a model of the labelled ones outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
