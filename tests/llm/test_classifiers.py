"""Held-out accuracy, edge cases and numpy against slow definitions for the three classifiers."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import labelled, language, quality, toxicity

EDGES = [(1, None), (2, ""), (3, " 12 !? "), (None, "hello there"), (4, "x"), (4, "x"), (5, "é" * 70_000)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, "c", 1.0) for i, t in EDGES], "doc_id long, text string, lang_pred string, score double")


def auc(scores, labels):
    pos = [s for s, y in zip(scores, labels, strict=True) if y]
    neg = [s for s, y in zip(scores, labels, strict=True) if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_folds(spark):
    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").select("doc_id", labelled.held_out(F.col("doc_id")).alias("h"))
    assert all(r["h"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in df.collect())


def test_sample_is_bounded_and_clean(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(100)] + [(7, "t7"), (None, "n"), (200, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(7, 0), (None, 1), (200, 1), (8, None)], "doc_id long, quality int")
    texts, ys = labelled.training_sample(docs, labels, "quality", F.min, rows=10)
    assert len(texts) <= 20 and len(set(texts)) == len(texts)
    for t, y in zip(texts, ys, strict=True):
        i = int(t[1:])
        assert zlib.crc32(str(i).encode()) % 5 and y == (0 if i == 7 else i % 2)


# --- language


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = language.op8_language_id(spark, sf).join(docs, "doc_id").where("held_out").collect()
    assert len(got) > 100 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark, edges):
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("the cat and dog", "en"), ("le chat et chien", "fr"), ("no", None), (None, "de")] * 30)], "doc_id long, text string, lang string")
    model = language.train(docs)
    assert model.langs == ["en", "fr"]
    got = sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(edges, model).collect()), key=repr)
    assert len(got) == len(EDGES)
    assert {d for d, lang, s in got if lang == "und" and s == 0} == {1, 2, 3}
    assert language.identify(edges, language.train(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_gram_counts_do_not_depend_on_steps(monkeypatch):
    text = "Ab, cd é 12 xyz " * 50
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "_STEP", 7)
    assert (language.gram_counts(text) == whole).all()
    assert language.gram_counts("12 ?") is None and language.gram_counts(None) is None


# --- quality


def test_quality_held_out(spark, sf):
    got = quality.op9_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert auc([r["score"] for r in got], [r["quality"] for r in got]) > 0.9
    assert sum(r["predicted"] for r in got if r["quality"] == 1) / sum(r["quality"] for r in got) > 0.95
    bad = [r["predicted"] for r in got if r["quality"] == 0]
    assert bad.count(0) / len(bad) > 0.6


def _slow_logit(model, text):
    """One text, position by position."""
    w, data = model.w, np.zeros(((len(text) + 4) // 128 + 1) * 128 + 4, np.uint8)
    data[: len(text)] = np.frombuffer(text, np.uint8)
    halves = (len(data) - 4) // 128
    h = []
    for p in range(halves * 32):
        a, b = (w["embed"][data[4 * (p + k) : 4 * (p + k) + 4]].reshape(-1) for k in (0, 1))
        h.append(w["bias"] if p == halves * 32 - 1 else a @ w["left"] + b @ w["right"] + w["bias"])
    pooled = np.maximum(np.array(h).reshape(halves, 32, -1).max(axis=1), 0)
    out = []
    for c in range(max(1, halves - 1)):
        z = pooled[c : c + 2].max(axis=0)
        fill = min(1, max(0, (len(text) - 128 * c) / 256))
        act = np.maximum(np.append(z, fill) @ w["hidden"] + w["hidden_bias"], 0)
        out.append(float(act @ w["out"] + w["out_bias"][0]))
    return max(out)


def test_network_equals_slow_definition(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [rng.integers(1, 255, n).astype(np.uint8).tobytes() for n in (0, 1, 120, 123, 124, 125, 128, 250, 1000, 5000)]
    model = quality.fit(texts, [1, 0] * 5, quality.Settings(visits=20))
    want = [_slow_logit(model, t) for t in texts]
    assert np.allclose(model.logits(texts), want, atol=1e-3)
    monkeypatch.setattr(quality, "_BATCH", 512)
    assert np.allclose(model.logits(texts), want, atol=1e-3)


def test_many_short_texts_are_scored_apart(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(1, 256, int(n), dtype=np.uint8)) for n in rng.integers(1, 60, 60)]
    model = quality.fit(texts[:20], [i % 2 for i in range(20)], quality.Settings(visits=20))
    model.w["bias"][:] = -0.5
    model.w["right"][:] *= 20
    alone = [float(model.logits([t])[0]) for t in texts]
    monkeypatch.setattr(quality, "_BATCH", 512)
    assert np.allclose(model.logits(texts), alone, atol=1e-4)
    assert np.allclose(model._logits(texts), alone, atol=1e-4)  # in parts, as for texts beyond two batches


def test_quality_edges(spark, edges):
    model = quality.fit([b"fine words here " * 20, b"$$$ &&& " * 40] * 10, [1, 0] * 10, quality.Settings(visits=80))
    got = quality.quality(edges, model).collect()
    assert len(got) == len(EDGES) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.keep_good(edges, model).columns == edges.columns
    assert quality.fit([], []).scores([None, b"x"]).min() > 0.9
    assert quality.keep_good(edges.limit(0), model).count() == 0


# --- toxicity


def test_toxicity_separates_and_shares_subwords():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aeioutrnsl"), 5)) for _ in range(400)]
    texts, labels = [], []
    for i in range(400):
        w = list(rng.choice(words, int(rng.integers(5, 200))))
        if i % 4 == 0:
            w[int(rng.integers(len(w)))] = str(rng.choice(["grobbler", "zwackhead", "vubbish"]))
        texts.append(" ".join(w).encode())
        labels.append(int(i % 4 == 0))
    model = toxicity.fit(texts[:300], labels[:300])
    p = model.scores(texts[300:])
    assert auc(p, labels[300:]) > 0.98 and ((p >= 0.5) == np.array(labels[300:])).mean() > 0.97
    new = model.scores([b"the grobblers! came", b"a zwackheadd there", " ".join(words[:50]).encode(), b"", None, b"| = |"])
    assert (new[:2] >= 0.5).all() and (new[2:] < 0.5).all()


def test_toxicity_windows():
    s, c = np.array([3.0, 0, 6, 1]), np.array([1, 0, 2, 1])
    assert np.allclose(toxicity.window_means(s, c, 1), [3, toxicity._CLEAN, 3, 1])
    assert np.allclose(toxicity.window_means(s, c, 2), [3, 3, 7 / 3])
    assert np.allclose(toxicity.window_means(s[:1], c[:1], 5), [3])
    assert np.allclose(toxicity.window_means(s[:0], c[:0], 1), [toxicity._CLEAN])


def test_toxicity_equals_slow_definition():
    """The average of a window's n-gram vectors through the linear layer and softmax; a text is its most toxic window."""
    cfg = toxicity.Settings(window=3, bucket_bits=10, dim=5)
    rng = np.random.default_rng(2)
    table, layer, bias = rng.standard_normal((1 << 10, 5)), rng.standard_normal((5, 2)), rng.standard_normal(2)
    model = toxicity.Model(table @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]), cfg)
    texts = [" ".join(rng.choice(["ab", "Cdé", "--", "xyzzy,", "q", "lorem"], n)).encode() for n in (1, 2, 3, 4, 9, 40)]
    for text, got in zip(texts, model.scores(texts), strict=True):
        ws, best = text.lower().split(), 0.0
        for at in range(max(1, len(ws) - 2)):
            rows = np.concatenate([toxicity._grams([w], cfg)[0] for w in ws[at : at + 3]])
            if len(rows):
                e = np.exp(table[rows].mean(axis=0) @ layer + bias)
                best = max(best, e[1] / e.sum())
        assert np.isclose(got, best) or best == 0 and got < 0.01


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] for r in got if r["toxic"] == 1)
    assert right / sum(r["toxic"] for r in got) > 0.85 and right / sum(r["predicted"] for r in got) > 0.85
    assert auc([r["score"] for r in got], [r["toxic"] for r in got]) > 0.95


def test_toxicity_edges(spark, edges, sf):
    model = toxicity.fit([b"you idiot", b"fine day"] * 20, [1, 0] * 20, toxicity.Settings(visits=120))
    got = toxicity.toxicity(edges, model).collect()
    assert len(got) == len(EDGES) and all(0 <= r["score"] < 0.5 for r in got if r["doc_id"] in (1, 2))
    assert toxicity.keep_clean(edges, model).columns == edges.columns
    assert toxicity.fit([], []).scores([b"anything"])[0] < 0.5
    assert toxicity.toxicity(edges.limit(0), model).count() == 0 and toxicity.keep_clean(edges.limit(0), model).count() == 0
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert toxicity.train(edges.limit(0), labels.limit(0)).scores([b"you idiot"])[0] < 0.5
