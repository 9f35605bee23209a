"""Tokens equal the tokenizer's, pieces cover documents, sequences hold what they may."""

import array
import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import packing as K

AWKWARD = ["", None, "  \n", "It's <|endoftext|>x a<|startoftext|> I'LL, ok. ...!, a., É. ß\x1c\x1dfoo\x85bar b é ́x 12.5, İ Σας. ½ ﬁ. 日本語。 １２,", "a." * 5000, "b" * 9000, "don't. 's. 'S, 've, l'll. , .", "word " * 3000]


def check(docs, rows, most=2048):
    tok = Tokenizer.from_file(str(public_tokenizers.path(K.TOKENIZER)))
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(i, k // most, k, len(ids[k : k + most]), zlib.crc32(array.array("I", ids[k : k + most]).tobytes())) for k in range(0, len(ids), most)]
    got = K.pack(docs).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= most
    return len(by), sum(r["length"] for r in got) / most


def test_fixture(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    used, least = check(d, [(r["doc_id"], r["text"]) for r in d.collect()])
    assert used <= least * 1.01 + 1


def test_awkward_texts(spark):
    rows = [*enumerate(AWKWARD), (None, "x"), (3, "again"), (3, "again")]
    check(spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, piece string, offset int"), rows)


def test_no_rows(spark):
    assert K.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_forgetting_changes_nothing(spark, monkeypatch):
    path = str(public_tokenizers.path(K.TOKENIZER))
    texts = [(t or "").encode() for t in AWKWARD]
    first = list(K.token_bytes(texts, path))
    monkeypatch.setattr(K, "REMEMBERED", 3)
    assert [list(K.token_bytes([t], path))[0] for t in texts] == first


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rng = np.random.default_rng(1)
    lengths = rng.integers(0, 900, 3000)
    cap = K.Capacity(1000, 5, 600_000, rule=rule)
    with pytest.raises(ValueError):
        K.pack_lengths(lengths, K.Capacity(1000, 5, 500_000))
    lengths = np.minimum(lengths, 700)
    seq, offset = K.pack_lengths(lengths, cap)
    assert np.bincount(seq).max() <= 5 and np.bincount(seq, lengths).max() <= 1000 and np.bincount(seq, lengths.astype(float) ** 2).max() <= 600_000
    for b in range(seq.max() + 1):
        own = np.flatnonzero(seq == b)
        own = own[np.lexsort((lengths[own], offset[own]))]
        assert (offset[own] == np.concatenate(([0], np.cumsum(lengths[own])[:-1]))).all()


def test_best_fit_beats_the_bound():
    rng = np.random.default_rng(2)
    lengths = np.minimum(2048, rng.lognormal(6.3, 1, 20_000).astype(int) + 1)
    assert K.pack_lengths(lengths)[0].max() + 1 <= lengths.sum() / 2048 * 1.01


def test_remembered_generations(monkeypatch):
    """Ids do not depend on what is remembered; a chunk that is met again outlives its generation."""
    path = str(public_tokenizers.path(K.TOKENIZER))
    texts = [f"stay w{i} v{i % 7}, x{i * i}".encode() for i in range(60)]
    want = list(K.token_bytes(texts, path))
    monkeypatch.setattr(K, "REMEMBERED", 10)
    monkeypatch.setattr(K, "_IDS", {})
    got = [x for i in range(0, 60, 4) for x in K.token_bytes(texts[i : i + 4], path)]
    assert got == want and b"stay" in K._IDS[path][2] and len(K._IDS[path][2]) + len(K._IDS[path][3]) < 60


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError, match="chunks"):
        K._tokenizer(str(public_tokenizers.path("byte_bpe_50k.json")))
