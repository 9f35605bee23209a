"""Wu-Manber search against direct comparison at every position."""

import hashlib
import random

import pytest

from tessera.llm import decontaminate as D


def brute(text, items, window):
    w = D.words(text.encode() if text is not None else None)
    hit, found = set(), set()
    for name, t in items:
        p = D.words(t.encode() if t is not None else None)
        m = min(window, len(p))
        for i in range(len(p) - m + 1) if p else ():
            for j in range(len(w) - m + 1):
                if w[j : j + m] == p[i : i + m]:
                    hit |= set(range(j, j + m))
                    found.add(name)
    return len(w), len(hit), sorted(found)


def test_words():
    assert D.words("Aé_b2-\x80C\x7fD�".encode()) == ["aé".encode(), b"b2", "\x80c".encode(), "d�".encode()]


@pytest.mark.parametrize("window", [1, 2, 3, 5])
def test_equals_direct_comparison(window):
    rng = random.Random(window)
    word = lambda: rng.choice(["a", "b", "c", "dd"])
    items = [(str(i), " ".join(word() for _ in range(rng.randint(0, 8)))) for i in range(8)]
    table = D.build([(n, t.encode()) for n, t in items], window)
    for _ in range(150):
        text = " ".join(word() for _ in range(rng.randint(0, 40)))
        (n, spans, found), (m, *_) = table.search([text.encode(), None])
        assert (n, D.covered(spans), sorted(found)) == brute(text, items, window) and m == 0


def test_blocks_of_items(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("abcdefg")
    items = [(i, " ".join(word() for _ in range(12))) for i in range(30)] + [(99, "short one"), (98, None), (None, "a b"), (97, ""), (0, "Second text of nought")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    texts = [items[3][1].upper() + " tail", "x short-one y", None, "", "second TEXT of, nought", "z " * 50_000 + items[5][1]]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, texts[0], 5), (0, texts[0], 5)], "doc_id long, text string, items int")
    shared = D.benchmark_blocks(bench, 10, block_bytes=40)
    assert len(shared) > 5
    named = [(str(i), t) for i, t in items if i is not None]
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in D.contamination(docs, bench).collect()), key=repr)
    assert got == sorted([(r["doc_id"], *brute(r["text"], named, 10)) for r in docs.collect()], key=repr)
    run, _ = D._scanner(shared)
    import pyarrow as pa

    out = list(run([pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in enumerate(texts)], pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))]))
    assert [(r["n_hit"], r["items"]) for r in out[0].to_pylist()] == [brute(t, named, 10)[1:] for t in texts]
    assert sorted(map(str, (r["doc_id"] for r in D.clean(docs, bench).collect()))) == ["2", "3"]


def test_tables_are_compact_and_held_one_at_a_time(spark):
    rng = random.Random(3)
    vocab = [f"word{i}" for i in range(30_000)]
    items = [(str(i), " ".join(rng.choices(vocab, k=1000)).encode()) for i in range(100)]
    text = sum(len(t) for _, t in items)
    assert D.build(items).nbytes() < 10 * text
    shared = [spark.sparkContext.broadcast(D.build(items[i : i + 20])) for i in range(0, 100, 20)]
    held = []
    for block in D._held(shared):
        held.append(sum("_value" in vars(b) for b in shared))
        assert len(block.names) == 20
    assert max(held) <= 1 and not any("_value" in vars(b) for b in shared)
    assert [b.names[0] for b in D._held(shared)] == ["0", "20", "40", "60", "80"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r) for r in D.contamination(docs, none).collect()] == [(1, 2, 0, [])]
    assert D.contamination(docs.limit(0), none).count() == 0


def test_query_equals_sql(spark, sf, duck):
    got = sorted(map(tuple, D.op7_benchmark_decontamination(spark, sf).collect()))
    assert got == sorted(duck.execute(D.OP7_SQL).fetchall())
    assert any(r[5] for r in got) and all((r[4] == hashlib.sha256(b"").hexdigest()) == (r[3] == 0) for r in got)
