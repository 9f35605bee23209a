"""Multi-index hashing against comparing everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hamming as H


def brute(rows, queries, k):
    out = []
    for q, a in queries:
        best = sorted({((a ^ b) & (2**64 - 1), i) for i, b in rows}, key=lambda x: (x[0].bit_count(), x[1]))[:k]
        out += [(q, i, x.bit_count(), r + 1) for r, (x, i) in enumerate(best)]
    return sorted(out)


def codes(rng, n, spread):
    base = rng.integers(-(2**63), 2**63 - 1, max(1, n // 20), dtype=np.int64)
    out = []
    for i in range(n):
        c = int(base[rng.integers(len(base))]) & (2**64 - 1)
        for b in rng.integers(0, 64, int(rng.integers(0, spread + 1))):
            c ^= 1 << int(b)
        out.append((i, c - 2**64 if c >> 63 else c))
    return out


@pytest.mark.parametrize(("n", "spread", "k"), [(300, 3, 5), (3000, 12, 10), (3000, 64, 3), (4, 1, 10)])
def test_index_equals_comparing_all(n, spread, k, monkeypatch):
    rng = np.random.default_rng(n + spread)
    all_codes = np.unique(np.array([c for _, c in codes(rng, n, spread)], np.int64).view(np.uint64))
    weights = rng.integers(1, 3, len(all_codes))
    index = H.Index(all_codes, weights)
    queries = np.concatenate((all_codes[:40], rng.integers(0, 2**63, 10, dtype=np.uint64)))
    monkeypatch.setattr(H, "_AT_ONCE", 500)
    q, c, d = index.search(queries, k)
    got = sorted(zip(q.tolist(), c.tolist(), d.tolist(), strict=True))
    assert len(set(got)) == len(got)
    want = []
    for i, x in enumerate(queries):
        dist = np.bitwise_count(x ^ all_codes).astype(int)
        order = np.sort(np.repeat(dist, weights))
        kth = order[min(k, len(order)) - 1] if len(order) >= k else 65
        want += [(i, j, int(v)) for j, v in enumerate(dist) if v <= kth]
    assert got == sorted(want)


def test_radii_grow_only_until_covered(monkeypatch):
    rng = np.random.default_rng(3)
    some = np.unique(rng.integers(0, 2**64 - 1, 2000, dtype=np.uint64))
    near = some[:50] ^ np.uint64(1)  # two codes at distance 1 at most
    index = H.Index(np.unique(np.concatenate((some, near))), np.ones(2050, np.int64))
    radii, probe = [], H.Index._probe
    monkeypatch.setattr(H.Index, "_probe", lambda self, queries, active, hist, s, t, k: radii.append((t, len(active))) or probe(self, queries, active, hist, s, t, k))
    index.search(near, 2)
    assert {t for t, _ in radii} == {0}
    radii.clear()
    index.search(some[100:120], 2)  # the second is far, so radii grow, but not to the last
    assert 0 < max(t for t, _ in radii) < max(b - a for a, b in index.segments)
    assert len(index.search(near[:1], len(index.codes) + 1)[1]) == len(index.codes)  # more than there are: everything is met, once


def test_hot_codes_nulls_and_ties(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(H, "BLOCK_CLASSES", 50)
    rows = codes(np.random.default_rng(1), 400, 6) + [(1000 + i, 12345) for i in range(300)] + [(5, 777)]
    df = spark.createDataFrame([*rows, (None, 5), (7, None), rows[0]], "vec_id long, code long").withColumn("ids", F.lit(1)).withColumn("distance", F.lit("x"))
    queries = [(i, c) for i, c in rows if i % 20 == 0]
    ask = spark.createDataFrame([*queries, (None, 3), (9, None)], "query_id long, code long")
    got = sorted(map(tuple, H.top_k(df, ask, 10).collect()))
    assert got == brute(rows, queries, 10)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, code long")
    one = spark.createDataFrame([(1, 5)], "vec_id long, code long")
    ask = lambda d: d.withColumnRenamed("vec_id", "query_id")
    assert H.top_k(none, ask(one)).count() == 0 and H.top_k(one, ask(none)).count() == 0
    assert list(map(tuple, H.top_k(one, ask(one)).collect())) == [(1, 1, 0, 1)]


def test_sign_code(spark):
    df = spark.createDataFrame([([1.0, -1.0, 0.0] + [2.0] * 61,), ([0.5],), (None,)], "v array<double>")
    got = [r[0] for r in df.select(H.sign_code(F.col("v"))).collect()]
    assert got == [(2**64 - 1 - 6) - 2**64, 1, None]


def test_query_equals_sql(spark, sf, duck):
    assert sorted(tuple(r[c] for c in ("query_id", "vec_id", "distance", "rank")) for r in H.op2_hamming_topk(spark, sf).collect()) == sorted(duck.execute(H.OP2_SQL).fetchall())
