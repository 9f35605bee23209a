"""Joins, ranks, decisions and graphs on small tables against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import blocking, decide, dense, graph, lsh, metrics


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, 5001 + i) for i in range(300)] + [(9000, 9000)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x["node"]: x["component"] for x in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: find(n) for n in parent}


def test_small_components_are_few_jobs(spark, monkeypatch):
    """A long path and a hub: one task settles them with a few jobs, rounds come to the same."""
    order = random.Random(3).sample(range(300), 300)
    edges = [*zip(order, order[1:]), *((1000, 1000 + i) for i in range(50)), (2000, None), (None, 3000)]
    want = {i: 0 for i in range(300)} | {1000 + i: 1000 for i in range(50)}
    df = spark.createDataFrame(edges, "src long, dst long")
    for most in (len(edges), 0):
        monkeypatch.setattr(graph, "ONE_TASK_EDGES", most, raising=False)
        spark.sparkContext.setJobGroup(f"components-{most}", "")
        try:
            assert {x["node"]: x["component"] for x in graph.connected_components(df).collect()} == want
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components-{len(edges)}")) <= 8


def test_components_of_nothing(spark):
    assert graph.connected_components(spark.createDataFrame([(None, 1)], "src long, dst long")).count() == 0


def test_f05(spark):
    df = spark.createDataFrame([(["a", "b", "x"], ["a", "b"]), ([], []), (["a"], []), ([], ["a"]), (["x"], ["a"])], "p array<string>, g array<string>")
    assert [round(r[0], 6) for r in df.select(metrics.f05(F.col("p"), F.col("g"))).collect()] == [0.714286, 1.0, 0.0, 0.0, 0.0]


@pytest.mark.parametrize(("country", "gap", "want"), [("US", 0.5, 70), (" France ", 0.5, 80), ("US", 0.01, 80), ("france", 0.01, 80), ("US", None, 70)])
def test_effective_threshold(spark, country, gap, want):
    df = spark.createDataFrame([(country, gap)], "c string, g double")
    assert df.select(decide.effective_threshold(F.lit(70), F.col("c"), F.col("g"))).first()[0] == want


def test_ties_and_caps(spark):
    p = spark.createDataFrame([("s", f"e{i}", 1.0) for i in range(5)] + [("t", "e1", 2.0)], "sid string, eid string, score double")
    got = sorted(map(tuple, blocking.top(p, 3).select("sid", "eid", "rank", "capped").collect()))
    assert got == [("s", "e0", 1, True), ("s", "e1", 2, True), ("s", "e2", 3, True), ("t", "e1", 1, False)]


def test_union_order(spark):
    a = spark.createDataFrame([("s", "x", 1), ("s", "y", 2)], "sid string, eid string, rank int")
    b = spark.createDataFrame([("s", "y", 1), ("s", "z", 2)], "sid string, eid string, rank int")
    assert [r["eid"] for r in blocking.union_candidates(a, b).orderBy("rank").collect()] == ["x", "y", "z"]
    assert [r["eid"] for r in blocking.union_candidates(b, a, max_k=2).orderBy("rank").collect()] == ["y", "z"]


def test_knn_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_VALUES", 8)
    r = random.Random(1)
    v = [(str(i), [r.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(v, "eid string, v array<double>").repartition(5)
    got = {}
    for x in dense.knn(df.select(F.col("eid").alias("sid"), "v").where("eid < '3'"), df, 3).collect():
        got.setdefault(x["sid"], []).append((x["rank"], x["eid"]))
    for sid, q in v:
        if sid < "3":
            best = sorted((-sum(a * b for a, b in zip(q, w, strict=True)), e) for e, w in v)[:3]
            assert [e for _, e in sorted(got[sid])] == [e for _, e in best]


def test_lsh_is_part_of_exact(spark):
    r = random.Random(2)
    rows = [(str(i), list({r.randint(0, 40) for _ in range(12)})) for i in range(80)] + [("e", [])]
    df = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in rows], "eid string, sh array<string>")
    left = df.withColumnRenamed("eid", "sid")
    exact = {(x["sid"], x["eid"]) for x in lsh.exact_join(left, df, 0.4).collect()}
    near = {(x["sid"], x["eid"]) for x in lsh.lsh_join(left, df, 0.4).collect()}
    want = {(a, b) for a, s in rows for b, t in rows if s and t and round(len(set(s) & set(t)) / len(set(s) | set(t)), 6) >= 0.4}
    assert exact == want and near <= want and len(near) > 0.8 * len(want)


def test_closure(spark):
    m = spark.createDataFrame([("s", "a", 0.95), ("t", "c", 0.5)], "sid string, eid string, score double")
    links = spark.createDataFrame([("a", "b", 0.95), ("b", "d", 0.8), ("c", "e", 0.99)], "x string, y string, score double")
    assert sorted(map(tuple, decide.closure(m).collect())) == [("s", "a"), ("t", "c")]
    assert sorted(map(tuple, decide.closure(m, links).collect())) == [("s", "a"), ("s", "b"), ("t", "c")]


def test_validator_finds_faults(spark):
    s1 = spark.createDataFrame([("a",), ("b",), ("c",)], "entity_id string")
    pool = spark.createDataFrame([("p",), ("q",)], "entity_id string")
    cands = spark.createDataFrame([("a", "p")], "sid string, eid string")
    rows = spark.createDataFrame([("a", "p,p"), ("b", "b"), ("b", "q")], "source1_entity_id string, matched_entity_ids string")
    got = {r["rule"]: r["n"] for r in decide.violations(rows, s1, pool, cands).collect()}
    assert got == {"missing_record": 1, "repeated_record": 1, "repeated_match": 1, "self_match": 1, "unknown_match": 1, "match_outside_candidates": 2}


def test_merge_without_scorer(spark):
    s = spark.createDataFrame([("a", "b", 0.4)], "sid string, eid string, score double")
    assert decide.merge_scores(s, None) is s


def _small_sets(spark, seed=3):
    r = random.Random(seed)
    rows = [(str(i), [str(x) for x in {r.randint(0, 40) for _ in range(12)}]) for i in range(80)]
    rows += [(f"c{i}", rows[i % 5][1]) for i in range(20)] + [("e", [])]
    return rows, spark.createDataFrame(rows, "eid string, sh array<string>")


def test_joins_over_blocks_and_copies(spark, monkeypatch):
    """Blocks of the right side, equal sets and a bounded list give the pairs of all comparisons, candidates not being shuffled."""
    monkeypatch.setattr(lsh, "BLOCK_VALUES", 200)
    rows, df = _small_sets(spark)
    left = df.withColumnRenamed("eid", "sid")
    found = lsh.exact_join(left, df, 0.4)
    assert "SortMergeJoin" not in found._jdf.queryExecution().toString() and "BroadcastHashJoin" not in found._jdf.queryExecution().toString()
    score = {(a, b): round(len(set(s) & set(t)) / len(set(s) | set(t)), 6) for a, s in rows for b, t in rows if s and t}
    assert {(x["sid"], x["eid"]): x["score"] for x in found.collect()} == {p: v for p, v in score.items() if v >= 0.4}
    best = {a: sorted((-v, b) for (x, b), v in score.items() if x == a and v >= 0.4)[:7] for a, _ in rows}
    got = {(x["sid"], x["eid"], x["rank"]) for x in lsh.exact_join(left, df, 0.4, 7).collect()}
    assert got == {(a, b, i + 1) for a, bs in best.items() for i, (_, b) in enumerate(bs)}


def test_lsh_pairs_share_a_band(spark, monkeypatch):
    monkeypatch.setattr(lsh, "BLOCK_VALUES", 500)
    rows, df = _small_sets(spark)
    least = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda s: F.array_min(F.transform("sh", lambda x: F.xxhash64(x, s))))
    sig = {r["eid"]: r["s"] for r in df.where(F.size("sh") > 0).select("eid", least.alias("s")).collect()}
    score = {(a, b): round(len(set(s) & set(t)) / len(set(s) | set(t)), 6) for a, s in rows for b, t in rows if s and t}
    want = {(a, b) for (a, b), v in score.items() if v >= 0.4 and any(sig[a][k : k + 2] == sig[b][k : k + 2] for k in range(0, 16, 2))}
    got = {(x["sid"], x["eid"]) for x in lsh.lsh_join(df.withColumnRenamed("eid", "sid"), df, 0.4, None, 16, 2).collect()}
    assert got == want and len(want) < sum(v >= 0.4 for v in score.values())


def test_candidates_send_lists_and_keep_ties(spark, monkeypatch):
    """Posting lists of several rows, repeated and equal records, and more partners than the cap; pairs are not shuffled one by one."""
    monkeypatch.setattr(blocking, "LIST_IDS", 3)
    r = random.Random(4)
    rec = lambda i: (i, r.choice(["US", "FR"]), r.sample("abcde", 3), r.sample("pq", 1), r.sample("123", 1))
    schema = "entity_id string, country string, name_set array<string>, addr_set array<string>, house_set array<string>"
    s1, pool = [rec(f"s{i}") for i in range(20)], [rec(f"e{i}") for i in range(60)]
    pool.append(pool[7])
    want = {}
    for a in s1:
        score = {}
        for b in pool:
            if a[1] == b[1]:
                score[b[0]] = score.get(b[0], 0) + 2.0 * len(set(a[2]) & set(b[2])) + 1.2 * len(set(a[3]) & set(b[3])) + 8.0 * len(set(a[4]) & set(b[4]))
        best = sorted((-round(v, 6), e) for e, v in score.items() if v)
        want |= {(a[0], e): (-v, k + 1, len(best) > 9) for k, (v, e) in enumerate(best[:9])}
    found = blocking.candidates(spark.createDataFrame(s1, schema), spark.createDataFrame(pool, schema), None, 9, 1000)
    assert {(x["sid"], x["eid"]): (x["score"], x["rank"], x["capped"]) for x in found.collect()} == want
    assert "Window" not in found._jdf.queryExecution().toString()


def test_decide_reads_scores_once(spark, tmp_path):
    rows = [("a", "x", 0.9), ("a", "y", 0.82), ("a", "z", 0.82), ("b", "x", 0.72), ("b", "y", 0.71), ("c", "x", 0.75), ("d", "x", 0.75), ("e", "x", 0.4)]
    spark.createDataFrame(rows, "sid string, eid string, score double").write.parquet(str(tmp_path / "scores"))
    scores = spark.read.parquet(str(tmp_path / "scores"))
    entities = spark.createDataFrame([("a", "US"), ("b", "US"), ("c", "France"), ("d", "US"), ("e", "US")], "sid string, country string")
    got = decide.decide(entities, scores, 50, 70)
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted(map(tuple, got.collect())) == [("a", "x", 0.9, 1), ("a", "y", 0.82, 2), ("a", "z", 0.82, 3), ("d", "x", 0.75, 1)]
    assert {r["sid"]: r["gap"] and round(r["gap"], 6) for r in decide.entity_stats(scores).collect()} == {"a": 0.08, "b": 0.01, "c": None, "d": None, "e": None}


@pytest.mark.parametrize("pairs", [blocking.CELL_PAIRS, 2])
def test_hash_key_pairs_are_not_shuffled(spark, monkeypatch, pairs):
    monkeypatch.setattr(blocking, "CELL_PAIRS", pairs)
    records = lambda tag, own: spark.createDataFrame(
        [(i, "US", f"n{k % 2}", [f"n{k % 2}"], [str(k % 3)], "" if k == 4 else f"a{k % 2}", ["main", f"s{k % 2}"], "c" if k % 4 else "") for k, i in enumerate(own)],
        "entity_id string, country string, name_sq string, name_set array<string>, house_set array<string>, addr_sq string, addr_set array<string>, city string",
    )
    for left, right in (([f"a{i}" for i in range(7)], [f"b{i}" for i in range(9)]), (["a", "a", None, None, "d", "e"], ["x", "y", "y", None, "z", None, None, "w"])):
        s1, pool = records("a", left), records("b", right)
        keys = [df.select("entity_id", F.explode(F.array_compact("keys")).alias("key")).collect() for df in (blocking.hash_keys(s1, "entity_id"), blocking.hash_keys(pool, "entity_id"))]
        want = Counter((a["entity_id"], b["entity_id"]) for a in keys[0] for b in keys[1] if a["key"] == b["key"])
        found = blocking.hash_key_candidates(s1, pool)
        rows = [tuple(r) for r in found.collect()]
        assert len(rows) == len(want) > 9 and {(a, b): n for a, b, n in rows} == want
        if len(set(left)) == len(left):
            assert "keys=[sid" not in found._jdf.queryExecution().executedPlan().toString()


def test_best_sets_are_ranked_where_they_are_found(spark, monkeypatch):
    """Over several blocks, with equal sets, ties and a record of two sets; records' best are not shuffled to be ranked."""
    monkeypatch.setattr(lsh, "BLOCK_VALUES", 60)
    monkeypatch.setattr(lsh, "_LEFT_ROWS", 5)
    r = random.Random(8)
    sets = [sorted(r.sample("abcdefgh", r.randint(2, 5))) for _ in range(12)]
    right = [(f"e{i}", sets[i % 12]) for i in range(60)]
    df = spark.createDataFrame(right, "eid string, sh array<string>")
    for names in ([f"s{i}" for i in range(16)], ["s0", "s0", *[f"s{i}" for i in range(2, 16)]]):
        left = [(s, sets[i % 9]) for i, s in enumerate(names)]
        found = lsh.lsh_join(spark.createDataFrame(left, "sid string, sh array<string>"), df, 0.4, 6, 64, 1)
        near = lambda a, b: round(len({*a} & {*b}) / len({*a} | {*b}), 6)
        best: dict = {}
        for s, a in left:
            best.setdefault(s, []).extend((-near(a, b), e) for e, b in right if near(a, b) >= 0.4)
        want = sorted((s, e, -x, k + 1) for s, es in best.items() for k, (x, e) in enumerate(sorted(es)[:6]))
        got = sorted((x["sid"], x["eid"], x["score"], x["rank"]) for x in found.collect())
        assert got == want
        if len(set(names)) == 16:
            assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
