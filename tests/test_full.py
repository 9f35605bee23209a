"""The full queries, which have no oracle, against brute force on the smallest fixture."""

import math

import pytest

from tessera.functions import features as FE
from tessera.functions import lexicon as L
from tessera.functions import similarity as S
from tessera.operators import blocking
from tessera.plans import registry
from tessera.plans import sql as Q
from tessera.plans.linkage import Full
from tessera.streaming import incremental

SMALL = "/root/testdata/sf0.001"
FUZZY = {"jaro_winkler": S.jaro_winkler, "rf_token_sort": S.token_sort_ratio, "rf_token_set": S.token_set_ratio, "rf_partial": S.partial_ratio}


@pytest.fixture(scope="module")
def run(spark):
    return Full(spark, SMALL)


def test_linear_score_counts_all_fifteen_features(spark, run):
    rec = {r["entity_id"]: r for r in [*run.s1_pre.collect(), *run.pool_pre.collect()]}
    got = {(r["sid"], r["eid"]): r["score"] for r in registry.QUERIES["linear_score_full"](spark, SMALL).collect()}
    rest = run.features(fuzzy=False).collect()
    assert len(got) == len(rest) > 0
    lifted = 0
    for r in rest:
        a, b = rec[r["sid"]], rec[r["eid"]]
        f = r.asDict() | {k: g(a["folded"], b["folded"]) for k, g in FUZZY.items()} | {"rf_addr_sort": S.token_sort_ratio(a["addr_sq"], b["addr_sq"])}
        z = L.LINEAR_BIAS + sum(w * f[n] for n, w in zip(FE.FEATURES, L.LINEAR_WEIGHTS, strict=False))
        assert got[r["sid"], r["eid"]] == pytest.approx(1 / (1 + math.exp(-z)), abs=2e-6)
        short = L.LINEAR_BIAS + sum(w * r[n] for n, w in zip(FE.FEATURES, L.LINEAR_WEIGHTS, strict=False))
        lifted += short < 0 <= z
    assert lifted > 0


def test_decisions_follow_the_full_scores(spark, run):
    best: dict = {}
    for r in run.scored.collect():
        best.setdefault(r["sid"], []).append(r["score"])
    country = {r["sid"]: r["country"].strip().lower() for r in run.entities.collect()}
    want = 0
    for sid, s in best.items():
        s.sort(reverse=True)
        limit = 70 + max(10 * (country[sid] == "france"), 10 * (len(s) > 1 and s[0] - s[1] < 0.05))
        want += sum(x * 100 >= 50 for x in s) if s[0] * 100 >= limit else 0
    assert registry.QUERIES["decisions_full"](spark, SMALL).count() == want > 0


def test_micro_batches_equal_the_full_run(spark, run, tmp_path):
    run.s1.repartition(2).write.csv(str(tmp_path / "in"), sep="\t", quote="", header=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    stream = incremental.entity_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    q = incremental.start_linkage(stream, run.pool_pre, run.idf, FE.name_frequency(run.s1_pre), str(tmp_path / "out"), str(tmp_path / "cp"), cap=run.cap, max_posting=run.max_posting, fuzzy=True)
    q.awaitTermination(600)
    pairs = lambda df: {(r["sid"], r["eid"], r["score"]) for r in df.collect()}
    assert pairs(spark.read.parquet(str(tmp_path / "out"))) == pairs(run.scored.where("score >= 0.5"))


def test_full_limits(spark, sf, duck):
    rows = lambda df, *c: sorted(tuple(r[x] for x in c) for r in df.collect())
    want = duck.execute(f"with {Q.POSTINGS}, {Q.candidates(blocking.CAP, blocking.MAX_POSTING)} select sid, eid, rank from cand").fetchall()
    assert rows(registry.QUERIES["idf_overlap_candidates_full"](spark, sf), "sid", "eid", "rank") == sorted(want)
    found = dict(rows(registry.QUERIES["candidate_recall_at_k_full"](spark, sf), "k", "recall"))
    assert list(found) == [25, 50, 100, 200]
    reach = duck.execute(f"with {Q.POSTINGS}, {Q.candidates(200, 2000)}, g as (select sid, avg(cast(c.eid is not null as int)) r from gold left join cand c using (sid, eid) group by sid) select avg(r) from g").fetchone()[0]
    gate = registry.QUERIES["recall_gate_full"](spark, sf).first()
    assert found[200] == gate["recall"] == pytest.approx(reach, abs=1e-6) and gate["gate"] == "proceed"


def test_triple_union_full_reaches_beyond_thirty(spark):
    ranks = {r["rank"] for r in registry.QUERIES["triple_union_full"](spark, SMALL).select("rank").distinct().collect()}
    assert 30 < max(ranks) <= 500


def test_full_models_use_all_features_and_rounds(spark):
    gbt, lr = registry.QUERIES["gbt_score_full"], registry.QUERIES["lr_score_full"]
    assert gbt.keywords["used"] == lr.keywords["used"] == FE.FEATURES and (gbt.keywords["rounds"], gbt.keywords["depth"]) == (500, 6)
    for rows in (lr(spark, SMALL).collect(), gbt(spark, SMALL, rounds=2, depth=3).collect()):
        score = {k: [r["score"] for r in rows if r["label"] == k] for k in (0, 1)}
        assert sum(score[1]) / len(score[1]) > sum(score[0]) / len(score[0]) + 0.3


def test_scores_in_rounds_equal_those_at_once(spark, run, monkeypatch):
    monkeypatch.setattr(Full, "rounds", lambda self: 3)
    parts = Full(spark, SMALL)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(parts.scored) == rows(run.scored) and len(parts.scored.inputFiles()) >= 3


def test_pairs_meet_sums_of_their_records(run):
    left, right = FE.sides(run.s1_pre, run.pool_pre, run.idf, FE.name_frequency(run.s1_pre))
    assert {"a_sum", "a_norm", "a_sound"} <= set(left.columns) and "b_name_w" not in right.columns and dict(right.dtypes)["b_grams"] == "array<bigint>"
    pairs = run.candidates.select("sid", "eid")
    assert FE.compared(pairs, left, right).columns == ["sid", "eid", *FE.FEATURES]
