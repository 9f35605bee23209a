"""The Jaccard join against all pairs in plain Python."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard_join as J
from tessera.llm.shingles import shingle_sets

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = _WORD.findall((text or "").translate(_LOW))
    if len(w) >= n:
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def brute(rows, n, percent):
    """Per row: set size, smallest id reachable, links."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = collections.Counter()
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)), links[i]) for i, (d, _) in enumerate(rows)), key=repr)


def run(spark, rows, n, percent):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, key int, part string")
    got = J.jaccard_classes(df, n, percent, count_links=True).collect()
    alone = J.jaccard_classes(df, n, percent).collect()  # components without all links
    order = lambda rs: sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["class_id"], r["copies"]) for r in rs), key=repr)
    assert order(got) == order(alone)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got), key=repr)


def noisy(rng, words, rate):
    return [rng.choice("abcdefgh") * 3 if rng.random() < rate else w for w in words]


def corpus(seed, size):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, line = [], [rng.choice(vocab) for _ in range(12)]
    for i in range(size):
        words = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 4, 9, 20, 60, 150]))]
        if i % 3 == 0:
            words += line  # a line that many share
        rows.append((i * 7 + 3, " ".join(words)))
        for k in range(rng.choice([0, 0, 1, 4])):
            rows.append((10_000 + i * 10 + k, " ".join(noisy(rng, words, rng.choice([0, 0.003, 0.02, 0.05])))))
    return rows


EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one  two"), (8, "É a b"), (9, "é a b"), (10, "A B C D"), (10, "a b c d"), (None, "a b c d"), (None, "x y z"), (None, None), (11, "word " * 30_000)]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_equals_all_pairs(spark, n, percent):
    rows = corpus(n, 120) + EDGES
    assert run(spark, rows, n, percent) == brute(rows, n, percent)


def test_groups_split_into_slices(spark, monkeypatch):
    monkeypatch.setattr(J, "GROUP_CLASSES", 6)
    rng = random.Random(9)
    base = [f"v{i}" for i in range(120)]
    rows = [(i, " ".join(noisy(rng, base, 0.01))) for i in range(90)]
    assert run(spark, rows, 3, 90) == brute(rows, 3, 90)


def test_components_of_groups_with_outliers(spark, monkeypatch):
    """Small groups, several components and a passage that unlike texts share: groups connect as all pairs do."""
    monkeypatch.setattr(J, "GROUP_CLASSES", 5)
    rng = random.Random(5)
    one, two = [f"v{i}" for i in range(100)], [f"u{i}" for i in range(100)]
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(noisy(rng, one, rng.choice([0.002, 0.01, 0.03])))) for i in range(60)]
    rows += [(100 + i, " ".join(noisy(rng, two, 0.01))) for i in range(25)]
    rows += [(200 + i, " ".join([*passage, *(f"x{i}y{k}" for k in range(20))])) for i in range(40)]
    for n, percent in ((3, 90), (5, 80)):
        assert run(spark, rows, n, percent) == brute(rows, n, percent)


def _near(words, at):
    return " ".join("zz" if i == at else w for i, w in enumerate(words))


@pytest.mark.parametrize("one_id", [1, None])
def test_texts_under_one_id_keep_their_links(spark, monkeypatch, one_id):
    """Two texts with one id and, in the worst case, one text hash are both found by their set."""
    monkeypatch.setattr(J.F, "xxhash64", lambda c, *more, _own=J.F.xxhash64: J.F.lit(7).cast("bigint") if "text" in str(c) else _own(c, *more))
    a, b = [f"a{i}" for i in range(80)], [f"b{i}" for i in range(80)]
    rows = [(one_id, " ".join(a)), (one_id, " ".join(b)), (5, _near(a, 40)), (6, _near(b, 40))]
    assert run(spark, rows, 3, 90) == brute(rows, 3, 90)


def test_no_rows(spark):
    assert run(spark, [], 3, 90) == []
    df = spark.createDataFrame([], "doc_id long, text string, h_ string")
    assert J.keep_one(df).collect() == [] and J.keep_one(df).columns == df.columns


def test_keep_one(spark):
    text = " ".join(f"t{i}" for i in range(40))
    df = spark.createDataFrame([(5, text, "a"), (2, text + " z", "b"), (9, "other", "c"), (None, None, "d"), (7, "", "e"), (8, "", "f")], "doc_id long, text string, component_id string")
    assert sorted(r["component_id"] for r in J.keep_one(df).collect()) == ["b", "c", "d", "e", "f"]


def test_keep_one_row_of_each_component(spark):
    """Texts under one id, repeated rows, null ids and clashing names: each component keeps exactly one row."""
    a, b, c = ([f"{x}{i}" for i in range(60)] for x in "abc")
    rows = [(3, " ".join(a)), (3, " ".join(b)), (2, _near(b, 30)), (5, _near(a, 30)), (None, " ".join(c)), (None, " ".join(c)), (8, "q r"), (8, "q r")]
    df = spark.createDataFrame([(d, t, i, "x", "y") for i, (d, t) in enumerate(rows)], "doc_id long, text string, id_ int, h_ string, stays string")
    got = sorted(((r["doc_id"], r["text"]) for r in J.keep_one(df).collect()), key=repr)
    assert got == sorted([(3, " ".join(a)), (2, _near(b, 30)), (None, " ".join(c)), (8, "q r")], key=repr)


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_linked_sets_share_a_part(percent):
    rng = np.random.default_rng(percent)
    plan = J.PartPlan(percent)
    for size in [*range(1, 60), *rng.integers(60, 4000, 60).tolist()]:
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        most = len(a) * (100 - percent) // 100
        for _ in range(4):
            drop, add = int(rng.integers(0, most + 1)), int(rng.integers(0, most + 1))
            b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
                window = min(plan.of(len(a))[0][0], plan.of(len(b))[0][0])
                same = np.intersect1d(J.part_digests(a, plan), J.part_digests(b, plan))
                assert (same & np.uint64(J.WINDOWS - 1) == window).sum() >= plan.shares()[window]


def test_bound_never_closes_a_qualifying_group():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, 80).astype(np.uint64)) for _ in range(30)]
    sets += [np.delete(s, 0) for s in sets]
    a, b = sets[:25], sets[25:]
    u = lambda x: np.unique(np.concatenate(x))
    got = J._probe(a, b, u(b), 90)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            both = len(np.intersect1d(x, y))
            assert got[i, j] == (100 * both >= 90 * (len(x) + len(y) - both))
    own = J._own_links(sets, 90)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            both = len(np.intersect1d(x, y))
            assert own[i, j] == (i != j and 100 * both >= 90 * (len(x) + len(y) - both))


def test_shingle_counts():
    texts = ["a b c a b c", "", None, "  a ", "x y", "p q r s"]
    got = [len(s) for s in shingle_sets([None if t is None else t.encode() for t in texts], 3)]
    assert got == [len(shingles(t, 3)) for t in texts]


def test_whole_fixture(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").where(F.length("text") < 4000).collect()]
    got = {r[0]: r[1:] for r in run(spark, rows, 3, 90)}
    inverted = collections.defaultdict(list)
    sets = {d: shingles(t, 3) for d, t in rows}
    for d, s in sets.items():
        for g in s:
            inverted[g].append(d)
    both = collections.Counter((a, b) for ds in inverted.values() for i, a in enumerate(ds) for b in ds[:i])
    links = collections.Counter()
    for (a, b), k in both.items():
        if 100 * k >= 90 * (len(sets[a]) + len(sets[b]) - k):
            links[a] += 1
            links[b] += 1
            assert got[a][1] == got[b][1]
    assert all(got[d][0] == len(s) and got[d][2] == links[d] for d, s in sets.items())


def test_parts_asked_from_both_sides_count_together(spark):
    """A pair's parts lie in two buckets, of which each side asks in one: neither has as many as linked sets share."""
    join = J._Join(None, 90)
    window = J.PartPlan(90).shares().index(4)
    seat = lambda bucket, key, parts, grp, component, main, mostly: (bucket, window, key, parts, 100, grp, component, main, mostly)
    rows = [seat(1, 10, 2, 1, 10, 10, True), seat(1, 11, 2, 1, 10, 10, True), seat(1, 20, 2, 2, 20, 10, True)]
    rows += [seat(2, 10, 2, 1, 10, 10, False), seat(2, 20, 2, 2, 20, 10, False)]
    df = spark.createDataFrame(rows, "bucket long, window long, key long, parts long, n long, grp long, component long, main long, mostly boolean")
    asked = {(r["key"], r["grp"]) for r in join.to_all(df).collect()}
    assert asked & {(10, 2), (20, 1)}
