"""The licence scan against comparing every passage with every template."""

import random
import re

import pytest

from tessera.llm import licences as L
from tessera.llm.decontaminate import words


def brute(text, templates, percent):
    """Matches without any pruning."""
    if not text:
        return []
    t = [(n, L.bigrams(words(x.encode()))) for n, x in templates]
    passages = [("line", p) for p in text.split("\n")]
    parts = re.split(r"\n[ \t\r]*\n", text)
    passages += [("paragraph", p) for p in parts] if len(parts) > 1 else []
    passages += [("text", text)] if "\n" in text else []
    out = []
    for kind, p in passages:
        b = L.bigrams(words(p.encode()))
        hits = [(-2 * len(b & g) / (len(b) + len(g)), n) for n, g in t if g and b and 200 * len(b & g) >= percent * (len(b) + len(g))]
        if hits:
            out.append((kind, min(hits)[1], -min(hits)[0]))
    return out


@pytest.mark.parametrize("percent", [50, 85, 100])
def test_equals_no_pruning(percent):
    rng = random.Random(percent)
    own = [(f"L{i}", " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))) for i in range(12)]
    t = L.Templates(own, percent)
    for _ in range(400):
        text = "".join(rng.choice("abcd") + rng.choice([" ", " ", " ", "\n", "\n \n"]) for _ in range(rng.randint(0, 30)))
        assert [(k, n, d) for k, _, _, n, d in t.scan(text.encode())] == brute(text, own, percent)


def test_templates_find_themselves():
    t = L.Templates()
    for name, text in L.TEMPLATES:
        wrapped = text.replace(". ", ".\n").upper()
        assert (1.0, name) == t.best(words(text.encode()))
        assert any(m[3] == name and m[4] == 1.0 for m in t.scan(("Some prose here.\n\n" + wrapped + "\n\nMore of it.").encode()))


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "word"), (4, "x\nReleased under the MIT license!\ny"), (None, "Licensed under CC BY-NC 4.0."), (4, "\n\n\n"), (5, "a b " * 100_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, matches int")
    got = {(r["doc_id"], tuple(m["licence"] for m in r["matches"])) for r in L.scan(df).collect()}
    assert got == {(1, ()), (2, ()), (3, ()), (4, ("MIT",)), (None, ("CC-BY-NC-4.0",)), (4, ()), (5, ())}
    assert L.scan(df.limit(0)).count() == 0 and all(r["matches"] == [] for r in L.scan(df, ()).collect())


def test_query_equals_sql(spark, sf, duck):
    cols = ("doc_id", "n_matches", "licences", "best_dice")
    got = sorted(tuple(r[c] for c in cols) for r in L.op4_licence_scan(spark, sf).collect())
    assert got == sorted(duck.execute(L.OP4_SQL).fetchall()) and any(r[1] for r in got)


def brute_runs(w, templates, percent, lo=0):
    """The best of all runs of words, then of those before and after it."""
    best = None
    for i in range(len(w)):
        for j in range(i + 2, len(w) + 1):
            b = L.bigrams(w[i:j])
            for name, g in templates:
                if g and 200 * len(b & g) >= percent * (len(b) + len(g)):
                    x = (-2 * len(b & g) / (len(b) + len(g)), j - i, i, name)
                    best = x if best is None else min(best, x)
    if best is None:
        return []
    d, n, i, name = best
    return [*brute_runs(w[:i], templates, percent, lo), (lo + i, lo + i + n, name, -d), *brute_runs(w[i + n :], templates, percent, lo + i + n)]


@pytest.mark.parametrize("percent", [50, 85, 100])
def test_runs_equal_all_windows(percent):
    rng = random.Random(percent)
    own = [(f"L{i}", " ".join(rng.choice("abcd") for _ in range(rng.randint(2, 9)))) for i in range(8)]
    t, sets, some = L.Templates(own, percent), [(n, L.bigrams(words(x.encode()))) for n, x in own], 0
    for _ in range(150):
        w = [rng.choice("abcde") for _ in range(rng.randint(0, 22))]
        got = [(a // 2, (b + 1) // 2, n, d) for _, a, b, n, d in t.runs(" ".join(w).encode())]
        assert got == brute_runs([x.encode() for x in w], sets, percent)
        some += len(got)
    assert some


def test_notices_that_fill_no_passage():
    t = L.Templates()
    mit = next(x for n, x in L.TEMPLATES if n == "MIT" and len(x) > 500)
    a, b = mit.index("The above"), mit.index("THE SOFTWARE IS")
    parts = "\n\n".join((mit[:a], mit[a:b], mit[b:]))
    prose = " ".join(f"word{i}" for i in range(300))
    text = f"{prose}\n\n{parts}\n\n{prose}".encode()
    assert t.scan(text) == []
    ((kind, lo, hi, name, dice),) = t.matches(text)
    # the shortest of the best: "the software" at the end brings no new bigram
    assert (kind, name, dice) == ("run", "MIT", 1.0) and words(text[lo:hi]) == words(mit.encode())[:-2]
    line = b"Copyright (c) 2019 Foo Inc. Released under the MIT License."
    assert t.matches(line) == [("run", 28, 58, "MIT", 1.0)]
    bsd = next(x for n, x in L.TEMPLATES if n == "BSD-2-Clause")
    assert [m[3] for m in t.matches(f"{prose} {bsd.replace(' 1. ', chr(10) * 2 + '1. ').replace(' 2. ', chr(10) * 2 + '2. ')} {prose}".encode())] == ["BSD-2-Clause"]


def test_runs_do_not_repeat_passages():
    t = L.Templates()
    for text in (b"x y z\nReleased under the MIT License.\nx y z", b"This work is licensed under a Creative Commons Attribution 4.0 International License."):
        assert {m[0] for m in t.matches(text)} == {"line"}
    two = t.matches(b"It is released under the MIT License. Its texts are licensed under CC BY 4.0. Enjoy both of them.")
    assert [m[3] for m in two] == ["MIT", "CC-BY-4.0"]


def test_query_finds_runs(spark):
    rows = [(1, "Copyright (c) 2019 Foo Inc. Released under the MIT License."), (2, "Nothing of the kind.")]
    got = {r["doc_id"]: [m["licence"] for m in r["matches"]] for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["MIT"], 2: []}
