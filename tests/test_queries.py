"""Every query with an oracle equals it; the others keep their invariants."""

import pytest

import __spark_entry__ as entry
from tessera.plans import registry


def plain(v):
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["gbt_score", "lr_score"])
def test_models_beat_chance(spark, sf, name):
    rows = registry.QUERIES[name](spark, sf).collect()
    pos = [r["score"] for r in rows if r["label"] == 1]
    neg = [r["score"] for r in rows if r["label"] == 0]
    assert sum(pos) / len(pos) > sum(neg) / len(neg) + 0.3


def test_isotonic_is_monotone(spark, sf):
    rows = sorted((r["raw_score"], r["score"]) for r in registry.QUERIES["isotonic_calibration"](spark, sf).collect())
    assert all(a[1] <= b[1] + 1e-12 for a, b in zip(rows, rows[1:], strict=False)) and 0 <= rows[0][1] <= rows[-1][1] <= 1


def test_fuzzy_features_in_range(spark, sf):
    from tessera.functions.features import FEATURES

    for r in registry.QUERIES["feature_fuzzy"](spark, sf).limit(3000).collect():
        assert all(-1e-9 <= r[f] <= 1 + 1e-9 for f in FEATURES if f != "idf_name_jac")


def test_same_result_for_any_partitioning(spark, sf):
    first = sorted(map(tuple, registry.QUERIES["decisions"](spark, sf).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(map(tuple, registry.QUERIES["decisions"](spark, sf).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
