"""Boosted trees against a plain definition, over one task and several."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import boosting, models

USED = ("x", "y", "z")


@pytest.fixture(scope="module")
def rows(spark):
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000))
    df = spark.range(1500).select("id", (h(1) % 12 / 11.0).alias("x"), (h(2) % 9 / 8.0).alias("y"), (h(3) % 2).cast("double").alias("z"), h(4).alias("noise"))
    hit = (F.col("x") + F.col("y") * F.col("z") > 1.1) != (F.col("noise") < 60)
    return df.withColumn("label", hit.cast("int")).drop("noise")


def plain(x, label, rounds, depth, rate, least):
    """Margins of the same method, a row and a threshold at a time."""
    weight = np.where(label == 1, (label == 0).sum() / (label == 1).sum(), 1.0)
    y, margin = 2 * label - 1.0, np.zeros(len(label))
    for t in range(rounds):
        target = y if t == 0 else 4 * y / (1 + np.exp(2 * y * margin))
        step = np.zeros(len(label))

        def grow(rows, left, target=target, step=step):
            w, r = weight[rows], target[rows]
            step[rows] = (w * r).sum() / w.sum()
            best = (1e-9, None)
            for f in range(x.shape[1]) if left else ():
                for v in np.unique(x[:, f])[:-1]:
                    a = x[rows, f] <= v
                    if min(a.sum(), (~a).sum()) >= least:
                        gain = sum((w[s] * r[s]).sum() ** 2 / w[s].sum() for s in (a, ~a)) - (w * r).sum() ** 2 / w.sum()
                        best = max(best, (gain, (f, v)), key=lambda c: c[0])
            if best[1]:
                a = x[rows, best[1][0]] <= best[1][1]
                grow(rows[a], left - 1)
                grow(rows[~a], left - 1)

        grow(np.arange(len(label)), depth)
        margin += step * (1.0 if t == 0 else rate)
    return 1 / (1 + np.exp(-2 * margin))


@pytest.mark.parametrize("least", [1, 20])
def test_equals_the_plain_definition(rows, least):
    got = boosting.fit(rows, USED, 6, 3, 0.3, least).score(rows, USED).orderBy("id").toPandas()
    want = plain(got[list(USED)].to_numpy(), got["label"].to_numpy(), 6, 3, 0.3, least)
    assert np.allclose(got["score"], want, atol=1e-9) and len(np.unique(want.round(9))) > 8


def test_several_tasks_make_the_same_trees(rows, monkeypatch):
    one = boosting.fit(rows, USED, 8, 4, 0.1, 5)
    monkeypatch.setattr(boosting, "TASK_VECTORS", 30)
    some = boosting.fit(rows, USED, 8, 4, 0.1, 5)
    assert (one.feature == some.feature).all() and (one.threshold == some.threshold).all() and np.allclose(one.value, some.value)


def test_no_job_for_each_level(spark, rows):
    spark.sparkContext.setJobGroup("boosting", "")
    try:
        models.fit_gbt(rows, USED, rounds=60, depth=6, least=5)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosting")) < 20
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_rare_values_missing_values_and_one_label(spark, rows):
    rare = rows.withColumn("z", F.when(F.col("id") < 30, 7.0).otherwise(0.0)).withColumn("label", (F.col("id") < 30).cast("int"))
    got = boosting.fit(rare, USED, 3, 2, 0.1, 20).score(rare, USED)
    assert got.where("(score > 0.5) = (label = 1)").count() == 1500
    holes = rows.withColumn("x", F.when(F.col("id") % 5 > 0, F.col("x"))).withColumn("y", F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("y")))
    got = boosting.fit(holes, USED, 3, 3, 0.1, 5).score(holes, USED)
    assert got.where("score > 0 and score < 1").count() == 1500
    for label, low, high in ((0, 0.0, 0.5), (1, 0.0, 1.0)):
        assert boosting.fit(rows.withColumn("label", F.lit(label)), USED, 2, 2, 0.1, 5).score(rows, USED).where(f"score between {low} and {high}").count() == 1500
    assert boosting.fit(rows.limit(0), USED, 2, 2, 0.1, 5).score(rows, USED).where("score = 0.5").count() == 1500
