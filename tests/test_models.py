"""Model files, pluggable scorers and their training pairs."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import models


def rows(spark):
    return spark.range(400).select(F.col("id"), (F.col("id") % 20 / 20.0).alias("x"), (F.col("id") % 7 / 7.0).alias("y"), (F.col("id") % 20 >= 12).cast("int").alias("label"))


def test_save_and_load(spark, tmp_path):
    df, used = rows(spark), ("x", "y")
    for kind, model in (("gbt", models.fit_gbt(df, used, rounds=3, depth=2)), ("lr", models.fit_lr(df, used))):
        models.save(model, str(tmp_path / kind))
        a, b = (models.FeatureScorer(m, used).score(df).orderBy("id").collect() for m in (model, models.load(kind, str(tmp_path / kind))))
        assert a == b and np.mean([(r["score"] >= 0.5) == (r["label"] == 1) for r in a]) > 0.95
    scored = models.score(models.fit_lr(df, used), df, used)
    iso = models.fit_isotonic(scored)
    models.save(iso, str(tmp_path / "isotonic"))
    assert models.calibrate(models.load("isotonic", str(tmp_path / "isotonic")), scored).orderBy("id").collect() == models.calibrate(iso, scored).orderBy("id").collect()


def test_probabilities():
    assert np.allclose(models.as_probability(np.array([[0.0, 0.0], [0.0, 50.0]])), [0.5, 1.0])
    assert np.allclose(models.as_probability(np.array([0.2, 0.9])), [0.2, 0.9])
    assert np.allclose(models.as_probability(np.array([-3.0, 0.5])), 1 / (1 + np.exp([3.0, -0.5])))


def test_scorer_pairs_noise(spark):
    s1 = spark.createDataFrame([("s", "Alpha Beta Inc", "1 St", "US")], "entity_id string, business_name string, business_address string, country string")
    pool = spark.createDataFrame([(f"e{i}", "Alpha Beta Gamma Inc", "", "US") for i in range(200)], s1.schema)
    pairs = pool.select(F.lit("s").alias("sid"), F.col("entity_id").alias("eid"), F.when(F.substring("entity_id", 2, 9).cast("int") < 100, 1).otherwise(0).alias("label"))
    got = models.scorer_pairs(pairs, s1, pool, 30).collect()
    plain = "COL name VAL Alpha Beta Gamma Inc COL country VAL US"
    assert all(r["right"] == plain for r in got if r["label"] == 0)
    changed = sum(r["right"] != plain for r in got if r["label"] == 1)
    assert 5 <= changed <= 35 and got[0]["left"] == "COL name VAL Alpha Beta Inc COL address VAL 1 St COL country VAL US"
