"""Evaluation: per-entity F0.5, ceilings, recall at K, gates and class reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS = (25, 50, 100, 200, 500)
#: Recall at 200 that lets a run proceed, and that calls for another design.
PROCEED, REDESIGN = 0.93, 0.88


def f05_counts(tp: Column, n_pred: Column, n_gold: Column) -> Column:
    """F0.5 from counts: 1 if both sets are empty, 0 if nothing is shared."""
    p, r = tp / n_pred, tp / n_gold
    return F.when((n_pred == 0) & (n_gold == 0), 1.0).when(tp == 0, 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def f05(pred: Column, gold: Column) -> Column:
    return f05_counts(F.size(F.array_intersect(pred, gold)), F.size(pred), F.size(gold))


def per_entity(entities: DataFrame, pairs: DataFrame, gold: DataFrame, keep: Column) -> DataFrame:
    """``sid, n_pred, n_gold, tp, f05`` for every entity, also those without pairs or gold."""
    got = pairs.where(keep).join(gold.withColumn("hit", F.lit(1)), ["sid", "eid"], "left").groupBy("sid").agg(F.count("*").alias("n_pred"), F.count("hit").alias("tp"))
    true = gold.groupBy("sid").agg(F.count("*").alias("n_gold"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = entities.select("sid").join(got, "sid", "left").join(true, "sid", "left").select("sid", *[zero(c).alias(c) for c in ("n_pred", "n_gold", "tp")])
    return out.withColumn("f05", f05_counts(F.col("tp"), F.col("n_pred"), F.col("n_gold")))


def summary(per: DataFrame) -> DataFrame:
    """One row: entities, macro F0.5, share of gold links among candidates, mean candidates, gold links.

    ``per`` has ``f05, n_cand, n_gold, n_reached`` for each entity; without gold the ceiling is 1.
    """
    return per.agg(
        F.count("*").alias("n"), F.round(F.avg("f05"), 6).alias("macro_f05"),
        F.round(F.when(F.sum("n_gold") > 0, F.sum("n_reached") / F.sum("n_gold")).otherwise(1.0), 6).alias("recall_ceiling"),
        F.round(F.avg("n_cand"), 6).alias("mean_candidates"), F.sum("n_gold").alias("gold_links"),
    )


def macro_ceiling(entities: DataFrame, cands: DataFrame, gold: DataFrame) -> DataFrame:
    """Macro F0.5 of a perfect matcher on the candidates."""
    reached = cands.join(gold, ["sid", "eid"], "left_semi")
    return per_entity(entities, reached, gold, F.lit(True)).agg(F.count("*").alias("n"), F.round(F.avg("f05"), 6).alias("macro_ceiling"))


def recall_at_k(cands: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """``k, recall``: mean share of an entity's gold among its first k candidates; entities without gold do not count."""
    per = gold.join(cands.select("sid", "eid", "rank"), ["sid", "eid"], "left").groupBy("sid").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("rank") <= k, 1)).alias(f"hit_{k}") for k in ks])
    means = per.agg(*[F.avg(F.col(f"hit_{k}") / F.col("n")).alias(f"r_{k}") for k in ks])
    return means.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.round(f"r_{k}", 6).alias("recall")) for k in ks])))


def gate(recall: Column) -> Column:
    return F.when(recall >= PROCEED, "proceed").when(recall >= REDESIGN, "marginal").otherwise("change")


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of a 0/1 prediction."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    y, p = F.col(label) == 1, F.col(predicted) == 1
    c = df.agg(F.count("*").alias("n"), count(y & p).alias("tp"), count(~y & p).alias("fp"), count(y & ~p).alias("fn"), count(y == p).alias("ok"))
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("n", "tp", "fp", "fn", share(F.col("ok"), F.col("n")).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    pos, neg = F.sum(F.when(F.col(label) == 1, 1).otherwise(0)), F.sum(F.when(F.col(label) == 0, 1).otherwise(0))
    return df.agg(pos.alias("n_pos"), neg.alias("n_neg")).withColumn("scale_pos_weight", F.round(F.col("n_neg") / F.greatest(F.lit(1), F.col("n_pos")), 6))
