"""Decisions per entity: thresholds, guards, sweeps, score merging, closure and samples.

Thresholds are whole hundredths, so a grid has no rounding of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.metrics import f05_counts

BUMP, MARGIN_GAP = 10, 0.05
UNCERTAIN, RERANK = (0.2, 0.8), 20


def ranked(scores: DataFrame) -> DataFrame:
    """Adds each pair's ``rank`` and its entity's ``best``; ties go to the smaller id."""
    return _ranked(scores).drop("gap")


def _ranked(scores: DataFrame) -> DataFrame:
    """``ranked`` with the ``gap`` of ``entity_stats``, all from one order of an entity's pairs."""
    by = Window.partitionBy("sid").orderBy(F.desc("score"), "eid")
    second = F.nth_value("score", 2).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return scores.withColumns({"rank": F.row_number().over(by), "best": F.first("score").over(by), "gap": F.first("score").over(by) - second})


def entity_stats(scores: DataFrame) -> DataFrame:
    """``sid, best, gap``: best score and its lead on the second; null lead for a single candidate."""
    return _ranked(scores).where(F.col("rank") == 1).select("sid", "best", "gap")


def effective_threshold(st: Column, country: Column, gap: Column, margin_gap: float = MARGIN_GAP) -> Column:
    """The threshold, in hundredths, that an entity's best score must reach: raised for France, or for a close second."""
    france = F.lower(F.trim(country)) == "france"
    return F.greatest(st + F.when(france, BUMP).otherwise(0), st + F.when(gap < margin_gap, BUMP).otherwise(0))


def decide(entities: DataFrame, scores: DataFrame, match_t: int, singleton_t: int) -> DataFrame:
    """``sid, eid, score, rank`` of accepted pairs: all at ``match_t`` or above, if the entity's best passes its threshold."""
    known = entities.select(F.col("sid").alias("of"), "country")
    passed = (F.col("sid") == F.col("of")) & (F.col("best") * 100 >= effective_threshold(F.lit(singleton_t), F.col("country"), F.col("gap")))
    return _ranked(scores).join(known, passed, "left_semi").where(F.col("score") * 100 >= match_t).select("sid", "eid", "score", "rank")


def _hits(scores: DataFrame, gold: DataFrame) -> DataFrame:
    return scores.select("sid", "eid", "score").join(gold.withColumn("hit", F.lit(1)), ["sid", "eid"], "left")


def threshold_sweep(entities: DataFrame, scores: DataFrame, gold: DataFrame, grid: tuple[int, ...] = tuple(range(5, 95, 2))) -> DataFrame:
    """``t, macro_f05`` for every threshold. Counts for the whole grid come from one pass over the scores."""
    true = gold.groupBy("sid").agg(F.count("*").alias("n_gold"))
    at = lambda t: F.col("score") * 100 >= t
    per = _hits(scores, gold).groupBy("sid").agg(*[F.count(F.when(at(t), 1)).alias(f"p{t}") for t in grid], *[F.count(F.when(at(t) & F.col("hit").isNotNull(), 1)).alias(f"h{t}") for t in grid])
    full = entities.select("sid").join(per, "sid", "left").join(true, "sid", "left").na.fill(0)
    means = full.agg(*[F.avg(f05_counts(F.col(f"h{t}"), F.col(f"p{t}"), F.col("n_gold"))).alias(f"f{t}") for t in grid])
    return means.select(F.inline(F.array(*[F.struct(F.lit(t).alias("t"), F.round(f"f{t}", 6).alias("macro_f05")) for t in grid])))


def two_threshold_sweep(entities: DataFrame, scores: DataFrame, gold: DataFrame, match: tuple[int, ...] = tuple(range(20, 81, 5)), singleton: tuple[int, int, int] = (40, 96, 5)) -> DataFrame:
    """``mt, st, macro_f05`` over the grid; the singleton ladder starts at the match threshold or at its own start."""
    true = gold.groupBy("sid").agg(F.count("*").alias("n_gold"))
    at = lambda t: F.col("score") * 100 >= t
    per = _hits(scores, gold).groupBy("sid").agg(*[F.count(F.when(at(t), 1)).alias(f"p{t}") for t in match], *[F.count(F.when(at(t) & F.col("hit").isNotNull(), 1)).alias(f"h{t}") for t in match])
    full = entities.select("sid", "country").join(per, "sid", "left").join(entity_stats(scores), "sid", "left").join(true, "sid", "left").na.fill(0, [*(f"p{t}" for t in match), *(f"h{t}" for t in match), "n_gold"])
    ladder = F.array(*[F.struct(F.lit(mt).alias("mt"), F.lit(st).alias("st"), F.col(f"p{mt}").alias("n_pred"), F.col(f"h{mt}").alias("tp")) for mt in match for st in range(max(mt, singleton[0]), singleton[1], singleton[2])])
    grid = full.select("country", "best", "gap", "n_gold", F.inline(ladder))
    passed = F.col("best") * 100 >= effective_threshold(F.col("st"), F.col("country"), F.col("gap"))
    zero = lambda c: F.when(passed, F.col(c)).otherwise(0)
    return grid.groupBy("mt", "st").agg(F.round(F.avg(f05_counts(zero("tp"), zero("n_pred"), F.col("n_gold"))), 6).alias("macro_f05"))


def best_of(sweep: DataFrame, *keys: str) -> DataFrame:
    """The first grid point, in grid order, with the best value."""
    return sweep.orderBy(F.desc("macro_f05"), *keys).limit(1)


def uncertain(scores: DataFrame, band: tuple[float, float] = UNCERTAIN, top_k: int = RERANK) -> DataFrame:
    """The ``top_k`` pairs of entities whose best score lies in the band: what a costly scorer looks at."""
    return ranked(scores).where(F.col("best").between(*band) & (F.col("rank") <= top_k)).select("sid", "eid", "score", "rank")


def merge_scores(scores: DataFrame, override: DataFrame | None) -> DataFrame:
    """Scores, replaced where ``override`` (sid, eid, score) has one; no scorer, no override."""
    if override is None:
        return scores
    o = override.select("sid", "eid", F.col("score").alias("over"))
    return scores.join(o, ["sid", "eid"], "left").withColumn("score", F.coalesce("over", "score")).drop("over")


def closure(matches: DataFrame, links: DataFrame | None = None, edge: float = 0.9, largest: int = 15) -> DataFrame:
    """Matches (sid, eid, score) closed within each entity.

    Without ``links`` the closure adds nothing. With ``links`` (x, y, score) between pool records, what a match at
    ``edge`` or above reaches over links at ``edge`` or above joins the entity, unless its component has more than
    ``largest`` members.
    """
    if links is None:
        return matches.select("sid", "eid")
    from tessera.operators.graph import connected_components

    comp = connected_components(links.where(F.col("score") >= edge), "x", "y")
    small = comp.join(comp.groupBy("component").count().where(F.col("count") <= largest).select("component"), "component")
    sure = matches.where(F.col("score") >= edge).join(small.withColumnRenamed("node", "eid"), "eid").select("sid", "component").distinct()
    more = sure.join(small, "component").select("sid", F.col("node").alias("eid"))
    return matches.select("sid", "eid").unionByName(more).distinct()


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The ``n`` rows with the smallest hash of their key: the same on every run and in any engine. Null keys come last."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))).asc_nulls_last(), key).limit(n)


def in_training_part(key: Column, percent: int = 70) -> Column:
    """Split by entity, never by pair; by a hash that any engine can compute."""
    return F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("int") % 100 < percent


def training_pairs(cands: DataFrame, gold: DataFrame, per_positive: int = 5) -> DataFrame:
    """``sid, eid, label``: all gold candidates, and the first ``per_positive`` times as many others by rank."""
    p = cands.select("sid", "eid", "rank").join(gold.withColumn("label", F.lit(1)), ["sid", "eid"], "left").na.fill(0, ["label"])
    by = Window.partitionBy("sid")
    p = p.withColumn("pos", F.sum("label").over(by)).withColumn("at", F.row_number().over(Window.partitionBy("sid", "label").orderBy("rank")))
    return p.where((F.col("label") == 1) | (F.col("at") <= per_positive * F.greatest(F.lit(1), F.col("pos")))).select("sid", "eid", "label")


def violations(results: DataFrame, s1: DataFrame, pool: DataFrame, cands: DataFrame) -> DataFrame:
    """``rule, n``: broken rules of a result table (source1_entity_id, matched_entity_ids)."""
    rows = results.select(F.col("source1_entity_id").alias("sid"), F.split("matched_entity_ids", ",").alias("ids"))
    long = rows.select("sid", F.explode("ids").alias("eid")).where("eid <> ''")
    checks = {
        "missing_record": s1.select(F.col("entity_id").alias("sid")).join(rows, "sid", "left_anti"),
        "repeated_record": rows.groupBy("sid").count().where("count > 1"),
        "repeated_match": rows.where(F.size("ids") != F.size(F.array_distinct("ids"))),
        "self_match": long.where("sid = eid"),
        "unknown_match": long.join(pool.select(F.col("entity_id").alias("eid")), "eid", "left_anti"),
        "match_outside_candidates": long.join(cands.select("sid", "eid"), ["sid", "eid"], "left_anti"),
    }
    out = None
    for rule, bad in checks.items():
        part = bad.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = part if out is None else out.unionByName(part)
    return out
