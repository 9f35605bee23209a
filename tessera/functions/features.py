"""Pair features over precomputed records. Both sides are computed once; pairs only join and compare them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import lexicon as L
from tessera.functions import similarity as S
from tessera.functions.text import padded_grams

# Names and order of the features.
FEATURES = (
    "idf_name_jac", "name_contain", "char_sim", "house_agree", "addr_jac", "addr_exact", "city_agree", "name_rare",
    "name_len_ratio", "jaro_winkler", "tfidf_cos", "rf_token_sort", "rf_token_set", "rf_partial", "rf_addr_sort",
    "phonetic_match", "name_rarity_log",
)
EXTENDED = (*FEATURES, "cosine", "idf_contain_fwd", "idf_contain_rev")


def name_frequency(s1: DataFrame) -> DataFrame:
    """``country, name_sq, freq`` over precomputed S1 records."""
    return s1.groupBy(F.trim("country").alias("country"), "name_sq").agg(F.count("*").alias("freq"))


def with_weights(pre: DataFrame, idf: DataFrame) -> DataFrame:
    """Adds ``name_w``: each distinct name token with its IDF (1 where unknown), and grams of the squashed name."""
    w = pre.select("entity_id", F.explode_outer("name_set").alias("token")).join(idf, "token", "left")
    w = w.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("token", F.coalesce("idf", F.lit(1.0)).alias("w"))))).alias("name_w"))
    return pre.join(w, "entity_id").withColumn("grams", padded_grams(F.col("name_sq")))


def _sum(ws: Column, square: bool = False) -> Column:
    return F.aggregate(ws, F.lit(0.0), lambda a, x: a + (x.w * x.w if square else x.w))


def _share(both: Column, whole: Column) -> Column:
    return F.when(whole > 0, both / whole).otherwise(0.0)


def _jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(n / (F.size(a) + F.size(b) - n))


def _gram_codes(grams: Column) -> Column:
    """Each gram of three characters as one number."""
    at = lambda g, i: F.ascii(F.substring(g, i, 1)).cast("bigint")
    return F.transform(grams, lambda g: at(g, 1) * (1 << 42) + at(g, 2) * (1 << 21) + at(g, 3))


def sides(s1: DataFrame, pool: DataFrame, idf: DataFrame, freq: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a pair's comparison needs of its record (sid) and of its partner (eid)."""
    own = ("name_sq", "name_set", "house_set", "addr_sq", "addr_set", "city", "folded")
    made = {"grams": _gram_codes(F.col("grams")), "sum": _sum(F.col("name_w")), "norm": F.sqrt(_sum(F.col("name_w"), True)), "sound": F.soundex("name_sq")}

    def side(df, key, tag, *more):
        return with_weights(df, idf).select(F.col("entity_id").alias(key), *more, *[F.col(c).alias(f"{tag}_{c}") for c in own], *[c.alias(f"{tag}_{k}") for k, c in made.items()])

    left = side(s1, "sid", "a", F.trim("country").alias("country"), F.col("name_w").alias("a_name_w"))
    return left.join(freq.withColumnRenamed("name_sq", "a_name_sq"), ["country", "a_name_sq"], "left"), side(pool, "eid", "b")


def _with_fuzzy(p: DataFrame) -> DataFrame:
    """Adds the features that need Python, all five in one pass, in place of the texts that they compare."""
    texts = {f"{side}_{field}" for field in S.FUZZY for side in "ab"}
    kept = [f for f in p.schema.fields if f.name not in texts]
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            made = {}
            for field, wanted in S.FUZZY.items():
                pairs, at = S.distinct(batch.column(f"a_{field}").to_pylist(), batch.column(f"b_{field}").to_pylist())
                for name, how in wanted.items():
                    value = S.of_pairs(*how, pairs)[at]
                    made[name] = pa.array(value, pa.float64(), mask=np.isnan(value))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made.values()], names=[*names, *made])

    schema = T.StructType([*kept, *(T.StructField(n, T.DoubleType()) for wanted in S.FUZZY.values() for n in wanted)])
    return p.mapInArrow(run, schema)


def pair_features(pairs: DataFrame, s1: DataFrame, pool: DataFrame, idf: DataFrame, freq: DataFrame, cosine: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """Features of ``pairs`` (sid, eid, ...), which keep their columns.

    ``fuzzy=False`` leaves out the five features that need Python, as 0. ``cosine`` (sid, eid, cosine) adds the
    three extended features; pairs that it lacks have cosine 0.
    """
    return compared(pairs, *sides(s1, pool, idf, freq), cosine, fuzzy)


def compared(pairs: DataFrame, left: DataFrame, right: DataFrame, cosine: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """The features of ``pair_features`` over the two ``sides``."""
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    p = pairs.join(left, "sid").join(right, "eid")
    # used several times, so a column of its own
    p = p.withColumn("both_w", F.filter(a("name_w"), lambda x: F.array_contains(b("name_set"), x.token))).withColumn("both_sum", _sum(F.col("both_w")))
    both, shared, fwd, rev = F.col("both_w"), F.col("both_sum"), a("sum"), b("sum")
    n1, n2, empty = a("norm"), b("norm"), F.size("both_w") == 0
    la, lb = F.length(a("name_sq")), F.length(b("name_sq"))
    count = F.coalesce("freq", F.lit(1))
    made = {
        "idf_name_jac": F.when(empty, 0.0).otherwise(_share(shared, fwd + rev - shared)),
        "name_contain": F.when(F.size(a("name_set")) > 0, F.size(both) / F.size(a("name_set"))).otherwise(0.0),
        "char_sim": F.when((la == 0) | (lb == 0), 0.0).otherwise(_jaccard(a("grams"), b("grams"))),
        "house_agree": F.arrays_overlap(a("house_set"), b("house_set")).cast("double"),
        "addr_jac": _jaccard(a("addr_set"), b("addr_set")),
        "addr_exact": ((F.length(a("addr_sq")) >= 8) & (a("addr_sq") == b("addr_sq"))).cast("double"),
        "city_agree": ((a("city") != "") & (a("city") == b("city"))).cast("double"),
        "name_rare": (count < 4).cast("double"),
        "name_len_ratio": F.when((la == 0) | (lb == 0), 0.0).otherwise(F.least(la, lb) / F.greatest(la, lb)),
        "jaro_winkler": F.lit(0.0),
        "tfidf_cos": F.when(empty | (n1 * n2 == 0), 0.0).otherwise(_sum(both, True) / (n1 * n2)),
        "rf_token_sort": F.lit(0.0),
        "rf_token_set": F.lit(0.0),
        "rf_partial": F.lit(0.0),
        "rf_addr_sort": F.lit(0.0),
        "phonetic_match": F.when((la == 0) | (lb == 0), 0.0).otherwise((a("sound") == b("sound")).cast("double")),
        "name_rarity_log": F.log(F.lit(1.0) / F.greatest(count, F.lit(1)) + 1),
    }
    if cosine is not None:
        p = p.join(cosine.select("sid", "eid", "cosine"), ["sid", "eid"], "left")
        made |= {"cosine": F.coalesce("cosine", F.lit(0.0)), "idf_contain_fwd": _share(shared, fwd), "idf_contain_rev": _share(shared, rev)}
    if not fuzzy:
        return p.select(*pairs.columns, *[v.alias(k) for k, v in made.items()])
    needs_python = [n for wanted in S.FUZZY.values() for n in wanted]
    plain = p.select(*pairs.columns, *[v.alias(k) for k, v in made.items() if k not in needs_python], *[f"{side}_{field}" for field in S.FUZZY for side in "ab"])
    return _with_fuzzy(plain).select(*pairs.columns, *made)


def linear_score(features: DataFrame) -> Column:
    """The scorer without a trained model: fixed weights on the first fifteen features."""
    total = F.lit(L.LINEAR_BIAS)
    for name, w in zip(FEATURES, L.LINEAR_WEIGHTS, strict=False):
        total = total + F.lit(w) * F.col(name)
    return total
