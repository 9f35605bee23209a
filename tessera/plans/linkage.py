"""The stages of a linkage run, each made once: records, postings, candidates, features, scores."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import features as FE
from tessera.functions import text as X
from tessera.operators import blocking
from tessera.runtime import Scratch
from tessera.sources import fixture

#: Caps at which both limits bite on the fixture; the operators' defaults are for full-size sources.
CAP, MAX_POSTING = 20, 100
#: Pairs that are shuffled with their records at a time, at least.
ROUND_PAIRS = 1 << 21


class Linkage:
    """Lazily built tables of one run. Records are normalised once and written, since every later stage reads them."""

    def __init__(self, spark: SparkSession, sf_dir: str, cap: int = CAP, max_posting: int = MAX_POSTING, fuzzy: bool = False):
        self.spark, self.sf_dir, self.cap, self.max_posting, self.fuzzy = spark, sf_dir, cap, max_posting, fuzzy
        self.scratch = Scratch(spark, "linkage")

    @cached_property
    def s1(self) -> DataFrame:
        return fixture.s1(self.spark, self.sf_dir)

    @cached_property
    def pool(self) -> DataFrame:
        return fixture.pool(self.spark, self.sf_dir)

    @cached_property
    def truth(self) -> DataFrame:
        return fixture.truth(self.spark, self.sf_dir)

    @cached_property
    def gold(self) -> DataFrame:
        return self.truth.select("sid", F.explode("gold").alias("eid"))

    @cached_property
    def s1_pre(self) -> DataFrame:
        return self.scratch.table(X.precompute(self.s1), "s1")

    @cached_property
    def pool_pre(self) -> DataFrame:
        return self.scratch.table(X.precompute(self.pool), "pool")

    @cached_property
    def idf(self) -> DataFrame:
        return self.scratch.table(blocking.idf(self.pool_pre), "idf")

    @cached_property
    def entities(self) -> DataFrame:
        return self.s1.select(F.col("entity_id").alias("sid"), "country")

    @cached_property
    def candidates(self) -> DataFrame:
        return self.scratch.table(blocking.candidates(self.s1_pre, self.pool_pre, self.idf, self.cap, self.max_posting), "candidates")

    @property
    def pairs(self) -> DataFrame:
        return self.candidates.select("sid", "eid", F.col("score").alias("block_score"))

    def features(self, cosine: DataFrame | None = None, fuzzy: bool = False) -> DataFrame:
        return FE.pair_features(self.pairs, self.s1_pre, self.pool_pre, self.idf, FE.name_frequency(self.s1_pre), cosine, fuzzy)

    @cached_property
    def scored(self) -> DataFrame:
        """``sid, eid, score`` by the fixed linear scorer, as a probability; without ``fuzzy`` five of its fifteen features are 0."""
        return self.compared("scored", self.pairs, lambda f: f.select("sid", "eid", F.round(1 / (1 + F.exp(-FE.linear_score(f))), 6).alias("score")))

    def compared(self, name: str, pairs: DataFrame, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """What ``made`` makes of the features of ``pairs``, the candidates with any columns, row by row, written."""
        rounds, freq = self.rounds(), FE.name_frequency(self.s1_pre)
        if rounds == 1:
            return self.scratch.table(made(FE.pair_features(pairs, self.s1_pre, self.pool_pre, self.idf, freq, fuzzy=self.fuzzy)), name)
        # a round's pairs, with all that is compared of their records, are shuffled and deleted before the next round
        left, right = FE.sides(self.s1_pre, self.pool_pre, self.idf, freq)
        left, right, parts = self.scratch.table(left, "left"), self.scratch.table(right, "right"), None
        for k in range(rounds):
            mine = F.pmod(F.xxhash64("sid", F.lit(rounds)), F.lit(rounds)) == k
            part = self.scratch.table(made(FE.compared(pairs.where(mine), left.where(mine), right, fuzzy=self.fuzzy)), f"{name}{k}")
            parts = part if parts is None else parts.unionByName(part)
        self.scratch.drop("left")
        self.scratch.drop("right")
        return parts

    def rounds(self) -> int:
        """So many that a round has few pairs, but several for each record that it shuffles again."""
        records = self.s1_pre.count() + self.pool_pre.count()
        return max(1, -(-self.candidates.count() // max(ROUND_PAIRS, 4 * records)))


class Full(Linkage):
    """A run with the limits of full-size sources that scores with all fifteen weighted features.

    SQL cannot express five of them, and is too slow at these limits, so its queries have no oracle.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, cap: int = blocking.CAP, max_posting: int = blocking.MAX_POSTING):
        super().__init__(spark, sf_dir, cap, max_posting, fuzzy=True)
