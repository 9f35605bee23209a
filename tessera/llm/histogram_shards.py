"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by (hash of the text, id), so equal texts stand together. Splitters that cut this order into
ranges of equal bytes are found without sorting: each round counts the exact bytes and rows below candidate
key boundaries, in every partition with a partial sum, and the driver refines only the intervals in which a
splitter still lies outside the tolerance. When the interval has shrunk to one text, its ids are probed, so
one huge group of equal texts is cut like anything else. Rows are then exchanged once, straight to the
range they belong to; the counts below the splitters give every row its gapless slot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.runtime import Scratch

#: Share of an even shard's bytes by which a splitter may miss its target.
TOLERANCE = 0.002
_FIRST_BITS, _MORE_BITS = 12, 8
_ROWS_A_RANGE, _MOST_RANGES = 2_000_000, 960
_LOW = -(1 << 63)


@dataclass
class _Open:
    """A target with the interval in which its splitter lies: keys with a prefix, or one key's ids from lo to hi."""

    target: float
    below: tuple[int, int]  # bytes and rows before the interval
    prefix: int = 0
    key: int | None = None
    lo: int = 0
    hi: int = 0

    @property
    def shift(self) -> int:
        """Id bits below those in which the ids of the interval differ first."""
        return max(0, ((self.lo ^ self.hi) & ((1 << 64) - 1)).bit_length() - _MORE_BITS)


def _counts():
    return F.sum("size").alias("b"), F.count("*").alias("n"), F.min("k").alias("k_lo"), F.max("k").alias("k_hi"), F.min("d").alias("d_lo"), F.max("d").alias("d_hi")


def find_splitters(rows: DataFrame, ranges: int, tolerance: float, shards: int) -> list[tuple[tuple[int, int], int]]:
    """``ranges - 1`` splitters over ``rows`` (k, d, size), each with the number of rows below it."""
    spark = rows.sparkSession
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    if not total["n"]:
        return [((_LOW, _LOW), 0)] * (ranges - 1)
    limit = tolerance * total["b"] / shards
    found: dict[int, tuple[tuple[int, int], int]] = {}
    opened = {j: _Open(total["b"] * j / ranges, (0, 0)) for j in range(1, ranges)}
    bits, back = _FIRST_BITS, None
    while opened:
        after: dict[int, _Open] = {}
        if by_key := {j: o for j, o in opened.items() if o.key is None}:
            counted = rows.withColumn("p", F.shiftright("k", 64 - bits))
            if back is not None:
                wanted = spark.createDataFrame([(p,) for p in {o.prefix for o in by_key.values()}], "q bigint")
                counted = counted.join(F.broadcast(wanted), F.shiftright("p", back) == F.col("q"), "left_semi")
            counted = sorted(counted.groupBy("p").agg(*_counts()).collect(), key=lambda r: r["p"])
            for j, o in by_key.items():
                own = [r for r in counted if back is None or r["p"] >> back == o.prefix]
                after |= _step(j, o, own, lambda p, s=64 - bits: (p << s, _LOW), limit, found)
            back, bits = min(_MORE_BITS, 64 - bits), min(64, bits + _MORE_BITS)
        if by_id := {j: o for j, o in opened.items() if o.key is not None}:
            wanted = spark.createDataFrame(list({(o.key, o.lo, o.hi, o.shift) for o in by_id.values()}), "wk bigint, lo bigint, hi bigint, shift int")
            counted = rows.join(F.broadcast(wanted), F.expr("k = wk and d between lo and hi")).groupBy("wk", "lo", F.expr("shiftright(d, shift)").alias("p")).agg(*_counts()).collect()
            for j, o in by_id.items():
                own = sorted((r for r in counted if (r["wk"], r["lo"]) == (o.key, o.lo)), key=lambda r: r["p"])
                after |= _step(j, o, own, lambda p, o=o: (o.key, p << o.shift), limit, found)
        opened = after
    return [found[j] for j in range(1, ranges)]


def _step(j, o, own, edge, limit, found) -> dict[int, _Open]:
    """Settle target ``j`` on a boundary of the counted buckets, or open the bucket that it falls into."""
    b, n = o.below
    for r in own:
        lower, upper = (edge(r["p"]), (b, n)), (edge(r["p"] + 1), (b + r["b"], n + r["n"]))
        if o.target <= upper[1][0] or r is own[-1]:
            best = min((lower, upper), key=lambda e: abs(e[1][0] - o.target))
            one_key = r["k_lo"] == r["k_hi"]
            if abs(best[1][0] - o.target) <= limit or one_key and r["d_lo"] == r["d_hi"]:
                found[j] = best[0], best[1][1]
                return {}
            if one_key:
                return {j: _Open(o.target, (b, n), 0, r["k_lo"], r["d_lo"], r["d_hi"])}
            return {j: _Open(o.target, (b, n), r["p"])}
        b, n = b + r["b"], n + r["n"]
    raise AssertionError("an open interval has rows")


def _range_of(edges: list[tuple[int, int]]):
    """The number of edges at or below a row's (k, d), by binary search in one array of edges in order."""
    edges = [(k + 1, _LOW) if d >= 1 << 63 else (k, d) for k, d in edges]
    edges = [e for e in edges if e[0] < 1 << 63]  # no row lies beyond the others
    if not edges:
        return F.lit(0)
    known = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(d).cast("bigint").alias("d")) for k, d in edges])
    own, steps = F.struct("k", "d"), [1 << i for i in reversed(range(len(edges).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, step: F.when(F.get(known, n + step - 1) <= own, n + step).otherwise(n))


def shard(docs: DataFrame, shards: int = 24, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``, by the law ``bytes``.

    Shard sizes in bytes differ from even ones by the tolerance at each end, or by one row where rows are larger.
    Rows with equal texts share a shard unless their group is cut by a splitter. A null text has no bytes and the
    checksum of nothing; null ids come first among equal texts; rows alike in text and id share a shard and have
    slots of their own; with fewer rows than shards some shards are empty. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(8)).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.xxhash64(text).alias("k"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LOW)).alias("d"),
    )
    rows = scratch.table(rows, "rows")
    slices = max(1, min(_MOST_RANGES // shards, -(-rows.count() // (shards * _ROWS_A_RANGE))))
    splitters = find_splitters(rows.select("k", "d", "size"), shards * slices, tolerance, shards)
    starts = [0] + [below for _, below in splitters]
    there = rows.withColumn("part", _range_of([edge for edge, _ in splitters])).repartitionById(shards * slices, F.col("part")).sortWithinPartitions("k", "d")
    begun = F.array(*[F.lit(starts[i] - starts[i - i % slices]).cast("bigint") for i in range(len(starts))])
    in_range = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return there.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.floor(F.col("part") / slices).cast("int").alias("shard"),
        (in_range + F.get(begun, F.col("part"))).alias("slot"), F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
    )


def op3_histogram_shards(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
