"""Shards by histogram sort: every row once, even bytes, gapless slots, equal texts together."""

import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import histogram_shards as H


def check(spark, df, shards, tolerance=H.TOLERANCE, largest=None):
    rows = df.select(F.col("doc_id").cast("long"), "text").collect()
    got = H.shard(df, shards, tolerance).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == sorted(((r["doc_id"], size(r["text"]), zlib.crc32((r["text"] or "").encode())) for r in rows), key=repr)
    by: dict[int, list] = {}
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        by.setdefault(r["shard"], []).append(r)
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    total = sum(size(r["text"]) for r in rows)
    most = largest or max((size(r["text"]) for r in rows), default=0)
    for s in range(shards):
        assert abs(sum(r["size"] for r in by.get(s, [])) - total / shards) <= 2 * tolerance * total / shards + most
    return got


def test_fixture(spark, sf):
    got = check(spark, spark.read.parquet(f"{sf}/documents.parquet"), 24)
    assert len({r["shard"] for r in got}) == 24


def test_hot_text_is_cut_by_id(spark):
    hot = spark.range(4000).select((F.col("id") * 11).alias("doc_id"), F.lit("same " * 50).alias("text"))
    rest = spark.range(2000).select((-F.col("id")).alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    check(spark, hot.unionByName(rest).withColumn("size", F.lit("clash")).withColumn("k", F.lit(1)), 8)


def test_several_ranges_a_shard(spark, monkeypatch):
    monkeypatch.setattr(H, "_ROWS_A_RANGE", 20)
    check(spark, spark.range(900).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text")), 6)


@pytest.mark.parametrize("rows", [[], [(1, "a")], [(None, None), (None, None), (None, "x"), (5, ""), (5, ""), (-(2**63), "y"), (2**63 - 1, "y")]])
def test_few_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = H.shard(df, 3).collect()
    assert len(got) == len(rows)
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_native_plan(spark, sf):
    df = H.op3_histogram_shards(spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1
