"""Scratch tables, size-checked joins, and plans that read no more than they need."""

import os

import pytest
from pyspark.sql import functions as F

from tessera import runtime
from tessera.operators import blocking
from tessera.plans import registry
from tessera.plans.linkage import Linkage


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scratch(spark):
    s = runtime.Scratch(spark, "test")
    t = s.table(spark.range(5).toDF("x"), "a")
    assert t.count() == 5 and s.root.startswith(runtime.shared_dir(spark))
    assert s.table(spark.range(0).toDF("x"), "b").count() == 0
    s.drop("a")
    with pytest.raises(Exception, match="(?i)path|file"):
        spark.read.parquet(s.path("a"))


def test_scratch_has_no_checksum_files(spark):
    s = runtime.Scratch(spark, "test")
    t = s.table(spark.range(0, 400, 1, 8).toDF("x"), "a")
    names = os.listdir(s.path("a").removeprefix("file:"))
    assert t.count() == 400 and sum(n.endswith(".parquet") for n in names) == 8 and not [n for n in names if n.endswith(".crc")]


def test_a_cluster_needs_a_shared_folder():
    class Spark:
        class sparkContext:
            master = "local-cluster[2,1,1024]"
            getConf = staticmethod(dict)

        conf = {}

    with pytest.raises(RuntimeError, match="share"):
        runtime.shared_dir(Spark)


def test_settings_return(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), runtime.arrow_rows(spark, 3):
        assert spark.conf.get(key) == "3"
        1 / 0
    assert spark.conf.get(key) == before


def test_joins_by_size(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = spark.range(100).toDF("k"), spark.range(50).toDF("k")
        small, large = runtime.join_by_size(a, b, ["k"], "inner", 16), runtime.join_by_size(a, b, ["k"], "inner", 1 << 30)
        assert "BroadcastHashJoin" in plan(small) and "SortMergeJoin" in plan(large)
        assert small.count() == large.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scan_reads_what_it_needs(spark, sf):
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in plan(registry.QUERIES["class_report"](spark, sf))
    assert "ReadSchema: struct<lang:string,text:string>" not in plan(registry.QUERIES["entity_split"](spark, sf))


def test_candidates_rank_with_group_limit(spark, sf):
    run = Linkage(spark, sf)
    df = blocking.candidates(run.s1_pre, run.pool_pre, run.idf, 5, 50)
    assert "WindowGroupLimit" in plan(df)
    rows = df.collect()
    assert max(r["rank"] for r in rows) == 5 and len({(r["sid"], r["eid"]) for r in rows}) == len(rows)


def test_postings_have_one_scan(spark, sf):
    p = plan(blocking.postings(Linkage(spark, sf).pool_pre))
    assert p.count("FileScan") == 1 and "Exchange" not in p
    assert blocking.postings(Linkage(spark, sf).pool_pre).groupBy("eid", "fld", "token").agg(F.count("*").alias("n")).where("n > 1").count() == 0
