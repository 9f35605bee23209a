"""Scans and sinks on awkward files."""

import pytest
from pyspark.sql import functions as F

from tessera.sources import tsv


@pytest.fixture
def messy(tmp_path):
    p = tmp_path / "s.tsv"
    p.write_bytes(b"entity_id\tname\taddr\tcountry\nS1\tA \"q\", b\\x\t1 St\tUS\n\nS2\tB\nS3\tC\tx\tFR\textra\nS4\t\xff\t\tIN\n")
    return str(p)


WANT = [("S1", 'A "q", b\\x', "1 St", "US"), ("S2", "B", "", ""), ("S3", "C", "x", "FR"), ("S4", "�", "", "IN")]


def test_entities(spark, messy):
    assert sorted(map(tuple, tsv.read_entities(spark, messy).collect())) == WANT
    assert sorted(map(tuple, tsv.read_entities_csv(spark, messy).collect())) == WANT
    with open(messy, "rb") as f, open(messy + "2", "wb") as g:
        g.write(f.read())
    assert tsv.read_entities(spark, messy, messy + "2").count() == 8


def test_truth(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("s\tm\nS1\ta,b,,\nS2\t\nS3\nS4\ta,a, b\n")
    t = tsv.read_truth(spark, str(tmp_path / "t.tsv"))
    assert {r["sid"]: r["gold"] for r in t.collect()} == {"S1": ["a", "b"], "S2": [], "S3": [], "S4": ["a", " b"]}
    assert tsv.truth_long(t).count() == 6


def test_results_in_order(spark, tmp_path):
    s1 = spark.createDataFrame([("x", 1), ("a", 2)], "entity_id string, ordinal int")
    m = spark.createDataFrame([("a", "p", 2), ("a", "q", 1), ("a", "p", 3)], "sid string, eid string, rank int")
    tsv.write_results(tsv.result_rows(s1, m), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert [x for x in text.split("\n") if x and not x.startswith("source1")] == ["x\t", "a\tq,p"]


def test_resume(spark, tmp_path):
    df = spark.range(10).select(F.col("id").cast("string").alias("eid"))
    path = str(tmp_path / "v")
    assert tsv.write_missing(df.where("id < 4"), path).count() == 4
    assert tsv.write_missing(df, path).count() == 10
    assert tsv.write_missing(df, path).count() == 10


def test_model_files(spark, tmp_path):
    p = str(tmp_path / "m.json")
    assert tsv.read_json(p, {"d": 1}) == {"d": 1}
    tsv.write_linear_model(p, [0.12345678], 1, 0.55555)
    assert tsv.read_json(p) == {"type": "lr", "coef": [0.123457], "intercept": 1.0, "threshold": 0.5555}
    tsv.append_log(spark, {"n": 1}, str(tmp_path / "log"))
    tsv.append_log(spark, {"n": 2}, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    assert tsv.dataset_root(spark, "x") == "x"
